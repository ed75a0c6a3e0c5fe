"""The scoring rules: each takes the frames of a corpus and returns (msg_id, rule_id, evidence) of the messages it fires on.

All frames share msg_id. Lists and brands are small settings of a fixed size and are broadcast; what depends on each other (a
homograph is not also punycode) is an anti-join.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import names as N
from ..functions.defang import defang_domain, defang_email
from ..functions.hosts import is_ip_literal, url_host, url_path_query
from ..functions.suffixes import host_suffixes, registrable_domain, registrable_label, rules as suffix_rules, split_host
from ..settings import Settings

#: Imitated labels have at least so many letters.
LEAST_LABEL = 5


@dataclass
class Corpus:
    """Parsed messages, their indicators, and what rules derive from them, each built once."""

    messages: DataFrame
    indicators: DataFrame
    settings: Settings

    def __post_init__(self) -> None:
        spark = self.messages.sparkSession
        self.spark = spark
        self.flat = self.messages.select(
            "msg_id", "auth", "anomalies", "headers", F.col("addresses.from.display_name").alias("name"), F.col("addresses.from.addr_spec").alias("spec"), F.col("addresses.from.domain").alias("domain"),
            F.col("addresses.reply_to.domain").alias("reply_to"), F.col("addresses.return_path.domain").alias("return_path"), F.col("addresses.sender.domain").alias("sender"),
        )
        self.has_results = F.exists("headers", lambda h: h["name_cf"] == "authentication-results")
        self.urls = self.indicators.where("type = 'url'").withColumn("host", url_host(F.col("value")))

    @property
    def candidates(self) -> DataFrame:
        """msg_id, d: domains that a message shows, other than those that only name its recipients."""
        own = self.indicators.where("type = 'domain'").where(F.size(F.array_except("provenance", F.array(F.lit("header:To"), F.lit("header:Cc")))) > 0).select("msg_id", F.col("value").alias("d"))
        hosts = self.urls.where("host is not null").where(~is_ip_literal(F.col("host"))).select("msg_id", F.col("host").alias("d"))
        heads = self.flat.select("msg_id", F.explode(F.array("domain", "reply_to", "return_path", "sender")).alias("d")).where("d is not null")
        return own.unionByName(hosts).unionByName(heads.withColumn("d", F.lower("d"))).where("d <> ''").distinct()

    @property
    def targets(self) -> list[tuple[str, str]]:
        """(domain, the label that names its owner) of every domain that may be imitated."""
        known = suffix_rules()
        out = []
        for d in self.settings.targets:
            label, suffix = split_host(d, known)
            parts = d.split(".")
            out.append((d, label if suffix else parts[-2] if len(parts) > 1 else parts[0]))
        return out


def _rows(frame: DataFrame, rule: str, evidence: Column) -> DataFrame:
    return frame.select("msg_id", F.lit(rule).alias("rule_id"), evidence.alias("evidence"))


def _hits(frame: DataFrame, rule: str, text: Column, *order: str) -> DataFrame:
    """One row a message of several hits, each text once, in order."""
    own = frame.select("msg_id", F.struct(*[F.col(c) for c in order], text.alias("t")).alias("x"))
    return own.groupBy("msg_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("msg_id", F.lit(rule).alias("rule_id"), F.array_distinct(F.transform("x", lambda e: e["t"])).alias("evidence"))


def _auth(method: str, state: str) -> Callable[[Corpus], DataFrame]:
    def rule(c: Corpus) -> DataFrame:
        own = F.col(f"auth.{method}")
        said = F.concat(F.lit(f"{method}={state}"), F.when(own["detail"] != "", F.concat(F.lit(" — "), own["detail"])).otherwise(""))
        return _rows(c.flat.where(own["result"] == state), f"auth.{method}_{state}", F.array(said))

    return rule


def dkim_none(c: Corpus) -> DataFrame:
    return _rows(c.flat.where(c.has_results & (F.col("auth.dkim.result") == "none")), "auth.dkim_none", F.array(F.lit("dkim=none (message carries no valid DKIM signature)")))


def results_missing(c: Corpus) -> DataFrame:
    lossy = F.exists("anomalies", lambda a: a["code"] == "msg_auth_unavailable")
    return _rows(c.flat.where(~c.has_results & ~lossy), "auth.results_missing", F.array(F.lit("no Authentication-Results header present")))


def _mismatch(column: str, label: str) -> Callable[[Corpus], DataFrame]:
    def rule(c: Corpus) -> DataFrame:
        both = c.flat.where(F.col(column).isNotNull() & F.col("domain").isNotNull())
        differ = both.where(registrable_domain(F.col(column)) != registrable_domain(F.col("domain")))
        return _rows(differ, f"identity.{column}_mismatch", F.array(F.concat(F.lit(f"{label} "), defang_domain(F.col(column)), F.lit(" ≠ From "), defang_domain(F.col("domain")))))

    return rule


def word_in(word: Column, text: Column) -> Column:
    """Whether a word stands whole in a text, in any case."""
    return F.regexp_like(text, F.concat(F.lit(r"(?iU)\b\Q"), word, F.lit(r"\E\b")))


def brand_mismatch(c: Corpus) -> DataFrame:
    brands = c.spark.createDataFrame([(k, b, own) for k, (b, own) in enumerate(c.settings.brands.items())], "k int, brand string, own array<string>")
    named = c.flat.where("name is not null and name <> '' and domain is not null").select("msg_id", "name", "domain")
    met = named.join(F.broadcast(brands), word_in(F.col("brand"), F.col("name"))).where(~F.arrays_overlap(host_suffixes(F.lower("domain")), "own"))
    return _hits(met, "identity.display_name_brand_mismatch", F.concat(F.lit('display name claims "'), "brand", F.lit('" but From domain is '), defang_domain(F.col("domain"))), "k")


def freemail_role(c: Corpus) -> DataFrame:
    roles = c.spark.createDataFrame(list(enumerate(c.settings.role_keywords)), "k int, role string")
    own = c.flat.where(F.lower("domain").isin(c.settings.freemail_domains) & F.col("name").isNotNull()).join(brand_mismatch(c).select("msg_id"), "msg_id", "left_anti")
    met = own.join(F.broadcast(roles), word_in(F.col("role"), F.col("name"))).groupBy("msg_id", "name", "spec", "domain").agg(F.array_sort(F.collect_list(F.struct("k", "role"))).alias("roles"))
    said = F.concat(F.lit("freemail sender "), defang_email(F.coalesce("spec", "domain")), F.lit(' presents as "'), "name", F.lit('" ('), F.array_join(F.transform("roles", lambda r: r["role"]), ", "), F.lit(")"))
    return _rows(met, "identity.freemail_role", F.array(said))


def multiple_from(c: Corpus) -> DataFrame:
    own = c.flat.withColumn("all", F.transform(F.filter("headers", lambda h: h["name_cf"] == "from"), lambda h: F.trim(h["value"]))).where(F.size("all") > 1)
    return _rows(own, "identity.multiple_from", F.array(F.concat(F.size("all").cast("string"), F.lit(" From headers: "), F.array_join("all", " | "))))


def name_is_email(c: Corpus) -> DataFrame:
    shown = F.transform(F.regexp_extract_all("name", F.lit(r"(?U)[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)+"), 0), F.lower)
    own = c.flat.withColumn("shown", F.array_distinct(shown)).where(F.size("shown") > 0).where(~((F.size("shown") == 1) & (F.col("shown")[0] == F.lower(F.coalesce("spec", F.lit(""))))))
    return _rows(own, "identity.display_name_is_email", F.array(F.concat(F.lit('From display name is itself an email address: "'), "name", F.lit('"'))))


def homographs(c: Corpus) -> DataFrame:
    """msg_id, d, evidence text of domains whose label imitates another by letters or mixes scripts."""
    imitated = c.spark.createDataFrame(sorted({N.fold(label): label for _, label in c.targets if len(label) >= LEAST_LABEL}.items()), "skeleton string, target string")
    labels = c.candidates.select("msg_id", "d", F.posexplode(F.split("d", r"\.")).alias("k", "raw")).withColumn("label", N.decode_label(F.col("raw")))
    whole = labels.groupBy("msg_id", "d").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda x: x["label"]), ".").alias("display"))
    odd = labels.where(~F.regexp_like("label", F.lit(r"^\p{ASCII}*$"))).withColumn("skeleton", N.latin_skeleton(F.col("label"))).withColumn("mix", N.is_suspicious_mix(F.col("label")))
    hit = odd.join(F.broadcast(imitated), "skeleton", "left").where(F.col("target").isNotNull() | F.col("mix")).groupBy("msg_id", "d").agg(F.min_by(F.struct("target"), "k").alias("t")).join(whole, ["msg_id", "d"])
    shown = F.concat(defang_domain(F.col("display")), F.when(F.col("display") != F.col("d"), F.concat(F.lit(" ("), defang_domain(F.col("d")), F.lit(")"))).otherwise(""))
    said = F.when(F.col("t.target").isNotNull(), F.concat(shown, F.lit(" imitates '"), F.col("t.target"), F.lit("' with look-alike characters"))).otherwise(F.concat(F.lit("mixed-script / confusable domain: "), shown))
    return hit.select("msg_id", "d", "display", said.alias("said"))


def idn_homograph(c: Corpus) -> DataFrame:
    return _hits(homographs(c), "url.idn_homograph", F.col("said"), "d")


def punycode(c: Corpus) -> DataFrame:
    own = c.candidates.where(F.contains("d", F.lit("xn--"))).join(homographs(c).select("msg_id", "d"), ["msg_id", "d"], "left_anti")
    decoded = own.select("msg_id", "d", F.posexplode(F.split("d", r"\.")).alias("k", "raw")).withColumn("label", N.decode_label(F.col("raw"))).groupBy("msg_id", "d").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda x: x["label"]), ".").alias("display"))
    return _hits(decoded, "url.punycode", F.concat(F.lit("punycode/xn-- domain present: "), defang_domain(F.col("d")), F.lit(" ("), defang_domain(F.col("display")), F.lit(")")), "d")


def lookalikes(domains: DataFrame, targets: list[tuple[str, str]], settings: Settings) -> DataFrame:
    """d, target, reason of `domains` (d) that imitate a target: the first target in order."""
    spark = domains.sparkSession
    known = settings.freemail_domains + settings.url_shorteners
    all_targets = [t for t, _ in targets]
    own = domains.select("d").distinct().where(F.regexp_like("d", F.lit(r"^\p{ASCII}+$")) & ~F.contains("d", F.lit("xn--")))
    own = own.where(~F.arrays_overlap(host_suffixes(F.col("d")), F.array(*[F.lit(t) for t in all_targets]))) if all_targets else own.limit(0)
    own = own.withColumns({"reg": registrable_domain(F.col("d")), "label": registrable_label(F.col("d"))}).where("label <> ''").where(~F.col("reg").isin(known))
    frame = spark.createDataFrame([(k, t, label, N.fold(label)) for k, (t, label) in enumerate(sorted(targets)) if len(label) >= LEAST_LABEL], "k int, target string, name string, skeleton string")
    words = F.split("label", "-")
    near = F.expr("length(name) > 5 and left(label, 1) = left(name, 1)") & (F.abs(F.length("label") - F.length("name")) <= F.when(F.length("name") <= 8, 1).otherwise(2))
    folded = N.skeleton(F.col("label")) == F.col("skeleton")
    embeds = (F.size(words) > 1) & F.array_contains(F.transform(words, N.skeleton), F.col("skeleton"))
    met = own.join(F.broadcast(frame), (F.col("label") != F.col("name")) & (folded | embeds | near))  # a settings list by its length: one pass over the domains
    lure = F.try_element_at(F.filter(words, lambda w: w.isin(settings.lures)), F.lit(1))
    met = met.withColumn("distance", F.when(near & ~folded & ~embeds, N.edit_distance(F.col("label"), F.col("name"))))
    typo = F.col("distance") <= F.when(F.length("name") <= 8, 1).otherwise(2)
    reason = F.when(folded, "confusable characters").when(embeds, F.concat(F.lit('embeds the name "'), "name", F.lit('" with "'), lure, F.lit('"'))).when(typo, F.concat(F.lit("edit distance "), F.col("distance").cast("string")))
    found = met.withColumn("reason", reason).where("reason is not null")
    return found.groupBy("d", "reg").agg(F.min_by(F.struct("target", "reason"), "k").alias("x")).select("d", "reg", "x.target", "x.reason")


def lookalike(c: Corpus) -> DataFrame:
    found = c.candidates.join(lookalikes(c.candidates, c.targets, c.settings), "d")
    return _hits(found, "url.lookalike", F.concat(defang_domain(F.col("reg")), F.lit(" is a lookalike of "), defang_domain(F.col("target")), F.lit(" ("), "reason", F.lit(")")), "d")


def anchor_mismatch(c: Corpus) -> DataFrame:
    anchors = c.messages.select("msg_id", F.posexplode(H.inspect_html(F.col("body.html_raw"))["anchors"]).alias("k", "a")).select("msg_id", "k", F.col("a.href").alias("href"), F.col("a.text").alias("text")).withColumn("host", url_host(F.col("href")))
    shared = c.spark.sparkContext.broadcast(suffix_rules())
    shown = first_host(shared)(F.col("text"), F.col("href"))
    own = anchors.where("host is not null").where(~is_ip_literal(F.col("host"))).withColumn("shown", shown).where("shown is not null")
    own = own.where(registrable_domain(F.col("shown")) != registrable_domain(F.col("host")))
    return _hits(own, "url.anchor_href_mismatch", F.concat(F.lit("link text shows "), defang_domain(F.col("shown")), F.lit(" but href points to "), defang_domain(F.col("host"))), "k")


def first_host(shared):
    """The first host name that a reader sees in a link's text: one with a public suffix, and no file name."""
    token = re.compile(r"(?:https?://|www\.)?((?:[\w-]{1,63}\.)+[\w-]{2,63})", re.IGNORECASE)
    files = {"zip", "mov", "md", "py", "sh", "rs", "pm", "ps"}

    def of(text: str, href: str) -> str | None:
        path = href.casefold().partition("?")[0]
        for found in token.finditer(text):
            whole, host = found[0].casefold(), found[1].casefold()
            suffix = split_host(host, shared.value)[1]
            explicit = whole.startswith(("http", "www."))
            if suffix and (explicit or not (suffix in files or f"/{host}" in path)):
                return host
        return None

    @F.pandas_udf("string")
    def run(texts: pd.Series, hrefs: pd.Series) -> pd.Series:
        return pd.Series([of(t, h) if isinstance(t, str) and isinstance(h, str) else None for t, h in zip(texts, hrefs, strict=True)], dtype=object)

    return run


def raw_ip(c: Corpus) -> DataFrame:
    return _hits(c.urls.where("host is not null").where(is_ip_literal(F.col("host"))), "url.raw_ip_host", F.concat(F.lit("URL uses a raw IP host: "), "defanged"), "ord")


def shortener(c: Corpus) -> DataFrame:
    own = c.urls.where("host is not null").where(registrable_domain(F.col("host")).isin(c.settings.url_shorteners))
    return _hits(own, "url.shortener", F.concat(F.lit("URL shortener hides destination: "), "defanged"), "ord")


def words_found(words: list[str], text: Column) -> Column:
    """Those of `words` that a text contains, in order of letters."""
    return F.array_sort(F.filter(F.array(*[F.lit(w) for w in sorted(set(words))]), lambda w: F.contains(text, w)))


def credential_words(c: Corpus) -> DataFrame:
    own = c.urls.withColumn("found", words_found(c.settings.credential_keywords, url_path_query(F.col("value")))).where(F.size("found") > 0)
    return _hits(own, "url.credential_keywords", F.concat(F.lit("credential-harvest keywords in URL path or query ("), F.array_join("found", ", "), F.lit("): "), F.col("defanged")), "ord")


def wrapped_divergence(c: Corpus) -> DataFrame:
    own = c.urls.where("wrapper is not null and not unresolved and host is not null").where(~is_ip_literal(F.col("host"))).join(c.flat.where("domain is not null").select("msg_id", "domain"), "msg_id")
    own = own.withColumns({"to": registrable_domain(F.col("host")), "by": registrable_domain(F.col("domain"))}).where("to <> by")
    return _hits(own, "url.wrapped_divergence", F.concat("wrapper", F.lit(" link unwraps to "), defang_domain(F.col("to")), F.lit(" (unrelated to sender "), defang_domain(F.col("by")), F.lit(")")), "ord")


def _flagged(rule: str, flag: str, said: str, without: str | None = None) -> Callable[[Corpus], DataFrame]:
    def run(c: Corpus) -> DataFrame:
        test = lambda a: F.array_contains(a["flags"], flag) & (~F.array_contains(a["flags"], without) if without else F.lit(True))
        own = F.transform(F.filter("attachments", test), lambda a: F.concat(F.lit(f"{said}: "), F.coalesce(a["filename"], F.lit("(unnamed)"))))
        return c.messages.select("msg_id", F.lit(rule).alias("rule_id"), own.alias("evidence")).where(F.size("evidence") > 0)

    return run


def urgency(c: Corpus) -> DataFrame:
    shown = F.regexp_replace(H.inspect_html(F.col("body.html_raw"))["text"], r"\s+", " ")
    text = F.lower(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body.text", F.lit("")), shown))
    own = c.messages.select("msg_id", text.alias("text")).select("msg_id", words_found(c.settings.urgency_keywords, F.col("text")).alias("found")).where(F.size("found") > 0)
    return _rows(own, "content.urgency_keywords", F.array(F.concat(F.lit("urgency / financial-pressure phrasing: "), F.array_join("found", ", "))))


#: All rules by id, in their fixed order.
RULES: dict[str, Callable[[Corpus], DataFrame]] = {
    "auth.spf_fail": _auth("spf", "fail"), "auth.spf_softfail": _auth("spf", "softfail"), "auth.dkim_fail": _auth("dkim", "fail"), "auth.dkim_none": dkim_none,
    "auth.dmarc_fail": _auth("dmarc", "fail"), "auth.results_missing": results_missing,
    "identity.display_name_brand_mismatch": brand_mismatch, "identity.return_path_mismatch": _mismatch("return_path", "Return-Path"),
    "identity.reply_to_mismatch": _mismatch("reply_to", "Reply-To"), "identity.sender_mismatch": _mismatch("sender", "Sender"), "identity.freemail_role": freemail_role,
    "identity.multiple_from": multiple_from, "identity.display_name_is_email": name_is_email,
    "url.punycode": punycode, "url.idn_homograph": idn_homograph, "url.lookalike": lookalike, "url.anchor_href_mismatch": anchor_mismatch, "url.raw_ip_host": raw_ip,
    "url.shortener": shortener, "url.credential_keywords": credential_words, "url.wrapped_divergence": wrapped_divergence,
    "attach.macro_capable": _flagged("attach.macro_capable", "macro_capable", "macro-capable office document"),
    "attach.double_extension": _flagged("attach.double_extension", "double_extension", "double extension (e.g. invoice.pdf.exe)"),
    "attach.type_mismatch": _flagged("attach.type_mismatch", "type_mismatch", "declared content-type ≠ detected magic bytes"),
    "attach.executable": _flagged("attach.executable", "executable", "executable / script / LNK / disk-image attachment"),
    "attach.password_protected_archive": _flagged("attach.password_protected_archive", "password_protected", "password-protected archive (evades scanning)"),
    "attach.html": _flagged("attach.html", "html", "HTML/SVG document attachment (opens in a browser)"),
    "attach.archive": _flagged("attach.archive", "archive", "archive attachment (common delivery vector)", without="password_protected"),
    "content.urgency_keywords": urgency,
}


def fired(corpus: Corpus, only: list[str] | None = None) -> DataFrame:
    """msg_id, rule_id, evidence of every rule that fires."""
    out = None
    for name, rule in RULES.items():
        if only is None or name in only:
            own = rule(corpus)
            out = own if out is None else out.unionByName(own)
    return out
