"""Indicators of parsed messages: collected in a fixed order, unwrapped, made inert, each once with its places.

Text scans are expressions (regular expressions of the JVM, linear patterns over the first 262,144 characters). Only HTML inspection, link unwrapping
and IP validation run in Python, in Arrow batches. The order of an indicator is (stage, place in its source): explicit columns, never the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.defang import browser_reading, defang, refang
from ..functions.hosts import is_ip_literal, ipv4_of, url_host
from ..functions.links import unwrap_url

#: Indicators of one message at most; more become an anomaly.
MOST = 1000
TEXT = 262_144

URL = r"(?i)(?<![a-z0-9+.\-])(?:https?|hxxps?|ftps?|fxps?)(?:://|\[:\]//|:\\\\)[^\s<>\"'`\u0000-\u001f]+"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.|\[\.\]|\(\.\))){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
IPV6 = r"(?i)(?<![0-9a-f:.])(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?![0-9a-f:])"
EMAIL = r"(?U)(?<![\w.%+\-])[\w.%+\-]{1,64}@(?:[\w\-]{1,63}\.){1,127}[\w\-]{2,63}(?![\w\-])"
DEFANGED_EMAIL = r"(?iU)(?<![\w.%+\-])[\w.%+\-]{1,64}\s?[\[({]\s?(?:at|@)\s?[\])}]\s?(?:[\w\-]{1,63}\s?(?:[\[({]\s?(?:dot|\.)\s?[\])}]|\.)\s?){1,127}[\w\-]{2,63}(?![\w\-])"
HASHES = [r"(?i)(?<![0-9a-f])[0-9a-f]{%d}(?![0-9a-f])" % n for n in (32, 40, 64, 128)]


def scan_emails(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(EMAIL), 0), F.lower)


def scan_defanged_emails(text: Column) -> Column:
    def plain(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?i)\s?[\[({]\s?(?:at|@)\s?[\])}]\s?", "@")
        return F.lower(F.regexp_replace(F.regexp_replace(x, r"(?i)\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?", "."), " ", ""))

    return F.transform(F.regexp_extract_all(text, F.lit(DEFANGED_EMAIL), 0), plain)


def scan_ipv4(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(IPV4), 0), refang)


def scan_ipv6(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(IPV6), 0), F.lower)


def scan_hashes(text: Column) -> Column:
    return F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(p), 0), F.lower) for p in HASHES]))


def scan_urls(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(URL), 0), lambda x: F.regexp_replace(refang(F.replace(x, F.lit("\\"), F.lit("/"))), r"[.,;:!?)\]}]+$", ""))


def domain_of_email(value: Column) -> Column:
    """After the first @."""
    return F.nullif(F.regexp_replace(F.trim(F.regexp_extract(value, "@(.*)$", 1)), r"\.+$", ""), F.lit(""))


def _entries(stage: Column | int, kind: str, values: Column, provenance: Column | str, navigation: bool = False) -> Column:
    """Values of one source as an array of (stage, place, type, value, provenance, navigation)."""
    stage, provenance = (x if isinstance(x, Column) else F.lit(x) for x in (stage, provenance))
    entry = lambda v, i: F.struct(stage.cast("int").alias("stage"), i.alias("place"), F.lit(kind).alias("type"), v.alias("value"), provenance.alias("provenance"), F.lit(navigation).alias("navigation"))
    return F.transform(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))), entry)


def _scans(source: Column) -> Column:
    """All scans of one text: source is (stage, text, provenance)."""
    text = F.substring(source["text"], 1, TEXT)
    kinds = [("link", scan_urls), ("ipv4", scan_ipv4), ("ipv6?", scan_ipv6), ("email", scan_emails), ("email", scan_defanged_emails), ("hash", scan_hashes)]
    return F.concat(*[_entries(source["stage"] * 10 + k, kind, scan(text), source["provenance"]) for k, (kind, scan) in enumerate(kinds)])


def collected(messages: DataFrame) -> DataFrame:
    """msg_id, stage, place, type, value, provenance, navigation of everything found, before links are read.

    One pass: each message's finds are built as one array and exploded.
    """
    own = messages.withColumn("html", H.inspect_html(F.col("body.html_raw")))
    heads = [("From", "from"), ("Reply-To", "reply_to"), ("Return-Path", "return_path"), ("Sender", "sender")]
    parts = [_entries(k, "email", F.array(F.lower(F.trim(F.col(f"addresses.{key}.addr_spec")))), f"header:{label}") for k, (label, key) in enumerate(heads)]
    parts += [_entries(4 + k, "email", F.transform(f"addresses.{key}", lambda a: F.lower(F.trim(a["addr_spec"]))), f"header:{label}") for k, (label, key) in enumerate((("To", "to"), ("Cc", "cc")))]
    parts.append(_entries(6, "hash", F.transform("attachments", lambda a: a["sha256"]), "attachment:sha256"))
    parts.append(_entries(7, "link", F.col("html.links"), "body:html", True))
    parts.append(_entries(8, "link", F.col("html.resources"), "body:html"))
    source = lambda stage, text, provenance: F.struct(F.lit(stage).alias("stage"), text.alias("text"), provenance.alias("provenance"))
    texts = F.array(
        source(1, F.col("subject"), F.lit("header:Subject")), source(2, F.col("body.text"), F.lit("body:text")), source(3, F.col("html.text"), F.lit("body:html")),
        source(4, F.col("html.hidden_text"), F.lit("body:html-hidden")),
    )
    more = F.transform(F.coalesce("body.other_text", F.array()), lambda p: source(5, p["text"], F.concat(F.lit("body:"), p["content_type"])))
    scanned = F.flatten(F.transform(F.filter(F.concat(texts, more), lambda t: t["text"].isNotNull()), _scans))
    return own.select("msg_id", F.explode(F.concat(*parts, scanned)).alias("x")).select("msg_id", "x.*").where("value is not null and value <> ''")


_PLAIN = "struct<sub:int,type:string,value:string,wrapped:string,wrapper:string,unresolved:boolean>"


def _row(sub: int, kind: Column | str, value: Column, wrapped: Column | None = None, wrapper: Column | None = None, unresolved: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(sub), kind if isinstance(kind, Column) else F.lit(kind), value, none if wrapped is None else wrapped, none if wrapper is None else wrapper, F.lit(False) if unresolved is None else F.coalesce(unresolved, F.lit(False))).cast(_PLAIN)


def with_hosts(found: DataFrame) -> DataFrame:
    """Links unwrapped and classed; hosts of links and domains of addresses added after them. Each find gives its rows as one array."""
    read = F.regexp_replace(F.trim(browser_reading(F.col("value"))), "^[<>\"']+|[<>\"']+$", "")
    rows = found.withColumn("value", F.when(F.col("type") != "link", F.col("value")).when(F.startswith(read, F.lit("//")), F.concat(F.lit("http:"), read)).otherwise(read))
    rows = rows.withColumn("scheme", F.when(F.col("type") == "link", F.lower(F.regexp_extract("value", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))))
    scheme = F.col("scheme")
    web = scheme.isin("http", "https", "ftp") | (F.col("navigation") & scheme.isin("javascript", "data", "vbscript")) | F.startswith("value", F.lit("\\\\"))
    other = (scheme != "") & ~scheme.isin("mailto", "cid", "tel", "sms", "about", "mid", "javascript", "data", "vbscript")
    rows = rows.withColumn("u", unwrap_url(F.when(web | other, F.col("value"))))
    rows = rows.withColumn("host", F.nullif(F.regexp_replace(url_host(F.col("u.value")), r"\.+$", ""), F.lit("")))
    rows = rows.withColumn("ip", is_ip_literal(F.when(F.col("type") == "ipv6?", F.col("value")).otherwise(F.col("host"))))
    kind = F.when(F.col("ip") & F.contains("host", F.lit(":")), "ipv6").when(F.col("ip"), "ipv4").otherwise("domain")
    named = F.when(F.col("ip") & ~F.contains("host", F.lit(":")), F.coalesce(ipv4_of(F.col("host")), "host")).otherwise(F.col("host"))
    is_link = F.col("u.value").isNotNull()
    made = F.array(
        F.when(is_link, _row(0, "url", F.col("u.value"), F.col("u.wrapped"), F.col("u.wrapper"), F.col("u.unresolved"))),
        F.when(is_link & F.col("host").isNotNull(), _row(1, kind, named)),
        F.when(F.col("u.target_domain").isNotNull(), _row(2, "domain", F.col("u.target_domain"))),
        F.when(F.col("type").isin("email", "hash", "ipv4"), _row(0, F.col("type"), F.col("value"))),
        F.when((F.col("type") == "ipv6?") & F.col("ip"), _row(0, "ipv6", F.col("value"))),
        F.when(F.col("type") == "email", _row(1, "domain", F.lower(domain_of_email(F.col("value"))))),
    )
    letters = F.when(scheme == "mailto", scan_emails(F.regexp_replace("value", "%40", "@"))).otherwise(F.array().cast("array<string>"))
    letters = F.flatten(F.transform(letters, lambda a: F.array(_row(0, "email", a), _row(1, "domain", F.lower(domain_of_email(a))))))
    out = rows.select("msg_id", "stage", "place", "provenance", F.explode(F.concat(made, letters)).alias("x")).where("x.value is not null and x.value <> ''")
    return out.select("msg_id", "stage", "place", "x.sub", "x.type", "x.value", "provenance", "x.wrapped", "x.wrapper", "x.unresolved")


def once(found: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(indicators, anomalies): each (type, value) of a message once, places in order, the first wrapper's facts; beyond `most` an anomaly."""
    order = F.struct("stage", "place", "sub")
    own = found.groupBy("msg_id", "type", "value").agg(
        F.min(order).alias("first"),
        F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct(order.alias("o"), F.col("provenance").alias("p")))), lambda x: x["p"])).alias("provenance"),
        F.min_by(F.struct("wrapped", "wrapper", "unresolved"), F.when(F.col("wrapper").isNotNull(), order)).alias("w"),
    )
    placed = own.withColumn("ord", F.row_number().over(Window.partitionBy("msg_id").orderBy("first", "type", "value")) - 1)
    kept = placed.where(F.col("ord") < most).select("msg_id", "ord", "type", "value", defang(F.col("value"), F.col("type")).alias("defanged"), "provenance", "w.wrapped", "w.wrapper", F.coalesce("w.unresolved", F.lit(False)).alias("unresolved"))
    over = placed.where(F.col("ord") == most).select("msg_id", F.lit("ioc_limit").alias("code"), F.lit("more indicators than the limit; the rest are left out").alias("message"), F.lit(True).alias("coverage_gap"))
    return kept, over


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indicators, anomalies) of parsed messages. Anomalies come before scoring, as they make an analysis incomplete."""
    kept, over = once(with_hosts(collected(messages)))
    cut = messages.where((F.length("subject") > TEXT) | (F.length("body.text") > TEXT) | (F.length("body.html_raw") > TEXT)).select("msg_id", F.lit("analysis_truncated").alias("code"), F.lit("text beyond the limit was not analysed").alias("message"), F.lit(True).alias("coverage_gap"))
    return kept, over.unionByName(cut)
