"""Queries over the driver's tables: each operator applied to whole tables, with DuckDB SQL of the same rows where SQL can say it.

The tables hold no mail, so message-level queries make their columns from other tables' columns, by the same expressions on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import attachments as A
from ..functions import defang as D
from ..functions import hosts as HO
from ..functions import html as H
from ..functions import links as L
from ..functions import names as N
from ..functions import suffixes as S
from ..operators import enrichment as E
from ..operators import indicators as I
from ..operators import rules as R
from ..operators import scoring as SC
from ..settings import BANDS, CREDENTIAL_WORDS, FREEMAIL, SHORTENERS, URGENCY_WORDS, Settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(words: list[str]) -> str:
    return ", ".join("('" + w.replace("'", "''") + "')" for w in words)


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_DOTS = "replace(replace(replace({}, '[.]', chr(1)), '.', '[.]'), chr(1), '[.]')"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


# --- text ------------------------------------------------------------------


@query(f"SELECT page_id, {_DOTS.format(_HOST)} AS defanged FROM pages")
def def_02_defang_domain(spark, d):
    return _t(spark, d, "pages").select("page_id", D.defang_domain(HO.url_host(F.col("url"))).alias("defanged"))


@query(f"SELECT page_id, {_DOTS.format("regexp_replace(url, '^(?i:http)(s?)://', 'hxxp\\1://')")} AS defanged FROM pages")
def def_01_defang_url(spark, d):
    return _t(spark, d, "pages").select("page_id", D.defang_url(F.col("url")).alias("defanged"))


@query("SELECT page_id, url AS restored, true AS same FROM pages")
def def_07_refang_url(spark, d):
    back = D.refang(D.defang_url(F.col("url")))
    return _t(spark, d, "pages").select("page_id", back.alias("restored"), (back == F.col("url")).alias("same"))


@query("SELECT event_id, replace(concat('u', user_id, '@m', event_id % 7, '.example'), '@', '[at]') AS x FROM (SELECT * FROM events)".replace("AS x", "AS raw").replace("SELECT event_id, replace(concat('u', user_id, '@m', event_id % 7, '.example'), '@', '[at]') AS raw", "SELECT event_id, replace(replace(concat('u', user_id, '@m', event_id % 7, '.example'), '@', '[at]'), '.', '[.]') AS defanged"))
def def_04_defang_email(spark, d):
    spec = F.concat(F.lit("u"), "user_id", F.lit("@m"), F.col("event_id") % 7, F.lit(".example"))
    return _t(spark, d, "events").select("event_id", D.defang_email(spec).alias("defanged"))


_IP = "concat_ws('.', 198, 51, event_id % 200, user_id % 250)"


@query(f"SELECT event_id, replace({_IP}, '.', '[.]') AS v4, replace(concat('2001:db8::', event_id % 9999), ':', '[:]') AS v6 FROM events")
def def_03_defang_ip(spark, d):
    v4 = F.concat_ws(".", F.lit("198"), F.lit("51"), (F.col("event_id") % 200).cast("string"), (F.col("user_id") % 250).cast("string"))
    return _t(spark, d, "events").select("event_id", D.defang_ipv4(v4).alias("v4"), D.defang_ipv6(F.concat(F.lit("2001:db8::"), F.col("event_id") % 9999)).alias("v6"))


@query()
def def_06_defang_text(spark, d):
    text = D.defang_text(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.md5(text).alias("defanged_md5"), (D.defang_text(text) == text).alias("idempotent"))


@query("SELECT doc_id, length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g')) AS n FROM documents")
def def_08_clean(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.length(D.clean(F.col("text"))).cast("bigint").alias("n"))


# --- indicators ------------------------------------------------------------

_EMAIL_SQL = r"[A-Za-z0-9_.%+-]+@(?:[A-Za-z0-9_-]+\.)+[A-Za-z0-9_-]{2,}"


@query()
def ext_09_email_scan(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(I.scan_emails(F.col("text"))).alias("email"))


@query(r"SELECT DISTINCT doc_id, regexp_extract(tok, '(?:^|[^\d.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))$', 1) AS ip FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.?$|\.?[^\d.]|\.\.)')) AS t FROM documents) x, LATERAL (SELECT regexp_replace(t, '(?:\.?[^\d.]|\.+)$', '') AS tok) WHERE regexp_extract(tok, '((?:\d+\.){3}\d+)$', 1) <> ''")
def ext_07_ipv4_scan(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(I.scan_ipv4(F.col("text"))).alias("ip")).distinct()


@query("SELECT doc_id, md5(text) AS hash FROM documents UNION ALL SELECT doc_id, sha256(text) FROM documents")
def ext_11_hash_scan(spark, d):
    text = F.concat(F.lit("see "), F.upper(F.md5("text")), F.lit(" and "), F.sha2("text", 256), F.lit("."))
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.explode(I.scan_hashes(text)).alias("hash"))


@query()
def ext_06_url_scan(spark, d):
    text = F.concat(F.lit("Look at "), "url", F.lit(", or "), D.defang_url(F.col("url")), F.lit("."))
    return _t(spark, d, "pages").select("page_id", F.explode(F.array_distinct(I.scan_urls(text))).alias("url"))


@query("SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, " + _HOST + " AS host FROM pages")
def dom_09_url_host(spark, d):
    return _t(spark, d, "pages").select("page_id", HO.url_scheme(F.col("url")).alias("scheme"), HO.url_host(F.col("url")).alias("host"))


@query(f"WITH h AS (SELECT page_id, string_split({_HOST}, '.') AS p FROM pages) SELECT page_id, unnest(list_transform(range(1, len(p) + 1), lambda k: array_to_string(p[k:], '.'))) AS suffix FROM h")
def dom_05_host_suffixes(spark, d):
    return _t(spark, d, "pages").select("page_id", F.explode(S.host_suffixes(HO.url_host(F.col("url")))).alias("suffix"))


@query(f"WITH h AS (SELECT page_id, string_split({_HOST}, '.') AS p FROM pages) SELECT page_id, array_to_string(p[-2:], '.') AS registrable, p[-2] AS label FROM h")
def dom_01_registrable_domain(spark, d):
    host = HO.url_host(F.col("url"))
    return _t(spark, d, "pages").select("page_id", S.registrable_domain(host).alias("registrable"), S.registrable_label(host).alias("label"))


@query("SELECT event_id, concat_ws('.', (n >> 24) & 255, (n >> 16) & 255, (n >> 8) & 255, n & 255) AS ip FROM (SELECT event_id, (event_id * 2654435761) % 4294967296 AS n FROM events)")
def dom_06_legacy_ipv4(spark, d):
    n = (F.col("event_id") * 2654435761) % 4294967296
    part = lambda k: F.shiftright(n, k).bitwiseAND(F.lit(255))
    forms = F.when(F.col("event_id") % 3 == 0, n.cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("0x"), F.lower(F.hex(n)))).otherwise(F.concat_ws(".", part(24).cast("string"), F.concat(F.lit("0x"), F.lower(F.hex(part(16)))), (n % 65536).cast("string")))
    return _t(spark, d, "events").select("event_id", HO.ipv4_of(forms).alias("ip"))


@query()
def dom_07_public_ip(spark, d):
    ip = F.concat_ws(".", (F.col("event_id") % 256).cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("1"), F.lit("7"))
    return _t(spark, d, "events").select("event_id", ip.alias("ip")).withColumn("public", HO.is_public_ip(F.col("ip")))


@query("SELECT c_custkey, replace(replace(replace(translate(x, '', ''), 'rn', 'm'), 'vv', 'w'), 'cl', 'd') AS y FROM (SELECT c_custkey, lower(c_name) AS x FROM customer)".replace("SELECT c_custkey, replace(replace(replace(translate(x, '', ''), 'rn', 'm'), 'vv', 'w'), 'cl', 'd') AS y", "SELECT c_custkey, translate(replace(replace(replace(x, 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), '01i|5$', 'olllss') AS skeleton"))
def dom_11_skeleton(spark, d):
    return _t(spark, d, "customer").select("c_custkey", N.skeleton(F.lower("c_name")).alias("skeleton"))


@query("SELECT a.n_name AS one, b.n_name AS two, damerau_levenshtein(a.n_name, b.n_name)::INTEGER AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def dom_10_edit_distance(spark, d):
    a = _t(spark, d, "nation")
    b = a.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("two"), F.col("n_regionkey").alias("r2"))
    return a.join(b, (F.col("n_regionkey") == F.col("r2")) & (F.col("n_nationkey") < F.col("k2"))).select(F.col("n_name").alias("one"), "two", N.edit_distance(F.col("n_name"), F.col("two")).alias("distance"))


@query()
def dom_12_15_unicode_names(spark, d):
    labels = spark.createDataFrame([("аррӏе",), ("xn--80ak6aa92e",), ("pаypal",), ("pàypal",), ("việtnam",), ("abcショップ",)], "label string")
    return labels.withColumn("decoded", N.decode_label(F.col("label"))).select("label", "decoded", N.latin_skeleton(F.col("decoded")).alias("skeleton"), N.is_suspicious_mix(F.col("decoded")).alias("mixed"))


# --- HTML ------------------------------------------------------------------


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def htm_02_links(spark, d):
    return _t(spark, d, "pages").select("page_id", F.explode(H.inspect_html(F.col("html"))["anchors"]).alias("a")).select("page_id", F.col("a.href").alias("href"))


@query()
def htm_05_visible_text(spark, d):
    own = H.inspect_html(F.col("html"))
    return _t(spark, d, "pages").select("page_id", own.alias("h")).select("page_id", F.md5("h.text").alias("text_md5"), F.length("h.hidden_text").alias("n_hidden"), F.size("h.resources").alias("n_resources"), "h.complete")


@query(f"SELECT {_HOST} AS host, {_DOTS.format(_HOST)} AS shown, count(*) AS n_pages, sum(len(regexp_extract_all(html, '<a href=')))::BIGINT AS n_links FROM pages GROUP BY 1, 2")
def agg_07_links_by_host(spark, d):
    own = _t(spark, d, "pages").select(HO.url_host(F.col("url")).alias("host"), F.regexp_count("html", F.lit("<a href=")).alias("n"))
    return own.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("n").cast("bigint").alias("n_links")).withColumn("shown", D.defang_domain(F.col("host")))


# --- attachments -----------------------------------------------------------

_NAMES = ["report.pdf", "invoice.pdf.exe", "notes.txt", "book.docm", "page.html", "pack.zip", "old.doc", "a.tar.gz", "x.jpg", "run.js"]
_HEADS = ["255044462D312E34", "4D5A9000", "504B0304", "D0CF11E0A1B11AE1", "89504E470D0A1A0A", "FFD8FFE0", "3C68746D6C3E", "1F8B08", "7B5C72746631", "00112233"]


def _files(spark, d):
    own = _t(spark, d, "part").select("p_partkey")
    pick = lambda xs, step: F.element_at(F.array(*[F.lit(x) for x in xs]), ((F.col("p_partkey") * step) % len(xs) + 1).cast("int"))
    return own.withColumns({"name": pick(_NAMES, 1), "content": F.unhex(pick(_HEADS, 3))})


_FILES = f"SELECT p_partkey, {_list(_NAMES)}[(p_partkey % 10 + 1)::INT] AS name, {_list(_HEADS)}[(p_partkey * 3 % 10 + 1)::INT] AS head FROM part"


@query(f"SELECT p_partkey, md5(unhex(head)) AS md5, sha1(unhex(head)) AS sha1, sha256(unhex(head)) AS sha256, octet_length(unhex(head))::BIGINT AS size FROM ({_FILES})")
def att_01_hashes(spark, d):
    return _files(spark, d).select("p_partkey", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("size"))


_DETECT = "CASE " + " ".join(f"WHEN starts_with(head, '{p}') THEN '{k}'" for p, k in A.MAGIC) + " WHEN starts_with(head, '3C68746D6C') THEN 'text/html' END"


@query(f"SELECT p_partkey, {_DETECT} AS detected FROM ({_FILES})")
def att_02_detect_type(spark, d):
    return _files(spark, d).select("p_partkey", A.detected_type(F.col("content")).alias("detected"))


@query(f"SELECT p_partkey, string_split(name, '.')[2:] AS extensions, string_split(name, '.')[-1] AS last FROM ({_FILES})")
def att_04_extensions(spark, d):
    return _files(spark, d).select("p_partkey", A.extensions(F.col("name")).alias("extensions"), A.last_extension(F.col("name")).alias("last"))


def _in(value: str, words: list[str]) -> str:
    return f"{value} IN ({', '.join(repr(w) for w in words)})"


def _fam(value: str, families: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {_in(value, m)} THEN '{f}'" for f, m in families.items()) + " END"


_FLAG_TESTS = [
    ("archive", f"({_in('k', A.ARCHIVE_TYPES)} AND NOT {_in('e', A.OOXML_EXTENSIONS)}) OR {_in('e', A.ARCHIVE_EXTENSIONS)}"),
    ("macro_capable", _in("e", A.OOXML_MACRO_EXTENSIONS + A.LEGACY_MACRO_EXTENSIONS)),
    ("executable", f"{_in('k', A.EXECUTABLE_TYPES)} OR {_in('e', A.DANGEROUS_EXTENSIONS)}"),
    ("html", f"{_in('e', A.HTML_EXTENSIONS)} OR {_in('k', ['text/html', 'image/svg+xml'])}"),
    ("double_extension", f"len(string_split(name, '.')) > 2 AND {_in('e', A.DANGEROUS_EXTENSIONS + A.HTML_EXTENSIONS)}"),
    ("type_mismatch", f"({_fam('e', A.EXTENSION_FAMILIES)}) <> ({_fam('k', A.DETECTED_FAMILIES)})"),
]


@query(f"SELECT p_partkey, list_filter([{', '.join(f"CASE WHEN {t} THEN '{n}' END" for n, t in _FLAG_TESTS)}], lambda x: x IS NOT NULL) AS flags FROM (SELECT *, {_DETECT} AS k, string_split(name, '.')[-1] AS e FROM ({_FILES}))")
def att_05_11_flags(spark, d):
    return _files(spark, d).select("p_partkey", A.flags(F.col("name"), F.lit(None).cast("string"), A.detected_type(F.col("content")), F.lit(False)).alias("flags"))


@query("SELECT o_orderkey, CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN concat(printf('%.1f', n / 1024.0), ' KB') ELSE concat(printf('%.1f', n / 1048576.0), ' MB') END AS shown FROM (SELECT o_orderkey, (o_orderkey * 37)::BIGINT AS n FROM orders)")
def att_13_human_size(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", A.human_size((F.col("o_orderkey") * 37).cast("bigint")).alias("shown"))


# --- links -----------------------------------------------------------------


@query("SELECT page_id, url AS value, 'safelinks' AS wrapper, false AS unresolved FROM pages")
def unw_02_09_safelinks(spark, d):
    wrapped = F.concat(F.lit("https://nam02.safelinks.protection.outlook.com/?url="), F.url_encode("url"), F.lit("&data=05"))
    return _t(spark, d, "pages").select("page_id", L.unwrap_url(wrapped).alias("u")).select("page_id", "u.value", "u.wrapper", "u.unresolved")


@query("SELECT page_id, concat('https://url.us.m.mimecast.com/s/abc?domain=', " + _HOST + ") AS value, 'mimecast' AS wrapper, true AS unresolved, " + _HOST + " AS target_domain FROM pages")
def unw_08_mimecast(spark, d):
    wrapped = F.concat(F.lit("https://url.us.m.mimecast.com/s/abc?domain="), HO.url_host(F.col("url")))
    return _t(spark, d, "pages").select("page_id", L.unwrap_url(wrapped).alias("u")).select("page_id", "u.value", "u.wrapper", "u.unresolved", "u.target_domain")


@query("SELECT page_id, url AS value, 'barracuda' AS wrapper, false AS unresolved FROM pages WHERE starts_with(url, 'http')")
def unw_06_barracuda(spark, d):
    wrapped = F.concat(F.lit("https://linkprotect.cudasvc.com/url?a="), F.replace(F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("&"), F.lit("%26")), F.lit("#"), F.lit("%23")), F.lit("+"), F.lit("%2B")))
    return _t(spark, d, "pages").where("startswith(url, 'http')").select("page_id", L.unwrap_url(wrapped).alias("u")).select("page_id", "u.value", "u.wrapper", "u.unresolved")


# --- joins and sets ---------------------------------------------------------

def _mailbox():
    return F.element_at(F.array(*[F.lit(x) for x in ["gmail.com", "corp.example", "bit.ly", "yahoo.com", "x.org"]]), (F.col("user_id") % 5 + 1).cast("int"))


_MAILBOX_SQL = "['gmail.com', 'corp.example', 'bit.ly', 'yahoo.com', 'x.org'][(user_id % 5 + 1)::INT]"


@query(f"SELECT event_id, {_MAILBOX_SQL} AS domain FROM events WHERE {_MAILBOX_SQL} IN (SELECT * FROM (VALUES {_values(FREEMAIL)}))")
def joi_06_freemail_semi(spark, d):
    words = F.broadcast(Settings().words_frame(spark).where("kind = 'freemail'").select(F.col("value").alias("domain")))
    return _t(spark, d, "events").select("event_id", _mailbox().alias("domain")).join(words, "domain", "left_semi").select("event_id", "domain")


@query(f"SELECT event_id, {_MAILBOX_SQL} AS domain FROM events WHERE {_MAILBOX_SQL} IN (SELECT * FROM (VALUES {_values(SHORTENERS)}))")
def joi_07_shortener_semi(spark, d):
    words = F.broadcast(Settings().words_frame(spark).where("kind = 'shortener'").select(F.col("value").alias("domain")))
    return _t(spark, d, "events").select("event_id", _mailbox().alias("domain")).join(words, "domain", "left_semi").select("event_id", "domain")


@query(f"SELECT event_id, {_MAILBOX_SQL} AS domain FROM events WHERE {_MAILBOX_SQL} NOT IN (SELECT * FROM (VALUES {_values(FREEMAIL + SHORTENERS)}))")
def joi_08_known_anti(spark, d):
    words = F.broadcast(Settings().words_frame(spark).where("kind in ('freemail', 'shortener')").select(F.col("value").alias("domain")))
    return _t(spark, d, "events").select("event_id", _mailbox().alias("domain")).join(words, "domain", "left_anti").select("event_id", "domain")


@query("SELECT c_custkey, b.brand FROM (SELECT c_custkey, ['PayPal Service', 'Apple', 'Pineapple Ltd', 'The Chase Team', 'nobody'][(c_custkey % 5 + 1)::INT] AS name FROM customer) JOIN (VALUES " + ", ".join(f"('{b}')" for b in Settings().brands) + ") b(brand) ON regexp_matches(lower(name), '\\b' || b.brand || '\\b')")
def joi_04_brand_theta(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ["PayPal Service", "Apple", "Pineapple Ltd", "The Chase Team", "nobody"]]), (F.col("c_custkey") % 5 + 1).cast("int"))
    brands = Settings().brands_frame(spark).select("brand").distinct()
    return _t(spark, d, "customer").select("c_custkey", name.alias("name")).join(F.broadcast(brands), R.word_in(F.col("brand"), F.col("name"))).select("c_custkey", "brand")


@query("SELECT a.event_id, max(b.event_id) AS hit FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 1 HOUR AND a.event_id <> b.event_id GROUP BY 1")
def joi_14_cache_interval(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "ts")
    hits = E.fresh(e.select("event_id", "user_id", "ts"), e.select(F.col("event_id").alias("hit"), "user_id", F.col("ts").alias("stored")), ["user_id"], "ts", "stored", 3600)
    return hits.where("event_id <> hit").groupBy("event_id").agg(F.max("hit").alias("hit"))


@query("SELECT DISTINCT 'event' AS kind, user_id AS k FROM events UNION SELECT 'order', o_custkey FROM orders")
def set_01_target_union(spark, d):
    a = _t(spark, d, "events").select(F.lit("event").alias("kind"), F.col("user_id").alias("k"))
    return a.unionByName(_t(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_custkey").alias("k"))).distinct()


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def set_02_recipient_only(spark, d):
    places = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("header:To"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("header:To"), F.lit("body:text"))).otherwise(F.array(F.lit("header:From")))
    return _t(spark, d, "events").where(F.size(F.array_except(places, F.array(F.lit("header:To"), F.lit("header:Cc")))) > 0).select("event_id")


# --- rules, scores ----------------------------------------------------------

_WORD_SQL = "list_sort(list_filter({}, lambda w: contains(lower({}), w)))"


@query(f"SELECT doc_id, {_WORD_SQL.format(_list(sorted(URGENCY_WORDS)), 'text')} AS found FROM documents WHERE text IS NOT NULL")
def rul_29_urgency_words(spark, d):
    return _t(spark, d, "documents").where("text is not null").select("doc_id", R.words_found(URGENCY_WORDS, F.lower("text")).alias("found"))


@query(f"SELECT page_id, {_WORD_SQL.format(_list(sorted(CREDENTIAL_WORDS)), 'p')} AS found FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '#.*$', '') AS p FROM pages)")
def rul_20_credential_words(spark, d):
    return _t(spark, d, "pages").select("page_id", R.words_found(CREDENTIAL_WORDS, HO.url_path_query(F.col("url"))).alias("found"))


_STATES = ["pass", "fail", "softfail", "neutral", "none", "temperror", "permerror"]


@query(f"SELECT doc_id, 'auth.spf_fail' AS rule_id FROM documents WHERE {_list(_STATES)}[(doc_id % 7 + 1)::INT] = 'fail' UNION ALL SELECT doc_id, 'auth.spf_softfail' FROM documents WHERE {_list(_STATES)}[(doc_id % 7 + 1)::INT] = 'softfail'")
def rul_01_02_auth_filters(spark, d):
    state = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (F.col("doc_id") % 7 + 1).cast("int"))
    own = _t(spark, d, "documents").select("doc_id", state.alias("s"))
    return own.where("s in ('fail', 'softfail')").select("doc_id", F.concat(F.lit("auth.spf_"), "s").alias("rule_id"))


_RULE_IDS = sorted(Settings().weights)[:20]


def _fired(spark, d):
    ids = F.array(*[F.lit(r) for r in _RULE_IDS])
    own = _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("msg_id"), F.element_at(ids, (F.col("l_partkey") % 20 + 1).cast("int")).alias("rule_id")).distinct()
    return own.withColumn("evidence", F.array(F.col("rule_id")))


_FIRED = f"SELECT DISTINCT l_orderkey::VARCHAR AS msg_id, {_list(_RULE_IDS)}[(l_partkey % 20 + 1)::INT] AS rule_id FROM lineitem"
_WEIGHTS = "(VALUES " + ", ".join(f"('{k}', {float(v)}::DOUBLE)" for k, v in Settings().weights.items()) + ") w(rule_id, weight)"
_SCORE = f"SELECT msg_id, least(greatest(floor(sum(coalesce(weight, 0)) + 0.5), 0), 100)::INT AS score FROM ({_FIRED}) LEFT JOIN {_WEIGHTS} USING (rule_id) GROUP BY 1"


@query(_SCORE)
def agg_01_02_score(spark, d):
    own = SC.weighted(_fired(spark, d), Settings())
    return own.groupBy("msg_id").agg(SC.clamped(F.sum("weight")).alias("score"))


_BAND_SQL = "CASE " + " ".join(f"WHEN score <= {t} THEN '{v}'" for t, v in BANDS) + " END"
_SEVERITY_SQL = "CASE WHEN score >= 85 THEN 'critical' WHEN score >= 65 THEN 'high' WHEN score >= 40 THEN 'elevated' WHEN score >= 20 THEN 'low' ELSE 'minimal' END"


@query(f"SELECT msg_id, score, {_BAND_SQL} AS verdict, {_SEVERITY_SQL} AS severity FROM ({_SCORE})")
def joi_12_13_verdict_bands(spark, d):
    own = agg_01_02_score(spark, d)
    bands = F.broadcast(Settings().bands_frame(spark))
    return own.join(bands, F.col("score").between(F.col("lo"), F.col("hi"))).select("msg_id", "score", "verdict", SC.severity(F.col("score")).alias("severity"))


@query(f"SELECT msg_id, list(rule_id ORDER BY coalesce(weight, 0) DESC, rule_id)[:8] AS top FROM ({_FIRED}) LEFT JOIN {_WEIGHTS} USING (rule_id) GROUP BY 1")
def srt_01_lim_03_top_reasons(spark, d):
    own = SC.weighted(_fired(spark, d), Settings()).groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "rule_id"))).alias("r"))
    return own.select("msg_id", F.slice(F.transform("r", lambda x: x["rule_id"]), 1, 8).alias("top"))


@query("SELECT l_orderkey, NOT bool_or(l_quantity > 49) AS complete, CASE WHEN bool_or(l_quantity > 49) THEN 'Low suspicion (incomplete analysis)' ELSE 'Low suspicion' END AS verdict FROM lineitem GROUP BY 1")
def agg_13_completeness(spark, d):
    own = _t(spark, d, "lineitem").groupBy("l_orderkey").agg((~F.bool_or(F.col("l_quantity") > 49)).alias("complete"))
    return own.withColumn("verdict", F.concat(F.lit("Low suspicion"), F.when(F.col("complete"), "").otherwise(SC.INCOMPLETE)))


def _signals(spark, d):
    ids = F.array(*[F.lit(s) for s in ["enrichment.virustotal.detections", "enrichment.rdap.young_domain", "enrichment.unknown"]])
    return _t(spark, d, "events").select(
        F.col("user_id").cast("string").alias("msg_id"), F.col("event_id").alias("ord"), F.element_at(ids, (F.col("event_id") % 3 + 1).cast("int")).alias("signal_id"),
        F.lit("said").alias("description"), (F.col("value") / 50 - 0.2).alias("magnitude"), F.col("event_type").alias("evidence"),
    )


@query(f"SELECT msg_id, rule_id, coalesce(weight, 0) * m AS weight FROM (SELECT user_id::VARCHAR AS msg_id, ['enrichment.virustotal.detections', 'enrichment.rdap.young_domain', 'enrichment.unknown'][(event_id % 3 + 1)::INT] AS rule_id, max(least(greatest(value / 50 - 0.2, 0), 1)) AS m FROM events GROUP BY 1, 2) LEFT JOIN {_WEIGHTS} USING (rule_id)")
def agg_03_04_fold_signals(spark, d):
    return SC.folded_signals(_signals(spark, d), Settings()).select("msg_id", "rule_id", "weight")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 2 WHEN s >= 60 THEN 1 WHEN o_orderkey % 5 = 0 THEN 3 ELSE 0 END AS exit_status FROM (SELECT o_orderkey, (o_orderkey % 101)::INT AS s FROM orders)")
def fil_12_exit_status(spark, d):
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select("o_orderkey", SC.exit_status((k % 101).cast("int"), k % 5 != 0, F.lit(60), k % 11 == 0).alias("exit_status"))


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def win_01_topmost(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return _t(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_type", "value")


@query("SELECT user_id, arg_min(event_id, struct_pack(a := CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, b := event_id)) AS event_id FROM events GROUP BY 1")
def par_20_aligned_choice(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct((F.col("event_type") != "purchase").cast("int"), "event_id")).alias("event_id"))


@query("SELECT l_orderkey, count(*) AS n_all, least(count(*), 3) AS n_kept FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY 1")
def ext_02_dedupe_cap(spark, d):
    found = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("msg_id"), F.lit(0).alias("stage"), F.col("l_linenumber").cast("int").alias("place"), F.lit(0).alias("sub"), F.lit("domain").alias("type"), F.col("l_suppkey").cast("string").alias("value"),
        F.lit("body:text").alias("provenance"), F.lit(None).cast("string").alias("wrapped"), F.lit(None).cast("string").alias("wrapper"), F.lit(False).alias("unresolved"),
    )
    kept = I.once(found, 3)[0].groupBy("msg_id").agg(F.count("*").alias("n_kept"))
    every = found.select("msg_id", "value").distinct().groupBy("msg_id").agg(F.count("*").alias("n_all"))
    return kept.join(every, "msg_id").select(F.col("msg_id").alias("l_orderkey"), "n_all", "n_kept")


@query("SELECT CASE event_type WHEN 'click' THEN 'urls' WHEN 'view' THEN 'domains' ELSE 'ips' END AS bucket, user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1, 2")
def agg_11_buckets(spark, d):
    bucket = F.when(F.col("event_type") == "click", "urls").when(F.col("event_type") == "view", "domains").otherwise("ips")
    return _t(spark, d, "events").groupBy(bucket.alias("bucket"), "user_id").agg(F.size(F.collect_set("event_type")).cast("bigint").alias("n"))


# --- enrichment -------------------------------------------------------------


@query("SELECT event_id, CASE WHEN s >= 75 THEN 'malicious' WHEN s >= 25 THEN 'suspicious' ELSE 'benign' END AS verdict, CASE WHEN s >= 25 THEN s / 100.0 END AS magnitude FROM (SELECT event_id, (event_id % 101)::DOUBLE AS s FROM events)")
def enr_09_abuseipdb(spark, d):
    body = F.concat(F.lit('{"data":{"abuseConfidenceScore":'), (F.col("event_id") % 101).cast("string"), F.lit(',"totalReports":3,"countryCode":"NL","isWhitelisted":false}}'))
    return _t(spark, d, "events").select("event_id", E.abuseipdb(body).alias("x")).select("event_id", "x.verdict", "x.magnitude")


@query("SELECT event_id, CASE WHEN n > 0 THEN n / 60.0 ELSE 0 END AS ratio FROM (SELECT event_id, (event_id % 30)::DOUBLE AS n FROM events)")
def enr_13_virustotal(spark, d):
    n = F.col("event_id") % 30
    body = F.concat(F.lit('{"data":{"attributes":{"last_analysis_stats":{"malicious":'), n.cast("string"), F.lit(',"suspicious":0,"harmless":'), (60 - n).cast("string"), F.lit(',"undetected":5}}}}'))
    return _t(spark, d, "events").select("event_id", E.virustotal(body)["ratio"].alias("ratio"))


@query("SELECT event_id, floor((epoch(TIMESTAMP '2024-02-15') - epoch(ts)) / 86400)::BIGINT AS age_days, (epoch(TIMESTAMP '2024-02-15') - epoch(ts)) / 86400 < 30 AS young FROM events")
def enr_10_domain_age(spark, d):
    body = F.concat(F.lit('{"events":[{"eventAction":"registration","eventDate":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"}]}'))
    return _t(spark, d, "events").select("event_id", E.rdap(body, F.lit("2024-02-15 00:00:00").cast("timestamp")).alias("x")).select("event_id", "x.age_days", "x.young")


@query("SELECT event_id, list_sort(list_distinct(list_filter([event_id % 30, 22, 3389], lambda p: p IN (21, 22, 23, 445, 3389, 5900)))) AS ports FROM events")
def enr_11_shodan(spark, d):
    body = F.concat(F.lit('{"ports":['), (F.col("event_id") % 30).cast("string"), F.lit(",22,3389]}"))
    return _t(spark, d, "events").select("event_id", E.shodan(body, [21, 22, 23, 445, 3389, 5900])["ports"].alias("ports"))


# --- extensions: corpus-level views -----------------------------------------


@query("SELECT source, lang, count(*) AS n, count(DISTINCT md5(text)) AS n_texts FROM documents GROUP BY 1, 2")
def x_campaigns_by_source(spark, d):
    return _t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.countDistinct(F.md5("text")).alias("n_texts"))


@query("SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def x_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(w).cast("timestamp").cast("double")
    own = _t(spark, d, "events").withColumn("new", F.when(gap <= 1800, 0).otherwise(1))
    return own.withColumn("s", F.sum("new").over(w)).groupBy("user_id", "s").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("s")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def x_tumbling_windows(spark, d):
    return _t(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
