"""Mail files as rows: raw bytes to one parsed message each.

`read` keeps bytes out of every later stage: one mapInArrow pass parses them, and what is not a mail file, or is
over the size limit, never has its content read (both tests are filters on the file listing's columns).
Parsing never fails a task: a fault becomes an anomaly of the row. Times of parsing are not part of rows, so results are the same in every run.
"""

from __future__ import annotations

import email.header
import email.message
import email.parser
import email.policy
import hashlib
import re
from collections.abc import Iterator
from email.utils import getaddresses, parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of one message, headers whose words may be encoded, result words of authentication headers.
LARGEST = 50 * 1024 * 1024
PARTS = 2000
DEPTH = 30
ENCODED = {"subject", "comments", "keywords", "thread-topic"}
RESULTS = {
    "pass": "pass", "fail": "fail", "hardfail": "fail", "softfail": "softfail", "neutral": "neutral", "none": "none", "temperror": "temperror", "error": "temperror",
    "permerror": "permerror", "unknown": "permerror",
}

_ADDRESS = pa.struct([("display_name", pa.string()), ("addr_spec", pa.string()), ("domain", pa.string())])
_RESULT = pa.struct([("result", pa.string()), ("detail", pa.string())])
ARROW = pa.schema([
    ("msg_id", pa.string()), ("filename", pa.string()), ("format", pa.string()),
    ("headers", pa.list_(pa.struct([("pos", pa.int32()), ("name", pa.string()), ("name_cf", pa.string()), ("value", pa.string())]))),
    ("auth", pa.struct([("spf", _RESULT), ("dkim", _RESULT), ("dmarc", _RESULT)])),
    ("routing", pa.list_(pa.struct([("idx", pa.int32()), ("raw", pa.string()), ("from", pa.string()), ("by", pa.string()), ("with", pa.string()), ("ts_iso", pa.string())]))),
    ("addresses", pa.struct([("from", _ADDRESS), ("reply_to", _ADDRESS), ("return_path", _ADDRESS), ("sender", _ADDRESS), ("to", pa.list_(_ADDRESS)), ("cc", pa.list_(_ADDRESS))])),
    ("subject", pa.string()), ("date_iso", pa.string()),
    ("body", pa.struct([("text", pa.string()), ("html_raw", pa.string()), ("has_html", pa.bool_()), ("other_text", pa.list_(pa.struct([("content_type", pa.string()), ("text", pa.string())])))])),
    ("attachments", pa.list_(pa.struct([("filename", pa.string()), ("declared_type", pa.string()), ("content", pa.binary()), ("encrypted", pa.bool_())]))),
    ("anomalies", pa.list_(pa.struct([("code", pa.string()), ("message", pa.string()), ("coverage_gap", pa.bool_())]))),
])


def _text(value) -> str:
    """A header's value: raw eight-bit bytes as UTF-8, lone surrogates as U+FFFD."""
    raw = str(value)
    if any("\ud800" <= c <= "\udfff" for c in raw):
        raw = raw.encode("ascii", "surrogateescape").decode("utf-8", "replace") if all(ord(c) < 128 or "\udc80" <= c <= "\udcff" for c in raw) else raw.encode("utf-8", "replace").decode()
    return raw


def unfold(value: str) -> str:
    return re.sub(r"\r?\n[ \t]+", " ", value)


def words(value: str) -> str:
    """Encoded words decoded; malformed ones as they stand."""
    try:
        return str(email.header.make_header(email.header.decode_header(value)))
    except (ValueError, LookupError, UnicodeError):
        return value


def address(name: str, spec: str) -> dict | None:
    spec = spec.strip()
    if not spec and not name:
        return None
    return {"display_name": name or None, "addr_spec": spec or None, "domain": spec.rpartition("@")[2].strip().casefold().rstrip(".") or None if "@" in spec else None}


def _addresses(values: list[str]) -> list[dict]:
    found = getaddresses(values, strict=True)
    if found in ([], [("", "")]):
        found = getaddresses(values, strict=False)
    return [a for a in (address(words(n), s) for n, s in found) if a]


def _single(values: list[str]) -> dict | None:
    if not values:
        return None
    angle = re.search(r"<([^<>]*)>\s*$", values[0])
    if angle:  # what mail programs show: the address in brackets, whatever stands before
        return address(words(values[0][: angle.start()].strip().strip('"')), angle[1])
    return next(iter(_addresses(values[:1])), None)


#: What a structured header is made of outside comments (quoted strings whole) and inside them (RFC 5322).
_OUTSIDE = re.compile(r'"(?:\\.|[^"\\])*"?|\\.?|[();]|[^"\\();]+', re.DOTALL)
_INSIDE = re.compile(r"\\.?|[()]|[^\\()]+", re.DOTALL)


def _tokens(value: str) -> Iterator[tuple[str, bool]]:
    """The parts of a structured header, and whether each belongs to a comment."""
    at = depth = 0
    while at < len(value):
        part = (_INSIDE if depth else _OUTSIDE).match(value, at)[0]
        at += len(part)
        before, depth = depth, max(0, depth + {"(": 1, ")": -1}.get(part, 0))
        yield part, before > 0 or depth > 0


def clauses(value: str) -> list[str]:
    """A header's clauses: what semicolons outside quotes and comments divide."""
    out = [[]]
    for part, comment in _tokens(value):
        if part == ";" and not comment:
            out.append([])
        else:
            out[-1].append(part)
    return ["".join(x) for x in out]


def without_comments(value: str) -> str:
    return "".join(part for part, comment in _tokens(value) if not comment)


def server_id(value: str) -> str:
    """The server that an Authentication-Results header names; empty where its first word is a result already."""
    first = (without_comments(clauses(value)[0]).split() or [""])[0]
    return "" if "=" in first else first.casefold()


_RESINFO = re.compile(r"\s*([A-Za-z0-9-]+)(?:\s*/\s*\d+)?\s*=\s*([A-Za-z]+)\s*(.*)", re.DOTALL)


def results(value: str) -> list[tuple[str, str, str | None]]:
    """method, state, detail of each clause about SPF, DKIM or DMARC."""
    own = clauses(value)
    out = []
    for clause in own[1:] if server_id(value) else own:
        found = _RESINFO.fullmatch(without_comments(clause))
        state = found and RESULTS.get(found[2].casefold())
        if state and found[1].casefold() in ("spf", "dkim", "dmarc"):
            whole = _RESINFO.fullmatch(clause) or found
            out.append((found[1].casefold(), state, " ".join(whole[3].split()) or None))
    return out


def _speaks_for(detail: str | None, domain: str) -> bool:
    signers = re.findall(r"header\.[di]=(?:[^\s;@]*@)?([^\s;@]+)", detail or "", re.IGNORECASE)
    return any(domain == s or domain.endswith("." + s) for s in (x.casefold().rstrip(".") for x in signers))


def authentication(values: list[str], received_spf: list[str], from_domain: str | None) -> tuple[dict, list[dict]]:
    """Results of the server that the topmost header names, each method from its topmost header; notes about the others."""
    auth = {m: {"result": "none", "detail": None} for m in ("spf", "dkim", "dmarc")}
    taken: dict[str, list] = {}
    notes, others, repeated = [], set(), set()
    trusted = server_id(values[0]) if values else ""
    for k, value in enumerate(values):
        server = server_id(value)
        if server != trusted or (k and not trusted):
            others.add(server or "(none)")
            continue
        own: dict[str, list] = {}
        for method, state, detail in results(value):
            own.setdefault(method, []).append((state, detail))
        repeated |= own.keys() & taken.keys()
        taken = own | taken
    for method, found in taken.items():
        best = next((f for f in found if from_domain and _speaks_for(f[1], from_domain)), found[0]) if method == "dkim" else found[0]
        auth[method] = {"result": best[0], "detail": best[1]}
    if "spf" not in taken and received_spf and received_spf[0].strip():
        own = received_spf[0].strip()
        state = RESULTS.get(re.split(r"[\s(]", own, maxsplit=1)[0].casefold())
        comment = re.search(r"\(([^()]*)\)", own)
        if state:
            auth["spf"] = {"result": state, "detail": comment[1].strip() if comment else None}
    if others:
        notes.append(note("auth_untrusted_results", "results of other servers were not used: " + ", ".join(sorted(others))))
    if repeated:
        notes.append(note("auth_repeated_results", "lower results were not used: " + ", ".join(sorted(repeated))))
    return auth, notes


def note(code: str, message: str, gap: bool = False) -> dict:
    return {"code": code, "message": message, "coverage_gap": gap}


def _date(value: str | None) -> str | None:
    try:
        return parsedate_to_datetime(value).isoformat() if value else None
    except (ValueError, TypeError, OverflowError):
        return None


def hop(k: int, value: str) -> dict:
    plain = without_comments(value)
    take = lambda word: (re.search(rf"(?:^|\s){word}\s+([^\s;]+)", plain) or [None, None])[1]
    return {"idx": k, "raw": value, "from": take("from"), "by": take("by"), "with": take("with"), "ts_iso": _date(plain.rpartition(";")[2].strip()) if ";" in plain else None}


def _leaves(message: email.message.Message, notes: list[dict]) -> Iterator[email.message.Message]:
    """Parts in order; enclosed messages are not entered."""
    stack, seen = [(message, 0)], 0
    while stack:
        part, depth = stack.pop()
        seen += 1
        if seen > PARTS or depth >= DEPTH:
            notes.append(note("mime_budget", "parts beyond the limit were not read", True))
            return
        if part.is_multipart() and part.get_content_maintype() == "multipart":
            stack += [(p, depth + 1) for p in reversed(part.get_payload())]
        else:
            yield part


def _decoded(part: email.message.Message) -> str:
    data = part.get_payload(decode=True)
    if data is None:
        data = str(part.get_payload()).encode("utf-8", "surrogateescape")
    for charset in (part.get_content_charset(), "utf-8"):
        try:
            return data.decode(charset) if charset else data.decode()
        except (LookupError, UnicodeError, ValueError):
            continue
    return data.decode("utf-8", "replace")


def _content(part: email.message.Message) -> bytes:
    if part.get_content_maintype() == "message" and part.is_multipart():
        return part.get_payload(0).as_bytes()
    return part.get_payload(decode=True) or b""


def encrypted_zip(data: bytes) -> bool:
    """Whether an entry of a zip's directory (10,000 read at most) is encrypted."""
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65557))
    if end < 0 or len(data) < end + 22:
        return False
    at = int.from_bytes(data[end + 16 : end + 20], "little")
    for _ in range(min(10_000, int.from_bytes(data[end + 10 : end + 12], "little"))):
        if data[at : at + 4] != b"PK\x01\x02":
            return False
        if data[at + 8] & 1:
            return True
        at += 46 + sum(int.from_bytes(data[at + k : at + k + 2], "little") for k in (28, 30, 32))
    return False


def parse_eml(data: bytes, filename: str) -> dict:
    """One message as a dict of `ARROW`'s fields."""
    notes: list[dict] = []
    row = {"msg_id": hashlib.sha256(data).hexdigest(), "filename": filename, "format": "eml", "anomalies": notes, "headers": [], "routing": [], "attachments": []}
    message = email.parser.BytesParser(policy=email.policy.compat32).parsebytes(data)
    headers = []
    for k, (name, value) in enumerate(message.items()):
        value = unfold(_text(value))
        headers.append({"pos": k, "name": name, "name_cf": name.casefold(), "value": words(value) if name.casefold() in ENCODED else value})
    get = lambda name: [h["value"] for h in headers if h["name_cf"] == name]
    row["headers"] = headers
    single = {key: _single(get(name)) for key, name in (("from", "from"), ("reply_to", "reply-to"), ("return_path", "return-path"), ("sender", "sender"))}
    row["addresses"] = {**single, "to": _addresses(get("to")), "cc": _addresses(get("cc"))}
    if not single["from"]:
        notes.append(note("missing_from", "no From address"))
    row["auth"], more = authentication(get("authentication-results"), get("received-spf"), (single["from"] or {}).get("domain"))
    notes += more
    row["routing"] = [hop(k, v) for k, v in enumerate(get("received"))]
    row["subject"] = next(iter(get("subject")), None)
    row["date_iso"] = _date(next(iter(get("date")), None))
    text, html, other = [], [], []
    for part in _leaves(message, notes):
        kind, name = part.get_content_type(), part.get_filename()
        attached = part.get_content_disposition() == "attachment" or bool(name) or part.get_content_maintype() not in ("text", "multipart")
        if part.get_content_maintype() == "multipart":  # its boundary never came
            notes.append(note("unsplit_multipart", "a multipart body could not be split", True))
            text.append(_decoded(part))
        elif attached or kind not in ("text/plain", "text/html"):
            content = _content(part)
            row["attachments"].append({"filename": words(name) if name else None, "declared_type": kind, "content": content, "encrypted": encrypted_zip(content)})
            if not attached:
                plain = _decoded(part)
                other.append({"content_type": kind, "text": re.sub(r"\r?\n[ \t]", "", plain) if kind == "text/calendar" else plain})
        else:
            (html if kind == "text/html" else text).append(_decoded(part))
        if part.defects:
            notes.append(note("mime_defect", type(part.defects[0]).__name__, True))
    row["body"] = {"text": "\n".join(text) or None, "html_raw": "\n".join(html) or None, "has_html": bool(html), "other_text": other}
    return row


def parse(data: bytes, filename: str) -> dict:
    """As parse_eml, but any fault becomes an anomaly of an otherwise empty row."""
    try:
        return parse_eml(data, filename)
    except Exception as fault:  # noqa: BLE001  a hostile message must not fail its task
        return {"msg_id": hashlib.sha256(data).hexdigest(), "filename": filename, "format": "eml", "anomalies": [note("parse_error", type(fault).__name__, True)]}


def parsed(raw: DataFrame) -> DataFrame:
    """Parsed messages of `raw` (path, content). Attachments come with the facts that expressions make of their bytes, without the bytes."""
    from ..functions import attachments as A
    from ..functions.suffixes import let

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pa.RecordBatch.from_pylist([parse(content.as_py() or b"", (path.as_py() or "").rpartition("/")[2])], schema=ARROW)

    from pyspark.sql.pandas.types import from_arrow_schema

    rows = raw.select("path", "content").mapInArrow(run, from_arrow_schema(ARROW))

    def facts(x):
        return let(A.detected_type(x["content"]), lambda kind: described(x, kind))

    def described(x, kind):
        return F.struct(
            x["filename"].alias("filename"), x["declared_type"].alias("declared_type"), kind.alias("detected_type"), F.octet_length(x["content"]).cast("bigint").alias("size"),
            F.md5(x["content"]).alias("md5"), F.sha1(x["content"]).alias("sha1"), F.sha2(x["content"], 256).alias("sha256"), A.flags(x["filename"], x["declared_type"], kind, x["encrypted"]).alias("flags"),
        )

    return rows.withColumn("attachments", F.transform(F.coalesce("attachments", F.array()), facts)).withColumn("date_ts", F.try_to_timestamp("date_iso"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects) of a folder of mail files. rejects: path, length, reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    mail = F.lower("path").endswith(".eml")
    rejects = files.select("path", "length").where(~mail | (F.col("length") > LARGEST)).select("path", "length", F.when(~mail, "unsupported_format").otherwise("input_too_large").alias("reason"))
    return parsed(files.where(mail & (F.col("length") <= LARGEST))), rejects


def embedded(data: bytes) -> list[dict]:
    """Enclosed messages in order: index, filename, declared_type, data."""
    out = []
    message = email.parser.BytesParser(policy=email.policy.compat32).parsebytes(data)
    for part in _leaves(message, []):
        kind, name = part.get_content_type(), part.get_filename()
        if kind in ("message/rfc822", "message/global", "message/news") or (name or "").casefold().endswith(".eml"):
            out.append({"index": len(out), "filename": name, "declared_type": kind, "data": _content(part)})
    return out


def embedded_rows(raw: DataFrame) -> DataFrame:
    """path, index, filename, declared_type, data of every enclosed message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("index", pa.int32()), ("filename", pa.string()), ("declared_type", pa.string()), ("data", pa.binary())])
        for batch in batches:
            rows = [{"path": p.as_py(), **e} for p, c in zip(batch["path"], batch["content"], strict=True) for e in embedded(c.as_py() or b"")]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return raw.select("path", "content").mapInArrow(run, "path string, index int, filename string, declared_type string, data binary")
