"""One report row per message, and its renderings: JSON, HTML and the buckets that response tools take.

Everything shown is inert: text is cleaned of control characters and defanged once, in the report row; renderings only escape.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attachments import human_size, is_embedded_mail
from ..functions.defang import clean, defang_domain, defang_email, defang_text
from ..settings import Settings
from . import scoring

#: Characters of a body that a report shows, and lines of a bucket that notes list.
PREVIEW = 4000
LINES = 50
BUCKETS = {"url": "urls", "domain": "domains", "ipv4": "ips", "ipv6": "ips", "email": "emails", "hash": "file_hashes"}
ORDER = ["url", "domain", "email", "ipv4", "ipv6", "hash"]
POLICY = "default-src 'none'; style-src 'unsafe-inline'"


def _shown(text: Column) -> Column:
    return defang_text(clean(text))


def _address(a: Column) -> Column:
    return F.when(a.isNotNull(), F.struct(_shown(a["display_name"]).alias("name"), defang_email(clean(a["addr_spec"])).alias("address"), defang_domain(clean(a["domain"])).alias("domain")))


def bucket(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, own in BUCKETS.items():
        out = F.when(kind == name, own).otherwise(out)
    return out


def buckets(indicators: DataFrame, most: int | None = None) -> DataFrame:
    """msg_id, bucket, n, defanged values in order, each once (`most` of them at most; n counts all)."""
    own = indicators.groupBy("msg_id", bucket(F.col("type")).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("ord", "defanged"))).alias("x"))
    values = F.array_distinct(F.transform("x", lambda e: e["defanged"]))
    return own.select("msg_id", "bucket", F.size(values).alias("n"), (F.slice(values, 1, most) if most else values).alias("shown"))


def build(messages: DataFrame, indicators: DataFrame, fired: DataFrame, scores: DataFrame, settings: Settings) -> DataFrame:
    """msg_id, report: one nested row a message; every join is on msg_id."""
    rules = scoring.weighted(fired, settings).groupBy("msg_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("rule_id").alias("id"), F.transform("evidence", _shown).alias("evidence")))).alias("rules")
    )
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("type"))
    found = indicators.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("k"), "ord", "type", "defanged", "provenance", "wrapper", "unresolved"))).alias("found"))
    base = messages.join(scores, "msg_id").join(rules, "msg_id", "left").join(found, "msg_id", "left")
    body = F.coalesce("body.text", F.lit(""))
    attachments = F.transform("attachments", lambda a: F.struct(_shown(a["filename"]).alias("filename"), a["declared_type"].alias("declared_type"), a["detected_type"].alias("detected_type"), human_size(a["size"]).alias("size"), a["sha256"].alias("sha256"), a["flags"].alias("flags"), is_embedded_mail(a["filename"], a["declared_type"]).alias("embedded_mail")))
    return base.select(
        "msg_id",
        F.struct(
            F.struct("score", "offline_score", "verdict", "severity", "analysis_complete").alias("summary"),
            F.transform(F.coalesce("rules", F.array()), lambda r: F.struct(r["id"].alias("id"), (-r["w"]).alias("weight"), r["evidence"].alias("evidence"))).alias("reasons"),
            F.struct(*[_address(F.col(f"addresses.{k}")).alias(k) for k in ("from", "reply_to", "return_path", "sender")]).alias("identity"),
            F.col("auth").alias("authentication"),
            _shown(F.col("subject")).alias("subject"),
            F.col("date_iso").alias("date"),
            F.transform(F.coalesce("found", F.array()), lambda i: F.struct(i["type"].alias("type"), i["defanged"].alias("value"), i["provenance"].alias("provenance"), i["wrapper"].alias("wrapper"), i["unresolved"].alias("unresolved"))).alias("indicators"),
            F.transform("routing", lambda h: F.struct(h["idx"].alias("index"), _shown(h["from"]).alias("from"), _shown(h["by"]).alias("by"), h["ts_iso"].alias("time"))).alias("routing"),
            F.transform("headers", lambda h: F.struct(h["name"].alias("name"), _shown(h["value"]).alias("value"))).alias("headers"),
            attachments.alias("attachments"),
            F.struct(_shown(F.substring(body, 1, PREVIEW)).alias("preview"), (F.length(body) > PREVIEW).alias("cut"), F.col("body.has_html").alias("has_html")).alias("body"),
            F.transform("anomalies", lambda a: F.struct(a["code"].alias("code"), _shown(a["message"]).alias("message"), a["coverage_gap"].alias("coverage_gap"))).alias("notes"),
        ).alias("report"),
    )


def to_json(reports: DataFrame) -> DataFrame:
    return reports.select("msg_id", F.to_json("report", {"ignoreNullFields": "false"}).alias("json"))


def _table(title: str, rows: list[dict]) -> str:
    if not rows:
        return ""
    cell = lambda v: html.escape(", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v))
    heads = "".join(f"<th>{html.escape(k)}</th>" for k in rows[0])
    return f"<h2>{html.escape(title)}</h2><table><tr>{heads}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"


def page(report: dict) -> str:
    """An HTML page of a report: no script, no link, no remote part; everything escaped."""
    top = report["summary"]
    flat = lambda d: [{"field": k, **(v or {})} for k, v in d.items() if v]
    parts = [
        f"<h1>{html.escape(top['verdict'])}</h1><p>Score {top['score']} of 100</p>", _table("Score", report["reasons"]), _table("Authentication claims", flat(report["authentication"])),
        _table("Identity", flat(report["identity"])), _table("Indicators", report["indicators"]), _table("Routing", report["routing"]), _table("Headers", report["headers"]),
        _table("Attachments", report["attachments"]), f"<h2>Body</h2><pre>{html.escape(report['body']['preview'] or '')}</pre>", _table("Analysis notes", report["notes"]),
    ]
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{POLICY}"><title>Message report</title></head><body>{"".join(parts)}</body></html>'


def to_html(reports: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"msg_id": batch["msg_id"], "html": [page(json.loads(j)) for j in batch["json"]]})

    return to_json(reports).mapInPandas(run, "msg_id string, html string")


def terminal(report: dict, reasons: int = 8, indicators: int = 12) -> str:
    """Plain text of one report: its heaviest reasons and the first indicators of each type."""
    top, lines, seen = report["summary"], [], {}
    lines.append(f"{top['verdict']} ({top['score']}/100)")
    lines += [f"  +{r['weight']:g} {r['id']}: {'; '.join(r['evidence'])}" for r in report["reasons"][:reasons]]
    for i in report["indicators"]:
        seen[i["type"]] = seen.get(i["type"], 0) + 1
        if seen[i["type"]] <= indicators:
            lines.append(f"  {i['type']}: {i['value']}")
    return "\n".join(lines)
