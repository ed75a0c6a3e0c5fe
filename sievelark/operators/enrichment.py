"""Recorded reputation answers as signals. Nothing here contacts anything: answers are rows of JSON text.

Vendors' fields are read defensively: what is missing or of another type counts as no data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days under which a registration is young, and how far in the future a date may lie.
YOUNG = 30


def count_at(body: Column, path: str) -> Column:
    """A whole number of 0 or more at a JSON path; booleans, texts and negative numbers are no data."""
    raw = F.get_json_object(body, path)
    return F.when(F.regexp_like(raw, F.lit(r"^\d{1,18}(\.0+)?$")), raw).try_cast("double")


def abuseipdb(body: Column) -> Column:
    """verdict, magnitude (from a confidence of 25 up)."""
    s = count_at(body, "$.data.abuseConfidenceScore")
    verdict = F.when(s.isNull(), "unknown").when(s >= 75, "malicious").when(s >= 25, "suspicious").otherwise("benign")
    return F.struct(verdict.alias("verdict"), F.when(s >= 25, s / 100).alias("magnitude"))


def virustotal(body: Column) -> Column:
    """flagged, judged, ratio of engines; those without an opinion aren't counted."""
    at = lambda k: F.coalesce(count_at(body, f"$.data.attributes.last_analysis_stats.{k}"), F.lit(0.0))
    flagged = at("malicious") + at("suspicious")
    judged = flagged + at("harmless") + at("undetected") * 0
    return F.struct(flagged.alias("flagged"), judged.alias("judged"), F.when(judged > 0, flagged / judged).otherwise(0.0).alias("ratio"))


def rdap(body: Column, now: Column) -> Column:
    """age_days (whole 24-hour periods), young. A date more than a day ahead is no data."""
    events = F.from_json(body, "events array<struct<eventAction:string,eventDate:string>>")["events"]
    when = F.try_element_at(F.transform(F.filter(events, lambda e: F.lower(e["eventAction"]) == "registration"), lambda e: F.try_to_timestamp(e["eventDate"])), F.lit(1))
    seconds = F.unix_micros(now) - F.unix_micros(when)
    days = F.floor(seconds / 86_400_000_000)
    fine = seconds > -86_400_000_000
    return F.struct(F.when(fine, days).alias("age_days"), F.when(fine, seconds / 86_400_000_000 < YOUNG).alias("young"))


def shodan(body: Column, notable: list[int]) -> Column:
    """ports (notable ones, sorted), magnitude (a third each, 1 at most)."""
    ports = F.from_json(body, "ports array<bigint>")["ports"]
    own = F.array_sort(F.array_distinct(F.filter(F.coalesce(ports, F.array().cast("array<bigint>")), lambda p: p.isin(notable))))
    return F.struct(own.alias("ports"), F.least(F.size(own) / F.lit(3.0), F.lit(1.0)).alias("magnitude"))


def worst_scan(scans: Column) -> Column:
    """Of scans (malicious, same_url, score): the greatest in that order."""
    return F.array_max(F.transform(scans, lambda s: F.struct(s["malicious"], s["same_url"], s["score"])))


def fresh(asked: DataFrame, stored: DataFrame, keys: list[str], now: str, at: str, seconds: int) -> DataFrame:
    """Asked rows with stored ones of the same keys that are not older than `seconds` (a negative number: of any age).

    An equi-join with an interval condition; keys that very many rows share are split as any skewed join's.
    """
    age = F.col(now).cast("timestamp").cast("double") - F.col(at).cast("timestamp").cast("double")
    return asked.join(stored, keys).where((age >= 0) & ((age <= seconds) if seconds >= 0 else F.lit(True)))


def targets(addresses: DataFrame, indicators: DataFrame, org_domains: list[str]) -> DataFrame:
    """msg_id, ord, type, value, defanged of what may be looked up: public sending addresses, then indicators, hashes of attachments first, each once."""
    from ..functions.hosts import is_public_ip, public_host, url_host
    from ..functions.suffixes import in_domain

    host = F.when(F.col("type") == "url", url_host(F.col("value"))).when(F.col("type") == "domain", F.col("value"))
    own = indicators.where("type <> 'email'").withColumn("host", host)
    own = own.where(F.col("host").isNull() | (public_host(F.col("host"))["kind"].isNotNull() & ~in_domain(F.col("host"), org_domains)))
    own = own.where(~F.col("type").isin("ipv4", "ipv6") | is_public_ip(F.col("value")))
    own = own.select("msg_id", F.when(F.array_contains("provenance", "attachment:sha256"), 1).otherwise(2).alias("stage"), "ord", "type", "value", "defanged")
    both = addresses.where(is_public_ip(F.col("value"))).select("msg_id", F.lit(0).alias("stage"), "ord", "type", "value", F.col("value").alias("defanged")).unionByName(own)
    return both.groupBy("msg_id", "type", "value").agg(F.min(F.struct("stage", "ord", "defanged")).alias("x")).select("msg_id", F.col("x.stage").alias("stage"), F.col("x.ord").alias("ord"), "type", "value", F.col("x.defanged").alias("defanged"))
