"""From fired rules to a score, a verdict and an exit status. Everything is an aggregation or a join with a small list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import SEVERITIES, Settings

INCOMPLETE = " (incomplete analysis)"


def clamped(total: Column) -> Column:
    """Half up to a whole number, within 0 to 100."""
    return F.least(F.greatest(F.floor(total + F.lit(0.5)), F.lit(0)), F.lit(100)).cast("int")


def magnitude(value: Column) -> Column:
    """Within 0 to 1; what isn't a finite number counts 0."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def weighted(fired: DataFrame, settings: Settings) -> DataFrame:
    """Fired rules with their weight; a rule without one weighs 0 and still counts as fired."""
    return fired.join(F.broadcast(settings.weights_frame(fired.sparkSession)), "rule_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def folded_signals(signals: DataFrame, settings: Settings) -> DataFrame:
    """msg_id, rule_id, weight, evidence, description of enrichment signals: one row a signal id, at its greatest magnitude.

    signals: msg_id, ord, signal_id, description, magnitude, evidence.
    """
    own = signals.groupBy("msg_id", F.col("signal_id").alias("rule_id")).agg(
        F.max(magnitude(F.col("magnitude"))).alias("m"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "evidence"))), lambda x: x["evidence"])).alias("evidence"),
        F.min_by("description", "ord").alias("description"),
    )
    return weighted(own, settings).select("msg_id", "rule_id", (F.col("weight") * F.col("m")).alias("weight"), "evidence", "description")


def verdict(score: Column, settings: Settings) -> Column:
    """The first band whose top reaches the score."""
    out = F.lit(settings.bands[-1][1])
    for top, text in reversed(settings.bands[:-1]):
        out = F.when(score <= top, text).otherwise(out)
    return out


def severity(score: Column) -> Column:
    out = F.lit(SEVERITIES[0][1])
    for floor, slug in SEVERITIES[1:]:
        out = F.when(score >= floor, slug).otherwise(out)
    return out


def scores(messages: DataFrame, fired: DataFrame, anomalies: DataFrame, settings: Settings, signals: DataFrame | None = None) -> DataFrame:
    """msg_id, score, offline_score, verdict, severity, analysis_complete of every message.

    messages: msg_id, anomalies. anomalies: those that extraction added (msg_id, coverage_gap).
    """
    offline = weighted(fired, settings).groupBy("msg_id").agg(F.sum("weight").alias("offline"))
    base = messages.select("msg_id", F.exists("anomalies", lambda a: a["coverage_gap"]).alias("gap"))
    gaps = anomalies.groupBy("msg_id").agg(F.bool_or("coverage_gap").alias("more"))
    out = base.join(offline, "msg_id", "left").join(gaps, "msg_id", "left")
    if signals is not None:
        out = out.join(folded_signals(signals, settings).groupBy("msg_id").agg(F.sum("weight").alias("online")), "msg_id", "left")
    total = F.coalesce("offline", F.lit(0.0)) + (F.coalesce("online", F.lit(0.0)) if signals is not None else F.lit(0.0))
    complete = ~(F.coalesce("gap", F.lit(False)) | F.coalesce("more", F.lit(False)))
    out = out.select("msg_id", clamped(total).alias("score"), clamped(F.coalesce("offline", F.lit(0.0))).alias("offline_score"), complete.alias("analysis_complete"))
    said = F.concat(verdict(F.col("score"), settings), F.when(F.col("analysis_complete"), "").otherwise(INCOMPLETE))
    return out.select("msg_id", "score", "offline_score", said.alias("verdict"), severity(F.col("score")).alias("severity"), "analysis_complete")


def reasons(fired: DataFrame, settings: Settings, most: int | None = None) -> DataFrame:
    """msg_id, reasons: rules by weight, heaviest first, then id; `most` at most."""
    own = weighted(fired, settings).groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "rule_id", "evidence"))).alias("r"))
    number = lambda w: F.when(w == F.floor(w), w.cast("bigint").cast("string")).otherwise(w.cast("string"))
    line = F.transform("r", lambda x: F.concat(x["rule_id"], F.lit(" +"), number(-x["w"]), F.lit(": "), F.array_join(x["evidence"], "; ")))
    return own.select("msg_id", (F.slice(line, 1, most) if most else line).alias("reasons"))


def exit_status(score: Column, complete: Column, threshold: Column, write_failed: Column) -> Column:
    """2 a result could not be written, 1 the score reaches the threshold, 3 the analysis is incomplete, else 0."""
    return F.when(write_failed, 2).when(threshold.isNotNull() & (score >= threshold), 1).when(~complete, 3).otherwise(0)
