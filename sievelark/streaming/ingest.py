"""Streaming over mail folders and event tables: an extension, built from the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import mail


def messages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Parsed messages of files as they arrive in a folder. Files over the size limit are left to a batch run, which reports them."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.eml").load(path)
    return mail.parsed(files.where(F.col("length") <= mail.LARGEST))


def tumbling(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, key, n, total per window; rows later than `late` behind the newest are dropped, as watermarks do."""
    own = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return own.groupBy(F.window("_ts", width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """start, end, key, n per session: rows of a key with less than `gap` between them."""
    own = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return own.groupBy(F.session_window("_ts", gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
