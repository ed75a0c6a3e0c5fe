"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders made inside each `scratch` that is open here.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; only where that is unset (tests on one machine) a new temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sievelark-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder: a lost executor costs a reread, not a recomputation."""
    shared_folder(frame.sparkSession)
    new = frame.checkpoint(eager=True)
    path = new._jdf.queryExecution().logical().rdd().getCheckpointFile()
    return noted(new, path.get()) if path.isDefined() else new


def noted(frame: DataFrame, folder: str) -> DataFrame:
    """`frame`, known to lie in a folder of its own."""
    frame._own_folder = folder
    for own in _scopes.get():
        own.append(folder)
    return frame


def written(frame: DataFrame, kept: bool = False) -> DataFrame:
    """The same rows, from a Parquet table in the shared folder: columnar and compressed, for rows that hold texts. kept: stays after `scratch`."""
    folder = f"{shared_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(folder)
    new = frame.sparkSession.read.schema(frame.schema).parquet(folder)
    return new if kept else noted(new, folder)


def _remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames that `cut` or `written` made. Whatever still reads them must be written already."""
    for frame in frames:
        _remove(frame.sparkSession, [frame._own_folder] if hasattr(frame, "_own_folder") else [])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What `cut` and `written` make inside is deleted at the end: for a step whose result is written outside."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        _remove(spark, own)


def release(spark: SparkSession) -> None:
    """Lets go of finished shuffles: their files stay on the executors' disks until the driver collects the frames that made them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
