"""Every registered query of the library proper against its SQL in DuckDB, and the streams."""

import math
import os

import duckdb
import pytest

from sievelark.plans import queries as P
from sievelark.streaming import ingest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(P.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    frame = P.QUERIES[name](spark, DATA)
    result = duck.execute(P.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted((repr(tuple(plain(row[names.index(c)]) for c in sorted(names))) for row in result.fetchall()))
    got = sorted(repr(tuple(plain(row[c]) for c in sorted(names))) for row in frame.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(P.QUERIES) - set(P.ORACLES)))
def test_other_queries_run(spark, name):
    assert P.QUERIES[name](spark, DATA).count() > 0


def test_defanged_prose_is_idempotent(spark):
    assert P.def_06_defang_text(spark, DATA).where("not idempotent").count() == 0


def test_streams(spark, tmp_path):
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, frame in (("windows", ingest.tumbling(stream, "ts", "event_type", "value")), ("visits", ingest.sessions(stream, "ts", "user_id"))):
        run = frame.writeStream.format("memory").queryName(name).outputMode("append").start()
        run.processAllAvailable()
        run.stop()
    whole = P.x_tumbling_windows(spark, DATA).count()
    assert 0 < spark.table("windows").count() <= whole and spark.table("visits").count() > 0
    (tmp_path / "mail").mkdir()
    (tmp_path / "mail" / "a.eml").write_bytes(b"From: a@b.example\nSubject: hi\n\ntext\n")
    run = ingest.messages(spark, str(tmp_path / "mail")).select("msg_id", "subject").writeStream.format("memory").queryName("mails").start()
    run.processAllAvailable()
    run.stop()
    assert [r.subject for r in spark.table("mails").collect()] == ["hi"]
