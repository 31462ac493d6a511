"""Streams with late rows, a batch that dies and is run again, sessions with timeouts, appends that may be repeated."""

import datetime as dt
import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sparkloom.operators import tables
from sparkloom.sources import readers
from sparkloom.streaming import live

SCHEMA = "user_id long, ts timestamp, value double"


def at(minutes):
    return (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)).isoformat(sep=" ")


@pytest.fixture
def arrive(tmp_path):
    """Puts files of rows where a stream reads them, one a batch, in order."""
    (tmp_path / "in").mkdir()
    n = iter(range(1000))

    def put(*rows):
        i = next(n)
        path = tmp_path / "in" / f"{i:04}.json"
        path.write_text("\n".join(json.dumps({"user_id": u, "ts": None if m is None else at(m), "value": v}) for u, m, v in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))

    return put


def stream(spark, tmp_path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def stored(spark, path):
    return sorted((r.value, r.user_id, None if r.ts is None else (r.ts - dt.datetime(2024, 1, 1)).total_seconds() / 60, r.batch) for r in spark.read.parquet(path).collect())


def test_late_rows_and_a_batch_that_dies(spark, tmp_path, arrive):
    arrive((1, 0, 1.0), (1, 30, 2.0), (2, None, 2.5))
    arrive((2, 25, 3.0), (2, 10, 4.0), (3, 60, 5.0))  # the mark is 30 - 10
    arrive((1, 49, 6.0), (1, 50, 7.0), (1, 90, 8.0))
    died, seen = [], []

    def then(batch, n):
        if n == 1 and not died:
            died.append(n)
            raise RuntimeError("killed between the writes and the commit")
        seen.append((n, sorted(r.value for r in batch.collect())))

    load = lambda: live.load_in_time(stream(spark, tmp_path), str(tmp_path / "out"), str(tmp_path / "check"), then=then)
    with pytest.raises(StreamingQueryException):
        load().awaitTermination()
    load().awaitTermination()
    assert died and seen == [(0, [1.0, 2.0, 2.5]), (1, [3.0, 5.0]), (2, [7.0, 8.0])]
    rows = stored(spark, str(tmp_path / "out/rows"))
    assert rows == [(1.0, 1, 0, 0), (2.0, 1, 30, 0), (2.5, 2, None, 0), (3.0, 2, 25, 1), (5.0, 3, 60, 1), (7.0, 1, 50, 2), (8.0, 1, 90, 2)]
    assert stored(spark, str(tmp_path / "out/late")) == [(4.0, 2, 10, 1), (6.0, 1, 49, 2)]
    # nothing new: nothing changes
    load().awaitTermination()
    assert stored(spark, str(tmp_path / "out/rows")) == rows


def sessions_of(df):
    return sorted((r.who, r.start, r.end, r.n, round(r.total, 6)) for r in df.collect())


def run(query_of, spark, tmp_path, name):
    q = query_of(stream(spark, tmp_path)).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def test_sessions_as_a_stream(spark, tmp_path, arrive):
    arrive((1, 0, 1.0), (1, 20, 2.0), (2, 5, 1.0))
    arrive((1, 45, 3.0), (2, 50, 2.0), (1, 39, 4.0))
    arrive((1, 100, 5.0), (3, 101, 1.0))
    arrive((3, 102, 1.0))  # rows are held against the mark of the batch before the last
    arrive((2, 51, 99.0), (3, 110, 1.0))  # late by far: the mark is 101 - 10
    arrive((9, 10_000, 0.0))
    arrive((9, 10_001, 0.0))
    every = spark.read.schema(SCHEMA).json(str(tmp_path / "in"))
    want = [s for s in sessions_of(live.sessions(every.where("value < 99"))) if s[0] != 9]
    built_in = run(lambda e: live.sessions(e), spark, tmp_path, "built-in")
    assert sessions_of(built_in) == want
    own = run(lambda e: live.busy_sessions(e), spark, tmp_path, "own")
    assert sessions_of(own) == want and not any(r.busy for r in own.collect())


def test_busy_sessions_come_at_once(spark, tmp_path, arrive):
    arrive(*[(1, m, 1.0) for m in range(5)], (2, 0, 1.0))
    arrive((1, 6, 1.0))
    arrive((9, 10_000, 0.0))
    arrive((9, 10_001, 0.0))
    out = run(lambda e: live.busy_sessions(e, most=5), spark, tmp_path, "busy")
    assert sorted((r.who, r.n, r.busy) for r in out.collect()) == [(1, 1, False), (1, 5, True), (2, 1, False)]


def test_appends_of_a_batch_replace_one_another(spark, tmp_path):
    rows = spark.createDataFrame([("t", "a", "fast", 1.0, 0.55555, 3)], readers.LATENCY)
    triples = spark.createDataFrame([("a", "P", "b", 0.1, "s")], "subject_id string, predicate string, object_id string, confidence double, source string")
    for batch in (0, 1, 1, 0):
        readers.append_latency(rows, str(tmp_path / "log"), batch)
        readers.append_review(triples, str(tmp_path / "queue"), F.lit("now"), batch)
    good, bad = readers.latency_log(spark, str(tmp_path / "log"))
    assert [r.best_score for r in good.collect()] == [0.5556] * 2 and bad.isEmpty()
    assert readers.review_queue(spark, str(tmp_path / "queue")).count() == 2


def test_counts_come_from_the_write(spark):
    triples = spark.createDataFrame([("a", "P", "b", 0.9), ("a", "P", "x", 0.9), ("a", "P", "b", 0.1), ("a", "P", "b", None)], "subject_id string, predicate string, object_id string, confidence double")
    counted = tables.Counted(triples, spark.createDataFrame([("a",), ("b",)], "id string"))
    plan = counted.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD[subject_id") == 1  # one scan of the triples
    assert tables.materialise(counted.rows).count() == 1 and counted.counts() == {"n": 4, "low": 2, "dangling": 1}
    none = tables.Counted(triples, spark.createDataFrame([("z",)], "id string"))
    assert tables.materialise(none.rows).count() == 0 and none.counts() == {"n": 4, "low": 2, "dangling": 2}
