"""Structured Streaming forms: pages loaded as they arrive, latencies rolled up by window, sessions, and loads that write each
batch once, late rows apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.chunking import chunk_documents
from ..functions.text import clean_text


def chunk_stream(pages: DataFrame) -> DataFrame:
    """Chunks of a stream of raw documents; ids depend on content alone, so a replay gives the same rows."""
    return chunk_documents(pages.withColumn("text", clean_text(F.col("text"))))


def load_stream(rows: DataFrame, load: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Every micro-batch goes to load(batch, batch number), an idempotent upsert."""
    return rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latency_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", ts: str = "ts", path: str = "path", value: str = "elapsed_sec", slide: str | None = None) -> DataFrame:
    """(start, path, n, total, high) for each window and path; windows begin every `slide`, one after the other unless it is
    given. On a stream, rows later than `late` are dropped."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, window, slide).alias("w"), F.col(path).alias("path")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), "path", "n", "total", "high")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", who: str = "user_id", value: str = "value") -> DataFrame:
    """(who, start, end, n, total): runs of events of one user with less than `gap` between neighbours; end is the last event
    plus the gap. On a stream a session comes when the watermark has passed its end, and rows later than `late` are
    dropped. Rows without a time are in no session; those without a user are one user's."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), F.col(who).alias("who")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select("who", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def _joined(runs: list[list], gap: int) -> list[list]:
    """Runs [first, last, n, total] in order, those less than a gap apart as one."""
    out: list[list] = []
    for run in sorted(runs):
        if out and run[0] - out[-1][1] < gap:
            out[-1] = [out[-1][0], max(out[-1][1], run[1]), out[-1][2] + run[2], out[-1][3] + run[3]]
        else:
            out.append(list(run))
    return out


def busy_sessions(events: DataFrame, gap_seconds: int = 1800, late: str = "10 minutes", most: int = 1000, ts: str = "ts", who: str = "user_id", value: str = "value") -> DataFrame:
    """sessions() of a stream with `busy`: a session of `most` events comes at once, without waiting for its end, and its
    user's next event begins another. State is a few numbers for each open run of a user, kept until the watermark has
    passed its end; a run within reach of late rows stays open. Events are dealt by user, so a user is one task's."""
    gap = gap_seconds * 1_000_000
    kind = events.schema[who].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = [list(r) for r in zip(*state.get, strict=True)] if state.exists else []
        for b in [] if state.hasTimedOut else batches:
            at = b["ts"].astype("datetime64[us]").astype("int64")
            runs = _joined(runs + [[t, t, 1, v] for t, v in zip(at.tolist(), b["v"].fillna(0.0).tolist(), strict=True)], gap)
        mark = state.getCurrentWatermarkMs() * 1000
        ended = [r for r in runs if r[2] >= most or r[1] + gap <= mark]
        runs = [r for r in runs if r not in ended]
        if runs:
            state.update(tuple(list(x) for x in zip(*runs, strict=True)))
            state.setTimeoutTimestamp(max(mark // 1000 + 1, min(r[1] for r in runs) // 1000 + gap // 1000 + 1))
        elif state.exists:
            state.remove()
        if ended:
            of = lambda us: pd.to_datetime(us, unit="us", utc=True)
            yield pd.DataFrame([(key[0], of(a), of(z + gap), n, total, n >= most) for a, z, n, total in ended], columns=["who", "start", "end", "n", "total", "busy"])

    rows = events.withWatermark(ts, late).where(F.col(ts).isNotNull()).select(F.col(who).alias("who"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("v"))
    out = f"who {kind}, start timestamp, end timestamp, n long, total double, busy boolean"
    held = "firsts array<long>, lasts array<long>, counts array<long>, totals array<double>"
    return rows.groupBy("who").applyInPandasWithState(run, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def write_once(rows: DataFrame, folder: str, batch: int, form: str = "parquet") -> None:
    """A batch's rows in a folder of their own: when the batch comes again, it replaces what it wrote before. Read the folder
    for all of them, with their number in the column `batch`."""
    rows.write.mode("overwrite").format(form).save(f"{folder}/batch={batch}")


def load_in_time(rows: DataFrame, folder: str, checkpoint: str, ts: str = "ts", late: str = "10 minutes", then: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Every row of a stream once in `folder`/rows, or in `folder`/late if it is more than `late` behind the latest time of
    the batches before its own (without a time: in time).

    That mark depends on earlier batches only and is kept with each batch's number, so a batch that is run again, after a
    job that died anywhere in it, writes the same rows to the same places. then(in time, number): what else is to be done
    with a batch; it may be done again, and so is to be idempotent, as upserts are.
    """

    def load(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{folder}/marks/batch={n - 1}").first()[0] if n else None
        batch = batch.persist()
        try:
            behind = F.coalesce(F.col(ts) < F.lit(before) - F.expr(f"interval {late}"), F.lit(False)) if before else F.lit(False)
            write_once(batch.where(~behind), f"{folder}/rows", n)
            write_once(batch.where(behind), f"{folder}/late", n)
            write_once(batch.agg(F.greatest(F.max(ts), F.lit(before).cast(batch.schema[ts].dataType)).alias("mark")), f"{folder}/marks", n)
            if then:
                then(spark.read.schema(batch.schema).parquet(f"{folder}/rows/batch={n}"), n)
        finally:
            batch.unpersist()

    return load_stream(rows, load, checkpoint, **trigger)
