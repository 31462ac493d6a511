"""Tables in the shared folder and keyed upserts. There is no MERGE on Parquet, so an upsert is a union and a
window; sources.versions writes what comes out as a new version of the table."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from .. import rules


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as the session names it. Only where driver and executors are one process may
    it be unset: it then becomes a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session as long as this lasts."""
    was = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: A write's shuffle files go when it has ended, not when the driver happens to collect its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def materialise(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with settings(df.sparkSession, TIDY):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def written(df: DataFrame) -> str:
    """The folder of a table that materialise() gave."""
    return df._written


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; the rank filter is pushed below the shuffle, so a hot key sends few rows."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_i", rank).where("_i = 1").drop("_i")


def dedupe_best(df: DataFrame, key: str = "id", score: str = "confidence", ord_: str = "ord") -> DataFrame:
    """One row for each key: the highest score, and of equal ones the first."""
    return pick(df, [key], [F.desc_nulls_last(score), F.asc(ord_)])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Last write wins: rows of new replace those of old with the same keys. New has a key once."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return pick(both, keys, [F.desc("_new")]).drop("_new")


def upsert_gated(old: DataFrame, new: DataFrame, keys: list[str], score: str = "confidence") -> DataFrame:
    """As upsert(), but a row of new with a lower score than the stored one is left out. A stored null is no gate;
    equal scores overwrite."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return pick(both, keys, [F.desc_nulls_last(score), F.desc("_new")]).drop("_new")


def upsert_keeping(old: DataFrame, new: DataFrame, keys: list[str], first: str = "created_at") -> DataFrame:
    """As upsert(), but column `first` keeps the stored value where there is one."""
    kept = old.where(F.col(first).isNotNull()).select(*keys, F.col(first).alias("_first"))
    return upsert(old, new, keys).join(kept, keys, "left").withColumn(first, F.coalesce("_first", first)).drop("_first")


def upsert_nodes(old: DataFrame, new: DataFrame, label: str, now: Column) -> DataFrame:
    """Nodes of a label that has its own table (Domain, Topic, Procedure, Document, Institution): the columns the label
    has, last write wins, `updated_at` is when a row was written. New has an id once."""
    cols = rules.NODE_COLUMNS[label]
    return upsert(old.select(*cols, "updated_at"), new.select(*cols).withColumn("updated_at", now), ["id"])


def split_review(triples: DataFrame, least: float = rules.CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(accepted, queued): triples below `least` wait for review. A null confidence waits too."""
    good = F.coalesce(F.col("confidence") >= least, F.lit(False))
    return triples.where(good), triples.where(~good)


def with_properties(triples: DataFrame, predicate: str = "predicate") -> DataFrame:
    """Only the property that belongs to the predicate stays; the others become null."""
    out = triples
    for name, column in rules.EDGE_PROPERTY.items():
        if column in triples.columns:
            out = out.withColumn(column, F.when(F.col(predicate) == name, F.col(column)))
    return out


#: Ids that a task holds, about, where rows are looked up among more than four times as many.
ENDS = 1 << 18


def end_tasks(nodes: DataFrame) -> int | None:
    """What existing_ends() should have as `tasks`: None where nodes are few."""
    n = nodes.count()
    return n // ENDS if n > 4 * ENDS else None


def existing_ends(rows: DataFrame, nodes: DataFrame, ends: list[str], key: str = "id", tasks: int | None = None) -> DataFrame:
    """Rows all of whose ends are nodes, whatever their label. tasks: for many nodes. Both sides are then dealt to so many tasks
    by end; a task holds its ids and lets its rows pass by, so neither many nodes nor an end of many rows fills it."""
    ids = nodes.select(F.col(key).alias("_id"))
    ids = ids.repartition(tasks, "_id").hint("shuffle_hash") if tasks else ids.distinct()
    for end in ends:
        rows = (rows.repartition(tasks, end) if tasks else rows).join(ids, F.col(end) == F.col("_id"), "left_semi")
    return rows


def upsert_edges(old: DataFrame, triples: DataFrame, nodes: DataFrame, least: float = rules.CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(edges, queued) after triples (subject_id, predicate, object_id, confidence, ...) are loaded: low ones are
    queued, those with an end that is no node go, and each (src_id, rel_type, dst_id) has one edge, whose stored
    properties stay where the new triple has none. Repeated triples: the one of highest confidence."""
    good, queued = split_review(triples, least)
    good = existing_ends(with_properties(good), nodes, ["subject_id", "object_id"])
    new = good.withColumnsRenamed({"subject_id": "src_id", "predicate": "rel_type", "object_id": "dst_id"})
    keys = ["src_id", "rel_type", "dst_id"]
    rest = [c for c in new.columns if c not in keys]
    new = pick(new, keys, [F.desc("confidence"), *[F.asc(c) for c in rest]])
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (*keys, "_new")]
    merged = both.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_new"))).alias(c) for c in cols])
    return merged.select(*keys, *cols), queued


def upsert_links(old: DataFrame, links: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Node-chunk links (node_id, chunk_id, link_type, ...) whose node and chunk exist; a link replaces its like."""
    good = existing_ends(existing_ends(links, nodes, ["node_id"]), chunks, ["chunk_id"])
    keys = ["node_id", "chunk_id", "link_type"]
    return upsert(old, pick(good, keys, [F.desc("confidence")]), keys)


def flag_review(df: DataFrame, column: str, value: str) -> tuple[DataFrame, int]:
    """(df with needs_review set where column = value, how many rows that is)."""
    hit = F.coalesce(F.col(column) == value, F.lit(False))
    flagged = df.withColumn("needs_review", F.when(hit, True).otherwise(F.coalesce("needs_review", F.lit(False))))
    return flagged, df.where(hit).count()


def missing(df: DataFrame, vector: str = "embedding") -> Column:
    return F.col(vector).isNull() | (F.size(vector) <= 0)


def fill_embeddings(chunks: DataFrame, encode, vector: str = "embedding") -> DataFrame:
    """Rows without a vector get one from encode(text column); all other columns stay."""
    none, some = chunks.where(missing(chunks, vector)), chunks.where(~missing(chunks, vector))
    return some.unionByName(none.withColumn(vector, encode(F.col("text"))))


class Counted:
    """Triples on their way to a table of edges: `rows` are those that are confident enough and whose ends are nodes; once
    an action has run over them, counts() has how many came, how many were low, and how many dangle, as that action
    saw them."""

    def __init__(self, triples: DataFrame, nodes: DataFrame, least: float = rules.CONFIDENCE, tasks: int | None = None):
        self._again = lambda: by_endpoint_count(triples, nodes, least, tasks)
        self._came, self._kept = Observation(), Observation()
        low = ~F.coalesce(F.col("confidence") >= least, F.lit(False))
        seen = triples.observe(self._came, F.count(F.lit(1)).alias("n"), F.count_if(low).alias("low"))
        good = existing_ends(split_review(seen, least)[0], nodes, ["subject_id", "object_id"], tasks=tasks)
        self.rows = good.observe(self._kept, F.count(F.lit(1)).alias("kept"))

    def counts(self) -> dict[str, int]:
        try:
            came, kept = self._came.get, self._kept.get["kept"]
        except Py4JJavaError:  # Spark drops the counters of a plan that turns out to be empty while it runs
            return self._again().first().asDict()
        return {"n": came["n"], "low": came["low"], "dangling": came["n"] - came["low"] - kept}


def by_endpoint_count(triples: DataFrame, nodes: DataFrame, least: float = rules.CONFIDENCE, tasks: int | None = None) -> DataFrame:
    """One row: triples, those below the confidence threshold, those that dangle."""
    good, _ = split_review(triples, least)
    kept = existing_ends(good, nodes, ["subject_id", "object_id"], tasks=tasks).agg(F.count("*").alias("kept"))
    counts = triples.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("confidence") >= least, F.lit(False))).alias("low"))
    # two one-row tables side by side
    return counts.join(kept, F.lit(True)).select("n", "low", (F.col("n") - F.col("low") - F.col("kept")).alias("dangling"))
