"""Shared pieces of the training-data operators: stashed tables, document scans, graph components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Characters that separate words: space and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Only where driver and executors are one process
    may it be unset: it then becomes a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*stashed: DataFrame) -> None:
    """Delete stashed tables that nothing will read again. What a returned DataFrame still reads stays."""
    for df in stashed:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


#: Rows in a batch that goes to Python, at most, where rows are whole texts.
BATCH_ROWS = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(df: DataFrame) -> DataFrame:
    """df, after the session's batches are set to BATCH_ROWS rows if they were larger: with long texts ten thousand rows,
    Spark's own setting, hold hundreds of megabytes on either side."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH)) <= BATCH_ROWS:
        conf.set(BATCH, str(BATCH_ROWS))
    return df


def prefix(df: DataFrame) -> str:
    """What no column of df begins with; helper columns get names that do."""
    out = "_"
    while any(c.startswith(out) for c in df.columns):
        out += "_"
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): component is the smallest id reachable over the undirected edges.

    Alternating large-star and small-star rounds until every edge leads to a smallest id; every round is an
    aggregation and a join of (long, long) rows, so no neighbourhood is gathered in a task. Null ends and loops are
    ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = stash(e)
    while True:
        # done when no smaller end has a smaller one itself, and no id two of them
        inner = e.select("v").distinct().join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("v")
        forked = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        if inner.unionByName(forked.withColumnRenamed("u", "v")).isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        last = e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("x"))
        e = stash(small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u > v").distinct())
        discard(last)
