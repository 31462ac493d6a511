"""Tables kept as versions: a write makes a new version and then names it, so a reader sees all of it or none.

A table is a folder with a folder of Parquet for each version and, for each, a file in `_named` that is made once
the version is whole. A job that dies leaves a version without a name, which nobody reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), lambda *p: jvm.org.apache.hadoop.fs.Path("/".join((path, *p)))


def latest(spark: SparkSession, path: str) -> int:
    """Number of the newest whole version; 0 if there is none."""
    fs, at = _files(spark, path)
    named = [int(s.getPath().getName()) for s in fs.listStatus(at("_named"))] if fs.exists(at("_named")) else []
    return max(named, default=0)


def save(df: DataFrame, path: str, keep: int = 2) -> int:
    """Write df as the next version and name it; versions before the last `keep` go. df may read the table itself."""
    spark = df.sparkSession
    fs, at = _files(spark, path)
    version = latest(spark, path) + 1
    df.write.mode("overwrite").parquet(f"{path}/{version}")
    if not fs.createNewFile(at("_named", str(version))):
        raise RuntimeError(f"version {version} of {path} was written by another job meanwhile")
    for old in range(max(1, version - keep - 3), version - keep + 1):
        fs.delete(at("_named", str(old)), False)
        fs.delete(at(str(old)), True)
    return version


def load(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The newest version. A table that does not exist yet is empty, if its schema is given."""
    version = latest(spark, path)
    if not version:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/{version}")


def create(spark: SparkSession, path: str, schema: StructType | str) -> None:
    """An empty table, unless there is one."""
    if not latest(spark, path):
        save(spark.createDataFrame([], schema), path)
