"""Sources and sinks: page files, images, logs, queues and the embedding cache."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import rules
from . import versions
from ..functions.text import doc_version, section, strip

LATENCY = "ts string, agent string, path string, elapsed_sec double, best_score double, evidence_count int"
REVIEW = "subject_id string, predicate string, object_id string, confidence double, source string, created_at string"


def page_files(spark: SparkSession, folder: str, parse: Callable[[bytes], Iterable[str]], glob: str = "*.pdf", errors: bool = False) -> DataFrame:
    """(source_file, source_page, text) of the pages of all files of a folder; parse gives the texts of a file's
    pages, one after the other. A file that parse fails on gives the pages before that; errors: and then a row without a
    text, whose `error` says where and why. Parsers are not part of this package."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name, i = path.rsplit("/", 1)[-1], 0
                try:
                    for i, t in enumerate(parse(content), 1):
                        rows.append((name, i, t, None))
                except Exception as e:  # a broken file must not end the job
                    rows += [(name, i + 1, None, f"{type(e).__name__}: {e}")] if errors else []
            yield pd.DataFrame(rows, columns=["source_file", "source_page", "text", "error"], dtype=None if rows else object)[columns]

    columns = ["source_file", "source_page", "text", "error"][: 4 if errors else 3]
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")
    return files.mapInPandas(run, "source_file string, source_page int, text string" + ", error string" * errors)


def carry_sections(pages: DataFrame, file: str = "source_file", page: str = "source_page", found: str = "section") -> DataFrame:
    """A page without a section of its own gets the last one before it in the file; empty before the first."""
    run = Window.partitionBy(file).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn(found, F.coalesce(F.last(F.nullif(found, F.lit("")), ignorenulls=True).over(run), F.lit("")))


def raw_documents(pages: DataFrame, language: str = "ko", patterns: list[str] | None = None) -> DataFrame:
    """Raw documents of (source_file, source_page, text): blank pages go, sections are carried on, the version comes
    from the file's name."""
    full = pages.where(strip(F.col("text")) != "").withColumn("section", section(F.col("text"), patterns))
    return carry_sections(full).withColumn("language", F.lit(language)).withColumn("doc_version", doc_version(F.col("source_file"))).withColumn("source_url", F.lit(""))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mime, data): images in base64; png where the suffix names no known type."""
    types = F.create_map(*[F.lit(x) for kv in rules.IMAGE_TYPES.items() for x in kv])
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return spark.read.format("binaryFile").load(folder).select("path", F.coalesce(F.try_element_at(types, suffix), F.lit("image/png")).alias("mime"), F.base64("content").alias("data"))


def parse_log(lines: DataFrame, column: str = "value", schema: str = LATENCY) -> DataFrame:
    """Log rows of JSON lines; a line that is no JSON has all of them null and stands in `corrupt`."""
    parsed = F.from_json(column, schema + ", corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return lines.where(F.trim(column) != "").select(parsed.alias("x")).select("x.*")


def latency_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined lines) of a JSON-lines log."""
    rows = parse_log(spark.read.text(path))
    return rows.where("corrupt is null").drop("corrupt"), rows.where("corrupt is not null").select("corrupt")


def append_latency(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """Add rows to a log. batch: the number of the stream's batch they are; run again, it replaces what it added before."""
    _append(rows.withColumn("best_score", F.round("best_score", 4)), path, batch)


def _append(rows: DataFrame, path: str, batch: int | None) -> None:
    if batch is None:
        rows.write.mode("append").json(path)
    else:
        rows.write.mode("overwrite").json(f"{path}/batch={batch}")


def review_queue(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Queued triples from JSON lines; whole: each file is one JSON array."""
    return spark.read.schema(REVIEW).option("multiLine", whole).json(path)


def append_review(triples: DataFrame, path: str, created_at: Column, batch: int | None = None) -> None:
    """Add triples to a queue; batch as in append_latency()."""
    cols = ["subject_id", "predicate", "object_id", "confidence", "source"]
    _append(triples.select(*cols, created_at.cast("string").alias("created_at")), path, batch)


def cached_embeddings(chunks: DataFrame, cache: DataFrame, encode: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, new cache rows): texts known to the cache (text_hash, embedding) are not encoded again."""
    rows = chunks.drop("embedding").withColumn("text_hash", F.sha2("text", 256))
    new = rows.join(cache, "text_hash", "left_anti").groupBy("text_hash").agg(F.first("text").alias("text")).select("text_hash", encode(F.col("text")).alias("embedding"))
    both = cache.select("text_hash", "embedding").unionByName(new)
    return rows.join(both, "text_hash").drop("text_hash"), new


def save_cache(spark: SparkSession, path: str, new: DataFrame) -> int:
    """Add new rows (text_hash, embedding) to a cache kept as versions; rows it has stay as they are."""
    old = versions.load(spark, path, new.schema)
    return versions.save(old.unionByName(new.join(old.select("text_hash"), "text_hash", "left_anti")), path)
