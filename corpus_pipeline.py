"""Corpus pipeline: language ID, near-duplicate removal, private data, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents, as they came in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import bpe, jaccard, langid, mixing, pii
from sparkloom.llm.common import documents, prefix, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; those without a letter (null and empty texts too) go. The label
    becomes the prediction. The model is trained on this stage's labelled input. Rows stand alone: repeated rows and
    rows without doc_id stay. Without any labelled text no document has a language."""
    own = prefix(docs)
    plain = docs.select(*[F.col(c).alias(own + c) for c in docs.columns])  # no name of a result is among them
    found = langid.detect(plain, langid.trained(docs), own + "text").where("lang_pred <> 'und'")
    return found.select(*[(F.col("lang_pred") if c == "lang" else F.col(own + c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of every class of linked documents. Of rows with the same doc_id, or
    without one, and the same text one stays; rows with one doc_id and different texts stay or go together. Documents
    without words are in no class."""
    classes = jaccard.similarity_classes(docs.select("doc_id", "text"))
    gone = classes.where("doc_id <> component_id").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if odd.isEmpty():
        return kept
    ids = odd.withColumnRenamed("doc_id", prefix(docs))
    same = kept["doc_id"].eqNullSafe(ids[prefix(docs)])
    return kept.join(ids, same, "left_anti").unionByName(kept.join(ids, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data become surrogates; every document stays, also without text or doc_id. n_chars is the new text's
    length, null for a null text."""
    own = prefix(docs)
    out = pii.replace(docs.select(*[F.col(c).alias(own + c) for c in docs.columns]), own + "doc_id", own + "text")
    size = F.length(own + "text")
    return out.select(*[(size.cast(docs.schema[c].dataType) if c == "n_chars" else F.col(own + c)).alias(c) for c in docs.columns])


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so some twice and some not at all; rows that share a
    doc_id, or have none, are taken as often as the one taken most. Wordless texts are never taken."""
    m = mixing.mix(docs.select("doc_id", "source", mixing.token_count(F.col("text")).alias("size")))
    own = prefix(docs)
    taken = m.where("repeats > 0").groupBy(F.col("doc_id").alias(own)).agg(F.max("repeats").alias(own + "n"))
    out = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(own))).withColumn(own + "i", F.explode(F.sequence(F.lit(1), F.col(own + "n"))))
    return out.select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix, a row for each time it is taken; a null text
    is empty."""
    return bpe.digest(docs, bpe.default_path())


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", private_data),
    ("mixing sources to target weights", mixing_weights),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Language models, surrogates and token ids are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; stages meet in tables in the shared folder."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/stage-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
