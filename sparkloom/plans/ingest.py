"""Loading pages into a knowledge base: clean, chunk, embed, extract, normalise, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.chunking import chunk_documents
from ..functions.embed import encoder
from ..functions.text import clean_text
from ..operators import extract, tables
from ..sources import buckets


def build(raw: DataFrame, now: Column, encode=None, model=None, aliases: dict[str, str] | None = None, pattern: str = rules.CODE, institutions: list[str] | None = None, trigger: str = rules.IMPOSSIBLE, header: str = rules.HEADER) -> dict[str, DataFrame]:
    """New rows of raw documents by table: chunks, entities, triples, links. model(Column) -> Column, if given, sees
    the chunks in which no rule finds an entity or triple."""
    chunks = chunk_documents(raw.withColumn("text", clean_text(F.col("text"))), header)
    chunks = chunks.withColumn("embedding", (encode or encoder())(F.col("text"))).withColumn("needs_review", F.lit(False)).withColumn("created_at", now)
    chunks = tables.materialise(chunks)
    found, triples = extract.rule_entities(chunks, pattern, institutions), extract.rule_triples(chunks, trigger, pattern)
    table = extract.alias_table(raw.sparkSession, aliases)
    if model is not None:
        replies = tables.materialise(extract.replies(extract.without_rules(chunks, found, triples), model))
        found = found.unionByName(extract.reply_entities(replies), allowMissingColumns=True)
        triples = triples.unionByName(extract.reply_triples(replies), allowMissingColumns=True)
    order = F.concat_ws("#", "chunk_id", F.lpad(F.col("ord").cast("string"), 8, "0"))
    found = tables.materialise(extract.normalise_ids(found.withColumn("ord", order), ["id"], table))
    entities = tables.dedupe_best(found, "id").drop("ord", "chunk_id").withColumn("created_at", now)
    triples = extract.normalise_ids(triples, ["subject_id", "object_id"], table).drop("ord", "chunk_id")
    return {"chunks": chunks.drop("ord"), "entities": entities, "triples": triples, "links": extract.found_in(found)}


def load(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after new rows are loaded in order: chunks, entities, edges, links. Ends are looked up among what
    is loaded by then. `queue` has the triples that wait for review."""
    chunks = tables.upsert_keeping(old["chunks"], new["chunks"], ["id"])
    entities = tables.upsert_gated(old["entities"], new["entities"], ["id"])
    edges, queue = tables.upsert_edges(old["edges"], new["triples"], entities)
    links = tables.upsert_links(old["links"], new["links"], entities, chunks)
    return {"chunks": chunks, "entities": entities, "edges": edges, "links": links, "queue": queue}


SCHEMAS = {
    "chunks": "id string, text string, source_file string, source_page int, section string, language string, doc_version string, embedding array<float>, needs_review boolean, created_at string",
    "entities": "id string, name string, domain string, source string, confidence double, created_at string",
    "edges": "src_id string, rel_type string, dst_id string, confidence double",
    "links": "node_id string, chunk_id string, link_type string, confidence double, source string",
    "queue": "subject_id string, predicate string, object_id string, confidence double",
}


#: Key and place of each stored table: what a page brings lies together.
LAYOUT = {
    "chunks": (["id"], ["source_file"]),
    "entities": (["id"], ["id"]),
    "edges": (["src_id", "rel_type", "dst_id"], ["src_id"]),
    "links": (["node_id", "chunk_id", "link_type"], ["node_id"]),
    "queue": (["subject_id", "predicate", "object_id"], ["subject_id"]),
}


def stored_tables(spark, folder: str, parts: int = 64, files: int = 4) -> dict[str, buckets.Table]:
    """The tables of a knowledge base in a folder, made where they do not exist."""
    return {k: buckets.Table(spark, f"{folder}/{k}", SCHEMAS[k], keys, place, parts, files) for k, (keys, place) in LAYOUT.items()}


def store(spark, folder: str, new: dict[str, DataFrame], parts: int = 64, files: int = 4) -> dict[str, DataFrame]:
    """load() into stored tables, in that order, so that ends are looked up among what is stored. Only the parts into which
    new rows fall are rewritten. A chunk has the file it came from in its id, so its place never changes. A rerun writes
    the same rows. `counts` has one row: triples, those that wait for review, those that dangle, as the write saw them."""
    kept = stored_tables(spark, folder, parts, files)
    kept["chunks"].upsert(new["chunks"], columns=buckets.keep_first())
    kept["entities"].upsert(new["entities"], buckets.gate())
    _, queued = tables.split_review(new["triples"])
    # ids alone and out of their buckets: joins with them have tasks by their number, and not as many as there are buckets
    nodes, chunks = (tables.materialise(kept[k].rows().select("id")) for k in ("entities", "chunks"))
    of_nodes, of_chunks = tables.end_tasks(nodes), tables.end_tasks(chunks)
    counted = tables.Counted(tables.with_properties(new["triples"]), nodes, tasks=of_nodes)
    edges = counted.rows.withColumnsRenamed({"subject_id": "src_id", "predicate": "rel_type", "object_id": "dst_id"})
    rest = [c for c in edges.columns if c not in LAYOUT["edges"][0]]
    edges = tables.materialise(tables.pick(edges, LAYOUT["edges"][0], [F.desc("confidence"), *[F.asc(c) for c in rest]]))
    kept["edges"].upsert(edges, columns=buckets.keep_known(["confidence"]))
    links = tables.existing_ends(new["links"], nodes, ["node_id"], tasks=of_nodes)
    links = tables.existing_ends(links, chunks, ["chunk_id"], tasks=of_chunks)
    kept["links"].upsert(tables.materialise(tables.pick(links, LAYOUT["links"][0], [F.desc("confidence")])))
    kept["queue"].upsert(tables.pick(queued, LAYOUT["queue"][0], [F.desc("confidence")]))
    counts = spark.createDataFrame([tuple(counted.counts().values())], "n long, low long, dangling long")
    return {k: t.rows() for k, t in kept.items()} | {"counts": counts}


def new_pages(raw: DataFrame, loaded: DataFrame) -> DataFrame:
    """Pages whose content (file, page, text) is not among those loaded (content_hash): a rerun loads nothing twice."""
    digest = F.sha2(F.concat_ws("\x01", "source_file", F.col("source_page").cast("string"), "text"), 256)
    return raw.withColumn("content_hash", digest).join(loaded.select("content_hash"), "content_hash", "left_anti")
