"""Entities and triples from chunks: by rules, and by a model's JSON for chunks in which the rules find nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import rules
from ..functions.text import unfence
from .tables import dedupe_best

ENTITY = "struct<id:string,name:string,type:string,domain:string,aliases:array<string>,summary:string,confidence:string>"
RELATION = "struct<subject_id:string,predicate:string,object_id:string,condition:string,confidence:string,source_text:string>"
REPLY = f"struct<entities:array<{ENTITY}>,relations:array<{RELATION}>>"


def codes(text: Column, pattern: str = rules.CODE) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def rule_entities(chunks: DataFrame, pattern: str = rules.CODE, institutions: list[str] | None = None) -> DataFrame:
    """(chunk_id, ord, id, name, domain, source, confidence): every code found, repeats too, then the institutions
    that the text names, by place in their list."""
    listed = rules.INSTITUTIONS if institutions is None else institutions
    names = F.filter(F.array(*[F.lit(x) for x in listed]), lambda n: F.contains(F.col("text"), n)) if listed else F.array().cast("array<string>")
    one = lambda x, domain: F.struct(F.replace(x, F.lit(" "), F.lit("_")).alias("id"), x.alias("name"), F.lit(domain).alias("domain"))
    found = F.concat(F.transform(codes(F.col("text"), pattern), lambda c: one(c, "visa")), F.transform(names, lambda n: one(n, "institution")))
    rows = chunks.select(F.col("id").alias("chunk_id"), F.col("source_file").alias("source"), F.posexplode(found).alias("ord", "e"))
    return rows.select("chunk_id", "ord", "e.id", "e.name", "e.domain", "source", F.lit(1.0).alias("confidence"))


def rule_triples(chunks: DataFrame, trigger: str = rules.IMPOSSIBLE, pattern: str = rules.CODE, subject: str = rules.BLOCKED_SUBJECT, suffix: str = rules.BLOCKED_SUFFIX, reason: str = rules.BLOCKED_REASON) -> DataFrame:
    """A BLOCKS triple for every code in a chunk that has the trigger."""
    rows = chunks.where(F.col("text").rlike(trigger)).select(F.col("id").alias("chunk_id"), F.col("source_file").alias("source"), "source_page", F.posexplode(codes(F.col("text"), pattern)).alias("ord", "c"))
    return rows.select(
        "chunk_id", "ord", F.lit(subject).alias("subject_id"), F.lit("BLOCKS").alias("predicate"), F.concat("c", F.lit(suffix)).alias("object_id"),
        F.lit(reason).alias("block_reason"), F.lit(1.0).alias("confidence"), "source", "source_page",
    )


def without_rules(chunks: DataFrame, *found: DataFrame) -> DataFrame:
    """Chunks in which no rule found anything: the only ones that a model sees."""
    for rows in found:
        chunks = chunks.join(rows.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_anti")
    return chunks


def instructions(ask: str, form: str = rules.REPLY_FORM, labels: list[str] | None = None, predicates: list[str] | None = None) -> str:
    """What a model is told before it sees a chunk or a picture: the task, the form of its reply, and the types of entities
    and relations that count; replies with others lose them when they are parsed."""
    return "\n".join([ask, f"Form: {form}", "Types: " + ", ".join(labels or rules.NODE_LABELS), "Predicates: " + ", ".join(predicates or rules.PREDICATES)])


def extraction_prompt(text: Column, source: Column, most: int = 3000, told: str | None = None) -> Column:
    """Instructions, where the text is from, and its first characters. A null text is empty."""
    return F.concat(F.lit((told or instructions(rules.EXTRACTION_ASK)) + "\n[Source: "), F.coalesce(source, F.lit("")), F.lit("]\n\n"), F.substring(F.coalesce(text, F.lit("")), 1, most))


def replies(chunks: DataFrame, model, most: int = 3000, prompted: bool = False) -> DataFrame:
    """(chunk_id, source, source_page, reply) from model(Column) -> Column on the first characters of each chunk, or on
    extraction_prompt() with them."""
    seen = extraction_prompt(F.col("text"), F.col("source_file"), most) if prompted else F.substring("text", 1, most)
    return chunks.select(F.col("id").alias("chunk_id"), F.col("source_file").alias("source"), "source_page", model(seen).alias("reply"))


def image_replies(images: DataFrame, model, told: str | None = None) -> DataFrame:
    """As replies(), from pictures (path, mime, data): model(instructions, mime, data in base64) -> reply, Columns all. The
    path stands for the chunk, the file's name for the source. Where the model fails (null) nothing is found."""
    asked = F.lit(told or instructions(rules.PICTURE_ASK))
    return images.select(F.col("path").alias("chunk_id"), F.regexp_extract("path", "[^/]*$", 0).alias("source"), F.lit(None).cast("int").alias("source_page"), model(asked, F.col("mime"), F.col("data")).alias("reply"))


def parsed(reply: Column) -> Column:
    """The reply as a struct; null for what is no JSON."""
    return F.from_json(unfence(reply), REPLY)


def reply_entities(rows: DataFrame) -> DataFrame:
    """Entities of replies with defaults: name from the id, domain visa, confidence 0.8. Without an id: dropped;
    so is an entity whose confidence is no number. The type routes to a node label, Entity if it names none."""
    e = rows.select("chunk_id", "source", F.posexplode(F.coalesce(parsed(F.col("reply"))["entities"], F.array().cast(f"array<{ENTITY}>"))).alias("ord", "e")).select("chunk_id", "source", "ord", "e.*")
    score = F.coalesce("confidence", F.lit("0.8")).try_cast("double")
    label = F.when(F.col("type").isin(rules.NODE_LABELS), F.col("type")).otherwise("Entity")
    out = e.where(F.col("id").isNotNull() & score.isNotNull())
    return out.select(
        "chunk_id", "ord", "id", F.coalesce("name", "id").alias("name"), F.coalesce("domain", F.lit("visa")).alias("domain"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("summary", F.lit("")).alias("summary"), label.alias("label"), score.alias("confidence"), "source",
    )


def reply_triples(rows: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Triples of replies whose predicate is allowed; malformed ones are dropped."""
    t = rows.select("chunk_id", "source", "source_page", F.posexplode(F.coalesce(parsed(F.col("reply"))["relations"], F.array().cast(f"array<{RELATION}>"))).alias("ord", "r")).select("chunk_id", "source", "source_page", "ord", "r.*")
    score = F.coalesce("confidence", F.lit("0.8")).try_cast("double")
    good = F.col("predicate").isin(allowed or rules.PREDICATES) & F.col("subject_id").isNotNull() & F.col("object_id").isNotNull() & score.isNotNull()
    return t.where(good).withColumn("confidence", score).withColumn("condition", F.coalesce("condition", F.lit("")))


def normalise_ids(df: DataFrame, columns: list[str], aliases: DataFrame) -> DataFrame:
    """Each column's values replaced by the standard id that the alias table (alias, standard_id) gives."""
    for c in columns:
        names = aliases.select(F.col("alias").alias("_a"), F.col("standard_id").alias("_s"))
        df = df.join(names, F.col(c) == F.col("_a"), "left").withColumn(c, F.coalesce("_s", c)).drop("_a", "_s")
    return df


def normalise_array(names: Column, table: dict[str, str] | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for kv in (table or rules.ALIASES).items() for x in kv])
    return F.transform(names, lambda a: F.coalesce(F.try_element_at(known, a), a))


def alias_table(spark, table: dict[str, str] | None = None) -> DataFrame:
    schema = T.StructType([T.StructField("alias", T.StringType()), T.StructField("standard_id", T.StringType())])
    return spark.createDataFrame(list((table or rules.ALIASES).items()), schema)


def best_entities(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities after alias normalisation, the most confident of each id, the first of equals in order of `ord`."""
    return dedupe_best(normalise_ids(found, ["id"], aliases), "id", "confidence", "ord")


def found_in(entities: DataFrame) -> DataFrame:
    """Links of the entities found in a chunk to it."""
    return entities.select(F.col("id").alias("node_id"), "chunk_id", F.lit("FOUND_IN").alias("link_type"), "confidence", "source").dropDuplicates(["node_id", "chunk_id"])
