"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import rules
from .functions import chunking, text as T
from .functions.embed import encoder
from .operators import extract, graph, link, rank, route, tables, vector
from .plans import ask
from .sources import readers
from .streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rules that fit the synthetic tables.
TYPES = {"comparison": ["edre", "aleau"], "cause": ["ontion", "keit"], "deadline": ["the"], "documents": ["une", "und"]}
INTENTS = {"alpha": ["ontion", "éle"], "beta": ["the ", "der "], "gamma": ["ingth", "und"]}
ANCHORS = {"alpha": ["tion", "an"], "beta": ["in", "an"], "gamma": ["er"]}
HOSTS = ["example.com", "example.org"]
AS_OF = "2024-07-01"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: what users say, qid from conversation and turn."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))


ASKED = "select conv_id * 1000 + turn as qid, text as question from conversations where role = 'user'"
QUOTED = lambda xs: ", ".join("'" + x + "'" for x in xs)


def has_any(low: str, found: list[str]) -> str:
    return "(" + " or ".join(f"contains({low}, '{x}')" for x in found) + ")"


TYPE_SQL = "case " + " ".join(f"when {has_any('lower(question)', v)} then '{k}'" for k, v in TYPES.items()) + " else 'general' end"
INTENT_SQL = "list_filter([" + ", ".join(f"case when {has_any('lower(question)', v)} then '{k}' end" for k, v in INTENTS.items()) + "], lambda x: x is not null)"
TERMS_SQL = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: length(w) > 1))"
RECENCY_SQL = lambda d: f"greatest(0.0::double, 1 - greatest(0.0::double, date_diff('day', {d}, date '{AS_OF}') / 30.0::double) / 24)"

# --- text -------------------------------------------------------------------------------------------------

CLEAN_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({0}, chr(9) || chr(160), '  '), '\r\n?', chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
MESSY = "replace(replace(text, '. ', chr(9) || '.  '), chr(10), chr(13) || chr(10) || chr(10) || chr(10) || chr(10))"


@query(f"select doc_id, {CLEAN_SQL.format(MESSY)} as text from documents")
def clean_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("text", F.replace(F.replace("text", F.lit(". "), F.lit("\t.  ")), F.lit("\n"), F.lit("\r\n\n\n\n")))
    return d.select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query(r"select doc_id, floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.3::double)::int as tokens from documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query(r"""with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n{2,}'), lambda x: trim(x)), lambda x: x <> '') as p from documents)
select doc_id, (i - 1)::int as ord, p[i] as paragraph from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from p)""")
def paragraph_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(chunking.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("ord", "paragraph"))


@query(r"""with d as (select doc_id, 'Part ' || (doc_id % 7) || chr(10) || text as t from documents)
select doc_id, trim(regexp_extract(t, '(?m)^(?:Part\s*\d+)\s*.{0,40}$', 0), chr(10) || ' ') as header from d""")
def header_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Part "), (F.col("doc_id") % 7).cast("string"), F.lit("\n"), "text").alias("t"))
    return d.select("doc_id", T.strip(F.regexp_extract_all("t", F.lit(rules.HEADER), F.lit(0))[0]).alias("header"))


WORDS_SQL = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


@query(f"select doc_id, {WORDS_SQL} as words from documents where {WORDS_SQL} > 0")
def sentence_pack(spark, sf_dir):
    """Sentences packed in chunks of at most 512 tokens; no word is lost."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunking.pack_sentences(F.col("text"))).alias("c"))
    return c.where(F.trim("c") != "").groupBy("doc_id").agg(F.sum(F.size(T.words(F.col("c")))).alias("words"))


def raw_documents(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("_2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit(".pdf"))
    return d.select(name.alias("source_file"), F.col("doc_id").cast("int").alias("source_page"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), F.lit("").alias("section"), F.col("lang").alias("language"), T.doc_version(name).alias("doc_version"))


@query()
def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(raw_documents(spark, sf_dir)).select("source_page", "ord", "id", "section", "text")


@query(f"select doc_id::int as source_page, {WORDS_SQL} as words from documents where {WORDS_SQL} > 0")
def chunk_words(spark, sf_dir):
    """Words of the chunks of every page: as many as in the page, which has no header line."""
    c = chunking.chunk_documents(raw_documents(spark, sf_dir), header="(?m)^\x02$")
    return c.groupBy("source_page").agg(F.sum(F.size(T.words(F.col("text")))).alias("words"))


@query("""select conv_id, turn, coalesce(last_value(case when role = 'system' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row), '') as section from conversations""")
def section_carry_forward(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("section", F.when(F.col("role") == "system", F.col("text")).otherwise(""))
    return readers.carry_sections(c, "conv_id", "turn").select("conv_id", "turn", "section")


@query("select doc_id, n_chars from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def blank_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.strip(F.col("text")) != "").select("doc_id", "n_chars")


@query("select o_orderkey, strftime(o_orderdate, '%Y.%m') as version from orders")
def doc_version_extract(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("f", F.concat(F.lit("guide_"), F.date_format("o_orderdate", "yyyy-MM"), F.lit("_v2.pdf")))
    return o.select("o_orderkey", T.doc_version(F.col("f")).alias("version"))


LANG_CASES = ["한글", "漢字", "한글 漢字", "かな", ""]


@query(
    "with d as (select doc_id, case doc_id % 6 "
    + " ".join(f"when {i} then '{x}'" for i, x in enumerate(LANG_CASES))
    + " else '' end || text as t from documents) select doc_id, case when regexp_matches(t, '[가-힣]') then 'ko' when regexp_matches(t, '[一-鿿]') then 'zh' else 'en' end as language from d"
)
def detect_language(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    added = F.coalesce(F.get(F.array(*[F.lit(x) for x in LANG_CASES]), (F.col("doc_id") % 6).cast("int")), F.lit(""))
    return d.select("doc_id", T.detect_language(F.concat(added, "text")).alias("language"))


@query(f"select qid, {TYPE_SQL} as question_type from ({ASKED})")
def question_type(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", T.question_type(F.col("question"), TYPES).alias("question_type"))


SQUEEZE_SQL = r"trim(regexp_replace(question, '\s+', ' ', 'g'))"


@query(f"""with q as (select qid, {SQUEEZE_SQL} as b from ({ASKED})), v as (select qid, [b, b || ' comparison difference', b || ' cause reason', b || ' exception unless'] as v from q)
select qid, (i - 1)::int as variant, v[i] as phrase from (select qid, v, unnest(range(1, 5)) as i from v)""")
def expand_query(spark, sf_dir):
    return route.with_variants(asked(spark, sf_dir)).select("qid", "variant", "phrase")


# --- extraction -------------------------------------------------------------------------------------------

CODE, TRIGGER, NAMES = r"([A-Z][a-z]nd)", "the the", ["Elle", "Der ", "The "]


def doc_chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("source_file"), F.lit(1).alias("source_page"))


@query(f"""with c as (select doc_id, regexp_extract_all(text, '{CODE}', 1) || list_filter([{QUOTED(NAMES)}], lambda n: contains(text, n)) as e from documents)
select doc_id as chunk_id, (i - 1)::int as ord, replace(e[i], ' ', '_') as id, e[i] as name from (select doc_id, e, unnest(range(1, len(e) + 1)) as i from c)""")
def rule_entities(spark, sf_dir):
    return extract.rule_entities(doc_chunks(spark, sf_dir), CODE, NAMES).select("chunk_id", "ord", "id", "name")


@query(f"select doc_id as chunk_id, unnest(regexp_extract_all(text, '{CODE}', 1)) || '_x' as object_id from documents where contains(text, '{TRIGGER}')")
def rule_triples(spark, sf_dir):
    return extract.rule_triples(doc_chunks(spark, sf_dir), TRIGGER, CODE, "s", "_x", "r").select("chunk_id", "object_id")


@query(f"select doc_id as id from documents where not regexp_matches(text, '{CODE}') and not ({has_any('text', NAMES)})")
def llm_candidates(spark, sf_dir):
    c = doc_chunks(spark, sf_dir)
    return extract.without_rules(c, extract.rule_entities(c, CODE, NAMES), extract.rule_triples(c, TRIGGER, CODE)).select("id")


REPLY = """concat('```json', chr(10), '{"entities":[{"id":"', event_type, '","confidence":', value, '},{"name":"no id"}],"relations":[{"subject_id":"u', user_id, '","predicate":"', case event_type when 'error' then 'ODD' when 'view' then 'BLOCKS' else 'REQUIRES' end, '","object_id":"', event_type, '","confidence":"', case event_type when 'click' then 'high' else '0.9' end, '"}]}', chr(10), '```')"""


def reply_rows(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("chunk_id"), F.lit("s").alias("source"), F.lit(1).alias("source_page"), F.expr(REPLY.replace("chr(10)", "'\\n'")).alias("reply"))


@query("select event_id as chunk_id, event_type as id, event_type as name, 'visa' as domain, value as confidence from events")
def json_extract_rows(spark, sf_dir):
    return extract.reply_entities(reply_rows(spark, sf_dir)).select("chunk_id", "id", "name", "domain", "confidence")


@query("select event_id as chunk_id, 'u' || user_id as subject_id, case event_type when 'view' then 'BLOCKS' else 'REQUIRES' end as predicate, event_type as object_id from events where event_type not in ('error', 'click')")
def json_extract_triples(spark, sf_dir):
    return extract.reply_triples(reply_rows(spark, sf_dir)).select("chunk_id", "subject_id", "predicate", "object_id")


ALIAS = {"NATION_1": "N-1", "NATION_2": "N-2", "FRANCE": "FR", "GERMANY": "DE"}


@query("select n_nationkey, coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in ALIAS.items()) + "}[n_name], n_name) as id from nation")
def alias_normalize(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("id"))
    return extract.normalise_ids(n, ["id"], extract.alias_table(spark, ALIAS)).select("n_nationkey", "id")


@query("select user_id as id, event_id, value as confidence from (select *, row_number() over (partition by user_id order by value desc, event_id) as i from events) where i = 1")
def entity_dedupe_max_conf(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", F.col("value").alias("confidence"))
    return tables.dedupe_best(e, "id", "confidence", "event_id")


# --- store ------------------------------------------------------------------------------------------------

OLD_NEW = """o as (select c_custkey // 2 as id, c_custkey as k, c_acctbal as confidence from customer where c_custkey % 2 = 0),
n as (select c_custkey // 2 as id, c_custkey as k, c_acctbal as confidence from customer where c_custkey % 2 = 1)"""


@query(f"with {OLD_NEW} select coalesce(o.id, n.id) as id, case when o.id is null or n.confidence >= o.confidence then n.k else o.k end as k, case when o.id is null or n.confidence >= o.confidence then n.confidence else o.confidence end as confidence from o full join n on o.id = n.id")
def entity_upsert_gate(spark, sf_dir):
    """Customers of even number are stored, those of odd number come in; two neighbours share an id."""
    c = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 2").alias("id"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("confidence"))
    old, new = (c.where(F.col("k") % 2 == i) for i in (0, 1))
    return tables.upsert_gated(old, new, ["id"])


@query("""select doc_id as id, case when doc_id % 3 <> 0 then 'new' else 'old' end as version, case when doc_id % 2 = 0 then 'first' when doc_id % 3 <> 0 then 'second' end as created_at from documents where doc_id % 2 = 0 or doc_id % 3 <> 0""")
def chunk_upsert_created_at(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    old = d.where("id % 2 = 0").select("id", F.lit("old").alias("version"), F.lit("first").alias("created_at"))
    new = d.where("id % 3 <> 0").select("id", F.lit("new").alias("version"), F.lit("second").alias("created_at"))
    return tables.upsert_keeping(old, new, ["id"])


def order_triples(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("o"), "l_orderkey").alias("subject_id"), F.lit("REQUIRES").alias("predicate"), F.concat(F.lit("p"), "l_partkey").alias("object_id"), (F.col("l_discount") * 10).alias("confidence"))


@query("select case when l_discount * 10 >= 0.7 then 'edge' else 'queue' end as state, count(*) as n from lineitem group by 1")
def triple_review_split(spark, sf_dir):
    good, queued = tables.split_review(order_triples(spark, sf_dir))
    return good.select(F.lit("edge").alias("state")).unionAll(queued.select(F.lit("queue").alias("state"))).groupBy("state").agg(F.count("*").alias("n"))


@query("""with n as (select 'o' || l_orderkey as src_id, 'p' || l_partkey as dst_id, max(l_discount * 10) as confidence from lineitem
where l_discount * 10 >= 0.7 and l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'F') and l_partkey in (select p_partkey from part where p_size > 10) group by all),
o as (select 'o' || l_orderkey as src_id, 'p' || l_partkey as dst_id, min(l_tax) as confidence, max(l_shipdate::date::varchar) as note from lineitem where l_linenumber = 1 group by all)
select coalesce(n.src_id, o.src_id) as src_id, 'REQUIRES' as rel_type, coalesce(n.dst_id, o.dst_id) as dst_id, coalesce(n.confidence, o.confidence) as confidence, o.note from n full join o on n.src_id = o.src_id and n.dst_id = o.dst_id""")
def edge_endpoint_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    parts = table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    li = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    old = li.groupBy(F.concat(F.lit("o"), "l_orderkey").alias("src_id"), F.lit("REQUIRES").alias("rel_type"), F.concat(F.lit("p"), "l_partkey").alias("dst_id")).agg(F.min("l_tax").alias("confidence"), F.max(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("note"))
    return tables.upsert_edges(old, order_triples(spark, sf_dir), orders.union(parts))[0]


@query("""with n as (select quality as node_id, doc_id as chunk_id, max(toxic::double) as confidence from labels where doc_id in (select doc_id from documents where lang is not null) and quality in (0, 1) group by all),
o as (select 1 as node_id, doc_id as chunk_id, 0.5::double as confidence from documents where doc_id % 3 = 0)
select coalesce(n.node_id, o.node_id)::int as node_id, coalesce(n.chunk_id, o.chunk_id) as chunk_id, 'FOUND_IN' as link_type, coalesce(n.confidence, o.confidence) as confidence from n full join o on n.node_id = o.node_id and n.chunk_id = o.chunk_id""")
def chunk_link_upsert(spark, sf_dir):
    links = table(spark, sf_dir, "labels").select(F.col("quality").alias("node_id"), F.col("doc_id").alias("chunk_id"), F.lit("FOUND_IN").alias("link_type"), F.col("toxic").cast("double").alias("confidence"))
    chunks = table(spark, sf_dir, "documents").where("lang is not null").select(F.col("doc_id").alias("id"))
    old = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.lit(1).alias("node_id"), F.col("doc_id").alias("chunk_id"), F.lit("FOUND_IN").alias("link_type"), F.lit(0.5).alias("confidence"))
    return tables.upsert_links(old, links, spark.range(2), chunks)


@query("select doc_id, source = 'src1' as needs_review from documents")
def flag_needs_review(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(False).alias("needs_review"))
    return tables.flag_review(d, "source", "src1")[0].select("doc_id", "needs_review")


@query("select doc_id, doc_id in (select vec_id from embeddings) as had from documents")
def missing_embedding_fill(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    filled = tables.fill_embeddings(d.withColumn("had", F.col("embedding").isNotNull()), encoder())
    return filled.where(~tables.missing(filled)).select("doc_id", "had")


# --- graph ------------------------------------------------------------------------------------------------


def places(spark, sf_dir) -> DataFrame:
    """Edges supplier - nation - region."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src_id"), F.lit("HANDLES").alias("rel_type"), F.concat(F.lit("n"), "s_nationkey").alias("dst_id"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src_id"), F.when(F.col("n_nationkey") % 5 == 0, "BLOCKS").otherwise("BELONGS_TO").alias("rel_type"), F.concat(F.lit("r"), "n_regionkey").alias("dst_id"))
    return s.unionByName(n)


EDGES_SQL = """e as (select 's' || s_suppkey as src_id, 'HANDLES' as rel_type, 'n' || s_nationkey as dst_id from supplier
  union all select 'n' || n_nationkey, case when n_nationkey % 5 = 0 then 'BLOCKS' else 'BELONGS_TO' end, 'r' || n_regionkey from nation),
w as (select src_id as a, rel_type, dst_id as b from e union all select dst_id, rel_type, src_id from e)"""
WALK_SQL = f"""with recursive {EDGES_SQL},
d as (select s_suppkey as qid, 's' || s_suppkey as node, 0 as hop from supplier
  union all select d.qid, w.b, d.hop + 1 from d join w on d.node = w.a where d.hop < 2),
m as (select qid, node, min(hop) as hop from d group by qid, node),
t as (select qid, a as src_id, rel_type, b as dst_id, case hop when 0 then 0.75::double else 0.375::double end as score, hop + 1 as hop from m join w on node = a where hop < 2)"""


def walked(spark, sf_dir, k: int | None = None) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return graph.traverse(places(spark, sf_dir), s.select(F.col("s_suppkey").alias("qid"), F.concat(F.lit("s"), "s_suppkey").alias("node")), cap=None, k=k)[0]


@query(f"with {EDGES_SQL} select 'n' || n_nationkey as start, rel_type, b as end, 1 as hop from nation join w on a = 'n' || n_nationkey")
def graph_neighbors(spark, sf_dir):
    starts = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("start"))
    return graph.neighbours(places(spark, sf_dir), starts, 1, 1_000_000)


@query(WALK_SQL + " select * from t")
def graph_dde_traversal(spark, sf_dir):
    return walked(spark, sf_dir)


@query(WALK_SQL + """, r as (select *, rel_type = 'BLOCKS' as forced, row_number() over (partition by qid, rel_type = 'BLOCKS' order by score desc, hop, src_id, rel_type, dst_id) as i from t)
select qid, src_id, rel_type, dst_id, forced, row_number() over (partition by qid order by forced desc, i)::int as rank from r where forced or i <= 8""")
def graph_forced_edges(spark, sf_dir):
    return graph.ranked_edges(walked(spark, sf_dir, rules.RANKING.edges)).select("qid", "src_id", "rel_type", "dst_id", "forced", "rank")


@query("select distinct quality as qid, doc_id as id, source from labels join documents using (doc_id)")
def graph_chunks_for_nodes(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    links = labels.select(F.concat(F.lit("q"), "quality").alias("node_id"), F.col("doc_id").alias("chunk_id")).unionAll(labels.select(F.concat(F.lit("q"), "quality"), "doc_id"))
    visited = labels.select(F.col("quality").alias("qid"), F.concat(F.lit("q"), "quality").alias("node")).distinct()
    return graph.chunks_of_nodes(visited, links, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")).select("qid", "id", "source")


# --- vectors, linking, ranking ----------------------------------------------------------------------------

COS_SQL = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"
NEAR_SQL = f"""n as (select a.vec_id as qid, b.vec_id as id, {COS_SQL} as c, row_number() over (partition by a.vec_id order by {COS_SQL} desc, b.vec_id) as i
  from embeddings a, embeddings b where a.vec_id % 20 = 0)"""


def vector_questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@query(f"with {NEAR_SQL} select qid, id, round(c, 6) as cosine, i::int as rank from n where i <= 30")
def vector_topk(spark, sf_dir):
    near = vector.nearest(vector_questions(spark, sf_dir), table(spark, sf_dir, "embeddings"), 30, "vec_id")
    return near.select("qid", "id", F.round("cosine", 6).alias("cosine"), "rank")


def vector_chunks(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("source_file"), F.concat(F.lit("2024."), F.lpad((F.col("doc_id") % 6 + 1).cast("string"), 2, "0")).alias("doc_version"))
    return e.join(d, "id")


def overlap_sql(question: str, text: str, anchors: str) -> str:
    return f"""(0.6::double * least(len(list_filter({anchors}, lambda x: contains(lower({text}), x))) / len({anchors})::double, 1.0::double)
  + 0.4::double * len(list_intersect({TERMS_SQL(question)}, {TERMS_SQL(text)})) / greatest(len({TERMS_SQL(question)}), 1)::double)"""


VERSION_SQL = "make_date(2024, (d.doc_id % 6 + 1)::int, 1)"
HYBRID_SQL = f"""{NEAR_SQL[:-1]} and b.vec_id in (select doc_id from documents)), h as (select n.qid, n.id, 0.65::double * c + 0.25::double * {overlap_sql('q.text', 'd.text', "['tion', 'an']")} + 0.1::double * {RECENCY_SQL(VERSION_SQL)} as s
  from n join documents d on d.doc_id = n.id join documents q on q.doc_id = n.qid where i <= 30),
r as (select *, row_number() over (partition by qid order by s desc, id) as i from h)"""


def hybrid(spark, sf_dir) -> DataFrame:
    q = vector_questions(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("question")), "qid")
    return vector.hybrid_search(q.withColumn("anchors", F.array(F.lit("tion"), F.lit("an"))), vector_chunks(spark, sf_dir), F.lit(AS_OF).cast("date"))


@query(f"with {HYBRID_SQL} select qid, id, round(s, 6) as score, i::int as rank from r where i <= 10")
def vector_hybrid_topk(spark, sf_dir):
    return hybrid(spark, sf_dir).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"with {NEAR_SQL} select qid, id, round(c, 6) as cosine from n where i <= 3 and c >= 0.72")
def entity_link_embedding(spark, sf_dir):
    found = vector.linked_entities(vector_questions(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    return found.select("qid", "id", F.round("cosine", 6).alias("cosine"))


PHRASES = """p as (select qid, lower(w) as p from (select conv_id * 1000 + turn as qid, unnest(regexp_split_to_array(text, '[^\\p{L}]+')) as w from conversations where role = 'user') where length(w) > 1),
t as (select distinct item_id as id, lower(m) as m from (select item_id, unnest(regexp_split_to_array(text, '[^\\p{L}]+')) as m from benchmark) where m <> '')"""


@query(f"with {PHRASES} select distinct qid, id from (select distinct qid, p from p) p join t on contains(p, m) or contains(m, p)")
def entity_link_alias_substring(spark, sf_dir):
    cut = lambda c: F.explode(F.split(c, r"[^\p{L}]+"))
    q = asked(spark, sf_dir).select("qid", cut("question").alias("phrase")).where("length(phrase) > 1")
    t = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), cut("text").alias("term"))
    return link.match_terms(q, t)


@query(f"select qid, array_to_string({INTENT_SQL}, ',') as intents from ({ASKED})")
def intent_classify(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", F.array_join(link.intents(F.col("question"), INTENTS), ",").alias("intents"))


ANCHOR_SQL = "flatten(list_transform(i, lambda x: map {" + ", ".join(f"'{k}': [{QUOTED(v)}]" for k, v in ANCHORS.items()) + "}[x]))"


@query(f"""with q as (select qid, {INTENT_SQL} as i from ({ASKED})), f as (select qid, {ANCHOR_SQL} as a from q),
u as (select qid, a[k] as x, k from (select qid, a, unnest(range(1, len(a) + 1)) as k from f)), g as (select qid, x, min(k) as k from u group by qid, x)
select q.qid, coalesce(string_agg(x, ',' order by k), '') as anchors from q left join g on q.qid = g.qid group by q.qid""")
def anchor_union(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", F.array_join(link.anchors(link.intents(F.col("question"), INTENTS), ANCHORS), ",").alias("anchors"))


@query(f"select d.doc_id, b.item_id, round({overlap_sql('b.text', 'd.text', chr(91) + QUOTED(['tion', 'the']) + chr(93))}, 6) as overlap from documents d join benchmark b on b.item_id = d.doc_id % 40")
def keyword_overlap(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))
    both = table(spark, sf_dir, "documents").join(b, F.col("item_id") == F.col("doc_id") % 40)
    return both.select("doc_id", "item_id", F.round(T.keyword_overlap(F.col("text"), F.col("q"), F.array(F.lit("tion"), F.lit("the"))), 6).alias("overlap"))


@query(f"select o_orderkey, round({RECENCY_SQL('date_trunc(chr(109) || chr(111) || chr(110) || chr(116) || chr(104), o_orderdate)::date')}, 6) as recency, date_diff('day', date_trunc('month', o_orderdate)::date, date '{AS_OF}') >= 180 as stale from orders")
def recency_score(spark, sf_dir):
    version, now = F.date_format("o_orderdate", "yyyy.MM"), F.lit(AS_OF).cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(T.recency(version, now), 6).alias("recency"), T.is_stale(version, now).alias("stale"))


def candidates(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, graph chunks (same label) and vector chunks of some vectors."""
    q = vector_questions(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("question")), "qid").withColumn("anchors", F.array(F.lit("tion"), F.lit("an")))
    found = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.expr("doc_id div 20 * 20").alias("qid"))
    chunks = vector_chunks(spark, sf_dir).drop("embedding")
    near = vector.nearest(vector_questions(spark, sf_dir), table(spark, sf_dir, "embeddings"), 10, "vec_id").select("qid", "id", F.col("cosine").alias("score"))
    return q, found.join(chunks, "id"), near.join(chunks, "id")


MERGE_SQL = f"""{NEAR_SQL}, f as (select doc_id // 20 * 20 as qid, doc_id as id, 0.75::double as base, 'graph' as origin from labels where toxic = 1 and doc_id in (select vec_id from embeddings)
  union all select qid, id, c, 'vector' from n where i <= 10 and id in (select doc_id from documents)),
s as (select f.qid, f.id, origin, q.text as question, d.text as text, 0.6::double * base + 0.3::double * {overlap_sql('q.text', 'd.text', "['tion', 'an']")} + 0.1::double * {RECENCY_SQL(VERSION_SQL)} as s
  from f join documents d on d.doc_id = f.id join documents q on q.doc_id = f.qid where f.qid in (select vec_id from embeddings)),
m as (select qid, id, max(s) as s, min(origin) as origin, any_value(question) as question, any_value(text) as text from s group by qid, id),
r as (select *, row_number() over (partition by qid order by s desc, id) as i from m where s >= 0.3)"""


def merged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    q, g, v = candidates(spark, sf_dir)
    return q, rank.top_candidates(rank.merge_candidates(g, v, q, F.lit(AS_OF).cast("date")))


@query(f"with {MERGE_SQL} select qid, id, origin, round(s, 6) as score, i::int as rank from r where i <= 4")
def merge_rerank(spark, sf_dir):
    return merged(spark, sf_dir)[1].select("qid", "id", "origin", F.round("score", 6).alias("score"), "rank")


@query(f"""with {MERGE_SQL}, k as (select qid, max({overlap_sql('question', 'text', "['tion', 'an']")}) as fit from r where i <= 4 group by qid)
select vec_id as qid, round(coalesce(fit, 0), 6) as fit, coalesce(fit, 0) < 0.06 as no_answer from embeddings join documents on doc_id = vec_id left join k on qid = vec_id where vec_id % 20 = 0""")
def fit_gate(spark, sf_dir):
    q, top = merged(spark, sf_dir)
    return rank.fit(top, q).select("qid", F.round("fit", 6).alias("fit"), (F.col("fit") < rules.RANKING.least_fit).alias("no_answer"))


@query(f"""with {MERGE_SQL}, k as (select qid, max(s) as b, count(*) as n from r where i <= 4 group by qid),
a as (select vec_id as qid, coalesce(b, 0.0::double) as b, coalesce(n, 0) as n, text as question from embeddings join documents on doc_id = vec_id left join k on qid = vec_id where vec_id % 20 = 0)
select qid, n as evidence, array_to_string(list_filter([case when b < 0.25 then 'low_top_score' end, case when n < 2 then 'insufficient_evidence' end, case when {TYPE_SQL} in ('comparison', 'cause') then 'complex_question' end], lambda x: x is not null), ',') as reasons from a""")
def deep_gate(spark, sf_dir):
    q, top = merged(spark, sf_dir)
    facts = rank.best_scores(top, q).join(q.select("qid", "question"), "qid")
    return facts.select("qid", F.col("evidence_count").alias("evidence"), F.array_join(rank.deep_reasons(F.col("question"), F.col("best_score"), F.col("evidence_count"), TYPES), ",").alias("reasons"))


@query(f"""with {MERGE_SQL}, k as (select qid, count(*) filter (origin = 'graph') as g, count(*) filter (origin = 'vector') as v from f where qid in (select vec_id from embeddings) and id in (select doc_id from documents) group by qid)
select qid, case when g > 0 and v > 0 then 'hybrid' when v > 0 then 'vector' else 'graph' end as method from k""")
def retrieval_method(spark, sf_dir):
    _, g, v = candidates(spark, sf_dir)
    both = g.select("qid", F.lit(1).alias("g"), F.lit(0).alias("v")).unionAll(v.select("qid", F.lit(0), F.lit(1))).groupBy("qid").agg(F.sum("g").alias("g"), F.sum("v").alias("v"))
    return both.select("qid", rank.method(F.col("g"), F.col("v")).alias("method")).join(vector_questions(spark, sf_dir).select("qid"), "qid", "left_semi")


@query("""with v as (select user_id as qid, event_id % 50 as id, value as score, (event_id % 4)::int as variant from events),
b as (select *, row_number() over (partition by qid, id order by score desc, variant) as i from v)
select qid, id::varchar as id, score, variant, rank::int as rank from (select *, row_number() over (partition by qid order by score desc, id::varchar) as rank from b where i = 1) where rank <= 4""")
def variant_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = e.select(F.col("user_id").alias("qid"), (F.col("event_id") % 50).cast("string").alias("id"), F.lit("").alias("text"), F.col("value").alias("score"), (F.col("event_id") % 4).cast("int").alias("variant"))
    return rank.merge_variants(v).select("qid", "id", "score", "variant", "rank")


FAQ = [(["ontion", "the the"], "first"), (["der ", "und "], "second"), (["elle", "é"], "third"), (["the ", "in "], "fourth")]


@query(f"""with f as (select * from (values {", ".join(f"({i}, [{QUOTED(k)}], '{a}')" for i, (k, a) in enumerate(FAQ))}) t(ord, k, answer)),
h as (select qid, ord, answer, len(list_filter(k, lambda x: contains(lower(question), x))) as n from ({ASKED}) q, f where not {has_any('lower(question)', ['keit', 'edre'])}),
r as (select *, row_number() over (partition by qid order by n desc, ord) as i from h where n > 0) select qid, answer, n as matched from r where i = 1""")
def faq_match(spark, sf_dir):
    faq = spark.createDataFrame([(i, k, a) for i, (k, a) in enumerate(FAQ)], "ord int, keywords array<string>, answer string")
    return route.stock_answers(asked(spark, sf_dir), faq, ["keit", "edre"]).select("qid", "answer", "matched")


# --- context, web, measurements ---------------------------------------------------------------------------


@query("""with d as (select *, (doc_id // 4) as qid, doc_id % 4 + 1 as rank, '2024.' || lpad((doc_id % 12 + 1)::varchar, 2, '0') as v from documents),
b as (select qid, string_agg('[' || source || ' | ' || v || ' | p.' || (doc_id + 1) || ']' || chr(10) || substring(text, 1, 700) || chr(10)
  || case when date_diff('day', make_date(2024, (doc_id % 12 + 1)::int, 1), date '2024-07-01') >= 180 then printf('%s', replace(replace('DISCLAIMER', '{f}', source), '{v}', v)) || chr(10) else '' end, chr(10) order by rank) as c,
  array_to_string(list_sort(list_distinct(list(source || ' (' || v || ')'))), ', ') as s from d group by qid)
select qid, case when qid % 5 = 0 then '' else 'TEXTS' || chr(10) || c || chr(10) || 'SOURCES' || s end as context from b""".replace("DISCLAIMER", rules.DISCLAIMER.replace("%s", "{f}", 1).replace("%s", "{v}", 1)).replace("TEXTS", rules.TEXTS_TITLE).replace("SOURCES", rules.SOURCES_TITLE))
def prompt_context(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.floor(F.col("doc_id") / 4)).alias("qid"), (F.col("doc_id") % 4 + 1).cast("int").alias("rank"), "text", F.col("source").alias("source_file"), F.concat(F.lit("2024."), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0")).alias("doc_version"), F.lit("").alias("section"), (F.col("doc_id") + 1).alias("source_page"))
    edges = d.select("qid", "rank", F.lit("").alias("src_id"), F.lit("").alias("rel_type"), F.lit("").alias("dst_id")).where("false")
    q = d.select("qid").distinct().withColumn("method", F.when(F.col("qid") % 5 == 0, "no_answer").otherwise("graph"))
    return route.context(d, edges, q, F.lit(AS_OF).cast("date"))


WEB_SQL = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')
HOST_SQL = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
ALLOWED_SQL = "(" + " or ".join(f"{HOST_SQL} = '{h}' or ends_with({HOST_SQL}, '.{h}')" for h in HOSTS) + ")"


@query(f"select page_id, {WEB_SQL} as text from pages")
def web_text_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query(f"select page_id, {HOST_SQL} as title, {ALLOWED_SQL} as allowed from pages")
def web_allowed_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.title_from_url(F.col("url")).alias("title"), T.allowed_host(F.col("url"), ",".join(HOSTS)).alias("allowed"))


@query(f"""with f as (select *, row_number() over (partition by page_id % 10 order by page_id) as i from pages where starts_with(url, 'http')),
g as (select page_id % 10 as qid, i, url, {HOST_SQL} as title, substring({WEB_SQL}, 1, 1200) as snippet from f where i <= 9 and {ALLOWED_SQL}),
r as (select *, row_number() over (partition by qid order by i) as rank from g where snippet <> '') select qid, rank::int as rank, url, title, snippet from r where rank <= 3""")
def web_snippets(spark, sf_dir):
    hits = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("qid"), F.col("page_id").alias("ord"), "url", "html")
    return route.snippets(hits, ",".join(HOSTS))


def events_log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("path"), F.col("value").alias("elapsed_sec"))


@query("select event_type as path, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, min(value) as low, max(value) as high from events group by 1")
def latency_by_path(spark, sf_dir):
    return route.latency_by_path(events_log(spark, sf_dir)).withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


@query("select event_type as path, t as target, round(avg(value), 6) as mean, count(*) filter (value > t) as over, avg(value) <= t as met from events join (values ('click', 5.0::double), ('view', 60.0::double)) x(p, t) on p = event_type group by 1, 2")
def latency_sla(spark, sf_dir):
    return route.latency_sla(events_log(spark, sf_dir), {"click": 5.0, "view": 60.0}).withColumn("mean", F.round("mean", 6))


@query("select time_bucket(interval '1 hour', ts)::timestamp as start, event_type as path, count(*) as n, round(sum(value), 4) as total, max(value) as high from events group by 1, 2")
def latency_windows(spark, sf_dir):
    out = live.latency_windows(events_log(spark, sf_dir)).withColumn("total", F.round("total", 4))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select event_id % 3 = 0 as corrupt, count(*) as n from events group by 1")
def corrupt_log_quarantine(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lines = e.select(F.when(F.col("event_id") % 3 == 0, "<<<<<<< HEAD").otherwise(F.concat(F.lit('{"path":"fast","elapsed_sec":'), F.col("value").cast("string"), F.lit("}"))).alias("value"))
    return readers.parse_log(lines).groupBy(F.col("corrupt").isNotNull().alias("corrupt")).agg(F.count("*").alias("n"))


def knowledge(spark, sf_dir) -> ask.Store:
    """Chunks of documents, every one linked to its language; languages are linked to sources."""
    chunks = tables.materialise(chunking.chunk_documents(raw_documents(spark, sf_dir)).withColumn("embedding", encoder()(F.col("text"))))
    # what both passes read several times is made once
    entities = tables.materialise(chunks.select(F.col("language").alias("id")).distinct().withColumn("name", F.col("id")).withColumn("embedding", encoder()(F.col("name"))))
    links = chunks.select(F.col("language").alias("node_id"), F.col("id").alias("chunk_id"))
    edges = tables.materialise(chunks.select(F.col("language").alias("src_id"), F.lit("RELATED_TO").alias("rel_type"), F.split_part("source_file", F.lit("_"), F.lit(1)).alias("dst_id")).distinct())
    terms = entities.select("id", F.concat(F.lit(" "), F.element_at(F.create_map(*[F.lit(x) for kv in {"en": "the", "fr": "elle", "de": "und", "es": "los"}.items() for x in kv]), F.col("id")), F.lit(" ")).alias("term")).where("term is not null")
    return ask.Store(entities, edges, links, chunks, terms)


@query()
def hybrid_retrieval(spark, sf_dir):
    """The whole path: chunks of documents, entities by language and source, all questions answered with context."""
    return ask.answer(asked(spark, sf_dir), knowledge(spark, sf_dir), F.lit(AS_OF).cast("date"), keywords=INTENTS, anchors=ANCHORS, types=TYPES)
