"""Rules on hand-made cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom import rules
from sparkloom.functions import chunking, text as T
from sparkloom.operators import extract, graph, link, rank, route, tables
from sparkloom.plans import ingest
from sparkloom.sources import readers
from sparkloom.streaming import live


def value(spark, column, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return row.select(column).first()[0]


def test_clean_text(spark):
    assert value(spark, T.clean_text(F.col("t")), t="a\t\tb c\r\nd\n\n\n\ne ") == "a b c\nd\n\ne"


@pytest.mark.parametrize("n, tokens", [(0, 0), (38, 49), (39, 50), (394, 512), (395, 513)])
def test_token_bounds(spark, n, tokens):
    assert value(spark, T.token_count(F.col("t")), t=" ".join(["w"] * n)) == tokens


@pytest.mark.parametrize("text, language", [("漢字", "zh"), ("한글 漢字", "ko"), ("한글", "ko"), ("abc", "en"), ("かな", "en")])
def test_language(spark, text, language):
    assert value(spark, T.detect_language(F.col("t")), t=text) == language


def test_header_may_take_the_next_line(spark):
    parts = value(spark, chunking.header_parts(F.col("t")), t="intro\nPart 1\nshort next\nbody")
    assert [tuple(p) for p in parts] == [("intro", ""), ("body", "Part 1\nshort next")]


def test_small_segments_join_before_the_next_large_one(spark):
    big = " ".join(["w"] * 60)
    got = value(spark, chunking.chunks(F.col("t"), F.lit("s")), t=f"a b\n\nc d\n\n{big}\n\ne f")
    assert [p["text"] for p in got] == ["a b\nc d", big, "e f"]


def plain_pack(text, most=512):
    import re

    out, now, n = [], [], 0
    for s in re.split(rules.SENTENCE_END, text):
        k = int(len(s.split()) * 1.3)
        if n + k > most and now:
            out.append(" ".join(now))
            now, n = [s], k
        else:
            now.append(s)
            n += k
    return out + [" ".join(now)]


def test_sentence_packing_equals_a_plain_loop(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb.", "ccc", "d!"]) for _ in range(rng.randrange(1, 900))) for _ in range(20)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.pack_sentences(F.col("t")).alias("p")).collect()
    assert all(r["p"] == plain_pack(r["t"]) for r in rows)


def test_code_needs_a_boundary(spark):
    assert value(spark, extract.codes(F.col("t")), t="D-2비자 및 D-4 비자") == ["D-4"]


@pytest.mark.parametrize("version, score", [("", 0.5), ("2024.13", 0.5), (None, 0.5), ("2030.01", 1.0), ("2024.01", 1 - 152 / 30 / 24)])
def test_recency(spark, version, score):
    df = spark.createDataFrame([(version,)], "v string")
    assert df.select(T.recency(F.col("v"), F.lit("2024-06-01").cast("date"))).first()[0] == pytest.approx(score)


@pytest.mark.parametrize("url, ok", [("http://x.ac.kr/a", True), ("http://bac.kr", False), ("http://ac.kr", True), ("no url", False), (None, False)])
def test_hosts(spark, url, ok):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(T.allowed_host(F.col("u"))).first()[0] is ok


def test_ties_within_and_across_batches(spark):
    cols = "id string, confidence double, ord int"
    batch = spark.createDataFrame([("e", 0.8, 1), ("e", 0.8, 2), ("f", None, 3)], cols)
    best = tables.dedupe_best(batch)
    assert {(r.id, r.ord) for r in best.collect()} == {("e", 1), ("f", 3)}
    old = spark.createDataFrame([("e", 0.8, 0), ("f", 0.1, 0), ("g", None, 0)], cols)
    new = spark.createDataFrame([("e", 0.8, 9), ("f", 0.05, 9), ("g", 0.0, 9)], cols)
    after = {r.id: r.ord for r in tables.upsert_gated(old, new, ["id"]).collect()}
    assert after == {"e": 9, "f": 0, "g": 9}
    again = tables.upsert_gated(tables.upsert_gated(old, new, ["id"]), new, ["id"])
    assert {r.id: r.ord for r in again.collect()} == after


def test_edges_need_both_ends_and_confidence(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    triples = spark.createDataFrame([("a", "REQUIRES", "b", 0.7, True, "x"), ("a", "BLOCKS", "b", 0.69, None, "x"), ("a", "REQUIRES", "z", 0.9, True, "x")], "subject_id string, predicate string, object_id string, confidence double, mandatory boolean, block_reason string")
    old = spark.createDataFrame([("a", "REQUIRES", "b", 0.1, None, "kept")], "src_id string, rel_type string, dst_id string, confidence double, mandatory boolean, condition string")
    edges, queue = tables.upsert_edges(old, triples, nodes)
    row = edges.collect()
    assert len(row) == 1 and row[0].confidence == 0.7 and row[0].mandatory and row[0].condition == "kept" and row[0].block_reason is None
    assert queue.count() == 1
    assert tables.by_endpoint_count(triples, nodes).first() == (3, 1, 1)


def test_walk_scores(spark):
    edges = spark.createDataFrame([("A", "X", "B"), ("B", "X", "C")], "src_id string, rel_type string, dst_id string")
    seeds = spark.createDataFrame([(1, "A")], "qid int, node string")
    got = {(r.src_id, r.dst_id): r.score for r in graph.traverse(edges, seeds)[0].collect()}
    assert got == {("A", "B"): 0.75, ("B", "A"): 0.375, ("B", "C"): 0.375}


def test_walks_take_all_edges_of_a_hub(spark):
    """What lies beyond the first 300 edges of a node is reached too, and its chunks count."""
    from sparkloom.plans import ask

    edges = spark.createDataFrame([("hub", "R", f"n{i:04}") for i in range(400)], "src_id string, rel_type string, dst_id string")
    seeds = spark.createDataFrame([(1, "hub")], "qid int, node string")
    scored, visited = graph.traverse(edges, seeds)
    assert visited.count() == 401 and scored.where("src_id = 'hub'").count() == 400
    assert graph.traverse(edges, seeds, cap=300)[1].count() == 301
    nodes = [f"n{i:04}" for i in range(400)]
    vector = F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>")
    chunks = spark.createDataFrame([(f"c{n}", f"text {n}", "a", 1, "", "2024.01") for n in nodes], "id string, text string, source_file string, source_page int, section string, doc_version string").withColumn("embedding", vector)
    entities = spark.createDataFrame([("hub", "hub", [])], "id string, name string, aliases array<string>").withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))
    store = ask.Store(entities, edges, spark.createDataFrame([(n, f"c{n}") for n in nodes], "node_id string, chunk_id string"), chunks, spark.createDataFrame([("hub", "hub")], "id string, term string"))
    asked = spark.createDataFrame([(1, "the hub and text n0399")], "qid int, question string")
    out = ask.retrieve(asked, store, F.lit("2024-07-01").cast("date"), encode=lambda c: vector, keywords={"x": ["zz"]}, anchors={"x": ["zz"]})
    assert out.questions.first().graph_n == 400 and out.chunks.orderBy("rank").first().id == "cn0399"


def test_paths_use_an_edge_once(spark):
    edges = spark.createDataFrame([("A", "X", "B"), ("B", "Y", "C")], "src_id string, rel_type string, dst_id string")
    got = graph.neighbours(edges, spark.createDataFrame([("A",)], "start string"), 2)
    assert {(r.rel_type, r.end, r.hop) for r in got.collect()} == {("X", "B", 1), ("Y", "C", 2)}


def test_terms_match_either_way(spark):
    q = spark.createDataFrame([(1, "Visa extension"), (2, "visa"), (3, "")], "qid int, phrase string")
    t = spark.createDataFrame([("v", "VISA"), ("l", "long visa extension form"), ("e", "")], "id string, term string")
    got = {(r.qid, r.id) for r in link.match_terms(q, t).collect()}
    assert got == {(1, "v"), (1, "l"), (2, "v"), (2, "l"), (3, "v"), (3, "l")}


def test_gates_of_a_question_without_chunks(spark):
    row = spark.createDataFrame([("q", 0.0, 0)], "q string, s double, n int")
    assert row.select(rank.deep_reasons(F.col("q"), F.col("s"), F.col("n"))).first()[0] == ["low_top_score", "insufficient_evidence"]


def test_complex_questions_get_no_stock_answer(spark):
    faq = spark.createDataFrame([(0, ["비자"], "a"), (1, ["비자", "연장"], "b")], "ord int, keywords array<string>, answer string")
    q = spark.createDataFrame([(1, "비자 연장"), (2, "비자 연장 비교"), (3, "xyz")], "qid int, question string")
    assert [(r.qid, r.answer, r.matched) for r in route.stock_answers(q, faq).collect()] == [(1, "b", 2)]


def test_replies_with_defects(spark):
    reply = json.dumps({"entities": [{"id": "a"}, {"name": "no id"}, {"id": "b", "type": "Topic", "confidence": "x"}], "relations": [{"subject_id": "a", "predicate": "ODD", "object_id": "b"}, {"subject_id": "a", "predicate": "BLOCKS", "object_id": "b"}]})
    rows = spark.createDataFrame([("c", "s", 1, f"```json\n{reply}\n```"), ("d", "s", 1, "sorry"), ("e", "s", 1, None)], "chunk_id string, source string, source_page int, reply string")
    assert [(r.id, r.name, r.confidence, r.label) for r in extract.reply_entities(rows).collect()] == [("a", "a", 0.8, "Entity")]
    assert extract.reply_triples(rows).count() == 1


def test_broken_log_lines_are_set_aside(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"path": "fast", "elapsed_sec": 1.5}\n<<<<<<< HEAD\n\n{"path": "deep", "elapsed_sec": 2}\n')
    rows, bad = readers.latency_log(spark, str(p))
    assert rows.count() == 2 and [r[0] for r in bad.collect()] == ["<<<<<<< HEAD"]


def test_page_files(spark, tmp_path):
    (tmp_path / "guide_2024-03.pdf").write_bytes(b"Part 1\fplain\f  ")
    (tmp_path / "bad.pdf").write_bytes(b"!")

    def parse(content):
        if content == b"!":
            raise ValueError
        return content.decode().split("\f")

    got = readers.raw_documents(readers.page_files(spark, str(tmp_path), parse)).orderBy("source_page").collect()
    assert [(r.source_page, r.section, r.doc_version) for r in got] == [(1, "Part 1", "2024.03"), (2, "Part 1", "2024.03")]


def test_ingest_twice_changes_nothing(spark):
    text = "D-2 연장 불가 법무부 " + "단어 " * 50
    raw = spark.createDataFrame([("a.pdf", 1, text, "", "ko", "", "")], "source_file string, source_page int, text string, section string, language string, doc_version string, source_url string")
    new = ingest.build(raw, F.lit("2024-01-01"))
    assert {r.id for r in new["entities"].collect()} == {"D-2", "법무부"} and new["triples"].count() == 1
    old = {k: new[k].where("false") for k in ("chunks", "entities", "links")}
    old["edges"] = spark.createDataFrame([], "src_id string, rel_type string, dst_id string, confidence double")
    once = ingest.load(old, new)
    twice = ingest.load(once, new)
    assert [once[k].count() for k in once] == [twice[k].count() for k in once] == [1, 2, 0, 2, 0]


def test_stream_equals_batch(spark, sf, tmp_path):
    files = str(tmp_path / "in")
    rows = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("source as source_file", "cast(doc_id as int) as source_page", "text", "'' as section", "lang as language", "'' as doc_version")
    rows.write.parquet(files)
    out = str(tmp_path / "out")
    stream = live.chunk_stream(spark.readStream.schema(rows.schema).parquet(files))
    live.load_stream(stream, lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(out).select("id").exceptAll(live.chunk_stream(rows).select("id")).isEmpty()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "qid int, question string")
    assert route.with_variants(none).isEmpty()
    assert link.match_terms(none.selectExpr("qid", "question as phrase"), none.selectExpr("qid as id", "question as term")).isEmpty()
