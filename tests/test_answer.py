"""The whole answer path on a small store against plain Python, and tables kept as versions."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import rules
from sparkloom.functions.embed import hashed
from sparkloom.operators import link
from sparkloom.plans import ask, ingest
from sparkloom.sources import readers, versions

AS_OF = datetime.date(2024, 7, 1)
INTENTS = {"fees": ["fee", "tuition"], "stay": ["visa", "permit"]}
ANCHORS = {"fees": ["tuition fee"], "stay": ["visa extension", "permit"]}
TYPES = {"comparison": ["compare"], "cause": ["why"]}
R = rules.RANKING


def unit(texts):
    return hashed(texts).astype(np.float32).astype(float)


def cosine(a, b):
    return float(a @ b) / (np.linalg.norm(a) + 1e-10) / (np.linalg.norm(b) + 1e-10)


def terms(x):
    return {w for w in x.lower().split() if len(w) > 1}


def overlap(text, question, anchors):
    low = text.lower()
    share = min(1.0, sum(a.lower() in low for a in anchors) / len(anchors)) if anchors else 0.0
    return 0.6 * share + 0.4 * len(terms(question) & terms(text)) / max(1, len(terms(question)))


def recency(version):
    y, m = map(int, version.split("."))
    return max(0.0, 1 - max(0.0, (AS_OF - datetime.date(y, m, 1)).days / 30) / 24)


class Plain:
    def __init__(self, entities, edges, links, chunks, names):
        self.entities, self.edges, self.links, self.chunks, self.names = entities, edges, links, chunks, names

    def retrieve(self, question):
        intents = [k for k, words in INTENTS.items() if any(w in question.lower() for w in words)]
        anchors = list(dict.fromkeys(a for i in intents for a in ANCHORS[i]))
        phrases = {p.lower().strip() for p in [" ".join(question.split()), *anchors]}
        found = {i for p in phrases for i, t in self.names if t.lower() in p or p in t.lower()}
        q = unit([question])[0]
        near = sorted(((-cosine(q, v), i) for i, v in self.entities.items()))[:3]
        found |= {i for c, i in near if -c >= R.link_cosine}
        seen, edge = set(found), set(found)
        for _ in range(R.hops):
            edge = {b for a in edge for x, y in self.edges for b in ((y,) if x == a else (x,) if y == a else ())} - seen
            seen |= edge
        graph = {c for n, c in self.links if n in seen}
        vector = {}
        if len(graph) < R.graph_chunks or len(intents) >= 2:
            q = unit([" ".join([question, " ".join(anchors)])])[0]
            best = sorted((-cosine(q, c["v"]), i) for i, c in self.chunks.items())[: R.widen * R.fetch]
            scored = [(R.cosine * -s + R.keyword * overlap(self.chunks[i]["text"], question, anchors) + R.recency * recency(self.chunks[i]["version"]), i) for s, i in best]
            vector = {i: s for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[: R.fetch]}
        merged = {}
        for i in graph | vector.keys():
            c = self.chunks[i]
            base = max(([R.graph_base] if i in graph else []) + ([vector[i]] if i in vector else []))
            s = R.merge_base * base + R.merge_keyword * overlap(c["text"], question, anchors) + R.merge_recency * recency(c["version"])
            if s >= R.least_score:
                merged[i] = s
        top = sorted(merged.items(), key=lambda x: (-x[1], x[0]))[: R.top]
        fit = max((overlap(self.chunks[i]["text"], question, anchors) for i, _ in top), default=0.0)
        method = "no_answer" if fit < R.least_fit else "hybrid" if graph and vector else "vector" if vector else "graph"
        return method, [] if method == "no_answer" else top

    def reasons(self, question, best, n):
        kind = next((k for k, words in TYPES.items() if any(w in question.lower() for w in words)), "general")
        return [r for r, bad in (("low_top_score", best < R.gate_score), ("insufficient_evidence", n < R.gate_evidence), ("complex_question", kind in rules.COMPLEX_TYPES)) if bad]

    def answer(self, question):
        method, top = self.retrieve(question)
        best, n = max((s for _, s in top), default=0.0), len(top)
        why = self.reasons(question, best, n)
        methods, rows = {method}, {i: s for i, s in top}
        if why:
            for suffix in rules.VARIANTS["en"]:
                m, more = self.retrieve(" ".join(question.split()) + " " + suffix)
                methods.add(m)
                for i, s in more:
                    rows[i] = max(s, rows.get(i, -1.0))
        methods -= {"no_answer"}
        method = "hybrid" if len(methods) > 1 else next(iter(methods), "no_answer")
        last = sorted(rows.values(), reverse=True)[: R.top]
        web = bool(why) and bool(self.reasons(question, max(last, default=0.0), len(last)))
        return ("deep" if why else "fast", method, round(best, 6), n, tuple(why), web)


@pytest.fixture(scope="module")
def store(spark):
    rng = random.Random(6)
    words = ["visa", "permit", "fee", "tuition", "office", "form", "month", "campus", "bank", "room", "card", "exam", "class", "bus"]
    chunks = {f"c{i}": {"text": " ".join(rng.choice(words) for _ in range(rng.randrange(4, 14))), "version": f"2024.{i % 6 + 1:02d}"} for i in range(40)}
    for c, v in zip(chunks.values(), unit([c["text"] for c in chunks.values()]), strict=True):
        c["v"] = v
    names = {f"e{i}": w for i, w in enumerate(words)}
    entities = dict(zip(names, unit(list(names.values())), strict=True))
    edges = [(f"e{i}", f"e{i + 1}") for i in range(0, 12, 3)]
    links = [(f"e{rng.randrange(6)}", f"c{i}") for i in range(0, 40, 3)]
    listed = [(i, names[i]) for i in list(names)[:9]]
    vector = lambda v: [float(x) for x in v]
    spark_store = ask.Store(
        spark.createDataFrame([(i, names[i], vector(v)) for i, v in entities.items()], "id string, name string, embedding array<float>"),
        spark.createDataFrame([(a, "RELATED_TO", b) for a, b in edges], "src_id string, rel_type string, dst_id string"),
        spark.createDataFrame(links, "node_id string, chunk_id string"),
        spark.createDataFrame([(i, c["text"], "f.pdf", 1, "", c["version"], vector(c["v"])) for i, c in chunks.items()], "id string, text string, source_file string, source_page int, section string, doc_version string, embedding array<float>"),
        spark.createDataFrame(listed, "id string, term string"),
    )
    return spark_store, Plain(entities, edges, links, chunks, listed)


QUESTIONS = ["visa fee", "why is the bus late", "compare room and bank", "qqq zzz", "tuition   fee office", "exam class campus bus", "card", "permit form month", "xylophone"]


@pytest.fixture(scope="module")
def answered(spark, store):
    q = spark.createDataFrame(list(enumerate(QUESTIONS)), "qid int, question string")
    hits = spark.createDataFrame([(i, 1, f"https://example.org/{i}" if i % 2 else "https://elsewhere.net", "<p>page</p>") for i in range(len(QUESTIONS))], "qid int, ord int, url string, html string")
    redirects = spark.createDataFrame([("https://elsewhere.net", None)], "url string, final_url string")
    faq = spark.createDataFrame([(0, ["card"], "Cards are at the desk.")], "ord int, keywords array<string>, answer string")
    out = ask.answer(q, store[0], F.lit(AS_OF), faq, keywords=INTENTS, anchors=ANCHORS, types=TYPES, web=ask.Web(hits, redirects, "example.org"))
    return {r.qid: r for r in out.collect()}


def test_answers_equal_plain_python(store, answered):
    assert answered.keys() == set(range(len(QUESTIONS)))
    for i, question in enumerate(QUESTIONS):
        r = answered[i]
        if question == "card":
            assert (r.path, r.answer) == ("faq", "Cards are at the desk.")
            continue
        path, method, best, n, why, web = store[1].answer(question)
        assert (r.path, r.method, round(r.best_score, 6), r.evidence_count, tuple(r.reasons), r.web) == (path, method, best, n, why, web and i % 2 == 1), question


def test_what_is_said(answered):
    """Context, the web below it, or the message where there is neither."""
    for r in answered.values():
        if r.path == "faq":
            continue
        if r.method == "no_answer" and not r.web:
            assert r.answer == rules.NO_EVIDENCE["en"] and r.context == ""
        else:
            assert r.answer.startswith(r.context) and (rules.WEB_TITLE in r.answer) == r.web
    assert any(r.web for r in answered.values()) and any(r.method == "no_answer" for r in answered.values())


def test_a_model_is_refused(spark, store):
    q = spark.createDataFrame([(0, "visa permit"), (1, "tuition fee"), (2, "office form")], "qid int, question string")
    made = lambda question, context: F.when(F.contains(question, F.lit("visa")), F.lit("总之")).when(F.contains(question, F.lit("tuition")), F.lit(None).cast("string")).otherwise(F.concat(F.lit("so: "), question))
    got = {r.qid: r for r in ask.answer(q, store[0], F.lit(AS_OF), generate=made, keywords=INTENTS, anchors=ANCHORS, types=TYPES).collect()}
    want = [rules.REFUSAL, rules.REFUSAL, "so: office form"]
    assert [got[i].answer for i in range(3) if got[i].method != "no_answer"] == [want[i] for i in range(3) if got[i].method != "no_answer"]
    assert any(got[i].method != "no_answer" for i in range(3))


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.load(spark, path, "id long").isEmpty() and versions.latest(spark, path) == 0
    for n in range(5):
        assert versions.save(versions.load(spark, path, "id long").unionByName(spark.range(n, n + 1)), path) == n + 1
    assert sorted(r.id for r in versions.load(spark, path).collect()) == [0, 1, 2, 3, 4]
    # a version without a name is not read
    spark.range(9).write.parquet(f"{path}/6")
    assert versions.load(spark, path).count() == 5
    assert not (tmp_path / "t" / "1").exists()


def test_ingest_with_a_model(spark, tmp_path):
    text = ["D-2 법무부 " + "단어 " * 60, "nothing known here " * 20]
    raw = spark.createDataFrame([("a.pdf", i, t, "", "ko", "", "") for i, t in enumerate(text, 1)], "source_file string, source_page int, text string, section string, language string, doc_version string, source_url string")
    model = lambda c: F.lit('{"entities":[{"id":"D2"},{"id":"office","confidence":0.5}],"relations":[{"subject_id":"office","predicate":"REQUIRES","object_id":"D2","confidence":0.9}]}')
    new = ingest.build(raw, F.lit("2024-01-01"), model=model)
    for _ in range(2):
        out = ingest.store(spark, str(tmp_path / "kb"), new)
        assert sorted(r.id for r in out["entities"].collect()) == ["D-2", "office", "법무부"]
        assert [(r.src_id, r.rel_type, r.dst_id) for r in out["edges"].collect()] == [("office", "REQUIRES", "D-2")]
        assert out["links"].count() == 4 and out["chunks"].count() == 2 and out["queue"].isEmpty()


def test_many_segments_and_long_texts(spark):
    """Work grows with the text: thousands of segments, and names sought in a long text."""
    from sparkloom.functions import chunking

    page = "\n\n".join(["word " * 60 if i % 3 else "small" for i in range(6000)])
    row = spark.createDataFrame([(page,)], "t string").select(F.size(chunking.chunks(F.col("t"), F.lit("s"))).alias("n")).first()
    assert row.n == 6000
    texts = spark.createDataFrame([(1, "ab" * 200_000 + "needle"), (2, "é漢\U0001f600")], "t_id int, t string")
    found = link.contained(texts, spark.createDataFrame([(1, "needle"), (2, "漢"), (3, ""), (4, "zzzz")], "m_id int, m string"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (1, 3), (2, 2), (2, 3)]


def test_arrays_in_the_queue(spark, tmp_path):
    (tmp_path / "q.json").write_text('[\n {"subject_id": "a", "predicate": "P", "object_id": "b", "confidence": 0.1},\n {"subject_id": "c", "predicate": "P", "object_id": "d", "confidence": 0.2}\n]')
    assert readers.review_queue(spark, str(tmp_path / "q.json"), whole=True).count() == 2
