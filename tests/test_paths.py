"""Bounded paths, redirect chains, lookups by the rarest gram, ranking without texts, text of pages."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.markup import html_document, page_text
from sparkloom.functions.text import keyword_overlap
from sparkloom.operators import extract, graph, link, postings, rank, route
from sparkloom.operators.tables import materialise
from sparkloom.plans import ask
from sparkloom.sources import readers


def plain_paths(edges, starts, hops, cap):
    walk = {}
    for e in set(edges):
        s, r, d = e
        walk.setdefault(s, []).append((r, d, e))
        if s != d:
            walk.setdefault(d, []).append((r, s, e))
    out = []
    for start in starts:
        level, rows = [(start, ())], []
        for hop in range(1, hops + 1):
            level = [(r, d, (*used, e)) for a, used in level for r, d, e in walk.get(a, []) if e not in used]
            rows += [(hop, r, d) for r, d, _ in level]
            level = [(d, used) for _, d, used in level]
        out += [(start, r, d, hop) for hop, r, d in sorted(rows)[:cap]]
    return sorted(out)


@pytest.mark.parametrize("cap", [1, 3, 7, 40])
@pytest.mark.parametrize("hops", [1, 2, 3])
def test_paths_around_a_hub(spark, hops, cap):
    edges = [("hub", "R", f"leaf{i:02}") for i in range(20)] + [("a", "S", "hub"), ("b", "Q", "hub"), ("a", "R", "b"), ("a", "T", "a"), ("b", "R", "c"), ("c", "R", "a")]
    df = spark.createDataFrame(edges, "src_id string, rel_type string, dst_id string")
    got = graph.neighbours(df, spark.createDataFrame([("a",), ("b",), ("leaf03",), ("nobody",)], "start string"), hops, cap)
    assert sorted(tuple(r) for r in got.select("start", "rel_type", "end", "hop").collect()) == plain_paths(edges, ["a", "b", "leaf03"], hops, cap)


def test_edges_of_hubs_that_cannot_be_ranked_are_not_emitted(spark, monkeypatch):
    edges = [(f"s{i}", "HANDLES", f"n{i % 2}") for i in range(40)] + [("n0", "BLOCKS", f"r{i}") for i in range(5)] + [("n1", "BELONGS_TO", "r0"), ("n1", "BELONGS_TO", "n1")]
    df = spark.createDataFrame(edges, "src_id string, rel_type string, dst_id string")
    seeds = spark.createDataFrame([(i, f"s{i}") for i in range(6)] + [(9, "r0"), (9, "s1")], "qid int, node string")
    written = []
    monkeypatch.setattr(graph, "materialise", lambda x: written.append(materialise(x)) or written[-1])
    whole, few = (graph.traverse(df, seeds, 2, None, k)[0] for k in (None, 3))
    ranked = lambda x: sorted(tuple(r) for r in graph.ranked_edges(x, 3).select("qid", "src_id", "rel_type", "dst_id", "score", "forced", "rank").collect())
    assert ranked(whole) == ranked(few) and few.count() < whole.count() / 2
    assert all(x.where("hop = 2").isEmpty() for x in written if "hop" in x.columns)  # nobody reads where the walk ends


def test_redirects_of_all_lengths_and_circles(spark):
    rows = [(f"{n}-{i}", f"{n}-{i + 1}") for n in range(1, 21) for i in range(n)]  # chains of 1 to 20
    rows += [(f"o{n}-{i}", f"o{n}-{(i + 1) % n}") for n in range(2, 8) for i in range(n)] + [("into", "o5-2"), ("x", "into")]  # circles, and ways into one
    rows += [("self", "self"), ("to-self", "self"), ("dead", None), ("to-dead", "dead"), ("twice", "z"), ("twice", "b"), (None, "q")]
    got = {r.url: r.final_url for r in route.final_urls(spark.createDataFrame(rows, "url string, final_url string")).collect()}
    want = {f"{n}-{i}": f"{n}-{n}" for n in range(1, 21) for i in range(n)} | {f"o{n}-{i}": "" for n in range(2, 8) for i in range(n)}
    assert got == want | {"into": "", "x": "", "self": "self", "to-self": "self", "dead": "", "to-dead": "", "twice": "b"}
    assert route.final_urls(spark.createDataFrame([], "url string, final_url string")).isEmpty()


def test_hits_that_share_an_address(spark):
    hits = spark.createDataFrame([(1, "u"), (2, "u"), (3, "u"), (4, "u"), (5, None)], "ord int, url string")
    leads = [(1, "u", "v"), (1, "v", "w"), (2, "u", None), (3, "u", "x"), (3, "x", "u"), (5, "u", "y")]
    redirects = spark.createDataFrame(leads, "ord int, url string, final_url string")
    assert {tuple(r) for r in route.resolve_urls(hits, redirects, ["ord"]).collect()} == {(1, "w"), (2, ""), (3, ""), (4, "u"), (5, None)}
    assert {r.url for r in route.resolve_urls(hits, redirects.where("ord = 1").drop("ord")).collect()} == {"w", None}
    wanted = spark.createDataFrame([(7,)], "qid int")
    page = hits.select(F.lit(7).alias("qid"), "ord", F.concat(F.lit("https://example.org/"), "url").alias("url"), F.concat("url", F.col("ord").cast("string")).alias("html"))
    own = page.where("ord < 3").select("qid", "ord", "url", F.when(F.col("ord") == 1, "https://www.example.org/").alias("final_url"))
    assert ask.web_lines(ask.Web(page, own, "example.org"), wanted).first().external.splitlines() == ["[WEB] www.example.org: u1", "[WEB] example.org: u3", "[WEB] example.org: u4"]


def test_terms_are_looked_up_by_their_rarest_gram(spark):
    texts = [(i, f"over the hill {i} and the river") for i in range(400)] + [(1000, "in the zebra crossing"), (1001, "zebra"), (1002, None), (1003, "")]
    terms = [(1, " the zebra"), (2, " the hill 7"), (3, "and the river"), (4, "quagga the"), (5, "a"), (6, ""), (7, None), (8, "zebr")]
    t = spark.createDataFrame(texts, "t_id long, t string")
    m = spark.createDataFrame(terms, "m_id long, m string")
    got = {tuple(r) for r in link.contained(t, m).collect()}
    assert got == {(i, j) for i, x in texts for j, y in terms if x is not None and y is not None and y in x}
    numbered = t.select(F.col("t_id").alias("_n"), "t")
    n = Counter(r.m_id for r in link.candidates(numbered, m).collect())
    assert n[1] == 1 and n[2] <= 20 and n[4] == 0 and n[8] == 2  # by their first four characters 1 and 2 would meet all texts


def test_long_terms_are_not_repeated_for_their_grams(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(link, "materialise", lambda df: (kept.append(materialise(df)), kept[-1])[1])
    long = "".join(chr(0x4E00 + i) for i in range(3000))
    t = spark.createDataFrame([(1, "the zebra"), (2, "quagga")], "t_id long, t string")
    m = spark.createDataFrame([("z", "zebra"), ("long", long)], "m_id string, m string")
    assert {tuple(r) for r in link.contained(t, m).collect()} == {(1, "z")}
    assert sum(df.count() for df in kept) < 100  # a term longer than all texts is not cut up
    del kept[:]
    t = t.unionByName(spark.createDataFrame([(3, long + "!")], "t_id long, t string"))
    assert {tuple(r) for r in link.contained(t, m).collect()} == {(1, "z"), (3, "long")}
    cut = [df for df in kept if "g" in df.columns]
    assert cut and not any("m" in df.columns or "t" in df.columns for df in cut)


def test_sets_of_ids_are_joined_as_words(spark):
    phrases = [(q, f"w{w}") for q in range(5) for w in range(q, 9)] + [(None, "w1"), (9, None), (8, "none")]
    terms = [(f"i{i}", f"w{i % 9}" if i % 2 else "W") for i in range(200)] + [(None, "w8"), ("i1", "of w3 and w4"), ("x", None)]
    q, t = spark.createDataFrame(phrases, "qid int, phrase string"), spark.createDataFrame(terms, "id string, term string")
    found = link.match_terms(q, t)
    low = [(i, m.lower()) for i, m in terms if m]
    want = {(a, i) for a, p in phrases if p for i, m in low if p in m or m in p}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "bit_or" in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each id of each phrase of a question


def test_overlap_from_hashes_equals_that_from_texts(spark, sf):
    anchors = {"x": ["tion", "An "], "y": ["ée"]}
    chunks = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.lit("2024.01").alias("doc_version"))
    q = spark.createDataFrame([(1, "The the tion of An", ["tion", "An "]), (2, "", []), (3, "is it and", ["ée"])], "qid int, question string, anchors array<string>")
    pairs = chunks.select("id").join(q.select("qid"), F.lit(True))
    table, as_of = materialise(postings.postings(chunks, anchors)), F.lit("2024-07-01").cast("date")
    got, other = ({(r.qid, r.id): round(r.overlap, 9) for r in postings.measured(pairs, postings.question_terms(q), table, as_of, most).collect()} for most in (postings.ASKED_BYTES, 0))
    assert got == other
    plain = chunks.join(q, F.lit(True)).select("qid", "id", keyword_overlap(F.coalesce("text", F.lit("")), F.col("question"), F.col("anchors")).alias("o"))
    assert got == {(r.qid, r.id): round(r.o, 9) for r in plain.collect()}


@pytest.mark.parametrize("parts, table", [(None, 1 << 25), ((2, 3), 40), ((1, 1), 4000)])
def test_best_linked_chunks_without_their_pairs(spark, sf, monkeypatch, parts, table):
    monkeypatch.setattr(postings, "TABLE_BYTES", table)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 90")
    known, as_of = {"x": ["tion", "An "], "y": ["ée"]}, F.lit("2024-07-01").cast("date")
    chunks = docs.select(F.col("doc_id").alias("id"), "text", F.concat(F.lit("2024.0"), F.col("doc_id") % 3 + 4).alias("doc_version"))
    chunks = chunks.unionByName(chunks.where("id < 30").withColumn("id", F.col("id") + 1000))  # texts that tie
    links = chunks.select(F.concat(F.lit("n"), F.col("id") % 5).alias("node_id"), F.col("id").alias("chunk_id"))
    links = links.unionByName(links.where("chunk_id % 2 = 0").withColumn("node_id", F.lit("n0"))).unionByName(links.limit(1).withColumn("chunk_id", F.lit(-1).cast("long")))
    q = chunks.where("id % 9 = 0").select(F.col("id").alias("qid"), F.substring("text", 1, 90).alias("question"), F.when(F.col("id") % 2 == 0, F.array(F.lit("tion"), F.lit("An "))).otherwise(F.array().cast("array<string>")).alias("anchors"))
    q = q.unionByName(spark.createDataFrame([(5000, "", [])], q.schema))
    visited = q.select("qid", F.explode(F.array(F.concat(F.lit("n"), F.col("qid") % 5), F.concat(F.lit("n"), F.col("qid") % 2), F.lit("none"))).alias("node")).where("qid <> 9")
    kept, asked = materialise(postings.postings(chunks, known)), postings.question_terms(q)
    pairs = materialise(postings.measured(graph.chunk_ids(visited, links), asked, kept, as_of))
    best, counts = postings.best_linked(visited, links, asked, kept, as_of, parts=parts)
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in pairs.groupBy("qid").count().collect()}
    none = materialise(pairs.limit(0).withColumn("score", F.lit(0.0)))
    top = lambda rows: {(r.qid, r.id, r["rank"], r.score) for r in rank.top_candidates(postings.merged(rows, none)).collect()}
    assert top(postings.measured(best, asked, kept, as_of)) == top(pairs)
    assert best.count() < pairs.count()


def test_no_text_is_shuffled_to_rank(spark, sf):
    chunks = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.lit("2024.01").alias("doc_version"))
    q = postings.question_terms(spark.createDataFrame([(1, "of it", ["tion"])], "qid int, question string, anchors array<string>"))
    kept = materialise(postings.postings(chunks))
    pairs = materialise(kept.select(F.lit(1).alias("qid"), "id", F.lit(0.5).alias("cosine")))
    near = postings.best_near(postings.measured(pairs, q, kept, F.lit("2024-07-01").cast("date")))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"\btext#", plan)
    after = plan[: plan.index("Project")]  # what goes on from the join: numbers
    assert "terms#" not in after


PAGES = {
    "<p>a<b>b</b>c</p>": "a b c",
    '<a title="x > y">in</a> out': "in out",
    "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    "&lt;b&gt; &amp;amp; &#65;&#x42; &eacute;&nbsp;&copy; &unknown;": "<b> &amp; AB é © &unknown;",
    "<script>if (a < b) { '</p>' }</script>x<STYLE>p { }</STYLE >y<noscript><p>no</p></noscript>z": "x y z",
    "a<!-- <p>hidden</p> -> - > -->b": "a b",
    "<!DOCTYPE html><html><head><title>T</title></head><body>\n one\t two </body></html>": "T one two",
    "never <script>closed": "never",
    "": "",
}


def test_pages_as_a_parser_reads_them(spark):
    assert {h: page_text(h) for h in PAGES} == PAGES
    df = spark.createDataFrame([(h,) for h in PAGES] + [(None,)], "html string")
    assert {r.html: r.t for r in df.select("html", html_document(F.col("html")).alias("t")).collect()} == PAGES | {None: None}
    assert page_text("<p>" * 100_000 + "deep") == "deep" and page_text("<" * 50_000) == "<" * 50_000


def test_references_without_their_semicolon(spark):
    pages = {"<title>a&amp;&amp</title>b": ("a&& b", "a&&amp b"), "&copyright; &notit; &#65;&#66 &am": ("©right; ¬it; AB &am", "&copyright; &notit; A&#66 &am"), "&amp": ("&", "&amp")}
    assert {h: (page_text(h), page_text(h, closed=True)) for h in pages} == pages
    df = spark.createDataFrame([(h,) for h in pages], "html string").select("html", html_document(F.col("html"), closed=True).alias("t"))
    assert {r.html: r.t for r in df.collect()} == {h: t for h, (_, t) in pages.items()}


def test_broken_files_say_why(spark, tmp_path):
    for name, content in (("a.txt", "one\ntwo"), ("b.txt", "one\n!\nthree"), ("c.txt", "!")):
        (tmp_path / name).write_text(content)

    def parse(content):
        for line in content.decode().split("\n"):
            if line == "!":
                raise ValueError("no page")
            yield line

    rows = lambda **how: sorted(tuple(r) for r in readers.page_files(spark, str(tmp_path), parse, "*.txt", **how).fillna("-").collect())
    assert rows() == [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("b.txt", 1, "one")]
    assert rows(errors=True) == [("a.txt", 1, "one", "-"), ("a.txt", 2, "two", "-"), ("b.txt", 1, "one", "-"), ("b.txt", 2, "-", "ValueError: no page"), ("c.txt", 1, "-", "ValueError: no page")]


def test_models_are_asked_with_instructions(spark):
    chunks = spark.createDataFrame([("c1", "text of it", "a.pdf", 1)], "id string, text string, source_file string, source_page int")
    echo = lambda c: F.to_json(F.struct(F.array(F.struct(c.alias("id"))).alias("entities")))
    told = extract.reply_entities(extract.replies(chunks, echo, prompted=True)).first().id
    assert told.endswith("[Source: a.pdf]\n\ntext of it") and "RELATED_TO" in told and "Procedure" in told
    assert extract.reply_entities(extract.replies(chunks, echo)).first().id == "text of it"
    pictures = spark.createDataFrame([("file:/x/p.png", "image/png", "QQ=="), ("file:/x/q.png", "image/png", None)], "path string, mime string, data string")
    see = lambda told, mime, data: F.when(data.isNotNull(), F.to_json(F.struct(F.array(F.struct(F.concat(mime, F.lit(" "), data).alias("id"))).alias("entities"))))
    got = extract.reply_entities(extract.image_replies(pictures, see)).collect()
    assert [(r.chunk_id, r.source, r.id) for r in got] == [("file:/x/p.png", "p.png", "image/png QQ==")]
