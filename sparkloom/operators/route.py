"""Routing of questions: stock answers, deep path, web snippets, context for the answer, measurements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions.text import allowed_host, contains_any, disclaimer, has_foreign_script, html_text, is_stale, message, style, title_from_url, variants
from .link import contained
from .tables import materialise, pick

R = rules.RANKING


def is_complex(question: Column, found: list[str] | None = None) -> Column:
    return contains_any(F.lower(question), rules.COMPLEX_TERMS if found is None else found)


def stock_answers(questions: DataFrame, faq: DataFrame, complex_terms: list[str] | None = None) -> DataFrame:
    """(qid, ord, answer, matched) of questions that a stock answer fits: the row of faq (ord, keywords, answer)
    with most keywords in the question, the first of equals. Complex questions get none.

    Keywords meet questions by an exact lookup of substrings, not pair by pair.
    """
    q = questions.where(~is_complex(F.col("question"), complex_terms)).select("qid", F.lower("question").alias("t"))
    k = faq.select("ord", F.explode("keywords").alias("m")).withColumn("m", F.lower("m"))
    hits = contained(q.select(F.col("t").alias("t_id"), "t").distinct(), k.select(F.col("m").alias("m_id"), "m").distinct())
    n = q.join(hits, F.col("t") == F.col("t_id")).join(k, F.col("m") == F.col("m_id")).groupBy("qid", "ord").agg(F.count("*").alias("matched"))
    return pick(n, ["qid"], [F.desc("matched"), F.asc("ord")]).join(faq.select("ord", "answer"), "ord")


def with_variants(questions: DataFrame, suffixes: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each distinct variant of a question; variant 0 is the question itself, normalised."""
    return questions.select("*", F.posexplode(variants(F.col("question"), None, suffixes)).alias("variant", "phrase"))


def snippets(hits: DataFrame, suffixes: str = rules.HOST_SUFFIXES, k: int = 3, widen: int = 3, most: int = 1200, read: Callable[[Column], Column] = html_text) -> DataFrame:
    """(qid, rank, url, title, snippet) of ranked pages (qid, ord, url, html): of the first widen * k results with an
    http address, those whose host is allowed and whose text is not empty, at most k. read: what a page's text is; by default
    an expression that knows common entities only, functions.markup.html_document parses."""
    http = hits.where(F.col("url").startswith("http"))
    first = http.withColumn("_i", F.row_number().over(Window.partitionBy("qid").orderBy("ord"))).where(F.col("_i") <= widen * k)
    good = first.where(allowed_host(F.col("url"), suffixes)).withColumn("snippet", F.substring(read(F.col("html")), 1, most)).where("snippet <> ''")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("_i"))
    return good.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "url", title_from_url(F.col("url")).alias("title"), "snippet")


def final_urls(redirects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(url, final_url) of redirects (url, final_url), followed to their end.

    A null target failed: it and all that lead to it are empty. An address that leads to itself is an end; a longer circle
    has none, so all of it and all that lead into it are empty. Of several targets of an address the smallest counts.
    Each round doubles the steps: what has not ended after as many as there are addresses is in a circle.

    keys: columns that tell fetches apart. An address may lead elsewhere in another one, so each is followed by itself, and
    the keys, which are not null, come back with it.
    """
    keys = keys or []
    known = redirects.where("url is not null").groupBy(*keys, "url").agg(F.coalesce(F.min("final_url"), F.lit("")).alias("at"))
    at = materialise(known.withColumn("done", (F.col("at") == F.col("url")) | (F.col("at") == "")))
    for _ in range(max(1, at.count()).bit_length() + 1):
        going = at.where("not done")
        if going.isEmpty():
            break
        onward = at.select(*keys, F.col("url").alias("at"), F.col("at").alias("_next"), F.col("done").alias("_done"))
        moved = going.drop("done").join(onward, [*keys, "at"], "left").select(*keys, "url", F.coalesce("_next", "at").alias("at"), F.coalesce("_done", F.lit(True)).alias("done"))
        at = materialise(at.where("done").unionByName(moved))
    return at.select(*keys, "url", F.when(F.col("done"), F.col("at")).otherwise("").alias("final_url"))


def resolve_urls(hits: DataFrame, redirects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Addresses after all redirects (url, final_url); an address whose chain failed or never ends becomes empty. keys: columns
    of both, where redirects are those that were met while a hit was fetched; else they hold for all hits."""
    known = final_urls(redirects, keys).withColumnsRenamed({"final_url": "_f"})
    return hits.join(known, [*(keys or []), "url"], "left").withColumn("url", F.coalesce("_f", "url")).select(*hits.columns)


def context(top: DataFrame, edges: DataFrame, questions: DataFrame, as_of: Column, triples: int = 15, texts: int = 4, chars: int = 700) -> DataFrame:
    """(qid, context) of questions (qid, method): the first edges by rank, the best chunks with where they are
    from, a warning under stale ones, and all sources. Empty where the method is no_answer."""
    shown = lambda c, form: F.when(F.coalesce(c, F.lit("")) != "", form)
    where = F.concat_ws(
        " | ", shown(F.col("source_file"), F.col("source_file")), shown(F.col("doc_version"), F.col("doc_version")),
        shown(F.col("section"), F.concat(F.lit(rules.SECTION_TITLE), F.col("section"))), F.when(F.coalesce("source_page", F.lit(0)) != 0, F.concat(F.lit("p."), F.col("source_page").cast("string"))),
    )
    stale = F.when(is_stale(F.col("doc_version"), as_of), disclaimer(F.col("source_file"), F.col("doc_version")))
    block = F.concat_ws("\n", F.when(where != "", F.concat(F.lit("["), where, F.lit("]"))), F.substring("text", 1, chars), stale, F.lit(""))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("x")))), lambda s: s["x"])
    source = shown(F.col("source_file"), F.concat(F.col("source_file"), F.lit(" ("), F.coalesce("doc_version", F.lit("")), F.lit(")")))
    c = top.groupBy("qid").agg(F.slice(ordered(block), 1, texts).alias("c"), F.array_sort(F.collect_set(source)).alias("s"))
    line = F.concat(F.lit("("), F.concat_ws(", ", "src_id", "rel_type", "dst_id"), F.lit(")"))
    e = edges.where(F.col("rank") <= triples).groupBy("qid").agg(ordered(line).alias("e"))
    out = questions.select("qid", "method").join(e, "qid", "left").join(c, "qid", "left")
    some = lambda name, form: F.when(F.coalesce(F.size(name), F.lit(0)) > 0, form)
    parts = F.concat_ws(
        "\n", some("e", F.concat_ws("\n", F.lit(rules.TRIPLES_TITLE), F.col("e"), F.lit(""))), some("c", F.concat_ws("\n", F.lit(rules.TEXTS_TITLE), F.col("c"))),
        some("s", F.concat(F.lit(rules.SOURCES_TITLE), F.array_join("s", ", "))),
    )
    return out.select("qid", F.when(F.col("method") == "no_answer", "").otherwise(parts).alias("context"))


def evidence_block(lines: Column, most: int = 8) -> Column:
    """Lines of sources for a prompt, each with a dash; `- (none)` without any."""
    return F.when(F.size(lines) > 0, F.array_join(F.transform(F.slice(lines, 1, most), lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("- (none)")


def prompt(language: Column, kind: Column, question: Column, context: Column, evidence: Column, profile: Column | None = None, history: Column | None = None) -> Column:
    """What a model is asked: role, layout, profile and conversation where there are any, evidence, sources, question."""
    some = lambda c, title: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n[{title}]\n"), c, F.lit("\n"))).otherwise("")
    none = F.lit("")
    return F.concat(
        message(language, rules.ROLES), F.lit("\n"), style(language, kind), F.lit("\n" + rules.CAUTION + "\n"), some(profile if profile is not None else none, rules.PROFILE_TITLE),
        some(history if history is not None else none, rules.HISTORY_TITLE), F.lit(f"\n[{rules.CONTEXT_TITLE}]\n"), context, F.lit(f"\n\n[{rules.EVIDENCE_TITLE}]\n"),
        evidence_block(evidence), F.lit(f"\n\n[{rules.QUESTION_TITLE}]\n"), question, F.lit("\n"),
    )


def refused(method: Column, context: Column, made: Column) -> Column:
    """A model's answer, or the strict refusal: without evidence, without an answer (null: the model failed), and for an
    answer in a script that answers must not have."""
    bad = (method == "no_answer") | (F.coalesce(context, F.lit("")) == "") | (F.coalesce(made, F.lit("")) == "") | has_foreign_script(made)
    return F.when(bad, F.lit(rules.REFUSAL)).otherwise(made)


def answers(questions: DataFrame, generate=None) -> DataFrame:
    """(qid, answer) of questions (qid, question, language, method, context, external).

    Questions without an answer and without anything from the web get the message for that; the others what
    generate(question, context) makes, or the strict refusal, and without a model the context itself."""
    context = with_external(F.col("context"), F.col("external"))
    sorry = message(F.col("language"), rules.NO_EVIDENCE)
    made = F.coalesce(F.nullif(context, F.lit("")), sorry) if generate is None else refused(F.col("method"), context, generate(F.col("question"), context))
    nothing = (F.col("method") == "no_answer") & (F.coalesce(F.col("external"), F.lit("")) == "")
    return questions.select("qid", F.when(nothing, sorry).otherwise(made).alias("answer"))


def with_external(context: Column, external: Column) -> Column:
    """The context with what the web gave below it."""
    web = F.coalesce(external, F.lit(""))
    return F.when(web != "", F.concat(F.coalesce(context, F.lit("")), F.lit("\n\n" + rules.WEB_TITLE + "\n"), web)).otherwise(F.coalesce(context, F.lit("")))


def external(found: DataFrame) -> DataFrame:
    """(qid, external): a line for each of the snippets (qid, rank, title, snippet), by rank."""
    line = F.concat(F.lit("[WEB] "), "title", F.lit(": "), "snippet")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("x")))), lambda s: s["x"])
    return found.groupBy("qid").agg(F.array_join(lines, "\n").alias("external"))


def latency_by_path(log: DataFrame, path: str = "path", value: str = "elapsed_sec") -> DataFrame:
    """(path, n, mean, median, low, high); the median is exact, from the counts of the values in their order."""
    rows = log.select(F.col(path).alias("path"), F.col(value).alias("v"))
    stats = rows.groupBy("path").agg(F.count("*").alias("n"), F.count("v").alias("m"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    upto = F.sum("k").over(Window.partitionBy("path").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    steps = rows.where("v is not null").groupBy("path", "v").agg(F.count("*").alias("k")).withColumn("upto", upto)
    both = steps.join(stats.select("path", "m"), "path")
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    middle = both.groupBy("path").agg(((at(F.floor((F.col("m") - 1) / 2)) + at(F.ceil((F.col("m") - 1) / 2))) / 2).alias("median"))
    return stats.join(middle, "path", "left").select("path", "n", "mean", "median", "low", "high")


#: Size of a quantile sketch: with 800, ranks are right to about half a percent.
SKETCH = 800


def latency_sketches(log: DataFrame, keys: list[str], value: str = "elapsed_sec", k: int = SKETCH) -> DataFrame:
    """(keys, n, m, total, low, high, sketch) of each group of a log: what is kept of a window, and merges with other windows.
    n counts rows, m those with a value. A sketch has a few kilobytes, however many rows there are."""
    v = F.col(value)
    return log.groupBy(*keys).agg(F.count("*").alias("n"), F.count(v).alias("m"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v.cast("double"), k).alias("sketch"))


def latency_from_sketches(kept: DataFrame, path: str = "path", shares: list[float] | None = None) -> DataFrame:
    """(path, n, mean, median, low, high, and `quantiles` of the shares) over kept windows. The median and quantiles are
    values whose rank is off by about half a percent of the rows; latency_by_path() has the exact median. A path
    without values has none."""
    merged = kept.groupBy(F.col(path).alias("path")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))
    at = lambda share: F.when(F.col("m") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(share)))
    return merged.select("path", "n", (F.col("total") / F.nullif("m", F.lit(0))).alias("mean"), at(0.5).alias("median"), "low", "high", F.array(*[at(x) for x in shares or [0.9, 0.99]]).alias("quantiles"))


def latency_sla(log: DataFrame, targets: dict[str, float], path: str = "path", value: str = "elapsed_sec") -> DataFrame:
    """(path, mean, target, met, over) of the paths that have a target."""
    goal = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    rows = log.withColumn("target", F.try_element_at(goal, F.col(path))).where("target is not null")
    out = rows.groupBy(F.col(path).alias("path"), "target").agg(F.avg(value).alias("mean"), F.count_if(F.col(value) > F.col("target")).alias("over"))
    return out.withColumn("met", F.col("mean") <= F.col("target"))


def top_evidence_rate(results: DataFrame, expected: DataFrame, k: int = 3) -> DataFrame:
    """One row: the share of the expected questions (qid, id) of which an expected chunk is among the first k results
    (qid, id, rank)."""
    hit = results.where(F.col("rank") <= k).join(expected.select("qid", "id"), ["qid", "id"], "left_semi").select("qid", F.lit(1).alias("hit")).distinct()
    return expected.select("qid").distinct().join(hit, "qid", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("top_evidence_rate"))


def quality(results: DataFrame) -> DataFrame:
    """One row: share of questions with a source, and share without an answer (qid, method, sources)."""
    return results.agg(F.avg((F.size("sources") > 0).cast("int")).alias("source_rate"), F.avg((F.col("method") == "no_answer").cast("int")).alias("no_answer_rate"))
