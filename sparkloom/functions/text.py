"""Text expressions: cleaning, counting, scoring, labels. Every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import rules


def strip(c: Column) -> Column:
    """Without white space (Unicode's) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s++\z", "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(text: Column, drop_symbols: bool = False) -> Column:
    """Tabs and no-break spaces as spaces, line ends as \\n, at most one space and one empty line in a row."""
    t = F.regexp_replace(F.translate(text, "\t ", "  "), "\r\n?", "\n")
    if drop_symbols:
        t = F.regexp_replace(t, "(?U)" + rules.NOT_PLAIN, "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return strip(t)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """Estimated tokens: words times 1.3, rounded down."""
    return F.floor(F.regexp_count(text, F.lit(r"(?U)\S+")) * F.lit(1.3)).cast("int")


def terms(text: Column) -> Column:
    """Distinct lower-case words of more than one character."""
    return F.array_distinct(F.filter(words(F.lower(text)), lambda w: F.length(w) > 1))


def contains_any(text: Column, found: list[str]) -> Column:
    """Whether a lower-case text has one of the terms; a short list of terms, as an expression."""
    if not found:
        return F.lit(False)
    return F.exists(F.array(*[F.lit(x) for x in found]), lambda x: F.contains(text, x))


def keyword_overlap(text: Column, question: Column, anchors: Column) -> Column:
    """0.6 * share of the anchors that the text contains + 0.4 * share of the question's terms that it has."""
    low = F.lower(text)
    hits = F.size(F.filter(anchors, lambda a: F.contains(low, F.lower(a))))
    anchor = F.when(F.size(anchors) > 0, F.least(hits / F.size(anchors), F.lit(1.0))).otherwise(0.0)
    asked = terms(question)
    shared = F.size(F.array_intersect(asked, terms(text))) / F.greatest(F.size(asked), F.lit(1))
    return 0.6 * anchor + 0.4 * shared


def version_date(version: Column) -> Column:
    """First day of a `YYYY.MM` version; null for anything else."""
    y, m = F.regexp_extract(version, r"^(\d{4})\.(\d{1,2})$", 1), F.regexp_extract(version, r"^(\d{4})\.(\d{1,2})$", 2)
    month = F.when(m != "", m.cast("int"))
    return F.when(month.between(1, 12) & (y != "0000"), F.make_date(F.when(y != "", y.cast("int")), F.when(month.between(1, 12), month), F.lit(1)))


def recency(version: Column, as_of: Column) -> Column:
    """1 for a version of this month, falling to 0 over 24 months of 30 days; 0.5 without a valid version."""
    months = F.greatest(F.lit(0.0), F.datediff(as_of, version_date(version)) / 30)
    return F.coalesce(F.when(version_date(version).isNotNull(), F.greatest(F.lit(0.0), 1 - months / 24)), F.lit(0.5))


def is_stale(version: Column, as_of: Column, days: int = rules.STALE_DAYS) -> Column:
    return F.coalesce(F.datediff(as_of, version_date(version)) >= days, F.lit(False))


def disclaimer(source_file: Column, version: Column) -> Column:
    return F.format_string(rules.DISCLAIMER, source_file, version)


def detect_language(text: Column) -> Column:
    """ko with Hangul, zh with Han alone, en otherwise."""
    return F.when(text.rlike(rules.HANGUL), "ko").when(text.rlike(rules.HAN), "zh").otherwise("en")


def question_type(text: Column, types: dict[str, list[str]] | None = None) -> Column:
    """The first type of which the question contains a term, else general."""
    low, out = F.lower(text), None
    for name, found in (types or rules.QUESTION_TYPES).items():
        out = (F if out is None else out).when(contains_any(low, found), name)
    return out.otherwise("general")


def variants(text: Column, language: Column | None = None, suffixes: dict[str, list[str]] | None = None) -> Column:
    """The normalised question, then itself with each suffix of its language; distinct, in order."""
    suffixes = suffixes or rules.VARIANTS
    base, lang = squeeze(text), language if language is not None else detect_language(text)
    of = lambda xs: F.array(base, *[F.concat(base, F.lit(" " + x)) for x in xs])
    out = of(suffixes["en"])
    for name, xs in suffixes.items():
        if name != "en":
            out = F.when(lang == name, of(xs)).otherwise(out)
    return F.array_distinct(out)


def doc_version(name: Column) -> Column:
    """`YYYY.MM` from the first year and month in a file name, else empty."""
    p = r"(\d{4})[._-](\d{2})"
    return F.when(F.regexp_extract(name, p, 1) != "", F.concat_ws(".", F.regexp_extract(name, p, 1), F.regexp_extract(name, p, 2))).otherwise("")


def section(text: Column, patterns: list[str] | None = None) -> Column:
    """What the first pattern that matches anywhere matches, else empty."""
    hits = [F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns or rules.SECTIONS]
    return F.coalesce(*hits, F.lit(""))


def has_foreign_script(text: Column) -> Column:
    return F.coalesce(text.rlike(rules.FOREIGN_SCRIPT), F.lit(False))


def message(language: Column, texts: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
    return F.coalesce(F.try_element_at(table, language), F.lit(texts["en"]))


def profile_updated(language: Column, profile: Column) -> Column:
    """Confirms a changed user profile in the user's language."""
    return F.replace(message(language, rules.PROFILE_UPDATED), F.lit("%s"), profile)


def style(language: Column, kind: Column) -> Column:
    """How an answer is to be laid out, with a hint for some types of question."""
    hints = F.coalesce(*[F.when(kind == name, message(language, texts)) for name, texts in rules.TYPE_HINTS.items()])
    return F.concat_ws("\n", message(language, rules.STYLES), hints)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def title_from_url(url: Column) -> Column:
    return F.coalesce(host(url), url)


def allowed_host(url: Column, suffixes: str = rules.HOST_SUFFIXES) -> Column:
    """Whether the host is one of the comma-separated suffixes or ends with a dot and one of them."""
    listed = [x.strip().lower().lstrip(".") for x in suffixes.split(",") if x.strip()]
    if not listed:
        return F.lit(False)
    h = host(url)
    return F.coalesce(F.exists(F.array(*[F.lit(x) for x in listed]), lambda s: (h == s) | F.endswith(h, F.concat(F.lit("."), s))), F.lit(False))


def html_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags; the common entities decoded, white space squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return squeeze(t)


def unfence(text: Column) -> Column:
    """A model's reply without the code fence around its JSON."""
    return strip(F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; a zero vector gives 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-10) * (F.sqrt(dot(b, b)) + 1e-10))
