"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every shuffled document gets a virtual finish time: the tokens of its source up to and including it,
divided by the source's target. The mix is the documents in order of that time, cut at the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, documents, stash

#: Weights by rank of the source in code-point order, repeating; null sources come last.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all tokens; a source is repeated at most so often.
BUDGET, MAX_REPEATS = 1.5, 2
#: The shuffle key is cut into 16 ** HEX ranges and a unit of virtual time into SLICES. Sums per range are
#: small tables; rows meet only within a range.
HEX, SLICES = 3, 65536


def token_count(text: Column) -> Column:
    """Number of words of a text; none in null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MAX_REPEATS) -> DataFrame:
    """Add `target` to (source, source_size): the budget shared by weight, no source above `most` times
    its size, the excess shared again by weight until none is above.

    In order of size / weight the capped sources come first, so the water level follows from running sums:
    source k stays capped while its cap is below what the rest would get. One row per source.
    """
    one = F.lit(0)
    order = Window.partitionBy(one).orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    w = w.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    ranked = Window.partitionBy(one).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(one)
    rest = F.lit(budget) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = rest / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # after the first source that is not capped, all have its level
    w = w.withColumn("first", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(all_)["level"])
    goal = F.when(F.col("capped") | F.col("first").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("first") * F.col("weight")))
    return w.select("source", "source_size", goal.alias("target"))


def order_key(*cols: Column, seed: int = 7) -> Column:
    """A pseudo-random hexadecimal key that depends on the seed and the values alone."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", weights=WEIGHTS, budget: float = BUDGET, most: int = MAX_REPEATS, seed: int = 7) -> DataFrame:
    """(key, source, size) of every row with source_size, target and `repeats`, how often the mix takes the row.

    Rows are whole, so the mix ends below the budget by less than one row; rows of size 0 are never
    taken. A null source is a source. Null keys and repeated rows keep their place by (key, size).
    An empty table gives an empty one; other columns are left out, so clashing names do no harm.

    The prefix sums are two-level: sums per range of the shuffle key, then a window inside a range,
    so a source with most of the rows is spread over all ranges.
    """
    rows = stash(df.select(F.col(key), F.col(source).alias("source"), F.col(size).cast("long").alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, budget, most)
    r = rows.withColumn("_h", order_key(F.col(key), F.col("size"), seed=seed))
    r = r.withColumn("_r", F.substring("_h", 1, HEX))
    sums = r.groupBy("source", "_r").agg(F.sum("size").alias("_n"))
    run = Window.partitionBy("source").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0))).drop("_n")
    inside = Window.partitionBy("source", "_r").orderBy("_h", key, "size").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_cum", F.sum("size").over(inside))
    sums, plan = sums.withColumnsRenamed({"source": "_s1", "_r": "_r1"}), plan.withColumnRenamed("source", "_s2")
    r = r.join(sums, F.col("source").eqNullSafe(F.col("_s1")) & F.col("_r").eqNullSafe(F.col("_r1"))).drop("_s1", "_r1")
    r = r.join(plan, F.col("source").eqNullSafe(F.col("_s2"))).drop("_s2")
    # a queue entry for each repeat, with its virtual finish time; the budget ends near time 1
    times = F.array(*[F.try_divide(F.col("_cum") + F.col("_before") + F.lit(e) * F.col("source_size"), F.col("target")) for e in range(most)])
    r = stash(r.withColumn("_times", F.when(F.col("size") > 0, times).otherwise(F.array().cast("array<double>"))).drop("_cum", "_before", "_r"))
    queue = r.select("_h", "size", F.explode("_times").alias("_v")).withColumn("_b", F.least(F.floor(F.col("_v") * SLICES), F.lit(4 * SLICES)))
    slices = queue.groupBy("_b").agg(F.sum("size").alias("_n"))
    slices = slices.withColumn("_end", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b")))
    total = budget * (sizes.agg(F.sum("source_size")).first()[0] or 0)
    over = slices.where(F.col("_end") > total).orderBy("_b").limit(1).first()
    if over is None:
        return r.select(key, "source", "size", "source_size", "target", F.size("_times").alias("repeats"))
    # only the slice in which the budget runs out is put in order row by row
    w = Window.partitionBy("_b").orderBy("_v", "_h").rowsBetween(Window.unboundedPreceding, 0)
    last = queue.where(F.col("_b") == over["_b"]).withColumn("_w", F.sum("size").over(w))
    cut = last.where(F.col("_w") <= total - over["_end"] + over["_n"]).agg(F.max(F.struct("_v", "_h"))).first()[0]
    inside_cut = lambda v: F.floor(v * SLICES) < F.lit(over["_b"])
    if cut is not None:
        first = inside_cut
        inside_cut = lambda v: first(v) | (v < F.lit(cut["_v"])) | ((v == F.lit(cut["_v"])) & (F.col("_h") <= F.lit(cut["_h"])))
    return r.select(key, "source", "size", "source_size", "target", F.size(F.filter("_times", inside_cut)).alias("repeats"))


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "source", token_count(F.col("text")).alias("size"))
    m = mix(d)
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


OP10_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
t as (select *, 2.0::double * source_size as cap, sum(source_size) over () as n,
        case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s),
u as (select *, (1.5::double * n - coalesce(sum(cap) over b, 0.0::double)) / (sum(weight) over () - coalesce(sum(weight) over b, 0.0::double)) as level from t
      window b as (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding)),
f as (select level as first_level from u where cap > level * weight order by cap / weight limit 1),
p as (select source, source_size, case when cap <= level * weight or (select count(*) from f) = 0 then cap
        else least(cap, (select first_level from f) * weight) end as target from u),
h as (select d.*, md5('7|' || coalesce(doc_id::varchar, 'null') || '|' || size) as h from d),
c as (select h.*, p.source_size, p.target,
        sum(size) over (partition by h.source order by h, doc_id, size rows between unbounded preceding and current row)::bigint as cum
      from h join p on h.source is not distinct from p.source),
q as (select c.*, (cum + e * source_size) / target as v from c, (values (0), (1)) x(e) where size > 0),
w as (select *, sum(size) over (order by v, h rows between unbounded preceding and current row) as run from q),
g as (select doc_id, count(*) as k from w where run <= 1.5::double * (select sum(size) from d) group by doc_id)
select c.doc_id, c.size, c.source_size, c.target, c.size * coalesce(g.k, 0) as taken from c left join g on c.doc_id = g.doc_id
"""
