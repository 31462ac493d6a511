"""Sharding: a uniform random permutation with exact shard sizes.

Rows are dealt to blocks. A communication matrix says how many rows each block sends to each shard: its
rows are drawn without replacement (multivariate hypergeometric) from what the shards still hold, which
is the law that a uniform permutation gives. Every block is permuted, cut by its row of the matrix and
sent; every shard is permuted again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import documents, prefix, stash

#: Rows in a block, or in a range of a shard, on average: what one task sorts at once.
BLOCK_ROWS = 200_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good + bad are good: inverse transform around the mode.

    The window of 12 standard deviations holds all but 1e-30 of the mass, so any table size works.
    """
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (total + 2)))
    sd = (n * (good / total) * (bad / total) * (total - n) / max(1, total - 1)) ** 0.5
    a, b = max(lo, int(mode - 12 * sd - 40)), min(hi, int(mode + 12 * sd + 40))
    k = np.arange(a, b, dtype=float)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    log = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(log - log.max())
    return a + int(np.searchsorted(np.cumsum(p) / p.sum(), rng.random()))


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """blocks x shards counts with these row and column sums, as a uniform permutation gives them."""
    rng, left, out = np.random.default_rng(seed), list(shards), []
    for n in blocks:
        row, rest = [], sum(left)
        for j, have in enumerate(left):
            x = hypergeometric(rng, have, rest - have, n)
            row.append(x)
            n, rest, left[j] = n - x, rest - have, have - x
        out.append(row)
    return out


def shard(df: DataFrame, key: list[str], n_shards: int, seed: int = 11, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with `shard` (0 .. n_shards - 1) and `slot` (gapless from 0 in each shard); counts differ by one at most.

    key: columns that tell rows apart; rows equal in all of them are interchangeable and meet in one block, so the
    key is to have no value that many rows share. Null keys are values like any other. An empty table gives an empty
    one. Existing shard and slot are replaced, all other columns stay. Everything depends on keys, seed and the
    number of rows, so reruns and lost executors change nothing. A uniform shuffle does not keep together rows that
    have more in common than chance: equal texts under different keys go to shards of their own.
    """
    df = df.drop("shard", "slot")
    columns, own = df.columns, prefix(df)
    block, place, ends, draw2, span, before, inside = (own + x for x in ("block", "place", "ends", "draw", "span", "before", "inside"))
    draw = lambda k: F.xxhash64(F.lit(seed * 10 + k), *key)
    rows = df.count()
    n_blocks = max(1, -(-rows // block_rows))
    df = df.withColumn(block, F.pmod(draw(0), F.lit(n_blocks)).cast("int"))
    counts = dict(df.groupBy(block).count().collect())  # a number for each block
    blocks = [counts.get(b, 0) for b in range(n_blocks)]
    matrix = communication_matrix(blocks, [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)], seed)
    cuts = df.sparkSession.createDataFrame([(b, np.cumsum(row).tolist()) for b, row in enumerate(matrix)], f"{block} int, {ends} array<long>")
    # permute locally and cut; the matrix has one short row for each block_rows rows
    local = Window.partitionBy(block).orderBy(draw(1), *key)
    out = df.withColumn(place, F.row_number().over(local)).join(cuts, block)
    out = out.withColumn("shard", F.size(F.filter(ends, lambda e: e < F.col(place))))
    # permute each shard: ranges of a second draw in order, and a sort inside a range
    per_shard = max(1, -(-rows // (block_rows * n_shards)))
    share = F.shiftrightunsigned(draw2, 11) / F.lit(float(1 << 53))
    out = stash(out.withColumn(draw2, draw(2)).withColumn(span, F.floor(share * per_shard).cast("int")).select(*columns, "shard", draw2, span))
    sizes = out.groupBy("shard", span).agg(F.count("*").alias(before))
    upto = Window.partitionBy("shard").orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum(before).over(upto), F.lit(0)))
    own_place = F.row_number().over(Window.partitionBy("shard", span).orderBy(draw2, *key))
    out = out.withColumn(inside, own_place).join(sizes, ["shard", span])
    return out.select(*columns, "shard", (F.col(before) + F.col(inside) - 1).cast("long").alias("slot"))


def write_shards(df: DataFrame, placed: DataFrame, key: str, path: str, part_rows: int = 1_000_000) -> None:
    """Write whole rows of df as folders shard=S/part=P, P counting runs of part_rows slots, each in slot order: so a
    task writes a part, however large a shard is. placed has key, which is unique, shard and slot."""
    placed = placed.select(key, "shard", "slot")
    out = df.drop("shard", "slot", "part").join(placed, key).withColumn("part", F.expr(f"slot div {part_rows}"))
    out.repartition("shard", "part").sortWithinPartitions("shard", "part", "slot").write.partitionBy("shard", "part").parquet(path)


def op3_shard_documents(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    d = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard(d, ["doc_id", "size", "text_crc32"], 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
