"""Vector operators against brute force: recall over many rows, ties, repeated and null keys, blocks that never meet."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import linked_classes

from sparkloom.llm import vectors


def frame(spark, v, ids=None):
    ids = np.arange(len(v)) if ids is None else np.array(ids)
    rows = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))})
    return spark.createDataFrame(rows)


def many(kind, n=20_000, d=32):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "lengths":
        v *= rng.lognormal(size=(n, 1))
    if kind == "clusters":
        v = v[rng.integers(0, 50, n)] + 0.1 * v
    return v.astype(np.float32).astype(float)


def recall_of(df, v, **more):
    got = collections.defaultdict(list)
    for r in vectors.nearest(df, df.where("vec_id % 20 = 0"), **more).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    queries = np.arange(0, len(v), 20)
    score = v[queries] @ v.T
    score[np.arange(len(queries)), queries] = -np.inf
    worst = -np.sort(-score, axis=1)[:, 19]
    hits = 0
    for q, row, least in zip(queries, score, worst, strict=True):
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, 21)) and len({x[1] for x in mine}) == 20
        assert mine == sorted(mine, key=lambda x: (-x[2], x[1])) and all(abs(row[n] - s) < 1e-9 for _, n, s in mine)
        hits += sum(s >= least - 1e-9 for _, _, s in mine)
    return hits / len(queries) / 20


@pytest.mark.parametrize("kind", ["unit", "lengths", "clusters"])
def test_recall_over_many_rows(spark, kind):
    v = many(kind)
    assert recall_of(frame(spark, v), v, shard_rows=3000) >= 0.95


def test_factor_one_is_exact_over_cells_and_shards(spark):
    v = many("clusters", 4000, 16)
    assert recall_of(frame(spark, v), v, relax=1.0, shard_rows=500, query_rows=64) == 1.0


def test_ties_go_to_smaller_keys(spark):
    v = np.zeros((200, 8))
    v[:, 0] = 1
    v[np.arange(1, 200), 1 + np.arange(1, 200) % 7] = np.arange(1, 200) / 256
    got = vectors.nearest(frame(spark, v, np.arange(200)), frame(spark, v[:1], [0]), relax=1.0, shard_rows=64).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21)) and {r.score for r in got} == {1.0}


def test_repeated_and_null_keys(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [1.0, 0.1], "x"), (2, [0.0, 1.0], "x"), (None, [1.0, 0.0], "x"), (3, [0.9, 0.1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").withColumn("score", F.lit("x")).withColumn("cell", F.lit(0))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vectors.nearest(df, df, k=5).collect()}
    # the smaller of two vectors stands for key 2
    assert got == {(1, 1): (3, 0.9), (1, 2): (2, 0.0), (2, 1): (3, 0.1), (2, 2): (1, 0.0), (3, 1): (1, 0.9), (3, 2): (2, 0.1)}
    near = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert near == [(0, 0, None, True), (1, 3, 1, True), (1, 3, 1, True), (2, 0, 2, True), (2, 3, 1, False), (3, 3, 1, False)]


@pytest.mark.parametrize("kind", ["unit", "clusters"])
def test_links_over_many_blocks(spark, kind):
    v = many(kind, 3000, 16)
    v[2000:2300] = v[:300] + 0.02
    v = v.astype(np.float32).astype(float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    classes = linked_classes(range(len(v)), zip(*np.nonzero(np.triu(link)), strict=True))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(frame(spark, v), block_rows=150).collect()}
    assert got == {i: (int(link[i].sum()), classes[i]) for i in range(len(v))}


def test_far_blocks_do_not_meet(spark):
    v = many("clusters", 3000, 16)
    df = frame(spark, v).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(1).cast("long").alias("n"))
    axes = vectors.principal_axes(df, "v", 32)
    _, boxes = vectors.blocks_of(df, axes, 150)
    n, met = boxes.count(), vectors.block_pairs(boxes, 0.9).count()
    assert n >= 20 and n <= met < n * (n + 1) / 4
