"""Whitening against numpy: tiles of any size, exact sums, vectors of all kinds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import whitening


def table(spark, m):
    return spark.createDataFrame(pd.DataFrame({"vec_id": range(len(m)), "embedding": np.asarray(m, float).tolist()}), "vec_id long, embedding array<double>")


def plain(m, k=32):
    x = np.floor(64 * np.asarray(m, float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, (e > e[0] * 1e-12).sum())
    return ((n * x.astype(object) - s) ** 2).sum(1).tolist(), y @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(got, m, k=32):
    deviation, white, share = plain(m, k)
    g = got.toPandas().sort_values(["vec_id", "component"])
    n, k = white.shape
    assert len(g) == n * k and (g["component"].to_numpy().reshape(n, k) == np.arange(1, k + 1)).all() and (g["n"] == n).all()
    w = g["whitened"].to_numpy().reshape(n, k)
    sign = np.sign((w * white).sum(0))
    assert np.allclose(w, white * sign, rtol=1e-6, atol=1e-8)
    assert g["deviation"].to_numpy().reshape(n, k)[:, 0].tolist() == deviation
    assert np.allclose(g["explained"].to_numpy().reshape(n, k), share, rtol=1e-9)
    error = np.abs((w - w.mean(0)).T @ (w - w.mean(0)) / n - np.eye(k)).max()
    assert g["identity_error"].nunique() == 1 and abs(g["identity_error"].iloc[0] - error) < 1e-9 and error < 1e-8


@pytest.mark.parametrize("tile", [1, 5, 7, 64])
def test_tiles_of_any_size(spark, monkeypatch, tile):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 14 * 13)  # row-blocks of 13 rows
    rng = np.random.default_rng(tile)
    m = rng.normal(size=(200, 14)) @ rng.normal(size=(14, 14))
    check(whitening.whiten(table(spark, m).repartition(5), tile=tile, components=9), m, 9)


def test_registered_query(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    assert e["vec_id"].tolist() == list(range(len(e)))
    check(whitening.op13_embedding_whitening(spark, sf), np.stack(e["embedding"]))


def test_vectors_of_all_kinds(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(60, 4))
    rows = [(i, v) for i, v in enumerate(good.tolist())] + [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, float("nan"), 2.0, 3.0]), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (None, good[0].tolist()), (None, good[0].tolist()), (5, good[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("own") for c in ("key", "x", "n", "component", "deviation", "i")})
    out = whitening.whiten(df)
    assert out.select("vec_id").distinct().count() == 61 and out.count() == 63 * 4 and {r.n for r in out.select("n").distinct().collect()} == {63}
    twice = out.where("vec_id is null or vec_id = 0").groupBy("component").agg(F.count("*").alias("n"), (F.max("whitened") - F.min("whitened")).alias("d")).collect()
    assert all(r.n == 3 and r.d == 0 for r in twice)


def test_few_equal_and_no_vectors(spark):
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 5)).isEmpty() and whitening.whiten(table(spark, [[1.0, 2.0]])).isEmpty()
    empty = whitening.whiten(table(spark, [[1.0, 2.0]]).where("false"))
    assert empty.isEmpty() and [f.name for f in empty.schema] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    m = np.random.default_rng(2).normal(size=(3, 6))  # three vectors span two components
    check(whitening.whiten(table(spark, m)), m)


def test_sums_and_squares_beyond_longs():
    big = np.array([[1 << 53, 5], [-(1 << 53), 7]])
    n, sums = 1 << 20, np.array([0, 12], dtype=object)
    exact = whitening.distances(big, n, sums)
    assert exact.tolist() == [[n * (1 << 53), 5 * n - 12], [-n * (1 << 53), 7 * n - 12]]
    assert whitening.squares(exact) == [None, None] and whitening.squares(np.array([[3, 4]])) == [25]
    assert whitening.squares(np.array([[1 << 31, 1 << 31], [1, 0]])) == [None, 1]


def test_huge_components_are_held(spark):
    df = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, -1.0])], "vec_id long, embedding array<double>")
    found = {r.key: list(r.x) for r in whitening.whole_vectors(df, "vec_id", "embedding").collect()}
    assert found[0][0] == (1 << 53) + 1_000_000 and found[1][0] == -(1 << 53) + 1_000_000 and found[2] == [1_000_000, 999_936]
    assert whitening.column_sums(spark.createDataFrame([([1 << 53],)] * 4000, "x array<long>"), 1) == [4000 * (1 << 53)]
