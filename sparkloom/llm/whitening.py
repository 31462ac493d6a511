"""Whitening of embeddings: covariance by tiles of dimension pairs, principal components, projection.

Dimensions are cut into blocks of TILE; a tile is a pair of blocks. Rows are cut into row-blocks, of which every tile gets
the one or two column blocks it needs; a task multiplies them, adds up what it has of one tile after the other, and the
rows of the tiles are summed. So no task holds more than a tile and a row-block, however many dimensions there are, until
the driver puts the covariance together for its eigenvectors: dimensions squared, whatever the number of rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stash

#: Dimensions of a block, and bytes of a row-block over all dimensions.
TILE, BLOCK_BYTES = 256, 1 << 21
#: Components c become floor(SCALE * c) + SHIFT; SCALE * c is held within LARGEST, up to which doubles are whole.
SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 53)
#: Eigenvalues below this share of the largest are rounding: such components have no variance to divide by.
NOTHING = 1e-12

Matrix = np.ndarray


def stacked(batches: Iterator[pd.DataFrame], rows: int, column: str = "x") -> Iterator[tuple[pd.DataFrame, Matrix]]:
    """(rows, their vectors as a matrix) of at most `rows` rows."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            part = batch.iloc[lo : lo + rows]
            yield part, np.stack(part[column].to_numpy())


def whole_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x) of the vectors that have entries and no null or non-finite ones, as whole numbers."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long") + SHIFT
    return rows.where((F.size(vector) > 0) & good).select(F.col(key).alias("key"), F.transform(v, held).alias("x"))


def column_sums(rows: DataFrame, d: int) -> list[int | float]:
    """Sum of each of the d columns of x. Long columns are summed exactly, in two halves."""
    exact = rows.schema["x"].dataType.elementType.simpleString() == "bigint"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64 if exact else float)
        for _, m in stacked(batches, max(1, BLOCK_BYTES // (8 * d))):
            if exact:
                high += (m >> 20).sum(axis=0)
                m = m & ((1 << 20) - 1)
            low += m.sum(axis=0)
        yield pd.DataFrame({"dim": np.arange(d), "high": high, "low": low})

    parts = rows.select("x").mapInPandas(add, f"dim int, high long, low {'long' if exact else 'double'}")
    total = parts.groupBy("dim").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)") if exact else F.col("low")).alias("low"))
    got = {r.dim: (int(r.high) << 20) + (int(r.low) if exact else r.low) for r in total.collect()}  # a row for each dimension
    return [got[i] for i in range(d)]


def covariance(rows: DataFrame, d: int, n: int, centred: Callable[[Matrix], Matrix], tile: int = TILE) -> Matrix:
    """The covariance, divisor n, of the vectors centred(x) of all n rows (x), which have d entries and mean zero."""
    blocks = -(-d // tile)
    pairs = list(itertools.combinations_with_replacement(range(blocks), 2))
    spark = rows.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // len(pairs))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for k, (_, m) in enumerate(stacked(batches, max(1, BLOCK_BYTES // (8 * d)))):
            cut = [np.ascontiguousarray(x) for x in np.split(centred(m), range(tile, d, tile), axis=1)]
            for t, (i, j) in enumerate(pairs):
                right = cut[j].tobytes() if i != j else None
                yield pd.DataFrame([(t, (task + k) % buckets, len(m), f"{task}-{k}", cut[i].tobytes(), right)], columns=sent)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None

        def close() -> pd.DataFrame:
            return pd.DataFrame({"tile": at, "line": np.arange(len(total)), "task": TaskContext.get().partitionId(), "sums": list(total)})

        for batch in batches:
            for t, _, count, _, left, right in batch.itertuples(index=False, name=None):
                a = np.frombuffer(left).reshape(count, -1)
                product = a.T @ (a if right is None else np.frombuffer(right).reshape(count, -1))
                if at is not None and at != t:
                    yield close()
                at, total = t, product if at != t else total + product
        if at is not None:
            yield close()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for t, line, _, sums in batch.itertuples(index=False, name=None):
                if held and held[-1][:2] == (t, line):
                    held[-1] = (t, line, held[-1][2] + sums)
                    continue
                if len(held) > 1000:
                    yield pd.DataFrame(held[:-1], columns=["tile", "line", "sums"])
                    del held[:-1]
                held.append((t, line, sums))
        yield pd.DataFrame(held, columns=["tile", "line", "sums"])

    sent = ["tile", "bucket", "count", "block", "left", "right"]
    cut = rows.select("x").mapInPandas(send, "tile int, bucket int, count int, block string, left binary, right binary")
    cut = cut.repartition(len(pairs) * buckets, "tile", "bucket").sortWithinPartitions("tile", "block")
    lines = cut.mapInPandas(multiply, "tile int, line int, task int, sums array<double>")
    lines = lines.repartition("tile", "line").sortWithinPartitions("tile", "line", "task").mapInPandas(add, "tile int, line int, sums array<double>")
    out = np.zeros((d, d))
    for t, line, sums in lines.collect():  # half of dimensions x dimensions
        i, j = pairs[t]
        out[i * tile + line, j * tile : j * tile + len(sums)] = sums
        out[j * tile : j * tile + len(sums), i * tile + line] = sums
    return out / n


def distances(m: Matrix, n: int, sums: Matrix) -> Matrix:
    """n * m - sums, exactly: as longs where they fit, as Python's whole numbers where not."""
    most = n * max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) + max(abs(int(s)) for s in sums)
    kind = np.int64 if most < 1 << 62 else object
    return m.astype(kind) * n - sums.astype(kind)


def squares(exact: Matrix) -> list[int | None]:
    """Sum of squares of each row; None where it is no long."""
    most = int(abs(exact).max(initial=0))
    if exact.dtype == object or most * most * exact.shape[1] >= 1 << 63:
        exact = exact.astype(object)
    return [int(s) if s < 1 << 63 else None for s in (exact * exact).sum(axis=1)]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32, tile: int = TILE) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every vector and principal component.

    Vectors that are null, empty, or hold null or non-finite entries take no part, nor do those that have another length
    than most have (of lengths equally frequent, the longer counts). The n others become whole numbers x; S are their sums
    by dimension. deviation is the sum of (n * x - S)^2, null where that is no long. Components are the eigenvectors of the
    covariance by falling eigenvalue, at most `components`; whitened is (x - S / n) along one, over the root of its
    eigenvalue, explained the eigenvalue's share of the trace. Components without variance are left out: with few or
    equal vectors there are fewer, with one vector or none there is no row. identity_error is the largest entry of
    the covariance of whitened minus the identity. Rows stand alone: repeated ones and null keys stay.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = stash(whole_vectors(rows, key, vector))
    length = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    d, n = length
    found = found.where(F.size("x") == d)
    sums = np.array(column_sums(found, d), dtype=object)
    v = covariance(found, d, n, lambda m: distances(m, n, sums).astype(float) / n, tile)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = int(min(components, (values > max(values[0], 0) * NOTHING).sum()))
    if not k:
        return spark.createDataFrame([], schema)
    onto = spark.sparkContext.broadcast(axes[:, :k] / np.sqrt(values[:k]))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, m in stacked(batches, max(1, BLOCK_BYTES // (8 * d))):
            exact = distances(m, n, sums)
            yield pd.DataFrame({"key": part["key"], "deviation": pd.array(squares(exact), dtype="Int64"), "x": list(exact.astype(float) / n @ onto.value)})

    white = stash(found.mapInPandas(project, f"key {kind}, deviation long, x array<double>"))
    mean = np.array(column_sums(white, k)) / n
    error = float(np.abs(covariance(white, k, n, lambda m: m - mean, tile) - np.eye(k)).max())
    share = F.array(*[F.lit(float(x)) for x in values[:k] / np.trace(v)])
    out = white.select(F.col("key").alias(key), "deviation", F.posexplode("x").alias("i", "whitened"))
    return out.select(key, (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
