"""Embedding operators: near-duplicates by tiled comparison along principal axes, and nearest neighbours
by vantage-point trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import components, stash

#: Rows that axes and splits are fitted on, about so many by hash; any axes and splits give the same links.
SAMPLE_ROWS = 8192
#: Rows of a block; two blocks meet in a task. Rows of a tile inside it, the share of axes summed first, and the
#: pivots whose distances bound a block.
BLOCK_ROWS, TILE, LEADING, BOX = 8192, 1024, 4, 32
#: Float32 products within this of the threshold are settled in double precision on the original vectors.
MARGIN = 1e-4

#: Rows of a shard, each with a tree of its own, rows of a leaf, and queries searched in a tree at once.
SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 65_536, 256, 16_384
#: The most cells that the first splits cut all rows into; a cell has one shard or more. Scores held at once.
CELLS, SCORES = 256, 1 << 22
#: Rows with a vector that a task hands on at once.
SENT_ROWS = 4096
#: A subtree is skipped if its least distance times a factor exceeds the distance of the k-th found; 1 is exact.
#: Unless it is given, the factor is the largest of FACTORS with which about TRIALS sampled queries find WANTED of
#: their neighbours in the index.
FACTORS, TRIALS, WANTED = (16.0, 12.0, 10.0, 8.0, 7.0, 6.0, 5.5, 5.0, 4.5, 4.0, 3.5, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.1, 1.0), 256, 0.975


def usable(v: Column) -> Column:
    """Vectors with components, all finite, that are not zero."""
    x = v.cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(x, lambda c: c != 0), F.lit(False))


def sampled(rows: DataFrame, count: int, most: int, column: str = "v") -> DataFrame:
    """About `most` rows by a hash of a column, all if there are fewer."""
    return rows.where(F.pmod(F.xxhash64(F.lit(7), column), F.lit(max(1, -(-count // most)))) == 0)


def units(v: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    m = np.stack([np.asarray(e, dtype=float) for e in v])
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class Axes:
    """Principal axes of vectors of one length, and cells around pivots: rows of the sample far from one another."""

    def __init__(self, sample: np.ndarray, cells: int):
        _, axes = np.linalg.eigh(sample.T @ sample)
        self.axes = axes[:, ::-1]
        at, far = [0], 1 - sample @ sample[0]
        while len(at) < cells and far.max() > 0:
            at.append(int(far.argmax()))
            far = np.minimum(far, 1 - sample @ sample[at[-1]])
        self.pivots = sample[at]

    def place(self, units_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest pivot, distances to the first BOX pivots) of unit vectors."""
        d = np.sqrt(np.maximum(0, 2 - 2 * units_ @ self.pivots.T))
        box = np.zeros((len(d), BOX))
        box[:, : min(BOX, d.shape[1])] = d[:, :BOX]
        return d.argmin(1), box


def principal_axes(sample: DataFrame, column: str, cells: int) -> dict[int, Axes]:
    """Axes and pivots for each vector length of a bounded sample."""
    found = sample.select(column).toPandas()[column]
    by = {}
    for x in found:
        by.setdefault(len(x), []).append(x)
    return {d: Axes(units(pd.Series(v)), cells) for d, v in by.items()}


class Forest:
    """Union-find over row numbers, by whole arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.parent[a], self.parent[b]
            apart = x != y
            if not apart.any():
                return
            np.minimum.at(self.parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (self.parent != self.parent[self.parent]).any():
                self.parent = self.parent[self.parent]


def close_pairs(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows with cosine >= threshold. ra, rb: unit vectors on the principal axes.

    The products of the leading axes plus the product of the norms of what is left bound the cosine, so
    most pairs end there; the others sum the next axes, up to the last.
    """
    d = ra.shape[1]
    cuts = sorted({max(1, d // LEADING), max(1, d // 2), d})
    rest = lambda r, k: np.linalg.norm(r[:, k:], axis=1).astype(np.float32)
    k = cuts[0]
    least = threshold - MARGIN
    bound = np.column_stack([ra[:, :k], rest(ra, k)]) @ np.column_stack([rb[:, :k], rest(rb, k)]).T
    i, j = np.nonzero(bound >= least)
    product = bound[i, j] - rest(ra, k)[i] * rest(rb, k)[j]
    for k, after in zip(cuts, cuts[1:], strict=False):
        product = product + np.einsum("nd,nd->n", ra[i, k:after], rb[j, k:after])
        alive = product + rest(ra, after)[i] * rest(rb, after)[j] >= least
        i, j, product = i[alive], j[alive], product[alive]
    near = np.flatnonzero(product < threshold + MARGIN)
    x, y = a[i[near]], b[j[near]]
    exact = np.einsum("nd,nd->n", x, y) / (np.sqrt(np.einsum("nd,nd->n", x, x)) * np.sqrt(np.einsum("nd,nd->n", y, y)))
    keep = np.ones(len(i), bool)
    keep[near] = exact >= threshold
    return i[keep], j[keep]


def compare_blocks(rows: pd.DataFrame, axes: dict[int, Axes], threshold: float) -> pd.DataFrame:
    """Links between the rows of block x and block y (or within a block): id, links with weights, root in this pair."""
    x, y = int(rows["x"].iloc[0]), int(rows["y"].iloc[0])
    ids, weight, block = rows["id"].to_numpy(), rows["n"].to_numpy(), rows["block"].to_numpy()
    order = np.lexsort((ids, block))
    ids, weight, block = ids[order], weight[order], block[order]
    v = np.stack([np.asarray(e, dtype=float) for e in rows["v"]])[order]
    r = (units(rows["v"])[order] @ (axes[v.shape[1]].axes if v.shape[1] in axes else np.eye(v.shape[1]))).astype(np.float32)
    left = np.flatnonzero(block == x)
    right = left if x == y else np.flatnonzero(block == y)
    links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
    for s in range(0, len(left), TILE):
        for t in range(s if x == y else 0, len(right), TILE):
            p, q = left[s : s + TILE], right[t : t + TILE]
            i, j = close_pairs(v[p], v[q], r[p], r[q], threshold)
            i, j = p[i], q[j]
            if x == y and s == t:
                i, j = i[i < j], j[i < j]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            forest.join(i, j)
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, forest.parent, ids)
    hit = links > 0
    return pd.DataFrame({"id": ids[hit], "links": links[hit], "root": low[forest.parent][hit]})


def blocks_of(classes: DataFrame, axes: dict[int, Axes], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(classes with d, block; box of each block): blocks are cells around pivots, dealt by hash where they are large.
    A box has the ranges of the distances from its unit vectors to the first pivots."""

    def place(batches):
        for rows in batches:
            for d, part in rows.groupby(rows["v"].map(len)):
                cell, box = axes[d].place(units(part["v"])) if d in axes else (0, np.zeros((len(part), BOX)))
                yield part.assign(d=np.int32(d), cell=cell, box=list(box))

    kind = classes.schema["v"].dataType.simpleString()
    placed = stash(classes.select("v", "id", "n").mapInPandas(place, f"v {kind}, id long, n long, d int, cell long, box array<double>"))
    # as many rows as there are cells of all lengths
    deals = placed.groupBy("d", "cell").agg(F.ceil(F.count("*") / block_rows).alias("deals"))
    dealt = placed.join(deals, ["d", "cell"]).withColumn("block", F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("id", "v"), F.col("deals")))
    ends = [f(F.col("box")[i]).alias(f"{name}{i}") for i in range(BOX) for name, f in (("low", F.min), ("high", F.max))]
    return dealt, dealt.groupBy("d", "block").agg(*ends)


def block_pairs(boxes: DataFrame, threshold: float) -> DataFrame:
    """(d, x, y), x <= y: blocks whose boxes are near enough to hold a link. Those of unit vectors with cosine >= t are
    at most sqrt(2 - 2t) apart, and their distances to a pivot differ by no more: blocks meet in bins of that width."""
    far = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + MARGIN
    bins = F.explode(F.sequence(F.floor(F.col("low0") / far), F.floor((F.col("high0") + far) / far)))
    binned = boxes.withColumn("bin", bins)
    x, y = binned.alias("x"), binned.alias("y")
    gap = [F.greatest(F.lit(0.0), F.col(f"x.low{i}") - F.col(f"y.high{i}"), F.col(f"y.low{i}") - F.col(f"x.high{i}")) for i in range(BOX)]
    near = F.greatest(*gap) <= far
    met = x.join(y, (F.col("x.d") == F.col("y.d")) & (F.col("x.bin") == F.col("y.bin")) & (F.col("x.block") <= F.col("y.block")) & near)
    return met.select(F.col("x.d").alias("d"), F.col("x.block").alias("x"), F.col("y.block").alias("y")).distinct()


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; links are pairs with cosine >= threshold.

    Equal vectors are compared once and counted as often as they occur. Blocks are cells around pivots, and only those
    meet whose ranges of distances to these are near enough. A pair of blocks emits, for each row, its number of links
    and one root, never the pairs. Vectors that are null, empty, zero or hold null or non-finite components have no
    links, nor have vectors of different lengths. Each row counts, also where rows share a key; a row with a null key
    takes no part: n_links 0, component_id null, kept. Other columns are not read.
    """
    all_ = df.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    part = usable(F.col("v")) & F.col("id").isNotNull()
    good = all_.where(part).withColumn("h", F.xxhash64("v"))
    classes = good.groupBy("h", "v").agg(F.min("id").alias("name"), F.count("*").alias("n"))
    classes = stash(classes.withColumn("id", F.monotonically_increasing_id()))
    count = classes.count()
    axes = principal_axes(sampled(classes, count, SAMPLE_ROWS), "v", min(CELLS, -(-count // block_rows)))
    dealt, boxes = blocks_of(classes, axes, block_rows)
    dealt, boxes = stash(dealt.select("id", "n", "v", "d", "block")), stash(boxes)
    pairs = stash(block_pairs(boxes, threshold))
    sides = pairs.select("d", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    met = dealt.join(sides, ["d", "block"])
    found = stash(met.groupBy("d", "x", "y").applyInPandas(lambda rows: compare_blocks(rows, axes, threshold), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "of")
    told = classes.join(links, "id", "left").join(groups, F.col("id") == F.col("of"), "left").withColumn("c", F.coalesce("component", "id"))
    least = told.groupBy("c").agg(F.min("name").alias("component_id"))
    told = told.join(least, "c").select(F.col("h").alias("h2"), F.col("v").alias("v2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # equal vectors may be many: the join goes by hash and value, and can be split
    own = good.join(told, (F.col("h") == F.col("h2")) & (F.col("v") == F.col("v2"))).select("id", "n_links", "component_id")
    rest = all_.where(~part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return own.unionByName(rest).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_embedding_near_dups(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def lift(v: np.ndarray, radius: float) -> np.ndarray:
    """Vectors with one more component, which makes all as long as the longest, so that the largest inner product with
    a query is the smallest distance to it."""
    return np.column_stack([v, np.sqrt(np.maximum(0, radius**2 - np.einsum("nd,nd->n", v, v)))])


def stacked(v: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(e, dtype=float) for e in v])


def grow_tree(rows: pd.DataFrame, radius: float, leaf_rows: int = LEAF_ROWS) -> pd.DataFrame:
    """Vantage-point tree of one shard as rows: inner nodes (vantage point, distance range of each child)
    and leaves (packed vectors and keys). Distances are between lifted vectors."""
    ids = np.array(rows["id"].to_list() + [None], dtype=object)[:-1]
    v = stacked(rows["v"])
    lifted = lift(v, radius)
    rng, out, todo = np.random.default_rng(len(v)), [], [(0, np.argsort([x[0] for x in ids], kind="stable"))]
    while todo:
        node, at = todo.pop()
        inner = len(at) > leaf_rows
        if inner:
            point = lifted[at[rng.integers(len(at))]]
            d = np.linalg.norm(lifted[at] - point, axis=1)
            near = d <= np.median(d)
            inner = not near.all()
        if inner:
            out.append((node, point.tobytes(), [float(f(d[s])) for s in (near, ~near) for f in (np.min, np.max)], None, None))
            todo += [(2 * node + 1, at[near]), (2 * node + 2, at[~near])]
        else:
            out.append((node, None, None, v[at].tobytes(), [list(map(int, ids[i])) for i in at]))
    shard = int(rows["shard"].iloc[0])
    return pd.DataFrame(out, columns=["node", "point", "ranges", "leaf", "ids"]).assign(shard=shard)


TREE = "node long, point binary, ranges array<double>, leaf binary, ids array<array<long>>, shard long"


class Search:
    """Best scores of a block of queries, over the leaves met so far. Of equal scores the smaller key is better."""

    def __init__(self, queries: np.ndarray, k: int, radius: float, nodes: dict, relax: float):
        self.q, self.k, self.nodes, self.relax = queries, k, nodes, relax
        self.lifted = np.column_stack([queries, np.zeros(len(queries))])
        self.norm = np.einsum("nd,nd->n", queries, queries) + radius**2
        self.best = np.full((len(queries), k), -np.inf)
        self.name = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.where = np.zeros((len(queries), k, 2), np.int64)
        self.home = np.full(len(queries), -1, np.int64)
        self.scanned = 0

    def scan(self, node: int, act: np.ndarray) -> None:
        leaf, name = self.nodes[node]["leaf"], self.nodes[node]["names"]
        spot = np.stack([np.full(len(leaf), node), np.arange(len(leaf))], axis=1)
        step = max(1, SCORES // (len(leaf) + self.k))
        self.scanned += len(act) * len(leaf)
        for some in np.split(act, range(step, len(act), step)):
            score = np.concatenate([self.best[some], self.q[some] @ leaf.T], axis=1)
            names = np.concatenate([self.name[some], np.broadcast_to(name, (len(some), len(name)))], axis=1)
            where = np.concatenate([self.where[some], np.broadcast_to(spot, (len(some), *spot.shape))], axis=1)
            top = np.argpartition(-score, self.k - 1, axis=1)[:, : self.k]
            last = np.take_along_axis(score, top, 1).min(1)
            tied = np.flatnonzero((score >= last[:, None]).sum(1) > self.k)
            top[tied] = np.lexsort((names[tied], -score[tied]), axis=1)[:, : self.k]
            for own, new in ((self.best, score), (self.name, names)):
                own[some] = np.take_along_axis(new, top, 1)
            self.where[some] = np.take_along_axis(where, top[:, :, None], 1)

    def reach(self, act: np.ndarray) -> np.ndarray:
        """Distance of the k-th found; the slack covers rounding."""
        return np.sqrt(np.maximum(0, self.norm[act] - 2 * self.best[act].min(1))) + 1e-7

    def descend(self, node: int, act: np.ndarray) -> None:
        """Every query to the one leaf it falls into, for a first reach."""
        n = self.nodes[node]
        if "leaf" in n:
            self.home[act] = node
            self.scan(node, act)
            return
        d = np.linalg.norm(self.lifted[act] - n["point"], axis=1)
        near = d <= n["ranges"][1]
        for child, some in ((2 * node + 1, act[near]), (2 * node + 2, act[~near])):
            if len(some):
                self.descend(child, some)

    def visit(self, node: int, act: np.ndarray) -> None:
        """Every leaf that the triangle inequality does not rule out."""
        n = self.nodes[node]
        if "leaf" in n:
            act = act[self.home[act] != node]
            if len(act):
                self.scan(node, act)
            return
        d = np.linalg.norm(self.lifted[act] - n["point"], axis=1)
        for child, (low, high) in ((2 * node + 1, n["ranges"][:2]), (2 * node + 2, n["ranges"][2:])):
            some = np.maximum(d - high, low - d) * self.relax <= self.reach(act)
            if some.any():
                self.visit(child, act[some])

    def run(self) -> Search:
        self.descend(0, np.arange(len(self.q)))
        self.visit(0, np.arange(len(self.q)))
        return self


def unpacked(tree: pd.DataFrame, d: int) -> dict:
    nodes = {}
    for node, point, ranges, leaf, ids in zip(tree["node"], tree["point"], tree["ranges"], tree["leaf"], tree["ids"], strict=True):
        if leaf is not None:
            nodes[int(node)] = {"leaf": np.frombuffer(leaf).reshape(-1, d), "ids": ids, "names": np.array([x[0] for x in ids], np.int64)}
        else:
            nodes[int(node)] = {"point": np.frombuffer(point), "ranges": np.asarray(ranges)}
    return nodes


def search_shard(tree: pd.DataFrame, queries: pd.DataFrame, k: int, radius: float, relax: float) -> pd.DataFrame:
    """The k nearest of each query in one shard, its own vector left out."""
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
    if not len(tree) or not len(queries):
        return empty
    q = stacked(queries["v"])
    nodes = unpacked(tree, q.shape[1])
    # distinct vectors: one for the query itself, some for scores that only rounding tells apart
    s = Search(q, k + 5, radius, nodes, relax).run()
    out = []
    for i, me in enumerate(queries["id"]):
        spots = s.where[i][s.best[i] > -np.inf]
        found = []
        for node, row in spots:
            score = float((nodes[node]["leaf"][row] * q[i]).sum())
            found += [(-score, int(x)) for x in nodes[node]["ids"][row] if x != me]
        out += [(me, x, -score) for score, x in sorted(found)[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else empty


def best_factor(rows: pd.DataFrame, queries: np.ndarray, k: int, radius: float) -> tuple[float, float, float]:
    """(factor, recall, share of rows scanned): the largest of FACTORS with which the queries find WANTED of their k
    nearest among the rows, by score."""
    tree = grow_tree(rows.assign(shard=0), radius)
    nodes, k = unpacked(tree, queries.shape[1]), min(k, len(rows))
    want = np.sort(queries @ stacked(rows["v"]).T, axis=1)[:, -k]
    for factor in FACTORS:
        s = Search(queries, k, radius, nodes, factor).run()
        recall = float((s.best >= want[:, None] - 1e-12 * radius**2).mean())
        if recall >= WANTED or factor == FACTORS[-1]:
            return factor, recall, s.scanned / len(queries) / len(rows)


class Cells:
    """First splits of all rows, by vantage points of a sample: cells of about the same number of rows."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.rows, parts = [], [sample]
        while len(parts) < cells:
            row, further = [], []
            for part in parts:
                point = part[0] if len(part) else np.zeros(sample.shape[1])
                d = np.linalg.norm(part - point, axis=1)
                cut = float(np.median(d)) if len(part) else 0.0
                row.append((point, cut))
                further += [part[d <= cut], part[d > cut]]
            self.rows.append(row)
            parts = further
        self.count = len(parts)

    def place(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distances to the vantage points on the way to it) of each row."""
        cell, told = np.zeros(len(lifted), np.int64), np.zeros((len(lifted), len(self.rows)))
        for i, row in enumerate(self.rows):
            d = np.linalg.norm(lifted - np.stack([p for p, _ in row])[cell], axis=1)
            told[:, i] = d
            cell = 2 * cell + (d > np.array([c for _, c in row])[cell])
        return cell, told

    def least(self, lifted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A lower bound of the distance of each row to each cell, whose rows have distances low to high on the way."""
        out = np.zeros((len(lifted), self.count))
        for i, row in enumerate(self.rows):
            d = np.stack([np.linalg.norm(lifted - p, axis=1) for p, _ in row], axis=1)
            d = np.repeat(d, self.count // len(row), axis=1)
            out = np.maximum(out, np.maximum(d - high[:, i], low[:, i] - d))
        return out


def indexable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part; of rows that share a key the smallest vector."""
    good = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(usable(F.col("v")) & F.col(key).isNotNull())
    return good.groupBy("id").agg(F.min("v").alias("v"))


class Index:
    """Trees of all rows of df in the shared folder: cells by first splits, a shard or more in each, a tree a shard.

    Equal vectors are one entry with their k + 1 smallest keys: no more of them can be among k nearest.
    """

    def __init__(self, df: DataFrame, key: str, vector: str, k: int, shard_rows: int):
        # in parts of the keys first, so that a vector with very many keys is no large group
        part = indexable(df, key, vector).withColumn("p", F.pmod(F.xxhash64("id"), F.lit(256)).cast("int"))
        first = lambda ids: F.slice(F.array_sort(ids), 1, k + 1)
        ranked = part.withColumn("i", F.row_number().over(Window.partitionBy("v", "p").orderBy("id"))).where(F.col("i") <= k + 1)
        entries = stash(ranked.groupBy("v").agg(first(F.collect_list("id")).alias("id")))
        x = F.transform("v", lambda c: c.cast("double") * c.cast("double"))
        count, longest = entries.agg(F.count("*"), F.max(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, c: a + c)))).first()
        self.radius = radius = longest or 0.0
        self.k, self.entries, self.count, self.shard_rows = k, entries, count, shard_rows
        if not count:
            return
        some = sampled(entries, count, SAMPLE_ROWS).select("v").toPandas()["v"] if count > shard_rows else entries.limit(1).toPandas()["v"]
        cells = self.cells = Cells(lift(stacked(some), radius), min(CELLS, -(-count // shard_rows)))

        def place(batches):
            for rows in batches:
                cell, told = cells.place(lift(stacked(rows["v"]), radius))
                yield rows.assign(cell=cell, told=list(told))

        kind = entries.schema["v"].dataType.simpleString()
        placed = entries.mapInPandas(place, f"v {kind}, id array<long>, cell long, told array<double>")
        placed = stash(placed) if cells.count > 1 else placed
        ends = [f(F.get("told", F.lit(i))) for i in range(len(cells.rows)) for f in (F.min, F.max)]
        # a row for each of at most CELLS cells
        self.low, self.high = np.full((2, cells.count, len(cells.rows)), np.inf)
        self.shards = np.ones(cells.count, np.int64)
        for r in placed.groupBy("cell").agg(F.count("*"), *ends).collect():
            self.shards[r[0]] = -(-r[1] // shard_rows)
            self.low[r[0]], self.high[r[0]] = r[2::2], r[3::2]
        deals = F.lit([int(x) for x in self.shards])[F.col("cell").cast("int")]
        shard = F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("v"), deals)
        self.trees = stash(placed.withColumn("shard", shard).groupBy("shard").applyInPandas(lambda g: grow_tree(g, radius), TREE))

    def factor(self, asked: DataFrame) -> tuple[float, float, float]:
        """(factor to use, its recall, share of rows scanned or nan) by about TRIALS of the queries: in one task where
        all rows are one shard, else by searches of the whole index, of which the one with factor 1 is the truth."""
        k, radius, count = self.k, self.radius, asked.count()
        if not self.count or not count:
            return FACTORS[-1], 1.0, 1.0
        queries = stacked(sampled(asked, count, TRIALS).limit(4 * TRIALS).toPandas()["v"]) if count > TRIALS else stacked(asked.toPandas()["v"])
        if not len(queries):
            return FACTORS[-1], 1.0, 1.0

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([best_factor(rows, queries, k, radius)], columns=["factor", "recall", "scanned"])

        if self.shards.sum() == 1:
            one = self.entries.withColumn("shard", F.lit(0))
            return tuple(one.groupBy("shard").applyInPandas(run, "factor double, recall double, scanned double").first())
        some = stash(sampled(asked, count, TRIALS).limit(4 * TRIALS))

        def scores(relax: float) -> pd.DataFrame:
            return top(self.search(some, relax, QUERY_ROWS), k).select("query_id", "score").toPandas()

        least = scores(1.0).groupby("query_id")["score"].agg(["min", "size"])
        low, high, known = 0, len(FACTORS) - 1, 1.0
        while low < high:
            middle = (low + high) // 2
            found = scores(FACTORS[middle])
            hits = found["score"].to_numpy() >= least["min"].reindex(found["query_id"]).to_numpy() - 1e-12 * radius**2
            recall = hits.sum() / least["size"].sum()
            if recall >= WANTED:
                high, known = middle, recall
            else:
                low = middle + 1
        return FACTORS[high], float(known), float("nan")

    def search(self, asked: DataFrame, relax: float, query_rows: int) -> DataFrame:
        """(query_id, vec_id, score): k nearest or more of each of the rows (id, v), first in the cell that each falls
        into, then in the cells which the k-th found there does not rule out."""
        cells, k, radius, shards, low, high = self.cells, self.k, self.radius, self.shards, self.low, self.high
        kind = asked.schema["v"].dataType.simpleString()

        def route(batches, home: bool):
            for rows in batches:
                q = stacked(rows["v"])
                lifted = np.column_stack([q, np.zeros(len(q))])
                own, _ = cells.place(lifted)
                if home:
                    wanted = np.arange(cells.count)[None, :] == own[:, None]
                else:
                    reach = np.sqrt(np.maximum(0, np.einsum("nd,nd->n", q, q) + radius**2 - 2 * rows["worst"].to_numpy(float))) + 1e-7
                    wanted = (cells.least(lifted, low, high) * relax <= reach[:, None]) & (np.arange(cells.count)[None, :] != own[:, None])
                i, c = np.nonzero(wanted)
                i, c, deal = np.repeat(i, shards[c]), np.repeat(c, shards[c]), np.concatenate([np.arange(0), *(np.arange(shards[x]) for x in c)])
                ids, vectors, shard = rows["id"].to_numpy(), rows["v"].to_numpy(), c << 32 | deal
                for lo in range(0, max(1, len(i)), SENT_ROWS):  # a query goes to as many shards as it must
                    part = slice(lo, lo + SENT_ROWS)
                    yield pd.DataFrame({"id": ids[i[part]], "v": vectors[i[part]], "shard": shard[part]})

        def visit(routed: DataFrame) -> DataFrame:
            # a task holds one tree and one block of its queries
            blocks = routed.groupBy("shard").agg(F.ceil(F.count("*") / query_rows).alias("blocks"))
            dealt = routed.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
            copies = self.trees.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            pairs = copies.drop("blocks").groupBy("shard", "block").cogroup(dealt.drop("blocks").groupBy("shard", "block"))
            return stash(pairs.applyInPandas(lambda t, q: search_shard(t, q, k, radius, relax), "query_id long, vec_id long, score double"))

        schema = f"id long, v {kind}, shard long"
        found = visit(stash(asked.mapInPandas(lambda b: route(b, True), schema)))
        if cells.count > 1:
            worst = top(found, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("worst"))
            known = asked.join(worst, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
            found = found.unionByName(visit(stash(known.mapInPandas(lambda b: route(b, False), schema))))
        return found


def top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, relax: float | None = None, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of df with the largest inner product, in double precision,
    for each row of queries, which are compared by key with themselves. Ties: smaller key first.

    relax: see FACTORS; 1 is exact. Vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do rows with a null key; all others have one length. Of rows that share a key the one with the
    smallest vector stands for all. Other columns are not read.
    """
    index = Index(df, key, vector, k, shard_rows)
    asked = stash(indexable(queries, key, vector))
    if not index.count:
        return asked.where("false").select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    factor = relax or index.factor(asked)[0]
    return top(index.search(asked, factor, query_rows), k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(e, e.where(F.col("vec_id") % 20 == 0))
