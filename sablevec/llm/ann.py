"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are projected on ``m`` Gaussian directions (seeded). The squared projected distance of two vectors is
their squared distance times a chi-square variable with ``m`` degrees of freedom, so a point beyond ``reach``
(the ``p`` quantile of that variable) times the squared k-th distance would beat it with probability 1 - p at most.

1. The top of the kd-tree, fitted on a bounded sample of projected points (``sample_rows``; every row is indexed),
   cuts space into cells. Every row is dealt to its cell; a cell with more rows than a task may hold is dealt on to
   several shards, so equal or crowded vectors don't make a shard grow.
2. A query first searches one shard of its own cell, then, carrying the k-th distance found there, all other shards
   whose cell the chi-square test leaves open.
3. In a shard the kd-tree goes on. A query takes its leaves by least possible projected distance, and their points
   by projected distance, verifies them on the original vectors in double precision, and stops when the chi-square
   test holds for all that is left.

Queries and points meet by shard; a shard holds its points (``cell_bytes`` at most, about) and reads its queries as a
stream. Only neighbours within the carried distance leave a shard, k at most for a query.

Defined results: vectors that are null, zero, of another dimension than the first query or holding a null or
non-finite component take no part; fewer candidates than k: all of them; ties by smaller id; a query's own id is
no candidate; repeated candidate ids count once; of a repeated query id the least vector asks; null ids take no
part; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sablevec.session import materialise

#: Points of a leaf; least points of a cell; most cells.
LEAF = 64
LEAST_CELL = 8192
MOST_CELLS = 8192


def chi_square_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """For even m, in closed form."""
    half = np.maximum(np.asarray(x, float), 0) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return np.where(np.isfinite(half), 1 - np.exp(-half) * total, 1.0)


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 100.0 + 10 * m
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


def directions(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


class Cells:
    """The top of the kd-tree: cuts at medians of the widest side, and the region of each cell."""

    def __init__(self, points: np.ndarray, n: int):
        m = points.shape[1]
        self.axis, self.cut, self.child, self.low, self.high = [], [], [], [], []
        todo = [(np.arange(len(points)), n, np.full(m, -np.inf), np.full(m, np.inf), None)]
        while todo:
            rows, n, low, high, up = todo.pop()
            if n == 1 or len(rows) < 2:
                at = ~len(self.low)  # a cell
                self.low.append(low)
                self.high.append(high)
            else:
                p = points[rows]
                axis = int(np.argmax(p.max(0) - p.min(0)))
                cut = float(np.quantile(p[:, axis], (n // 2) / n))
                at = len(self.axis)
                self.axis.append(axis)
                self.cut.append(cut)
                self.child.append([0, 0])
                left = p[:, axis] < cut
                for side, own, share in ((0, left, n // 2), (1, ~left, n - n // 2)):
                    lo, hi = low.copy(), high.copy()
                    (hi if side == 0 else lo)[axis] = cut
                    todo.append((rows[own], share, lo, hi, (at, side)))
            if up:
                self.child[up[0]][up[1]] = at
        self.axis, self.cut, self.child = np.array(self.axis, int), np.array(self.cut), np.array(self.child, int).reshape(-1, 2)
        self.low, self.high = np.stack(self.low), np.stack(self.high)

    def route(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), int) if len(self.axis) else np.full(len(points), -1)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            right = points[open_, self.axis[node]] >= self.cut[node]
            at[open_] = self.child[node, right.astype(int)]
        return ~at

    def nearest(self, point: np.ndarray) -> np.ndarray:
        """The least squared distance of each cell's points."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(1)


def _nearest(ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, dist))
    ids, dist = ids[order], dist[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    return ids[first[:k]], dist[first[:k]]


class Shard:
    """A kd-tree over the projections of some vectors; ``verified`` counts distances taken on original vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, m: int, p: float, seed: int):
        self.g, self.reach, self.verified = directions(x.shape[1], m, seed), chi_square_quantile(p, m), 0
        points = x @ self.g
        order, levels = np.arange(len(x)), [np.array([[0, len(x)]])]
        while len(x) and (levels[-1][:, 1] - levels[-1][:, 0]).max() > LEAF:
            spans = []
            for lo, hi in levels[-1]:
                mid = (lo + hi) // 2
                own = points[order[lo:hi]]
                axis = int(np.argmax(own.max(0) - own.min(0)))
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], mid - lo)]
                spans += [(lo, mid), (mid, hi)]
            levels.append(np.array(spans))
        self.ids, self.x, self.points = ids[order], x[order], points[order]
        self.spans = levels[-1]
        # the children of node i of a level are nodes 2 i and 2 i + 1 of the next
        low, high = (f.reduceat(self.points, self.spans[:, 0], axis=0) if len(x) else self.points for f in (np.minimum, np.maximum))
        self.boxes = [(low, high)]
        while len(self.boxes[0][0]) > 1:
            low, high = self.boxes[0]
            self.boxes.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
        self.slack = 1e-12 * float((self.points * self.points).sum(1).max(initial=0))

    def _gaps(self, level: int, nodes: np.ndarray, point: np.ndarray) -> np.ndarray:
        low, high = self.boxes[level]
        gap = np.maximum(np.maximum(low[nodes] - point, point - high[nodes]), 0)
        return (gap * gap).sum(1)

    def search(self, own: int, q: np.ndarray, k: int, bound: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Up to k ids and distances, none beyond ``bound``, of the nearest points but ``own``."""
        ids, best = np.zeros(0, np.int64), np.zeros(0)
        if not len(self.x):
            return ids, best
        point = q @ self.g

        def within() -> float:
            d = min(bound, best[-1] if len(best) == k else math.inf)
            return self.reach * d * d + self.slack

        def verify(leaves: np.ndarray) -> None:
            nonlocal ids, best
            at = np.concatenate([np.arange(lo, hi) for lo, hi in self.spans[leaves]])
            at = at[self.ids[at] != own]
            gap = self.points[at] - point
            near = (gap * gap).sum(1)
            order = np.argsort(near, kind="stable")
            at, near, done, step = at[order], near[order], 0, 4 * k
            while done < (last := int(np.searchsorted(near, within(), "right"))):
                take = at[done : min(last, done + step)]
                diff = self.x[take] - q
                self.verified += len(take)
                ids, best = _nearest(np.concatenate([ids, self.ids[take]]), np.concatenate([best, np.sqrt((diff * diff).sum(1))]), k)
                done, step = done + len(take), 2 * step

        node = 0
        for level in range(1, len(self.boxes)):  # the nearest leaf gives a first distance
            pair = np.array([2 * node, 2 * node + 1])
            node = int(pair[np.argmin(self._gaps(level, pair, point))])
        verify(np.array([node]))
        first, nodes = node, np.zeros(1, int)
        for level in range(1, len(self.boxes)):  # down the tree, without what the test rules out
            nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
            near = self._gaps(level, nodes, point)
            nodes, near = nodes[near <= within()], near[near <= within()]
        if len(self.boxes) > 1:
            order = np.argsort(near, kind="stable")
            nodes, near = nodes[order], near[order]
            near, nodes = near[nodes != first], nodes[nodes != first]
            at, step = 0, 4
            while at < len(nodes) and near[at] <= within():
                verify(nodes[at : at + step])
                at, step = at + step, 2 * step
        inside = best <= bound
        return ids[inside], best[inside]


def _serve(dim: int, k: int, m: int, p: float, seed: int):
    """Answers for rows sorted by shard, points before queries."""

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows, shard = None, [], [], None
        for batch in batches:
            places, kinds = batch.column("shard").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            edges = [0, *(np.flatnonzero((np.diff(places) != 0) | (np.diff(kinds.astype(int)) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if places[lo] != now:
                    now, ids, rows, shard = places[lo], [], [], None
                if not kinds[lo]:
                    ids.append(part.column("i").to_numpy())
                    rows.append(vectors(part))
                    continue
                if shard is None:
                    shard = Shard(np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate(rows) if rows else np.zeros((0, dim)), m, p, seed)
                    ids, rows = [], []
                for own, v, bound in zip(part.column("i").to_pylist(), vectors(part), part.column("bound").to_pylist(), strict=True):
                    found, dist = shard.search(own, v, k, math.inf if bound is None else bound)
                    out += [(own, i, d) for i, d in zip(found.tolist(), dist.tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", m: int = 24, p: float = 0.85, seed: int = 7, sample_rows: int = 1 << 16, cell_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found."""

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector}`").cast("array<double>")
        d = df.select(F.col(f"`{key}`").cast("bigint").alias("i"), v.alias("v"))
        fine = "i is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
        return d.where(fine)

    spark = vectors.sparkSession
    q, x = valid(queries), valid(vectors)
    size, dim = q.agg(F.count("*"), F.min_by(F.size("v"), "i")).first()
    rows = x.where(F.size("v") == dim).count() if size else 0
    if not rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    q = q.where(F.size("v") == dim).groupBy("i").agg(F.min("v").alias("v"))
    x = x.where(F.size("v") == dim)
    most = max(1, cell_bytes // (8 * dim))
    n = min(MOST_CELLS, math.ceil(rows / min(most, max(LEAST_CELL, rows // 32))))
    g = directions(dim, m, seed)
    step = max(1, rows // sample_rows)
    some = x.where(F.pmod(F.xxhash64("i", "v"), F.lit(step)) == 0).limit(2 * sample_rows).toArrow() if n > 1 else None
    points = np.array(some.column("v").to_pylist(), float).reshape(-1, dim) @ g if n > 1 else np.zeros((0, m))
    cells = spark.sparkContext.broadcast(Cells(points, n))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([pa.array(cells.value.route(v @ g), pa.int32()), batch.column("i"), batch.column("v")], ["cell", "i", "v"])

    routed = "cell int, i bigint, v array<double>"
    dealt = materialise(x.mapInArrow(route, routed).withColumn("nth", F.monotonically_increasing_id()), "points")
    asked = materialise(q.mapInArrow(route, routed), "queries")
    count = {r.cell: r["count"] for r in dealt.groupBy("cell").count().collect()}  # a row for each cell
    parts = np.array([math.ceil(count.get(c, 0) / most) or 1 for c in range(len(cells.value.low))])
    base = np.concatenate([[0], np.cumsum(parts)])
    shards = F.broadcast(spark.createDataFrame([(c, int(base[c]), int(parts[c])) for c in range(len(parts))], "cell int, base bigint, parts bigint"))

    def placed(df: DataFrame, by: str) -> DataFrame:
        return df.join(shards, "cell").withColumn("shard", F.col("base") + F.pmod(F.hash(by), "parts"))

    stored = placed(dealt, "nth").select("shard", F.lit(False).alias("query"), "i", "v", F.lit(None).cast("double").alias("bound"))

    def answers(asking: DataFrame) -> DataFrame:
        met = stored.union(asking.select("shard", F.lit(True).alias("query"), "i", "v", "bound")).repartition(int(base[-1]), "shard").sortWithinPartitions("shard", "query")
        return met.mapInArrow(_serve(dim, k, m, p, seed), "query_id bigint, vec_id bigint, score double")

    at_home = placed(asked, "i").select("shard", "i", "v", F.lit(None).cast("double").alias("bound"))
    found = materialise(answers(at_home), "near")
    if base[-1] > 1:
        bound = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("bound"))
        carried = placed(asked, "i").join(bound, F.col("i") == F.col("query_id"), "left").select(F.col("shard").alias("home"), "i", "v", F.when(F.col("n") >= k, F.col("bound")).alias("bound"))
        reach = chi_square_quantile(p, m)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) @ g
                for i, (home, point, d) in enumerate(zip(batch.column("home").to_pylist(), v, batch.column("bound").to_pylist(), strict=True)):
                    open_ = cells.value.nearest(point) <= (math.inf if d is None else reach * d * d + 1e-12 * float(point @ point))
                    to = np.concatenate([np.arange(base[c], base[c + 1]) for c in np.flatnonzero(open_)] or [np.zeros(0, np.int64)])
                    to = to[to != home]
                    one = batch.slice(i, 1).take(pa.array(np.zeros(len(to), np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), one.column("i"), one.column("v"), one.column("bound")], ["shard", "i", "v", "bound"])

        found = found.union(answers(carried.mapInArrow(spread, "shard bigint, i bigint, v array<double>, bound double")))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    distinct = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
