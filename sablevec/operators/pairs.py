"""The best documents of every document by inner product, exactly, in tiles of blocks.

Equal vectors are one class: only the k + 1 smallest ids of a class can be among anyone's k neighbours, and its members
share one search. Classes are packed into blocks of at most ``DOCS`` vectors and about ``POSTINGS`` postings, one row
each; two blocks meet as one row of a product without a shuffle, however large the corpus is. A task buffers an asking
block and streams the others past it, so each class sends on its k best once (a few times, where there are fewer asking
blocks than tasks): what is shuffled grows with the classes, not with their pairs.

In a tile, single-precision products, with the most their error can be, say which pairs may still be among the best;
these alone are summed in double precision, by component. Components that few vectors hold are added as outer products
of their two lists instead, so wide sparse corpora don't become dense matrices. Memory is bounded by the blocks.

Defined results: pairs that share no component are no neighbours, whatever their sum; repeated (d, c) add up; rows with
a null take no part; NaN comes before all other scores, as in ``search.top``; ids and components are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablevec.session import materialise

#: Most vectors of a block and about the most postings; rows of a block that are multiplied at once.
DOCS, POSTINGS, STRIP = 4096, 262_144, 512
#: Asking blocks that a task may hold at once; postings summed in double precision at once.
HELD, SUMMED = 16, 1_000_000
#: Seconds of one multiplication in a matrix product, of one in an outer product, and of any outer product.
DENSE_S, OUTER_S, CALL_S = 4e-11, 6e-9, 1.5e-5
#: Components of a matrix product at once.
WIDE = 2048
#: Vectors outside these sizes, or with a wider spread of values, aren't judged in single precision.
LEAST, MOST, SPREAD = 1e-140, 1e140, 1e-12

BLOCK = "first bigint, d binary, n binary, c binary, v binary"
FOUND = "q bigint, d bigint, score double"


def classes(p: DataFrame) -> DataFrame:
    """(rep, ids, x): every different vector with the sorted ids that have it; ``rep`` is the smallest."""
    p = p.select(F.col("d").cast("bigint").alias("d"), F.col("c").cast("bigint").alias("c"), F.col("v").cast("double").alias("v")).where("d IS NOT NULL AND c IS NOT NULL AND v IS NOT NULL")
    x = p.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("x"))
    return x.groupBy("x").agg(F.array_sort(F.collect_list("d")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "x")


class Block:
    """Vectors as rows of postings: ``d`` ids, ``start`` of each row, ``c`` and ``v`` by row and component."""

    def __init__(self, d: np.ndarray, n: np.ndarray, c: np.ndarray, v: np.ndarray):
        self.d, self.c, self.v = d, c, v
        self.start = np.concatenate([[0], np.cumsum(n)])
        self.row = np.repeat(np.arange(len(d)), n)
        self.words, self.code = np.unique(c, return_inverse=True)
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(np.bincount(self.row, v * v, len(d)))
            size = np.abs(v)
            least = np.minimum.reduceat(size, self.start[:-1])
            #: Rows that any pair of is summed in double precision.
            self.odd = ~((self.norm > LEAST) & (self.norm < MOST) & (least >= SPREAD * self.norm))
            self.most = float(self.norm[~self.odd].max(initial=LEAST))
            self.odd |= self.norm < SPREAD * self.most
        self.positive = bool((v[~self.odd[self.row]] > 0).all())
        self.key = self.row * len(self.words) + self.code
        self.by_word = np.argsort(self.code, kind="stable")
        self.word_at = np.searchsorted(self.code[self.by_word], np.arange(len(self.words) + 1))

    @classmethod
    def of(cls, batch: pa.RecordBatch, side: str, i: int) -> Block:
        d, n, c, v = (batch.column(side + x)[i].as_buffer() for x in "dncv")
        d, n = np.frombuffer(d, np.int64), np.frombuffer(n, np.int32)
        size = int(n.sum())  # postings, as narrow as packed
        c, v = np.frombuffer(c, f"i{c.size // size}"), np.frombuffer(v, f"f{v.size // size}")
        return cls(d, n, c.astype(np.int64), v.astype(np.float64))

    def scaled(self, by: np.ndarray | float) -> np.ndarray:
        """Values divided by a norm, in single precision; those of odd rows are 0."""
        by = np.broadcast_to(by, len(self.d))
        return np.where(self.odd[self.row], 0, self.v / np.where(self.odd, 1, by)[self.row]).astype(np.float32)

    def postings(self, word: int) -> np.ndarray:
        return self.by_word[self.word_at[word] : self.word_at[word + 1]]

    def matrix(self, words: np.ndarray, v: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Rows lo to hi over some words (their codes)."""
        at = np.full(len(self.words), -1)
        at[words] = np.arange(len(words))
        span = slice(self.start[lo], self.start[hi])
        column = at[self.code[span]]
        out = np.zeros((hi - lo, len(words)), np.float32)
        out[self.row[span][column >= 0] - lo, column[column >= 0]] = v[span][column >= 0]
        return out


def narrow(x: np.ndarray, *kinds: type) -> bytes:
    """The bytes of ``x`` in the first of ``kinds`` that holds every value exactly, or else as they are."""
    for kind in kinds:
        with np.errstate(all="ignore"):
            y = x.astype(kind)
        if np.array_equal(y.astype(x.dtype), x, equal_nan=True):
            return y.tobytes()
    return x.tobytes()


def pack():
    """Rows (rep, x) into blocks."""

    def block(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        d, n, c, v = (np.concatenate(x) for x in zip(*rows))
        row = np.repeat(np.arange(len(d)), n)
        first = np.concatenate([[True], (row[1:] != row[:-1]) | (c[1:] != c[:-1])])  # repeated components add up
        with np.errstate(all="ignore"):
            v = np.add.reduceat(v, np.flatnonzero(first))
        n = np.bincount(row[first], minlength=len(d))
        c, v = narrow(c[first].astype(np.int64), np.int16, np.int32), narrow(v.astype(np.float64), np.float32)
        blobs = [pa.array([x], pa.binary()) for x in (d.astype(np.int64).tobytes(), n.astype(np.int32).tobytes(), c, v)]
        return pa.RecordBatch.from_arrays([pa.array([int(d[0])], pa.int64()), *blobs], names=["first", "d", "n", "c", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, docs, postings = [], 0, 0
        for batch in batches:
            x, d = batch.column("x"), batch.column("rep").to_numpy()
            at = x.offsets.to_numpy()
            c, v = (x.values.field(k).to_numpy() for k in ("c", "v"))
            lo = 0
            while lo < len(d):
                room = np.searchsorted(at, at[lo] + POSTINGS - postings, side="right") - 1
                hi = int(min(len(d), lo + DOCS - docs, max(room, lo + (not docs))))
                if hi > lo:
                    rows.append((d[lo:hi], np.diff(at[lo : hi + 1]), c[at[lo] : at[hi]], v[at[lo] : at[hi]]))
                    docs, postings, lo = docs + hi - lo, postings + int(at[hi] - at[lo]), hi
                if lo < len(d):
                    yield block(rows)
                    rows, docs, postings = [], 0, 0
        if rows:
            yield block(rows)

    return run


def products(a: Block, b: Block, lo: int, hi: int, qv: np.ndarray, dv: np.ndarray, right: dict) -> tuple[np.ndarray, int]:
    """Single-precision products of rows lo to hi of ``a`` with all of ``b``, and the number of shared components."""
    _, i, j = np.intersect1d(a.words, b.words, assume_unique=True, return_indices=True)
    na, nb = np.diff(a.word_at)[i] * ((hi - lo) / len(a.d)), np.diff(b.word_at)[j]
    dense = CALL_S + OUTER_S * na * nb > DENSE_S * (hi - lo) * len(b.d)
    out = None
    di, dj = i[dense], j[dense]
    for at in range(0, len(di), WIDE):
        if len(di) > WIDE or "m" not in right or not np.array_equal(right["words"], dj):
            right["words"], right["m"] = dj[at : at + WIDE], b.matrix(dj[at : at + WIDE], dv, 0, len(b.d))
        part = a.matrix(di[at : at + WIDE], qv, lo, hi) @ right["m"].T
        out = part if out is None else np.add(out, part, out)
    if out is None:
        out = np.zeros((hi - lo, len(b.d)), np.float32)
    for x, y in zip(i[~dense], j[~dense]):
        s, t = a.postings(x), b.postings(y)
        s = s[(a.row[s] >= lo) & (a.row[s] < hi)]
        if len(s):
            out[(a.row[s] - lo)[:, None], b.row[t]] += np.outer(qv[s], dv[t])
    return out, len(i)


def sums(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of pairs (row of a, row of b) in double precision, by component, and how many components they share."""
    code = np.searchsorted(a.words, b.words)
    known = code < len(a.words)
    known[known] = a.words[code[known]] == b.words[known]
    total, shared = np.zeros(len(i)), np.zeros(len(i), int)
    n = (b.start[1:] - b.start[:-1])[j]
    step = max(1, SUMMED // int(n.max(initial=1)))
    for at in range(0, len(i), step):
        x, y, m = i[at : at + step], j[at : at + step], n[at : at + step]
        pair = np.repeat(np.arange(len(x)), m)
        post = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(b.start[y], m)
        own = known[b.code[post]]
        pair, post = pair[own], post[own]
        want = x[pair] * len(a.words) + code[b.code[post]]
        place = np.minimum(np.searchsorted(a.key, want), len(a.key) - 1)
        both = a.key[place] == want
        with np.errstate(all="ignore"):
            total[at : at + step] = np.bincount(pair[both], a.v[place[both]] * b.v[post[both]], len(x))
        shared[at : at + step] = np.bincount(pair[both], minlength=len(x))
    return total, shared


class Best:
    """The best classes of each row of a block so far."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.q, self.d, self.score = np.empty(0, int), np.empty(0, np.int64), np.empty(0)
        self.least = np.full(len(block.d), -np.inf)  # sums below it can't come in
        self.scaled = block.scaled(block.norm)

    def meet(self, b: Block) -> None:
        a, k = self.block, self.k
        dv, right, found = b.scaled(b.most), {}, []
        positive = a.positive and b.positive
        for lo in range(0, len(a.d), STRIP):
            hi = min(len(a.d), lo + STRIP)
            s, m = products(a, b, lo, hi, self.scaled, dv, right)
            # (m + 4) roundings of 2^-24 each, of sums of absolute values that are at most 1
            error = (m + 8) * 2.0**-24
            with np.errstate(all="ignore"):
                bar = self.least[lo:hi] / (a.norm[lo:hi] * b.most)
            open_ = np.flatnonzero(np.isneginf(self.least[lo:hi]) & ~a.odd[lo:hi])
            if len(open_) and len(b.d) > k:
                kth = np.partition(s[open_], len(b.d) - k, axis=1)[:, len(b.d) - k]
                bar[open_] = np.where(kth > error, kth - error, -np.inf)  # k positive sums, so of shared components
            bar = (bar - error).astype(np.float32)
            bar = np.nextafter(bar, np.float32(-np.inf))
            if positive:  # 0: no shared component
                bar = np.maximum(bar, np.float32(1e-45))
            if b.odd.any():
                s[:, b.odd] = np.inf
            bar[a.odd[lo:hi]] = -np.inf
            i, j = np.divmod(np.flatnonzero(s >= bar[:, None]), len(b.d))
            found.append((i + lo, j))
        i, j = (np.concatenate(x) for x in zip(*found))
        total, shared = sums(a, b, i, j)
        self.add(i[shared > 0], b.d[j[shared > 0]], total[shared > 0])

    def add(self, i: np.ndarray, d: np.ndarray, score: np.ndarray) -> None:
        q, d, score = np.concatenate([self.q, i]), np.concatenate([self.d, d]), np.concatenate([self.score, score])
        with np.errstate(all="ignore"):
            r = np.copysign(np.floor(np.abs(score) * 1e9 + 0.5) / 1e9, score)
        r = np.where(np.isfinite(r), r, score)
        order = np.lexsort((d, -r, ~np.isnan(r), q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[rank < self.k]
        self.q, self.d, self.score = q[rank < self.k], d[keep], score[keep]
        low = r[order[rank == self.k - 1]]
        slack = 1e-9 + 1e-15 * np.abs(np.where(np.isfinite(low), low, 0))
        self.least[q[rank == self.k - 1]] = np.where(np.isnan(low), np.inf, low - slack)

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.block.d[self.q], pa.int64()), pa.array(self.d, pa.int64()), pa.array(self.score, pa.float64())], names=["q", "d", "score"])


def meet(k: int):
    """Pairs of blocks (q_..., d_...) to the k best classes of every asking class, among the blocks of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                first = batch.column("q_first")[i].as_py()
                if first not in states:
                    if len(states) == HELD:
                        yield states.pop(next(iter(states))).rows()
                    states[first] = Best(Block.of(batch, "q_", i), k)
                states[first].meet(Block.of(batch, "d_", i))
        for x in states.values():
            yield x.rows()

    return run


def blocks(x: DataFrame, name: str) -> DataFrame:
    docs, postings = x.agg(F.count("*"), F.coalesce(F.sum(F.size("x")), F.lit(0))).first()
    n = max(1, math.ceil(docs / DOCS), math.ceil(postings / POSTINGS))
    return materialise(x.select("rep", "x").coalesce(n).mapInArrow(pack(), BLOCK), name)


def met(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(q, d, score): the k best classes of every class of the left blocks, from each part of the right blocks."""
    n_left, n_right = left.count(), right.count()
    # one part, unless there are too few left blocks to keep all cores busy
    parts = max(1, min(n_right, math.ceil(2 * left.sparkSession.sparkContext.defaultParallelism / max(1, n_left))))
    q = left.select(*[F.col(c).alias("q_" + c) for c in left.columns]).repartition(max(1, n_left))
    d = right.select(*[F.col(c).alias("d_" + c) for c in right.columns]).repartition(parts)
    # a product buffers its second side and streams the first; a broadcast would leave one task a part
    return d.hint("shuffle_replicate_nl").crossJoin(q).mapInArrow(meet(k), FOUND)


def neighbours(p: DataFrame, degree: int, asked: DataFrame | None = None) -> DataFrame:
    """(q, d, score): the ``degree`` best others of each document of p (d, c, v), or of those in ``asked`` (d)."""
    from sablevec.operators.search import small, top

    k = degree + 1
    known = materialise(classes(p), "classes")
    copied = known.where(F.size("ids") > 1)  # other classes need no joins
    members = (copied if asked is None else known).select("rep", F.explode("ids").alias("member"))
    if asked is not None:
        members = materialise(members.join(asked.select(F.col("d").cast("bigint").alias("member")), "member", "left_semi").select("rep", "member"), "asked")
    right = blocks(known, "blocks")
    left = right if asked is None else blocks(known.join(members.select("rep").distinct(), "rep", "left_semi"), "asking")
    best = top(met(left, right, k), k).drop("rank")
    first = copied.select(F.col("rep").alias("d"), F.slice("ids", 1, k).alias("ids"))
    each = best.join(small(first), "d", "left").select("q", F.explode(F.coalesce("ids", F.array("d"))).alias("d"), "score")
    each = top(each, k).drop("rank").withColumnRenamed("q", "rep")
    each = each.join(small(members), "rep", "left").withColumn("member", F.coalesce("member", "rep"))
    return each.where("member <> d").select(F.col("member").alias("q"), "d", "score")
