"""Benchmark decontamination with training suffix arrays.

Each run of documents is a training shard. Words of a shard that no benchmark match can pass through (those in
no word pair of the benchmark) are cut out, which loses no match; the rest becomes a suffix array over word
numbers, made by induced sorting. Every benchmark suffix that begins with a word pair of the shard is looked up by
binary search, as far as one window reaches; the ranges found give all verbatim occurrences, and neighbouring ones
on one diagonal join into the longest matches, with their places in item and document. Affected documents can then
be removed. Documents are read once and never shuffled.

The benchmark is a stated query set: it is broadcast in blocks of at most ``block_bytes`` bytes of text, as many
as its size asks for. The driver makes one block at a time, of arrays only, and a worker holds one at a time.

Words are runs of ASCII letters and digits and of any non-ASCII characters, A-Z in lower case. A window is
``window`` words of an item in a row, or all words of a shorter item.

Defined results: null or empty text has no words and is clean; items without words or with a null id hit
nothing; items that share an id count once, and equal ones of one id are one; repeated rows are treated alike; other columns are ignored; an
empty table on either side gives clean results or none; whole texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablevec.llm.common import ALNUM, Words, mix, pieces, utf8
from sablevec.llm.suffix_array import suffix_array


class Block:
    """Suffixes of a part of the benchmark, as far as a window reaches: where each begins, its words, and all its places."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        self.window, self.ids = window, [i for i, _ in rows]
        data, offsets = utf8(pa.array([t for _, t in rows], pa.string()))
        w = Words(data, offsets, ALNUM)
        self.vocabulary, numbers = np.unique(w.hash, return_inverse=True)
        self.numbers = np.concatenate([numbers + 1, np.zeros(window, np.int64)])
        n = np.where(w.count >= window, w.count - window + 1, w.count > 0)
        item = np.repeat(np.arange(len(rows)), n)
        at = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        start, size = w.first[item] + at, np.minimum(w.count[item], window)
        h = size.astype(np.uint64)
        for j in range(window):
            word = np.where(size > j, self.numbers[start + j], 0).astype(np.uint64)
            h = mix(h * np.uint64(0x8CB92BA72F3D8DD7) + word)
        _, first, kind = np.unique(h, return_index=True, return_inverse=True)
        self.start, self.size = start[first], size[first]
        order = np.argsort(kind, kind="stable")
        self.item, self.at, self.first = item[order], at[order], np.searchsorted(kind[order], np.arange(len(first) + 1))
        same = w.row[1:] == w.row[:-1]
        self.pairs = np.unique(self._pair(numbers[:-1][same] + 1, numbers[1:][same] + 1))
        self.single = np.unique(self.numbers[self.start[self.size == 1]])

    def places(self, kind: int) -> list[tuple[int, int]]:
        """Items and word places of a suffix."""
        lo, hi = self.first[kind : kind + 2]
        return list(zip(self.item[lo:hi].tolist(), self.at[lo:hi].tolist(), strict=True))

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * (len(self.vocabulary) + 1) + b

    def number(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)

    def compact(self, numbers: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard: numbers of the words a match can pass through, 0 between runs, and where they were."""
        n = len(numbers)
        joined = np.zeros(n, bool)  # with the word before
        if n > 1 and len(self.pairs):
            pair = self._pair(numbers[:-1], numbers[1:])
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[1:] = (self.pairs[at] == pair) & (row[1:] == row[:-1]) & (numbers[1:] > 0) & (numbers[:-1] > 0)
        keep = joined.copy()
        keep[:-1] |= joined[1:]
        if len(self.single):
            keep |= np.isin(numbers, self.single)
        at = np.flatnonzero(keep)
        breaks = ~joined[at]
        place = np.arange(len(at)) + np.cumsum(breaks)
        shard, where = np.zeros(int(place[-1]) + 1 if len(at) else 0, np.int64), np.full(int(place[-1]) + 1 if len(at) else 0, -1)
        shard[place], where[place] = numbers[at], at
        return shard, where

    def find(self, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (suffix, place in the shard) with the suffix's words at that place."""
        if not len(shard) or not len(self.start):
            return np.zeros(0, int), np.zeros(0, int)
        # a suffix whose first word pair (only word) isn't in the shard has no match
        pairs = np.unique(self._pair(shard[:-1], shard[1:]))
        begins = np.isin(self._pair(self.numbers[self.start], self.numbers[self.start + 1]), pairs)
        which = np.flatnonzero(np.where(self.size > 1, begins, np.isin(self.numbers[self.start], shard)))
        if not len(which):
            return np.zeros(0, int), np.zeros(0, int)
        rank = np.unique(shard, return_inverse=True)[1]
        sa = suffix_array(rank.astype(np.min_scalar_type(len(rank))))
        padded = np.concatenate([shard, np.zeros(self.window, np.int64)])
        lo, hi = self._bound(which, sa, padded, False), self._bound(which, sa, padded, True)
        n = hi - lo
        place = sa[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        return np.repeat(which, n), place

    def _bound(self, which: np.ndarray, sa: np.ndarray, padded: np.ndarray, after: bool) -> np.ndarray:
        """For each suffix the first of the shard's not before it, or (``after``) the first that is behind all with its words."""
        lo, hi = np.zeros(len(which), int), np.full(len(which), len(sa))
        start, size = self.start[which], self.size[which]
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            order = np.zeros(len(open_), np.int8)  # of the shard's suffix against the benchmark's: -1, 0, 1
            live = np.arange(len(open_))
            for j in range(self.window):
                live = live[size[open_[live]] > j]
                if not len(live):
                    break
                a, b = padded[sa[mid[live]] + j], self.numbers[start[open_[live]] + j]
                order[live] = np.sign(a - b)
                live = live[a == b]
            right = order < 0 if not after else order <= 0
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        return lo


def blocks(benchmark: DataFrame, window: int, item: str = "item_id", text: str = "text", block_bytes: int = 8 << 20) -> list:
    """The benchmark as broadcast blocks; each is read by the driver on its own."""
    b = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    size = b.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    share = b.sparkSession.sparkContext.broadcast
    return [share(Block([(r.i, r.t) for r in b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()], window)) for k in range(n)]


def _scan(part: pa.RecordBatch, column: str, shared: list, window: int) -> tuple[Words, np.ndarray, list, list]:
    data, offsets = utf8(part.column(column))
    w = Words(data, offsets, ALNUM)
    hit = np.zeros(len(w.hash) + 1, np.int32)
    items, matches = [set() for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
    for number, one in enumerate(shared):
        block = one.value
        shard, where = block.compact(block.number(w.hash), w.row)
        which, place = block.find(shard)
        place = where[place]
        np.add.at(hit, place, 1)
        np.add.at(hit, place + block.size[which], -1)
        rows = w.row[place]
        seen = np.unique(np.stack([rows, which]), axis=1) if len(rows) else np.zeros((2, 0), int)
        for r, k in seen.T:
            items[r].update(block.ids[i] for i, _ in block.places(k))
        for r, k, p in zip(rows.tolist(), which.tolist(), (place - w.first[rows]).tolist(), strict=True):
            matches[r] += [(p, number, i, block.ids[i], at, int(block.size[k])) for i, at in block.places(k)]
        if len(shared) > 1 and hasattr(one, "_value"):
            del one._value  # the next block takes its place
    return w, np.cumsum(hit[:-1]) > 0, items, matches


def _longest(matches: list[tuple]) -> list[dict]:
    """Windows on one diagonal of item and document that touch, joined: the longest verbatim matches."""
    ends: dict = {}
    out = []
    for p, number, i, item, at, size in sorted(matches):
        if (m := ends.get((number, i, at - p))) and m["doc_word"] + m["n_words"] == p + size - 1:
            m["n_words"] += 1
        else:
            m = ends[(number, i, at - p)] = {"item_id": item, "item_word": at, "doc_word": p, "n_words": size}
            out.append(m)
    return out


def _hits(docs: DataFrame, benchmark: DataFrame, text: str, keep: tuple[str, ...], window: int, locate: bool, **block_args) -> DataFrame:
    """Columns ``k0`` and so on for ``keep``, and the results."""
    shared = blocks(benchmark, window, **block_args)
    src = docs.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)], *([] if text in keep else [F.col(f"`{text}`").alias("t")]))
    column = f"k{keep.index(text)}" if text in keep else "t"  # a kept text crosses once
    found = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column):
                w, hit, items, matches = _scan(part, column, shared, window)
                n_hit = np.concatenate([[0], np.cumsum(hit)])
                made = [pa.array(w.count.astype(np.int64)), pa.array((n_hit[w.first[1:]] - n_hit[w.first[:-1]]).astype(np.int64)), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                made += [pa.array([_longest(m) for m in matches], found)] if locate else []
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], [*part.schema.names[: len(keep)], "n_words", "n_hit", "items", "matches"][: len(keep) + len(made)])

    kinds = [f"k{i} {src.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    kinds += ["n_words bigint", "n_hit bigint", "items array<string>"] + ["matches array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>"] * locate
    return src.mapInArrow(run, ", ".join(kinds))


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = 10, locate: bool = False, **block_args) -> DataFrame:
    """``keep`` columns, n_words, n_hit, the item ids with occurring windows and, if asked, the longest matches."""
    out = _hits(docs, benchmark, text, keep, window, locate, **block_args)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], *out.columns[len(keep) :])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, **block_args) -> DataFrame:
    """``docs`` without the affected documents."""
    found = _hits(docs, benchmark, text, tuple(docs.columns), window, False, **block_args).where("n_hit = 0")
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(docs.columns)])


def digest(found: DataFrame) -> DataFrame:
    """Of ``hits`` with ``locate``: the counts, and the number and greatest length of the longest matches."""
    longest = F.coalesce(F.array_max(F.expr("transform(matches, m -> m.n_words)")), F.lit(0)).cast("bigint")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("matches").cast("bigint").alias("n_matches"), longest.alias("n_longest"))
