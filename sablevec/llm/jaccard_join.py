"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets are one class, joined once.

1. Shingles that many documents hold are counted over all documents; they go last in the global order, the rest
   is ordered by hash. (Which ones are taken for frequent changes the work, never the result.)
2. Two sets at or above the threshold share one of the first ``n - ceil(t n) + 1`` elements in that order, and it
   is among the first ``n - ceil(2 t n / (1 + t)) + 1`` of the smaller one. These meet by element; what meets no
   other class of fitting size and rank falls away.
3. The classes of an element are cut into bands by size: a band's first class is the candidate of all its band.
   Each class keeps the candidate it met most often. Candidates that pass the bitmap bound (differing bits bound
   the difference from below, so the overlap from above) make first families. Classes of an element in different
   families are compared tile by tile, sizes and bitmaps only; what passes joins families. So all pairs that can
   be similar are in one family, and no list of pairs is made.
4. A family's sets meet in tiles of bounded size, each tile with itself and with every other of its family, in
   tasks of their own. All pairs of fitting size are tested, by finer bitmaps and then by exact intersection of
   the sorted arrays.

Every link is verified and counted where it is found: a tile gives the links that span its components, and for
each class how many documents its links reach. Lists of all pairs of a group are never made, so a group of many
near copies costs the square of its different texts in comparisons, but not in rows.

Defined results: null text or text without words: empty set, linked with nothing, its own component; fewer than
``k`` words: the whole sequence as one shingle; equal texts or repeated rows share a component; a null id never
names a component that has another id; extra columns are ignored; an empty table gives an empty result. Sets are
compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablevec.llm.common import NOT_SPACE, Words, fresh, pieces, release, shingles, utf8
from sablevec.llm.components import components
from sablevec.session import materialise, settle

#: Rows that one task sorts at a time, on average.
TASK_ROWS = 500_000
#: Elements of the sets of a tile of a family, about.
TILE_ELEMENTS = 1_000_000
#: Classes of an element that are compared with another tile in one step.
TILE = 512


def sets(part: pa.RecordBatch, column: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after another, and where each row begins."""
    data, offsets = utf8(part.column(column))
    h, row = shingles(Words(data, offsets, NOT_SPACE), k)
    order = np.argsort(h)
    h, row = h[order], row[order]
    order = np.argsort(row.astype(np.uint16) if part.num_rows < 1 << 16 else row, kind="stable")
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(part.num_rows + 1))


def width(n: int) -> int:
    """Bits of a signature: a power of two that grows with the set's size band."""
    return max(64, 1 << max(0, int(n) - 1).bit_length())


def bitmap(h: np.ndarray) -> bytes:
    bits = np.zeros(width(len(h)), bool)
    bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(sig: bytes, bits: int) -> np.ndarray:
    a = np.frombuffer(sig, np.uint64)
    return np.bitwise_or.reduce(a.reshape(-1, bits // 64), axis=0)


def least_overlap(a, b, num: int, den: int):
    """The least intersection of sets of sizes a and b with intersection / union >= num / den."""
    return -(-num * (a + b) // (num + den))


def bound(sig_a: bytes, sig_b: bytes, n_a: int, n_b: int) -> int:
    """No more elements than these can be in both sets."""
    bits = 8 * min(len(sig_a), len(sig_b))
    apart = int(np.bitwise_count(_fold(sig_a, bits) ^ _fold(sig_b, bits)).sum())
    return (n_a + n_b - apart) // 2


def frequent(docs: DataFrame, text: str, k: int, least: int, most: int) -> np.ndarray:
    """Hashes of at most ``most`` shingles that at least ``least`` documents hold, counted in all documents; tasks report what they see four times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in pieces(batch, "t"):
                h, _ = sets(part, "t", k)
                h, n = np.unique(h, return_counts=True)
                seen, back = np.unique(np.concatenate([seen, h]), return_inverse=True)
                count = np.bincount(back, np.concatenate([count, n]), len(seen)).astype(np.int64)
                if len(seen) > 1 << 20:  # bounded memory: what was seen once may be counted once too few
                    seen, count = seen[count > 1], count[count > 1]
        yield pa.RecordBatch.from_arrays([pa.array(seen[count >= 4].view(np.int64)), pa.array(count[count >= 4])], ["h", "n"])

    local = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "h bigint, n bigint")
    rows = local.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _signatures(docs: DataFrame, k: int, num: int, den: int, hot: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    kind = docs.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            for part in pieces(batch, "t"):
                h, first = sets(part, "t", k)
                if len(hot):
                    last = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                else:
                    last = np.zeros(len(h), bool)
                n = np.diff(first)
                cut = np.where(n > 0, n + (-num * n // den) + 1, 0)
                head, digest, sig = [], [], []
                for i in range(part.num_rows):
                    own = h[first[i] : first[i + 1]]
                    late = last[first[i] : first[i + 1]]
                    order = np.concatenate([own[~late], own[late]]) if late.any() else own
                    head.append(order[: cut[i]].view(np.int64))
                    digest.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    sig.append(bitmap(own) if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("d"), pa.array(n.astype(np.int64)), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(head, pa.list_(pa.int64()))],
                    ["d", "n", "digest", "sig", "head"],
                )

    return docs.mapInArrow(run, f"d {kind}, n bigint, digest binary, sig binary, head array<bigint>")


def _gather(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    got: list[list] = [[] for _ in names]
    for batch in batches:
        for g, name in zip(got, names, strict=True):
            g.append(batch.column(name).to_numpy(zero_copy_only=False))
    return [np.concatenate(g) if g else np.zeros(0, np.int64) for g in got]


def _partnered(group: np.ndarray, n: np.ndarray, early: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of rows sorted by group and size: those with a partner of fitting size, the smaller of the two being early."""
    at = np.arange(len(group))
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), at, 0)) if len(at) else at
    before = np.concatenate([[-1], np.maximum.accumulate(np.where(early, at, -1))[:-1]]) if len(at) else at
    ok = (before >= begin) & (den * n[before] >= num * n)
    ok[:-1] |= early[:-1] & (group[1:] == group[:-1]) & (den * n[:-1] >= num * n[1:])
    return ok


def _meet(num: int, den: int):
    """Keep rows with a partner; band each element's classes by size and name the band's first class. Sizes of rows that aren't early are negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, cls, n = _gather(batches, "h", "cls", "n")
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        order = order[same[1:] | same[:-1]]
        h, cls, n = h[order], cls[order], n[order]
        order = np.lexsort((cls, np.abs(n), h))
        order = order[_partnered(h[order], np.abs(n[order]), n[order] > 0, num, den)]
        h, cls, n = h[order], cls[order], n[order]
        size = np.abs(n)
        lead = np.zeros(len(h), np.int64)
        open_ = np.arange(len(h))
        while len(open_):  # a band a round, for all elements at once
            begin = np.concatenate([[True], h[open_][1:] != h[open_][:-1]])
            top = open_[np.maximum.accumulate(np.where(begin, np.arange(len(open_)), 0))]
            inside = den * size[top] >= num * size[open_]
            lead[open_[inside]] = cls[top[inside]]
            open_ = open_[~inside]
        for at in range(0, len(h), 1 << 18):
            cut = slice(at, at + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (h, cls, n, lead)], ["h", "cls", "n", "lead"])
        release()

    return run


def _apart(num: int, den: int):
    """Rows of elements whose classes are in two families or more, and that have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, cls, n, comp = _gather(batches, "h", "cls", "n", "comp")
        order = np.lexsort((cls, np.abs(n), h))
        h, cls, n, comp = h[order], cls[order], n[order], comp[order]
        if len(h):
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.concatenate([first, [len(h)]]))
            keep = np.repeat(np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first), size)
            keep &= _partnered(h, np.abs(n), n > 0, num, den)
            for at in range(0, len(h), 1 << 18):
                cut = slice(at, at + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(x[cut][keep[cut]]) for x in (h, cls, n, comp)], ["h", "cls", "n", "comp"])

    return run


class Labels:
    """Components of numbers 0 to n - 1, kept as an array of labels."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        x, y = self.of[a], self.of[b]
        if x == y:
            return False
        self.of[self.of == y] = x
        return True


def _tiles(num: int, den: int):
    """Families that one element's classes connect, sizes and bitmaps allowing: spanning pairs, found tile by tile."""

    def group(cls, n, comp, sig) -> Iterator[tuple[int, int]]:
        order = np.lexsort((cls, np.abs(n)))
        early, n, sig = n[order] > 0, np.abs(n[order]), [sig[i] for i in order]
        names, comp = np.unique(comp[order], return_inverse=True)
        labels = Labels(len(names))
        wide = np.array([len(x) for x in sig])
        cuts = sorted({*range(0, len(n), TILE), *(np.flatnonzero(np.diff(wide)) + 1).tolist(), len(n)})
        for i, end in zip(cuts, cuts[1:], strict=False):  # signatures of a tile have one width
            a = np.arange(i, end)
            top = int(np.searchsorted(n, den * n[a[-1]] // num, "right"))
            for j in range(i, top, TILE):
                b = np.arange(j, min(j + TILE, top))
                la, lb = labels.of[comp[a]], labels.of[comp[b]]
                x, y = np.nonzero((la[:, None] != lb[None]) & (den * n[a][:, None] >= num * n[b][None]) & (a[:, None] < b[None]) & early[a][:, None])
                if not len(x):
                    continue
                bits = 8 * int(wide[i])
                left, right = np.stack([_fold(sig[k], bits) for k in a]), np.stack([_fold(sig[k], bits) for k in b])
                for at in range(0, len(x), 1 << 14):
                    p, q = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
                    apart = np.bitwise_count(left[p] ^ right[q]).sum(1, dtype=np.int64)
                    both = n[a][p] + n[b][q]
                    ok = (both - apart) // 2 >= least_overlap(n[a][p], n[b][q], num, den)
                    for u, v in np.unique(np.stack([comp[a][p[ok]], comp[b][q[ok]]]), axis=1).T:
                        if labels.join(u, v):
                            yield int(names[u]), int(names[v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, cls, n, comp, sig = _gather(batches, "h", "cls", "n", "comp", "sig")
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else []
        pairs: set[tuple[int, int]] = set()
        for lo, hi in zip(first, [*first[1:], len(h)], strict=True):
            at = order[lo:hi]
            pairs.update((min(p), max(p)) for p in group(cls[at], n[at], comp[at], [sig[i] for i in at]))
        columns = list(zip(*sorted(pairs), strict=True)) if pairs else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return run


def fine_bitmap(h: np.ndarray) -> np.ndarray:
    """Eight to sixteen bits an element."""
    bits = np.zeros(8 * width(len(h)), bool)
    bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def linked(sets_: list[np.ndarray], copies: np.ndarray, num: int, den: int, second: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between some sets: pairs of places that span their components, and for each set the copies that all its links reach.

    With ``second``, where a second tile begins, only pairs across the two are tested.
    """
    order = np.argsort([len(x) for x in sets_], kind="stable")
    own = [sets_[i] for i in order]
    n = np.array([len(x) for x in own], np.int64)
    labels, weight, out = Labels(len(order)), np.zeros(len(order), np.int64), []
    if second in (0, len(order)):  # the other tile is empty
        return out, weight
    if len(order) == 2:
        both = int(np.isin(own[0], own[1], assume_unique=True).sum()) if den * n[0] >= num * n[1] else 0
        if both and both >= least_overlap(n[0], n[1], num, den):
            return [(0, 1)], copies[::-1].copy()
        return [], weight
    side = order >= second if second is not None else None
    first = np.concatenate([[0], np.cumsum(n)])
    values, rank = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_inverse=True)
    marked = np.zeros(len(values), bool)
    sig = [fine_bitmap(x) for x in own]
    have, words, begin = np.zeros((0, 0), np.uint64), 0, 0
    for i in range(len(order)):
        top = int(np.searchsorted(n, den * n[i] // num, "right"))
        j = np.arange(i + 1, top)
        if side is not None:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        if len(sig[i]) != words:  # all larger sets at this width; sizes only grow
            words, begin, have = len(sig[i]), i, np.zeros((0, len(sig[i])), np.uint64)
        if begin + len(have) < top:
            have = np.concatenate([have, np.stack([np.bitwise_or.reduce(s.reshape(-1, words), axis=0) for s in sig[begin + len(have) : top]])])
        need = least_overlap(n[i], n[j], num, den)
        apart = np.concatenate([np.bitwise_count(have[j[k : k + 4096] - begin] ^ sig[i]).sum(1, dtype=np.int64) for k in range(0, len(j), 4096)])
        ok = (n[i] + n[j] - apart) // 2 >= need
        j, need = j[ok], need[ok]
        marked[rank[first[i] : first[i + 1]]] = True
        for k in range(0, len(j), 4096):
            at, least = j[k : k + 4096], need[k : k + 4096]
            ends = np.cumsum(n[at])
            place = np.arange(ends[-1]) + np.repeat(first[at] - ends + n[at], n[at])
            at = at[np.add.reduceat(marked[rank[place]], ends - n[at], dtype=np.int64) >= least]
            weight[i] += copies[order[at]].sum()
            weight[at] += copies[order[i]]
            for x in at[np.unique(labels.of[at], return_index=True)[1]].tolist():
                if labels.join(i, x):
                    out.append((int(order[i]), int(order[x])))
        marked[rank[first[i] : first[i + 1]]] = False
    back = np.empty_like(weight)
    back[order] = weight
    return out, back


def _bounded(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            ok = [bound(x, y, p, q) >= least_overlap(p, q, num, den) for x, y, p, q in zip(rows["sig_a"], rows["sig_b"], rows["n_a"], rows["n_b"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _links(num: int, den: int):
    """Links of each tile, or pair of tiles: spanning ones as (a, b), and as (a, null, w) what the links of a reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, dict[int, tuple]] = {}
        for batch in batches:
            own = batch.column("set")
            names = [batch.column(c).to_pylist() for c in ("family", "low", "high", "tile", "cls", "copies")]
            for i, (family, low, high, tile, cls, copies) in enumerate(zip(*names, strict=True)):
                groups.setdefault((family, low, high), {})[cls] = (tile != low, copies, np.frombuffer(own[i].as_py(), np.uint64))
        for (_, low, high), rows in groups.items():
            cls = sorted(rows, key=lambda c: (rows[c][0], c))
            second = sum(not rows[c][0] for c in cls) if low < high else None
            pairs, weight = linked([rows[c][2] for c in cls], np.array([rows[c][1] for c in cls], np.int64), num, den, second)
            out = [(cls[i], cls[j], 0) for i, j in pairs] + [(cls[i], None, int(weight[i])) for i in np.flatnonzero(weight)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b", "w"])
        release()

    return run


class Join:
    """The stages of one join; ``links`` and ``members`` are its results."""

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, num: int = 75, den: int = 100, hot_least: int = 200, hot_most: int = 200_000, broadcast_bytes: int = 32 << 20):
        self.docs = docs.select(F.col(f"`{key}`").alias("d"), F.col(f"`{text}`").alias("t"))
        self.k, self.num, self.den, self.broadcast_bytes = k, num, den, broadcast_bytes
        hot = frequent(docs, text, k, hot_least, hot_most)
        self.table = materialise(_signatures(self.docs, k, num, den, hot).withColumn("rid", F.monotonically_increasing_id()), "signatures")
        classes = self.table.where("n > 0").groupBy("digest").agg(F.min("rid").alias("cls"), F.min("d").alias("d"), F.count("*").alias("copies"))
        self.classes = materialise(classes, "classes")
        first_rows = self.classes.select("cls")
        if first_rows.count() * 64 <= broadcast_bytes:
            first_rows = F.broadcast(first_rows)
        reps = self.table.select(F.col("rid").alias("cls"), "n", "head").join(first_rows, "cls", "left_semi")
        self.sizes = self.table.select(F.col("rid").alias("cls"), "n", "sig", "digest")
        rows = self.table.agg(F.sum(F.size("head"))).first()[0] or 0
        self.tasks = max(1, math.ceil(rows / TASK_ROWS))
        early = F.expr(f"n - (2 * {num} * n + {num + den - 1}) div {num + den} + 1")
        spread = reps.select(F.posexplode("head").alias("pos", "h"), "cls", "n").select("h", "cls", F.when(F.col("pos") < early, F.col("n")).otherwise(-F.col("n")).alias("n")).repartition(self.tasks, "h")
        self.met = materialise(spread.mapInArrow(_meet(num, den), "h bigint, cls bigint, n bigint, lead bigint"), "met")
        first = self.met.where("lead <> cls").groupBy("cls", "lead").agg(F.count("*").alias("times"))
        first = first.groupBy("cls").agg(F.max(F.struct("times", "lead")).alias("m")).select(F.least("cls", "m.lead").alias("a"), F.greatest("cls", "m.lead").alias("b"))
        star = materialise(self._bound(first.distinct()), "star")
        one = components(star)
        named = one.select(F.col("node").alias("cls"), "component")
        if named.count() * 64 <= broadcast_bytes:
            named = F.broadcast(named)
        labelled = self.met.select("h", "cls", "n").join(named, "cls", "left").select("h", "cls", "n", F.coalesce("component", "cls").alias("comp"))
        self.apart = apart = materialise(labelled.repartition(self.tasks, "h").mapInArrow(_apart(num, den), "h bigint, cls bigint, n bigint, comp bigint"), "apart")
        signed = apart.join(self.sizes.select("cls", "sig"), "cls").select("h", "cls", "n", "comp", "sig").repartition(self.tasks, "h")
        more = signed.mapInArrow(_tiles(num, den), "a bigint, b bigint").distinct()
        families = components(star.union(more))
        self._family_links(families)

    def _bound(self, pairs: DataFrame) -> DataFrame:
        s = self.sizes.drop("digest")
        both = pairs.join(s.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a").join(s.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
        return both.mapInArrow(_bounded(self.num, self.den), "a bigint, b bigint")

    def _family_links(self, families: DataFrame) -> None:
        """``links``, ``reached`` and ``components`` from the families (node, component)."""
        sized = families.select(F.col("node").alias("cls"), F.col("component").alias("family")).join(self.sizes.select("cls", "n"), "cls")
        tiles = sized.groupBy("family").agg(F.ceil(F.sum("n") / TILE_ELEMENTS).alias("tiles"))
        placed = sized.join(tiles, "family").withColumn("tile", F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("cls"), "tiles")).otherwise(F.lit(0)).cast("bigint"))
        placed = materialise(placed.join(self.classes, "cls").select("cls", "n", "family", "tiles", "tile", "d", "digest", "copies"), "placed")
        # each class is dealt to the tasks of its tile with every tile of its family
        meet = placed.withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)"))).select("cls", "n", "family", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "d", "digest", "copies")
        found = materialise(self._tested(meet), "verified")
        self.links = found.where("b is not null").select("a", "b")
        self.reached = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("w").alias("reached"))
        self.components = components(self.links)

    def _tested(self, rows: DataFrame) -> DataFrame:
        """Links among the sets, made again from the texts, of one document of each class."""
        elements = rows.agg(F.sum("n")).first()[0] or 0
        tasks = max(1, math.ceil(elements / (2 * TILE_ELEMENTS)))
        keys, ids = rows.drop("d", "n"), rows.select(F.col("d").alias("w")).distinct()
        if rows.count() * 128 <= self.broadcast_bytes:
            keys, ids = F.broadcast(keys), F.broadcast(ids)
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "t"):
                    h, first = sets(part, "t", k)
                    own = [h[first[i] : first[i + 1]].tobytes() for i in range(part.num_rows)]
                    yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) if x else None for x in own], pa.binary()), pa.array(own, pa.binary())], ["digest", "set"])

        texts = self.docs.join(ids, F.col("d").eqNullSafe(F.col("w")), "left_semi").select("t")
        made = texts.mapInArrow(run, "digest binary, set binary").join(keys, "digest").drop("digest")
        return made.repartition(tasks, "family", "low", "high").mapInArrow(_links(self.num, self.den), "a bigint, b bigint, w bigint")

    def members(self) -> DataFrame:
        """One row per document: its key ``d``, set size ``n``, ``component``, the smallest key of its component, and ``links``, how many other documents it is linked with."""
        in_links = self.classes.join(self.components.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        least = in_links.groupBy("component").agg(F.min("d").alias("least"), F.sum("copies").alias("docs")).where("docs > 1")
        links = F.col("copies") - 1 + F.coalesce("reached", F.lit(0))
        # a table of its own, so that a digest that many documents share can be split
        named = materialise(in_links.join(least, "component").join(self.reached, "cls", "left").select("digest", "least", links.alias("links")), "named")
        return self.table.select("d", "n", "digest").join(named, "digest", "left").select("d", "n", F.coalesce("least", "d").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))


def digest(docs: DataFrame) -> DataFrame:
    m = Join(docs).members()
    return m.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, key: str = "doc_id", broadcast_bytes: int = 32 << 20, **args) -> DataFrame:
    """``docs`` with one document of each component: the one whose key names it (of repeated keys one row; rows of null key stay)."""
    join = Join(docs, key=key, **args)
    settle(docs.sparkSession)
    d = fresh(docs.columns, "d")
    out = materialise(join.members().where("d <> component").select(F.col("d").alias(d)).distinct(), "copies")
    if out.count() * 64 <= broadcast_bytes:
        out = F.broadcast(out)
    same = F.col(f"`{key}`") == F.col(d)
    kept = docs.join(out, same, "left_anti")
    twice = materialise(join.table.where("d is not null").groupBy("d").count().where("count > 1").select(F.col("d").alias(d)), "repeated")
    if twice.limit(1).count():
        again = kept.join(twice, same, "left_semi").dropDuplicates([key])
        kept = kept.join(twice, same, "left_anti").union(again)
    return kept
