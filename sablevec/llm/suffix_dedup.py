"""Removal of long repeated byte strings with sharded suffix arrays.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same text or another.

1. Every window of ``length`` bytes selects an anchor, the least hashed ``gram`` bytes inside it: equal windows
   select equal anchors. The windows that select one anchor are one region of the text. Regions whose anchor no
   other region has hold no repeated window and fall away, which loses nothing.
2. Equal regions repeat as a whole. One of each, with all other regions of its anchor, goes to the anchor's shard.
3. An anchor of more than ``HOT`` different regions is split first: its regions into pieces by the position of
   the anchor in the window and by the bytes that all windows of such a position share, and those that are still
   hot into single windows. Equal pieces repeat as a whole, and one of each goes on, so neither copies nor
   different surroundings of one passage make a shard grow.
4. A shard is a suffix array made by induced sorting; permuted common prefixes of ``length`` bytes or more mark
   repeated windows.
5. Each document's spans are joined and cut out.

Passages are the same operator over words: a text becomes a number for each word (white space and ASCII case don't
matter), and passages are runs of ``passage`` words that start anywhere else too. They are reported, not removed.

Defined results: null text is empty; texts shorter than ``length`` never change; texts are bytes of UTF-8;
repeated rows are different documents, so they repeat each other; null ids are kept; other columns are ignored;
an empty table gives an empty result. Regions are told apart by 128 bits of hashes, words by 32.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablevec.llm.common import NOT_SPACE, Words, mix, pieces, powers, prefix_hash, release, utf8
from sablevec.llm.suffix_array import permuted_common_prefixes, suffix_array
from sablevec.session import discard, materialise

#: Bytes of text of a shard, about; different regions that make an anchor hot; ways to split it at first.
SHARD = 1 << 20
HOT = 2000
WAYS = 16
#: Bytes of text whose anchors are sought at a time.
STEP = 1 << 19
#: Bytes of the number that stands for a word where passages are sought.
CODE = 4
#: Split regions whose documents' keys take no more than this are broadcast to the documents.
BROADCAST = 32 << 20


def least_in_windows(key: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row: of the rest of one block and the start of the next."""
    n = len(key) - w + 1
    blocks = -(-len(key) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each region: row, anchor hash, and anchor, first window and end as places in ``data``."""
    none = (np.zeros(0, np.int64),) * 5
    if len(data) < length:
        return none
    h = prefix_hash(data)
    g = mix((h[gram:] - h[:-gram]) * powers(len(data) + 1, True)[: len(data) - gram + 1])
    key = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    place = (least_in_windows(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offsets)
    n = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    if not len(start):
        return none
    place = place[start]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return row[first], g[place[first]].view(np.int64), place[first], start[first], start[last] + length


def _identified(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows with two hashes that tell texts of different keys apart."""
    d, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    return docs.select(d.alias("d"), t.alias("t"), F.xxhash64(d.cast("string"), t).alias("k1"), F.xxhash64(d.cast("string")).alias("k2"))


def _regions(docs: DataFrame, length: int, gram: int, unit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t", STEP):
                data, offsets = utf8(part.column("t"))
                view, offsets = memoryview(np.ascontiguousarray(data)), offsets // unit
                row, kh, p, s, e = anchors(data if unit == 1 else data.view(np.uint32), offsets, length, gram)
                ctx = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip((s * unit).tolist(), (e * unit).tolist(), strict=True)), np.uint64, len(s)).view(np.int64)
                base = offsets[row] if len(row) else row
                k1, k2 = (part.column(k).to_numpy()[row] if len(row) else row for k in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, kh, ctx, (p - base).astype(np.int32), (s - base).astype(np.int32), (e - base).astype(np.int32))], ["k1", "k2", "kh", "ctx", "p", "s", "e"])

    return docs.select("k1", "k2", "t").mapInArrow(run, "k1 bigint, k2 bigint, kh bigint, ctx bigint, p int, s int, e int")


def _bytes(t: str | bytes | None) -> bytes:
    return t.encode() if isinstance(t, str) else t or b""


def _split(length: int, width: int, unit: int):
    """Pieces of the wanted regions: the windows whose anchor is c * width to (c + 1) * width - 1 bytes in, for each c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                out: list[tuple] = []
                for k1, k2, t, wanted in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "t", "wanted")), strict=True):
                    b = _bytes(t)
                    for w in wanted:
                        kh, p, s, e = w["kh"], w["p"], w["s"], w["e"]
                        for c in range((p - e + length) // width, (p - s) // width + 1):
                            lo, hi = max(s, p - (c + 1) * width + 1), min(e - length, p - c * width)
                            common = xxhash.xxh3_64_intdigest(b[(p - c * width) * unit : (p - (c + 1) * width + 1 + length) * unit], seed=c)
                            out.append((k1, k2, _signed(common ^ (kh & (1 << 64) - 1)), _signed(xxhash.xxh3_64_intdigest(b[lo * unit : (hi + length) * unit])), p, lo, hi + length))
                        if len(out) > 20_000:
                            yield _rows(out, _REGION)
                            out = []
                if out:
                    yield _rows(out, _REGION)

    return run


def _extract(shards: int, unit: int):
    """Bytes of the wanted regions of each text, dealt to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                out: list[tuple] = []
                for k1, k2, t, wanted in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "t", "wanted")), strict=True):
                    b = _bytes(t)
                    for w in wanted:
                        out.append((w["kh"] % shards, k1, k2, w["s"], b[w["s"] * unit : w["e"] * unit]))
                        if len(out) > 20_000:
                            yield _rows(out, _DEALT)
                            out = []
                if out:
                    yield _rows(out, _DEALT)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_REGION = {"k1": pa.int64(), "k2": pa.int64(), "kh": pa.int64(), "ctx": pa.int64(), "p": pa.int32(), "s": pa.int32(), "e": pa.int32()}
_DEALT = {"shard": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "s": pa.int32(), "b": pa.binary()}


def _rows(out: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))


def repeated(regions: list[tuple], length: int, unit: int = 1) -> list[tuple]:
    """Spans (k1, k2, s, e) of all windows of the regions (k1, k2, s, bytes) that start more than once among them."""
    joined: list[list] = []
    for k1, k2, s, b in sorted(regions, key=lambda r: (r[0], r[1], r[2], -len(r[3]))):
        if joined and joined[-1][:2] == [k1, k2] and s <= (end := joined[-1][2] + len(joined[-1][3]) // unit):
            joined[-1][3] += b[(end - s) * unit :]  # a place of a text is in the shard once
        else:
            joined.append([k1, k2, s, bytearray(b)])
    begin = np.concatenate([[0], np.cumsum([len(r[3]) // unit + 1 for r in joined])])
    if unit == 1:
        text = np.frombuffer(b"\xff".join(bytes(r[3]) for r in joined) + b"\xff", np.uint8)
    else:  # numbers by rank; 0 parts regions
        text = np.zeros(begin[-1], np.uint32)
        inside = np.ones(len(text), bool)
        inside[begin[1:] - 1] = False
        text[inside] = np.unique(np.frombuffer(b"".join(bytes(r[3]) for r in joined), np.uint32), return_inverse=True)[1] + 1
    sa = suffix_array(text)
    phi, common = permuted_common_prefixes(text, sa, length)
    own = np.repeat(np.arange(len(joined)), np.diff(begin))
    twice = np.flatnonzero((common >= length) & (begin[own + 1] - 1 - np.arange(len(text)) >= length))
    hit = np.zeros(len(text), bool)
    hit[twice] = hit[phi[twice]] = True
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (own[at][1:] != own[at][:-1])]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    out = []
    for a, b in zip(at[first], at[last], strict=True):
        k1, k2, s, _ = joined[own[a]]
        out.append((k1, k2, int(s + a - begin[own[a]]), int(s + b - begin[own[a]] + length)))
    return out


def _shard(length: int, unit: int):
    def run(table: pa.Table) -> pa.Table:
        found = repeated(list(zip(*(table.column(c).to_pylist() for c in ("k1", "k2", "s", "b")), strict=True)), length, unit)
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        release()
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], ["k1", "k2", "s", "e"])

    return run


def _met(named: DataFrame, wanted: DataFrame, few: bool = False) -> DataFrame:
    """Texts with their wanted regions. All columns of the documents are taken, so that this exchange is the one that the spans meet too."""
    by_text = wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted")).select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "wanted")
    by_text = F.broadcast(by_text) if few else by_text.hint("shuffle_hash")
    return named.join(by_text, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2"))).select("d", "t", "k1", "k2", "wanted")


def spans(named: DataFrame, length: int, gram: int, unit: int = 1) -> DataFrame:
    """All repeated spans (k1, k2, s, e) of identified documents (d, t, k1, k2), counted in symbols of ``unit`` bytes; they may overlap or repeat."""
    region = ", ".join(f"{c} {'int' if k == pa.int32() else 'bigint'}" for c, k in _REGION.items())
    regions = materialise(_regions(named, length, gram, unit), "regions")
    found, wanted = None, None
    for width in (-(-(length - gram + 1) // WAYS), 1, None):
        # every side of a join is a table of its own, so that skewed keys of the other side can be split
        shared = materialise(regions.groupBy("kh").agg(F.count("*").alias("n"), (F.min("ctx") != F.max("ctx")).alias("mixed")).where("n > 1").select("kh", "mixed"), "anchors")
        some = materialise(regions.join(shared, "kh"), "shared")
        discard(regions, shared)
        kinds = materialise(some.groupBy("kh", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "p", "s", "e")).alias("r"), F.max("mixed").alias("mixed")), "kinds")
        whole = some.join(kinds.where("n > 1").select("kh", "ctx"), ["kh", "ctx"]).select("k1", "k2", "s", "e")
        found = whole if found is None else found.union(whole)
        mixed = kinds.where("mixed").select("kh", "r.*")
        hot = materialise(kinds.where("mixed").groupBy("kh").count().where(F.col("count") > HOT).select("kh"), "hot")
        split = F.struct("kh", "p", "s", "e").alias("w")
        calm = mixed.join(hot, "kh", "left_anti").select("k1", "k2", split)
        wanted = calm if wanted is None else wanted.union(calm)
        if width is None or not hot.limit(1).count():  # pieces of one window are never mixed
            break
        again = materialise(mixed.join(hot, "kh").select("k1", "k2", split), "again")
        few = again.count() * 64 <= BROADCAST
        regions = materialise(_met(named, again, few).select("k1", "k2", "t", "wanted").mapInArrow(_split(length, width, unit), region), "regions")
        discard(again)
    wanted = materialise(wanted, "wanted")
    total = wanted.agg(F.sum(F.expr("w.e - w.s"))).first()[0] or 0
    dealt = _met(named, wanted).mapInArrow(_extract(max(1, math.ceil(total * unit / SHARD)), unit), "shard bigint, k1 bigint, k2 bigint, s int, b binary")
    part = dealt.groupBy("shard").applyInArrow(_shard(length, unit), "k1 bigint, k2 bigint, s int, e int")
    return found.union(part)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "t", STEP):
            words = Words(*utf8(part.column("t")), NOT_SPACE)
            code = pa.py_buffer((words.hash >> np.uint64(32)).astype(np.uint32).tobytes())
            at = pa.py_buffer((words.first * CODE).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("d"), pa.Array.from_buffers(pa.binary(), part.num_rows, [None, at, code]), part.column("k1"), part.column("k2")], ["d", "t", "k1", "k2"])


def _joined(found: list[int] | None) -> list[list[int]]:
    """Maximal runs of packed spans."""
    joined: list[list[int]] = []
    for s, e in sorted((x >> 32, x & 0xFFFFFFFF) for x in found or ()):
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    return joined


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    many = pa.list_(pa.int64())
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_passages": pa.int64(), "n_passage_words": pa.int64(), "spans": many}
    for batch in batches:
        for part in pieces(batch, "t"):
            out = []
            for t, found, words in zip(*(part.column(c).to_pylist() for c in ("t", "found", "words")), strict=True):
                b = _bytes(t)
                joined, passages = _joined(found), _joined(words)
                at, sha = 0, hashlib.sha256()
                for s, e in joined:
                    sha.update(b[at:s])
                    at = e
                sha.update(b[at:])
                out.append((len(b), sum(e - s for s, e in joined), len(joined), sha.hexdigest(), len(passages), sum(e - s for s, e in passages), [x for j in joined for x in j]))
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([part.column("d"), *(pa.array(x, k) for x, k in zip(columns, kinds.values(), strict=True))], ["d", *kinds])


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 400, gram: int = 64, passage: int = 51) -> DataFrame:
    """Per document: key ``d``, byte counts, the hash of what is left, passages, and the removed spans (starts and ends in turn)."""
    named = _identified(docs, text, key)
    packed = (F.shiftleft(F.col("s").cast("bigint"), 32) + F.col("e")).alias("x")
    kind = named.schema["d"].dataType.simpleString()
    coded = named.mapInArrow(_codes, f"d {kind}, t binary, k1 bigint, k2 bigint")
    found = spans(named, length, gram).select("k1", "k2", packed, F.lit(False).alias("word"))
    found = found.union(spans(coded, passage, min(8, passage // 2), CODE).select("k1", "k2", packed, F.lit(True).alias("word")))
    sets = [F.collect_set(F.when(F.col("word") == w, F.col("x"))).alias(c) for w, c in ((False, "found"), (True, "words"))]
    by_text = found.groupBy("k1", "k2").agg(*sets).select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "found", "words")
    both = named.join(by_text.hint("shuffle_hash"), (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")), "left").select("d", "t", "found", "words")
    return both.mapInArrow(_cut, f"d {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, n_passage_words bigint, spans array<bigint>")


def digest(docs: DataFrame, **args) -> DataFrame:
    return dedup(docs, **args).select(F.col("d").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words")
