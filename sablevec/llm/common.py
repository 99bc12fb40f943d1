"""Shared pieces: byte-level text access and vectorised word hashing for Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text one numpy step works on; only a longer single text makes a larger step.
CHUNK = 1 << 20
#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}
#: What empties an operator's cache between tasks, by the operator's name.
CACHES: dict[str, Callable[[], None]] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """``BASE**i`` (or its inverse) modulo 2**64 for i < n; kept between batches up to twice a chunk."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), BASE_INVERSE if inverse else BASE, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if len(have) <= 2 * CHUNK:
            _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string or binary column as one byte array, and where each begins; null is empty."""
    plain = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    a = pc.fill_null(column, b"").cast(pa.large_binary()) if plain else pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give memory that arrays no longer use back to the system: workers live on between tasks and share a bounded executor."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of at most ``limit`` bytes of text, or of one longer row; only the ``owner``'s cache stays."""
    for name, empty in CACHES.items():
        if name != owner:
            empty()
    _, offsets = utf8(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
    release()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] the polynomial of data[i:j], still to be shifted by the inverse power of i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * powers(len(data)), out=out[1:])
    return out


def fresh(columns: list[str], name: str) -> str:
    """A name like ``name`` that no column has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class Words:
    """Words of a run of texts: hashes, byte spans and the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        n = len(data)
        b = _LOWER[data]
        w = inside[b]
        begin = np.zeros(n + 1, bool)
        begin[offsets] = True  # a text's first byte follows no word
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = w[:-1]
        before &= ~begin[:n]
        self.start = np.flatnonzero(w & ~before)
        after = np.zeros(n, bool)
        if n:
            after[:-1] = w[1:]
        after &= ~begin[1:]
        self.end = np.flatnonzero(w & ~after) + 1
        h = prefix_hash(b)
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((h[self.end] - h[self.start]) * powers(n + 1, True)[self.start] + length)
        self.first = np.searchsorted(self.start, offsets)  # of each text, and of the end
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.count)


#: Words are all but white space; or runs of ASCII letters, digits and any non-ASCII character.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of k words within a text (shorter texts: all their words), and its row."""
    h, n = words.hash, len(words.hash)
    out = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        out = out * np.uint64(0x8CB92BA72F3D8DD7) + h[j : n - k + 1 + j] if len(out) else out
    row = words.row[: len(out)]
    whole = words.row[k - 1 :] == row if len(out) else np.zeros(0, bool)
    out, row = mix(out[whole]), row[whole]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = words.count[short] > j
            extra[has] = extra[has] * np.uint64(0x8CB92BA72F3D8DD7) + h[words.first[short[has]] + j]
        extra = mix(extra ^ (words.count[short].astype(np.uint64) << np.uint64(56)))
        out, row = np.concatenate([out, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        out, row = out[order], row[order]
    return out, row


def binary(values: list) -> pa.Array:
    return pa.array(values, pa.binary())
