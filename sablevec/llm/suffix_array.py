"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classed as smaller (S) or larger (L) than the next one. The leftmost S suffixes (LMS) are sorted by
their substrings through one induction, named, and the string of names is sorted in turn by the same method, to
any depth and for any number of names. A last induction gives the array. All steps are linear: names come from
hashes of substrings, buckets from counts, and placing in a bucket sorts small integers by radix.

An induction scans the buckets in blocks of about equal size. A long bucket is a block of its own: what it induces
is placed at once, and what falls into the bucket itself in further rounds. In a block of short buckets only the
suffixes induced into the same block are placed one by one, in the order of their places; all others at once.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

from sablevec.llm.common import mix, powers, prefix_hash

#: Blocks of buckets that a scan makes; it changes the time, never the result.
BLOCKS = 128


def classify(s: np.ndarray) -> np.ndarray:
    """True for each S suffix; the last suffix is L."""
    n = len(s)
    differ = np.zeros(n, bool)
    differ[:-1] = s[1:] != s[:-1]
    differ[-1] = True
    smaller = np.zeros(n, bool)
    smaller[:-1] = s[:-1] < s[1:]
    at = np.where(differ, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal symbols ends
    return smaller[at]


def _place(sa: np.ndarray, edge: np.ndarray, items: np.ndarray, symbols: np.ndarray, step: int) -> None:
    """Put items, in order, at their buckets' edges, which move on by ``step``."""
    order = np.argsort(symbols, kind="stable")
    c = symbols[order].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    size = np.diff(np.concatenate([new, [len(c)]]))
    inside = np.arange(len(c)) - np.repeat(new, size)
    sa[edge[c] + step * inside] = items[order]
    edge[c[new]] += step * size


def _blocks(begin: np.ndarray, end: np.ndarray, n: int) -> list[tuple[int, int]]:
    """First and last bucket of each block: long buckets alone, runs of short ones together."""
    used = np.flatnonzero(end > begin)
    most = -(-n // BLOCKS)
    long = end[used] - begin[used] > most // 2
    block = begin[used] // most * 2
    cut = np.flatnonzero((block[1:] != block[:-1]) | long[1:] | long[:-1]) + 1
    return [(int(x[0]), int(x[-1])) for x in np.split(used, cut)]


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The order that LMS suffixes, given in theirs, induce on all others."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    tail = end - 1
    if len(lms):
        _place(sa, tail, lms[::-1], s[lms[::-1]], -1)
    head = begin.copy()
    _place(sa, head, np.array([n - 1]), s[n - 1 :], 1)
    blocks = _blocks(begin, end, n)
    large = ~small
    for c, last in blocks:
        _block(sa, s, large, head, begin[c], end[last], c, last, 1)
    # LMS suffixes are induced again, in their final order
    sa[np.repeat(head, end - begin) <= np.arange(n)] = -1
    tail = end - 1
    for c, last in blocks[::-1]:
        _block(sa, s, small, tail, begin[c], end[last], last, c, -1)
    return sa


def _block(sa: np.ndarray, s: np.ndarray, kind: np.ndarray, edge: np.ndarray, lo: int, hi: int, near: int, far: int, step: int) -> None:
    """Place what the buckets from ``near`` to ``far``, in places lo to hi - 1, induce of suffixes of a kind, scanning by ``step``."""
    if near == far:  # suffixes of the bucket's own symbol land in it: in rounds, until none does
        part = sa[lo:hi][::step]
        wait = part[part > 0]
        while len(wait):
            j = wait - 1
            own = j[kind[j] & (s[j] == near)]
            if not len(own):
                break
            _place(sa, edge, own, s[own], step)
            wait = own[own > 0]
    else:
        i = np.flatnonzero(sa[lo:hi] > 0)
        j = sa[lo:hi][i] - 1
        inside = kind[j] & ((s[j] <= far) if step > 0 else (s[j] >= far))
        queue = ((i[inside] + lo) * step).tolist()
        queue.sort()
        while queue:
            j = int(sa[heappop(queue) * step]) - 1
            c = s[j]
            y = int(edge[c])
            sa[y] = j
            edge[c] = y + step
            if j > 0 and kind[j - 1] and (s[j - 1] <= far if step > 0 else s[j - 1] >= far):
                heappush(queue, y * step)
    part = sa[lo:hi][::step]
    j = part[part > 0] - 1
    j = j[kind[j]]
    j = j[(s[j] > far) if step > 0 else (s[j] < far)]
    if len(j):
        _place(sa, edge, j, s[j], step)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """All suffixes of ``s`` (small non-negative numbers) in order."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    small = classify(s)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms)
    count = np.bincount(s)
    end = np.cumsum(count)
    begin = end - count
    if len(lms) > 1:
        sa = _induce(s, small, lms, begin, end)
        order = sa[is_lms[sa]]
        # an LMS substring reaches up to and with the next one's first symbol; the last up to the end
        stop = np.concatenate([lms[1:] + 1, [n]])
        h = prefix_hash(s)
        size = (stop - lms).astype(np.uint64)
        h = mix((h[stop] - h[lms]) * powers(n + 1, True)[lms] + size)
        h[-1] ^= np.uint64(1)  # none is like the last, which the end follows
        nth = np.empty(n, np.int64)
        nth[lms] = np.arange(len(lms))
        h = h[nth[order]]
        name = np.empty(len(lms), np.int64)
        name[nth[order]] = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
        names = int(name.max()) + 1
        lms = lms[suffix_array(name.astype(np.min_scalar_type(names)))] if names < len(lms) else order
    return _induce(s, small, lms, begin, end)


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, chain: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the one before it in the array (-1: none) and their common prefix, counted up to ``most``.

    The common prefix of a suffix is at most one less than that of the suffix one place before it in the text, so
    each place starts where the last one ended; chains of places run side by side.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    wide = text.itemsize
    padded = np.concatenate([text, np.zeros(most + 16, text.dtype)])
    word = np.ndarray((len(padded) - 8,), np.uint64, padded, 0, (wide,))  # eight bytes from each symbol on
    out = np.zeros(n, np.int64)
    last = np.zeros(-(-n // chain), np.int64)
    for t in range(chain):
        at = np.arange(t, n, chain)
        before = phi[at]
        size = np.maximum(last[: len(at)] - 1, 0)
        size[before < 0] = 0
        open_ = np.flatnonzero(before >= 0)
        while len(open_):
            p, q = at[open_] + size[open_], before[open_] + size[open_]
            apart = word[p] ^ word[q]
            same = apart == 0
            low = apart & (~apart + np.uint64(1))
            more = np.where(same, 8, (np.frexp(low.astype(np.float64))[1] - 1) >> 3) // wide
            size[open_] += more
            open_ = open_[same & (size[open_] < most)]
        room = n - np.maximum(at, before)
        size = np.minimum(np.minimum(size, room), most)
        out[at] = size
        last[: len(at)] = size
    return phi, out
