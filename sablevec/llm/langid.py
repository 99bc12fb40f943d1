"""Language identification by word-first backoff.

Training counts lower-case words of labelled documents by language. A known word scores its per-language log
frequency; an unseen word is scored by the longest known character n-grams (4 down to 1) that begin at each of
its characters, word borders included. A document's score is the mean over its words.

Training takes a bounded sample of the labelled rows of every language: rows in the order of their ids' hashes,
until ``per_lang`` rows or ``max_chars`` characters are met (both within a 64th part of ``per_lang`` rows). Their
whole texts are read; every word and n-gram of theirs is kept, and no language is left out. The model holds, for
each string, only the languages that know it, so its size follows the sample. Prediction reads whole texts.

The score is the winner's share when the languages' mean log frequencies are weighed as those of a text of as many
words as this one has, but of 20 at most (words of a text depend on each other, and more would always give 1).

Defined results: null text, or text without letters: ``und`` with score 0, as is everything when there are no
labelled rows; ties go to the language that sorts first; repeated rows are treated alike; other columns are
never inputs of a prediction; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from sablevec.llm.common import mix, pieces, powers, prefix_hash
from sablevec.session import discard, materialise

LENGTHS = (4, 3, 2, 1)
BORDER = 1
SMOOTH = 0.5
#: Words of a text that count as independent of each other.
INDEPENDENT = 20
#: Parts that the sample of a language is cut into.
PARTS = 64

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def _hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = prefix_hash(codes)
    return mix((h[end] - h[start]) * powers(len(codes) + 1, True)[start] + (end - start).astype(np.uint64))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Table:
    """Strings by hash, each with the languages that know it and what it gains there over an unseen string."""

    def __init__(self, h: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: int):
        order = np.lexsort((lang, h))
        h, self.lang, n = h[order], lang[order].astype(np.int32), n[order].astype(float)
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        self.hash, self.first = h[new], np.append(np.flatnonzero(new), len(h))
        self.gain = np.log((n + SMOOTH) / SMOOTH).astype(np.float32)
        self.unseen = np.log(SMOOTH / (np.bincount(lang, n[np.argsort(order)], langs) + SMOOTH * max(1, len(self.hash)))).astype(np.float32)

    def add(self, scores: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        """Log frequencies of the strings at ``at`` into these rows of ``scores``."""
        scores[rows] = self.unseen
        size = self.first[at + 1] - self.first[at]
        place = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        scores[np.repeat(rows, size), self.lang[place]] += self.gain[place]


def _table(counts: DataFrame, langs: int) -> Table:
    """From (l, w, n): numbers of the languages, strings and counts."""
    rows = counts.toArrow()
    words = rows.column("w").combine_chunks()
    ends = np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)) if len(words) else np.zeros(0, np.int64)
    h = _hash(_codes("".join(words.to_pylist())), np.concatenate([[0], ends[:-1]]), ends) if len(words) else np.zeros(0, np.uint64)
    return Table(h, rows.column("l").to_numpy().astype(np.int64), rows.column("n").to_numpy(), langs)


def sample(docs: DataFrame, text: str, lang: str, key: str, per_lang: int, max_chars: int) -> DataFrame:
    """(lang, text) of the training rows. Rows are counted by language and part first, so no task ranks a language's rows."""
    known = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")
    size = materialise(known.groupBy("lang").agg(F.count("*").alias("n")), "sizes")  # tables of known size: Spark broadcasts small ones
    unit = F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    # the part of a row, among as many as there are samples in the language times PARTS; only the first two samples' are counted
    placed = known.join(size, "lang").withColumn("part", F.floor(unit * F.ceil(F.col("n") / per_lang) * PARTS)).where(F.col("part") < 2 * PARTS)
    parts = placed.groupBy("lang", "part").agg(F.count("*").alias("rows"), F.sum(F.length("text").cast("bigint")).alias("chars"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    met = parts.select("lang", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars"))
    met = materialise(met.where((F.col("rows") < per_lang) & (F.col("chars") < max_chars)).select("lang", "part"), "parts")
    return placed.join(met, ["lang", "part"]).select("lang", "text")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 2000, max_chars: int = 8_000_000) -> dict:
    """The model, a dict of sparse tables, from rows of ``docs`` whose language is not null."""
    some = materialise(sample(docs, text, lang, key, per_lang, max_chars), "sample")
    langs = [r.lang for r in some.select("lang").distinct().orderBy("lang").collect()]
    kind = some.schema["lang"].dataType
    # an Arrow table: rows of a list would go through Python workers, which stay beside those of the operators
    number = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(langs, to_arrow_type(kind)), "l": pa.array(range(len(langs)), pa.int32())}), StructType().add("lang", kind).add("l", "integer"))
    split = some.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n"))
    words = materialise(split.join(F.broadcast(number), "lang").select("l", "w", "n"), "words")
    model = {"langs": langs, "words": _table(words, len(langs))}
    border = chr(BORDER)
    for n in LENGTHS:
        padded = words.select("l", "n", F.concat(F.lit(border), "w", F.lit(border)).alias("p")).where(F.length("p") >= n)
        grams = padded.select("l", "n", F.explode(F.expr(f"transform(sequence(1, length(p) - {n - 1}), i -> substr(p, i, {n}))")).alias("w"))
        model[n] = _table(grams.groupBy("l", "w").agg(F.sum("n").alias("n")), len(langs))
    discard(some, words)
    return model


def _look(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each hash is in the sorted table, or -1."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def _backoff(model: dict, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mean log frequencies of the longest known n-grams of words."""
    size = end - start + 2
    ends = np.cumsum(size)
    begin = ends - size
    padded = np.full(int(ends[-1]), BORDER, np.uint32)
    inner = np.arange(len(padded)) - np.repeat(begin, size)
    inside = (inner > 0) & (inner < np.repeat(size, size) - 1)
    padded[inside] = codes[(np.repeat(start, size) + inner - 1)[inside]]
    left = np.repeat(size, size) - inner
    lang = len(model["langs"])
    total, count = np.zeros((len(padded), lang), np.float32), np.zeros(len(padded), np.float32)
    open_ = np.arange(len(padded))
    for n in LENGTHS:
        fit_ = open_[left[open_] >= n]
        at = _look(model[n].hash, _hash(padded, fit_, fit_ + n))
        hit = at >= 0
        model[n].add(total, fit_[hit], at[hit])
        count[fit_[hit]] = 1
        done = np.zeros(len(padded), bool)
        done[fit_[hit]] = True
        open_ = open_[~done[open_]]
    return np.add.reduceat(total, begin, axis=0) / np.maximum(np.add.reduceat(count, begin), 1)[:, None]


def score(texts: list, model: dict) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    langs = model["langs"]
    low = [(t or "").lower() for t in texts]
    codes = _codes("\n".join(low) + "\n")
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    w = letters()[codes]
    edge = np.diff(np.concatenate([[0], w.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, best = ["und"] * len(low), np.zeros(len(low))
    if not len(start) or not langs:
        return out, best
    unique, first, back = np.unique(_hash(codes, start, end), return_index=True, return_inverse=True)
    at = _look(model["words"].hash, unique)
    each = np.zeros((len(unique), len(langs)), np.float32)
    model["words"].add(each, np.flatnonzero(at >= 0), at[at >= 0])
    unseen = np.flatnonzero(at < 0)
    if len(unseen):
        each[unseen] = _backoff(model, codes, start[first[unseen]], end[first[unseen]])
    bounds = np.searchsorted(start, offsets)
    n = np.diff(bounds)
    has = np.flatnonzero(n)
    mean = np.add.reduceat(each[back].astype(np.float64), bounds[:-1][has], axis=0) / n[has, None]
    top = mean.argmax(1)
    scaled = np.exp((mean - mean.max(1, keepdims=True)) * np.minimum(n[has], INDEPENDENT)[:, None])
    best[has] = 1 / scaled.sum(1)
    for i, k in zip(has, top):
        out[i] = langs[k]
    return out, best


def _predict(docs: DataFrame, model: dict, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``k0`` and so on for ``keep``, ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)], *([] if text in keep else [F.col(f"`{text}`").alias("t")]))
    column = f"k{keep.index(text)}" if text in keep else "t"  # a kept text crosses once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column):
                lang, best = score(part.column(column).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(lang), pa.array(best)], [*part.schema.names[: len(keep)], "lang_pred", "score"])

    kinds = ", ".join(f"k{i} {src.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    return src.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def predict(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` for each row."""
    return _predict(docs, model, text, keep).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "lang_pred", "score")


def keep_known(docs: DataFrame, model: dict, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without those that have no language; a missing label is filled in."""
    found = _predict(docs, model, text, tuple(docs.columns)).where("lang_pred <> 'und'")
    return found.select(*[(F.coalesce(f"k{i}", "lang_pred") if k == lang else F.col(f"k{i}")).alias(k) for i, k in enumerate(docs.columns)])


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
