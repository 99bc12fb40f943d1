"""SentencePiece models on the tokenizers library.

The model file (a protobuf message) is parsed field by field; its normaliser, metaspace marker, scores and byte
pieces are rebuilt as a tokenizers pipeline, for unigram and BPE models alike.

Texts are normalised and cut before each run of markers, where no piece can cross (checked against the
vocabulary). Each distinct cut of a batch is encoded by the library, in batches on its own threads, and decoded
again; texts are put together from them. A worker keeps what it has encoded, up to ``KEPT`` cuts. A model whose
pieces can hold a marker inside, or that adds none, and a unigram model, whose sums of scores round otherwise in
another place of a text, is given whole texts instead.

Parity is verified, not assumed: the ids of every distinct cut are compared with the sentencepiece library's, and a
text with a cut that differs is compared as a whole. ``parity`` tells whether a text's ids are the library's,
``exact`` whether they decode to the text itself (not so for text that holds the marker character, or that the
model's normaliser changes). All ids come from the tokenizers pipeline.

Defined results: null or empty text has no tokens and decodes to the empty text; repeated rows are treated
alike; other columns are kept or ignored as asked; an empty table gives an empty result; whole texts are encoded.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sablevec.llm.common import CACHES, pieces

MARK = "▁"
#: Kinds of a piece and of a model, as fixed by the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Encoded cuts that a worker keeps between batches.
KEPT = 100_000
#: Strings that new cuts are joined to for the library.
RUNS = 16


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of a protobuf message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, i = b[i : i + size], i + size
        elif kind == 2:
            size, i = _varint(b, i)
            value, i = b[i : i + size], i + size
        else:
            raise ValueError(f"wire type {kind} isn't used by these models")
        yield key >> 3, value


def parse(data: bytes) -> dict:
    """Pieces as (text, score, kind), and what the trainer and normaliser messages fix."""
    out = {"pieces": [], "kind": UNIGRAM, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True, "suffix": False}
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            out["pieces"].append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
        elif number == 2:
            f = dict(_fields(value))
            out |= {"kind": f.get(3, UNIGRAM), "byte_fallback": bool(f.get(35, 0)), "suffix": bool(f.get(24, 0))}
        elif number == 3:
            f = dict(_fields(value))
            out |= {"charsmap": f.get(2, b""), "dummy_prefix": bool(f.get(3, 1)), "squeeze": bool(f.get(4, 1)), "escape": bool(f.get(5, 1))}
    return out


def build(data: bytes):
    """A tokenizers pipeline that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = parse(data)
    rows = m["pieces"]
    if m["suffix"] or not m["escape"] or any(kind == USER_DEFINED for *_, kind in rows):
        raise ValueError("models with a suffix marker, plain spaces or user-defined pieces aren't supported")
    unknown = next((i for i, x in enumerate(rows) if x[2] == UNKNOWN), None)
    if m["kind"] == UNIGRAM:
        # no text is matched by a control piece (normalised text has no space) nor, but as a last resort, by a byte's name
        reach = {NORMAL: lambda p, s: (p, s), BYTE: lambda p, s: (p, -1e4)}
        model = models.Unigram([reach.get(kind, lambda p, s: (f" {p}", s))(p, s) for p, s, kind in rows], unknown, m["byte_fallback"])
    elif m["kind"] == BPE:
        score = {p: s for p, s, kind in rows if kind in (NORMAL, UNUSED)}
        splits = [(-s, p, i) for p, s in score.items() for i in range(1, len(p)) if p[:i] in score and p[i:] in score]
        merges = [(p[:i], p[i:]) for _, p, i in sorted(splits)]
        model = models.BPE({p: i for i, (p, *_) in enumerate(rows)}, merges, unk_token=rows[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=m["byte_fallback"])
    else:
        raise ValueError("only unigram and BPE models are supported")
    steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
    if m["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if m["dummy_prefix"] else []
    out = Tokenizer(model)
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(MARK in p.lstrip(MARK) for p, *_ in rows):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if m["dummy_prefix"] else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


class Codec:
    """Encodes and decodes texts, and compares both with the sentencepiece library."""

    def __init__(self, data: bytes):
        import sentencepiece
        from tokenizers import decoders, normalizers

        m = parse(data)
        self.cuts = build(data)
        self.normalizer, self.decoder = self.cuts.normalizer, self.cuts.decoder  # of whole texts
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.apart = m["kind"] == BPE and m["dummy_prefix"] and self.cuts.pre_tokenizer is not None
        if self.apart:  # cuts are normalised already, and only a text's first one loses its marker
            self.cuts.normalizer = normalizers.Sequence([])
            self.cuts.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.plain = not m["charsmap"] and not m["squeeze"]  # the normaliser is a marker before the text and for each space
        self.begins = np.array([p.startswith(MARK) for p, *_ in m["pieces"]])
        self.markers = np.array([p.strip(MARK) == "" for p, *_ in m["pieces"]])
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}  # the number of each cut
        self.slot = np.zeros(0, np.int64)  # and where its ids are
        self.flat, self.first, self.same = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)
        self.back: list[str] = []

    def _joined(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, object, list[str]]:
        """Ids of cuts, how many each has, which are the library's, and the cuts decoded.

        Cuts are encoded one behind another: each begins at the next marker that no other one precedes. Cuts of
        nothing but markers, which come last, are encoded alone.
        """
        text = sum(x[-1] != MARK for x in new)
        cuts = sorted({text * i // RUNS for i in range(RUNS + 1)} | set(range(text, len(new) + 1)))
        parts = [new[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        runs = ["".join(p) for p in parts]
        got = [e.ids for e in self.cuts.encode_batch_fast(runs, add_special_tokens=False)]
        ids = [np.array(g, np.int32) for g in got]
        begin = [np.flatnonzero(self.begins[g] & ~np.concatenate([[False], self.markers[g[:-1]]])) for g in ids]
        if [len(x) for x in begin] != [len(p) for p in parts]:
            return self._singly(new)
        size = np.concatenate([np.diff(np.append(x, len(g))) for x, g in zip(begin, ids, strict=True)])
        head, plain = self.library.encode("a"), [r.replace(MARK, " ") for r in runs]
        want = self.library.encode(["a" + r for r in plain], num_threads=1)
        if any(w != head + g for w, g in zip(want, got, strict=True)) or self.cuts.decode_batch(got, skip_special_tokens=False) != plain:
            return self._singly(new)
        return np.concatenate(ids), size, True, [x.replace(MARK, " ") for x in new]

    def _singly(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, object, list[str]]:
        ids = [e.ids for e in self.cuts.encode_batch_fast(new, add_special_tokens=False)]
        if self.apart:  # behind a word of their own, as the library adds a marker to the first one
            head = self.library.encode("a")
            want = self.library.encode(["a" + x.replace(MARK, " ") for x in new], num_threads=1)
        else:
            head, want = [], self.library.encode(new, num_threads=1)
        same = [w == head + i for w, i in zip(want, ids, strict=True)]
        return np.array([x for i in ids for x in i], np.int32), np.array([len(i) for i in ids], np.int64), same, self.cuts.decode_batch(ids, skip_special_tokens=False)

    def _learn(self, new: list[str]) -> None:
        order = sorted(range(len(new)), key=lambda i: new[i][-1] == MARK) if self.apart else range(len(new))
        ids, size, same, back = (self._joined if self.apart else self._singly)([new[i] for i in order])
        slot = np.empty(len(new), np.int64)
        slot[list(order)] = np.arange(len(new)) + len(self.slot)
        self.slot, self.flat = np.concatenate([self.slot, slot]), np.concatenate([self.flat, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        self.same = np.concatenate([self.same, np.broadcast_to(same, len(new))])
        self.back += back

    def run(self, texts: list[str], kept: int | None = None) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """All ids, where each text's begin (and the end), the decoded texts, and whether the ids are the library's."""
        if len(self.at) > (KEPT if kept is None else kept):
            self.forget()
        if self.apart:
            normal = (lambda t: t and MARK + t.replace(" ", MARK)) if self.plain else self.normalizer.normalize_str
            parts = [_CUT.findall(normal(t)) for t in texts]
        else:
            parts = [[t] for t in texts]
        at, known = self.at, len(self.at)
        number = [at.setdefault(x, len(at)) for p in parts for x in p]
        if len(at) > known:
            self._learn(list(itertools.islice(at, known, None)))
        of = self.slot[np.array(number, np.int64)]
        text = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        size = self.first[of + 1] - self.first[of]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.first[of] - ends[:-1], size) + np.arange(ends[-1])]
        begin = ends[text]
        wrong = np.concatenate([[0], np.cumsum(~self.same[of])])
        parity = wrong[text[1:]] == wrong[text[:-1]]
        for i in np.flatnonzero(~parity):
            parity[i] = self.library.encode(texts[i]) == ids[begin[i] : begin[i + 1]].tolist()
        piece = self.back.__getitem__
        back = ["".join(map(piece, of[a:b].tolist())) for a, b in zip(text, text[1:], strict=False)]
        return ids, begin, [t.removeprefix(" ") for t in back] if self.apart else back, parity


_CUT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@functools.lru_cache(2)
def _codec(data: bytes) -> Codec:
    return Codec(data)


CACHES["sp_codec"] = _codec.cache_clear


def encode(data: bytes, texts: list) -> list[list[int]]:
    ids, begin, *_ = _codec(data).run([t or "" for t in texts])
    return [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)]


def decode(data: bytes, ids: list[list[int]]) -> list[str]:
    codec = _codec(data)
    return [codec.decoder.decode([codec.cuts.id_to_token(i) for i in x]) for x in ids]


def verify(data: bytes, texts: list[str]) -> list[int]:
    """Positions of texts whose ids differ from the sentencepiece library's, compared as wholes."""
    return [i for i, (a, b) in enumerate(zip(encode(data, texts), _codec(data).library.encode(texts, num_threads=1), strict=True)) if a != b]


def load(spark, path: str) -> bytes:
    """The model file, read by the driver's file system or by Spark (a bounded file, a few MB)."""
    import os

    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def codec(docs: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded", "exact", "parity"), kept: int = KEPT) -> DataFrame:
    """``keep`` columns and the asked ``outputs`` of encoding each text and decoding it again; a worker keeps ``kept`` cuts, which changes time and memory only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "exact": "boolean", "parity": "boolean"}
    src = docs.select(*[docs[f"`{k}`"].alias(f"k{i}") for i, k in enumerate(keep)], docs[f"`{text}`"].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t", 1 << 20, "sp_codec"):
                texts = [t or "" for t in part.column("t").to_pylist()]
                ids, begin, back, parity = _codec(shared.value).run(texts, kept)
                made = {"n_tokens": pa.array(np.diff(begin), pa.int64()), "parity": pa.array(parity)}
                if "ids" in outputs:
                    made["ids"] = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids))
                if "ids_sha256" in outputs:
                    made["ids_sha256"] = pa.array([hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(begin, begin[1:], strict=False)], pa.string())
                if "decoded" in outputs:
                    made["decoded"] = pa.array(back, pa.string())
                if "exact" in outputs:
                    made["exact"] = pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *[made[o] for o in outputs]], [*part.schema.names[: len(keep)], *outputs])

    schema = ", ".join([f"k{i} {src.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))] + [f"{o} {kinds[o]}" for o in outputs])
    out = src.mapInArrow(run, schema)
    return out.select(*[out[f"k{i}"].alias(k) for i, k in enumerate(keep)], *outputs)
