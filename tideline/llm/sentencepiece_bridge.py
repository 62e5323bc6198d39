"""SentencePiece encoding and decoding on the backend of the tokenizers library.

The model's protobuf is parsed here (wire format only), and its normaliser, white-space marker, scores and byte
fallback are rebuilt as a tokenizers pipeline: a unigram model keeps its scores; a BPE model gets its merges in
order of the scores of what they make. Batches are encoded by the library's threads inside each task.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw_bytes, slices

MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Runs that a task remembers, about 200 bytes each.
MOST_KNOWN = 300_000
#: Bytes of text that are cut into runs at a time, and new runs that are encoded as one text.
RUN_BYTES, TOGETHER = 4_000_000, 64


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 BPE
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    extra_spaces_removed: bool = True
    spaces_escaped: bool = True


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at, end = 0, len(data)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"not a SentencePiece model: wire type {kind}")


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in fields(value):
                if k == 1:
                    piece = v.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            spec = dict(fields(value))
            m.kind, m.byte_fallback = spec.get(3, 1), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(fields(value))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix, m.extra_spaces_removed, m.spaces_escaped = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    m.unk_id = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """For BPE: each way to make a piece of two others, best score first."""
    rank = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
    made = []
    for piece, i in rank.items():
        ways = [(rank[piece[:k]], rank[piece[k:]], piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in rank and piece[k:] in rank]
        made.extend((-m.pieces[i][1], i, *way) for way in sorted(ways))
    made.sort(key=lambda x: x[:4])
    return [(x[4], x[5]) for x in made]


def by_runs(m: Model) -> bool:
    """Whether a text can be encoded run by run: no piece goes on after a run of markers, so no merge crosses
    the run's start, and the normaliser does nothing but escape spaces. See also line_end()."""
    inner = any(MARKER in p.strip(MARKER) or (p.strip(MARKER) and p.endswith(MARKER)) for p, _, kind in m.pieces if kind in (NORMAL, USER))
    return m.kind == 2 and not inner and not m.charsmap and not m.extra_spaces_removed and m.spaces_escaped


def line_end(m: Model) -> int | None:
    """The id that each line feed has, whatever stands beside it: no piece joins it to something, and it is no unknown
    that could be fused with another."""
    if not m.byte_fallback or any("\n" in p and p != "\n" for p, _, _ in m.pieces):
        return None
    at = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    return at.get("\n", at.get("<0x0A>"))


def joining(m: Model) -> np.ndarray:
    """Of two bytes, the first times 256 and the second: whether they lie in one character, or end and begin two that
    some piece has side by side. No merge crosses another place."""
    table = np.zeros((256, 256), bool)
    table[:, 0x80:0xC0] = True
    for p, _, _ in m.pieces:
        chars = [c.encode() for c in p.replace(MARKER, " ")]
        for a, b in itertools.pairwise(chars):
            table[a[-1], b[0]] = True
    return table.ravel()


def runs_of(texts: list[str], joins: np.ndarray) -> tuple[np.ndarray, pa.LargeStringArray]:
    """Number of each text's first run, and all runs: texts are cut wherever two characters can't join. An empty text
    has no run."""
    data, off = raw_bytes(pa.array(texts, pa.large_string()))
    begins = np.zeros(len(data), bool)
    begins[1:] = ~joins[data[:-1].astype(np.uint16) << 8 | data[1:]]
    begins[off[:-1][np.diff(off) > 0]] = True
    start = np.flatnonzero(begins)
    runs = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data))), pa.py_buffer(data))
    return np.searchsorted(start, off), runs


def build(m: Model, prefix: bool = True):
    """The model as a tokenizers.Tokenizer; without prefix, for runs of a text."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.kind == 1:
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback))
    elif m.kind == 2:
        own = [p for p, _, kind in m.pieces if kind == USER]
        t = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback, ignore_merges=bool(own)))
        if own:  # pieces that users define are split off first, the longest at each place
            t.pre_tokenizer = pre_tokenizers.Split(Regex("|".join(re.escape(p) for p in sorted(own, key=len, reverse=True))), "isolated")
    else:
        raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.extra_spaces_removed:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A +| +\z"), "")]  # spaces only, as the library does
    if m.dummy_prefix and prefix:
        steps.append(normalizers.Prepend(" "))
    if m.spaces_escaped:
        steps.append(normalizers.Replace(" ", MARKER))
    t.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARKER, " ")] + ([decoders.ByteFallback()] if m.byte_fallback else []) + [decoders.Fuse()]
    if m.dummy_prefix and prefix:
        back.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(back)
    t.encode_special_tokens = True
    return t


def together(runs: list[str]) -> list[str]:
    """Texts of TOGETHER runs each, every run after a line feed."""
    return ["\n" + "\n".join(runs[i : i + TOGETHER]) for i in range(0, len(runs), TOGETHER)]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of spans, one span after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Backend:
    """Encodes and decodes lists of texts."""

    def __init__(self, data: bytes):
        m = parse(data)
        self.data, self.feed, self.joins = data, line_end(m), joining(m)
        self.whole, self.prefix = build(m), " " if m.dummy_prefix else ""
        self.runs = build(m, prefix=False) if by_runs(m) and self.feed is not None else None
        self.forget()

    def forget(self) -> None:
        """Empties the table of runs seen so far: a run's number, its ids, their number, if they decode to it, if they are
        those of the sentencepiece library, and in how many calls it was met. The line feed is its first."""
        self.known: dict[str, int] = {"\n": 0}
        self.flat, self.size, self.met = np.array([self.feed or 0], np.int32), np.ones(1, np.int64), np.zeros(1, np.int64)
        self.good, self.same = np.ones(1, bool), np.ones(1, bool)

    def thin(self) -> None:
        """Forgets all runs but the line feed and those met more than once, half the table at most."""
        names = list(self.known)
        kept = 1 + np.flatnonzero(self.met[1:] > 1)
        kept = np.sort(np.append(0, kept[np.argsort(-self.met[kept], kind="stable")[: MOST_KNOWN // 2]]))
        self.known = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.flat = self.flat[spread((np.cumsum(self.size) - self.size)[kept], self.size[kept])]
        self.size, self.good, self.same, self.met = self.size[kept], self.good[kept], self.same[kept], np.maximum(self.met[kept] // 2, 1)

    def apart(self, ids: list[list[int]]) -> list[list[int]]:
        """The ids of each run, from those of texts that begin each run with a line feed."""
        flat = list(itertools.chain.from_iterable(ids))
        cut = np.flatnonzero(np.array(flat, np.int32) == self.feed)
        skip = np.cumsum([0, *map(len, ids)])  # what comes before a text's first line feed is a dummy prefix
        end = np.append(cut[1:], len(flat))
        first = np.searchsorted(cut, skip[1:-1])
        end[first - 1] = skip[1:-1]
        return [flat[i:j] for i, j in zip((cut + 1).tolist(), end.tolist(), strict=True)]

    def theirs(self, runs: list[str]) -> list[list[int]]:
        """The library's ids of runs. Its dummy prefix comes before the first line feed."""
        return self.apart(original(self.data).encode(together(runs), num_threads=1))

    def learn(self, new: list[str]) -> None:
        """Encodes runs, decodes them and compares them with the library's. TOGETHER of them are one text, parted by line
        feeds, which no merge crosses."""
        flat, size, good, same = [self.flat], [self.size], [self.good], [self.same]
        for at in range(0, len(new), 64 * TOGETHER):  # bounds what the tokenizers hold beside the table
            part = new[at : at + 64 * TOGETHER]
            whole = [e.ids for e in self.runs.encode_batch_fast(together(part), add_special_tokens=False)]
            ids = self.apart(whole)
            back = "".join(self.runs.decode_batch(whole, skip_special_tokens=False)).split("\n")[1:]
            if back != part:
                back = self.runs.decode_batch(ids, skip_special_tokens=False)
            flat.append(np.array(list(itertools.chain.from_iterable(ids)), np.int32))
            size.append(np.array([len(i) for i in ids], np.int64))
            good.append(np.array([a == b for a, b in zip(back, part, strict=True)], bool))
            same.append(np.array([a == b for a, b in zip(ids, self.theirs(part), strict=True)], bool))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.flat, self.size, self.good, self.same = map(np.concatenate, (flat, size, good, same))
        self.met = np.append(self.met, np.zeros(len(new), np.int64))

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, np.ndarray, list[bool | None]]:
        """ids, whether decoding them gives the text back, and whether they are the library's. Where runs can be
        encoded alone, each distinct run is encoded, decoded and compared once, as long as the table of MOST_KNOWN
        runs holds it. The last is None where it takes the whole text to tell: without runs, or for spaces at its end
        (the library sets no prefix before nothing) or U+2581."""
        if self.runs is None:
            ids = [e.ids if x else [] for x, e in zip(texts, self.whole.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
            return pa.array(ids, pa.list_(pa.int32())), np.array([a == b for a, b in zip(self.decode(ids), texts, strict=True)], bool), [None] * len(texts)
        bounds, runs = runs_of([self.prefix + x.replace(MARKER, " ") if x else "" for x in texts], self.joins)
        runs = runs.dictionary_encode()
        vocab = runs.dictionary.to_pylist()
        if len(self.known) + len(vocab) > MOST_KNOWN:
            self.thin()
        self.learn([r for r in vocab if r not in self.known])
        of = np.array([self.known[r] for r in vocab], np.int64)
        self.met[of] += 1
        which = of[runs.indices.to_numpy()]
        size, start = self.size[which], (np.cumsum(self.size) - self.size)[which]
        count = lambda wrong: np.diff(np.concatenate([[0], np.cumsum(wrong[which])])[bounds])
        plain = np.array([MARKER not in x for x in texts], bool)
        trip = plain & (count(~self.good) == 0)
        same = [bool(n == 0) if p and not x.endswith(" ") else None for x, p, n in zip(texts, plain, count(~self.same), strict=True)]
        ends = np.concatenate([[0], np.cumsum(size)])[bounds]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(self.flat[spread(start, size)])), trip, same

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)


@functools.cache
def loaded(data: bytes) -> Backend:
    return Backend(data)


@functools.cache
def original(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """A model file is a parameter of a few hundred kilobytes, read once by the driver."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, parity_every: int = 16) -> DataFrame:
    """docs with ids (array<int>), n_ids, round_trip and parity added (over columns of those names).

    Null text gives null ids, n_ids 0 and null checks; an empty text gives no ids. round_trip: decoding gives the
    text back, which a normaliser may change and U+2581 in a text always does. parity: the ids equal those of
    the sentencepiece library, for every row: run by run where the text's ids are those of its runs, else for the
    whole text. Where it is false, as unigram models have ties that the two libraries break differently, ids are those of the
    sentencepiece library all the same. One row in parity_every, by a hash of the text, is compared as a whole besides (1: all; 0: none).
    Special pieces in a text are ordinary text. Repeated rows come out as often as they come in; an empty table
    gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("ids", "n_ids", "round_trip", "parity")]
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, s = loaded(sent.value), original(sent.value)
        for b in slices(batches, names.index("text"), RUN_BYTES):
            text = b.column(names.index("text")).to_pylist()
            asked = b.column(len(names)).to_pylist()
            ids, trip, by_run = t.encode([x or "" for x in text])
            null = pa.array([x is None for x in text], pa.bool_())
            same = [None if x is None else k for x, k in zip(text, by_run, strict=True)]
            check = [i for i, x in enumerate(text) if x is not None and (asked[i] or not same[i])]
            other: dict[int, list[int]] = {}
            for i, want in zip(check, s.encode([text[i] for i in check], num_threads=1) if check else [], strict=True):
                if want != ids[i].values.to_pylist():
                    other[i] = want
                same[i] = same[i] is not False and i not in other
            if other:  # ties that the two libraries break differently: the model's own library is right
                ids = pa.array([other.get(i, x) for i, x in enumerate(ids.to_pylist())], ids.type)
                for i, want in other.items():
                    trip[i] = s.decode(want) == text[i]
            made = [pc.if_else(null, pa.scalar(None, ids.type), ids), pc.list_value_length(ids).cast(pa.int64()), pc.if_else(null, pa.scalar(None, pa.bool_()), pa.array(trip)), pa.array(same, pa.bool_())]
            yield pa.record_batch([*b.columns[: len(names)], *made], names=[*names, "ids", "n_ids", "round_trip", "parity"])

    asked = F.pmod(F.xxhash64("text"), F.lit(parity_every)) == 0 if parity_every else F.lit(False)
    rows = docs.select(*names, asked.alias("__asked"))
    schema = T.StructType(list(docs.select(*names).schema.fields)).add("ids", T.ArrayType(T.IntegerType())).add("n_ids", T.LongType()).add("round_trip", T.BooleanType()).add("parity", T.BooleanType())
    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """rows with `decoded` added: the text of the column ids; null for null ids, and empty for none."""
    names = rows.columns
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(sent.value)
        for b in batches:
            ids = b.column(names.index("ids")).to_pylist()
            full = [i for i, x in enumerate(ids) if x is not None]
            out: list = [None] * len(ids)
            for i, x in zip(full, t.decode([ids[i] for i in full]), strict=True):
                out[i] = x
            yield pa.record_batch([*b.columns, pa.array(out, pa.string())], names=[*names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
