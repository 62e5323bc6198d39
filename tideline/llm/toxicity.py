"""Toxicity by compression distance: separate zstandard dictionaries trained on toxic and on ordinary text.

A window of a text (some words; one by default) is compressed with each dictionary; the shorter it gets with the toxic
one, the nearer it is to toxic text. Windows whose advantage reaches a threshold are alarms, and a logistic function of a
text's alarms is its score. Threshold and function are calibrated on each half of the labelled texts by dictionaries that
were trained on the other half.

Lengths are whole bytes, and zstandard looks for no match in the last eight bytes of its input. So each byte of a window
and of a dictionary is written as WIDTH bytes, of which a match takes as few as before, and a window ends with a pad
that matches nothing.

What tells toxic from ordinary text may be a small part of it. So the toxic dictionary is trained on the windows that
significantly more toxic than ordinary texts hold (a bound on the tail of a Poisson distribution, over all that were
tried; near copies count once), and the ordinary one on the others, the commonest first.

A window's lengths depend on the window alone: each distinct one of a batch is compressed once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, hashed_words, held_out, mix, owner, rolling, sampled, slices, words_of

#: About this many labelled texts of each kind are learned from (defaults of parameters), none of more characters.
MOST_TOXIC, MOST_ORDINARY, LONGEST = 3_000, 6_000, 50_000
#: Bytes that a byte becomes; the pad; bytes of a dictionary before that, at most; bytes of a window that are compared.
WIDTH, PAD, DICTIONARY, WINDOW = 4, bytes(range(1, 9)), 32_000, 256
#: Advantages that may be the threshold, in bytes of the widened window.
THRESHOLDS = range(2, 60, 2)


def widened(data: bytes) -> bytes:
    """Each byte as WIDTH bytes that no other byte has at the same places, nor often at others."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    return ((a + 1) * np.uint32(0x9E3779B1)).astype("<u4").tobytes()


def windows(texts: pa.Array, words: int) -> tuple[np.ndarray, pa.Array]:
    """Offsets by text, and all windows: runs of `words` words, lower-cased, each word after a space. Null and empty
    texts have none; the last window of a text may have fewer words."""
    off, flat = words_of(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    if words > 1:
        count = np.diff(off)
        number = np.arange(len(flat)) - np.repeat(off[:-1], count)
        first = np.append(np.flatnonzero(number % words == 0), len(flat))
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), flat.cast(pa.string()))
        flat, off = pc.binary_join(lists, " ").cast(pa.large_string()), np.concatenate([[0], np.cumsum(-(-count // words))])
    return off, flat


class Lengths:
    """Compresses windows with one dictionary. A binary tree finds the longest match; chains would give up on the many
    places that begin alike."""

    def __init__(self, content: bytes):
        how = dict(window_log=18, chain_log=16, hash_log=16, search_log=9, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2)
        self.params = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, **how)
        made = zstandard.ZstdCompressionDict(content or PAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(compression_params=self.params)
        self.c = zstandard.ZstdCompressor(dict_data=made, compression_params=self.params)

    def of(self, data: bytes, sizes: np.ndarray) -> np.ndarray:
        """Compressed lengths of the pieces of data, of these sizes."""
        at = np.stack([np.cumsum(sizes) - sizes, sizes], 1).astype("<u8")
        made = self.c.multi_compress_to_buffer(zstandard.BufferWithSegments(data, at.tobytes()), threads=0)
        return np.array([len(x) for x in made], np.int64)


class Model:
    """Two dictionaries, the threshold of an alarm and the weights of a text's score; plain data, so it can be sent."""

    def __init__(self, toxic: bytes, ordinary: bytes, words: int):
        self.toxic, self.ordinary, self.words = toxic, ordinary, words
        self.threshold, self.weights, self.prior = 1 << 30, np.zeros(4), 0.5
        self.open()

    def open(self) -> None:
        self.pair = Lengths(widened(self.toxic)), Lengths(widened(self.ordinary))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "pair"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.open()

    def advantages(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets by text, and by how much shorter each window gets with the toxic dictionary. Of a window of more than
        WINDOW bytes (a word of that length) each piece of that size is compressed, and the greatest advantage counts."""
        off, flat = windows(texts, self.words)
        if not len(flat):
            return off, np.zeros(0, np.int64)
        enc = flat.dictionary_encode()
        pieces, which = [], []
        for i, w in enumerate(enc.dictionary.to_pylist()):
            b = b" " + w.encode()
            for s in range(0, len(b), WINDOW):
                pieces.append(b[s : s + WINDOW + 16])
                which.append(i)
        size = np.array([len(p) for p in pieces], np.int64)
        wide = np.frombuffer(widened(b"".join(pieces)), np.uint8)
        step = 100_000
        ends = np.cumsum(size) * WIDTH
        diff = np.zeros(len(pieces), np.int64)
        for s in range(0, len(pieces), step):
            e = min(s + step, len(pieces))
            each = size[s:e] * WIDTH
            start = ends[s:e] - each
            out = np.zeros(int(each.sum()) + len(PAD) * (e - s), np.uint8)
            to = np.arange(int(each.sum())) + np.repeat(np.arange(e - s) * len(PAD), each)
            out[to] = wide[start[0] : ends[e - 1]]
            pad = np.cumsum(each + len(PAD))[:, None] - len(PAD) + np.arange(len(PAD))
            out[pad] = np.frombuffer(PAD, np.uint8)
            data = out.tobytes()
            toxic, ordinary = (x.of(data, each + len(PAD)) for x in self.pair)
            diff[s:e] = ordinary - toxic
        best = np.full(len(enc.dictionary), -(1 << 20), np.int64)
        np.maximum.at(best, np.array(which), diff)
        return off, best[enc.indices.to_numpy()]

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """For each text: one, the logarithm of its alarms and one, their share, its greatest advantage."""
        off, diff = self.advantages(texts)
        return evidence(off, diff, self.threshold)

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(texts), self.prior)
        return logistic(self.evidence(texts) @ self.weights)


def evidence(off: np.ndarray, diff: np.ndarray, threshold: int) -> np.ndarray:
    n, own = len(off) - 1, owner(off)
    alarms = np.bincount(own, diff >= threshold, n)
    most = np.full(n, -10.0)
    np.maximum.at(most, own, diff)
    return np.stack([np.ones(n), np.log1p(alarms), np.minimum(alarms / np.maximum(np.diff(off), 1), 0.1) * 20, np.clip(most, -10, 40) / 20], 1)


def logistic(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of the logistic function, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = logistic(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


def holders(texts: list[str], words: int) -> Counter:
    """In how many texts each window is."""
    out: Counter = Counter()
    for x in texts:
        off, flat = windows(pa.array([x], pa.large_string()), words)
        out.update(flat.unique().to_pylist())
    return out


def telling(own: Counter, n_own: int, other: Counter, n_other: int) -> dict[str, int]:
    """Windows that significantly more texts of one kind hold: at least four times the other's share, and too many for
    chance (Chernoff's bound on a Poisson tail), even if all windows had a try."""
    out, tries = {}, np.log(100 * max(1, len(own)))
    for w, k in own.items():
        expected = n_own * (other.get(w, 0) + 1) / (n_other + 2)
        if k > 4 * expected and k * np.log(k / expected) - (k - expected) > tries:
            out[w] = k
    return out


def trained(samples: dict[str, int], size: int) -> bytes:
    """A dictionary's content: zstandard's trainer over the windows as often as documents hold them, then as many of the
    commonest windows as still fit, the commonest last (nearest). Few samples can't be trained on; then those alone."""
    ranked = [b" " + w.encode() for w in sorted(samples, key=lambda w: (-samples[w], w))]
    plain, room = [], size
    for w in ranked:
        if len(w) > room:
            break
        plain.append(w)
        room -= len(w)
    content = b"".join(reversed(plain))
    many = [b" " + w.encode() for w in sorted(samples) for _ in range(min(samples[w], 50))]
    try:
        made = zstandard.train_dictionary(max(256, min(room, len(content))), many, k=32, d=8, level=3).as_bytes() if room >= 256 else b""
    except zstandard.ZstdError:
        made = b""
    return (made + content)[-size:]


def unlike(texts: list[str]) -> list[str]:
    """The texts without near copies of those before: such as share the least hash of their word shingles, by one of
    four orders. A family of copies would make all its words telling."""
    seen: set[tuple[int, int]] = set()
    out = []
    for x in texts:
        h = hashed_words(pa.array([x], pa.large_string()))[3]
        g = rolling(h, min(SHINGLE_WORDS, max(1, len(h))))
        least = {(k, int(mix(g ^ np.uint64(k * 0x9E3779B97F4A7C1)).min())) for k in range(4)} if len(g) else {(-1, 0)}
        if not least & seen:
            out.append(x)
        seen |= least
    return out


def dictionaries(toxic: list[str], ordinary: list[str], words: int) -> Model:
    t, o = holders(toxic, words), holders(ordinary, words)
    marks = telling(t, len(toxic), o, len(ordinary))
    content = trained(marks, DICTIONARY) if marks else b""
    usual = {w: k for w, k in o.most_common(20_000) if w not in marks}
    return Model(content, trained(usual, DICTIONARY), words)


def fit(toxic: list[str], ordinary: list[str], words: int = 1, seed: int = 0) -> Model:
    """Dictionaries from all texts; threshold and weights from each half by dictionaries of the other half."""
    r = np.random.default_rng(seed)
    toxic, ordinary = unlike(toxic), unlike(ordinary)
    halves = [[[texts[i] for i in order[k::2]] for k in (0, 1)] for texts in (toxic, ordinary) for order in (r.permutation(len(texts)),)]
    found, y, ends = [], [], [np.zeros(1, np.int64)]
    for k in (0, 1):
        m = dictionaries(halves[0][1 - k], halves[1][1 - k], words)
        off, diff = m.advantages(pa.array(halves[0][k] + halves[1][k], pa.large_string()))
        ends.append(off[1:] + ends[-1][-1])
        found.append(diff)
        y.append(np.repeat([1.0, 0.0], [len(halves[0][k]), len(halves[1][k])]))
    off, diff, y = (np.concatenate(x) for x in (ends, found, y))
    m = dictionaries(toxic, ordinary, words)
    m.prior = float(y.mean())
    best = None
    for threshold in THRESHOLDS:
        x = evidence(off, diff, threshold)
        w = regression(x, y)
        p = np.clip(logistic(x @ w), 1e-9, 1 - 1e-9)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        if best is None or loss < best[0] - 1e-9:
            best = loss, threshold, w
    _, m.threshold, m.weights = best
    return m


def labelled(docs: DataFrame, labels: DataFrame, toxic: int, bound: int) -> list[str]:
    """About `bound` texts of that label, of those that are not held out, chosen by a hash of the id; texts of over
    LONGEST characters are not learned from. Labels given twice count as their greatest."""
    marked = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.col("toxic") == toxic)
    rows = docs.where(F.length("text") <= LONGEST).join(sampled(marked.select("doc_id"), "doc_id", bound), "doc_id", "left_semi")
    return sorted({r[0] for r in rows.select("text").collect()})


def model(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_ordinary: int = MOST_ORDINARY, words: int = 1) -> Model | None:
    """None where there are no labelled texts of one kind."""
    toxic, ordinary = labelled(docs, labels, 1, most_toxic), labelled(docs, labels, 0, most_ordinary)
    return fit(toxic, ordinary, words) if toxic and ordinary else None


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, words: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    Null and empty texts are scored as texts without windows; a text of any length counts whole, and a word of any length
    in pieces. Without labelled texts of both kinds every score is 0.5. Rows with a null doc_id are scored, and are not held out;
    nothing is learned from them. A score equal to the threshold is toxic. Repeated rows come out as often as they come
    in; other columns of docs are ignored; an empty table gives an empty result.
    """
    m = model(docs, labels, words=words)
    sent = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches):
            s = m.score(b.column(1)) if m else np.full(b.num_rows, 0.5)
            yield pa.record_batch([b.column(0), pa.array(s)], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def windows_of(docs: DataFrame, m: Model) -> DataFrame:
    """The alarms of each text: doc_id, the window's number in the text (from 0), its text and its advantage."""
    sent = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches):
            off, diff = m.advantages(b.column(1))
            _, flat = windows(b.column(1), m.words)
            own, at = owner(off), np.flatnonzero(diff >= m.threshold)
            yield pa.record_batch([b.column(0).take(pa.array(own[at])), pa.array(at - off[own[at]]), flat.take(pa.array(at)).cast(pa.string()), pa.array(diff[at])], names=["doc_id", "window", "text", "advantage"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, window long, text string, advantage long")
