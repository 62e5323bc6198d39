"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk.

A small network over features of a whole text is fitted to trusted positives and unlabelled texts:
    prior * E_P[loss(g, +)] + max(0, E_U[loss(g, -)] - prior * E_P[loss(g, -)]),
with the logistic loss. Where the second term turns negative, its gradient is taken back (the correction that
keeps the estimated risk of the negatives from going below zero).

The fit starts on a bounded sample and goes on with gradients over every unlabelled text, summed on the executors.
The class prior is estimated from positives and unlabelled texts alone: where a ranking puts nearly only positives on
top, the share of the unlabelled above a threshold, divided by that of positives kept from the ranking's fit, bounds
the prior from above; the tightest bound is taken. The score's offset is set so that all unlabelled texts have that
mean. Labelled negatives are used for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, materialise, owner, raw_bytes, sampled, slices, words_of

#: About this many positives are learned from, and so many texts start the fit; defaults of parameters.
MOST_POSITIVE, MOST_START = 12_000, 24_000
#: Gradient steps over all unlabelled texts; bins of a score's histogram, and the scores that they span.
STEPS, BINS, SPAN = 4, 4096, 16.0
HIDDEN, EPOCHS, BATCH = 24, 40, 1024
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".?", "comma": b",;:", "mark": b"!", "symbol": b"#$%&*@^~_=+<>\\/{}[]", "bar": b"|", "line": b"\n", "quote": b"\"'()-"}
FEATURES = len(CLASSES) + 13


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers for each text; null counts as empty."""
    n = len(texts)
    out = np.zeros((n, FEATURES))
    raw, ends = raw_bytes(texts)
    length = np.diff(ends)
    full = np.flatnonzero(length)
    for i, members in enumerate(CLASSES.values()):
        hit = np.isin(np.arange(256), np.frombuffer(members, np.uint8))[raw]
        if len(full):
            out[full, i] = np.add.reduceat(hit, ends[:-1][full], dtype=np.int64) / length[full]
    off, flat = words_of(texts)
    count = np.diff(off)
    doc = owner(off)
    per = np.maximum(count, 1)
    k = len(CLASSES)
    if len(flat):
        enc = flat.dictionary_encode()
        codes, vocab = enc.indices.to_numpy().astype(np.int64), enc.dictionary
        chars = pc.utf8_length(flat).to_numpy().astype(np.float64)
        both, times = np.unique(doc * len(vocab) + codes, return_counts=True)
        at = both // len(vocab)
        out[:, k] = np.bincount(at, minlength=n) / per  # distinct words
        out[:, k + 1] = np.sqrt(np.bincount(at, times.astype(float) ** 2, n)) / per  # concentration
        same = np.concatenate([[False], (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])])
        out[:, k + 2] = np.bincount(doc, same, n) / per  # immediate repeats
        mean = np.bincount(doc, chars, n) / per
        out[:, k + 3] = mean
        out[:, k + 4] = np.sqrt(np.maximum(np.bincount(doc, chars**2, n) / per - mean**2, 0))
        out[:, k + 5] = np.bincount(doc, chars <= 3, n) / per
        out[:, k + 6] = np.bincount(doc, chars >= 12, n) / per
        title = pc.match_substring_regex(vocab, r"^\p{Lu}").to_numpy(zero_copy_only=False)[codes]
        out[:, k + 7] = np.bincount(doc, title, n) / per
        letters = pc.match_substring_regex(vocab, r"^\p{L}+[.,;:?!]?$").to_numpy(zero_copy_only=False)[codes]
        out[:, k + 8] = np.bincount(doc, letters, n) / per
        shout = pc.match_substring_regex(vocab, r"^\p{Lu}{2,}").to_numpy(zero_copy_only=False)[codes]
        out[:, k + 9] = np.bincount(doc, shout, n) / per
        inside = doc[1:] == doc[:-1]
        # One number for a text and a pair: fits, as a slice of many texts has a small vocabulary.
        pair = np.unique(((doc[1:] * len(vocab) + codes[:-1]) * len(vocab) + codes[1:])[inside])
        out[:, k + 10] = np.bincount(pair // len(vocab) ** 2, minlength=n) / np.maximum(count - 1, 1)  # distinct pairs of words
    out[:, k + 11] = np.log1p(count)
    out[:, k + 12] = np.log1p(length / np.maximum(count, 1))
    return out


class Net:
    """One hidden layer with tanh, fitted by Adam."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        r = np.random.default_rng(seed)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        self.p = [r.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 0.1, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p], 0
        self.offset = 0.0

    def norm(self, x):
        return np.clip((x - self.mean) / self.std, -6, 6)

    def forward(self, z):
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def gradients(self, z, h, dg):
        dh = dg[:, None] * self.p[2] * (1 - h**2)
        return [z.T @ dh, dh.sum(0), h.T @ dg, np.array([dg.sum()])]

    def move(self, grads, rate):
        self.t += 1
        for i, g in enumerate(grads):
            g = g + (1e-4 * self.p[i] if i in (0, 2) else 0)
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.p[i] = self.p[i] - rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)

    def score(self, x):
        return sigmoid(self.forward(self.norm(x))[1] + self.offset)


def sigmoid(g):
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def risk(net: Net, zp: np.ndarray, prior: float, loss: float, grads: list[np.ndarray], rate: float) -> None:
    """One step on the non-negative risk. loss, grads: mean loss of the unlabelled as negatives, and its gradient."""
    h, g = net.forward(zp)
    negative = loss - prior * np.logaddexp(0, g).mean()
    plus, minus = net.gradients(zp, h, prior * (sigmoid(g) - 1) / len(zp)), net.gradients(zp, h, -prior * sigmoid(g) / len(zp))
    net.move([a + b + c if negative >= 0 else -b - c for a, b, c in zip(plus, minus, grads, strict=True)], rate)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0) -> Net:
    net, r = Net(unlabelled, seed), np.random.default_rng(seed)
    zp, zu = net.norm(positive), net.norm(unlabelled)
    rounds = max(EPOCHS * len(zu) // BATCH, 400)
    for i in range(rounds):
        bp, bu = zp[r.integers(0, len(zp), BATCH // 2)], zu[r.integers(0, len(zu), BATCH)]
        h, g = net.forward(bu)
        risk(net, bp, prior, np.logaddexp(0, g).mean(), net.gradients(bu, h, sigmoid(g) / len(bu)), 0.01 * (1 - i / rounds) + 1e-4)
    return net


def prior_of(unlabelled: np.ndarray, positive: np.ndarray, width: float = 0.01, doubt: float = 0.1) -> float:
    """The class prior from histograms of a ranking's scores (ascending bins) of unlabelled and of positive texts."""
    nu, np_ = unlabelled.sum(), positive.sum()
    if not nu or not np_:
        return 0.5
    qu, qp = unlabelled[::-1].cumsum() / nu, positive[::-1].cumsum() / np_
    some = qp > 0
    slack = width * (np.sqrt(np.log(4 / doubt) / (2 * nu)) + np.sqrt(np.log(4 / doubt) / (2 * np_)))
    ratio = qu[some] / qp[some]
    return float(np.clip(ratio[np.argmin(ratio + slack / qp[some])], 0.01, 0.99))


def floats(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, FEATURES).astype(np.float64)


def featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and __f, the features of a text as bytes of 32-bit floats; written once, read often."""
    names, at, out = [*keep, "text"], len(keep), range(len(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            f = features(b.column(at)).astype(np.float32)
            made = pa.array([x.tobytes() for x in f], pa.binary())
            yield pa.record_batch([*(b.column(i) for i in out), made], names=[*(names[i] for i in out), "__f"])

    schema = T.StructType([docs.schema[names[i]] for i in out]).add("__f", T.BinaryType())
    return materialise(docs.select(*names).mapInArrow(run, schema))


def histogram(rows: DataFrame, net: Net) -> np.ndarray:
    """Counts of net's scores (before the logistic function) over all rows, by BINS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for b in batches:
            total += np.bincount(bins(net.forward(net.norm(floats(b.column(0))))[1]), minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bin", "n"])

    got = rows.select("__f").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BINS)
    out[got["bin"].to_numpy()] = got["n"].to_numpy()
    return out


def bins(g: np.ndarray) -> np.ndarray:
    return np.clip(((g / SPAN + 1) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def summed(rows: DataFrame, net: Net) -> tuple[float, list[np.ndarray]]:
    """Mean loss of all rows as negatives and its gradient; each task sums its own, so the driver gets some hundred
    numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            z = net.norm(floats(b.column(0)))
            h, g = net.forward(z)
            part = np.concatenate([[np.logaddexp(0, g).sum()], *(x.ravel() for x in net.gradients(z, h, sigmoid(g)))])
            total, n = part if total is None else total + part, n + len(z)
        if n:
            yield pa.record_batch([pa.array(np.arange(-1, len(total))), pa.array(np.concatenate([[float(n)], total]))], names=["i", "v"])

    got = rows.select("__f").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i")["v"].to_numpy()
    mean, at = got[1:] / got[0], 1
    grads = []
    for q in net.p:
        grads.append(mean[at : at + q.size].reshape(q.shape))
        at += q.size
    return float(mean[0]), grads


def model(rows: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_start: int = MOST_START) -> tuple[Net | None, float]:
    """rows: featured. Learned from those that are not held out; None where there is no positive or no text to learn
    from. Labels given twice count as their greatest."""
    free = rows.where(~held_out("doc_id", 5, 0))
    good = labels.where("quality is not null and doc_id is not null").where(~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1")
    got = free.join(sampled(good, "doc_id", most_positive), "doc_id", "left_semi").select("doc_id", "__f").toArrow().sort_by([("doc_id", "ascending"), ("__f", "ascending")])
    start = sampled(free, "doc_id", most_start).select("doc_id", "__f").toArrow().sort_by([("doc_id", "ascending"), ("__f", "ascending")])
    if not got.num_rows or not start.num_rows:
        return None, 0.5
    positive, unlabelled = floats(got["__f"].combine_chunks()), floats(start["__f"].combine_chunks())
    ranking = fit(positive[::2], unlabelled, 0.5)
    kept = np.bincount(bins(ranking.forward(ranking.norm(positive[1::2]))[1]), minlength=BINS)
    prior = prior_of(histogram(free, ranking), kept)
    net = fit(positive, unlabelled, prior)
    for i in range(STEPS):
        loss, grads = summed(free, net)
        risk(net, net.norm(positive), prior, loss, grads, 0.001 / (1 + i))
    n, g = histogram(free, net), (2 * (np.arange(BINS) + 0.5) / BINS - 1) * SPAN
    low, high = -20.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (sigmoid(g + mid) * n).sum() < prior * n.sum() else (low, mid)
    net.offset = (low + high) / 2
    return net, prior


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    Null and empty texts are scored by the model like any other, as texts without words; a text of any length counts
    whole. Without anything to learn from, every score is 0.5. Rows with a null doc_id are scored, and are not held
    out; no model learns a label from them. A score equal to the threshold is accepted. Repeated rows come out as
    often as they come in; other columns of docs are ignored; an empty table gives an empty result.
    """
    rows = featured(docs, ["doc_id"])
    net, prior = model(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = net.score(floats(b.column(1))) if net else np.full(b.num_rows, prior)
            yield pa.record_batch([b.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = rows.select("doc_id", "__f").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that score() doesn't reject; an empty table gives an empty result. Features are
    made again here: writing all texts with them would cost the disk that they take."""
    net, prior = model(featured(docs, ["doc_id"]), labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, names.index("text")):
            s = net.score(features(b.column(names.index("text"))).astype(np.float32)) if net else np.full(b.num_rows, prior)
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
