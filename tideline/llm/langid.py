"""Language ID of the words of code-switched text by a linear-chain conditional random field.

The words of a line are a chain, however long. A word's features are its affixes of one
to three characters, its character bigrams and trigrams, the word itself, and whether it is in the lexicon of a
language (its most frequent words in the sample); all but the lexicon are hashed. The weights of the features and
of the transitions between languages are learned together by maximising the likelihood of the training lines, some
of which are joined from the halves of two lines of different languages, so that switches are seen;
forward-backward gives each word's marginals, and its label is the likeliest. A text has the language with the
greatest sum of marginals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, mix, owner, slices, split_lines, words_of

#: About this many texts of each language are learned from (default of a parameter); all languages are.
MOST_TEXTS = 120
HASHED, LEXICON, ROUNDS = 1 << 16, 200, 45
#: One line joined of two languages for so many lines.
JOINED = 4


def clean(vocab: pa.Array) -> pa.Array:
    """Letters of a word in lower case, inner apostrophes and hyphens kept; null where it has no letter."""
    letters = pc.match_substring_regex(vocab, r"\p{L}")
    low = pc.replace_substring_regex(pc.utf8_lower(vocab), r"[^\p{L}\p{M}'’-]+", "")
    return pc.if_else(letters, low, pa.scalar(None, low.type))


def chains(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text of each chain, where chains start among the words, the index of each word, and the distinct words."""
    doc, _, lines = split_lines(texts)
    off, flat = words_of(lines)
    enc = flat.dictionary_encode()
    words = clean(enc.dictionary)
    again = words.dictionary_encode()
    code = again.indices.fill_null(-1).to_numpy().astype(np.int64)[enc.indices.to_numpy()]
    keep = code >= 0
    line = owner(off)[keep]
    code = code[keep]
    first = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    return doc[line[begin]], np.append(begin, len(line)), code, again.dictionary


def features(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of each distinct word, one after the other, and where each word's begin."""
    text = "".join(f"\x02{w}\x03" for w in vocab.to_pylist())
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = pc.utf8_length(vocab).to_numpy().astype(np.int64) + 2
    ends = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(size)), size)
    found, words = [], []

    def add(kind: int, key: np.ndarray, word: np.ndarray) -> None:
        found.append((mix(key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind)) % np.uint64(HASHED)).astype(np.int64))
        words.append(word)

    one = np.uint64(1 << 21)
    two = chars[:-1] * one + chars[1:]
    three = two[:-1] * one + chars[2:]
    inside = of[:-1] == of[1:]
    add(1, two[inside], of[:-1][inside])
    inside = of[:-2] == of[2:]
    add(2, three[inside], of[:-2][inside])
    all_words = np.arange(len(size))
    for n in (1, 2, 3):  # affixes with n letters, where the word has them
        long = size - 2 >= n
        for kind, at in ((10 + n, ends[:-1] + 1), (20 + n, ends[1:] - 1 - n)):
            key = np.zeros(long.sum(), np.uint64)
            for j in range(n):
                key = key * one + chars[at[long] + j]
            add(kind, key, all_words[long])
    power = mix(np.arange(int(size.max(initial=1)), dtype=np.uint64) + np.uint64(99)) | np.uint64(1)
    if len(size):
        add(3, np.add.reduceat(chars * power[np.arange(len(chars)) - np.repeat(ends[:-1], size)], ends[:-1]), all_words)
    feature, word = np.concatenate(found), np.concatenate(words)
    order = np.argsort(word, kind="stable")
    return feature[order], np.searchsorted(word[order], np.arange(len(size) + 1))


class Crf:
    def __init__(self, languages: list[str], lexicon: list[list[str]]):
        k = len(languages)
        self.languages, self.lexicon = languages, [frozenset(x) for x in lexicon]
        self.w, self.lex, self.move = np.zeros((HASHED, k)), np.zeros((k, k)), np.eye(k) * 2.0

    def in_lexicon(self, vocab: pa.Array) -> np.ndarray:
        return np.array([[w in x for x in self.lexicon] for w in vocab.to_pylist()], float).reshape(-1, len(self.languages))

    def emissions(self, feature, starts, member) -> np.ndarray:
        if not len(member):
            return np.zeros((0, len(self.languages)))
        return np.add.reduceat(self.w[feature], starts[:-1]) + member @ self.lex

    def marginals(self, score: np.ndarray, bounds: np.ndarray, pairs: bool = False):
        """score: of each word by language. Marginals of each word; with pairs, expected transitions and the
        log-likelihood's normaliser too. All chains advance together, the longest first."""
        n, k = score.shape
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        start, size = bounds[:-1][order], size[order]
        top = score.max(axis=1, keepdims=True) if n else score
        e, a = np.exp(score - top), np.exp(self.move - self.move.max())
        alpha, scale = np.zeros((n, k)), np.ones(n)
        longest = int(size[0]) if len(size) else 0
        live = [int(np.searchsorted(-size, -t, "left")) for t in range(longest + 1)]  # chains longer than t
        for t in range(longest):
            at = start[: live[t]] + t
            x = e[at] * ((alpha[at - 1] @ a) if t else 1.0)
            scale[at] = x.sum(axis=1)
            alpha[at] = x / scale[at][:, None]
        beta, moves = np.ones((n, k)), np.zeros((k, k))
        for t in range(longest - 2, -1, -1):
            at = start[: live[t + 1]] + t
            after = e[at + 1] * beta[at + 1] / scale[at + 1][:, None]
            if pairs:
                moves += (alpha[at].T @ after) * a
            beta[at] = after @ a.T
        m = alpha * beta
        m /= np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
        return (m, moves) if pairs else m


def joined(bounds: np.ndarray, gold: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """For some chains, word numbers of a new one: the first half of it and the second of one of another language."""
    r, size = np.random.default_rng(seed), np.diff(bounds)
    long = np.flatnonzero(size > 1)
    out = []
    for i in long[r.permutation(len(long))[: len(long) // JOINED]]:
        other = long[r.integers(0, len(long), 16)]
        other = other[gold[other] != gold[i]]
        if len(other):
            j = other[0]
            out.append(np.concatenate([np.arange(bounds[i], bounds[i] + size[i] // 2), np.arange(bounds[j] + size[j] // 2, bounds[j + 1])]))
    return out


def learn(texts: pa.Array, labels: list[str]) -> Crf:
    languages = sorted(set(labels))
    doc, bounds, code, vocab = chains(texts)
    number = {x: i for i, x in enumerate(languages)}
    gold = np.array([number[x] for x in labels], np.int64)[doc]
    label = np.repeat(gold, np.diff(bounds))
    more = joined(bounds, gold)
    words = np.concatenate([np.arange(len(code)), *more])
    code, label = code[words], label[words]
    bounds = np.concatenate([bounds, bounds[-1] + np.cumsum([len(x) for x in more], dtype=np.int64)])
    k, n = len(languages), len(code)
    by = np.zeros((k, len(vocab)))
    np.add.at(by, (label, code), 1)
    names = vocab.to_pylist()
    crf = Crf(languages, [[names[i] for i in np.argsort(-by[j], kind="stable")[:LEXICON] if by[j, i] > 1] for j in range(k)])
    if not n:
        return crf
    feature, starts = features(vocab)
    member = crf.in_lexicon(vocab)
    count = np.diff(starts)
    truth = by.T
    inner = np.ones(n, bool)
    inner[bounds[:-1]] = False
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (label[np.flatnonzero(inner) - 1], label[inner]), 1)
    params = [crf.w, crf.lex, crf.move]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, ROUNDS + 1):  # Adam on the mean log-likelihood, with a ridge
        marginal, moves = crf.marginals(crf.emissions(feature, starts, member)[code], bounds, pairs=True)
        got = np.stack([np.bincount(code, marginal[:, j], len(vocab)) for j in range(k)], axis=1)
        delta = np.repeat((truth - got) / n, count, axis=0)
        grads = [np.stack([np.bincount(feature, delta[:, j], HASHED) for j in range(k)], axis=1) - 1e-6 * crf.w, member.T @ ((truth - got) / n) - 1e-6 * crf.lex, (gold_moves - moves) / n - 1e-3 * (crf.move - np.eye(k))]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] += 0.08 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-7)
    return crf


def trained(docs: DataFrame, most_texts: int = MOST_TEXTS) -> Crf | None:
    """Learned from about most_texts texts of each language of the rows that are not held out."""
    free = docs.where("lang is not null and text is not null").where(~held_out("doc_id", 4, 2))
    count = free.groupBy("lang").agg(F.count("*").alias("__n"))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) * F.col("__n") < F.lit(most_texts << 30)
    got = free.join(F.broadcast(count), "lang").where(chosen).select("doc_id", F.xxhash64("text").alias("tie"), "text", "lang").toArrow().sort_by([("doc_id", "ascending"), ("tie", "ascending")])
    return learn(got["text"].combine_chunks(), got["lang"].to_pylist()) if got.num_rows else None


def identify(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """doc_id, lang_pred, score (mean marginal of that language over the text's words), switches (changes of label
    from word to word) and labels (runs of words of one label: first and last word, of those with a letter, from 0,
    and the language) of each row of docs.

    A text of any length is labelled whole. Null text and text without a letter: und, score 0. Without a model, every text is und. Ties go to the language
    first in order of name. Repeated rows come out as often as they come in; other columns are ignored; an empty
    table gives an empty result. Rows with a null doc_id are judged, and are not held out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(crf)  # HASHED weights for each language, whatever the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = sent.value
        for b in slices(batches):
            n = b.num_rows
            names, score, switches = np.full(n, "und", object), np.zeros(n), np.zeros(n, np.int64)
            of = best = np.zeros(0, np.int64)
            doc, bounds, code, vocab = chains(b.column(1)) if crf else (np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), None)
            if len(code):
                feature, starts = features(vocab)
                m = crf.marginals(crf.emissions(feature, starts, crf.in_lexicon(vocab))[code], bounds)
                of = np.repeat(doc, np.diff(bounds))
                total = np.bincount(of, minlength=n)
                sums = np.stack([np.bincount(of, m[:, j], n) for j in range(m.shape[1])], axis=1)
                some = total > 0
                names[some] = np.array(crf.languages, object)[sums[some].argmax(axis=1)]
                score[some] = np.clip(sums[some].max(axis=1) / total[some], 0, 1)
                best = m.argmax(axis=1)
                switches = np.bincount(of[1:], (best[1:] != best[:-1]) & (of[1:] == of[:-1]), n).astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (of[1:] != of[:-1])])[: len(of)])
            base, first = np.searchsorted(of, of[begin]), np.searchsorted(of[begin], np.arange(n + 1))
            said = pa.array(crf.languages if crf else [], pa.string()).take(pa.array(best[begin]))
            parts = [pa.array((begin - base).astype(np.int32)), pa.array((np.append(begin[1:], len(of)) - 1 - base).astype(np.int32)), said]
            labels = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(parts, ["first", "last", "lang"]))
            yield pa.record_batch([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(switches), labels], names=["doc_id", "lang_pred", "score", "switches", "labels"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, switches long, labels array<struct<first:int,last:int,lang:string>>")


def predict(docs: DataFrame) -> DataFrame:
    """identify() with a model learned from the rows of docs that are not held out, and held_out."""
    rows = identify(docs, trained(docs))
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "switches")
