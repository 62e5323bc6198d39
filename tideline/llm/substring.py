"""Substring dedup: matching statistics by backward search in a compressed FM-index for each shard.

Shards are cut by content, so that a window of WINDOW words meets every other window of the same words in one
shard, and each text is streamed against one shard and not against all: consecutive windows whose smallest hash
of SEED words (minimiser) sits at the same place form a piece, and a piece goes to the shard of its minimiser.
A first pass finds the minimisers that two documents hold; only their pieces are shipped, by a bitmap of them whose
size follows the input up to MOST_BITS (beyond some thousand million of them it rules out little, and more pieces
are shipped; results stay exact). A second bitmap marks minimisers of so many pieces that one task would feel it:
their windows are pieces of their own and go to the shards of their own hash. Equal pieces of a part of a task are
one row with the smallest and greatest doc_id that holds them, so a passage that a third of all documents share is
a few rows for each task.

In a shard, the pieces are concatenated and indexed: suffixes sorted as deep as a window, the Burrows-Wheeler
transform in a wavelet matrix of packed bits with counts for each block. Backward search gives the interval of
what all windows of a piece have in common; where that is one suffix, nothing repeats. Otherwise each window is
searched, and the smallest doc_id over its interval is where its word sequence first starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, drawn_key, hashed_words, materialise, mix, owner, partitions, possibly, rolling, slices, words_of

WINDOW, SEED = 13, 5
#: Words that one index holds; a larger shard gets several, and its pieces are streamed against each.
MOST_WORDS = 2_000_000
#: Stands for a null doc_id, which is never smaller than another.
NO_ID = np.iinfo(np.int64).max
#: Bits of each bitmap of minimisers: as many as bytes of text, within these bounds (the greater is 64 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
#: Words of pieces that a task gathers before it ships what is distinct among them.
GATHERED = 500_000
#: Salts by a word's place in a piece.
PLACE = mix(np.arange(1, 2 * WINDOW + 1, dtype=np.uint64))


def pieces_of(off: np.ndarray, h: np.ndarray, window: int = WINDOW, seed: int = SEED):
    """For each piece: its text, its first word (counted from the text's start), its windows and its minimiser."""
    n = len(h)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    seeds = rolling(h, seed)
    span = window - seed + 1
    count = n - window + 1
    least, where = seeds[:count].copy(), np.zeros(count, np.int64)
    for j in range(1, span):
        other = seeds[j : j + count]
        less = other < least
        least[less] = other[less]
        where[less] = j
    place = np.arange(count) + where
    doc = owner(off)
    inside = doc[:count] == doc[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    first = np.concatenate([[True], (place[at][1:] != place[at][:-1]) | (at[1:] != at[:-1] + 1) | (doc[at][1:] != doc[at][:-1])])
    start = at[first]
    windows = np.diff(np.append(np.flatnonzero(first), len(at)))
    return doc[start], start - off[doc[start]], windows, least[start]


def shared_minimisers(docs: DataFrame, size: int, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (as 64-bit words) of the minimisers that documents of two ids hold, and of those of very many
    pieces, gathered on the executors. size: bytes of all texts."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(size).bit_length()))
    # A piece is about 35 bytes of text; a task of the index should have no minimiser of over an eighth of its pieces.
    hot = max(500, size // 35 // (8 * shards(docs.sparkSession, size)))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            _, off, at, h = hashed_words(b.column(1), key)
            doc, _, _, seed = pieces_of(np.searchsorted(at, off), h)
            if not len(doc):
                continue
            ids = pc.fill_null(b.column(0), int(NO_ID)).to_numpy()[doc]
            order = np.lexsort((ids, seed))
            seed, ids = seed[order], ids[order]
            start = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
            end = np.append(start[1:], len(seed))
            two = ids[start] != ids[end - 1]
            seed, n = seed[start], (end - start).astype(np.int32)
            rows = [np.concatenate([seed, seed[two]]).view(np.int64), np.concatenate([ids[start], ids[end[two] - 1]]), np.concatenate([n, np.zeros(two.sum(), np.int32)])]
            yield pa.record_batch([pa.array(x) for x in rows], names=["minimiser", "id", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in b.columns] for b in batches]
        if not got:
            return
        seed, ids, n = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.argsort(seed, kind="stable")
        seed, ids, n = seed[order], ids[order], n[order].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
        two = np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)
        many = np.add.reduceat(n, start) > hot
        # The hot ones are told apart by the range of the number: two bitmaps in one.
        slot = seed[start].view(np.uint64) & np.uint64(bits - 1)
        yield pa.record_batch([pa.array(np.concatenate([slot[two], slot[two & many] + np.uint64(bits)]).view(np.int64))], names=["minimiser"])

    rows = docs.select("doc_id", "text").mapInArrow(seeds, "minimiser long, id long, n int").repartition(shards(docs.sparkSession, size), "minimiser")
    got = bitmap(rows.mapInArrow(meet, "minimiser long"), "minimiser", 2 * bits).toArrow()
    out = np.zeros(2 * bits // 64, np.int64)
    out[got["__slot"].to_numpy()] = got["__mask"].to_numpy()
    return out.view(np.uint64)[: bits // 64], out.view(np.uint64)[bits // 64 :]


def marked(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    slot = value & np.uint64(len(bits) * 64 - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)) > 0


def pieces(docs: DataFrame, shared, words: bool, key: int) -> DataFrame:
    """Pieces whose minimiser may be shared (a broadcast pair of bitmaps). With words: shard (what they are dealt by),
    piece (hash of its words), windows, words (64-bit hashes), least and most doc_id. Without: piece, doc_id, tie and
    at (first word) of each occurrence."""

    def found(b: pa.RecordBatch):
        """Text, first word, windows, shard and name of each piece; where its words end in the last, hashes of words."""
        _, text_off, begin, h = hashed_words(b.column(1), key)
        off = np.searchsorted(begin, text_off)
        doc, at, windows, seed = pieces_of(off, h)
        may = np.flatnonzero(marked(shared.value[0], seed))
        doc, at, windows, seed = doc[may], at[may], windows[may], seed[may]
        hot = marked(shared.value[1], seed)
        if hot.any():  # a piece for each window
            each = np.where(hot, windows, 1)
            of = np.repeat(np.arange(len(doc)), each)
            at = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            doc, seed, windows, hot = doc[of], seed[of], np.where(hot, 1, windows)[of], hot[of]
        size = windows + WINDOW - 1
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
        w = h[np.repeat(off[doc] + at, size) + place]
        # Every word goes through a finaliser with its place: pieces are equal if their words are, in order.
        name = np.add.reduceat(mix(w ^ PLACE[place]), ends[:-1]) ^ size.astype(np.uint64) if len(doc) else np.zeros(0, np.uint64)
        return doc, at, windows, np.where(hot, name, seed), name, ends, w

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            doc, at, _, _, name, _, _ = found(b)
            if len(doc):
                take = pa.array(doc)
                yield pa.record_batch([pa.array(name.view(np.int64)), b.column(0).take(take), b.column(2).take(take), pa.array(at.astype(np.int32))], names=["piece", "doc_id", "tie", "at"])

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in slices(batches):
            doc, _, windows, shard, name, ends, w = found(b)
            if not len(doc):
                continue
            ids = pc.fill_null(b.column(0), int(NO_ID)).to_numpy()[doc]
            lists = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer((ends * 8).astype(np.int64).tobytes()), pa.py_buffer(w.tobytes())])
            held.append(distinct(pa.record_batch([pa.array(shard.view(np.int64)), pa.array(name.view(np.int64)), pa.array(windows.astype(np.int32)), lists, pa.array(ids), pa.array(ids)], names=["shard", "piece", "windows", "words", "least", "most"])))
            n += held[-1].column("words").nbytes // 8
            if n > GATHERED:
                yield whole(distinct(pa.Table.from_batches(held).combine_chunks().to_batches()[0]))
                held, n = [], 0
        if held:
            yield whole(distinct(pa.Table.from_batches(held).combine_chunks().to_batches()[0]))

    whole = lambda b: b.set_column(3, "words", b.column(3).cast(pa.binary()))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    if words:
        return rows.mapInArrow(classes, "shard long, piece long, windows int, words binary, least long, most long")
    return rows.mapInArrow(occurrences, "piece long, doc_id long, tie long, at int")


def distinct(b: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each piece, with the least and the most of its rows."""
    name, least, most = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("piece", "least", "most"))
    order = np.argsort(name, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
    kept = b.select(["shard", "piece", "windows", "words"]).take(pa.array(order[start]))
    return pa.record_batch([*kept.columns, pa.array(np.minimum.reduceat(least[order], start)), pa.array(np.maximum.reduceat(most[order], start))], names=["shard", "piece", "windows", "words", "least", "most"])


class Bits:
    """A packed bit vector with the number of ones before each block of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + b"\0" * (16 - len(packed) % 8), np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        block = i >> 6
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class Index:
    """FM-index of a sequence of numbers below `kinds`, its suffixes sorted by their first `depth` numbers."""

    def __init__(self, text: np.ndarray, kinds: int, depth: int = WINDOW):
        n = len(text)
        rank, step = text.astype(np.int64) + 1, 1
        order = np.argsort(rank, kind="stable")
        while step < depth:
            ranked = rank[order]
            new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
            group = np.flatnonzero(new)
            size = np.diff(np.append(group, n))
            tied = np.repeat(size > 1, size)
            rank = np.empty(n, np.int64)
            rank[order] = np.repeat(group, size) + 1  # place of the group: order is kept among groups
            if not tied.any():
                break
            # Only suffixes that are not yet alone are sorted on.
            at = order[tied]
            follow = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], 0)
            by = np.lexsort((follow, rank[at]))
            order[tied] = at[by]
            pair = rank[at][by] * np.int64(n + 2) + follow[by]
            fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
            spots = np.flatnonzero(tied)
            rank[order[tied]] = np.repeat(spots[fresh], np.diff(np.append(np.flatnonzero(fresh), len(pair)))) + 1
            step *= 2
        self.order = order
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])
        bwt = text[order - 1]  # the text ends in a separator, which also comes before its first number
        self.bits, self.zeros = [], []
        for level in reversed(range(max(1, int(kinds - 1).bit_length()))):
            one = (bwt >> level & 1).astype(bool)
            self.bits.append(Bits(one))
            self.zeros.append(int(n - one.sum()))
            bwt = np.concatenate([bwt[~one], bwt[one]])

    def count_before(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of a symbol in the transform before place i."""
        low = np.zeros(len(i), np.int64)
        levels = len(self.bits)
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = (symbol >> (levels - 1 - k) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low

    def search(self, text: np.ndarray, start: np.ndarray, length: np.ndarray, until: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of text[start : start + length] by backward search, all at once; stops where an interval is
        no larger than `until`."""
        at = start + length - 1
        low, high = self.starts[text[at]].copy(), self.starts[text[at] + 1].copy()
        live = np.flatnonzero((length > 1) & (high - low > until))
        at = at.copy()
        while len(live):
            at[live] -= 1
            symbol = text[at[live]]
            base = self.starts[symbol]
            both = self.count_before(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = base + both[: len(live)], base + both[len(live) :]
            live = live[(at[live] > start[live]) & (high[live] - low[live] > until)]
        return low, high


def least_over(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low:high] for each non-empty interval, by a table of powers of two."""
    out = np.full(len(low), NO_ID, np.int64)
    table, width = values, 1
    size = high - low
    while len(low):
        here = (size >= width) & (size < 2 * width)
        out[here] = np.minimum(table[low[here]], table[high[here] - width])
        if not (size >= 2 * width).any():
            break
        table = np.minimum(table[: len(table) - width], table[width:])
        width *= 2
    return out


def first_docs(words: np.ndarray, ends: np.ndarray, windows: np.ndarray, least: np.ndarray, window: int = WINDOW, most: int = MOST_WORDS) -> np.ndarray:
    """For each window of each piece (piece k is words[ends[k]:ends[k+1]]), the smallest of `least` over all pieces
    that hold the same words; several indexes if there are more words than `most`."""
    vocab, text = np.unique(words, return_inverse=True)
    text = text.astype(np.int64) + 1  # 0 separates
    size = np.diff(ends)
    out_ends = np.concatenate([[0], np.cumsum(windows)])
    result = np.repeat(least, windows)
    cuts = [0]
    while cuts[-1] < len(size):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + most, "right")) - 1))
    every = np.arange(len(size))
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = text[ends[a] : ends[b]]
        held = np.zeros(len(part) + (b - a) + 1, np.int64)
        spot = np.arange(len(part)) + np.repeat(np.arange(b - a), size[a:b]) + 1
        held[spot] = part
        holder = np.zeros(len(held), np.int64)
        holder[spot] = np.repeat(least[a:b], size[a:b])
        index = Index(held, len(vocab) + 1, window)
        holder = holder[index.order]
        # What all windows of a piece share: if that occurs but once, the piece itself, no window repeats.
        core = np.minimum(windows, window)
        low, high = index.search(text, ends[:-1] + core - 1, np.maximum(window - core + 1, 1), until=1 if len(cuts) == 2 else 0)
        some = every[high - low > (1 if len(cuts) == 2 else 0)]
        if not len(some):
            continue
        n = windows[some]
        which = np.repeat(out_ends[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        start = np.repeat(ends[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        low, high = index.search(text, start, np.full(len(start), window))
        full = high > low
        result[which[full]] = np.minimum(result[which[full]], least_over(holder, low[full], high[full]))
    return result


def repeated(classes: DataFrame, n: int) -> DataFrame:
    """classes(shard, piece, windows, words, least, most), some of them of one piece: piece and firsts (of each window, the smallest doc_id)
    for pieces in which some document has a window that starts in a smaller one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        t = distinct(t.set_column(3, "words", t["words"].cast(pa.large_binary())).combine_chunks().to_batches()[0])
        del got
        piece, windows, least, most = (t.column(c).to_numpy() for c in ("piece", "windows", "least", "most"))
        size = pc.binary_length(t.column("words")).to_numpy().astype(np.int64) // 8
        words = np.frombuffer(b"".join(t.column("words").to_pylist()), np.uint64)
        windows = windows.astype(np.int64)
        firsts = first_docs(words, np.concatenate([[0], np.cumsum(size)]), windows, least)
        ends = np.concatenate([[0], np.cumsum(windows)])
        keep = np.flatnonzero(np.minimum.reduceat(firsts, ends[:-1]) < most)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(firsts)).take(pa.array(keep))
        yield pa.record_batch([pa.array(piece[keep]), lists], names=["piece", "firsts"])

    return classes.repartition(n, "shard").mapInArrow(run, "piece long, firsts array<long>")


def shards(spark, size: int) -> int:
    """As many for so many bytes of text that one holds about a quarter of MOST_WORDS, if all pieces repeat."""
    return max(partitions(spark), 1 + int(size / (MOST_WORDS * 4)))


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, tie and starts (first words of the windows to remove) for texts that have any."""
    ids = F.coalesce("doc_id", F.lit(int(NO_ID)))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    key = drawn_key()
    shared = docs.sparkSession.sparkContext.broadcast(shared_minimisers(docs, size, key))
    firsts = materialise(repeated(pieces(docs, shared, True, key), shards(docs.sparkSession, size)))
    places = possibly(pieces(docs, shared, False, key), "piece", firsts, "piece").where("__may").drop("__may")
    met = places.join(firsts, "piece").where(F.array_min("firsts") < ids)
    found = F.filter(F.transform("firsts", lambda f, i: F.when(f < ids, F.col("at") + i)), lambda x: x.isNotNull())
    return met.select("doc_id", "tie", found.alias("starts")).groupBy("doc_id", "tie").agg(F.flatten(F.collect_set("starts")).alias("starts"))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """The rows of docs with `kept` (the words that stay, joined by one space), n_words, n_removed and `spans`
    (first word and end of each removed run) added, over columns of those names.

    A word goes if a window of 13 words over it also starts in a document with a smaller doc_id. Null and shorter
    texts lose nothing; null text has no words, and kept is then empty. Rows with one doc_id, repeated or not,
    don't take from each other. A null doc_id is greater than any other. Other columns are kept as they are. An
    empty table gives an empty result. A text of any length is worked on whole. Words and pieces are compared by
    64-bit hashes, under a key that is drawn for each run.
    """
    added = ("kept", "n_words", "n_removed", "spans")
    names = [c for c in docs.columns if c not in added]
    lost = covered(docs).select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.col("starts").alias("__starts"))
    lost = materialise(lost)
    rows = possibly(docs.select(*names, F.xxhash64("text").alias("__of")), "__of", lost, "__tie")
    some = rows.where("__may")
    some = some.join(lost, some.doc_id.eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__tie")), "left").select(*names, "__starts")
    rows = some.union(rows.where("NOT __may").select(*names, F.lit(None).cast("array<int>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, names.index("text")):
            off, flat = words_of(b.column(names.index("text")))
            lists = b.column(len(names))
            gone = np.zeros(len(flat) + 1, np.int64)
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = np.repeat(off[:-1], count) + lists.flatten().to_numpy()
            np.add.at(gone, at, 1)
            np.add.at(gone, at + WINDOW, -1)
            gone = np.cumsum(gone)[:-1] > 0
            before = np.concatenate([[0], np.cumsum(~gone)])[off]
            stay = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), flat.filter(pa.array(~gone)))
            doc = owner(off)
            edge = np.concatenate([[True], (gone[1:] != gone[:-1]) | (doc[1:] != doc[:-1])]) if len(gone) else np.zeros(0, bool)
            start = np.flatnonzero(edge)
            end = np.append(start[1:], len(gone))
            runs = gone[start] if len(start) else np.zeros(0, bool)
            start, end = start[runs], end[runs]
            of = doc[start]
            pairs = np.stack([start - off[of], end - off[of]], axis=1).ravel() if len(start) else np.zeros(0, np.int64)
            inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(pairs) + 1, 2).astype(np.int32)), pa.array(pairs))
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(off))).astype(np.int32)), inner)
            words = np.diff(off)
            made = [pc.binary_join(stay, pa.scalar(" ", pa.large_string())).cast(pa.string()), pa.array(words), pa.array(words - np.diff(before)), spans]
            yield pa.record_batch([*b.columns[: len(names)], *made], names=[*names, *added])

    schema = T.StructType(list(docs.select(*names).schema.fields))
    schema.add("kept", T.StringType()).add("n_words", T.LongType()).add("n_removed", T.LongType()).add("spans", T.ArrayType(T.ArrayType(T.LongType())))
    return rows.mapInArrow(run, schema)
