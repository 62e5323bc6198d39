"""Line dedup: an exact set-similarity join of lines that removes later matches.

A line is its set of words. Words are ordered by rarity: counts of all words over all documents, gathered in
2**16 hashed buckets (any order gives right results; a rare one gives short lists). Two lines of Jaccard
similarity >= t share a word in their first |x| - ceil(t|x|) + 1 words by that order (prefix filter), at places
that leave room for the overlap (positional filter), and differ in size by a factor of t at most (length filter).

1. Lines with equal sets are one class: a hash of the set, with the first place where it occurs. The same pass
   over the texts counts the words.
2. A second pass emits the prefix words of each class; on a shuffle by word, pairs are filtered by length, place
   and a parity sketch of 64 bits, or 128 for larger sets (set differences flip bits). No pair is emitted, only the members that have a
   partner left.
3. The words of those members alone are read again from the texts. They meet again by prefix word and are verified
   in order of first occurrence; a class leaves as soon as an earlier match is found.
4. An occurrence is removed if it isn't the first of its class, or if its class has an earlier match.

No step ships the words of all lines. Texts are shipped only where a bitmap of bounded size says that they may be
needed, and then matched exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIMILARITY, STEP, discard, drawn_key, hashed_words, materialise, mix, partitions, possibly, slices

BUCKETS = 1 << 16
#: Words of a set that gets a sketch of twice as many bits.
LARGE = 64
#: Rows of a prefix word from which they are compared in blocks.
LONG = 64
#: Classes of more than this part of all lines are broadcast (fewer than HOT of them, some 60 bytes each).
HOT = 4096
#: Words of the input for each task of the join: a prefix has about a quarter of them, in rows of some 30 bytes.
WORDS_PER_TASK = 8_000_000
#: Classes that a task remembers to have emitted, eight bytes each.
REMEMBERED = 500_000


def lines_of(texts: pa.Array, rank: np.ndarray, key: int):
    """For each line with a word: its text, its number (from 0), the first of its words in `name`; then `name`, the
    hashes of the words of all lines (each once, ordered by the rank of their bucket), and the hashes of all
    occurrences."""
    data, off, at, h = hashed_words(texts, key)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(at, off)))
    feeds = np.cumsum(data == 10, dtype=np.int32)  # up to each byte; a word's first byte is none, and a text's is none of its own
    before = np.where(off > 0, feeds[off - 1], 0) if len(feeds) else np.zeros(len(off), np.int32)
    number = (feeds[at] - before[doc]).astype(np.int64)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])])[: len(at)]
    line = np.cumsum(new) - 1
    # Line, rank and some bits of the hash in one number; only where those don't tell, the hash too.
    key = line.astype(np.uint64) << np.uint64(42) | rank[h >> np.uint64(48)] << np.uint64(26) | (h >> np.uint64(22) & np.uint64((1 << 26) - 1))
    order = np.argsort(key)
    key, name = key[order], h[order]
    if len(at) and (line[-1] >= 1 << 22 or ((key[1:] == key[:-1]) & (name[1:] != name[:-1])).any()):
        order = np.lexsort((h, h >> np.uint64(22) & np.uint64((1 << 26) - 1), rank[h >> np.uint64(48)], line))
        name = h[order]
    line = line[order]
    once = np.concatenate([[True], (line[1:] != line[:-1]) | (name[1:] != name[:-1])])[: len(line)]
    line, name = line[once], name[once]
    start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])[: len(line)])
    first = np.flatnonzero(new)
    return doc[first], number[first], start, name, h


def classes_of(name: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set: two sums, so the order of words doesn't matter."""
    one = np.add.reduceat(mix(name * STEP + np.uint64(1)), start)
    two = np.add.reduceat(mix(name ^ STEP), start)
    return one.view(np.int64), two.view(np.int64)


def places(docs: DataFrame, key: int) -> DataFrame:
    """doc_id, tie (a hash of the text), line and class (with `rest`, the other half of its name) of each line that
    has a word; besides, bucket and n: word counts of each task."""
    same = np.arange(BUCKETS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("line", pa.int32()), ("class", pa.int64()), ("rest", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64())])
        for b in slices(batches):
            doc, number, start, name, h = lines_of(b.column(1), same, key)
            if not len(start):
                continue
            total += np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
            of = pa.array(doc)
            none = pa.nulls(len(doc), pa.int64())
            yield pa.record_batch([b.column(0).take(of), b.column(2).take(of), pa.array(number.astype(np.int32)), *map(pa.array, classes_of(name, start)), none.cast(pa.int32()), none], schema=schema)
        at = np.flatnonzero(total)
        none = pa.nulls(len(at), pa.int64())
        yield pa.record_batch([none, none, none.cast(pa.int32()), none, none, pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, "doc_id long, tie long, line int, class long, rest long, bucket int, n long")


def rarity(every: DataFrame) -> tuple[np.ndarray, int]:
    """Rank of each of the 2**16 buckets by its words' occurrences in all documents, rarest first; all occurrences."""
    got = every.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(BUCKETS, np.int64)
    n[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return np.argsort(np.argsort(n, kind="stable"), kind="stable").astype(np.uint64), int(n.sum())


def prefixes(docs: DataFrame, rank: np.ndarray, t: float, key: int) -> DataFrame:
    """at (prefix word, size and place in one long), class, sketch and more (of it, for larger sets) of each class, as
    a rule once for each task, so that hot lines are reduced before the shuffle. Sizes from 65,535 on are written as
    that and escape the filters."""
    rank = docs.sparkSession.sparkContext.broadcast(rank)  # half a megabyte, whatever the input
    small = 4 if t > 0.75 else 1  # smaller sets match only equal sets, which are one class already

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for b in slices(batches, 0):
            _, _, start, name, _ = lines_of(b.column(0), rank.value, key)
            if not len(start):
                continue
            group, which = np.unique(classes_of(name, start)[0], return_index=True)
            fresh = ~np.isin(group, seen, assume_unique=True)
            size = np.diff(np.append(start, len(name)))
            fresh &= size[which] >= small
            group, which = group[fresh], which[fresh]
            if not len(which):
                continue
            seen = group if len(seen) > REMEMBERED else np.concatenate([seen, group])
            size = size[which]
            spot = mix(name)
            bit, low = np.uint64(1) << (spot & np.uint64(63)), (spot & np.uint64(64)) > 0
            sketch = np.bitwise_xor.reduceat(np.where(low, bit, np.uint64(0)), start)[which]
            more = np.bitwise_xor.reduceat(np.where(low, np.uint64(0), bit), start)[which]
            few = size < LARGE
            sketch, more = np.where(few, sketch ^ more, sketch), np.where(few, np.uint64(0), more)
            many = size - np.ceil(size * t - 1e-9).astype(np.int64) + 1
            of = np.repeat(np.arange(len(which)), many)
            place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            word = name[start[which][of] + place] >> np.uint64(32)
            at = word << np.uint64(32) | np.minimum(size, 65535)[of].astype(np.uint64) << np.uint64(16) | np.minimum(place, 65535).astype(np.uint64)
            yield pa.record_batch([pa.array(at.view(np.int64)), pa.array(group[of]), pa.array(sketch[of].view(np.int64)), pa.array(more[of].view(np.int64))], names=["at", "class", "sketch", "more"])

    return docs.select("text").mapInArrow(run, "at long, class long, sketch long, more long")


def needed(x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Least overlap of sets of these sizes for Jaccard >= t."""
    return np.ceil(t / (1 + t) * (x + y) - 1e-9).astype(np.int64)


def least(x: int, y: int, t: float) -> int:
    return math.ceil(t / (1 + t) * (x + y) - 1e-9)


def possible(size, place, sketch, more, x, y, t: float) -> np.ndarray:
    """Whether no filter rules out the pairs of rows x and y (of one prefix word), y not the smaller."""
    sx, sy = size[x], size[y]
    need = needed(sx, sy, t)
    folded = (sx < LARGE) != (sy < LARGE)
    one = np.bitwise_count(sketch[x] ^ sketch[y] ^ np.where(folded, more[x] ^ more[y], np.uint64(0))).astype(np.int64)
    two = np.where(folded, 0, np.bitwise_count(more[x] ^ more[y]))
    ok = (one + two <= sx + sy - 2 * need) & (np.minimum(sx - place[x], sy - place[y]) >= need)
    return (ok & (sx >= t * sy - 1e-9)) | (sy == 65535)  # which stands for larger sets too


def with_partner(word, size, place, sketch, more, t: float) -> np.ndarray:
    """Which rows, sorted by word and size, have a partner of the same word that no filter rules out. All rows are
    compared with the next, the second next and so on, as long as word and size allow; those of long lists
    block by block, so memory is bounded in a list of any length."""
    n = len(word)
    keep = np.zeros(n, bool)
    start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    end = np.append(start[1:], n)
    long = end - start > LONG
    live = np.flatnonzero(np.repeat(~long, end - start))
    for k in range(1, LONG):
        live = live[live + k < n]
        live = live[(word[live + k] == word[live]) & ((size[live] >= t * size[live + k] - 1e-9) | (size[live + k] == 65535))]
        if not len(live):
            break
        ok = live[possible(size, place, sketch, more, live, live + k, t)]
        keep[ok] = keep[ok + k] = True
    for s, e in zip(start[long], end[long], strict=True):
        last = s + np.searchsorted(size[s:e], np.floor(size[s:e] / t + 1e-9), "right")
        at = s
        while at < e:
            stop = min(e, at + max(1, (1 << 20) // max(1, last[at - s] - at)))
            x, y = np.arange(at, stop)[:, None], np.arange(at, last[stop - 1 - s])[None, :]
            ok = possible(size, place, sketch, more, x, y, t) & (x < y)
            keep[at:stop] |= ok.any(axis=1)
            keep[at : last[stop - 1 - s]] |= ok.any(axis=0)
            at = stop
    return keep


def candidates(rows: DataFrame, t: float, n: int) -> DataFrame:
    """word, class: members of each prefix word's list that have a partner left. n: partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy() for i in range(4)] for b in batches]
        if not got:
            return
        at, group, sketch, more = (np.concatenate(c) for c in zip(*got, strict=True))
        del got
        order = np.lexsort((group, at.view(np.uint64)))
        at, group, sketch, more = at[order].view(np.uint64), group[order], sketch[order].view(np.uint64), more[order].view(np.uint64)
        other = np.concatenate([[True], (at[1:] != at[:-1]) | (group[1:] != group[:-1])])  # slices repeat classes
        at, group, sketch, more = at[other], group[other], sketch[other], more[other]
        word, size, place = (at >> np.uint64(32)).astype(np.int64), (at >> np.uint64(16) & np.uint64(65535)).astype(np.int64), (at & np.uint64(65535)).astype(np.int64)
        keep = with_partner(word, size, place, sketch, more, t)
        yield pa.record_batch([pa.array(word[keep].astype(np.uint32).view(np.int32)), pa.array(group[keep])], names=["word", "class"])

    return rows.repartition(n, F.shiftright("at", 32)).mapInArrow(run, "word int, class long")


def members(docs: DataFrame, wanted: DataFrame, key: int) -> DataFrame:
    """wanted(class, rest, doc_id, tie, line, under): word, class, rest, doc_id, tie, line and words (64-bit hashes) of
    each class under each of its words `under`, from the texts."""
    lists = materialise(wanted.groupBy(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie")).agg(F.collect_list(F.struct("line", "class", "rest", "under")).alias("lines")))
    texts = possibly(docs.select("doc_id", "text", F.xxhash64("text").alias("tie")), "tie", lists, "__tie").where("__may")
    met = texts.join(lists, texts.doc_id.eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie")))
    same = np.arange(BUCKETS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            doc, number, start, name, _ = lines_of(b.column(1), same, key)
            end = np.append(start[1:], len(name))
            width = int(number.max(initial=0)) + 1
            found = doc * width + number  # in order
            lists = b.column(3)
            item = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = np.searchsorted(found, owner * width + item.field("line").to_numpy())
            under = item.field("under")
            of = np.repeat(np.arange(len(item)), under.value_lengths().to_numpy(zero_copy_only=False))
            words = pa.array([name[start[i] : end[i]].view(np.int64) for i in at[of]], pa.list_(pa.int64()))
            take, row = pa.array(of), pa.array(owner[of])
            yield pa.record_batch([under.flatten(), item.field("class").take(take), item.field("rest").take(take), b.column(0).take(row), b.column(2).take(row), item.field("line").take(take), words], names=["word", "class", "rest", "doc_id", "tie", "line", "words"])

    return met.select("doc_id", "text", "tie", "lines").mapInArrow(run, "word int, class long, rest long, doc_id long, tie long, line int, words array<long>")


def matched(rows: DataFrame, t: float, n: int) -> DataFrame:
    """rows(word, class, rest, doc_id, tie, line, words): classes with an earlier match under some word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if got is None:
            return
        # Null ids come first in order of occurrence, as in min() of a struct.
        word, group, rest = got["word"].to_numpy(), got["class"].to_numpy(), got["rest"].to_numpy()
        ids, nulls = got["doc_id"].fill_null(0).to_numpy(), ~got["doc_id"].is_null().to_numpy()
        tie, line = got["tie"].to_numpy(), got["line"].to_numpy()
        order = np.lexsort((line, tie, ids, nulls, word))
        again = (word[order][1:] == word[order][:-1]) & (group[order][1:] == group[order][:-1]) & (rest[order][1:] == rest[order][:-1])
        order = order[np.concatenate([[True], ~again])]  # repeated rows
        lists = got["words"].combine_chunks()
        off, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        word, found = word[order], np.zeros(len(order), bool)
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        for s, e in zip(start, np.append(start[1:], len(word)), strict=True):
            own, late = order[s:e], found[s:e]
            if e - s <= 4:
                sets = [set(flat[off[i] : off[i + 1]].tolist()) for i in own]
                for y in range(1, e - s):
                    late[y] = any(len(sets[x] & sets[y]) >= least(len(sets[x]), len(sets[y]), t) for x in range(y))
                continue
            sizes = off[own + 1] - off[own]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            values = np.unique(np.concatenate([flat[off[i] : off[i + 1]] for i in own]), return_inverse=True)[1]
            mark = np.zeros(len(values), np.int64)
            for x in range(e - s - 1):
                size = sizes[x + 1 :]
                far = np.flatnonzero(~late[x + 1 :] & (np.minimum(size, sizes[x]) >= t * np.maximum(size, sizes[x]) - 1e-9))
                if not len(far):
                    continue
                own_values = values[ends[x] : ends[x + 1]]
                mark[own_values] = 1
                common = np.add.reduceat(mark[values[ends[x + 1] :]], ends[x + 1 : -1] - ends[x + 1])[far]
                mark[own_values] = 0
                late[far[common >= needed(sizes[x], size[far], t)] + x + 1] = True
                if late[x + 1 :].all():
                    break
        gone = order[found]
        yield pa.record_batch([pa.array(group[gone]), pa.array(rest[gone])], names=["class", "rest"])

    return rows.repartition(n, "word").mapInArrow(run, "class long, rest long").distinct()


def removals(docs: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """doc_id, tie and the array `lines` of the numbers of the lines to remove, for texts that lose any."""
    key = drawn_key()
    every = materialise(places(docs, key))
    lines, place, name = every.where("bucket IS NULL"), F.struct("doc_id", "tie", "line"), ["class", "rest"]
    # What is one row for each class: hot lines are reduced on the map side.
    classes = materialise(lines.groupBy(*name).agg(F.min(place).alias("first"), F.count("*").alias("n")))
    rank, words = rarity(every)
    n = max(partitions(docs.sparkSession), words // WORDS_PER_TASK + 1)
    some = candidates(prefixes(docs, rank, t, key), t, n).groupBy("class").agg(F.collect_set("word").alias("under"))
    late = matched(members(docs, some.join(classes, "class").select(*name, "under", "first.*"), key), t, n)
    state = materialise(classes.join(late.withColumn("late", F.lit(True)), name, "left"), instead=classes)
    # At most HOT classes have so many lines; they are broadcast, and their lines needn't meet in a task.
    limit = (state.agg(F.sum("n")).first()[0] or 0) // HOT
    hot = F.broadcast(state.where(F.col("n") > limit).select(*name, F.col("first").alias("own"), F.coalesce("late", F.lit(False)).alias("gone")))
    rows = lines.select(*name, "doc_id", "tie", "line").join(hot, name, "left")
    hot_lost = rows.where(F.col("own").isNotNull() & (F.col("gone") | ~place.eqNullSafe(F.col("own"))))
    rows = rows.where("own IS NULL").drop("own", "gone").join(state.where(F.col("n") <= limit), name)
    lost = rows.where(F.coalesce("late", F.lit(False)) | ~place.eqNullSafe(F.col("first")))
    lost = lost.select("doc_id", "tie", "line").union(hot_lost.select("doc_id", "tie", "line"))
    found = materialise(lost.groupBy("doc_id", "tie").agg(F.collect_set("line").alias("lines")), instead=every)
    discard(state)
    return found


def dedup_lines(docs: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """The rows of docs with later matches of lines removed from text, and n_lines and n_removed added (over
    columns of those names).

    Lines end at line feeds; words are separated by ASCII white space and compared unchanged. A line of document
    order (doc_id, a hash of the text, line number), null doc_id first, goes if an earlier line of the table,
    removed or not, has a Jaccard similarity of its set of words >= t. Lines without words stay. Null text stays
    null, with 0 lines. Repeated rows are one document: what leaves one leaves the other. Other columns are kept
    as they are. An empty table gives an empty result. A text of any length is worked on whole. Words are compared by
    64-bit and whole sets by 128-bit hashes, under a key that is drawn for each run.
    """
    gone = removals(docs, t).select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.col("lines").alias("__lines"))
    rows = possibly(docs.withColumn("__of", F.xxhash64("text")), "__of", gone, "__tie")
    some = rows.where("__may")
    some = some.join(gone, some.doc_id.eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__tie")), "left").select(*docs.columns, "__lines")
    rows = some.union(rows.where("NOT __may").select(*docs.columns, F.lit(None).cast("array<int>")))
    parts = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("__lines", i)), "\n")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    made = {"n_lines": n, "n_removed": F.coalesce(F.size("__lines"), F.lit(0)).cast("long"), "text": F.when(F.col("__lines").isNull(), F.col("text")).otherwise(kept)}
    columns = [c for c in docs.columns if c not in made]
    return rows.select(*[made["text"].alias("text") if c == "text" else F.col(c) for c in docs.columns if c in columns or c == "text"], *[made[c].alias(c) for c in ("n_lines", "n_removed")])
