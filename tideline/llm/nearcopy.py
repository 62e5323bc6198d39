"""Near-duplicates by the Jaccard similarity of their shingle sets, all of them: prefix filter and verification.

Texts with equal sets are one node. With the hashes of all sets in one order, two sets of similarity s or more share
one of their first n - ceil(s n) + 1 hashes, so only those are shuffled, and only nodes that meet are compared. The
order is that of rarity, by counts of all hashes over all documents in 2**18 buckets: shingles of a line or passage that
many texts hold come last, and texts that have nothing else in common don't meet. Any order gives right results.
Links are found in two rounds. First each node is compared with one leader of each hash it shares, so that a group of
near copies costs a star and not all pairs. What is then in one component needs no further comparison; between
components, all nodes that share a hash are compared if they share as many as the similarity asks of the two prefixes.
Pairs are first held against parity sketches: the bits in which two sketches differ are no more than the hashes in
which the sets differ. Whole sets are made of the texts of the few pairs that are left, and no others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SHINGLE_WORDS, SIMILARITY, discard, drawn_key, hashed_words, materialise, mix, partitions, possibly, rolling, slices
from .components import components

#: Prefix rows of one task, about 20 bytes each; pairs that are counted at a time.
ROWS_PER_TASK, PAIRS = 2_000_000, 1_000_000
#: Sketches compared at a time.
SKETCHES = 20_000
NEAR = 1e-9
#: Bits of a parity sketch.
SKETCH = 2048
#: Bits that name the bucket in which a hash is counted: ranks of a megabyte, whatever the input.
BUCKET_BITS = 18
#: Nodes that a task remembers to have emitted, eight bytes each.
REMEMBERED = 500_000


def shingle_sets(texts: pa.Array, shingle: int, key: int = 0) -> Iterator[np.ndarray]:
    """The ascending hashes of each text's runs of words in lower case; of a shorter text, of all its words."""
    # Copied first: ascii_lower keeps the offsets of a slice, but not the bytes before it.
    texts = texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    _, off, start, h = hashed_words(pc.ascii_lower(pc.fill_null(texts, "")), key)
    at = np.searchsorted(start, off)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield np.unique(rolling(h[a:b], min(shingle, b - a))) if b > a else np.zeros(0, np.uint64)


def prefix(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many hashes of a set of n one of equal or higher similarity must meet."""
    return n - np.ceil(similarity * n - NEAR).astype(np.int64) + 1


def bucket_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def rarity(seen: DataFrame) -> np.ndarray:
    """Rank of each bucket by the sets that hold its hashes, in all documents, rarest first."""
    got = seen.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("count")).toArrow()
    n = np.zeros(1 << BUCKET_BITS, np.int64)
    n[got["bucket"].to_numpy()] = got["count"].to_numpy()
    rank = np.empty(len(n), np.int32)
    rank[np.argsort(n, kind="stable")] = np.arange(len(n), dtype=np.int32)
    return rank


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both + NEAR >= similarity * (len(a) + len(b) - both)


def grouped(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray] | None:
    """The columns by the first of them, then by the second, without repeats of the two, and where groups begin and end."""
    got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not got:
        return None
    cols = [np.concatenate(c) for c in zip(*got, strict=True)]
    del got
    order = np.lexsort((cols[1], cols[0]))
    cols = [c[order] for c in cols]
    new = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
    cols = [c[new] for c in cols]
    return cols, np.append(np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]])), len(cols[0]))


def sketch(s: np.ndarray) -> bytes:
    """The parity of how many hashes of a set fall on each of SKETCH bits."""
    return np.packbits(np.bincount(mix(s ^ np.uint64(SKETCH)) % np.uint64(SKETCH), minlength=SKETCH) & 1).tobytes()


def sized(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(a, b) + NEAR >= similarity * np.maximum(a, b)


def asked(a: Column, b: Column, similarity: float) -> Column:
    """How many hashes of their prefixes sets of these sizes share at least. Of the set whose prefix ends first, only
    the hashes after it, ceil(s n) - 1, can be shared besides."""
    up = lambda x: F.ceil(x - F.lit(NEAR))
    return F.greatest(up((a + b) * (similarity / (1 + similarity))) - F.greatest(up(a * similarity), up(b * similarity)) + 1, F.lit(1))


def stars(shared: DataFrame, similarity: float, n: int) -> DataFrame:
    """Distinct a, b: the nodes of each hash with its leader, that of the least mixed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = grouped(batches)
        if got is None:
            return
        (_, node, size), ends = got
        rank = mix(node.view(np.uint64))
        group = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        order = np.lexsort((rank, group))
        lead = order[ends[:-1]][group]
        ok = (lead != np.arange(len(node))) & sized(size, size[lead], similarity)
        pairs = np.unique(np.stack([node[ok], node[lead[ok]]]), axis=1)
        yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return shared.select("hash", "node", "n").repartition(n, "hash").mapInArrow(run, "a long, b long").distinct()


def mixed(labelled: DataFrame, n: int) -> DataFrame:
    """The rows (hash, node, component) of hashes that nodes of several components hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = grouped(batches)
        if got is not None:
            cols, ends = got
            several = np.minimum.reduceat(cols[2], ends[:-1]) != np.maximum.reduceat(cols[2], ends[:-1])
            several = np.repeat(several, np.diff(ends))
            yield pa.record_batch([pa.array(c[several]) for c in cols], names=["hash", "node", "component"])

    return labelled.select("hash", "node", "component").repartition(n, "hash").mapInArrow(run, "hash long, node long, component long")


def crossing(rows: DataFrame, nodes: DataFrame, similarity: float, n: int) -> DataFrame:
    """Distinct a, b of different components that share a hash and as many as they must, and whose sketches don't rule
    the similarity out. Sketches are held against each other where the pairs meet, so that only the pairs left are
    shuffled, and not all that share a passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, known = [], {}
        for rows in batches:
            got.append(rows.select(["hash", "node", "n", "component"]))
            node = rows.column("node").to_numpy()
            of, at = np.unique(node, return_index=True)
            for x, i in zip(of.tolist(), at.tolist(), strict=True):
                if x not in known:
                    known[x] = rows.column("sketch")[i].as_py()
        got = grouped(got)
        if got is None:
            return
        (_, node, size, comp), ends = got
        # Every node's sketch is held once, however many of its rows are here.
        names = np.array(sorted(known), np.int64)
        bits = np.frombuffer(b"".join(known[x] for x in names.tolist()), np.uint64).reshape(len(names), -1)
        known.clear()
        where = np.searchsorted(names, node)
        n_of = np.zeros(len(names), np.int64)
        n_of[where] = size

        def counted(a: list, b: list) -> pa.RecordBatch:
            x, y = np.concatenate(a), np.concatenate(b)
            pairs, k = np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y), return_counts=True)
            x, y = pairs // len(names), pairs % len(names)
            ok = np.zeros(len(x), bool)
            for i in range(0, len(x), SKETCHES):
                at = slice(i, i + SKETCHES)
                most = (1 - similarity) / (1 + similarity) * (n_of[x[at]] + n_of[y[at]])
                ok[at] = np.bitwise_count(bits[x[at]] ^ bits[y[at]]).sum(axis=1, dtype=np.int64) <= most + NEAR
            x, y = x[ok], y[ok]
            return pa.record_batch([pa.array(names[x]), pa.array(names[y]), pa.array(n_of[x]), pa.array(n_of[y]), pa.array(k[ok].astype(np.int64))], names=["a", "b", "n_a", "n_b", "k"])

        a, b, held = [], [], 0
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            at = lo + np.argsort(size[lo:hi], kind="stable")
            # Sizes ascend: those after x that aren't too large.
            most = np.searchsorted(size[at], size[at] / similarity + NEAR, "right")
            for i, x in enumerate(at[:-1]):
                y = at[i + 1 : most[i]]
                y = y[comp[y] != comp[x]]
                if len(y):
                    a.append(np.repeat(where[x], len(y)))
                    b.append(where[y])
                    held += len(y)
                if held >= PAIRS:
                    yield counted(a, b)
                    a, b, held = [], [], 0
        if a:
            yield counted(a, b)

    whole = rows.join(nodes.select("node", "n", "sketch"), "node").select("hash", "node", "n", "component", "sketch")
    met = whole.repartition(n, "hash").mapInArrow(run, "a long, b long, n_a long, n_b long, k long")
    pairs = met.groupBy("a", "b", "n_a", "n_b").agg(F.sum("k").alias("k"))
    return pairs.where(F.col("k") >= asked(F.col("n_a"), F.col("n_b"), similarity)).select("a", "b")


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sketches don't rule the similarity out, with the sizes n_a and n_b of their sets."""
    names = pairs.columns
    m = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x, y = (np.frombuffer(b"".join(rows.column(i).to_pylist()), np.uint64).reshape(rows.num_rows, -1) for i in (m + 2, m + 3))
            most = (1 - similarity) / (1 + similarity) * (rows.column(m).to_numpy() + rows.column(m + 1).to_numpy())
            yield rows.select(range(m + 2)).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most + NEAR))

    one = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    rows = pairs.join(one("a"), "a").join(one("b"), "b").select(*names, "n_a", "n_b", "s_a", "s_b")
    return rows.mapInArrow(run, T.StructType(list(pairs.schema.fields)).add("n_a", T.LongType()).add("n_b", T.LongType()))


def verified(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, shingle: int, similarity: float, key: int) -> DataFrame:
    """The pairs a, b whose sets are similar; pairs is materialised, and goes."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.record_batch([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1), shingle, key)], pa.binary())], names=["node", "set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x, y = rows.column(2), rows.column(3)
            ok = [similar(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64), similarity) for i in range(rows.num_rows)]
            yield rows.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    asked = materialise(ends.join(nodes, "node").select("node", F.col("first.doc_id").alias("i"), F.col("first.tie").alias("t")))
    rows = possibly(keyed, "tie", asked, "t").where("__may")
    texts = rows.join(asked, rows.doc_id.eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t"))).select("node", "text").dropDuplicates(["node"])
    sets = materialise(texts.mapInArrow(full, "node long, set binary"), instead=asked)
    one = lambda k: sets.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}"))
    links = materialise(pairs.select("a", "b").join(one("a"), "a").join(one("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"), instead=sets)
    discard(pairs)
    return links


def majority(s: np.ndarray) -> int:
    """The SimHash of a set: a bit is 1 if it is set in over half of its hashes; 0 without any. As a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 15):  # bounded memory for very long texts
        ones += np.unpackbits(mix(s[at : at + (1 << 15)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(s), bitorder="little").view(np.int64)[0])


def proposed(nodes: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Distinct a, b: each node with the first of its fingerprint, and the firsts of fingerprints that near() links."""
    firsts = materialise(nodes.groupBy("fp").agg(F.min("node").alias("lead")))
    one = lambda k: firsts.select(F.col("fp").alias(k), F.col("lead").alias(f"lead_{k}"))
    between = near(firsts.select("fp")).join(one("a"), "a").join(one("b"), "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    return nodes.join(firsts, "fp").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).union(between)


def groups(docs: DataFrame, shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """component and first (doc_id is null, doc_id, hash of the text; the least) of each distinct shingle set of docs;
    the component is equal for sets that links of the similarity join. Texts without words are one set.

    near: links (a, b) between distinct SimHash fingerprints (fp); sets whose fingerprints it links are verified first, and
    those that are similar need no further comparison."""
    key = drawn_key()
    kind = "doc_id bigint, tie bigint, node long, n long, sketch binary, fp long, bucket int, count long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names = np.zeros(1 << BUCKET_BITS, np.int64), ["doc_id", "tie", "node", "n", "sketch", "fp", "bucket", "count"]
        for b in slices(batches):
            sets = list(shingle_sets(b.column(1), shingle, key))
            total += np.bincount(bucket_of(np.concatenate(sets)), minlength=len(total))
            node = np.array(list(map(node_of, sets)), np.uint64).view(np.int64)
            n = np.array([len(s) for s in sets], np.int64)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.record_batch([b.column(0), b.column(2), pa.array(node), pa.array(n), pa.array(list(map(sketch, sets)), pa.binary()), pa.array(list(map(majority, sets)), pa.int64()) if near else none, none.cast(pa.int32()), none], names=names)
        at = np.flatnonzero(total)
        none = pa.nulls(len(at), pa.int64())
        yield pa.record_batch([none, none, none, none, pa.nulls(len(at), pa.binary()), none, pa.array(at.astype(np.int32)), pa.array(total[at])], names=names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = np.zeros(0, np.int64)
        for b in slices(batches, 0):
            sets = list(shingle_sets(b.column(0), shingle, key))
            node, which = np.unique(np.array(list(map(node_of, sets)), np.uint64).view(np.int64), return_index=True)
            fresh = ~np.isin(node, done, assume_unique=True)
            node, which = node[fresh], which[fresh]
            if not len(node):
                continue
            done = node if len(done) > REMEMBERED else np.concatenate([done, node])
            n = np.array([len(sets[i]) for i in which], np.int64)
            many = np.minimum(prefix(n, similarity), n)
            first = [sets[i][np.argsort(rank.value[bucket_of(sets[i])], kind="stable")[:k]] for i, k in zip(which, many, strict=True)]
            yield pa.record_batch([pa.array(np.concatenate(first).view(np.int64)), pa.array(np.repeat(node, many)), pa.array(np.repeat(n, many))], names=["hash", "node", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = grouped(batches)
        if got is not None:
            cols, ends = got
            many = np.repeat(np.diff(ends) > 1, np.diff(ends))
            yield pa.record_batch([pa.array(c[many]) for c in cols], names=["hash", "node", "n"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    seen = materialise(keyed.mapInArrow(read, kind))
    found = seen.where("node IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("tie"))).alias("first")
    nodes = materialise(found.groupBy("node").agg(first, F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp")))
    rows = found.agg(F.sum(F.col("n") - F.ceil(similarity * F.col("n") - F.lit(NEAR)) + 1)).first()[0] or 0
    n = int(max(partitions(docs.sparkSession), rows // ROWS_PER_TASK + 1))
    rank = docs.sparkSession.sparkContext.broadcast(rarity(seen))
    shared = materialise(docs.select("text").mapInArrow(emit, "hash long, node long, n long").repartition(n, "hash").mapInArrow(meet, "hash long, node long, n long"), instead=seen)
    pairs = stars(shared, similarity, n)
    pairs = pairs.union(proposed(nodes, near)).distinct() if near else pairs
    links = verified(materialise(plausible(pairs, nodes, similarity)), nodes, keyed, shingle, similarity, key)
    found = materialise(components(links))
    labelled = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = materialise(mixed(labelled, n), instead=shared)
    # A row has a sketch here, some 300 bytes.
    near = crossing(rows, nodes, similarity, max(n, rows.count() // (ROWS_PER_TASK // 16) + 1))
    more = verified(materialise(near), nodes, keyed, shingle, similarity, key)
    for step in (rows, found):
        discard(step)
    found = components(links.union(more))
    return nodes.join(found, "node", "left").select(F.coalesce("component", "node").alias("component"), "first")


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of docs, all columns, with one of each group of near-duplicates: that of the smallest doc_id, then
    of the smallest hash of its text; null ids go last. Repeated rows are one group. Empty texts are one group."""
    stay = groups(docs, shingle, similarity, near).groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.tie").alias("__tie"))
    rows = docs.withColumn("__of", F.xxhash64("text"))
    kept = rows.join(stay, rows.doc_id.eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__tie")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__of"]).drop("__of")
