"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit set where more than half of the text's shingle hashes have it. Two fingerprints
are linked if they differ in at most `radius` bits. Each fingerprint emits every variant within half the
radius, the shuffle brings equal variants together, and what meets is deduplicated and verified. For an odd
radius the odd bit is given away: the fingerprint is emitted once for each of three blocks with that block
erased (one of the differing bits lies in some block), so that radius 3 costs 132 variants and not the
2,081 of a full ball of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nearcopy
from .common import SHINGLE_WORDS, SIMILARITY, materialise, partitions, slices
from .components import components

BITS, BLOCKS, SEED = 64, 3, 42
#: Variants that one task sorts at a time, about 16 bytes each.
ROWS_PER_TASK = 1_000_000


def fingerprint(text: str | None, shingle: int) -> int:
    """As a signed 64-bit number; a text without words gives 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.fromiter((digest(join(r), SEED) for r in runs), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 15):  # bounded memory for very long texts
        part = np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """key and fp (signed long) of each row of docs; other columns are dropped. Null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = pa.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.record_batch([b.column(0), fp], names=[key, "fp"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, fp long")


def masks(radius: int) -> list[tuple[int, np.ndarray]]:
    """For each way to erase: the bits kept, and what to flip for each variant."""
    half, odd = divmod(radius, 2)
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    erased = [range(a, b) for a, b in zip(edges, edges[1:], strict=False)] if odd else [range(0)]
    out = []
    for block in erased:
        free = [b for b in range(BITS) if b not in block]
        flips = [sum(1 << b for b in c) for k in range(half + 1) for c in combinations(free, k)]
        out.append((sum(1 << b for b in free), np.array(flips, np.uint64)))
    return out


def forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """The smallest member that each of a few fingerprints reaches by links; no pair is kept."""
    label, n = np.arange(len(fps)), len(fps)
    step = max(1, (1 << 22) // n)
    while True:
        new = label.copy()
        for at in range(0, n, step):
            near = np.bitwise_count(fps[at : at + step, None] ^ fps[None, :]) <= radius
            new[at : at + step] = np.where(near, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """fps(fp): distinct fingerprints. Returns a, b: for all fingerprints that share a variant, a forest of
    the verified links among them, which joins the same fingerprints as all pairs within the radius do."""
    ways = masks(radius)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fp), 4096):
                fp = all_fp[at : at + 4096]
                for i, (kept, flips) in enumerate(ways):
                    rest = (fp & np.uint64(kept)) | (~np.uint64(kept) & np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64))
                    keys = (rest[:, None] ^ flips[None, :]).ravel()
                    yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64))], names=["variant", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        key, fp = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        del got
        order = np.argsort(key, kind="stable")
        key, fp = key[order], fp[order].view(np.uint64)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        a, b = [], []
        two = start[size == 2]
        ok = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
        a.append(fp[two][ok])
        b.append(fp[two + 1][ok])
        for at, n in zip(start[size > 2], size[size > 2], strict=False):
            group = fp[at : at + n]
            root = forest(group, radius)
            tied = root != np.arange(n)
            a.append(group[tied])
            b.append(group[root[tied]])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        yield pa.record_batch([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], names=["a", "b"])

    rows = fps.count() * sum(len(f) for _, f in ways)
    n = max(partitions(fps.sparkSession), rows // ROWS_PER_TASK + 1)
    met = fps.select("fp").mapInArrow(emit, "variant long, fp long").repartition(n, "variant").mapInArrow(meet, "a long, b long")
    return met.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of each row of docs.

    component_id is the smallest doc_id that links reach. Null and empty texts have fingerprint zero and are
    linked like any other. Repeated rows come out as often as they come in. Rows with a null doc_id take
    part; they get the component of their fingerprint. Columns other than doc_id and text are ignored.
    Equal fingerprints are one node, so groups of copies of any size cost one row.
    """
    fps = materialise(fingerprints(docs, shingle))
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes, radius))
    named = nodes.join(found, nodes.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "component").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY, radius: int = 3) -> DataFrame:
    """The rows of docs with one of each group of near-duplicates by shingle similarity; see nearcopy.keep_one().

    Fingerprints within the radius are found by balls, and what they link is verified by its shingle sets. At that
    similarity fingerprints of 64 bits may differ in about ten, beyond what balls reach: the prefix filter finds the rest,
    so that no pair of the similarity is lost, and none below it goes."""
    return nearcopy.keep_one(docs, shingle, similarity, near=lambda fps: links(fps, radius))
