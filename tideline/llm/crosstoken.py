"""Cross-tokenizer alignment: which tokens of one vocabulary go with which of another, counted over a corpus.

A text's tokens are cut into groups at the byte offsets where tokens of both vocabularies end; all pairs within a group
are linked. A pair of ids is one packed 64-bit key (first id above 32 bits of second), so keys sort by their first id.

Each task counts the documents of its keys with np.unique; the partial counts are sorted over the whole cluster by
ranges of keys and equal neighbours are summed, which leaves sorted shards of counts. A shard is a file of keys and
counts in the shared folder; lookups map the files into memory and search them, so a task reads only the pages that its
keys are on. Where the shared folder is no file system that can be mapped, the same counts are joined instead.

Texts are encoded by runs: between a character that isn't white space and a space no token of either vocabulary goes on,
so each distinct run is encoded once in a while.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sentencepiece_bridge as bridge
from .common import discard, materialise, shared_dir, slices

#: Begins where a space follows what is no white space; white space at the end of a text goes with its last run.
RUN = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*")
#: Runs that a task remembers, and their characters; keys that it counts before it gives them on; rows of a shard.
MOST_KNOWN, MOST_CHARS, MOST_KEYS, SHARD_ROWS = 200_000, 8_000_000, 2_000_000, 2_000_000
#: Columns that align() adds, besides groups or groups_sha256.
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_symbols() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte: printable Latin-1 bytes stand for
    themselves, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(c): b for c, b in [*((b, b) for b in plain), *((256 + i, b) for i, b in enumerate(other))]}


class ByteLevel:
    """A byte-level BPE tokenizer of the tokenizers library, from its JSON file."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_str(data.decode())
        self.t.encode_special_tokens = True
        before = json.loads(data).get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError("a byte-level tokenizer without a prefix space of its own is needed")
        symbols, vocab = byte_symbols(), self.t.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes[i] = bytes(symbols[c] for c in piece) if all(c in symbols for c in piece) else piece.encode()

    def encode(self, runs: list[str]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch_fast(runs, add_special_tokens=False)]


class Pieces:
    """A SentencePiece model, by the library; it sets a space before each text."""

    def __init__(self, data: bytes):
        m = bridge.parse(data)
        if not m.dummy_prefix or not bridge.by_runs(m):
            raise ValueError("a BPE model that sets a prefix, keeps texts as they are and has no piece across spaces is needed")
        self.s = bridge.original(data)
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == bridge.BYTE else p.replace(bridge.MARKER, " ").encode() for p, _, kind in m.pieces]

    def encode(self, runs: list[str]) -> list[list[int]]:
        return self.s.encode([r[1:] for r in runs], num_threads=1)


class Aligner:
    """Groups and links of runs, each distinct one encoded once as long as the table holds it."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        self.a, self.b = ByteLevel(byte_level), Pieces(pieces)
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        most = max(len(t.bytes) for t in (self.a, self.b))
        self.digits = np.array([str(i).encode() for i in range(most)]).view(np.uint8).reshape(most, -1)
        self.forget()

    def forget(self) -> None:
        """Empties the table of runs: for each, if both sides have its bytes, tokens of both, groups, links, and the text
        of its groups; its keys and how often each is linked lie between two ends."""
        self.known: dict[str, int] = {}
        self.chars = 0
        self.rows, self.text, self.parts, self.ends = [np.zeros((0, 5), np.int64)], [], [np.zeros((0, 2), np.int64)], [np.zeros(1, np.int64)]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for name in ("rows", "parts", "ends"):
            held = getattr(self, name)
            if len(held) > 1:
                setattr(self, name, [np.concatenate(held)])
        return self.rows[0], self.parts[0], self.ends[0]

    def learn(self, runs: list[str]) -> None:
        ids, ends, good = [], [], np.ones(len(runs), bool)
        raw = [r.encode() for r in runs]
        length = np.array([len(r) for r in raw], np.int64)
        base, whole = np.concatenate([[0], np.cumsum(length)]), b"".join(raw)
        owners = []
        for t, size in zip((self.a, self.b), self.sizes, strict=True):
            got = t.encode(runs)
            count = np.array([len(x) for x in got], np.int64)
            flat = np.fromiter(chain.from_iterable(got), np.int64, count.sum())
            own = np.repeat(np.arange(len(runs)), count)
            if not (np.array_equal(np.bincount(own, size[flat], len(runs)), length) and b"".join([t.bytes[k] for k in flat.tolist()]) == whole):
                bad = [i for i, (x, r) in enumerate(zip(got, raw, strict=True)) if b"".join([t.bytes[k] for k in x]) != r]
                good[bad] = False
                keep = good[own]
                flat, own = flat[keep], own[keep]
                count = np.bincount(own, minlength=len(runs))
            within = np.cumsum(size[flat]) if len(flat) else np.zeros(0, np.int64)
            before = np.concatenate([[0], within])[np.cumsum(count) - count]
            ids.append(flat)
            owners.append(own)
            ends.append(base[own] + within - before[own])
        for i, own in enumerate(owners):  # a run with one side's bytes only has no tokens of either
            keep = good[own]
            ids[i], owners[i], ends[i] = ids[i][keep], own[keep], ends[i][keep]
        cuts = np.intersect1d(ends[0], ends[1], assume_unique=True)
        of = np.searchsorted(base, cuts, "left") - 1  # the run of each group
        groups = [np.searchsorted(cuts, e, "left") for e in ends]
        # Within a group, each id once with how often it is there; then all pairs of the two sides' ids.
        sides = []
        for g, i in zip(groups, ids, strict=True):
            packed, times = np.unique((g << 32) | i, return_counts=True)
            sides.append((packed >> 32, packed & 0xFFFFFFFF, times))
        (ga, ia, ta), (gb, ib, tb) = sides
        first, count = np.searchsorted(gb, np.arange(len(cuts))), np.bincount(gb, minlength=len(cuts))
        each = count[ga]
        left = np.repeat(np.arange(len(ga)), each)
        right = first[ga[left]] + np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
        key, times, run = (ia[left] << 32) | ib[right], ta[left] * tb[right], of[ga[left]]
        order = np.lexsort((key, run))
        key, times, run = key[order], times[order], run[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(times, at) if len(at) else np.zeros(0, np.int64)
        n = len(runs)
        links = np.bincount(run[at], total, n).astype(np.int64)
        rows = np.stack([good, np.bincount(owners[0], minlength=n), np.bincount(owners[1], minlength=n), np.bincount(of, minlength=n), links], 1).astype(np.int64)
        self.rows.append(rows)
        self.parts.append(np.stack([key[at], total], 1))
        self.ends.append(self.ends[-1][-1] + np.cumsum(np.bincount(run[at], minlength=n)))
        self.text += self.written(n, groups, ids, of)

    def written(self, n: int, groups: list[np.ndarray], ids: list[np.ndarray], of: np.ndarray) -> list[bytes]:
        """`a,a|b;a|b,b` of each run: the digits of all ids and the mark after each, as one array of bytes that is cut."""
        group, side = np.concatenate(groups), np.repeat([0, 1], [len(g) for g in groups])
        order = np.lexsort((side, group))  # stable: ids of a side stay in order
        group, side, flat = group[order], side[order], np.concatenate(ids)[order]
        last = np.ones(len(flat), bool)
        last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
        mark = np.where(~last, ord(","), np.where(side == 0, ord("|"), ord(";"))).astype(np.uint8)
        cells = np.concatenate([self.digits[flat], mark[:, None]], 1)
        full = cells != 0
        ends = np.cumsum(np.bincount(of[group], full.sum(1), n).astype(np.int64)).tolist()
        data = cells[full].tobytes()
        return [data[s : max(s, e - 1)] for s, e in zip([0, *ends], ends, strict=False)]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
        """For each text n_a, n_b, n_groups, n_links; its groups as text; its keys, ascending, and the links of each."""
        found = []
        for x in texts:
            if not x:
                found.append([])
                continue
            x = " " + x
            body = x.rstrip()
            runs = RUN.findall(body)
            if runs:
                runs[-1] += x[len(body) :]
            found.append(runs or [x])
        count = np.array([len(x) for x in found], np.int64)
        enc = pa.array([r for x in found for r in x], pa.large_string()).dictionary_encode()
        del found
        vocab = enc.dictionary.to_pylist()
        if len(self.known) + len(vocab) > MOST_KNOWN or self.chars > MOST_CHARS:
            self.forget()
        new = [r for r in vocab if r not in self.known]
        self.chars += sum(map(len, new))
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            self.learn(part)
            self.known.update({r: i for i, r in enumerate(part, len(self.known))})
        rows, parts, ends = self.tables()
        which = np.array([self.known[r] for r in vocab], np.int64)[enc.indices.to_numpy()]
        bounds = np.concatenate([[0], np.cumsum(count)])
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(rows[which], 0)])
        total = sums[bounds[1:]] - sums[bounds[:-1]]
        good = total[:, 0] == count
        total[~good] = 0
        text, links, none = [], [], np.zeros(0, np.int64)
        for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if s == e or not good[i]:
                text.append(b"")
                links.append((none, none))
                continue
            text.append(b";".join([self.text[k] for k in which[s:e].tolist()]))
            run, often = np.unique(which[s:e], return_counts=True)
            size = ends[run + 1] - ends[run]
            at = np.repeat(ends[run] - np.cumsum(size) + size, size) + np.arange(size.sum())
            key, times = parts[at, 0], parts[at, 1] * np.repeat(often, size)
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            links.append((key[first], np.add.reduceat(times, first)))
        return total[:, 1:], text, links


@functools.cache
def loaded(byte_level: bytes, pieces: bytes) -> Aligner:
    return Aligner(byte_level, pieces)


def default_tokenizers() -> tuple[bytes, bytes]:
    """The two public vocabularies at hand, some megabytes, read once by the driver."""
    import public_tokenizers

    made = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as f:
            made.append(f.read())
    return made[0], made[1]


def linked(docs: DataFrame, tokenizers: tuple[bytes, bytes], groups: str) -> DataFrame:
    """docs without text, with n_a, n_b, n_groups, n_links, `groups` (the groups' text or its digest), and as bytes the
    keys of 64 bits (ascending) and the links of each (64 bits)."""
    names = [c for c in docs.columns if c not in (*FIELDS, groups, "__keys", "__times")]
    at = names.index("text")
    out = [i for i in range(len(names)) if i != at]
    sent = docs.sparkSession.sparkContext.broadcast(tokenizers)
    added = ("n_a", "n_b", "n_groups", "n_links", groups, "__keys", "__times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(*sent.value)
        for b in slices(batches, at):
            total, text, links = t.align(b.column(at).to_pylist())
            if groups == "groups_sha256":
                text = [hashlib.sha256(x).hexdigest().encode() if x else b"" for x in text]
            made = [*(pa.array(total[:, i]) for i in range(4)), pa.array(text, pa.binary()).cast(pa.string()), *(pa.array([x[i].tobytes() for x in links], pa.binary()) for i in range(2))]
            yield pa.record_batch([*(b.column(i) for i in out), *made], names=[*(names[i] for i in out), *added])

    schema = T.StructType([docs.schema[names[i]] for i in out])
    for name in added[:4]:
        schema = schema.add(name, "long")
    return docs.select(*names).mapInArrow(run, schema.add(groups, "string").add("__keys", "binary").add("__times", "binary"))


def partial_counts(rows: DataFrame) -> DataFrame:
    """key and n, in how many of a task's documents: by np.unique over as many keys as fit at a time, merged in the task
    as long as the distinct ones do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key, n = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged():
            new, times = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            both, inverse = np.unique(np.concatenate([key, new]), return_inverse=True)
            return both, np.bincount(inverse, np.concatenate([n, times]), len(both)).astype(np.int64)

        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(np.frombuffer(x, np.int64))
                size += len(held[-1])
                if size > MOST_KEYS:
                    key, n = merged()
                    held, size = [], 0
                    if len(key) > MOST_KEYS:
                        yield pa.record_batch([pa.array(key), pa.array(n)], names=["key", "n"])
                        key, n = key[:0], n[:0]
        key, n = merged()
        for s in range(0, len(key), 500_000):
            yield pa.record_batch([pa.array(key[s : s + 500_000]), pa.array(n[s : s + 500_000])], names=["key", "n"])

    return rows.select("__keys").mapInArrow(run, "key long, n long")


def summed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and sums of a sorted partition: equal neighbours are one run, which may go on in the next batch."""
    last, carried = None, 0
    for b in batches:
        key, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(key):
            continue
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, n = key[first], np.add.reduceat(n, first)
        if last is not None and key[0] == last:
            n[0] += carried
        elif last is not None:
            yield np.array([last]), np.array([carried])
        last, carried = int(key[-1]), int(n[-1])
        if len(key) > 1:
            yield key[:-1], n[:-1]
    if last is not None:
        yield np.array([last]), np.array([carried])


def counted(partial: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """key and n over the corpus, sorted by ranges of keys. partial: materialised; a shard for each shard_rows of its rows."""
    shards = max(1, -(-partial.count() // shard_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in summed_runs(batches):
            yield pa.record_batch([pa.array(key), pa.array(n)], names=["key", "n"])

    return partial.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(run, "key long, n long")


class Shards:
    """Sorted count shards in files: keys, then counts, of 64 bits each."""

    def __init__(self, files: list[tuple[int, int, str]]):
        """files: first key, rows and path of each shard, ascending."""
        self.firsts = np.array([f[0] for f in files], np.int64)
        self.maps = [np.memmap(path, np.int64, "r", shape=(2, rows)) for _, rows, path in files]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of ascending keys, all of which are there."""
        out = np.zeros(len(keys), np.int64)
        shard = np.searchsorted(self.firsts, keys, "right") - 1
        bounds = np.searchsorted(shard, np.arange(len(self.maps) + 1))
        for k in np.unique(shard):
            s, e = bounds[k], bounds[k + 1]
            held = self.maps[k]
            out[s:e] = held[1][np.searchsorted(held[0], keys[s:e])]
        return out


def write_shards(counts: DataFrame, folder: str, size: int) -> tuple[list[tuple[int, int, str]], np.ndarray]:
    """One file for each partition of counted(), under a name of its own for each attempt, so that only files of attempts
    that counted are named in what comes back; and the highest count of each of `size` first ids. The driver gets a row
    for each shard, and one for each first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        key, n = (np.concatenate([x[i] for x in got]) for i in range(2))
        path = f"{folder}/shard-{uuid.uuid4().hex}"
        os.makedirs(folder, exist_ok=True)
        with open(path, "wb") as f:
            f.write(key.tobytes())
            f.write(n.tobytes())
            f.flush()
            os.fsync(f.fileno())
        first = np.flatnonzero(np.concatenate([[True], key[1:] >> 32 != key[:-1] >> 32]))
        ids, best = key[first] >> 32, np.maximum.reduceat(n, first)
        yield pa.record_batch([pa.array(np.append(ids, key[0])), pa.array(np.append(best, len(key))), pa.array([None] * len(ids) + [path], pa.string())], names=["key", "n", "path"])

    # Written once, as the files are: whatever reads the rows again must not write other files.
    made = materialise(counts.mapInArrow(run, "key long, n long, path string"))
    files = sorted(map(tuple, made.where("path is not null").collect()))
    tops = made.where("path is null").groupBy("key").agg(F.max("n").alias("n")).toArrow()
    discard(made)
    best = np.zeros(size, np.int64)
    best[tops["key"].to_numpy()] = tops["n"].to_numpy()
    return files, best


def mappable(spark: SparkSession) -> str | None:
    """The shared folder as a path of the file system, if it is one."""
    at = urlparse(shared_dir(spark))
    return unquote(at.path) if at.scheme in ("", "file") else None


def best_counts(counts: DataFrame, size: int) -> np.ndarray:
    """The highest count of each first id: no more numbers than the vocabulary has."""
    got = counts.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n").alias("best")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["a"].to_numpy()] = got["best"].to_numpy()
    return out


def valued(rows: DataFrame, names: list[str], files: list[tuple[int, int, str]], best: np.ndarray) -> DataFrame:
    """rows with n_best and count_sum, looked up in mapped shards."""
    sent = rows.sparkSession.sparkContext.broadcast((files, best))
    kept = [c for c in rows.columns if c not in ("__keys", "__times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, best = Shards(sent.value[0]), sent.value[1]
        for b in slices(batches, len(kept), 8_000_000):
            key, times = (np.frombuffer(b"".join(b.column(len(kept) + i).to_pylist()), np.int64) for i in range(2))
            size = np.array([len(x) // 8 for x in b.column(len(kept)).to_pylist()], np.int64)
            own = np.repeat(np.arange(b.num_rows), size)
            all_keys, inverse = np.unique(key, return_inverse=True)
            n = shards.counts(all_keys)[inverse]
            made = []
            for x in (np.where(n == best[key >> 32], times, 0), times * n):
                total = np.concatenate([[0], np.cumsum(x)])
                ends = np.cumsum(size)
                made.append(pa.array(total[ends] - total[ends - size]))
            yield pa.record_batch([*b.columns[: len(kept)], *made], names=[*kept, "n_best", "count_sum"])

    schema = T.StructType([rows.schema[c] for c in kept]).add("n_best", "long").add("count_sum", "long")
    return rows.select(*kept, "__keys", "__times").mapInArrow(run, schema).select(*names)


def valued_by_join(rows: DataFrame, names: list[str], counts: DataFrame, best: np.ndarray) -> DataFrame:
    """The same by a join of each row's keys with the counts, where shards can't be mapped. The keys are evenly met:
    each row has a key once."""
    numbered = materialise(rows.withColumn("__row", F.monotonically_increasing_id()))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 8_000_000):
            ids, keys, times = (b.column(i).to_pylist() for i in range(3))
            size = [len(x) // 8 for x in keys]
            yield pa.record_batch([pa.array(np.repeat(np.array(ids, np.int64), size)), pa.array(np.frombuffer(b"".join(keys), np.int64)), pa.array(np.frombuffer(b"".join(times), np.int64))], names=["__row", "key", "__n"])

    links = numbered.select("__row", "__keys", "__times").mapInArrow(apart, "__row long, key long, __n long")
    spark = rows.sparkSession
    tops = spark.createDataFrame([(int(i), int(best[i])) for i in np.flatnonzero(best)], "a long, best long")
    met = links.join(counts, "key").withColumn("a", F.shiftright("key", 32)).join(F.broadcast(tops), "a")
    sums = met.groupBy("__row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("__n")).otherwise(0)).alias("n_best"), F.sum(F.col("__n") * F.col("n")).alias("count_sum"))
    return numbered.join(sums, "__row", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}).select(*names)


def align(docs: DataFrame, tokenizers: tuple[bytes, bytes], groups: str = "groups", mapped: bool | None = None) -> DataFrame:
    """docs without its text, with n_a and n_b (tokens of each vocabulary), n_groups, n_links, n_best (links whose pair is
    in as many documents as any pair of its first id), count_sum (over links, documents that hold the pair) and groups
    (`a,a|b;a|b,b`: the ids of each group, in order; or groups_sha256, its digest, empty if it is) added, over columns of
    those names.

    tokenizers: a byte-level BPE's JSON and a SentencePiece BPE model; both are encoded with a space before the text and
    without special tokens, whose strings in a text are plain text. Null and empty texts have no tokens, nor have texts
    that either vocabulary doesn't give back byte for byte (such as those with U+2581, which stands for a space): zeros, and an
    empty groups. Texts of any length are encoded whole. Repeated rows count as documents of their own and come out as
    often as they come in; ids are not looked at, so null ones are rows like others; pairs that tie for the highest count
    are all best. An empty table gives an empty result. mapped: whether counts are looked up in mapped files (None: if the
    shared folder allows it) or joined; the results are equal.
    """
    if groups not in ("groups", "groups_sha256"):
        raise ValueError("groups must be groups or groups_sha256")
    rows = materialise(linked(docs, tokenizers, groups))
    names = [*(c for c in rows.columns if c not in (groups, "__keys", "__times")), "n_best", "count_sum", groups]
    partial, size = materialise(partial_counts(rows)), len(loaded(*tokenizers).a.bytes)
    folder = mappable(docs.sparkSession)
    if folder is None if mapped is None else not mapped:
        counts = materialise(counted(partial), instead=partial)
        return valued_by_join(rows, names, counts, best_counts(counts, size))
    files, best = write_shards(counted(partial), f"{folder}/shards-{uuid.uuid4().hex}", size)
    discard(partial)
    return valued(rows, names, files, best)
