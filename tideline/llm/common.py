"""Helpers that the text operators share: tables, words in Arrow batches, materialised steps."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production defaults of near-duplicate stages on word shingles.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bytes of text that a task works on at a time; a longer text is worked on alone.
TEXT_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def local_dir() -> str:
    return tempfile.mkdtemp(prefix="tideline-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one if all runs in one
    process; on a cluster, which would not see it, an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return local_dir()
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def materialise(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back, so that a lost
    executor costs a read and not a recomputation. Empty frames keep their schema. `instead`: an earlier
    step that nothing reads any more; its files go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead is not None:
        discard(instead)
    made = spark.read.schema(df.schema).parquet(path)
    made.step = path
    return made


def discard(step: DataFrame) -> None:
    """Deletes what materialise() wrote for this frame."""
    path = step.sparkSession._jvm.org.apache.hadoop.fs.Path(step.step)
    path.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words between ASCII white space (0x20, 0x09-0x0D), unchanged: offsets by text, and all words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    off, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full).as_py() is False:  # an empty text gives one empty word
        keep = full.to_numpy(zero_copy_only=False)
        off = np.concatenate([[0], np.cumsum(keep)])[off - off[0]]
        flat = flat.filter(full)
    return off - off[0], flat


def split_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text and number (from 0) of each line, and the lines; null text has none."""
    rows = [(x or "").split("\n") if x is not None else [] for x in texts.to_pylist()]
    count = np.array([len(r) for r in rows], np.int64)
    doc = np.repeat(np.arange(len(rows)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, number, pa.array([x for r in rows for x in r], pa.large_string())


STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Keeps the first k bytes of a little-endian number of eight.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def drawn_key() -> int:
    """A secret key for the hashes of one run: nobody can write words that collide under it."""
    return int.from_bytes(os.urandom(8), "little")


def hashed_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each data[start:end], by a key: eight bytes at a time through a finaliser that is a bijection, so
    equal lengths of up to eight bytes never collide; the key gives the factors of the finaliser and the state that it
    begins with, so that which longer words would collide depends on it. Those of over LONG_WORD bytes by xxh3 with the
    key as its seed."""
    more, *factors = key_parts(key)
    size = end - start
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = scrambled(size.astype(np.uint64) * STEP + more, *factors)
    live = np.flatnonzero(size <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        h[live] = scrambled(h[live] ^ (eight[start[live] + k] & FIRST[np.minimum(size[live] - k, 8)]), *factors)
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), key)
    return h


def key_parts(key: int) -> tuple[np.uint64, np.uint64, np.uint64]:
    """A number to begin with and two odd factors, all drawn from the key."""
    one, two, three = mix(np.array([key + i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for i in (1, 2, 3)], np.uint64))
    return one, two | np.uint64(1), three | np.uint64(1)


def scrambled(x: np.ndarray, one: np.uint64, two: np.uint64) -> np.ndarray:
    """mix() by factors of the caller's, which must be odd; x is the caller's to lose."""
    shift = np.uint64(33)
    x ^= x >> shift
    x *= one
    x ^= x >> shift
    x *= two
    x ^= x >> shift
    return x


def hashed_words(texts: pa.Array, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space as 64-bit hashes, straight from the UTF-8 bytes: all bytes, offsets of the
    texts in them, first byte of each word, hash of each word."""
    data, off = raw_bytes(texts)
    n = len(data)
    letter = ~SPACE[data]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    cut = off[(off > 0) & (off < n)]  # words end with their text
    first[cut] |= letter[cut]
    last[cut - 1] |= letter[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, off, start, hashed_spans(data, start, end, key)


def bits_for(n: int) -> int:
    """Bits of a bitmap of n values: a sixteenth of them set at most, from 2**20 to 2**26 (a million rows, some 30 MB)."""
    return min(1 << 26, max(1 << 20, 1 << (16 * n).bit_length()))


def bitmap(df: DataFrame, column: str, bits: int) -> DataFrame:
    """The set of a column's values (longs) as at most bits / 64 rows (__slot, __mask), whatever the input: small
    enough to broadcast. See possibly()."""
    slot = F.pmod(F.col(column), F.lit(bits))
    return df.select(F.shiftright(slot, 6).alias("__slot"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("__bit")).groupBy("__slot").agg(F.bit_or("__bit").alias("__mask"))


def possibly(df: DataFrame, column: str, step: DataFrame, of: str) -> DataFrame:
    """df with boolean __may: whether the column's value may be among those of `of` in a materialised step, by a
    bitmap; false is certain. An exact join of those that may be follows; the others need not be shuffled."""
    bits = bits_for(step.count())
    among = bitmap(step, of, bits)
    slot = F.pmod(F.col(column), F.lit(bits))
    met = df.withColumn("__slot", F.shiftright(slot, 6)).join(F.broadcast(among), "__slot", "left")
    return met.withColumn("__may", F.coalesce(F.getbit("__mask", (slot % 64).cast("int")) == 1, F.lit(False))).drop("__slot", "__mask")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    return scrambled(x.copy(), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive values; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = g * STEP + h[j : j + n]
    return mix(g)


def owner(off: np.ndarray) -> np.ndarray:
    """Number of the text that each word is of."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def bucket(column: str, n: int):
    """crc32 of an id as text, modulo n: the deterministic fold of a row."""
    return F.crc32(F.col(column).cast("string")) % n


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `most` bytes of the text column, to bound memory; a text is never cut."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < len(size):
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right"))
            end = max(end, at + 1)
            yield b.slice(at, end - at)
            at = end


def held_out(column: str, n: int, remainder: int):
    """Whether a row is in the fold that models don't learn from; a null id is in no held-out fold."""
    return F.coalesce(bucket(column, n) == remainder, F.lit(False))


def sampled(df: DataFrame, column: str, bound: int) -> DataFrame:
    """About `bound` rows at most, chosen by a hash of an id; all rows if there are fewer."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(column), F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * bound / n))
