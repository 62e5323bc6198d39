"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A text is the multiset of its non-empty paragraphs (split at line feeds). Each paragraph hashes to a vector of
STRONG + LANES numbers, and the fingerprint is their sum modulo 2**32, lane by lane. So the order of paragraphs
does not matter, and paragraphs can be added to or taken from a fingerprint without the text.

The strong lanes are the words of two SHA-512 digests of the paragraph, 1,024 bits in all: wide enough that lists of
paragraphs of one sum can't be had by a generalised birthday search (some 2**64 steps). The other lanes count, for
each bit of two 64-bit hashes of the paragraph's runs of three words, set less unset bits; the cosine of two such
vectors estimates the share of runs that two texts have in common, with a deviation of about 1 / sqrt(LANES).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRONG, LANES, RUN = 32, 128, 3
#: Ranges of doc_id, at most: bounds what the driver and a broadcast hold (a doc_id and a hash for each).
MOST_RANGES, ROWS_PER_RANGE = 1 << 16, 1000


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p != "")


def digests(paras: Column) -> Column:
    """Two SHA-512 digests of each paragraph, as one string of hexadecimal digits."""
    digest = lambda p, salt: F.sha2(F.concat(F.lit(salt), p).cast("binary"), 512)
    return F.transform(paras, lambda p: F.concat(digest(p, "0"), digest(p, "1")))


def strong(digests: Column) -> Column:
    """Sums of the 32-bit words of digests, which should be a column: an expression would be evaluated for each lane."""
    word = lambda s, k: F.conv(F.substring(s, 8 * k + 1, 8), 16, 10).cast("long")
    lane = lambda k: F.aggregate(digests, F.lit(0).cast("long"), lambda a, s: F.pmod(a + word(s, k), F.lit(1 << 32)))
    return F.array(*map(lane, range(STRONG)))


def runs(paras: Column) -> Column:
    """A 64-bit hash of each run of three words of each paragraph; of a shorter paragraph, one hash."""
    words = F.transform(paras, lambda p: F.filter(F.split(p, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    hashed = F.transform(
        F.filter(words, lambda w: F.size(w) > 0),
        lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - RUN, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(RUN)))),
    )
    return F.flatten(hashed)


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and vector (array of STRONG + LANES longs, each modulo 2**32) of each row of texts, of which keys
    must be unique. Stays in the partitioning of texts if that is by some of the keys."""
    paras = texts.select(*keys, paragraphs(F.col(text)).alias("__p"))
    # In steps: what stands beside a generator is made anew for each row that it gives, digests for each lane.
    digested = paras.select(*keys, digests(F.col("__p")).alias("__d"), runs(F.col("__p")).alias("__r"))
    hashed = digested.select(*keys, strong(F.col("__d")).alias("__s"), "__r")
    rows = hashed.select(*keys, "__s", F.explode_outer("__r").alias("__h"))
    # Two lanes to a number: the bits i and i + 32 of a hash, 32 bits apart, so that one sum does for two lanes.
    hashes, half = [F.col("__h"), F.xxhash64(F.col("__h"))], LANES // 4
    pair = lambda h, i: F.shiftrightunsigned(h, i).bitwiseAND(F.lit(0x100000001))
    lanes = [(k, i) for k in range(len(hashes)) for i in range(half)]
    sums = rows.groupBy(*keys, "__s").agg(F.count("__h").alias("__n"), *(F.coalesce(F.sum(F.when(F.col("__h").isNotNull(), pair(hashes[k], i))), F.lit(0)).alias(f"__{k}_{i}") for k, i in lanes))
    low = [F.col(f"__{k}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)) for k, i in lanes]
    high = [F.shiftrightunsigned(f"__{k}_{i}", 32) for k, i in lanes]
    counts = [F.pmod(2 * c - F.col("__n"), F.lit(1 << 32)) for c in (*low, *high)]
    return sums.select(*keys, F.concat(F.col("__s"), F.array(*counts)).alias("vector"))


def as_text(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def from_text(fingerprint: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(STRONG + LANES - 1)), lambda i: F.conv(F.substring(fingerprint, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def insert(vector: Column, paragraph: Column) -> Column:
    """The vector after the paragraphs of another vector come in."""
    return F.zip_with(vector, paragraph, lambda a, b: F.pmod(a + b, F.lit(1 << 32)))


def delete(vector: Column, paragraph: Column) -> Column:
    """The vector after the paragraphs of another vector go out."""
    return F.zip_with(vector, paragraph, lambda a, b: F.pmod(a - b, F.lit(1 << 32)))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)


def signed(vector: Column) -> Column:
    """The lanes of likeness as numbers around zero."""
    return F.transform(F.slice(vector, STRONG + 1, LANES), lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("double"))


def likeness(a: Column, b: Column, x: Column | None = None, y: Column | None = None, norm_x: Column | None = None, norm_y: Column | None = None) -> Column:
    """0 to 1; 1 for equal vectors, also of two empty texts; 0 if only one is empty. Their signed lanes and the norms
    of these can be given as columns, so that they are not made anew for each use."""
    x, y = signed(a) if x is None else x, signed(b) if y is None else y
    norm = (F.sqrt(dot(x, x)) if norm_x is None else norm_x) * (F.sqrt(dot(y, y)) if norm_y is None else norm_y)
    return F.when(a == b, F.lit(1.0)).when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / norm)))


def ranged(docs: DataFrame) -> DataFrame:
    """docs in ranges of doc_id of about equal size, as column `range`; the first row of each range is also put,
    as a guest, at the end of the range before (of the first range: of the last), so that a window over a range
    sees each row's successor."""
    spark = docs.sparkSession
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, n // ROWS_PER_RANGE))
    cuts = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else []
    cuts = sorted(set(cuts or []))
    found = F.lit(0)
    if cuts:
        bounds, steps = F.lit(cuts), [1 << i for i in reversed(range(len(cuts).bit_length()))]
        found = F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when(F.coalesce(F.get(bounds, at + s - 1) <= F.col("doc_id"), F.lit(False)), at + s).otherwise(at))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("range", found)
    starts = [r for r in rows.groupBy("range").agg(F.min(F.struct("doc_id", "tie")).alias("s")).select("range", "s.*").collect()]
    order = sorted(r["range"] for r in starts)
    before = dict(zip(order, [order[-1:], *([x] for x in order)], strict=False)) if order else {}
    guests = spark.createDataFrame([(r["doc_id"], r["tie"], before[r["range"]][0]) for r in starts], "g_id long, g_tie long, g_range int")
    # At most MOST_RANGES rows are broadcast, whatever the input.
    extra = rows.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie"))).select("doc_id", "text", "tie", F.col("g_range").alias("range"), F.lit(1).alias("guest"))
    return rows.withColumn("guest", F.lit(0)).unionByName(extra)


def edit_likeness(docs: DataFrame) -> DataFrame:
    """For each row of docs: its fingerprint, that of its text with the last quarter replaced from the next
    document's start, and their likeness.

    Null text counts as empty; a text of any length counts whole. Rows come in ascending doc_id, null first, rows with one doc_id by a hash of
    the text; the last row's next is the first, also if there is only one row. Columns other than doc_id and
    text are ignored. An empty table gives an empty result.
    """
    w = Window.partitionBy("range").orderBy("guest", "doc_id", "tie")
    head = F.col("n_chars") - F.floor(F.col("n_chars") / 4)
    texts = (
        ranged(docs)
        .withColumn("next", F.lead("text").over(w))
        .withColumn("rn", F.row_number().over(w))
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), head.cast("int")), F.substring(F.coalesce("next", F.lit("")), F.lit(1), (F.col("n_chars") - head).cast("int"))))
    )
    both = texts.select("range", "rn", "guest", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("version", "text"))
    made = fingerprints(both.where("guest = 0 or version = 0"), ["range", "rn", "guest", "doc_id", "n_chars", "edited_sha256", "version"])
    w = Window.partitionBy("range").orderBy("rn", "version")
    made = made.withColumn("lanes", signed(F.col("vector"))).withColumn("norm", F.sqrt(dot(F.col("lanes"), F.col("lanes"))))
    follow = [F.lead(c, k).over(w).alias(f"{name}_{c}") for name, k in (("edited", 1), ("next", 2)) for c in ("vector", "lanes", "norm")]
    rows = made.select("*", *follow).where("guest = 0 and version = 0")
    near = lambda other: likeness(*(F.col(c) for v in ("vector", "lanes", "norm") for c in (v, f"{other}_{v}")))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("vector")).alias("fingerprint"),
        as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        near("edited").alias("near_edited"),
        near("next").alias("near_next"),
    )
