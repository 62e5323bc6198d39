"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Names, numbers and units of a text become typed placeholders; punctuation and case go. Windows of five template
words are hashed and joined with those of the benchmark. A document that holds at least `share` of an item's
windows is a candidate. Windows that lie as far apart as in the item, but for up to DRIFT words, are a run; one that
holds `share` of the windows by itself is a leak if the placeholders of its windows are filled consistently (one value
of the item always by one value of the document, and the other way round), as in a re-parameterised question. Windows with fewer than two words that are not placeholders say nothing and are not used. An item without
any other window is met by windows of its plain words, values included; one of fewer than five words by the whole
lines that consist of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, materialise

#: Units that may follow a number.
UNITS = "km|m|cm|mm|mi|miles|ft|feet|in|inch|inches|kg|g|mg|lb|lbs|oz|tons?|l|ml|litres?|liters?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|mph|kmh|usd|eur|dollars?|euros?|cents?|percent|degrees?|celsius|fahrenheit"
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
#: Benchmark windows up to this many are broadcast (about 40 bytes each); more are joined by a shuffle, with one result.
MOST_BROADCAST = 250_000
#: Words that may be put in or left out within a run.
DRIFT = 4


def marked(text: Column) -> Column:
    """The words of a text without punctuation, each name, number and unit with its mark before it."""
    s = F.regexp_replace(text, "[\u0001-\u0003]", " ")
    s = F.regexp_replace(s, r"(?<=[\p{L}\p{N},][ \t])(\p{Lu}\p{Ll}+)", f"{NAME}$1")
    s = F.regexp_replace(s, r"(?<![\p{L}\p{N}])(\d(?:[\d.,]*\d)?)", f"{NUMBER}$1")
    s = F.regexp_replace(s, rf"({NUMBER}[\d.,]+)[ \t]?((?i:{UNITS}))(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    s = F.regexp_replace(s, r"[\p{P}\p{S}](?!\d)", "")
    return F.filter(F.split(s, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def template(words: Column) -> Column:
    """The words with marked values left out, in lower case."""
    return F.transform(words, lambda w: F.when(w < F.lit("\u0004"), F.substring(w, 1, 1)).otherwise(F.lower(w)))


def plain(words: Column) -> Column:
    """The words without their marks, in lower case."""
    return F.transform(words, lambda w: F.lower(F.translate(w, NAME + NUMBER + UNIT, "")))


def windows(rows: DataFrame, keys: list[str], text: str, at: str, telling: bool = False, values: bool = False) -> DataFrame:
    """keys, h (hash) and the place `at` of each window; telling: of those that are used; values: of the words as they
    are and not of the template."""
    form = plain if values else template
    words = rows.select(*keys, form(marked(F.coalesce(F.col(text), F.lit("")))).alias("__w"))
    n = SHINGLE_WORDS
    # A hash of each word first: windows then are of numbers. Placeholders are 1 to 3.
    hashed = words.select(*keys, F.transform("__w", lambda w: F.when(w < F.lit("\u0004"), F.ascii(w).cast("long")).otherwise(F.xxhash64(w))).alias("__h"))
    shape = lambda i: [F.get("__h", i + k) for k in range(n)]
    starts = F.when(F.size("__h") >= n, F.sequence(F.lit(0), F.size("__h") - n)).otherwise(F.array().cast("array<int>"))
    h = lambda i: F.xxhash64(*shape(i))
    if not telling:
        return hashed.select(*keys, F.posexplode(F.transform(starts, h)).alias(at, "h"))
    words_in = lambda i: sum((F.when(x.between(1, 3), 0).otherwise(1) for x in shape(i)), F.lit(0))
    return hashed.select(*keys, F.posexplode(F.transform(starts, lambda i: F.when(words_in(i) >= 2, h(i)))).alias(at, "h")).where("h is not null")


def small(df: DataFrame, n: int) -> DataFrame:
    """df with a hint to broadcast it if n rows are few enough."""
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def unmet(items: DataFrame, asked: DataFrame) -> DataFrame:
    """The items that have no usable window."""
    some = asked.select(F.col("item_id").alias("i"), F.col("item_tie").alias("t")).distinct()
    return items.join(some, items.item_id.eqNullSafe(F.col("i")) & (F.col("item_tie") == F.col("t")), "left_anti")


def hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each place of a text (at) that holds a window (item_at) of an item: doc_id, tie, item_id, item_tie, item_at, at;
    and the items' windows."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    asked = materialise(windows(items, ["item_id", "item_tie"], "text", "item_at", telling=True))
    other = materialise(windows(unmet(items, asked), ["item_id", "item_tie"], "text", "item_at", values=True))
    found = windows(keyed, ["doc_id", "tie"], "text", "at").join(small(asked, asked.count()), "h")
    if n := other.count():
        found = found.union(windows(keyed, ["doc_id", "tie"], "text", "at", values=True).join(small(other, n), "h"))
    return found, asked.union(other)


def short_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """leaks() of the items of one to four words: whole lines of the same words."""
    named = lambda text: F.xxhash64(F.array_join(plain(marked(text)), " "))
    some = materialise(items.withColumn("__n", F.size(marked(F.coalesce("text", F.lit(""))))).where(F.col("__n").between(1, SHINGLE_WORDS - 1)).select("item_id", named(F.col("text")).alias("h")))
    lines = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.explode(F.split("text", "\n")).alias("__l")) if (n := some.count()) else docs.select("doc_id", F.lit(0).cast("long").alias("tie"), F.lit("").alias("__l")).limit(0)
    met = lines.select("doc_id", "tie", named(F.col("__l")).alias("h")).join(small(some, n), "h")
    return met.select("doc_id", "tie", "item_id", F.lit(1.0).alias("found"), F.lit(True).alias("exact")).distinct()


def leaks(docs: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """doc_id, tie, item_id, found (share of the item's windows) and exact (no value differs) of each leak."""
    items = items.select("item_id", "text").distinct().withColumn("item_tie", F.xxhash64("text"))
    met, asked = hits(docs, items)
    sizes = asked.groupBy("item_id", "item_tie").agg(F.count_distinct("item_at").alias("windows"))
    pair = ["doc_id", "tie", "item_id", "item_tie"]
    place = F.struct((F.col("at") - F.col("item_at")).alias("shift"), "item_at")
    near = met.groupBy(*pair).agg(F.count_distinct("item_at").alias("n"), F.collect_set(place).alias("places"))
    sizes = sizes.select(F.col("item_id").alias("i"), F.col("item_tie").alias("t"), "windows")
    near = near.join(small(sizes, asked.count()), near.item_id.eqNullSafe(F.col("i")) & (near.item_tie == F.col("t"))).drop("i", "t").where(F.col("n") >= share * F.col("windows"))
    by_shift = near.select(*pair, "windows", F.explode("places").alias("p")).groupBy(*pair, "windows", F.col("p.shift").alias("shift")).agg(F.collect_set("p.item_at").alias("ats"))
    around = Window.partitionBy(*pair).orderBy("shift").rangeBetween(-DRIFT, DRIFT)
    runs = by_shift.withColumn("run", F.collect_list(F.struct("shift", "ats")).over(around))
    runs = runs.withColumn("n", F.size(F.array_distinct(F.flatten(F.transform("run", lambda r: r.ats))))).where(F.col("n") >= share * F.col("windows"))
    near = materialise(runs.groupBy(*pair, "windows").agg(F.max("n").alias("n"), F.collect_set("run").alias("runs")))
    # The words of candidate documents and items: keys with a null id are met by the hash of the text alone.
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("tie"), "text").join(near.select(F.col("doc_id").alias("d"), "tie").distinct(), ["tie"], "left_semi").dropDuplicates(["d", "tie"])
    asks = items.select(F.col("item_id").alias("i"), "item_tie", F.col("text").alias("item_text"))
    pairs = near.join(texts, (near.tie == texts.tie) & near.doc_id.eqNullSafe(F.col("d"))).drop(texts.tie).join(asks, (near.item_tie == asks.item_tie) & near.item_id.eqNullSafe(F.col("i"))).drop(asks.item_tie)
    # Written, so that the words are not made anew for each place of an alignment.
    pairs = materialise(pairs.select("doc_id", "tie", "item_id", "n", "windows", "runs", marked(F.col("text")).alias("w"), marked(F.col("item_text")).alias("v")))

    def slots(run: Column) -> Column:
        """(value of the item, value of the document) at the placeholders of a run's windows."""
        word = lambda at, k, s: F.struct(F.get("v", at + k).alias("x"), F.get("w", at + k + s).alias("y"))
        window = lambda at, s: F.array(*[word(at, k, s) for k in range(SHINGLE_WORDS)])
        both = F.flatten(F.transform(run, lambda r: F.flatten(F.transform(r.ats, lambda at: window(at, r["shift"])))))
        return F.filter(F.array_distinct(both), lambda p: (p.x < F.lit("\u0004")) & (F.substring(p.x, 1, 1) == F.substring(p.y, 1, 1)))

    def consistent(got: Column) -> Column:
        one = lambda f: F.size(F.array_distinct(F.transform(got, f))) == F.size(got)
        return one(lambda p: p.x) & one(lambda p: p.y)

    filled = pairs.withColumn("filled", F.filter(F.transform("runs", slots), consistent))
    fine = filled.where(F.size("filled") > 0)
    exact = F.exists("filled", lambda got: F.forall(got, lambda p: p.x == p.y))
    return fine.select("doc_id", "tie", "item_id", (F.col("n") / F.col("windows")).alias("found"), exact.alias("exact")).union(short_leaks(docs, items))


def contaminated(docs: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """doc_id, contaminated, n_items and item_ids (ascending) of each row of docs.

    Null and empty texts hold nothing, and null and empty items are never found. A text of any length is judged
    whole, and one that repeats an item is judged at each place: its places are one row's work, as many as it has
    windows. A share equal to `share` is a leak. Items that are equal but for their ids are found alike. Rows with a null doc_id are judged; a null item_id counts in n_items and is left out of item_ids. Repeated
    rows come out as often as they come in; other columns are ignored; an empty table gives an empty result,
    and with an empty benchmark nothing is contaminated.
    """
    found = leaks(docs, items, share).groupBy(F.col("doc_id").alias("d"), F.col("tie").alias("t")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n_items"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie")).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    return rows.select("doc_id", F.col("t").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))


def keep_clean(docs: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    found = leaks(docs, items, share).select(F.col("doc_id").alias("__d"), F.col("tie").alias("__t")).distinct()
    return docs.join(found, docs.doc_id.eqNullSafe(F.col("__d")) & (F.xxhash64(docs.text) == F.col("__t")), "left_anti")
