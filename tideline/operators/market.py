"""Current-market operators on quotes(game, player, market, book, side, point, price, observed_at, sportsbook).

GRAIN is the key of nearly every result; all reductions have a map side, and a grain's books are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import age_rounded, first_true, rounded
from tideline.operators.deal import tasks

GRAIN = ["game", "player", "market"]
#: Seconds up to which a market row is fresh, aging, stale; the same for a feed.
ROW_AGES, FEED_AGES = (90, 300, 900), (600, 1800)


def offerings(quotes: DataFrame) -> DataFrame:
    """One row for each grain, book and point with its over and under price (M-01). The latest quote gives a
    side's price; quotes of one time are ordered by price, so that input order doesn't matter."""
    latest = lambda s: F.max(F.when(F.col("side") == s, F.struct("observed_at", "price"))).getField("price")
    return quotes.groupBy(*GRAIN, "book", "point").agg(latest("over").alias("over_price"), latest("under").alias("under_price"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.bool_or("sportsbook").alias("sportsbook"))


def unique_mode(rows: DataFrame, keys: list[str], value: str, voter: str) -> DataFrame:
    """Mode of a value by distinct voters, only where no other value has as many (A-09): keys, mode, votes (of
    the mode), voters, kinds (of values) and ties (values with as many)."""
    votes = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_distinct(voter).alias("n"))
    everyone = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count_distinct(voter).alias("voters"))
    top = votes.groupBy(*keys).agg(F.max(F.struct("n", F.col(value).alias("v"))).alias("top"), F.collect_list("n").alias("ns"), F.min(value).alias("least"), F.count("*").alias("kinds"))
    ties = F.size(F.filter("ns", lambda n: n == F.col("top.n")))
    return top.join(everyone, keys).select(*keys, F.when(ties == 1, F.col("top.v")).alias("mode"), F.col("top.n").alias("votes"), "voters", "kinds", "least", ties.alias("ties"))


def summary(rows: DataFrame, keys: list[str] = GRAIN, point: str = "point", book: str = "book", dealt_by: list[str] | None = None) -> DataFrame:
    """What the quotes of each key say, in two exchanges: line, method and coverage (L-01), books, books_at_line, low and
    high (of sportsbooks' points), one_sided (of all), line_observed_at (of all). First each (key, book, point) becomes one row,
    on the map side already; then keys are dealt out once, by dealt_by (a part of keys, by default all of them)."""
    at, side = (F.col(c) if c in rows.columns else F.lit(None) for c in ("observed_at", "side"))
    priced = F.col("price").isNotNull() if "price" in rows.columns else F.lit(True)
    one = rows.groupBy(*keys, book, point).agg(F.bool_or("sportsbook").alias("__sb"), F.max(at).alias("__at"), F.bool_or((side == "over") & priced).alias("__over"), F.bool_or((side == "under") & priced).alias("__under"))
    votes = F.col("__sb") & F.col(book).isNotNull() & F.col(point).isNotNull()
    points = one.repartition(*(dealt_by or keys)).groupBy(*keys, point).agg(F.count_if(votes).alias("__n"), F.collect_set(F.when(votes, F.col(book))).alias("__books"), F.max("__at").alias("__at"), F.bool_or("__over").alias("__over"), F.bool_or("__under").alias("__under"))
    voted = F.col("__n") > 0
    got = points.groupBy(*keys).agg(
        F.collect_list(F.when(voted, F.struct("__n", F.col(point).alias("point")))).alias("__votes"), F.size(F.array_distinct(F.flatten(F.collect_list("__books")))).cast("long").alias("books"),
        F.min(F.when(voted, F.col(point))).alias("low"), F.max(F.when(voted, F.col(point))).alias("high"), F.max("__at").alias("line_observed_at"), F.bool_or("__over").alias("__over"), F.bool_or("__under").alias("__under"),
    )
    top = F.array_max("__votes")
    ties = F.size(F.filter("__votes", lambda v: v["__n"] == top["__n"]))
    none, single, unique = F.col("books") == 0, F.col("books") == 1, ties == 1
    line = F.when(single, F.col("low")).when(unique & ~none, top["point"])
    method = first_true([(none, "no_eligible_source"), (single, "single_book"), (unique, "unique_modal")], "tied_no_unique_mode")
    coverage = first_true([(none, "no_line"), (single, "single_book"), (unique, "complete")], "unresolved_consensus")
    over, under = F.coalesce("__over", F.lit(False)), F.coalesce("__under", F.lit(False))
    return got.select(*keys, line.alias("line"), method.alias("method"), coverage.alias("coverage"), "books", F.when(line.isNotNull(), top["__n"]).alias("books_at_line"), "low", "high", one_sided(over, under).alias("one_sided"), "line_observed_at")


def consensus(rows: DataFrame, keys: list[str] = GRAIN, point: str = "point", book: str = "book", spine: DataFrame | None = None) -> DataFrame:
    """Line consensus among sportsbooks (L-01): line, method and coverage. One book: its least point; else the
    unique mode; a tie gives no line. Keys without a sportsbook, those of the spine too, have no_eligible_source."""
    got = summary(rows, keys, point, book).select(*keys, "line", "method", "coverage", "books")
    if spine is None:
        return got
    filled = {"method": "no_eligible_source", "coverage": "no_line", "books": 0}
    return spine.select(*keys).distinct().join(got, keys, "left").fillna(filled)


def line_range(rows: DataFrame, keys: list[str] = GRAIN) -> DataFrame:
    return rows.where("sportsbook").groupBy(*keys).agg(F.min("point").alias("low"), F.max("point").alias("high"))


def distribution(rows: DataFrame, keys: list[str] = GRAIN) -> DataFrame:
    """Distinct books at each point, ascending (L-03)."""
    return rows.where("sportsbook").groupBy(*keys, "point").agg(F.count_distinct("book").alias("book_count"))


def distribution_array(rows: DataFrame, keys: list[str] = GRAIN) -> DataFrame:
    return distribution(rows, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("point", "book_count"))).alias("distribution"))


def first_observed(quotes: DataFrame, keys: list[str] = GRAIN) -> DataFrame:
    """Consensus over each book's earliest point, and when a book first had it (L-05). Keys are dealt out once, to as many
    tasks as there are rows for; all that follows happens within a key."""
    rows = quotes.where("sportsbook")
    first = rows.repartition(tasks(rows), *keys).groupBy(*keys, "book").agg(F.min(F.struct("observed_at", "point")).alias("f"))
    point = F.col("f.point")
    votes = F.count_if(F.col("book").isNotNull() & point.isNotNull())
    points = first.groupBy(*keys, point.alias("point")).agg(votes.alias("n"), F.min("f.observed_at").alias("at"))
    voted = F.when(F.col("n") > 0, F.struct("n", "point", "at"))
    got = points.groupBy(*keys).agg(F.max(voted).alias("top"), F.collect_list(F.when(F.col("n") > 0, F.col("n"))).alias("ns"), F.sum("n").alias("books"))
    none, single, unique = F.col("books") == 0, F.col("books") == 1, F.size(F.filter("ns", lambda n: n == F.col("top.n"))) == 1
    method = first_true([(none, "no_eligible_source"), (single, "single_book"), (unique, "unique_modal")], "tied_no_unique_mode")
    line = lambda c: F.when(unique & ~none, F.col(f"top.{c}"))
    return got.select(*keys, line("point").alias("line"), method.alias("method"), line("at").alias("first_at"))


def one_sided(over: Column, under: Column) -> Column:
    """over_only, under_only, neither; null where no price is known (M-02). For aggregated flags."""
    return F.when(over & ~under, "over_only").when(under & ~over, "under_only").when(over & under, "neither")


def book_detail(offered: DataFrame, keys: list[str] = GRAIN) -> DataFrame:
    detail = F.array_sort(F.collect_list(F.struct("book", "point", "over_price", "under_price")))
    return offered.groupBy(*keys).agg(detail.alias("detail"), one_sided(F.bool_or(F.col("over_price").isNotNull()), F.bool_or(F.col("under_price").isNotNull())).alias("one_sided"))


def best_price(quotes: DataFrame) -> DataFrame:
    """Greatest price at each grain, point and side among sportsbooks, its first book, and all books (M-03)."""
    return quotes.where("sportsbook").groupBy(*GRAIN, "point", "side").agg(F.max("price").alias("best_price"), F.min(F.struct(-F.col("price"), "book")).getField("book").alias("best_book"), F.count_distinct("book").alias("books"))


def freshness(age: Column, available: Column, poll_failed: Column, ages: tuple[int, ...] = ROW_AGES) -> Column:
    """Of a market row (M-04): an unavailable source and a failed poll come before any age."""
    bands = list(zip(ages, ("fresh", "aging", "stale"), strict=False))
    return first_true([(~available, "unavailable"), (poll_failed, "failed_latest_poll"), (age.isNull(), "unavailable"), *((age <= a, name) for a, name in bands)], "unavailable")


def feed_freshness(age: Column, poll_failed: Column) -> Column:
    """Of a feed's own timestamp (M-10); one in the future is fresh."""
    return first_true([(poll_failed, "failed_latest_poll"), (age.isNull(), "unavailable"), (age <= FEED_AGES[0], "fresh"), (age <= FEED_AGES[1], "aging")], "stale")


def freshness_v2(books: Column, age: Column) -> Column:
    """E-17: no book comes before any age."""
    return first_true([(books == 0, "absent"), (age <= 900, "fresh"), (age <= 1800, "aging"), (age <= 3600, "stale_present")], "beyond_horizon")


def market_row(quotes: DataFrame, spine: DataFrame | None, now: Column, gated: bool = True, keys: list[str] = GRAIN) -> DataFrame:
    """The current row of each grain of the spine, or of the quotes if that is None (M-05 to M-08): freshness from the
    latest quote; gated: a row that is neither fresh nor aging keeps its grain but loses its line (v1); not gated: as it
    is (v2)."""
    rows = summary(quotes, keys)
    if spine is not None:
        rows = spine.select(*keys).distinct().join(rows, keys, "left")
    rows = rows.withColumn("freshness", freshness(age_rounded(now, F.col("line_observed_at")), F.lit(True), F.lit(False), ROW_AGES))
    usable = F.col("freshness").isin("fresh", "aging") if gated else F.lit(True)
    kept = {c: F.when(usable, F.col(c)) for c in ("line", "method", "coverage", "books", "low", "high")}
    return rows.withColumns(kept).fillna({"method": "no_eligible_source", "coverage": "no_line", "books": 0}).select(*keys, "freshness", "line_observed_at", "line", "method", "coverage", "books", "low", "high")


def movement_summary(current: DataFrame, first: DataFrame, events: DataFrame, keys: list[str] = GRAIN) -> DataFrame:
    """Net change of the line and counts of events by type (L-06)."""
    kinds = ("side_added", "side_removed", "point_changed", "over_price_changed", "under_price_changed")
    counts = events.groupBy(*keys).agg(*[F.count_if(F.col("type") == k).alias(k) for k in kinds])
    net = rounded(F.col("line") - F.col("first_line"), 2)
    both = current.select(*keys, "line").join(first.select(*keys, F.col("line").alias("first_line")), keys, "left").join(counts, keys, "left")
    return both.select(*keys, net.alias("net"), *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def collapse_duplicates(rows: DataFrame, group: list[str], line: list[str]) -> DataFrame:
    """Duplicate collapse (D-04): rows of one group with over one price are quarantined whole; else they are one
    row. State: multi_line where a line (player, side) has several points, else which sides a point has."""
    point = [c for c in group if c != "side"]
    got = rows.groupBy(*group).agg(F.count("*").alias("duplicates"), (F.min("price").eqNullSafe(F.max("price"))).cast("int").alias("__one"), F.count("price").alias("__priced"), F.min("price").alias("price"))
    got = got.withColumn("prices", F.when(F.col("__priced") == 0, 0).when(F.col("__one") == 1, 1).otherwise(2))
    both = [c for c in line if c in point]  # dealt by what both windows have, once
    got = got.repartition(*both) if both else got
    good = F.col("prices") == 1
    points = F.size(F.collect_set(F.when(good, F.col("point"))).over(Window.partitionBy(*line)))
    sides = F.array_sort(F.collect_set(F.when(good, F.col("side"))).over(Window.partitionBy(*point)))
    state = first_true([(~good, "quarantined"), (points > 1, "multi_line"), (F.size(sides) == 2, "two_sided_complete"), (sides[0] == "over", "over_only")], "under_only")
    return got.select(*group, "duplicates", F.when(good, F.col("price")).alias("price"), state.alias("state"))
