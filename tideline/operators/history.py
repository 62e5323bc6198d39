"""Closing lines, graded results and windows over a player's latest games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import age_rounded, first_true, rounded
from tideline.operators.market import summary
from tideline.operators.prefix import ranged

#: Seconds after the scheduled start that a line still closes, and that a snapshot may be old.
GRACE, STALE_AFTER = 900, 600
WINDOWS = {"L5": 5, "L10": 10, "L20": 20, "season": None}


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key (W-01). Catalyst turns the filter on row_number into a partial top-1."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def close_boundary(status: Column, scheduled: Column, actual: Column) -> tuple[Column, Column]:
    """Where the boundary is from, and the boundary (H-01)."""
    off = status.isin("postponed", "canceled")
    source = first_true([(off, "none"), (actual.isNotNull(), "actual_start")], "scheduled_plus_grace")
    at = F.when(~off, F.coalesce(actual, scheduled + F.make_interval(secs=F.lit(GRACE))))
    return source, at


def capture_state(snapshot: Column, boundary: Column) -> Column:
    """H-02: no snapshot, one after the boundary or too old, or eligible."""
    return first_true([(snapshot.isNull(), "no_snapshot"), (snapshot > boundary, "close_capture_stale"), (age_rounded(boundary, snapshot) > STALE_AFTER, "close_capture_stale")], "eligible")


def closing_points(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Canonical closing point (H-04, H-05) of quotes(keys, book, point, eligible); a tie gives none."""
    got = summary(quotes.select(*keys, "book", "point", F.col("eligible").alias("sportsbook")), keys)
    named = {"no_line": "no_closing_line", "unresolved_consensus": "unresolved_closing_consensus"}
    return got.select(*keys, F.col("line").alias("closing_point"), "method", F.col("coverage").alias("coverage"), "books", F.col("books_at_line").alias("books_at_point")).replace(named, subset=["coverage"])


def line_result(stat: Column, point: Column) -> tuple[Column, Column]:
    """Margin to two places and outcome over, under or push (H-06); null without either number."""
    margin = rounded(stat - point, 2)
    return margin, F.when(margin > 0, "over").when(margin < 0, "under").when(margin == 0, "push")


def numbered(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rn: 1 for the newest game of a key (W-02, W-03)."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def judged(rows: DataFrame, keys: list[str], order: list[Column], outcome: Column, counts: Column) -> DataFrame:
    """Rows with __rn (1 for the newest that counts), __o (its outcome) and __first (the newest outcome of the key).
    Rows that don't count come last and have no outcome, so a key stays even if none does."""
    w = Window.partitionBy(*keys).orderBy(F.col("__none"), *order)
    return rows.withColumns({"__none": ~F.coalesce(counts, F.lit(False)), "__o": F.when(counts, outcome)}).withColumns({"__rn": F.row_number().over(w), "__first": F.first("__o").over(w)})


def inside(n: int | None) -> Column:
    """Whether a row of judged() is in the window of the newest n."""
    return ~F.col("__none") & (F.lit(True) if n is None else F.col("__rn") <= n)


def run_of(rows: Column, frozen: str | None = None) -> Column:
    """Length of the run of the newest outcome within a window of so many rows (W-04), null without any; one that begins
    with `frozen` has length 1. For an aggregation of judged() rows."""
    run = F.least(F.coalesce(F.min(F.when(F.col("__o") != F.col("__first"), F.col("__rn"))) - 1, rows), rows)
    run = run if frozen is None else F.when(F.first("__first") == frozen, F.lit(1)).otherwise(run)
    return F.when(rows > 0, run).cast("long")


def centre(x: Column, c: Column) -> tuple[Column, Column]:
    """Mean (summed in the rows' order) and median of x over rows that meet c, to four places; null without any."""
    return rounded(F.sum(F.when(c, x)) / F.count_if(c), 4), rounded(F.percentile(F.when(c, x), 0.5), 4)


def threshold_windows(rows: DataFrame, keys: list[str], order: list[Column], value: Column, threshold: Column, names: list[str] = tuple(WINDOWS), extra: list[Column] = ()) -> DataFrame:
    """A struct for each window of each key (H-09 to H-11): n, requested, above, equal and below the threshold, avg,
    median, avg_minus and median_minus (to four places), streak_of, streak and label (no_data, incomplete or complete).

    Values are compared as they are; only what is averaged is rounded. The threshold is the same for all rows of a key. Rows
    with a null value don't count; a key without others has n 0 and nulls. extra: further aggregates of the same grouping.
    """
    made = judged(rows.withColumns({"__v": value, "__t": threshold}), keys, order, first_true([(value > threshold, "above"), (value < threshold, "below")], "equal"), value.isNotNull())
    aggregates = []
    for k in names:
        c, v, t = inside(WINDOWS[k]), F.col("__v"), F.first("__t")
        n, (avg, med) = F.count_if(c), centre(v, c)
        requested = n if WINDOWS[k] is None else F.lit(WINDOWS[k]).cast("long")
        label = first_true([(n == 0, "no_data"), (n < requested, "incomplete")], "complete")
        counts = [F.count_if(c & (F.col("__o") == o)).alias(o) for o in ("above", "equal", "below")]
        aggregates.append(F.struct(n.alias("n"), requested.alias("requested"), *counts, avg.alias("avg"), med.alias("median"), rounded(avg - t, 4).alias("avg_minus"), rounded(med - t, 4).alias("median_minus"), F.first("__first").alias("streak_of"), run_of(n).alias("streak"), label.alias("label")).alias(k))
    return made.groupBy(*keys).agg(*aggregates, *extra)


def evaluated(rows: DataFrame, keys: list[str], order: list[Column], value: Column, threshold: Column) -> DataFrame:
    """The games that a threshold window was counted over, one row each: number (1 for the newest) and outcome."""
    made = judged(rows, keys, order, first_true([(value > threshold, "above"), (value < threshold, "below")], "equal"), value.isNotNull())
    return made.where(~F.col("__none")).withColumns({"number": F.col("__rn"), "outcome": F.col("__o")}).drop("__none", "__rn", "__o", "__first")


def real_line_windows(rows: DataFrame, keys: list[str], order: list[Column], names: list[str] = tuple(WINDOWS)) -> DataFrame:
    """A struct for each window of graded results (H-08): n, requested, over, under and push counts, over_rate, mean and
    median of margin and value (to four places), streak_of, streak (a push is a run of its own) and label (incomplete,
    single_book, no_closing_line or complete). rows(keys, outcome, margin, value, single_book): margin as it was graded."""
    made = judged(rows, keys, order, F.col("outcome"), F.col("outcome").isNotNull())
    aggregates = []
    for k in names:
        c = inside(WINDOWS[k])
        n, requested = F.count_if(c), F.lit(WINDOWS[k]).cast("long")
        over, under, push = (F.count_if(c & (F.col("__o") == o)) for o in ("over", "under", "push"))
        rate = F.when(over + under > 0, rounded(over / (over + under), 4))
        single = F.coalesce(F.bool_or(c & F.col("single_book")), F.lit(False))
        short = F.coalesce(n < requested, F.lit(False))
        label = first_true([(short, "incomplete"), (single, "single_book"), (n == 0, "no_closing_line")], "complete")
        (avg_m, med_m), (avg_v, med_v) = centre(F.col("margin"), c), centre(F.col("value"), c)
        aggregates.append(F.struct(n.alias("n"), F.coalesce(requested, n).alias("requested"), over.alias("over"), under.alias("under"), push.alias("push"), rate.alias("over_rate"), avg_m.alias("avg_margin"), med_m.alias("median_margin"), avg_v.alias("avg_value"), med_v.alias("median_value"), F.first("__first").alias("streak_of"), run_of(n, "push").alias("streak"), label.alias("label")).alias(k))
    return made.groupBy(*keys).agg(*aggregates)


def one_each(windows: DataFrame, keys: list[str], names: list[str] = tuple(WINDOWS)) -> DataFrame:
    """A row for each window instead of a column."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("window"), F.col(k).alias("__w")) for k in names]))
    return windows.select(*keys, rows.alias("__x")).select(*keys, "__x.window", "__x.__w.*")


def series(games: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Every game, with the value only where a usable result matches (H-16, J-05)."""
    usable = results.select(*keys, "value", F.lit(True).alias("__hit"))
    return games.join(usable, keys, "left").withColumn("eligible", F.coalesce("__hit", F.lit(False))).drop("__hit")


def affected(changes: DataFrame, stats: DataFrame) -> DataFrame:
    """(game, player) pairs that a changed stat, game or player touches (H-19)."""
    of = lambda kind, column: stats.join(changes.where(F.col("kind") == kind).select(F.col("entity").alias(column)), column, "left_semi").select("game", "player")
    return of("stat", "stat_id").union(of("game", "game")).union(of("player", "player")).distinct()


def merge_versions(current: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Upsert (S-11, S-12): the rows after it, with action inserted, updated, unchanged or kept."""
    c = current.select(*keys, *[F.col(v).alias(f"__old_{v}") for v in values], F.lit(True).alias("__c"))
    i = incoming.select(*keys, *values, F.lit(True).alias("__i"))
    both = c.join(i, keys, "full")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"__old_{v}"))
    action = first_true([(F.col("__c").isNull(), "inserted"), (F.col("__i").isNull(), "kept"), (same, "unchanged")], "updated")
    return both.select(*keys, *[F.when(F.col("__i"), F.col(v)).otherwise(F.col(f"__old_{v}")).alias(v) for v in values], action.alias("action"))


def nearest_ranks(rows: DataFrame, counts: DataFrame, key: str, value: str, shares: dict[str, float], ranges: int | None = None) -> DataFrame:
    """Values at rank floor(p n), from 0, of each key (A-14), null first. counts(key, n). Values are dealt by ranges, whose
    counts tell which of them holds a rank; only those are numbered, each apart, so no task sees a key's whole column."""
    parts = ranged(rows.select(key, value), value, ranges)
    w = Window.partitionBy(key).orderBy("__range")
    held = parts.groupBy(key, "__range").agg(F.count("*").alias("__k")).withColumn("__upto", F.sum("__k").over(w)).join(counts.select(key, F.col("n").alias("__n")), key)
    ranks = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.least(F.col("__n"), F.floor(F.lit(p) * F.col("__n")) + 1).alias("rank")) for c, p in shares.items()]))
    wanted = held.select(key, "__range", "__k", "__upto", ranks.alias("r")).where((F.col("r.rank") > F.col("__upto") - F.col("__k")) & (F.col("r.rank") <= F.col("__upto")))
    wanted = wanted.select(key, "__range", F.col("r.name").alias("__name"), (F.col("r.rank") - F.col("__upto") + F.col("__k")).alias("__rn"))
    inside = parts.join(wanted.select(key, "__range").distinct(), [key, "__range"], "left_semi")
    numbers = inside.withColumn("__rn", F.row_number().over(Window.partitionBy(key, "__range").orderBy(value)).cast("long"))
    found = wanted.join(numbers, [key, "__range", "__rn"])
    return found.groupBy(key).agg(*[F.max(F.when(F.col("__name") == c, F.col(value))).alias(c) for c in shares])


def strip(rows: DataFrame, keys: list[str], newest_first: list[Column], eligible: Column, n: int) -> DataFrame:
    """The newest rows of each key down to the n-th eligible one, with all between (W-17)."""
    w = Window.partitionBy(*keys).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(eligible, 1).otherwise(0)).over(w), F.lit(0))
    return rows.withColumn("__before", before).where(F.col("__before") < n).drop("__before")


def mismatches(series: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Where a series' eligibility and the presence of an outcome disagree (H-17): keys and violation."""
    s = series.select(*keys, F.coalesce("eligible", F.lit(False)).alias("__e"), F.lit(True).alias("__s"))
    both = s.join(outcomes.select(*keys, F.lit(True).alias("__o")), keys, "full")
    said = first_true([(F.col("__s").isNull(), "outcome_without_game"), (F.col("__e") & F.col("__o").isNull(), "eligible_without_outcome"), (~F.col("__e") & F.col("__o").isNotNull(), "outcome_of_ineligible")], None)
    return both.select(*keys, said.alias("violation")).where("violation IS NOT NULL")
