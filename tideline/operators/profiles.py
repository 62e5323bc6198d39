"""Evidence profiles from raw tables: the input of the engine for all grains at once, and both engines.

Quotes are reduced to a row for each (grain, book, point) first; then everything is dealt by (player, market) once: the
market row of each grain, the results of a player and the windows over them need no further exchange, as a grain lies
within its player and market. Game and player facts are dimensions. One reference time holds for all grains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalar import age_rounded, age_seconds, first_true
from tideline.operators import evidence, history, market

GRAIN = market.GRAIN
#: Suffixes of a window's columns in a profile's input.
SUFFIX = {"L5": "5", "L10": "10", "L20": "20", "season": "s"}


def grains(quotes: DataFrame, keys: list[str] = GRAIN) -> DataFrame:
    """The distinct grains (E-22)."""
    return quotes.select(*keys).distinct()


def source_identity(quotes: DataFrame, keys: list[str] = GRAIN, book: str = "book", title: str = "title") -> DataFrame:
    """The distinct (id, title) of each grain's sources, by id (E-21)."""
    return quotes.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(F.col(book).alias("id"), F.col(title).alias("title")))).alias("sources"))


def latest_results(results: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each game's result (W-01), as an aggregate: at and value by player, market and game."""
    newest = F.max(F.struct("version", "at", "value"))
    return results.groupBy(*keys, "game").agg(newest.alias("__v")).select(*keys, F.col("game").alias("played"), F.col("__v.at").alias("at"), F.col("__v.value").alias("value"))


def inputs(quotes: DataFrame, results: DataFrame, players: DataFrame, games: DataFrame, now: Column, gated: bool, normalisers: dict[str, float] | None = None) -> DataFrame:
    """The input of the engine for each grain of quotes in a known market (E-19).

    quotes(game, player, market, book, side, point, price, observed_at, sportsbook); results(player, market, game, at,
    value, version); players(player, player_resolved); games(game, game_status, event_resolved, starts_at). The line
    is the consensus, or 0 without one (no rule looks at it then). Windows are of results of games before the grain's own
    start (all, if that isn't known), newest first, the same instant by game. gated (the first engine): quotes count
    only where the newest is fresh or aging at `now`; else (the second) all count. Players and games that aren't there
    are unresolved. A grain without results has empty windows.
    """
    normalisers = evidence.NORMALISERS if normalisers is None else normalisers
    m = F.create_map(*[F.lit(x) for kv in normalisers.items() for x in kv])
    by = ["player", "market"]
    rows = market.summary(quotes.where(F.col("market").isin(*normalisers)), GRAIN, dealt_by=by)
    age = age_rounded(now, F.col("line_observed_at"))
    rows = rows.withColumns({"freshness": market.freshness(age, F.lit(True), F.lit(False)), "age": age_seconds(now, F.col("line_observed_at"))})
    if gated:
        usable = F.col("freshness").isin("fresh", "aging")
        rows = rows.withColumns({c: F.when(usable, F.col(c)) for c in ("line", "low", "high", "one_sided", "books_at_line")} | {"books": F.when(usable, F.col("books")).otherwise(F.lit(0))})
    rows = rows.withColumnRenamed("line", "consensus").join(games, "game", "left").join(players, "player", "left")
    past = latest_results(results.repartition(*by), by).withColumnRenamed("player", "__player").withColumnRenamed("market", "__market")
    both = rows.withColumn("line", F.coalesce("consensus", F.lit(0.0))).join(past, (F.col("player") == F.col("__player")) & (F.col("market") == F.col("__market")) & F.coalesce(F.col("at") < F.col("starts_at"), F.lit(True)), "left")
    facts = [c for c in rows.columns if c not in GRAIN] + ["line"]
    # One row of the grain's own facts rides along; the windows are aggregates of the same grouping.
    w = history.threshold_windows(both, GRAIN, [F.desc("at"), F.desc("played")], F.col("value"), F.col("line"), list(history.WINDOWS), extra=[F.first(c).alias(c) for c in facts] + [F.min("at").alias("earliest")])
    made = {"m": m[F.col("market")], "net": F.lit(None).cast("double"), "span_days": F.datediff(now, F.col("earliest"))}
    for k, s in SUFFIX.items():
        win = F.col(k)
        made |= {f"a{s}": win["above"], f"b{s}": win["below"], f"e{s}": win["equal"], f"n{s}": win["n"], f"avg{s}": win["avg_minus"], f"med{s}": win["median_minus"]}
    made |= {"player_resolved": F.coalesce("player_resolved", F.lit(False)), "event_resolved": F.coalesce("event_resolved", F.lit(False))}
    return w.withColumns(made).drop(*SUFFIX)


def engine_v1(rows: DataFrame) -> DataFrame:
    """Profiles by the freshness of the market row (E-16), from inputs(gated=True); a row without books is no market,
    however fresh, so that no profile is scored against the placeholder line."""
    return profiles(rows.withColumn("freshness", F.when(F.col("books") == 0, "unavailable").otherwise(F.col("freshness"))))


def engine_v2(rows: DataFrame) -> DataFrame:
    """Profiles by the age of the line at the reference time (E-18), from inputs(gated=False): unrounded, and none where
    the line is younger than that; a line without a time is beyond the horizon. Grains beyond the horizon give no row; a grain without books is unavailable whatever
    its age."""
    branch = market.freshness_v2(F.col("books"), F.greatest(F.coalesce("age", F.lit(float("inf"))), F.lit(0.0)))
    verdict = first_true([(F.col("branch") == "absent", "unavailable"), (F.col("branch") == "stale_present", "stale")], "fresh")
    return profiles(rows.withColumn("branch", branch).where("branch <> 'beyond_horizon'").withColumn("freshness", verdict))


def profiles(rows: DataFrame) -> DataFrame:
    """The profile of each row of inputs(), null where there is nothing to say (E-14): an unavailable one has no line, which
    an insufficient one keeps; market_alignment is the market's component."""
    made = evidence.reasons(evidence.profile(rows.withColumnRenamed("market", "of")))
    line = F.when(F.col("classification") != "unavailable", F.col("line"))
    return made.select("game", "player", F.col("of").alias("market"), line.alias("line"), "trend", "margin", "agreement", F.col("market").alias("market_alignment"), "score", "classification", "direction", "quality_capped", "cap", "cause", "reasons", "freshness", "books", "n10", "ns", "earliest")


def series_outcomes(series: DataFrame, evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """Every game of a series with its outcome against the line where it was evaluated (E-19's series): evaluated has
    keys, game and outcome. History.mismatches() tells where the two disagree."""
    return series.join(evaluated.select(*keys, "game", "outcome"), [*keys, "game"], "left")
