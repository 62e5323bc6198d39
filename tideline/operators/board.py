"""The board: profiles with who and what they are about, gates, order, and the bundles of what they were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalar import age_seconds, first_true, rounded
from tideline.operators.market import GRAIN
from tideline.operators.serving import ingestion_gate, serving_gate

WINDOWS = ("L5", "L10", "L20", "season")
#: Seconds up to which a line is served, and what a board row never shows.
HORIZON = 3600
HIDDEN = ("score", "trend", "margin", "agreement", "market_alignment", "line_observed_at")


def bundles(profiles: DataFrame, windows: DataFrame, sources: DataFrame, series: DataFrame, key: str = "profile_id") -> DataFrame:
    """What each profile was made of (V-07): status, windows (a map by their names), sources and series (in order).

    windows(key, window, ...), sources(key, ordinal, source_id, title), series(key, ordinal, ...): children of profiles,
    each grouped once. A profile without windows is unavailable_not_persisted, with nothing else; one with some of
    the four and not all fails the job. Children of other profiles don't count.
    """
    inside = lambda d: d.join(profiles.select(key).distinct(), key, "left_semi")
    row = lambda d, drop: F.struct(*[c for c in d.columns if c not in (key, *drop)])
    ordered = lambda d, name: inside(d).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", row(d, ("ordinal",)).alias("v")))).alias(name))
    w = inside(windows).where(F.col("window").isin(*WINDOWS)).groupBy(key).agg(F.count_distinct("window").alias("__n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("window", row(windows, ("window",)).alias("v"))))).alias("windows"))
    rows = profiles.select(key).join(w, key, "left").join(ordered(sources, "sources"), key, "left").join(ordered(series, "series"), key, "left")
    n = F.coalesce("__n", F.lit(0))
    partial = F.raise_error(F.concat(F.lit("an incomplete set of windows: "), F.col(key).cast("string"))).cast("string")
    rows = rows.withColumn("status", F.when(n == 0, "unavailable_not_persisted").when(n == len(WINDOWS), "available").otherwise(partial))
    there = F.col("status") == "available"
    none = lambda c: F.array().cast(rows.schema[c].dataType)
    plain = lambda c: F.when(there, F.transform(F.coalesce(F.col(c), none(c)), lambda x: x["v"]))
    return rows.select(key, "status", F.when(there, F.col("windows")).alias("windows"), plain("sources").alias("sources"), plain("series").alias("series"))


def board_rows(profiles: DataFrame, players: DataFrame, teams: DataFrame, games: DataFrame, market_rows: DataFrame, observed: DataFrame) -> DataFrame:
    """Each profile with its player, team, opponent, game, newest market row and the newest observation that the profile
    could have seen (V-01). profiles(grain, reference_at, ...), players(player, name, team), teams(team, title, city),
    games(game, home, away, starts_at), market_rows(grain, version, books, low, high), observed(grain, observed_at).

    A profile of an unknown player goes; all else may be missing. Observations after a profile's own reference time don't
    make it any fresher.
    """
    newest = market_rows.groupBy(*GRAIN).agg(F.max(F.struct("version", "books", "low", "high")).alias("__m")).select(*GRAIN, "__m.books", "__m.low", "__m.high")
    seen = profiles.select(*GRAIN, "reference_at").distinct().join(observed.select(*GRAIN, "observed_at"), GRAIN).where("observed_at <= reference_at").groupBy(*GRAIN, "reference_at").agg(F.max("observed_at").alias("line_observed_at"))
    place = lambda name: F.coalesce("city", "title").alias(name)
    rows = profiles.join(players.select("player", "name", F.col("team").alias("__team")), "player").join(games, "game", "left")
    rows = rows.withColumns({"is_home": F.col("home") == F.col("__team"), "__other": F.when(F.col("home") == F.col("__team"), F.col("away")).otherwise(F.col("home"))})
    rows = rows.join(teams.select(F.col("team").alias("__team"), F.col("title").alias("team"), place("team_city")), "__team", "left").join(teams.select(F.col("team").alias("__other"), place("opponent_city")), "__other", "left")
    rows = rows.join(newest, GRAIN, "left").join(seen, [*GRAIN, "reference_at"], "left")
    return rows.withColumns({"team": F.coalesce("team", F.lit("")), "books": F.coalesce("books", F.lit(0))}).drop("__team", "__other", "home", "away")


def board(rows: DataFrame, now: Column, oldest_unresolved: DataFrame, most: int | None = None) -> DataFrame:
    """The rows that are served, in order (V-05): rank, display_age and all of board_rows() but HIDDEN.

    oldest_unresolved(at, readable): one row, the oldest past game without usable results; over 96 hours back, or
    unreadable, nothing is served, and without a row or a time the ingestion is current. Then a row is served whose line is at
    most HORIZON seconds old at `now`. The order is by the size of the score, null last, then the grain. most: a
    report of that many; None: all.
    """
    gate = oldest_unresolved.select(ingestion_gate(age_seconds(now, F.col("at")), F.coalesce("readable", F.lit(True))).alias("__g")).where("__g = 'suppress'").limit(1)
    age = age_seconds(now, F.col("line_observed_at"))
    served = rows.where(serving_gate(age, HORIZON) == "serve").withColumn("display_age", F.greatest(rounded(age, 0), F.lit(0.0)))
    served = served.join(F.broadcast(gate), F.lit(True), "left_anti")
    order = [F.abs(F.col("score")).desc_nulls_last(), *GRAIN]
    served = served.orderBy(*order)
    served = served if most is None else served.limit(most)
    return served.drop(*HIDDEN)


def research_freshness(observed_at: Column, now: Column) -> tuple[Column, Column]:
    """Age in whole seconds, and state: unknown without a time, aged_historical beyond the horizon, else fresh (V-08)."""
    age = F.when(observed_at.isNotNull() & now.isNotNull(), F.greatest(rounded(age_seconds(now, observed_at), 0), F.lit(0.0))).cast("long")
    return age, first_true([(age.isNull(), "unknown"), (age > HORIZON, "aged_historical")], "fresh")


def unmapped(games: DataFrame, events: DataFrame, probe: Column | None = None) -> DataFrame:
    """population and matched event of each unmapped game (D-14): b_discovery_recoverable where one event has both teams, or
    of several the one that is nearest to the probed time alone; else c_unrecoverable. games(game, home, away, in_recent_n,
    probe_at), events(event_id, home, away, at): teams by the names that matched. A game without a team, and an event
    without one, match nothing; an event without a time can't be told from others by it."""
    met = games.select("game", "home", "away", "probe_at").join(events, ["home", "away"])
    far = F.abs(F.unix_micros("at") - F.unix_micros(F.col("probe_at") if probe is None else probe))
    by = met.withColumn("__d", far).groupBy("game").agg(F.count("*").alias("__n"), F.count("__d").alias("__timed"), F.min(F.struct("__d", "event_id")).alias("__first"), F.min("__d").alias("__least"), F.array_sort(F.collect_list("__d")).alias("__all"))
    alone = (F.col("__n") > 1) & (F.col("__timed") == F.col("__n")) & (F.get("__all", F.lit(0)) < F.get("__all", F.lit(1)))
    one = F.coalesce((F.col("__n") == 1) | alone, F.lit(False))
    rows = games.join(by, "game", "left")
    return rows.select("game", "in_recent_n", F.when(one, "b_discovery_recoverable").otherwise("c_unrecoverable").alias("population"), F.when(one, F.col("__first.event_id")).alias("event_id"), F.coalesce("__n", F.lit(0)).alias("candidates"))


def recovery(rows: DataFrame) -> DataFrame:
    """Totals of unmapped() (D-14): games, n_b, n_c, recovery_rate (0 of none) and c_within_recent_n."""
    b, c = F.count_if(F.col("population") == "b_discovery_recoverable"), F.count_if(F.col("population") == "c_unrecoverable")
    n = F.count("*")
    return rows.agg(n.alias("games"), b.alias("n_b"), c.alias("n_c"), F.when(n == 0, 0.0).otherwise(b / n).alias("recovery_rate"), F.count_if((F.col("population") == "c_unrecoverable") & F.col("in_recent_n")).alias("c_within_recent_n"))
