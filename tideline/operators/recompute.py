"""Incremental recomputation: a queue of changes to the derived tables they touch, equal to computing all anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.history import line_result, real_line_windows

PAIR, RESULT = ["game", "player"], ["game", "player", "market"]
USABLE = ("complete", "single_book")


def oldest(queue: DataFrame, most: int | None) -> DataFrame:
    """The unprocessed changes, the oldest `most` of them if that is given; equal times by id."""
    waiting = queue.where("processed_at IS NULL")
    return waiting if most is None else waiting.orderBy("observed_at", "id").limit(most)


def touched(changes: DataFrame, stats: DataFrame) -> DataFrame:
    """id, game and player of what each change touches: a stat its own row, a game or a player all of theirs."""
    by = lambda kind, column: changes.where(F.col("kind") == kind).select("id", F.col("entity").alias(column)).join(stats.select("stat_id", *PAIR), column).select("id", *PAIR)
    return by("stat", "stat_id").unionByName(by("game", "game")).unionByName(by("player", "player")).distinct()


def results(points: DataFrame, stats: DataFrame) -> DataFrame:
    """Graded results (H-06, H-07) of eligible stats at closing points that stand: outcome, margin and coverage."""
    standing = points.where(F.col("closing_point").isNotNull() & F.col("coverage").isin(*USABLE))
    rows = standing.join(stats.where("eligible").select(*RESULT, "value"), RESULT).where(F.col("value").isNotNull() & ~F.isnan("value"))
    margin, outcome = line_result(F.col("value"), F.col("closing_point"))
    return rows.select(*RESULT, "closing_point", "value", outcome.alias("outcome"), margin.alias("margin"), "coverage")


def windows(graded: DataFrame, starts: DataFrame) -> DataFrame:
    """Real-line windows of each player and market, newest game first."""
    rows = graded.join(starts.select("game", "starts_at"), "game").withColumn("single_book", F.col("coverage") == "single_book")
    return real_line_windows(rows, ["player", "market"], [F.desc("starts_at"), F.desc("game")])


def upsert(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def drain(queue: DataFrame, points: DataFrame, stats: DataFrame, starts: DataFrame, graded: DataFrame, windowed: DataFrame, now: Column, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queue, the results and the windows after the changes have been worked off (H-20).

    queue(id, kind, entity, observed_at, processed_at, note): kind is stat, game or player. stats(stat_id, game, player,
    market, value, eligible) and points as results() takes them, both as they are now; graded and windowed as they were.
    Only pairs that a change touches are graded again, and only windows of their players are made again; a row that can't
    be made any more stays as it was. note: recomputed, or no_eligible_source where a change touches nothing. A change of
    another kind touches nothing. Working off an empty queue, or the same one again, changes nothing.
    """
    changes = oldest(queue, most)
    pairs = touched(changes, stats)
    some = pairs.select(*PAIR).distinct()
    fresh = results(points.join(some, PAIR, "left_semi"), stats.join(some, PAIR, "left_semi"))
    after = upsert(graded, fresh, RESULT)
    players = some.select("player").distinct()
    made = windows(after.join(players, "player", "left_semi"), starts)
    done = changes.select("id").join(pairs.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left").select("id", F.when(F.col("__hit"), "recomputed").otherwise("no_eligible_source").alias("__note"))
    marked = queue.join(done, "id", "left")
    marked = marked.withColumns({"processed_at": F.when(F.col("__note").isNotNull(), now).otherwise(F.col("processed_at")), "note": F.coalesce("__note", "note")}).select(*queue.columns)
    return marked, after, upsert(windowed, made, ["player", "market"])
