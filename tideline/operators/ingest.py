"""Validation, corrections, eligibility and schedules of incoming data, each row with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import first_true


def poll_state(status: Column, body_ok: Column, items: Column, partial: Column) -> Column:
    """Result of a poll (D-03)."""
    return first_true([(status.isNull(), "network_failure"), (status == 401, "auth_failure"), (status == 422, "invalid_request"), (status == 429, "rate_limited"), (status >= 500, "server_failure"), (status != 200, "http_failure"), (~body_ok, "schema_drift"), (partial, "partial"), (items == 0, "successful_empty")], "complete")


def duplicated_ids(rows: DataFrame, key: str) -> DataFrame:
    """All copies of an id that occurs more than once, and null ids, get a reason (D-01)."""
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("reason", first_true([(F.col(key).isNull(), "missing_id"), (n > 1, "duplicate_id")]))


def disposition(rows: DataFrame, group: list[str], order: list[Column], quarantined: Column) -> DataFrame:
    """The first row of a group contributes, the others are duplicates (D-05)."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("disposition", first_true([(quarantined, "quarantined"), (rn == 1, "contributed")], "duplicate"))


def correction(prior: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Kind of a correction and its changed fields in a fixed order (D-07)."""
    p = prior.select(key, *[F.col(f).alias(f"p_{f}") for f in fields], F.lit(True).alias("__p"))
    changed = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"p_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    both = current.join(p, key, "left").withColumn("changed", F.when(F.col("__p"), changed).otherwise(F.array().cast("array<string>")))
    return both.select(key, first_true([(F.col("__p").isNull(), "initial"), (F.size("changed") == 0, "metadata_only")], "material").alias("kind"), F.concat_ws(",", "changed").alias("changed"))


def eligibility(rows: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """The first rule that holds names the state (D-08)."""
    return rows.withColumn("state", first_true(rules, "eligible"))


def invalidations(corrections: DataFrame, key: str, game: str, player: str) -> DataFrame:
    """One row for each thing a material correction invalidates (D-09)."""
    s = lambda kind, col: F.struct(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("entity"))
    return corrections.where("kind = 'material'").select(key, F.explode(F.array(s("stat", key), s("player", player), s("game", game))).alias("i")).select(key, "i.*")


def reconciliation_schedule(finals: DataFrame, key: str, at: str) -> DataFrame:
    """Checks at once and 2 hours, 24 hours and 7 days after a final (D-10)."""
    hours = F.explode(F.array(*[F.lit(h) for h in (0, 2, 24, 168)]))
    return finals.select(key, F.col(at), hours.alias("hours")).select(key, "hours", (F.col(at) + F.make_interval(hours=F.col("hours"))).alias("due_at"))


def within_budget(calls: DataFrame, group: str, order: list[Column], cost: str, ceiling: float) -> DataFrame:
    """Calls of each group in order until the ceiling would be passed (V-12, H-22)."""
    spent = F.sum(cost).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("spent", spent).where(F.col("spent") <= ceiling)


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Counts of rows that break each named constraint; a null verdict breaks none, as with CHECK."""
    return rows.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])


def current_only(rows: DataFrame, current: Column, own: Column) -> DataFrame:
    """Rows of a current poll that this system observed itself (P-01); unknown is no."""
    return rows.where(F.coalesce(current & own, F.lit(False)))


def finalization(stored: Column, reported: Column) -> Column:
    """What to do with a game's reported state (D-12): unknown goes to quarantine, an equal one changes nothing."""
    return F.when(reported.isNull(), "quarantine").when(reported.eqNullSafe(stored), "noop").otherwise("update")
