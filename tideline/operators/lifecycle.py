"""Lifecycles of quoted lines: generations, holds and movement events with their confidence.

A line's state changes only by polls that tell something: one that failed, or whose source was unavailable, holds it; one
after the event's start takes nothing away any more. So between two appearances only the number of telling polls counts,
and that is a difference of two running counts: no row is made for a poll in which a line is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import first_true

#: Telling omissions in a row that confirm a removal.
CONFIRMED = 2


def telling(polls: DataFrame, scope: list[str], poll: str) -> DataFrame:
    """Each poll of a scope with __ok (it saw what there was), __out (an omission in it counts), __through (omissions that
    would have counted up to it, itself included) and __total (in all polls of the scope)."""
    truth = lambda c: F.coalesce(F.col(c), F.lit(False))
    ok = truth("succeeded") & ~truth("unavailable")
    out = (ok & ~truth("started")).cast("long")
    by = Window.partitionBy(*scope)
    rows = polls.select(*scope, poll, ok.alias("__ok"), out.alias("__out"))
    return rows.withColumns({"__through": F.sum("__out").over(by.orderBy(poll)), "__total": F.sum("__out").over(by)})


def lifecycle(seen: DataFrame, polls: DataFrame, keys: list[str], scope: list[str], poll: str = "poll") -> DataFrame:
    """A row for each generation of each line (L-09, T-01, T-02): first_seen and last_seen, state (present,
    single_omission or confirmed_removed), omissions (0 to 2) and confirmed_at (the poll that confirmed the removal).

    seen(keys, poll): appearances, repeated or not. polls(scope, poll, succeeded, unavailable, started): one row for each
    poll; scope is a part of keys; a null flag counts as false. Appearances in polls that aren't there, or of lines with a
    null key, don't count. An appearance in a poll that failed makes a line, or moves its last_seen, and changes no state. The first appearance in a
    telling poll after a confirmed removal begins a generation; the one before stays as it was.
    """
    numbers = telling(polls, scope, poll)
    rows = seen.select(*keys, poll).dropna(subset=keys).distinct().join(numbers, [*scope, poll])
    by = Window.partitionBy(*keys)
    w = by.orderBy(poll)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__tells", F.col("__ok") | (F.row_number().over(w) == 1))
    missed = F.col("__through") - F.col("__out") - F.last(F.when(F.col("__tells"), F.col("__through")), ignorenulls=True).over(before)
    rows = rows.withColumn("__new", (F.col("__ok") & (F.coalesce(missed, F.lit(0)) >= CONFIRMED)).cast("int"))
    rows = rows.withColumns({"generation": 1 + F.sum("__new").over(w), "__last": 1 + F.sum("__new").over(by)})
    made = rows.groupBy(*keys, "generation").agg(F.min(poll).alias("first_seen"), F.max(poll).alias("last_seen"), F.max(F.when(F.col("__tells"), F.col("__through"))).alias("__from"), F.first("__total").alias("__total"), (F.first("__last") > F.col("generation")).alias("__closed"))
    omitted = F.when(F.col("__closed"), CONFIRMED).otherwise(F.least(F.col("__total") - F.col("__from"), F.lit(CONFIRMED))).cast("int")
    state = first_true([(F.col("omissions") == 0, "present"), (F.col("omissions") < CONFIRMED, "single_omission")], "confirmed_removed")
    made = made.withColumn("omissions", omitted).withColumn("state", state)
    marks = numbers.where("__out = 1").select(*scope, F.col(poll).alias("confirmed_at"), (F.col("__through") - CONFIRMED).alias("__from"))
    return made.join(marks, [*scope, "__from"], "left").select(*keys, "generation", "first_seen", "last_seen", "state", "omissions", "confirmed_at")


def movements(prior: DataFrame, current: DataFrame, context: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """Movement events between two polls (L-07 to L-09), without unchanged grains: type, confidence (high or low) and what
    was before and after.

    prior and current: offerings(keys, side, point, price, provider_time), a grain (keys, side, point) once; grains with a
    null key don't count. context(scope, produced, succeeded): whether the poll before had offerings and the current one
    succeeded; missing counts as neither. An added side is sure where the poll before had offerings, a removed one where
    the current poll succeeded. Where one point of (keys, side) went and one came, a point_changed event is added to the
    two. A price change hides a change of the provider's time.
    """
    grain = [*keys, "side", "point"]
    known = lambda d: d.dropna(subset=keys)
    p = known(prior).select(*grain, F.col("price").alias("prior_price"), F.col("provider_time").alias("prior_time"), F.lit(True).alias("__p"))
    c = known(current).select(*grain, F.col("price").alias("current_price"), F.col("provider_time").alias("current_time"), F.lit(True).alias("__c"))
    rows = p.join(c, grain, "full").join(context.select(*scope, "produced", "succeeded"), scope, "left")
    differ = lambda x: ~F.col(f"prior_{x}").eqNullSafe(F.col(f"current_{x}"))
    added, removed = F.col("__p").isNull(), F.col("__c").isNull()
    kind = first_true([(added, "side_added"), (removed, "side_removed"), (differ("price") & (F.col("side") == "over"), "over_price_changed"), (differ("price"), "under_price_changed"), (differ("time"), "provider_timestamp_changed")], "unchanged")
    sure = F.when(added, F.col("produced")).when(removed, F.col("succeeded")).otherwise(F.lit(True))
    rows = rows.withColumns({"type": kind, "confidence": confidence(sure), "prior_point": F.when(~added, F.col("point")), "current_point": F.when(~removed, F.col("point"))})
    # One point went and one came: seen in the same rows, by one more grouping of them.
    went, came = F.col("type") == "side_removed", F.col("type") == "side_added"
    one = lambda c, x: F.max(F.when(c, F.col(x)))
    linked = rows.groupBy(*keys, "side").agg(F.count_if(went).alias("__went"), F.count_if(came).alias("__came"), *[one(went, x).alias(x) for x in ("prior_point", "prior_price", "prior_time")], *[one(came, x).alias(x) for x in ("current_point", "current_price", "current_time")])
    linked = linked.where("__went = 1 AND __came = 1").withColumns({"type": F.lit("point_changed"), "confidence": F.lit("high"), "point": F.col("current_point")})
    columns = [*grain, "type", "confidence", "prior_point", "current_point", "prior_price", "current_price", "prior_time", "current_time"]
    return rows.where("type <> 'unchanged'").select(*columns).unionByName(linked.select(*columns))


def confidence(sure: Column) -> Column:
    return F.when(F.coalesce(sure, F.lit(False)), "high").otherwise("low")
