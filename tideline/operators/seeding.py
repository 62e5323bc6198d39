"""Historical snapshots of quotes: one pass over nested payloads to closing quotes and to what is excluded, with why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tideline.functions.scalar import first_true, normal_name, side
from tideline.operators.history import capture_state

#: Markets at launch, and reasons that a quarantined row may have.
LAUNCH = ("player_points", "player_rebounds", "player_assists", "player_threes")
REASONS = (
    "schema_drift_http_200", "missing_bookmakers_array", "missing_markets_array", "missing_outcomes_array", "missing_last_update", "missing_price", "missing_point", "missing_player_description", "missing_side", "unexpected_field_shape",
    "conflicting_outcomes", "unallowlisted_bookmaker_key", "unlaunched_market_key", "dfs_pickem_excluded_from_sportsbook_consensus", "duplicate_event_id",
)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def outcomes(snapshots: DataFrame, classes: dict[str, str], markets: tuple[str, ...] = LAUNCH, count: Observation | None = None) -> DataFrame:
    """Each outcome of the eligible snapshots, or what stands in its way: snapshot_id, event_id, book, market,
    provider_time, player, side, point, price, __at (its place) and reason (null: it counts).

    snapshots(snapshot_id, boundary, taken_at, data): data as in sources.files.PAYLOAD. A book that isn't in classes, or is
    no sportsbook there, is one row, with its reason; so is a market that isn't among `markets`. An outcome without a player,
    a finite point or a side has the first of these as its reason. Null or empty lists give no row. count: gets the rows
    by reason in the same pass.
    """
    rows = snapshots.where(capture_state(F.col("taken_at"), F.col("boundary")) == "eligible")
    rows = rows.select("snapshot_id", F.col("data.id").alias("event_id"), F.posexplode("data.bookmakers").alias("__b", "b"))
    kinds = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]) if classes else F.create_map().cast("map<string,string>")
    kind = kinds[F.col("b.key")]
    rows = rows.withColumn("__book", first_true([(kind.isNull(), "unallowlisted_bookmaker_key"), (kind != "sportsbook", "dfs_pickem_excluded_from_sportsbook_consensus")]))
    rows = rows.select("*", F.posexplode_outer(F.when(F.col("__book").isNull(), F.col("b.markets"))).alias("__m", "m")).where("__book IS NOT NULL OR m IS NOT NULL")
    rows = rows.withColumn("__market", F.when(F.col("m").isNotNull() & ~F.coalesce(F.col("m.key").isin(*markets), F.lit(False)), "unlaunched_market_key"))
    rows = rows.select("*", F.posexplode_outer(F.when(F.col("__market").isNull(), F.col("m.outcomes"))).alias("__o", "o")).where("__book IS NOT NULL OR __market IS NOT NULL OR o IS NOT NULL")
    o = F.when(F.col("o").isNotNull(), first_true([(F.trim(F.coalesce("o.description", F.lit(""))) == "", "missing_player_description"), (~finite(F.col("o.point")), "missing_point"), (side(F.col("o.name")).isNull(), "missing_side")]))
    made = rows.select("snapshot_id", "event_id", F.col("b.key").alias("book"), F.col("m.key").alias("market"), F.col("m.last_update").alias("provider_time"), F.col("o.description").alias("player"), side(F.col("o.name")).alias("side"), F.col("o.point").alias("point"), F.col("o.price").alias("price"), F.struct("__b", "__m", "__o").alias("__at"), F.coalesce("__book", "__market", o).alias("reason"))
    if count is not None:
        made = made.observe(count, F.count_if(F.col("reason").isNull()).alias("valid"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    return made


def exclusions(rows: DataFrame) -> DataFrame:
    """What outcomes() kept out, one row each (H-03)."""
    return rows.where("reason IS NOT NULL").select("snapshot_id", "event_id", "book", F.coalesce("market", F.lit("")).alias("market"), "reason")


def closing_quotes(rows: DataFrame) -> DataFrame:
    """What outcomes() let through, paired (H-03): over and under price of each snapshot, book, market, normal player
    name and point. The last outcome of a side counts; a price that is missing counts as 0, a side that is missing has none.
    player and provider_time are those of the over side, if there is one."""
    price = F.when(finite(F.col("price")), F.col("price").cast("long")).otherwise(0)
    one = lambda s, name: F.max(F.when(F.col("side") == s, F.struct("__at", F.struct(price.alias("price"), "player", "provider_time").alias("v"))))["v"].alias(name)
    keys = ["snapshot_id", "event_id", "book", "market", "name", "point"]
    pairs = rows.where("reason IS NULL").withColumn("name", normal_name(F.col("player"))).groupBy(*keys).agg(one("over", "o"), one("under", "u"))
    any_ = F.when(F.col("o").isNotNull(), F.col("o")).otherwise(F.col("u"))
    return pairs.select("snapshot_id", "event_id", "book", "market", any_["player"].alias("player"), "point", F.col("o.price").alias("over_price"), F.col("u.price").alias("under_price"), any_["provider_time"].alias("provider_time"))


def quarantined(rows: DataFrame, run_id: str) -> DataFrame:
    """Exclusions as rows of the quarantine (D-13): a reason that isn't in the closed list fails the job that writes them."""
    known = F.col("reason").isin(*REASONS)
    checked = F.when(known, F.col("reason")).otherwise(F.raise_error(F.concat(F.lit("not a quarantine reason: "), F.coalesce("reason", F.lit("null")))).cast("string"))
    return rows.select(F.lit(run_id).alias("run_id"), "snapshot_id", "event_id", "book", F.nullif("market", F.lit("")).alias("market"), checked.alias("reason"))
