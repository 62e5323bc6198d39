"""Reconciliation of provider events and players with internal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import first_true, normal_name

TOLERANCE = 900


def reconcile_events(events: DataFrame, games: DataFrame) -> DataFrame:
    """events(event_id, home, away, at), games(game_id, home, away, at): outcome and game (I-01, J-15). The join is
    on the teams of a pair in either order; times are compared in buckets of the tolerance, not within all of a pair."""
    ordered = lambda d: d.withColumn("pair", F.concat_ws("|", F.least("home", "away"), F.greatest("home", "away")))
    e = ordered(events)
    g = ordered(games).select("pair", "game_id", F.col("home").alias("g_home"), F.col("at").alias("g_at"))
    slot = lambda c: F.floor(F.unix_micros(c) / (TOLERANCE * 1_000_000))
    near_by = e.select("event_id", "pair", "home", "at", F.explode(F.array(*[slot("at") + i for i in (-1, 0, 1)])).alias("slot"))
    met = near_by.join(g.select("pair", F.col("g_home").alias("home"), slot("g_at").alias("slot"), "game_id", "g_at"), ["pair", "home", "slot"])
    met = met.withColumn("delta", F.abs(F.unix_micros("at") - F.unix_micros("g_at"))).where(F.col("delta") <= TOLERANCE * 1_000_000)
    exact = F.col("delta") == 0
    close = met.groupBy("event_id").agg(F.count_if(exact).alias("exact"), F.count("*").alias("near"), F.min(F.when(exact, F.col("game_id"))).alias("exact_id"), F.min("game_id").alias("near_id"))
    pairs, sides = g.groupBy("pair").agg(F.count("*").alias("candidates")), g.groupBy("pair", F.col("g_home").alias("home")).agg(F.count("*").alias("ordered"))
    got = e.join(pairs, "pair", "left").join(sides, ["pair", "home"], "left").join(close, "event_id", "left").na.fill(0, ["candidates", "ordered", "exact", "near"])
    outcome = first_true(
        [
            (F.col("home").isNull() | F.col("away").isNull(), "unresolved_team"),
            (F.col("home") == F.col("away"), "same_team"),
            (F.col("at").isNull(), "bad_time"),
            (F.col("candidates") == 0, "no_candidate"),
            (F.col("ordered") == 0, "reversed_pair"),
            (F.col("exact") == 1, "approved_exact"),
            (F.col("exact") > 1, "multiple_exact"),
            (F.col("near") == 1, "approved_near"),
            (F.col("near") > 1, "multiple_near"),
        ],
        "time_window_exceeded",
    )
    rows = got.withColumn("outcome", outcome)
    return rows.select("event_id", "outcome", F.when(F.col("outcome") == "approved_exact", F.col("exact_id")).when(F.col("outcome") == "approved_near", F.col("near_id")).alias("game_id"))


def reconcile_players(provider: DataFrame, reviewed: DataFrame, aliases: DataFrame, players: DataFrame) -> DataFrame:
    """provider(provider_id, name): a reviewed mapping, else one reviewed alias (several: quarantined), else a name
    proposed for review (I-02)."""
    by_alias = aliases.groupBy("name").agg(F.count_distinct("player_id").alias("n_alias"), F.min("player_id").alias("alias_id"))
    by_name = players.groupBy("name").agg(F.count_distinct("player_id").alias("n_name"), F.min("player_id").alias("name_id"))
    rows = provider.join(reviewed.select("provider_id", F.col("player_id").alias("reviewed_id")), "provider_id", "left").join(by_alias, "name", "left").join(by_name, "name", "left")
    outcome = first_true([(F.col("reviewed_id").isNotNull(), "reviewed_mapping"), (F.col("n_alias") > 1, "alias_conflict"), (F.col("n_alias") == 1, "reviewed_alias"), (F.col("n_name") == 1, "proposed_for_review"), (F.col("n_name") > 1, "ambiguous_name")], "unmatched")
    pick = F.coalesce("reviewed_id", F.when(F.col("n_alias") == 1, F.col("alias_id")), F.when(F.col("n_alias").isNull() & (F.col("n_name") == 1), F.col("name_id")))
    return rows.select("provider_id", outcome.alias("outcome"), pick.alias("player_id"))


def nearest_unique(left: DataFrame, right: DataFrame, key: str, at: str, other: str, other_id: str) -> DataFrame:
    """The nearest row in time of each left row, if no other is as near (J-16). Each left row meets the last right row
    up to it and the first from it on, by two ordered windows; no pairs are made."""
    found = right.groupBy(key, F.col(other).alias("__t")).agg(F.min(other_id).alias("__id"), F.count("*").alias("__n"))
    names = left.columns
    rows = left.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.struct(*names).alias("__left"), F.lit(None).cast("struct<t:timestamp,id:bigint,n:bigint>").alias("__r"))
    spots = found.select(F.col(key).alias("__k"), "__t", F.lit(None).cast(rows.schema["__left"].dataType).alias("__left"), F.struct(F.col("__t").cast("timestamp").alias("t"), F.col("__id").cast("bigint").alias("id"), F.col("__n").alias("n")).alias("__r"))
    side = F.col("__left").isNotNull()
    over = lambda *order: F.last("__r", ignorenulls=True).over(Window.partitionBy("__k").orderBy(*order, side).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = rows.union(spots).withColumn("__p", over(F.col("__t"))).withColumn("__q", over(F.col("__t").desc())).where(side)
    gap = lambda c: F.abs(F.unix_micros(F.col("__t").cast("timestamp")) - F.unix_micros(F.col(f"{c}.t")))
    p, q = gap("__p"), gap("__q")
    one = F.when(F.col("__q").isNull() | (p < q), F.col("__p")).when(F.col("__p").isNull() | (q < p) | (p == 0), F.col("__q"))
    got = both.where(F.col("__p").isNotNull() | F.col("__q").isNotNull()).select("__left.*", (F.least(p, q) / 1e6).alias("delta"), one.alias("__one"))
    return got.select(*names, "delta", F.when(F.col("__one.n") == 1, F.col("__one.id")).alias("nearest"))


def by_any_name(rows: DataFrame, name: str, teams: DataFrame, names: list[str], team_id: str) -> DataFrame:
    """rows with team_id of the team that has the name in any of its columns, whatever the case; null where none or
    several have it (J-17)."""
    known = teams.select(team_id, F.explode(F.array(*[F.lower(F.trim(F.col(c))) for c in names])).alias("__name")).where("__name IS NOT NULL").groupBy("__name").agg(F.count_distinct(team_id).alias("__n"), F.min(team_id).alias("__id"))
    met = rows.join(known, F.lower(F.trim(F.col(name))) == F.col("__name"), "left")
    return met.select(*rows.columns, F.when(F.col("__n") == 1, F.col("__id")).alias(team_id))


def name_index(players: DataFrame, player_id: str, display: str, stored: str) -> DataFrame:
    """name and player_id: stored normalised names go before display names that normalise alike (J-18); of several the
    smallest id."""
    keys = players.select(F.lower(F.trim(F.col(stored))).alias("name"), F.lit(0).alias("rank"), player_id).union(players.select(F.lower(F.trim(F.col(display))), F.lit(1), player_id))
    return keys.where("name IS NOT NULL").groupBy("name").agg(F.min_by(player_id, F.struct("rank", player_id)).alias(player_id))


def queue_reason(wanted: DataFrame, queue: DataFrame) -> DataFrame:
    """wanted(id), queue(candidate_ids, resolution, reason, created_at): reason of the queue row that names the id,
    open rows first, then the oldest; unmatched without one (H-18, J-12, W-09)."""
    rows = queue.select(F.explode(F.array_distinct("candidate_ids")).alias("id"), "resolution", "reason", "created_at")
    best = rows.groupBy("id").agg(F.min_by("reason", F.struct((F.col("resolution") != "open").alias("a"), F.col("created_at"), F.col("reason"))).alias("reason"))
    return wanted.join(best, "id", "left").select("id", F.coalesce("reason", F.lit("unmatched")).alias("reason"))


def last_token(provider: DataFrame, players: DataFrame) -> DataFrame:
    """provider(provider_id, name), players(player_id, name): a proposal where one internal name is a single word, and
    equal to the provider name's last (F-15)."""
    words = lambda c: F.split(F.lower(F.trim(F.col(c))), r"\s+")
    single = players.where(F.size(words("name")) == 1).groupBy(F.lower(F.trim(F.col("name"))).alias("token")).agg(F.count_distinct("player_id").alias("n"), F.min("player_id").alias("player_id")).where("n = 1")
    return provider.withColumn("token", F.element_at(words("name"), -1)).join(single, "token").select("provider_id", "player_id")


def superseded(current: DataFrame, approved: DataFrame, key: str, value: str) -> DataFrame:
    """History events of newly approved mappings (I-03): superseded with the old value where one is replaced, approved
    with the new; none where nothing changes."""
    both = approved.join(current.select(key, F.col(value).alias("__old")), key, "left").where(~F.col("__old").eqNullSafe(F.col(value)))
    events = F.array(F.when(F.col("__old").isNotNull(), F.struct(F.lit("superseded").alias("event"), F.col("__old").alias(value))), F.struct(F.lit("approved").alias("event"), F.col(value).alias(value)))
    return both.select(key, F.explode(F.filter(events, lambda x: x.isNotNull())).alias("__e")).select(key, "__e.*")


def mapping_resolution(grains: DataFrame, players: DataFrame, games: DataFrame, player_queue: DataFrame, game_queue: DataFrame) -> DataFrame:
    """grains(player, game) with player_resolved, event_resolved and queue_reason (H-18): whether any provider's mapping of
    it is approved; the reason is that of the player if it isn't, else of the game if that isn't, else null.

    players(player, state) and games(game, state): mappings, several of a thing by several providers. The queues are as in
    queue_reason(); where none names it, the reason is unmatched. Only unresolved things are looked up there.
    """
    rows = grains
    for name, mapped in (("player", players), ("game", games)):
        approved = mapped.where("state = 'approved'").select(name).distinct().withColumn(f"__{name}", F.lit(True))
        rows = rows.join(approved, name, "left").withColumn(f"__{name}", F.coalesce(f"__{name}", F.lit(False)))
    for name, queue in (("player", player_queue), ("game", game_queue)):
        wanted = rows.where(~F.col(f"__{name}")).select(F.col(name).alias("id")).distinct()
        reason = queue_reason(wanted, queue).select(F.col("id").alias(name), F.col("reason").alias(f"__{name}_reason"))
        rows = rows.join(reason, name, "left")
    reason = F.when(~F.col("__player"), F.col("__player_reason")).when(~F.col("__game"), F.col("__game_reason"))
    return rows.select(*grains.columns, F.col("__player").alias("player_resolved"), F.col("__game").alias("event_resolved"), reason.alias("queue_reason"))


def persisted_resolutions(outcomes: DataFrame, mappings: DataFrame, queue: DataFrame) -> DataFrame:
    """What becomes of each event's outcome (I-04), in one pass over what is known of it: event_id, action, game_id and
    state of its mapping afterwards, and reason.

    outcomes(event_id, game_id, reason): a game that was found, or null and why not; one row for an event. mappings(event_id,
    game_id, state), queue(event_id, resolution, reason). action: inserted (no mapping was there), unchanged (approved, the
    same game), updated (a mapping without a game gets it, an unresolved one is approved), clash (the mapping has another
    game, which stays; an unresolved state is approved all the same), queued, and already_queued where the event has an open
    row. Only an insertion and a queueing make rows, so working off the same outcomes again makes none.
    """
    kinds = [outcomes.select("event_id", F.struct("game_id", "reason").alias("o")), mappings.select("event_id", F.struct("game_id", "state").alias("m")), queue.where("resolution = 'open'").select("event_id", F.lit(True).alias("q"))]
    both = kinds[0].unionByName(kinds[1], allowMissingColumns=True).unionByName(kinds[2], allowMissingColumns=True)
    one = both.groupBy("event_id").agg(F.max("o").alias("o"), F.max("m").alias("m"), F.bool_or("q").alias("q")).where("o IS NOT NULL")
    found, known = F.col("o.game_id"), F.col("m.game_id")
    same = (known == found) & (F.col("m.state") == "approved")
    action = first_true([(found.isNull() & F.coalesce("q", F.lit(False)), "already_queued"), (found.isNull(), "queued"), (F.col("m").isNull(), "inserted"), (F.coalesce(same, F.lit(False)), "unchanged"), (F.coalesce(known != found, F.lit(False)), "clash")], "updated")
    state = F.when(found.isNull(), F.col("m.state")).otherwise(F.when(F.coalesce(F.col("m.state"), F.lit("unresolved")) == "unresolved", "approved").otherwise(F.col("m.state")))
    return one.select("event_id", action.alias("action"), F.when(found.isNull(), known).otherwise(F.coalesce(known, found)).alias("game_id"), state.alias("state"), F.when(found.isNull(), F.col("o.reason")).alias("reason"))


def reconcile_players_in_context(provider: DataFrame, reviewed: DataFrame, aliases: DataFrame, players: DataFrame, teams: DataFrame) -> DataFrame:
    """provider(provider_id, name, provider_team): outcome and player_id (I-02), by names in normal form and teams.

    A reviewed mapping decides. Else the active aliases of the name: of several players, alias_conflict; of one, approved
    by reviewed_alias if the provider's team, where it gives one, is mapped (teams(provider_team, team)) and is the
    player's own, where that is known; else missing_team_context. Else players of that name: of one, proposed_for_review; of
    several, ambiguous_name; a name that is empty in normal form, or that nobody has, is unmatched. player_id is null
    where nobody is chosen, and the candidate's where it waits for review.
    """
    keyed = lambda d, c: d.withColumn("__name", normal_name(F.col(c)))
    by_alias = keyed(aliases.where("active"), "name").groupBy("__name").agg(F.count_distinct("player_id").alias("n_alias"), F.min("player_id").alias("alias_id"))
    by_name = keyed(players, "name").groupBy("__name").agg(F.count_distinct("player_id").alias("n_name"), F.min("player_id").alias("name_id"))
    home = players.groupBy(F.col("player_id").alias("alias_id")).agg(F.max("team").alias("__own"))
    rows = keyed(provider, "name").join(reviewed.select("provider_id", F.col("player_id").alias("reviewed_id")), "provider_id", "left")
    rows = rows.join(by_alias, "__name", "left").join(by_name, "__name", "left").join(home, "alias_id", "left").join(teams.select("provider_team", F.col("team").alias("__seen")), "provider_team", "left")
    fits = F.col("provider_team").isNull() | (F.col("__seen").isNotNull() & (F.col("__own").isNull() | (F.col("__own") == F.col("__seen"))))
    named = F.coalesce(F.col("__name"), F.lit("")) != ""
    outcome = first_true(
        [
            (F.col("reviewed_id").isNotNull(), "reviewed_mapping"), (~named, "unmatched"), (F.col("n_alias") > 1, "alias_conflict"), ((F.col("n_alias") == 1) & fits, "reviewed_alias"), (F.col("n_alias") == 1, "missing_team_context"),
            (F.col("n_name") == 1, "proposed_for_review"), (F.col("n_name") > 1, "ambiguous_name"),
        ],
        "unmatched",
    )
    rows = rows.withColumn("outcome", outcome)
    o = F.col("outcome")
    pick = F.when(o == "reviewed_mapping", F.col("reviewed_id")).when(o.isin("reviewed_alias", "missing_team_context"), F.col("alias_id")).when(o == "proposed_for_review", F.col("name_id"))
    return rows.select("provider_id", "outcome", pick.alias("player_id"))


def reconcile_provider_events(events: DataFrame, games: DataFrame, teams: DataFrame) -> DataFrame:
    """events(event_id, home, away, at) with teams by any of their names: outcome and game (I-01 with J-17). teams(team,
    full_name, name, abbreviation, city); games have internal teams. A name that no team, or more than one, has is an
    unresolved team."""
    names = ["full_name", "name", "abbreviation", "city"]
    rows = events.select("event_id", "home", "away", "at")
    for side in ("home", "away"):
        rows = by_any_name(rows, side, teams, names, "team").drop(side).withColumnRenamed("team", side)
    return reconcile_events(rows, games)
