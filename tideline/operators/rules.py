"""Rules in a fixed order: eligibility of a stat, what a correction invalidates, forbidden copy, shapes of payloads and the
canonical form that content is hashed in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalar import first_true

#: Fixed values: (flag that makes it so, state, reason of a quarantine), the first that holds.
ELIGIBILITY = (
    ("duplicate_source_key", "quarantined", "duplicate_source_key"),
    ("missing_player", "quarantined", "missing_player"),
    ("missing_game", "quarantined", "missing_game"),
    ("unknown_game_status", "quarantined", "unknown_game_status"),
    ("unresolved_minutes", "unresolved_minutes", None),
    ("team_not_in_game", "quarantined", "team_not_in_game"),
    ("season_mismatch", "quarantined", "season_mismatch"),
    ("unsupported_competition_team", "quarantined", "unsupported_competition_team"),
    ("not_final", "live_or_non_final", None),
    ("dnp", "non_participation", None),
)
#: Forbidden terms as (term, a word or a phrase, whether its case counts), and texts that are exempt.
FORBIDDEN = (
    ("guaranteed", "word", False),
    ("lock", "word", False),
    ("free money", "phrase", False),
    ("sure thing", "phrase", False),
    ("guaranteed winner", "phrase", False),
    ("can't miss", "phrase", False),
    ("risk-free", "phrase", False),
    ("safest bet", "phrase", False),
    ("proven winner", "phrase", False),
    ("probability", "word", False),
    ("probabilities", "word", False),
    ("expected value", "phrase", False),
    ("guarantee", "word", False),
    ("guarantees", "word", False),
    ("EV", "word", True),
    ("+EV", "phrase", True),
    ("ROI", "word", True),
)
EXEMPT = (
    "Evidence profiles summarize historical results and current market information. They are research tools, not guarantees or predicted probabilities.",
    "Evidence Strength is a transparent research-ranking score. It is not the estimated probability that a prop will hit.",
)


def stat_eligibility(rows: DataFrame) -> DataFrame:
    """state and quarantine_reason of each stat row (D-08), from the source's columns: duplicate (the source key occurs
    again), player, game, game_status, minutes_status, team, home_team, away_team, season, game_season, supported.

    Null ids, and a status of unknown or null, are what they say; a null team, season or flag agrees with nothing.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    holds = {
        "duplicate_source_key": F.coalesce("duplicate", F.lit(False)),
        "missing_player": F.col("player").isNull(),
        "missing_game": F.col("game").isNull(),
        "unknown_game_status": F.coalesce(F.col("game_status") == "unknown", F.lit(True)),
        "unresolved_minutes": F.coalesce(F.col("minutes_status") == "unresolved_non_numeric", F.lit(True)),
        "team_not_in_game": no((F.col("team") == F.col("home_team")) | (F.col("team") == F.col("away_team"))),
        "season_mismatch": no(F.col("season") == F.col("game_season")),
        "unsupported_competition_team": no(F.col("supported")),
        "not_final": F.col("game_status") != "final",
        "dnp": F.col("minutes_status") == "dnp",
    }
    state = first_true([(holds[k], s) for k, s, _ in ELIGIBILITY], "eligible")
    reason = first_true([(holds[k], k if r else "") for k, _, r in ELIGIBILITY], "")
    return rows.withColumns({"state": state, "quarantine_reason": F.nullif(reason, F.lit(""))})


def stat_invalidations(corrections: DataFrame) -> DataFrame:
    """stat_id, kind, entity and reason of each thing that a material correction invalidates (D-09): the stat; again where
    its state of minutes changed; the player and the game where they are known. corrections(stat_id, player, game, kind,
    minutes_changed)."""
    one = lambda kind, column, reason, holds: F.when(holds, F.struct(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("entity"), F.lit(reason).alias("reason")))
    made = F.array(
        one("player_game_stat", "stat_id", "material_stat_change", F.lit(True)),
        one("player_game_stat", "stat_id", "minutes_state_change", F.coalesce("minutes_changed", F.lit(False))),
        one("internal_player", "player", "material_stat_change", F.col("player").isNotNull()),
        one("internal_game", "game", "material_stat_change", F.col("game").isNotNull()),
    )
    return corrections.where("kind = 'material'").select("stat_id", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("i")).select("stat_id", "i.*")


def forbidden_copy(text: Column) -> Column:
    """The forbidden terms of a text, in their order (V-10): words at word boundaries; phrases between what is no word
    character, with any white space inside; some in capitals only. A text that is one of EXEMPT to the letter has none; null
    has none."""
    hits = []
    for term, kind, cased in FORBIDDEN:
        t = r"\s+".join(re.escape(x) for x in term.split())
        t = rf"\b{t}\b" if kind == "word" else rf"(?:^|\W){t}(?:$|\W)"
        hits.append(F.when(text.rlike(t if cased else f"(?i){t}"), F.lit(term)))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return F.when(text.isNull() | text.isin(*EXEMPT), F.array().cast("array<string>")).otherwise(found)


# ---- shapes -----------------------------------------------------------------------------------------------------------


def kind_of(v: Column) -> Column:
    """Type of a variant: object, array, string, bigint, ...; void for a JSON null, missing for nothing."""
    return F.coalesce(F.lower(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)), F.lit("missing"))


def wrong(path: Column, expected: str, found: Column, holds: Column, *at: Column) -> Column:
    place = F.array(*[a.cast("int") for a in at])
    return F.when(~holds, F.struct(place.alias("place"), path.alias("path"), F.lit(expected).alias("expected"), found.alias("found")))


def shape_violations(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """key, path, expected and found of every place where a quote payload (JSON text) departs from its shape (D-02), walked
    level by level: an object with an array of bookmakers, each an object with a key and an array of markets, each an
    object with a key and, if at all, an array of outcomes. What is under a wrong element isn't looked at. Text that is
    no JSON, and null, are a missing object."""
    get = lambda v, p, t="variant": F.try_variant_get(v, f"$.{p}", t)
    named = lambda v: (kind_of(get(v, "key")) == "string") & (F.coalesce(get(v, "key", "string"), F.lit("")) != "")
    root = payloads.select(key, F.try_parse_json(body).alias("v"))
    is_object, books = kind_of(F.col("v")) == "object", get(F.col("v"), "bookmakers")
    top = root.select(key, F.array(wrong(F.lit("$"), "object", kind_of(F.col("v")), is_object), F.when(is_object, wrong(F.lit("$.bookmakers"), "array", kind_of(books), kind_of(books) == "array"))).alias("w"))

    level = root.where(is_object & (kind_of(books) == "array")).select(key, F.posexplode(get(F.col("v"), "bookmakers", "array<variant>")).alias("i", "b"))
    i, b = F.col("i"), F.col("b")
    at = F.concat(F.lit("$.bookmakers["), i, F.lit("]"))
    good, markets = kind_of(b) == "object", get(b, "markets")
    middle = level.select(key, F.array(wrong(at, "object", kind_of(b), good, i), F.when(good, wrong(F.concat(at, F.lit(".key")), "string", kind_of(get(b, "key")), named(b), i)), F.when(good, wrong(F.concat(at, F.lit(".markets")), "array", kind_of(markets), kind_of(markets) == "array", i))).alias("w"))

    under = level.where(good & (kind_of(markets) == "array")).select(key, "i", F.posexplode(get(b, "markets", "array<variant>")).alias("j", "m"))
    j, m = F.col("j"), F.col("m")
    at = F.concat(F.lit("$.bookmakers["), i, F.lit("].markets["), j, F.lit("]"))
    good, outcomes = kind_of(m) == "object", kind_of(get(m, "outcomes"))
    low = under.select(key, F.array(wrong(at, "object", kind_of(m), good, i, j), F.when(good, wrong(F.concat(at, F.lit(".key")), "string", kind_of(get(m, "key")), named(m), i, j)), F.when(good, wrong(F.concat(at, F.lit(".outcomes")), "array", outcomes, outcomes.isin("array", "missing"), i, j))).alias("w"))
    rows = top.unionByName(middle).unionByName(low).select(key, F.explode(F.filter("w", lambda x: x.isNotNull())).alias("w"))
    return rows.select(key, "w.*")


def payload_shape(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """key, state (valid, valid_empty or schema_drift), the path of the first violation, and how many there are. key is
    unique."""
    first = shape_violations(payloads, key, body).groupBy(key).agg(F.min(F.struct("place", "path")).alias("__first"), F.count("*").alias("violations"))
    books = F.try_variant_get(F.try_parse_json(body), "$.bookmakers", "array<variant>")
    rows = payloads.select(key, (F.size(books) == 0).alias("__empty")).join(first, key, "left")
    state = first_true([(F.col("__first").isNotNull(), "schema_drift"), (F.coalesce("__empty", F.lit(False)), "valid_empty")], "valid")
    return rows.select(key, state.alias("state"), F.col("__first.path").alias("path"), F.coalesce("violations", F.lit(0)).alias("violations"))


def canonical_json(body: Column) -> Column:
    """JSON text with keys in order at every depth and numbers in one form (F-12): 1, 1.0 and 1e0 are 1. Keys are in the
    order of their UTF-8 bytes; of a key given twice the parser takes none: null, like text that is no JSON."""
    text = F.to_json(F.try_parse_json(body))
    # Strings pass through whole; of numbers, a fraction of zeros goes.
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|(-?\d+)\.0+(?![0-9eE])', "$1$2")


def content_hash(body: Column) -> Column:
    """SHA-256 of the canonical form, null without one."""
    return F.sha2(canonical_json(body).cast("binary"), 256)
