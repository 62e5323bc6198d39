"""The evidence profile: four components, composite, quality rules, classes and reasons, as columns of one row.

Input columns: line, below/above/equal counts and avg/median minus threshold of L5, L10, L20 and season (a5, b5, ...,
a10, b10, e10, avg10, med10, ... with 20 and s), n10, n20, ns, consensus line, books, books_at_line, net movement,
normaliser m. Optional: span_days (days of history; null is too few), one_sided, game_status, player_resolved,
event_resolved, freshness (of the current market), availability (presence of the player's source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalar import clamp, first_true

#: Normalisers by market, weights and thresholds of the method.
NORMALISERS = {"player_points": 6.0, "player_rebounds": 3.0, "player_assists": 2.0, "player_threes": 1.5}
TREND, MARGIN, AGREEMENT, MARKET = (0.55, 0.25, 0.20), (0.40, 0.30, 0.20, 0.10), (0.10, 0.40, 0.25, 0.25), (0.60, 0.20, 0.20)
COMPOSITE, NEUTRAL = (0.35, 0.25, 0.20, 0.20), 0.05
MIN_L10, MIN_SEASON, MIN_STRONG, MIN_DAYS, MIN_BOOKS = 5, 10, 8, 30, 3
PUSH_SHARE, DISAGREE, STRONG, MODERATE = 0.30, 0.30, 0.55, 0.30


def rate_deviation(above: Column, below: Column) -> Column:
    """2p - 1 for p = above / (above + below); 0 without either (E-01)."""
    total = above + below
    return F.when(total > 0, 2 * (above / total) - 1).otherwise(F.lit(0.0))


def trend(rd10: Column, rd_long: Column, rd_season: Column) -> Column:
    """Weighted rate deviations (E-02), before clamping; L5 has no part in it."""
    return TREND[0] * rd10 + TREND[1] * rd_long + TREND[2] * rd_season


def margin_strength(terms: list[Column], m: Column) -> Column:
    """Mean of clamped margins over the normaliser, by weights renormalised over terms that aren't null (E-03)."""
    weights = [F.when(t.isNotNull(), w).otherwise(0.0) for t, w in zip(terms, MARGIN, strict=True)]
    total = sum(weights[1:], weights[0])
    parts = [F.coalesce(clamp(t / m), F.lit(0.0)) * w for t, w in zip(terms, weights, strict=True)]
    return F.when(total > 0, sum(parts[1:], parts[0]) / total).otherwise(F.lit(0.0))


def window_agreement(rds: list[Column]) -> Column:
    """How far windows agree with the sign that most weight is on, signed by it (E-04). Windows without a sign count
    for neither side; where no sign dominates, they are what agrees and every other counts against."""
    signs = [F.signum(r) for r in rds]
    weighted = [s * w for s, w in zip(signs, AGREEMENT, strict=True)]
    dominant = F.signum(sum(weighted[1:], weighted[0]))
    votes = [F.when(s == dominant, 1.0).when(s == 0, 0.0).otherwise(-1.0) * w for s, w in zip(signs, AGREEMENT, strict=True)]
    raw = sum(votes[1:], votes[0])
    return clamp(F.when(dominant == 0, raw).otherwise(dominant * raw))


def market_alignment(gap: Column, m: Column, coverage: Column, net: Column, blocked: Column) -> Column:
    """Gap to the consensus, coverage of the line and net movement (E-05); 0 where the market can't be read."""
    x = MARKET[0] * clamp(gap / m) + MARKET[1] * coverage * F.signum(gap) + MARKET[2] * clamp(F.coalesce(net, F.lit(0.0)) / m)
    return F.when(blocked, F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))


def composite(c: list[Column]) -> Column:
    parts = [x * w for x, w in zip(c, COMPOSITE, strict=True)]
    return clamp(sum(parts[1:], parts[0]))


def opposed(a: Column, b: Column) -> Column:
    return (F.signum(a) * F.signum(b) < 0) & (F.abs(a) >= DISAGREE) & (F.abs(b) >= DISAGREE)


#: Causes of an unavailable profile and reasons of a cap, each in the order that decides.
UNAVAILABLE = ("postponed_game", "canceled_game", "unresolved_player_mapping", "unresolved_event_mapping", "no_current_market", "no_unique_consensus_line")
CAPS = ("one_sided_offering", "push_heavy_sample", "stale_current_market", "insufficient_book_coverage", "market_disagrees_with_history")
COMPOSITE_OF = ("trend", "margin", "agreement", "market")
COMPONENTS = (*COMPOSITE_OF, "score")


def optional(rows: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in rows.columns else default


def gates(rows: DataFrame) -> tuple[dict[str, Column], dict[str, Column]]:
    """What makes a profile unavailable (E-08, E-13), and what makes its evidence insufficient (E-07)."""
    books, status = F.coalesce("books", F.lit(0)), optional(rows, "game_status", F.lit(""))
    freshness = optional(rows, "freshness", F.when(books == 0, "unavailable").otherwise("fresh"))
    stale = freshness.isin("stale", "failed_latest_poll")
    no_market = (freshness == "unavailable") | (stale & (books == 0))
    holds = (status == "postponed", status == "canceled", optional(rows, "player_resolved", F.lit(True)) == F.lit(False), optional(rows, "event_resolved", F.lit(True)) == F.lit(False), no_market, F.col("consensus").isNull() & (books > 0))
    span = optional(rows, "span_days", F.lit(None).cast("int"))
    few = {"insufficient_l10_sample": F.coalesce(F.col("n10") < MIN_L10, F.lit(True)), "incomplete_historical_coverage": F.coalesce((F.col("ns") < MIN_SEASON) | (span < MIN_DAYS), F.lit(True)) | span.isNull()}
    return {k: F.coalesce(v, F.lit(False)) for k, v in zip(UNAVAILABLE, holds, strict=True)}, few


def profile(rows: DataFrame) -> DataFrame:
    """Scores and classes of each row (E-01 to E-14): adds rd5, rd10, rd20, rds, trend, margin, agreement, market,
    score (null where unavailable or insufficient), cause, caps (all that fire), windows_disagree, classification,
    direction, quality_capped and cap (the reason that held a strong class down to moderate, else none)."""
    gone, few = gates(rows)
    r = rows
    for k in ("5", "10", "20", "s"):
        r = r.withColumn(f"rd{k}", rate_deviation(F.col(f"a{k}"), F.col(f"b{k}")))
    long = F.when(F.col("n20") >= 10, F.col("rd20")).otherwise(F.col("rds"))
    gap = F.col("consensus") - F.col("line")
    coverage = F.when(F.col("books") > 0, F.col("books_at_line") / F.col("books")).otherwise(F.lit(0.0))
    one_side = F.coalesce(optional(rows, "one_sided", F.lit("neither")).isin("over_only", "under_only"), F.lit(False))
    stale = F.coalesce(optional(rows, "freshness", F.lit("fresh")).isin("stale", "failed_latest_poll"), F.lit(False))
    cause = first_true([(gone[k], k) for k in UNAVAILABLE], None)
    r = r.withColumns({"cause": cause, "few_l10": few["insufficient_l10_sample"], "few_season": few["incomplete_historical_coverage"]})
    r = r.withColumns(
        {
            "trend_raw": trend(F.col("rd10"), long, F.col("rds")),
            "margin": margin_strength([F.col("avg10"), F.col("med10"), F.col("avgs"), F.col("meds")], F.col("m")),
            "agreement": window_agreement([F.col(f"rd{k}") for k in ("5", "10", "20", "s")]),
            "market": market_alignment(gap, F.col("m"), coverage, F.col("net"), F.col("consensus").isNull() | one_side),
        }
    ).withColumn("trend", clamp(F.col("trend_raw")))
    r = r.withColumn("score", composite([F.col(c) for c in COMPOSITE_OF]))
    fires = (one_side, F.coalesce(F.col("e10") / F.col("n10") > PUSH_SHARE, F.lit(False)), stale, F.coalesce(F.col("books").between(1, MIN_BOOKS - 1), F.lit(False)), opposed(F.col("trend"), F.col("market")))
    scored = F.col("cause").isNull() & ~F.col("few_l10") & ~F.col("few_season")
    caps = F.when(scored, F.filter(F.array(*[F.when(f, k) for f, k in zip(fires, CAPS, strict=True)]), lambda c: c.isNotNull())).otherwise(F.array().cast("array<string>"))
    r = r.withColumns({"caps": caps, "windows_disagree": scored & (opposed(F.col("rd10"), F.col("rd20")) | opposed(F.col("rd10"), F.col("rds")) | opposed(F.col("rd20"), F.col("rds")))})
    size, side = F.abs(F.col("score")), F.when(F.col("score") > 0, "over").otherwise("under")
    capped = F.size("caps") > 0
    strong = (size >= STRONG) & (F.col("n10") >= MIN_STRONG) & (F.signum("rd10") == F.signum("score")) & (F.abs(F.col("trend_raw")) >= MODERATE) & ~capped
    level = F.when(strong, "strong_").when(size >= MODERATE, "moderate_")
    r = r.withColumn("level", F.when(scored & ~F.col("windows_disagree") & (size >= NEUTRAL), level)).withColumn("direction", F.when(F.col("level").isNotNull(), side))
    held = F.coalesce((F.col("level") == "moderate_") & capped, F.lit(False))
    named = F.when(F.col("cause").isNotNull(), "unavailable").when(~scored, "insufficient_evidence").when(F.col("level").isNull(), "mixed").otherwise(F.concat("level", "direction"))
    r = r.withColumns({"classification": named, "quality_capped": held, "cap": F.when(held, F.get("caps", F.lit(0))).otherwise("none")})
    return r.withColumns({c: F.when(scored, F.col(c)) for c in (*COMPONENTS, "trend_raw")}).drop("level")


def reasons(rows: DataFrame) -> DataFrame:
    """Ranked reason codes of a profile (E-15, W-05): support, contradiction, quality; within each by size, then by
    code. What makes a profile unavailable or insufficient stands alone, but for a source that is unavailable."""
    code = lambda category, name, holds, size=None: F.when(holds, F.struct(F.lit(category).alias("category"), (F.lit(1.0) if size is None else -F.abs(size)).cast("double").alias("order"), F.lit(name).alias("code")))
    gap, sign = F.col("consensus") - F.col("line"), F.signum("score")
    toward = F.when(F.col("direction") == "over", gap).when(F.col("direction") == "under", -gap)
    margin, agreement = F.col("margin"), F.col("agreement")
    strong_margin = (F.abs(margin) >= MODERATE) & (sign != 0)
    absent = optional(rows, "availability", F.lit("")) == "source_unavailable"
    made = F.array(
        code("1_support", "positive_margin_support", strong_margin & (F.signum(margin) == sign), margin),
        code("1_support", "window_agreement_support", (F.abs(agreement) >= 0.60) & (F.signum(agreement) == F.when(F.col("direction") == "over", 1.0).when(F.col("direction") == "under", -1.0)), agreement),
        code("1_support", "favorable_consensus_difference", toward >= 0.5, gap),
        code("2_contradiction", "negative_margin_support", strong_margin & (F.signum(margin) == -sign), margin),
        code("2_contradiction", "unfavorable_consensus_difference", toward <= -0.5, gap),
        code("2_contradiction", "margin_measures_disagree", F.signum("avg10") * F.signum("med10") < 0),
        code("2_contradiction", "market_disagrees_with_history", opposed(F.col("trend"), F.col("market")), F.least(F.abs(F.col("trend")), F.abs(F.col("market")))),
        code("2_contradiction", "windows_disagree", F.col("windows_disagree"), F.greatest(F.abs(F.col("rd10")), F.abs(F.col("rd20")), F.abs(F.col("rds")))),
        *[code("3_quality", c, F.array_contains("caps", c)) for c in CAPS[:-1]],
        code("3_quality", "source_unavailable", absent),
    )
    alone = F.array(*[code("3_quality", c, F.col("cause") == c) for c in UNAVAILABLE], code("3_quality", "insufficient_l10_sample", F.col("cause").isNull() & F.col("few_l10")), code("3_quality", "incomplete_historical_coverage", F.col("cause").isNull() & F.col("few_season")), code("3_quality", "source_unavailable", absent))
    chosen = F.when(F.col("classification").isin("unavailable", "insufficient_evidence"), alone).otherwise(made)
    return rows.withColumn("reasons", F.transform(F.array_sort(F.filter(chosen, lambda x: x.isNotNull())), lambda x: x.code))
