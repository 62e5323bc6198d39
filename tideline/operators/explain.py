"""Explanations of a profile: its ranked reasons as text, a short line, and what must be said beside it (V-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.rules import EXEMPT

#: The text of each reason, by category; the reserved reason has none and is never shown.
SUPPORT = {
    "window_agreement_support": "Recent and longer-window results point in the same direction.",
    "favorable_consensus_difference": "The selected line is more favorable than sportsbook consensus for this direction.",
    "positive_margin_support": "Recent average and/or median margin support this direction.",
}
CONTRADICTION = {
    "unfavorable_consensus_difference": "The selected line is less favorable than sportsbook consensus for this direction.",
    "negative_margin_support": "Margin evidence works against this direction.",
    "margin_measures_disagree": "Recent average and median results fall on opposite sides of the selected line.",
    "market_disagrees_with_history": "Current market context points in a different direction from the historical results.",
    "windows_disagree": "Recent and longer-window evidence point in different directions.",
}
QUALITY = {
    "stale_current_market": "The current market snapshot is stale. Line and price context may not reflect the current market.",
    "insufficient_book_coverage": "Fewer than 3 eligible sportsbooks offer this market. Cross-book confirmation is limited.",
    "push_heavy_sample": "A large share of recent games landed exactly on the line. Direction is less clear.",
    "one_sided_offering": "Only one side is offered across eligible sportsbooks. Cross-side comparison isn't available.",
    "source_unavailable": "The availability feed is currently unavailable. Availability context is limited.",
    "insufficient_l10_sample": "Fewer than 5 eligible recent games. Sample is too small to grade evidence.",
    "incomplete_historical_coverage": "Historical coverage is incomplete for this player. Longer-term evidence limited.",
    "unresolved_player_mapping": "Player identity is under review. Evidence cannot be graded yet.",
    "unresolved_event_mapping": "Game identity is under review. Evidence cannot be graded yet.",
    "no_current_market": "No current market is available. Evidence cannot be graded.",
    "postponed_game": "Game postponed. Evidence not applicable to this scheduled slot.",
    "canceled_game": "Game canceled.",
    "no_unique_consensus_line": "Eligible sportsbooks are evenly split on this line, so no single consensus line can be established.",
}
RESERVED = "abnormal_dispersion"
#: Full and compact labels of classes, tags of caps, and the mark of seeded history.
FULL = {"strong_over": "Strong Over Evidence", "moderate_over": "Moderate Over Evidence", "mixed": "Mixed Evidence", "moderate_under": "Moderate Under Evidence", "strong_under": "Strong Under Evidence", "insufficient_evidence": "Insufficient Evidence", "unavailable": "Unavailable"}
COMPACT = {"strong_over": "Over-leaning", "moderate_over": "Over-leaning", "mixed": "Mixed", "moderate_under": "Under-leaning", "strong_under": "Under-leaning", "insufficient_evidence": "Insufficient Evidence", "unavailable": "Unavailable"}
TAGS = {"stale_current_market": "stale market", "insufficient_book_coverage": "limited book coverage", "push_heavy_sample": "push-heavy recent sample", "market_disagrees_with_history": "market disagrees with history", "one_sided_offering": "one-sided offering"}
SEEDED = "Includes seeded historical closing lines"


def among(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def named(values: dict[str, str], key: Column, what: str) -> Column:
    """The value of a key; a key that has none fails the job."""
    return F.coalesce(F.try_element_at(among(values), key), F.raise_error(F.concat(F.lit(f"no {what} of "), F.coalesce(key, F.lit("null")))).cast("string"))


def explanations(profiles: DataFrame, seeded: Column, numeric: bool = False) -> DataFrame:
    """profiles with label, compact_line (the compact label, and the tag of the cap that binds), support, contradiction and
    quality (the texts of the reasons of that category, in their order, as a paragraph; null without any), texts (of
    all reasons), marker (null unless `seeded`) and disclosures.

    profiles(classification, quality_capped, cap, reasons). A class or reason without a text fails the job, and so does the
    reserved reason. numeric: whether the score is shown, which takes a second disclosure; the compact line never has it.
    """
    every = SUPPORT | CONTRADICTION | QUALITY
    texts = F.transform("reasons", lambda c: F.when(c == RESERVED, F.raise_error(F.lit(f"{RESERVED} is reserved")).cast("string")).otherwise(named(every, c, "text")))
    part = lambda kind: F.nullif(F.array_join(F.transform(F.filter("reasons", lambda c: c.isin(*kind)), lambda c: F.try_element_at(among(kind), c)), " "), F.lit(""))
    binds = F.col("quality_capped") & (F.col("cap") != "none")
    short = named(COMPACT, F.col("classification"), "compact label")
    line = F.when(binds, F.concat_ws(" — ", short, named(TAGS, F.col("cap"), "tag"))).otherwise(short)
    said = [F.lit(EXEMPT[0])] + ([F.lit(EXEMPT[1])] if numeric else [])
    return profiles.withColumns({"label": named(FULL, F.col("classification"), "label"), "compact_line": line, "support": part(SUPPORT), "contradiction": part(CONTRADICTION), "quality": part(QUALITY), "texts": texts, "marker": F.when(seeded, F.lit(SEEDED)), "disclosures": F.array(*said)})
