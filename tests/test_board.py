"""Explanations, bundles, the board and its gates, and recovery of unmapped games."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.operators import board, explain, rules

T0 = dt.datetime(2026, 1, 10)
ago = lambda s: T0 - dt.timedelta(seconds=s)


def test_explanations(spark):
    rows = [(1, "moderate_over", True, "push_heavy_sample", ["positive_margin_support", "window_agreement_support", "windows_disagree", "push_heavy_sample"], True), (2, "mixed", False, "none", [], False), (3, "unavailable", False, "none", ["no_current_market"], False)]
    schema = "id int, classification string, quality_capped boolean, cap string, reasons array<string>, seeded boolean"
    got = {r.id: r for r in explain.explanations(spark.createDataFrame(rows, schema), F.col("seeded"), numeric=True).collect()}
    assert got[1].compact_line == "Over-leaning — push-heavy recent sample" and got[1].label == "Moderate Over Evidence" and got[1].marker == explain.SEEDED
    assert got[1].support == "Recent average and/or median margin support this direction. Recent and longer-window results point in the same direction."
    assert got[1].contradiction.startswith("Recent and longer-window evidence") and got[1].quality.startswith("A large share") and len(got[1].texts) == 4
    assert (got[2].compact_line, got[2].support, got[2].quality, got[2].texts, got[2].marker) == ("Mixed", None, None, [], None)
    assert got[3].quality == "No current market is available. Evidence cannot be graded." and got[2].disclosures == list(rules.EXEMPT)
    for bad in (("odd", []), ("mixed", ["abnormal_dispersion"]), ("mixed", ["no such reason"])):
        with pytest.raises(Exception, match="reserved|no .* of"):
            explain.explanations(spark.createDataFrame([(1, bad[0], False, "none", bad[1], False)], schema), F.lit(False)).collect()


def test_no_explanation_has_forbidden_copy(spark):
    texts = [*(explain.SUPPORT | explain.CONTRADICTION | explain.QUALITY).values(), *explain.FULL.values(), *explain.COMPACT.values(), *explain.TAGS.values(), explain.SEEDED, *rules.EXEMPT]
    found = spark.createDataFrame([(t,) for t in texts], "t string").where(F.size(rules.forbidden_copy(F.col("t"))) > 0)
    assert found.count() == 0


def test_bundles(spark):
    profiles = spark.createDataFrame([(1,), (2,), (3,)], "profile_id int")
    windows = [(p, w, n) for p in (1, 3, 9) for n, w in enumerate(board.WINDOWS)]
    make = lambda rows: spark.createDataFrame(rows, "profile_id int, window string, n int")
    sources = spark.createDataFrame([(1, 2, "b", "B"), (1, 1, "a", "A"), (2, 1, "c", "C"), (9, 1, "d", "D")], "profile_id int, ordinal int, source_id string, title string")
    series = spark.createDataFrame([(1, k, g) for k, g in ((3, 30), (1, 10), (2, 20))], "profile_id int, ordinal int, game int")
    got = {r.profile_id: r for r in board.bundles(profiles, make(windows), sources, series).collect()}
    assert [s.source_id for s in got[1].sources] == ["a", "b"] and [s.game for s in got[1].series] == [10, 20, 30] and got[1].windows["L10"].n == 1
    assert (got[2].status, got[2].windows, got[2].sources, got[2].series) == ("unavailable_not_persisted", None, None, None)
    assert got[3].status == "available" and got[3].sources == [] and set(got) == {1, 2, 3}
    with pytest.raises(Exception, match="incomplete set of windows: 1"):
        board.bundles(profiles, make([w for w in windows if w[:2] != (1, "L20")]), sources, series).collect()


def table(spark):
    profiles = spark.createDataFrame([(10, 1, "pts", ago(60), 0.5), (10, 2, "pts", ago(60), -0.9), (10, 3, "pts", ago(60), 0.1), (11, 1, "pts", ago(60), None), (11, 2, "pts", ago(7200), 0.7), (10, 99, "pts", ago(60), 1.0)], "game int, player int, market string, reference_at timestamp, score double")
    players = spark.createDataFrame([(1, "Ann", "A"), (2, "Bo", "B"), (3, "Cy", None)], "player int, name string, team string")
    teams = spark.createDataFrame([("A", "Stars", "Aville"), ("B", "Owls", None)], "team string, title string, city string")
    games = spark.createDataFrame([(10, "A", "B", T0)], "game int, home string, away string, starts_at timestamp")
    market = spark.createDataFrame([(10, 1, "pts", 1, 3, 1.0, 2.0), (10, 1, "pts", 2, 5, 1.5, 2.5)], "game int, player int, market string, version int, books int, low double, high double")
    seen = spark.createDataFrame([(g, p, "pts", ago(s)) for g, p, s in ((10, 1, 100), (10, 1, 30), (10, 2, 3600), (10, 3, 3661), (11, 1, 61), (11, 2, 7300), (11, 2, 10), (10, 99, 100))], "game int, player int, market string, observed_at timestamp")
    return board.board_rows(profiles, players, teams, games, market, seen)


def test_board(spark):
    rows = {(r.game, r.player): r for r in table(spark).collect()}
    one, two = rows[10, 1], rows[10, 2]
    assert set(rows) == {(10, 1), (10, 2), (10, 3), (11, 1), (11, 2)}
    assert (one.is_home, one.team, one.team_city, one.opponent_city, one.books, one.low) == (True, "Stars", "Aville", "Owls", 5, 1.5)
    assert (two.is_home, two.team_city, two.opponent_city, two.books) == (False, "Owls", "Aville", 0) and rows[10, 3].team == ""
    assert one.line_observed_at == ago(100) and rows[11, 2].line_observed_at == ago(7300)  # later ones can't rejuvenate
    now = F.lit(T0)
    lag = lambda *r: spark.createDataFrame(list(r), "at timestamp, readable boolean")
    got = board.board(table(spark), now, lag((ago(345_600), True)))
    assert [(r.game, r.player, r.display_age) for r in got.collect()] == [(10, 2, 3600.0), (10, 1, 100.0), (11, 1, 61.0)] and not set(got.columns) & set(board.HIDDEN)
    assert board.board(table(spark), now, lag((ago(345_601), True))).count() == 0 and board.board(table(spark), now, lag((None, False))).count() == 0
    assert board.board(table(spark), now, lag((None, True)), most=1).count() == 1 and board.board(table(spark), now, lag()).count() == 3


def test_research_freshness(spark):
    rows = spark.createDataFrame([(1, ago(3600)), (2, ago(3601)), (3, None), (4, T0 + dt.timedelta(seconds=5))], "k int, at timestamp")
    age, state = board.research_freshness(F.col("at"), F.lit(T0))
    assert {r.k: (r.a, r.s) for r in rows.select("k", age.alias("a"), state.alias("s")).collect()} == {1: (3600, "fresh"), 2: (3601, "aged_historical"), 3: (None, "unknown"), 4: (0, "fresh")}


def test_unmapped(spark):
    games = spark.createDataFrame([(1, "A", "B", True, T0), (2, "A", "C", True, T0), (3, "D", "E", True, T0), (4, None, "B", False, T0), (5, "F", "G", False, T0), (6, "H", "I", False, T0)], "game int, home string, away string, in_recent_n boolean, probe_at timestamp")
    events = spark.createDataFrame([("e1", "A", "B", None), ("e2", "A", "C", ago(5)), ("e3", "A", "C", ago(-9)), ("e4", "F", "G", ago(5)), ("e5", "F", "G", ago(-5)), ("e6", "H", "I", None), ("e7", "H", "I", T0)], "event_id string, home string, away string, at timestamp")
    made = board.unmapped(games, events)
    got = {r.game: (r.population[0], r.event_id, r.candidates) for r in made.collect()}
    assert got == {1: ("b", "e1", 1), 2: ("b", "e2", 2), 3: ("c", None, 0), 4: ("c", None, 0), 5: ("c", None, 2), 6: ("c", None, 2)}
    assert tuple(board.recovery(made).first()) == (6, 2, 4, 2 / 6, 1) and tuple(board.recovery(made.limit(0)).first()) == (0, 0, 0, 0.0, 0)
