"""Labels, ties and published worked examples of the operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import scalar as S
from tideline.operators import evidence, history, identity, market, presence, serving
from tideline.sources import files
from tideline.streaming import presence as stream

QUOTES = "game int, player int, market string, book int, side string, point double, price double, observed_at timestamp, sportsbook boolean"
T0 = dt.datetime(2026, 1, 1)


def quotes(spark, rows):
    return spark.createDataFrame([(1, p, "pts", b, s, x, c, T0 + dt.timedelta(seconds=k), ok) for p, b, s, x, c, k, ok in rows], QUOTES)


def test_consensus_labels_do_not_depend_on_order(spark):
    rows = [(1, 1, "over", 19.5, 1.0, 0, True), (1, 2, "over", 20.0, 1.0, 0, True), (1, 3, "over", 20.0, 1.0, 0, True), (2, 1, "over", 5.5, 1.0, 0, True), (2, 1, "over", 4.5, 1.0, 0, True), (3, 1, "over", 1.5, 1.0, 0, True), (3, 2, "over", 2.5, 1.0, 0, True), (4, 9, "over", 1.5, 1.0, 0, False)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = {r["player"]: (r["line"], r["method"], r["coverage"]) for r in market.consensus(quotes(spark, rows).repartition(3)).collect()}
        assert got == {1: (20.0, "unique_modal", "complete"), 2: (4.5, "single_book", "single_book"), 3: (None, "tied_no_unique_mode", "unresolved_consensus"), 4: (None, "no_eligible_source", "no_line")}


def test_gated_row_keeps_its_grain(spark):
    rows = quotes(spark, [(1, 1, "over", 1.5, 1.0, 0, True), (2, 1, "over", 1.5, 1.0, 86_000, True)])
    got = {r["player"]: (r["freshness"], r["method"]) for r in market.market_row(rows, rows, F.lit(T0 + dt.timedelta(seconds=86_050))).collect()}
    assert got == {1: ("unavailable", "no_eligible_source"), 2: ("fresh", "single_book")}


def test_rounding_is_half_up_on_the_double(spark):
    got = spark.sql("SELECT -2.5D AS x").select(S.rounded(F.col("x"), 0)).first()[0]
    assert got == -2.0


@pytest.mark.parametrize(("text", "want"), [("--", ("unresolved", None)), ("", ("unresolved", None)), (None, ("unresolved", None)), ("0", ("dnp", None)), ("12:30", ("played", 12.5)), ("12:75", ("unresolved", None)), ("33", ("played", 33.0)), ("-4", ("unresolved", None))])
def test_minutes(spark, text, want):
    state, value = S.minutes(F.col("t"))
    assert tuple(spark.createDataFrame([(text,)], "t string").select(state, value).first()) == want


def test_names(spark):
    got = spark.createDataFrame([("  José  O'Neil-Díaz Jr. ",)], "n string").select(S.normal_name(F.col("n"))).first()[0]
    assert got == "jose o neil diaz jr"
    pairs = [("Lakers", "Los Angeles Lakers", True), ("Los Angeles", "Los Angeles Lakers", True), ("Angeles", "Los Angeles Lakers", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean").select(S.team_match(F.col("a"), F.col("b")), "want").collect()
    assert all(a == b for a, b in rows)


def test_worked_profile(spark):
    row = dict(a5=4, b5=1, e5=0, n5=5, a10=8, b10=2, e10=0, n10=10, a20=14, b20=5, e20=1, n20=20, ns=65, es=3, avg10=2.6, med10=2.5, avgs=1.8, meds=2.0, line=19.5, consensus=20.0, books=8, books_at_line=2, net=0.0, m=6.0, one_sided="neither", span_days=90)
    row |= {"as": 42, "bs": 20}
    got = evidence.reasons(evidence.profile(spark.createDataFrame([row]))).first()
    assert abs(got["score"] - 0.4997) < 1e-4 and got["classification"] == "moderate_over"
    assert got["reasons"][:1] == ["window_agreement_support"]
    # Rules of the method, one change of the row at a time: class, cap, direction, reasons that must be there.
    flat = {"a5": 5, "b5": 0, "a10": 9, "b10": 1, "a20": 18, "b20": 2, "as": 60, "bs": 5, "avg10": 6.0, "med10": 6.0, "avgs": 6.0, "meds": 6.0, "consensus": 24.0, "books_at_line": 8}
    cases = [
        (flat, "strong_over", "none", "over", {"positive_margin_support", "favorable_consensus_difference"}),
        (flat | {"books": 2, "books_at_line": 2}, "moderate_over", "insufficient_book_coverage", "over", {"insufficient_book_coverage"}),
        (flat | {"one_sided": "over_only"}, "moderate_over", "one_sided_offering", "over", {"one_sided_offering"}),
        (flat | {"freshness": "stale"}, "moderate_over", "stale_current_market", "over", {"stale_current_market"}),
        (flat | {"e10": 4}, "moderate_over", "push_heavy_sample", "over", {"push_heavy_sample"}),
        # Market against history is a cap, not a mixed profile.
        (flat | {"consensus": 12.0}, "moderate_over", "market_disagrees_with_history", "over", {"market_disagrees_with_history", "unfavorable_consensus_difference"}),
        (flat | {"a10": 1, "b10": 9}, "mixed", "none", None, {"windows_disagree"}),
        (flat | {"as": 20, "bs": 21}, "strong_over", "none", "over", set()),  # the season's sign is no clause
        (flat | {"span_days": None}, "insufficient_evidence", "none", None, {"incomplete_historical_coverage"}),
        (flat | {"n10": 4, "ns": 4}, "insufficient_evidence", "none", None, {"insufficient_l10_sample", "incomplete_historical_coverage"}),
        (flat | {"game_status": "postponed", "books": 0}, "unavailable", "none", None, {"postponed_game"}),
        (flat | {"player_resolved": False, "event_resolved": False}, "unavailable", "none", None, {"unresolved_player_mapping"}),
        (flat | {"freshness": "stale", "books": 0}, "unavailable", "none", None, {"no_current_market"}),
        (flat | {"consensus": None, "availability": "source_unavailable"}, "unavailable", "none", None, {"no_unique_consensus_line", "source_unavailable"}),
    ]
    base = row | {"game_status": "scheduled", "player_resolved": True, "event_resolved": True, "freshness": "fresh", "availability": "present", "k": 0}
    schema = ", ".join(f"`{k}` {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int'}" for k, v in base.items())
    rows = spark.createDataFrame([tuple((base | c[0] | {"k": i}).values()) for i, c in enumerate(cases)], schema)
    for r in evidence.reasons(evidence.profile(rows)).collect():
        _, want, cap, direction, codes = cases[r["k"]]
        assert (r["classification"], r["cap"], r["direction"]) == (want, cap, direction), (r["k"], r["score"], r["caps"])
        assert codes <= set(r["reasons"]), (r["k"], r["reasons"])
        assert (r["score"] is None) == (want in ("unavailable", "insufficient_evidence"))
        assert want not in ("unavailable", "insufficient_evidence") or codes == set(r["reasons"])
    signs = spark.createDataFrame([(1.0, 1.0, -1.0, -1.0), (1.0, 1.0, 1.0, 0.0), (-1.0, -1.0, -1.0, -1.0), (0.0, -0.5, 0.2, 0.2)], "a double, b double, c double, d double")
    got = [round(x[0], 6) for x in signs.select(evidence.window_agreement([signs[c] for c in "abcd"])).collect()]
    assert got == [-1.0, 0.75, -1.0, 0.1]


def test_close_boundary_and_capture(spark):
    rows = spark.createDataFrame([("final", T0, None), ("postponed", T0, None), ("final", T0, T0 + dt.timedelta(seconds=60))], "s string, a timestamp, b timestamp")
    source, at = history.close_boundary(F.col("s"), F.col("a"), F.col("b"))
    got = [(r[0], r[1] and (r[1] - T0).total_seconds()) for r in rows.select(source, at).collect()]
    assert got == [("scheduled_plus_grace", 900), ("none", None), ("actual_start", 60)]


GAMES = "player int, market string, ts int, value double"


def test_streak_that_begins_with_a_push_is_one(spark):
    rows = spark.createDataFrame([(1, "m", 5 - i, v) for i, v in enumerate([10.0, 10.0, 12.0])], GAMES)
    margin, outcome = history.line_result(F.col("value"), F.lit(10.0))
    real = history.real_line_windows(rows.select("*", margin.alias("margin"), outcome.alias("outcome"), F.lit(False).alias("single_book")), ["player", "market"], [F.desc("ts")]).first()
    plain = history.threshold_windows(rows, ["player", "market"], [F.desc("ts")], F.col("value"), F.lit(10.0)).first()
    assert (real.season.streak, plain.season.streak) == (1, 2)
    assert (real.L5.label, real.season.label, real.L5.requested, real.season.requested) == ("incomplete", "complete", 5, 3)


def test_threshold_windows_compare_values_as_they_are(spark):
    """Less than a hundredth above the threshold is above; a key without values has no data."""
    rows = spark.createDataFrame([(1, "m", i, 10.004) for i in range(4)] + [(2, "m", 1, None), (3, "m", 2, 9.0), (3, "m", 1, 11.0), (3, "m", 3, None)], GAMES)
    got = {r.player: r for r in history.threshold_windows(rows, ["player", "market"], [F.desc("ts")], F.col("value"), F.lit(10.0)).collect()}
    one = got[1].L5
    assert (one.n, one.above, one.equal, one.avg, one.avg_minus, one.median_minus, one.streak_of, one.streak, one.label) == (4, 4, 0, 10.004, 0.004, 0.004, "above", 4, "incomplete")
    none = got[2].season
    assert (none.n, none.avg, none.median_minus, none.streak_of, none.streak, none.label) == (0, None, None, None, None, "no_data") and got[2].L10.label == "no_data"
    assert (got[3].season.streak_of, got[3].season.streak, got[3].season.avg, got[3].season.label) == ("below", 1, 10.0, "complete")
    games = history.evaluated(rows, ["player", "market"], [F.desc("ts")], F.col("value"), F.lit(10.0)).where("player = 3").collect()
    assert {(r.ts, r.number, r.outcome) for r in games} == {(2, 1, "below"), (1, 2, "above")}


def test_presence_batch_and_transition_agree(spark):
    seen = [1, 2, 5, 6, 7, 9]
    s = spark.createDataFrame([("k", p) for p in seen], "key string, poll long")
    polls = spark.range(1, 10).withColumnRenamed("id", "poll")
    got = [(r["state"], r["generation"]) for r in presence.line_presence(presence.polled(s, ["key"], polls), ["key"]).orderBy("poll").collect()]
    state, want = ("present", 0, 1), []
    for p in range(1, 10):
        state = stream.step(*state, p in seen)
        want.append((state[0], state[2]))
    assert got == want and want[-1] == ("present", 2)


def test_presence_stream(spark, tmp_path):
    rows = [("k", p, p in (1, 2, 5)) for p in range(1, 6)]
    spark.createDataFrame(rows, "key string, poll long, present boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, poll long, present boolean").parquet(str(tmp_path / "in"))
    q = stream.presence_stream(source).writeStream.format("memory").queryName("presence_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [tuple(r) for r in spark.table("presence_out").orderBy("poll").collect()]
    assert got == [("k", 1, "present", 1), ("k", 2, "present", 1), ("k", 3, "single_omission", 1), ("k", 4, "confirmed_removed", 1), ("k", 5, "present", 2)]


def test_reconciliation_outcomes(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "home int, away int, at timestamp"
    events = spark.createDataFrame([(1, 1, 2, at(0)), (2, 2, 1, at(0)), (3, 3, 3, at(0)), (4, 5, 6, at(0)), (5, 7, 8, at(500)), (6, 7, 8, at(9000)), (7, None, 8, at(0))], f"event_id int, {schema}")
    games = spark.createDataFrame([(11, 1, 2, at(0)), (12, 7, 8, at(0))], f"game_id int, {schema}")
    got = {r[0]: (r[1], r[2]) for r in identity.reconcile_events(events, games).collect()}
    assert got == {1: ("approved_exact", 11), 2: ("reversed_pair", None), 3: ("same_team", None), 4: ("no_candidate", None), 5: ("approved_near", 12), 6: ("time_window_exceeded", None), 7: ("unresolved_team", None)}


def test_copy_safety_word_boundaries(spark):
    got = spark.createDataFrame([("A sure lock. Unlocked.",)], "t string").select(serving.copy_violations(F.col("t"), ["lock", "unlock"], ["sure l"])).first()[0]
    assert got == ["lock", "sure l"]


def test_payload_source_and_drift(spark, tmp_path):
    good = '{"id":"e1","commence_time":"2026-01-01T00:00:00Z","bookmakers":[{"key":"b","markets":[{"key":"pts","outcomes":[{"name":"Over","description":"P","price":1.9,"point":20.5}]}]}]}'
    (tmp_path / "a.json").write_text(good)
    (tmp_path / "b.json").write_text('{"id":"e2","bookmakers":"oops"}')
    (tmp_path / "c.json").write_text('{"id":"e3","bookmakers":[]}')
    got = {(r["event_id"], r["drift"], r["point"]) for r in files.quote_payloads(spark, str(tmp_path)).collect()}
    assert ("e1", False, 20.5) in got and ("e3", False, None) in got and any(r[1] for r in got)


def test_sink_is_idempotent(spark, tmp_path):
    for _ in range(2):
        files.append_run(spark.range(3), str(tmp_path / "t"), "r1")
    files.append_run(spark.range(2), str(tmp_path / "t"), "r2")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
