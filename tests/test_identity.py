"""Mappings, persisted resolutions, players and events in context, watermarks and projections."""

import datetime as dt

import pytest

from tideline.operators import identity, presence, serving

T0 = dt.datetime(2026, 1, 1)
QUEUE = "candidate_ids array<int>, resolution string, reason string, created_at int"


def test_mapping_resolution(spark):
    grains = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (1, 11), (4, 12)], "player int, game int")
    players = spark.createDataFrame([(1, "approved"), (1, "unresolved"), (2, "unresolved")], "player int, state string")
    games = spark.createDataFrame([(10, "approved"), (11, "rejected")], "game int, state string")
    pq = spark.createDataFrame([([2, 3], "closed", "old", 1), ([2], "open", "newer", 9), ([2], "open", "newest", 10), ([1], "open", "moot", 1)], QUEUE)
    gq = spark.createDataFrame([([11], "closed", "time", 1)], QUEUE)
    got = {(r.player, r.game): (r.player_resolved, r.event_resolved, r.queue_reason) for r in identity.mapping_resolution(grains, players, games, pq, gq).collect()}
    assert got == {(1, 10): (True, True, None), (2, 10): (False, True, "newer"), (3, 11): (False, False, "old"), (1, 11): (True, False, "time"), (4, 12): (False, False, "unmatched")}


def test_persisted_resolutions(spark):
    outcomes = spark.createDataFrame([(1, 100, None), (2, 100, None), (3, 100, None), (4, 100, None), (5, 100, None), (6, None, "no_candidate"), (7, None, "no_candidate"), (8, None, "x")], "event_id int, game_id int, reason string")
    mappings = spark.createDataFrame([(2, 100, "approved"), (3, None, "unresolved"), (4, 200, "approved"), (5, 300, "unresolved"), (8, 7, "approved"), (99, 1, "approved")], "event_id int, game_id int, state string")
    queue = spark.createDataFrame([(6, "open", "r"), (7, "closed", "r")], "event_id int, resolution string, reason string")
    got = {r.event_id: (r.action, r.game_id, r.state, r.reason) for r in identity.persisted_resolutions(outcomes, mappings, queue).collect()}
    assert got == {1: ("inserted", 100, "approved", None), 2: ("unchanged", 100, "approved", None), 3: ("updated", 100, "approved", None), 4: ("clash", 200, "approved", None), 5: ("clash", 300, "approved", None), 6: ("already_queued", None, None, "no_candidate"), 7: ("queued", None, None, "no_candidate"), 8: ("queued", 7, "approved", "x")}


def test_players_in_context(spark):
    provider = [("a", "José Núñez", None), ("b", "Jose Nunez", "t1"), ("c", "JOSE NUNEZ", "t2"), ("d", "jose nunez", "t9"), ("e", "Ann Lee", None), ("f", "Bo", None), ("g", "Twin", None), ("h", "Nobody", None), ("i", "!!", None), ("j", "Whoever", None), ("k", "Lone", "t2")]
    rows = spark.createDataFrame(provider, "provider_id string, name string, provider_team string")
    reviewed = spark.createDataFrame([("j", 9)], "provider_id string, player_id int")
    aliases = spark.createDataFrame([(1, "Jose Núñez", True), (2, "Ann-Lee", True), (3, "ann lee", True), (4, "bo", False), (6, "Lone", True)], "player_id int, name string, active boolean")
    players = spark.createDataFrame([(1, "x", 1), (4, "Bo", 1), (5, "Twin", 1), (7, "twin", 2), (6, "y", None)], "player_id int, name string, team int")
    teams = spark.createDataFrame([("t1", 1), ("t2", 2)], "provider_team string, team int")
    got = {r.provider_id: (r.outcome, r.player_id) for r in identity.reconcile_players_in_context(rows, reviewed, aliases, players, teams).collect()}
    assert got == {"a": ("reviewed_alias", 1), "b": ("reviewed_alias", 1), "c": ("missing_team_context", 1), "d": ("missing_team_context", 1), "e": ("alias_conflict", None), "f": ("proposed_for_review", 4), "g": ("ambiguous_name", None), "h": ("unmatched", None), "i": ("unmatched", None), "j": ("reviewed_mapping", 9), "k": ("reviewed_alias", 6)}


def test_events_by_any_name(spark):
    teams = spark.createDataFrame([("A", "Los Angeles Stars", "Stars", "LAS", "Los Angeles"), ("B", "New York Owls", "Owls", "NYO", "New York"), ("C", "New York Cats", "Cats", "NYC", "New York")], "team string, full_name string, name string, abbreviation string, city string")
    games = spark.createDataFrame([(1, "A", "B", T0)], "game_id int, home string, away string, at timestamp")
    events = spark.createDataFrame([("x", "los angeles stars", "NYO", T0), ("y", "Stars", "New York", T0), ("z", "Owls", "LAS", T0), ("w", "Stars", "Owls", T0 + dt.timedelta(seconds=900))], "event_id string, home string, away string, at timestamp")
    got = {r.event_id: (r.outcome, r.game_id) for r in identity.reconcile_provider_events(events, games, teams).collect()}
    assert got == {"x": ("approved_exact", 1), "y": ("unresolved_team", None), "z": ("reversed_pair", None), "w": ("approved_near", 1)}


def test_watermarks(spark):
    current = spark.createDataFrame([("e", "s1", 10, 1, 5), ("e", "s2", None, None, None), ("e", "s3", 10, 1, 5), ("e", "s4", 10, 1, 5), ("e", "s5", 10, 1, 5)], "endpoint string, scope string, completed_at int, run_id int, row_count int")
    runs = spark.createDataFrame([("e", "s1", "complete", 10, 2, 7), ("e", "s2", "complete", 3, 2, 7), ("e", "s3", "partial", 20, 2, 7), ("e", "s4", "complete", 9, 2, 7), ("other", "s5", "complete", 99, 2, 7)], "endpoint string, scope string, state string, completed_at int, run_id int, row_count int")
    got = {r.scope: (r.completed_at, r.run_id, r.previous_at, r.refusal) for r in presence.advanced(current, runs, ["endpoint", "scope"]).collect()}
    assert got == {"s1": (10, 2, 10, None), "s2": (3, 2, None, None), "s3": (10, 1, None, "not_complete"), "s4": (10, 1, None, "older_than_watermark"), "s5": (10, 1, None, "no_run")}


def test_projection_at_any_depth(spark):
    rows = spark.createDataFrame([], "a int, b struct<c:array<struct<d:map<string,struct<secret:int>>>>>")
    assert serving.projected(rows, ["a", "b"], ["other"]).columns == ["a", "b"]
    for bad in (["secret"], ["d"], ["c"], ["a"]):
        with pytest.raises(ValueError):
            serving.projected(rows, ["a", "b"], bad)
