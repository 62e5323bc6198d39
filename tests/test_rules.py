"""Orders of rules, copy, shapes and canonical forms; cursors, ledger and linked tables."""

import itertools
import json
import threading

import pytest
from pyspark.sql import functions as F

from tideline.operators import rules
from tideline.sources import landing

STAT = "duplicate boolean, player int, game int, game_status string, minutes_status string, team string, home_team string, away_team string, season int, game_season int, supported boolean"


def test_each_rung_of_eligibility(spark):
    fine = [False, 1, 2, "final", "played", "A", "A", "B", 2025, 2025, True]
    breaks = [(0, True, "quarantined", "duplicate_source_key"), (1, None, "quarantined", "missing_player"), (2, None, "quarantined", "missing_game"), (3, "unknown", "quarantined", "unknown_game_status"), (4, "unresolved_non_numeric", "unresolved_minutes", None), (5, "C", "quarantined", "team_not_in_game"), (8, 2024, "quarantined", "season_mismatch"), (10, False, "quarantined", "unsupported_competition_team"), (3, "live", "live_or_non_final", None), (4, "dnp", "non_participation", None)]
    rows, want = [tuple(fine)], [("eligible", None)]
    for k, (at, value, state, reason) in enumerate(breaks):
        row = list(fine)
        for later, v, _, _ in reversed(breaks[k:]):  # all later rungs hold as well
            row[later] = v
        row[at] = value
        rows.append(tuple(row))
        want.append((state, reason))
    got = rules.stat_eligibility(spark.createDataFrame(rows, STAT).coalesce(1)).collect()
    assert [(r.state, r.quarantine_reason) for r in got] == want


def test_invalidations(spark):
    rows = [(1, 10, 20, "material", True), (2, None, 21, "material", None), (3, 11, None, "metadata_only", True)]
    got = rules.stat_invalidations(spark.createDataFrame(rows, "stat_id int, player int, game int, kind string, minutes_changed boolean"))
    assert sorted(map(tuple, got.collect())) == sorted([(1, "player_game_stat", "1", "material_stat_change"), (1, "player_game_stat", "1", "minutes_state_change"), (1, "internal_player", "10", "material_stat_change"), (1, "internal_game", "20", "material_stat_change"), (2, "player_game_stat", "2", "material_stat_change"), (2, "internal_game", "21", "material_stat_change")])


def test_copy(spark):
    texts = {
        "A LOCK, unlocked": ["lock"], "free \n money!": ["free money"], "you can't miss": ["can't miss"], "ev and roi": [], "EV, +EV and ROI": ["EV", "+EV", "ROI"], "a guaranteed winner": ["guaranteed", "guaranteed winner"],
        "risk-free": ["risk-free"], "not guarantees or predicted probabilities": ["probabilities", "guarantees"], rules.EXEMPT[0]: [], rules.EXEMPT[0] + " ": ["probabilities", "guarantees"], rules.EXEMPT[1]: [], None: [], "unproven winners": [],
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(rules.forbidden_copy(F.col("t"))).collect()] == list(texts.values())


def test_shapes(spark):
    bodies = {
        "no": "not json", "null": None, "list": "[1]", "none": "{}", "text": '{"bookmakers": "x"}', "empty": '{"bookmakers": []}', "fine": '{"bookmakers": [{"key": "a", "markets": [{"key": "m", "outcomes": []}, {"key": "n"}]}]}',
        "many": '{"bookmakers": [1, {"key": "", "markets": 3}, {"key": "a", "markets": [null, {"key": 5, "outcomes": {}}, {"key": "m", "outcomes": null}]}]}',
    }
    df = spark.createDataFrame(list(bodies.items()), "id string, body string")
    got = sorted((r.id, r.path, r.expected, r.found) for r in rules.shape_violations(df, "id", "body").collect())
    b = "$.bookmakers"
    assert got == sorted([("no", "$", "object", "missing"), ("null", "$", "object", "missing"), ("list", "$", "object", "array"), ("none", b, "array", "missing"), ("text", b, "array", "string"), ("many", f"{b}[0]", "object", "bigint"), ("many", f"{b}[1].key", "string", "string"), ("many", f"{b}[1].markets", "array", "bigint"), ("many", f"{b}[2].markets[0]", "object", "void"), ("many", f"{b}[2].markets[1].key", "string", "bigint"), ("many", f"{b}[2].markets[1].outcomes", "array", "object"), ("many", f"{b}[2].markets[2].outcomes", "array", "void")])
    state = {r.id: (r.state, r.path, r.violations) for r in rules.payload_shape(df, "id", "body").collect()}
    assert state["fine"] == ("valid", None, 0) and state["empty"] == ("valid_empty", None, 0) and state["many"] == ("schema_drift", f"{b}[0]", 7) and state["none"][:2] == ("schema_drift", b)


def test_canonical_form(spark):
    groups = [
        ['{"b": 1, "a": [1.0, {"y": "é", "x": null}]}', '{ "a":[1,{"x":null,"y":"é"}], "b":1.0 }', '{"b":1e0,"a":[1.00,{"y":"\\u00e9","x":null}]}'],
        ['{"a": "1.0 and \\"2.0\\" {b:3.0}"}', '{"a":"1.0 and \\"2.0\\" {b:3.0}"}'], ['{"a": 1.05}', '{"a":1.050}'], ["[]"], ["{}"], ['{"a": "1"}'], ['{"a": 10}', '{"a": 10.0}'], ['{"a": -2.0}', '{"a":-2}'],
    ]
    rows = [(k, t) for k, g in enumerate(groups) for t in g]
    got = {}
    for k, h in spark.createDataFrame(rows, "k int, t string").select("k", rules.content_hash(F.col("t"))).collect():
        got.setdefault(k, set()).add(h)
    assert all(len(h) == 1 for h in got.values()) and len(set.union(*got.values())) == len(groups)
    assert spark.createDataFrame([("no json",), (None,)], "t string").select(rules.content_hash(F.col("t")).alias("h")).where("h IS NOT NULL").count() == 0


def test_cursor_chains(spark):
    rows = [
        ("whole", None, "p2", None, 5), ("whole", "p2", "p3", None, 5), ("whole", "p3", "", None, 1), ("whole", "p2", "p3", None, 5), ("whole", "stray", None, None, 9),
        ("broken", None, "b2", None, 2), ("broken", "b2", None, "rate_limited", None), ("gone", None, "x", None, 2), ("circle", None, "c", None, 1), ("circle", "c", "d", None, 1), ("circle", "d", "c", None, 1), ("headless", "h", None, None, 1),
        *[("long", str(i) if i else None, str(i + 1), None, 1) for i in range(40)],
    ]
    df = spark.createDataFrame(rows, "chain string, cursor string, next_cursor string, failure string, n_rows long")
    got = {r.chain: (r.state, r.cursors, r.row_count) for r in landing.follow_cursors(df, 20).collect()}
    assert got["whole"] == ("complete", [None, "p2", "p3"], 11) and got["broken"] == ("rate_limited", [None], 2)
    assert got["gone"] == ("missing_page", [None], 2) and got["headless"] == ("missing_page", [], 0)
    assert got["circle"][0] == got["long"][0] == "partial_pagination" and len(got["circle"][1]) == len(got["long"][1]) == 20


def test_ledger(spark, tmp_path):
    ledger = landing.Ledger(spark, str(tmp_path / "runs"))
    assert ledger.open("r1", "t0") and not ledger.open("r1", "t9") and ledger.open("r2", "t1")
    won, gate = [], threading.Barrier(8)

    def end(k):
        gate.wait()
        if landing.create_once(spark, f"{ledger.folder}/r1.ended", json.dumps({"run_id": "r1", "state": "complete", "completed_at": str(k)})):
            won.append(str(k))

    threads = [threading.Thread(target=end, args=(k,)) for k in range(8)]
    for t in itertools.chain(threads):
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and not ledger.close("r1", "partial", "t5")
    got = {r.run_id: (r.state, r.started_at, r.completed_at) for r in ledger.runs().collect()}
    assert got == {"r1": ("complete", "t0", won[0]), "r2": ("running", "t1", None)}
    for bad in (("r2", "running", "t"), ("r2", "complete", ""), ("r9", "complete", "t")):
        with pytest.raises(ValueError):
            ledger.close(*bad)


QUOTES = "snapshot_id int, book string, player string, side string, point double, price int, seen long"


def test_linked_tables_survive_a_failure_between_writes(spark, tmp_path):
    folder = str(tmp_path / "linked")
    batches = [spark.createDataFrame([(n, "b", p, s, 1.5, 100 + k, k) for p in "xy" for s in ("over", "under") for k in range(2)], QUOTES) for n in range(3)]
    tables = landing.snapshot_tables()
    for failing in tables:
        def broken(rows, failing=failing):
            raise RuntimeError(failing)

        with pytest.raises(RuntimeError):
            landing.linked_sink(folder, tables | {failing: broken})(batches[0], 0)
    good = landing.linked_sink(folder, tables)
    good(batches[0], 0)
    good(batches[0], 0)  # the stream tries again after the mark
    good(batches[1], 1)
    with pytest.raises(RuntimeError):
        landing.linked_sink(folder, tables | {"raw": broken})(batches[2], 2)
    count = {n: landing.read_linked(spark, folder, n).count() for n in tables}
    assert count == {"snapshots": 2, "offerings": 8, "raw": 16}
    raw, offered = (landing.read_linked(spark, folder, n) for n in ("raw", "offerings"))
    met = raw.join(offered.select("snapshot_id", "offering", "player", F.col("price").alias("last")), ["snapshot_id", "offering"]).collect()
    assert len(met) == 16 and {r.last for r in met} == {101} and len({(r.snapshot_id, r.offering) for r in met}) == 8
    good(batches[2], 2)
    assert landing.read_linked(spark, folder, "raw").count() == 24
