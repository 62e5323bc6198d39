"""Nested snapshots, incremental recomputation and distributed running totals, on small tables and by plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tideline.operators import prefix, recompute, seeding
from tideline.sources.files import PAYLOAD

T0 = dt.datetime(2026, 1, 1)


def snapshot(bookmakers, taken=T0):
    return (1, T0 + dt.timedelta(seconds=600), taken, ("e1", None, None, None, None, bookmakers))


def outcome(name, player, price, point):
    return (name, player, price, point, None)


SNAPSHOTS = f"snapshot_id int, boundary timestamp, taken_at timestamp, data struct<{','.join(c.strip().replace(' ', ':', 1) for c in PAYLOAD.split(', '))}>"
CLASSES = {"a": "sportsbook", "d": "dfs_pickem"}


def market(key, *outcomes):
    return (key, None, list(outcomes))


def book(key, *markets):
    return (key, key, None, list(markets))


def test_snapshots(spark):
    pts = "player_points"
    rows = [
        snapshot([
            book("a", market(pts, outcome("Over", "José Núñez", -110.9, 9.5), outcome("under ", "Jose Nunez", None, 9.5), outcome("OVER", "JOSE  NUNEZ", -105.0, 9.5), outcome("Over", " ", 1.0, 1.0), outcome("Over", "P", 1.0, None), outcome("Over", "P", 1.0, float("nan")), outcome("push", "P", 1.0, 2.0), outcome("Under", "Q", 120.0, 3.5)), market("other", outcome("Over", "P", 1.0, 1.0)), market(pts)),
            book("d", market(pts, outcome("Over", "P", 1.0, 1.0))), book("x", market(pts, outcome("Over", "P", 1.0, 1.0))), book("a"),
        ]),
        snapshot([book("a", market(pts, outcome("Over", "P", 1.0, 1.0)))], taken=T0 - dt.timedelta(seconds=60)),
        snapshot(None), snapshot([]),
    ]
    count = Observation("seeded")
    made = seeding.outcomes(spark.createDataFrame(rows, SNAPSHOTS), CLASSES, count=count)
    out = sorted((r.book, r.market, r.reason) for r in seeding.exclusions(made).collect())
    assert out == sorted([("a", pts, "missing_player_description"), ("a", pts, "missing_point"), ("a", pts, "missing_point"), ("a", pts, "missing_side"), ("a", "other", "unlaunched_market_key"), ("d", "", "dfs_pickem_excluded_from_sportsbook_consensus"), ("x", "", "unallowlisted_bookmaker_key")])
    assert (count.get["valid"], count.get["missing_point"], count.get["unlaunched_market_key"]) == (4, 2, 1)
    pairs = sorted((r.player, r.point, r.over_price, r.under_price) for r in seeding.closing_quotes(made).collect())
    assert pairs == [("JOSE  NUNEZ", 9.5, -105, 0), ("Q", 3.5, None, 120)]


def test_quarantine_takes_known_reasons_only(spark):
    rows = spark.createDataFrame([(1, "e", "b", "", "missing_point"), (1, "e", "b", "m", "missing_side")], "snapshot_id int, event_id string, book string, market string, reason string")
    assert sorted((r.run_id, r.market or "", r.reason) for r in seeding.quarantined(rows, "r").collect()) == [("r", "", "missing_point"), ("r", "m", "missing_side")]
    with pytest.raises(Exception, match="not a quarantine reason: odd"):
        seeding.quarantined(rows.withColumn("reason", F.lit("odd")), "r").collect()


def recomputable(spark, seed=0, games=60):
    r = random.Random(seed)
    stats, points, starts = [], [], []
    for g in range(games):
        starts.append((g, T0 + dt.timedelta(days=r.randrange(30))))
        for p in range(4):
            if r.random() < 0.7:
                stats.append((100 * g + p, g, p, "pts", float(r.randrange(20)), r.random() < 0.9))
                points.append((g, p, "pts", r.choice([None, 9.5, 10.0]), r.choice(["complete", "single_book", "no_closing_line"])))
    make = lambda s: spark.createDataFrame(s, "stat_id long, game long, player long, market string, value double, eligible boolean")
    return stats, make, spark.createDataFrame(points, "game long, player long, market string, closing_point double, coverage string"), spark.createDataFrame(starts, "game long, starts_at timestamp")


def test_drain_equals_computing_anew(spark):
    stats, make, points, starts = recomputable(spark)
    changed = [(i, g, p, m, v + 3 if g % 2 else v, e) for i, g, p, m, v, e in stats]
    old, new = make(stats), make(changed)
    graded = recompute.results(points, old)
    windowed = recompute.windows(graded, starts)
    jobs = [(f"q{g}", "game", g, T0 + dt.timedelta(seconds=g), None, None) for g in range(1, 60, 2)] + [("z", "game", 999, T0, None, None), ("y", "odd", 1, T0, None, None), ("done", "game", 2, T0, T0, "recomputed")]
    queue = spark.createDataFrame(jobs, "id string, kind string, entity long, observed_at timestamp, processed_at timestamp, note string")
    marked, after, win = recompute.drain(queue, points, new, starts, graded, windowed, F.lit(T0))
    anew = recompute.results(points, new)
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    assert same(after, anew) and same(win, recompute.windows(anew, starts)) and not same(graded, anew)
    notes = {r.id: r.note for r in marked.collect()}
    assert notes["z"] == notes["y"] == "no_eligible_source" and notes["done"] == "recomputed" and all(r.processed_at for r in marked.collect())
    again = recompute.drain(marked, points, new, starts, after, win, F.lit(T0))
    assert same(again[1], after) and same(again[2], win) and same(again[0], marked)
    two = recompute.drain(queue, points, new, starts, graded, windowed, F.lit(T0), most=2)[0]
    assert {r.id for r in two.where("processed_at IS NOT NULL").collect()} == {"done", "y", "z"}


def test_running_totals(spark):
    r = random.Random(1)
    rows = [(r.choice([None, *range(40)]), i, r.choice([None, -3, 0, 5, 10**12])) for i in range(500)]
    df = spark.createDataFrame(rows, "at long, id long, v long").repartition(5)
    total, want = 0, {}
    for a, i, v in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        total += v or 0
        want[i] = total
    for n in (1, 7, 100):
        got = prefix.running_total(df, "at", ["id"], F.col("v"), ranges=n)
        assert {x.id: x.total for x in got.collect()} == want and got.columns == ["at", "id", "v", "total"]
    assert prefix.running_total(df.limit(0), "at", ["id"], F.col("v"), ranges=4).count() == 0
    plan = prefix.running_total(df, "at", ["id"], F.col("v"), ranges=7)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_bounded_repair_equals_a_loop(spark):
    r = random.Random(2)
    for ceiling in (0, 39, 200, 900, 10**6):
        rows = [(i, r.random() < 0.3, r.random() < 0.2, r.choice(["eligible", "no_snapshot", None]), r.choice([None, 0, 12, 40, 55])) for i in range(60)]
        spent, want = 0, []
        for i, repaired, failed, capture, credits in rows:
            if not repaired:
                if spent + 40 > ceiling:
                    break
                if not failed:
                    spent += 40 if credits is None else credits
            want.append((i, "skipped" if repaired else "failed" if failed else "eligible" if capture == "eligible" else "close_capture_stale", spent))
        df = spark.createDataFrame(rows, "game long, repaired boolean, failed boolean, capture string, credits long").repartition(4)
        got = prefix.bounded_repair(df, "game", ceiling, ranges=9)
        assert sorted((x.game, x.outcome, x.spent) for x in got.collect()) == want
