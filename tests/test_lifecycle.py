"""Lifecycles: batch, stream and a loop over random histories give the same rows; movement events and confidence."""

import random

from pyspark.sql import functions as F

from tideline.operators import lifecycle
from tideline.streaming import lifecycle as stream

POLLS = "event int, poll long, succeeded boolean, unavailable boolean, started boolean"


def histories(seed=0, events=4, lines=15, polls=25):
    r = random.Random(seed)
    out_polls, out_seen = [], []
    for e in range(events):
        start = r.randint(10, 30)
        flags = [(r.random() > 0.2, r.random() < 0.1, p >= start) for p in range(polls)]
        out_polls += [(e, p, *f) for p, f in enumerate(flags)]
        for n in range(lines):
            rate = r.choice([0.3, 0.6, 0.9])
            out_seen += [(f"{e}-{n}", e, p) for p in range(polls) if r.random() < rate]
    return out_polls, out_seen


def looped(polls, seen):
    """The state machine, poll by poll."""
    here = {(k, p) for k, _, p in seen}
    out = {}
    for key, event in sorted({(k, e) for k, e, _ in seen}):
        line = None
        for e, p, ok, gone, started in polls:
            if e != event:
                continue
            present, tells = (key, p) in here, ok and not gone
            if line is None:
                if present:
                    line = {"generation": 1, "first_seen": p, "last_seen": p, "state": "present", "omissions": 0, "confirmed_at": None}
            elif present and tells and line["state"] == "confirmed_removed":
                out[key, line["generation"]] = dict(line)
                line = {"generation": line["generation"] + 1, "first_seen": p, "last_seen": p, "state": "present", "omissions": 0, "confirmed_at": None}
            elif present:
                line["last_seen"] = p
                if tells:
                    line.update(state="present", omissions=0)
            elif tells and not started and line["state"] != "confirmed_removed":
                line["omissions"] += 1
                line["state"] = "single_omission" if line["omissions"] == 1 else "confirmed_removed"
                line["confirmed_at"] = p if line["omissions"] == 2 else None
        if line:
            out[key, line["generation"]] = dict(line)
    return out


def rows_of(rows):
    return {(r["key"], r["generation"]): {c: r[c] for c in ("generation", "first_seen", "last_seen", "state", "omissions", "confirmed_at")} for r in rows}


def test_batch_equals_loop(spark):
    for seed in range(3):
        polls, seen = histories(seed)
        got = lifecycle.lifecycle(spark.createDataFrame(seen + seen[:5], "key string, event int, poll long"), spark.createDataFrame(polls, POLLS), ["key", "event"], ["event"])
        want = looped(polls, seen)
        assert rows_of(got.collect()) == want and max(g for _, g in want) >= 2
        assert {r["state"] for r in want.values()} == {"present", "single_omission", "confirmed_removed"}


def test_no_row_for_an_absent_poll(spark):
    polls, seen = histories()
    got = lifecycle.lifecycle(spark.createDataFrame(seen, "key string, event int, poll long"), spark.createDataFrame(polls, POLLS), ["key", "event"], ["event"])
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    empty = lifecycle.lifecycle(spark.createDataFrame([], "key string, event int, poll long"), spark.createDataFrame(polls, POLLS), ["key", "event"], ["event"])
    assert empty.count() == 0


def test_stream_equals_loop(spark, tmp_path):
    """In batches of some polls each, with an old poll again in a later batch."""
    polls, seen = histories(7, events=2, lines=6, polls=12)
    here = {(k, p) for k, _, p in seen}
    rows = [(k, p, (k, p) in here, ok, gone, started) for k, ev in sorted({(k, e) for k, e, _ in seen}) for e, p, ok, gone, started in polls if e == ev]
    schema = "key string, poll long, present boolean, succeeded boolean, unavailable boolean, started boolean"
    for n, part in enumerate(([r for r in rows if r[1] < 5], [r for r in rows if r[1] >= 3 and r[1] < 9], [r for r in rows if r[1] >= 9])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    latest = {}

    def take(batch, _):
        for r in batch.collect():
            latest[r["key"], r["generation"]] = r

    before = spark.conf.get(stream.PROVIDER[0])
    spark.conf.set(*stream.PROVIDER)
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = stream.lifecycle_stream(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "at")).foreachBatch(take).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    finally:
        spark.conf.set(stream.PROVIDER[0], before)
    assert rows_of(latest.values()) == looped(polls, seen)


OFFER = "event int, player int, side string, point double, price int, provider_time int"


def test_movements(spark):
    prior = [(1, 1, "over", 9.5, -110, 1), (1, 1, "under", 9.5, -110, 1), (1, 2, "over", 4.5, 100, 1), (1, 3, "over", 1.5, 100, 1), (1, 4, "over", 2.5, 1, 1), (1, 4, "over", 3.5, 1, 1), (2, 5, "over", 1.5, 100, 1), (1, None, "over", 1.5, 1, 1), (3, 8, "under", 7.5, 5, 1)]
    current = [(1, 1, "over", 9.5, -120, 2), (1, 1, "under", 9.5, -110, 2), (1, 2, "over", 5.5, 105, 2), (1, 3, "over", 1.5, 100, 1), (1, 4, "over", 4.5, 1, 1), (1, None, "over", 2.5, 1, 1), (3, 8, "under", 7.5, 6, 1), (3, 9, "over", 7.5, 6, 1)]
    context = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, True)], "event int, produced boolean, succeeded boolean")
    got = lifecycle.movements(spark.createDataFrame(prior, OFFER), spark.createDataFrame(current, OFFER), context, ["event", "player"], ["event"])
    rows = sorted((r.player, r.side, r.point, r.type, r.confidence, r.prior_point, r.current_point) for r in got.collect())
    assert rows == sorted([
        (1, "over", 9.5, "over_price_changed", "high", 9.5, 9.5), (1, "under", 9.5, "provider_timestamp_changed", "high", 9.5, 9.5),
        (2, "over", 4.5, "side_removed", "high", 4.5, None), (2, "over", 5.5, "side_added", "high", None, 5.5), (2, "over", 5.5, "point_changed", "high", 4.5, 5.5),
        (4, "over", 2.5, "side_removed", "high", 2.5, None), (4, "over", 3.5, "side_removed", "high", 3.5, None), (4, "over", 4.5, "side_added", "high", None, 4.5),
        (5, "over", 1.5, "side_removed", "low", 1.5, None), (8, "under", 7.5, "under_price_changed", "high", 7.5, 7.5), (9, "over", 7.5, "side_added", "low", None, 7.5),
    ])
    linked = got.where(F.col("type") == "point_changed").first()
    assert (linked.prior_price, linked.current_price) == (100, 105)
