"""Queries against their SQL on rows that small tables lack: times close to midnight, rows that tie, grains without a book."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalogue import FOLDER, rows

from tideline.operators import profiles
from tideline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture
def against_sql(spark, tmp_path):
    """changed(table=SELECT): copies of the tables with some replaced, and a comparison of a query with its SQL on them."""

    def changed(**selects):
        con = duckdb.connect()
        con.sql("SET timezone = 'UTC'")
        for t in TABLES:
            con.sql(f"COPY ({selects.get(t, 'SELECT * FROM {}').format(f"'{FOLDER}/{t}.parquet'")}) TO '{tmp_path}/{t}.parquet'")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        return lambda name: (rows(catalogue.queries()[name](spark, str(tmp_path)).toArrow()), rows(con.sql(catalogue.SQL[name]).to_arrow_table()))

    return changed


@pytest.mark.parametrize("name", ["l09_lifecycle", "t01_line_presence", "t03_event_presence"])
def test_polls_close_to_midnight(against_sql, name):
    """Seconds are rounded to the nearest, halves to even, and days before 1970 towards 1970."""
    near = "date_trunc('day', ts) + to_microseconds([86399400000, 86399500000, 86399999999, 500000, 0][1 + event_id % 5])"
    compared = against_sql(events=f"SELECT * REPLACE (CASE WHEN user_id % 7 = 0 THEN {near} - INTERVAL 55 YEAR ELSE {near} END AS ts) FROM {{}}")
    got, want = compared(name)
    assert got == want


@pytest.mark.parametrize("name", ["l09_lifecycle", "t01_line_presence", "t03_event_presence"])
def test_keys_with_nulls(against_sql, name):
    """A null user or type is no key: it never appears, also where only one poll is left to tell."""
    compared = against_sql(events="SELECT * REPLACE (CASE WHEN event_id >= 998 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 60 = 7 THEN NULL ELSE event_type END AS event_type) FROM {}")
    got, want = compared(name)
    assert got == want


@pytest.mark.parametrize("name", ["a03_epoch_differences", "d10_schedule", "h01_close_boundary", "l05_first_observed", "t06_watermark", "v01_board"])
def test_fractions_of_a_second(against_sql, name):
    compared = against_sql(orders="SELECT * REPLACE (o_orderdate + to_microseconds(o_orderkey % 4 * 250000) AS o_orderdate) FROM {}", lineitem="SELECT * REPLACE (l_shipdate + to_microseconds(l_partkey % 4 * 250000) AS l_shipdate) FROM {}")
    got, want = compared(name)
    assert got == want


def test_running_total_of_rows_that_tie(against_sql):
    """Rows of one time, order and line have one total; times are told apart within a second."""
    compared = against_sql(lineitem="SELECT * REPLACE (l_orderkey % 5 AS l_orderkey, l_shipdate + to_microseconds(l_partkey % 4 * 250000) AS l_shipdate) FROM {}")
    got, want = compared("w_running_total")
    assert got == want


def test_a_fresh_market_without_books(spark):
    """A grain that only other sources quote has no market, and no line of 0."""
    at = "TIMESTAMP '2024-03-01 00:00:00'"
    quotes = spark.sql(f"SELECT * FROM VALUES (1, 1, 'A', 7, 'over', 2.5D, 9.0D, false), (2, 1, 'A', 8, 'over', 2.5D, 9.0D, true) q(game, player, market, book, side, point, price, sportsbook)").withColumn("observed_at", F.expr(at))
    results = spark.sql("SELECT 1 AS player, 'A' AS market, id AS game, TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS at, 5.0D AS value, 1 AS version FROM range(20)")
    players = spark.sql("SELECT 1 AS player, true AS player_resolved")
    games = spark.sql(f"SELECT id AS game, 'scheduled' AS game_status, true AS event_resolved, {at} AS starts_at FROM range(3)")
    made = profiles.engine_v1(profiles.inputs(quotes, results, players, games, F.expr(at), gated=True, normalisers={"A": 3.0}))
    got = {r.game: (r.cause, r.line, r.score is None) for r in made.collect()}
    assert got == {1: ("no_current_market", None, True), 2: (None, 2.5, False)}
