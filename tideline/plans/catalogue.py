"""All registered queries over the driver tables, each with its SQL.

The tables play the roles of the domain: lineitem is quotes (grain: part and return flag; book: supplier; point:
discount; side: line status), events is a player's graded history, orders is versioned rows. A query applies one
operator, to whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import scalar as S
from tideline.operators import deal, evidence, history, identity, ingest, market, presence, serving
from tideline.sources.files import Tables, insert_missing

QUERIES, SQL = {}, {}
GRAIN = market.GRAIN

#: Adapters as SQL, used by several oracles.
Q = "q AS (SELECT l_partkey % 10 AS game, l_partkey AS player, l_returnflag AS market, l_suppkey AS book, CASE WHEN l_linestatus = 'O' THEN 'over' ELSE 'under' END AS side, l_discount AS point, l_extendedprice AS price, l_shipdate AS observed_at, s_nationkey % 5 <> 0 AS sportsbook FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def mode_sql(source: str, keys: str, where: str = "sportsbook", book: str = "book") -> str:
    return f"""v AS (SELECT {keys}, point, count(DISTINCT {book}) AS n FROM {source} WHERE {where} GROUP BY {keys}, point),
    e AS (SELECT {keys}, count(DISTINCT {book}) AS voters FROM {source} WHERE {where} GROUP BY {keys}),
    t AS (SELECT {keys}, max(n) AS top, min(point) AS least FROM v GROUP BY {keys}),
    m AS (SELECT {keys}, any_value(top) AS votes, any_value(least) AS least, count(*) AS ties, max(point) AS v, any_value(voters) AS voters FROM v JOIN t USING ({keys}) JOIN e USING ({keys}) WHERE n = top GROUP BY {keys}),
    c AS (SELECT {keys}, CASE WHEN voters = 1 THEN m.least WHEN ties = 1 THEN m.v END AS line, CASE WHEN voters IS NULL THEN 'no_eligible_source' WHEN voters = 1 THEN 'single_book' WHEN ties = 1 THEN 'unique_modal' ELSE 'tied_no_unique_mode' END AS method,
    CASE WHEN voters IS NULL THEN 'no_line' WHEN voters = 1 THEN 'single_book' WHEN ties = 1 THEN 'complete' ELSE 'unresolved_consensus' END AS coverage, coalesce(voters, 0) AS books, CASE WHEN voters = 1 OR ties = 1 THEN votes END AS books_at_point FROM (SELECT DISTINCT {keys} FROM {source}) LEFT JOIN m USING ({keys}))"""


G = "game, player, market"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return add


def quotes(t: Tables):
    """lineitem with its book's class; supplier is a dimension, which AQE broadcasts where its size allows."""
    books = t.supplier.select(F.col("s_suppkey").alias("book"), (F.col("s_nationkey") % 5 != 0).alias("sportsbook"))
    rows = t.lineitem.select(
        (F.col("l_partkey") % 10).alias("game"), F.col("l_partkey").alias("player"), F.col("l_returnflag").alias("market"), F.col("l_suppkey").alias("book"), F.when(F.col("l_linestatus") == "O", "over").otherwise("under").alias("side"), F.col("l_discount").alias("point"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("observed_at")
    )
    return rows.join(books, "book")


def played(t: Tables):
    return t.events.select(F.col("user_id").alias("player"), F.col("event_type").alias("market"), "ts", "value", "event_id")


NOW = "TIMESTAMP '2001-06-01 00:00:00'"

# ---- current market -----------------------------------------------------------------------------------------------


@query("l01_line_consensus", f"WITH {Q}, {mode_sql('q', G)} SELECT {G}, line, method, coverage, books FROM c")
def _(t):
    return market.consensus(quotes(t))


@query("l02_line_range", f"WITH {Q} SELECT {G}, min(point) AS low, max(point) AS high FROM q WHERE sportsbook GROUP BY {G}")
def _(t):
    return market.line_range(quotes(t))


@query("l03_point_distribution", f"WITH {Q} SELECT {G}, point, count(DISTINCT book) AS book_count FROM q WHERE sportsbook GROUP BY {G}, point")
def _(t):
    return market.distribution(quotes(t))


@query("l04_eligible_books", f"WITH {Q} SELECT {G}, count(DISTINCT book) AS books FROM q WHERE sportsbook GROUP BY {G}")
def _(t):
    return quotes(t).where("sportsbook").groupBy(*GRAIN).agg(F.count_distinct("book").alias("books"))


F1 = f"f AS (SELECT {G}, book, min(struct_pack(o := observed_at, p := point)) AS s FROM q WHERE sportsbook GROUP BY {G}, book), g AS (SELECT {G}, book, s.o AS observed_at, s.p AS point, true AS sportsbook FROM f)"


@query("l05_first_observed", f"WITH {Q}, {F1}, {mode_sql('g', G)} SELECT {G}, line, method, epoch(min(g.observed_at))::BIGINT AS first_at FROM c LEFT JOIN g USING ({G}) WHERE c.line IS NULL OR g.point = c.line GROUP BY {G}, line, method".replace("epoch(min(g.observed_at))::BIGINT", "CASE WHEN line IS NOT NULL THEN epoch(min(g.observed_at))::BIGINT END"))
def _(t):
    return market.first_observed(quotes(t)).withColumn("first_at", S.whole_seconds(F.col("first_at")))


@query("l06_movement_summary", f"""WITH {Q}, x AS (SELECT *, observed_at >= TIMESTAMP '1999-06-01' AS late FROM q)
    SELECT {G}, max(point) FILTER (WHERE sportsbook) - min(point) FILTER (WHERE sportsbook) AS net, count(*) FILTER (WHERE side = 'over' AND late) AS side_added, count(*) FILTER (WHERE side = 'under' AND late) AS side_removed FROM x GROUP BY {G}""")
def _(t):
    rows = quotes(t)
    events = rows.where("observed_at >= TIMESTAMP '1999-06-01'").select(*GRAIN, F.when(F.col("side") == "over", "side_added").otherwise("side_removed").alias("type"))
    ends = rows.select(*GRAIN).distinct().join(market.line_range(rows), GRAIN, "left")
    now, before = (ends.select(*GRAIN, F.col(c).alias("line")) for c in ("high", "low"))
    return market.movement_summary(now, before, events).select(*GRAIN, "net", "side_added", "side_removed")


@query("m01_offerings", f"WITH {Q}, s AS (SELECT {G}, book, point, side, max(struct_pack(o := observed_at, p := price)).p AS price FROM q GROUP BY {G}, book, point, side) SELECT {G}, book, point, max(price) FILTER (WHERE side = 'over') AS over_price, max(price) FILTER (WHERE side = 'under') AS under_price FROM s GROUP BY {G}, book, point")
def _(t):
    return market.offerings(quotes(t)).select(*GRAIN, "book", "point", "over_price", "under_price")


@query("m02_one_sided", f"WITH {Q}, s AS (SELECT {G}, bool_or(side = 'over') AS o, bool_or(side = 'under') AS u, count(DISTINCT (book, point)) AS n FROM q GROUP BY {G}) SELECT {G}, CASE WHEN o AND NOT u THEN 'over_only' WHEN u AND NOT o THEN 'under_only' ELSE 'neither' END AS one_sided, n FROM s")
def _(t):
    return market.book_detail(market.offerings(quotes(t))).select(*GRAIN, "one_sided", F.size("detail").cast("long").alias("n"))


@query("m03_best_price", f"WITH {Q}, b AS (SELECT {G}, point, side, max(price) AS best_price, count(DISTINCT book) AS books FROM q WHERE sportsbook GROUP BY {G}, point, side) SELECT {G}, point, side, best_price, min(book) FILTER (WHERE price = best_price) AS best_book, books FROM b JOIN (SELECT * FROM q WHERE sportsbook) USING ({G}, point, side) GROUP BY {G}, point, side, best_price, books")
def _(t):
    return market.best_price(quotes(t))


AGE = f"floor(epoch({NOW}) - epoch(max(ts)) + 0.5)"


@query("m04_freshness", "WITH a AS (SELECT user_id, event_type, greatest(0, floor(epoch(TIMESTAMP '2024-01-31') - epoch(max(ts)) + 0.5)) AS age FROM events GROUP BY ALL) SELECT user_id, event_type, CASE WHEN age <= 90 THEN 'fresh' WHEN age <= 300 THEN 'aging' WHEN age <= 900 THEN 'stale' ELSE 'unavailable' END AS freshness FROM a")
def _(t):
    age = S.age_rounded(F.lit("2024-01-31").cast("timestamp"), F.max("ts").cast("timestamp"))
    return t.events.groupBy("user_id", "event_type").agg(age.alias("age")).select("user_id", "event_type", market.freshness(F.col("age"), F.lit(True), F.lit(False)).alias("freshness"))


GATE = f"l AS (SELECT {G}, greatest(0, floor(epoch({NOW}) - epoch(max(observed_at)) + 0.5)) AS age FROM q GROUP BY {G}), fresh AS (SELECT q.* FROM q JOIN l USING ({G}) WHERE age <= 300)"


@query("m06_market_row_gated", f"WITH {Q}, {GATE}, {mode_sql('fresh', G)}, r AS (SELECT {G}, min(point) AS low, max(point) AS high FROM fresh WHERE sportsbook GROUP BY {G}) SELECT {G}, CASE WHEN age <= 90 THEN 'fresh' WHEN age <= 300 THEN 'aging' WHEN age <= 900 THEN 'stale' ELSE 'unavailable' END AS freshness, line, coalesce(method, 'no_eligible_source') AS method, coalesce(books, 0) AS books, low, high FROM l LEFT JOIN c USING ({G}) LEFT JOIN r USING ({G})")
def _(t):
    rows = quotes(t)
    return market.market_row(rows, None, F.expr(NOW)).select(*GRAIN, "freshness", "line", "method", "books", "low", "high")


@query("m07_market_row_neutral", f"WITH {Q}, {mode_sql('q', G)}, r AS (SELECT {G}, min(point) AS low, max(point) AS high FROM q WHERE sportsbook GROUP BY {G}) SELECT {G}, line, method, coverage, books, low, high FROM c LEFT JOIN r USING ({G})")
def _(t):
    rows = quotes(t)
    return market.market_row(rows, None, F.expr(NOW), gated=False).select(*GRAIN, "line", "method", "coverage", "books", "low", "high")


@query("m10_feed_freshness", "WITH a AS (SELECT event_id, epoch(TIMESTAMP '2024-01-15') - epoch(ts) AS age, event_type = 'error' AS bad FROM events) SELECT event_id, CASE WHEN bad THEN 'failed_latest_poll' WHEN age <= 600 THEN 'fresh' WHEN age <= 1800 THEN 'aging' ELSE 'stale' END AS freshness FROM a")
def _(t):
    age = S.age_seconds(F.lit("2024-01-15").cast("timestamp"), F.col("ts").cast("timestamp"))
    return t.events.select("event_id", market.feed_freshness(age, F.col("event_type") == "error").alias("freshness"))


@query("e17_freshness_v2", "WITH a AS (SELECT event_id, epoch(TIMESTAMP '2024-01-15') - epoch(ts) AS age, event_id % 7 AS books FROM events) SELECT event_id, CASE WHEN books = 0 THEN 'absent' WHEN age <= 900 THEN 'fresh' WHEN age <= 1800 THEN 'aging' WHEN age <= 3600 THEN 'stale_present' ELSE 'beyond_horizon' END AS freshness FROM a")
def _(t):
    age = S.age_seconds(F.lit("2024-01-15").cast("timestamp"), F.col("ts").cast("timestamp"))
    return t.events.select("event_id", market.freshness_v2(F.col("event_id") % 7, age).alias("freshness"))


D4 = "player, market, book, side, point"


@query("d04_duplicate_collapse", f"""WITH {Q}, g AS (SELECT {D4}, count(*) AS duplicates, count(DISTINCT price) = 1 AS good, min(price) AS price FROM q GROUP BY {D4}),
    l AS (SELECT player, market, book, side, count(DISTINCT point) FILTER (WHERE good) AS points FROM g GROUP BY ALL), s AS (SELECT player, market, book, point, bool_or(good AND side = 'over') AS o, bool_or(good AND side = 'under') AS u FROM g GROUP BY ALL)
    SELECT {D4}, duplicates, CASE WHEN good THEN price END AS price, CASE WHEN NOT good THEN 'quarantined' WHEN points > 1 THEN 'multi_line' WHEN o AND u THEN 'two_sided_complete' WHEN o THEN 'over_only' ELSE 'under_only' END AS state FROM g JOIN l USING (player, market, book, side) JOIN s USING (player, market, book, point)""")
def _(t):
    return market.collapse_duplicates(quotes(t), D4.split(", "), ["player", "market", "book", "side"])


# ---- closing lines and history ------------------------------------------------------------------------------------


@query("h01_close_boundary", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'none' WHEN o_orderkey % 3 = 0 THEN 'actual_start' ELSE 'scheduled_plus_grace' END AS source, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderkey % 3 = 0 THEN epoch(o_orderdate)::BIGINT + 60 ELSE epoch(o_orderdate)::BIGINT + 900 END AS boundary FROM orders")
def _(t):
    at = F.col("o_orderdate").cast("timestamp")
    source, boundary = history.close_boundary(F.when(F.col("o_orderstatus") == "F", "postponed").otherwise("final"), at, F.when(F.col("o_orderkey") % 3 == 0, at + F.expr("INTERVAL 60 SECONDS")))
    return t.orders.select("o_orderkey", source.alias("source"), S.whole_seconds(boundary).alias("boundary"))


@query("h02_capture_state", "WITH a AS (SELECT event_id, ts, date_trunc('hour', ts) + INTERVAL 30 MINUTE AS b, event_type FROM events) SELECT event_id, CASE WHEN event_type = 'error' THEN 'no_snapshot' WHEN ts > b OR floor(epoch(b) - epoch(ts) + 0.5) > 600 THEN 'close_capture_stale' ELSE 'eligible' END AS state FROM a")
def _(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", history.capture_state(F.when(F.col("event_type") != "error", ts), F.date_trunc("hour", ts) + F.expr("INTERVAL 30 MINUTES")).alias("state"))


@query("h04_closing_point", f"""WITH {Q}, {mode_sql('q', G, "sportsbook AND side = 'over'")} SELECT {G}, line AS closing_point, method, CASE coverage WHEN 'no_line' THEN 'no_closing_line' WHEN 'unresolved_consensus' THEN 'unresolved_closing_consensus' ELSE coverage END AS coverage, books, books_at_point FROM c""")
def _(t):
    return history.closing_points(quotes(t).withColumn("eligible", F.col("sportsbook") & (F.col("side") == "over")), GRAIN)


@query("h06_line_result", "WITH a AS (SELECT event_id, floor((value - 50.5) * 100 + 0.5) / 100 AS margin FROM events) SELECT event_id, margin, CASE WHEN margin > 0 THEN 'over' WHEN margin < 0 THEN 'under' ELSE 'push' END AS outcome FROM a")
def _(t):
    margin, outcome = history.line_result(F.col("value"), F.lit(50.5))
    return t.events.select("event_id", margin.alias("margin"), outcome.alias("outcome"))


@query("h07_results_backfill", f"""WITH {Q}, {mode_sql('q', G)}, p AS (SELECT p_partkey AS player, p_size::DOUBLE / 500 AS stat FROM part), a AS (SELECT {G}, floor((stat - line) * 100 + 0.5) / 100 AS margin FROM c JOIN p USING (player) WHERE line IS NOT NULL)
    SELECT {G}, margin, CASE WHEN margin > 0 THEN 'over' WHEN margin < 0 THEN 'under' ELSE 'push' END AS outcome FROM a""")
def _(t):
    stats = t.part.select(F.col("p_partkey").alias("player"), (F.col("p_size").cast("double") / 500).alias("stat"))
    margin, outcome = history.line_result(F.col("stat"), F.col("line"))
    return market.consensus(quotes(t)).where("line is not null").join(stats, "player").select(*GRAIN, margin.alias("margin"), outcome.alias("outcome"))


def played_sql(outcome: str, more: str = "") -> str:
    """Graded games of events, numbered from the newest, with the newest outcome of each player and market."""
    return f"""a AS (SELECT user_id AS player, event_type AS market, value AS v, {more}row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    f AS (SELECT *, first(o) OVER (PARTITION BY player, market ORDER BY rn) AS first_o FROM (SELECT *, {outcome} AS o FROM a)), w(w, wanted) AS (VALUES ('L5', 5), ('L10', 10), ('L20', 20), ('season', NULL))"""


def four(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def mean_sql(x: str) -> str:
    """Summed from the newest game on."""
    return f"list_reduce(list({x} ORDER BY rn), lambda p, q: p + q) / count(*)"


def threshold_sql(line: str = "50.0::DOUBLE") -> str:
    return f"""WITH {played_sql(f"CASE WHEN v > {line} THEN 'above' WHEN v < {line} THEN 'below' ELSE 'equal' END")},
    g AS (SELECT player, market, w AS "window", wanted, count(*) AS n, count(*) FILTER (WHERE o = 'above') AS above, count(*) FILTER (WHERE o = 'equal') AS equal, count(*) FILTER (WHERE o = 'below') AS below, {four(mean_sql('v'))} AS avg, {four('median(v)')} AS median, least(coalesce(min(rn) FILTER (WHERE o <> first_o) - 1, count(*)), count(*)) AS streak, any_value(first_o) AS streak_of
      FROM f JOIN w ON wanted IS NULL OR rn <= wanted GROUP BY player, market, w, wanted)
    SELECT player, market, "window", n, coalesce(wanted, n) AS requested, above, equal, below, avg, median, {four(f'avg - {line}')} AS avg_minus, {four(f'median - {line}')} AS median_minus, streak_of, streak, CASE WHEN n < wanted THEN 'incomplete' ELSE 'complete' END AS label FROM g"""


REAL_SQL = f"""WITH {played_sql("CASE WHEN m > 0 THEN 'over' WHEN m < 0 THEN 'under' ELSE 'push' END", "floor((value - 50.0::DOUBLE) * 100 + 0.5) / 100 AS m, event_id % 11 = 0 AS single, ")},
    g AS (SELECT player, market, w AS "window", wanted, count(*) AS n, count(*) FILTER (WHERE o = 'over') AS over, count(*) FILTER (WHERE o = 'under') AS under, count(*) FILTER (WHERE o = 'push') AS push, {four(mean_sql('m'))} AS avg_margin, {four('median(m)')} AS median_margin, {four(mean_sql('v'))} AS avg_value, {four('median(v)')} AS median_value,
      CASE WHEN any_value(first_o) = 'push' THEN 1 ELSE least(coalesce(min(rn) FILTER (WHERE o <> first_o) - 1, count(*)), count(*)) END AS streak, any_value(first_o) AS streak_of, bool_or(single) AS single FROM f JOIN w ON wanted IS NULL OR rn <= wanted GROUP BY player, market, w, wanted)
    SELECT player, market, "window", n, coalesce(wanted, n) AS requested, over, under, push, CASE WHEN over + under > 0 THEN {four('over / (over + under)')} END AS over_rate, avg_margin, median_margin, avg_value, median_value, streak_of, streak, CASE WHEN n < wanted THEN 'incomplete' WHEN single THEN 'single_book' ELSE 'complete' END AS label FROM g"""

def newest():
    return [F.desc("ts"), F.desc("event_id")]


@query("h08_real_line_windows", REAL_SQL)
def _(t):
    margin, outcome = history.line_result(F.col("value"), F.lit(50.0))
    rows = played(t).select("*", margin.alias("margin"), outcome.alias("outcome"), (F.col("event_id") % 11 == 0).alias("single_book"))
    return history.one_each(history.real_line_windows(rows, ["player", "market"], newest()), ["player", "market"])


@query("h09_threshold_windows", threshold_sql())
def _(t):
    return history.one_each(history.threshold_windows(played(t), ["player", "market"], newest(), F.col("value"), F.lit(50.0)), ["player", "market"])


@query("h09_games_evaluated", "SELECT user_id AS player, event_type AS market, event_id, CASE WHEN value > 50 THEN 'above' WHEN value < 50 THEN 'below' ELSE 'equal' END AS outcome, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS number FROM events")
def _(t):
    return history.evaluated(played(t), ["player", "market"], newest(), F.col("value"), F.lit(50.0)).select("player", "market", "event_id", "outcome", "number")


@query("h13_historical_coverage", "SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS earliest, count(*) AS n, bool_or(event_type = 'error') AS backfilled, date_diff('day', min(ts)::DATE, max(ts)::DATE) >= 30 AS covered FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(S.day_text(F.min("ts")).alias("earliest"), F.count("*").alias("n"), F.bool_or(F.col("event_type") == "error").alias("backfilled"), (F.datediff(F.max("ts"), F.min("ts")) >= 30).alias("covered"))


@query("w01_latest_version", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(t):
    return history.latest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("w02_last_n", "SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 10")
def _(t):
    return history.numbered(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).where("rn <= 10").select("o_custkey", "o_orderkey", "rn")


@query("h16_series", "SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value, o_orderstatus <> 'P' AS eligible FROM orders")
def _(t):
    return history.series(t.orders.select("o_custkey", "o_orderkey"), t.orders.where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("value")), ["o_custkey", "o_orderkey"]).select("o_custkey", "o_orderkey", "value", "eligible")


@query("h19_invalidation_fanout", "SELECT DISTINCT o_custkey AS game, o_orderkey AS player FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def _(t):
    stats = t.orders.select(F.col("o_custkey").alias("game"), F.col("o_orderkey").alias("player"), F.col("o_orderkey").alias("stat_id"))
    changes = t.orders.where("o_orderpriority = '1-URGENT'").select(F.lit("stat").alias("kind"), F.col("o_orderkey").alias("entity")).union(t.customer.where("c_nationkey = 3").select(F.lit("game"), "c_custkey"))
    return history.affected(changes, stats)


@query("s11_versioned_upsert", "WITH c AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), i AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0) SELECT o_orderkey, CASE WHEN i.o_orderkey IS NULL THEN c.o_totalprice ELSE i.o_totalprice END AS o_totalprice, CASE WHEN c.o_orderkey IS NULL THEN 'inserted' WHEN i.o_orderkey IS NULL THEN 'kept' WHEN c.o_totalprice IS NOT DISTINCT FROM i.o_totalprice THEN 'unchanged' ELSE 'updated' END AS action FROM c FULL JOIN i USING (o_orderkey)")
def _(t):
    incoming = t.orders.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") + 1).alias("o_totalprice"))
    return history.merge_versions(t.orders.where("o_orderkey % 3 <> 0"), incoming, ["o_orderkey"], ["o_totalprice"])


@query("s10_insert_missing", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return insert_missing(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


# ---- relational base ----------------------------------------------------------------------------------------------


@query("p03_usable_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice IS NOT NULL AND o_orderpriority <> '5-LOW'")
def _(t):
    return t.orders.where(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").isNotNull() & (F.col("o_orderpriority") != "5-LOW")).select("o_orderkey")


@query("p09_lookahead_window", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-10 03:00:00'")
def _(t):
    return t.events.where("ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-10 03:00:00'").select("event_id")


@query("p12_text_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND p_type IN ('ECONOMY', 'SMALL')")
def _(t):
    return t.part.where(F.lower("p_name").contains("ring") & F.col("p_type").isin("ECONOMY", "SMALL")).select("p_partkey", "p_name")


@query("p14_redaction", "SELECT p_partkey, p_brand, CAST(NULL AS DOUBLE) AS p_retailprice FROM part")
def _(t):
    return serving.redacted(t.part.select("p_partkey", "p_brand", "p_retailprice"), {"book_detail": ["p_retailprice"], "windows": ["p_brand"]}, {"windows"})


@query("j03_three_way_join", "SELECT l_orderkey, o_custkey, p_brand, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def _(t):
    # Dealt by order, to as many tasks as there are rows for; the sums are of one order and need no further exchange.
    n = deal.tasks(t.lineitem)
    branded = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand", "l_quantity")
    rows = branded.repartition(n, "l_orderkey").join(t.orders.select("o_orderkey", "o_custkey").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_orderkey", "o_custkey", "p_brand").agg(F.sum("l_quantity").alias("qty"))


@query("j06_conditional_key_join", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey ELSE (c_nationkey + 1) % 25 END")
def _(t):
    key = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey")).otherwise((F.col("c_nationkey") + 1) % 25)
    return t.customer.withColumn("k", key).join(t.nation, F.col("k") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("j07_lateral_top1", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def _(t):
    return t.customer.join(t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("j08_as_of", "WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view') SELECT l.event_id, l.user_id, r.value AS observed FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts")
def _(t):
    ev = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    left, right = ev.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), ev.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), "value")
    return serving.as_of(left, right, ["user_id"], "ts", "seen", "value").select("event_id", "user_id", "observed")


@query("j09_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def _(t):
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j10_existence_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has FROM customer")
def _(t):
    keys = t.orders.where("o_orderstatus = 'P'").select("o_custkey").distinct()
    return t.customer.join(keys, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("has"))


@query("j11_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j16_nearest_unique", "WITH d AS (SELECT l.event_id, r.event_id AS rid, abs(epoch_us(l.ts) - epoch_us(r.ts)) / 1e6 AS delta FROM events l JOIN events r USING (user_id) WHERE l.event_type = 'purchase' AND r.event_type = 'view'), m AS (SELECT event_id, min(delta) AS delta FROM d GROUP BY event_id) SELECT event_id, CASE WHEN count(*) = 1 THEN min(rid) END AS nearest FROM d JOIN m USING (event_id, delta) GROUP BY event_id")
def _(t):
    ev = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    left, right = ev.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("rid"), F.col("ts").alias("other"))
    return identity.nearest_unique(left, right, "user_id", "ts", "other", "rid").select("event_id", "nearest")


@query("j20_batched_children", "SELECT o_orderkey, count(l_linenumber) AS n, coalesce(string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR), '') AS suppliers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(t):
    kids = t.lineitem.groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"), F.array_join(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("suppliers"))
    return t.orders.join(kids, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("suppliers", F.lit("")).alias("suppliers"))


@query("a01_counts", "SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS kinds, count(DISTINCT l_suppkey) AS books FROM lineitem")
def _(t):
    return t.lineitem.agg(F.count("*").alias("n"), F.count_distinct("l_orderkey", "l_linenumber").alias("kinds"), F.count_distinct("l_suppkey").alias("books"))


@query("a02_filtered_counts", "SELECT l_shipmode, n, big FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS big FROM lineitem GROUP BY 1)")
def _(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("big"))


@query("a04_percentiles", "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS p50, percentile_cont(0.95) WITHIN GROUP (ORDER BY l_quantity) AS p95 FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.5).alias("p50"), F.percentile("l_quantity", 0.95).alias("p95"))


@query("a06_checksum", "SELECT o_custkey, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS checksum FROM orders GROUP BY o_custkey")
def _(t):
    ids = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return t.orders.groupBy("o_custkey").agg(F.md5(F.array_join(ids, ",").cast("binary")).alias("checksum"))


@query("a07_bucketed_having", "SELECT CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS bucket, o_custkey % 50 AS slot, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) >= 5")
def _(t):
    bucket = F.when(F.col("o_totalprice") < 100000, "low").when(F.col("o_totalprice") < 300000, "mid").otherwise("high")
    return t.orders.groupBy(bucket.alias("bucket"), (F.col("o_custkey") % 50).alias("slot")).agg(F.count("*").alias("n")).where("n >= 5")


@query("a12_coverage_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def _(t):
    return t.orders.groupBy("o_orderpriority").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"])


@query("a13_spread", "SELECT l_returnflag, floor(stddev_pop(l_quantity) * 1000 + 0.5) / 1000 AS sd FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(S.rounded(F.stddev_pop("l_quantity"), 3).alias("sd"))


@query("a15_histogram", "SELECT least(19, floor(l_discount * 100 / 0.5))::INTEGER AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(F.least(F.lit(19), F.floor(F.col("l_discount") * 100 / 0.5)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query("a16_clamp_share", "SELECT event_type, count(*) FILTER (WHERE abs((value - 50) / 60) >= 1) AS clamped, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.count_if(F.abs((F.col("value") - 50) / 60) >= 1).alias("clamped"), F.count("*").alias("n"))


@query("a17_season_and_l10", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, count(*) AS season_n, count(*) FILTER (WHERE rn <= 10) AS l10_n, count(*) FILTER (WHERE rn <= 10 AND value > 50) AS l10_above FROM r GROUP BY user_id")
def _(t):
    rows = history.numbered(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return rows.groupBy("user_id").agg(F.count("*").alias("season_n"), F.count_if(F.col("rn") <= 10).alias("l10_n"), F.count_if((F.col("rn") <= 10) & (F.col("value") > 50)).alias("l10_above"))


@query("a20_ledger", "SELECT count(*) AS calls, sum(o_orderkey)::BIGINT AS total, max(o_orderkey) - min(o_orderkey) AS moved, sum(o_orderkey) = max(o_orderkey) - min(o_orderkey) AS balanced FROM orders")
def _(t):
    total, moved = F.sum("o_orderkey"), F.max("o_orderkey") - F.min("o_orderkey")
    return t.orders.agg(F.count("*").alias("calls"), total.alias("total"), moved.alias("moved"), (total == moved).alias("balanced"))


@query("w06_poll_to_poll", "SELECT event_id, floor((value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) * 100 + 0.5) / 100 AS moved FROM events")
def _(t):
    from pyspark.sql import Window

    return t.events.select("event_id", S.rounded(F.col("value") - F.lag("value").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")), 2).alias("moved"))


@query("w08_recent_top", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 55")
def _(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(55).select("event_id")


@query("w10_board_rank", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC NULLS LAST, c_custkey LIMIT 100")
def _(t):
    return serving.ranked(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"], 100)


@query("w18_union_distinct", "SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)")
def _(t):
    parts = [d.select(F.col(c).alias("name")) for d, c in ((t.customer, "c_name"), (t.supplier, "s_name"), (t.nation, "n_name"), (t.region, "r_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()


# ---- scalar functions ---------------------------------------------------------------------------------------------


@query("f01_plain_name", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' - ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS name FROM part")
def _(t):
    return t.part.select("p_partkey", S.plain_name(F.concat_ws(" - ", "p_name", "p_brand")).alias("name"))


@query("f02_rounding", "SELECT event_id, floor((value - 100) * 10 + 0.5) / 10 AS r1, greatest(-1, least(1, (value - 50) / 60)) AS clamped, sign(value - 50)::DOUBLE AS s FROM events")
def _(t):
    return t.events.select("event_id", S.rounded(F.col("value") - 100, 1).alias("r1"), S.clamp((F.col("value") - 50) / 60).alias("clamped"), F.signum(F.col("value") - 50).alias("s"))


@query("f08_minutes", "WITH a AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '--' WHEN 1 THEN (event_id % 40)::VARCHAR || ':30' WHEN 2 THEN '0' WHEN 3 THEN '-4' ELSE (event_id % 40)::VARCHAR END AS m FROM events), b AS (SELECT event_id, CASE event_id % 5 WHEN 1 THEN event_id % 40 + 0.5 WHEN 2 THEN 0 WHEN 4 THEN event_id % 40 END::DOUBLE AS p FROM a) SELECT event_id, CASE WHEN p IS NULL THEN 'unresolved' WHEN p = 0 THEN 'dnp' ELSE 'played' END AS state, CASE WHEN p > 0 THEN p END AS minutes FROM b")
def _(t):
    k, m = F.col("event_id") % 5, (F.col("event_id") % 40).cast("string")
    state, value = S.minutes(F.when(k == 0, "--").when(k == 1, F.concat(m, F.lit(":30"))).when(k == 2, "0").when(k == 3, "-4").otherwise(m))
    return t.events.select("event_id", state.alias("state"), value.alias("minutes"))


@query("f09_status", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'live' ELSE 'unresolved' END AS status FROM orders")
def _(t):
    text = F.when(F.col("o_orderstatus") == "F", " Final ").when(F.col("o_orderstatus") == "O", "In Progress").otherwise("who knows")
    return t.orders.select("o_orderkey", S.status(text).alias("status"))


@query("f10_json_number", "SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events")
def _(t):
    return t.events.select("event_id", S.json_number(F.col("props"), "k").alias("k"))


@query("f12_content_hash", "SELECT o_orderkey, sha256('=' || o_orderkey || '|=' || o_orderstatus || '|=' || o_orderpriority) AS h FROM orders")
def _(t):
    return t.orders.select("o_orderkey", S.content_hash("o_orderkey", "o_orderstatus", "o_orderpriority").alias("h"))


@query("f18_display_text", "SELECT event_id, CASE WHEN event_id < 60 THEN event_id || 's' WHEN event_id < 3600 THEN event_id // 60 || 'm' WHEN event_id < 86400 THEN event_id // 3600 || 'h' ELSE event_id // 86400 || 'd' END AS age, (event_id % 9) || '-' || (event_id % 4) || CASE WHEN event_id % 2 > 0 THEN '-' || event_id % 2 ELSE '' END AS counts FROM events")
def _(t):
    i = F.col("event_id")
    return t.events.select("event_id", S.age_text(i).alias("age"), S.counts_text(i % 9, i % 4, i % 2).alias("counts"))


@query("f23_quota", "SELECT p_partkey, ceil(p_size / 10.0)::BIGINT * 4 AS cost, ceil(p_size / 10.0)::BIGINT * 40 AS historical FROM part")
def _(t):
    return t.part.select("p_partkey", S.quota_cost(F.col("p_size"), F.lit(4)).alias("cost"), S.quota_cost(F.col("p_size"), F.lit(4), True).alias("historical"))


# ---- ingest, presence, identity -----------------------------------------------------------------------------------


@query("d01_duplicated_ids", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY l_orderkey * 10 + l_linenumber) > 1 THEN 'duplicate_id' END AS reason FROM lineitem) GROUP BY reason")
def _(t):
    return ingest.duplicated_ids(t.lineitem.withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "id").groupBy("reason").agg(F.count("*").alias("n"))


@query("d03_poll_state", "WITH a AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 422 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN 404 WHEN 6 THEN NULL ELSE 200 END AS s, value > 100 AS ok, event_id % 3 AS items FROM events) SELECT event_id, CASE WHEN s IS NULL THEN 'network_failure' WHEN s = 401 THEN 'auth_failure' WHEN s = 422 THEN 'invalid_request' WHEN s = 429 THEN 'rate_limited' WHEN s >= 500 THEN 'server_failure' WHEN s <> 200 THEN 'http_failure' WHEN NOT ok THEN 'schema_drift' WHEN items = 0 THEN 'successful_empty' ELSE 'complete' END AS state FROM a")
def _(t):
    k = F.col("event_id") % 8
    s = F.when(k.isin(0, 7), 200).when(k == 1, 401).when(k == 2, 422).when(k == 3, 429).when(k == 4, 503).when(k == 5, 404)
    return t.events.select("event_id", ingest.poll_state(s, F.col("value") > 100, F.col("event_id") % 3, F.lit(False)).alias("state"))


@query("d05_disposition", f"WITH {Q}, r AS (SELECT *, row_number() OVER (PARTITION BY player, market, book, side ORDER BY observed_at, point, price) AS rn FROM q) SELECT CASE WHEN price < 10000 THEN 'quarantined' WHEN rn = 1 THEN 'contributed' ELSE 'duplicate' END AS disposition, count(*) AS n FROM r GROUP BY 1")
def _(t):
    rows = ingest.disposition(quotes(t), ["player", "market", "book", "side"], [F.col("observed_at"), F.col("point"), F.col("price")], F.col("price") < 10000)
    return rows.groupBy("disposition").agg(F.count("*").alias("n"))


CORR = "c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_custkey FROM orders), d AS (SELECT c.o_orderkey, c.o_custkey, CASE WHEN p.o_orderkey IS NULL THEN 'initial' WHEN c.o_orderkey % 7 <> 0 AND c.o_orderkey % 5 <> 0 THEN 'metadata_only' ELSE 'material' END AS kind, CASE WHEN p.o_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN c.o_orderkey % 7 = 0 THEN 'o_orderstatus' END, CASE WHEN c.o_orderkey % 5 = 0 THEN 'o_totalprice' END) END AS changed FROM c LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 <> 0) p ON c.o_orderkey = p.o_orderkey)"


def corrected(t):
    k = F.col("o_orderkey")
    now = t.orders.select("o_orderkey", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return ingest.correction(t.orders.where("o_orderkey % 4 <> 0"), now, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("d07_correction", f"WITH {CORR} SELECT o_orderkey, kind, changed FROM d")
def _(t):
    return corrected(t)


@query("d08_eligibility", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'quarantined' WHEN event_type = 'error' THEN 'unresolved_minutes' WHEN event_type = 'signup' THEN 'live_or_non_final' WHEN value < 10 THEN 'non_participation' ELSE 'eligible' END AS state FROM events")
def _(t):
    e, v = F.col("event_type"), F.col("value")
    return ingest.eligibility(t.events, [(F.col("event_id") % 11 == 0, "quarantined"), (e == "error", "unresolved_minutes"), (e == "signup", "live_or_non_final"), (v < 10, "non_participation")]).select("event_id", "state")


@query("d09_invalidations", f"WITH {CORR} SELECT o_orderkey, kind, entity FROM (SELECT o_orderkey, unnest(['stat', 'player', 'game']) AS kind, unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, (o_custkey % 10)::VARCHAR]) AS entity FROM d WHERE kind = 'material')")
def _(t):
    rows = corrected(t).join(t.orders.select("o_orderkey", "o_custkey", (F.col("o_custkey") % 10).alias("g")), "o_orderkey")
    return ingest.invalidations(rows, "o_orderkey", "g", "o_custkey")


@query("d10_schedule", "SELECT o_orderkey, hours, epoch(o_orderdate)::BIGINT + hours * 3600 AS due_at FROM orders, (VALUES (0), (2), (24), (168)) h(hours) WHERE o_orderstatus = 'F'")
def _(t):
    rows = ingest.reconciliation_schedule(t.orders.where("o_orderstatus = 'F'").withColumn("at", F.col("o_orderdate").cast("timestamp")), "o_orderkey", "at")
    return rows.select("o_orderkey", "hours", S.whole_seconds(F.col("due_at")).alias("due_at"))


@query("d11_due", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '1999-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 200")
def _(t):
    return t.orders.where("o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '1999-01-01'").orderBy("o_orderdate", "o_orderkey").limit(200).select("o_orderkey")


POLLS = "p AS (SELECT DISTINCT user_id, event_type, epoch(ts)::BIGINT // 86400 AS poll FROM events), days AS (SELECT DISTINCT poll FROM p), f AS (SELECT user_id, event_type, min(poll) AS a FROM p GROUP BY ALL), g AS (SELECT f.user_id, f.event_type, days.poll, p.poll IS NOT NULL AS present FROM f JOIN days ON days.poll >= f.a LEFT JOIN p ON p.user_id = f.user_id AND p.event_type = f.event_type AND p.poll = days.poll), r AS (SELECT *, row_number() OVER w AS rn FROM g WINDOW w AS (PARTITION BY user_id, event_type ORDER BY poll)), o AS (SELECT *, rn - max(CASE WHEN present THEN rn END) OVER (PARTITION BY user_id, event_type ORDER BY poll) AS om FROM r), z AS (SELECT *, CASE WHEN present AND coalesce(lag(om) OVER (PARTITION BY user_id, event_type ORDER BY poll), 0) >= 2 THEN 1 ELSE 0 END AS nw, CASE WHEN present THEN 'present' WHEN om = 1 THEN 'single_omission' ELSE 'confirmed_removed' END AS state FROM o)"


def seen(t):
    return t.events.select("user_id", "event_type", S.poll_day(F.col("ts")).alias("poll")).distinct()


@query("t01_line_presence", f"WITH {POLLS} SELECT user_id, event_type, poll, present, least(om, 2) AS omissions, state, 1 + (sum(nw) OVER (PARTITION BY user_id, event_type ORDER BY poll))::BIGINT AS generation FROM z")
def _(t):
    s = seen(t)
    return presence.line_presence(presence.polled(s, ["user_id", "event_type"], s), ["user_id", "event_type"])


@query("t03_event_presence", f"WITH {POLLS} SELECT user_id, event_type, CASE WHEN bool_or(state = 'confirmed_removed') THEN 'confirmed_removed' WHEN arg_max(state, poll) = 'present' THEN 'currently_returned' ELSE arg_max(state, poll) END AS state, max(CASE WHEN present THEN poll END) AS last_seen FROM z GROUP BY ALL")
def _(t):
    s = seen(t)
    return presence.event_presence(presence.polled(s, ["user_id", "event_type"], s), ["user_id", "event_type"])


@query("l07_movement", "WITH p AS (SELECT user_id, event_type, max(value) AS o, min(value) AS u, count(*) AS t FROM events WHERE ts < TIMESTAMP '2024-01-05' GROUP BY ALL), c AS (SELECT user_id, event_type, max(value) AS o, min(value) AS u, count(*) AS t FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09' GROUP BY ALL) SELECT user_id, event_type, CASE WHEN p.t IS NULL THEN 'side_added' WHEN c.t IS NULL THEN 'side_removed' WHEN c.o IS DISTINCT FROM p.o THEN 'over_price_changed' WHEN c.u IS DISTINCT FROM p.u THEN 'under_price_changed' WHEN c.t IS DISTINCT FROM p.t THEN 'provider_timestamp_changed' ELSE 'unchanged' END AS type FROM p FULL JOIN c USING (user_id, event_type)")
def _(t):
    poll = lambda where: t.events.where(where).groupBy("user_id", "event_type").agg(F.max("value").alias("over_price"), F.min("value").alias("under_price"), F.count("*").alias("provider_time"))
    return presence.movement(poll("ts < TIMESTAMP '2024-01-05'"), poll("ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'"), ["user_id", "event_type"])


@query("l08_linked_points", f"WITH {Q}, o AS (SELECT DISTINCT player, market, point FROM q WHERE observed_at < TIMESTAMP '1999-01-01'), n AS (SELECT DISTINCT player, market, point FROM q WHERE observed_at >= TIMESTAMP '1999-01-01'), k AS (SELECT DISTINCT o.player, o.market FROM o JOIN n USING (player, market)), a AS (SELECT player, market, min(point) AS from_point FROM (SELECT * FROM o EXCEPT SELECT * FROM n) SEMI JOIN k USING (player, market) GROUP BY ALL HAVING count(*) = 1), b AS (SELECT player, market, min(point) AS to_point FROM (SELECT * FROM n EXCEPT SELECT * FROM o) SEMI JOIN k USING (player, market) GROUP BY ALL HAVING count(*) = 1) SELECT player, market, from_point, to_point FROM a JOIN b USING (player, market)")
def _(t):
    q = quotes(t)
    return presence.linked_points(q.where("observed_at < TIMESTAMP '1999-01-01'"), q.where("observed_at >= TIMESTAMP '1999-01-01'"), ["player", "market"])


@query("t04_snapshot_diff", "WITH b AS (SELECT c_custkey, c_mktsegment AS was FROM customer WHERE c_custkey % 5 <> 0), a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS now FROM customer WHERE c_custkey % 7 <> 0) SELECT c_custkey, was, now, CASE WHEN b.c_custkey IS NULL THEN 'newly_present' WHEN a.c_custkey IS NULL THEN 'newly_absent' WHEN was <> now THEN 'changed' ELSE 'unchanged' END AS change FROM b FULL JOIN a USING (c_custkey)")
def _(t):
    after = t.customer.where("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("seg"))
    return presence.snapshot_diff(t.customer.where("c_custkey % 5 <> 0").withColumnRenamed("c_mktsegment", "seg"), after, "c_custkey", "seg")


@query("t06_watermark", "SELECT o_custkey, epoch(max(o_orderdate))::BIGINT AS watermark, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS run_id FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def _(t):
    runs = t.orders.select("o_custkey", F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("partial").alias("state"), F.col("o_orderdate").cast("timestamp").alias("completed_at"))
    return presence.watermark(runs, ["o_custkey"]).select("o_custkey", S.whole_seconds(F.col("watermark")).alias("watermark"), "run_id")


@query("i01_event_reconciliation", "WITH e AS (SELECT o_orderkey AS id, o_custkey % 40 AS h, o_orderkey % 40 AS a, o_orderdate AS at FROM orders WHERE o_orderkey % 2 = 0), g AS (SELECT o_orderkey AS gid, o_custkey % 40 AS h, o_orderkey % 40 AS a, o_orderdate AS at FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 6 = 0), j AS (SELECT e.*, g.gid, g.h = e.h AS same, abs(epoch_us(e.at) - epoch_us(g.at)) / 1e6 AS d FROM e LEFT JOIN g ON least(e.h, e.a) = least(g.h, g.a) AND greatest(e.h, e.a) = greatest(g.h, g.a)), c AS (SELECT id, h, a, count(gid) AS n, count(*) FILTER (WHERE same) AS o, count(*) FILTER (WHERE same AND d = 0) AS x, count(*) FILTER (WHERE same AND d <= 900) AS y, min(gid) FILTER (WHERE same AND d = 0) AS xi, min(gid) FILTER (WHERE same AND d <= 900) AS yi FROM j GROUP BY ALL), r AS (SELECT *, CASE WHEN h = a THEN 'same_team' WHEN n = 0 THEN 'no_candidate' WHEN o = 0 THEN 'reversed_pair' WHEN x = 1 THEN 'approved_exact' WHEN x > 1 THEN 'multiple_exact' WHEN y = 1 THEN 'approved_near' WHEN y > 1 THEN 'multiple_near' ELSE 'time_window_exceeded' END AS outcome FROM c) SELECT id AS event_id, outcome, CASE outcome WHEN 'approved_exact' THEN xi WHEN 'approved_near' THEN yi END AS game_id FROM r")
def _(t):
    o = t.orders.select("o_orderkey", (F.col("o_custkey") % 40).alias("home"), (F.col("o_orderkey") % 40).alias("away"), F.col("o_orderdate").cast("timestamp").alias("at"))
    k = F.col("o_orderkey")
    return identity.reconcile_events(o.where(k % 2 == 0).withColumnRenamed("o_orderkey", "event_id"), o.where((k % 2 == 1) | (k % 6 == 0)).withColumnRenamed("o_orderkey", "game_id"))


@query("i02_player_reconciliation", "WITH p AS (SELECT c_custkey AS provider_id, p_name AS name FROM customer JOIN part ON p_partkey = c_custkey), r AS (SELECT c_custkey AS provider_id, c_custkey + 1000000 AS rid FROM customer WHERE c_custkey % 10 = 0), al AS (SELECT p_name AS name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS id FROM part WHERE p_size < 4 GROUP BY 1), pl AS (SELECT p_name AS name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS id FROM part WHERE p_size >= 4 AND p_size < 8 GROUP BY 1) SELECT provider_id, CASE WHEN rid IS NOT NULL THEN 'reviewed_mapping' WHEN al.n > 1 THEN 'alias_conflict' WHEN al.n = 1 THEN 'reviewed_alias' WHEN pl.n = 1 THEN 'proposed_for_review' WHEN pl.n > 1 THEN 'ambiguous_name' ELSE 'unmatched' END AS outcome, coalesce(rid, CASE WHEN al.n = 1 THEN al.id END, CASE WHEN al.n IS NULL AND pl.n = 1 THEN pl.id END) AS player_id FROM p LEFT JOIN r USING (provider_id) LEFT JOIN al USING (name) LEFT JOIN pl USING (name)")
def _(t):
    provider = t.customer.join(t.part, F.col("p_partkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("provider_id"), F.col("p_name").alias("name"))
    reviewed = t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("provider_id"), (F.col("c_custkey") + 1000000).alias("player_id"))
    named = lambda where: t.part.where(where).select(F.col("p_name").alias("name"), F.col("p_partkey").alias("player_id"))
    return identity.reconcile_players(provider, reviewed, named("p_size < 4"), named("p_size >= 4 AND p_size < 8"))


# ---- serving and operations ---------------------------------------------------------------------------------------


@query("v02_ingestion_lag", "WITH g AS (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 55), x AS (SELECT *, epoch(TIMESTAMP '2005-01-01') - epoch(o_orderdate) AS age FROM g WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) SELECT count(*) AS unresolved, count(*) FILTER (WHERE age > 172800) AS past_48h, count(*) FILTER (WHERE age > 345600) AS past_96h FROM x")
def _(t):
    recent = t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(55).select("o_orderkey", "o_orderdate")
    rows = recent.join(t.lineitem.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    age = S.age_seconds(F.lit("2005-01-01").cast("timestamp"), F.col("o_orderdate").cast("timestamp"))
    return rows.agg(F.count("*").alias("unresolved"), F.count_if(age > serving.LAG[0]).alias("past_48h"), F.count_if(age > serving.LAG[1]).alias("past_96h"))


@query("v04_serving_gate", "SELECT event_id, CASE WHEN epoch(TIMESTAMP '2024-01-20') - epoch(ts) > 3600 THEN 'suppress' ELSE 'serve' END AS gate FROM events")
def _(t):
    return t.events.select("event_id", serving.serving_gate(S.age_seconds(F.lit("2024-01-20").cast("timestamp"), F.col("ts").cast("timestamp"))).alias("gate"))


@query("v10_copy_safety", "SELECT c_custkey, concat_ws(',', CASE WHEN regexp_matches(lower(c_mktsegment), '\\bbuilding\\b') THEN 'building' END, CASE WHEN contains(lower(c_mktsegment), 'mach') THEN 'mach' END) AS found FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.concat_ws(",", serving.copy_violations(F.col("c_mktsegment"), ["building"], ["mach"])).alias("found"))


@query("v12_budget", "SELECT o_custkey, o_orderkey, spent FROM (SELECT o_custkey, o_orderkey, sum(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM orders) WHERE spent <= 25")
def _(t):
    calls = t.orders.withColumn("cost", F.lit(4))
    return ingest.within_budget(calls, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], "cost", 25).select("o_custkey", "o_orderkey", "spent")


@query("c01_constraints", "SELECT count(*) FILTER (WHERE NOT (l_quantity > 0)) AS positive_quantity, count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 0.05)) AS small_discount FROM lineitem")
def _(t):
    return ingest.violations(t.lineitem, {"positive_quantity": F.col("l_quantity") > 0, "small_discount": F.col("l_discount").between(0, 0.05)})


# ---- evidence -----------------------------------------------------------------------------------------------------


def evidence_rows(t: Tables):
    """Windows of each player and market of events as the columns a profile needs; threshold 50."""
    w = history.threshold_windows(played(t), ["player", "market"], newest(), F.col("value"), F.lit(50.0))
    cols = [F.col(k)[c].alias(f"{p}{s}") for k, s in (("L5", "5"), ("L10", "10"), ("L20", "20"), ("season", "s")) for c, p in (("above", "a"), ("below", "b"), ("equal", "e"), ("n", "n"), ("avg_minus", "avg"), ("median_minus", "med"))]
    rows = w.select("player", "market", *cols)
    k = F.col("player")
    return rows.withColumns({"line": F.lit(50.0), "consensus": F.when(k % 9 != 0, 50.0 + (k % 5) - 2), "books": (k % 6).cast("long"), "books_at_line": F.least(k % 6, F.lit(2)).cast("long"), "net": F.lit(0.5), "m": F.lit(60.0), "one_sided": F.when(k % 13 == 0, "over_only").otherwise("neither"), "span_days": F.lit(60)})


def evidence_sql(columns: str, source: str | None = None, keys: str = "player, market") -> str:
    """source: CTEs that end in y(keys, the windows' columns, line, m, net, consensus, books, books_at_line, one, stale, cause,
    long_enough); by default events against a line of 50."""
    inner = threshold_sql()
    of = lambda k, c, a: f"max({c}) FILTER (WHERE \"window\" = '{k}')::DOUBLE AS {a}"
    cols = ", ".join(of(k, c, p + s) for k, s in (("L5", "5"), ("L10", "10"), ("L20", "20"), ("season", "z")) for c, p in (("above", "a"), ("below", "b"), ("equal", "e"), ("n", "n"), ("avg_minus", "avg"), ("median_minus", "med")))
    rd = ", ".join(f"CASE WHEN a{k} + b{k} > 0 THEN 2 * (a{k} / (a{k} + b{k})) - 1 ELSE 0.0 END::DOUBLE AS rd{k}" for k in ("5", "10", "20", "z"))
    clamp = lambda x: f"greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {x}))"
    apart = lambda x, y: f"(sign({x}) * sign({y}) < 0 AND abs({x}) >= 0.3 AND abs({y}) >= 0.3)"
    vote = " + ".join(f"CASE WHEN sign(rd{k}) = dom THEN {w} WHEN rd{k} = 0 THEN 0 ELSE -{w} END" for k, w in (("5", "0.1::DOUBLE"), ("10", "0.4::DOUBLE"), ("20", "0.25::DOUBLE"), ("z", "0.25::DOUBLE")))
    reason = lambda c, o, k, when: f"CASE WHEN {when} THEN {{'c': {c}, 'o': ({o})::DOUBLE, 'k': '{k}'}} END"
    scored = [
        reason(1, "-abs(margin)", "positive_margin_support", "abs(margin) >= 0.3 AND sign(margin) = sign(raw) AND raw <> 0"),
        reason(1, "-abs(agreement)", "window_agreement_support", "abs(agreement) >= 0.6 AND sign(agreement) = side"),
        reason(1, "-abs(consensus - line)", "favorable_consensus_difference", "side * (consensus - line) >= 0.5"),
        reason(2, "-abs(margin)", "negative_margin_support", "abs(margin) >= 0.3 AND sign(margin) = -sign(raw) AND raw <> 0"),
        reason(2, "-abs(consensus - line)", "unfavorable_consensus_difference", "side * (consensus - line) <= -0.5"),
        reason(2, "1", "margin_measures_disagree", "sign(avg10) * sign(med10) < 0"),
        reason(2, "-least(abs(trend), abs(market_c))", "market_disagrees_with_history", "against"),
        reason(2, "-greatest(abs(rd10), abs(rd20), abs(rdz))", "windows_disagree", "apart"),
        reason(3, "1", "one_sided_offering", "one"),
        reason(3, "1", "push_heavy_sample", "pushy"),
        reason(3, "1", "stale_current_market", "stale"),
        reason(3, "1", "insufficient_book_coverage", "thin"),
    ]
    alone = [reason(3, "1", k, f"cause = '{k}'") for k in ("postponed_game", "canceled_game", "unresolved_player_mapping", "unresolved_event_mapping", "no_current_market", "no_unique_consensus_line")] + [reason(3, "1", "insufficient_l10_sample", "cause IS NULL AND n10 < 5"), reason(3, "1", "incomplete_historical_coverage", "cause IS NULL AND (nz < 10 OR NOT long_enough)")]
    ranked = lambda rows: f"list_transform(list_sort(list_filter([{', '.join(rows)}], lambda q: q IS NOT NULL)), lambda q: q.k)"
    source = source or f"""wn AS ({inner}), x AS (SELECT player, market, {cols} FROM wn GROUP BY player, market),
    y AS (SELECT *, 50.0::DOUBLE AS line, 60.0::DOUBLE AS m, 0.5::DOUBLE AS net, CASE WHEN player % 9 <> 0 THEN 50.0::DOUBLE + (player % 5) - 2 END AS consensus, player % 6 AS books, least(player % 6, 2) AS books_at_line, player % 13 = 0 AS one, false AS stale, true AS long_enough, CASE WHEN player % 6 = 0 THEN 'no_current_market' WHEN player % 9 = 0 THEN 'no_unique_consensus_line' END AS cause FROM x)"""
    return f"""WITH {source}, yy AS (SELECT *, {rd}, books IN (1, 2) AS thin, coalesce(e10 / nullif(n10, 0) > 0.3, false) AS pushy FROM y),
    z AS (SELECT *, {clamp("0.55::DOUBLE * rd10 + 0.25::DOUBLE * CASE WHEN n20 >= 10 THEN rd20 ELSE rdz END + 0.2::DOUBLE * rdz")} AS trend,
      CASE WHEN avg10 IS NULL THEN 0.0 ELSE (0.4::DOUBLE * {clamp('avg10 / m')} + 0.3::DOUBLE * {clamp('med10 / m')} + 0.2::DOUBLE * {clamp('avgz / m')} + 0.1::DOUBLE * {clamp('medz / m')}) / (0.4::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE) END AS margin,
      sign(0.1::DOUBLE * sign(rd5) + 0.4::DOUBLE * sign(rd10) + 0.25::DOUBLE * sign(rd20) + 0.25::DOUBLE * sign(rdz)) AS dom,
      {apart('rd10', 'rd20')} OR {apart('rd10', 'rdz')} OR {apart('rd20', 'rdz')} AS apart FROM yy),
    u AS (SELECT *, CASE WHEN dom = 0 THEN 1 ELSE dom END * ({vote}) AS agreement,
      CASE WHEN consensus IS NULL OR one THEN 0.0 ELSE 0.6::DOUBLE * {clamp('(consensus - line) / m')} + 0.2::DOUBLE * CASE WHEN books > 0 THEN books_at_line / books ELSE 0 END * sign(consensus - line) + 0.2::DOUBLE * {clamp('net / m')} END::DOUBLE AS market_c FROM z),
    v AS (SELECT *, {clamp('0.35::DOUBLE * trend + 0.25::DOUBLE * margin + 0.2::DOUBLE * agreement + 0.2::DOUBLE * market_c')} AS raw, {apart('trend', 'market_c')} AS against, cause IS NULL AND n10 >= 5 AND nz >= 10 AND long_enough AS scored FROM u),
    w AS (SELECT *, one OR pushy OR stale OR thin OR against AS capped, scored AND NOT apart AND abs(raw) >= 0.05 AS open FROM v),
    p AS (SELECT *, CASE WHEN NOT open THEN '' WHEN abs(raw) >= 0.55 AND n10 >= 8 AND sign(rd10) = sign(raw) AND abs(trend) >= 0.3 AND NOT capped THEN 'strong_' WHEN abs(raw) >= 0.3 THEN 'moderate_' ELSE '' END AS level FROM w),
    q AS (SELECT *, CASE WHEN level <> '' THEN sign(raw) END AS side, CASE WHEN raw > 0 THEN 'over' ELSE 'under' END AS dir FROM p)
    SELECT {keys}, {columns.replace('#ALONE', ranked(alone)).replace('#SCORED', ranked(scored))} FROM q"""


SCORE_SQL = "CASE WHEN scored THEN floor(raw * 10000 + 0.5) / 10000 END AS score"


@query("e06_composite", evidence_sql(SCORE_SQL))
def _(t):
    return evidence.profile(evidence_rows(t).withColumnRenamed("market", "of")).select("player", F.col("of").alias("market"), S.rounded(F.col("score"), 4).alias("score"))


CLASS_SQL = """CASE WHEN cause IS NOT NULL THEN 'unavailable' WHEN NOT scored THEN 'insufficient_evidence' WHEN level = '' THEN 'mixed' ELSE level || dir END AS classification,
    CASE WHEN level = 'moderate_' AND capped THEN CASE WHEN one THEN 'one_sided_offering' WHEN pushy THEN 'push_heavy_sample' WHEN stale THEN 'stale_current_market' WHEN thin THEN 'insufficient_book_coverage' ELSE 'market_disagrees_with_history' END ELSE 'none' END AS cap,
    array_to_string(CASE WHEN scored THEN #SCORED ELSE #ALONE END, ',') AS reasons"""


@query("e11_classification", evidence_sql(CLASS_SQL))
def _(t):
    rows = evidence.reasons(evidence.profile(evidence_rows(t).withColumnRenamed("market", "of")))
    return rows.select("player", F.col("of").alias("market"), "classification", "cap", F.concat_ws(",", "reasons").alias("reasons"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


from tideline.plans import built, more, ruled  # noqa: E402, F401  (add their queries)
