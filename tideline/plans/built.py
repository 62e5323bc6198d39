"""Queries that chain several operators: lifecycles, and evidence profiles from raw quotes and results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions import scalar
from tideline.operators import board, evidence, explain, lifecycle, prefix, profiles, recompute, seeding
from tideline.plans.catalogue import CLASS_SQL, G, SQL, evidence_rows, evidence_sql, four, mode_sql, query, quotes

# ---- lifecycles of lines --------------------------------------------------------------------------------------------


def polls_and_lines(t):
    """Days of events are polls of ten feeds, some of which failed or began too late; a user's event type is a line."""
    day = scalar.poll_day(F.col("ts"))
    seen = t.events.select((F.col("user_id") % 10).alias("event"), "user_id", "event_type", day.alias("poll"))
    e, p = F.col("event"), F.col("poll")
    polls = seen.select("event", "poll").distinct().select("event", "poll", ((p + e) % 7 != 0).alias("succeeded"), ((3 * p + e) % 11 == 0).alias("unavailable"), (p >= 19743 + e).alias("started"))
    return polls, seen


#: The state machine as a recursion over the polls of each feed, one at a time.
LIFECYCLE = """WITH RECURSIVE seen AS (SELECT DISTINCT user_id % 10 AS event, user_id, event_type, epoch(ts)::BIGINT // 86400 AS poll FROM events),
polls AS (SELECT event, poll, (poll + event) % 7 <> 0 AS succeeded, (3 * poll + event) % 11 = 0 AS unavailable, poll >= 19743 + event AS started, row_number() OVER (PARTITION BY event ORDER BY poll) AS k FROM (SELECT DISTINCT event, poll FROM seen)),
line AS (SELECT DISTINCT event, user_id, event_type FROM seen),
grid AS (SELECT event, user_id, event_type, poll, k, succeeded AND NOT unavailable AS ok, started, s.poll IS NOT NULL AS present FROM line JOIN polls USING (event) LEFT JOIN seen s USING (event, user_id, event_type, poll)),
r AS (
    SELECT event, user_id, event_type, 0::BIGINT AS k, 0 AS generation, NULL::BIGINT AS first_seen, NULL::BIGINT AS last_seen, NULL::VARCHAR AS state, 0 AS omissions, NULL::BIGINT AS confirmed_at FROM line
    UNION ALL
    SELECT event, user_id, event_type, g.k, CASE WHEN g.present AND (r.state IS NULL OR g.ok AND r.state = 'confirmed_removed') THEN r.generation + 1 ELSE r.generation END,
        CASE WHEN g.present AND (r.state IS NULL OR g.ok AND r.state = 'confirmed_removed') THEN g.poll ELSE r.first_seen END, CASE WHEN g.present THEN g.poll ELSE r.last_seen END,
        CASE WHEN g.present AND (r.state IS NULL OR g.ok) THEN 'present' WHEN g.present OR r.state IS NULL OR NOT g.ok OR g.started THEN r.state WHEN r.omissions = 0 THEN 'single_omission' ELSE 'confirmed_removed' END,
        CASE WHEN g.present AND (r.state IS NULL OR g.ok) THEN 0 WHEN g.present OR r.state IS NULL OR NOT g.ok OR g.started THEN r.omissions ELSE least(r.omissions + 1, 2) END,
        CASE WHEN g.present AND (r.state IS NULL OR g.ok) THEN NULL WHEN NOT g.present AND g.ok AND NOT g.started AND r.omissions = 1 THEN g.poll ELSE r.confirmed_at END
    FROM r JOIN grid g USING (event, user_id, event_type) WHERE g.k = r.k + 1
)
SELECT event, user_id, event_type, generation, first_seen, last_seen, state, omissions, confirmed_at FROM (SELECT *, row_number() OVER (PARTITION BY event, user_id, event_type, generation ORDER BY k DESC) AS n FROM r WHERE generation > 0) WHERE n = 1"""


@query("l09_lifecycle", LIFECYCLE)
def _(t):
    polls, seen = polls_and_lines(t)
    return lifecycle.lifecycle(seen, polls, ["event", "user_id", "event_type"], ["event"])


OFFER_SQL = "SELECT l_suppkey % 20 AS event, l_suppkey AS book, l_partkey AS player, CASE WHEN l_linestatus = 'O' THEN 'over' ELSE 'under' END AS side, l_discount AS point, max(l_extendedprice) AS price, max(l_linenumber) AS provider_time FROM lineitem WHERE {} GROUP BY ALL"
GRAIN_SQL = "event, book, player, side, point"
MOVES = f"""WITH p AS ({OFFER_SQL.format("l_orderkey % 3 <> 0")}), c AS ({OFFER_SQL.format("l_orderkey % 4 <> 0")}),
x AS (SELECT {GRAIN_SQL}, p.price AS prior_price, c.price AS current_price, p.provider_time AS prior_time, c.provider_time AS current_time, p.price IS NOT NULL AS was, c.price IS NOT NULL AS is_ FROM p FULL JOIN c USING ({GRAIN_SQL})),
e AS (SELECT {GRAIN_SQL}, CASE WHEN NOT was THEN 'side_added' WHEN NOT is_ THEN 'side_removed' WHEN prior_price <> current_price THEN side || '_price_changed' WHEN prior_time <> current_time THEN 'provider_timestamp_changed' END AS type,
  CASE WHEN was AND is_ OR NOT was AND event % 3 <> 0 OR NOT is_ AND event % 4 <> 0 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN was THEN point END AS prior_point, CASE WHEN is_ THEN point END AS current_point, prior_price, current_price, prior_time, current_time FROM x),
one AS (SELECT event, book, player, side FROM e GROUP BY ALL HAVING count(*) FILTER (WHERE type = 'side_added') = 1 AND count(*) FILTER (WHERE type = 'side_removed') = 1)
SELECT * FROM e WHERE type IS NOT NULL UNION ALL BY NAME SELECT event, book, player, side, a.point, 'point_changed' AS type, 'high' AS confidence, r.point AS prior_point, a.point AS current_point, r.prior_price, a.current_price, r.prior_time, a.current_time FROM one JOIN e a USING (event, book, player, side) JOIN e r USING (event, book, player, side) WHERE a.type = 'side_added' AND r.type = 'side_removed'"""


@query("l09_movements", MOVES)
def _(t):
    def offered(where):
        rows = t.lineitem.where(where).select((F.col("l_suppkey") % 20).alias("event"), F.col("l_suppkey").alias("book"), F.col("l_partkey").alias("player"), F.when(F.col("l_linestatus") == "O", "over").otherwise("under").alias("side"), F.col("l_discount").alias("point"), F.col("l_extendedprice").alias("price"), F.col("l_linenumber").alias("provider_time"))
        return rows.groupBy("event", "book", "player", "side", "point").agg(F.max("price").alias("price"), F.max("provider_time").alias("provider_time"))

    e = F.col("event")
    context = t.supplier.select((F.col("s_suppkey") % 20).alias("event")).distinct().select("event", (e % 3 != 0).alias("produced"), (e % 4 != 0).alias("succeeded"))
    return lifecycle.movements(offered("l_orderkey % 3 <> 0"), offered("l_orderkey % 4 <> 0"), context, ["event", "book", "player"], ["event"])


# ---- evidence profiles ----------------------------------------------------------------------------------------------

#: One reference time; quotes were observed up to 4,400 seconds before it, by their player and book.
AT = "TIMESTAMP '2024-03-01 00:00:00'"
NORMAL = {"A": 0.03, "R": 0.05}


def raw_tables(t):
    k = F.col("player")
    q = quotes(t).withColumn("observed_at", F.expr(AT) - F.make_interval(secs=k % 37 * 120 + F.col("book") % 10))
    results = t.events.select(F.col("user_id").alias("player"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("R").alias("market"), (F.col("event_id") / 2).cast("long").alias("game"), F.col("ts").alias("at"), (F.col("value") / 2000).alias("value"), F.lit(1).alias("version"))
    older = results.where("game % 5 = 0").withColumns({"version": F.lit(0), "value": F.lit(9.0)})
    players = t.part.select(F.col("p_partkey").alias("player"), (F.col("p_partkey") % 17 != 0).alias("player_resolved"))
    games = t.supplier.select((F.col("s_suppkey") % 10).alias("game")).distinct().select("game", F.when(F.col("game") == 3, "postponed").otherwise("scheduled").alias("game_status"), (F.col("game") != 7).alias("event_resolved"), F.expr("TIMESTAMP '2024-01-29 00:00:00'").alias("starts_at"))
    return q, results.union(older), players, games


def profile_sql(gated: bool) -> str:
    """Profiles from the rules: the market row of each grain, its games, windows, and the engine's gates."""
    q = f"q AS (SELECT l_partkey % 10 AS game, l_partkey AS player, l_returnflag AS market, l_suppkey AS book, CASE WHEN l_linestatus = 'O' THEN 'over' ELSE 'under' END AS side, l_discount AS point, s_nationkey % 5 <> 0 AS sportsbook, l_partkey % 37 * 120 + l_suppkey % 10 AS age FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag IN ('A', 'R'))"
    seen = f"seen AS (SELECT {G}, min(age) AS age, bool_or(side = 'over') AS o, bool_or(side = 'under') AS u FROM q GROUP BY {G})"
    open_ = "age <= 300" if gated else "true"
    stale, gone = ("false", "NOT open") if gated else ("age > 1800", "books = 0")
    g = f"g AS (WITH {q}, {mode_sql('q', G)}, {seen} SELECT {G}, seen.age, {open_} AS open, CASE WHEN {open_} THEN line END AS consensus, CASE WHEN {open_} THEN books ELSE 0 END AS books, CASE WHEN {open_} THEN books_at_point ELSE 0 END AS books_at_line, {open_} AND o <> u AS one FROM seen JOIN c USING ({G}))"
    v = "v0 AS (SELECT user_id AS player, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'R' END AS market, event_id // 2 AS played, ts, value / 2000 AS v FROM events WHERE ts < TIMESTAMP '2024-01-29 00:00:00')"
    a = f"a0 AS (SELECT g.*, coalesce(consensus, 0.0) AS line, played, ts, v, row_number() OVER (PARTITION BY {G} ORDER BY ts DESC, played DESC) AS rn FROM g LEFT JOIN v0 USING (player, market))"
    win = ", ".join(f"count(v) FILTER (WHERE {c} AND v > line)::DOUBLE AS a{k}, count(v) FILTER (WHERE {c} AND v < line)::DOUBLE AS b{k}, count(v) FILTER (WHERE {c} AND v = line)::DOUBLE AS e{k}, count(v) FILTER (WHERE {c})::DOUBLE AS n{k}, {four('list_reduce(list(v ORDER BY rn) FILTER (WHERE ' + c + ' AND v IS NOT NULL), lambda p, q: p + q) / count(v) FILTER (WHERE ' + c + ')')} AS am{k}, {four('median(v) FILTER (WHERE ' + c + ')')} AS mm{k}" for k, c in (("5", "rn <= 5"), ("10", "rn <= 10"), ("20", "rn <= 20"), ("z", "true")))
    x = f"x AS (SELECT {G}, any_value(age) AS age, any_value(open) AS open, any_value(consensus) AS consensus, any_value(books) AS books, any_value(books_at_line) AS books_at_line, any_value(one) AS one, any_value(line) AS line, min(ts) AS earliest, {win} FROM a0 GROUP BY {G})"
    minus = ", ".join(f"{four(f'am{k} - line')} AS avg{k}, {four(f'mm{k} - line')} AS med{k}" for k in ("5", "10", "20", "z"))
    kept = "" if gated else " WHERE books = 0 OR age <= 3600"
    y = f"y AS (SELECT *, {minus}, CASE market WHEN 'A' THEN 0.03::DOUBLE ELSE 0.05::DOUBLE END AS m, 0.0::DOUBLE AS net, {stale} AS stale, coalesce(date_diff('day', earliest::DATE, DATE '2024-03-01') >= 30, false) AS long_enough, CASE WHEN game = 3 THEN 'postponed_game' WHEN player % 17 = 0 THEN 'unresolved_player_mapping' WHEN game = 7 THEN 'unresolved_event_mapping' WHEN {gone} OR books = 0 THEN 'no_current_market' WHEN consensus IS NULL THEN 'no_unique_consensus_line' END AS cause FROM x{kept})"
    columns = "CASE WHEN cause IS NULL THEN line END AS line, CASE WHEN scored THEN floor(raw * 10000 + 0.5) / 10000 END AS score, cause, " + CLASS_SQL
    return evidence_sql(columns, ", ".join([g, v, a, x, y]), G)


def said(rows):
    return rows.select("game", "player", "market", "line", F.expr("floor(score * 10000 + 0.5) / 10000").alias("score"), "cause", "classification", "cap", F.concat_ws(",", "reasons").alias("reasons"))


@query("e16_profiles_v1", profile_sql(True))
def _(t):
    return said(profiles.engine_v1(profiles.inputs(*raw_tables(t), F.expr(AT), gated=True, normalisers=NORMAL)))


@query("e18_profiles_v2", profile_sql(False))
def _(t):
    return said(profiles.engine_v2(profiles.inputs(*raw_tables(t), F.expr(AT), gated=False, normalisers=NORMAL)))


@query("e21_source_identity", f"SELECT l_partkey % 10 AS game, l_partkey AS player, l_returnflag AS market, array_to_string(list_sort(list(DISTINCT l_suppkey || ':' || s_name)), ',') AS sources FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY {G}")
def _(t):
    q = quotes(t).join(t.supplier.select(F.col("s_suppkey").alias("book"), F.col("s_name").alias("title")), "book")
    named = F.transform("sources", lambda x: F.concat_ws(":", x["id"], x["title"]))
    return profiles.source_identity(q).select("game", "player", "market", F.array_join(F.array_sort(named), ",").alias("sources"))


@query("e22_grains", "SELECT DISTINCT l_partkey % 10 AS game, l_partkey AS player, l_returnflag AS market FROM lineitem")
def _(t):
    return profiles.grains(quotes(t))


# ---- snapshots, recomputation, ceilings -----------------------------------------------------------------------------

CLASSES = {f"b{k}": "dfs_pickem" if k == 3 else "sportsbook" for k in range(9)}


def nested_snapshots(t):
    """Orders as snapshots: suppliers are books, return flags or high taxes markets, and lines their outcomes, some of them broken."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    o = F.struct(
        F.when(n % 7 == 6, "push").when(F.col("l_linestatus") == "O", " Over ").otherwise("UNDER").alias("name"), F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("Né-"), k % 50)).alias("description"),
        F.when(k % 11 != 0, F.col("l_extendedprice")).alias("price"), F.when(k % 17 != 0, F.col("l_discount")).alias("point"), F.lit(None).cast("double").alias("multiplier"),
    )
    market = ["l_orderkey", (F.col("l_suppkey") % 11).alias("b"), F.when(F.col("l_tax") > 0.06, "other").otherwise(F.col("l_returnflag")).alias("k")]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "o"))), lambda x: x["o"])
    markets = t.lineitem.select(*market, n.alias("n"), o.alias("o")).groupBy("l_orderkey", "b", "k").agg(ordered.alias("outcomes"))
    books = markets.groupBy("l_orderkey", "b").agg(F.array_sort(F.collect_list(F.struct(F.col("k").alias("key"), F.lit(None).cast("timestamp").alias("last_update"), "outcomes"))).alias("markets"))
    data = books.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("b"), "b").alias("key"), F.lit("t").alias("title"), F.lit(None).cast("timestamp").alias("last_update"), "markets"))).alias("bookmakers"))
    at = F.expr(AT)
    return data.select(F.col("l_orderkey").alias("snapshot_id"), at.alias("boundary"), (at - F.make_interval(secs=F.col("l_orderkey") % 900)).alias("taken_at"), F.struct(F.col("l_orderkey").cast("string").alias("id"), "bookmakers").alias("data"))


SEEDED = "l AS (SELECT l_orderkey AS snapshot_id, l_suppkey % 11 AS b, 'b' || l_suppkey % 11 AS book, CASE WHEN l_tax > 0.06 THEN 'other' ELSE l_returnflag END AS market, l_partkey AS k, l_linenumber AS n, l_linestatus, l_discount, l_extendedprice FROM lineitem WHERE l_orderkey % 900 <= 600)"
WHY = "CASE WHEN k % 13 = 0 THEN 'missing_player_description' WHEN k % 17 = 0 THEN 'missing_point' WHEN n % 7 = 6 THEN 'missing_side' END"


@query("h03_exclusions", f"WITH {SEEDED} SELECT DISTINCT 0 AS n, snapshot_id, book, '' AS market, CASE WHEN b >= 9 THEN 'unallowlisted_bookmaker_key' ELSE 'dfs_pickem_excluded_from_sportsbook_consensus' END AS reason FROM l WHERE b >= 9 OR b = 3 UNION ALL SELECT DISTINCT 0, snapshot_id, book, market, 'unlaunched_market_key' FROM l WHERE b < 9 AND b <> 3 AND market = 'other' UNION ALL SELECT row_number() OVER (PARTITION BY snapshot_id, book, market, {WHY}), snapshot_id, book, market, {WHY} FROM l WHERE b < 9 AND b <> 3 AND market <> 'other' AND {WHY} IS NOT NULL")
def _(t):
    rows = seeding.exclusions(seeding.outcomes(nested_snapshots(t), CLASSES, ("A", "N", "R")))
    by = Window.partitionBy("snapshot_id", "book", "market", "reason").orderBy("reason")
    whole = F.col("reason").isin("unallowlisted_bookmaker_key", "dfs_pickem_excluded_from_sportsbook_consensus", "unlaunched_market_key")
    return rows.withColumn("n", F.when(whole, F.row_number().over(by) - 1).otherwise(F.row_number().over(by))).select("n", "snapshot_id", "book", "market", "reason")


@query("h03_closing_quotes", f"WITH {SEEDED}, v AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'over' ELSE 'under' END AS side, CASE WHEN k % 11 <> 0 THEN trunc(l_extendedprice)::BIGINT ELSE 0 END AS price, k % 50 AS p FROM l WHERE b < 9 AND b <> 3 AND market <> 'other' AND {WHY} IS NULL) SELECT snapshot_id, book, market, 'Né-' || p AS player, l_discount AS point, arg_max(price, n) FILTER (WHERE side = 'over') AS over_price, arg_max(price, n) FILTER (WHERE side = 'under') AS under_price FROM v GROUP BY snapshot_id, book, market, p, l_discount")
def _(t):
    return seeding.closing_quotes(seeding.outcomes(nested_snapshots(t), CLASSES, ("A", "N", "R"))).select("snapshot_id", "book", "market", "player", "point", "over_price", "under_price")


@query("d13_quarantine", f"WITH {SEEDED} SELECT 'r1' AS run_id, snapshot_id, book, market, count(*) AS n FROM (SELECT DISTINCT snapshot_id, book, NULL::VARCHAR AS market FROM l WHERE b >= 9 OR b = 3 UNION ALL SELECT DISTINCT snapshot_id, book, market FROM l WHERE b < 9 AND b <> 3 AND market = 'other' UNION ALL SELECT snapshot_id, book, market FROM l WHERE b < 9 AND b <> 3 AND market <> 'other' AND {WHY} IS NOT NULL) GROUP BY ALL")
def _(t):
    rows = seeding.quarantined(seeding.exclusions(seeding.outcomes(nested_snapshots(t), CLASSES, ("A", "N", "R"))), "r1")
    return rows.groupBy("run_id", "snapshot_id", "book", "market").agg(F.count("reason").alias("n"))


def recomputable(t):
    """events as stats, half of them changed since they were graded, and the queue that says so."""
    e = F.col("event_id")
    base = t.events.select(e.alias("stat_id"), e.alias("game"), F.col("user_id").alias("player"), F.col("event_type").alias("market"), "value", (e % 9 != 0).alias("eligible"))
    stats = base.withColumn("value", F.when(e_changed(), F.col("value") + 7).otherwise(F.col("value")))
    points = base.select("game", "player", "market", F.when(F.col("game") % 13 != 0, 50.0).alias("closing_point"), F.when(F.col("game") % 5 == 0, "single_book").when(F.col("game") % 7 == 0, "unresolved_closing_consensus").otherwise("complete").alias("coverage"))
    starts = t.events.select(e.alias("game"), F.col("ts").alias("starts_at"))
    g = F.col("game")
    changed = stats.where(e_changed())
    never = F.lit(None).cast("timestamp").alias("processed_at"), F.lit(None).cast("string").alias("note")
    queue = changed.select(F.concat_ws("-", F.lit("c"), "game").alias("id"), F.when(g % 3 == 0, "stat").otherwise("game").alias("kind"), g.alias("entity"), F.expr(AT).alias("observed_at"), *never)
    queue = queue.union(t.supplier.select(F.concat_ws("-", F.lit("s"), "s_suppkey"), F.lit("game"), -1 - F.col("s_suppkey"), F.expr(AT), *never))
    return queue, points, base, stats, starts


def e_changed():
    return F.col("game") % 2 == 0


def drained(t):
    queue, points, base, stats, starts = recomputable(t)
    old = recompute.results(points, base)
    return recompute.drain(queue, points, stats, starts, old, recompute.windows(old, starts), F.expr(AT))


#: All computed anew from the changed stats.
ANEW = "r AS (SELECT event_id AS game, user_id AS player, event_type AS market, ts, CASE WHEN event_id % 2 = 0 THEN value + 7 ELSE value END AS v, CASE WHEN event_id % 5 = 0 THEN 'single_book' ELSE 'complete' END AS coverage FROM events WHERE event_id % 9 <> 0 AND event_id % 13 <> 0 AND (event_id % 5 = 0 OR event_id % 7 <> 0)), d AS (SELECT *, floor((v - 50.0::DOUBLE) * 100 + 0.5) / 100 AS m FROM r), f AS (SELECT *, CASE WHEN m > 0 THEN 'over' WHEN m < 0 THEN 'under' ELSE 'push' END AS o, row_number() OVER (PARTITION BY player, market ORDER BY ts DESC, game DESC) AS rn FROM d)"


@query("h20_drained_results", f"WITH {ANEW} SELECT game, player, market, v AS value, o AS outcome, m AS margin, coverage FROM f")
def _(t):
    return drained(t)[1].select("game", "player", "market", "value", "outcome", "margin", "coverage")


@query("h20_drained_windows", f"WITH {ANEW} SELECT player, market, count(*) AS n, count(*) FILTER (WHERE o = 'over') AS over, {four('list_reduce(list(m ORDER BY rn) FILTER (WHERE rn <= 10), lambda p, q: p + q) / count(*) FILTER (WHERE rn <= 10)')} AS avg_margin FROM f GROUP BY player, market")
def _(t):
    return drained(t)[2].select("player", "market", F.col("season.n").alias("n"), F.col("season.over").alias("over"), F.col("L10.avg_margin").alias("avg_margin"))


@query("h20_drained_queue", "SELECT 'c-' || event_id AS id, 'recomputed' AS note FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 's-' || s_suppkey, 'no_eligible_source' FROM supplier")
def _(t):
    return drained(t)[0].where("processed_at IS NOT NULL").select("id", "note")


@query("h22_bounded_repair", "WITH m AS (SELECT o_orderkey AS game, o_orderkey % 5 = 0 AS repaired, o_orderkey % 7 = 0 AS failed, o_orderkey % 3 <> 0 AS fine, o_custkey % 41 AS credits FROM orders), c AS (SELECT *, CASE WHEN repaired OR failed THEN 0 ELSE credits END AS cost FROM m), s AS (SELECT *, sum(cost) OVER (ORDER BY game)::BIGINT AS spent FROM c) SELECT game, CASE WHEN repaired THEN 'skipped' WHEN failed THEN 'failed' WHEN fine THEN 'eligible' ELSE 'close_capture_stale' END AS outcome, spent FROM s WHERE game < coalesce((SELECT min(game) FROM s WHERE NOT repaired AND spent - cost + 40 > 10000), 1e18)")
def _(t):
    k = F.col("o_orderkey")
    manifest = t.orders.select(k.alias("game"), (k % 5 == 0).alias("repaired"), (k % 7 == 0).alias("failed"), F.when(k % 3 != 0, "eligible").otherwise("close_capture_stale").alias("capture"), (F.col("o_custkey") % 41).alias("credits"))
    return prefix.bounded_repair(manifest, "game", 10_000, ranges=16).select("game", "outcome", "spent")


@query("w_running_total", "SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT) OVER (ORDER BY epoch(l_shipdate), l_orderkey, l_linenumber)::BIGINT AS total FROM lineitem")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at"))
    return prefix.running_total(rows, "at", ["l_orderkey", "l_linenumber"], F.col("l_quantity"), ranges=16).select("l_orderkey", "l_linenumber", "total")


# ---- the board ------------------------------------------------------------------------------------------------------


def texts_sql(kinds: dict[str, str]) -> str:
    pairs = ", ".join(f"""'{k}': '{v.replace("'", "''")}'""" for k, v in kinds.items())
    return f"nullif(array_to_string(list_filter(list_transform(string_split(reasons, ','), lambda c: MAP {{{pairs}}}[c]), lambda x: x IS NOT NULL), ' '), '')"


def of_sql(values: dict[str, str], key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@query("v09_explanations", f"""WITH e AS ({SQL["e11_classification"]}) SELECT player, market, {of_sql(explain.FULL, "classification")} AS label, {of_sql(explain.COMPACT, "classification")} || CASE WHEN cap <> 'none' THEN ' — ' || {of_sql(explain.TAGS, "cap")} ELSE '' END AS compact_line,
    {texts_sql(explain.SUPPORT)} AS support, {texts_sql(explain.CONTRADICTION)} AS contradiction, {texts_sql(explain.QUALITY)} AS quality, CASE WHEN player % 4 = 0 THEN '{explain.SEEDED}' END AS marker FROM e""")
def _(t):
    rows = evidence.reasons(evidence.profile(evidence_rows(t).withColumnRenamed("market", "of")))
    made = explain.explanations(rows, F.col("player") % 4 == 0)
    return made.select("player", F.col("of").alias("market"), "label", "compact_line", "support", "contradiction", "quality", "marker")


@query("v07_bundles", "WITH n AS (SELECT l_orderkey AS profile_id, count(*) AS n, array_to_string(list(l_linenumber || ':' || l_partkey ORDER BY l_linenumber, l_linenumber || ':' || l_partkey), ',') AS series FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS profile_id, CASE WHEN o_orderkey % 3 = 0 THEN 'unavailable_not_persisted' ELSE 'available' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice + 10 END AS l10, CASE WHEN o_orderkey % 3 <> 0 THEN coalesce(series, '') END AS series FROM orders LEFT JOIN n ON profile_id = o_orderkey")
def _(t):
    k = F.col("o_orderkey").alias("profile_id")
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), (F.col("o_totalprice") + n).alias("v")) for w, n in (("L5", 5), ("L10", 10), ("L20", 20), ("season", 0))])).alias("w")
    windows = t.orders.where("o_orderkey % 3 <> 0").select(k, each).select("profile_id", "w.*")
    series = t.lineitem.select(F.col("l_orderkey").alias("profile_id"), F.col("l_linenumber").alias("ordinal"), F.concat_ws(":", "l_linenumber", "l_partkey").alias("v"))
    sources = t.lineitem.select(F.col("l_orderkey").alias("profile_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_suppkey").alias("source_id"))
    made = board.bundles(t.orders.select(k), windows, sources, series)
    return made.select("profile_id", "status", F.col("windows")["L10"]["v"].alias("l10"), F.when(F.col("series").isNotNull(), F.array_join(F.transform("series", lambda x: x["v"]), ",")).alias("series"))


@query("v01_board", "WITH p AS (SELECT o_orderkey AS game, o_custkey AS player, o_orderpriority AS market, o_orderdate AS ref, o_totalprice AS score FROM orders WHERE o_custkey % 5 <> 0), m AS (SELECT l_orderkey AS game, max(l_linenumber) AS v, count(*) AS n, arg_max(l_discount, {'a': l_linenumber, 'b': l_discount}) AS low FROM lineitem GROUP BY l_orderkey), s AS (SELECT l_orderkey AS game, max(l_shipdate - INTERVAL 60 DAY) FILTER (WHERE l_shipdate - INTERVAL 60 DAY <= o_orderdate) AS seen FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey) SELECT p.game, p.player, p.market, c_name AS name, n1.n_name AS team, c_nationkey = p.game % 25 AS is_home, n2.n_name AS opponent_city, coalesce(v, 0) AS books, low, epoch(seen)::BIGINT AS seen FROM p JOIN customer ON c_custkey = player LEFT JOIN nation n1 ON n1.n_nationkey = c_nationkey LEFT JOIN nation n2 ON n2.n_nationkey = CASE WHEN c_nationkey = p.game % 25 THEN (p.game + 7) % 25 ELSE p.game % 25 END LEFT JOIN m ON m.game = p.game LEFT JOIN s ON s.game = p.game")
def _(t):
    g = F.col("o_orderkey")
    grain = [g.alias("game"), F.col("o_custkey").alias("player"), F.col("o_orderpriority").alias("market")]
    profile = t.orders.where("o_custkey % 5 <> 0").select(*grain, F.col("o_orderdate").cast("timestamp").alias("reference_at"), F.col("o_totalprice").alias("score"))
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey").join(t.orders, "o_orderkey")
    market = lines.select(*grain, F.col("l_linenumber").alias("version"), F.col("l_linenumber").alias("books"), F.col("l_discount").alias("low"), F.col("l_discount").alias("high"))
    seen = lines.select(*grain, (F.col("l_shipdate").cast("timestamp") - F.expr("INTERVAL 60 DAYS")).alias("observed_at"))
    players = t.customer.select(F.col("c_custkey").alias("player"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("team"))
    teams = t.nation.select(F.col("n_nationkey").alias("team"), F.col("n_name").alias("title"), F.lit(None).cast("string").alias("city"))
    games = t.orders.select(g.alias("game"), (g % 25).alias("home"), ((g + 7) % 25).alias("away"), F.lit(None).cast("timestamp").alias("starts_at"))
    rows = board.board_rows(profile, players, teams, games, market, seen)
    return rows.select("game", "player", "market", "name", "team", "is_home", "opponent_city", "books", "low", scalar.whole_seconds(F.col("line_observed_at")).alias("seen"))
