"""Further queries over the driver's tables: predicates, lookups, aggregates and lifecycle rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions import scalar as S
from tideline.operators import history, identity, ingest, presence, serving
from tideline.plans.catalogue import query

# ---- predicates -----------------------------------------------------------------------------------------------------


@query("p01_current_only", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'")
def _(t):
    return ingest.current_only(t.orders, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "O").select("o_orderkey")


@query("p02_historical_or_backfilled", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' OR o_orderstatus = 'F'")
def _(t):
    return t.orders.where((F.col("o_orderpriority") == "5-LOW") | (F.col("o_orderstatus") == "F")).select("o_orderkey")


@query("p04_backfill_eligible", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount IS NOT NULL AND l_returnflag <> 'R' AND o_orderstatus = 'F' AND l_quantity > 0")
def _(t):
    rows = t.lineitem.where(F.col("l_discount").isNotNull() & (F.col("l_returnflag") != "R") & (F.col("l_quantity") > 0))
    return rows.join(t.orders.where("o_orderstatus = 'F'").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("p06_allow_lists", "SELECT event_id FROM events WHERE event_type IN ('view', 'purchase') AND user_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def _(t):
    return t.events.where(F.col("event_type").isin("view", "purchase") & F.col("user_id").isin(1, 2, 3, 5, 8, 13, 21, 34, 55, 89)).select("event_id")


@query("p07_optional_predicates", "SELECT event_id FROM events WHERE event_type = 'view' AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 3)")
def _(t):
    games = t.customer.where("c_nationkey < 3").select(F.col("c_custkey").alias("user_id"))
    return serving.restricted(t.events, {"event_type": "view", "value": None}, {"user_id": games}).select("event_id")


@query("p08_eligible_stat", "SELECT event_id, value AS stat FROM events WHERE event_type <> 'error' AND value IS NOT NULL AND isfinite(value)")
def _(t):
    stat = F.col("value").try_cast("double")
    finite = stat.isNotNull() & ~F.isnan(stat) & (F.abs(stat) < float("inf"))
    return t.events.where((F.col("event_type") != "error") & finite).select("event_id", stat.alias("stat"))


@query("p10_candidate_window", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 60 MINUTE AND ts <= TIMESTAMP '2024-01-10 12:00:00' + INTERVAL 60 MINUTE")
def _(t):
    at = F.lit("2024-01-10 12:00:00").cast("timestamp")
    return t.events.where(F.col("ts").between(at - F.expr("INTERVAL 60 MINUTES"), at + F.expr("INTERVAL 60 MINUTES"))).select("event_id")


@query("p11_stuck_backlog", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def _(t):
    rows = t.orders.where("o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
    rows = rows.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return rows.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("place"))


@query("p13_projection", "SELECT p_partkey, p_brand FROM part")
def _(t):
    return serving.projected(t.part, ["p_partkey", "p_brand"], forbidden=["p_retailprice"])


# ---- joins and lookups ----------------------------------------------------------------------------------------------


@query("j02_registry_fallback", "SELECT l_orderkey, l_linenumber, coalesce(s_name, l_suppkey::VARCHAR) AS title FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey < 15) ON s_suppkey = l_suppkey")
def _(t):
    known = t.supplier.where("s_nationkey < 15").select("s_suppkey", "s_name")
    return t.lineitem.join(known, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("l_orderkey", "l_linenumber", F.coalesce("s_name", F.col("l_suppkey").cast("string")).alias("title"))


@query("j04_results_in_order", "SELECT o_custkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber) AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return history.numbered(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("l_orderkey"), F.asc("l_linenumber")]).select("o_custkey", "l_orderkey", "l_linenumber", F.col("rn").cast("long").alias("rn"))


@query("j12_queue_reason", """WITH q AS (SELECT unnest([o_custkey, o_custkey + 1]) AS id, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS a, o_orderdate AS made, o_orderpriority AS reason FROM orders WHERE o_orderkey % 3 = 0),
    b AS (SELECT id, reason, row_number() OVER (PARTITION BY id ORDER BY a, made, reason) AS rn FROM q) SELECT c_custkey AS id, coalesce(reason, 'unmatched') AS reason FROM customer LEFT JOIN b ON id = c_custkey AND rn = 1""")
def _(t):
    queue = t.orders.where("o_orderkey % 3 = 0").select(F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("candidate_ids"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("resolution"), F.col("o_orderpriority").alias("reason"), F.col("o_orderdate").alias("created_at"))
    return identity.queue_reason(t.customer.select(F.col("c_custkey").alias("id")), queue)


@query("j17_any_name", "WITH k AS (SELECT name, count(DISTINCT team_id) AS n, min(team_id) AS id FROM (SELECT lower(unnest([n_name, 'R' || n_regionkey])) AS name, n_nationkey AS team_id FROM nation) GROUP BY name) SELECT w.id, w.name, CASE WHEN n = 1 THEN k.id END AS team_id FROM (SELECT n_nationkey AS id, upper(n_name) AS name FROM nation UNION ALL SELECT r_regionkey + 100, 'r' || r_regionkey FROM region) w LEFT JOIN k ON lower(w.name) = k.name")
def _(t):
    rows = t.nation.select(F.col("n_nationkey").alias("id"), F.upper("n_name").alias("name")).union(t.region.select(F.col("r_regionkey") + 100, F.concat(F.lit("r"), "r_regionkey")))
    teams = t.nation.select(F.col("n_nationkey").alias("team_id"), "n_name", F.concat(F.lit("R"), "n_regionkey").alias("short"))
    return identity.by_any_name(rows, "name", teams, ["n_name", "short"], "team_id")


@query("j18_name_index", "SELECT name, arg_min(id, struct_pack(r := r, i := id)) AS p_partkey FROM (SELECT lower(p_brand) AS name, 0 AS r, p_partkey AS id FROM part WHERE p_size < 10 UNION ALL SELECT lower(p_name), 1, p_partkey FROM part) GROUP BY name")
def _(t):
    return identity.name_index(t.part.withColumn("stored", F.when(F.col("p_size") < 10, F.col("p_brand"))), "p_partkey", "p_name", "stored")


@query("f15_last_token", "WITH s AS (SELECT lower(split_part(p_name, ' ', -1)) AS token, count(DISTINCT p_partkey) AS n, min(p_partkey) AS player_id FROM part WHERE p_partkey IN (7, 14, 21) GROUP BY 1) SELECT p_partkey AS provider_id, player_id FROM part JOIN s ON lower(split_part(p_name, ' ', -1)) = token WHERE n = 1")
def _(t):
    last = F.element_at(F.split("p_name", " "), -1)
    return identity.last_token(t.part.select(F.col("p_partkey").alias("provider_id"), F.col("p_name").alias("name")), t.part.where("p_partkey IN (7, 14, 21)").select(F.col("p_partkey").alias("player_id"), last.alias("name")))


@query("i03_mapping_history", """WITH c AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 5 <> 0), a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE c_nationkey + 1 END AS v FROM customer WHERE c_custkey % 3 <> 0),
    d AS (SELECT a.k, a.v, c.v AS o FROM a LEFT JOIN c USING (k) WHERE c.v IS DISTINCT FROM a.v) SELECT k, 'approved' AS event, v FROM d UNION ALL SELECT k, 'superseded', o FROM d WHERE o IS NOT NULL""")
def _(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return identity.superseded(t.customer.where(k % 5 != 0).select(k.alias("k"), n.alias("v")), t.customer.where(k % 3 != 0).select(k.alias("k"), F.when(k % 2 == 0, n).otherwise(n + 1).alias("v")), "k", "v")


# ---- aggregates and windows -----------------------------------------------------------------------------------------


@query("a03_epoch_differences", "SELECT o_orderstatus, min(d)::BIGINT AS least, max(d)::BIGINT AS most, avg(d) AS mean FROM (SELECT o_orderstatus, epoch(l_shipdate)::BIGINT - epoch(o_orderdate)::BIGINT AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY o_orderstatus")
def _(t):
    d = S.whole_seconds(F.col("l_shipdate")) - S.whole_seconds(F.col("o_orderdate"))
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus").agg(F.min(d).alias("least"), F.max(d).alias("most"), F.avg(d).alias("mean"))


@query("a05_newest_of_list", "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS newest, count(*) AS n FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("newest"), F.count("*").alias("n"))


@query("a14_nearest_rank", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(value) FILTER (WHERE rn = least(n, floor(0.5 * n) + 1)) AS p50, max(value) FILTER (WHERE rn = least(n, floor(0.9 * n) + 1)) AS p90 FROM r GROUP BY event_type")
def _(t):
    counts = t.events.where("value IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("n"))
    return history.nearest_ranks(t.events.where("value IS NOT NULL"), counts, "event_type", "value", {"p50": 0.5, "p90": 0.9})


@query("a18_daily_coverage", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def _(t):
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("a19_side_by_side", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS finished, (SELECT count(*) FROM customer) AS customers, (SELECT max(event_id) FROM events) AS newest")
def _(t):
    one = t.orders.where("o_orderstatus = 'F'").agg(F.count("*").alias("finished"))
    return one.crossJoin(t.customer.agg(F.count("*").alias("customers"))).crossJoin(t.events.agg(F.max("event_id").alias("newest")))  # one row each


@query("w07_newest_generation", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS state, max(o_orderkey) AS generation FROM orders GROUP BY o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("state"), F.max("o_orderkey").alias("generation"))


@query("w14_sorted_ids", "SELECT s_nationkey, string_agg(DISTINCT s_suppkey::VARCHAR, ',' ORDER BY s_suppkey::VARCHAR) AS ids FROM supplier GROUP BY s_nationkey")
def _(t):
    return t.supplier.groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_set(F.col("s_suppkey").cast("string"))), ",").alias("ids"))


@query("w17_strip_span", "WITH a AS (SELECT user_id, event_id, coalesce(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events) SELECT user_id, event_id FROM a WHERE before < 5")
def _(t):
    return history.strip(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("event_type") != "error", 5).select("user_id", "event_id")


# ---- functions, rules and lifecycle ---------------------------------------------------------------------------------


@query("f11_zero_fill", "SELECT event_id, CASE WHEN event_type <> 'error' AND user_id % 4 <> 0 THEN coalesce(CASE WHEN value < 50 THEN NULL ELSE value END, 0) ELSE CASE WHEN value < 50 THEN NULL ELSE value END END AS stat FROM events")
def _(t):
    return t.events.select("event_id", S.zero_filled(F.when(F.col("value") >= 50, F.col("value")), F.col("event_type") != "error", F.col("user_id") % 4 != 0).alias("stat"))


@query("f13_outcome", "SELECT p_partkey, CASE WHEN trim(lower(n)) NOT IN ('over', 'under') THEN 'unknown_side' WHEN d IS NULL OR d = '' THEN 'missing_description' WHEN pt IS NULL THEN 'missing_point' WHEN pr IS NULL THEN 'missing_price' ELSE 'ok' END AS reason, CASE WHEN trim(lower(n)) IN ('over', 'under') AND d <> '' AND pt IS NOT NULL AND pr IS NOT NULL THEN trunc(pr)::BIGINT END AS price FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ' Over' WHEN 1 THEN 'UNDER ' WHEN 2 THEN 'under' ELSE 'push' END AS n, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS d, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS pt, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS pr FROM part)")
def _(t):
    k, z = F.col("p_partkey"), F.col("p_size") % 4
    rows = t.part.select("p_partkey", F.when(z == 0, " Over").when(z == 1, "UNDER ").when(z == 2, "under").otherwise("push").alias("n"), F.when(k % 11 != 0, F.col("p_name")).alias("d"), F.when(k % 7 != 0, F.col("p_size")).alias("pt"), F.when(k % 5 != 0, F.col("p_retailprice")).alias("pr"))
    got = S.outcome(F.col("n"), F.col("d"), F.col("pt"), F.col("pr"))
    return rows.select("p_partkey", got["reason"].alias("reason"), got["price"].alias("price"))


@query("f19_tip_off", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'A vs B' ELSE 'A @ B' END AS matchup, strftime(timezone('America/New_York', timezone('UTC', ts)), '%-I:%M %p') AS tip_off FROM events")
def _(t):
    return t.events.select("event_id", S.matchup(F.lit("A"), F.lit("B"), F.col("user_id") % 2 == 0).alias("matchup"), S.tip_off(F.col("ts")).alias("tip_off"))


@query("d12_finalization", "SELECT o_orderkey, CASE WHEN l IS NULL THEN 'quarantine' WHEN l = o_orderstatus THEN 'noop' ELSE 'update' END AS action FROM orders LEFT JOIN (SELECT l_orderkey, max(CASE WHEN l_linestatus = 'O' THEN 'O' WHEN l_returnflag <> 'R' THEN 'F' END) AS l FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def _(t):
    known = F.when(F.col("l_linestatus") == "O", "O").when(F.col("l_returnflag") != "R", "F")
    feed = t.lineitem.groupBy("l_orderkey").agg(F.max(known).alias("l"))
    return t.orders.join(feed, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", ingest.finalization(F.col("o_orderstatus"), F.col("l")).alias("action"))


@query("d15_probe_plan", "SELECT epoch(date_trunc('second', ts))::BIGINT AS boundary, count(*) AS games, min(event_id) AS first_id FROM events WHERE event_type = 'view' GROUP BY 1")
def _(t):
    return t.events.where("event_type = 'view'").groupBy(F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("boundary")).agg(F.count("*").alias("games"), F.min("event_id").alias("first_id"))


@query("h17_series_guard", "SELECT coalesce(s.k, r.k) AS event_id, CASE WHEN s.k IS NULL THEN 'outcome_without_game' WHEN r.k IS NULL THEN 'eligible_without_outcome' ELSE 'outcome_of_ineligible' END AS violation FROM (SELECT event_id AS k, value > 20 AS eligible FROM events WHERE event_id % 7 <> 0) s FULL JOIN (SELECT event_id AS k FROM events WHERE value > 25 OR event_id % 50 = 0) r ON s.k = r.k WHERE s.k IS NULL OR coalesce(eligible, false) <> (r.k IS NOT NULL)")
def _(t):
    k = F.col("event_id")
    return history.mismatches(t.events.where(k % 7 != 0).select("event_id", (F.col("value") > 20).alias("eligible")), t.events.where((F.col("value") > 25) | (k % 50 == 0)).select("event_id"), ["event_id"])


@query("t07_slice_watermark", """WITH a AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), f AS (SELECT user_id, min(rn) FILTER (WHERE event_type = 'purchase') AS last FROM a GROUP BY user_id)
    SELECT user_id, CASE WHEN any_value(last) IS NULL THEN 'open' ELSE 'terminal' END AS state, count(*) AS runs, max(rn) FILTER (WHERE event_type <> 'error') AS cursor_at FROM a JOIN f USING (user_id) WHERE last IS NULL OR rn <= last GROUP BY user_id""")
def _(t):
    return presence.slice_watermark(t.events, ["user_id"], [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "purchase", F.col("event_type") == "error")
