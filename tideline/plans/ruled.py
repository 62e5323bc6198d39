"""Queries of rules in a fixed order, shapes of payloads, canonical hashes and landed pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import rules
from tideline.plans.catalogue import query
from tideline.sources import landing

FLAGS = {11: "duplicate_source_key", 13: "missing_player", 17: "missing_game", 19: "unknown_game_status", 7: "unresolved_minutes", 23: "team_not_in_game", 29: "season_mismatch", 31: "unsupported_competition_team"}
STATE = " ".join(f"WHEN k % {n} = 0 THEN '{'unresolved_minutes' if r == 'unresolved_minutes' else 'quarantined'}'" for n, r in FLAGS.items())
REASON = " ".join(f"WHEN k % {n} = 0 THEN {'NULL' if r == 'unresolved_minutes' else repr(r)}" for n, r in FLAGS.items())


@query("d08_stat_eligibility", f"SELECT k AS stat_id, CASE {STATE} WHEN s <> 'F' THEN 'live_or_non_final' WHEN k % 5 = 0 THEN 'non_participation' ELSE 'eligible' END AS state, CASE {REASON} END AS quarantine_reason FROM (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders)")
def _(t):
    k = F.col("o_orderkey")
    n = lambda m: k % m == 0
    rows = t.orders.select(
        k.alias("stat_id"), n(11).alias("duplicate"), F.when(~n(13), F.col("o_custkey")).alias("player"), F.when(~n(17), k).alias("game"), F.when(n(19), "unknown").when(F.col("o_orderstatus") == "F", "final").otherwise("live").alias("game_status"),
        F.when(n(7), "unresolved_non_numeric").when(n(5), "dnp").otherwise("played").alias("minutes_status"), F.when(n(23), "Z").when(n(2), "A").otherwise("B").alias("team"), F.lit("A").alias("home_team"), F.lit("B").alias("away_team"), F.when(n(29), 2024).otherwise(2025).alias("season"), F.lit(2025).alias("game_season"), (~n(31)).alias("supported"),
    )
    return rules.stat_eligibility(rows).select("stat_id", "state", "quarantine_reason")


@query("d09_stat_invalidations", "WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS p, o_orderkey % 7 = 0 AS m FROM orders WHERE o_orderkey % 3 = 0) SELECT k AS stat_id, 'player_game_stat' AS kind, k::VARCHAR AS entity, 'material_stat_change' AS reason FROM c UNION ALL SELECT k, 'player_game_stat', k::VARCHAR, 'minutes_state_change' FROM c WHERE m UNION ALL SELECT k, 'internal_player', p::VARCHAR, 'material_stat_change' FROM c WHERE p IS NOT NULL UNION ALL SELECT k, 'internal_game', (k * 2)::VARCHAR, 'material_stat_change' FROM c")
def _(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(k.alias("stat_id"), F.when(k % 13 != 0, F.col("o_custkey")).alias("player"), (k * 2).alias("game"), F.when(k % 3 == 0, "material").otherwise("metadata_only").alias("kind"), (k % 7 == 0).alias("minutes_changed"))
    return rules.stat_invalidations(rows)


#: Sentences by key: with forbidden terms, with near ones, and one that is exempt.
SAID = ["{} is a lock", "unlocked {}", "free  money from {}", "the EV of {}", "the ev of {}", "+EV, says {}", "{} can't miss, risk-free", rules.EXEMPT[1], "{}: guarantees and probabilities", "proven winners {}"]


def found_sql() -> str:
    hits = []
    for term, kind, cased in rules.FORBIDDEN:
        t = term.replace("+", r"\+").replace("-", r"\-").replace("'", "''").replace(" ", r"\s+")
        t = rf"\b{t}\b" if kind == "word" else rf"(?:^|\W){t}(?:$|\W)"
        hits.append(f"""CASE WHEN regexp_matches(s, '{t}'{"" if cased else ", 'i'"}) THEN '{term.replace("'", "''")}' END""")
    return f"concat_ws('|', {', '.join(hits)})"


WHICH = " ".join(f"WHEN {i} THEN replace('{x.replace(chr(39), chr(39) * 2)}', '{{}}', c_name)" for i, x in enumerate(SAID))


@query("v10_forbidden_copy", f"SELECT c_custkey, CASE WHEN s = '{rules.EXEMPT[1]}' THEN '' ELSE {found_sql()} END AS found FROM (SELECT c_custkey, CASE c_custkey % 10 {WHICH} END AS s FROM customer)")
def _(t):
    said = F.get(F.array(*[F.replace(F.lit(x), F.lit("{}"), F.col("c_name")) for x in SAID]), (F.col("c_custkey") % 10).cast("int"))
    return t.customer.select("c_custkey", F.concat_ws("|", rules.forbidden_copy(said)).alias("found"))


#: Payloads as JSON, with what may be wrong in them by their order's key.
BODY = """CASE WHEN k % 17 = 0 THEN '[' || k || ']' WHEN k % 13 = 0 THEN '{"bookmakers": "' || k || '"}' WHEN k % 11 = 0 THEN '{"bookmakers": []}'
    ELSE '{"bookmakers": [' || CASE WHEN k % 7 = 0 THEN k || ', ' ELSE '' END || '{"key": "b' || k || '", "markets": [{"key": ' || CASE WHEN k % 5 = 0 THEN '""' ELSE '"m"' END || ', "outcomes": ' || CASE WHEN k % 3 = 0 THEN '{"a": 1}' ELSE '[1]' END || '}' || CASE WHEN k % 4 = 0 THEN ', null' ELSE '' END || ']}]}' END"""
KINDS = "CASE {} WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'bigint' WHEN 'BIGINT' THEN 'bigint' WHEN 'NULL' THEN 'void' ELSE lower(coalesce({}, 'missing')) END"


def kind(x: str) -> str:
    return KINDS.format(x, x)


SHAPES = f"""WITH p AS (SELECT k, {BODY} AS body FROM (SELECT o_orderkey AS k FROM orders)), r AS (SELECT k, body::JSON AS v FROM p), t AS (SELECT k, v, {kind("json_type(v)")} AS kv, {kind("json_type(v, '$.bookmakers')")} AS kb FROM r),
i AS (SELECT k, n - 1 AS i, json_extract(v, '$.bookmakers[' || (n - 1) || ']') AS b FROM (SELECT k, v, unnest(generate_series(1, json_array_length(v, '$.bookmakers')::BIGINT)) AS n FROM t WHERE kb = 'array')), j0 AS (SELECT *, {kind("json_type(b)")} AS kb, {kind("json_type(b, '$.key')")} AS kk, {kind("json_type(b, '$.markets')")} AS km FROM i),
j AS (SELECT k, i, n - 1 AS j, json_extract(b, '$.markets[' || (n - 1) || ']') AS m FROM (SELECT k, i, b, unnest(generate_series(1, json_array_length(b, '$.markets')::BIGINT)) AS n FROM j0 WHERE km = 'array')), m0 AS (SELECT *, {kind("json_type(m)")} AS km, {kind("json_type(m, '$.key')")} AS kk, {kind("json_type(m, '$.outcomes')")} AS ko, '$.bookmakers[' || i || '].markets[' || j || ']' AS place FROM j)
SELECT k AS id, '$' AS path, 'object' AS expected, kv AS found FROM t WHERE kv <> 'object' UNION ALL SELECT k, '$.bookmakers', 'array', kb FROM t WHERE kv = 'object' AND kb <> 'array'
UNION ALL SELECT k, '$.bookmakers[' || i || ']', 'object', kb FROM j0 WHERE kb <> 'object' UNION ALL SELECT k, '$.bookmakers[' || i || '].key', 'string', kk FROM j0 WHERE kb = 'object' AND (kk <> 'string' OR b ->> '$.key' = '') UNION ALL SELECT k, '$.bookmakers[' || i || '].markets', 'array', km FROM j0 WHERE kb = 'object' AND km <> 'array'
UNION ALL SELECT k, place, 'object', km FROM m0 WHERE km <> 'object' UNION ALL SELECT k, place || '.key', 'string', kk FROM m0 WHERE km = 'object' AND (kk <> 'string' OR m ->> '$.key' = '') UNION ALL SELECT k, place || '.outcomes', 'array', ko FROM m0 WHERE km = 'object' AND ko NOT IN ('array', 'missing')"""


def payloads(t):
    return t.orders.select(F.col("o_orderkey").alias("k")).select(F.col("k").alias("id"), F.expr(BODY).alias("body"))


@query("d02_shape_violations", SHAPES)
def _(t):
    return rules.shape_violations(payloads(t), "id", "body").select("id", "path", "expected", "found")


@query("d02_payload_shape", f"WITH v AS ({SHAPES}) SELECT o_orderkey AS id, CASE WHEN n > 0 THEN 'schema_drift' WHEN o_orderkey % 11 = 0 THEN 'valid_empty' ELSE 'valid' END AS state, coalesce(n, 0) AS violations FROM orders LEFT JOIN (SELECT id, count(*) AS n FROM v GROUP BY id) w ON w.id = o_orderkey")
def _(t):
    return rules.payload_shape(payloads(t), "id", "body").select("id", "state", "violations")


@query("f12_canonical_json", """SELECT o_orderkey, sha256('{"a":[' || o_orderkey || ',{"x":null,"y":"1.0 ' || o_orderstatus || '"}],"b":' || o_custkey || '}') AS hash FROM orders""")
def _(t):
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    text = F.when(k % 2 == 0, F.concat(F.lit('{"b": '), c, F.lit('.0, "a": ['), k, F.lit(', {"y": "1.0 '), s, F.lit('", "x": null}]}'))).otherwise(F.concat(F.lit('{"a":['), k, F.lit('.00,{"x":null,"y":"1.0 '), s, F.lit('"}], "b":'), c, F.lit("}")))
    return t.orders.select("o_orderkey", rules.content_hash(text).alias("hash"))


@query("s04_cursor_chains", "WITH p AS (SELECT o_custkey AS chain, o_orderkey AS k, row_number() OVER w AS rn, lead(o_orderkey) OVER w IS NULL AS final, o_orderkey % 13 = 0 AS bad FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), e AS (SELECT chain, least(min(rn) FILTER (WHERE bad), 26) AS stop, count(*) AS n FROM p GROUP BY chain) SELECT chain, CASE WHEN stop IS NULL THEN 'complete' WHEN stop = 26 AND n > 25 THEN 'partial_pagination' WHEN stop = 26 THEN 'complete' ELSE 'rate_limited' END AS state, (SELECT count(*) FROM p WHERE p.chain = e.chain AND rn < coalesce(stop, 1000)) AS pages FROM e".replace("least(min(rn) FILTER (WHERE bad), 26)", "coalesce(least(min(rn) FILTER (WHERE bad), 26), 26)"))
def _(t):
    from pyspark.sql import Window

    w, k = Window.partitionBy("o_custkey").orderBy("o_orderkey"), F.col("o_orderkey")
    pages = t.orders.select(F.col("o_custkey").alias("chain"), F.when(F.row_number().over(w) > 1, k).cast("string").alias("cursor"), F.lead(k).over(w).cast("string").alias("next_cursor"), F.when(k % 13 == 0, "rate_limited").alias("failure"), F.lit(1).cast("long").alias("n_rows"))
    return landing.follow_cursors(pages, 25).select("chain", "state", F.size("cursors").cast("long").alias("pages"))
