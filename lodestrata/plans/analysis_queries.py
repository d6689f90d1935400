"""Reachability, symbols, gates, budgets, stages, cases and loads as queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import budgets, cases, loading, reachability, stages, symbols
from lodestrata.operators.storage import settle
from lodestrata.plans.catalogue_queries import _sql
from lodestrata.plans.queries import query


def _name(prefix: str, c):
    return F.concat(F.lit(prefix), c.cast("string"))


# scripts

def _scripts(v):
    k, i = F.col("p_partkey"), F.floor(F.col("p_partkey") / 40)
    functions = v("part").select(
        _name("p", k % 40).alias("path"), F.concat(F.lit("f"), F.lpad(k.cast("string"), 9, "0")).alias("function_id"), F.when(k % 11 == 0, None).when(k % 11 == 1, "n1").otherwise(_name("n", i)).alias("display_name"), (i * 20_000).alias("body_start"),
        (i * 20_000 + F.when(k % 7 == 0, 30_000).otherwise(15_000)).alias("body_end"),
    )
    n = F.col("l_orderkey")
    sites = v("lineitem").select(
        _name("p", F.col("l_partkey") % 40).alias("path"), (F.floor(F.col("l_partkey") / 40) * 20_000 + (F.col("l_suppkey") * 37 + n * 1009) % 16_000).alias("at"), _name("n", (n + F.col("l_suppkey")) % 900).alias("name"),
        F.when(n % 300 == 0, reachability.FRAMEWORK).when(n % 7 == 1, reachability.EVENT).otherwise(reachability.DIRECT).alias("construct"),
    )
    o = F.col("o_orderkey")
    requests = v("orders").select(_name("p", F.col("o_custkey") % 40).alias("path"), _name("r", o).alias("request_id"), (o * 7919 % 1_100_000).alias("at"))
    return requests, functions, sites


_SCRIPTS = f"""functions AS (SELECT 'p' || (p_partkey % 40) AS path, 'f' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS f, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 11 = 1 THEN 'n1' ELSE 'n' || (p_partkey // 40) END AS name, p_partkey // 40 * 20000 AS s,
  p_partkey // 40 * 20000 + CASE WHEN p_partkey % 7 = 0 THEN 30000 ELSE 15000 END AS e FROM part),
 sites AS (SELECT 'p' || (l_partkey % 40) AS path, l_partkey // 40 * 20000 + (l_suppkey * 37 + l_orderkey * 1009) % 16000 AS place, 'n' || ((l_orderkey + l_suppkey) % 900) AS name,
  CASE WHEN l_orderkey % 300 = 0 THEN '{reachability.FRAMEWORK}' WHEN l_orderkey % 7 = 1 THEN '{reachability.EVENT}' ELSE '{reachability.DIRECT}' END AS construct FROM lineitem),
 requests AS (SELECT 'p' || (o_custkey % 40) AS path, 'r' || o_orderkey AS request_id, o_orderkey * 7919 % 1100000 AS place FROM orders),
 once AS (SELECT path, name, min(f) AS f FROM functions WHERE name IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
 around AS (SELECT p.path, p.place, f.f, f.name FROM (SELECT path, place FROM sites UNION SELECT path, place FROM requests) p JOIN functions f ON f.path = p.path AND f.s <= p.place AND p.place < f.e QUALIFY row_number() OVER (PARTITION BY p.path, p.place ORDER BY f.e - f.s, f.s, f.f) = 1),
 known AS (SELECT DISTINCT s.path, s.place, s.construct, o.f AS callee, a.f AS caller, CASE WHEN s.construct = '{reachability.FRAMEWORK}' THEN 0 WHEN a.f IS NULL THEN CASE WHEN s.construct = '{reachability.EVENT}' THEN 1 ELSE 2 END END AS root
  FROM sites s JOIN once o ON s.path = o.path AND s.name = o.name LEFT JOIN around a ON a.path = s.path AND a.place = s.place),
 roots AS (SELECT path, callee AS f, root, place, construct FROM known WHERE root IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path, callee ORDER BY root, place, construct) = 1),
 calls AS (SELECT path, caller, callee, min(place) AS place FROM known WHERE root IS NULL GROUP BY ALL),
 walk AS (SELECT path, f, 0 AS d FROM roots UNION SELECT w.path, c.callee, d + 1 FROM walk w JOIN calls c ON w.path = c.path AND w.f = c.caller WHERE d < 60),
 least AS (SELECT path, f, min(d) AS d FROM walk GROUP BY ALL),
 best AS (SELECT r.path, r.f, 0 AS d, root, [r.f] AS way FROM roots r UNION ALL
  SELECT path, callee, d, x.root, x.way FROM (SELECT b.path, c.callee, b.d + 1 AS d, min({{'root': b.root, 'way': list_append(b.way, c.callee)}}) AS x FROM best b JOIN calls c ON b.path = c.path AND b.f = c.caller JOIN least l ON l.path = c.path AND l.f = c.callee AND l.d = b.d + 1 GROUP BY b.path, c.callee, b.d))"""


@query
def invocations(v):
    found = reachability.invocation_status(*_scripts(v))
    return found.select("path", "request_id", "at", "status", "root_kind", "owner", F.array_join("call_path", ">").alias("call_path"), F.size("proofs").alias("proofs"))


_sql("invocations", f"""WITH RECURSIVE {_SCRIPTS},
 spelled AS (SELECT b.path, b.f, string_agg(n.name, '>' ORDER BY i) AS call_path FROM (SELECT path, f, unnest(way) AS x, generate_subscripts(way, 1) AS i FROM best) b JOIN functions n ON n.path = b.path AND n.f = b.x WHERE n.name IS NOT NULL GROUP BY ALL)
SELECT q.path, q.request_id, CAST(q.place AS BIGINT) AS at, CASE WHEN a.f IS NULL THEN 'top_level_declaration' WHEN b.f IS NOT NULL THEN 'active_call_path' WHEN o.f IS NOT NULL THEN 'declared_but_unreached' ELSE 'unresolved' END AS status,
 CASE WHEN a.f IS NULL THEN 'top_level_declaration' ELSE ['framework_registered_callback', 'event_registered_callback', 'top_level_direct_call'][b.root + 1] END AS root_kind, a.name AS owner,
 coalesce(call_path, '') AS call_path, coalesce(len(b.way), 0)::INTEGER AS proofs
FROM requests q LEFT JOIN around a ON a.path = q.path AND a.place = q.place LEFT JOIN best b ON b.path = a.path AND b.f = a.f LEFT JOIN once o ON o.path = a.path AND o.name = a.name LEFT JOIN spelled p ON p.path = a.path AND p.f = a.f""")


@query
def symbols_resolved(v):
    k = F.col("p_partkey")
    ref = lambda c: F.concat(F.lit("{s"), F.floor(c).cast("string"), F.lit("}"))
    template = F.when(k % 5 == 0, _name("v", k)).when(k % 5 == 1, F.concat(ref(k / 2), F.lit("/x"))).when(k % 5 == 2, F.concat(ref(k / 7), F.lit("-"), ref(k / 50))).when(k % 25 == 4, "{lost}").when(k % 5 == 3, ref(k + 1)).otherwise(ref(k - 1))
    s = F.col("s_suppkey")
    more = v("supplier").select(_name("x", s).alias("path"), _name("s", s * 15).alias("symbol"), F.when(s % 2 == 0, _name("v", s * 15)).otherwise("other").alias("template"))
    definitions = v("part").select(_name("f", k % 30).alias("path"), _name("s", k).alias("symbol"), template.alias("template")).unionByName(more)
    found = symbols.resolve_symbols(definitions)
    users = v("orders").select(_name("f", F.col("o_custkey") % 30).alias("path"), _name("s", F.col("o_orderkey") % 900).alias("symbol"))
    bound = symbols.bind_consumers(users, found).groupBy("symbol").agg(F.count("*").alias("consumers"))
    return found.join(bound, "symbol", "left").select("symbol", "value", "status", F.coalesce("consumers", F.lit(0)).alias("consumers"))


_sql("symbols_resolved", """WITH RECURSIVE d AS (SELECT 'f' || (p_partkey % 30) AS path, 's' || p_partkey AS symbol, CASE WHEN p_partkey % 5 = 0 THEN 'v' || p_partkey WHEN p_partkey % 5 = 1 THEN '{s' || (p_partkey // 2) || '}/x' WHEN p_partkey % 5 = 2 THEN '{s' || (p_partkey // 7) || '}-{s' || (p_partkey // 50) || '}'
   WHEN p_partkey % 25 = 4 THEN '{lost}' WHEN p_partkey % 5 = 3 THEN '{s' || (p_partkey + 1) || '}' ELSE '{s' || (p_partkey - 1) || '}' END AS template FROM part
  UNION ALL SELECT 'x' || s_suppkey, 's' || (s_suppkey * 15), CASE WHEN s_suppkey % 2 = 0 THEN 'v' || (s_suppkey * 15) ELSE 'other' END FROM supplier),
 j AS (SELECT symbol, count(*) AS n, count(DISTINCT template) AS templates, min(template) AS template, min(path) AS path FROM d GROUP BY symbol),
 t AS (SELECT symbol, template AS text, 0 AS n FROM j WHERE n = 1
  UNION ALL SELECT t.symbol, substr(t.text, 1, strpos(t.text, '{') - 1) || o.template || substr(t.text, strpos(t.text, '}') + 1), t.n + 1 FROM t JOIN j o ON o.n = 1 AND o.symbol = substr(t.text, strpos(t.text, '{') + 1, strpos(t.text, '}') - strpos(t.text, '{') - 1) WHERE t.n < 60 AND contains(t.text, '{')),
 r AS (SELECT symbol, text AS value FROM t WHERE NOT contains(text, '{')),
 u AS (SELECT DISTINCT 'f' || (o_custkey % 30) AS path, 's' || (o_orderkey % 900) AS symbol FROM orders),
 c AS (SELECT u.symbol, count(*) AS consumers FROM u JOIN r USING (symbol) JOIN j USING (symbol) WHERE u.path <> j.path GROUP BY ALL)
SELECT symbol, r.value, CASE WHEN j.templates > 1 THEN 'conflict' WHEN j.n > 1 THEN 'ambiguous' WHEN r.symbol IS NOT NULL THEN 'resolved' ELSE 'open' END AS status, coalesce(consumers, 0) AS consumers FROM j LEFT JOIN r USING (symbol) LEFT JOIN c USING (symbol)""")


@query
def gates_joined(v):
    c, k, s = F.col("c_custkey"), F.col("p_partkey"), F.col("s_suppkey")
    macros = v("customer").select(F.lit("macro.js").alias("path"), _name("F", F.when(c % 10 == 0, c % 50).otherwise(c)).alias("symbol"), _name("", c % 2).alias("value"))
    maps = v("part").select(_name("m", k % 20).alias("path"), (F.floor(k / 20) * 3000).alias("end"), _name("F", k % 1000).alias("symbol"), _name("t", k % 50).alias("target"))
    reveals = v("supplier").select(_name("m", s % 20).alias("path"), (F.floor(s / 20) * 9100 + s % 7 * 100).alias("at"), _name("", s % 2).alias("enabled_value"))
    routes = v("customer").select(_name("m", c % 20).alias("path"), _name("t", c % 50).alias("target"), F.concat(F.lit("w/x"), (c % 50).cast("string"), F.lit(".html")).alias("page"))
    scripts = v("orders").select(F.concat(F.lit("w/x"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".html")).alias("page"), F.concat(F.lit("js/x"), (F.col("o_custkey") % 60).cast("string"), F.lit(".js")).alias("script"))
    requests = v("lineitem").select(F.concat(F.lit("js/x"), (F.col("l_partkey") % 45).cast("string"), F.lit(".js")).alias("path"), _name("q", F.col("l_suppkey") % 5).alias("request_id"))
    return symbols.feature_gates(macros, maps, reveals, routes, scripts, requests).withColumn("requests", F.array_join("requests", ","))


_sql("gates_joined", """WITH macros AS (SELECT 'F' || CASE WHEN c_custkey % 10 = 0 THEN c_custkey % 50 ELSE c_custkey END AS symbol, min(CAST(c_custkey % 2 AS VARCHAR)) AS configured FROM customer GROUP BY 1 HAVING count(*) = 1),
 maps AS (SELECT 'm' || (p_partkey % 20) AS path, p_partkey // 20 * 3000 AS past, 'F' || (p_partkey % 1000) AS symbol, 't' || (p_partkey % 50) AS target FROM part),
 reveals AS (SELECT 'm' || (s_suppkey % 20) AS path, s_suppkey // 20 * 9100 + s_suppkey % 7 * 100 AS place, CAST(s_suppkey % 2 AS VARCHAR) AS enabled_value FROM supplier),
 shown AS (SELECT m.*, r.enabled_value FROM maps m JOIN reveals r ON r.path = m.path AND r.place BETWEEN m.past AND m.past + 4096 QUALIFY row_number() OVER (PARTITION BY m.path, m.past, m.symbol, m.target ORDER BY r.place, r.enabled_value) = 1),
 routes AS (SELECT 'm' || (c_custkey % 20) AS path, 't' || (c_custkey % 50) AS target, min('w/x' || (c_custkey % 50) || '.html') AS page FROM customer GROUP BY 1, 2),
 scripts AS (SELECT DISTINCT 'w/x' || (o_orderkey % 50) || '.html' AS page, 'js/x' || (o_custkey % 60) || '.js' AS script FROM orders WHERE o_orderkey % 50 = o_custkey % 60),
 asked AS (SELECT page, string_agg(DISTINCT 'q' || (l_suppkey % 5), ',' ORDER BY 'q' || (l_suppkey % 5)) AS requests FROM lineitem JOIN scripts ON script = 'js/x' || (l_partkey % 45) || '.js' GROUP BY page)
SELECT DISTINCT path, symbol, target, page, configured, enabled_value, CASE WHEN configured = enabled_value THEN 'enabled' ELSE 'disabled' END AS status, requests FROM shown JOIN macros USING (symbol) JOIN routes USING (path, target) JOIN asked USING (page)""")


# inventories

@query
def inventory_within_budgets(v):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    path = lambda kind, n, m: F.concat(F.lit("d"), (n % m).cast("string"), F.lit(f"/{kind}"), F.lpad(n.cast("string"), 9, "0"))
    # an inode's names have one size
    size = F.when(k % 9 == 0, k % 40 * 90).otherwise(k * 7919 % 5000)
    files = v("part").select(path("f", k, 17).alias("canonical_path"), size.alias("size"), F.when(k % 9 == 0, k % 40).alias("inode"))
    links = v("supplier").select(path("l", s, 13).alias("canonical_path"), F.lit(4).cast("long").alias("size"), F.when(s % 3 == 0, "missing").otherwise("resolved").alias("status"))
    n = v("part").count()
    return budgets.inventory_entries(files, links, n * 7 // 10, 4800, n * 1300)


_sql("inventory_within_budgets", """WITH RECURSIVE e AS (SELECT 'd' || (p_partkey % 17) || '/f' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS p, CASE WHEN p_partkey % 9 = 0 THEN p_partkey % 40 * 90 ELSE p_partkey * 7919 % 5000 END AS size, CASE WHEN p_partkey % 9 = 0 THEN p_partkey % 40 END AS inode, CAST(NULL AS VARCHAR) AS link FROM part
  UNION ALL SELECT 'd' || (s_suppkey % 13) || '/l' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 4, NULL, CASE WHEN s_suppkey % 3 = 0 THEN 'missing' ELSE 'resolved' END FROM supplier),
 o AS (SELECT *, row_number() OVER (ORDER BY p) AS i FROM e), b AS (SELECT count(*) * 7 // 10 AS files, count(*) * 1300 AS bytes FROM part),
 w AS (SELECT 0::BIGINT AS i, 0::BIGINT AS n, 0::BIGINT AS spent, MAP {}::MAP(BIGINT, VARCHAR) AS seen, NULL::VARCHAR AS p, NULL::BIGINT AS size, NULL::VARCHAR AS kind, NULL::VARCHAR AS parent_path, NULL::VARCHAR AS status
  UNION ALL SELECT x.i, x.n + CASE WHEN x.s IN ('file_count', 'file_size', 'total_bytes') THEN 0 ELSE 1 END, x.spent + CASE WHEN x.s = 'completed' THEN x.size ELSE 0 END, CASE WHEN x.s = 'completed' AND x.inode IS NOT NULL THEN map_concat(x.seen, MAP {x.inode: x.p}) ELSE x.seen END, x.p, x.size,
   CASE WHEN x.link IS NOT NULL THEN 'symlink' WHEN x.held THEN 'hardlink' ELSE 'file' END, CASE WHEN x.held THEN x.seen[x.inode] END, x.s
  FROM (SELECT o.*, w.n, w.spent, w.seen, o.inode IS NOT NULL AND len(map_extract(w.seen, o.inode)) > 0 AS held,
     CASE WHEN w.n >= b.files THEN 'file_count' WHEN o.link IS NOT NULL THEN o.link WHEN o.inode IS NOT NULL AND len(map_extract(w.seen, o.inode)) > 0 THEN 'hardlink' WHEN o.size > 4800 THEN 'file_size' WHEN w.spent + o.size > b.bytes THEN 'total_bytes' ELSE 'completed' END AS s
   FROM w JOIN o ON o.i = w.i + 1, b) x)
SELECT p AS canonical_path, kind, size, parent_path, status FROM w WHERE i > 0""")


# runs

def _runs(v):
    o, n = F.col("o_orderkey"), F.col("l_linenumber")
    stage = _name("s", o % 12)
    every = v("orders").groupBy((F.col("o_custkey") % 700).alias("run_id"), stage.alias("stage")).agg(F.min("o_orderstatus").alias("s"), (F.min("o_orderkey") % 10 != 0).alias("enabled"))
    table = every.select("run_id", "stage", F.when(F.col("s") == "F", "completed").when(F.col("s") == "O", "partial").otherwise("failed").alias("outcome"), "enabled")
    on = F.when(F.col("l_quantity") < 2, (o % 12 + 1) % 14).when(F.col("l_quantity") < 3, F.lit(13)).otherwise(o % 12 - 1 - n % 3)
    rows = v("lineitem").join(v("orders"), F.col("l_orderkey") == o).select((F.col("o_custkey") % 700).alias("run_id"), stage.alias("stage"), on.alias("n")).where("n >= 0")
    # most runs have few stages: a need of one that is not there is known only for the thirteenth
    needs = rows.select("run_id", "stage", _name("s", F.col("n")).alias("needs")).distinct()
    there = needs.join(table.select("run_id", F.col("stage").alias("needs")), ["run_id", "needs"], "left_semi").unionByName(needs.where("needs = 's13'").select("run_id", "needs", "stage"))
    return table, there.select("run_id", "stage", "needs")


@query
def stages_ordered(v):
    return stages.run_order(*_runs(v))


_sql("stages_ordered", """WITH RECURSIVE s AS (SELECT o_custkey % 700 AS run_id, 's' || (o_orderkey % 12) AS stage, CASE min(o_orderstatus) WHEN 'F' THEN 'completed' WHEN 'O' THEN 'partial' ELSE 'failed' END AS outcome, min(o_orderkey) % 10 <> 0 AS enabled FROM orders GROUP BY 1, 2),
 r AS (SELECT DISTINCT o_custkey % 700 AS run_id, 's' || (o_orderkey % 12) AS stage, CASE WHEN l_quantity < 2 THEN (o_orderkey % 12 + 1) % 14 WHEN l_quantity < 3 THEN 13 ELSE o_orderkey % 12 - 1 - l_linenumber % 3 END AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 e AS (SELECT run_id, r.stage, 's' || n AS needs FROM r JOIN s t USING (run_id) WHERE n >= 0 AND t.stage = 's' || n), lost AS (SELECT DISTINCT run_id, stage FROM r WHERE n = 13),
 reach AS (SELECT run_id, stage, needs AS far FROM e UNION SELECT reach.run_id, reach.stage, e.needs FROM reach JOIN e ON e.run_id = reach.run_id AND e.stage = reach.far),
 loops AS (SELECT DISTINCT run_id, stage FROM reach WHERE stage = far), stuck AS (SELECT run_id, stage FROM loops UNION SELECT reach.run_id, reach.stage FROM reach JOIN loops ON loops.run_id = reach.run_id AND loops.stage = reach.far),
 level AS (SELECT run_id, stage, 0 AS layer FROM s ANTI JOIN stuck USING (run_id, stage) UNION SELECT e.run_id, e.stage, layer + 1 FROM level JOIN e ON e.run_id = level.run_id AND e.needs = level.stage ANTI JOIN stuck ON stuck.run_id = e.run_id AND stuck.stage = e.stage),
 layers AS (SELECT run_id, stage, max(layer) AS layer FROM level GROUP BY ALL),
 own AS (SELECT s.*, lost.stage IS NOT NULL AS lost, layer, lost.stage IS NOT NULL OR NOT enabled OR outcome = 'failed' AS bad FROM s JOIN layers USING (run_id, stage) LEFT JOIN lost USING (run_id, stage)),
 fails AS (SELECT run_id, stage FROM own WHERE bad UNION SELECT reach.run_id, reach.stage FROM reach JOIN own ON own.run_id = reach.run_id AND own.stage = reach.far AND own.bad),
 down AS (SELECT DISTINCT e.run_id, e.stage, e.needs FROM e JOIN fails ON fails.run_id = e.run_id AND fails.stage = e.needs),
 w AS (SELECT run_id, stage, stage AS now FROM own JOIN fails USING (run_id, stage) UNION SELECT w.run_id, w.stage, down.needs FROM w JOIN own ON own.run_id = w.run_id AND own.stage = w.now AND NOT own.lost AND own.enabled JOIN down ON down.run_id = w.run_id AND down.stage = w.now),
 cause AS (SELECT w.run_id, w.stage, min(CASE WHEN own.lost THEN 's13' ELSE w.now END) AS cause FROM w JOIN own ON own.run_id = w.run_id AND own.stage = w.now WHERE own.lost OR NOT own.enabled OR NOT EXISTS (SELECT 1 FROM down WHERE down.run_id = w.run_id AND down.stage = w.now) GROUP BY ALL)
SELECT run_id, stage, layer, CASE WHEN lost THEN 'missing' WHEN NOT enabled THEN 'skipped' WHEN cause IS NOT NULL AND EXISTS (SELECT 1 FROM down WHERE down.run_id = own.run_id AND down.stage = own.stage) THEN 'skipped' ELSE outcome END AS status, cause FROM own LEFT JOIN cause USING (run_id, stage)
UNION ALL SELECT run_id, stage, NULL, CASE WHEN loops.stage IS NOT NULL THEN 'cycle' ELSE 'blocked' END, NULL FROM stuck LEFT JOIN loops USING (run_id, stage)""")


# cases

def _cases(v) -> cases.Cases:
    o, key = F.col("o_orderkey"), _name("case", F.col("o_custkey"))
    orders = v("orders")
    texts = lambda *x: F.array(*(F.lit(t) for t in x)).cast("array<string>")
    some = lambda condition: F.when(condition, texts("x")).otherwise(texts())
    c = F.col("c_custkey")
    evidence = orders.select(key.alias("case_key"), _name("e", o % 30).alias("evidence_ref"), F.substring("o_orderpriority", 1, 1).alias("kind"), _name("", o % 30).alias("sha256"))
    claims = orders.select(key.alias("case_key"), _name("c", o).alias("claim_id"), F.lit("holds").alias("statement"), F.array(_name("e", o % 30), _name("e", F.when(o % 40 == 0, 31).otherwise(o % 30))).alias("evidence_refs"))
    obligations = orders.select(key.alias("case_key"), _name("o", o).alias("obligation_id"), F.when(o % 5 == 0, "open").when(o % 5 == 1, "rejected").otherwise("resolved").alias("status"), F.array(_name("e", F.when(o % 50 == 3, 32).otherwise(o % 30))).alias("closure_refs"))
    # each order is a stage that creates its obligation; the next stage but the sixth of each case closes it
    begins = orders.select(key.alias("case_key"), _name("a", o).alias("stage_id"), (o * 2).cast("int").alias("order"), F.array(_name("c", F.when(o % 60 == 7, 0).otherwise(o))).alias("claim_ids"), F.when(o % 45 == 9, texts()).otherwise(F.array(_name("o", o))).alias("creates"), texts().alias("resolves"), texts().alias("rejects"))
    mine = F.array(_name("o", o))
    closes = orders.select(key.alias("case_key"), _name("b", F.when(o % 70 == 8, F.lit(0)).otherwise(o)).alias("stage_id"), (o * 2 + F.when(o % 35 == 2, -1).otherwise(1)).cast("int").alias("order"), texts().alias("claim_ids"), texts().alias("creates"), F.when(o % 5 > 1, mine).when(o % 55 == 0, mine).otherwise(texts()).alias("resolves"), F.when(o % 5 == 1, mine).when(o % 65 == 4, mine).otherwise(texts()).alias("rejects"))
    rows = v("customer").select(_name("case", c).alias("case_key"), F.lit("t").alias("title"), F.lit("").alias("case_id"), some(c % 6 != 0).alias("counterfactuals"), some(c % 7 != 0).alias("paper_uses"), some(c % 8 != 0).alias("limitations"))
    return cases.Cases(rows, evidence, claims, begins.unionByName(closes), obligations)


@query
def case_corpus_issues(v):
    """Recorded identities are those that replay, but of every ninth case."""
    c = _cases(v)
    replayed = settle(cases.case_identities(c))
    ids = replayed.select("case_key", F.when(F.substring_index("case_key", "case", -1).cast("long") % 9 == 0, "old").otherwise(F.col("replayed_id")).alias("case_id"))
    recorded = c.cases.drop("case_id").join(ids, "case_key").select(*c.cases.columns)
    return cases.corpus_issues(cases.Cases(recorded, c.evidence, c.claims, c.stages, c.obligations), replayed)


_sql("case_corpus_issues", """WITH o AS (SELECT 'case' || o_custkey AS case_key, o_orderkey AS n, o_orderkey % 30 AS r, substr(o_orderpriority, 1, 1) AS kind FROM orders), c AS (SELECT c_custkey AS n, 'case' || c_custkey AS case_key FROM customer),
 e AS (SELECT DISTINCT case_key, 'e' || r AS ref FROM o), cited AS (SELECT case_key, unnest(['e' || r, 'e' || CASE WHEN n % 40 = 0 THEN 31 ELSE r END]) AS ref FROM o), closing AS (SELECT case_key, 'e' || CASE WHEN n % 50 = 3 THEN 32 ELSE r END AS ref FROM o),
 st AS (SELECT case_key, 'a' || n AS stage_id, n * 2 AS ord FROM o UNION ALL SELECT case_key, 'b' || CASE WHEN n % 70 = 8 THEN 0 ELSE n END, n * 2 + CASE WHEN n % 35 = 2 THEN -1 ELSE 1 END FROM o),
 m AS (SELECT *, n % 45 <> 9 AS created, n % 5 > 1 OR n % 55 = 0 AS resolved, n % 5 = 1 OR (n % 65 = 4 AND n % 5 <= 1) OR (n % 65 = 4) AS rejected, CASE WHEN n % 5 = 0 THEN 'open' WHEN n % 5 = 1 THEN 'rejected' ELSE 'resolved' END AS status, n % 35 = 2 AS early FROM o)
SELECT case_key, 'evidence_repeated' AS rule, 'e' || r AS detail FROM o GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT case_key, 'claim_evidence_unknown', ref FROM (SELECT DISTINCT * FROM cited) ANTI JOIN e USING (case_key, ref)
UNION ALL SELECT case_key, 'closure_evidence_unknown', ref FROM (SELECT DISTINCT * FROM closing) ANTI JOIN e USING (case_key, ref)
UNION ALL SELECT DISTINCT case_key, 'stage_claim_unknown', 'c0' FROM o WHERE n % 60 = 7 AND NOT EXISTS (SELECT 1 FROM o z WHERE z.case_key = o.case_key AND z.n = 0)
UNION ALL SELECT case_key, 'stage_repeated', stage_id FROM st GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT case_key, 'order_repeated', CAST(ord AS VARCHAR) FROM st GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT case_key, 'closed_before_created', 'o' || n FROM m WHERE (resolved OR rejected) AND (early OR NOT created)
UNION ALL SELECT case_key, 'never_created', 'o' || n FROM m WHERE NOT created
UNION ALL SELECT case_key, 'resolved_by_no_stage', 'o' || n FROM m WHERE status = 'resolved' AND NOT resolved
UNION ALL SELECT case_key, 'rejected_by_no_stage', 'o' || n FROM m WHERE status = 'rejected' AND NOT rejected
UNION ALL SELECT case_key, 'open_but_closed', 'o' || n FROM m WHERE status = 'open' AND (resolved OR rejected)
UNION ALL SELECT case_key, 'resolved_but_rejected', 'o' || n FROM m WHERE status = 'resolved' AND rejected
UNION ALL SELECT case_key, 'rejected_but_resolved', 'o' || n FROM m WHERE status = 'rejected' AND resolved
UNION ALL SELECT case_key, 'identity_does_not_replay', 'old' FROM c WHERE n % 9 = 0
UNION ALL SELECT c.case_key, 'fewer_than_two_kinds_of_evidence', CAST(count(DISTINCT kind) AS VARCHAR) FROM c LEFT JOIN o USING (case_key) GROUP BY c.case_key HAVING count(DISTINCT kind) < 2
UNION ALL SELECT case_key, 'counterfactuals_missing', '' FROM c WHERE n % 6 = 0 UNION ALL SELECT case_key, 'paper_uses_missing', '' FROM c WHERE n % 7 = 0 UNION ALL SELECT case_key, 'limitations_missing', '' FROM c WHERE n % 8 = 0""")


# loads

@query
def loads_judged(v):
    e = F.col("event_id")
    body = F.when(e % 17 == 0, F.concat(F.lit('{"clue_id": "c'), e, F.lit('", "routes": '))).otherwise(F.to_json(F.struct(F.when(e % 11 != 0, _name("c", e % 4000)).alias("clue_id"), F.col("event_type").alias("kind"), F.floor(F.col("value")).cast("long").alias("weight"), F.when(e % 7 != 0, F.array(F.concat(F.lit("/r"), e % 3))).otherwise(F.array().cast("array<string>")).alias("routes"))))
    rows = loading.parsed(v("events").select("event_id", body.alias("body")), "body", "clue_id string, kind string, weight long, routes array<string>")
    rules = [loading.Rule("named", "clue_id", F.col("clue_id").rlike("^c[0-9]+$")), loading.Rule("weighed", "weight", F.col("weight").between(0, 60)), loading.Rule("routed", "routes", F.size("routes") > 0), loading.Rule("known_kind", "kind", F.col("kind") != "error")]
    single = loading.judged(rows, rules).select("event_id", F.explode("violations").alias("x")).select(F.col("event_id").cast("string").alias("document"), "x.rule", "x.at")
    repeated = loading.violations(rows.where(F.col(loading.CORRUPT).isNull()), [], "clue_id").select(F.col("clue_id").alias("document"), "rule", "at")
    return single.unionByName(repeated)


_sql("loads_judged", """WITH d AS (SELECT event_id, event_id % 17 = 0 AS bad, CASE WHEN event_id % 11 <> 0 THEN 'c' || (event_id % 4000) END AS clue_id, event_type AS kind, CAST(floor(value) AS BIGINT) AS weight, event_id % 7 <> 0 AS routed FROM events)
SELECT CAST(event_id AS VARCHAR) AS document, 'readable' AS rule, '' AS at FROM d WHERE bad UNION ALL SELECT CAST(event_id AS VARCHAR), 'named', 'clue_id' FROM d WHERE NOT bad AND clue_id IS NULL UNION ALL SELECT CAST(event_id AS VARCHAR), 'weighed', 'weight' FROM d WHERE NOT bad AND NOT coalesce(weight BETWEEN 0 AND 60, false)
UNION ALL SELECT CAST(event_id AS VARCHAR), 'routed', 'routes' FROM d WHERE NOT bad AND NOT routed UNION ALL SELECT CAST(event_id AS VARCHAR), 'known_kind', 'kind' FROM d WHERE NOT bad AND NOT coalesce(kind <> 'error', false)
UNION ALL SELECT clue_id, 'repeated', 'clue_id' FROM d WHERE NOT bad AND clue_id IS NOT NULL GROUP BY clue_id HAVING count(*) > 1""")
