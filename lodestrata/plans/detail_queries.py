"""Linked publication, lookups by id, alignments, presets and small rules as queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import models
from lodestrata.functions.versions import meaningful_identity
from lodestrata.operators import catalogue, correlation, exploration, graph, history, merging, paging, relevance, storage
from lodestrata.plans.catalogue_queries import _sql
from lodestrata.plans.queries import query
from lodestrata.sources import feeds, producers


@query
def graphs_published(v):
    """Graphs name a catalogue and nodes; those that name none that is known are refused."""
    c, n = v("customer"), F.col("c_custkey")
    rows = c.select(n.alias("graph_id"), F.when(n % 4 != 0, F.concat(F.lit("cat"), n * 10)).alias("catalog_id"), F.array(F.concat(F.lit("n"), F.col("c_nationkey")), F.concat(F.lit("r"), n % 7)).alias("nodes"), F.when(n % 9 == 0, "changed").otherwise("same").alias("body"))
    known = c.where(n % 6 == 0).select(n.alias("graph_id"), F.when(n % 4 != 0, F.concat(F.lit("cat"), n * 10)).alias("catalog_id"), F.array(F.concat(F.lit("n"), F.col("c_nationkey")), F.concat(F.lit("r"), n % 7)).alias("nodes"), F.lit("same").alias("body"))
    found = storage.publish_linked(known, rows, "graph_id", {"catalog_id": (v("catalogs"), "catalog_id"), "nodes": (v("nodes"), "node_id")})
    return found.select("graph_id", "outcome", F.array_join("dangling", ",").alias("dangling"))


_sql("graphs_published", """WITH g AS (SELECT c_custkey AS graph_id, CASE WHEN c_custkey % 4 <> 0 THEN 'cat' || (c_custkey * 10) END AS catalog_id, ['n' || c_nationkey, 'r' || (c_custkey % 7)] AS nodes, CASE WHEN c_custkey % 9 = 0 THEN 'changed' ELSE 'same' END AS body FROM customer),
 l AS (SELECT graph_id, 'catalog_id' AS c FROM g WHERE catalog_id IS NOT NULL AND catalog_id NOT IN (SELECT catalog_id FROM catalogs) UNION SELECT graph_id, 'nodes' FROM (SELECT graph_id, unnest(nodes) AS x FROM g) WHERE x NOT IN (SELECT node_id FROM nodes)),
 d AS (SELECT graph_id, string_agg(c, ',' ORDER BY c) AS dangling FROM l GROUP BY graph_id)
SELECT graph_id, CASE WHEN dangling IS NOT NULL THEN 'refused' WHEN graph_id % 6 <> 0 THEN 'created' WHEN body = 'same' THEN 'unchanged' ELSE 'conflict' END AS outcome, coalesce(dangling, '') AS dangling FROM g LEFT JOIN d USING (graph_id)""", "catalogs", "nodes")


@query
def contexts_registered(v):
    """Release contexts of catalogues: known ones stay as they were, those of unknown catalogues are refused."""
    s, n = v("supplier"), F.col("s_suppkey")
    rows = s.select(F.concat(F.lit("cat"), n * 2).alias("catalog_id"), F.col("s_name").alias("product"), F.when(n % 5 == 0, "2.0").otherwise("1.0").alias("version"))
    known = s.where(n % 3 == 0).select(F.concat(F.lit("cat"), n * 2).alias("catalog_id"), F.col("s_name").alias("product"), F.lit("1.0").alias("version"))
    linked = rows.withColumn("of", F.col("catalog_id"))
    return storage.publish_linked(known.withColumn("of", F.col("catalog_id")), linked, "catalog_id", {"of": (v("catalogs").where("status = 'completed'"), "catalog_id")}).select("catalog_id", "version", "outcome")


_sql("contexts_registered", """SELECT 'cat' || (s_suppkey * 2) AS catalog_id, CASE WHEN s_suppkey % 5 = 0 THEN '2.0' ELSE '1.0' END AS version, CASE WHEN 'cat' || (s_suppkey * 2) NOT IN (SELECT catalog_id FROM catalogs WHERE status = 'completed') THEN 'refused' WHEN s_suppkey % 3 <> 0 THEN 'created' WHEN s_suppkey % 5 = 0 THEN 'conflict' ELSE 'unchanged' END AS outcome FROM supplier""", "catalogs")


@query
def catalogues_by_id(v):
    wanted = v("customer").select(F.concat(F.lit("cat"), F.col("c_custkey") * 13).alias("catalog_id"))
    return storage.documents_by_id(v("catalogs"), "catalog_id", wanted).select("catalog_id", "firmware", "status", "found")


_sql("catalogues_by_id", "SELECT catalog_id, firmware, status, firmware IS NOT NULL AS found FROM (SELECT DISTINCT 'cat' || (c_custkey * 13) AS catalog_id FROM customer) LEFT JOIN catalogs USING (catalog_id)", "catalogs")


@query
def candidates_aligned(v):
    k = F.col("o_orderkey")
    kind = F.when(k % 6 == 0, "native_handler").when(k % 6 == 1, "native_nested_dispatch").when(k % 6 == 2, "native_request_protection").when(k % 6 == 3, "set_difference_attribution").when(k % 6 == 4, "frontend_request")
    canonical = F.when(k % 7 == 0, F.concat(F.lit("a -> b -> "), F.col("o_custkey") % 9)).when(k % 7 == 1, F.lit(None)).otherwise(F.concat(F.lit("/goform/x"), F.col("o_custkey") % 20))
    attributes = F.create_map(F.lit("route_token"), F.when(k % 4 != 0, F.concat(F.lit("t"), F.col("o_custkey") % 5)).otherwise(""), F.lit("normalized_operation"), F.concat(F.lit("op"), k % 3), F.lit("difference_side"), F.when(k % 2 == 0, "native"))
    rows = v("orders").select(history.candidate_alignment(kind, canonical, attributes).alias("alignment"))
    return rows.groupBy("alignment").agg(F.count("*").alias("members"))


_sql("candidates_aligned", """WITH c AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'native_handler' WHEN 1 THEN 'native_nested_dispatch' WHEN 2 THEN 'native_request_protection' WHEN 3 THEN 'set_difference_attribution' WHEN 4 THEN 'frontend_request' END AS kind,
  coalesce(CASE WHEN o_orderkey % 7 = 0 THEN 'a -> b -> ' || (o_custkey % 9) WHEN o_orderkey % 7 = 1 THEN NULL ELSE '/goform/x' || (o_custkey % 20) END, '') AS canonical, CASE WHEN o_orderkey % 4 <> 0 THEN 't' || (o_custkey % 5) END AS route, 'op' || (o_orderkey % 3) AS op, CASE WHEN o_orderkey % 2 = 0 THEN 'native' ELSE '' END AS side FROM orders)
SELECT coalesce(kind, 'unknown') || '|' || CASE kind WHEN 'native_handler' THEN coalesce(route, canonical) WHEN 'native_nested_dispatch' THEN op WHEN 'native_request_protection' THEN regexp_replace(canonical, ' -> [^>]*$', '') WHEN 'set_difference_attribution' THEN canonical || '|' || side || '|' ELSE canonical END AS alignment, count(*) AS members FROM c GROUP BY ALL""")


@query
def compound_names(v):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("The keys "), F.when(k % 4 == 0, F.concat(F.lit("wan.a"), k % 9, F.lit("/lan.b/x.c"))).when(k % 4 == 1, F.concat(F.lit("wan.a/plain"), k % 9)).when(k % 4 == 2, F.concat(F.lit("/www/app.js/x"), k % 9, F.lit(".y"))).otherwise(F.concat(F.lit("b.z/a.y. and b.z/a.y, c.d/e.f"), k % 9)), F.lit(" are set."))
    return v("orders").select("o_orderkey", F.array_join(history.compound_members(text), ",").alias("members"))


_sql("compound_names", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'lan.b,wan.a' || (o_orderkey % 9) || ',x.c' WHEN 3 THEN 'a.y,b.z,c.d,e.f' || (o_orderkey % 9) ELSE '' END AS members FROM orders""")


@query
def presets_of_catalogues(v):
    k = F.col("o_orderkey")
    kind = F.when(k % 17 == 0, "native_configuration_text_import_flow").when(k % 19 == 0, "native_configuration_url_consumer").otherwise("frontend_request")
    candidates = v("orders").select((F.col("o_custkey") % 400).alias("catalog_id"), kind.alias("candidate_kind"))
    r = F.col("r_regionkey")
    presets = v("region").select(F.when(r == 0, "interface_structure").when(r == 1, "parameter_state").when(r == 2, "completeness").otherwise(F.col("r_name")).alias("preset_id"), F.array(F.lit("gates"), F.when(r == 2, "writes_state").otherwise("calls")).alias("edge_kinds"))
    return graph.view_presets(candidates, presets).select("catalog_id", "preset_id", F.array_join("edge_kinds", ",").alias("edge_kinds"))


_sql("presets_of_catalogues", """WITH c AS (SELECT o_custkey % 400 AS catalog_id, bool_or(o_orderkey % 17 = 0) AS a, bool_or(o_orderkey % 17 <> 0 AND o_orderkey % 19 = 0) AS b FROM orders GROUP BY 1),
 p AS (SELECT CASE r_regionkey WHEN 0 THEN 'interface_structure' WHEN 1 THEN 'parameter_state' WHEN 2 THEN 'completeness' ELSE r_name END AS preset_id, CASE WHEN r_regionkey = 2 THEN 'writes_state' ELSE 'calls' END AS second FROM region)
SELECT catalog_id, preset_id, concat_ws(',', 'gates', second, CASE WHEN state AND a THEN 'imports_state' END, CASE WHEN state AND b THEN 'reads_state' END, CASE WHEN state AND b AND second <> 'writes_state' THEN 'writes_state' END, CASE WHEN state AND b THEN 'deletes_state,persists_state' END) AS edge_kinds
FROM (SELECT *, preset_id IN ('parameter_state', 'completeness') AS state FROM p), c""")


@query
def policies_judged(v):
    p = F.col("p_partkey")
    many = F.array_repeat(F.lit("term"), (p % 130).cast("int"))
    rows = v("part").select("p_partkey", (p % 120).alias("strong"), (p % 70).alias("likely"), (p % 50 - 1).alias("review"), many.alias("firmware"), F.slice(many, 1, 90).alias("devices"))
    return relevance.policy_issues(rows, "p_partkey")


_sql("policies_judged", "SELECT p_partkey, 'thresholds_unordered' AS rule FROM part WHERE NOT (p_partkey % 50 - 1 >= 0 AND p_partkey % 50 - 1 <= p_partkey % 70 AND p_partkey % 70 <= p_partkey % 120 AND p_partkey % 120 <= 100) UNION ALL SELECT p_partkey, 'firmware_too_many' FROM part WHERE p_partkey % 130 > 100")


@query
def identities_known(v):
    return v("vulns").select("identifier", meaningful_identity(F.col("vendor")).alias("vendor_known"), meaningful_identity(F.concat(F.lit(" "), F.when(F.col("vid") % 3 == 0, "Unspecified").when(F.col("vid") % 3 == 1, "-").otherwise("x"), F.lit(" "))).alias("other_known"))


_sql("identities_known", "SELECT identifier, vendor IS NOT NULL AND lower(vendor) NOT IN ('', '*', '-', 'n/a', 'na', 'unknown', 'unspecified', 'not applicable') AS vendor_known, vid % 3 = 2 AS other_known FROM vulns", "vulns")


@query
def times_of_feeds(v):
    return v("events").select("event_id", feeds.feed_time(F.col("ts")).alias("at"))


_sql("times_of_feeds", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS at FROM events")


@query
def strings_hinted(v):
    """Printable runs of binary contents, and those that look like endpoints, servers or route tokens."""
    k = F.col("c_custkey")
    nul = F.lit(b"\x00\x01")
    part = lambda c: F.encode(c, "UTF-8")
    content = F.concat(nul, part(F.concat(F.lit("/goform/set"), k % 30)), nul, part(F.lit("abc")), nul, part(F.concat(F.lit("route_"), k)), F.lit(b"\xff"), part(F.when(k % 3 == 0, "GoAhead httpd 2.1").otherwise("no hint here!")), nul, part(F.lit("9lives")))
    files = v("customer").select(F.col("c_name").alias("canonical_path"), content.alias("content"))
    return producers.native_hints(producers.printable_strings(files)).select("canonical_path", "value", "start_byte", "end_byte", "kind")


_sql("strings_hinted", """WITH c AS (SELECT c_name AS canonical_path, '/goform/set' || (c_custkey % 30) AS a, 'route_' || c_custkey AS b, c_custkey FROM customer)
SELECT canonical_path, a AS value, CAST(2 AS BIGINT) AS start_byte, CAST(2 + length(a) AS BIGINT) AS end_byte, 'endpoint_literal' AS kind FROM c
UNION ALL SELECT canonical_path, b, 9 + length(a), 9 + length(a) + length(b), 'route_token' FROM c UNION ALL SELECT canonical_path, 'GoAhead httpd 2.1', 10 + length(a) + length(b), 27 + length(a) + length(b), 'server_hint' FROM c WHERE c_custkey % 3 = 0""")


@query
def objects_plausible(v):
    k = F.col("p_partkey")
    path = F.concat(F.lit("/usr/lib/rpcd/"), F.when(k % 5 == 0, ".hidden").otherwise(F.col("p_brand")), F.when(k % 2 == 0, ".so").when(k % 7 == 0, ".tar.gz").otherwise(""))
    name = F.when(k % 3 == 0, F.concat("p_brand", F.lit("-x"))).when(k % 3 == 1, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("x")))
    return v("part").select("p_partkey", models.plausible_object(path, name).alias("plausible"), models.span_locator(k, k + 5).alias("binary"), models.span_locator(k, k + 5, F.lit(1), k % 9, F.lit(2), k % 4).alias("text"))


_sql("objects_plausible", """WITH x AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN '.hidden' ELSE p_brand END || CASE WHEN p_partkey % 2 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN '.tar' ELSE '' END AS stem, CASE p_partkey % 3 WHEN 0 THEN p_brand || '-x' WHEN 1 THEN p_brand ELSE p_brand || 'x' END AS name FROM part)
SELECT p_partkey, name = stem OR starts_with(name, stem || '-') AS plausible, 'binary:bytes=' || p_partkey || '-' || (p_partkey + 5) AS "binary", 'text_utf8:bytes=' || p_partkey || '-' || (p_partkey + 5) || ';lines=1:' || (p_partkey % 9) || '-2:' || (p_partkey % 4) AS "text" FROM x""")


@query
def corpus_judged(v):
    """Samples of categories, what each lacks or shows against expectation, and the gate over all."""
    k = F.col("o_orderkey")
    tier = F.when(k % 11 == 0, "external_lead").when(k % 3 == 0, "real_firmware").when(k % 3 == 1, "derived_firmware").otherwise("contract")
    arr = lambda *c: F.array_compact(F.array(*c))
    samples = v("orders").select((F.col("o_custkey") % 300).alias("category"), tier.alias("evidence_tier"), arr(F.lit("a"), F.when(k % 5 == 0, "b")).alias("required"), arr(F.lit("x")).alias("forbidden"), F.when(k % 13 != 0, arr(F.lit("a"), F.when(k % 10 == 0, "b"), F.when(k % 7 == 0, "x"))).alias("observed"), (k % 17).alias("open_obligations"), F.when(k % 4 == 0, "partial").otherwise("completed").alias("coverage_status"))
    return history.category_results(history.sample_results(samples.withColumn("open_obligations", F.when(F.col("open_obligations") == 0, 1).otherwise(0))))


_sql("corpus_judged", """WITH s AS (SELECT o_custkey % 300 AS category, CASE WHEN o_orderkey % 11 = 0 THEN 'acquisition_gap' WHEN o_orderkey % 13 = 0 OR (o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0) OR o_orderkey % 7 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 4 = 0 THEN 'coverage_gap'
  WHEN o_orderkey % 3 = 0 THEN 'verified' WHEN o_orderkey % 3 = 1 THEN 'derived_only' ELSE 'contract_only' END AS status FROM orders),
 c AS (SELECT category, count(*) AS samples, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'derived_only') AS derived_only, count(*) FILTER (status = 'coverage_gap') AS coverage_gap, count(*) FILTER (status = 'contract_only') AS contract_only FROM s GROUP BY category)
SELECT category, CASE WHEN verified > 0 THEN 'verified' WHEN derived_only > 0 THEN 'derived_only' WHEN coverage_gap > 0 THEN 'coverage_gap' WHEN contract_only > 0 THEN 'contract_only' ELSE 'acquisition_gap' END AS category_status, samples, verified, derived_only, coverage_gap, contract_only FROM c""")


# what records, catalogues and runs hold

@query
def parameters_grouped(v):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = v("lineitem").select(
        F.concat(F.lit("c"), F.col("l_partkey") % 300).alias("owner_ref"), F.when(n % 3 != 0, "query").alias("namespace"), F.concat(F.lit("arg"), F.col("l_suppkey") % 9).alias("name"), F.when(o % 4 == 0, (o % 3).cast("string")).alias("literal_value"), (o % 101 == 0).alias("is_operation_selector"),
        F.when(n % 2 == 0, "form").alias("source_construct"), F.when(o % 5 == 0, F.array(F.concat(F.lit("s"), o % 4), F.concat(F.lit("s"), n % 4))).otherwise(F.array().cast("array<string>")).alias("selector_values"),
    )
    candidates = v("customer").where("c_custkey % 300 < 200").select(F.concat(F.lit("c"), F.col("c_custkey") % 300).alias("candidate_id"), F.concat(F.lit("frontend_request|/x"), F.col("c_custkey") % 300 % 50).alias("alignment")).distinct()
    found = history.parameter_entities(rows, candidates)
    return found.select("identity", "member_count", "operation_selector", *(F.array_join(c, ",").alias(c) for c in ("literal_values", "selector_values", "source_constructs")))


_sql("parameters_grouped", """WITH o AS (SELECT DISTINCT 'c' || (c_custkey % 300) AS owner, 'frontend_request|/x' || (c_custkey % 300 % 50) AS alignment FROM customer WHERE c_custkey % 300 < 200),
 p AS (SELECT coalesce(alignment, 'unresolved-owner|c' || (l_partkey % 300)) || '|' || CASE WHEN l_linenumber % 3 <> 0 THEN 'query' ELSE '' END || '|arg' || (l_suppkey % 9) AS identity, * FROM lineitem LEFT JOIN o ON owner = 'c' || (l_partkey % 300)),
 s AS (SELECT identity, string_agg(DISTINCT x, ',' ORDER BY x) AS selector_values FROM (SELECT identity, unnest(['s' || (l_orderkey % 4), 's' || (l_linenumber % 4)]) AS x FROM p WHERE l_orderkey % 5 = 0) GROUP BY identity)
SELECT identity, count(*) AS member_count, bool_or(l_orderkey % 101 = 0) AS operation_selector, coalesce(string_agg(DISTINCT CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_orderkey % 3 AS VARCHAR) END, ',' ORDER BY CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_orderkey % 3 AS VARCHAR) END), '') AS literal_values, any_value(coalesce(selector_values, '')) AS selector_values,
 string_agg(DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'form' ELSE '' END, ',' ORDER BY CASE WHEN l_linenumber % 2 = 0 THEN 'form' ELSE '' END) AS source_constructs FROM p LEFT JOIN s USING (identity) GROUP BY identity""")


@query
def bus_references(v):
    k = F.col("p_partkey")
    endpoint = F.when(k % 5 == 0, F.concat(F.lit("/ubus://x/"), k)).when(k % 5 == 1, F.concat(F.lit("ubus://"), "p_brand", F.lit("/get/"), k % 7)).when(k % 5 == 2, "ubus:///get").when(k % 5 == 3, F.concat(F.lit("ubus://"), "p_brand", F.lit("/"))).otherwise(F.concat(F.lit("ubus://net/set"), k % 3))
    rows = v("part").select(F.concat(F.lit("c"), k).alias("candidate_id"), endpoint.alias("endpoint"), F.array(F.concat(F.lit("e"), k % 9)).alias("evidence_ids"))
    return correlation.bus_operations(rows.unionByName(rows)).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


_sql("bus_references", """SELECT 'c' || p_partkey AS operation_ref, CASE WHEN p_partkey % 5 = 1 THEN p_brand ELSE 'net' END AS object_name, CASE WHEN p_partkey % 5 = 1 THEN 'get/' || (p_partkey % 7) ELSE 'set' || (p_partkey % 3) END AS method_name, 'e' || (p_partkey % 9) AS evidence_ids FROM part WHERE p_partkey % 5 IN (1, 4)""")


@query
def cwe_semi_join(v):
    bridge = v("vulns").select(F.col("identifier").alias("vulnerability_identifier"), F.explode(F.split("cwe_list", ";")).alias("cwe_id"))
    return exploration.with_cwe(v("vulns"), bridge, "cwe-7").select("identifier", "title")


_sql("cwe_semi_join", "SELECT identifier, title FROM vulns WHERE list_contains(string_split(cwe_list, ';'), 'CWE-7')", "vulns")


@query
def fingerprints_of_settings(v):
    k = F.col("s_suppkey")
    made = merging.analysis_fingerprint("rules-1", "prompt-2", F.when(k % 4 != 0, k % 3 == 0), F.concat(F.lit("http://m"), k, F.when(k % 2 == 0, "//").otherwise("")), F.col("s_name"))
    return v("supplier").select("s_suppkey", made.alias("fingerprint"))


_sql("fingerprints_of_settings", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 3 = 0 THEN 'rules-1+prompt-2@http://m' || s_suppkey || ':' || s_name ELSE 'rules-1' END AS fingerprint FROM supplier")


@query
def bridge_rewritten(v):
    """A bridge after some records came again with other CWEs, some with none."""
    vulns = v("vulns").withColumn("cwes", F.split("cwe_list", ";"))
    bridge = vulns.where("vid % 3 <> 2").select("identifier", F.explode("cwes").alias("cwe_id")).distinct()
    news = vulns.where("vid % 3 <> 0").select("identifier", F.when(F.col("vid") % 2 == 0, F.array(F.lit("CWE-1"), F.concat(F.lit("CWE-"), F.col("vid") % 5))).otherwise(F.array().cast("array<string>")).alias("cwes"))
    return merging.bridge_replaced(bridge, news)


_sql("bridge_rewritten", """SELECT DISTINCT identifier, unnest(string_split(cwe_list, ';')) AS cwe_id FROM vulns WHERE vid % 3 = 0 UNION ALL SELECT DISTINCT identifier, unnest(['CWE-1', 'CWE-' || (vid % 5)]) FROM vulns WHERE vid % 3 <> 0 AND vid % 2 = 0""", "vulns")


@query
def records_written(v):
    c = F.col("c_custkey")
    stored = v("customer").where(c % 3 == 0).select(F.concat(F.lit("V"), c).alias("identifier"), F.concat(F.lit("2020-01-"), F.lpad((c % 28 + 1).cast("string"), 2, "0")).alias("ingested_at"))
    return merging.records_rewritten(stored, v("customer").select(F.concat(F.lit("V"), c).alias("identifier"), F.col("c_name").alias("title")), "2024-02-03")


_sql("records_written", "SELECT 'V' || c_custkey AS identifier, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN '2020-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') ELSE '2024-02-03' END AS ingested_at, '2024-02-03' AS updated_at FROM customer")


@query
def collection_failures(v):
    s = F.col("s_suppkey")
    loads = v("supplier").select(F.col("s_name").alias("source"), F.when(s % 7 == 0, "timeout").alias("error"), F.when(s % 5 != 0, s * 3).alias("records"))
    leads = v("lineitem").join(v("supplier"), F.col("l_suppkey") == s).select(F.concat(F.when(F.col("l_orderkey") % 6 == 0, "lost:").otherwise("fw:"), F.col("l_partkey")).alias("candidate_id"), F.col("s_name").alias("source"))
    kept, failures = catalogue.collect_catalogue(v("candidates"), leads, loads)
    return failures.unionByName(kept.groupBy("source").agg(F.count("*").alias("n")).select("source", F.lit("leads").alias("reason"), "n"))


_sql("collection_failures", """WITH l AS (SELECT s_name AS source, l_orderkey % 6 = 0 OR l_partkey NOT IN (SELECT p_partkey FROM part) AS lost FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT s_name AS source, 'failed: timeout' AS reason, CAST(CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 3 ELSE 0 END AS BIGINT) AS n FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT s_name, 'empty', 0 FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 = 0
UNION ALL SELECT source, 'leads_without_candidate', count(*) FROM l WHERE lost GROUP BY source UNION ALL SELECT source, 'leads', count(*) FROM l WHERE NOT lost GROUP BY source""")


@query
def graphs_listed(v):
    """A page of published graphs, newest first."""
    o = v("orders").select(F.concat(F.lit("g"), F.col("o_orderkey")).alias("graph_id"), F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("published_at"))
    return paging.page(o, [F.desc("published_at"), F.col("graph_id")], 40, 20)


_sql("graphs_listed", "SELECT 'g' || o_orderkey AS graph_id, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS published_at FROM orders ORDER BY published_at DESC, graph_id LIMIT 40 OFFSET 20")


@query
def reclassified_partly(v):
    """A partial policy changes what it names; the rest of the old one stays."""
    old = relevance.Policy.from_dict({"firmware": ("u-boot",), "strong": 60, "likely": 40, "review": 20})
    return exploration.level_counts(relevance.classify(v("vulns").drop("relevance_level").withColumns({"cpes": F.array("cpe"), "references": F.array("reference")}), old.updated({"devices": [" router "], "likely": 45})))


def _reclassified() -> str:
    from lodestrata.plans.oracles import _relevance

    return f"WITH {_relevance(relevance.Policy(firmware=('u-boot',), devices=('router',), strong=60, likely=45, review=20))} SELECT relevance_level, count(*) AS n FROM scored GROUP BY ALL"


_sql("reclassified_partly", _reclassified(), "vulns")


@query
def device_models(v):
    """Devices by vendor and product, or by their CPE where these are unknown."""
    m = models.firmware_model(F.col("vendor"), F.col("product"), F.col("title"), F.col("summary"), F.array("cpe"))
    return v("devices").select("n", m.alias("m")).select("n", "m.key", "m.vendor", "m.model", "m.source", "m.alignment", F.col("m.version_summary").alias("versions"))


_sql("device_models", f"""WITH c AS (SELECT *, split_part(cpe, ':', 4) AS cv, replace(split_part(cpe, ':', 5), '_', ' ') AS cp, split_part(cpe, ':', 6) AS version, lower(trim(coalesce(vendor, ''))) IN ('', 'n/a', 'unknown', 'unspecified') AS no_vendor, lower(trim(coalesce(product, ''))) IN ('', 'n/a', 'unknown', 'unspecified') AS by_cpe FROM devices),
 a AS (SELECT *, CASE WHEN NOT no_vendor THEN trim(vendor) WHEN cv = 'dlink' THEN 'D-Link' WHEN cv = 'acme_corp' THEN 'Acme Corp' ELSE '' END AS v, trim(regexp_replace(CASE WHEN by_cpe THEN cp ELSE trim(product) END, '\\s+(device\\s+)?(firmware|software)$', '', 'i')) AS m1 FROM c),
 b AS (SELECT *, CASE WHEN v <> '' AND starts_with(lower(m1), lower(v) || ' ') THEN trim(substr(m1, length(v) + 1)) ELSE m1 END AS m2 FROM a),
 d AS (SELECT *, CASE WHEN by_cpe THEN array_to_string([CASE WHEN regexp_matches(w, '[0-9]') THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END FOR w IN list_filter(string_split_regex(m2, '\\s+'), lambda w: lower(w) NOT IN ('firmware', 'software'))], ' ') ELSE m2 END AS model,
   list_distinct(list_filter(regexp_extract_all(lower(cp), '[a-z0-9]+'), lambda w: w NOT IN ('firmware', 'software'))) AS theirs, regexp_extract_all(lower(concat_ws(' ', trim(coalesce(product, '')), title, summary)), '[a-z0-9]+') AS told FROM b)
SELECT n, trim(regexp_replace(lower(concat_ws(' ', v, model)), '\\s+', ' ', 'g')) AS key, CASE WHEN v <> '' THEN v ELSE '{models.NO_VENDOR_LABEL}' END AS vendor, model, CASE WHEN by_cpe THEN 'cpe' ELSE 'description' END AS source,
 CASE WHEN by_cpe THEN 'cpe_fallback' WHEN len(theirs) > 0 AND len(list_filter(theirs, lambda w: list_contains(told, w))) >= greatest(1, len(theirs) // 2) THEN 'aligned' ELSE 'description_primary' END AS alignment, CASE WHEN version = '-' THEN '{models.NO_VERSION}' ELSE version END AS versions FROM d""", "devices")


@query
def subtypes_labelled(v):
    n = F.col("p_partkey")
    labels = v("part").select((F.concat(F.lit("style"), n % 5)).alias("category"), F.concat(F.lit("sub"), n % 9).alias("key"), F.concat(F.lit("Label "), n % 5, F.lit("/"), n % 9).alias("label"), F.concat(F.lit("about "), n % 9).alias("description")).where("key <> 'sub4'").distinct()
    rows = v("orders").select("o_orderkey", F.concat(F.lit("style"), F.col("o_custkey") % 6).alias("category"), F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.concat(F.lit("sub"), F.col("o_orderkey") % 10)).alias("subtype"))
    return exploration.with_subtype_labels(rows, labels)


_sql("subtypes_labelled", f"""WITH l AS (SELECT DISTINCT 'style' || (p_partkey % 5) AS category, 'sub' || (p_partkey % 9) AS subtype, 'Label ' || (p_partkey % 5) || '/' || (p_partkey % 9) AS label, 'about ' || (p_partkey % 9) AS description FROM part WHERE p_partkey % 9 <> 4),
 r AS (SELECT o_orderkey, 'style' || (o_custkey % 6) AS category, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'sub' || (o_orderkey % 10) END AS subtype FROM orders)
SELECT o_orderkey, category, subtype, coalesce(label, CASE WHEN subtype = '' THEN '{exploration.NO_SUBTYPE}' ELSE subtype END) AS label, coalesce(description, '{exploration.INFERRED}') AS description FROM r LEFT JOIN l USING (category, subtype)""")
