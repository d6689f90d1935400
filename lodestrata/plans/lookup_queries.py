"""Lookups, published layers, repairs and publication as queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import interfaces as I
from lodestrata.functions import versions as V
from lodestrata.operators import evidence, graph, lookups, paging, projection, relevance, review, storage
from lodestrata.plans.catalogue_queries import _sql
from lodestrata.plans.oracles import _styled
from lodestrata.plans.queries import query
from lodestrata.sources import inventory


@query
def candidates_filtered(v):
    return lookups.search_candidates(v("candidates"), v("leads"), vendor="brand#11", host="FILES3.example.com", method="version", has_vulnerability=True).select("candidate_id", "vendor", "version")


_sql("candidates_filtered", """SELECT candidate_id, vendor, version FROM candidates WHERE lower(vendor) = 'brand#11' AND starts_with(lower(download_url), 'https://files3.example.com/')
 AND candidate_id IN (SELECT candidate_id FROM leads WHERE match_method IN ('exact_version', 'version_range'))""", "candidates", "leads")


@query
def candidates_searched(v):
    return lookups.search_candidates(v("candidates"), v("leads"), query="brand fw ext1", method="no such method").select("candidate_id", "filename")


_sql("candidates_searched", r"""WITH t AS (SELECT *, [' ' || trim(regexp_replace(lower(coalesce(x, '')), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' FOR x IN [external_id, vendor, product, model, version, filename, download_url]] AS texts FROM candidates)
SELECT candidate_id, filename FROM t WHERE len([1 FOR x IN texts IF contains(x, ' brand')]) > 0 AND len([1 FOR x IN texts IF contains(x, ' fw')]) > 0 AND len([1 FOR x IN texts IF contains(x, ' ext1')]) > 0""", "candidates")


@query
def vulnerability_records(v):
    a = v("analyses").select("analysis_id", "identifier", "is_current", (F.col("prompt_tokens") % 7).alias("interface_count"), (F.col("completion_tokens") % 5).alias("parameter_count"))
    return lookups.vulnerability_details(v("vulns"), a).select("identifier", F.col("semantic_interface_count").cast("long"), F.col("semantic_parameter_count").cast("long"), "is_firmware_related")


_sql("vulnerability_records", """WITH a AS (SELECT identifier, min_by(prompt_tokens % 7, analysis_id) AS i, min_by(completion_tokens % 5, analysis_id) AS p FROM analyses WHERE is_current GROUP BY identifier)
SELECT identifier, CAST(coalesce(i, 0) AS BIGINT) AS semantic_interface_count, CAST(coalesce(p, 0) AS BIGINT) AS semantic_parameter_count, coalesce(relevance_level IN ('strong', 'likely'), false) AS is_firmware_related FROM vulns LEFT JOIN a USING (identifier)""", "vulns", "analyses")


@query
def records_decoded(v):
    n = F.col("c_custkey")
    rows = v("customer").select("c_custkey", F.when(n % 5 == 0, "").when(n % 5 == 1, "not json").otherwise(F.concat(F.lit('["CWE-'), n % 9, F.lit('", "CWE-x"]'))).alias("cwes_json"), F.when(n % 4 != 0, n % 2).cast("int").alias("kev"))
    return lookups.decode_records(rows, {"cwes": "array<string>"}, ("kev",)).select("c_custkey", F.array_join("cwes", ";").alias("cwes"), "kev")


_sql("records_decoded", "SELECT c_custkey, CASE WHEN c_custkey % 5 < 2 THEN '' ELSE 'CWE-' || (c_custkey % 9) || ';CWE-x' END AS cwes, c_custkey % 4 <> 0 AND c_custkey % 2 = 1 AS kev FROM customer")

_RUNS = "SELECT concat('A', CAST(o_orderkey AS VARCHAR)) AS analysis_id, concat('V', CAST(o_custkey AS VARCHAR)) AS identifier, concat('in', CAST(o_orderkey % 3 AS VARCHAR)) AS input_sha256, concat('fp', CAST(o_orderkey % 2 AS VARCHAR)) AS fingerprint, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS finished_at FROM orders"


def _runs(v):
    o = v("orders")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return o.select(name("A", o.o_orderkey).alias("analysis_id"), name("V", o.o_custkey).alias("identifier"), name("in", o.o_orderkey % 3).alias("input_sha256"), name("fp", o.o_orderkey % 2).alias("fingerprint"), F.substring(o.o_orderdate.cast("string"), 1, 10).alias("finished_at"))


@query
def analysis_latest(v):
    return lookups.latest_analysis(_runs(v), input_sha256="in1", fingerprint="fp0")


_sql("analysis_latest", f"SELECT * FROM ({_RUNS}) WHERE input_sha256 = 'in1' AND fingerprint = 'fp0' QUALIFY row_number() OVER (PARTITION BY identifier ORDER BY finished_at DESC, analysis_id DESC) = 1")


@query
def report_latest(v):
    return paging.page(_runs(v), [F.desc("finished_at"), F.desc("analysis_id")], 1).select("analysis_id", "finished_at")


_sql("report_latest", f"SELECT analysis_id, finished_at FROM ({_RUNS}) ORDER BY finished_at DESC, analysis_id DESC LIMIT 1")

_LAYERS = """WITH p AS (SELECT concat('g', CAST(o_custkey % 40 AS VARCHAR)) AS graph_id, o_orderkey AS overlay_id, substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS published_at FROM orders),
 newest AS (SELECT graph_id, overlay_id FROM p QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY published_at DESC, overlay_id DESC) = 1),
 e AS (SELECT l_orderkey AS overlay_id, concat('CVE-', CAST(l_partkey AS VARCHAR)) AS identifier, concat('/goform/setPart', CAST(l_suppkey % 30 AS VARCHAR)) AS interface_value,
   CASE l_linenumber % 3 WHEN 0 THEN 'observed' WHEN 1 THEN 'missing' ELSE 'partial' END AS status, CASE l_partkey % 4 WHEN 0 THEN 'unknown' ELSE 'exact_artifact' END AS applicability,
   CASE l_partkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN '' ELSE 'coverage_incomplete' END AS gap_reason FROM lineitem JOIN newest ON l_orderkey = overlay_id),
 x AS (SELECT * FROM e JOIN newest USING (overlay_id))"""


def _layers(v):
    o, n = v("orders"), v("lineitem")
    published = o.select(F.concat(F.lit("g"), (o.o_custkey % 40).cast("string")).alias("graph_id"), o.o_orderkey.alias("overlay_id"), F.substring(o.o_orderdate.cast("string"), 1, 7).alias("published_at"))
    entries = n.select(
        n.l_orderkey.alias("overlay_id"), F.concat(F.lit("CVE-"), n.l_partkey.cast("string")).alias("identifier"), F.concat(F.lit("/goform/setPart"), (n.l_suppkey % 30).cast("string")).alias("interface_value"),
        F.when(n.l_linenumber % 3 == 0, "observed").when(n.l_linenumber % 3 == 1, "missing").otherwise("partial").alias("status"), F.when(n.l_partkey % 4 == 0, "unknown").otherwise("exact_artifact").alias("applicability"),
        F.when(n.l_partkey % 3 == 0, "none").when(n.l_partkey % 3 == 1, "").otherwise("coverage_incomplete").alias("gap_reason"),
    )
    return lookups.latest_entries(published, entries, "graph_id", "overlay_id")


@query
def overlay_entries(v):
    q = lookups.EntryQuery("Part1 goform", {"status": ("missing", "partial"), "applicability": ("exact_artifact",)})
    return lookups.select_entries(_layers(v), q, lookups.OVERLAY_FILTERS, ("identifier", "interface_value", "gap_reason", "applicability"))


_sql("overlay_entries", f"{_LAYERS} SELECT * FROM x WHERE status IN ('missing', 'partial') AND applicability = 'exact_artifact' AND contains(interface_value, 'Part1')")


@query
def overlay_facets(v):
    return lookups.entry_facets(_layers(v), "graph_id", ("status", "applicability", "gap_reason"))


_sql("overlay_facets", f"{_LAYERS} SELECT graph_id, facet, value, count(*) AS n FROM (SELECT graph_id, 'status' AS facet, status AS value FROM x UNION ALL SELECT graph_id, 'applicability', applicability FROM x UNION ALL SELECT graph_id, 'gap_reason', gap_reason FROM x) WHERE value <> '' GROUP BY ALL")


@query
def ledger_entries(v):
    rows = _layers(v).withColumnRenamed("gap_reason", "evidence_state")
    return lookups.select_entries(rows, lookups.EntryQuery("cve", {"status": ("observed",), "evidence_state": ("none", "other")}), lookups.LEDGER_FILTERS, ("identifier", "interface_value")).drop("applicability")


_sql("ledger_entries", f"{_LAYERS} SELECT overlay_id, identifier, interface_value, status, gap_reason AS evidence_state, graph_id FROM x WHERE status = 'observed' AND gap_reason IN ('none', 'other')")


@query
def ledger_facets(v):
    return lookups.entry_facets(_layers(v), "graph_id", ("status", "gap_reason"), "structured")


_sql("ledger_facets", f"{_LAYERS} SELECT graph_id, facet, value, count(*) AS n FROM (SELECT graph_id, 'status' AS facet, status AS value FROM x UNION ALL SELECT graph_id, 'gap_reason', CASE WHEN gap_reason = '' THEN 'structured' ELSE gap_reason END FROM x) GROUP BY ALL")


@query
def web_interfaces(v):
    n = F.col("part_id")
    identity = F.when(n % 8 == 0, F.concat(F.lit("ubus://x/"), "product")).when(n % 8 == 1, F.concat(F.lit("HTTP:"), "product")).when(n % 8 == 2, F.concat(F.lit("https://"), "product")).otherwise(F.col("value"))
    shape = F.when(n % 3 == 0, "exact_literal").when(n % 3 == 1, "logical_operation")
    return v("routes").select("part_id", lookups.is_web_interface(identity, shape).alias("web"))


_sql("web_interfaces", """SELECT part_id, CASE WHEN part_id % 8 = 0 OR part_id % 3 = 1 THEN false WHEN part_id % 3 = 0 THEN true WHEN part_id % 8 = 1 THEN false WHEN part_id % 8 = 2 THEN true ELSE starts_with(value, '/') END AS web FROM routes""", "routes")


@query
def answer_objects(v):
    """Answers in fences, after words, before a second object, or without any."""
    return v("answers").select("n", lookups.answer_object(F.col("text"), "summary string, score bigint").alias("o")).select("n", "o.summary", "o.score")


_sql("answer_objects", r"""WITH o AS (SELECT n, regexp_extract(text, '\{[^{}]*\}') AS o FROM answers)
SELECT n, CASE WHEN o <> '' THEN json_extract_string(o, '$.summary') END AS summary, CASE WHEN o <> '' THEN CAST(json_extract_string(o, '$.score') AS BIGINT) END AS score FROM o""", "answers")


@query
def pages_gated(v):
    n = F.col("s_suppkey")
    code = F.concat(F.lit('switch (x) {\ncase "menu'), n % 50, F.lit("\" :\n showIframe(t, '/p"), n, F.lit(".html'); break;\ncase 'other"), n % 3, F.lit("': showIframe(\"q"), n % 7, F.when(n % 2 == 0, '.html"); }').otherwise('.htm"); }'))
    targets = v("supplier").select(F.concat(F.when(n % 2 == 0, "menu").otherwise("other"), n % 40).alias("target"))
    return lookups.gated_pages(v("supplier").select(F.concat(F.lit("f"), n).alias("path"), code.alias("content")), targets)


_sql("pages_gated", """WITH t AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'menu' ELSE 'other' END || (s_suppkey % 40) AS target FROM supplier)
SELECT 'f' || s_suppkey AS path, target, '/p' || s_suppkey || '.html' AS page FROM supplier JOIN t ON target = 'menu' || (s_suppkey % 50)
UNION ALL SELECT 'f' || s_suppkey, target, 'q' || (s_suppkey % 7) || '.html' FROM supplier JOIN t ON target = 'other' || (s_suppkey % 3) WHERE s_suppkey % 2 = 0""")


@query
def identities_repaired(v):
    n = F.col("vid")
    rows = v("vulns").select("identifier", F.when(n % 3 == 0, F.concat("identifier", F.lit(" · unknown n/a"))).when(n % 3 == 1, F.col("title")).alias("title"), "vendor", F.when(n % 2 == 0, " Unknown ").otherwise(F.col("product")).alias("product"), F.when(n % 5 != 0, F.array(F.lit("junk"), F.concat(F.lit("cpe:2.3:o:acme_co:r_"), n % 9, F.lit(":1.0:*:*:*:*:*:*:*")))).otherwise(F.array().cast("array<string>")).alias("cpes"))
    return lookups.repair_identities(rows)


_sql("identities_repaired", """WITH r AS (SELECT identifier, vid, CASE vid % 3 WHEN 0 THEN identifier || ' · unknown n/a' WHEN 1 THEN title END AS title, vendor, CASE WHEN vid % 2 = 0 THEN ' Unknown ' ELSE product END AS product,
   CASE WHEN vendor IS NULL OR vendor = 'n/a' THEN CASE WHEN vid % 5 <> 0 THEN 'acme co' END ELSE vendor END AS nv, CASE WHEN vid % 2 = 0 THEN CASE WHEN vid % 5 <> 0 THEN 'r ' || (vid % 9) END ELSE product END AS np FROM vulns)
SELECT identifier, CASE WHEN vid % 3 = 0 THEN identifier || ' · ' || CASE WHEN nv IS NULL AND np IS NULL THEN '未知厂商' ELSE concat_ws(' ', nv, np) END ELSE coalesce(title, identifier) END AS title, nv AS vendor, np AS product FROM r WHERE nv IS DISTINCT FROM vendor OR np IS DISTINCT FROM product""", "vulns")


@query
def batch_counts(v):
    return lookups.ingest_counts(v("vulns").select(F.when(F.col("vid") % 6 != 0, F.col("identifier")).alias("identifier"), "relevance_level", (F.col("vid") % 10).alias("batch")), "batch")


_sql("batch_counts", "SELECT vid % 10 AS batch, count(*) AS fetched, count(*) FILTER (relevance_level IN ('strong', 'likely')) AS relevant FROM vulns WHERE vid % 6 <> 0 GROUP BY ALL", "vulns")


@query
def clues_unique(v):
    return lookups.unique_rows(v("customer").select(F.concat(F.lit("CVE-H-"), "c_custkey").alias("identifier"), "c_name"), "identifier")


_sql("clues_unique", "SELECT 'CVE-H-' || c_custkey AS identifier, c_name FROM customer")


@query
def documents_published(v):
    n = F.col("c_custkey")
    existing = v("customer").where(n % 3 == 0).select(n.alias("id"), "c_name", "c_nationkey")
    incoming = v("customer").where(n % 2 == 0).select(n.alias("id"), F.when(n % 5 == 0, "other").otherwise(F.col("c_name")).alias("c_name"), "c_nationkey")
    twice = v("customer").where(n % 14 == 0).select(n.alias("id"), F.lit("second").alias("c_name"), "c_nationkey")
    return storage.publish(existing, incoming.unionByName(incoming).unionByName(twice), "id").select("id", "c_name", "outcome")


_sql("documents_published", """WITH i AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 2 = 0 UNION SELECT c_custkey, 'second' FROM customer WHERE c_custkey % 14 = 0)
SELECT id, c_name, CASE WHEN id % 14 = 0 THEN 'conflict' WHEN id % 3 <> 0 THEN 'created' WHEN id % 5 = 0 THEN 'conflict' ELSE 'unchanged' END AS outcome FROM i""")


@query
def sources_upserted(v):
    n = F.col("s_suppkey")
    old = v("supplier").where(n % 3 != 0).select("s_suppkey", "s_name", F.lit("first").alias("added"))
    new = v("supplier").where(n % 2 == 0).select("s_suppkey", F.concat("s_name", F.lit(" new")).alias("s_name"), F.lit("second").alias("added"))
    return storage.upsert(old, new, ["s_suppkey"], keep=("added",))


_sql("sources_upserted", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' new' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'second' ELSE 'first' END AS added FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0")


@query
def references_missing(v):
    leads = v("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return storage.missing_references(leads, "l_partkey", v("part").where("p_partkey % 7 <> 0"), "p_partkey")


_sql("references_missing", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)")


@query
def model_rows_cleaned(v):
    n = F.col("o_orderkey")
    rows = v("orders").select("o_orderkey", (n % 7).alias("place"), F.when(n % 11 != 0, F.col("o_orderpriority")).otherwise(" ").alias("name"), F.when(n % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("effect"), F.when(n % 4 != 0, (n % 13).cast("double") / 10).alias("confidence"))
    return review.clean_model_rows(rows, "name", {"name": 3, "effect": 4}, optional=("effect",), most=4)


_sql("model_rows_cleaned", """SELECT o_orderkey, o_orderkey % 7 AS place, substr(o_orderpriority, 1, 3) AS name, CASE WHEN o_orderkey % 3 <> 0 THEN substr(trim(o_orderpriority), 1, 4) END AS effect,
 CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 13 = 0 THEN 0.5 ELSE least(0.9, CAST(o_orderkey % 13 AS DOUBLE) / 10) END AS confidence, 'llm' AS source FROM orders WHERE o_orderkey % 7 < 4 AND o_orderkey % 11 <> 0""")


@query
def cpe_parts(v):
    n = F.col("p_partkey")
    cpe = F.when(n % 4 == 0, F.concat(F.lit("cpe:/o:v"), n % 9, F.lit(":p"), n % 5, F.lit(":1.2"))).when(n % 4 == 1, "cpe:2.3:o:short").when(n % 4 == 2, F.concat(F.lit("cpe:2.3:o:w"), n % 9, F.lit(":q:2.0:*:*:*:*:*:*:*")))
    return v("part").select("p_partkey", *(V.cpe_part(cpe, p).alias(p) for p in ("vendor", "product", "version")))


_sql("cpe_parts", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'v' || (p_partkey % 9) WHEN 2 THEN 'w' || (p_partkey % 9) END AS vendor, CASE p_partkey % 4 WHEN 0 THEN 'p' || (p_partkey % 5) WHEN 2 THEN 'q' END AS product, CASE p_partkey % 4 WHEN 0 THEN '1.2' WHEN 2 THEN '2.0' END AS version FROM part""")


@query
def catalogue_assembled(v):
    n, ref = F.col("o_orderkey"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    candidates = v("orders").select(ref("c", n).alias("candidate_id"), F.array(ref("e", F.col("o_custkey")), ref("e", n % 3000)).alias("evidence_ids"))
    parameters = v("lineitem").select(ref("c", F.col("l_orderkey") + F.when(F.col("l_linenumber") == 5, 1_000_000_000).otherwise(0)).alias("owner_ref"), F.col("l_linenumber").alias("place"))
    proofs = v("customer").select(ref("e", F.col("c_custkey")).alias("evidence_id"))
    return evidence.assemble(candidates, parameters, proofs, v("coverage")).drop("catalog_id")


_sql("catalogue_assembled", """SELECT (SELECT count(*) FROM orders) AS candidates, CASE WHEN count(*) FILTER (required AND status = 'failed') > 0 THEN 'failed' WHEN bool_and(status IN ('completed', 'not_applicable')) THEN 'completed' ELSE 'partial' END AS coverage_status,
 (SELECT count(*) FROM (SELECT o_custkey AS e FROM orders UNION ALL SELECT o_orderkey % 3000 FROM orders) WHERE e NOT IN (SELECT c_custkey FROM customer)) AS missing_evidence, (SELECT count(*) FROM lineitem WHERE l_linenumber = 5 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphan_parameters FROM coverage""", "coverage")


def _obligations(v):
    n = F.col("o_orderkey")
    return v("orders").select(F.concat(F.lit("ob"), n).alias("obligation_id"), F.when(n % 4 == 0, "binds_handler").otherwise("registers_route").alias("required_capability"), F.concat(F.lit("t"), n % 100).alias("target_ref"), (n % 90).cast("int").alias("priority"), F.when(n % 9 == 0, "resolved").otherwise("open").alias("status"), F.when(n % 5 == 0, F.array(F.lit("handlers"))).otherwise(F.array(F.lit("routes"), F.lit("handlers"))).alias("candidate_analyzers"))


@query
def obligations_run(v):
    """Routes resolve even targets and ask for a handler of each; handlers resolve all they get."""
    even = F.substring("target_ref", 2, 9).cast("int") % 2 == 0

    def routes(batch):
        handler = batch.where(even).withColumns({"obligation_id": F.concat("obligation_id", F.lit("/h")), "required_capability": F.lit("binds_handler"), "candidate_analyzers": F.array(F.lit("handlers"))})
        return batch.where(even), handler

    initial = _obligations(v)
    done, end = evidence.run_obligations(initial.unionByName(initial), {"routes": ("registers_route", routes), "handlers": ("binds_handler", lambda batch: (batch, batch.limit(0)))}, max_obligations=None)
    return done.select("obligation_id", "required_capability", "status").withColumn("termination", F.lit(end))


_sql("obligations_run", """WITH o AS (SELECT o_orderkey AS n, 'ob' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'binds_handler' ELSE 'registers_route' END AS capability, o_orderkey % 9 <> 0 AS open, (o_orderkey % 100) % 2 = 0 AS even FROM orders)
SELECT id AS obligation_id, capability AS required_capability, CASE WHEN NOT open OR n % 4 = 0 OR (n % 5 <> 0 AND even) THEN 'resolved' ELSE 'open' END AS status, 'fixed_point' AS termination FROM o
UNION ALL SELECT id || '/h', 'binds_handler', 'resolved', 'fixed_point' FROM o WHERE open AND n % 4 <> 0 AND n % 5 <> 0 AND even""")


@query
def reasoning_rows(v):
    """Both parts of a request: the obligations and the candidates."""
    candidates = v("customer").select(F.concat(F.lit("t"), "c_custkey").alias("candidate_id"))
    top, first = projection.reasoning_request(_obligations(v), candidates)
    return top.select(F.lit("obligation").alias("part"), F.col("obligation_id").alias("id")).unionByName(first.select(F.lit("candidate").alias("part"), F.col("candidate_id").alias("id")))


_sql("reasoning_rows", """WITH top AS (SELECT 'ob' || o_orderkey AS id, 't' || (o_orderkey % 100) AS target FROM orders WHERE o_orderkey % 9 <> 0 ORDER BY o_orderkey % 90 DESC, id LIMIT 20)
SELECT 'obligation' AS part, id FROM top UNION ALL SELECT * FROM (SELECT 'candidate' AS part, 't' || c_custkey AS id FROM customer ORDER BY id NOT IN (SELECT target FROM top), id LIMIT 24)""")


@query
def candidate_parts(v):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    candidates = v("part").select(text("p", "p_partkey").alias("candidate_id"), F.concat(F.lit("p"), (F.col("p_partkey") % 20).cast("string")).alias("target_ref"), F.array(text("s", "p_size"), F.lit("s1")).alias("evidence_ids"))
    parameters = v("lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("parameter_id"), text("p", "l_partkey").alias("owner_ref"))
    links = v("orders").select(text("a", "o_orderkey").alias("association_id"), F.concat(F.lit("p"), F.col("o_orderkey") % 30).alias("frontend_candidate_id"), F.concat(F.lit("p"), F.col("o_custkey") % 30).alias("native_hint_id"))
    return projection.candidate_detail("p7", candidates, parameters, links, v("supplier").select(text("s", "s_suppkey").alias("evidence_id")))


_sql("candidate_parts", """SELECT 'parameter' AS part, l_orderkey || '/' || l_linenumber AS id FROM lineitem WHERE l_partkey = 7 UNION ALL SELECT 'association', 'a' || o_orderkey FROM orders WHERE o_orderkey % 30 = 7 OR o_custkey % 30 = 7
 UNION ALL SELECT 'related', 'p' || p_partkey FROM part WHERE p_partkey % 20 = 7 UNION ALL SELECT 'evidence', 's' || s_suppkey FROM supplier WHERE s_suppkey = 1 OR s_suppkey IN (SELECT p_size FROM part WHERE p_partkey = 7)""")


@query
def links_resolved(v):
    n = F.col("s_suppkey")
    links = v("supplier").where(n % 5 != 0).select(F.concat(F.lit("f"), n).alias("source_path"), F.when(n % 7 == 0, F.concat(F.lit("f"), n)).when(n % 11 == 0, "gone").otherwise(F.concat(F.lit("f"), n - n % 5)).alias("target_path"))
    return inventory.resolve_links(links, v("supplier").where(n % 5 == 0).select(F.concat(F.lit("f"), n).alias("canonical_path")))


_sql("links_resolved", """SELECT 'f' || s_suppkey AS source_path, CASE WHEN s_suppkey % 7 = 0 THEN 'f' || s_suppkey WHEN s_suppkey % 11 = 0 THEN 'gone' ELSE 'f' || (s_suppkey - s_suppkey % 5) END AS resolved_path,
 CASE WHEN s_suppkey % 7 = 0 THEN 'depth' WHEN s_suppkey % 11 = 0 OR s_suppkey - s_suppkey % 5 NOT IN (SELECT s_suppkey FROM supplier) THEN 'missing' ELSE 'resolved' END AS status FROM supplier WHERE s_suppkey % 5 <> 0""")


@query
def analyzers_routed(v):
    n = F.col("p_partkey")
    suffix = F.when(n % 6 == 0, ".js").when(n % 6 == 1, ".LUA").when(n % 6 == 2, ".asp").when(n % 6 == 3, ".json").when(n % 6 == 4, "/nginx.conf").otherwise("")
    content = F.when(n % 4 == 0, "#!/bin/sh").when(n % 4 == 1, "\x7fELF..").otherwise("x")
    return inventory.route_analyzers(v("part").select(F.concat(F.lit("f"), n, suffix).alias("canonical_path"), content.cast("binary").alias("content")))


_sql("analyzers_routed", """WITH f AS (SELECT p_partkey AS n, 'f' || p_partkey || ['.js', '.LUA', '.asp', '.json', '/nginx.conf', ''][p_partkey % 6 + 1] AS canonical_path FROM part)
SELECT canonical_path, 'native' AS analyzer FROM f WHERE n % 4 = 1 UNION ALL SELECT canonical_path, 'frontend' FROM f WHERE n % 6 IN (0, 2) UNION ALL SELECT canonical_path, 'script' FROM f WHERE n % 6 IN (1, 2) OR n % 4 = 0
UNION ALL SELECT canonical_path, 'web_configuration' FROM f WHERE n % 6 = 4 UNION ALL SELECT canonical_path, 'response_fixture' FROM f WHERE n % 6 = 3""")


@query
def text_positions(v):
    line, column = evidence.text_position(F.encode("text", "UTF-8"), F.lit(500))
    return v("documents").where("octet_length(text) > 500").groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", line.alias("line"), column.alias("place"))


_sql("text_positions", r"""WITH d AS (SELECT doc_id, min(text) AS text FROM documents WHERE strlen(text) > 500 GROUP BY doc_id), b AS (SELECT doc_id, hex(encode(text))[:1000] AS h FROM d),
 p AS (SELECT doc_id, [substr(h, CAST(2 * i - 1 AS INT), 2) FOR i IN range(1, 501)] AS bytes FROM b)
SELECT doc_id, CAST(len([x FOR x IN bytes IF x = '0A']) + 1 AS INT) AS line, CAST(500 - coalesce(list_max([i FOR i IN range(1, 501) IF bytes[i] = '0A']), 0) + 1 AS INT) AS place FROM p""")


@query
def graph_narrowed(v):
    nodes, edges = graph.narrow(v("nodes"), v("edges"), graph.GraphQuery(node_kinds=("request", "component"), statuses=("supported",), edge_kinds=("belongs_to", "calls")))
    identified = graph.edge_identity(edges.drop("edge_id").withColumn("origin_ref", F.lit(None).cast("string")))
    return nodes.select(F.lit("node").alias("part"), F.col("node_id").alias("id")).unionByName(identified.select(F.lit("edge").alias("part"), F.col("edge_id").alias("id")))


_sql("graph_narrowed", """WITH n AS (SELECT node_id FROM nodes WHERE node_kind IN ('request', 'component') AND status = 'supported')
SELECT 'node' AS part, node_id AS id FROM n UNION ALL SELECT 'edge', 'edge:' || sha256('["' || edge_kind || '","' || source_ref || '","' || target_ref || '",""]') FROM edges WHERE edge_kind IN ('belongs_to', 'calls') AND source_ref IN (FROM n) AND target_ref IN (FROM n)""", "nodes", "edges")


@query
def stable_ids(v):
    return v("customer").select("c_custkey", storage.stable_id("sample", "c_name", "c_nationkey").alias("sample_id"))


_sql("stable_ids", """SELECT c_custkey, 'sample:' || sha256('["' || c_name || '","' || c_nationkey || '"]') AS sample_id FROM customer""")


@query
def parameter_types(v):
    n = F.col("p_partkey")
    values = F.when(n % 5 == 0, F.array(F.lit("TRUE"), F.lit("false"))).when(n % 5 == 1, F.array(n.cast("string"), F.lit("-3"))).when(n % 5 == 2, F.array(F.lit("1"), F.lit("true"))).when(n % 5 == 3, F.array().cast("array<string>"))
    shown, more = projection.bounded_list(F.sequence(F.lit(1), n % 20 + 1), 12)
    return v("part").select("p_partkey", I.parameter_type(values).alias("type"), F.array_max(shown).cast("int").alias("last_shown"), more.alias("more"))


_sql("parameter_types", "SELECT p_partkey, ['boolean', 'integer', 'string', 'unknown', 'unknown'][p_partkey % 5 + 1] AS type, CAST(least(12, p_partkey % 20 + 1) AS INT) AS last_shown, CAST(greatest(0, p_partkey % 20 - 11) AS INT) AS more FROM part")

_sql("recommend_similar", f"""WITH {_styled("interface_obs")},
 r AS (SELECT value, split_part(value, '?', 1) AS path, count(DISTINCT identifier) AS vulnerabilities FROM styled WHERE category = 'form_handler' AND subtype = 'goform_snake_registry' GROUP BY ALL),
 t AS (SELECT *, lower(path) AS c, len(list_intersect(['set', 'almond', 'blue'], regexp_extract_all(lower(regexp_replace(regexp_extract(rtrim(path, '/'), '[^/]*$'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+'))) AS common, [x FOR x IN string_split(path, '/') IF x <> ''] AS parts FROM r),
 k AS (SELECT *, CASE WHEN c = '/goform/setalmond_blue' THEN 0 WHEN contains('/goform/setalmond_blue', c) OR contains(c, '/goform/setalmond_blue') THEN 1 WHEN common > 0 THEN 2 ELSE 3 END AS tier FROM t),
 b AS (SELECT *, CASE tier WHEN 0 THEN 100 WHEN 1 THEN 95 WHEN 2 THEN 80 + least(12, 4 * common) ELSE 80 END AS base FROM k),
 f AS (SELECT *, CASE WHEN base < 100 AND lower(parts[1]) = 'goform' THEN base + 10 ELSE base END AS one FROM b)
SELECT value, tier, CAST(least(CASE WHEN one < 100 AND len(parts) = 2 THEN one + 5 ELSE one END, CASE WHEN tier = 0 THEN 100 ELSE 99 END) AS INT) AS score, vulnerabilities FROM f""", "interface_obs")


# relevance with what it rests on

#: Terms as a user may write them: blanks around, underscores, percent escapes, other case.
_TERMS = {"firmware": ["", " Firmware_Update ", "u-boot", "firmware%20are"], "devices": ["access_point", "Router", "routers"], "watched": ["Vendor 3", "vendor"], "vendors": ["tp-link", "VENDOR_7"], "strong": 60, "likely": 40, "review": 20, "unknown": 1}


@query
def relevance_signals(v):
    policy = relevance.Policy.from_dict(_TERMS)
    rows = v("vulns").drop("relevance_level").withColumns({"cpes": F.array("cpe"), "references": F.array("reference")})
    return relevance.classify(rows, policy).select("identifier", F.explode("signals").alias("s"), "relevance_score").select("identifier", "s.name", "s.weight", "s.term", "relevance_score")


def _first(text: str, terms: list[str]) -> str:
    given = "[" + ", ".join("'" + t.strip().replace("'", "''") + "'" for t in terms if t.strip()) + "]"
    clean = "trim(regexp_replace(lower(replace(url_decode(x), '_', ' ')), '\\s+', ' ', 'g'))"
    return f"list_filter({given}, lambda x: regexp_matches({text}, '(^|[^a-z0-9_])' || regexp_escape({clean}) || '($|[^a-z0-9_])'))[1]"


_sql("relevance_signals", f"""WITH t AS (SELECT identifier, cpe, reference, replace(lower(concat_ws(' ', title, summary, vendor, product)), '_', ' ') AS t, replace(lower(concat_ws(' ', vendor, product, title)), '_', ' ') AS n FROM vulns),
 f AS (SELECT identifier, {_first("t", _TERMS["firmware"])} AS a, {_first("t", _TERMS["devices"])} AS b, {_first("n", _TERMS["vendors"])} AS c, {_first("n", _TERMS["watched"])} AS d, CASE WHEN split_part(cpe, ':', 3) = 'h' THEN cpe END AS e, CASE WHEN split_part(cpe, ':', 11) IN ('firmware', 'embedded') THEN cpe END AS g,
   {_first("lower(reference)", ["firmware", "download"])} AS h, {_first("t", list(relevance.OTHER_CONTEXTS))} AS i FROM t),
 s AS (SELECT identifier, 'firmware-term' AS name, 55 AS weight, a AS term FROM f WHERE a IS NOT NULL UNION ALL SELECT identifier, 'device-term', 25, b FROM f WHERE b IS NOT NULL UNION ALL SELECT identifier, 'firmware-vendor', 55, c FROM f WHERE c IS NOT NULL UNION ALL SELECT identifier, 'watched-vendor', 25, d FROM f WHERE c IS NULL AND d IS NOT NULL
  UNION ALL SELECT identifier, 'hardware-cpe', 30, e FROM f WHERE e IS NOT NULL UNION ALL SELECT identifier, 'firmware-target-cpe', 65, g FROM f WHERE g IS NOT NULL UNION ALL SELECT identifier, 'firmware-reference', 10, h FROM f WHERE h IS NOT NULL UNION ALL SELECT identifier, 'non-firmware-context', -25, i FROM f WHERE i IS NOT NULL AND a IS NULL AND c IS NULL AND g IS NULL)
SELECT identifier, name, weight, term, CAST(greatest(0, least(100, sum(weight) OVER (PARTITION BY identifier))) AS INTEGER) AS relevance_score FROM s""", "vulns")
