"""Feeds, catalogues, projections and merging as queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import extraction
from lodestrata.functions import interfaces as I
from lodestrata.operators import catalogue, correlation, evidence, exploration, graph, history, merging, projection, review
from lodestrata.plans.oracles import ORACLES
from lodestrata.plans.queries import query
from lodestrata.plans.views import view_over, with_views
from lodestrata.sources import feeds


def _sql(name: str, sql: str, *views: str) -> None:
    ORACLES[name] = with_views(sql, *views) if views else sql


# feeds

@query
def cve_records(v):
    """Named records, records with a product only or with none, nested nodes, metrics of several versions."""
    raw, n = v("cve_raw"), F.col("n")
    text = lambda lang, c: F.when(c.isNotNull(), F.struct(F.lit(lang).alias("lang"), c.alias("value")))
    english = F.when(n % 7 == 1, "A buffer overflow in foo.").when(n % 7 == 2, F.concat(F.lit("line one\nline two of "), n, F.lit(". end"))).when(n % 7 == 3, "").otherwise(F.col("en"))

    def metric(kind, version, score, severity, source):
        data = F.struct(version.alias("version"), F.col(score).alias("baseScore"), severity.alias("baseSeverity"), F.when(n % 2 == 0, "NETWORK").alias("attackVector"), F.lit("LOCAL").alias("accessVector"), F.when(n % 3 == 0, "REQUIRED").alias("userInteraction"), F.lit("UNCHANGED").alias("scope"))
        return F.struct(F.lit(kind).alias("type"), F.lit(source).alias("source"), data.alias("cvssData"), F.when(n % 4 == 0, "medium").alias("baseSeverity"), (n % 10).cast("double").alias("impactScore"), F.lit("true").alias("userInteractionRequired"))

    none = F.lit(None).cast("string")
    newer = F.when(F.col("score31").isNotNull(), F.array(metric("Secondary", F.when(n % 5 != 0, "3.1"), "score31", F.col("severity31"), "other"), metric("Primary", F.lit("3.1"), "score31", F.col("severity31"), "nist")))
    cpe = lambda vendor: F.concat(F.lit("cpe:2.3:o:"), vendor, F.lit(":"), "product", F.lit(":1.0:*:*:*:*:*:*:*"))
    match = lambda c, holds: F.array(F.struct(holds.alias("vulnerable"), c.alias("criteria")))
    deep = F.struct(match(F.concat(F.lit("cpe:/h:tp-link:"), "product"), F.lit(None).cast("boolean")).alias("cpeMatch"))
    inner = F.struct(F.when(n % 3 == 0, False).alias("vulnerable"), match(cpe(F.lit("second")), F.lit(None).cast("boolean")).alias("cpeMatch"), F.array(deep).alias("children"))
    node = F.struct(F.when(n % 4 != 0, True).alias("vulnerable"), F.concat(match(cpe(F.col("vendor")), F.when(n % 6 == 0, False)), match(cpe(F.col("vendor")), F.lit(True))).alias("cpeMatch"), F.array(inner).alias("children"))
    bare = n % 6 == 1
    item = F.struct(
        F.col("identifier").alias("id"), F.array_compact(F.array(text("de", F.col("de")), text("en", english))).alias("descriptions"), F.struct(newer.alias("cvssMetricV31"), F.array(metric("Secondary", none, "score2", none, "old")).alias("cvssMetricV2")).alias("metrics"),
        F.array(F.struct(F.array(F.struct(F.lit("en").alias("lang"), F.col("cwe").alias("value")), F.struct(F.lit("en").alias("lang"), F.lit("").alias("value"))).alias("description"))).alias("weaknesses"), F.when(~bare & (n % 6 != 2), F.array(F.struct(F.array(node).alias("nodes")))).alias("configurations"),
        F.when(n % 6 == 2, F.array(F.struct(F.when(n % 4 == 0, "ACME").alias("vendor"), F.concat(F.lit("P "), n % 9).alias("product"), F.array(F.lit("cpe:2.3:o:acme:p:1")).alias("cpes")))).when(n % 6 == 3, F.array(F.struct(F.lit("n/a").alias("vendor"), F.lit("SECOND").alias("product"), F.array(F.lit("")).alias("cpes")))).alias("affected"),
        F.array(F.struct(F.col("link").alias("url"), F.when(F.col("exploit"), F.array(F.lit("Exploit"))).otherwise(F.array(F.lit("exploit-like"))).alias("tags")), F.struct(F.lit("").alias("url"), F.array(F.lit("Exploit")).alias("tags"))).alias("references"),
    )
    r = feeds.normalize_cve(raw.select(F.from_json(F.to_json(item), feeds.CVE_SCHEMA).alias("cve")))
    metrics = F.array_join(F.transform("cvss_metrics", lambda m: F.concat_ws("/", m["version"], m["source"], m["base_severity"], m["attack_vector"], m["user_interaction"], m["impact_score"].cast("int"))), " ")
    return r.select(
        "identifier", "summary", "cvss_score", "cvss_version", "severity", "vendor", "product", "title", metrics.alias("metrics"), F.array_join("cpes", " ").alias("cpes"), F.array_join(F.transform("affected_products", lambda p: F.when(p["vulnerable"], "y").otherwise("n")), "").alias("vulnerable"),
        "nodes_cut", F.array_join("cwes", ";").alias("cwes"), F.array_join("references", ";").alias("links"), F.size("exploit_references").alias("exploits"), F.array_join("vendors", ";").alias("vendors"), F.array_join("products", ";").alias("products"),
    )


_sql("cve_records", r"""WITH t AS (SELECT *, n % 6 = 1 OR n % 6 = 2 AS plain, CASE WHEN n % 7 = 1 THEN 'A buffer overflow in foo.' WHEN n % 7 = 2 THEN 'line one' || chr(10) || 'line two of ' || n || '. end' WHEN n % 7 = 3 THEN '' ELSE en END AS english FROM cve_raw),
 band AS (SELECT *, coalesce(english, de) AS summary, CASE WHEN score31 = 0 THEN 'NONE' WHEN score31 < 4 THEN 'LOW' WHEN score31 < 7 THEN 'MEDIUM' WHEN score31 < 9 THEN 'HIGH' ELSE 'CRITICAL' END AS band31, CASE WHEN score2 < 4 THEN 'LOW' WHEN score2 < 7 THEN 'MEDIUM' ELSE 'HIGH' END AS band2,
   CASE WHEN n % 4 = 0 THEN 'MEDIUM' END AS own, concat_ws('/', CASE WHEN n % 2 = 0 THEN 'NETWORK' ELSE 'LOCAL' END, CASE WHEN n % 3 = 0 THEN 'REQUIRED' ELSE 'true' END, n % 10) AS rest,
   'cpe:2.3:o:' || vendor || ':' || product || ':1.0:*:*:*:*:*:*:*' AS c1, 'cpe:2.3:o:second:' || product || ':1.0:*:*:*:*:*:*:*' AS c2, 'cpe:/h:tp-link:' || product AS c3 FROM t),
 m AS (SELECT *, coalesce(upper(severity31), own, band31) AS s31, coalesce(own, band2) AS s2,
   list_filter([CASE WHEN n % 6 = 2 AND n % 4 = 0 THEN 'ACME' END, CASE WHEN n % 6 = 2 AND n % 4 <> 0 THEN 'acme' END, CASE WHEN NOT plain AND vendor <> '*' THEN replace(vendor, '_', ' ') END, CASE WHEN NOT plain THEN 'second' END, CASE WHEN NOT plain THEN 'TP-Link' END], lambda x: x IS NOT NULL) AS vendors,
   list_filter([CASE WHEN n % 6 = 2 THEN 'P ' || (n % 9) END, CASE WHEN n % 6 = 2 THEN 'p' END, CASE WHEN n % 6 = 3 THEN 'SECOND' END, CASE WHEN NOT plain THEN replace(product, '_', ' ') END], lambda x: x IS NOT NULL) AS products FROM band)
SELECT identifier, summary, coalesce(score31, score2) AS cvss_score, CASE WHEN score31 IS NOT NULL THEN '3.1' ELSE '2.0' END AS cvss_version, CASE WHEN score31 IS NOT NULL THEN s31 ELSE s2 END AS severity, vendors[1] AS vendor, products[1] AS product,
 CASE WHEN len(vendors) + len(products) > 0 THEN identifier || ' · ' || coalesce(vendors[1], '') || ' ' || coalesce(products[1], '') WHEN split_part(summary, '. ', 1) <> '' THEN substr(split_part(summary, '. ', 1), 1, 120) ELSE identifier END AS title,
 concat_ws(' ', CASE WHEN score31 IS NOT NULL THEN concat_ws('/', '3.1', 'nist', s31, rest) || ' ' || concat_ws('/', '3.1', 'other', s31, rest) END, concat_ws('/', '2.0', 'old', s2, rest)) AS metrics,
 CASE WHEN n % 6 = 1 THEN '' WHEN n % 6 = 2 THEN 'cpe:2.3:o:acme:p:1' ELSE concat_ws(' ', c1, CASE WHEN c2 <> c1 THEN c2 END, c3) || CASE WHEN n % 6 = 3 THEN ' ' ELSE '' END END AS cpes,
 CASE WHEN plain THEN '' ELSE CASE WHEN n % 6 = 0 THEN 'n' WHEN n % 4 <> 0 THEN 'y' ELSE 'n' END || 'y' || CASE WHEN n % 3 = 0 THEN 'nn' WHEN n % 4 <> 0 THEN 'yy' ELSE 'nn' END END AS vulnerable, false AS nodes_cut,
 cwe AS cwes, link AS links, CASE WHEN exploit THEN 1 ELSE 0 END AS exploits, array_to_string(vendors, ';') AS vendors, array_to_string(products, ';') AS products FROM m""", "cve_raw")


@query
def kev_records(v):
    c = F.col
    item = F.struct(
        F.concat(F.lit("CVE-K-"), "c_custkey").alias("cveID"), c("c_mktsegment").alias("vendorProject"), c("c_name").alias("product"), F.concat(F.lit("Bug in "), "c_name").alias("vulnerabilityName"), F.lit("2024-01-02").alias("dateAdded"), c("c_nationkey").cast("string").alias("shortDescription"),
        F.lit("patch").alias("requiredAction"), F.lit("2024-02-02").alias("dueDate"), F.when(c("c_custkey") % 2 == 0, "Known").otherwise("Unknown").alias("knownRansomwareCampaignUse"),
        F.concat(F.lit("see this; https://example.com/"), "c_custkey", F.when(c("c_custkey") % 3 == 0, " ; http://example.org/x").otherwise("")).alias("notes"), F.when(c("c_custkey") % 4 != 0, F.array(F.concat(F.lit("CWE-"), c("c_custkey") % 11))).alias("cwes"),
    )
    r = feeds.normalize_kev(v("customer").select(F.lit("2024-03-03").alias("dateReleased"), item.alias("v")))
    return r.select("identifier", "source", "title", "summary", "vendor", "product", "kev_date_added", "kev_due_date", "ransomware_use", "kev", F.array_join("cwes", ";").alias("cwes"), F.array_join("references", " ").alias("links"), "modified_at")


_sql("kev_records", """SELECT 'CVE-K-' || c_custkey AS identifier, 'cisa-kev' AS source, 'Bug in ' || c_name AS title, CAST(c_nationkey AS VARCHAR) AS summary, c_mktsegment AS vendor, c_name AS product, '2024-01-02' AS kev_date_added, '2024-02-02' AS kev_due_date,
 CASE WHEN c_custkey % 2 = 0 THEN 'Known' ELSE 'Unknown' END AS ransomware_use, true AS kev, CASE WHEN c_custkey % 4 <> 0 THEN 'CWE-' || (c_custkey % 11) ELSE '' END AS cwes, 'https://example.com/' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN ' http://example.org/x' ELSE '' END AS links, '2024-03-03' AS modified_at FROM customer""")


@query
def text_identifiers(v):
    """Ids with a letter before them, of few digits or in lower case are none; each counts once."""
    rows = v("notes")
    return rows.select("n", F.array_join(feeds.vulnerability_identifiers(F.col("text")), ",").alias("ids"), F.array_join(feeds.benchmark_identifiers(F.col("text")), ",").alias("benchmarks"))


_sql("text_identifiers", r"""WITH f AS (SELECT n, regexp_extract_all(text, '\bC(?:VE|NVD)-[0-9]{4}-[0-9]+\b') AS a, regexp_extract_all(text, '\bBM-[0-9]{4}-[0-9]+\b') AS b FROM notes)
SELECT n, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS ids, array_to_string(list_filter(b, lambda x, i: list_position(b, x) = i), ',') AS benchmarks FROM f""", "notes")


@query
def device_rows(v):
    n = F.col("p_partkey")
    line = F.when(n % 9 == 0, "| Vendor | Model | Version | Link |").when(n % 9 == 1, "| --- | :--- | ---: | - |").when(n % 9 == 2, "plain text").when(n % 9 == 3, F.concat(F.lit("| only | three | "), n, F.lit(" |")))
    line = F.coalesce(line, F.concat(F.lit("  | "), "p_brand", F.lit(" | "), "p_name", F.lit("|"), n, F.lit(" | http://x/"), n, F.lit(" |")))
    return feeds.device_table(v("part").select(line.alias("value")))


_sql("device_rows", "SELECT p_brand AS vendor, trim(p_name) AS model, CAST(p_partkey AS VARCHAR) AS version, 'http://x/' || p_partkey AS link FROM part WHERE p_partkey % 9 > 3")


@query
def listed_candidates(v):
    n = F.col("p_partkey")
    url = F.concat(F.when(n % 10 == 0, "gopher://").when(n % 10 == 1, "HTTPS://").otherwise("https://"), F.when(n % 13 == 0, "").otherwise(F.concat(F.lit("Host"), n % 20, F.lit(".example.com"))), F.lit("/fw/"), n, F.lit(".bin?x=1"))
    return feeds.catalogue_rows(v("part").select(url.alias("url"), F.when(n % 4 == 0, " ").otherwise(F.col("p_brand")).alias("vendor"), F.lit(None).cast("string").alias("product"), n.cast("string").alias("version")))


_sql("listed_candidates", """WITH u AS (SELECT CASE p_partkey % 10 WHEN 0 THEN 'gopher://' WHEN 1 THEN 'HTTPS://' ELSE 'https://' END || CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'Host' || (p_partkey % 20) || '.example.com' END || '/fw/' || p_partkey || '.bin?x=1' AS url, * FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 13 <> 0)
SELECT 'list:' || sha256(url) AS candidate_id, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE p_brand END AS vendor, 'unknown' AS product, CAST(p_partkey AS VARCHAR) AS version, url AS download_url, 'host' || (p_partkey % 20) || '.example.com' AS download_host, p_partkey || '.bin' AS filename FROM u""")


@query
def verified_files(v):
    """Some files have no META, some one of another size, some one of another digest, in other case."""
    docs = v("documents").where("text is not null").groupBy(F.col("doc_id").cast("string").alias("name")).agg(F.max("text").alias("text"))
    files = docs.select("name", F.encode("text", "UTF-8").alias("content"))
    n = F.col("name").cast("long")
    digest = F.sha2("text", 256)
    meta = docs.select(F.when(n % 7 == 0, F.concat(F.lit("other"), "name")).otherwise(F.col("name")).alias("name"), (F.octet_length("text") + F.when(n % 5 == 0, 1).otherwise(0)).cast("string").alias("size"), F.when(n % 3 == 0, F.sha2(F.lower("text"), 256)).when(n % 3 == 1, F.upper(digest)).otherwise(digest).alias("sha256"))
    return feeds.verify_files(files, meta)


_sql("verified_files", """WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS name, max(text) AS text, doc_id AS n FROM documents WHERE text IS NOT NULL GROUP BY doc_id),
 m AS (SELECT CASE WHEN n % 7 = 0 THEN 'other' || name ELSE name END AS name, octet_length(encode(text)) + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN n % 3 = 0 THEN sha256(lower(text)) ELSE sha256(text) END AS digest FROM f)
SELECT name, coalesce(octet_length(encode(text)) = size AND sha256(text) = digest, false) AS valid FROM f LEFT JOIN m USING (name)""")


@query
def feeds_wanted(v):
    meta = v("supplier").select("s_name", "s_suppkey").select(F.col("s_name").alias("name"), F.concat(F.lit("d"), F.col("s_suppkey") % 4).alias("sha256"))
    states = v("supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("d"), F.col("s_suppkey") % 2).alias("sha256"), F.when(F.col("s_suppkey") % 3 == 0, "failed").otherwise("imported").alias("status"))
    return feeds.feeds_to_load(meta, states)


_sql("feeds_wanted", "SELECT s_name AS name, 'd' || (s_suppkey % 4) AS sha256 FROM supplier WHERE NOT (s_suppkey % 3 <> 0 AND s_suppkey % 4 = s_suppkey % 2)")

# projections


def _catalogue(v) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    n, o = F.col("s_suppkey"), F.col("o_orderkey")
    candidates = v("observed").withColumn("n", F.expr("CAST(substr(candidate_id, 5) AS BIGINT)")).select(
        "candidate_id", "candidate_kind", "canonical_identity", F.lit("supported").alias("claim_status"), F.when(F.col("n") % 5 == 0, "").otherwise(F.concat(F.lit("www/p"), F.col("n") % 9)).alias("source_path"),
        F.when(F.col("n") % 4 == 0, F.concat(F.lit("cand"), F.col("n") + 1)).alias("target_ref"),
    )
    parameters = v("orders").select(F.concat(F.lit("par"), o).alias("parameter_id"), F.concat(F.lit("cand"), F.col("o_custkey") % 120).alias("owner_ref"), F.concat(F.lit("arg"), o % 8).alias("name"))
    associations = v("supplier").select(F.concat(F.lit("as"), n).alias("association_id"), F.concat(F.lit("cand"), n).alias("frontend_candidate_id"), F.concat(F.lit("cand"), n + 2).alias("native_hint_id"))
    obligations = v("nation").select(F.concat(F.lit("ob"), "n_nationkey").alias("obligation_id"), F.concat(F.lit("cand"), F.col("n_nationkey") * 3).alias("target_ref"), F.lit("trace").alias("required_capability"), F.lit("open").alias("status"))
    return candidates, parameters, associations, obligations


_CATALOGUE = """c AS (SELECT candidate_id, candidate_kind, canonical_identity, CASE WHEN n % 5 = 0 THEN '' ELSE 'www/p' || (n % 9) END AS source_path, CASE WHEN n % 4 = 0 THEN 'cand' || (n + 1) END AS target_ref FROM (SELECT *, CAST(substr(candidate_id, 5) AS BIGINT) AS n FROM observed)),
p AS (SELECT 'par' || o_orderkey AS parameter_id, 'cand' || (o_custkey % 120) AS owner_ref, 'arg' || (o_orderkey % 8) AS name FROM orders),
a AS (SELECT 'as' || s_suppkey AS association_id, 'cand' || s_suppkey AS one, 'cand' || (s_suppkey + 2) AS two FROM supplier),
o AS (SELECT 'ob' || n_nationkey AS obligation_id, 'cand' || (n_nationkey * 3) AS target_ref FROM nation),
pn AS (SELECT candidate_id AS node_id, CASE WHEN candidate_kind = 'native_hint' THEN {hint} ELSE {request} END AS node_kind, canonical_identity AS label FROM c UNION ALL SELECT DISTINCT 'artifact:' || source_path, 'artifact', source_path FROM c WHERE source_path <> ''
  UNION ALL SELECT parameter_id, 'parameter', name FROM p UNION ALL SELECT obligation_id, 'obligation', 'trace' FROM o),
pe AS (SELECT 'declared_in_artifact' AS edge_kind, candidate_id AS source_ref, 'artifact:' || source_path AS target_ref, candidate_id AS origin_ref FROM c WHERE source_path <> '' UNION ALL SELECT 'has_parameter', owner_ref, parameter_id, parameter_id FROM p
  UNION ALL SELECT 'targets', candidate_id, target_ref, candidate_id FROM c WHERE target_ref IS NOT NULL UNION ALL SELECT 'associated_with', one, two, association_id FROM a UNION ALL SELECT 'requires_evidence_for', obligation_id, target_ref, obligation_id FROM o)""".format(
    hint=f"'{projection.NODE_KINDS.get('native_hint', 'evidence_candidate')}'", request=f"'{projection.NODE_KINDS.get('frontend_request', 'evidence_candidate')}'"
)


@query
def projected_nodes(v):
    return projection.project_graph(*_catalogue(v))[0].select("node_id", "node_kind", "label")


@query
def projected_edges(v):
    return projection.project_graph(*_catalogue(v))[1].select("edge_kind", "source_ref", "target_ref", "origin_ref")


@query
def projected_unresolved(v):
    return projection.project_graph(*_catalogue(v))[2]


_sql("projected_nodes", f"WITH {_CATALOGUE} SELECT * FROM pn", "observed")
_sql("projected_edges", f"WITH {_CATALOGUE} SELECT * FROM pe WHERE source_ref IN (SELECT node_id FROM pn) AND target_ref IN (SELECT node_id FROM pn)", "observed")
_sql("projected_unresolved", f"WITH {_CATALOGUE} SELECT 'unresolved_reference:' || edge_kind || ':' || origin_ref AS diagnostic FROM pe WHERE source_ref NOT IN (SELECT node_id FROM pn) OR target_ref NOT IN (SELECT node_id FROM pn)", "observed")


@query
def tree_levels(v):
    candidates, parameters, _, _ = _catalogue(v)
    bindings = v("supplier").select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "goform/").otherwise("other/"), "s_suppkey").alias("route"), F.concat(F.lit("lib"), F.col("s_suppkey") % 6).alias("component"))
    typed = parameters.withColumn("selector_values", F.when(F.col("name") < "arg4", F.array(F.lit("1"), F.lit("-2"))).when(F.col("name") == "arg4", F.array(F.lit("True"))).when(F.col("name") == "arg5", F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))))
    return projection.interface_tree(candidates, bindings, typed)


_sql("tree_levels", f"""WITH {_CATALOGUE}, m AS (SELECT candidate_id, canonical_identity, CASE WHEN CAST(substr(candidate_id, 5) AS BIGINT) % 2 = 0 THEN 'lib' || (CAST(substr(candidate_id, 5) AS BIGINT) % 6) ELSE 'unbound' END AS component FROM c),
 l AS (SELECT DISTINCT owner_ref, name FROM p WHERE owner_ref IN (SELECT candidate_id FROM c))
SELECT 'parameter' AS level, owner_ref || '#' || name AS node, owner_ref AS parent, name AS label, CASE WHEN name < 'arg4' THEN 'integer' WHEN name = 'arg4' THEN 'boolean' WHEN name = 'arg5' THEN 'unknown' ELSE 'string' END AS detail, 0 AS children FROM l
UNION ALL SELECT 'interface', candidate_id, component, canonical_identity, '', (SELECT count(*) FROM l WHERE l.owner_ref = candidate_id) FROM m
UNION ALL SELECT 'component', component, 'firmware', component, '', count(*) FROM m GROUP BY component""", "observed")


@query
def overlay_nodes(v):
    candidates, _, _, _ = _catalogue(v)
    nodes, edges, _ = projection.project_graph(*_catalogue(v))
    matches = v("orders").select(F.concat(F.lit("CVE-H-"), F.col("o_custkey") % 50).alias("identifier"), F.concat(F.lit("cand"), F.col("o_orderkey") % 150).alias("candidate_id")).distinct()
    placed, between, lost = projection.induced_overlay(matches, nodes, edges)
    count = lambda df, n: df.groupBy("identifier").agg(F.count("*").alias(n))
    return count(placed, "nodes").join(count(between, "edges"), "identifier", "full").unionByName(lost.select("identifier", F.lit(0).cast("long").alias("nodes"), F.lit(None).cast("long").alias("edges")))


_sql("overlay_nodes", f"""WITH {_CATALOGUE}, m AS (SELECT DISTINCT 'CVE-H-' || (o_custkey % 50) AS identifier, 'cand' || (o_orderkey % 150) AS candidate_id FROM orders),
 x AS (SELECT * FROM m WHERE candidate_id IN (SELECT node_id FROM pn)), ids AS (SELECT DISTINCT identifier FROM m),
 b AS (SELECT identifier, count(*) AS edges FROM (SELECT DISTINCT x.identifier, edge_kind, source_ref, target_ref, origin_ref FROM pe JOIN x ON x.candidate_id = source_ref JOIN x y ON y.candidate_id = target_ref AND y.identifier = x.identifier) GROUP BY 1)
SELECT identifier, (SELECT count(*) FROM x WHERE x.identifier = ids.identifier) AS nodes, edges FROM ids LEFT JOIN b USING (identifier)""", "observed")


@query
def call_reach(v):
    calls = v("orders").select(F.concat(F.lit("f"), F.col("o_custkey") % 300).alias("caller"), F.concat(F.lit("f"), F.col("o_orderkey") % 307).alias("callee"))
    anchors = v("region").select(F.concat(F.lit("f"), F.col("r_regionkey") * 11).alias("anchor"))
    return projection.call_closure(calls, anchors, 2)


_sql("call_reach", """WITH RECURSIVE s AS (SELECT DISTINCT 'f' || (o_custkey % 300) AS caller, 'f' || (o_orderkey % 307) AS callee FROM orders), w AS (
 SELECT 'f' || (r_regionkey * 11) AS origin, 'f' || (r_regionkey * 11) AS function, 0 AS depth FROM region UNION SELECT w.origin, s.callee, w.depth + 1 FROM w JOIN s ON s.caller = w.function WHERE w.depth < 2)
SELECT origin, function, min(depth) AS depth FROM w GROUP BY ALL""")


@query
def exports_resolved(v):
    n = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("sym"), c % 60)
    uses = v("part").select(F.concat(F.lit("bin"), n % 40).alias("path"), name(n).alias("name")).distinct()
    exports = v("supplier").select(F.concat(F.when(F.col("s_suppkey") % 4 == 0, "bin").otherwise("lib"), F.col("s_suppkey") % 7).alias("path"), name(F.col("s_suppkey")).alias("name")).distinct()
    needed = v("nation").select(F.concat(F.lit("bin"), "n_nationkey").alias("path"), F.concat(F.lit("lib"), F.col("n_nationkey") % 7).alias("library")).unionByName(v("nation").select(F.concat(F.lit("bin"), "n_nationkey"), F.concat(F.lit("lib"), (F.col("n_nationkey") + 3) % 7)).toDF("path", "library")).distinct()
    return projection.resolve_exports(uses, exports, needed)


_sql("exports_resolved", """WITH u AS (SELECT DISTINCT 'bin' || (p_partkey % 40) AS path, 'sym' || (p_partkey % 60) AS name FROM part), e AS (SELECT DISTINCT CASE WHEN s_suppkey % 4 = 0 THEN 'bin' ELSE 'lib' END || (s_suppkey % 7) AS path, 'sym' || (s_suppkey % 60) AS name FROM supplier),
 d AS (SELECT 'bin' || n_nationkey AS path, 'lib' || (n_nationkey % 7) AS library FROM nation UNION SELECT 'bin' || n_nationkey, 'lib' || ((n_nationkey + 3) % 7) FROM nation),
 l AS (SELECT d.path, e.name, count(*) AS n, min(library) AS library FROM d JOIN e ON e.path = d.library GROUP BY ALL), t AS (SELECT u.*, CASE WHEN e.path IS NOT NULL THEN u.path WHEN l.n = 1 THEN l.library END AS target_path FROM u LEFT JOIN e USING (path, name) LEFT JOIN l USING (path, name))
SELECT *, CASE WHEN target_path IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM t""")


@query
def hidden_documents(v):
    o, n = F.col("o_orderkey"), F.col("n")
    cats = v("catalogs").select("catalog_id", "firmware", F.col("status").alias("source_inventory_coverage_status"), F.expr("CAST(substr(catalog_id, 4) AS BIGINT)").alias("n"))
    cover = cats.select("catalog_id", F.explode(F.array(F.struct(F.lit("frontend").alias("producer_kind"), F.lit("completed").alias("status")), F.struct(F.when(n % 8 == 0, "native").otherwise("set_difference").alias("producer_kind"), F.when(n % 5 == 0, "partial").otherwise("completed").alias("status")))).alias("x")).select("catalog_id", "x.*")
    diffs = cats.select("catalog_id", F.lit("native").alias("side"), F.when(n % 2 == 0, "native_registration_no_frontend_reference").otherwise("frontend_scope_gap").alias("kind"), F.concat(F.lit("tok"), n % 11).alias("token"))
    proof = lambda capability, subject, value: cats.select("catalog_id", F.lit(capability).alias("capability"), subject.alias("subject_ref"), value.alias("object_value"))
    proofs = proof("registers_route", F.lit("s"), F.concat(F.lit("tok"), n % 11)).unionByName(proof("binds_handler", F.when(n % 7 == 0, "other").otherwise("s"), F.lit("h1"))).unionByName(proof("binds_handler", F.when(n % 3 == 1, "s").otherwise("none"), F.lit("h0")))
    return evidence.hidden_interfaces(cats.drop("n"), cover, diffs, proofs).select("catalog_id", "firmware", "token", F.array_join("handlers", ",").alias("handlers"))


_sql("hidden_documents", """SELECT catalog_id, firmware, 'tok' || (n % 11) AS token, CASE WHEN n % 3 = 1 AND n % 7 <> 0 THEN 'h0,h1' WHEN n % 3 = 1 THEN 'h0' ELSE 'h1' END AS handlers
FROM (SELECT *, CAST(substr(catalog_id, 4) AS BIGINT) AS n FROM catalogs) WHERE status = 'completed' AND n % 8 <> 0 AND n % 5 <> 0 AND n % 2 = 0 AND (n % 7 <> 0 OR n % 3 = 1)""", "catalogs")


@query
def catalogue_listing(v):
    cats = v("catalogs").select("catalog_id", "published_at")
    cands = v("lineitem").select(F.concat(F.when(F.col("l_orderkey") % 3 > 0, "cat").otherwise("none"), "l_orderkey").alias("catalog_id"), F.array_repeat(F.lit("e"), (F.col("l_linenumber") % 3).cast("int")).alias("evidence_ids"))
    contexts = v("orders").select(F.concat(F.when(F.col("o_orderkey") % 4 == 0, "cat").otherwise("none"), "o_orderkey").alias("catalog_id"), F.col("o_orderstatus").alias("vendor"))
    return projection.catalogue_listing(cats, cands, contexts)


_sql("catalogue_listing", """WITH k AS (SELECT 'cat' || l_orderkey AS catalog_id, count(*) AS candidates, sum(l_linenumber % 3) AS evidence_references FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1), x AS (SELECT 'cat' || o_orderkey AS catalog_id, o_orderstatus AS vendor FROM orders WHERE o_orderkey % 4 = 0)
SELECT catalog_id, published_at, coalesce(candidates, 0) AS candidates, CAST(evidence_references AS BIGINT) AS evidence_references, vendor FROM catalogs LEFT JOIN k USING (catalog_id) LEFT JOIN x USING (catalog_id)""", "catalogs")

# merging and review


@query
def lists_united(v):
    e = v("events").select("event_id", (F.col("user_id") % 200).cast("string").alias("identifier"), F.lit("nvd").alias("source"), F.array(F.concat(F.lit("CWE-"), F.col("event_id") % 5), F.concat(F.lit("CWE-"), F.col("event_id") % 3)).alias("cwes"))
    return merging.merge_records(e, "event_id").select("identifier", F.array_join("cwes", ",").alias("cwes"))


_sql("lists_united", """WITH x AS (SELECT user_id % 200 AS k, 'CWE-' || (event_id % 5) AS c, event_id * 2 AS pos FROM events UNION ALL SELECT user_id % 200, 'CWE-' || (event_id % 3), event_id * 2 + 1 FROM events), f AS (SELECT k, c, min(pos) AS pos FROM x GROUP BY ALL)
SELECT CAST(k AS VARCHAR) AS identifier, string_agg(c, ',' ORDER BY pos) AS cwes FROM f GROUP BY k""")


@query
def observations_merged(v):
    row = lambda c: v("part").select((F.col("p_partkey") % 30).cast("string").alias("identifier"), c.alias("value"), F.col("p_partkey").alias("n"))
    rules = row(F.upper(F.substring("p_type", 1, 5))).groupBy("identifier", "value").agg(F.min("n").alias("n")).withColumn("origin", F.lit("rules"))
    model = row(F.lower(F.substring("p_type", 1, 6))).groupBy("identifier", "value").agg(F.min("n").alias("n")).withColumn("origin", F.lit("model"))
    return merging.merge_observations(rules, model, ["identifier", "value"])


_sql("observations_merged", """WITH r AS (SELECT CAST(p_partkey % 30 AS VARCHAR) AS identifier, upper(substr(p_type, 1, 5)) AS value, min(p_partkey) AS n FROM part GROUP BY 1, 2), m AS (SELECT CAST(p_partkey % 30 AS VARCHAR) AS identifier, lower(substr(p_type, 1, 6)) AS value, min(p_partkey) AS n FROM part GROUP BY 1, 2)
SELECT *, 'rules' AS origin FROM r UNION ALL SELECT *, 'model' FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.identifier = m.identifier AND lower(r.value) = m.value)""")


@query
def checked_union(v):
    c = v("customer").select("c_custkey", "c_name")
    return merging.checked_union(c.unionByName(c).unionByName(c), "c_custkey")


_sql("checked_union", "SELECT c_custkey, c_name FROM customer")


@query
def analyses_to_compute(v):
    inputs = v("vulns").select("identifier", "title", "summary")
    done = merging.to_compute(inputs, inputs.limit(0).select("identifier", F.lit("").alias("input_sha256"), F.lit("").alias("fingerprint")), "m1")
    n = F.substring_index("identifier", "-", -1).cast("long")
    old = done.withColumn("fingerprint", F.when((n % 3 == 0) & (n % 2 != 0), F.col("fingerprint")).otherwise("m0"))
    return merging.to_compute(inputs, old, "m1").select("identifier")


_sql("analyses_to_compute", "SELECT identifier FROM vulns WHERE NOT (vid % 3 = 0 AND vid % 2 <> 0)", "vulns")


@query
def jobs_interrupted(v):
    return review.fail_interrupted(v("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"), F.lit(None).cast("string").alias("error")))


_sql("jobs_interrupted", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderstatus = 'O' THEN 'interrupted' END AS error FROM orders")


@query
def outcomes_combined(v):
    rows = v("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")).select(F.col("l_orderkey").alias("obligation_id"), F.col("l_linenumber").alias("place"), (F.col("p") % 4 == 0).alias("resolved"), F.array(F.concat(F.lit("e"), F.col("p") % 3)).alias("evidence_ids"))
    return review.combine_outcomes(rows).select("obligation_id", "resolved", F.array_join("evidence_ids", ",").alias("evidence"))


_sql("outcomes_combined", """WITH x AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), f AS (SELECT l_orderkey, 'e' || (p % 3) AS e, min(l_linenumber) AS pos FROM x GROUP BY 1, 2)
SELECT obligation_id, resolved, evidence FROM (SELECT l_orderkey AS obligation_id, bool_or(p % 4 = 0) AS resolved FROM x GROUP BY 1) JOIN (SELECT l_orderkey AS obligation_id, string_agg(e, ',' ORDER BY pos) AS evidence FROM f GROUP BY 1) USING (obligation_id)""")


@query
def bindings_viewed(v):
    s = v("supplier")
    rows = lambda handler, proof: s.select(F.concat(F.lit("lib"), F.col("s_suppkey") % 5).alias("canonical_path"), F.concat(F.lit("r"), "s_suppkey").alias("route_token"), handler.alias("handler_address"), F.lit("p").alias("producer"), F.array(F.lit(proof)).alias("evidence_ids"))
    r = review.binding_view(rows(F.lit("0x10"), "own"), rows(F.when(F.col("s_suppkey") % 3 == 0, "0x10").otherwise("0x20"), "better"))
    return r.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


_sql("bindings_viewed", "SELECT 'lib' || (s_suppkey % 5) AS canonical_path, 'r' || s_suppkey AS route_token, '0x10' AS handler_address, 'p' AS producer, CASE WHEN s_suppkey % 3 = 0 THEN 'better' ELSE 'own' END AS evidence_ids, s_suppkey % 3 = 0 AS anchored FROM supplier")

# search and correlation


@query
def suffix_variants(v):
    """Identifiers that end in a token after 2 to 24 more characters, some after fewer or more, some by chance."""
    tokens = v("nation").select(F.lower("n_name").alias("token")).unionByName(v("region").select(F.lower("r_name").alias("token"))).unionByName(v("customer").select(F.substring("c_name", -3, 3).alias("token")))
    return correlation.suffix_hits(tokens, v("scripts"), "n", "text")


_sql("suffix_variants", """WITH t AS (SELECT lower(n_name) AS token FROM nation UNION SELECT lower(r_name) FROM region UNION SELECT right(c_name, 3) FROM customer), w AS (SELECT n, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM scripts)
SELECT token, n, count(*) AS hits FROM w JOIN t ON ends_with(word, token) AND length(word) - length(token) BETWEEN 2 AND 24 GROUP BY ALL""", "scripts")


@query
def parameter_clues(v):
    words = v("part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("content"))
    names = words.select(F.explode(F.split("content", " ")).alias("name")).where("name rlike '^[A-Za-z0-9_]+$'").select("name").distinct()
    return correlation.parameter_clues(names, words, 3)


_sql("parameter_clues", """WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS path, unnest(regexp_extract_all(p_name, '[A-Za-z0-9_]+')) AS name FROM part), s AS (SELECT unnest(string_split(p_name, ' ')) AS name FROM part), n AS (SELECT DISTINCT name FROM s WHERE regexp_matches(name, '^[A-Za-z0-9_]+$')),
 h AS (SELECT name, path, count(*) AS hits FROM w WHERE name IN (SELECT name FROM n) GROUP BY ALL) SELECT name, path, hits, place FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) AS place FROM h) WHERE place <= 3""")


@query
def interface_associations(v):
    top = v("interface_obs").agg(F.min("value").alias("value")).first()["value"]
    return exploration.associations(v("interface_obs"), v("vulns"), top)


_sql("interface_associations", """WITH h AS (SELECT identifier, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, max(confidence) AS confidence FROM interface_obs WHERE value = (SELECT min(value) FROM interface_obs) GROUP BY identifier)
SELECT h.*, severity, cvss_score FROM h JOIN vulns USING (identifier)""", "interface_obs", "vulns")


@query
def lead_candidates(v):
    some = v("leads").agg(F.min("identifier")).first()[0]
    with_any = catalogue.with_lead(v("candidates"), v("leads"), identifier=some.lower(), method="version").select("candidate_id", F.lit("version").alias("why"))
    return with_any.unionByName(catalogue.with_lead(v("candidates"), v("leads"), method="product_scope", has_vulnerability=False).select("candidate_id", F.lit("none").alias("why")))


_sql("lead_candidates", """SELECT candidate_id, 'version' AS why FROM candidates WHERE candidate_id IN (SELECT candidate_id FROM leads WHERE identifier = (SELECT min(identifier) FROM leads) AND match_method IN ('exact_version', 'version_range'))
UNION ALL SELECT candidate_id, 'none' FROM candidates WHERE candidate_id NOT IN (SELECT candidate_id FROM leads WHERE match_method = 'product_scope')""", "candidates", "leads")


@query
def vulnerability_samples(v):
    leads_of = lambda vulns: view_over("leads", lineitem=v("lineitem"), vulns=vulns)
    first = catalogue.least_with_lead(v("vulns"), leads_of)
    one = F.broadcast(v("vulns").where(F.col("identifier") == first))  # a row: it holds the key
    return catalogue.candidates_for(first, leads_of(one), v("candidates"), v("sources")).select("candidate_id", "name", "confidence", "match_method", "vendor", "model")


_sql("vulnerability_samples", "SELECT l.candidate_id, s.name, l.confidence, l.match_method, c.vendor, c.model FROM leads l JOIN candidates c USING (candidate_id) JOIN sources s USING (source_id) WHERE l.identifier = (SELECT min(identifier) FROM leads)", "leads", "candidates", "sources")


@query
def route_identities(v):
    r = v("routes").select("part_id", F.concat(F.lit(" "), "value", F.lit("?a=1 ")).alias("raw"), "value")
    return r.select("part_id", I.interface_identity(F.col("raw")).alias("identity"), I.display_path(I.interface_identity(F.col("value"))).alias("shown"), I.endpoint_component(F.trim("raw")).alias("component"), I.normalized_identity(F.col("value")).alias("normal"))


_sql("route_identities", """SELECT part_id, regexp_replace(value || '?a=1', '^/+', '') AS identity, CASE WHEN starts_with(value, '/goform/') THEN value ELSE regexp_replace(value, '^/+', '') END AS shown, regexp_extract(value, '[^/]*$') AS component,
 array_to_string(regexp_extract_all(lower(value), '[a-z0-9]+'), ' ') AS normal FROM routes""", "routes")


@query
def redacted_texts(v):
    return v("model_texts").select("n", extraction.redact(F.col("text"), 200).alias("text"))


_sql("redacted_texts", r"""WITH t AS (SELECT n, substr(text, 1, 200) AS x FROM model_texts), w AS (SELECT *, string_split_regex(lower(x), '[^a-z0-9_]+') AS words FROM t),
 c AS (SELECT *, regexp_matches(lower(x), '(^|[^a-z0-9_])(password|passwd|pwd|secret|token|api[-_]?key|authorization|private[-_]?key) *[=:]') OR contains(x, '-----BEGIN ') OR regexp_matches(lower(x), '(^|[^a-z0-9_])bearer +[a-z0-9._~+/=-]') AS gives FROM w),
 p AS (SELECT n, gives, x, regexp_replace(regexp_replace(x, '\b[0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}\b', '<redacted:mac>', 'g'), '\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b', '<redacted:ipv4>', 'g') AS y FROM c)
SELECT n, CASE WHEN gives THEN '<redacted:credential>' ELSE array_to_string([CASE WHEN regexp_full_match(k, '[0-9A-Fa-f]{48,}') OR regexp_full_match(k, '[A-Za-z0-9_+/=-]{64,}') THEN '<redacted:opaque-token>' ELSE k END FOR k IN string_split(y, ' ')], ' ') END AS text FROM p""", "model_texts")


@query
def graph_query_facets(v):
    nodes, edges = graph.query_graph(v("nodes"), v("edges"), graph.GraphQuery(focus=("n3",), max_hops=1, max_nodes=None, max_edges=None, edge_kinds=("belongs_to", "declared_in")))
    return graph.facets(nodes, edges)


_sql("graph_query_facets", """WITH n AS (SELECT * FROM nodes WHERE node_id = 'n3' OR node_id IN (SELECT source_ref FROM edges WHERE target_ref = 'n3' AND edge_kind = 'belongs_to') OR node_id IN (SELECT target_ref FROM edges WHERE source_ref = 'n3' AND edge_kind = 'declared_in')),
 e AS (SELECT * FROM edges WHERE edge_kind IN ('belongs_to', 'declared_in') AND source_ref IN (SELECT node_id FROM n) AND target_ref IN (SELECT node_id FROM n))
SELECT 'node_kind' AS facet, node_kind AS value, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'edge_kind', edge_kind, count(*) FROM e GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM n GROUP BY ALL""", "nodes", "edges")


@query
def image_roots(v):
    n = F.col("s_suppkey")
    m = v("supplier").select(F.concat(F.lit("img"), n % 20).alias("image"), F.concat(F.lit("x/"), n, F.when(n % 3 == 0, "/squashfs-root").when(n % 3 == 1, "/rootfs").otherwise("/other")).alias("root"), (n % 4).cast("int").alias("markers"))
    return projection.root_candidates(m)


_sql("image_roots", """WITH m AS (SELECT 'img' || (s_suppkey % 20) AS image, 'x/' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '/squashfs-root' WHEN 1 THEN '/rootfs' ELSE '/other' END AS root, CAST(s_suppkey % 4 AS INT) AS markers, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS pref FROM supplier),
 r AS (SELECT *, rank() OVER (PARTITION BY image ORDER BY markers DESC, pref) AS place FROM m) SELECT image, root, markers, CASE WHEN count(*) OVER (PARTITION BY image) > 1 THEN 'ambiguous' ELSE 'selected' END AS status FROM r WHERE place = 1""")


@query
def evidence_replayed(v):
    docs = v("documents").where("text <> ''").groupBy("doc_id").agg(F.max("text").alias("text"))
    files = docs.select(F.col("doc_id").cast("string").alias("canonical_path"), F.encode("text", "UTF-8").alias("content")).withColumns({"content_sha256": F.sha2("content", 256), "size": F.length("content")})
    end = F.least(F.lit(9), F.octet_length("text") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).cast("long")
    claims = docs.select(
        F.col("doc_id").cast("string").alias("canonical_path"), F.lit(0).cast("long").alias("start_byte"), end.alias("end_byte"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise("s").alias("subject_ref"), F.lit("p").alias("predicate"), F.lit("").alias("object_value"),
        F.lit("derived").alias("observation_kind"), F.lit("route").alias("capability"), (F.col("doc_id") % 11 / 10).alias("confidence"), F.lit("me").alias("producer"), F.lit("1").alias("producer_version"),
    )
    captured = evidence.capture(claims, files)
    changed = files.withColumn("content", F.when(F.col("canonical_path").cast("long") % 3 == 0, F.encode(F.lit("new"), "UTF-8")).otherwise(F.col("content")))
    held = evidence.replay(captured.where("problem is null"), changed).groupBy("holds").agg(F.count("*").alias("n")).select(F.when(F.col("holds"), "holds").otherwise("lost").alias("what"), "n")
    return captured.where("problem is not null").groupBy(F.col("problem").alias("what")).agg(F.count("*").alias("n")).unionByName(held)


_sql("evidence_replayed", """WITH d AS (SELECT doc_id, max(text) AS text FROM documents WHERE text <> '' GROUP BY doc_id), c AS (SELECT *, CASE WHEN doc_id % 7 = 0 AND octet_length(encode(text)) < 9 THEN 'range' WHEN doc_id % 5 = 0 THEN 'empty_field' END AS problem FROM d)
SELECT problem AS what, count(*) AS n FROM c WHERE problem IS NOT NULL GROUP BY 1 UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN 'lost' ELSE 'holds' END, count(*) FROM c WHERE problem IS NULL GROUP BY 1""")


@query
def release_families(v):
    """Contexts spelled in other case, with other separators, of other products, or unknown."""
    n, part = F.col("c_custkey"), lambda a, b, c: F.struct(a.alias("vendor"), b.alias("product"), c.alias("device_model"))
    left = part(F.col("c_mktsegment"), F.when(n % 11 == 0, "").otherwise("R-1"), F.col("c_name"))
    right = part(F.when(n % 3 == 0, F.concat("c_mktsegment", F.lit("s"))).otherwise(F.lower("c_mktsegment")), F.when(n % 5 == 0, F.lit(None).cast("string")).when(n % 11 == 0, "").otherwise("r 1"), F.when(n % 4 == 0, F.upper("c_name")).when(n % 4 == 1, F.replace("c_name", F.lit("#"), F.lit("_"))).otherwise(F.col("c_name")))
    return v("customer").select("c_custkey", left.alias("left"), right.alias("right")).select("c_custkey", review.same_family("left", "right").alias("same"))


_sql("release_families", r"""WITH p AS (SELECT c_custkey, [c_mktsegment, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'R-1' END, c_name] AS l, [CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || 's' ELSE lower(c_mktsegment) END, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '' ELSE 'r 1' END, CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN replace(c_name, '#', '_') ELSE c_name END] AS r FROM customer),
 n AS (SELECT c_custkey, [trim(regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]+', ' ', 'g')) FOR x IN l] AS l, [trim(regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]+', ' ', 'g')) FOR x IN r] AS r FROM p)
SELECT c_custkey, l = r AS same FROM n""")


@query
def coverage_profiles(v):
    """Scopes of two snapshots: the second lacks some producers, and in it others have got further."""
    c = v("coverage").distinct()
    later = c.where("not (scope like 'c1%' and producer_kind = 'native')").withColumn("status", F.when(F.col("scope").like("c2%") & (F.col("producer_kind") == "config"), "completed").otherwise(F.col("status")))
    return history.coverage_confidence(c, later, ["scope"])


_sql("coverage_profiles", """WITH b AS (SELECT DISTINCT * FROM coverage), t AS (SELECT DISTINCT scope, producer_kind, CASE WHEN scope LIKE 'c2%' AND producer_kind = 'config' THEN 'completed' ELSE status END AS status, required FROM b WHERE NOT (scope LIKE 'c1%' AND producer_kind = 'native')),
 x AS (SELECT scope, count(*) AS n FROM (SELECT scope, producer_kind, status, required FROM b EXCEPT SELECT scope, producer_kind, status, required FROM t) GROUP BY scope), y AS (SELECT scope, count(*) AS n FROM (SELECT scope, producer_kind, status, required FROM t EXCEPT SELECT scope, producer_kind, status, required FROM b) GROUP BY scope),
 z AS (SELECT scope, count(*) FILTER (required AND status <> 'completed') AS incomplete FROM (SELECT scope, producer_kind, status, required FROM b UNION SELECT scope, producer_kind, status, required FROM t) GROUP BY scope)
SELECT scope, CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) > 0 THEN 'confounded' WHEN incomplete > 0 THEN 'equivalent_partial' ELSE 'equivalent' END AS confidence, coalesce(x.n, 0) AS base_only, coalesce(y.n, 0) AS target_only, incomplete FROM z LEFT JOIN x USING (scope) LEFT JOIN y USING (scope)""", "coverage")

_sql("budget_greedy", """WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place FROM l),
 w AS (SELECT l_orderkey, l_linenumber AS item, place, size <= 60 AS taken, CASE WHEN size <= 60 THEN size ELSE 0 END AS spent FROM o WHERE place = 1
  UNION ALL SELECT o.l_orderkey, o.l_linenumber, o.place, w.spent + o.size <= 60, CASE WHEN w.spent + o.size <= 60 THEN w.spent + o.size ELSE w.spent END FROM w JOIN o ON o.l_orderkey = w.l_orderkey AND o.place = w.place + 1)
SELECT l_orderkey, item, taken FROM w""")


# semantics of texts

@query
def texts_extracted(v):
    """Routes, parameters, method and effects that texts name: quoted, in brackets, of files, of tags, repeated."""
    rows = v("advisories").select(F.col("n").cast("string").alias("identifier"), "title", "description")
    r = extraction.extract_semantics(rows)
    first = F.get("interfaces", F.lit(0))
    return r.select(
        "identifier", F.array_join(F.transform("interfaces", lambda x: x["value"]), " ").alias("routes"), F.array_join(F.transform("parameters", lambda x: x["name"]), " ").alias("parameters"), first["method"].alias("method"), first["protocol"].alias("protocol"), first["component"].alias("component"), first["evidence"].alias("evidence"),
        "attack_type", "remotely_exploitable",
    )


def _listed(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


_sql("texts_extracted", rf"""WITH a AS (SELECT CAST(n AS VARCHAR) AS identifier, coalesce(description, '') AS d, concat_ws(chr(10), title, coalesce(description, '')) AS t FROM advisories),
 b AS (SELECT *, [CASE WHEN ends_with(trim(x, '`''"()[]{{}},;'), '/.') THEN trim(x, '`''"()[]{{}},;') ELSE rtrim(rtrim(trim(x, '`''"()[]{{}},;'), '.:!?'), '`''"()[]{{}},;') END FOR x IN list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')] AS w,
   [rtrim(rtrim(trim(x, '`''"()[]{{}},;'), '.:!?'), '`''"()[]{{}},;') FOR x IN list_filter(string_split_regex(d, '\s+'), lambda x: x <> '')] AS own,
   string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)) AS sentences, string_split(regexp_replace(d, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)) AS own_sentences FROM a),
 p AS (SELECT *, list_filter(w, lambda x, i: starts_with(x, '/') AND NOT ends_with(x, '>') AND NOT ends_with(x, '/.') AND length(x) > 1 AND list_position(w, x) = i AND NOT (list_contains({_listed(extraction.LOCAL_FOLDERS)}, '/' || lower(split_part(x, '/', 2)) || '/') AND len(string_split(x, '/')) > 2)) AS paths FROM b),
 r AS (SELECT *, list_filter(paths, lambda x: list_contains({_listed(extraction.ROUTE_FOLDERS)}, split_part(x, '/', 2)) OR starts_with(split_part(x, '/', 2), 'HNAP') OR len(list_filter(string_split(lower(x), '/'), lambda y: contains(y, '.') AND list_contains({_listed(extraction.PAGE_SUFFIXES)}, string_split(y, '.')[-1]))) > 0
   OR list_has_any(regexp_extract_all(lower(list_filter(sentences, lambda s: contains(s, x))[1]), '[a-z0-9]+'), {_listed(extraction.WEB_WORDS)})) AS routes FROM p),
 m AS (SELECT *, list_filter([CASE WHEN lower(x) = 'http' AND list_contains({_listed(extraction.METHODS)}, lower(w[i + 1])) THEN upper(w[i + 1]) END FOR x, i IN w], lambda x: x IS NOT NULL)[1] AS method,
   list_filter([CASE WHEN list_contains({_listed(extraction.PARAMETER_WORDS)}, lower(x)) THEN CASE WHEN lower(own[i + 1]) = 'named' THEN own[i + 2] ELSE own[i + 1] END END FOR x, i IN own], lambda x: x IS NOT NULL) AS names,
   list_has_any(regexp_extract_all(lower(t), '[a-z0-9]+'), ['http', 'cgi']) OR contains(lower(t), 'web interface') OR contains(lower(t), 'request handler') OR len(list_filter(routes, lambda x: list_contains({_listed(extraction.HTTP_FOLDERS)}, split_part(x, '/', 2)))) > 0 AS http FROM r),
 q AS (SELECT *, list_filter(names, lambda x, i: list_position(names, x) = i AND regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_.:-]*$') AND NOT list_contains({_listed(extraction.STOPWORDS)}, lower(x))) AS params FROM m)
SELECT identifier, array_to_string(routes, ' ') AS routes, array_to_string(params, ' ') AS parameters, CASE WHEN len(routes) > 0 THEN method END AS method, CASE WHEN len(routes) > 0 AND http THEN 'HTTP' END AS protocol,
 CASE WHEN len(routes) > 0 AND contains(lower(d), 'component ') THEN nullif(trim(string_split_regex(substr(d, strpos(lower(d), 'component ') + 10), '[.,;\n]')[1]), '') END AS component,
 CASE WHEN len(routes) > 0 THEN trim(coalesce(list_filter(own_sentences, lambda s: contains(s, routes[1]))[1], d)) END AS evidence,
 lower(coalesce(CASE WHEN contains(lower(d), 'leads to ') THEN nullif(trim(string_split_regex(substr(d, strpos(lower(d), 'leads to ') + 9), '[.;]')[1]), '') END, CASE WHEN contains(lower(d), 'lead to ') THEN nullif(trim(string_split_regex(substr(d, strpos(lower(d), 'lead to ') + 8), '[.;]')[1]), '') END)) AS attack_type,
 CASE WHEN len(list_filter(own_sentences, lambda s: list_has_any(regexp_extract_all(lower(s), '[a-z0-9]+'), {_listed(extraction.ATTACK_WORDS)}) AND list_contains(regexp_extract_all(lower(s), '[a-z0-9]+'), 'remotely'))) > 0 THEN true WHEN list_has_any(regexp_extract_all(lower(d), '[a-z0-9]+'), ['local', 'locally']) THEN false END AS remotely_exploitable FROM q""", "advisories")
