"""The engine's own operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import interfaces as I
from lodestrata.functions import models
from lodestrata.functions import versions as V
from lodestrata.operators import catalogue, correlation, exploration, graph, history, linking, merging, paging, relevance, review, search
from lodestrata.plans.views import view, view_over

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Callable) -> Callable:
    """Register ``f(v)``, where ``v(name)`` gives a table or view, under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(lambda name: view(spark, sf_dir, name))

    QUERIES[f.__name__] = run
    return f


def _vulns(v) -> DataFrame:
    return v("vulns").withColumn("cwes", F.split("cwe_list", ";")).withColumn("cpes", F.array("cpe")).withColumn("references", F.array("reference"))


@query
def category_profile(v):
    return exploration.category_profile(v("interface_obs"), v("vulns"))


@query
def category_top5(v):
    return exploration.top_interfaces(v("interface_obs"), 5)


@query
def subtype_rollup(v):
    return exploration.subtype_rollup(v("interface_obs"))


@query
def subtype_examples(v):
    return exploration.top_interfaces(v("interface_obs"), 3, "subtype")


@query
def route_styles(v):
    return exploration.styled(v("routes")).select("part_id", "value", "category", "subtype")


@query
def version_link_best(v):
    return linking.link_versions(v("candidates"), v("claims"))


@query
def version_link_counts(v):
    return linking.link_counts(linking.link_versions(v("candidates"), v("claims")))


@query
def version_link_uncurated(v):
    curated = v("leads").select("candidate_id").distinct().join(v("claims").select("identifier"), F.col("candidate_id") == F.concat(F.lit("fw:"), F.substring_index("identifier", "-", -1)))
    return linking.link_versions(v("candidates"), v("claims"), curated).select("candidate_id", "identifier", "match_method")


@query
def version_keys(v):
    c = v("candidates")
    return c.select("candidate_id", V.normalize_version(F.col("version")).alias("normalized"), V.meaningful_version(F.col("version")).alias("meaningful"), (V.version_key(F.col("version")) >= V.version_key(F.lit("2.10"))).alias("at_least_2_10"))


@query
def relevance_score(v):
    return relevance.classify(_vulns(v).drop("relevance_level")).select("identifier", "relevance_score", "relevance_level", F.array_join(F.transform("signals", lambda s: s["name"]), ",").alias("signals"))


@query
def relevance_levels(v):
    return exploration.level_counts(relevance.classify(_vulns(v).drop("relevance_level")))


@query
def relevance_reclassified(v):
    policy = relevance.Policy(firmware=("u-boot",), strong=60, likely=40, review=20)
    return exploration.level_counts(relevance.classify(_vulns(v).drop("relevance_level"), policy))


@query
def overview_counts(v):
    return exploration.overview(v("vulns"))


@query
def vendor_casefold_top(v):
    return exploration.top_vendors(v("vulns"))


@query
def severity_statistics(v):
    return exploration.severity_counts(v("vulns"))


@query
def year_histogram(v):
    return exploration.year_histogram(v("vulns"), 5)


@query
def cwe_top(v):
    vulns = _vulns(v)
    return exploration.top_cwes(vulns, exploration.cwe_bridge(vulns))


@query
def json_explode_distinct(v):
    return exploration.cwe_bridge(_vulns(v)).groupBy("cwe_id").agg(F.count("*").alias("n"))


@query
def vulnerability_page(v):
    found = exploration.list_vulnerabilities(_vulns(v), relevance="firmware", severity="high", query="rout_r", exploit_only=True, cwe="CWE-7")
    return paging.page(found, exploration.feed_order(), 50, 2).select("identifier", "title", "published_at")


@query
def vulnerability_envelope(v):
    return paging.page_envelope(exploration.list_vulnerabilities(v("vulns"), kev_only=True, vendor="VENDOR 3"), 20, 40)


@query
def keyset_page(v):
    return paging.after_key(v("vulns").where(exploration.is_related()), "identifier", "CVE-1996", 100).select("identifier")


@query
def candidate_listing(v):
    return catalogue.listing(v("candidates"), v("sources"), v("leads")).select("candidate_id", "source_name", "vulnerability_count", "exact_count", "best_method", F.md5(F.coalesce("identifiers", F.lit(""))).alias("identifiers_md5"))


@query
def candidate_page(v):
    return paging.page(catalogue.listing(v("candidates"), v("sources"), v("leads")), catalogue.candidate_order(), 40, 10).select("candidate_id", "vulnerability_count")


@query
def lead_semi_filter(v):
    return catalogue.with_lead(v("candidates"), v("leads").where("match_score > 40"), method="version").select("candidate_id")


@query
def lead_anti_filter(v):
    return catalogue.with_lead(v("candidates"), v("leads").where("match_score > 20"), method="exact_version", has_vulnerability=False).select("candidate_id")


@query
def lead_details(v):
    return catalogue.lead_details(v("leads"), v("vulns").where("kev")).groupBy("severity").agg(F.count("*").alias("n"))


@query
def source_fanout_counts(v):
    return catalogue.source_counts(v("sources"), v("candidates"), v("leads"))


@query
def catalogue_overview(v):
    return catalogue.catalogue_overview(v("candidates"), v("sources"), v("leads"))


@query
def download_hosts(v):
    return catalogue.host_counts(v("candidates"))


@query
def samples_of_vulnerability(v):
    top = v("vulns").agg(F.min("identifier").alias("identifier"))
    one = F.broadcast(v("vulns").join(F.broadcast(top), "identifier"))  # a row: it holds the key
    leads = view_over("leads", lineitem=v("lineitem"), vulns=one)  # the first vulnerability's samples
    return leads.join(v("candidates"), "candidate_id").select("candidate_id", "identifier", "confidence", catalogue.in_order("confidence", catalogue.CONFIDENCE_ORDER).alias("rank"))


@query
def parameter_fanout(v):
    return exploration.explore_parameters(v("parameter_obs"), v("interface_obs"))


@query
def interface_explore(v):
    return exploration.explore_interfaces(v("interface_obs"), v("vulns"), "/goform/Set")


@query
def model_groups(v):
    return exploration.model_groups(v("vulns"))


@query
def fts_phrase(v):
    return search.search(v("vulns"), "access_point u-boot", ("identifier", "title", "summary", "vendor", "product")).select("identifier")


@query
def fts_prefix(v):
    return search.search(v("vulns"), "firm mod", ("title", "summary", "vendor", "product"), prefix=True).select("identifier")


@query
def recommend_similar(v):
    return exploration.recommend_similar(v("interface_obs"), "/goform/SetAlmond_Blue")


@query
def correlate_exact(v):
    return correlation.correlate(v("frontend"), v("hints")).select("candidate_id", "hint_id", "match_basis")


@query
def correlate_unmatched(v):
    return correlation.uncorrelated(v("frontend"), v("hints")).select("candidate_id", "endpoint")


@query
def correlate_budget(v):
    return correlation.correlate(v("frontend"), v("hints"), 500)


@query
def set_difference(v):
    return correlation.set_difference(v("tokens"))


@query
def difference_attribution(v):
    one = correlation.set_difference(v("tokens"))
    n = F.substring("token", 4, 9).cast("int")
    kind = correlation.classify_difference(F.col("side"), n % 3 - 1, n % 5 - 3, n % 2, n % 7 > 2)
    return one.groupBy("side", kind.alias("kind")).agg(F.count("*").alias("n"))


@query
def token_containment(v):
    tokens = v("nation").select(F.lower("n_name").alias("token")).unionByName(v("documents").sparkSession.createDataFrame([("the",), ("of",), ("and",), ("der",)], "token string"))
    return correlation.token_hits(tokens, v("documents").withColumn("doc", F.col("doc_id").cast("string")), "doc", "text")


@query
def acl_pattern_join(v):
    return correlation.acl_grants(v("operations"), v("acl")).groupBy("acl_group").agg(F.count("*").alias("grants"))


@query
def operation_bindings(v):
    ops = v("operations")
    plugins = ops.where(F.col("operation_ref").endswith("3")).select("object_name", "method_name", F.concat(F.lit("p/"), F.col("operation_ref")).alias("path"))
    natives = ops.where(F.col("operation_ref").endswith("77")).select("object_name", "method_name", F.concat(F.lit("n/"), F.col("operation_ref")).alias("path"))
    return correlation.bind_operations(ops, plugins, natives).select("operation_ref", "binding_status", "binding_path")


@query
def latest_per_key(v):
    return paging.latest(v("catalogs"), ["firmware"], [F.desc("published_at"), F.desc("catalog_id")]).select("firmware", "catalog_id", "published_at")


@query
def hidden_interfaces(v):
    whole = paging.latest(v("catalogs"), ["firmware"], [F.desc("published_at"), F.desc("catalog_id")]).where("status = 'completed'")
    return whole.select("artifact", "firmware", F.explode(F.split("handlers", ";")).alias("handler")).groupBy("artifact").agg(F.countDistinct("firmware").alias("firmwares"), F.countDistinct("handler").alias("handlers"))


@query
def merge_upsert(v):
    e = v("events").select("event_id", F.concat_ws("/", F.col("user_id") % 500, "event_type").alias("identifier"), F.col("value").cast("decimal(18,2)").cast("string").alias("title"), F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.concat(F.lit("v"), F.col("event_id") % 7)).alias("vendor"), (F.col("event_id") % 11 == 0).alias("kev"), F.when(F.col("event_id") % 5 == 0, "cisa-kev").otherwise("nvd").alias("source"))
    return merging.merge_records(e, "event_id")


@query
def scd2_current(v):
    e = v("events").select(F.col("user_id"), "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("finished_at"))
    return merging.current_versions(e, ["user_id"], [F.desc("finished_at"), F.desc("event_id")]).where("is_current").select("user_id", "event_id", "finished_at")


@query
def graph_khop(v):
    seeds = v("nodes").where("node_id in ('n3', 'c7')").select("node_id")
    return graph.reach(seeds, v("edges"), 3)


@query
def graph_undirected_khop(v):
    seeds = v("nodes").where("node_id = 'o1'").select("node_id")
    return graph.reach(seeds, v("edges").where("edge_kind <> 'declared_in'"), 2, directed=False)


@query
def graph_query(v):
    nodes, _ = graph.query_graph(v("nodes"), v("edges"), graph.GraphQuery(focus=("n3",), max_hops=2, max_nodes=50, edge_kinds=("belongs_to", "calls")))
    return nodes.select("node_id", "distance", "status_of_query")


@query
def graph_text_query(v):
    nodes, edges = graph.query_graph(v("nodes"), v("edges"), graph.GraphQuery(text="supported handler 1", max_nodes=None, max_edges=None))
    return nodes.select("node_id", "distance")


@query
def graph_facets(v):
    return graph.facets(v("nodes"), v("edges"))


@query
def graph_dangling(v):
    return graph.dangling(v("nodes").where("node_kind <> 'component'"), v("edges"))


@query
def graph_tree(v):
    return graph.tree(v("nodes"), v("edges").where("edge_kind <> 'calls'"), "firmware")


@query
def snapshot_diff(v):
    return history.compare_entities(v("snap_base"), v("snap_target"), "identity", ("status", "members"))


@query
def snapshot_summary(v):
    return history.change_summary(history.compare_entities(v("snap_base"), v("snap_target"), "identity", ("status", "members")))


@query
def aligned_members(v):
    c = v("frontend").withColumn("alignment", I.normalized_identity(I.endpoint_component(F.col("endpoint"))))
    return history.merge_members(c, "alignment", ("endpoint", "endpoint_shape"))


@query
def hist_status(v):
    return history.compare_expectations(v("expectations"), v("observed"))


@query
def hist_bindings(v):
    o = v("observed").withColumn("canonical_identity", F.substring_index("canonical_identity", "/", -1))
    return history.compare_bindings(v("expectations"), o.where("candidate_kind = 'frontend_request'"), o.where("candidate_kind = 'native_hint'"))


def _audit(v) -> DataFrame:
    n = F.col("c_custkey")
    denominator = v("customer").select(F.concat(F.lit("CVE-H-"), n).alias("identifier"), (n % 5 != 0).alias("semantic_present"), (n % 3 - 1).alias("interfaces_raw"), (n % 2).cast("int").alias("parameters")).withColumn("interfaces", F.greatest(F.lit(0), F.col("interfaces_raw").cast("int"))).drop("interfaces_raw")
    return history.audit_partition(denominator, v("expectations").where("applicability = 'exact_artifact'"))


@query
def audit_partition(v):
    return _audit(v).groupBy("category").agg(F.count("*").alias("n"))


@query
def coverage_queue(v):
    n = F.col("c_custkey")
    clues = v("customer").where(n % 2 == 0).select(
        F.concat(F.lit("CVE-H-"), n).alias("identifier"), F.array(F.when(n % 8 == 0, "the").otherwise("ssid")).alias("parameters"), F.when(n % 6 == 0, F.array(F.lit("formSet"))).otherwise(F.array().cast("array<string>")).alias("handlers"),
        F.when(n % 14 == 0, F.array(F.lit("/goform/x"))).otherwise(F.array().cast("array<string>")).alias("interfaces"), F.when(n % 10 == 0, F.array(F.lit("a.b"))).otherwise(F.array().cast("array<string>")).alias("compound"),
    )
    return history.coverage_queue(_audit(v), clues)


@query
def coverage_ledger(v):
    overlay = history.compare_expectations(v("expectations"), v("observed")).withColumn("identifier", F.concat(F.lit("G"), F.substring_index("identifier", "-", -1).cast("int") % 211))
    return history.ledger(overlay, v("nation").select(F.concat(F.lit("Q"), F.col("n_nationkey")).alias("identifier")))


@query
def coverage_gate(v):
    return history.batch_coverage(v("coverage"))


@query
def required_coverage(v):
    scopes = v("customer").select(F.concat(F.lit("c"), F.col("c_custkey") - 1).alias("scope"), (F.col("c_custkey") % 2 == 0).alias("required"))
    expected = scopes.withColumn("producer_kind", F.explode(F.array(F.lit("frontend"), F.lit("native"), F.lit("script"))))
    return history.required_coverage(expected, v("coverage"))


@query
def corpus_gate(v):
    n = F.col("p_partkey")
    array = lambda *c: F.array_compact(F.array(*c))
    samples = v("part").select(
        F.concat(F.lit("s"), n).alias("sample_id"), F.col("p_brand").alias("category"), F.when(n % 4 == 0, "external_lead").when(n % 4 == 1, "real_firmware").when(n % 4 == 2, "derived_firmware").otherwise("contract").alias("evidence_tier"),
        array(F.lit("route"), F.when(n % 3 == 0, "handler")).alias("required"), array(F.when(n % 5 == 0, "acl")).alias("forbidden"),
        F.when(n % 4 != 0, array(F.lit("route"), F.when(n % 6 != 0, "handler"), F.when(n % 10 == 0, "acl"))).alias("observed"), (n % 7 == 0).cast("int").alias("open_obligations"), F.when(n % 11 == 0, "partial").otherwise("completed").alias("coverage_status"),
    )
    return history.category_results(history.sample_results(samples))


@query
def budget_prefix(v):
    lines = v("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("size"))
    return paging.prefix_budget(lines, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("size")], F.col("size"), 60).select("l_orderkey", "l_linenumber", "spent", "status")


@query
def budget_greedy(v):
    lines = v("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("size")).withColumn("item", F.col("l_linenumber"))
    return paging.greedy_budget(lines, "l_orderkey", "item", "l_linenumber", "size", 60)


@query
def interface_path_terms(v):
    return v("routes").select("part_id", F.array_join(F.array_sort(I.search_terms(I.endpoint_component(F.col("value")))), " ").alias("terms"), I.search_text(F.col("value")).alias("search_text"))


@query
def page_links(v):
    hrefs = v("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("value"))
    return exploration.styled(hrefs.withColumn("kind", F.lit("http_route")).withColumn("component", F.lit(""))).groupBy("category", "subtype").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


@query
def event_properties(v):
    return v("events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.countDistinct("k").alias("kinds"), F.max("k").alias("greatest"))


@query
def semantic_overview(v):
    return review.semantic_overview(v("vulns"), v("analyses"), v("interface_obs"), v("parameter_obs"))


@query
def top_parameters(v):
    return review.top_observed(v("parameter_obs"), v("analyses"), "name")


@query
def stage_results(v):
    n = F.col("c_custkey")
    results = v("customer").select(F.concat(F.lit("s"), F.col("c_nationkey") + 5).alias("stage"), F.when((F.col("c_nationkey") % 3 == 0) | (n % 7 != 0), "completed").otherwise("partial").alias("status"), F.when(n % 2 == 0, F.array(F.concat(F.lit("d"), n % 8))).otherwise(F.array().cast("array<string>")).alias("diagnostics"))
    return review.stage_results(v("nation").select(F.concat(F.lit("s"), "n_nationkey").alias("stage")), results)


@query
def proposal_reasons(v):
    proposals = v("proposals").withColumn("cited_evidence_ids", F.split("citations", ";"))
    runs = proposals.select("run_id").distinct()
    targets = runs.select("run_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.concat(F.lit("t"), i))).alias("target_ref"))
    evidence = runs.select("run_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.lit("e"), i))).alias("evidence_id"))
    judged = review.judge_proposals(proposals, targets, evidence, most=50_000)
    return judged.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("proposal_id").alias("ids"))


@query
def pivot_anchors(v):
    return review.pivot_anchors(v("part").select(F.concat(F.lit("g"), "p_partkey").alias("gate_id"), F.concat("p_name", F.lit(" Status-menu_"), "p_type").alias("ui_target_id"))).groupBy("feature_token").agg(F.count("*").alias("gates"))


@query
def url_selectors(v):
    found = v("pages").select("page_id", F.explode(models.url_selectors(F.col("url"))).alias("s"))
    return found.groupBy(F.col("s.name").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("s.value").alias("values"))
