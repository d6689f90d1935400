"""Queries on tables that are larger, or have other keys, than the small ones: the whole job with the SQL's rows."""

import hashlib
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries and their SQL)

from lodestrata.operators import cases, catalogue, correlation, evidence, loading, projection, reachability, relevance
from lodestrata.plans.oracles import ORACLES
from lodestrata.plans.queries import QUERIES
from tests.oracle import TABLES, duck_rows, spark_rows


@pytest.fixture
def tables(sf_dir, tmp_path):
    """A folder of the small tables, but for those that a SELECT gives."""

    def make(**selects: str) -> str:
        for t in TABLES:
            if t in selects:
                duckdb.sql(f"COPY ({selects[t].format(t=f'{sf_dir}/{t}.parquet')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            else:
                os.symlink(f"{sf_dir}/{t}.parquet", f"{tmp_path}/{t}.parquet")
        return str(tmp_path)

    return make


def same(spark, name, folder):
    df = QUERIES[name](spark, folder)
    assert spark_rows(df) == duck_rows(ORACLES[name], folder, df.columns)


def test_lost_leads_have_no_candidate_whatever_the_keys(spark, tables):
    same(spark, "collection_failures", tables(part="SELECT * FROM '{t}' UNION ALL SELECT * REPLACE (p_partkey + 1000000 AS p_partkey) FROM '{t}'"))


def test_facets_count_the_whole_neighbourhood(spark, tables):
    same(spark, "graph_query_facets", tables(customer="SELECT c.* REPLACE (i AS c_custkey, 3 AS c_nationkey) FROM range(10500) r(i), (FROM '{t}' LIMIT 1) c"))


def test_text_finds_every_node(spark, tables):
    same(spark, "graph_text_query", tables(orders="SELECT o.* REPLACE (i AS o_orderkey) FROM range(260000) r(i), (FROM '{t}' LIMIT 1) o"))


def test_obligations_run_to_their_end_without_a_budget(spark):
    start = spark.createDataFrame([(f"o{i}", "route", "open", ["a"]) for i in range(6)], "obligation_id string, required_capability string, status string, candidate_analyzers array<string>")
    analyzers = {"a": ("route", lambda batch: (batch, batch.limit(0)))}
    assert evidence.run_obligations(start, analyzers, max_obligations=5)[1] == "budget_exhausted"
    done, end = evidence.run_obligations(start, analyzers, max_obligations=None)
    assert end == "fixed_point" and done.where("status = 'resolved'").count() == 6


def test_obligations_query_has_no_budget(spark, sf_dir, monkeypatch):
    run = evidence.run_obligations
    monkeypatch.setattr(evidence, "run_obligations", lambda *a, max_obligations=1_000_000, **k: run(*a, max_obligations=max_obligations and max_obligations // 1_000_000, **k))
    same(spark, "obligations_run", sf_dir)


def crowd(spark):
    """Thirty candidates that ask for one value, the first for three, and thirty hints, of which one gives two."""
    frontend = spark.createDataFrame([(f"f{i:02}", v, "exact_literal") for i in range(30) for v in (["/x/a", "/y/a", "/x/b"] if i == 0 else ["/x/a"])] + [("g", "/x/c", "exact_literal")], "candidate_id string, endpoint string, endpoint_shape string")
    hints = spark.createDataFrame([(f"h{i:02}", "route_token", v) for i in range(30) for v in (["a", "b"] if i == 3 else ["a"])] + [("h99", "endpoint_literal", "/y/a")], "hint_id string, kind string, value string")
    return frontend, hints, sorted({(f"f{i:02}", f"h{j:02}", "route_token") for i in range(30) for j in range(30)} | {("f00", "h99", "exact_endpoint")})


def test_pairs_of_one_value_go_to_slices(spark, monkeypatch):
    monkeypatch.setattr(correlation, "SLICE_PAIRS", 90)
    monkeypatch.setattr(correlation, "PART_PAIRS", 90)
    frontend, hints, every = crowd(spark)
    found = correlation.correlate(frontend, hints).select("candidate_id", "hint_id", "match_basis")
    assert sorted(map(tuple, found.collect())) == every
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < len(every) / 2


def test_candidates_without_hints_need_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(correlation, "_pairs", None)
    frontend, hints, _ = crowd(spark)
    assert [r.candidate_id for r in correlation.uncorrelated(frontend, hints).collect()] == ["g"]


@pytest.mark.parametrize("budget", [1, 31, 32, 40, 900, 901, 1000])
def test_first_pairs_need_no_others(spark, monkeypatch, budget):
    monkeypatch.setattr(correlation, "_pairs", None)
    frontend, hints, every = crowd(spark)
    found = correlation.correlate(frontend, hints, budget)
    assert sorted(map(tuple, found.select("candidate_id", "hint_id", "match_basis").collect())) == every[:budget]
    assert {r.status for r in found.collect()} == {"partial" if len(every) > budget else "completed"}


def test_unresolved_references_are_found_before_edges_get_ids(spark):
    rows = lambda values, schema: spark.createDataFrame(values, schema)
    candidates = rows([("c1", "native_hint", "x", "supported", "p", "c2"), ("c2", "native_hint", "y", "supported", "", "lost"), ("c2", "native_hint", "y", "supported", "", "lost")], "candidate_id string, candidate_kind string, canonical_identity string, claim_status string, source_path string, target_ref string")
    parameters = rows([("p1", "c1", "a"), ("p2", None, "b")], "parameter_id string, owner_ref string, name string")
    associations = rows([("a1", "lost", "gone")], "association_id string, frontend_candidate_id string, native_hint_id string")
    obligations = rows([("o1", "c1", "trace", "open")], "obligation_id string, target_ref string, required_capability string, status string")
    found = projection.project_graph(candidates, parameters, associations, obligations)[2]
    assert sorted(r[0] for r in found.collect()) == [f"unresolved_reference:{x}" for x in ("associated_with:a1", "has_parameter:p2", "targets:c2")]
    # one digest, of those that are reported, and no second reading of the edges
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and "LeftAnti" not in plan


def test_sources_are_counted_without_fan_out(spark):
    sources = spark.createDataFrame([("1", "a", "high"), ("1", "a", "high"), ("2", "b", "primary"), (None, "c", "low")], "source_id string, name string, trust_level string")
    candidates = spark.createDataFrame([("1", "x"), ("1", "y"), ("1", "x"), (None, "z")], "source_id string, candidate_id string")
    leads = spark.createDataFrame([("x", "v1"), ("x", "v1"), ("y", "v1"), ("y", "v2"), ("y", None), ("z", "v3")], "candidate_id string, identifier string")
    found = catalogue.source_counts(sources, candidates, leads)
    assert [tuple(r) for r in found.collect()] == [("2", "b", "primary", 0, 0), ("1", "a", "high", 2, 2), (None, "c", "low", 0, 0)]
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [1, 2, 3, 1000])
def test_the_least_identifier_with_a_lead(spark, few):
    vulns = spark.createDataFrame([("c", 3), ("b", 2), ("a", 1), ("a", 4), (None, 5)], "identifier string, vid long")
    leads = spark.createDataFrame([(3,), (2,), (2,), (5,), (9,)], "vid long")
    of = lambda leads: lambda some: leads.join(some, "vid")
    assert catalogue.least_with_lead(vulns, of(leads), few) == "b"
    assert catalogue.least_with_lead(vulns, of(leads.where("vid = 5")), few) is None


@pytest.mark.parametrize("name", ["vulnerability_samples", "samples_of_vulnerability"])
def test_samples_of_one_vulnerability_shuffle_no_leads(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [l_orderkey" in plan and "hashpartitioning(l_orderkey" not in plan
        assert spark_rows(df) == duck_rows(ORACLES[name], sf_dir, df.columns)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_filters_on_signals_do_not_search_the_texts_again(spark):
    rows = spark.range(3).select("id", *(F.concat(F.lit("router "), "id").alias(c) for c in ("title", "summary", "vendor", "product")), *(F.array(F.concat(F.lit("cpe:2.3:h:"), "id")).alias(c) for c in ("cpes", "references")))
    found = relevance.classify(rows, relevance.Policy(("firmware",), ("router",), ("one",), ("two",)))
    searches = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Contains(")
    # an inferred filter (the array has elements) and a given one
    assert 0 < searches(found.select("id", F.explode("signals"))) == searches(found.where("relevance_level = 'strong'")) == searches(found)


def test_documents_are_parsed_once(spark):
    rows = spark.range(3).select("id", F.concat(F.lit('{"n": '), "id", F.lit("}")).alias("body"))
    found = loading.judged(loading.parsed(rows, "body", "n int"), [loading.Rule("small", "n", F.col("n") < 2)])
    parses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("from_json")
    assert parses(found) == parses(found.select("id", F.explode("violations"))) == parses(found.where("size(violations) > 0")) == 1


def test_cases_are_replayed_once(spark, sf_dir, monkeypatch):
    calls, replay = [], cases.case_identities
    monkeypatch.setattr(cases, "case_identities", lambda c: calls.append(c) or replay(c))
    same(spark, "case_corpus_issues", sf_dir)
    assert len(calls) == 1


def test_sites_meet_functions_once_for_roots_and_calls(spark):
    functions = spark.createDataFrame([("p", "f1", "a", 0, 100), ("p", "f2", "b", 200, 300)], "path string, function_id string, display_name string, body_start long, body_end long")
    sites = spark.createDataFrame([("p", 10, "b", reachability.DIRECT), ("p", 150, "a", reachability.DIRECT)], "path string, at long, name string, construct string")
    roots, calls = reachability.call_graph(functions, sites)
    assert [(r.function_id, r.root) for r in roots.collect()] == [("f1", 2)] and [(r.caller, r.callee) for r in calls.collect()] == [("f1", "f2")]
    assert not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in (roots, calls))


def odd_cases(spark):
    """A case with an id, an order and references twice or null, a stage without one of its lists, and one without parts."""
    rows = lambda values, schema: spark.createDataFrame(values, schema)
    return cases.Cases(
        rows([("k", "t\n", "", None, ["p"], []), ("z", None, "", ["x"], ["p"], ["l"])], "case_key string, title string, case_id string, counterfactuals array<string>, paper_uses array<string>, limitations array<string>"),
        rows([("k", "e1", "a"), ("k", "e1", "b"), ("k", None, "a"), (None, "e2", "a")], "case_key string, evidence_ref string, kind string"),
        rows([("k", "c1", "é", ["e1", "e1", "e2", None]), ("k", "c1", None, None), ("k", None, "n", ["e1"])], "case_key string, claim_id string, statement string, evidence_refs array<string>"),
        rows([("k", "s1", 1, ["c1"], ["o1"], None, ["o9"]), ("k", "s1", 2, ["c9"], [], ["o1", "o1"], None), ("k", None, 2, None, None, ["o1"], [])], "case_key string, stage_id string, `order` int, claim_ids array<string>, creates array<string>, resolves array<string>, rejects array<string>"),
        rows([("k", "o1", "resolved", ["e1"]), ("k", "o2", None, [None])], "case_key string, obligation_id string, status string, closure_refs array<string>"),
    )


def test_identities_are_digests_from_the_leaves_up(spark):
    digest = lambda *own: hashlib.sha256(json.dumps({f"p{i}": x for i, x in enumerate(own)}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    both = sorted([digest("k", "e1", "a"), digest("k", "e1", "b")])
    evidence = [*both, digest("k", None, "a")]
    claims, obligations = [digest("c1", "é", both), digest("c1", None, both)], [digest("o1", "resolved", both), digest("o2", None, [])]
    of_s1 = sorted(claims), obligations[:1], obligations[:1], []
    parts = evidence, [*claims, digest(None, "n", None)], [digest("s1", 1, *of_s1), digest("s1", 2, *of_s1), digest(None, 2, [], [], [], [])], obligations
    want = {"k": digest("k", "t\n", None, ["p"], [], *map(sorted, parts)), "z": digest("z", None, ["x"], ["p"], ["l"], [], [], [], [])}
    found = cases.case_identities(odd_cases(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {r.case_key: r.replayed_id for r in found.collect()} == {k: f"research-case:{x}" for k, x in want.items()}
    # rows are shuffled once, by their case, and what is shuffled holds no digests
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.index("sha2(") < plan.index("Exchange")


def test_issues_of_odd_cases(spark):
    found = cases.case_issues(odd_cases(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([
        ("k", "evidence_repeated", "e1"), ("k", "claim_repeated", "c1"), ("k", "stage_repeated", "s1"), ("k", "order_repeated", "2"), ("k", "claim_evidence_unknown", "e2"), ("k", "claim_evidence_unknown", None), ("k", "closure_evidence_unknown", None),
        ("k", "stage_claim_unknown", "c9"), ("k", "stage_rejects_unknown", "o9"), ("k", "closed_before_created", "o9"), ("k", "never_created", "o2"),
    ], key=repr)
    assert plan.count("Exchange") <= 2 and "Join" not in plan
