"""Graph projection and what is read off it."""

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import projection as P


@pytest.fixture(scope="module")
def catalogue(spark):
    candidates = spark.createDataFrame(
        [("c1", "request_interface", "goform/set", "candidate", "a.js", None, ["e1", "e2"]), ("c2", "native_handler", "set", "supported", "httpd", "c1", ["e2"]), ("c3", "mystery", "x", "candidate", "", "gone", [])],
        "candidate_id string, candidate_kind string, canonical_identity string, claim_status string, source_path string, target_ref string, evidence_ids array<string>",
    )
    parameters = spark.createDataFrame([("p1", "c1", "ssid", ["1", "2"]), ("p2", "nobody", "x", [])], "parameter_id string, owner_ref string, name string, selector_values array<string>")
    associations = spark.createDataFrame([("a1", "c1", "c2")], "association_id string, frontend_candidate_id string, native_hint_id string")
    obligations = spark.createDataFrame([("o1", "c1", "binds_handler", "open", 80), ("o2", "c9", "x", "open", 90)], "obligation_id string, target_ref string, required_capability string, status string, priority int")
    return candidates, parameters, associations, obligations


def test_projection_drops_and_reports_open_ends(spark, catalogue):
    nodes, edges, diagnostics = P.project_graph(*catalogue)
    assert {r.node_id: r.node_kind for r in nodes.collect()} == {"c1": "interface", "c2": "handler", "c3": "evidence_candidate", "artifact:a.js": "artifact", "artifact:httpd": "artifact", "p1": "parameter", "p2": "parameter", "o1": "obligation", "o2": "obligation"}
    got = {(r.edge_kind, r.source_ref, r.target_ref) for r in edges.collect()}
    assert got == {("declared_in_artifact", "c1", "artifact:a.js"), ("declared_in_artifact", "c2", "artifact:httpd"), ("has_parameter", "c1", "p1"), ("targets", "c2", "c1"), ("associated_with", "c1", "c2"), ("requires_evidence_for", "o1", "c1")}
    assert {r[0] for r in diagnostics.collect()} == {"unresolved_reference:has_parameter:p2", "unresolved_reference:targets:c3", "unresolved_reference:requires_evidence_for:o2"}
    again = P.project_graph(*(t.repartition(3) for t in catalogue))[1]
    assert {r.edge_id for r in again.collect()} == {r.edge_id for r in edges.collect()}
    matches = spark.createDataFrame([("v1", "c1"), ("v1", "c2"), ("v2", "zz")], "identifier string, candidate_id string")
    placed, between, unmapped = P.induced_overlay(matches, nodes, edges)
    assert placed.count() == 2 and between.count() == 2 and [r[0] for r in unmapped.collect()] == ["v2"]


def test_details_and_tree(spark, catalogue):
    candidates, parameters, associations, obligations = catalogue
    evidence = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "evidence_id string")
    assert {tuple(r) for r in P.candidate_detail("c1", candidates, parameters, associations, evidence).collect()} == {("parameter", "p1"), ("association", "a1"), ("related", "c2"), ("evidence", "e1"), ("evidence", "e2")}
    top, named = P.reasoning_request(obligations, candidates, 1, 2)
    assert [r.obligation_id for r in top.collect()] == ["o2"] and [r.candidate_id for r in named.collect()] == ["c1", "c2"]
    bindings = spark.createDataFrame([("/goform/set", "httpd")], "route string, component string")
    tree = {r.node: (r.parent, r.label, r.detail, r.children) for r in P.interface_tree(candidates.where("candidate_id = 'c1'"), bindings, parameters).collect()}
    assert tree == {"httpd": ("firmware", "httpd", "", 1), "c1": ("httpd", "/goform/set", "", 1), "c1#ssid": ("c1", "ssid", "integer", 0)}
    listing = P.catalogue_listing(spark.createDataFrame([("k",), ("m",)], "catalog_id string"), candidates.withColumn("catalog_id", F.lit("k")), spark.createDataFrame([("k", "acme")], "catalog_id string, vendor string"))
    assert {r.catalog_id: (r.candidates, r.vendor) for r in listing.collect()} == {"k": (3, "acme"), "m": (0, None)}


def test_closure_and_exports(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "c")], "caller string, callee string")
    anchors = spark.createDataFrame([("a",), ("x",)], "anchor string")
    assert {tuple(r) for r in P.call_closure(calls, anchors, 2).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("x", "x", 0), ("x", "c", 1), ("x", "a", 2), ("x", "d", 2)}
    uses = spark.createDataFrame([("m", "f"), ("m", "g"), ("m", "h"), ("m", "k")], "path string, name string")
    exports = spark.createDataFrame([("m", "f"), ("l1", "f"), ("l1", "g"), ("l1", "h"), ("l2", "h"), ("l3", "k")], "path string, name string")
    needed = spark.createDataFrame([("m", "l1"), ("m", "l2")], "path string, library string")
    assert {r.name: r.target_path for r in P.resolve_exports(uses, exports, needed).collect()} == {"f": "m", "g": "l1", "h": None, "k": None}
    roots = spark.createDataFrame([("i", "x/squashfs-root", 3), ("i", "x/rootfs", 3), ("j", "a", 2), ("j", "b", 2)], "image string, root string, markers int")
    assert {(r.root, r.status) for r in P.root_candidates(roots).collect()} == {("x/squashfs-root", "selected"), ("a", "ambiguous"), ("b", "ambiguous")}
