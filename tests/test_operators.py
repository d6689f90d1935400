"""Operators on rows small enough to see what must come out."""

import zipfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import interfaces as I
from lodestrata.functions import versions as V
from lodestrata.operators import correlation, exploration, graph, history, linking, merging, paging, relevance, search, storage
from lodestrata.sources import feeds, inventory
from lodestrata.streaming import ingest


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "raw, normal",
    [("V1.06", "1.06"), ("firmware-2.0.zip", "2.0"), (" ver 3_1- ", "3_1"), ("n/a", "n/a"), ("1.0%20beta", "1.0 beta"), ("1\\.2", "1.2"), (None, "")],
)
def test_normalize_version(spark, raw, normal):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(V.normalize_version(F.col("v"))).first()[0] == normal


@pytest.mark.parametrize(
    "left, right, less",
    [("1.2", "1.10", True), ("1.0", "1.0.0", True), ("1.0.0", "1.0", False), ("1.9", "1.a", True), ("1.0b", "1.0b2", True), ("99999999999999999999", "100000000000000000000", True)],
)
def test_version_order(spark, left, right, less):
    df = spark.createDataFrame([(left, right)], "a string, b string")
    assert df.select(V.version_key(F.col("a")) < V.version_key(F.col("b"))).first()[0] is less


def test_candidate_versions_in_order_and_distinct(spark):
    df = spark.createDataFrame([("DIR850LA1_FW106KRb02.bin", "1.06KRb02"), ("fw_1.2.3_FW123.bin", "1.2.3"), ("x.bin", "unknown")], "f string, d string")
    rows = V.with_candidate_versions(df, F.col("f"), F.col("d")).select(F.transform("identities", lambda i: F.concat_ws("/", i["raw"], i["source"]))).collect()
    assert rows[0][0] == ["1.06KRb02/declared"]
    assert rows[1][0] == ["1.2.3/declared", "123/filename"]
    assert rows[2][0] == []


def test_linking_cascade(spark):
    candidates = spark.createDataFrame([("a", "D-Link", "DIR_850", "1.06"), ("b", "dlink", "DIR-850 router", "20190101"), ("c", "D-Link", "DIR850", None)], "candidate_id string, vendor string, product string, version string")
    claims = spark.createDataFrame(
        [("X1", "dlink", "dir-850_firmware", "1.06", None, None), ("X2", "dlink", "dir-850_firmware", "*", "1.0", "1.07"), ("X3", "dlink", "dir-850_firmware", "-", None, None), ("X2", "dlink", "dir-850_firmware", "*", None, None)],
        "identifier string, vendor string, product string, version string, version_start_including string, version_end_excluding string",
    )
    got = {(r.candidate_id, r.identifier): (r.match_method, r.match_score) for r in linking.link_versions(candidates, claims).collect()}
    assert got[("a", "X1")] == ("exact_version", 98) and ("b", "X1") not in got
    assert got[("a", "X2")] == ("version_range", 90)  # beats the unbounded claim
    assert got[("b", "X2")] == ("product_scope", 58)  # a single number is not in a dotted range
    assert got[("c", "X3")] == ("product_scope", 58)


def test_constraint_text(spark):
    df = spark.createDataFrame([("*", "1.0", None, None, "2.0"), ("1.5", None, None, None, None), ("*", None, None, None, None)], "v string, a string, b string, c string, d string")
    assert [r[0] for r in df.select(V.constraint_text(*(F.col(c) for c in "vabcd"))).collect()] == ["[1.0, 2.0)", "1.5", "all versions"]


@pytest.mark.parametrize(
    "value, kind, style, subtype",
    [
        ("/goform/SetWan", "", "form_handler", "goform_camel_registry"), ("/goform/set_wan", "", "form_handler", "goform_snake_registry"), ("/goform/WAN", "", "form_handler", "goform_symbol_registry"), ("/cgi-bin/cstecgi.cgi", "", "cgi_gateway", "shared_cgi_dispatcher"),
        ("/cgi-bin/a/b", "", "cgi_gateway", "nested_cgi_module"), ("/HNAP1/", "", "hnap_soap", "hnap_envelope_dispatcher"), ("/api/v1/x", "", "resource_api", "versioned_resource_router"), ("/a/b.jsp", "", "web_action", "servlet_page_controller"),
        ("tcp://80", "", "", ""), ("exec", "rpc", "rpc_command", "command_execution"), ("/login", "", "management_route", "flat_named_management_handler"), ("/boafrm/formX", "", "management_route", "boafrm_handler_registry"),
    ],
)
def test_styles(spark, value, kind, style, subtype):
    df = spark.createDataFrame([(value, kind)], "v string, k string").withColumn("s", I.interface_style(F.col("v"), F.col("k")))
    assert df.select("s", I.interface_subtype(F.col("v"), F.col("s"), F.col("k"))).first()[:] == (style, subtype)


def test_recommendation_scores(spark):
    obs = spark.createDataFrame([("X", v, "http_route", "") for v in ("/goform/SetWan", "/goform/SetWanMode", "/goform/GetWan", "/goform/Other", "/login")], "identifier string, value string, kind string, component string")
    got = {r.value: (r.tier, r.score) for r in exploration.recommend_similar(obs, "/goform/SetWan").collect()}
    # one of two terms: 80 + 6, then 10 for the folder and 5 for the depth while below 100
    assert got == {"/goform/SetWan": (0, 100), "/goform/SetWanMode": (1, 99), "/goform/GetWan": (2, 99), "/goform/Other": (3, 95)}


def test_relevance(spark):
    rows = [
        ("1", "Router bug", "A firmware update fails", "TP-Link", "x", ["cpe:2.3:h:v:p:*"], ["http://x/download/a"]), ("2", "", "a cloud service", "", "", [], []), ("3", "", "firmwares", "Cisco", "", [], []), ("4", "x", "software as a service gateway", "", "", [], []),
    ]
    df = spark.createDataFrame(rows, "identifier string, title string, summary string, vendor string, product string, cpes array<string>, references array<string>")
    got = {r.identifier: (r.relevance_score, r.relevance_level) for r in relevance.classify(df).collect()}
    assert got == {"1": (100, "strong"), "2": (0, "unrelated"), "3": (25, "unrelated"), "4": (0, "unrelated")}
    with pytest.raises(ValueError):
        relevance.Policy(strong=10, likely=50)


def test_search_phrases(spark):
    df = spark.createDataFrame([("1", "access-point of U-Boot"), ("2", "point access"), ("3", None)], "id string, t string")
    assert one(search.search(df, "access-point", ("t",)).select("id")) == [("1",)]
    assert one(search.search(df, "acc poi", ("t",), prefix=True).select("id").orderBy("id")) == [("1",), ("2",)]
    assert search.search(df, " ,; ", ("t",)).count() == 0


def test_correlation_rules(spark):
    frontend = spark.createDataFrame([("f1", "/goform/Set?x=1", "exact_literal"), ("f2", "/goform/Set", "literal_prefix"), ("f3", "/a/b", "exact_literal")], "candidate_id string, endpoint string, endpoint_shape string")
    hints = spark.createDataFrame([("h1", "route_token", "Set"), ("h2", "endpoint_literal", "/a/b"), ("h3", "route_token", "set")], "hint_id string, kind string, value string")
    got = correlation.correlate(frontend, hints)
    assert sorted(one(got.select("candidate_id", "hint_id", "match_basis"))) == [("f1", "h1", "route_token"), ("f3", "h2", "exact_endpoint")]
    assert one(correlation.unmatched(frontend, got).select("candidate_id")) == [("f2",)]
    limited = correlation.correlate(frontend, hints, 1).collect()
    assert [(r.candidate_id, r.status) for r in limited] == [("f1", "partial")]
    assert correlation.association_obligations(got).count() == 4


def test_tokens_are_bounded(spark):
    texts = spark.createDataFrame([("a", "foo food x_foo foo"), ("b", None)], "path string, content string")
    tokens = spark.createDataFrame([("foo",)], "token string")
    assert one(correlation.token_hits(tokens, texts, "path", "content")) == [("foo", "a", 2)]
    assert one(correlation.suffix_hits(tokens, texts, "path", "content")) == [("foo", "a", 1)]
    assert one(correlation.parameter_clues(spark.createDataFrame([("foo",)], "name string"), texts).select("name", "path", "hits")) == [("foo", "a", 2)]


def test_acl_globs(spark):
    ops = spark.createDataFrame([("o1", "net.wan", "get"), ("o2", "net", "set"), ("o3", "nett", "get")], "operation_ref string, object_name string, method_name string")
    acl = spark.createDataFrame([("g1", "net.*", "get"), ("g2", "net", "*"), ("g3", "ne??", "set")], "acl_group string, object_pattern string, method string")
    assert sorted(one(correlation.acl_grants(ops, acl))) == [("g1", "o1"), ("g2", "o2")]


def test_directed_reach(spark):
    edges = spark.createDataFrame([("1", "calls", "a", "shared"), ("2", "calls", "b", "shared"), ("3", "dispatches", "d", "a")], "edge_id string, edge_kind string, source_ref string, target_ref string")
    seeds = lambda n: spark.createDataFrame([(n,)], "node_id string")
    assert sorted(one(graph.reach(seeds("a"), edges, 1))) == [("a", 0), ("d", 1), ("shared", 1)]
    assert one(graph.reach(seeds("shared"), edges, 3)) == [("shared", 0)]
    assert {r[0] for r in graph.reach(seeds("shared"), edges, 3, directed=False).collect()} == {"a", "b", "d", "shared"}


def test_graph_focus_missing_leaves_text(spark):
    nodes = spark.createDataFrame([("a", "request", "login page", "supported"), ("b", "request", "other", "supported")], "node_id string, node_kind string, label string, status string")
    edges = spark.createDataFrame([], "edge_id string, edge_kind string, source_ref string, target_ref string")
    got, _ = graph.query_graph(nodes, edges, graph.GraphQuery(focus=("none",), text="login"))
    assert [r.node_id for r in got.collect()] == ["a"]
    with pytest.raises(ValueError):
        graph.GraphQuery(max_nodes=0)


def test_budgets(spark):
    rows = spark.createDataFrame([("k", i, i, s) for i, s in enumerate((5, 9, 3, 1))], "k string, at int, item int, size long")
    assert sorted((r.item, r.taken) for r in paging.greedy_budget(rows, "k", "item", "at", "size", 9).collect()) == [(0, True), (1, False), (2, True), (3, True)]
    kept = paging.prefix_budget(rows, ["k"], [F.col("at")], F.col("size"), 9).collect()
    assert [(r.item, r.status) for r in kept] == [(0, "partial")]


def test_snapshot_changes(spark):
    base = spark.createDataFrame([("a", 1, None), ("b", 1, "x"), ("c", 1, "x")], "id string, n int, s string")
    target = spark.createDataFrame([("a", 1, None), ("b", 2, "y"), ("d", 1, "x")], "id string, n int, s string")
    assert sorted(one(history.compare_entities(base, target, "id", ("n", "s")))) == [("b", "changed", "n,s"), ("c", "removed", ""), ("d", "added", "")]


def test_ledger_rejects_overlap(spark):
    overlay = spark.createDataFrame([("v1", "observed"), ("v1", "missing"), ("v2", "missing")], "identifier string, status string")
    queue = spark.createDataFrame([("v3",)], "identifier string")
    assert {r.identifier: r.status for r in history.ledger(overlay, queue).collect()} == {"v1": "partial", "v2": "missing", "v3": "queued"}
    with pytest.raises(Exception, match="overlap"):
        history.ledger(overlay, spark.createDataFrame([("v1",)], "identifier string")).collect()


def test_publication(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "catalog_id string, body string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("c", "1"), ("d", "1"), ("d", "2")], "catalog_id string, body string")
    got = sorted(set(one(storage.publish(old, new, "catalog_id").select("catalog_id", "outcome"))))
    assert got == [("a", "unchanged"), ("b", "conflict"), ("c", "created"), ("d", "conflict")]
    kept = storage.upsert(old.withColumn("created_at", F.lit("t0")), spark.createDataFrame([("a", "9", "t1"), ("z", "1", "t1")], "catalog_id string, body string, created_at string"), ["catalog_id"], ("created_at",))
    assert sorted(one(kept.select("catalog_id", "body", "created_at"))) == [("a", "9", "t0"), ("b", "1", "t0"), ("z", "1", "t1")]


def test_merge_is_the_fold(spark):
    rows = [(1, "v", "nvd", "t1", "", "n/a", False, ["a"]), (2, "v", "nvd", "t2", "s2", "Acme", False, ["b", "a"]), (3, "v", "cisa-kev", "t3", "s3", "-", True, ["c"]), (4, "v", "nvd", "t4", "s4", None, False, ["a"])]
    df = spark.createDataFrame(rows, "n int, identifier string, source string, title string, summary string, vendor string, kev boolean, aliases array<string>")
    r = merging.merge_records(df, "n").first()
    assert (r.title, r.summary, r.vendor, r.kev, r.sources, r.aliases) == ("t3", "s3", "Acme", True, "cisa-kev,nvd", ["a", "b", "c"])


def test_checked_union(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, n int")
    assert sorted(one(merging.checked_union(df, "id"))) == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="conflicting"):
        merging.checked_union(df.unionByName(spark.createDataFrame([("b", 3)], "id string, n int")), "id").collect()


def test_memo_key(spark):
    inputs = spark.createDataFrame([("v", "t", "s"), ("w", "t", "s")], "identifier string, title string, summary string")
    first = merging.to_compute(inputs, spark.createDataFrame([], "identifier string, input_sha256 string, fingerprint string"), "f1")
    done = first.where("identifier = 'v'").select("identifier", "input_sha256", "fingerprint")
    assert one(merging.to_compute(inputs, done, "f1").select("identifier")) == [("w",)]
    assert merging.to_compute(inputs, done, "f2").count() == 2


def test_feed_records(spark, tmp_path):
    import gzip
    import json

    cve = {
        "id": "CVE-2024-1", "published": "2024-01-01", "lastModified": "2024-01-02", "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": "First one. Second."}],
        "metrics": {"cvssMetricV31": [{"type": "Secondary", "cvssData": {"version": "3.1", "baseScore": 5.0}}, {"type": "Primary", "cvssData": {"version": "3.1", "baseScore": 9.8}}]}, "weaknesses": [{"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "en", "value": "NVD-CWE-noinfo"}]}],
        "configurations": [{"nodes": [{"cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:o:acme_co:r1_firmware:1.0:*:*:*:*:*:*:*"}]}]}], "references": [{"url": "http://a", "tags": ["Exploit"]}, {"url": "http://b"}],
    }
    with gzip.open(tmp_path / "f.json.gz", "wt") as f:
        json.dump({"resultsPerPage": 1, "vulnerabilities": [{"cve": cve}]}, f)
    r = feeds.normalize_cve(feeds.read_feed(spark, str(tmp_path / "f.json.gz"))).first()
    assert (r.identifier, r.summary, r.cvss_score, r.severity, r.cwes, r.vendor, r.product) == ("CVE-2024-1", "First one. Second.", 9.8, "CRITICAL", ["CWE-79", "NVD-CWE-noinfo"], "acme co", "r1 firmware")
    assert r.references == ["http://a", "http://b"] and r.exploit_references == ["http://a"] and r.title == "CVE-2024-1 · acme co r1 firmware"


def test_titles(spark):
    rows = [("A buffer overflow in foo.", None, None), ("line one\nline two. end", None, None), ("x", None, "P"), ("x", "V", None), (". rest", None, None), (None, "", ""), ("a" * 200 + ". b", None, None)]
    got = [r.t for r in spark.createDataFrame([("CVE-1", *r) for r in rows], "identifier string, summary string, vendor string, product string").select(feeds.summary_title().alias("t")).collect()]
    assert got == ["A buffer overflow in foo.", "line one\nline two", "CVE-1 ·  P", "CVE-1 · V", "CVE-1", "CVE-1", "a" * 120]


def test_nodes_that_lie_too_deep_are_told(spark):
    import json

    def nested(n):
        return {"cpeMatch": [{"criteria": f"cpe:2.3:o:v:p{n}:1"}], "children": [nested(n - 1)] if n else []}

    feed = spark.createDataFrame([(json.dumps({"id": f"CVE-{n}", "configurations": [{"vulnerable": True, "nodes": [nested(n)]}]}),) for n in (feeds.NODE_LEVELS, feeds.NODE_LEVELS + 1)], "j string").select(F.from_json("j", feeds.CVE_SCHEMA).alias("cve"))
    got = [(r.nodes_cut, len(r.affected_products), all(p.vulnerable for p in r.affected_products)) for r in feeds.normalize_cve(feed).collect()]
    assert got == [(False, feeds.NODE_LEVELS + 1, True), (True, feeds.NODE_LEVELS + 1, True)]


def test_terms_are_normalised_as_texts_are(spark):
    row = spark.createDataFrame([("i", "a smart device fails", "", None, None, [], [])], "identifier string, title string, summary string, vendor string, product string, cpes array<string>, references array<string>")
    s = relevance.classify(row, relevance.Policy.from_dict({"devices": [" ", "Smart%5Fdevice"], "other": 1})).first()
    assert (s.relevance_score, s.signals[0].term, s.signals[0]["name"]) == (25, "Smart%5Fdevice", "device-term") and "Smart%5Fdevice" in s.signals[0].reason


def test_trees_of_any_depth(spark):
    nodes = spark.range(23).select(F.col("id").cast("string").alias("node_id"), F.when(F.col("id") == 0, "root").otherwise("n").alias("node_kind"))
    edges = spark.range(1, 23).select(F.col("id").cast("string").alias("source_ref"), (F.col("id") - 1).cast("string").alias("target_ref"))
    assert max(r.level for r in graph.tree(nodes, edges, "root").collect()) == 22


def test_windows():
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert feeds.time_windows(start, start) == []
    assert feeds.time_windows(start, start + timedelta(hours=3), 2) == [("2024-01-01T00:00:00.000Z", "2024-01-01T02:00:00.000Z"), ("2024-01-01T02:00:00.000Z", "2024-01-01T03:00:00.000Z")]
    with pytest.raises(ValueError):
        feeds.time_windows(datetime(2024, 1, 1), start)
    now = datetime(2024, 2, 1, tzinfo=timezone.utc)
    assert ingest.sync_window(now, now - timedelta(days=1), 30)[0] == now - timedelta(days=1, minutes=5)
    assert ingest.sync_window(now, None, 500)[0] == now - timedelta(days=120)


def test_archive_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/ok.txt", "hello")
        z.writestr("../bad.txt", "no")
        z.writestr("late.txt", "y" * 100)
    (tmp_path / "plain.js").write_text("alert(1)")
    files = inventory.read_tree(spark, str(tmp_path))
    assert {r.canonical_path for r in files.collect()} == {"a.zip", "plain.js"}
    got = {r.member_path: (r.status, r.content) for r in inventory.archive_members(files, most_bytes=50).collect()}
    assert got == {"x/ok.txt": ("completed", bytearray(b"hello")), "../bad.txt": ("rejected", None), "late.txt": ("skipped", None)}
    assert ("plain.js", "frontend") in one(inventory.route_analyzers(files))


def test_links(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("l1", "l2"), ("l2", "l1"), ("m", "gone")], "source_path string, target_path string")
    files = spark.createDataFrame([("c",)], "canonical_path string")
    assert {r.source_path: r.status for r in inventory.resolve_links(links, files).collect()} == {"a": "resolved", "b": "resolved", "l1": "depth", "l2": "depth", "m": "missing"}


def test_stream_equals_batch(spark, tmp_path):
    import json

    schema = "arrived long, identifier string, source string, title string, summary string, vendor string, kev boolean"
    rows = [{"arrived": i, "identifier": f"v{i % 3}", "source": "cisa-kev" if i == 4 else "nvd", "title": f"t{i}", "summary": f"s{i}", "vendor": None if i % 2 else f"V{i}", "kev": i == 4} for i in range(9)]
    folder = tmp_path / "in"
    folder.mkdir()
    table = ingest.RecordTable(spark, str(tmp_path / "table"), schema)
    assert table.read().count() == 0
    for part in (rows[:4], rows[3:7], rows[6:]):  # overlapping deliveries
        (folder / f"{part[0]['arrived']}.json").write_text("\n".join(json.dumps(r) for r in part))
        q = ingest.ingest(spark, str(folder), schema, table, str(tmp_path / "check"))
        q.awaitTermination(120)
    batch = merging.merge_records(spark.createDataFrame([tuple(r.values()) for r in rows], schema), "arrived")
    assert sorted(map(str, ingest.merged(table).collect())) == sorted(map(str, batch.collect()))
    # a new checkpoint, which counts from 0 again, and a second stream lose nothing
    other = tmp_path / "other"
    other.mkdir()
    more = dict(rows[0], identifier="CVE-NEW", arrived=99)
    (other / "x.json").write_text(json.dumps(more))
    ingest.ingest(spark, str(other), schema, table, str(tmp_path / "check2")).awaitTermination(120)
    ingest.ingest(spark, str(folder), schema, table, str(tmp_path / "check3")).awaitTermination(120)
    assert sorted(r.identifier for r in ingest.merged(table).collect()) == sorted({r["identifier"] for r in rows} | {"CVE-NEW"})
