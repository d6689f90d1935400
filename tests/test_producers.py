"""Table functions, extraction, evidence and obligations on small contents."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import extraction
from lodestrata.operators import evidence
from lodestrata.sources import producers


def files(spark, *pairs):
    return spark.createDataFrame([(p, bytearray(c if isinstance(c, bytes) else c.encode())) for p, c in pairs], "canonical_path string, content binary")


def test_forms_and_calls(spark):
    page = '<p>é<form action="/goform/x" method=post><input name=a><input></form><form><input name=b></form><form action="/open"><input name=c>'
    r = producers.html_forms(files(spark, ("a.html", page), ("b.html", b"\xff\xfe"))).collect()
    form = next(x for x in r if x.status == "completed")
    assert form.value == "/goform/x" and json.loads(form.detail) == {"encoding": "application/x-www-form-urlencoded", "method": "POST", "parameters": ["a"], "role": "write"}
    assert page.encode()[form.start_byte : form.end_byte].startswith(b"<form action") and [x.status for x in r if x.canonical_path == "b.html"] == ["failed"]
    script = '// $.post("/no")\n$.post("/goform/y", "cmd=go&v=1"); $.getJSON("/api/z" + id); rpc.declare({object: "net", method: "up", params: ["if"]}); rpc.declare({object: o})'
    got = {x.source_construct: (x.value, json.loads(x.detail)) for x in producers.javascript_requests(files(spark, ("a.js", script))).collect()}
    assert got["jquery.post"] == ("/goform/y", {"method": "POST", "parameters": ["cmd", "v"], "selectors": {"cmd": "go"}})
    assert got["jquery.getJSON"][1]["shape"] == "literal_prefix" and got["luci.rpc.declare"] == ("ubus://net/up", {"method": "POST", "parameters": ["if"]})


def test_object_style_requests(spark):
    script = """$.ajax({url: "/api/x", type: 'post', contentType: "application/json; x", data: {cmd: "go", v: f(1, {a: 2}), "w": 3}, success: function (d) { var q = {url: "no"}; }});
A.request({url: '/r', method: "get"}); A.request({url: u}); $.GetSetData.setData("/goform/s" + n, {a: 1, b: "2"}); $.ajax({type: "get"}); $.ajax({"""
    got = [(x.source_construct, x.value, json.loads(x.detail)) for x in producers.javascript_requests(files(spark, ("a.js", script))).collect()]
    assert got == [
        ("jquery.ajax", "/api/x", {"method": "POST", "parameters": ["cmd", "v", "w"], "representation": "json", "selectors": {"cmd": "go"}}), ("custom.request", "/r", {"method": "GET", "parameters": [], "representation": None, "selectors": {}}),
        ("custom.GetSetData.setData", "/goform/s", {"method": "POST", "parameters": ["a", "b"], "shape": "literal_prefix"}),
    ]


def test_web_configurations(spark):
    light = 'server.port = 80 # no\nserver.document-root = "/www"\n$HTTP["url"] =~ "^/cgi-bin/" {\n cgi.assign = ( "" => "" )\n}\ncgi.assign = ()\n'
    got = [(x.kind, x.value, x.namespace) for x in producers.lighttpd(files(spark, ("lighttpd.conf", light))).collect()]
    assert got == [("listener", "80", None), ("document_root", "/www", "/"), ("namespace_mapping", "cgi", "/cgi-bin/")]
    nginx = 'server { listen 8080; root "/w"; # x\n location /a { internal; alias /b; } location /p { proxy_pass http://h; auth_basic "x"; auth_basic_user_file /u; } }'
    rows = [(x.kind, x.value, x.detail, x.namespace) for x in producers.nginx(files(spark, ("nginx.conf", nginx))).collect()]
    assert rows == [("listener", "8080", None, None), ("document_root", "/w", None, None), ("namespace_mapping", "/b", "internal_alias", "/a"), ("namespace_mapping", "http://h", "reverse_proxy", "/p"), ("authentication", "basic", "/u", "/p")]
    uci = "config uhttpd main\n\tlist listen_http '0.0.0.0:80'\n\toption home /www\n\toption cgi_prefix /cgi-bin\n\tlist lua_prefix '/luci=/h.lua'\n"
    rows = [(x.kind, x.value, x.namespace) for x in producers.uhttpd(files(spark, ("uhttpd", uci))).collect()]
    assert rows == [("listener", "0.0.0.0:80", None), ("document_root", "/www", "/"), ("namespace_mapping", "cgi", "/cgi-bin"), ("namespace_mapping", "/h.lua", "/luci")]


def test_scripts_strings_fields(spark):
    php = "<?php // $_GET['no']\n echo $_POST['name']; include 'x.php';"
    assert [(x.kind, x.value) for x in producers.scripts(files(spark, ("a.php", php), ("b", "#!/bin/sh\n# nvram get no\nnvram get wan_ip\n"))).collect()] == [("parameter", "name"), ("include", "x.php"), ("state", "wan_ip")]
    doc = json.dumps({"a/b": [{"c~": None}, {"c~": True}], "n": 1})
    assert sorted((x.value, x.detail, x.namespace) for x in producers.response_fields(files(spark, ("r.json", doc))).collect()) == [("a/b", "array", "/a~1b"), ("c~", "boolean", "/a~1b/*/c~0"), ("c~", "null", "/a~1b/*/c~0"), ("n", "number", "/n")]
    hints = producers.native_hints(producers.printable_strings(files(spark, ("x", b"\x7fELF\0/goform/x\0formSet\0ab\0" + b"lighttpd/1.4 !\0"))))
    assert sorted((x.value, x.kind) for x in hints.collect()) == [("/goform/x", "endpoint_literal"), ("formSet", "route_token"), ("lighttpd/1.4 !", "server_hint")]
    defs = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "1"), ("c", "1"), ("c", "2")], "symbol string, value string")
    assert {x.symbol: (x.value, x.status) for x in producers.symbol_table(defs).collect()} == {"a": ("1", "resolved"), "b": (None, "ambiguous"), "c": (None, "conflict")}


def test_semantics(spark):
    texts = [
        ("1", "X", "The manipulation of the argument ssid of the file /goform/setWifi leads to stack overflow. The attack may be launched remotely."), ("2", "", "An HTTP GET request to /status with parameter named id."), ("3", "", "See https://example.com/a/b and </div> in /etc/passwd of the web."),
        ("4", "", "The tool reads /data/file. Local users only. The parameter of the function."), ("5", None, None),
    ]
    got = {r.identifier: r for r in extraction.extract_semantics(spark.createDataFrame(texts, "identifier string, title string, description string")).collect()}
    assert [i.value for i in got["1"].interfaces] == ["/goform/setWifi"] and got["1"].interfaces[0].confidence == 0.96 and [p.name for p in got["1"].parameters] == ["ssid"] and got["1"].attack_type == "stack overflow" and got["1"].remotely_exploitable is True
    assert [i.value for i in got["2"].interfaces] == ["/status"] and got["2"].interfaces[0].method == "GET" and got["2"].parameters[0].location == "query"
    assert not got["3"].interfaces and not got["4"].interfaces and got["4"].remotely_exploitable is False and not got["4"].parameters and not got["5"].interfaces
    df = spark.createDataFrame([("password: hunter2 at 10.0.0.1 aa:bb:cc:dd:ee:ff",)], "t string")
    assert df.select(extraction.redact(F.col("t"), 100)).first()[0] == "<redacted:credential>"
    hidden = spark.createDataFrame([(f"at 10.0.0.1 00:11:22:33:44:55 id {'ab' * 24} {'x' * 63} {'Z9' * 32}",), ("x" * 20 + " pwd = 1",)], "t string")
    assert [r[0] for r in hidden.select(extraction.redact(F.col("t"))).collect()] == [f"at <redacted:ipv4> <redacted:mac> id <redacted:opaque-token> {'x' * 63} <redacted:opaque-token>", "<redacted:credential>"]
    assert hidden.select(extraction.redact(F.col("t"), 20)).collect()[1][0] == "x" * 20


def test_evidence(spark):
    f = files(spark, ("a.js", "one\ntwo /goform/x three")).withColumn("content_sha256", F.sha2("content", 256)).withColumn("size", F.length("content"))
    claim = lambda *x: ("a.js", *x)
    rows = [claim(8, 17, "c1", "has", "/goform/x", "direct_static", "route", 0.9, "p", "1"), claim(0, 3, "c1", "has", "/goform/x", "direct_static", "route", 0.9, "p", "1"), claim(5, 5, "c1", "has", "x", "derived", "route", 0.9, "p", "1"), claim(0, 3, " ", "has", "x", "derived", "route", 0.9, "p", "1")]
    claims = spark.createDataFrame(rows, "canonical_path string, start_byte long, end_byte long, subject_ref string, predicate string, object_value string, observation_kind string, capability string, confidence double, producer string, producer_version string")
    got = evidence.capture(claims, f)
    assert [(r.problem, r.start_line, r.start_column) for r in got.collect()][:2] == [(None, 2, 5), ("object_not_in_span", 1, 1)]
    assert sorted(r.problem or "" for r in got.collect()) == ["", "empty_field", "object_not_in_span", "range"]
    kept = got.where("problem is null")
    assert [r.holds for r in evidence.replay(kept, f).collect()] == [True]
    changed = files(spark, ("a.js", "one\ntwo /goform/y three"))
    assert [r.holds for r in evidence.replay(kept, changed).collect()] == [False]


def test_obligations_reach_a_fixed_point(spark):
    schema = "obligation_id string, target_ref string, required_capability string, priority int, candidate_analyzers array<string>, status string"
    start = spark.createDataFrame([("o1", "t", "route", 90, ["a", "b"], "open"), ("o2", "t", "other", 10, ["a"], "open"), ("o1", "t", "route", 90, ["a", "b"], "open")], schema)

    def unable(batch):
        return batch.limit(0), batch.limit(0)

    def able(batch):
        made = batch.where("obligation_id = 'o1'").withColumn("obligation_id", F.lit("o3"))
        return batch, made

    now, how = evidence.run_obligations(start, {"a": ("route", unable), "b": ("route", able)})
    assert how == "fixed_point" and {r.obligation_id: r.status for r in now.collect()} == {"o1": "resolved", "o2": "open", "o3": "resolved"}
    with pytest.raises(Exception, match="conflicting"):
        evidence.normalize_obligations(start.unionByName(start.withColumn("priority", F.lit(1)))).collect()
