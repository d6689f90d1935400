"""What is let in of models' and analysers' output, and names of devices, on small rows."""

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import models
from lodestrata.operators import review


def test_device_models(spark):
    rows = [
        ("D-Link", "D-Link DIR 815 Firmware", "DIR 815 flaw", "", ["cpe:2.3:o:dlink:dir_815_firmware:1.0\\(a\\):x", "cpe:2.3:o:dlink:dir_815_firmware:1.0\\(a\\):x"]), ("n/a", None, None, None, ["cpe:2.3:o:tp-link:archer_ax50_firmware:*:x"]), (None, "", "", "", None),
        ("Acme", "Box", "", "", ["cpe:2.3:o:acme:other_thing:2:x"]),
    ]
    df = spark.createDataFrame(rows, "vendor string, product string, title string, summary string, cpes array<string>")
    got = [r[0].asDict() for r in df.select(models.firmware_model(*(F.col(c) for c in df.columns))).collect()]
    assert [(g["vendor"], g["model"], g["source"], g["alignment"], g["version_summary"]) for g in got] == [
        ("D-Link", "DIR 815", "description", "aligned", "1.0(a)"), ("TP-Link", "Archer AX50", "cpe", "cpe_fallback", models.NO_VERSION), (models.NO_VENDOR_LABEL, models.NO_MODEL, "cpe", "cpe_fallback", models.NO_VERSION), ("Acme", "Box", "description", "description_primary", "2"),
    ]
    assert got[0]["key"] == "d-link dir 815" and got[0]["label"] == "D-Link DIR 815 固件"


def test_small_functions(spark):
    one = spark.createDataFrame([("/up?cmd=go&x/y&=1&z=&p", "lib/net.so", "net-a", 3, 9)], "url string, path string, name string, a int, b int")
    r = one.select(models.url_selectors(F.col("url")).alias("s"), models.plausible_object(F.col("path"), F.col("name")).alias("p"), models.plausible_object(F.col("path"), F.lit("netx")).alias("q"), models.span_locator(F.col("a"), F.col("b")).alias("l"), models.title_case(F.lit("tp-link ax")).alias("t")).first()
    assert [tuple(x) for x in r.s] == [("cmd", "go"), ("x", "y")] and r.p and not r.q and r.l == "binary:bytes=3-9" and r.t == "Tp-Link Ax"


def test_model_rows_are_bounded(spark):
    rows = [(0, " /a ", " ", None, 0.0), (1, " ", "GET", "x", 0.4), (2, "/b", " POST ", "y", 1.7), (3, "/c", None, "z", -1.0)]
    df = spark.createDataFrame(rows, "place int, value string, method string, evidence string, confidence double")
    got = review.clean_model_rows(df, "value", {"value": 3, "method": 2, "evidence": 5}, ("method",), most=3).collect()
    assert [(r.value, r.method, r.evidence, r.confidence, r.source) for r in got] == [(" /a", None, "", 0.5, "llm"), ("/b", "PO", "y", 0.9, "llm")]


def test_outcomes_views_and_jobs(spark):
    out = spark.createDataFrame([("o1", 1, False, ["b"]), ("o1", 0, True, ["a", "b"]), ("o2", 0, False, [])], "obligation_id string, place int, resolved boolean, evidence_ids array<string>")
    assert {(r.obligation_id, r.resolved, tuple(r.evidence_ids)) for r in review.combine_outcomes(out).collect()} == {("o1", True, ("a", "b")), ("o2", False, ())}
    schema = "canonical_path string, route_token string, handler_address long, producer string, evidence_ids array<string>"
    inventory, better = spark.createDataFrame([("p", "r", 1, "x", ["e"]), ("p", "s", 2, "x", ["f"])], schema), spark.createDataFrame([("p", "r", 1, "x", ["g"])], schema)
    assert {(r.route_token, r.anchored, tuple(r.evidence_ids)) for r in review.binding_view(inventory, better).collect()} == {("r", True, ("g",)), ("s", False, ("f",))}
    with pytest.raises(Exception, match="two producers"):
        review.binding_view(inventory, better.withColumn("producer", F.lit("y"))).collect()
    jobs = spark.createDataFrame([("a", "running", None), ("b", "done", None)], "job string, status string, error string")
    assert {tuple(r) for r in review.fail_interrupted(jobs).collect()} == {("a", "failed", "interrupted"), ("b", "done", None)}
    context = "struct<vendor: string, product: string, device_model: string>"
    pairs = spark.createDataFrame([((("A-B", "P", "m 1")), ("a b", "p", "M-1")), (("A", "P", "m"), None)], f"l {context}, r {context}")
    assert [r[0] for r in pairs.select(review.same_family("l", "r")).collect()] == [True, False]
