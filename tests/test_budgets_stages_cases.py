"""Budgets in one order, stages in layers, research cases and validated loads against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import budgets, cases, loading, stages


@pytest.mark.parametrize("seed", range(4))
def test_budgets_in_order(spark, seed):
    r = random.Random(seed)
    rows = [(f"k{i:04d}", r.choice([1, 2, 5, 40, 300, None]), r.choice([0, 1, 1, 9])) for i in range(400)]
    limits = {"bytes": r.choice([0, 500, 9000, 10**9]), "count": r.choice([3, 200, 10**6])}
    left, want = [limits["bytes"], limits["count"]], {}
    for k, a, b in rows:
        refused = budgets.take(left, [a or 0, b])
        want[k] = None if refused is None else ["bytes", "count"][refused]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(r.sample(rows, len(rows)), "k string, a long, b int")
        out = budgets.within_budgets(df, [F.col("k")], {"bytes": ("a", limits["bytes"]), "count": ("b", limits["count"])})
        assert out.columns == ["k", "a", "b", "refused_by"] and {x.k: x.refused_by for x in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert budgets.within_budgets(df.limit(0), [F.col("k")], {"bytes": ("a", 1)}).count() == 0


def inventory_by_walk(files, links, most_files, most_file, most_bytes):
    out, count, spent, seen = {}, 0, 0, {}
    for path, size, inode, link in sorted([(*f, None) for f in files] + [(p, s, None, st) for p, s, st in links], key=lambda x: x[0]):
        if count >= most_files:
            out[path] = "file_count"
        elif link is not None:
            out[path], count = link, count + 1
        elif inode is not None and inode in seen:
            out[path], count = "hardlink", count + 1
        elif size > most_file:
            out[path] = "file_size"
        elif spent + size > most_bytes:
            out[path] = "total_bytes"
        else:
            out[path], count, spent = "completed", count + 1, spent + size
            if inode is not None:
                seen[inode] = path
    return out


@pytest.mark.parametrize("limits", [(1000, 50, 10**6), (40, 50, 700), (60, 100, 300), (1000, 100, 900)])
def test_inventory_by_walk(spark, limits):
    r = random.Random(limits[0])
    sizes = {i: r.randint(0, 80) for i in range(9)}
    files = [(f"d{r.randrange(5)}/f{i:03d}", *((sizes[n], n) if r.random() < 0.4 else (r.randint(0, 80), None))) for i in range(90) for n in [r.randrange(9)]]
    links = [(f"d{r.randrange(5)}/l{i}", 4, r.choice(["resolved", "missing"])) for i in range(12)]
    got = budgets.inventory_entries(spark.createDataFrame(files, "canonical_path string, size long, inode long"), spark.createDataFrame(links, "canonical_path string, size long, status string"), *limits).collect()
    want = inventory_by_walk(files, links, *limits)
    assert {x.canonical_path: x.status for x in got} == want
    assert len(set(want.values())) > 3


def layers_by_search(table, needs):
    known, out = set(table), {}
    todo = True
    while todo:
        todo = [s for s in known - set(out) if all(n in out for n in needs[s] if n in known)]
        for s in todo:
            own = [n for n in needs[s] if n in known]
            outcome, enabled = table[s]
            unknown = min((n for n in needs[s] if n not in known), default=None)
            bad = min((out[n][2] for n in own if out[n][2]), default=None)
            layer = 1 + max((out[n][0] for n in own), default=-1)
            if unknown:
                out[s] = (layer, "missing", unknown)
            elif not enabled:
                out[s] = (layer, "skipped", s)
            elif bad:
                out[s] = (layer, "skipped", bad)
            else:
                out[s] = (layer, outcome, None if outcome in stages.GOOD else s)
    stuck = known - set(out)
    for s in stuck:
        seen, front = set(), {s}
        while front:
            front = {n for x in front for n in needs[x] if n in stuck} - seen
            seen |= front
        out[s] = (None, "cycle" if s in seen else "blocked", None)
    return out


def test_stages_by_search(spark):
    r, table, need, want = random.Random(11), [], [], {}
    for run in range(25):
        n = r.randint(1, 9)
        own = {f"s{i}": (r.choice(["completed", "completed", "partial", "failed"]), r.random() < 0.9) for i in range(n)}
        needs = {s: {f"s{r.randrange(n if r.random() < 0.15 else max(1, int(s[1:])))}" for _ in range(r.randint(0, 2))} - ({s} if r.random() < 0.9 else set()) for s in own}
        if r.random() < 0.2:
            needs["s0"] = {"nowhere"}
        table += [(run, s, o, e) for s, (o, e) in own.items()]
        need += [(run, s, x) for s, xs in needs.items() for x in xs]
        want |= {(run, s): x for s, x in layers_by_search(own, needs).items()}
    got = stages.run_order(spark.createDataFrame(table, "run_id int, stage string, outcome string, enabled boolean"), spark.createDataFrame(need, "run_id int, stage string, needs string")).collect()
    assert {(x.run_id, x.stage): (x.layer, x.status, x.cause) for x in got} == want
    assert {"cycle", "blocked", "missing", "skipped", "failed", "completed"} <= {x[1] for x in want.values()}


def a_case(key, **changes):
    rows = {
        "cases": [{"case_key": key, "title": "t", "case_id": "", "counterfactuals": ["x"], "paper_uses": ["p"], "limitations": ["l"]}],
        "evidence": [{"case_key": key, "evidence_ref": "e1", "kind": "static", "sha256": "1"}, {"case_key": key, "evidence_ref": "e2", "kind": "dynamic", "sha256": "2"}],
        "claims": [{"case_key": key, "claim_id": "c1", "statement": "holds", "evidence_refs": ["e1", "e2"]}],
        "stages": [{"case_key": key, "stage_id": "s1", "order": 1, "claim_ids": [], "creates": ["o1", "o2"], "resolves": [], "rejects": []}, {"case_key": key, "stage_id": "s2", "order": 2, "claim_ids": ["c1"], "creates": [], "resolves": ["o1"], "rejects": []}],
        "obligations": [{"case_key": key, "obligation_id": "o1", "status": "resolved", "closure_refs": ["e2"]}, {"case_key": key, "obligation_id": "o2", "status": "open", "closure_refs": []}],
    }
    for path, value in changes.items():
        table, n, field = path.split("__")
        rows[table][int(n)][field] = value
    return rows


SCHEMAS = {
    "cases": "case_key string, title string, case_id string, counterfactuals array<string>, paper_uses array<string>, limitations array<string>", "evidence": "case_key string, evidence_ref string, kind string, sha256 string", "claims": "case_key string, claim_id string, statement string, evidence_refs array<string>",
    "stages": "case_key string, stage_id string, `order` int, claim_ids array<string>, creates array<string>, resolves array<string>, rejects array<string>", "obligations": "case_key string, obligation_id string, status string, closure_refs array<string>",
}

BROKEN = {
    "evidence__1__evidence_ref": ("e1", {"evidence_repeated", "claim_evidence_unknown", "closure_evidence_unknown"}), "claims__0__evidence_refs": (["e9"], {"claim_evidence_unknown"}), "stages__1__stage_id": ("s1", {"stage_repeated"}), "stages__1__order": (1, {"order_repeated", "closed_before_created"}),
    "obligations__0__closure_refs": (["e9"], {"closure_evidence_unknown"}), "stages__1__claim_ids": (["c9"], {"stage_claim_unknown"}), "stages__0__creates": (["o1"], {"never_created"}), "stages__0__resolves": (["o1"], {"closed_before_created", "closed_twice"}), "stages__1__resolves": ([], {"resolved_by_no_stage"}),
    "obligations__0__status": ("rejected", {"rejected_by_no_stage", "rejected_but_resolved"}), "obligations__1__status": ("rejected", {"rejected_by_no_stage"}), "stages__1__rejects": (["o2"], {"open_but_closed"}), "evidence__1__kind": ("static", {"fewer_than_two_kinds_of_evidence"}), "cases__0__limitations": ([], {"limitations_missing"}),
    "cases__0__paper_uses": (None, {"paper_uses_missing"}), "stages__1__creates": (["o9"], {"stage_creates_unknown"}),
}


def test_cases(spark):
    built = {"good": a_case("good"), **{path: a_case(path, **{path: value}) for path, (value, _) in BROKEN.items()}}
    of = lambda name, ids=None: spark.createDataFrame([tuple({**r, "case_id": ids[r["case_key"]]}.values() if ids and name == "cases" else r.values()) for c in built.values() for r in c[name]], SCHEMAS[name])
    table = lambda ids=None: cases.Cases(*(of(n, ids) for n in ("cases", "evidence", "claims", "stages", "obligations")))
    ids = {r.case_key: r.replayed_id for r in cases.case_identities(table()).collect()}
    assert len(set(ids.values())) == len(built)  # every change shows
    found = {}
    for r in cases.corpus_issues(table(ids)).collect():
        found.setdefault(r.case_key, set()).add(r.rule)
    assert found == {path: rules for path, (_, rules) in BROKEN.items()}
    wrong = {r.case_key for r in cases.corpus_issues(table({k: "old" for k in ids})).collect() if r.rule == "identity_does_not_replay"}
    assert wrong == set(built)


def test_loads(spark, tmp_path):
    lines = ['{"id": "a", "n": 1, "tags": ["x"]}', '{"id": "b", "n": -1, "tags": []}', "no json", '{"id": null, "n": 2, "tags": ["x"]}', '{"id": "a", "n": 3, "tags": ["y"]}', '{"id": "c", "n": "many", "tags": ["x"]}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    rows = loading.read_documents(spark, f"{tmp_path}/in", "id string, n int, tags array<string>")
    rules = [loading.Rule("positive", "n", F.col("n") > 0), loading.Rule("named", "id", F.col("id") != ""), loading.Rule("tagged", "tags", F.size("tags") > 0)]
    got = sorted((str(r.id), r.rule) for r in loading.violations(rows, rules, "id").collect())
    assert got == [("None", "named"), ("None", "readable"), ("a", "repeated"), ("b", "positive"), ("b", "tagged"), ("c", "readable")]
    with pytest.raises(loading.Refused) as e:
        loading.load(rows, rules, f"{tmp_path}/out")
    assert e.value.counts == {"readable": 2, "positive": 1, "named": 1, "tagged": 1} and not (tmp_path / "out").exists()
    assert spark.read.parquet(f"{tmp_path}/out-refused").count() == 4
    good = rows.where("id = 'a'")
    assert loading.load(good, rules, f"{tmp_path}/out")["rows"] == 2 and spark.read.parquet(f"{tmp_path}/out").columns == ["id", "n", "tags", "file"]
    texts = spark.createDataFrame([(1, '{"n": 4}'), (2, "{"), (3, None)], "k int, body string")
    assert [r.rule for r in loading.violations(loading.parsed(texts, "body", "n int"), [loading.Rule("n", "n", F.col("n") > 0)], "k").orderBy("k").collect()] == ["readable", "n"]
