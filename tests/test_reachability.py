"""Reachability, symbols and gates against searches in plain Python on random graphs."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestrata.operators import intervals, reachability, symbols

KINDS = [reachability.FRAMEWORK, reachability.EVENT, reachability.DIRECT]


def some_scripts(r, files, most):
    functions, sites, requests = [], [], []
    for p in range(files):
        n = r.randint(1, most)
        for i in range(n):
            a, inner = i * 20_000, r.random() < 0.4
            functions.append((f"p{p}", f"f{p}_{i}", r.choices([f"n{i}", f"n{r.randrange(most)}", None], [8, 1, 1])[0], a, a + 15_000))
            if inner:
                functions.append((f"p{p}", f"g{p}_{i}", r.choice([f"m{i}", None]), a + 5000, a + 5000 + r.randint(1, 9000)))
        place = lambda: r.randrange(n) * 20_000 + (r.randint(0, 14_999) if r.random() < 0.9 else r.randint(15_000, 20_000))  # noqa: E731, B023
        sites += [(f"p{p}", place(), r.choices([f"n{r.randrange(n)}", f"m{r.randrange(n)}", "?"], [12, 3, 1])[0], r.choices(KINDS, [1, 3, 40])[0]) for _ in range(2 * n)]
        requests += [(f"p{p}", f"r{p}_{k}", place()) for k in range(8)]
    return functions, sites, requests


def by_search(functions, sites, requests):
    by_path = defaultdict(list)
    for f in functions:
        by_path[f[0]].append(f)

    def owner(path, at):
        return min((f for f in by_path[path] if f[3] <= at < f[4]), key=lambda f: (f[4] - f[3], f[3]), default=None)

    reached = {}
    for path, mine in by_path.items():
        count = Counter(f[2] for f in mine if f[2])
        one = {f[2]: f[1] for f in mine if f[2] and count[f[2]] == 1}
        roots, calls = defaultdict(list), defaultdict(list)
        for p, at, name, construct in sites:
            if p == path and name in one:
                o = owner(path, at)
                rank = 0 if construct == KINDS[0] else (1 if construct == KINDS[1] else 2) if o is None else None
                if rank is None:
                    calls[o[1], one[name]].append((at, construct))
                else:
                    roots[one[name]].append((rank, (at, construct)))
        level = {f: (min(x)[0], (f,), (min(x)[1],)) for f, x in roots.items()}
        found = dict(level)
        while level:
            new = {}
            for (a, b), proofs in calls.items():
                if a in level and b not in found:
                    rank, way, proof = level[a]
                    new.setdefault(b, []).append((rank, (*way, b), (*proof, min(proofs))))
            level = {b: min(x) for b, x in new.items()}
            found |= level
        reached |= {(path, f): x for f, x in found.items()}
    out = {}
    for path, request, at in requests:
        o = owner(path, at)
        names = {f[1]: f[2] for f in by_path[path]}
        once = o is not None and o[2] is not None and sum(f[2] == o[2] for f in by_path[path]) == 1
        x = reached.get((path, o[1])) if o else None
        status = "top_level_declaration" if o is None else "active_call_path" if x else "declared_but_unreached" if once else "unresolved"
        kind = "top_level_declaration" if o is None else reachability.ROOT_KINDS[x[0]] if x else None
        out[request] = (status, kind, o[2] if o else None, [names[f] for f in x[1] if names[f]] if x else [], list(x[2]) if x else [])
    return out


def test_invocations_by_search(spark):
    functions, sites, requests = some_scripts(random.Random(7), 12, 14)
    f = spark.createDataFrame(functions, "path string, function_id string, display_name string, body_start long, body_end long")
    s = spark.createDataFrame(sites, "path string, at long, name string, construct string")
    q = spark.createDataFrame(requests, "path string, request_id string, at long")
    got = {r.request_id: (r.status, r.root_kind, r.owner, r.call_path, [tuple(p) for p in r.proofs]) for r in reachability.invocation_status(q, f, s).collect()}
    want = by_search(functions, sites, requests)
    assert got == want
    assert len({x[0] for x in want.values()}) == 4 and max(len(x[4]) for x in want.values()) > 2
    empty = reachability.invocation_status(q, f.limit(0), s)
    assert {r.status for r in empty.collect()} == {"top_level_declaration"}


def test_paths_have_no_greatest_depth(spark):
    n = 25
    calls = spark.range(n).select(F.lit("p").alias("path"), F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("caller"), F.concat(F.lit("f"), F.lpad((F.col("id") + 1).cast("string"), 3, "0")).alias("callee"), F.struct(F.col("id").alias("at"), F.lit("c").alias("construct")).alias("proof"))
    calls = calls.union(calls.limit(1).select("path", F.lit("f025").alias("caller"), F.lit("f000").alias("callee"), "proof"))  # a loop
    roots = spark.createDataFrame([("p", "f000", 2, (-1, "c"))], "path string, function_id string, root int, proof struct<at: long, construct: string>")
    out = {r.function_id: r for r in reachability.proof_paths(roots, calls).collect()}
    assert len(out) == n + 1 and out["f025"].distance == n and len(out["f025"].proofs) == n + 1


def test_events_within_reach(spark):
    r = random.Random(3)
    places = [("a", r.randrange(60_000)) for _ in range(60)] + [("b", 5)]
    events = [("a", r.randrange(60_000), f"v{k}") for k in range(25)]
    got = intervals.first_after(spark.createDataFrame(places, "path string, end long"), spark.createDataFrame(events, "path string, at long, value string"), "path", "end", "at", 1000).collect()
    assert Counter((x.path, x.end, x.at) for x in got) == Counter((p, e, min((a for q, a, _ in events if q == p and e <= a <= e + 1000), default=None)) for p, e in places)


def test_symbols_settle(spark):
    rows = [("a.js", "base", "/cgi"), ("b.js", "api", "{base}/api"), ("c.js", "get", "{api}/get?{mode}{"), ("c.js", "mode", "m{api}"), ("d.js", "twice", "x"), ("e.js", "twice", "x"), ("d.js", "both", "1"), ("e.js", "both", "2"), ("f.js", "loop", "{loop2}"), ("f.js", "loop2", "{loop}"), ("g.js", "lost", "{none}"), ("g.js", "over", "{twice}"), ("g.js", "empty", "")]
    found = symbols.resolve_symbols(spark.createDataFrame(rows, "path string, symbol string, template string"))
    got = {r.symbol: (r.status, r.value, r["round"]) for r in found.collect()}
    assert got == {
        "base": ("resolved", "/cgi", 0), "api": ("resolved", "/cgi/api", 1), "mode": ("resolved", "m/cgi/api", 2), "get": ("resolved", "/cgi/api/get?m/cgi/api{", 3), "twice": ("ambiguous", None, None), "both": ("conflict", None, None), "loop": ("open", None, None),
        "loop2": ("open", None, None), "lost": ("open", None, None), "over": ("open", None, None), "empty": ("resolved", "", 0),
    }
    users = spark.createDataFrame([("a.js", "base"), ("z.js", "base"), ("z.js", "base"), ("z.js", "both")], "path string, symbol string")
    assert [(r.symbol, r.value, r.consumer_path) for r in symbols.bind_consumers(users, found).collect()] == [("base", "/cgi", "z.js")]


def test_gates(spark):
    df = spark.createDataFrame
    macros = df([("m.js", "A", "1"), ("m.js", "B", "0"), ("m.js", "C", "1"), ("n.js", "C", "1"), ("m.js", "D", "1")], "path string, symbol string, value string")
    maps = df([("main.js", 100, x, x.lower()) for x in "ABCD"] + [("main.js", 9000, "A", "a")], "path string, end long, symbol string, target string")
    reveals = df([("main.js", 4196, "1"), ("main.js", 4197, "0"), ("main.js", 99, "0")], "path string, at long, enabled_value string")
    routes = df([("main.js", x, f"w/{x}.html") for x in "abcd"], "path string, target string, page string")
    scripts = df([("w/a.html", "js/a.js"), ("w/a.html", "js/other.js"), ("w/b.html", "js/b.js"), ("w/c.html", "js/c.js"), ("w/d.html", "js/d.js")], "page string, script string")
    requests = df([("js/a.js", "q2"), ("js/a.js", "q1"), ("js/b.js", "q3"), ("js/other.js", "q4"), ("js/c.js", "q5")], "path string, request_id string")
    got = {(r.symbol, r.status, tuple(r.requests)) for r in symbols.feature_gates(macros, maps, reveals, routes, scripts, requests).collect()}
    assert got == {("A", "enabled", ("q1", "q2")), ("B", "disabled", ("q3",))}  # C is defined twice, D asks for nothing
