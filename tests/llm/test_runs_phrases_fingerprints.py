"""Periodic runs, collocations and fingerprints against brute force, on awkward rows too."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import collocations, fingerprints, periodic_runs
from tests.llm.test_operators import CLASH, ROWS, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows for these three: pieces, tabs, control characters, echoes of one word, other scripts.
MORE = [
    (20, "A b. a B\ta b; a\x1cb", None, "a"), (21, "la " * 40 + "end", "en", "a"), (22, "x y z " * 30 + "x y", "und", None), (23, "ÄÖ äö É é " * 12, "de", "b"), (24, "語" * 90, "ja", "b"), (25, "one", "", "c"),
    (26, " ".join("p q r s t u v".split() * 6 + "p q r".split()) + "\n" + "A B. " * 30, "en", "b"), (-30, "minus thirty goes on and on " * 9, "en", "b"), *((100 + n, " ".join(f"{a} {a}" for a in "abcdefgh" * 5), "en", "a") for n in range(12)),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, x, g, s, len(x or ""), *("clash" for _ in CLASH)) for i, x, g, s in [*ROWS, *MORE]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def runs_by_definition(w, least, periods):
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(least, periods * q) and not any(a <= s and s + n <= a + b for a, b, _ in out):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_by_definition():
    r, seen = random.Random(5), 0
    for _ in range(1500):
        letters = r.choice([1, 2, 2, 3, 5])
        w = [b"%d" % r.randrange(letters) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            at, block = r.randint(0, len(w)), [b"%d" % r.randrange(letters) for _ in range(r.randint(1, 9))]
            w[at:at] = (block * 20)[: r.randint(1, 6 * len(block))]
        for least, periods in ((24, 3), (6, 2), (4, 3)):
            want = runs_by_definition(w, least, periods)
            seen += len(want)
            assert periodic_runs.runs_of(w, least, periods) == want
    assert seen > 5000


def test_extensions_do_not_trust_hashes(monkeypatch):
    """With hashes that are all equal, the words decide."""
    monkeypatch.setattr(periodic_runs, "_BASE", 0)
    monkeypatch.setattr(periodic_runs, "_POWERS", [1])
    r = random.Random(2)
    for _ in range(200):
        ids = [r.randrange(2) for _ in range(60)]
        ids[59] = 7  # sums that end alike
        e = periodic_runs.Extensions(ids)
        e.sums = [0] * 61
        for _ in range(30):
            i, j = sorted(r.sample(range(59), 2))
            assert e.forward(i, j) == next(k for k in range(61) if j + k == 60 or ids[i + k] != ids[j + k])
            assert e.backward(i, j) == next(k for k in range(61) if k > i or ids[i - k] != ids[j - k])


def test_runs_of_rows(rows, none):
    out = periodic_runs.with_runs(rows).collect()
    assert len(out) == rows.count()
    for r in out:
        w = WORD.findall(r.text or "")
        assert r.periodic.n_words == len(w) and {r[c] for c in CLASH} == {"clash"}
        if len(w) > 5000:
            continue
        runs = runs_by_definition(w, 24, 3)
        assert [tuple(x) for x in r.periodic.runs] == runs
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert r.periodic.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic_runs.with_runs(none).count() == 0 and periodic_runs.describe_runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.with_runs(none.withColumn("periodic", F.lit(1)))


def echoed(doc_id, w):
    import zlib

    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_run_query_by_definition(spark, rows):
    many = rows.where("length(text) < 4000 or text is null").select("doc_id", "text").union(spark.createDataFrame([(n, " ".join(f"w{k * n % 17}" for k in range(n))) for n in range(150, 400)], "doc_id long, text string"))
    got = periodic_runs.describe_runs(periodic_runs.with_echoes(many)).collect()
    want = []
    for doc_id, text in many.collect():
        w = echoed(doc_id, WORD.findall(text or ""))
        runs = runs_by_definition(w, 24, 3)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(r.n_runs > 0 for r in got) > 20


def phrases_by_definition(table, deepest=3, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in table:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            for k in range(1, deepest + 1):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {}
        for x, a in counts.items():
            if len(x) > 1 and a >= least:
                score, k = min((1000000 * a * a // (counts[x[:k]] * counts[x[k:]]), k) for k in range(1, len(x)))
                found[x] = (score, a, counts[x[:k]], counts[x[k:]])
        inside = lambda x, y: len(x) < len(y) and any(y[i : i + len(x)] == x for i in range(len(y)))
        kept = [x for x in found if not any(inside(x, y) and 100 * found[y][1] >= share * found[x][1] for y in found)]
        kept.sort(key=lambda x: (-found[x][0], -found[x][1], " ".join(x).encode()))
        out += [(lang, r, " ".join(x), *found[x][1:], n[lang], found[x][0]) for r, x in enumerate(kept[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("deepest,least,share,top", [(3, 10, 50, 2000), (4, 2, 60, 15), (2, 3, 50, 5)])
def test_collocations_by_definition(rows, deepest, least, share, top):
    some = rows.where("doc_id is null or doc_id <> 4")
    got = sorted(map(tuple, collocations.collocations(some.repartition(9, "doc_id"), deepest, least, share, top).collect()))  # many shards
    want = phrases_by_definition([(r.lang, r.text) for r in some.collect()], deepest, least, share, top)
    assert got == want and len(got) > 5


def test_no_collocations(none):
    assert collocations.collocations(none).count() == 0


def test_blocks_count_every_run_once(monkeypatch):
    """Blocks of any size give the counts of one block."""
    r = random.Random(3)
    texts = pa.array([" ".join(r.choice(["a", "b", "c.", "d"]) for _ in range(r.randint(0, 90))) for _ in range(20)] + [None, ""], pa.large_string())
    langs = pa.array(["x", "y"] * 11)
    counts = []
    for size in (1 << 20, 64, 7, 1):
        monkeypatch.setattr(collocations, "BLOCK_WORDS", size)
        for deepest in (1, 2, 3, 5):
            all_of, by_state = Counter(), Counter()
            for block in collocations._blocks(*collocations._coded(langs), texts, deepest):
                a = collocations.Automaton(block.words, block.left, deepest, block.begin)
                for d in range(deepest):
                    all_of.update(dict(Counter({int(h): int(c) for h, c in zip(a.hashes(d, block.hashes), a.count[d])})))
                for d, states, shortest in a.states():
                    for s, k in zip(states.tolist(), shortest.tolist()):
                        at = a.first[d][s]
                        for words in range(k, d + 2):
                            by_state[tuple(block.hashes[at + d + 1 - words : at + d + 1].tolist())] += int(a.count[d][s])
            assert sorted(by_state.values()) == sorted(c for c in all_of.values() if c)
            counts.append((deepest, sorted(c for c in all_of.values() if c)))
    assert all(x == y for x in counts for y in counts if x[0] == y[0])


def long_hash(values):
    h = 42
    for v in values:
        h = xxhash.xxh64(v if isinstance(v, bytes) else int(v).to_bytes(8, "little", signed=True), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def winnowed(text, gram, window):
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,8}", (text or "").lower())
    h = [long_hash([t.encode()]) for t in tokens]
    g = [long_hash(h[i : i + gram]) for i in range(max(1, len(h) - gram + 1))] if h else []
    places = []
    for i in range(max(1, len(g) - window + 1)) if g else []:
        some = g[i : i + window]
        p = i + max(k for k, x in enumerate(some) if x == min(some))
        if p not in places:
            places.append(p)
    return [(g[p], p) for p in places]


@pytest.mark.parametrize("gram,window", [(5, 6), (3, 4), (1, 1)])
def test_winnowing_by_definition(rows, none, gram, window):
    some = rows.where("doc_id is null or doc_id <> 4")
    for r in fingerprints.with_fingerprints(some, "prints", gram, window).collect():
        assert [tuple(x) for x in r.prints] == winnowed(r.text, gram, window)
    assert fingerprints.with_fingerprints(none, "prints").count() == 0
    with pytest.raises(ValueError):
        fingerprints.with_fingerprints(none, "TEXT")


def test_shared_runs_share_a_hash():
    r = random.Random(8)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    need = fingerprints.GRAM + fingerprints.WINDOW - 1
    for _ in range(200):
        shared = words(need)
        a, b = (" ".join(words(r.randint(0, 30)) + shared + words(r.randint(0, 30))) for _ in range(2))
        assert {h for h, _ in winnowed(a, 5, 6)} & {h for h, _ in winnowed(b, 5, 6)}


def test_fingerprints_of_edits(spark, rows, none):
    got = fingerprints.compare_with_next(rows)
    assert fingerprints.compare_with_next(none).count() == 0
    texts = {(r.doc_id, r.text) for r in rows.collect()}  # equal rows are one document
    digests = {(r.doc_id, r.text): (r.a, r.b) for r in rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(7), F.col("doc_id"), F.col("text")).alias("b")).collect()}
    order = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), digests[x]))
    edit = lambda x, y: (x := x or "")[: len(x) - len(x) // 3] + (y or "")[: len(x) // 3]
    want = Counter()
    for x, y in zip(order, [*order[1:], order[0]]):
        want[(x[0], len(x[1] or ""), hashlib.sha256(edit(x[1], y[1]).encode()).hexdigest(), y[0])] += sum((r.doc_id, r.text) == x for r in rows.select("doc_id", "text").collect())
    out = got.collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.next_doc_id) for r in out) == want

    def like(x, y):
        p, q = ({h for h, _ in winnowed(t, fingerprints.GRAM, fingerprints.WINDOW)} for t in (x, y))
        return len(p & q) / len(p | q) if p | q else 1.0

    by_id = {r.doc_id: r for r in out}
    for x, y in zip(order, [*order[1:], order[0]]):
        if x[0] not in (None, 4, 8) and y[0] != 4:
            assert by_id[x[0]].near_next == pytest.approx(like(x[1], y[1])) and by_id[x[0]].near_edited == pytest.approx(like(x[1], edit(x[1], y[1])))
    same = defaultdict(set)
    for (doc_id, text) in texts:
        if doc_id not in (None, 8):
            same[text or ""].add(by_id[doc_id].fingerprint)
    assert all(len(s) == 1 for s in same.values())
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    alone = fingerprints.compare_with_next(one).collect()[0]
    assert alone.next_doc_id == 1 and alone.near_next == 1.0


def test_likeness_of_empty_sets(spark):
    long = "array<bigint>"
    r = spark.range(1).select(*(fingerprints.likeness(F.lit(a).cast(long) if a else F.array().cast(long), F.lit(b).cast(long) if b else F.array().cast(long)).alias(n) for n, a, b in (("both", [], []), ("one", [1], []), ("half", [1, 2], [2, 3])))).first()
    assert (r.both, r.one, r.half) == (1.0, 0.0, pytest.approx(1 / 3))


def test_next_of_many_parts(spark):
    """Places run on over the parts of the sort."""
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(13)
    got = {r.doc_id: r.next_doc_id for r in fingerprints.compare_with_next(df).collect()}
    assert got == {n: (n - 1) % 1000 for n in range(1000)}


def test_counts_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", "", 9 * big), ("en", "a", 2 * big + 1), ("en", "b", 3 * big), ("en", "a b", big)], "lang string, phrase string, n long")
    r = collocations.scored_phrases(counts).first()
    assert r.score == 1000000 * big * big // ((2 * big + 1) * 3 * big) and np.int64(r.score) == r.score
