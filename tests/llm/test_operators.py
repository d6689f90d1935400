"""The corpus operators on awkward rows: nulls, empty and long texts, repeats, no rows, clashing names."""

import itertools
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import common, components, decontaminate, license_scan, line_dedup, mixing, near_dup, quality_classifier, quality_rules, token_counts, unit_dedup, url_filter

#: Names that operators use inside.
CLASH = "size t h a b n at place words_ gone gone_lines found_spans plan_row twin mix_key mix_twin __size __taken taken listed_url leaked_text text_key class_row all_lines full_lines cut_lines raw_counts n_tokens_raw found spans first kept row shift key item s x".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
BASE = " ".join(f"b{i}" for i in range(120))


def near(n):
    words = BASE.split()
    words[n % 120] = f"x{n}"
    return " ".join(words)


ROWS = [
    (1, "alpha beta gamma delta epsilon zeta\nsecond line of text here today\nthird one", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, LONG, "en", "b"), (5, BASE, "en", None), (6, near(3), "en", "a"), (7, near(90), "de", "c"),
    (8, BASE, "en", "a"), (8, BASE, "en", "a"), (None, "second line of text here today\nthird one\nand more words than that one", "en", "a"), (9, " \n\t ", "en", "b"), (10, "alpha beta gamma delta epsilon zeta\nsecond line of text here today\nfourth", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, x, g, s, len(x or ""), *("clash" for _ in CLASH)) for i, x, g, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 1, 0), (7, 0, 0), (10, 0, None), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")


def ids(df):
    return sorted(((r.doc_id is None, r.doc_id or 0) for r in df.collect()))


def test_pass_through_and_empty_tables(spark, docs, none, labels):
    trees = quality_rules.fit_quality_trees(docs, labels)
    model = quality_classifier.fit_quality(docs, labels)
    for f in (lambda d: quality_rules.score_documents(d, trees), lambda d: quality_classifier.score_quality(d, model), token_counts.with_token_counts, license_scan.scan_licenses, line_dedup.dedup_lines):
        out = f(docs)
        assert ids(out) == ids(docs) and set(docs.columns) <= set(out.columns)
        assert f(none).count() == 0
    assert quality_rules.fit_quality_trees(none, labels.limit(0)).score([[0.0] * len(quality_rules.FEATURES)] if False else __import__("numpy").zeros((1, len(quality_rules.FEATURES))))[0] == pytest.approx(0.5)


def test_names_that_clash(spark, docs, none, labels):
    """Operators that give rows of ``docs`` leave its own columns alone, whatever their names."""
    bench = spark.createDataFrame([(1, "nothing of this stands there at all")], "item_id long, text string")
    for f in (near_dup.drop_near_duplicates, mixing.mix, unit_dedup.remove_repeated_units, line_dedup.drop_repeated_lines, lambda d: decontaminate.drop_contaminated(d, bench), lambda d: quality_rules.keep_good(d, labels)):
        out = f(docs)
        assert set(docs.columns) <= set(out.columns)
        assert {r[c] for r in out.collect() for c in CLASH} <= {"clash"}
        assert f(none).count() == 0
    listed = spark.createDataFrame([("z.org/a",)], "listed_url string")
    pages = docs.withColumn("url", F.lit("http://z.org/a"))
    assert {r.url_filter.verdict for r in url_filter.filter_urls(pages, listed).collect()} == {"block"}


@pytest.mark.parametrize("name", ["quality_rules", "quality_score", "tokens", "licenses", "line_dedup", "removed_spans", "epoch", "words", "url_filter"])
def test_result_names_must_be_free(spark, none, labels, name):
    taken = none.withColumn(name, F.lit(1)).withColumn("url", F.lit("x"))
    calls = {
        "quality_rules": lambda d: quality_rules.score_documents(d, quality_rules.fit_trees(__import__("numpy").zeros((0, len(quality_rules.FEATURES))), __import__("numpy").zeros(0))),
        "quality_score": lambda d: quality_classifier.score_quality(d, quality_classifier.fit_support_vectors([], __import__("numpy").zeros(0))), "tokens": token_counts.with_token_counts, "licenses": license_scan.scan_licenses,
        "line_dedup": line_dedup.dedup_lines, "removed_spans": unit_dedup.remove_repeated_units, "epoch": mixing.mix, "words": mixing.mix, "url_filter": lambda d: url_filter.filter_urls(d, d.select("url")),
    }
    with pytest.raises(ValueError):
        calls[name](taken)


def test_repeated_ids_teach_the_text_of_least_digest(spark):
    rows = [(n, " ".join(f"w{n}_{k}" for k in range(60))) for n in range(40)] + [(n, " ".join(f"v{n}_{k}" for k in range(60))) for n in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(40)], "doc_id long, quality int, toxic int")
    a, b = (quality_classifier.fit_quality(d, labels).weights for d in (df, df.orderBy(F.desc("text")).repartition(7)))
    assert (a == b).all()


def test_training_stops_at_its_budget_of_indicators(spark):
    """Long texts do not burden the driver: rows of least hash count, until their indicators fill the budget."""
    rows = [(n, " ".join(f"w{n}_{k}" for k in range(4000))) for n in range(30)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(n, n % 2, 0) for n in range(30)], "doc_id long, quality int, toxic int")
    order = [r.doc_id for r in df.where(~quality_classifier.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).collect()]
    one = len(quality_classifier.indicators(__import__("pyarrow").array([rows[order[0]][1]]))[1])
    few = quality_classifier.fit_quality(df, labels, max_features=12 * (one + 40))
    same = quality_classifier.fit_quality(df.where(F.col("doc_id").isin(order[:12])), labels)
    assert (few.weights == same.weights).all() and few.weights.any() and few.offset == same.offset
    assert not quality_classifier.fit_quality(df, labels, max_features=one // 2).weights.any()


def test_quality_without_labels(docs, labels):
    out = quality_classifier.score_quality(docs, quality_classifier.fit_quality(docs, labels.limit(0))).collect()
    assert {r.quality_score for r in out} == {0.5}


def test_quality_rules_base(docs, labels):
    out = quality_rules.score_documents(docs, quality_rules.fit_quality_trees(docs, labels))
    for r in out.collect():
        q = r.quality_rules
        n = len(WORD.findall(r.text or ""))
        assert q.n_words == n and q.base_failed == (n < 50 or 100 * q.n_repeat_words > 50 * n)
        assert not (q.base_failed and q.kept)


def test_quality_scores_and_fold(docs, labels):
    out = quality_classifier.score_quality(docs, quality_classifier.fit_quality(docs, labels)).collect()
    by = defaultdict(set)
    for r in out:
        assert 0 <= r.quality_score <= 1
        by[r.text or ""].add(r.quality_score)
    assert all(len(s) == 1 for s in by.values())
    import zlib

    flags = docs.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("o")).collect()
    assert all(r.o == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in flags)


def test_token_counts_of_whole_texts(docs):
    t = token_counts.load_tokenizer(token_counts.TOKENIZER)
    for r in token_counts.with_token_counts(docs).collect():
        want = len(t.encode(r.text or "", add_special_tokens=False))
        assert (r.tokens.n_bytes, r.tokens.n_tokens, r.tokens.over_limit) == (len((r.text or "").encode()), want, want > 512)


def test_mix_meets_its_targets(spark, docs, none):
    plan = mixing.plan_mix(docs).collect()
    size = lambda s: sum(len(WORD.findall(x or "")) for _, x, _, src in ROWS if src == s)
    assert len(plan) == len(ROWS)
    by = defaultdict(list)
    for r in plan:
        by[(r.source_size, r.target)].append(r)
        assert 0 <= r.taken <= 2 * r.size
    for (source_size, target), rows in by.items():
        assert target <= 2 * source_size + 1e-9
        alike = sum(size(s) == source_size for s in ("a", "b", "c", None))  # sources of one size and target
        assert abs(sum(r.taken for r in rows) - alike * target) <= alike
    assert sum(t * sum(size(s) == n for s in ("a", "b", "c", None)) for n, t in by) == pytest.approx(1.5 * sum(size(s) for s in ("a", "b", "c", None)))
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan_mix(docs.repartition(7)).collect()))
    assert mixing.plan_mix(none).count() == 0
    mixed = mixing.mix(docs).collect()
    assert sum(r.words for r in mixed) == sum(r.taken for r in plan) and mixing.mix(none).count() == 0


def test_weights_are_dealt_to_the_others(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10_000), (None, 10)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 200 and got["b"] == 2000 and got[None] == 20  # capped; the rest goes to c
    assert sum(got.values()) == pytest.approx(1.5 * 11_110)


def test_urls(spark):
    urls = ["https://a.example.com/en/1", "http://example.com/en/72?x=1#y", "http://EXAMPLE.net/de/80", "ftp://x.net/de/1", "https://notcom/en/1", "no scheme", None, "http://Host?q", "https://www.z.org/a/?utm_source=feed", "http://z.org/a#f", "http://z.org/a?ref=x&id=2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    listed = url_filter.feed_list(pages.unionByName(pages.where("page_id = 8")))
    got = {r.page_id: r.url_filter for r in url_filter.filter_urls(pages, listed).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(6)] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), (None, "allow"), (None, "allow")]
    assert (got[6].host, got[6].path, got[6].verdict) == ("", "", "allow") and (got[7].host, got[7].path) == ("host", "")
    assert [got[i].verdict for i in (8, 9, 10)] == ["block", "block", "allow"]
    # a filter of one block lets everything through, and nothing changes
    tiny = {r.page_id: r.url_filter for r in url_filter.filter_urls(pages, listed, max_bytes=64).collect()}
    assert tiny == got
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    assert all(not r.url_filter.listed for r in url_filter.filter_urls(pages, listed.limit(0)).collect())


def lines_by_definition(rows, least):
    """What stays of each document when later copies of runs go, and its longest copied run.

    From a plain suffix array: all suffixes sorted, common prefixes of any two as the least of
    those of neighbours between them.
    """
    distinct = sorted({(i is None, i or 0, x) for i, x, *_ in rows if x is not None})
    seqs = [[(n, y) for n, y in enumerate(x.split("\n")) if WORD.search(y)] for *_, x in distinct]
    suffixes = sorted((tuple(y for _, y in s[a:]), k, a) for k, s in enumerate(seqs) for a in range(len(s)))
    common = lambda x, y: next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    lcp = [common(x[0], y[0]) for x, y in zip(suffixes, suffixes[1:])]
    gone, copied = defaultdict(set), defaultdict(int)
    for i, (_, k, a) in enumerate(suffixes):
        best = 0
        for step in (1, -1):
            shared, j = len(seqs[k]), i
            while shared > best and 0 <= j + step < len(suffixes):
                shared = min(shared, lcp[j if step == 1 else j - 1])
                j += step
                if suffixes[j][1:] < (k, a):
                    best = max(best, shared)
        if best >= least:
            gone[k] |= {n for n, _ in seqs[k][a : a + best]}
            copied[k] = max(copied[k], best)
    return {(None if d[0] else d[1], d[2]): ("\n".join(y for n, y in enumerate(d[2].split("\n")) if n not in gone[k]), copied[k]) for k, d in enumerate(distinct)}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_dedup_by_definition(spark, docs, least):
    run = lambda n: "\n".join(f"r{i}" for i in range(n))
    more = [(20, "a\nb\na\nb\na\nb\n\nc"), (21, "x\na\nb\n\na\nc"), (22, "a\na\na\na"), (23, "c\nx\na\nb\na"), (24, run(20)), (25, f"u\n{run(3)}\nv\n{run(5)}"), (26, f"{run(7)}\nw\nr4\nr5\nr6\nr7\nr8\nr9\nr10\nr11\nr12\nr13\nr14"), (27, run(20)), (28, f"{run(13)}\nr2\nr3")]
    rows = [(i, x) for i, x, *_ in ROWS] + more
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # equal ids and texts of the rows above do not differ in digest order here
    want = lines_by_definition(rows, least)
    for r, src in zip(line_dedup.dedup_lines(df.withColumn("old", F.col("text")), least).collect(), rows):
        assert (r.text, r.line_dedup.copied) == ((None, 0) if r.old is None else want[(r.doc_id, r.old)])


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_dedup_of_random_lines(spark, least):
    import random

    r = random.Random(least)
    rows = [(n, "\n".join(r.choice("abcd" if n % 3 else "ab") for _ in range(r.randint(1, 30)))) for n in range(60)]
    want = lines_by_definition(rows, least)
    for got in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("old", F.col("text")), least).collect():
        assert (got.text, got.line_dedup.copied) == want[(got.doc_id, got.old)]


def test_line_dedup_drops_whole_copies(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc"), (3, "a\nb\nd"), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(df).collect()) == [(1, "a\nb\nc"), (3, "d"), (4, None)]


def test_single_long_lines_are_runs(spark):
    words = lambda n, x: " ".join(f"{x}{i}" for i in range(n))
    long, edge, short = words(60, "p"), words(line_dedup.LONG_WORDS, "e"), words(line_dedup.LONG_WORDS - 1, "s")
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n \t{short} \n{edge}\nd"), (3, long), (4, f"e\n{long}\nf\n{short}"), (5, f"g\n{edge}\nh\n \t{short} \ni"), (None, f"{long}\nj"), (6, f"{words(60, 'u')}\nk")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 4: f"e\nf\n{short}", 5: f"g\nh\n \t{short} \ni", None: "j", 6: rows[6][1]}
    counts = {r.doc_id: r.line_dedup for r in line_dedup.dedup_lines(df, long_words=line_dedup.LONG_WORDS).collect()}
    assert (counts[4].n_deleted, counts[4].n_runs, counts[4].longest_run, counts[4].copied) == (1, 1, 1, 1) and counts[1].n_deleted == 0
    assert all(r.text == dict(rows)[r.doc_id] for r in line_dedup.dedup_lines(df).collect())  # by lines alone, as the SQL says


def test_near_duplicates(docs, none):
    got = near_dup.near_duplicate_classes(docs).collect()
    assert len(got) == len(ROWS)
    classes = {(r.doc_id, r.class_id, r.class_size, r.kept) for r in got}
    assert {(5, 5, 5, True), (6, 5, 5, False), (7, 5, 5, False), (8, 5, 5, False)} <= classes
    assert {(2, 2, 1, True), (3, 3, 1, True), (9, 9, 1, True), (1, 1, 1, True), (4, 4, 1, True), (None, None, 1, True)} <= classes
    assert ids(near_dup.drop_near_duplicates(docs)) == [(False, i) for i in (1, 2, 3, 4, 5, 9, 10)] + [(True, 0)]
    assert near_dup.near_duplicate_classes(none).count() == 0


def test_near_copies_with_a_passage_pasted_many_times(spark):
    rows = []
    for n in range(6):  # ten shingles stand fifty times in the copy, whose set has few others
        words = [f"p{n}_{i}" for i in range(304)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words + words[100:114] * 49))]
    got = near_dup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.kept) for r in got} == {(i, i - i % 2, i % 2 == 0) for i, _ in rows}


def test_repeated_rows_keep_one(spark):
    rows = [(None, BASE), (None, BASE), (None, near(3)), (4, "a b c"), (4, "a b c"), (None, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicate_classes(df).collect()
    assert sum(r.kept for r in got) == 4
    out = near_dup.drop_near_duplicates(df).collect()
    assert len(out) == 4 and sorted(r.text for r in out)[:3] == ["", "", "a b c"]


def test_recall_of_near_duplicates_against_all_pairs(spark):
    """Classes against the components of all pairs of weighted similarity 0.8 and more."""
    import random

    r = random.Random(5)
    rows = []
    for n in range(40):
        words = [r.choice([f"g{n}_{k}", f"h{n}_{k}", "a", "of", "the"]) for k in range(r.randint(40, 200))]
        rows.append(" ".join(words))
        for _ in range(r.randint(1, 9)):
            copy = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 40))):
                copy[r.randrange(len(copy))] = r.choice([f"n{r.random()}", "x", "in"])
            rows.append(" ".join(copy[r.randint(0, 3) :] + [f"e{r.random()}"] * r.randint(0, 3)))
    rows = list(enumerate(rows))
    sets = {i: {tuple(w[k : k + 5]) for w in [x.split()] for k in range(len(w) - 4)} for i, x in rows}
    weight = lambda s: sum(1 + sum(len(w) >= near_dup.LONG for w in g) for g in s)
    pairs = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) > 3 and 100 * weight(sets[i] & sets[j]) >= 80 * weight(sets[i] | sets[j])]
    plain = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert set(pairs) != set(plain)  # weights matter here
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        parent[max(top(i), top(j))] = min(top(i), top(j))
    got = {row.doc_id: row.class_id for row in near_dup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 200
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.99 * len(pairs)
    # exact verification: a class never joins what no chain of pairs joins
    assert all(top(i) == top(got[i]) for i in got)


def test_chains_of_near_copies_are_one_class(spark):
    words, rows = BASE.split(), []
    for n in range(12):  # each differs from the next in one word, first and last in many
        words[n * 9] = f"y{n}"
        rows.append((n, " ".join(words)))
    got = near_dup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_scratch_tables_go_with_their_scope(spark):
    df = spark.range(5)
    with common.scratch(spark):
        inner, kept = common.settle(df), common.settle(df, keep=True)
        assert inner.count() == 5
    assert kept.count() == 5
    with pytest.raises(Exception):
        inner.selectExpr("id + 1").collect()
    assert common.settle(df).count() == 5


def test_heavy_groups_join_like_others(spark):
    rows = spark.range(9000).selectExpr("CASE WHEN id < 6000 THEN 0 ELSE id END AS k", "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = common.join_groups(rows, groups, ["k"], "n")
    assert got.count() == 9000 and got.where("k = 0").agg(F.max("first"), F.count("*")).first()[:] == (0, 6000)


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 45), (41, 45), (42, 45), (42, 41), (7, 7)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[31] == 30 and {got[i] for i in (40, 41, 42, 45)} == {40}


def overlaps_by_definition(docs, items):
    out = set()
    words = lambda x: WORD.findall((x or "").lower())
    for i, x in docs:
        w = words(x)
        for item, y in items:
            b = words(y)
            n = min(13, len(b))
            for shift in range(-len(b) + 1, len(w)):
                same = [0 <= j + shift < len(w) and w[j + shift] == b[j] for j in range(len(b))]
                if b and max(sum(same[k : k + n]) for k in range(len(b) - n + 1)) >= n - n * 2 // 13:
                    out.add((i, item))
                    break
    return out


def test_decontamination_by_definition(spark, docs, none):
    item = " ".join(f"q{i}" for i in range(20))
    swap = item.split()
    swap[4], swap[9] = "other", "words"
    spoiled = item.split()
    spoiled[::4] = ["no"] * 5
    rows = [(1, f"a b {item} c"), (2, f"{' '.join(swap)}"), (3, " ".join(spoiled)), (4, f"tail {' '.join(item.split()[:12])}"), (5, "say hello big world now"), (6, "say hello small world now"), (7, None), (8, ""), (9, item.upper()), (9, item.upper()), (None, item)]
    items = [(1, item), (2, "hello big world"), (3, None), (4, ""), (5, "zz"), (6, item)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in decontaminate.contaminated_documents(df, bench).collect())
    assert got == sorted((str(i), k) for i, k in overlaps_by_definition(rows, items))
    assert ids(decontaminate.drop_contaminated(df, bench)) == [(False, i) for i in (3, 6, 7, 8)]
    assert decontaminate.contaminated_documents(none, bench).count() == 0
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == len(rows)
    assert decontaminate.contaminated_documents(df, bench.limit(0)).count() == 0
    within = spark.createDataFrame([(1, f"{LONG} {item} {LONG}"), (2, LONG)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.first_word) for r in decontaminate.contaminated_documents(within, bench).collect()} == {(1, 1, 60_000), (1, 6, 60_000)}


def test_short_items_with_a_word_substituted(spark):
    items = [(n, " ".join(f"i{n}_{k}" for k in range(n))) for n in range(5, 14)]
    rows = []
    for n, x in items:
        w = x.split()
        for p in range(n):
            one = [*w[:p], "no", *w[p + 1 :]]
            two = [*one[: (p + 3) % n], "no", *one[(p + 3) % n + 1 :]]
            rows += [" ".join(["a", "b", *one, "c"]), " ".join(one), " ".join(["a", *two, "c"])]
        rows += [" ".join(w[1:]), " ".join(w[:-1]), f"a {x} b"]
    rows = list(enumerate(rows))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_documents(df, bench).collect()}
    assert got == overlaps_by_definition(rows, items)


def test_unit_dedup_by_definition(spark, docs, none):
    got = sorted((str(r.doc_id), r.start, r.end, str(r.kept_doc_id), r.copies, r.kept) for r in unit_dedup.repeated_units(docs, least_words=5).collect())
    places = defaultdict(list)
    for i, x in sorted({(i, x or "") for i, x, *_ in ROWS}, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        at = 0
        for line in x.split("\n"):
            key = " ".join(line.lower().split())
            if len(key.split()) >= 5:
                places[key].append((str(i), at, at + len(line)))
            at += len(line) + 1
    assert got == sorted((*p, all_of[0][0], len(all_of), k == 0) for all_of in places.values() if len(all_of) > 1 for k, p in enumerate(all_of))
    cleaned = {r.doc_id: r for r in unit_dedup.remove_repeated_units(docs, least_words=5).collect() if r.doc_id in (1, 2, 3, 10)}
    assert cleaned[1].text == ROWS[0][1] and cleaned[10].text == "fourth" and cleaned[2].text is None and cleaned[3].text == ""
    assert unit_dedup.repeated_units(none).count() == 0 and unit_dedup.remove_repeated_units(none).count() == 0


def test_repeated_passages_are_found_in_every_holder(spark):
    words = lambda n, x: " ".join(f"{x}{i}" for i in range(n))
    rows = [(1, f"{words(60, 'a')}\n{words(20, 'p')}"), (2, f"{words(20, 'q')}\n{words(60, 'a').upper()}"), (3, f"{words(60, 'c')}\nall rights reserved"), (4, f"{words(60, 'd')}\nall rights reserved")]
    got = {(r.doc_id, r.kept, r.kept_doc_id) for r in unit_dedup.repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, True, 1), (2, False, 1)}


def test_passages_within_lines_are_found_by_runs_of_sentences(spark):
    passage = " ".join(" ".join(f"s{k}w{i}" for i in range(9)) + "." for k in range(6))
    chance = "this one sentence recurs alone."
    rows = [(1, f"own words to begin with, then {passage} and words of its own"), (2, f"others before {passage}\nNo. A line of its own.\n{chance}"), (3, f"a quite different text here. {chance}"), (3, f"a quite different text here. {chance}"), (None, None), (5, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, rows[r.doc_id - 1][1][r.start : r.end], r.kept, r.kept_doc_id, r.copies) for r in unit_dedup.repeated_units(table, **unit_dedup.PASSAGES).collect())
    inner = [f"{s}." for s in passage[:-1].split(". ")][1:]
    assert got == sorted([(1, s, True, 1, 2) for s in inner] + [(2, s, False, 1, 2) for s in inner])
    cleaned = {r.doc_id: r.text for r in unit_dedup.remove_repeated_units(table, **unit_dedup.PASSAGES).collect()}
    assert cleaned[1] == rows[0][1] and cleaned[2] == f"others before {passage.split('. ')[0]}.\nNo. A line of its own.\n{chance}" and cleaned[3] == rows[2][1] and cleaned[None] is None and cleaned[5] == ""


def test_runs_by_definition(spark, docs):
    got = sorted((str(r.doc_id), r.start, r.end, r.words, r.kept, str(r.kept_doc_id), r.copies) for r in unit_dedup.repeated_units(docs, **unit_dedup.PASSAGES).collect())
    places, texts = defaultdict(list), {}
    for i, x in sorted({(i, x or "") for i, x, *_ in ROWS}, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        units, at = [], 0
        for k, c in enumerate(x + "\n"):
            if c == "\n" or (c == " " and k and x[k - 1] in ".!?"):
                words = x[at:k].lower().split()
                if len(words) >= 5:
                    units.append((at, k, len(words), " ".join(words)))
                    places[units[-1][3]].append((i, at))
                at = k + 1
        texts[i, x] = units
    expected = []
    for (i, _), units in texts.items():
        for repeated, run in itertools.groupby(units, key=lambda u: len(places[u[3]]) > 1):
            run = list(run)
            if repeated and sum(u[2] for u in run) >= 25:
                expected += [(str(i), a, b, n, places[k][0] == (i, a), str(places[k][0][0]), len(places[k])) for a, b, n, k in run]
    assert expected and got == sorted(expected)
