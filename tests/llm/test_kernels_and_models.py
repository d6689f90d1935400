"""Pure functions of the corpus operators against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import decontaminate, kernels, license_scan, near_dup, quality_classifier, quality_rules, token_counts, unit_dedup, url_filter

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b.aAbZ09é汉🙂|!", max_size=60)), max_size=12)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    array = pa.array(texts, pa.string())
    d, s, e, h, counts = kernels.words(array, kernels.WHITE_SPACE)
    want = [WORD.findall(t or "") for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    names = {}
    for word, value in zip(flat, h.tolist()):
        assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tab#|xé汉🙂\0\x0c", max_size=80)), max_size=6))
def test_statistics_by_definition(texts):
    counts, features = quality_rules.statistics_of(pa.array(texts, pa.string()))
    assert features.shape == (len(texts), len(quality_rules.FEATURES))
    for text, found in zip(texts, counts.tolist()):
        assert found == statistics_by_definition(text or "")


def statistics_by_definition(t):
    words = WORD.findall(t)
    lines, dup = [x for x in t.split("\n") if WORD.search(x)], 0
    for i, x in enumerate(lines):
        dup += x in lines[:i]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeat = len({j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)})
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, repeat]


def test_words_longer_than_a_block():
    long = "é" * (kernels.BLOCK // 2 + 5)
    texts = [f"a {long}\n{long} b", long, "c d"]
    *_, counts = kernels.words(pa.array(texts), kernels.WHITE_SPACE)
    assert counts.tolist() == [4, 1, 2]
    assert quality_rules.statistics_of(pa.array(texts))[0].tolist() == [statistics_by_definition(t) for t in texts]


def test_coordinate_descent_reaches_the_least_loss():
    """Against plain projected gradient steps on the dual of a dense problem."""
    r = np.random.default_rng(2)
    x, y = r.normal(size=(40, 5)), (r.random(40) < 0.4).astype(float)
    x[:, 0] += 1.5 * y
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    sign, rows = np.where(y > 0, 1.0, -1.0), [np.arange(5)] * 40
    w, alpha = quality_classifier.coordinate_descent(rows, list(x), y, 1.0, 500, features=5)
    bound = 40 / (2 * np.where(y > 0, y.sum(), 40 - y.sum()))
    q, a = (x * sign[:, None]) @ (x * sign[:, None]).T, np.zeros(40)
    for _ in range(40000):
        a = np.clip(a - 0.02 * (q @ a - 1), 0, bound)
    dual = lambda v: 0.5 * v @ q @ v - v.sum()
    assert dual(alpha) == pytest.approx(dual(a), abs=2e-3) and np.allclose(w, (alpha * sign) @ x)


def test_scores_do_not_follow_length():
    texts = ["the quick brown fox jumps", "buy!! now!! cheap!!"]
    rows = [quality_classifier.indicators(pa.array([t]))[1] for t in texts * 12]
    model = quality_classifier.fit_support_vectors(rows, np.array([1.0, 0.0] * 12))
    short, long = model.score(pa.array(texts)), model.score(pa.array([" ".join([t] * 500) for t in texts]))
    assert np.abs(short - long).max() < 0.2 and short[0] > 0.5 > short[1]


def test_trees_are_monotone_and_learn():
    r = np.random.default_rng(3)
    x = r.random((600, len(quality_rules.FEATURES)))
    j = quality_rules.FEATURES.index("symbol_share")
    y = ((x[:, j] < 0.5) & (x[:, 0] > 0.2)).astype(float)
    trees = quality_rules.fit_trees(x, y)
    assert ((trees.score(x) > 0.5) == (y > 0)).mean() > 0.97
    for name in quality_rules.MONOTONE:
        k = quality_rules.FEATURES.index(name)
        grid = np.repeat(x[:50], 20, axis=0)
        grid[:, k] = np.tile(np.linspace(0, 1, 20), 50)
        assert (np.diff(trees.score(grid).reshape(50, 20), axis=1) <= 1e-12).all()


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0]])
def test_trees_without_both_labels(y):
    x = np.zeros((len(y), len(quality_rules.FEATURES)))
    s = quality_rules.fit_trees(x, np.array(y)).score(np.zeros((2, len(quality_rules.FEATURES))))
    assert ((0 < s) & (s < 1)).all()


def test_flat_scores_equal_walked_scores():
    r = np.random.default_rng(5)
    x = r.random((200, len(quality_rules.FEATURES)))
    t = quality_rules.fit_trees(x, (x[:, 0] + x[:, 3] > 1).astype(float), trees=5)
    for row, score in zip(x, t.score(x)):
        total = t.base
        for node in t.roots:
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
            total += t.value[node]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_support_vectors_separate():
    good, bad = ["the quick brown fox jumps"] * 20 + ["a calm river runs"] * 20, ["buy!! now!! buy!!"] * 15
    texts = pa.array(good + bad)
    d, f = quality_classifier.indicators(texts)
    rows = [f[d == i] for i in range(len(texts))]
    model = quality_classifier.fit_support_vectors(rows, np.array([1.0] * 40 + [0.0] * 15))
    s = model.score(texts)
    assert s[:40].min() > 0.5 > s[40:].max()
    assert 0 <= model.score(pa.array(["", None]))[0] == model.score(pa.array(["", None]))[1] <= 1
    assert quality_classifier.fit_support_vectors([], np.zeros(0)).score(pa.array(["x"]))[0] == 0.5


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "the ", " ", "  ", "\n", "é", "1", "!!", "'s", "<|endoftext|>", "<|endo", "🙂", "xy" * 30]), max_size=120))
def test_spliced_counts_equal_whole_counts(parts):
    text = "".join(parts)
    t = token_counts.load_tokenizer("byte_bpe_50k.json")
    want = len(t.encode(text, add_special_tokens=False))
    for chunk, overlap in ((20, 17), (64, 24)):
        assert token_counts.count_tokens(t, text, chunk, overlap) == want


def test_one_word_longer_than_any_overlap():
    t = token_counts.load_tokenizer("byte_bpe_50k.json")
    text = "so " + "q" * 3000 + " end"
    assert token_counts.count_tokens(t, text, 100, 20) == len(t.encode(text, add_special_tokens=False))


def brute_matches(templates, words, least):
    """Maximal runs of words that occur in some template."""
    grams = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    ending = []
    for i in range(len(words)):
        n = next((n for n in range(i + 1, 0, -1) if tuple(words[i + 1 - n : i + 1]) in grams), 0)
        ending.append(n)
    return {(i + 1 - n, n) for i, n in enumerate(ending) if n >= least and (i + 1 == len(words) or ending[i + 1] <= n)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=9), min_size=1, max_size=3), st.lists(st.integers(-1, 3), max_size=25))
def test_automaton_matching_statistics(templates, words):
    a = license_scan.SuffixAutomaton(templates)
    seeds = {tuple(t[i : i + 2]) for t in templates for i in range(len(t) - 1)}
    found, done = set(), 0
    for i in range(len(words) - 1):  # as the scanner streams: from places where a template's window stands
        if tuple(words[i : i + 2]) in seeds and i >= done:
            runs, done = a.matches(words, i, 2)
            found |= {(s, n) for s, n, _ in runs}
    want = brute_matches(templates, words, 2)
    assert {r for r in want if not any(o != r and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in want)} <= found
    for s, n in found:
        assert any(words[s : s + n] == t[i : i + n] for t in templates for i in range(len(t)))


def scan_by_definition(templates, words, least, gap):
    """Per template the most words that a chain of runs covers, over all chains."""
    grams = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    best = {}
    for t, template in enumerate(templates):
        runs = [(s, n, e) for s, n in brute_matches(templates, words, least) for e in range(n, len(template) + 1) if template[e - n : e] == words[s : s + n]]

        def chain(covered, text_end, template_end, runs=runs):
            out = covered
            for s, n, e in runs:
                skip = max(0, text_end - s, template_end - (e - n))
                if s >= 0 and s - text_end <= gap and e > template_end and skip < n and e - n - template_end <= gap and s + n > text_end:
                    out = max(out, chain(covered + n - skip, s + n, e))
            return out

        if runs:
            best[t] = max(chain(n, s + n, e) for s, n, e in runs)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["alpha beta gamma delta epsilon", "zeta eta theta", "beta gamma zeta", "x", "alpha beta", "delta epsilon zeta eta theta iota"]), max_size=6))
def test_chains_by_definition(parts):
    templates = [("one", "alpha beta gamma delta epsilon zeta eta theta"), ("two", "zeta eta theta iota kappa"), ("one", "beta gamma zeta")]
    scanner = license_scan.Scanner(templates, least=2, gap=3)
    found = scanner.scan(pa.array([" ".join(parts)]))[0]
    split = [t.split() for _, t in templates]
    want = scan_by_definition(split, " ".join(parts).split(), 2, 3)
    share = {t: c / len(split[t]) for t, c in want.items()}
    assert found["score"] == pytest.approx(min(1.0, max(share.values(), default=0.0)))
    assert found["labels"] == {templates[t][0] for t, s in share.items() if s >= scanner.covered}


def test_packaged_licences_are_recognised():
    templates = license_scan.standard_templates()
    scanner = license_scan.Scanner(templates)
    texts = [f"Copyright (c) somebody\n{text.upper()}\nint main" for _, text in templates]
    for (label, _), found in zip(templates, scanner.scan(pa.array(texts))):
        assert label in found["labels"] and found["score"] == 1.0
    edited = dict(templates[::-1])["mit"].replace("sublicense", "licence").replace("EXPRESS OR IMPLIED", "ANY")
    assert license_scan.Scanner([("mit", dict(templates[::-1])["mit"])]).scan(pa.array([edited]))[0]["labels"] == {"mit"}
    assert license_scan.Scanner([]).scan(pa.array(["all rights reserved"]))[0]["base"] == {"reserved"}


def test_license_spans():
    r = license_scan.Scanner().scan(pa.array(["x y Licensed under the Apache License, Version 2.0. CC-BY and ALL rights reserved", None]))
    assert (r[0]["n_base"], r[0]["first_word"], r[0]["last_word"], r[0]["base"], r[0]["labels"]) == (2, 10, 13, {"cc-by", "reserved"}, {"apache-2.0"})
    assert r[1]["n_words"] == 0 and r[1]["first_word"] is None and r[1]["score"] == 0


def test_prob_minhash_estimates_probability_jaccard():
    r = np.random.default_rng(1)
    n, shared = 400, 300
    h = kernels.mix(np.arange(n + 100, dtype=np.uint64))
    w = r.integers(1, 5, n + 100).astype(float)
    x, y = np.arange(n), np.r_[np.arange(shared), np.arange(n, n + 100)]
    d = np.r_[np.zeros(len(x), int), np.ones(len(y), int)]
    both = near_dup.prob_minhash(d, np.r_[h[x], h[y]], np.r_[w[x], w[y]], 2, 4096)
    top = sum(1 / sum(max(w[k] / w[i] if k in xs else 0, w[k] / w[i] if k in ys else 0) for k in range(n + 100)) for xs, ys in [(set(x), set(y))] for i in range(shared))
    # equal total weights are not needed: the bound below allows for their ratio
    assert abs((both[0] == both[1]).mean() - top) < 0.06


def test_shingles_of_short_texts():
    d, h, w = near_dup.shingles(pa.array(["a b", "", "A  b", "a b c d e a b c d e", None]))
    assert np.bincount(d, minlength=5).tolist() == [1, 0, 1, 5, 0]
    assert h[d == 0] == h[d == 2] and (w == 1).all()


def test_weights_of_shingles():
    texts = ["the long words of this text are what it says", "abc", "abcd é éé", " ".join(["aaaa"] * 9), None, "in it"]
    d, h, w = near_dup.shingles(pa.array(texts))
    for i, t in enumerate(texts):
        words = (t or "").lower().split()
        n = min(5, len(words))
        want = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
        assert sorted(w[d == i].tolist()) == sorted(1 + sum(len(x.encode()) >= 4 for x in g) for g in want)
    assert (h.astype(np.uint64) & np.uint64(7) == w.astype(np.uint64)).all()


def test_parity_never_tells_more_weight_than_differs(spark):
    r = np.random.default_rng(4)
    words = ["a", "of", "abc", "words", "longer", "abcd", "x1", "seven"]
    rows = [(i, " ".join(r.choice(words, r.integers(5, 300)))) for i in range(40)]
    sets = spark.createDataFrame(rows, "id long, text string").select("id", near_dup.shingle_set(F.col("text")).alias("s")).select("id", "s.*")
    x, y = (sets.select(F.struct("*").alias(n)) for n in "xy")
    for p in x.crossJoin(y).select("x", "y", near_dup._differing_weight("x.parity", "y.parity").alias("least")).collect():
        apart = set(p.x.shingles) ^ set(p.y.shingles)
        assert p.least <= sum(s & 7 for s in apart) and (apart or not p.least)


def test_probability_jaccard_of_equal_weights_is_the_weight_shared():
    """The definition over normalised weights of two sets, against shared weight over joint weight."""
    r = np.random.default_rng(2)
    for _ in range(50):
        w = r.integers(1, 7, 30).astype(float)
        x, y = (set(np.flatnonzero(r.random(30) < 0.7).tolist()) for _ in range(2))
        of = lambda s, k: w[k] if k in s else 0.0  # noqa: E731, B023
        defined = sum(1 / sum(max(of(x, e) / of(x, d), of(y, e) / of(y, d)) for e in x | y) for d in x & y)
        assert defined == pytest.approx(w[list(x & y)].sum() / w[list(x | y)].sum())


def test_masks_find_every_window():
    from itertools import combinations

    n, e = decontaminate.OVERLAP, decontaminate.SUBSTITUTED
    for gone in combinations(range(n), e):
        assert any(not {o + p for p in m} & set(gone) for m in decontaminate.MASKS for o in range(n - m[-1]))


def test_units_have_original_offsets():
    text = "é one two three four five\n\nshort\n  ONE two three  four five é "
    units = unit_dedup.units_of(text, least_words=5)
    assert [text[a:b] for a, b, *_ in units] == ["é one two three four five", "  ONE two three  four five é "]
    a = unit_dedup.units_of("one two three four FIVE", least_words=5)[0]
    b = unit_dedup.units_of(" one  two three four five ", least_words=5)[0]
    assert a[3:] == b[3:]
    assert unit_dedup.cut_spans("a\nb\nc", [{"start": 2, "end": 3}], unit_dedup.SEPARATORS["line"]) == "a\nc"


def test_filter_bits_lie_in_one_block():
    h = kernels.mix(np.arange(1000, dtype=np.uint64))
    block, bits = url_filter._bits(h.view(np.int64), 7)
    assert set(block.tolist()) == set(range(7)) and bits.shape == (1000, 8)
    assert all(bin(int(b)).count("1") == 1 for b in bits.ravel())
