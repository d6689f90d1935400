"""Quality rules: monotone gradient-boosted trees over document statistics.

The statistics of every whole text are counted inside Arrow batches.  The trees are fitted
on a bounded sample of labelled rows, flattened into numpy node arrays and walked for all
rows of a batch at once.  Features that only ever speak against a text (share of symbols,
of repeated words, of repeated lines) are held monotone.

Batches are cut into slices of about 2 MB; a longer text is a slice by itself, and takes some
dozens of bytes of working memory for each of its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import kernels
from lodestrata.llm.common import free, fresh, text_digest

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "mark_share")
#: -1: a larger value never raises the score; 0: free.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "mark_share": -1}
#: At most so many labelled rows, those of least hash, fit the trees.
MAX_TRAIN_ROWS = 20_000
#: Texts of a lower score are rejected.
KEEP_SCORE = 0.3


def _in_text(document: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.uint64]:
    """One value for each (document, hash): the document above, the hash's high bits below."""
    bits = np.uint64(max(1, int(n).bit_length()))
    return (document.astype(np.uint64) << (np.uint64(64) - bits)) | (keys >> bits), np.uint64(64) - bits


def _repeats(document: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Marks the rows whose (document, key) occurs more than once."""
    both, _ = _in_text(document, keys, n)
    ordered = np.sort(both)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(both), bool)
    at = np.minimum(np.searchsorted(twice, both), len(twice) - 1)
    return twice[at] == both


def _distinct(document: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Different keys of each document."""
    both, shift = _in_text(document, keys, n)
    ordered = np.sort(both)
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.bincount((ordered[new] >> shift).astype(np.int64), minlength=n)


def _slice_statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = len(texts)
    data, offsets = kernels.buffers(texts)
    low, high = int(offsets[0]), int(offsets[-1])
    own = data[low:high]

    def per_text(mark: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mark, dtype=np.int64))
        return sums[offsets[1:] - low] - sums[offsets[:-1] - low]

    solid = kernels.WHITE_SPACE[own] > 0
    word_chars = per_text(solid & ((own & 0xC0) != 0x80))
    symbols, marks, upper = per_text(_SYMBOL[own]), per_text(own == ord("!")), per_text((own >= 65) & (own <= 90))
    d, _, _, h, n_words = kernels.words(texts, kernels.WHITE_SPACE)
    size = np.maximum(n_words, 1)

    # lines with a word
    ld, ls, le, lh, _ = kernels.words(texts, kernels.LINES)
    filled = np.append(0, np.cumsum(solid, dtype=np.int64))
    full = filled[le - low] > filled[ls - low]
    ld, lh = ld[full], lh[full]
    lines = np.bincount(ld, minlength=n)
    dup_lines = lines - _distinct(ld, lh, n)

    # words in windows of three that stand twice or more
    covered = np.zeros(len(d), bool)
    if len(d) >= 3:
        window = kernels.ngrams(np.zeros(len(h), np.int64), h, 3)[1]
        at = np.flatnonzero(d[2:] == d[:-2])
        at = at[_repeats(d[at], window[at], n)]
        for k in range(3):
            covered[at + k] = True
    repeated = np.bincount(d[covered], minlength=n)
    counts = np.stack([n_words, word_chars, symbols, dup_lines, repeated], axis=1)
    features = [np.log1p(n_words), word_chars / size, symbols / size, dup_lines / np.maximum(lines, 1), repeated / size, _distinct(d, h, n) / size, upper / np.maximum(word_chars, 1), marks / size]
    return counts, np.stack(features, axis=1)


def statistics_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The contract's counts and the features of the trees, of every whole text (null: empty)."""
    counts, features = np.zeros((len(texts), len(COUNTS)), np.int64), np.zeros((len(texts), len(FEATURES)))
    for at, part in kernels.batches(texts):
        counts[at : at + len(part)], features[at : at + len(part)] = _slice_statistics(part)
    return counts, features


@dataclass
class FlatTrees:
    """All trees in shared node arrays; a leaf has itself as both children."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: int = 10) -> FlatTrees:
    """Boost trees on the logistic loss; x and y are a bounded sample.

    Without both labels the score of every text is the share of label 1 (0.5 without rows).
    """
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    margin = np.full(len(y), np.log(share / (1 - share)))
    sign = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, len(FEATURES)), int)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([0, 0.0, at, at, value * rate])
        best = None
        if level < depth and len(rows) >= 2 * least:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                gr, hr, nr = g[rows].sum() - gl, h[rows].sum() - hl, len(rows) - nl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2)
                gain[(nl < least) | (nr < least) | (sign[j] * (vr - vl) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
                    best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        own = -(g[rows].sum() * value + 0.5 * (h[rows].sum() + ridge) * value**2)
        if best and best[0] > own + 1e-6:
            _, j, k, vl, vr = best
            middle = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[int(sign[j])]
            goes = binned[rows, j] <= k
            a = grow(rows[goes], g, h, level + 1, *bounds[0])
            b = grow(rows[~goes], g, h, level + 1, *bounds[1])
            nodes[at] = [j, float(cuts[j][k]), a, b, 0.0]
        return at

    if len(y) and 0 < y.sum() < len(y):
        everything = np.arange(len(y))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(everything, p - y, p * (1 - p), 0, -4.0, 4.0))
            f, t, le, ri, v = (np.array(c) for c in zip(*nodes))
            one = FlatTrees(np.array(roots[-1:]), f, t, le, ri, v, 0.0, depth)
            s = one.score(x)
            margin = margin + np.log(s / (1 - s))
    if not nodes:
        nodes, roots = [[0, 0.0, 0, 0, 0.0]], [0]
    f, t, le, ri, v = (np.array(c) for c in zip(*nodes))
    return FlatTrees(np.array(roots), f.astype(int), t.astype(float), le.astype(int), ri.astype(int), v.astype(float), float(np.log(share / (1 - share))), depth)


def fit_quality_trees(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> FlatTrees:
    """Fit on at most ``max_rows`` labelled rows, those whose doc_id has the least hash.

    Null ids and null labels teach nothing; of repeated ids the text of least digest counts.
    """
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        x = statistics_of(texts)[1]
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())

    # bounded by max_rows, two small columns: safe to broadcast at any input size
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", text_digest(F.col("text")).alias("t"), features("text").alias("x"))
    table = rows.groupBy("doc_id", "quality").agg(F.min_by("x", "t").alias("x")).orderBy("doc_id").toArrow()
    x = np.array(table["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_trees(x, np.array(table["quality"].to_pylist(), float))


def score_documents(docs: DataFrame, trees: FlatTrees, keep_score: float = KEEP_SCORE, into: str = "quality_rules") -> DataFrame:
    """Add a struct column ``into``: counts, base_failed, score and kept, of every whole text.

    A null text counts as empty: no words, so it fails the base rule.  Repeated rows get equal
    verdicts; all other columns pass through, whatever their names; ``into`` must not be one of them.
    """
    free(docs, into)
    fields = ", ".join(f"{c}: bigint" for c in COUNTS)

    @F.arrow_udf(f"struct<{fields}, score: double>")
    def judge(texts: pa.Array) -> pa.Array:
        counts, x = statistics_of(texts)
        return pa.StructArray.from_arrays([*(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(trees.score(x))], [*COUNTS, "score"])

    raw = fresh(docs, "raw_counts")
    c = lambda name: F.col(raw)[name]
    failed = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    return docs.withColumn(raw, judge(F.col("text"))).withColumn(
        into, F.struct(*(c(n).alias(n) for n in COUNTS), failed.alias("base_failed"), c("score").alias("score"), (~failed & (c("score") >= keep_score)).alias("kept"))
    ).drop(raw)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    name = fresh(docs, "quality_rules")
    scored = score_documents(docs, fit_quality_trees(docs, labels), into=name)
    return scored.where(F.col(name)["kept"]).select(*docs.columns)


#: The contract's counts and the base rule, for DuckDB.
BASE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT n, count(*) - count(DISTINCT line) AS dup FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY n
), g AS (
  SELECT n, i, words[i : i + 2] AS gram FROM d, unnest(range(1, len(words) - 1)) AS u(i)
), often AS (
  SELECT n, i FROM (SELECT *, count(*) OVER (PARTITION BY n, gram) AS c FROM g) WHERE c > 1
), r AS (
  SELECT n, count(DISTINCT i + o) AS repeated FROM often, (VALUES (0), (1), (2)) AS v(o) GROUP BY n
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       coalesce(dup, 0) AS n_dup_lines, coalesce(repeated, 0) AS n_repeat_words, len(words) < 50 OR 100 * coalesce(repeated, 0) > 50 * len(words) AS base_failed
FROM d LEFT JOIN l USING (n) LEFT JOIN r USING (n)
"""
