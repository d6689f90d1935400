"""Quality classifier: naive Bayes support vectors on hashed n-gram indicators.

Indicators are one- and two-grams of folded words and one- to three-grams of word shapes
(case, marks, repeats).  Each is scaled by the log ratio of its smoothed counts in the two
classes; a linear hinge loss on the scaled indicators is fitted by dual coordinate descent;
margins become scores by a logistic curve that is fitted on margins of folds left out.  Rows
have length one, in training as in scoring, so the length of a text does not move its score.

A text is read as a whole by one task, in slices of about 2 MB of short texts; a longer one is a
slice by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import kernels
from lodestrata.llm.common import free, settle, text_digest

#: Hashed features; the last is always on, so that an empty text has a score as well.
FEATURES = 1 << 18
#: At most so many labelled rows, those of least hash, fit the model.
MAX_TRAIN_ROWS = 6_000
#: ... as long as their indicators are no more than these in all (64 MB on the driver, 4 bytes each).
MAX_TRAIN_FEATURES = 1 << 24
POSITIVE_SCORE = 0.3

_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 4 digit, 8 stop, 16 other mark, 32 not ASCII
_CLASS[33:128] = 16
_CLASS[[*b".,;:'"]] = 8
_CLASS[48:58] = 4
_CLASS[65:91] = 2
_CLASS[97:123] = 1
_CLASS[128:] = 32


def _shapes(data: np.ndarray, document: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: classes of its bytes, the first one's, more capitals, a repeat."""
    kinds = np.bitwise_or.reduceat(_CLASS[data[: e[-1]]], s) if len(s) else np.zeros(0, np.uint8)
    # reduceat runs up to the next start: what lies between is white space, class 0
    first = _CLASS[data[s]].astype(np.uint64)
    second = np.where(e - s > 1, _CLASS[data[np.minimum(s + 1, len(data) - 1)]], 0).astype(np.uint64)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (document[1:] == document[:-1])
    code = kinds.astype(np.uint64) | (first << np.uint64(8)) | (second << np.uint64(16)) | (same.astype(np.uint64) << np.uint64(24))
    return kernels.mix(code + np.uint64(0xABCD << 32))


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document, feature) of the texts."""
    data, _ = kernels.buffers(texts)
    document, s, e, h, _ = kernels.words(texts, kernels.FOLDED_WHITE_SPACE)
    shape = _shapes(data, document, s, e, h)
    parts = [kernels.ngrams(document, x, n) for x, sizes in ((h, (1, 2)), (shape, (1, 2, 3))) for n in sizes]
    d, f = (np.concatenate(x) for x in zip(*parts))
    keys = np.unique(d.astype(np.int64) * FEATURES + (f % np.uint64(FEATURES - 1)).astype(np.int64))
    keys = np.sort(np.concatenate([keys, np.arange(len(texts), dtype=np.int64) * FEATURES + FEATURES - 1]))
    return keys // FEATURES, keys % FEATURES


@dataclass
class SupportVectors:
    ratio: np.ndarray  # log-count ratios, which scale the indicators
    weights: np.ndarray  # of the scaled indicators
    slope: float
    offset: float

    def margins(self, document: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Margins of rows of length one."""
        x = self.ratio[feature]
        return np.bincount(document, x * self.weights[feature], n) / np.maximum(np.sqrt(np.bincount(document, x * x, n)), 1e-9)

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for at, part in kernels.batches(texts):
            out[at : at + len(part)] = self.margins(*indicators(part), len(part))
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.offset, -30, 30)))


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, with Platt's smoothed targets, by Newton's steps."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(y))], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * (b - [1.0, 0.0]))
        b = b - step
        if np.abs(step).max() < 1e-6:
            break
    return max(float(b[0]), 0.0), float(b[1])


def _log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float) -> np.ndarray:
    p, q = np.full(FEATURES, smooth), np.full(FEATURES, smooth)
    for f, label in zip(rows, y):
        (p if label else q)[f] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[FEATURES - 1] = 1.0
    return ratio


def coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and dual variables of the linear hinge loss, by dual coordinate descent."""
    sign = np.where(y > 0, 1.0, -1.0)
    w, alpha = np.zeros(features), np.zeros(len(y))
    # the rarer class may pull as hard as the other
    bound = cost * len(y) / (2 * np.where(y > 0, y.sum(), len(y) - y.sum()))
    norm = np.array([v @ v for v in values])
    order = np.random.default_rng(11)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            f, v = rows[i], values[i]
            new = min(max(alpha[i] - (sign[i] * (w[f] @ v) - 1) / max(norm[i], 1e-12), 0.0), bound[i])
            if new != alpha[i]:
                w[f] += (new - alpha[i]) * sign[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, alpha


def _fit(rows: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, smooth: float) -> SupportVectors:
    ratio = _log_count_ratios(rows, y, smooth)
    values = [ratio[f] / max(float(np.sqrt(ratio[f] @ ratio[f])), 1e-9) for f in rows]
    return SupportVectors(ratio, coordinate_descent(rows, values, y, cost, epochs)[0], 1.0, 0.0)


def fit_support_vectors(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 10, smooth: float = 1.0, folds: int = 3) -> SupportVectors:
    """``rows``: the indicators of each text of a bounded sample; ``y``: its labels, 0 or 1.

    The logistic curve is fitted on margins that models of the other folds give.  Without both
    labels in every fold's rest, every score is the share of label 1 (0.5 without rows).
    """
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    fold = np.arange(len(y)) % folds
    if not len(y) or any(len(np.unique(y[fold != k])) < 2 for k in range(folds)):
        return SupportVectors(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, float(np.log(share / (1 - share))))
    margin = np.zeros(len(y))
    for k in range(folds):
        mine = np.flatnonzero(fold != k)
        model = _fit([rows[i] for i in mine], y[mine], cost, epochs, smooth)
        for i in np.flatnonzero(fold == k):
            margin[i] = model.margins(np.zeros(len(rows[i]), np.int64), rows[i], 1)[0]
    model = _fit(rows, y, cost, epochs, smooth)
    scale = float(np.abs(margin).mean()) or 1.0
    slope, offset = _calibrate(margin / scale, y)
    return SupportVectors(model.ratio, model.weights, slope / scale, offset)


def held_out(doc_id):
    """Rows that teach nothing: crc32 of the id's digits is a multiple of 5.  A null id teaches nothing either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, max_features: int = MAX_TRAIN_FEATURES) -> SupportVectors:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold, those of least hash.

    Rows come in order of their hash; the driver gets them while their indicators are no more
    than ``max_features`` in all, so its memory is bounded whatever the length of the texts.  Null
    ids and null labels teach nothing; of repeated ids the text of least digest counts.
    """
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(*by_hash).limit(max_rows)
    )

    @F.arrow_udf("array<int>")
    def features(texts: pa.Array) -> pa.Array:
        found, sizes = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for _, part in kernels.batches(texts):
            d, f = indicators(part)
            found.append(f), sizes.append(np.bincount(d, minlength=len(part)))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(found), pa.int32()))

    # bounded by max_rows, two small columns: safe to broadcast at any input size
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", text_digest(F.col("text")).alias("t"), features("text").alias("x"))
    rows = settle(rows.groupBy("doc_id", "quality").agg(F.min_by("x", "t").alias("x")))
    # a row for each of max_rows at most, without the indicators
    running = rows.select("doc_id", F.sum(F.size("x").cast("long")).over(Window.orderBy(*by_hash)).alias("sum"))
    taken = running.where(F.col("sum") <= max_features).select("doc_id")
    table = rows.join(F.broadcast(taken), "doc_id").toArrow().sort_by("doc_id")
    return fit_support_vectors([np.asarray(x.values) for x in table["x"]], np.array(table["quality"].to_pylist(), float))


def score_quality(docs: DataFrame, model: SupportVectors, into: str = "quality_score") -> DataFrame:
    """Add the score (0 to 1) of every whole text as column ``into``; other columns pass through.

    Only the text counts: equal texts, in repeated rows or not, get equal scores.  A null text
    scores as the empty text does.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts))

    free(docs, into)
    return docs.withColumn(into, score(F.col("text")))
