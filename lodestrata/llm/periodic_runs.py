"""Periodic runs of words: the Lyndon roots of every run, found by a stack from right to left.

A run of smallest period p begins again, somewhere within its first p words, with a Lyndon word
of p words that is the longest one at its place, in the alphabet's order or in the reverse one.
So for both orders each place's longest Lyndon word is found: from right to left, the stack of
next smaller suffixes gives its end.  Suffixes are compared by their longest common extension: a
binary search over rolling hashes whose answer the words themselves confirm.  Each Lyndon word is
then extended to both sides by its own period, and what is long enough is a run.

Places in no run are passed over first: where a run repeats itself, some fixed number of words in
a row stands elsewhere in the text as well, at each of its places.  Only stretches of such places
are scanned, and a run never leaves its stretch.

Defined results: null and empty texts have no words and no runs; a text's words are compared as
bytes; a text is read as a whole by one task, in time that grows with its length times the
logarithm; rows are independent, so repeated ones get equal results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import free, fresh

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3

_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687
_POWERS = [1]


class Extensions:
    """Longest common extensions of places in a sequence of word numbers."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self.bytes = np.asarray(ids, np.int32).tobytes()
        while len(_POWERS) <= self.n:
            _POWERS.append(_POWERS[-1] * _BASE % _PRIME)
        self.sums = sums = [0] * (self.n + 1)
        s = 0
        for i, x in enumerate(ids):
            sums[i + 1] = s = (s * _BASE + x + 1) % _PRIME
        #: For each distance the last place whose extension is known, and that extension.
        self.known: dict[int, tuple[int, int]] = {}

    def _agree(self, i: int, j: int, most: int) -> int:
        """How many words from i and from j are equal, up to ``most``."""
        ids, k, near = self.ids, 0, min(most, 6)
        while k < near and ids[i + k] == ids[j + k]:
            k += 1
        if k < near or k == most:
            return k
        sums = self.sums
        low, high = k, most + 1  # equal for ``low`` words, unequal for ``high``
        step = 8
        while high - low > 1:
            mid = min(low + step, (low + high) // 2) if high > most else (low + high) // 2
            p = _POWERS[mid]
            if (sums[i + mid] - sums[i] * p - sums[j + mid] + sums[j] * p) % _PRIME:
                high = mid
            else:
                low, step = mid, step * 4
        b = self.bytes
        if b[4 * i : 4 * (i + low)] == b[4 * j : 4 * (j + low)]:
            return low
        return next(k for k in range(low) if ids[i + k] != ids[j + k])  # a hash that two word runs share

    def forward(self, i: int, j: int) -> int:
        """Equal words from i and from j on, i < j."""
        most, at = self.n - j, self.known.get(j - i)
        if at is not None and 0 < at[0] - i <= most:
            gap = at[0] - i
            k = self._agree(i, j, gap)
            if k == gap:
                k += at[1]
        else:
            k = self._agree(i, j, most)
        self.known[j - i] = (i, k)
        return k

    def backward(self, i: int, j: int) -> int:
        """Equal words up to i and up to j (both included), i < j."""
        ids, k, near = self.ids, 0, min(i + 1, 6)
        while k < near and ids[i - k] == ids[j - k]:
            k += 1
        if k < near or k == i + 1:
            return k
        sums, low, high = self.sums, k, i + 2
        while high - low > 1:
            mid = (low + high) // 2
            p = _POWERS[mid]
            if (sums[i + 1] - sums[i + 1 - mid] * p - sums[j + 1] + sums[j + 1 - mid] * p) % _PRIME:
                high = mid
            else:
                low = mid
        b = self.bytes
        if b[4 * (i + 1 - low) : 4 * (i + 1)] == b[4 * (j + 1 - low) : 4 * (j + 1)]:
            return low
        return next(k for k in range(low) if ids[i - k] != ids[j - k])


def lyndon_runs(ids: list[int], least: int, periods: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of word numbers."""
    n, found = len(ids), set()
    for reverse in (False, True):
        ext = Extensions(ids)
        after = [n] * (n + 1)  # the next smaller suffix: where the longest Lyndon word ends
        last: dict[int, tuple[int, int]] = {}  # of each period the run found last, from right to left
        for i in range(n - 1, -1, -1):
            j, k = i + 1, 0
            while j < n:
                k = ext.forward(i, j)
                if j + k == n or (ids[i + k] < ids[j + k]) == reverse:
                    break
                j = after[j]
            after[i], p = j, j - i
            if j == n or p * periods > n:
                continue
            begin, end = last.get(p, (n, n))
            if begin <= i and j <= end:
                continue
            before = ext.backward(i - 1, j - 1) if i else 0
            length = before + p + k
            if length >= 2 * p:
                last[p] = (i - before, i - before + length)
            if length >= max(least, periods * p):
                found.add((i - before, length, p))
    return found


def repeated_stretches(words: list[bytes], least: int, periods: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches that can hold runs: all their places repeat some words in a row.

    A run of L words and period p has L - 2p >= L (periods - 2) / periods; grams of no more words
    than that stand again p words later or earlier at each of its places.
    """
    gram = max(1, least * (periods - 2) // periods)
    n = len(words) - gram + 1
    if len(words) < least:
        return
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)  # a filter only: equal words agree
    g = h[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, gram):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(g)
    same = np.flatnonzero(g[order[1:]] == g[order[:-1]])
    again = np.zeros(n + 2, np.int8)
    again[order[same] + 1] = again[order[same + 1] + 1] = 1
    edges = np.flatnonzero(np.diff(again))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a + gram - 1 >= least:
            yield a, b + gram - 1


def runs_of(words: list[bytes], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``least`` words and ``periods`` periods or more, by start, then period."""
    found = []
    for a, b in repeated_stretches(words, least, periods):
        numbers: dict[bytes, int] = {}
        ids = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
        found += [(a + s, n, p) for s, n, p in lyndon_runs(ids, least, periods)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that stand in a run after its first period."""
    if not runs:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        cover[s + p] += 1
        cover[s + n] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist())


_RUNS = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


def with_runs(docs: DataFrame, into: str = "periodic", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """Add a struct ``into`` to every row; other columns pass through, ``into`` must not be one of them.

    n_words; runs: start (word number), length and period of every run, by start, then period;
    collapsed: the words joined by one space, each run cut to its first period.
    """
    if least < 1 or periods < 2:
        raise ValueError("a run has a word and two periods at least")
    free(docs, into)

    @F.arrow_udf(_RUNS)
    def find(texts: pa.Array) -> pa.Array:
        counts, offsets, flat, kept = [], [0], [], []
        for text in texts.cast(pa.large_binary()):
            words = (text.as_py() or b"").split()  # bytes split at ASCII white space
            runs = runs_of(words, least, periods)
            counts.append(len(words)), flat.extend(runs), offsets.append(len(flat)), kept.append(collapsed(words, runs))
        each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (list(zip(*flat)) or [[]] * 3)], ["start", "length", "period"])
        texts = pa.array(kept, pa.large_binary() if sum(map(len, kept)) >= 1 << 31 else pa.binary())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each), texts.cast(pa.string() if texts.type == pa.binary() else pa.large_string())], ["n_words", "runs", "collapsed"])

    return docs.withColumn(into, find(F.col("text")))


def greatest_run(runs: Column) -> Column:
    """The run of the greatest length to period; of equals the first by start, then period; null without runs."""
    empty = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, empty, lambda a, b: F.when(better(a, b), b).otherwise(a))


def echoed(doc_id: int | None, text: str | None) -> str | None:
    """The text of a document, which may go on periodically, as the query has it.

    h is the checksum of the decimal doc_id.  If it ends in 0, the rest g gives the word a from
    which the text repeats its next p words.  Other texts, and those of null doc_ids, stay.
    """
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not text or not (words := text.encode().split()):
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join([*words[:a], *(words[a + i % p] for i in range(n - a))]).decode()


def with_echoes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``echoed`` texts."""

    @F.arrow_udf("string")
    def echo(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array(map(echoed, ids.to_pylist(), texts.to_pylist()), pa.string())

    return docs.withColumn("text", echo(F.col("doc_id"), F.col("text")))


def describe_runs(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """doc_id, n_runs, the greatest run, and digests of all runs and of the collapsed text."""
    name = fresh(docs, "periodic")
    runs, best = F.col(name)["runs"], F.col("best")
    line = lambda r: F.concat(*(x for f in ("start", "length", "period") for x in (r[f].cast("string"), F.lit("\n" if f == "period" else ","))))
    return with_runs(docs, name, least, periods).withColumn("best", greatest_run(runs)).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(F.array_join(F.transform(runs, line), ""), 256).alias("runs_sha256"), F.sha2(F.col(name)["collapsed"], 256).alias("collapsed_sha256"),
    )


RUN_SQL = r"""
WITH h AS (
  SELECT doc_id, text, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(
           flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for c in string_split(CAST(doc_id AS VARCHAR), '')]),
           lambda s, x: xor(xor(s, x) >> 1, CASE WHEN xor(s, x) % 2 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT)) END AS h
  FROM documents
), d AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS v, coalesce(h % 10 = 0, false) AS echoes, h // 10 AS g FROM h
), p AS (
  SELECT *, len(v) AS n, CASE WHEN echoes AND len(v) > 0 THEN g % len(v) ELSE len(v) END AS a, CASE WHEN echoes AND len(v) > 0 THEN 1 + (len(v) - g % len(v)) // (3 + g % 8) ELSE 1 END AS p FROM d
), w AS (
  SELECT d, doc_id, n, [v[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] for i in range(n)] AS w FROM p
), grams AS (
  SELECT d, n, i, list_aggregate(w[i + 1 : i + 8], 'string_agg', ' ') AS gram FROM (SELECT *, unnest(range(n - 7)) AS i FROM w WHERE n >= 24)
), pairs AS (
  SELECT x.d, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.d = y.d AND x.gram = y.gram AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT d, q, min(i) AS s, count(*) + 7 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS island FROM pairs) GROUP BY d, q, island
), long AS (
  SELECT * FROM stretches WHERE l >= 24 AND l >= 3 * q
), runs AS (
  SELECT * FROM long r WHERE NOT EXISTS (SELECT 1 FROM long o WHERE o.d = r.d AND o.q < r.q AND o.s <= r.s AND o.s + o.l >= r.s + r.l)
), best AS (
  SELECT d, s, l, q FROM runs QUALIFY row_number() OVER (PARTITION BY d ORDER BY l::DOUBLE / q DESC, s, q) = 1
), listed AS (
  SELECT d, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM runs GROUP BY d
), dropped AS (
  SELECT DISTINCT d, unnest(range(s + q, s + l)) AS i FROM runs
), kept AS (
  SELECT w.d, string_agg(w.w[i + 1], ' ' ORDER BY i) AS text FROM (SELECT d, w, unnest(range(n)) AS i FROM w) w ANTI JOIN dropped USING (d, i) GROUP BY w.d
)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
       sha256(coalesce(listed.runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM w LEFT JOIN listed USING (d) LEFT JOIN best USING (d) LEFT JOIN kept USING (d)
"""
