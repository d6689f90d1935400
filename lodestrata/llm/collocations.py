"""Phrase collocations from suffix automata of bounded depth, one for each shard of texts.

A shard's automaton is built level by level over its word sequences (texts cut into pieces).  The
root stands at every place; a state and a word lead to a state one word deeper, and each state
has a suffix link to that of the same run without its first word.  A state's endpos count is the
number of places where its run ends.  A run whose only continuation to the left has as many
places as itself belongs to that state: what is enumerated is each state's longest run with the
lengths of its suffixes that share its count.

Counts of runs are summed over all shards in two passes.  The first knows runs by 64-bit hashes
and tells which are frequent; sums that mix colliding hashes can only be too large.  The second
counts the words themselves, of runs whose two halves (the run without its last and without its
first word) are frequent.  What is not frequent as a whole has no frequent longer run, so nothing
that counts is lost.  The table of frequent hashes reaches the tasks as a bitmap of fixed size;
when it is full, more rows are shuffled, at most a row for each run of a shard, and results stay
the same.

Candidates are scored by their worst cut into two parts, and those that stand mostly within a
longer candidate, which its suffix link or its beginning shows, are dropped.

Defined results: null and empty texts have no words; a null lang is ``und``; repeated rows count
as often as they stand; no phrase crosses a piece; a text of any length is cut into blocks whose
phrases all count once.  Equal scores rank by count, then by the phrase's UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import kernels
from lodestrata.llm.bitmap import bitmap
from lodestrata.llm.common import settle

#: Words of the longest phrase, places of a candidate, share of places (of 100) that a longer one takes, phrases of a lang.
DEEPEST, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Bytes that end pieces; the others but space and tab are parts of words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Bytes of text and words of one automaton.
SHARD, BLOCK_WORDS = 2 << 20, 1 << 18

_WORD_BYTES = np.arange(256, dtype=np.uint16)
_WORD_BYTES[0] = 256
_WORD_BYTES[65:91] += 32
_WORD_BYTES[[0x20, 0x09, *PIECE_ENDS]] = 0
_ENDS = np.zeros(256, np.int8)
_ENDS[list(PIECE_ENDS)] = 1


class Automaton:
    """All runs of up to ``deepest`` words of some word sequences, with their places counted.

    words: the number of each word, in order; left: how many words its piece has from there on.
    Places that end before word ``begin`` are there for later runs only and do not count.  Of
    each level d (runs of d + 1 words): ``state`` of each place, -1 where there is none, and of
    each state ``count`` (endpos), ``first`` (a place) and ``link`` (the state of its suffix).
    ``wanted`` tells of which states of a level longer runs are built.
    """

    def __init__(self, words: np.ndarray, left: np.ndarray, deepest: int, begin: int = 0, wanted: Callable[[Automaton, int], np.ndarray] | None = None):
        self.state, self.count, self.first, self.link, self.wanted = [], [], [], [], []
        self.begin = begin
        n = len(words)
        self._level(n, np.arange(n), words)
        for d in range(1, deepest):
            self.wanted.append(np.ones(len(self.count[-1]), bool) if wanted is None else wanted(self, d - 1))
            before = self.state[-1]
            at = np.flatnonzero(left > d)
            at = at[(before[at] >= 0) & (before[at + 1] >= 0)]
            at = at[self.wanted[-1][before[at]] & self.wanted[-1][before[at + 1]]]
            # a transition: the state of a run and the next word
            self._level(n, at, before[at] * (int(words.max(initial=0)) + 1) + words[at + d])
        self.wanted.append(np.ones(len(self.count[-1]), bool))

    def _level(self, n: int, at: np.ndarray, transitions: np.ndarray) -> None:
        _, first, state = np.unique(transitions, return_index=True, return_inverse=True)
        every = np.full(n, -1, np.int64)
        every[at] = state
        self.link.append(self.state[-1][at[first] + 1] if self.state else np.zeros(len(first), np.int64))
        self.state.append(every), self.first.append(at[first])
        self.count.append(np.bincount(state[at + len(self.count) >= self.begin], minlength=len(first)))

    def hashes(self, d: int, words: np.ndarray) -> np.ndarray:
        """A hash of each run of level d, from the hashes of all words; the same in every shard."""
        h = words[self.first[d]]
        with np.errstate(over="ignore"):
            for k in range(1, d + 1):
                h = kernels.mix(h * np.uint64(0x9E3779B97F4A7C15) + words[self.first[d] + k])
        return h.view(np.int64)

    def states(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, states, words of the shortest run) of those that are enumerated.

        A run that has as many places as a wanted one with a word more before it is enumerated there.
        """
        shortest, out = np.ones(len(self.count[0]), np.int64), []
        for d, count in enumerate(self.count):
            there = self.wanted[d] & (count > 0)
            if d + 1 < len(self.count):
                link = self.link[d + 1]
                same = self.wanted[d + 1] & (self.count[d + 1] == self.count[d][link])
                there[link[same]] = False
            out.append((d, np.flatnonzero(there), shortest[there]))
            if d + 1 < len(self.count):
                shortest = np.where(same, shortest[link], d + 2)
        return iter(out)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(langs, texts) of consecutive rows, about ``SHARD`` bytes of text each, one row at least."""
    held, size = [], 0
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1).cast(pa.large_string())
        for first, part in kernels.batches(texts, SHARD):
            held.append((langs.slice(first, len(part)), part))
            ends = kernels.buffers(part)[1]
            size += int(ends[-1] - ends[0])
            if size >= SHARD:
                yield pa.concat_arrays([x for x, _ in held]), pa.concat_arrays([x for _, x in held])
                held, size = [], 0
    if held:
        yield pa.concat_arrays([x for x, _ in held]), pa.concat_arrays([x for _, x in held])


class Block:
    """Words of a shard: lang number, start, end, hash (which tells langs apart) and words left in the piece."""

    def __init__(self, lang, start, end, hashes, left, begin):
        self.lang, self.start, self.end, self.hashes, self.begin = lang, start, end, hashes, begin
        self.left = np.minimum(left, len(left) - np.arange(len(left)))
        _, self.words = np.unique(hashes, return_inverse=True)


def _blocks(names: list[str], code: np.ndarray, texts: pa.Array, deepest: int) -> Iterator[Block]:
    """The words of a shard in blocks; each begins with the words before it that its runs can need."""
    data, offsets = kernels.buffers(texts)
    d, s, e, h, _ = kernels.words(texts, _WORD_BYTES)
    if not len(s):
        return
    low = int(offsets[0])
    ends = np.cumsum(_ENDS[data[low : int(offsets[-1])]], dtype=np.int64)[s - low]
    of_lang = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
    h = kernels.mix(h ^ of_lang[code[d]])
    last = np.ones(len(s), bool)
    last[:-1] = (ends[1:] != ends[:-1]) | (d[1:] != d[:-1])
    stops = np.flatnonzero(last)
    left = np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(len(s)) + 1
    for at in range(0, len(s), BLOCK_WORDS):
        begin = max(0, at - deepest + 1)
        some = slice(begin, min(len(s), at + BLOCK_WORDS))
        yield Block(code[d[some]], s[some], e[some], h[some], left[some], at - begin)


def _coded(langs: pa.Array) -> tuple[list[str], np.ndarray]:
    codes = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
    return codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)


def frequent_hashes(docs: DataFrame, deepest: int = DEEPEST, least: int = LEAST) -> DataFrame:
    """hash: of every run of fewer than ``deepest`` words that stands at ``least`` places of a lang or more (and of few others)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _shards(batches):
            for block in _blocks(*_coded(langs), texts, deepest - 1):
                automaton = Automaton(block.words, block.left, deepest - 1, block.begin)
                for d in range(deepest - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(automaton.hashes(d, block.hashes)), pa.array(automaton.count[d])], ["hash", "n"])

    return docs.select("lang", "text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("hash")


def phrase_counts(docs: DataFrame, deepest: int = DEEPEST, least: int = LEAST) -> DataFrame:
    """lang, phrase (words joined by a space) and n, its places, of all phrases of up to ``deepest`` words with ``least`` places.

    The empty phrase is there for each lang with words: it stands at every word.
    """
    frequent = settle(frequent_hashes(docs, deepest, least))
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(np.array(spark.range(1).select(bitmap(frequent).alias("bits")).first()["bits"], np.int64))  # of fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words64 = bits.value.view(np.uint64)

        def held(h: np.ndarray) -> np.ndarray:
            bit = h % np.int64(64 * len(words64))
            return (words64[bit // 64] >> (bit % 64).astype(np.uint64)) & np.uint64(1) == 1

        for langs, texts in _shards(batches):
            names, code = _coded(langs)
            for block in _blocks(names, code, texts, deepest):
                automaton = Automaton(block.words, block.left, deepest, block.begin, lambda a, d, block=block: held(a.hashes(d, block.hashes)))
                spelled = _spelled(texts, block, automaton.first[0])
                lang_names = pa.array(names, pa.string())
                for d, states, shortest in automaton.states():
                    at = automaton.first[d][states]
                    parts = [spelled.take(pa.array(block.words[at + k])) for k in range(d + 1)]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if d else parts[0]
                    yield _rows(lang_names.take(pa.array(block.lang[at])), phrase, d + 1, shortest, automaton.count[d][states])
                places = np.bincount(block.lang[block.begin :], minlength=len(names))
                yield _rows(lang_names, pa.array([""] * len(names), pa.string()), 0, np.zeros(len(names), np.int64), places)

    rows = docs.select("lang", "text").mapInArrow(count, "lang string, phrase string, words int, shortest int, n long").where("n > 0")
    # a state's run and those suffixes that share its places
    runs = rows.select("lang", "phrase", "n", F.explode(F.sequence("shortest", "words")).alias("k"))
    return runs.groupBy("lang", F.call_function("substring_index", F.col("phrase"), F.lit(" "), -F.col("k")).alias("phrase")).agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))


def _spelled(texts: pa.Array, block: Block, first: np.ndarray) -> pa.Array:
    """The folded words by number."""
    data, _ = kernels.buffers(texts)
    start, size = block.start[first], block.end[first] - block.start[first]
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    flat = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(_WORD_BYTES[data[flat]].astype(np.uint8)))


def _rows(lang: pa.Array, phrase: pa.Array, words: int, shortest: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [lang, phrase.cast(pa.string()), pa.array(np.full(len(n), words, np.int32)), pa.array(shortest.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "phrase", "words", "shortest", "n"]
    )


def scored_phrases(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every phrase of two words or more: by its worst cut, of equals the first.

    Scores are whole millionths; products are decimals of 38 digits.
    """
    sized = counts.where("phrase != ''").withColumn("words", F.size(F.split("phrase", " ")))
    cuts = sized.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("k")).alias("left"), F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("k") - F.col("words")).alias("right"))
    half = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(half("left", "l"), ["lang", "left"]).join(half("right", "r"), ["lang", "right"])
    exact = both.withColumn("score", F.expr("cast(1000000 as decimal(38, 0)) * cast(a as decimal(38, 0)) * cast(a as decimal(38, 0)) div (cast(l as decimal(38, 0)) * cast(r as decimal(38, 0)))"))
    worst = exact.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "words")).alias("x"))
    return worst.select("lang", "phrase", "x.words", "x.a", "x.l", "x.r", "x.score")


def within_longer(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase of those that have ``share`` of 100 of their places or more within one longer phrase of ``phrases``.

    The longer one's beginnings and its suffix links' beginnings are the phrases within it.
    """
    w, size = F.split("phrase", " "), F.col("words")
    lengths = F.sequence(F.lit(2), size - 1)
    parts = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))))
    inner = phrases.where("words > 2").select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(inner, ["lang", "phrase"]).where(F.expr(f"cast(100 as decimal(38, 0)) * longer >= cast({share} as decimal(38, 0)) * a")).select("lang", "phrase")


def collocations(docs: DataFrame, deepest: int = DEEPEST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's ``top`` collocations of 2 to ``deepest`` words.

    a, l and r are the places of the phrase and of the two parts of its worst cut, n the words of
    the lang.  Each lang is ranked in many parts first, of which ``top`` rows each meet.
    """
    counts = settle(phrase_counts(docs, deepest, least))
    phrases = settle(scored_phrases(counts))
    kept = phrases.join(within_longer(phrases, share), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counts.where("phrase = ''").select("lang", "n")
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATION_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d
), u AS (
  SELECT lang, piece, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM (SELECT lang, w, row_number() OVER () AS piece FROM p)
), l AS (
  SELECT lang, x, lead(x) OVER q AS y, lead(x, 2) OVER q AS z FROM u WINDOW q AS (PARTITION BY piece ORDER BY i)
), g AS (
  SELECT lang, 1 AS words, x AS phrase FROM l UNION ALL SELECT lang, 2, x || ' ' || y FROM l WHERE y IS NOT NULL UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM l WHERE z IS NOT NULL
), f AS (
  SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang
), c AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 10
), cuts AS (
  SELECT c.*, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : words], ' ') AS tail FROM c, (VALUES (1), (2)) AS v(k) WHERE k < words
), scored AS (
  SELECT cuts.lang, cuts.words, cuts.phrase, a, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, a FROM c WHERE words = 3 UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM c WHERE words = 3
), kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.a >= 50 * s.a)
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""
