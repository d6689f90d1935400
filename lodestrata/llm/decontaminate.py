"""Benchmark decontamination by spaced-seed hashing, with built-in functions only.

A mask names the positions of a window that count; the others may hold any word.  Every place
of every text gives one hash for each mask; the hashes of the benchmark's places are joined
with them.  A hit names a benchmark item and a shift between it and the text; text and item are
then laid over each other at that shift and compared word by word.

The positions that all masks share are hashed first and looked up in a bitmap of the benchmark's
places; only places that it may hold get the masks' own hashes, and only these are joined.

The two masks are chosen so that a window of ``OVERLAP`` words with ``SUBSTITUTED`` of them
substituted always holds one of them untouched (the test goes through all such windows).
Items of 7 to 9 words may have one word substituted, which can spoil every place of both masks;
they get masks that leave out one of their words each.

Defined results: null and empty texts and items overlap with nothing; equal texts are searched
once; equal items count for each of their ids; a null item_id is an id like any other; a very
long text gives a row a place only where the bitmap may hold it, and is laid over an item as a
whole, by one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.bitmap import bitmap, may_hold
from lodestrata.llm.common import fresh, settle, text_digest

WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Positions that count.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
#: Lengths of items that may have a word substituted where no place of a mask stays untouched.
LOOSE = (7, 8, 9)
#: Words of an overlap that counts, and how many of them may be substituted.
OVERLAP, SUBSTITUTED = 13, 2
#: Rows of the benchmark's hashes up to which they are broadcast; beyond, both sides are shuffled.
MOST_BROADCAST = 500_000


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but ASCII white space, lower-cased.  Null: none."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(WHITE_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def seed_hash(words: str, place: str, k: int, mask: tuple[int, ...]) -> Column:
    """The hash that mask ``k`` gives at a place; null where the mask reaches beyond the last word."""
    inside = F.col(place) + mask[-1] < F.size(words)
    return F.when(inside, F.xxhash64(F.lit(k), *(F.get(words, F.col(place) + p) for p in mask)))


def loose_masks(length: int) -> list[tuple[int, ...]]:
    """Masks of which an item of ``length`` words keeps one untouched if any word is substituted.

    The first leaves out the last word, or the first word where it lies one place later.
    """
    return [tuple(range(length - 1)), *(tuple(i for i in range(length) if i != p) for p in range(1, length - 1))]


def seed_places(texts: DataFrame, words: str, masks: list[tuple[int, ...]], sieve: tuple[list[tuple[int, ...]], Column] | None = None, only: list[int | None] | None = None) -> DataFrame:
    """A row (place, h) for each place and mask of each text, beside its other columns.

    ``only``: for each mask, the number of words of the texts that it is for; None: of all.
    ``sieve``: masks that count less, and a bitmap of their hashes.  Places of which it holds
    none give no rows.
    """
    others = [c for c in texts.columns if c != words]
    last = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    places = texts.select(*others, words, F.explode(last).alias("place"))
    mine = lambda k, h: h if only is None or only[k] is None else F.when(F.size(words) == only[k], h)
    hashes = lambda of: [mine(k, seed_hash(words, "place", k, m)) for k, m in enumerate(of)]
    if sieve:
        places = places.where(reduce(lambda x, y: x | y, (may_hold(sieve[1], h) for h in hashes(sieve[0]))))
    return places.select(*others, "place", F.explode(F.array(*hashes(masks))).alias("h")).where("h is not null")


def _needed(length: Column) -> Column:
    """Words that must agree in an overlap of ``length`` words."""
    return length - F.floor(length * SUBSTITUTED / OVERLAP)


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """t (digest of the text), item_id, item_words, first_word, agreeing: each item that a text holds.

    An overlap is ``OVERLAP`` consecutive words of the item (all, if it has fewer) of which at
    most two in thirteen are substituted in the text.  Of several, the one with most agreeing
    words, then the first, is reported; ``first_word`` is its place in the text, from 0.  Items
    of fewer than seven words must occur word by word, as two in thirteen are none of these.  Null or empty texts and items
    overlap with nothing.  Equal texts are one t, equal items one row for each item_id.
    """
    items = settle(
        benchmark.select("item_id", words_of(F.col("text")).alias("item")).where("size(item) > 0").distinct()
        .select("item_id", "item", F.size("item").alias("item_words"), F.xxhash64("item").alias("key"))
    )
    # masks for each short length that the benchmark has: nine lengths at most
    short = sorted(r[0] for r in items.where(F.col("item_words") <= max(LOOSE)).select("item_words").distinct().collect())
    whole = [tuple(range(n)) for n in short if n < min(LOOSE)]
    loose = [(n, m) for n in short if n in LOOSE for m in loose_masks(n)]
    # with one word substituted, one half of an item is untouched
    halves = [(n, tuple(h)) for n in short if n in LOOSE for h in (range(n // 2), range(n // 2, n))]
    masks, coarse = [*MASKS, *whole, *(m for _, m in loose)], [tuple(sorted(set.intersection(*map(set, MASKS)))), *whole, *(h for _, h in halves)]
    masks_for, coarse_for = ([None] * (len(of) - len(more)) + [n for n, _ in more] for of, more in ((masks, loose), (coarse, halves)))
    one_each = items.dropDuplicates(["key", "item"]).select("key", "item")
    seeds = settle(seed_places(one_each, "item", masks, only=masks_for).withColumnRenamed("place", "item_place").distinct())
    sieve = settle(seed_places(one_each, "item", coarse, only=coarse_for).select("h").distinct())
    few = seeds.count() <= MOST_BROADCAST
    texts = docs.select(text_digest(F.col("text")).alias("t"), words_of(F.col("text")).alias("words"))
    places = seed_places(texts, "words", masks, (coarse, bitmap(sieve)))
    hits = places.join(F.broadcast(seeds) if few else seeds, "h")
    hits = settle(hits.select("t", "key", (F.col("place") - F.col("item_place")).alias("shift")).distinct())

    # texts with hits, one of each digest, beside the items they may hold
    mine = text_digest(F.col("text"))
    found = bitmap(hits.select(F.col("t.a").alias("h")))
    texts = docs.where(may_hold(found, mine["a"])).select(mine.alias("t"), words_of(F.col("text")).alias("words"))
    # a text's words are brought to each item once, whatever the number of shifts
    shifts = hits.groupBy("t", "key").agg(F.collect_list("shift").alias("shifts"))
    laid = shifts.join(items, "key").join(texts.dropDuplicates(["t"]), "t").withColumn("shift", F.explode("shifts"))
    same = F.transform("item", lambda w, j: F.when(F.get("words", j + F.col("shift")) == w, 1).otherwise(0))
    length = F.least(F.lit(OVERLAP), F.col("item_words"))
    at = F.sequence(F.lit(0), F.col("item_words") - length)
    sums = F.transform(at, lambda i: F.struct(F.aggregate(F.slice("same", i + 1, length), F.lit(0), lambda s, x: s + x).alias("agreeing"), (-(i + F.col("shift"))).alias("back")))
    best = laid.select("t", "item_id", "item_words", "shift", length.alias("length"), same.alias("same")).select("t", "item_id", "item_words", "length", F.array_max(sums.alias("s")).alias("best"))
    return (
        best.where(F.col("best.agreeing") >= _needed(F.col("length"))).groupBy("t", "item_id").agg(F.max("item_words").alias("item_words"), F.max("best").alias("best"))
        .select("t", "item_id", "item_words", (-F.col("best.back")).cast("long").alias("first_word"), F.col("best.agreeing").cast("long").alias("agreeing"))
    )


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id beside each overlap of its text; rows equal in doc_id and text count once."""
    overlaps = find_overlaps(docs, benchmark)
    ids = docs.select("doc_id", text_digest(F.col("text")).alias("t"))
    return ids.join(overlaps, "t").dropDuplicates(["doc_id", "t", "item_id"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns as they are."""
    key, leaked = fresh(docs, "text_key"), fresh(docs, "leaked_text")
    gone = find_overlaps(docs, benchmark).select(F.col("t").alias(leaked)).distinct()
    return docs.withColumn(key, text_digest(F.col("text"))).join(gone, F.col(key) == F.col(leaked), "left_anti").select(*docs.columns)
