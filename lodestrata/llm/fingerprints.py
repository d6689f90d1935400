"""Document fingerprints by winnowing, with built-in functions only.

A text is folded to lower case and cut into tokens: words, the longer ones in pieces of
``PIECE`` code points.  Every place has the hash of its ``gram`` consecutive tokens; of each
``window`` consecutive places the one with the least hash is chosen, of equal ones the
rightmost.  Chosen hashes are kept with their places.  Any ``gram + window - 1`` consecutive
tokens that two texts share give both a common hash; no run of fewer than ``gram`` tokens does.

Hashing and choosing stay in the row of the text, so nothing is shuffled for them.  To compare
each document with the one after it, only what the other needs travels: the beginning that its
edit takes over, and its chosen hashes.

Defined results: null and empty texts, and those of white space only, have no hashes; texts of
fewer than ``gram`` tokens have one, of all their tokens; two texts without hashes have the
likeness 1, with only one of them the likeness 0.  Equal texts have equal fingerprints, and so
have texts that differ in case or white space only.  Rows equal in doc_id and text are one
document, of which each row gets the same values; a null doc_id ranks last, equal ids rank by
text digest; a single document is its own next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import free, settle

#: Code points of the longest token; tokens of a gram; grams of a window.
PIECE, GRAM, WINDOW = 8, 5, 6


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(n: Column, span: int) -> Column:
    """0, 1, ... for each of the ``span`` consecutive items of ``n``; one place if there are fewer."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - span, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW, piece: int = PIECE) -> Column:
    """array<struct<hash: bigint, place: int>> of the chosen places, in text order."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % piece), F.lit(0))
    hashes = F.transform(tokens, lambda x: F.xxhash64(x))
    # what lies beyond the end is null, which a hash and a minimum pass over
    grams = lambda h: F.transform(_places(F.size(h), gram), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(gram))))

    def rightmost(g: Column, i: Column) -> Column:
        every = [F.get(g, i + k) for k in range(window)]
        return bound(F.least(*every) if window > 1 else every[0], lambda m: F.coalesce(*(F.when(every[k] == m, i + k) for k in reversed(range(window)))))

    chosen = lambda g: F.array_distinct(F.transform(_places(F.size(g), window), lambda i: rightmost(g, i)))
    return bound(bound(hashes, grams), lambda g: F.transform(chosen(g), lambda p: F.struct(F.get(g, p).alias("hash"), p.alias("place"))))


def hash_set(marks: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(marks["hash"])


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets: 1 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def digest(marks: Column) -> Column:
    """A fingerprint as a short string: how many hashes, and 128 bits of all in order; places do not count."""
    h = marks["hash"]
    return F.concat(F.size(h).cast("string"), F.lit("-"), *(F.lower(F.lpad(F.hex(x), 16, "0")) for x in (F.xxhash64(h), F.xxhash64(F.lit(7), h))))


def with_fingerprints(docs: DataFrame, into: str = "fingerprint", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add the fingerprint of ``text`` as column ``into``, which must be free; other columns pass through."""
    return docs.withColumn(free(docs, into), fingerprint(F.col("text"), gram, window))


def _key() -> tuple[Column, Column]:
    """128 bits that stand for (doc_id, text)."""
    return F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(7), F.col("doc_id"), F.col("text")).alias("b")


def followers(docs: DataFrame) -> DataFrame:
    """a, b of each distinct document, to_a and to_b of the one before it in descending doc_id, its n_chars and copies.

    The first document follows the last.  Documents are range-sorted by id alone; a place counts
    within its part, and the counts of parts (a row each) give each part's offset.
    """
    ids = settle(docs.select("doc_id", *_key(), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")).groupBy("doc_id", "a", "b").agg(F.first("n_chars").alias("n_chars"), F.count("*").alias("copies")))
    placed = settle(ids.orderBy(F.desc_nulls_last("doc_id"), "a", "b").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    offsets = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("offset", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    total = placed.count()
    dense = placed.withColumn("part", part).join(F.broadcast(offsets.select("part", "offset")), "part")  # a row for each part of the sort
    dense = dense.select("a", "b", "n_chars", "copies", (F.col("offset") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("at"))
    before = dense.select(F.col("a").alias("to_a"), F.col("b").alias("to_b"), "n_chars", "copies", F.pmod(F.col("at") + 1, F.lit(max(total, 1))).alias("at"))
    return dense.select("a", "b", "at").join(before, "at").drop("at")


def edited_with_next(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text, n_chars, edited, next_doc_id, next_hashes, copies.

    ``edited`` is the text whose last third (rounded down, in code points) is replaced by as many
    code points from the beginning of the next document, or all that it has.  Texts are shuffled
    once: both joins read the same exchange.  ``copies`` counts the rows that this one stands for.
    """
    whole = docs.select("doc_id", "text", *_key()).groupBy("a", "b").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    sent = whole.join(followers(docs), ["a", "b"]).select(
        F.col("to_a").alias("a"), F.col("to_b").alias("b"), "n_chars", "copies", F.col("doc_id").alias("next_doc_id"), F.substr(F.coalesce("text", F.lit("")), F.lit(1), third).alias("begin"),
        hash_set(fingerprint(F.col("text"), gram, window)).alias("next_hashes"),
    )
    edited = F.concat(F.substr(F.coalesce("text", F.lit("")), F.lit(1), F.col("n_chars") - third), F.col("begin"))
    return whole.join(sent, ["a", "b"]).select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"), edited.alias("edited"), "next_doc_id", "next_hashes", "copies")


def compare_with_next(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id.

    How like each text's fingerprint is to that of its edited text and to the next document's.
    """
    both = edited_with_next(docs, gram, window).withColumns({"mine": fingerprint(F.col("text"), gram, window), "other": fingerprint(F.col("edited"), gram, window)})
    sets = both.select("*", hash_set(F.col("mine")).alias("my_hashes"))
    rows = sets.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("mine")).alias("fingerprint"), digest(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("my_hashes"), hash_set(F.col("other"))).alias("near_edited"), likeness(F.col("my_hashes"), F.col("next_hashes")).alias("near_next"), "next_doc_id", F.array_repeat(F.lit(0), F.col("copies").cast("int")).alias("rows"),
    )
    return rows.withColumn("rows", F.explode("rows")).drop("rows")


EDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER w AS after, first_value(coalesce(text, '')) OVER w AS top, lead(doc_id) OVER w AS after_id, first_value(doc_id) OVER w AS top_id, row_number() OVER w = count(*) OVER () AS is_last
  FROM documents WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)
), e AS (
  SELECT doc_id, CASE WHEN is_last THEN top_id ELSE after_id END AS next_doc_id, CAST(length(text) AS BIGINT) AS n_chars,
         left(text, CAST(length(text) - length(text) // 3 AS BIGINT)) || left(CASE WHEN is_last THEN top ELSE after END, CAST(length(text) // 3 AS BIGINT)) AS edited
  FROM d
)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, next_doc_id FROM e
"""
