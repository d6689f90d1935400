"""Substring dedup by line or paragraph hashing.

Texts are cut into units (lines, the sentences of lines, or paragraphs at blank lines), each with
its place in the original text.  Units are normalised and hashed to 128 bits; digests are grouped
over the whole corpus, first on the map side, so a line that a third of all texts share costs
each task one row.  The earliest occurrence (by doc_id, then text digest, then place) is kept;
all others are removed.  Every occurrence of a repeated unit is reported with its original offsets.

A passage that was copied into the middle of a line makes no equal lines, but its sentences are
equal; a single short sentence recurs by chance, a run of them does not.  ``PASSAGES`` are the
parameters for that: sentences, of which repeated ones count where neighbours that are repeated
too make up enough words with them.

Defined results: null and empty texts have no units; rows equal in doc_id and text are one
document; a null doc_id ranks last; a very long text is cut as a whole, by one task, into as
many rows as it has units.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import free, fresh, join_groups, settle, text_digest

#: What ends a unit.
SEPARATORS = {"line": re.compile(r"\n"), "sentence": re.compile(r"\n|\x1F|(?<=[.!?]) "), "paragraph": re.compile(r"\n[ \t]*\n\s*")}
#: Units of fewer words are left alone: short lines recur by chance (headings, greetings, notices)
#: and say nothing about copying.  13 words is the length from which an overlap counts in
#: decontamination as well; a passage of over 50 words in longer lines is found at any such floor.
LEAST_WORDS = 13
#: Passages of over 50 words: a copy cut at both ends within sentences still leaves half of the
#: words in whole ones.  Sentences of fewer than five words are passed over and end no run.
PASSAGES = {"unit": "sentence", "least_words": 5, "least_run": 25}
_UNIT = "struct<start: bigint, end: bigint, words: bigint, a: bigint, b: bigint>"


def units_of(text: str | None, unit: str = "line", least_words: int = LEAST_WORDS) -> list[tuple[int, int, int, int, int]]:
    """(start, end, words, digest in two halves) of each unit; offsets are code points."""
    out, at, text = [], 0, text or ""
    for end, after in [*((m.start(), m.end()) for m in SEPARATORS[unit].finditer(text)), (len(text), len(text))]:
        words = text[at:end].lower().split()
        if len(words) >= least_words:
            digest = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            out.append((at, end, len(words), int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)))
        at = after
    return out


def cut_units(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, digest t of the text, then number n, start, end, words, a and b of each unit.

    Lower case and equal white space make units equal.  Null and empty texts have none.
    """

    @F.arrow_udf(f"array<{_UNIT}>")
    def cut(texts: pa.Array) -> pa.Array:
        found = [units_of(t.as_py(), unit, least_words) for t in texts]
        flat = list(zip(*(u for units in found for u in units))) or [[]] * 5
        offsets = [0]
        for units in found:
            offsets.append(offsets[-1] + len(units))
        rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], ["start", "end", "words", "a", "b"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return docs.select("doc_id", text_digest(F.col("text")).alias("t"), F.posexplode(cut(F.col("text"))).alias("n", "u")).select("doc_id", "t", "n", "u.*")


def _rank(doc_id: Column) -> Column:
    """Order of occurrences: doc_id (null last), text digest, place."""
    return F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), F.col("t").alias("t"), F.col("start").alias("start"))


def _with_runs(found: DataFrame) -> DataFrame:
    """Repeated units with the words of the run of consecutive ones that they stand in."""
    text = Window.partitionBy("doc_id", "t")
    runs = found.withColumn("run", F.col("n") - F.row_number().over(text.orderBy("n")))
    return runs.withColumn("run_words", F.sum("words").over(Window.partitionBy("doc_id", "t", "run")))


def repeated_units(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS, least_run: int = 0) -> DataFrame:
    """One row for each occurrence of a unit that occurs more than once.

    With ``least_run``, only occurrences in runs of consecutive repeated units of so many words
    are reported; the earliest of all occurrences is kept even if it stands in no such run.

    doc_id, t, start, end, words, run_words, kept (the earliest occurrence, which stays),
    kept_doc_id, kept_start and copies.  ``start`` and ``end`` are places in the original text;
    ``run_words`` are the words of the run that the unit stands in, by which a reader may draw the
    line elsewhere; ``copies`` counts all occurrences.  Rows equal in doc_id and text get one set of rows.
    """
    units = settle(cut_units(docs, unit, least_words).dropDuplicates(["doc_id", "t", "start"]))
    groups = settle(units.groupBy("a", "b").agg(F.min(_rank(F.col("doc_id"))).alias("first"), F.count("*").alias("copies")).where("copies > 1"))
    found = join_groups(units, groups, ["a", "b"], "copies")
    return _with_runs(found).where(F.col("run_words") >= least_run).select(
        "doc_id", "t", "start", "end", "words", "run_words", _rank(F.col("doc_id")).eqNullSafe(F.col("first")).alias("kept"), F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"), "copies"
    )


def remove_repeated_units(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS, removed: str = "removed_spans", least_run: int = 0) -> DataFrame:
    """``docs`` with repeated units cut from ``text`` and their original offsets in column ``removed``.

    What separates units stays only between kept ones; a text without repeats stays as it is,
    a null text null.  Other columns pass through; ``removed`` must not be one of them.
    """
    free(docs, removed)
    spans = repeated_units(docs, unit, least_words, least_run).where("not kept").groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([cut_spans(t, s, SEPARATORS[unit]) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    key, found = fresh(docs, "text_key"), fresh(docs, "found_spans")
    s = spans.select(F.struct("doc_id", "t", "spans").alias(found))
    mine = docs.withColumn(key, text_digest(F.col("text")))
    joined = mine.join(s, mine["doc_id"].eqNullSafe(s[found]["doc_id"]) & (mine[key] == s[found]["t"]), "left")
    cut = F.col(found)["spans"]
    return joined.select(*(c for c in docs.columns if c != "text"), without(F.col("text"), cut).alias("text"), F.coalesce(cut, F.array().cast("array<struct<start: bigint, end: bigint>>")).alias(removed))


def cut_spans(text: str | None, spans: list[dict] | None, separator: re.Pattern) -> str | None:
    if not text or not spans:
        return text
    gone, kept, at = {s["start"] for s in spans}, [], 0
    for end, after in [*((m.start(), m.end()) for m in separator.finditer(text)), (len(text), len(text))]:
        if at not in gone:
            kept.append((text[at:end], text[end:after]))
        elif kept and kept[-1][1] == " ":  # the end of a line stays where its last sentence goes
            kept[-1] = (kept[-1][0], text[end:after])
        at = after
    return "".join(body + (gap if i + 1 < len(kept) else "") for i, (body, gap) in enumerate(kept))


UNIT_SQL = r"""
WITH d AS (
  SELECT doc_id, md5(text) AS t, string_split(replace(regexp_replace(text, '([.!?]) ', '\1' || chr(31), 'g'), chr(10), chr(31)), chr(31)) AS bodies
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text <> '')
), l AS (
  SELECT doc_id, t, generate_subscripts(bodies, 1) AS i, unnest(bodies) AS body FROM d
), u AS (
  SELECT doc_id, t, CAST(sum(length(body) + 1) OVER (PARTITION BY doc_id, t ORDER BY i) - length(body) - 1 AS BIGINT) AS start, length(body) AS size,
         trim(regexp_replace(lower(body), '[\s\x0B]+', ' ', 'g')) AS unit
  FROM l
), w AS (
  SELECT doc_id, t, start, start + size AS "end", unit, CAST(length(regexp_replace(unit, '[^ ]', '', 'g')) + 1 AS BIGINT) AS words FROM u WHERE unit <> ''
), n AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY start) AS n FROM w WHERE words >= 5
), r AS (
  SELECT *, row_number() OVER same AS place, first_value(doc_id) OVER same AS kept_doc_id, first_value(start) OVER same AS kept_start, count(*) OVER (PARTITION BY unit) AS copies
  FROM n WINDOW same AS (PARTITION BY unit ORDER BY doc_id NULLS LAST, t, start)
), runs AS (
  SELECT *, n - row_number() OVER (PARTITION BY doc_id, t ORDER BY n) AS run FROM r WHERE copies > 1
), sized AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id, t, run) AS run_words FROM runs
)
SELECT doc_id, start, "end", words, CAST(run_words AS BIGINT) AS run_words, place = 1 AS kept, kept_doc_id, kept_start, copies FROM sized WHERE run_words >= 25
"""
