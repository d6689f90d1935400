"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every document gets a hash-random key.  Within a source, documents lie in key order; the key
space is range-split into ``ranges`` equal parts (keys are uniform, so a hot source is dealt
out evenly), each part sums its sizes, the parts' totals give each part its offset, and a
part's own window gives each document the words before it.  The last epoch is cut where the
running sum meets the source's exact budget; the document on the cut gives the words up to it.

Defined results: a null or empty text has size 0 and is never taken; a null source is one source;
a very long text counts as any other, its words are counted in one pass over its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.bitmap import bitmap, may_hold
from lodestrata.llm.common import WORD_PATTERN, free, fresh, settle

#: Weights of the sources in code point order, repeating; null is the last source.
WEIGHTS = (5, 2, 1)
#: Parts of the key space: two hexadecimal digits of the key and more.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """32 uniform hexadecimal digits, the same on every run; only equal rows share one."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: int = 2) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    The budget is ``share`` of all words.  It is dealt by weight; no target passes ``limit``
    times its source, and what is above goes to the others by weight until none is above.
    That fixed point is found without a loop: sources by limit per weight, least first, are
    capped as long as their cap is below their part of what the ones before have left.
    One row a source: the windows below order sources, never documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.col("total") * F.lit(share) - F.col("caps_before")
    weight_left = F.col("weights") - F.col("weights_before")
    return (
        sizes.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * limit)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumns({
            "total": F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything),
            "caps_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weights_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        })
        .withColumn("capped", F.col("cap") * weight_left <= F.col("weight") * left)
        .withColumns({
            "left": F.col("total") * F.lit(share) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)),
            "weight_left": F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything),
        })
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("left") / F.col("weight_left")))
        .select("source", "source_size", "target")
    )


def plan_mix(docs: DataFrame, share: float = 1.5, limit: int = 2, ranges: int = RANGES) -> DataFrame:
    """doc_id, mix_key, size, source_size, target and taken of every document.

    ``taken`` counts the words that the mix takes of the document: its size for each whole
    epoch, and in the last epoch as much of it as lies before the cut.  Null text: size 0,
    never taken.  A null source is one source, the last.  Repeated rows tie on the key and on
    all else, so which of them the cut meets makes no difference.  Other columns are ignored.
    """
    digits = max(1, len(f"{ranges - 1:x}"))
    sized = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text")).alias("mix_key")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share=share, limit=limit)
    sized = sized.withColumn("part", F.conv(F.substring("mix_key", 1, digits), 16, 10).cast("int"))
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    # at most ``ranges`` rows a source
    offsets = parts.withColumn("offset", F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = targets.withColumnRenamed("source", "t_source")
    offsets = offsets.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").select(F.col("source").alias("o_source"), F.col("part").alias("o_part"), "offset", "source_size", "target")
    within = Window.partitionBy("source", "part").orderBy("mix_key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    return (
        sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("part") == F.col("o_part")))
        .withColumn("taken", (epochs * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("offset") - F.col("inside")))).cast("long"))
        .select("doc_id", "mix_key", "size", "source_size", "target", "taken")
    )


def mix(docs: DataFrame, share: float = 1.5, limit: int = 2, ranges: int = RANGES) -> DataFrame:
    """The mixed corpus: one row for each document and epoch that the mix takes.

    All columns of ``docs``, then ``epoch`` (from 1) and ``words`` (how many leading words of
    the text that epoch takes: all, but for the document on a source's cut, whose text stays
    whole here).  ``docs`` must not have these two names.  Repeated rows stay as many rows.
    """
    free(docs, "epoch"), free(docs, "words")
    key, twin, row = fresh(docs, "mix_key"), fresh(docs, "mix_twin"), fresh(docs, "plan_row")
    plan = settle(plan_mix(docs, share, limit, ranges).select("mix_key", "size", "taken"))
    # repeated rows share a key; the n-th of them gets the n-th plan row
    repeated = settle(plan.groupBy("mix_key").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("mix_key").alias("h")))
    numbered = plan.withColumn("twin", F.row_number().over(Window.partitionBy("mix_key").orderBy(F.col("taken").desc()))).where("taken > 0")
    mine = docs.withColumn(key, random_key(F.col("doc_id"), F.col("text")))
    maybe = may_hold(bitmap(repeated), F.xxhash64(key))
    twins = mine.where(maybe).withColumn(twin, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1))))
    mine = mine.where(~maybe).withColumn(twin, F.lit(1)).unionByName(twins)
    p = numbered.select(F.struct("*").alias(row))
    joined = mine.join(p, (mine[key] == p[row]["mix_key"]) & (mine[twin] == p[row]["twin"]))
    size, taken = F.col(row)["size"], F.col(row)["taken"]
    dealt = joined.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(taken / size))))
    return dealt.select(*docs.columns, "epoch", F.least(size, taken - (F.col("epoch") - 1) * size).alias("words"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS mix_key
  FROM {documents}
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s
), b AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights,
         CAST(coalesce(sum(cap) OVER before_it, 0) AS BIGINT) AS caps_before, CAST(coalesce(sum(weight) OVER before_it, 0) AS BIGINT) AS weights_before
  FROM w WINDOW before_it AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, cap * (weights - weights_before) <= weight * (total * CAST(1.5 AS DOUBLE) - caps_before) AS capped FROM b
), t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE weight * (total * CAST(1.5 AS DOUBLE) - CAST(coalesce(sum(cap) FILTER (capped) OVER (), 0) AS BIGINT)) / CAST(sum(weight) FILTER (NOT capped) OVER () AS BIGINT) END AS target
  FROM c
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mix_key, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size + least(size, greatest(0, budget % source_size - words_before)) ELSE 0 END AS BIGINT) AS taken
FROM p
"""
