"""A bitmap of key hashes, made of built-in functions only.

It tells rows whose key cannot be in a small set before they are shuffled for an exact join.
Its size follows the number of keys up to a fixed bound (8 MB); beyond, more keys only let more
rows through to the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the least and most 64-bit words of a bitmap.
BITS, LEAST_WORDS, MOST_WORDS = 32, 1 << 12, 1 << 20


def bitmap(keys: DataFrame) -> Column:
    """The bitmap of ``keys``' one column of 64-bit hashes (a settled table), as a scalar subquery."""
    words = max(LEAST_WORDS, min(MOST_WORDS, -(-keys.count() * BITS // 64)))
    bit = F.pmod(F.col(keys.columns[0]), F.lit(words * 64))
    set_words = keys.select((bit / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("word")).join(set_words, "word", "left")
    # a bounded number of rows meets in one task, whatever the input
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"])
    return every.agg(in_order.alias("bitmap")).scalar()


def may_hold(bits: Column, key: Column) -> Column:
    """The bitmap has ``key``'s bit."""
    bit = F.pmod(key, F.size(bits).cast("long") * 64)
    return F.call_function("shiftright", F.get(bits, (bit / 64).cast("int")), (bit % 64).cast("int")).bitwiseAND(1) == 1
