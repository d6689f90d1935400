"""Pages, budgets and latest rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """One page in a total order; limits outside 1..``most`` are clamped."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def page_envelope(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """total, pages, page, has_previous and has_next of a paged result."""
    total = F.count("*")
    return df.agg(total.alias("total")).select(
        "total", F.ceil(F.col("total") / limit).alias("pages"), F.lit(offset // limit + 1).alias("page"), F.lit(offset > 0).alias("has_previous"), (F.col("total") > offset + limit).alias("has_next")
    )


def after_key(df: DataFrame, key: str, after: str, limit: int) -> DataFrame:
    """Keyset pagination: the next ``limit`` rows whose key is greater."""
    return df.where(F.col(key) > after).orderBy(key).limit(limit)


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, ordinal: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in ``order``; ``ordinal`` keeps their number."""
    name = ordinal or "__ordinal"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if ordinal else out.drop(name)


def prefix_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows in order until the running size would pass the budget; all later ones are cut off.

    Adds ``spent`` and ``status``: completed, or partial for every key that lost rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    spent = df.withColumn("spent", F.sum(size).over(w))
    return spent.withColumn("status", F.when(F.max("spent").over(every) > budget, "partial").otherwise("completed")).where(F.col("spent") <= budget)


def greedy_budget(df: DataFrame, key: str, item: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows in order, each taken if it still fits: a row too large is skipped and later ones may fit.

    Each choice needs the ones before, so a key is one ordered stream: rows are sorted within
    partitions by key, and only the running sum is held from one batch to the next.  Returns key,
    item and taken; ties of ``order`` go by item.
    """
    rows = df.select(key, item, order, size).repartition(key).sortWithinPartitions(key, order, item)

    def choose(batches):
        at, spent = object(), 0
        for batch in batches:
            taken = []
            for k, n in zip(batch.column(key).to_pylist(), batch.column(size).to_pylist()):
                if k != at:
                    at, spent = k, 0
                fits = spent + n <= budget
                spent += n if fits else 0
                taken.append(fits)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(item), pa.array(taken, pa.bool_())], [key, item, "taken"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return rows.mapInArrow(choose, f"`{key}` {kinds[key]}, `{item}` {kinds[item]}, taken boolean")
