"""One global order under several budgets, without one ordered task.

Each row is taken if all its costs still fit; one that does not is passed over, and later ones may
fit.  What a part of the order does to the remaining budgets is a function of what is left when it
begins.  Where all that could fit is taken together, that function is a subtraction of sums, which
all parts give at once; the few parts in which a budget runs short are walked one by one.  Then
every part knows its beginning and all decide at once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.storage import settle


def take(left: list[int], costs: list[int]) -> int | None:
    """The first budget that the costs exceed; None, and less is left, if all fit."""
    for i, (have, cost) in enumerate(zip(left, costs)):
        if cost > have:
            return i
    for i, cost in enumerate(costs):
        left[i] -= cost
    return None


def within_budgets(rows: DataFrame, order: list[Column], costs: dict[str, tuple[str, int]], into: str = "refused_by") -> DataFrame:
    """``rows`` with a column that names the first budget that refused them; null for those taken.

    costs: budget name to (column of costs, never negative, null is 0; the budget).  ``order``
    must tell rows apart, else equal ones fall in either order.  The driver holds as many numbers
    as the sort has parts.
    """
    names, kept = list(costs), rows.columns
    part, place = "__part", "__place"
    cost = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"__cost_{i}") for i, (c, _) in enumerate(costs.values())]
    placed = settle(rows.select("*", *cost).orderBy(*order).withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33).cast("int")))
    columns = [f"__cost_{i}" for i in range(len(names))]
    starts = _starts(placed, part, place, columns, [b for _, b in costs.values()])

    def decide(batches):
        left, now = [], None
        for batch in batches:
            numbers = [batch.column(c).to_pylist() for c in columns]
            found = []
            for p, *n in zip(batch.column(part).to_pylist(), *numbers):
                if p != now:
                    now, left = p, list(starts[p])
                refused = take(left, n)
                found.append(None if refused is None else names[refused])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.string())], [*kept, into])

    inner = placed.repartitionByRange(part).sortWithinPartitions(place)
    return inner.mapInArrow(decide, rows.select("*", F.lit(None).cast("string").alias(into)).schema)


def _starts(placed: DataFrame, part: str, place: str, columns: list[str], budgets: list[int]) -> dict[int, list[int]]:
    """What is left of each budget where each part begins."""
    left, begin, out = list(budgets), -1, {}
    while True:
        could = [F.col(c) <= n for c, n in zip(columns, left)]
        fits = could[0]
        for c in could[1:]:
            fits = fits & c
        sums = placed.where(F.col(part) > begin).groupBy(part).agg(*(F.coalesce(F.sum(F.when(fits, F.col(c)).cast("decimal(38,0)")), F.lit(0)).alias(c) for c in columns)).orderBy(part).collect()
        short = None
        for row in sums:
            out[row[part]] = list(left)
            spent = [int(row[c]) for c in columns]
            if any(s > n for s, n in zip(spent, left)):
                short = row[part]
                break
            left = [n - s for s, n in zip(spent, left)]
        if short is None:
            return out
        left, begin = _walked(placed.where(F.col(part) == short), place, columns, left), short


def _walked(rows: DataFrame, place: str, columns: list[str], begin: list[int]) -> list[int]:
    """What is left after one part: its rows are one sorted stream in one task, none of them held."""

    def walk(batches):
        left = list(begin)
        for batch in batches:
            for n in zip(*(batch.column(c).to_pylist() for c in columns)):
                take(left, list(n))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in left], columns)

    return list(rows.repartition(1).sortWithinPartitions(place).select(*columns).mapInArrow(walk, ", ".join(f"{c} long" for c in columns)).first())


def inventory_entries(files: DataFrame, links: DataFrame, most_files: int, most_file_bytes: int, most_bytes: int) -> DataFrame:
    """canonical_path, kind, size, parent_path and status of the files and links of a tree, in path order.

    files: canonical_path, size, inode (null where it has one name).  links: canonical_path,
    size and resolved status, which stays theirs.  Of the names of one inode the first that is
    read is the file and the others are hard links, which cost a file but no bytes.  Statuses of
    files are completed, hardlink, or the budget that refused them: file_size, file_count, total_bytes.
    """
    every = files.select("canonical_path", "size", "inode", F.lit("file").alias("kind"), F.lit(None).cast("string").alias("link_status")).unionByName(links.select("canonical_path", "size", F.lit(None).cast(files.schema["inode"].dataType).alias("inode"), F.lit("symlink").alias("kind"), F.col("status").alias("link_status")))
    large = F.when((F.col("kind") == "file") & (F.col("size") > most_file_bytes), 1).otherwise(0)
    first = every.where("inode is not null").groupBy("inode").agg(F.min("canonical_path").alias("parent_path"))
    known = settle(every.join(first, "inode", "left").withColumn("later", F.coalesce(F.col("parent_path") < F.col("canonical_path"), F.lit(False)) & (large == 0)))
    while True:
        bytes_of = F.when((F.col("kind") == "file") & ~F.col("later"), F.col("size")).otherwise(0)
        costed = known.withColumns({"__count": F.lit(1), "__large": large, "__bytes": bytes_of})
        decided = settle(within_budgets(costed, [F.col("canonical_path")], {"file_count": ("__count", most_files), "file_size": ("__large", 0), "total_bytes": ("__bytes", most_bytes)}))
        # where the first name was refused, the next ones are files of their own, and are refused as well: less is left
        orphans = decided.where("later").join(decided.where("refused_by is not null").select(F.col("canonical_path").alias("parent_path")), "parent_path", "left_semi").select("canonical_path")
        if orphans.isEmpty():
            break
        known = settle(known.join(orphans.withColumn("__orphan", F.lit(True)), "canonical_path", "left").withColumn("later", F.col("later") & F.col("__orphan").isNull()).drop("__orphan"))
    status = F.when(F.col("refused_by").isNotNull(), F.col("refused_by")).when(F.col("kind") == "symlink", F.col("link_status")).when(F.col("later"), "hardlink").otherwise("completed")
    return decided.select("canonical_path", F.when(F.col("later"), "hardlink").otherwise(F.col("kind")).alias("kind"), "size", F.when(F.col("later"), F.col("parent_path")).alias("parent_path"), status.alias("status"))
