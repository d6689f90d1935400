"""Joins of byte offsets in files by buckets, so that a long file is not one task's product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a bucket.
WIDTH = 4096


def innermost(points: DataFrame, spans: DataFrame, path: str, at: str, start: str, end: str, width: int = WIDTH) -> DataFrame:
    """``points`` with the columns of the shortest span of the same ``path`` with start <= at < end; null where none holds it.

    A span is a row for each bucket that it reaches into; of equal lengths the first start counts.
    Repeated points stay.  Columns other than ``path`` must differ.
    """
    bucket = lambda c: F.floor(c / width)
    covered = spans.where(F.col(end) > F.col(start)).withColumn("__bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end) - 1))))
    marked = points.select(F.col(path), F.col(at)).distinct().withColumn("__bucket", bucket(F.col(at)))
    held = marked.join(covered, [path, "__bucket"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)))
    others = [c for c in spans.columns if c != path]
    best = held.groupBy(path, at).agg(F.min(F.struct((F.col(end) - F.col(start)).alias("length"), F.col(start).alias("start"), F.struct(*others).alias("span")))["span"].alias("__span"))
    return points.join(best, [path, at], "left").select(*points.columns, *(F.col("__span")[c].alias(c) for c in others))


def first_after(places: DataFrame, events: DataFrame, path: str, end: str, at: str, within: int = WIDTH) -> DataFrame:
    """``places`` with the columns of the first event of the same ``path`` with end <= at <= end + within; null where there is none."""
    near = places.select(path, end).distinct().withColumn("__bucket", F.explode(F.array(F.floor(F.col(end) / within), F.floor(F.col(end) / within) + 1)))
    met = near.join(events.withColumn("__bucket", F.floor(F.col(at) / within)), [path, "__bucket"]).where((F.col(at) >= F.col(end)) & (F.col(at) <= F.col(end) + within))
    others = [c for c in events.columns if c != path]
    best = met.groupBy(path, end).agg(F.min_by(F.struct(*others), F.struct(F.col(at), F.struct(*others))).alias("__event"))
    return places.join(best, [path, end], "left").select(*places.columns, *(F.col("__event")[c].alias(c) for c in others))
