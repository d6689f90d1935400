"""Keyed incremental merge: what a batch brings changes only the buckets of its keys.

A record's state holds, for each rule of the merge, the deciding value with its place in the order
of arrival.  States are combined by least and greatest places, sums of flags and unions, so the
same batch may come twice and batches in any order: the result is that of merging all records one
by one.  The state is plain Parquet, partitioned by a hash of the key.  A batch reads and
overwrites the buckets of its own keys and no others (Spark's dynamic partition overwrite); a
reader has one row for each key and merges nothing.  A run that broke off is repaired by running
its batch again.

Beside the states stand summaries, a partial one for each bucket, made from its records whenever
it is written.  A record that changes level, or any other column, is thereby taken out where it
was counted before.  Totals are sums, unions of sketches and tops over the partial ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators import merging
from lodestrata.operators.storage import scratch, settle
from lodestrata.streaming.ingest import stream_name


@dataclass(frozen=True)
class KeyedTable:
    """States of records below ``path``, in ``buckets`` of keys.

    schema: columns of the records; key and order: names of two of them.  ``order`` tells records
    of one key apart and says which came later.
    """

    spark: SparkSession
    path: str
    schema: str
    order: str
    key: str = "identifier"
    buckets: int = 256

    def _records(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _stored(self, part: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as e:  # nothing is written yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _in_buckets(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def states(self) -> DataFrame:
        return self._stored("states", self._in_buckets(merging.merge_states(self._records(), self.order, self.key)).schema)

    def read(self) -> DataFrame:
        """One merged record of each key."""
        return merging.finished(self.states().drop("bucket"))

    def apply(self, batch: DataFrame, summary: Summary | None = None) -> list[int]:
        """Merge a batch into the buckets of its keys; which those are, at most ``buckets``."""
        with scratch(self.spark):  # what is settled here is in the table at the end
            news = settle(self._in_buckets(merging.merge_states(batch.select(*self._records().columns), self.order, self.key)))
            touched = sorted(r.bucket for r in news.select("bucket").distinct().collect())
            if not touched:
                return []
            old = self.states().where(F.col("bucket").isin(touched))  # a filter on the partitions
            now = settle(merging.combined_states(old.unionByName(news), self.key, "bucket"))
            overwrite(now.repartition("bucket"), f"{self.path}/states", "bucket")
        if summary is not None:
            self.summarise(summary, touched)
        return touched

    def summarise(self, summary: Summary, buckets: list[int]) -> None:
        """Write the partial summaries of ``buckets`` anew."""
        mine = self.states().where(F.col("bucket").isin(buckets))
        overwrite(summary.partial(merging.finished(mine, "bucket")).repartition("bucket"), f"{self.path}/summary", "bucket")

    def summaries(self, summary: Summary) -> DataFrame:
        return self._stored("summary", summary.partial(merging.finished(self.states(), "bucket")).schema)


def overwrite(rows: DataFrame, path: str, column: str) -> None:
    """Replace the partitions that ``rows`` has, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


@dataclass(frozen=True)
class Summary:
    """Counts by facet and value, and how many distinct values each facet has.

    facets: columns of the merged record, an array's elements counting one each; distinct: columns
    of which a sketch keeps how many values there are.  Nulls and empty values are not counted.
    """

    facets: tuple[str, ...]
    distinct: tuple[str, ...] = ()

    def _values(self, records: DataFrame, names: tuple[str, ...]) -> DataFrame:
        arrays = {f.name for f in records.schema.fields if f.dataType.typeName() == "array"}
        value = lambda c: F.array_distinct(F.transform(c, lambda x: x.cast("string"))) if c in arrays else F.array(F.col(c).cast("string"))
        named = lambda c: F.transform(value(c), lambda x: F.struct(F.lit(c).alias("facet"), x.alias("value")))
        rows = F.concat(*map(named, names))
        return records.select("bucket", F.explode(rows).alias("x")).select("bucket", "x.*").where("value <> ''")

    def partial(self, records: DataFrame) -> DataFrame:
        """bucket, facet, value, n and sketch: a row for each value of a facet, and one with a sketch for each of ``distinct``."""
        counted = self._values(records, self.facets).groupBy("bucket", "facet", "value").agg(F.count("*").alias("n")).withColumn("sketch", F.lit(None).cast("binary"))
        everything = records.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.lit("all").alias("facet"), F.lit("").alias("value"), "n", F.lit(None).cast("binary").alias("sketch"))
        counted = counted.unionByName(everything)
        if not self.distinct:
            return counted
        sketched = self._values(records, self.distinct).groupBy("bucket", "facet").agg(F.hll_sketch_agg("value", F.lit(14)).alias("sketch"))
        return counted.unionByName(sketched.select("bucket", F.concat(F.lit("distinct "), "facet").alias("facet"), F.lit("").alias("value"), F.lit(None).cast("long").alias("n"), "sketch"))

    @staticmethod
    def totals(partial: DataFrame) -> DataFrame:
        """facet, value and n over all buckets; for ``distinct`` facets n is the sketch's estimate."""
        counts = partial.where("sketch is null").groupBy("facet", "value").agg(F.sum("n").alias("n"))
        sketches = partial.where("sketch is not null").groupBy("facet", "value").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
        return counts.unionByName(sketches)

    @staticmethod
    def top(partial: DataFrame, facet: str, k: int) -> DataFrame:
        """value and n of a facet's ``k`` most frequent values, of equals the first by value."""
        return partial.where((F.col("facet") == facet) & F.col("sketch").isNull()).groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def merge_stream(records: DataFrame, table: KeyedTable, checkpoint: str, summary: Summary | None = None, cursors: CursorTable | None = None, source: str = "", cursor: Column | None = None) -> StreamingQuery:
    """Merge a stream of records into ``table`` until all is in, and then the cursor of each batch.

    The cursor is written after the data: a run that breaks off between takes the batch in again,
    which changes nothing.
    """
    name = stream_name(checkpoint)

    def each(batch: DataFrame, n: int) -> None:
        with scratch(table.spark):
            rows = settle(batch)
            table.apply(rows, summary)
            if cursors is not None:
                cursors.save(rows.agg(F.max(cursor).alias("cursor")).select(F.lit(source).alias("source"), "cursor").where("cursor is not null"), f"{name}-{n}")

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class CursorTable:
    """How far each source has been read: a row for each run, the greatest of a source counts."""

    spark: SparkSession
    path: str

    def save(self, rows: DataFrame, run: str) -> None:
        """source and cursor (text) of a run; a run that comes again writes over itself."""
        rows.select("source", F.col("cursor").cast("string").alias("cursor")).write.mode("overwrite").parquet(f"{self.path}/run={run}")

    def read(self) -> DataFrame:
        try:
            rows = self.spark.read.schema("source string, cursor string, run string").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "source string, cursor string")
        return rows.groupBy("source").agg(F.max("cursor").alias("cursor"))

    def of(self, source: str) -> datetime | None:
        row = self.read().where(F.col("source") == source).first()
        return datetime.fromisoformat(row.cursor) if row else None
