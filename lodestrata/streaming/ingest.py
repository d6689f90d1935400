"""Incremental ingestion: micro-batches kept as source records, merged by key when read."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators.merging import merge_records

OVERLAP = timedelta(minutes=5)


def sync_window(now: datetime, cursor: datetime | None, days: int) -> tuple[datetime, datetime]:
    """From the last success less five minutes, but ``days`` (1..120) ago at the earliest."""
    earliest = now - timedelta(days=max(1, min(days, 120)))
    return (max(earliest, cursor - OVERLAP) if cursor else earliest), now


class RecordTable:
    """Source records as plain Parquet, a folder for each stream and batch.

    A batch writes its own folder only, so its cost follows the batch and not the table; a batch
    that runs again overwrites what it wrote.  Streams are told apart by their own name, so a new
    checkpoint, or a second stream into the table, never meets the folders of another.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def folder(self, stream: str, batch_id: int) -> str:
        return f"{self.path}/stream={stream}/batch={batch_id}"

    def write(self, batch: DataFrame, stream: str, batch_id: int) -> None:
        columns = self.spark.createDataFrame([], self.schema).columns
        batch.select(*columns).write.mode("overwrite").parquet(self.folder(stream, batch_id))

    def read(self) -> DataFrame:
        """All records; those that an overlap of deliveries brought twice are one."""
        try:
            rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)
        return rows.dropDuplicates()


def stream_name(checkpoint: str) -> str:
    """A stream is its checkpoint: batches of one count on, those of another start anew."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def ingest(spark: SparkSession, folder: str, schema: str, table: RecordTable, checkpoint: str) -> StreamingQuery:
    """Stream JSON files of ``folder`` into ``table`` and stop when all are in."""
    name = stream_name(checkpoint)
    records = spark.readStream.schema(schema).json(folder)
    return records.writeStream.foreachBatch(lambda batch, n: table.write(batch, name, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(table: RecordTable, order: str = "arrived") -> DataFrame:
    """The table's records, merged by identifier."""
    return merge_records(table.read(), order)


def feed_states(states: DataFrame, news: DataFrame) -> DataFrame:
    """Feed states after a run: the newest of each feed; ``imported_at`` moves only on import."""
    both = states.withColumn("run", F.lit(0)).unionByName(news.withColumn("run", F.lit(1)), allowMissingColumns=True)
    latest = F.struct("run", "status", "sha256")
    return both.groupBy("name").agg(F.max_by("status", latest).alias("status"), F.max_by("sha256", latest).alias("sha256"), F.max(F.when(F.col("status") == "imported", F.col("imported_at"))).alias("imported_at"))


def needs_replay(meta_modified: datetime, now: datetime, days: int = 8) -> bool:
    """The feed of changes does not reach back far enough: replay the yearly feeds."""
    return now - meta_modified > timedelta(days=days)
