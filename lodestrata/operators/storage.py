"""Tables in the shared folder, and immutable publication by content."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_scopes: list[list[str]] = []


def settle(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there: lost executors cost no recomputation of what lies before, and values
    that a rerun could deal otherwise (row ids) are fixed.  Within ``scratch`` the table goes when
    that scope ends, unless ``keep``; else it stays, as the frame that is returned may read it.
    """
    path = f"{shared_folder(df.sparkSession)}/settled/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _scopes and not keep:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables settled within are deleted at the end, but for those that are to be kept."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stable_id(prefix: str, *columns: str):
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))), 256))


def with_digest(df: DataFrame, key: str) -> DataFrame:
    """A content digest of every column but the key."""
    return df.withColumn("content_sha256", F.sha2(F.to_json(F.struct(*(c for c in sorted(df.columns) if c != key))), 256))


def publish(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """New rows and what became of every incoming one: ``outcome`` created, unchanged or conflict.

    A known key with equal content is unchanged; with other content it is a conflict, as is a
    key that comes with two contents at once.  Only created rows may be appended.
    """
    fresh = with_digest(incoming, key).dropDuplicates([key, "content_sha256"])
    known = with_digest(existing, key).select(key, F.col("content_sha256").alias("known_sha256"))
    twice = fresh.groupBy(key).agg(F.count("*").alias("contents"))
    judged = fresh.join(twice, key).join(known, key, "left")
    outcome = F.when(F.col("contents") > 1, "conflict").when(F.col("known_sha256").isNull(), "created").when(F.col("known_sha256") == F.col("content_sha256"), "unchanged").otherwise("conflict")
    return judged.withColumn("outcome", outcome).drop("known_sha256", "contents")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Incoming rows replace those of equal key; columns in ``keep`` stay as they were."""
    old = existing.select(*key, *(F.col(c).alias(f"__old_{c}") for c in keep))
    renewed = incoming.join(old, key, "left").select(*(F.coalesce(f"__old_{c}", c).alias(c) if c in keep else F.col(c) for c in incoming.columns))
    return existing.join(incoming.select(*key), key, "left_anti").unionByName(renewed, allowMissingColumns=True)


def missing_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose reference no parent has."""
    return child.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def publish_linked(existing: DataFrame, incoming: DataFrame, key: str, links: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """As ``publish``, but a document whose references dangle is ``refused``, and ``dangling`` names the columns.

    links: column of ``incoming`` (a value, or an array of values) to the parent table and its
    key.  Every value that is not null must be there; a document is refused whole.
    """
    rows = with_digest(incoming, key).dropDuplicates([key, "content_sha256"])
    lost = None
    for column, (parent, parent_key) in links.items():
        listed = incoming.schema[column].dataType.typeName() == "array"
        cited = rows.select(key, "content_sha256", (F.explode(column) if listed else F.col(column)).alias("__ref")).where("__ref is not null").distinct()
        found = cited.join(parent.select(F.col(parent_key).alias("__ref")).distinct(), "__ref", "left_anti").select(key, "content_sha256", F.lit(column).alias("__column")).distinct()
        lost = found if lost is None else lost.unionByName(found)
    judged = publish(existing, incoming, key)
    if lost is None:
        return judged.withColumn("dangling", F.array().cast("array<string>"))
    broken = lost.groupBy(key, "content_sha256").agg(F.array_sort(F.collect_set("__column")).alias("dangling"))
    met = judged.join(broken, [key, "content_sha256"], "left")
    return met.withColumn("outcome", F.when(F.col("dangling").isNotNull(), "refused").otherwise(F.col("outcome"))).withColumn("dangling", F.coalesce("dangling", F.array().cast("array<string>")))


def documents_by_id(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The documents of the wanted ids (column ``key``), a row for each id, with ``found``."""
    return wanted.select(key).distinct().join(rows.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
