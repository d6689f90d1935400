"""What the corpus operators share: fresh names, text digests and cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as runs of anything but ASCII white space, in Java's and RE2's syntax.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """A column name, starting with ``name``, that ``df`` does not use in any case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"{name}_"
    return name


def free(df: DataFrame, name: str) -> str:
    """``name``, which must not be a column of ``df`` yet."""
    if name != fresh(df, name):
        raise ValueError(f"{name} is a column already")
    return name


def text_digest(text: Column) -> Column:
    """128 bits that stand for a text (null counts as empty): two xxhash64 of other seeds."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(7), t).alias("b"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is set.

    Only a local session that names no such folder (tests) gets one of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(named)
    return named


_scopes: list[list[str]] = []


def settle(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there: lost executors cost no recomputation of what lies before,
    and values that a rerun could deal otherwise (row ids) are fixed.  Within ``scratch`` the
    table goes when that scope ends, unless ``keep``; else it stays, as the frame that is returned
    may read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/settled/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _scopes and not keep:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


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


#: Groups that may be broadcast: fewer than so many can each hold more than one part in HEAVY of all rows.
HEAVY = 4096


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` with the one row of their group; ``groups`` counts its rows in column ``n``.

    Groups of more than one ``HEAVY``-th of all rows are fewer than ``HEAVY`` whatever the input:
    these are broadcast, so their rows stay where they are.  All others are shuffled.  Both
    tables are read twice and should be settled.
    """
    bound = (groups.agg(F.sum(n)).first()[0] or 0) / HEAVY
    heavy, light = groups.where(F.col(n) > bound), groups.where(F.col(n) <= bound)
    cool = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(cool.join(light, keys))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
