"""Documents loaded under rules: what breaks them is kept as rows, and counted while they load."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.storage import settle

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Rule:
    """``holds`` must be true of every document; ``at`` is the field it speaks of."""

    name: str
    at: str
    holds: Column


def read_documents(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """JSON documents, one a line (or, if ``whole``, a file), with their file; text that is none of the schema is kept in ``_corrupt_record``."""
    rows = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", whole).json(path)
    return rows.withColumn("file", F.substring_index(F.col("_metadata.file_path"), "/", -1))


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """``rows`` with the JSON of ``column`` as columns; text that is none of the schema goes to ``_corrupt_record``.

    Each text is one element to ``inline``: filters on its columns do not go below and parse it again.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return rows.select(*(c for c in rows.columns if c != column), F.inline(F.array(F.from_json(column, f"{schema}, {CORRUPT} string", options))))


def judged(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` with ``violations``: (rule, at) of each rule that does not hold, null counting as not.

    A corrupt document breaks the rule ``readable`` and no other.
    """
    bad = F.col(CORRUPT).isNotNull() if CORRUPT in rows.columns else F.lit(False)
    pair = lambda name, at: F.struct(F.lit(name).alias("rule"), F.lit(at).alias("at"))
    broken = F.array_compact(F.array(F.when(bad, pair("readable", "")), *(F.when(~bad & ~F.coalesce(r.holds, F.lit(False)), pair(r.name, r.at)) for r in rules)))
    return rows.withColumn("violations", broken)


def violations(rows: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """key, rule and at of every broken rule, ``repeated`` for documents that share a key."""
    judgement = judged(rows, rules)
    single = judgement.select(key, F.explode("violations").alias("x")).select(key, "x.rule", "x.at")
    repeated = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("repeated").alias("rule"), F.lit(key).alias("at"))
    return single.unionByName(repeated)


class Refused(ValueError):
    """A load that broke rules; ``counts`` tells how often each."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(", ".join(f"{k}: {v}" for k, v in sorted(counts.items()) if v))
        self.counts = counts


def load(rows: DataFrame, rules: list[Rule], path: str) -> dict[str, int]:
    """Write the documents to ``path`` if none breaks a rule; else refuse the load and leave ``path`` alone.

    Rules are counted in the pass that judges the rows.  Those refused are written, with what
    they broke, to ``path`` with ``-refused`` added.
    """
    names, seen = ["readable", *(r.name for r in rules)], Observation()
    broken = F.col("violations")["rule"]
    judgement = settle(judged(rows, rules).observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.array_contains(broken, n)).alias(n) for n in names)))
    found = {k: int(v) for k, v in seen.get.items()}
    if any(found[n] for n in names):
        judgement.where("size(violations) > 0").write.mode("overwrite").parquet(f"{path}-refused")
        raise Refused({n: found[n] for n in names})
    judgement.drop("violations", CORRUPT).write.mode("overwrite").parquet(path)
    return found
