"""Stages of many runs in dependency order: layers, failures that pass on, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.storage import settle

#: Outcomes after which dependent stages may run.
GOOD = ("completed", "partial", "not_applicable")


def run_order(stages: DataFrame, needs: DataFrame, key: str = "run_id") -> DataFrame:
    """``key``, stage, layer, status and cause of every stage of every run.

    stages: key, stage, outcome (what it gives once it runs), enabled.  needs: key, stage, needs.
    A stage's layer is one more than the highest of those it needs.  It gets its own outcome if
    all that it needs ended well, else it is skipped, and ``cause`` is the first failing stage
    among those it rests on.  A stage that is not enabled is skipped by itself; one that needs an
    unknown stage is ``missing``; stages of a cycle, and those that rest on one, never run:
    ``cycle`` and ``blocked``.  Each round handles the stages whose last need was met in it.
    """
    known = stages.select(key, "stage")
    wanted = settle(needs.select(key, "stage", "needs").distinct().join(known, [key, "stage"], "left_semi"))
    unknown = wanted.join(known.withColumnRenamed("stage", "needs"), [key, "needs"], "left_anti").groupBy(key, "stage").agg(F.min("needs").alias("unknown"))
    edges = settle(wanted.join(known.withColumnRenamed("stage", "needs"), [key, "needs"], "left_semi"))
    count = edges.groupBy(key, "stage").agg(F.count("*").alias("n"))
    todo = settle(stages.select(key, "stage", "outcome", "enabled").join(count, [key, "stage"], "left").join(unknown, [key, "stage"], "left").withColumn("n", F.coalesce("n", F.lit(0))))

    def ended(rows: DataFrame) -> DataFrame:
        """status and cause of stages whose needs are met; ``bad`` is the first cause among those."""
        own = F.when(F.col("unknown").isNotNull(), "missing").when(~F.coalesce("enabled", F.lit(True)), "skipped").when(F.col("bad").isNotNull(), "skipped").otherwise(F.col("outcome"))
        cause = F.when(F.col("unknown").isNotNull(), F.col("unknown")).when(~F.coalesce("enabled", F.lit(True)), F.col("stage")).when(F.col("bad").isNotNull(), F.col("bad")).when(~F.col("outcome").isin(*GOOD) | F.col("outcome").isNull(), F.col("stage"))
        return rows.select(key, "stage", "layer", own.alias("status"), cause.alias("cause"))

    front = settle(ended(todo.where("n = 0").withColumns({"layer": F.lit(0), "bad": F.lit(None).cast("string")})))
    done = front
    while not front.isEmpty():
        touched = edges.join(front.select(key, F.col("stage").alias("needs")), [key, "needs"], "left_semi").select(key, "stage").distinct()
        met = edges.join(touched, [key, "stage"], "left_semi").join(done.select(key, F.col("stage").alias("needs"), "layer", "cause"), [key, "needs"])
        ready = met.groupBy(key, "stage").agg(F.count("*").alias("have"), (F.max("layer") + 1).alias("layer"), F.min("cause").alias("bad"))
        front = settle(ended(todo.join(ready, [key, "stage"]).where("have = n")))
        done = done.unionByName(front)
    return done.unionByName(_stuck(todo.join(done.select(key, "stage"), [key, "stage"], "left_anti").select(key, "stage"), edges, key))


def _stuck(rows: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Stages that never run: those that reach themselves are on a cycle, the others are blocked by one.

    What no other stuck stage needs is taken off until all that is left is needed: cycles, and
    paths between them.  Of these, a stage is on a cycle if it reaches itself.
    """
    rest = settle(rows)
    if rest.isEmpty():
        return rest.select(key, "stage", F.lit(None).cast("int").alias("layer"), F.lit("").alias("status"), F.lit(None).cast("string").alias("cause"))
    inner = settle(edges.join(rest, [key, "stage"], "left_semi").join(rest.withColumnRenamed("stage", "needs"), [key, "needs"], "left_semi"))
    core = rest
    while True:
        fewer = settle(core.join(inner.join(core, [key, "stage"], "left_semi").select(key, F.col("needs").alias("stage")).distinct(), [key, "stage"], "left_semi"))
        if fewer.count() == core.count():
            break
        core = fewer
    steps = settle(inner.join(core, [key, "stage"], "left_semi").join(core.withColumnRenamed("stage", "needs"), [key, "needs"], "left_semi"))
    seen = front = settle(steps.select(key, "stage", F.col("needs").alias("to")))
    while not front.isEmpty():
        onward = front.join(steps.select(key, F.col("stage").alias("to"), F.col("needs").alias("next")), [key, "to"]).select(key, "stage", F.col("next").alias("to")).distinct()
        front = settle(onward.join(seen, [key, "stage", "to"], "left_anti"))
        seen = seen.unionByName(front)
    loops = seen.where("stage = to").select(key, "stage", F.lit(True).alias("loop"))
    return rest.join(loops, [key, "stage"], "left").select(key, "stage", F.lit(None).cast("int").alias("layer"), F.when(F.col("loop"), "cycle").otherwise("blocked").alias("status"), F.lit(None).cast("string").alias("cause"))
