"""Evidence spans, catalogues and the obligations they leave open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.storage import settle


def text_position(content: Column, offset: Column) -> tuple[Column, Column]:
    """Line and column (both from 1) of a byte offset."""
    before = F.decode(F.substring(content, F.lit(1), offset), "ISO-8859-1")
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return line, F.length(F.substring_index(before, "\n", -1)) + 1


def capture(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Claims with their verified span and a stable id; ``problem`` says why one is refused.

    ``claims``: canonical_path, start_byte, end_byte, subject_ref, predicate, object_value,
    observation_kind, capability, confidence, producer, producer_version.
    """
    met = claims.join(files.select("canonical_path", "content", "content_sha256", "size"), "canonical_path", "left")
    excerpt = F.expr("substring(content, int(start_byte) + 1, int(end_byte - start_byte))")
    blank = F.greatest(*(F.trim(F.coalesce(F.col(c), F.lit(""))) == "" for c in ("subject_ref", "predicate", "capability", "producer", "producer_version")))
    problem = (
        F.when(F.col("content").isNull(), "unknown_source").when(F.sha2("content", 256) != F.col("content_sha256"), "digest_mismatch")
        .when(~((F.col("start_byte") >= 0) & (F.col("start_byte") < F.col("end_byte")) & (F.col("end_byte") <= F.col("size"))), "range").when(blank, "empty_field").when(~F.col("confidence").between(0, 1), "confidence")
        .when((F.col("observation_kind") == "direct_static") & ~F.contains(excerpt, F.col("object_value").cast("binary")), "object_not_in_span")
    )
    line, column = text_position(F.col("content"), F.col("start_byte").cast("int"))
    out = met.withColumn("problem", problem).withColumn("excerpt_sha256", F.when(F.col("problem").isNull(), F.sha2(excerpt, 256))).withColumns({"start_line": line, "start_column": column})
    identity = F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("canonical_path", "content_sha256", "start_byte", "end_byte", "subject_ref", "predicate", "object_value", "producer", "producer_version"))))
    return out.withColumn("evidence_id", F.when(F.col("problem").isNull(), F.concat(F.lit("evidence:"), F.sha2(identity, 256)))).drop("content", "size")


def replay(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """(evidence_id, holds): path, digest and excerpt are still what they were."""
    met = evidence.join(files.select("canonical_path", "content", F.sha2("content", 256).alias("now_sha256")), "canonical_path", "left")
    excerpt = F.sha2(F.expr("substring(content, int(start_byte) + 1, int(end_byte - start_byte))"), 256)
    return met.select("evidence_id", F.coalesce((F.col("now_sha256") == F.col("content_sha256")) & (excerpt == F.col("excerpt_sha256")), F.lit(False)).alias("holds"))


def assemble(candidates: DataFrame, parameters: DataFrame, evidence: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: catalogue id over all contents in any order, counts, coverage, and how many references dangle."""
    # sums of row hashes do not depend on order, so they are summed where the rows are
    row = lambda df, seed: F.sum(F.xxhash64(F.lit(seed), F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)"))
    digest = lambda df, key: df.agg(F.concat_ws(":", F.count("*"), row(df, 1), row(df, 2)).alias(key))
    lost = candidates.select("candidate_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id"), "evidence_id", "left_anti").agg(F.count("*").alias("missing_evidence"))
    orphans = parameters.join(candidates.select(F.col("candidate_id").alias("owner_ref")), "owner_ref", "left_anti").agg(F.count("*").alias("orphan_parameters"))
    status = coverage.agg(F.when(F.bool_or(F.col("required") & (F.col("status") == "failed")), "failed").when(F.bool_and(F.col("status").isin("completed", "not_applicable")), "completed").otherwise("partial").alias("coverage_status"))
    rows = candidates.agg(F.count("*").alias("candidates"))
    parts = [digest(candidates, "c"), digest(parameters, "p"), digest(evidence, "e"), digest(coverage, "v"), lost, orphans, status, rows]
    out = parts[0].withColumn("one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("one", F.lit(1)), "one")  # single rows
    return out.select(F.concat(F.lit("catalog:"), F.sha2(F.concat_ws(":", "c", "p", "e", "v"), 256)).alias("catalog_id"), "candidates", "coverage_status", "missing_evidence", "orphan_parameters")


def hidden_interfaces(catalogs: DataFrame, coverage: DataFrame, differences: DataFrame, proofs: DataFrame) -> DataFrame:
    """Native-only, unreferenced registrations of catalogues whose coverage allows that claim.

    Inventory, frontend and set difference must all be completed; a route and a handler must be
    proved for the same subject.
    """
    gate = coverage.where("producer_kind in ('frontend', 'set_difference')").groupBy("catalog_id").agg(F.countDistinct("producer_kind").alias("kinds"), F.bool_and(F.col("status") == "completed").alias("whole")).where("kinds = 2 and whole")
    allowed = catalogs.where("source_inventory_coverage_status = 'completed'").join(gate.select("catalog_id"), "catalog_id", "left_semi").select("catalog_id", "firmware")
    native = differences.where("side = 'native' and kind = 'native_registration_no_frontend_reference'").join(allowed, "catalog_id")
    routes = proofs.where("capability = 'registers_route'").select("catalog_id", "subject_ref", F.col("object_value").alias("token"))
    handlers = proofs.where("capability = 'binds_handler'").select("catalog_id", "subject_ref", F.col("object_value").alias("handler"))
    bound = routes.join(handlers, ["catalog_id", "subject_ref"]).groupBy("catalog_id", "token").agg(F.array_sort(F.collect_set("handler")).alias("handlers"))
    return native.join(bound, ["catalog_id", "token"]).select("catalog_id", "firmware", "token", "handlers")


def normalize_obligations(values: DataFrame) -> DataFrame:
    """Equal repeats are one; an id with two contents raises an error."""
    content = F.to_json(F.struct(*sorted(values.columns)))
    same = values.withColumn("__content", content).dropDuplicates(["obligation_id", "__content"])
    n = F.count("*").over(Window.partitionBy("obligation_id"))
    return same.withColumn("__content", F.when(n > 1, F.raise_error(F.concat(F.lit("conflicting obligation "), F.col("obligation_id")))).otherwise(F.col("__content"))).where("__content is not null").drop("__content")


Analyzer = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def run_obligations(initial: DataFrame, analyzers: dict[str, tuple[str, Analyzer]], max_rounds: int = 100, max_obligations: int | None = 1_000_000) -> tuple[DataFrame, str]:
    """Run analysers on open obligations until nothing changes; (obligations, termination).

    ``analyzers``: name to (capability, function of a batch of obligations to (resolved ids,
    generated obligations)).  A round takes, for every open obligation, its first candidate
    analyser that it has not met; whole batches run at once, and what they generate joins the
    next round.  Each pair of obligation and analyser meets once.  A run that has more than
    ``max_obligations`` (None: as many as there are) ends with ``budget_exhausted``.
    """
    columns = initial.columns
    now = settle(normalize_obligations(initial))
    met = None
    for _ in range(max_rounds):
        pairs = now.where("status = 'open'").select("*", F.posexplode("candidate_analyzers").alias("place", "analyzer"))
        able = F.create_map(*(F.lit(x) for name, (capability, _) in sorted(analyzers.items()) for x in (name, capability)))
        pairs = pairs.where(able[F.col("analyzer")] == F.col("required_capability"))
        if met is not None:
            pairs = pairs.join(met, ["obligation_id", "analyzer"], "left_anti")
        first = Window.partitionBy("obligation_id").orderBy("place")
        turn = settle(pairs.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "place"))
        if turn.isEmpty():
            return now, "fixed_point"
        # each round's pairs are written once, as its turns: what was met before is not written again
        seen = turn.select("obligation_id", "analyzer")
        met = seen if met is None else met.unionByName(seen)
        resolved, generated = None, None
        for name, (_, analyze) in sorted(analyzers.items()):
            r, g = analyze(turn.where(F.col("analyzer") == name).select(*columns))
            resolved = r.select("obligation_id") if resolved is None else resolved.unionByName(r.select("obligation_id"))
            generated = g.select(*columns) if generated is None else generated.unionByName(g.select(*columns))
        done = resolved.distinct().withColumn("__done", F.lit(True))
        updated = now.join(done, "obligation_id", "left").withColumn("status", F.when(F.col("__done"), "resolved").otherwise(F.col("status"))).select(*columns)
        new = normalize_obligations(generated).join(now.select("obligation_id"), "obligation_id", "left_anti").select(*columns)
        now = settle(updated.unionByName(new))
        if max_obligations is not None and now.count() > max_obligations:
            return now, "budget_exhausted"
    return now, "budget_exhausted"


def queue_order() -> list[Column]:
    return [F.desc("priority"), F.col("obligation_id")]
