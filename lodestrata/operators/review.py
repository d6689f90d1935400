"""Overviews of analyses, and what of a model's or an analyser's output is let in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.interfaces import normalized_identity
from lodestrata.operators.exploration import is_related

#: Kinds of proposals, answers that name no corroboration, tokens that anchor nothing.
PROPOSAL_KINDS = ("analysis_step", "candidate_relation", "parameter_alias", "conflict_explanation", "missing_evidence")
NO_CORROBORATION = ("none", "n/a")
GENERIC_TOKENS = ("config", "feature", "menu", "module", "modules", "server", "status", "system", "target", "webroot")
#: The highest confidence that a model's word can have, and what stands for none.
MOST_CONFIDENCE, DEFAULT_CONFIDENCE = 0.9, 0.5


def semantic_overview(vulns: DataFrame, analyses: DataFrame, interfaces: DataFrame, parameters: DataFrame) -> DataFrame:
    """One row: related vulnerabilities, how many of them are analysed and pending, observations and model tokens.

    ``analyses``: analysis_id, identifier, status, is_current, prompt_tokens, completion_tokens.
    Only current analyses count; those that failed have observations but do not count as analysed.
    """
    current = analyses.where("is_current").select("analysis_id")
    seen = lambda df: df.join(current, "analysis_id", "left_semi").agg(F.count("*")).scalar()
    total = vulns.where(is_related()).agg(F.count("*")).scalar()
    tokens = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    done = analyses.where("is_current and status in ('succeeded', 'partial')").agg(F.countDistinct("identifier").alias("analyzed"), tokens("prompt_tokens"), tokens("completion_tokens"))
    return done.select(
        total.alias("total"), "analyzed", F.greatest(F.lit(0), total - F.col("analyzed")).alias("pending"), seen(interfaces).alias("interfaces"), seen(parameters).alias("parameters"), "prompt_tokens", "completion_tokens"
    )


def top_observed(observations: DataFrame, analyses: DataFrame, column: str, n: int = 8) -> DataFrame:
    """The values of ``column`` that current analyses saw most often; ties by value."""
    current = analyses.where("is_current").select("analysis_id")
    counts = observations.join(current, "analysis_id", "left_semi").groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "label").limit(n)


def stage_results(stages: DataFrame, results: DataFrame) -> DataFrame:
    """Status of each stage: not_applicable without results, completed if all results are, else partial.

    ``results``: stage, status, diagnostics (array).  Diagnostics are distinct, sorted and
    comma-joined.
    """
    counted = results.groupBy("stage").agg(F.count("*").alias("results"), F.bool_and(F.col("status") == "completed").alias("whole"))
    codes = results.select("stage", F.explode("diagnostics").alias("code")).groupBy("stage").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    met = stages.select("stage").join(counted, "stage", "left").join(codes, "stage", "left")
    status = F.when(F.col("results").isNull(), "not_applicable").when(F.col("whole"), "completed").otherwise("partial")
    none = F.when(F.col("results").isNull(), "no selected sources").otherwise(F.coalesce("codes", F.lit("")))
    return met.select("stage", status.alias("status"), F.coalesce("results", F.lit(0)).alias("results"), none.alias("diagnostics"))


def clean_model_rows(rows: DataFrame, name: str, lengths: dict[str, int], optional: tuple[str, ...] = (), place: str = "place", most: int = 50) -> DataFrame:
    """A model's rows within bounds: the first ``most`` of each answer, named, cut to length, never certain.

    ``place`` is the row's place in its answer, from 0.  ``optional`` columns are trimmed and
    null where blank.  A confidence of none or 0 counts as the default.
    """
    cut = {c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n) for c, n in lengths.items() if c not in optional}
    cut |= {c: F.when(F.trim(c) != "", F.substring(F.trim(c), 1, lengths[c])) for c in optional}
    given = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, F.lit(DEFAULT_CONFIDENCE)).otherwise(F.col("confidence"))
    kept = rows.where((F.col(place) < most) & (F.trim(F.coalesce(F.col(name), F.lit(""))) != ""))
    return kept.withColumns({**cut, "confidence": F.least(F.lit(MOST_CONFIDENCE), F.greatest(F.lit(0.0), given)), "source": F.lit("llm")})


def judge_proposals(proposals: DataFrame, targets: DataFrame, evidence: DataFrame, most: int = 40) -> DataFrame:
    """Each proposal with the reason why it is refused (null: accepted) and, if accepted, an id.

    ``proposals``: run_id, place (from 0), kind, target_ref, summary, rationale,
    required_corroboration, cited_evidence_ids, confidence.  ``targets`` (run_id, target_ref) and
    ``evidence`` (run_id, evidence_id) are what a run may speak of.
    """
    cited = proposals.select("run_id", "place", F.explode("cited_evidence_ids").alias("evidence_id"))
    outside = cited.join(evidence, ["run_id", "evidence_id"], "left_anti").select("run_id", "place", F.lit(True).alias("outside")).distinct()
    known = targets.select("run_id", "target_ref", F.lit(True).alias("known")).distinct()
    met = proposals.join(outside, ["run_id", "place"], "left").join(known, ["run_id", "target_ref"], "left")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    reason = (
        F.when(F.col("place") >= most, "budget").when(~F.coalesce(F.col("kind").isin(*PROPOSAL_KINDS), F.lit(False)), "kind").when(F.col("known").isNull(), "target")
        .when((F.coalesce(F.size("cited_evidence_ids"), F.lit(0)) < 1) | F.col("outside").isNotNull(), "evidence").when((text("summary") == "") | (text("rationale") == ""), "summary")
        .when((text("required_corroboration") == "") | F.lower(text("required_corroboration")).isin(*NO_CORROBORATION), "corroboration").when(~F.coalesce(F.col("confidence").between(0, MOST_CONFIDENCE), F.lit(False)), "confidence")
    )
    content = F.to_json(F.struct("kind", "target_ref", "summary", "rationale", "required_corroboration", F.array_distinct("cited_evidence_ids").alias("cited_evidence_ids"), "confidence"))
    judged = met.withColumn("reason", reason).drop("outside", "known")
    return judged.withColumn("proposal_id", F.when(F.col("reason").isNull(), F.concat(F.lit("proposal:"), F.sha2(F.concat("run_id", F.lit("\n"), content), 256))))


def combine_outcomes(outcomes: DataFrame) -> DataFrame:
    """One outcome for each obligation of what several analysers found.

    ``outcomes``: obligation_id, place (the analyser's), resolved, evidence_ids.  Resolved if any
    did; evidence in the analysers' order, each id once.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_ids"))), lambda x: x["evidence_ids"])  # one item an analyser
    return outcomes.groupBy("obligation_id").agg(F.bool_or("resolved").alias("resolved"), F.array_distinct(F.flatten(ordered)).alias("evidence_ids"))


def pivot_anchors(gates: DataFrame) -> DataFrame:
    """Distinct (feature_token, target_ref) of feature gates (gate_id, ui_target_id): words of four letters and more."""
    tokens = F.array_except(F.filter(F.regexp_extract_all(F.lower("ui_target_id"), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) >= 4), F.array(*map(F.lit, GENERIC_TOKENS)))
    return gates.select(F.explode(tokens).alias("feature_token"), F.col("gate_id").alias("target_ref")).distinct()


def binding_view(inventory: DataFrame, anchored: DataFrame) -> DataFrame:
    """All bindings of the inventory, with the anchored one's evidence where there is one.

    Both: canonical_path, route_token, handler_address, producer, evidence_ids.  An anchored
    binding by another producer is an error.
    """
    key = ["canonical_path", "route_token", "handler_address"]
    a = anchored.select(*key, F.col("producer").alias("other"), F.col("evidence_ids").alias("better"))
    met = inventory.join(a, key, "left")
    checked = F.when(F.col("other") != F.col("producer"), F.raise_error(F.concat(F.lit("two producers for "), F.col("route_token")))).otherwise(F.col("producer"))
    return met.select(*key, checked.alias("producer"), F.coalesce("better", "evidence_ids").alias("evidence_ids"), F.col("better").isNotNull().alias("anchored"))


def same_family(left: str, right: str) -> Column:
    """Two release contexts (structs of vendor, product, device_model) are of one family; null: not known to be."""
    parts = [normalized_identity(F.col(left)[c]) == normalized_identity(F.col(right)[c]) for c in ("vendor", "product", "device_model")]
    return F.coalesce(parts[0] & parts[1] & parts[2], F.lit(False))


def fail_interrupted(jobs: DataFrame, error: str = "interrupted") -> DataFrame:
    """Jobs that a stopped process has left running are failed ones."""
    running = F.col("status") == "running"
    return jobs.withColumns({"status": F.when(running, "failed").otherwise(F.col("status")), "error": F.when(running, error).otherwise(F.col("error"))})
