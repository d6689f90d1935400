"""Snapshot differences, historical expectations, coverage and corpus gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.interfaces import interface_identity

#: Words that are no parameter names.
SUSPICIOUS = ("a", "an", "and", "argument", "field", "in", "of", "parameter", "the", "to", "variable", "via", "with")


def compare_entities(base: DataFrame, target: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, change, changed_fields) of every entity that was added, removed or changed."""
    b = base.select(F.col(key), *(F.col(f).alias(f"base_{f}") for f in fields), F.lit(True).alias("in_base"))
    t = target.select(F.col(key), *(F.col(f).alias(f"target_{f}") for f in fields), F.lit(True).alias("in_target"))
    both = b.join(t, key, "full")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"base_{f}").eqNullSafe(F.col(f"target_{f}")), F.lit(f)) for f in sorted(fields))))
    change = F.when(F.col("in_base").isNull(), "added").when(F.col("in_target").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return both.select(key, change.alias("change"), F.when(change == "changed", F.array_join(changed, ",")).otherwise("").alias("changed_fields")).where("change is not null")


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")))


def coverage_confidence(base: DataFrame, target: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by``, confidence, and how many coverage rows only one side has and how many required ones are incomplete.

    confounded: the two sides differ.  equivalent: they agree and all that is required is
    completed; equivalent_partial: they agree, but it is not.  Without ``by`` one row for the two
    snapshots; with it one for each of its values, such as pairs of snapshots.
    """
    by = by or []
    row = [*by, "producer_kind", "scope", "status", "required"]
    row = list(dict.fromkeys(row))
    both = base.select(*row).withColumns({"b": F.lit(1), "t": F.lit(0)}).unionByName(target.select(*row).withColumns({"b": F.lit(0), "t": F.lit(1)}))
    seen = both.groupBy(*row).agg(F.max("b").alias("b"), F.max("t").alias("t"))
    short = F.coalesce("required", F.lit(False)) & ~F.col("status").eqNullSafe("completed")
    counts = seen.groupBy(*by).agg(F.count_if((F.col("b") == 1) & (F.col("t") == 0)).alias("base_only"), F.count_if((F.col("b") == 0) & (F.col("t") == 1)).alias("target_only"), F.count_if(short).alias("incomplete"))
    confidence = F.when(F.col("base_only") + F.col("target_only") > 0, "confounded").when(F.col("incomplete") > 0, "equivalent_partial").otherwise("equivalent")
    return counts.select(*by, confidence.alias("confidence"), "base_only", "target_only", "incomplete")


def merge_members(candidates: DataFrame, key: str, attributes: tuple[str, ...]) -> DataFrame:
    """Entities of equal alignment key: sorted distinct values of each attribute, and how many."""
    return candidates.groupBy(key).agg(*(F.array_join(F.array_sort(F.collect_set(a)), ",").alias(a) for a in attributes), F.count("*").alias("members"))


def candidate_alignment(kind: Column, canonical: Column, attributes: Column) -> Column:
    """What a candidate is aligned by between snapshots: its kind and the identity that counts for it."""
    of = lambda name: F.nullif(F.try_element_at(attributes, F.lit(name)), F.lit(""))
    text = F.coalesce(canonical, F.lit(""))
    before = F.when(F.instr(text, " -> ") > 0, F.substr(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, " -> ", -1)) - 4)).otherwise(text)
    identity = (
        F.when(kind == "native_handler", F.coalesce(of("route_token"), text)).when(kind == "native_nested_dispatch", F.coalesce(of("normalized_operation"), text)).when(kind == "native_request_protection", before)
        .when(kind == "set_difference_attribution", F.concat_ws("|", text, F.coalesce(of("difference_side"), F.lit("")), F.coalesce(of("attribution_kind"), F.lit("")))).otherwise(text)
    )
    return F.concat_ws("|", F.coalesce(kind, F.lit("unknown")), identity)


def compound_members(description: Column) -> Column:
    """Distinct sorted members of slash-separated lists of qualified names; paths and lists with an unqualified name are none."""
    names = F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(r"(?<![A-Za-z0-9_.:-])([A-Za-z_][A-Za-z0-9_.:-]*(?:/[A-Za-z_][A-Za-z0-9_.:-]*)+)"), 1)
    lists = F.transform(names, lambda x: F.transform(F.split(x, "/"), lambda m: F.rtrim(m, F.lit("."))))
    return F.array_sort(F.array_distinct(F.flatten(F.filter(lists, lambda ms: F.forall(ms, lambda m: m.contains("."))))))


def parameter_entities(parameters: DataFrame, candidates: DataFrame) -> DataFrame:
    """identity, member_count, literal_values, selector_values, operation_selector and source_constructs of parameters that are one.

    Parameters of equal owner alignment, namespace and name are one; an owner that is no
    candidate aligns by itself.  candidates: candidate_id, alignment.  Lists are distinct and sorted.
    """
    owners = candidates.select(F.col("candidate_id").alias("owner_ref"), "alignment").dropDuplicates(["owner_ref"])
    ref = F.coalesce("owner_ref", F.lit(""))
    owned = parameters.join(owners, "owner_ref", "left")
    identity = F.concat_ws("|", F.coalesce("alignment", F.concat(F.lit("unresolved-owner|"), ref)), F.coalesce("namespace", F.lit("")), F.coalesce("name", F.lit("")))
    # selectors meet one by one, so that only a parameter's distinct ones are gathered
    rows = owned.select(identity.alias("identity"), "literal_value", "is_operation_selector", "source_construct", "selector_values")
    values = rows.select("identity", F.explode("selector_values").alias("v")).groupBy("identity").agg(F.array_sort(F.collect_set("v")).alias("selector_values"))
    entities = rows.groupBy("identity").agg(
        F.count("*").alias("member_count"), F.array_sort(F.collect_set("literal_value")).alias("literal_values"), F.bool_or(F.coalesce("is_operation_selector", F.lit(False))).alias("operation_selector"), F.array_sort(F.collect_set(F.coalesce("source_construct", F.lit("")))).alias("source_constructs"),
    )
    return entities.join(values, "identity", "left").withColumn("selector_values", F.coalesce("selector_values", F.array().cast("array<string>")))


def compare_expectations(expectations: DataFrame, observed: DataFrame, complete: bool = True) -> DataFrame:
    """Status and gap reason of each expectation against a catalogue's candidates.

    Interfaces meet by identity without leading slashes; where none does, native hints meet by
    the route's last component or the expected handler.  An expectation of another artifact, or
    against an incomplete catalogue, is not assessable rather than missing.
    """
    own = expectations.withColumn("identity", interface_identity(F.col("interface_value"))).withColumn("route", F.substring_index("identity", "/", -1))
    requests = observed.where("candidate_kind = 'frontend_request'").groupBy(interface_identity(F.col("canonical_identity")).alias("identity")).agg(F.count("*").alias("requests"))
    hints = observed.where("candidate_kind in ('native_hint', 'native_route_binding')").select(interface_identity(F.col("canonical_identity")).alias("hint")).distinct()
    met = own.join(requests, "identity", "left")
    met = met.join(hints.select(F.col("hint").alias("route"), F.lit(True).alias("by_route")), "route", "left").join(hints.select(F.col("hint").alias("handler"), F.lit(True).alias("by_handler")), "handler", "left")
    seen, exact, whole = F.col("requests").isNotNull(), F.col("applicability") == "exact_artifact", F.lit(complete)
    status = F.when(seen, "observed").when(~exact | ~whole, "not_assessable").otherwise("missing")
    gap = (
        F.when(seen, "none").when(F.col("applicability") == "out_of_scope", "artifact_out_of_scope").when(~exact, "artifact_scope_unknown").when(~whole, "coverage_incomplete")
        .when(F.coalesce("by_route", "by_handler").isNotNull(), "dispatcher_binding_without_interface").otherwise("interface_not_observed")
    )
    return met.select("identifier", status.alias("status"), gap.alias("gap_reason"))


def compare_bindings(expectations: DataFrame, bindings: DataFrame, hints: DataFrame) -> DataFrame:
    """Five states of each expected route: expected handler, other handler, bound, clue only, not seen."""
    own = expectations.withColumn("route", F.substring_index(interface_identity(F.col("interface_value")), "/", -1))
    bound = bindings.groupBy(F.col("canonical_identity").alias("route")).agg(F.collect_set("handler").alias("handlers"))
    clue = hints.select(F.col("canonical_identity").alias("route"), F.lit(True).alias("clue")).distinct()
    met = own.join(bound, "route", "left").join(clue, "route", "left").join(clue.toDF("handler", "handler_clue"), "handler", "left")
    status = (
        F.when(F.array_contains("handlers", F.col("handler")), "verified_expected_handler").when(F.col("handlers").isNotNull() & F.col("handler").isNotNull(), "handler_mismatch")
        .when(F.col("handlers").isNotNull(), "verified_route_binding").when(F.coalesce("clue", "handler_clue").isNotNull(), "native_clue_only").otherwise("binding_not_observed")
    )
    return met.select("identifier", status.alias("status"))


def audit_partition(denominator: DataFrame, compared: DataFrame) -> DataFrame:
    """Every vulnerability in one of four categories.

    Needs identifier, semantic_present, interfaces, parameters; ``compared`` has those that an
    expectation was compared for.
    """
    met = denominator.join(compared.select("identifier", F.lit(True).alias("was_compared")).distinct(), "identifier", "left")
    category = F.when(F.col("was_compared"), "compared").when(~F.col("semantic_present"), "not_analyzed").when(F.col("interfaces") + F.col("parameters") == 0, "no_structured_communication").otherwise("structured_not_compared")
    return met.withColumn("category", category)


def coverage_queue(audit: DataFrame, clues: DataFrame) -> DataFrame:
    """What to do next for each vulnerability that was not compared, most urgent first.

    ``clues``: identifier, parameters, handlers, interfaces (arrays), compound (members named in the text).
    """
    met = audit.where("category <> 'compared'").select("identifier", "category").join(clues, "identifier", "left")
    arr = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    suspicious = F.exists(arr("parameters"), lambda p: F.lower(p).isin(*SUSPICIOUS))
    lost = F.size(F.array_except(arr("compound"), arr("parameters"))) > 0
    cases = (
        (F.col("category") == "not_analyzed", "analyze_semantics", 30), (F.col("category") == "no_structured_communication", "extract_structured_communication", 50), (suspicious, "repair_parameter_extraction", 100), (lost, "repair_parameter_extraction", 95),
        (F.size(arr("interfaces")) > 0, "verify_source_expectation", 90), (F.size(arr("handlers")) > 0, "resolve_handler_to_route", 85),
    )
    action = reduce(lambda out, c: F.when(c[0], c[1]).otherwise(out), reversed(cases), F.lit("recover_interface"))
    priority = reduce(lambda out, c: F.when(c[0], c[2]).otherwise(out), reversed(cases), F.lit(80))
    return met.select("identifier", "category", action.alias("action"), priority.alias("priority")).orderBy(F.desc("priority"), "identifier")


def ledger(overlay: DataFrame, queue: DataFrame) -> DataFrame:
    """One status for each vulnerability of overlay or queue; one that both have is an error."""
    states = overlay.groupBy("identifier").agg(F.collect_set("status").alias("states"))
    one = lambda s: F.col("states") == F.array(F.lit(s))
    entries = states.select("identifier", F.when(one("observed"), "observed").when(one("not_assessable"), "not_assessable").when(one("missing"), "missing").otherwise("partial").alias("status"), F.lit("overlay").alias("origin"))
    queued = queue.select("identifier", F.lit("queued").alias("status"), F.lit("queue").alias("origin"))
    both = entries.unionByName(queued)
    twice = both.groupBy("identifier").agg(F.count("*").alias("n"))
    checked = both.join(twice, "identifier")
    return checked.select("identifier", "status", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("overlay and queue overlap: "), F.col("identifier")))).otherwise(F.col("origin")).alias("origin"))


def batch_coverage(coverage: DataFrame) -> DataFrame:
    """Status of each producer kind and scope: completed only if all of its rows are."""
    return coverage.groupBy("producer_kind", "scope").agg(F.bool_or("required").alias("required"), F.count("*").alias("results"), F.when(F.bool_and(F.col("status") == "completed"), "completed").otherwise("partial").alias("status"))


def required_coverage(expected: DataFrame, coverage: DataFrame) -> DataFrame:
    """Expected producers without rows: failed where required, else not applicable."""
    met = expected.join(batch_coverage(coverage).drop("required"), ["producer_kind", "scope"], "left")
    return met.select("producer_kind", "scope", F.coalesce("status", F.when(F.col("required"), "failed").otherwise("not_applicable")).alias("status"))


def sample_results(samples: DataFrame) -> DataFrame:
    """missing, unexpected and status of corpus samples (required, forbidden, observed: arrays)."""
    missing, unexpected = F.array_except("required", "observed"), F.array_intersect("forbidden", "observed")
    gap = (F.size(missing) > 0) | (F.size(unexpected) > 0) | (F.col("open_obligations") > 0) | (F.col("coverage_status") != "completed")
    status = (
        F.when(F.col("evidence_tier") == "external_lead", "acquisition_gap").when(F.col("observed").isNull() | gap, "coverage_gap")
        .when(F.col("evidence_tier") == "real_firmware", "verified").when(F.col("evidence_tier") == "derived_firmware", "derived_only").otherwise("contract_only")
    )
    return samples.withColumns({"missing": F.when(F.col("observed").isNull(), F.col("required")).otherwise(F.array_sort(missing)), "unexpected": F.coalesce(F.array_sort(unexpected), F.array().cast("array<string>")), "status": status})


def category_results(results: DataFrame) -> DataFrame:
    """Each category's status: the best that any of its samples reached."""
    order = ("verified", "derived_only", "coverage_gap", "contract_only")
    best = reduce(lambda out, s: F.when(F.count_if(F.col("status") == s) > 0, s).otherwise(out), reversed(order), F.lit("acquisition_gap"))
    return results.groupBy("category").agg(best.alias("category_status"), F.count("*").alias("samples"), *(F.count_if(F.col("status") == s).alias(s) for s in order))


def corpus_gate(categories: DataFrame) -> DataFrame:
    """passed if all categories are verified; partial if any is verified, derived or contract; else failed."""
    some = F.bool_or(F.col("category_status").isin("verified", "derived_only", "contract_only"))
    return categories.agg(F.when(F.bool_and(F.col("category_status") == "verified"), "passed").when(some, "partial").otherwise("failed").alias("gate"))
