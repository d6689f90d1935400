"""The firmware candidate catalogue: candidates, their sources and their vulnerability leads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of trust and of confidence.
TRUST_ORDER = ("primary", "high")
CONFIDENCE_ORDER = ("high", "medium")


def in_order(column: str, values: tuple[str, ...]) -> Column:
    out = F.lit(len(values))
    for i, v in enumerate(values):
        out = F.when(F.col(column) == v, i).otherwise(out)
    return out


def download_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def listing(candidates: DataFrame, sources: DataFrame, leads: DataFrame) -> DataFrame:
    """Candidates with their source and what their leads say, in one pre-aggregated join.

    vulnerability_count, exact_count, identifiers (sorted) and best_method: the method of the
    highest score, of equal ones the first identifier's.
    """
    summary = leads.groupBy("candidate_id").agg(
        F.countDistinct("identifier").alias("vulnerability_count"), F.count_if(F.col("match_method") == "exact_version").alias("exact_count"),
        F.array_join(F.array_sort(F.collect_set("identifier")), ",").alias("identifiers"), F.min_by("match_method", F.struct(-F.col("match_score"), F.col("identifier"), F.col("match_method"))).alias("best_method"),
    )
    return (
        candidates.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id").join(summary, "candidate_id", "left")
        .withColumn("vulnerability_count", F.coalesce("vulnerability_count", F.lit(0))).withColumn("exact_count", F.coalesce("exact_count", F.lit(0)))
    )


def candidate_order() -> list[Column]:
    return [F.desc("vulnerability_count"), F.lower("vendor"), F.lower("model"), F.col("external_id"), F.col("candidate_id")]


def with_lead(candidates: DataFrame, leads: DataFrame, *, identifier: str | None = None, method: str | None = None, has_vulnerability: bool | None = None) -> DataFrame:
    """Candidates that have a fitting lead (``version``: exact or range); with False, those with none."""
    wanted = leads
    if identifier:
        wanted = wanted.where(F.upper("identifier") == identifier.upper())
    if method:
        wanted = wanted.where(F.col("match_method").isin("exact_version", "version_range") if method == "version" else F.col("match_method") == method)
    return candidates.join(wanted.select("candidate_id"), "candidate_id", "left_anti" if has_vulnerability is False else "left_semi")


def source_counts(sources: DataFrame, candidates: DataFrame, leads: DataFrame) -> DataFrame:
    """Every source with its distinct candidates and vulnerabilities, each counted by itself before it meets the source."""
    of = candidates.select("source_id", "candidate_id").distinct()
    held = of.groupBy("source_id").agg(F.count("candidate_id").alias("candidates"))
    found = of.join(leads.select("candidate_id", "identifier"), "candidate_id").select("source_id", "identifier").distinct().groupBy("source_id").agg(F.count("identifier").alias("vulnerabilities"))
    return (
        sources.select("source_id", "name", "trust_level").distinct().join(held, "source_id", "left").join(found, "source_id", "left")
        .select("source_id", "name", "trust_level", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("vulnerabilities", F.lit(0)).alias("vulnerabilities"))
        .orderBy(in_order("trust_level", TRUST_ORDER), F.desc("candidates"), "name")
    )


def catalogue_overview(candidates: DataFrame, sources: DataFrame, leads: DataFrame) -> DataFrame:
    """One row: counts of all three tables, each read once."""
    c = candidates.agg(F.count("*").alias("candidates"), F.countDistinct("vendor").alias("vendors"), F.count_if(F.col("version").isNotNull() & (F.col("version") != "unknown")).alias("versioned"))
    s = sources.agg(F.count("*").alias("sources"))
    v = leads.agg(F.count("*").alias("leads"), F.countDistinct("candidate_id").alias("linked_candidates"), F.countDistinct("identifier").alias("linked_vulnerabilities"), F.count_if(F.col("match_method") == "exact_version").alias("exact_leads"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(c).join(one(s), "one").join(one(v), "one").drop("one")  # three single rows


def host_counts(candidates: DataFrame, n: int = 16) -> DataFrame:
    return candidates.groupBy(download_host(F.col("download_url")).alias("host")).agg(F.count("*").alias("n")).where("host <> ''").orderBy(F.desc("n"), "host").limit(n)


def candidates_for(identifier: str, leads: DataFrame, candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Samples of one vulnerability, by confidence, vendor and model."""
    mine = leads.where(F.col("identifier") == identifier)
    return mine.join(candidates, "candidate_id").join(sources.select("source_id", "name"), "source_id").orderBy(in_order("confidence", CONFIDENCE_ORDER), F.lower("vendor"), F.lower("model"), "candidate_id")


def least_with_lead(vulns: DataFrame, leads_of: Callable[[DataFrame], DataFrame], few: int = 1000) -> str | None:
    """The least identifier that has a lead.

    The ``few`` least vulnerabilities are looked up among the leads, which are not shuffled for it.
    What comes after them is greater than any that is found; all are looked up if none is.
    """
    known = vulns.where("identifier is not null")
    least = lambda some: leads_of(some).agg(F.min("identifier")).first()[0]
    found = least(F.broadcast(known.orderBy("identifier").limit(few)))
    return least(known) if found is None else found


def lead_details(leads: DataFrame, vulns: DataFrame) -> DataFrame:
    """Leads with their vulnerability where it is known; unknown ones stay."""
    return leads.join(vulns.select("identifier", "severity", "cvss_score"), "identifier", "left")


def collect_catalogue(candidates: DataFrame, leads: DataFrame, loads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leads whose candidate exists, and the failures (source, reason, n) of a collection.

    loads: source, error (null where it loaded), records.  A source that failed gives its error, one
    that gave nothing and one whose leads name no candidate are told as well, so that a partial
    collection is seen as such.
    """
    ids = candidates.select("candidate_id").distinct()
    kept = leads.join(ids, "candidate_id", "left_semi")
    lost = leads.join(ids, "candidate_id", "left_anti").groupBy("source").agg(F.count("*").alias("n")).select("source", F.lit("leads_without_candidate").alias("reason"), "n")
    failed = loads.where("error is not null").select("source", F.concat(F.lit("failed: "), "error").alias("reason"), F.coalesce("records", F.lit(0)).cast("long").alias("n"))
    empty = loads.where("error is null and coalesce(records, 0) = 0").select("source", F.lit("empty").alias("reason"), F.lit(0).cast("long").alias("n"))
    return kept, failed.unionByName(empty).unionByName(lost)
