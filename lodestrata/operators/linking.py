"""Linking firmware candidates to vulnerability claims by product identity and version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import versions as V

#: Score and confidence of each method.
METHODS = {"exact_version": (98, "high"), "version_range": (90, "high"), "product_scope": (58, "low")}
_BOUNDS = V.BOUNDS


def _with_bounds(claims: DataFrame) -> DataFrame:
    missing = [b for b in _BOUNDS if b not in claims.columns]
    return claims.withColumns({b: F.lit(None).cast("string") for b in missing})


def candidate_keys(candidates: DataFrame) -> DataFrame:
    """(vendor_key, product_key) of a candidate, from its product and from its model."""
    vendor = V.vendor_identity(F.col("vendor"))
    names = F.array_distinct(F.array(V.identity(F.col("product")), V.identity(F.col("model")) if "model" in candidates.columns else V.identity(F.col("product"))))
    return candidates.select("*", vendor.alias("vendor_key"), F.explode(names).alias("product_key")).where("vendor_key <> '' and product_key <> ''")


def link_versions(candidates: DataFrame, claims: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """The best lead of each candidate and vulnerability.

    An equi-join on vendor and product; then a claim with a version needs that very version, one
    with bounds a version in range, and one with neither takes the product as such.  Curated
    pairs are left alone.  Of several claims the highest score wins, then the first in
    ``claim_order`` (or by the claim's own text).
    """
    claims = _with_bounds(claims)
    if "claim_order" not in claims.columns:
        claims = claims.withColumn("claim_order", F.concat_ws("|", "version", *_BOUNDS))
    wanted = claims.select("identifier", "claim_order", F.col("version").alias("claimed"), *_BOUNDS, V.normalize_version(F.col("version")).alias("claimed_normal"), *(V.normalize_version(F.col(b)).alias(f"{b}_normal") for b in _BOUNDS), V.vendor_identity(F.col("vendor")).alias("vendor_key"), V.identity(F.col("product")).alias("product_key"))
    keyed = candidate_keys(V.with_candidate_versions(candidates, F.col("filename") if "filename" in candidates.columns else F.lit(""), F.col("version"))).select("candidate_id", "identities", "vendor_key", "product_key")
    met = keyed.join(wanted, ["vendor_key", "product_key"])
    bounded = F.greatest(*(F.coalesce(F.col(b), F.lit("")) != "" for b in _BOUNDS))
    exact = F.filter("identities", lambda i: V.same_version(i["normalized"], F.col("claimed_normal")))
    ranged = F.filter("identities", lambda i: V.in_range(i["normalized"], *(F.col(f"{b}_normal") for b in _BOUNDS)))
    stated = ~F.col("claimed_normal").isin(*V.NO_VERSION)
    met = met.withColumn("exact", F.get(exact, F.lit(0))).withColumn("ranged", F.get(ranged, F.lit(0)))
    method = F.when(stated, F.when(F.col("exact").isNotNull(), "exact_version")).when(bounded, F.when(F.col("ranged").isNotNull(), "version_range")).otherwise("product_scope")
    chosen = F.when(stated, F.col("exact")).when(bounded, F.col("ranged")).otherwise(F.get("identities", F.lit(0)))
    score, confidence = (F.create_map(*(F.lit(x) for k, v in METHODS.items() for x in (k, v[i]))) for i in (0, 1))
    leads = met.select(
        "candidate_id", "identifier", "claim_order", method.alias("match_method"), chosen["raw"].alias("candidate_version"), V.constraint_text(F.col("claimed"), *(F.col(b) for b in _BOUNDS)).alias("affected_constraint")
    ).where("match_method is not null")
    leads = leads.withColumn("match_score", score[F.col("match_method")]).withColumn("confidence", confidence[F.col("match_method")])
    if curated is not None:
        leads = leads.join(curated.select("candidate_id", "identifier"), ["candidate_id", "identifier"], "left_anti")
    best = Window.partitionBy("candidate_id", "identifier").orderBy(F.desc("match_score"), "claim_order")
    return leads.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place", "claim_order")


def link_counts(leads: DataFrame) -> DataFrame:
    return leads.groupBy("match_method").agg(F.count("*").alias("n"), F.countDistinct("candidate_id").alias("candidates"))
