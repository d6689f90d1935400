"""The corpus operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import collocations, decontaminate, fingerprints, license_scan, line_dedup, mixing, near_dup, periodic_runs, quality_classifier, quality_rules, token_counts, unit_dedup, url_filter
from lodestrata.llm.common import read_table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated_documents(docs, read_table(spark, sf_dir, "benchmark")).drop("t")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.feed_list(pages)).select("page_id", "url_filter.*")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(read_table(spark, sf_dir, "documents")).drop("mix_key")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    scored = quality_classifier.score_quality(docs, model, into="score")
    predicted = (F.col("score") >= quality_classifier.POSITIVE_SCORE).cast("int")
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs).select("doc_id", "tokens.*")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, long_words=line_dedup.LONG_WORDS).select("doc_id", "text", "line_dedup.*")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicate_classes(docs).drop("t")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).select("doc_id", "licenses.*")


def op9_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return unit_dedup.repeated_units(docs, **unit_dedup.PASSAGES).drop("t")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality_rules.fit_quality_trees(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.score_documents(docs, trees).select("doc_id", "quality_rules.*")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.describe_runs(periodic_runs.with_echoes(docs))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read_table(spark, sf_dir, "documents"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op8_license_scan, which SQL expresses."""
    return op8_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op10_quality_rules, which SQL expresses."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", *quality_rules.COUNTS, "base_failed")


def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op13_fingerprints that do not rest on hashes, which SQL expresses."""
    return op13_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256", "next_doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_url_filter, op3_source_mix, op4_quality_classifier, op5_token_counts, op6_line_dedup, op7_near_dup, op8_license_scan, op9_unit_dedup, op10_quality_rules, op11_periodic_runs, op12_collocations, op13_fingerprints, license_phrases, quality_counts, edited_documents)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filter.URL_SQL, "op3_source_mix": mixing.MIX_SQL.format(documents="documents"), "op6_line_dedup": line_dedup.LINE_SQL, "op9_unit_dedup": unit_dedup.UNIT_SQL, "op11_periodic_runs": periodic_runs.RUN_SQL, "op12_collocations": collocations.COLLOCATION_SQL, "license_phrases": license_scan.BASE_SQL, "quality_counts": quality_rules.BASE_SQL, "edited_documents": fingerprints.EDIT_SQL}
