"""Read models over vulnerabilities and the interfaces that analyses saw in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.interfaces import interface_style, interface_subtype, search_terms
from lodestrata.functions.versions import NO_IDENTITY
from lodestrata.operators.paging import latest
from lodestrata.operators.storage import settle

#: Vendors that the overview leaves out.
NO_VENDOR = ("", "n/a", "na", "unknown", "unspecified")
RELATED = ("strong", "likely")


def is_related(column: str = "relevance_level") -> Column:
    return F.col(column).isin(*RELATED)


def list_vulnerabilities(vulns: DataFrame, *, relevance: str | None = None, query: str | None = None, severity: str | None = None, source: str | None = None, vendor: str | None = None, kev_only: bool = False, exploit_only: bool = False, cwe: str | None = None) -> DataFrame:
    """All given filters hold; ``firmware`` means strong or likely.  Pages and order are the caller's.

    A query is matched as a substring, its ``%`` and ``_`` as wildcards, over five columns.
    """
    out = vulns
    if relevance == "firmware":
        out = out.where(is_related())
    elif relevance:
        out = out.where(F.col("relevance_level") == relevance)
    if query:
        columns = ("identifier", "title", "summary", "vendor", "product")
        out = out.where(F.greatest(*(F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False)) for c in columns)))
    if severity:
        out = out.where(F.col("severity") == severity.upper())
    if source:
        out = out.where(F.array_contains("sources", source) if "sources" in out.columns else F.col("source") == source)
    if vendor:
        out = out.where(F.lower("vendor") == vendor.lower())
    if kev_only:
        out = out.where("kev")
    if exploit_only:
        out = out.where("has_exploit")
    if cwe:
        out = out.where(F.array_contains("cwes", cwe))
    return out


def feed_order() -> list[Column]:
    first = F.coalesce("published_at", "modified_at", F.lit(""))
    second = F.coalesce("modified_at", "published_at", F.lit(""))
    return [first.desc(), second.desc(), F.col("identifier").desc()]


def overview(vulns: DataFrame) -> DataFrame:
    """One row of counts over related vulnerabilities."""
    count = lambda c: F.count_if(c)
    return vulns.where(is_related()).agg(
        F.count("*").alias("relevant"), count(F.col("severity") == "CRITICAL").alias("critical"), count(F.col("kev")).alias("kev"), count(F.col("has_exploit")).alias("exploit"), F.max("modified_at").alias("updated_at")
    )


def level_counts(vulns: DataFrame) -> DataFrame:
    return vulns.groupBy("relevance_level").agg(F.count("*").alias("n"))


def top_vendors(vulns: DataFrame, n: int = 10) -> DataFrame:
    """Vendors folded by case, under their least spelling."""
    known = vulns.where(is_related() & F.col("vendor").isNotNull() & ~F.lower("vendor").isin(*NO_VENDOR))
    return known.groupBy(F.lower("vendor").alias("folded")).agg(F.min("vendor").alias("vendor"), F.count("*").alias("n")).orderBy(F.desc("n"), "vendor").limit(n).select("vendor", "n")


def severity_counts(vulns: DataFrame) -> DataFrame:
    return vulns.groupBy(F.coalesce("severity", F.lit("UNKNOWN")).alias("severity"), F.coalesce("cvss_version", F.lit("Unknown")).alias("cvss_version")).agg(F.count("*").alias("n"))


def year_histogram(vulns: DataFrame, years: int = 12) -> DataFrame:
    """The latest years that have rows, in ascending order."""
    year = F.substring("published_at", 1, 4)
    counts = vulns.where(F.col("published_at").isNotNull()).groupBy(year.alias("year")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("year")).limit(years).orderBy("year")


def cwe_bridge(vulns: DataFrame, column: str = "cwes") -> DataFrame:
    """Distinct (identifier, cwe_id), as exploded from each vulnerability's own list."""
    return vulns.select("identifier", F.explode(F.array_distinct(column)).alias("cwe_id")).distinct()


def top_cwes(vulns: DataFrame, bridge: DataFrame, n: int = 10) -> DataFrame:
    related = vulns.where(is_related()).select("identifier")
    return bridge.where(F.col("cwe_id").rlike("^CWE-[0-9]")).join(related, "identifier").groupBy("cwe_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cwe_id").limit(n)


def styled(observations: DataFrame) -> DataFrame:
    style = interface_style(F.col("value"), F.col("kind"), F.col("component"))
    return observations.withColumn("category", style).withColumn("subtype", interface_subtype(F.col("value"), F.col("category"), F.col("kind"), F.col("component")))


def _known(column: str) -> Column:
    return F.when(~F.lower(F.coalesce(F.col(column), F.lit(""))).isin("", "n/a", "unknown"), F.col(column))


def category_profile(observations: DataFrame, vulns: DataFrame) -> DataFrame:
    """Distinct interfaces, vulnerabilities, known vendors and products, latest date, first five vendors.

    Repeats go before anything is counted: an interface is styled once, a vulnerability of a
    category counts once, and a category's vendors are deduplicated before five are taken.
    """
    named = observations.groupBy("value", "kind", "component", "identifier").agg(F.lit(1).alias("one"))
    seen = settle(named.withColumn("category", interface_style(F.col("value"), F.col("kind"), F.col("component"))).where("category <> ''").join(vulns.select("identifier"), "identifier", "left_semi").select("category", "value", "identifier").distinct())
    known = settle(seen.select("category", "identifier").distinct().join(vulns.select("identifier", _known("vendor").alias("vendor"), _known("product").alias("product"), F.coalesce("published_at", "modified_at").alias("at")), "identifier"))
    count = lambda df, c: df.select("category", c).where(F.col(c).isNotNull()).distinct().groupBy("category").agg(F.count("*").alias(f"{c}s"))
    vendors = latest(known.where("vendor is not null").select("category", "vendor").distinct(), ["category"], [F.col("vendor")], 5).groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("vendor")), "|").alias("first_vendors"))
    out = count(seen, "value").withColumnRenamed("values", "interfaces").join(count(known, "identifier").withColumnRenamed("identifiers", "vulnerabilities"), "category")
    for more in (count(known, "vendor"), count(known, "product"), known.groupBy("category").agg(F.max("at").alias("latest_at")), vendors):
        out = out.join(more, "category", "left")  # a row a category
    return out.select("category", "interfaces", "vulnerabilities", F.coalesce("vendors", F.lit(0)).alias("vendors"), F.coalesce("products", F.lit(0)).alias("products"), "latest_at", F.coalesce("first_vendors", F.lit("")).alias("first_vendors"))


def top_interfaces(observations: DataFrame, n: int = 5, by: str = "category") -> DataFrame:
    """The n interfaces of each category that most vulnerabilities share."""
    counts = styled(observations).where("category <> ''").groupBy(by, "value").agg(F.countDistinct("identifier").alias("vulnerabilities"), F.count("*").alias("occurrences"))
    return latest(counts, [by], [F.desc("vulnerabilities"), F.desc("occurrences"), F.col("value")], n, "place")


def explore_interfaces(observations: DataFrame, vulns: DataFrame, query: str = "") -> DataFrame:
    """Interfaces with counts, in order of relevance to ``query``: exact, prefix, contained, other."""
    counts = observations.join(vulns.select("identifier", "vendor"), "identifier").groupBy("value").agg(
        F.min("kind").alias("kind"), F.min("method").alias("method"), F.count("*").alias("occurrences"), F.countDistinct("identifier").alias("vulnerabilities"), F.countDistinct(_known("vendor")).alias("vendors")
    )
    v, q = F.lower("value"), query.lower()
    tier = F.when(v == q, 0).when(v.startswith(q), 1).when(v.contains(q), 2).otherwise(3)
    return counts.withColumn("tier", tier).where(F.lit(not q) | (F.col("tier") < 3))


def explore_parameters(parameters: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Parameters joined to interfaces of the same analysis and value.

    A value of several kinds fans a parameter out; the occurrences count joined rows.
    """
    i = interfaces.select("analysis_id", F.col("value").alias("interface_value"), "kind")
    return parameters.join(i, ["analysis_id", "interface_value"], "left").groupBy("name").agg(F.count("*").alias("occurrences"), F.countDistinct("identifier").alias("vulnerabilities"), F.countDistinct("kind").alias("kinds"))


def associations(observations: DataFrame, vulns: DataFrame, value: str) -> DataFrame:
    """Vulnerabilities in which an interface was seen, with the highest confidence."""
    hit = observations.where(F.col("value") == value).groupBy("identifier").agg(F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"), F.max("confidence").alias("confidence"))
    return hit.join(vulns.select("identifier", "severity", "cvss_score"), "identifier")


def subtype_rollup(observations: DataFrame) -> DataFrame:
    return styled(observations).where("category <> ''").groupBy("category", "subtype").agg(F.countDistinct("value").alias("interfaces"), F.countDistinct("identifier").alias("vulnerabilities"))


def recommend_similar(observations: DataFrame, value: str) -> DataFrame:
    """Interfaces of ``value``'s own category and subtype, scored by how alike their paths are.

    80 for the structure; 100 for the same path, +15 where one path holds the other, else up to
    +12 for shared terms; +10 first folder, +5 depth, +5 suffix; at most 99 but for the same path.
    """
    spark = observations.sparkSession
    path = lambda c: F.substring_index(c, "?", 1)
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    suffix = lambda c: F.when(c.contains("."), F.lower(F.substring_index(c, ".", -1))).otherwise("")
    leaf = lambda c: F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1)
    one = spark.range(1).select(F.lit(value).alias("q"))
    one = one.withColumn("q_category", interface_style(F.col("q"))).withColumn("q_subtype", interface_subtype(F.col("q"), F.col("q_category"))).withColumn("q", path(F.col("q")))
    # an interface is styled once, and apart from the scores: one expression of both is too long to compile
    counts = observations.groupBy("value", "kind", "component", "identifier").agg(F.lit(1).alias("one"))
    names = settle(styled(counts.select("value", "kind", "component").distinct()))
    same = [counts[c].eqNullSafe(names[c]) for c in ("value", "kind", "component")]
    rows = counts.join(names, same[0] & same[1] & same[2]).select(names["value"], "category", "subtype", "identifier").groupBy("value", "category", "subtype").agg(F.countDistinct("identifier").alias("vulnerabilities"))
    both = rows.join(F.broadcast(one), (F.col("category") == F.col("q_category")) & (F.col("subtype") == F.col("q_subtype")))  # one row
    both = both.withColumn("c", path(F.col("value")))
    q, c = F.lower("q"), F.lower("c")
    mine, theirs = search_terms(leaf(F.col("q"))), search_terms(leaf(F.col("c")))
    common = F.size(F.array_intersect(mine, theirs))
    tier = F.when(q == c, 0).when(q.contains(c) | c.contains(q), 1).when(common > 0, 2).otherwise(3)
    first = lambda p: F.coalesce(F.lower(F.get(parts(p), F.lit(0))), F.lit(""))
    base = F.when(F.col("tier") == 0, 100).when(F.col("tier") == 1, 95).when(F.col("tier") == 2, 80 + F.least(F.lit(12), F.bround(12 * common / F.size(mine)).cast("int"))).otherwise(80)

    def plus(score: Column, holds: Column, n: int) -> Column:
        return F.when((score < 100) & holds, score + n).otherwise(score)

    scored = both.withColumn("tier", tier).withColumn("score", base)
    for holds, n in (((first(F.col("q")) != "") & (first(F.col("q")) == first(F.col("c"))), 10), (F.size(parts(F.col("q"))) == F.size(parts(F.col("c"))), 5), ((suffix(F.col("q")) != "") & (suffix(F.col("q")) == suffix(F.col("c"))), 5)):
        scored = scored.withColumn("score", plus(F.col("score"), holds, n))
    top = F.when(F.col("tier") == 0, 100).otherwise(99)
    return scored.select("value", "tier", F.least("score", top).alias("score"), "vulnerabilities").orderBy("tier", F.desc("score"), F.desc("vulnerabilities"), "value")


def model_groups(vulns: DataFrame) -> DataFrame:
    """Vulnerabilities of each vendor and model, names normalised."""
    known = ~F.lower(F.coalesce("vendor", F.lit(""))).isin(*NO_IDENTITY)
    model = F.trim(F.regexp_replace("product", r"(?i)\s+(?:device\s+)?(?:firmware|software)$", ""))
    key = F.lower(F.regexp_replace(F.trim(F.concat_ws(" ", F.when(known, F.trim("vendor")), model)), r"\s+", " "))
    return vulns.groupBy(key.alias("model_key")).agg(F.min(model).alias("model"), F.count("*").alias("n"))


def with_cwe(vulns: DataFrame, bridge: DataFrame, cwe: str) -> DataFrame:
    """Vulnerabilities that the bridge (vulnerability_identifier, cwe_id) links to a CWE, whatever its case is given in."""
    linked = bridge.where(F.col("cwe_id") == cwe.upper()).select(F.col("vulnerability_identifier").alias("identifier"))
    return vulns.join(linked, "identifier", "left_semi")


#: What stands for a subtype that no label describes.
NO_SUBTYPE, INFERRED = "未分类", "基于路径语法、命名空间与分发形态推断。"


def with_subtype_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (category, subtype) with label and description of the subtype.

    labels: category, key, label, description, a row for each known subtype; others are named by
    themselves.
    """
    known = labels.select("category", F.col("key").alias("subtype"), F.col("label").alias("__label"), F.col("description").alias("__text")).dropDuplicates(["category", "subtype"])
    met = rows.join(known, ["category", "subtype"], "left")
    own = F.coalesce(F.nullif(F.col("subtype"), F.lit("")), F.lit(NO_SUBTYPE))
    return met.withColumns({"label": F.coalesce("__label", own), "description": F.coalesce("__text", F.lit(INFERRED))}).drop("__label", "__text")
