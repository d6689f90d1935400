"""Readers of vulnerability feeds and public firmware lists."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.versions import meaningful_identity
from lodestrata.operators.catalogue import download_host
from lodestrata.sources.arrays import read_array

META_KEYS = ("lastModifiedDate", "size", "zipSize", "gzSize", "sha256")

#: vendors' names for what CPEs spell otherwise.
VENDOR_LABELS = {"d-link": "D-Link", "dlink": "D-Link", "tp-link": "TP-Link", "tplink": "TP-Link", "netgear": "NETGEAR", "totolink": "TOTOLINK"}
#: Keys of metrics, best ones first, and the versions that they stand for.
METRIC_KEYS = {"cvssMetricV40": "4.0", "cvssMetricV31": "3.1", "cvssMetricV30": "3.0", "cvssMetricV2": "2.0"}
#: Levels of nodes below a configuration's own; what lies deeper is told by ``nodes_cut``.
NODE_LEVELS = 5

_CPE = "struct<vulnerable: boolean, criteria: string, matchCriteriaId: string, versionStartIncluding: string, versionStartExcluding: string, versionEndIncluding: string, versionEndExcluding: string>"
_DATA = "struct<version: string, vectorString: string, baseScore: double, baseSeverity: string, attackVector: string, accessVector: string, attackComplexity: string, accessComplexity: string, privilegesRequired: string, authentication: string, userInteraction: string, scope: string>"
_METRIC = f"struct<source: string, type: string, cvssData: {_DATA}, baseSeverity: string, exploitabilityScore: double, impactScore: double, userInteractionRequired: string>"


def _node(levels: int) -> str:
    return f"struct<vulnerable: boolean, cpeMatch: array<{_CPE}>, children: array<{_node(levels - 1) if levels else 'string'}>>"


CVE_SCHEMA = f"""
id string, published string, lastModified string, vulnStatus string, cisaVulnerabilityName string,
descriptions array<struct<lang: string, value: string>>,
metrics struct<{", ".join(f"{k}: array<{_METRIC}>" for k in METRIC_KEYS)}>,
weaknesses array<struct<source: string, type: string, description: array<struct<lang: string, value: string>>>>,
configurations array<struct<vulnerable: boolean, nodes: array<{_node(NODE_LEVELS)}>>>,
affected array<struct<vendor: string, product: string, cpes: array<string>>>,
`references` array<struct<url: string, source: string, tags: array<string>>>
"""


def feed_names(first: int, last: int) -> list[str]:
    """Yearly feeds."""
    return [str(y) for y in range(first, last + 1)]


def time_windows(start: datetime, end: datetime, hours: int = 120) -> list[tuple[str, str]]:
    """Sub-windows of a time range, as UTC texts; an empty range has none.

    Both ends need a time zone; ``hours`` lies in 1..2880.
    """
    if start.tzinfo is None or end.tzinfo is None:
        raise ValueError("both ends need a time zone")
    if not 1 <= hours <= 2880:
        raise ValueError("a window lasts 1 to 2880 hours")
    out, at = [], start
    while at < end:
        to = min(end, at + timedelta(hours=hours))
        out.append((_utc(at), _utc(to)))
        at = to
    return out


def _utc(t: datetime) -> str:
    t = t.astimezone(timezone.utc)
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


def feed_time(t: Column) -> Column:
    """A timestamp as feeds write it: UTC with milliseconds and a Z."""
    return F.concat(F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of (gzipped) feed files, read in blocks: the column ``cve``."""
    items = read_array(spark, path).select(F.when(F.col("whole"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("a feed is cut off: "), "file"))).alias("item"))
    return items.select(F.from_json(F.coalesce(F.get_json_object("item", "$.cve"), F.col("item")), CVE_SCHEMA).alias("cve"))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row for each META file; a file without all five keys raises an error."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.split("value", r"\r?\n")).alias("line")).where("line like '%:%'")
    pairs = lines.select("file", F.trim(F.substring_index("line", ":", 1)).alias("key"), F.trim(F.expr("substr(line, instr(line, ':') + 1)")).alias("value"))
    wide = pairs.groupBy("file").pivot("key", list(META_KEYS)).agg(F.first("value"))
    whole = F.greatest(*(F.col(k).isNull() for k in META_KEYS))
    return wide.select("file", *(F.when(whole, F.raise_error(F.lit("a META file lacks keys"))).otherwise(F.col(k)).alias(k) for k in META_KEYS))


def severity(score: Column, version: Column) -> Column:
    """The band of a CVSS score; version 2 has no CRITICAL."""
    second = version.startswith("2")
    return F.when(score == 0, F.when(second, "LOW").otherwise("NONE")).when(score < 4, "LOW").when(score < 7, "MEDIUM").when(second | (score < 9), "HIGH").otherwise("CRITICAL")


def _listed(values: Column) -> Column:
    """A null list is empty."""
    return F.filter(F.coalesce(values, F.array()), lambda x: x.isNotNull())


def _matches(node: Column, inherited: Column, levels: int) -> Column:
    """Matches of a node and, after them, of those below it; each is vulnerable as it or what holds it says."""
    own = F.coalesce(node["vulnerable"], inherited)
    fields = {"match_criteria_id": "matchCriteriaId", "version_start_including": "versionStartIncluding", "version_start_excluding": "versionStartExcluding", "version_end_including": "versionEndIncluding", "version_end_excluding": "versionEndExcluding"}
    mine = F.transform(F.coalesce(node["cpeMatch"], F.array()), lambda m: F.struct(m["criteria"].alias("criteria"), F.coalesce(m["vulnerable"], own, F.lit(False)).alias("vulnerable"), *(m[f].alias(n) for n, f in fields.items())))
    mine = F.filter(mine, lambda m: m["criteria"].isNotNull())
    if not levels:
        return mine
    return F.concat(mine, F.flatten(F.transform(F.coalesce(node["children"], F.array()), lambda c: _matches(c, own, levels - 1))))


def _too_deep(node: Column, levels: int) -> Column:
    below = F.coalesce(node["children"], F.array())
    return F.exists(below, lambda c: _too_deep(c, levels - 1)) if levels else F.size(below) > 0


def _metrics(metrics: Column) -> Column:
    """All metrics, the best versions first and of one version the primary ones."""

    def of(key: str, version: str) -> Column:
        def row(m: Column) -> Column:
            d = m["cvssData"]
            named = F.coalesce(F.nullif(d["version"], F.lit("")), F.lit(version))
            band = F.coalesce(F.nullif(d["baseSeverity"], F.lit("")), F.nullif(m["baseSeverity"], F.lit("")), severity(d["baseScore"], named))
            either = lambda a, b: F.coalesce(F.nullif(d[a], F.lit("")), b)
            return F.struct(
                named.alias("version"), m["type"].alias("type"), m["source"].alias("source"), d["baseScore"].alias("base_score"), F.upper(band).alias("base_severity"), d["vectorString"].alias("vector"), m["impactScore"].alias("impact_score"), m["exploitabilityScore"].alias("exploitability_score"),
                either("attackVector", d["accessVector"]).alias("attack_vector"), either("attackComplexity", d["accessComplexity"]).alias("attack_complexity"), either("privilegesRequired", d["authentication"]).alias("privileges_required"),
                either("userInteraction", m["userInteractionRequired"]).alias("user_interaction"), d["scope"].alias("scope"),
            )

        rows = F.transform(F.coalesce(metrics[key], F.array()), row)
        return F.concat(F.filter(rows, lambda m: m["type"].eqNullSafe("Primary")), F.filter(rows, lambda m: ~m["type"].eqNullSafe("Primary")))

    return F.concat(*(of(k, version) for k, version in METRIC_KEYS.items()))


def _named(stated: Column, cpes: Column, part: str) -> Column:
    """Meaningful names that a record states or its CPEs hold, each once whatever its case, first spellings kept."""
    at = {"vendor": 0, "product": 1}[part]

    def of_cpe(c: Column) -> Column:
        p = F.split(c, ":")
        found = F.when(c.startswith("cpe:/") & (F.size(p) >= 4), F.get(p, F.lit(2 + at))).when(F.size(p) >= 5, F.get(p, F.lit(3 + at)))
        name = F.replace(found, F.lit("_"), F.lit(" "))
        return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in VENDOR_LABELS.items() for x in kv)), F.lower(name)), name) if part == "vendor" else name

    every = F.transform(F.concat(_listed(stated), F.transform(cpes, of_cpe)), lambda x: F.trim(x))
    good = F.filter(every, lambda x: x.isNotNull() & meaningful_identity(x))
    folded = F.transform(good, lambda x: F.lower(x))
    return F.filter(good, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)


def normalize_cve(feed: DataFrame) -> DataFrame:
    """Feed records as vulnerability records: English text, CPEs of all nodes, metrics, names, CWEs, references."""
    c = F.col("cve")
    english = F.filter(c["descriptions"], lambda d: d["lang"] == "en")
    configurations = F.coalesce(c["configurations"], F.array())
    products = F.flatten(F.transform(configurations, lambda x: F.flatten(F.transform(F.coalesce(x["nodes"], F.array()), lambda n: _matches(n, x["vulnerable"], NODE_LEVELS)))))
    cut = F.exists(configurations, lambda x: F.exists(F.coalesce(x["nodes"], F.array()), lambda n: _too_deep(n, NODE_LEVELS)))
    affected = F.coalesce(c["affected"], F.array())
    weak = F.filter(F.flatten(F.transform(F.coalesce(c["weaknesses"], F.array()), lambda w: F.transform(F.coalesce(w["description"], F.array()), lambda d: d["value"]))), lambda x: x != "")
    links = F.filter(F.coalesce(c["references"], F.array()), lambda r: r["url"] != "")
    exploit = F.filter(links, lambda r: F.exists(F.coalesce(r["tags"], F.array()), lambda t: F.lower(t) == "exploit"))
    out = feed.select(
        F.trim(c["id"]).alias("identifier"), F.lit("nvd").alias("source"), F.coalesce(F.get(english, F.lit(0))["value"], F.get(c["descriptions"], F.lit(0))["value"], F.lit("")).alias("summary"), c["published"].alias("published_at"), c["lastModified"].alias("modified_at"),
        products.alias("affected_products"), cut.alias("nodes_cut"), _metrics(c["metrics"]).alias("cvss_metrics"), F.array_sort(F.array_distinct(weak)).alias("cwes"), F.transform(links, lambda r: r["url"]).alias("references"), F.transform(exploit, lambda r: r["url"]).alias("exploit_references"),
        F.nullif(c["cisaVulnerabilityName"], F.lit("")).alias("__name"), affected.alias("__affected"),
    )
    stated = lambda f: F.transform("__affected", lambda a: a[f])
    listed = F.flatten(F.transform("__affected", lambda a: F.coalesce(a["cpes"], F.array())))
    out = out.withColumn("cpes", F.array_distinct(F.concat(F.transform("affected_products", lambda m: m["criteria"]), _listed(listed))))
    out = out.withColumns({"vendors": _named(stated("vendor"), F.col("cpes"), "vendor"), "products": _named(stated("product"), F.col("cpes"), "product")})
    best = F.get("cvss_metrics", F.lit(0))
    out = out.withColumns({"vendor": F.get("vendors", F.lit(0)), "product": F.get("products", F.lit(0)), "cvss_score": best["base_score"], "severity": best["base_severity"], "cvss_vector": best["vector"], "cvss_version": best["version"]})
    out = out.withColumns({n: best[n] for n in ("impact_score", "exploitability_score", "attack_vector", "attack_complexity", "privileges_required", "user_interaction", "scope")})
    return out.withColumn("title", F.coalesce("__name", summary_title())).withColumn("kev", F.lit(False)).drop("__name", "__affected")


def summary_title() -> Column:
    """Identifier with vendor and product; else the text before its first full stop and blank, 120 characters at most; else the identifier."""
    vendor, product = F.coalesce("vendor", F.lit("")), F.coalesce("product", F.lit(""))
    named = F.trim(F.concat("identifier", F.lit(" · "), vendor, F.lit(" "), product))
    first = F.substring(F.regexp_replace(F.substring_index(F.coalesce("summary", F.lit("")), ". ", 1), r"^\s+|\s+$", ""), 1, 120)
    return F.when((vendor != "") | (product != ""), named).when(first != "", first).otherwise(F.col("identifier"))


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of exploited vulnerabilities as records."""
    item = "array<struct<cveID: string, vendorProject: string, product: string, vulnerabilityName: string, dateAdded: string, shortDescription: string, requiredAction: string, dueDate: string, knownRansomwareCampaignUse: string, notes: string, cwes: array<string>>>"
    return normalize_kev(spark.read.schema(f"dateReleased string, vulnerabilities {item}").option("multiLine", True).json(path).select("dateReleased", F.explode("vulnerabilities").alias("v")))


def normalize_kev(rows: DataFrame) -> DataFrame:
    """(dateReleased, v) of the catalogue's items as records."""
    links = F.filter(F.transform(F.split(F.coalesce("v.notes", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x.startswith("http"))
    return rows.select(
        F.col("v.cveID").alias("identifier"), F.lit("cisa-kev").alias("source"), F.col("v.vulnerabilityName").alias("title"), F.col("v.shortDescription").alias("summary"), F.col("v.vendorProject").alias("vendor"), F.col("v.product").alias("product"),
        F.col("v.dateAdded").alias("kev_date_added"), F.col("v.dueDate").alias("kev_due_date"), F.col("v.knownRansomwareCampaignUse").alias("ransomware_use"), F.col("v.requiredAction").alias("required_action"), F.coalesce("v.cwes", F.array().cast("array<string>")).alias("cwes"), links.alias("references"), F.lit(True).alias("kev"), F.col("dateReleased").alias("modified_at"),
    )


def vulnerability_identifiers(text: Column) -> Column:
    """Distinct CVE and CNVD ids in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b((?:CVE-\d{4}-\d+|CNVD-\d{4}-\d+))\b"), 1))


def benchmark_identifiers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(BM-\d{4}-\d+)\b"), 1))


def device_table(lines: DataFrame) -> DataFrame:
    """Rows of a Markdown table with four columns; headings and rules are no rows."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.where(F.trim("value").rlike(r"^\|.*\|$")).withColumn("cells", cells).where("size(cells) = 4")
    rule = F.forall("cells", lambda c: c.rlike(r"^:?-+:?$"))
    return rows.where(~rule & (F.lower(F.get("cells", F.lit(0))) != "vendor")).select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("vendor", "model", "version", "link"))))


def url_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of a CSV list of download links; other schemes and links without host go."""
    return catalogue_rows(spark.read.schema("url string, vendor string, product string, version string, date string").option("header", True).csv(path))


def catalogue_rows(rows: DataFrame) -> DataFrame:
    """Download links (url, vendor, product, version) as candidates."""
    known = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))
    kept = rows.where(F.col("url").rlike(r"^(?i)(?:https?|ftp)://") & (F.coalesce(download_host(F.col("url")), F.lit("")) != ""))
    return kept.select(
        F.concat(F.lit("list:"), F.sha2("url", 256)).alias("candidate_id"), known("vendor").alias("vendor"), known("product").alias("product"), known("version").alias("version"), F.col("url").alias("download_url"),
        download_host(F.col("url")).alias("download_host"), F.substring_index(F.substring_index("url", "?", 1), "/", -1).alias("filename"),
    )


def verify_files(files: DataFrame, meta: DataFrame) -> DataFrame:
    """(name, valid): size and SHA-256 of each file's content against its META."""
    own = files.select("name", F.length("content").alias("size"), F.upper(F.sha2("content", 256)).alias("sha256"))
    wanted = meta.select("name", F.col("size").cast("long").alias("wanted_size"), F.upper("sha256").alias("wanted_sha256"))
    return own.join(wanted, "name", "left").select("name", F.coalesce((F.col("size") == F.col("wanted_size")) & (F.col("sha256") == F.col("wanted_sha256")), F.lit(False)).alias("valid"))


def feeds_to_load(meta: DataFrame, states: DataFrame, force: bool = False) -> DataFrame:
    """Feeds whose content is not what was imported last."""
    done = states.where("status = 'imported'").select("name", "sha256")
    return meta if force else meta.join(done, ["name", "sha256"], "left_anti")
