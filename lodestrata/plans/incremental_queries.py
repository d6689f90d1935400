"""Windowed and huge sources, keyed incremental merging and its summaries as queries, each beside its SQL."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.storage import shared_folder
from lodestrata.plans.catalogue_queries import _sql
from lodestrata.plans.queries import query
from lodestrata.sources import arrays, paged
from lodestrata.streaming.keyed import CursorTable, KeyedTable, Summary, merge_stream


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/{name}/{uuid.uuid4().hex}"


# windows and pages

_START = datetime(1992, 1, 1, tzinfo=timezone.utc)


def _recorded(orders: DataFrame, path: str, since: str = "", until: str = "9") -> None:
    """Orders as the answers of a source with windows of 60 days and pages of 250 records."""
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    item = F.struct(F.concat(F.lit("CVE-"), "o_orderkey").alias("id"), day.alias("lastModified"), F.concat(F.lit("status ‘"), "o_orderstatus", F.lit('" {')).alias("vulnStatus"))
    rows = orders.where((day >= since) & (day < until)).select(F.col("o_orderdate").cast("timestamp").alias("modified"), F.to_json(item).alias("record"))
    paged.record_pages(rows, path, _START, 60 * 24, 250)


def _feed(spark, path: str, stream: bool = False) -> DataFrame:
    spark.dataSource.register(paged.PagedFeed)
    return (spark.readStream if stream else spark.read).format("paged_feed").options(path=path, start=_START.isoformat(), pages="4").load()


@query
def paged_records(v):
    orders = v("orders")
    path = _folder(orders, "pages")
    _recorded(orders, path)
    rows = _feed(orders.sparkSession, path)
    number = F.col("start_index") + F.col("place")  # an answer's offset counts the window's records before it
    id_of = F.get_json_object("record", "$.id")
    return rows.withColumn("number", number).select(id_of.alias("identifier"), F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), F.date_format("window_end", "yyyy-MM-dd").alias("window_end"), "start_index", F.col("number").cast("long").alias("number"), F.get_json_object("record", "$.vulnStatus").alias("status"))


_sql("paged_records", """WITH o AS (SELECT 'CVE-' || o_orderkey AS identifier, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS day, 'status ‘' || o_orderstatus || '" {' AS status, o_orderstatus FROM orders),
 w AS (SELECT *, DATE '1992-01-01' + CAST(60 * (date_diff('day', DATE '1992-01-01', CAST(day AS DATE)) // 60) AS INTEGER) AS s, '{"id":"' || identifier || '","lastModified":"' || day || '","vulnStatus":"status ‘' || o_orderstatus || '\\" {"}' AS record FROM o),
 n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY day, record) - 1 AS number FROM w)
SELECT identifier, strftime(s, '%Y-%m-%d') AS window_start, strftime(s + 60, '%Y-%m-%d') AS window_end, CAST(number // 250 * 250 AS INTEGER) AS start_index, number, status FROM n""")


def _identified(feed: DataFrame) -> DataFrame:
    """Records with the number of their identifier, each parsed once: as one element to ``inline``, no filter goes below and parses it again."""
    parsed = feed.select("window_end", F.inline(F.array(F.from_json("record", "id string, lastModified string"))))
    return parsed.withColumn("o_orderkey", F.substring("id", len("CVE-") + 1, 20).cast("long"))


_SYNC_SCHEMA = "identifier string, source string, title string, modified_at string, vendor string, severity string, cwes array<string>, arrived string"


@query
def synced_records(v):
    """Two runs of the stream, the second after more windows were recorded, merged by customer."""
    orders = v("orders")
    spark, path = orders.sparkSession, _folder(orders, "sync")
    by_key = orders.select("o_orderkey", "o_custkey")
    table = KeyedTable(spark, f"{path}/table", _SYNC_SCHEMA, "arrived", buckets=16)
    cursors = CursorTable(spark, f"{path}/cursors")
    _recorded(orders, f"{path}/pages", until="1995-04-15")  # the end of a window
    for since in (None, "1995-04-15"):
        if since:
            # windows count from the start: those recorded already are empty here and left out
            _recorded_after(orders, f"{path}/pages", since)
        feed = _identified(_feed(spark, f"{path}/pages", stream=True)).select("o_orderkey", F.col("lastModified").alias("modified_at"), F.date_format("window_end", "yyyy-MM-dd").alias("until"))
        n = F.col("o_orderkey")
        rows = feed.join(by_key, "o_orderkey").select(
            F.concat(F.lit("C"), F.col("o_custkey") % 500).alias("identifier"), F.when(n % 5 == 0, "cisa-kev").otherwise("nvd").alias("source"), F.concat(F.lit("order "), n).alias("title"), "modified_at", F.when(n % 3 == 0, "n/a").otherwise(F.concat(F.lit("v"), n % 7)).alias("vendor"),
            F.when(n % 4 != 0, F.concat(F.lit("s"), n % 3)).alias("severity"), F.array(F.concat(F.lit("CWE-"), n % 5), F.concat(F.lit("CWE-"), n % 3)).alias("cwes"), F.concat_ws(" ", "modified_at", F.lpad(n.cast("string"), 12, "0")).alias("arrived"), "until",
        )
        merge_stream(rows, table, f"{path}/checkpoint", cursors=cursors, source="nvd", cursor=F.col("until")).awaitTermination()
    merged = table.read().select("identifier", "title", "modified_at", "vendor", "severity", "sources", F.array_join("cwes", ",").alias("cwes"))
    return merged.crossJoin(F.broadcast(cursors.read().select(F.col("cursor").alias("read_until"))))  # a row for the one source


def _recorded_after(orders: DataFrame, path: str, since: str) -> None:
    """The windows from ``since`` on, numbered from there."""
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    item = F.struct(F.concat(F.lit("CVE-"), "o_orderkey").alias("id"), day.alias("lastModified"))
    rows = orders.where(day >= since).select(F.col("o_orderdate").cast("timestamp").alias("modified"), F.to_json(item).alias("record"))
    paged.record_pages(rows, path, datetime.fromisoformat(since).replace(tzinfo=timezone.utc), 60 * 24, 400)


_RECORDS = """r AS (SELECT 'C' || (o_custkey % 500) AS identifier, CASE WHEN o_orderkey % 5 = 0 THEN 'cisa-kev' ELSE 'nvd' END AS source, 'order ' || o_orderkey AS title, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS modified_at,
 CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE 'v' || (o_orderkey % 7) END AS vendor, CASE WHEN o_orderkey % 4 <> 0 THEN 's' || (o_orderkey % 3) END AS severity, 'CWE-' || (o_orderkey % 5) AS c1, 'CWE-' || (o_orderkey % 3) AS c2,
 substr(CAST(o_orderdate AS VARCHAR), 1, 10) || ' ' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS arrived FROM orders),
 u AS (SELECT identifier, c1 AS c, arrived || '0' AS pos FROM r UNION ALL SELECT identifier, c2, arrived || '1' FROM r), f AS (SELECT identifier, c, min(pos) AS pos FROM u GROUP BY ALL), l AS (SELECT identifier, string_agg(c, ',' ORDER BY pos) AS cwes FROM f GROUP BY identifier),
 m AS (SELECT identifier, coalesce(arg_max(title, arrived) FILTER (source = 'cisa-kev'), arg_min(title, arrived)) AS title, max(modified_at) AS modified_at, arg_max(vendor, arrived) FILTER (vendor <> 'n/a') AS vendor, arg_max(severity, arrived) FILTER (severity IS NOT NULL) AS severity,
  string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM r GROUP BY identifier)"""

_sql("synced_records", f"""WITH {_RECORDS}
SELECT identifier, title, modified_at, vendor, severity, sources, cwes, strftime((SELECT DATE '1995-04-15' + CAST(60 * (1 + date_diff('day', DATE '1995-04-15', CAST(max(o_orderdate) AS DATE)) // 60) AS INTEGER) FROM orders), '%Y-%m-%d') AS read_until FROM m JOIN l USING (identifier)""")


# keyed merging in batches

_SUMMARY = Summary(("severity", "vendor", "sources", "cwes"), ("vendor", "cwes"))


def _in_batches(orders: DataFrame) -> tuple[KeyedTable, list[list[int]]]:
    """Records in four batches, out of order, one of them twice."""
    n = F.col("o_orderkey")
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    rows = orders.select(
        F.concat(F.lit("C"), F.col("o_custkey") % 500).alias("identifier"), F.when(n % 5 == 0, "cisa-kev").otherwise("nvd").alias("source"), F.concat(F.lit("order "), n).alias("title"), day.alias("modified_at"), F.when(n % 3 == 0, "n/a").otherwise(F.concat(F.lit("v"), n % 7)).alias("vendor"),
        F.when(n % 4 != 0, F.concat(F.lit("s"), n % 3)).alias("severity"), F.array(F.concat(F.lit("CWE-"), n % 5), F.concat(F.lit("CWE-"), n % 3)).alias("cwes"), F.concat_ws(" ", day, F.lpad(n.cast("string"), 12, "0")).alias("arrived"), (n % 4).alias("batch"),
    )
    table = KeyedTable(orders.sparkSession, _folder(orders, "keyed"), _SYNC_SCHEMA, "arrived", buckets=32)
    return table, [table.apply(rows.where(F.col("batch") == b), _SUMMARY) for b in (2, 0, 3, 0, 1)]


@query
def incremental_merge(v):
    table, _ = _in_batches(v("orders"))
    return table.read().select("identifier", "title", "modified_at", "vendor", "severity", "sources", F.array_join("cwes", ",").alias("cwes"))


_sql("incremental_merge", f"WITH {_RECORDS} SELECT * FROM m JOIN l USING (identifier)")


@query
def incremental_summary(v):
    table, _ = _in_batches(v("orders"))
    return Summary.totals(table.summaries(_SUMMARY)).select("facet", "value", F.col("n").cast("long").alias("n"))


_sql("incremental_summary", f"""WITH {_RECORDS}, x AS (SELECT 'severity' AS facet, severity AS value FROM m UNION ALL SELECT 'vendor', vendor FROM m UNION ALL SELECT 'sources', sources FROM m UNION ALL SELECT 'cwes', c FROM f)
SELECT facet, value, count(*) AS n FROM x WHERE value <> '' GROUP BY ALL UNION ALL SELECT 'all', '', count(*) FROM m UNION ALL SELECT 'distinct vendor', '', count(DISTINCT vendor) FROM m UNION ALL SELECT 'distinct cwes', '', count(DISTINCT c) FROM f""")


# huge arrays

@query
def array_objects(v):
    """Feed files, each one array in one line, read in blocks: objects that lie across blocks too."""
    orders = v("orders")
    spark, path = orders.sparkSession, _folder(orders, "arrays")
    text = F.concat(F.lit('say "}{" \\ '), "o_orderpriority")
    item = F.to_json(F.struct(F.struct(F.col("o_orderkey").alias("id"), F.struct(text.alias("text"), F.array(F.struct(F.col("o_custkey").alias("k"))).alias("links")).alias("body")).alias("cve")))
    file = F.floor(F.col("o_orderkey") / 20_000)  # of bounded size
    arrays_of = orders.select(file.alias("file"), item.alias("item")).groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    arrays_of.select(F.concat(F.lit('{"format":"x","other":[{"no":1}],"vulnerabilities":['), "items", F.lit('],"after":[{"no":2}]}')).alias("value"), "file").write.partitionBy("file").text(path)
    found = arrays.read_array(spark, path)
    return found.select(F.get_json_object("value", "$.cve.id").cast("long").alias("id"), F.get_json_object("value", "$.cve.body.links[0].k").cast("long").alias("k"), F.get_json_object("value", "$.cve.body.text").alias("text"), "whole")


_sql("array_objects", """SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS k, 'say "}{" \\ ' || o_orderpriority AS text, true AS whole FROM orders""")
