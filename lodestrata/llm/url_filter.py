"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Each listed URL sets eight bits in one 512-bit block of the filter.  Spark ORs the blocks
together; their number follows the list up to a fixed bound, so the filter that is broadcast
never passes ``MAX_FILTER_BYTES`` however long the list is (a fuller filter only lets more
false hits through).  Possible hits go to an exact hash join with the list, which removes the
false ones, so the verdicts do not depend on the filter's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import free, fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict and rule, host up to the first slash, then the path's start.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
BITS_PER_URL = 16
MAX_FILTER_BYTES = 16 << 20
#: Query parameters that do not change what a URL shows.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a last slash, query without tracking parameters.

    The scheme and the fragment do not count.  Null where the URL has no ``://``.
    """
    query = F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, rf"(?:\A|&){TRACKING}=[^&]*", ""), r"\A&", "")
    host, path = F.regexp_replace(host_of(url), r"\A(?:www|m)\.", ""), F.regexp_replace(path_of(url), r"/\z", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits the host or a parent domain; else null.

    ``rules`` is a short literal list; ties of length go to the rule that sorts first.
    """
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes: the index of each one's block, and eight words of one bit each."""
    h = h.astype(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    salts = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)
    shift = (((h & np.uint64(0xFFFFFFFF))[:, None] * salts) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
    return block.astype(np.int64), np.uint64(1) << shift


def bloom_filter(listed: DataFrame, column: str, max_bytes: int = MAX_FILTER_BYTES) -> np.ndarray:
    """The filter of ``listed``'s distinct values as an array (blocks, 8) of 64-bit words."""
    hashes = listed.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h"))
    n = hashes.agg(F.approx_count_distinct("h")).first()[0]
    blocks = max(1, min(max_bytes // 64, -(-n * BITS_PER_URL // 512)))

    def words(batches):
        """One row for each word that a task has set, its bits merged."""
        words = np.zeros((blocks, 8), np.uint64)
        for b in batches:
            block, bits = _bits(b.column("h").to_numpy(zero_copy_only=False), blocks)
            for k in range(8):
                np.bitwise_or.at(words[:, k], block, bits[:, k])
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words.ravel()[at].view(np.int64))], ["word", "bits"])

    merged = hashes.mapInArrow(words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(blocks * 8, np.int64)  # at most max_bytes reach the driver
    out[merged["word"].to_numpy()] = merged["bits"].to_numpy()
    return out.view(np.uint64).reshape(blocks, 8)


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, into: str = "url_filter", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Judge ``pages.url``; ``listed`` has one column of canonical URLs (null or repeated values do no harm).

    Adds a struct ``into``: host, path, rule, verdict and listed.  A fitting rule decides; else
    a listed URL is blocked and any other allowed.  A null URL or one without ``://`` has an
    empty host and path, fits no rule, is not listed and is allowed.  Other columns
    pass through; ``into`` must not be one of them.  Repeated rows get equal verdicts.
    """
    free(pages, into)
    spark = pages.sparkSession
    name = listed.columns[0]
    words = spark.sparkContext.broadcast(bloom_filter(listed, name, max_bytes))

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        table = words.value
        block, bits = _bits(h.to_numpy(zero_copy_only=False), len(table))
        return pa.array(((table[block] & bits) == bits).all(axis=1))

    key, hit, host, path = (fresh(pages, x) for x in ("canonical_url", "maybe_listed", "url_host", "url_path"))
    found = fresh(pages, "listed_url")
    url = F.col("url")
    judged = pages.withColumns({host: host_of(url), path: path_of(url), key: canonical(url)}).withColumn(hit, F.col(key).isNotNull() & maybe(F.xxhash64(key)))
    exact = listed.where(F.col(name).isNotNull()).select(F.col(name).alias(found)).distinct()

    def verdict(df: DataFrame, is_listed: Column) -> DataFrame:
        r = rule_for(F.col(host), F.col(path), rules)
        method = F.when(is_listed, "block").otherwise("allow")
        return df.select(*pages.columns, F.struct(F.col(host).alias("host"), F.col(path).alias("path"), r["rule"].alias("rule"), F.coalesce(r["verdict"], method).alias("verdict"), is_listed.alias("listed")).alias(into))

    hits = judged.where(F.col(hit)).join(exact, F.col(key) == F.col(found), "left")
    return verdict(judged.where(~F.col(hit)), F.lit(False)).unionByName(verdict(hits, F.col(found).isNotNull()))


def feed_list(pages: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs of pages that a feed links to with tracking parameters."""
    return pages.where(F.col("url").rlike(r"[?&]utm_source=feed(?:[&#]|\z)")).select(canonical(F.col("url")).alias("listed")).where("listed is not null")


URL_SQL = r"""
WITH p AS (
  SELECT page_id, url,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), u AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '(?:^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS query
  FROM p
), k AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '/$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical
  FROM u
), l AS (
  SELECT DISTINCT canonical FROM k WHERE regexp_matches(url, '[?&]utm_source=feed(?:[&#]|$)') AND canonical IS NOT NULL
), r(verdict, rule) AS (
  VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')
), f AS (
  SELECT k.page_id, k.host, k.path, k.canonical, k.url, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM (SELECT *, row_number() OVER () AS n FROM k) k
  LEFT JOIN r ON (k.host = split_part(r.rule, '/', 1) OR ends_with(k.host, '.' || split_part(r.rule, '/', 1)))
             AND starts_with(k.path, substr(r.rule, instr(r.rule, '/')))
  GROUP BY k.n, k.page_id, k.host, k.path, k.canonical, k.url
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canonical IS NOT NULL AS listed
FROM f LEFT JOIN l USING (canonical)
"""
