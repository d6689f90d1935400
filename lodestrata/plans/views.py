"""Views that give the driver's tables the roles of the engine's own tables.

Each view is one SQL text for Spark and DuckDB alike, with deterministic arithmetic only, so
an operator's DataFrame plan and its SQL start from the same rows.  Placeholders in braces name
base tables or earlier views.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "routes": """
SELECT p_partkey AS part_id,
       concat(CASE p_partkey % 11 WHEN 0 THEN '/goform/Set' WHEN 1 THEN '/cgi-bin/' WHEN 2 THEN '/HNAP1/' WHEN 3 THEN '/api/v1/' WHEN 4 THEN '/admin/'
                   WHEN 5 THEN '/rest/' WHEN 6 THEN '/' WHEN 7 THEN '/goform/' WHEN 8 THEN '/form/' WHEN 9 THEN '/web/mod/' ELSE 'dev.' END,
              replace(p_name, ' ', '_'),
              CASE p_partkey % 11 WHEN 1 THEN '.cgi' WHEN 6 THEN '.asp' WHEN 9 THEN '.php' ELSE '' END) AS value,
       CASE WHEN p_partkey % 11 = 10 THEN 'rpc' ELSE 'http_route' END AS kind,
       CASE WHEN p_partkey % 5 = 0 THEN 'message handler' ELSE p_type END AS component,
       p_brand AS vendor, p_name AS product
FROM {part}""",
    "vulns": """
SELECT concat('CVE-', substr(CAST(o_orderdate AS STRING), 1, 4), '-', CAST(o_orderkey AS STRING)) AS identifier, o_orderkey AS vid,
       CASE WHEN o_custkey % 13 = 0 THEN 'n/a' WHEN o_custkey % 17 = 0 THEN concat('VENDOR ', CAST(o_custkey % 40 AS STRING)) WHEN o_custkey % 19 = 0 THEN CAST(NULL AS STRING)
            WHEN o_custkey % 11 = 0 THEN 'TP-Link' ELSE concat('Vendor ', CAST(o_custkey % 40 AS STRING)) END AS vendor,
       concat('Model R', CAST(o_custkey % 97 AS STRING)) AS product,
       concat('Issue ', CAST(o_orderkey AS STRING), CASE o_orderkey % 4 WHEN 0 THEN ' in router' WHEN 1 THEN ' in access_point' WHEN 2 THEN ' in cloud service' ELSE '' END) AS title,
       CASE o_orderkey % 7 WHEN 0 THEN 'A firmware update is not checked. Remote attackers can win.' WHEN 1 THEN 'The desktop application leaks.' WHEN 2 THEN 'Routers of this gateway restart.'
            WHEN 3 THEN 'Stack overflow in the u-boot loader' WHEN 4 THEN 'Firmwares are old' ELSE 'Nothing more is known.' END AS summary,
       CASE WHEN o_orderkey % 10 = 0 THEN CAST(NULL AS STRING) ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' ELSE 'LOW' END END AS severity,
       CASE WHEN o_orderkey % 9 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 3 = 0 THEN '2.0' ELSE '3.1' END AS cvss_version,
       CAST(o_orderkey % 101 AS DOUBLE) / 10 AS cvss_score,
       CASE WHEN o_orderkey % 23 = 0 THEN CAST(NULL AS STRING) ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS published_at,
       substr(CAST(o_orderdate AS STRING), 1, 10) AS modified_at,
       concat('CWE-', CAST(o_orderkey % 29 AS STRING), ';CWE-', CAST(o_custkey % 31 AS STRING), CASE WHEN o_orderkey % 5 = 0 THEN ';NVD-CWE-noinfo' ELSE '' END) AS cwe_list,
       concat('cpe:2.3:', CASE WHEN o_orderkey % 6 = 0 THEN 'h' ELSE 'o' END, ':vendor:product:*:*:*:*:*:', CASE WHEN o_orderkey % 15 = 0 THEN 'firmware' ELSE '*' END, ':*:*') AS cpe,
       CASE WHEN o_orderkey % 8 = 0 THEN 'https://example.com/download/fw.bin' ELSE 'https://example.com/advisory' END AS reference,
       o_orderstatus = 'F' AS kev, o_orderkey % 3 = 1 AS has_exploit,
       CASE WHEN o_orderkey % 2 = 0 THEN 'nvd' ELSE 'cisa-kev' END AS source,
       CASE o_orderkey % 5 WHEN 0 THEN 'strong' WHEN 1 THEN 'likely' WHEN 2 THEN 'review' ELSE 'unrelated' END AS relevance_level
FROM {orders}""",
    "sources": """
SELECT CAST(s_suppkey AS STRING) AS source_id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'high' ELSE 'medium' END AS trust_level
FROM {supplier}""",
    "candidates": """
SELECT concat('fw:', CAST(p_partkey AS STRING)) AS candidate_id, CAST(p_partkey % 70 + 1 AS STRING) AS source_id, concat('ext', CAST(p_partkey % 100 AS STRING)) AS external_id,
       p_brand AS vendor, p_name AS product, p_type AS model,
       CASE WHEN p_partkey % 11 = 0 THEN 'unknown' WHEN p_partkey % 11 = 1 THEN CAST(NULL AS STRING) WHEN p_partkey % 11 = 2 THEN CAST(20100000 + p_partkey AS STRING)
            ELSE concat('V', CAST(p_partkey % 5 AS STRING), '.', CAST(p_size AS STRING), CASE WHEN p_partkey % 3 = 0 THEN 'b' ELSE '.' END, CAST(p_partkey % 7 AS STRING)) END AS version,
       concat(replace(p_brand, '#', '_'), '_FW_', CAST(p_partkey % 5 AS STRING), '.', CAST(p_size AS STRING), '.zip') AS filename,
       concat('https://Files', CAST(p_partkey % 20 AS STRING), '.Example.com/fw/', CAST(p_partkey AS STRING), '.zip') AS download_url
FROM {part}""",
    "leads": """
SELECT concat('fw:', CAST(l_partkey AS STRING)) AS candidate_id, v.identifier, CAST(l_quantity AS INT) AS match_score,
       CASE l_linenumber % 3 WHEN 0 THEN 'exact_version' WHEN 1 THEN 'version_range' ELSE 'product_scope' END AS match_method,
       CASE l_linenumber % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
FROM {lineitem} l JOIN {vulns} v ON l.l_orderkey = v.vid""",
    "claims": """
SELECT concat('CVE-2020-', CAST(min(p_partkey) AS STRING)) AS identifier, p_brand AS vendor, p_name AS product,
       CASE WHEN min(p_partkey) % 3 = 0 THEN concat(CAST(min(p_partkey) % 5 AS STRING), '.', CAST(min(p_size) AS STRING), '.', CAST(min(p_partkey) % 7 AS STRING)) ELSE '*' END AS version,
       CASE WHEN min(p_partkey) % 3 = 1 THEN concat('0.', CAST(min(p_size) AS STRING), '.0') ELSE CAST(NULL AS STRING) END AS version_start_including,
       CASE WHEN min(p_partkey) % 3 = 1 AND min(p_partkey) % 2 = 0 THEN concat('4.', CAST(max(p_size) AS STRING), '.1')
            WHEN min(p_partkey) % 9 = 1 THEN '20101000' ELSE CAST(NULL AS STRING) END AS version_end_excluding
FROM {part} GROUP BY p_brand, p_name""",
    "interface_obs": """
SELECT concat('A', CAST(l.l_orderkey AS STRING)) AS analysis_id, v.identifier, r.value, r.kind, r.component,
       CASE WHEN l.l_linenumber % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, CAST(l.l_quantity AS DOUBLE) / 50 AS confidence
FROM {lineitem} l JOIN {routes} r ON l.l_partkey = r.part_id JOIN {vulns} v ON l.l_orderkey = v.vid""",
    "parameter_obs": """
SELECT concat('A', CAST(l.l_orderkey AS STRING)) AS analysis_id, v.identifier, concat('arg', CAST(l.l_suppkey % 25 AS STRING)) AS name,
       CASE WHEN l.l_linenumber % 4 = 0 THEN CAST(NULL AS STRING) ELSE r.value END AS interface_value
FROM {lineitem} l JOIN {routes} r ON l.l_partkey = r.part_id JOIN {vulns} v ON l.l_orderkey = v.vid""",
    "nodes": """
SELECT concat('n', CAST(n_nationkey AS STRING)) AS node_id, 'component' AS node_kind, n_name AS label, 'supported' AS status FROM {nation}
UNION ALL SELECT concat('r', CAST(r_regionkey AS STRING)), 'firmware', r_name, 'supported' FROM {region}
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), 'request', c_name, CASE WHEN c_custkey % 4 = 0 THEN 'candidate' ELSE 'supported' END FROM {customer}
UNION ALL SELECT concat('o', CAST(o_orderkey AS STRING)), 'handler', concat('order ', CAST(o_orderkey AS STRING)), 'supported' FROM {orders}""",
    "edges": """
SELECT concat('en', CAST(n_nationkey AS STRING)) AS edge_id, 'declared_in' AS edge_kind, concat('n', CAST(n_nationkey AS STRING)) AS source_ref, concat('r', CAST(n_regionkey AS STRING)) AS target_ref FROM {nation}
UNION ALL SELECT concat('ec', CAST(c_custkey AS STRING)), 'belongs_to', concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)) FROM {customer}
UNION ALL SELECT concat('eo', CAST(o_orderkey AS STRING)), 'calls', concat('c', CAST(o_custkey AS STRING)), concat('o', CAST(o_orderkey AS STRING)) FROM {orders}""",
    "snap_base": """
SELECT concat(CAST(l_orderkey AS STRING), '/', CAST(l_partkey AS STRING)) AS identity, max(l_returnflag) AS status, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS members
FROM {lineitem} WHERE l_linenumber <> 3 GROUP BY l_orderkey, l_partkey""",
    "snap_target": """
SELECT concat(CAST(l_orderkey AS STRING), '/', CAST(l_partkey AS STRING)) AS identity, CASE WHEN l_orderkey % 10 = 0 THEN 'X' ELSE max(l_returnflag) END AS status,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS members
FROM {lineitem} WHERE l_linenumber <> 4 GROUP BY l_orderkey, l_partkey""",
    "expectations": """
SELECT concat('CVE-H-', CAST(c_custkey AS STRING)) AS identifier, concat(CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '' END, 'goform/', CAST(c_custkey % 400 AS STRING)) AS interface_value,
       CASE c_custkey % 4 WHEN 0 THEN 'exact_artifact' WHEN 1 THEN 'product_family' WHEN 2 THEN 'unknown' ELSE 'out_of_scope' END AS applicability,
       CASE WHEN c_custkey % 3 = 0 THEN concat('h', CAST(c_custkey % 50 AS STRING)) ELSE CAST(NULL AS STRING) END AS handler
FROM {customer}""",
    "observed": """
SELECT concat('cand', CAST(s_suppkey AS STRING)) AS candidate_id, CASE WHEN s_suppkey % 3 = 0 THEN 'native_hint' ELSE 'frontend_request' END AS candidate_kind,
       concat('/goform/', CAST(s_suppkey AS STRING)) AS canonical_identity, concat('h', CAST(s_suppkey % 50 AS STRING)) AS handler
FROM {supplier}""",
    "tokens": """
SELECT 'frontend' AS side, concat('tok', CAST(c_custkey % 700 AS STRING)) AS token, concat('page', CAST(c_custkey % 31 AS STRING)) AS path FROM {customer}
UNION ALL SELECT 'native', concat('tok', CAST(o_custkey % 900 AS STRING)), concat('lib', CAST(o_orderkey % 7 AS STRING)) FROM {orders}""",
    "frontend": """
SELECT concat('f', CAST(p_partkey AS STRING)) AS candidate_id, value AS endpoint, CASE WHEN part_id % 5 = 0 THEN 'literal_prefix' ELSE 'exact_literal' END AS endpoint_shape
FROM {routes} r JOIN {part} p ON r.part_id = p.p_partkey""",
    "hints": """
SELECT concat('h', CAST(s_suppkey AS STRING)) AS hint_id, CASE WHEN s_suppkey % 2 = 0 THEN 'endpoint_literal' ELSE 'route_token' END AS kind,
       CASE WHEN s_suppkey % 2 = 0 THEN r.value ELSE replace(r.product, ' ', '_') END AS value
FROM {supplier} s JOIN {routes} r ON s.s_suppkey = r.part_id""",
    "acl": """
SELECT concat('g', CAST(n_nationkey AS STRING)) AS acl_group, CASE n_nationkey % 8 WHEN 0 THEN concat('Vendor ', CAST(n_nationkey % 10 AS STRING), '*') WHEN 1 THEN 'V?ndor 1' WHEN 2 THEN '*' WHEN 3 THEN concat('*', CAST(n_nationkey % 10 AS STRING)) WHEN 4 THEN '?en*r ?' WHEN 5 THEN '????????' WHEN 6 THEN 'Vendor 7' ELSE '*dor 1*' END AS object_pattern,
       CASE WHEN n_nationkey % 2 = 0 THEN '*' ELSE concat('m', CAST(n_nationkey % 6 AS STRING)) END AS method
FROM {nation}""",
    "operations": """
SELECT concat('op', CAST(c_custkey AS STRING)) AS operation_ref, concat('Vendor ', CAST(c_custkey % 40 AS STRING)) AS object_name, concat('m', CAST(c_custkey % 6 AS STRING)) AS method_name FROM {customer}""",
    "coverage": """
SELECT concat('c', CAST(o_custkey % 300 AS STRING)) AS scope, CASE o_orderkey % 3 WHEN 0 THEN 'frontend' WHEN 1 THEN 'native' ELSE 'config' END AS producer_kind,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'completed' ELSE 'partial' END AS status, o_custkey % 2 = 0 AS required
FROM {orders}""",
    "analyses": """
SELECT concat('A', CAST(o_orderkey AS STRING)) AS analysis_id, v.identifier, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status,
       o_orderkey % 4 <> 0 AS is_current, o_custkey AS prompt_tokens, o_orderkey % 50 AS completion_tokens
FROM {orders} o JOIN {vulns} v ON o.o_orderkey = v.vid""",
    "proposals": """
SELECT concat('r', CAST(o_custkey % 50 AS STRING)) AS run_id, CAST(o_orderkey AS INT) AS place, CASE o_orderkey % 6 WHEN 0 THEN 'analysis_step' WHEN 1 THEN 'guess' ELSE 'parameter_alias' END AS kind,
       concat('t', CAST(o_orderkey % 30 AS STRING)) AS target_ref, CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE 'summary' END AS summary, 'because' AS rationale,
       CASE WHEN o_orderkey % 13 = 0 THEN 'N/A' ELSE 'a second source' END AS required_corroboration, concat('e', CAST(o_orderkey % 10 AS STRING), ';e', CAST(o_custkey % 10 AS STRING)) AS citations,
       CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence
FROM {orders}""",
    "cve_raw": """
SELECT o_orderkey AS n, concat('CVE-2021-', CAST(o_orderkey AS STRING)) AS identifier, CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE concat('Flaw ', CAST(o_custkey AS STRING), ' found. More text.') END AS en,
 concat('Fehler ', CAST(o_custkey AS STRING)) AS de, CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(o_orderkey % 101 AS DOUBLE) / 10 END AS score31, CAST(o_custkey % 101 AS DOUBLE) / 10 AS score2,
 CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE CAST(NULL AS STRING) END AS severity31, CASE WHEN o_orderkey % 7 = 0 THEN '*' ELSE concat('acme_', CAST(o_custkey % 20 AS STRING)) END AS vendor, concat('r_', CAST(o_orderkey % 50 AS STRING)) AS product,
 CASE WHEN o_orderkey % 4 = 0 THEN 'NVD-CWE-noinfo' ELSE concat('CWE-', CAST(o_orderkey % 9 AS STRING)) END AS cwe, concat('https://example.com/', CAST(o_orderkey % 30 AS STRING)) AS link, o_orderkey % 6 = 0 AS exploit FROM {orders}""",
    "model_texts": """
SELECT c_custkey AS n, concat('host 10.1.', CAST(c_custkey % 9 AS STRING), '.7 ', CASE c_custkey % 14 WHEN 0 THEN 'mac 00:11:22:33:44:5a plain' WHEN 1 THEN 'Api-Key = x' WHEN 2 THEN 'my token is fine' WHEN 3 THEN 'password: a' WHEN 4 THEN 'Bearer abc.def' WHEN 5 THEN 'bearer' WHEN 6 THEN '-----BEGIN KEY'
   WHEN 7 THEN repeat('ab', 32) WHEN 8 THEN repeat('a', 47) WHEN 9 THEN repeat('x_', 32) WHEN 10 THEN '1.2.3 and 300.300.300.300 v1.2.3.4x' WHEN 11 THEN '001:11:22:33:44:55:66 tokens = 3 secretive: 1' WHEN 12 THEN 'my-secret= 1' ELSE repeat('long words ', 30) END,
   CASE WHEN c_custkey % 5 = 0 THEN ' 192.168.0.1:80 AA:BB:CC:DD:EE:FF' ELSE '' END) AS text FROM {customer}""",
    "devices": """
SELECT p_partkey AS n, CASE p_partkey % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN CAST(NULL AS STRING) WHEN 2 THEN ' Tenda ' ELSE p_brand END AS vendor,
   CASE p_partkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN concat(p_brand, ' R', CAST(p_size AS STRING), ' Device Firmware') WHEN 2 THEN concat('tenda AC', CAST(p_size AS STRING)) ELSE concat(p_name, ' software') END AS product,
   concat('Bug in ', p_name) AS title, CASE WHEN p_partkey % 4 = 0 THEN concat('seen in ac', CAST(p_size AS STRING), ' firmware') ELSE '' END AS summary,
   concat('cpe:2.3:o:', CASE p_partkey % 7 WHEN 0 THEN 'dlink' WHEN 1 THEN '*' ELSE 'acme_corp' END, ':ac', CAST(p_size AS STRING), '_firmware:', CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE concat('1.', CAST(p_size AS STRING)) END, ':*:*:*:*:*:*:*') AS cpe FROM {part}""",
    "notes": """
SELECT o_orderkey AS n, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'See ' ELSE 'x' END, 'CVE-2020-', CAST(o_orderkey % 40 AS STRING), ' and CNVD-2019-', CAST(o_custkey % 7 AS STRING), ', CVE-2020-', CAST(o_custkey % 20 AS STRING), '; CVE-20-1 cve-2020-2 BM-2024-', CAST(o_custkey % 3 AS STRING),
   CASE WHEN o_orderkey % 4 = 0 THEN ' (CVE-2021-7) BM-2024-9, BM-2024-1x' ELSE '.' END) AS text FROM {orders}""",
    "answers": """
SELECT c_custkey AS n, concat(CASE c_custkey % 5 WHEN 0 THEN '```json ' WHEN 1 THEN 'Here it is: ' WHEN 2 THEN '' WHEN 3 THEN 'no object' ELSE '[1] ' END, CASE WHEN c_custkey % 5 = 3 THEN '' ELSE concat(chr(123), '"summary": "', c_name, '", "score": ', CAST(c_nationkey AS STRING), CASE WHEN c_custkey % 7 = 0 THEN '' ELSE ', "other": [1]' END, chr(125)) END,
   CASE c_custkey % 3 WHEN 0 THEN ' ```' WHEN 1 THEN concat(' and ', chr(123), '"summary": "second"', chr(125)) ELSE '' END) AS text FROM {customer}""",
    "scripts": """
SELECT c_custkey AS n, concat('x ', CASE c_custkey % 4 WHEN 0 THEN 'set_' WHEN 1 THEN 'y' WHEN 2 THEN repeat('z', 25) ELSE concat(repeat('z', 20), '_') END, CASE WHEN c_nationkey % 2 = 0 THEN 'europe' ELSE 'america' END, '(g_asia, get_asia); asia_2 ', c_name, CASE WHEN c_custkey % 3 = 0 THEN ' my_europe my_europe' ELSE '' END) AS text FROM {customer}""",
    "advisories": """
SELECT o_orderkey AS n, concat('Flaw ', CAST(o_orderkey AS STRING)) AS title, CASE o_orderkey % 10
   WHEN 0 THEN concat('A flaw was found in the file /goform/set', CAST(o_custkey % 50 AS STRING), ' of the component Web Server. The manipulation of the argument arg', CAST(o_custkey % 9 AS STRING), ' leads to Stack Overflow. The attack can be launched remotely.')
   WHEN 1 THEN concat('An HTTP post request to "/cgi-bin/x', CAST(o_custkey % 30 AS STRING), '.cgi" with the parameter named ssid, or the field of lan, lets others in. It is exploited locally.')
   WHEN 2 THEN 'The file /etc/passwd is read by /usr/bin/tool in the web interface. No route here.'
   WHEN 3 THEN concat('Look at the url (/admin/page', CAST(o_custkey % 4 AS STRING), '). The parameter is broken! Variable `v1` too.')
   WHEN 4 THEN 'Paths /opt/x and /plain/thing are named. A handler is not.'
   WHEN 5 THEN '[/api/v1/users], /HNAP1/ and /web/Index.PHP?x=1; variable token=1 lead to SQL injection; remotely'
   WHEN 6 THEN '</form> and /x. are no routes, / neither. Route /x/y.do is. The attack is local'
   WHEN 7 THEN 'HTTP get and http PUT of /status: field a-b.c[0], argument 9x, param p_1, PARAM p_1.'
   WHEN 8 THEN '' ELSE CAST(NULL AS STRING) END AS description FROM {orders}""",
    "catalogs": """
SELECT concat('cat', CAST(o_orderkey AS STRING)) AS catalog_id, concat('fw', CAST(o_custkey % 200 AS STRING)) AS firmware, substr(CAST(o_orderdate AS STRING), 1, 10) AS published_at,
       CASE WHEN o_orderkey % 3 = 0 THEN 'partial' ELSE 'completed' END AS status, concat('lib', CAST(o_orderkey % 9 AS STRING)) AS artifact,
       concat('h', CAST(o_orderkey % 13 AS STRING), ';h', CAST(o_custkey % 7 AS STRING)) AS handlers
FROM {orders}""",
}


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"{(\w+)}", text)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in _needs(text)})


def view_over(name: str, **tables: DataFrame) -> DataFrame:
    """The view ``name`` over the given tables and views."""
    return next(iter(tables.values())).sparkSession.sql(VIEWS[name], **tables)


@lru_cache(maxsize=None)
def _order(name: str) -> tuple[str, ...]:
    """Views that ``name`` needs, first ones first, and itself."""
    if name in BASE:
        return ()
    out: list[str] = []
    for n in _needs(VIEWS[name]):
        out += [x for x in _order(n) if x not in out]
    return (*out, name)


def with_views(sql: str, *names: str) -> str:
    """``sql`` for DuckDB, after the views it names."""
    needed = list(dict.fromkeys(x for n in names for x in _order(n)))
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].format(**{m: m for m in _needs(VIEWS[n])})})" for n in needed)
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"WITH\s+RECURSIVE", body) else ""
    body = re.sub(r"^WITH\s+(?:RECURSIVE\s+)?", ", ", body) if re.match(r"WITH\b", body) else body
    return f"WITH {recursive}{ctes}\n{body}"
