"""The SQL of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from lodestrata.functions.interfaces import CALL_KINDS, MANAGEMENT_FOLDERS, SHARED_CGI, TERM_STOPWORDS
from lodestrata.functions.versions import ARCHIVES, NO_IDENTITY, NO_VERSION, NOISE
from lodestrata.operators import relevance
from lodestrata.operators.history import SUSPICIOUS
from lodestrata.operators.review import GENERIC_TOKENS, PROPOSAL_KINDS
from lodestrata.plans.views import with_views


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _any(column: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{p}')" for p in prefixes) + ")"


def style_sql(value: str = "value", kind: str = "kind", component: str = "component") -> str:
    v, k, c = f"lower({value})", f"lower({kind})", f"lower({component})"
    return f"""CASE WHEN {_any(v, ("tcp://", "udp://"))} OR {k} = 'network_listener' THEN ''
 WHEN {_any(v, ("/goform/", "/form/"))} THEN 'form_handler'
 WHEN {_any(v, ("/cgi-bin/", "/scgi-bin/"))} OR contains({v}, '.cgi') THEN 'cgi_gateway'
 WHEN contains({v}, 'hnap') OR contains({v}, 'soap') OR contains({c}, 'soap') OR starts_with({v}, '/control/') THEN 'hnap_soap'
 WHEN {_any(v, ("/api/", "/rest/", "/v1/", "/v2/"))} THEN 'resource_api'
 WHEN regexp_matches({v}, '\\.(asp|aspx|php|jsp|do|action)(/|$)') THEN 'web_action'
 WHEN {k} IN ({_list(CALL_KINDS)}) THEN 'rpc_command' ELSE 'management_route' END"""


def subtype_sql(value: str = "value", component: str = "component", kind: str = "kind") -> str:
    raw = f"regexp_replace(trim({value}), '''+$', '')"
    low, leaf = f"lower({raw})", f"regexp_extract({raw}, '[^/]*$')"
    slashes = f"(length({low}) - length(replace({low}, '/', '')))"
    bare, context = f"regexp_replace(lower(trim({value})), '[/.]+$', '')", f"lower({value} || ' ' || coalesce({component}, ''))"
    return f"""CASE category
 WHEN 'web_action' THEN CASE WHEN regexp_matches({low}, '\\.(do|action)(/|$)') THEN 'framework_action_dispatcher' WHEN regexp_matches({low}, '\\.(jsp|aspx)(/|$)') THEN 'servlet_page_controller'
   WHEN {slashes} > 1 THEN 'namespaced_page_controller' ELSE 'flat_page_controller' END
 WHEN 'form_handler' THEN CASE WHEN contains({raw}, '*') THEN 'goform_wildcard_dispatcher' WHEN starts_with({low}, '/form/') THEN 'form_namespace_registry' WHEN contains({leaf}, '_') THEN 'goform_snake_registry'
   WHEN regexp_matches({leaf}, '[A-Za-z]') AND {leaf} = lower({leaf}) THEN 'goform_lower_registry' WHEN regexp_matches({leaf}, '[A-Za-z]') AND {leaf} = upper({leaf}) THEN 'goform_symbol_registry' ELSE 'goform_camel_registry' END
 WHEN 'cgi_gateway' THEN CASE WHEN starts_with({low}, '/scgi-bin/') THEN 'scgi_gateway' WHEN lower({leaf}) IN ({_list(SHARED_CGI)}) THEN 'shared_cgi_dispatcher'
   WHEN starts_with({low}, '/cgi-bin/') AND {slashes} > 2 THEN 'nested_cgi_module' WHEN starts_with({low}, '/cgi-bin/') THEN 'cgi_executable_registry' ELSE 'external_cgi_handler' END
 WHEN 'hnap_soap' THEN CASE WHEN {bare} = '/hnap1' THEN 'hnap_envelope_dispatcher' WHEN starts_with({bare}, '/hnap1/') THEN 'hnap_uri_method' WHEN starts_with({bare}, '/control/') THEN 'upnp_service_control' ELSE 'soap_service_endpoint' END
 WHEN 'resource_api' THEN CASE WHEN regexp_matches({low}, '^/(api/)?v[0-9]+(\\.[0-9]+)?/') OR regexp_matches({low}, '^/api/[0-9]+(\\.[0-9]+)?/') THEN 'versioned_resource_router' WHEN starts_with({low}, '/rest/') THEN 'rest_resource_tree'
   WHEN starts_with({low}, '/api/') AND {slashes} >= 3 THEN 'namespaced_api_router' ELSE 'flat_api_registry' END
 WHEN 'rpc_command' THEN CASE WHEN regexp_matches({context}, 'command|exec|shell|cmd') THEN 'command_execution' WHEN regexp_matches({context}, 'topic|mqtt|message|publish|subscribe') THEN 'message_topic'
   WHEN lower({kind}) = 'device_node' OR starts_with(trim({context}), '/dev/') THEN 'device_node' ELSE 'rpc_method' END
 WHEN 'management_route' THEN CASE WHEN starts_with({low}, '/boafrm/') THEN 'boafrm_handler_registry' WHEN regexp_matches({low}, '\\.(xml|json)(/|$)') THEN 'structured_data_endpoint' WHEN regexp_matches({low}, '\\.(jpe?g|png|gif|mp4|mjpg)(/|$)') THEN 'media_endpoint'
   WHEN {_any(low, tuple(f'/{x}/' for x in MANAGEMENT_FOLDERS))} THEN 'namespaced_management_router' WHEN regexp_matches(trim({value}), '^/[A-Za-z][A-Za-z0-9_-]*$') THEN 'flat_named_management_handler' ELSE 'unresolved_management_route' END
 ELSE '' END"""


def _styled(source: str) -> str:
    return f"styled AS (SELECT *, {subtype_sql()} AS subtype FROM (SELECT *, {style_sql()} AS category FROM {source}))"


def normalize_sql(c: str) -> str:
    out = f"lower(trim(replace(coalesce({c}, ''), chr(92), '')))"
    out = f"regexp_replace({out}, '\\.({ARCHIVES})$', '')"
    out = f"regexp_replace({out}, '^(firmware|version|ver)[-_ ]*', '')"
    out = f"regexp_replace({out}, '^v([0-9])', '\\1')"
    return f"regexp_replace({out}, '^[ _-]+|[ _-]+$', '', 'g')"


def key_sql(normalized: str) -> str:
    return f"""list_transform(regexp_extract_all({normalized}, '[0-9]+|[a-z]+'), lambda t: {{'kind': CASE WHEN regexp_matches(t, '^[0-9]') THEN 0 ELSE 1 END, 'number': CASE WHEN regexp_matches(t, '^[0-9]') THEN CAST(t AS DECIMAL(38, 0)) ELSE 0 END, 'word': CASE WHEN regexp_matches(t, '^[0-9]') THEN '' ELSE t END}})"""


_KNOWN_VENDOR = "CASE WHEN lower(coalesce(vendor, '')) NOT IN ('', 'n/a', 'unknown') THEN vendor END"
_RELATED = "relevance_level IN ('strong', 'likely')"


def _words(text: str, terms) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '(^|[^a-z0-9_]){t.replace('-', '\\-')}($|[^a-z0-9_])')" for t in terms) + ")"


def _relevance(policy: relevance.Policy = relevance.Policy()) -> str:
    return f"""text AS (
  SELECT identifier, cpe, reference, replace(lower(concat_ws(' ', title, summary, vendor, product)), '_', ' ') AS t, replace(lower(concat_ws(' ', vendor, product, title)), '_', ' ') AS n FROM vulns
), found AS (
  SELECT identifier, {_words("t", policy.firmware)} AS f, {_words("t", policy.devices)} AS d, {_words("n", policy.vendors)} AS v, {_words("n", policy.watched)} AS w,
         split_part(cpe, ':', 3) = 'h' AS h, split_part(cpe, ':', 11) IN ('firmware', 'embedded') AS e, {_words("lower(reference)", ("firmware", "download"))} AS r, {_words("t", relevance.OTHER_CONTEXTS)} AS o
  FROM text
), summed AS (
  SELECT *, o AND NOT (f OR v OR e) AS other,
         greatest(0, least(100, 55 * f::INT + 25 * d::INT + 55 * v::INT + 25 * (w AND NOT v)::INT + 30 * h::INT + 65 * e::INT + 10 * r::INT - 25 * (o AND NOT (f OR v OR e))::INT)) AS relevance_score
  FROM found
), scored AS (
  SELECT *, CASE WHEN relevance_score >= {policy.strong} THEN 'strong' WHEN relevance_score >= {policy.likely} THEN 'likely' WHEN relevance_score >= {policy.review} THEN 'review' ELSE 'unrelated' END AS relevance_level FROM summed
)"""


_IDENTITY = "regexp_replace(regexp_replace(lower(replace({0}, '_', ' ')), '\\b(" + NOISE + ")\\b', ' ', 'g'), '[^a-z0-9]', '', 'g')"

def _range_sql(bound: str, op: str) -> str:
    """A bound that is absent, or comparable to the version and kept by it."""
    prefix, runs = "regexp_extract({0}, '^([a-z]+)[0-9]', 1)", "len(regexp_extract_all({0}, '[0-9]+'))"
    alike = f"{prefix.format('nv')} = {prefix.format(bound)} AND ({runs.format('nv')} = 1) = ({runs.format(bound)} = 1) AND {runs.format('nv')} > 0 AND {runs.format(bound)} > 0"
    return f"({bound} IS NULL OR ({alike} AND {key_sql('nv')} {op} {key_sql(bound)}))"


_LINK = f"""cand AS (
  SELECT candidate_id, trim(version) AS raw, filename, {normalize_sql("version")} AS nv, {_IDENTITY.format("vendor")} AS vk, unnest(list_distinct([{_IDENTITY.format("product")}, {_IDENTITY.format("model")}])) AS pk FROM candidates
), own AS (
  -- the declared version, then the one dotted version that the file names of this view hold
  SELECT candidate_id, vk, pk, 1 AS place, raw, nv FROM cand WHERE nv NOT IN ({_list(NO_VERSION)})
  UNION ALL SELECT candidate_id, vk, pk, 2, regexp_extract(filename, '_([0-9]+\\.[0-9]+)\\.zip$', 1), regexp_extract(filename, '_([0-9]+\\.[0-9]+)\\.zip$', 1) FROM cand
), cl AS (
  SELECT *, {_IDENTITY.format("vendor")} AS vk, {_IDENTITY.format("product")} AS pk, {normalize_sql("version")} AS cv FROM claims
), pairs AS (
  SELECT o.*, cl.identifier, cl.version, cl.cv, cl.version_start_including AS lo, cl.version_end_excluding AS hi FROM own o JOIN cl USING (vk, pk)
), judged AS (
  SELECT *, CASE WHEN cv NOT IN ({_list(NO_VERSION)}) THEN CASE WHEN {key_sql("nv")} = {key_sql("cv")} THEN 'exact_version' END
                 WHEN coalesce(lo, hi) IS NOT NULL THEN CASE WHEN {_range_sql("lo", ">=")} AND {_range_sql("hi", "<")} THEN 'version_range' END ELSE 'product_scope' END AS match_method
  FROM pairs
), best AS (
  SELECT candidate_id, identifier, match_method, arg_min(raw, place) AS candidate_version, any_value(CASE WHEN coalesce(lo, hi) IS NOT NULL THEN CASE WHEN lo IS NOT NULL THEN '[' ELSE '(' END || coalesce(lo, '-∞') || ', ' || coalesce(hi, '+∞') || ')'
         WHEN cv NOT IN ({_list(NO_VERSION)}) THEN version ELSE 'all versions' END) AS affected_constraint,
         CASE match_method WHEN 'exact_version' THEN 98 WHEN 'version_range' THEN 90 ELSE 58 END AS match_score, CASE match_method WHEN 'product_scope' THEN 'low' ELSE 'high' END AS confidence
  FROM judged WHERE match_method IS NOT NULL GROUP BY candidate_id, identifier, match_method
)"""

_FEED = "coalesce(published_at, modified_at, '') DESC, coalesce(modified_at, published_at, '') DESC, identifier DESC"

_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY firmware ORDER BY published_at DESC, catalog_id DESC) AS place FROM catalogs) WHERE place = 1)"

_CORRELATED = """exact AS (SELECT * FROM frontend WHERE endpoint_shape = 'exact_literal'),
found AS (
  SELECT DISTINCT candidate_id, hint_id, 'exact_endpoint' AS match_basis FROM exact JOIN hints ON kind = 'endpoint_literal' AND hints.value = endpoint
  UNION SELECT DISTINCT candidate_id, hint_id, 'route_token' FROM exact JOIN hints ON kind = 'route_token' AND hints.value = regexp_extract(regexp_replace(split_part(endpoint, '?', 1), '/+$', ''), '[^/]*$')
)"""

_ONE_SIDED = """one AS (
  SELECT side, token, count(DISTINCT path) AS places FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM tokens o WHERE o.token = t.token AND o.side <> t.side) GROUP BY side, token
)"""

_AUDIT = """denominator AS (
  SELECT 'CVE-H-' || c_custkey AS identifier, c_custkey % 5 <> 0 AS semantic_present, greatest(0, c_custkey % 3 - 1) AS interfaces, c_custkey % 2 AS parameters FROM customer
), audit AS (
  SELECT d.*, CASE WHEN e.identifier IS NOT NULL THEN 'compared' WHEN NOT semantic_present THEN 'not_analyzed' WHEN interfaces + parameters = 0 THEN 'no_structured_communication' ELSE 'structured_not_compared' END AS category
  FROM denominator d LEFT JOIN (SELECT DISTINCT identifier FROM expectations WHERE applicability = 'exact_artifact') e USING (identifier)
)"""

_EXPECTED = """req AS (
  SELECT DISTINCT ltrim(canonical_identity, '/') AS identity FROM observed WHERE candidate_kind = 'frontend_request'
), hint AS (
  SELECT DISTINCT ltrim(canonical_identity, '/') AS hint FROM observed WHERE candidate_kind IN ('native_hint', 'native_route_binding')
), met AS (
  SELECT e.*, req.identity IS NOT NULL AS seen,
         EXISTS (SELECT 1 FROM hint WHERE hint = regexp_extract(interface_value, '[^/]*$')) OR EXISTS (SELECT 1 FROM hint WHERE hint = e.handler) AS clue
  FROM expectations e LEFT JOIN req ON ltrim(trim(e.interface_value), '/') = req.identity
), judged AS (
  SELECT identifier, CASE WHEN seen THEN 'observed' WHEN applicability <> 'exact_artifact' THEN 'not_assessable' ELSE 'missing' END AS status,
         CASE WHEN seen THEN 'none' WHEN applicability = 'out_of_scope' THEN 'artifact_out_of_scope' WHEN applicability <> 'exact_artifact' THEN 'artifact_scope_unknown'
              WHEN clue THEN 'dispatcher_binding_without_interface' ELSE 'interface_not_observed' END AS gap_reason
  FROM met
)"""

_SEEN = f"""{_styled("interface_obs")}, seen AS (SELECT s.*, v.vendor, v.product, coalesce(v.published_at, v.modified_at) AS day FROM styled s JOIN vulns v USING (identifier) WHERE category <> '')"""


def _top(by: str, n: int) -> str:
    return f"""WITH {_styled("interface_obs")}, c AS (SELECT {by}, value, count(DISTINCT identifier) AS vulnerabilities, count(*) AS occurrences FROM styled WHERE category <> '' GROUP BY {by}, value),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY vulnerabilities DESC, occurrences DESC, value) AS INT) AS place FROM c) SELECT * FROM r WHERE place <= {n}"""


_WALK = """step(origin, dest) AS (SELECT source_ref, target_ref FROM edges {forward} UNION SELECT target_ref, source_ref FROM edges {back}),
walk(node_id, distance) AS (SELECT node_id, 0 FROM nodes WHERE node_id IN ({seeds}) UNION SELECT s.dest, w.distance + 1 FROM walk w JOIN step s ON s.origin = w.node_id WHERE w.distance < {hops})"""

_SNAP = """changes AS (
  SELECT coalesce(b.identity, t.identity) AS identity, CASE WHEN b.identity IS NULL THEN 'added' WHEN t.identity IS NULL THEN 'removed' WHEN b.status IS DISTINCT FROM t.status OR b.members IS DISTINCT FROM t.members THEN 'changed' END AS change,
         CASE WHEN b.identity IS NULL OR t.identity IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.members IS DISTINCT FROM t.members THEN 'members' END, CASE WHEN b.status IS DISTINCT FROM t.status THEN 'status' END) END AS changed_fields
  FROM snap_base b FULL JOIN snap_target t ON b.identity = t.identity
)"""

ORACLES: dict[str, str] = {
    "category_profile": with_views(f"""WITH {_SEEN} SELECT category, count(DISTINCT value) AS interfaces, count(DISTINCT identifier) AS vulnerabilities, count(DISTINCT {_KNOWN_VENDOR}) AS vendors,
       count(DISTINCT CASE WHEN lower(coalesce(product, '')) NOT IN ('', 'n/a', 'unknown') THEN product END) AS products, max(day) AS latest_at,
       array_to_string(list_sort(list_distinct(list({_KNOWN_VENDOR})))[1:5], '|') AS first_vendors FROM seen GROUP BY category""", "interface_obs", "vulns"),
    "category_top5": with_views(_top("category", 5), "interface_obs"),
    "subtype_examples": with_views(_top("subtype", 3), "interface_obs"),
    "subtype_rollup": with_views(f"WITH {_styled('interface_obs')} SELECT category, subtype, count(DISTINCT value) AS interfaces, count(DISTINCT identifier) AS vulnerabilities FROM styled WHERE category <> '' GROUP BY ALL", "interface_obs"),
    "route_styles": with_views(f"WITH {_styled('routes')} SELECT part_id, value, category, subtype FROM styled", "routes"),
    "version_keys": with_views(f"SELECT candidate_id, {normalize_sql('version')} AS normalized, {normalize_sql('version')} NOT IN ({_list(NO_VERSION)}) AS meaningful, {key_sql(normalize_sql('version'))} >= {key_sql(chr(39) + '2.10' + chr(39))} AS at_least_2_10 FROM candidates", "candidates"),
    "version_link_best": with_views(f"WITH {_LINK} SELECT * FROM best", "candidates", "claims"),
    "version_link_counts": with_views(f"WITH {_LINK} SELECT match_method, count(*) AS n, count(DISTINCT candidate_id) AS candidates FROM best GROUP BY match_method", "candidates", "claims"),
    "version_link_uncurated": with_views(f"""WITH {_LINK} SELECT candidate_id, identifier, match_method FROM best
WHERE NOT (candidate_id = 'fw:' || split_part(identifier, '-', 3) AND candidate_id IN (SELECT candidate_id FROM leads))""", "candidates", "claims", "leads"),
    "relevance_score": with_views(f"""WITH {_relevance()} SELECT identifier, relevance_score, relevance_level,
       concat_ws(',', CASE WHEN f THEN 'firmware-term' END, CASE WHEN d THEN 'device-term' END, CASE WHEN v THEN 'firmware-vendor' END, CASE WHEN w AND NOT v THEN 'watched-vendor' END, CASE WHEN h THEN 'hardware-cpe' END,
                 CASE WHEN e THEN 'firmware-target-cpe' END, CASE WHEN r THEN 'firmware-reference' END, CASE WHEN other THEN 'non-firmware-context' END) AS signals FROM scored""", "vulns"),
    "relevance_levels": with_views(f"WITH {_relevance()} SELECT relevance_level, count(*) AS n FROM scored GROUP BY ALL", "vulns"),
    "relevance_reclassified": with_views(f"WITH {_relevance(relevance.Policy(firmware=('u-boot',), strong=60, likely=40, review=20))} SELECT relevance_level, count(*) AS n FROM scored GROUP BY ALL", "vulns"),
    "overview_counts": with_views(f"SELECT count(*) AS relevant, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (kev) AS kev, count(*) FILTER (has_exploit) AS exploit, max(modified_at) AS updated_at FROM vulns WHERE {_RELATED}", "vulns"),
    "vendor_casefold_top": with_views(f"SELECT min(vendor) AS vendor, count(*) AS n FROM vulns WHERE {_RELATED} AND vendor IS NOT NULL AND lower(vendor) NOT IN ('', 'n/a', 'na', 'unknown', 'unspecified') GROUP BY lower(vendor) ORDER BY n DESC, vendor LIMIT 10", "vulns"),
    "severity_statistics": with_views("SELECT coalesce(severity, 'UNKNOWN') AS severity, coalesce(cvss_version, 'Unknown') AS cvss_version, count(*) AS n FROM vulns GROUP BY ALL", "vulns"),
    "year_histogram": with_views("SELECT * FROM (SELECT substr(published_at, 1, 4) AS year, count(*) AS n FROM vulns WHERE published_at IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 5)", "vulns"),
    "cwe_top": with_views(f"""WITH b AS (SELECT DISTINCT identifier, unnest(string_split(cwe_list, ';')) AS cwe_id FROM vulns WHERE {_RELATED})
SELECT cwe_id, count(*) AS n FROM b WHERE regexp_matches(cwe_id, '^CWE-[0-9]') GROUP BY cwe_id ORDER BY n DESC, cwe_id LIMIT 10""", "vulns"),
    "json_explode_distinct": with_views("WITH b AS (SELECT DISTINCT identifier, unnest(string_split(cwe_list, ';')) AS cwe_id FROM vulns) SELECT cwe_id, count(*) AS n FROM b GROUP BY cwe_id", "vulns"),
    "vulnerability_page": with_views(f"""SELECT identifier, title, published_at FROM vulns WHERE {_RELATED} AND severity = 'HIGH' AND has_exploit AND list_contains(string_split(cwe_list, ';'), 'CWE-7')
AND (identifier ILIKE '%rout_r%' OR title ILIKE '%rout_r%' OR summary ILIKE '%rout_r%' OR vendor ILIKE '%rout_r%' OR product ILIKE '%rout_r%') ORDER BY {_FEED} LIMIT 50 OFFSET 2""", "vulns"),
    "vulnerability_envelope": with_views("SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages, 3 AS page, true AS has_previous, count(*) > 60 AS has_next FROM vulns WHERE kev AND lower(vendor) = 'vendor 3'", "vulns"),
    "keyset_page": with_views(f"SELECT identifier FROM vulns WHERE {_RELATED} AND identifier > 'CVE-1996' ORDER BY identifier LIMIT 100", "vulns"),
    "candidate_listing": with_views("""SELECT c.candidate_id, s.name AS source_name, (SELECT count(DISTINCT identifier) FROM leads l WHERE l.candidate_id = c.candidate_id) AS vulnerability_count,
       (SELECT count(*) FROM leads l WHERE l.candidate_id = c.candidate_id AND match_method = 'exact_version') AS exact_count,
       (SELECT match_method FROM leads l WHERE l.candidate_id = c.candidate_id ORDER BY match_score DESC, identifier, match_method LIMIT 1) AS best_method,
       md5(coalesce((SELECT string_agg(DISTINCT identifier, ',' ORDER BY identifier) FROM leads l WHERE l.candidate_id = c.candidate_id), '')) AS identifiers_md5
FROM candidates c JOIN sources s USING (source_id)""", "candidates", "sources", "leads"),
    "candidate_page": with_views("""SELECT c.candidate_id, count(DISTINCT l.identifier) AS vulnerability_count FROM candidates c JOIN sources s USING (source_id) LEFT JOIN leads l USING (candidate_id)
GROUP BY c.candidate_id, c.vendor, c.model, c.external_id ORDER BY 2 DESC, lower(c.vendor), lower(c.model), c.external_id, c.candidate_id LIMIT 40 OFFSET 10""", "candidates", "sources", "leads"),
    "lead_semi_filter": with_views("SELECT candidate_id FROM candidates c WHERE EXISTS (SELECT 1 FROM leads l WHERE l.candidate_id = c.candidate_id AND match_score > 40 AND match_method IN ('exact_version', 'version_range'))", "candidates", "leads"),
    "lead_anti_filter": with_views("SELECT candidate_id FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM leads l WHERE l.candidate_id = c.candidate_id AND match_score > 20 AND match_method = 'exact_version')", "candidates", "leads"),
    "lead_details": with_views("SELECT v.severity, count(*) AS n FROM leads l LEFT JOIN (SELECT * FROM vulns WHERE kev) v USING (identifier) GROUP BY v.severity", "leads", "vulns"),
    "source_fanout_counts": with_views("""SELECT s.source_id, s.name, s.trust_level, count(DISTINCT c.candidate_id) AS candidates, count(DISTINCT l.identifier) AS vulnerabilities
FROM sources s LEFT JOIN candidates c USING (source_id) LEFT JOIN leads l USING (candidate_id) GROUP BY ALL""", "sources", "candidates", "leads"),
    "catalogue_overview": with_views("""SELECT (SELECT count(*) FROM candidates) AS candidates, (SELECT count(DISTINCT vendor) FROM candidates) AS vendors, (SELECT count(*) FROM candidates WHERE version IS NOT NULL AND version <> 'unknown') AS versioned,
       (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM leads) AS leads, (SELECT count(DISTINCT candidate_id) FROM leads) AS linked_candidates, (SELECT count(DISTINCT identifier) FROM leads) AS linked_vulnerabilities,
       (SELECT count(*) FROM leads WHERE match_method = 'exact_version') AS exact_leads""", "candidates", "sources", "leads"),
    "download_hosts": with_views("SELECT lower(regexp_extract(download_url, '://([^/:?#]+)', 1)) AS host, count(*) AS n FROM candidates GROUP BY 1 ORDER BY n DESC, host LIMIT 16", "candidates"),
    "samples_of_vulnerability": with_views("SELECT candidate_id, identifier, confidence, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rank FROM leads JOIN candidates USING (candidate_id) WHERE identifier = (SELECT min(identifier) FROM vulns)", "leads", "candidates"),
    "parameter_fanout": with_views("""SELECT p.name, count(*) AS occurrences, count(DISTINCT p.identifier) AS vulnerabilities, count(DISTINCT i.kind) AS kinds
FROM parameter_obs p LEFT JOIN interface_obs i ON p.analysis_id = i.analysis_id AND p.interface_value = i.value GROUP BY p.name""", "parameter_obs", "interface_obs"),
    "interface_explore": with_views(f"""WITH c AS (SELECT value, min(kind) AS kind, min(method) AS method, count(*) AS occurrences, count(DISTINCT identifier) AS vulnerabilities, count(DISTINCT {_KNOWN_VENDOR}) AS vendors
  FROM interface_obs JOIN (SELECT identifier, vendor FROM vulns) USING (identifier) GROUP BY value),
t AS (SELECT *, CASE WHEN lower(value) = '/goform/set' THEN 0 WHEN starts_with(lower(value), '/goform/set') THEN 1 WHEN contains(lower(value), '/goform/set') THEN 2 ELSE 3 END AS tier FROM c) SELECT * FROM t WHERE tier < 3""", "interface_obs", "vulns"),
    "model_groups": with_views(f"""WITH m AS (SELECT CASE WHEN lower(coalesce(vendor, '')) IN ({_list(NO_IDENTITY)}) THEN NULL ELSE trim(vendor) END AS v, trim(regexp_replace(product, '\\s+(device\\s+)?(firmware|software)$', '', 'i')) AS model FROM vulns)
SELECT lower(regexp_replace(trim(concat_ws(' ', v, model)), '\\s+', ' ', 'g')) AS model_key, min(model) AS model, count(*) AS n FROM m GROUP BY 1""", "vulns"),
    "fts_phrase": with_views("""WITH t AS (SELECT identifier, [' ' || trim(regexp_replace(lower(coalesce(x, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' FOR x IN [identifier, title, summary, vendor, product]] AS texts FROM vulns)
SELECT identifier FROM t WHERE len([1 FOR x IN texts IF contains(x, ' access point ')]) > 0 AND len([1 FOR x IN texts IF contains(x, ' u boot ')]) > 0""", "vulns"),
    "fts_prefix": with_views("""WITH t AS (SELECT identifier, [' ' || trim(regexp_replace(lower(coalesce(x, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' FOR x IN [title, summary, vendor, product]] AS texts FROM vulns)
SELECT identifier FROM t WHERE len([1 FOR x IN texts IF contains(x, ' firm')]) > 0 AND len([1 FOR x IN texts IF contains(x, ' mod')]) > 0""", "vulns"),
    "correlate_exact": with_views(f"WITH {_CORRELATED} SELECT * FROM found", "frontend", "hints"),
    "correlate_unmatched": with_views(f"WITH {_CORRELATED} SELECT candidate_id, endpoint FROM frontend WHERE candidate_id NOT IN (SELECT candidate_id FROM found)", "frontend", "hints"),
    "correlate_budget": with_views(f"WITH {_CORRELATED} SELECT *, CASE WHEN (SELECT count(*) FROM found) > 500 THEN 'partial' ELSE 'completed' END AS status FROM found ORDER BY candidate_id, hint_id, match_basis LIMIT 500", "frontend", "hints"),
    "set_difference": with_views(f"WITH {_ONE_SIDED} SELECT * FROM one", "tokens"),
    "difference_attribution": with_views(f"""WITH {_ONE_SIDED}, h AS (SELECT side, n % 3 - 1 AS web, n % 5 - 3 AS native, n % 2 AS variant, n % 7 > 2 AS direct FROM (SELECT side, CAST(substr(token, 4) AS INT) AS n FROM one))
SELECT side, CASE WHEN side = 'frontend' THEN CASE WHEN native > 0 THEN 'alternate_native_literal' WHEN web > 0 THEN 'frontend_consumer_native_absent' WHEN direct THEN 'frontend_operation_native_absent' ELSE 'frontend_declaration_native_absent' END
  ELSE CASE WHEN web > 0 THEN 'frontend_scope_gap' WHEN native > 0 THEN 'cross_native_literal' WHEN variant > 0 THEN 'cross_native_token_variant' ELSE 'native_registration_no_frontend_reference' END END AS kind, count(*) AS n FROM h GROUP BY ALL""", "tokens"),
    "token_containment": """WITH t AS (SELECT lower(n_name) AS token FROM nation UNION VALUES ('the'), ('of'), ('and'), ('der')), w AS (SELECT CAST(doc_id AS VARCHAR) AS doc, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS token FROM documents)
SELECT token, doc, count(*) AS hits FROM w JOIN t USING (token) GROUP BY ALL""",
    "acl_pattern_join": with_views("SELECT acl_group, count(DISTINCT operation_ref) AS grants FROM acl JOIN operations ON object_name GLOB object_pattern AND (acl.method = '*' OR acl.method = method_name) GROUP BY acl_group", "acl", "operations"),
    "operation_bindings": with_views("""WITH p AS (SELECT object_name, method_name, 1 AS rank, 'static' AS status, 'p/' || operation_ref AS path FROM operations WHERE ends_with(operation_ref, '3')
  UNION ALL SELECT object_name, method_name, 2, 'verified', 'n/' || operation_ref FROM operations WHERE ends_with(operation_ref, '77')),
b AS (SELECT *, row_number() OVER (PARTITION BY object_name, method_name ORDER BY rank DESC, path DESC) AS place FROM p)
SELECT operation_ref, coalesce(status, 'open') AS binding_status, path AS binding_path FROM operations o LEFT JOIN b ON b.place = 1 AND o.object_name = b.object_name AND o.method_name = b.method_name""", "operations"),
    "latest_per_key": with_views(f"WITH {_LATEST} SELECT firmware, catalog_id, published_at FROM latest", "catalogs"),
    "hidden_interfaces": with_views(f"WITH {_LATEST}, h AS (SELECT artifact, firmware, unnest(string_split(handlers, ';')) AS handler FROM latest WHERE status = 'completed') SELECT artifact, count(DISTINCT firmware) AS firmwares, count(DISTINCT handler) AS handlers FROM h GROUP BY artifact", "catalogs"),
    "merge_upsert": """WITH e AS (SELECT event_id, concat(user_id % 500, '/', event_type) AS identifier, CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS title, CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE 'v' || event_id % 7 END AS vendor,
  event_id % 11 = 0 AS kev, CASE WHEN event_id % 5 = 0 THEN 'cisa-kev' ELSE 'nvd' END AS source FROM events)
SELECT identifier, coalesce(arg_max(title, event_id) FILTER (source = 'cisa-kev'), arg_min(title, event_id)) AS title, arg_max(vendor, event_id) FILTER (vendor <> 'n/a') AS vendor, bool_or(kev) AS kev,
       string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM e GROUP BY identifier""",
    "scd2_current": "SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS finished_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S') DESC, event_id DESC) AS place FROM events) WHERE place = 1",
    "graph_khop": with_views(f"WITH RECURSIVE {_WALK.format(forward='', back="WHERE edge_kind <> 'calls'", seeds="'n3', 'c7'", hops=3)} SELECT node_id, min(distance) AS distance FROM walk GROUP BY node_id", "nodes", "edges"),
    "graph_undirected_khop": with_views(f"WITH RECURSIVE {_WALK.format(forward="WHERE edge_kind <> 'declared_in'", back="WHERE edge_kind <> 'declared_in'", seeds="'o1'", hops=2)} SELECT node_id, min(distance) AS distance FROM walk GROUP BY node_id", "nodes", "edges"),
    "graph_query": with_views(f"""WITH RECURSIVE {_WALK.format(forward="WHERE edge_kind IN ('belongs_to', 'calls')", back="WHERE edge_kind = 'belongs_to'", seeds="'n3'", hops=2)}, r AS (SELECT node_id, min(distance) AS distance FROM walk GROUP BY node_id)
SELECT node_id, distance, CASE WHEN (SELECT count(*) FROM r) > 50 THEN 'partial' ELSE 'completed' END AS status_of_query FROM r ORDER BY distance, node_id LIMIT 50""", "nodes", "edges"),
    "graph_text_query": with_views("""WITH t AS (SELECT node_id, array_to_string(regexp_extract_all(lower(regexp_replace(concat_ws(' ', label, status, node_kind), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+'), ' ') AS text FROM nodes)
SELECT node_id, 0 AS distance FROM t WHERE contains(text, 'supported') AND contains(text, 'handler') AND contains(text, '1')""", "nodes"),
    "graph_facets": with_views("""SELECT 'node_kind' AS facet, node_kind AS value, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge_kind', edge_kind, count(*) FROM edges GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM nodes GROUP BY ALL""", "nodes", "edges"),
    "graph_dangling": with_views("""WITH n AS (SELECT node_id FROM nodes WHERE node_kind <> 'component') SELECT edge_id, 'source_ref' AS "end" FROM edges WHERE source_ref NOT IN (SELECT node_id FROM n) UNION ALL SELECT edge_id, 'target_ref' FROM edges WHERE target_ref NOT IN (SELECT node_id FROM n)""", "nodes", "edges"),
    "graph_tree": with_views("""WITH RECURSIVE e AS (SELECT * FROM edges WHERE edge_kind <> 'calls'), w AS (
  SELECT CAST(NULL AS VARCHAR) AS parent, node_id AS child, 0 AS level FROM nodes WHERE node_kind = 'firmware'
  UNION ALL SELECT w.child, e.source_ref, w.level + 1 FROM w JOIN e ON e.target_ref = w.child WHERE w.level < 16
), p AS (SELECT child, min(level) AS level FROM w GROUP BY child), t AS (SELECT min(w.parent) AS parent, child, level FROM w JOIN p USING (child, level) GROUP BY child, level),
k AS (SELECT parent AS child, count(*) AS children FROM t WHERE parent IS NOT NULL GROUP BY 1)
SELECT parent, child, level, coalesce(children, 0) AS children, coalesce(children, 0) > 0 AS expandable FROM t LEFT JOIN k USING (child)""", "nodes", "edges"),
    "snapshot_diff": with_views(f"WITH {_SNAP} SELECT * FROM changes WHERE change IS NOT NULL", "snap_base", "snap_target"),
    "snapshot_summary": with_views(f"WITH {_SNAP} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed FROM changes", "snap_base", "snap_target"),
    "aligned_members": with_views("""WITH a AS (SELECT *, array_to_string(regexp_extract_all(lower(regexp_extract(regexp_replace(split_part(endpoint, '?', 1), '/+$', ''), '[^/]*$')), '[a-z0-9]+'), ' ') AS alignment FROM frontend)
SELECT alignment, string_agg(DISTINCT endpoint, ',' ORDER BY endpoint) AS endpoint, string_agg(DISTINCT endpoint_shape, ',' ORDER BY endpoint_shape) AS endpoint_shape, count(*) AS members FROM a GROUP BY alignment""", "frontend"),
    "hist_status": with_views(f"WITH {_EXPECTED} SELECT * FROM judged", "expectations", "observed"),
    "hist_bindings": with_views("""WITH o AS (SELECT *, regexp_extract(canonical_identity, '[^/]*$') AS route FROM observed), b AS (SELECT route, list(DISTINCT handler) AS handlers FROM o WHERE candidate_kind = 'frontend_request' GROUP BY route), c AS (SELECT DISTINCT route FROM o WHERE candidate_kind = 'native_hint'),
e AS (SELECT *, regexp_extract(interface_value, '[^/]*$') AS route FROM expectations)
SELECT identifier, CASE WHEN list_contains(handlers, e.handler) THEN 'verified_expected_handler' WHEN handlers IS NOT NULL AND e.handler IS NOT NULL THEN 'handler_mismatch' WHEN handlers IS NOT NULL THEN 'verified_route_binding'
  WHEN e.route IN (SELECT route FROM c) OR coalesce(e.handler, '') IN (SELECT route FROM c) THEN 'native_clue_only' ELSE 'binding_not_observed' END AS status FROM e LEFT JOIN b ON e.route = b.route""", "expectations", "observed"),
    "audit_partition": with_views(f"WITH {_AUDIT} SELECT category, count(*) AS n FROM audit GROUP BY category", "expectations"),
    "coverage_queue": with_views(f"""WITH {_AUDIT}, clues AS (SELECT 'CVE-H-' || c_custkey AS identifier, CASE WHEN c_custkey % 8 = 0 THEN 'the' ELSE 'ssid' END AS p, c_custkey % 6 = 0 AS h, c_custkey % 14 = 0 AS i, c_custkey % 10 = 0 AS c FROM customer WHERE c_custkey % 2 = 0),
m AS (SELECT audit.identifier, category, coalesce(p IN ({_list(SUSPICIOUS)}), false) AS s, coalesce(h, false) AS h, coalesce(i, false) AS i, coalesce(c, false) AS c FROM audit LEFT JOIN clues USING (identifier) WHERE category <> 'compared')
SELECT identifier, category, CASE WHEN category = 'not_analyzed' THEN 'analyze_semantics' WHEN category = 'no_structured_communication' THEN 'extract_structured_communication' WHEN s OR c THEN 'repair_parameter_extraction' WHEN i THEN 'verify_source_expectation' WHEN h THEN 'resolve_handler_to_route' ELSE 'recover_interface' END AS action,
       CASE WHEN category = 'not_analyzed' THEN 30 WHEN category = 'no_structured_communication' THEN 50 WHEN s THEN 100 WHEN c THEN 95 WHEN i THEN 90 WHEN h THEN 85 ELSE 80 END AS priority FROM m""", "expectations"),
    "coverage_ledger": with_views(f"""WITH {_EXPECTED}, g AS (SELECT 'G' || CAST(split_part(identifier, '-', 3) AS INT) % 211 AS identifier, list_sort(list(DISTINCT status)) AS s FROM judged GROUP BY 1)
SELECT identifier, CASE WHEN len(s) = 1 THEN s[1] ELSE 'partial' END AS status, 'overlay' AS origin FROM g UNION ALL SELECT 'Q' || n_nationkey, 'queued', 'queue' FROM nation""", "expectations", "observed"),
    "coverage_gate": with_views("SELECT producer_kind, scope, bool_or(required) AS required, count(*) AS results, CASE WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'partial' END AS status FROM coverage GROUP BY ALL", "coverage"),
    "required_coverage": with_views("""WITH b AS (SELECT producer_kind, scope, CASE WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'partial' END AS status FROM coverage GROUP BY ALL),
x AS (SELECT 'c' || (c_custkey - 1) AS scope, c_custkey % 2 = 0 AS required, unnest(['frontend', 'native', 'script']) AS producer_kind FROM customer)
SELECT x.producer_kind, x.scope, coalesce(b.status, CASE WHEN required THEN 'failed' ELSE 'not_applicable' END) AS status FROM x LEFT JOIN b ON x.producer_kind = b.producer_kind AND x.scope = b.scope""", "coverage"),
    "corpus_gate": """WITH s AS (SELECT p_brand AS category, p_partkey AS n FROM part), r AS (
  SELECT category, CASE WHEN n % 4 = 0 THEN 'acquisition_gap' WHEN (n % 3 = 0 AND n % 6 = 0) OR (n % 5 = 0 AND n % 10 = 0) OR n % 7 = 0 OR n % 11 = 0 THEN 'coverage_gap' WHEN n % 4 = 1 THEN 'verified' WHEN n % 4 = 2 THEN 'derived_only' ELSE 'contract_only' END AS status FROM s)
SELECT category, CASE WHEN bool_or(status = 'verified') THEN 'verified' WHEN bool_or(status = 'derived_only') THEN 'derived_only' WHEN bool_or(status = 'coverage_gap') THEN 'coverage_gap' WHEN bool_or(status = 'contract_only') THEN 'contract_only' ELSE 'acquisition_gap' END AS category_status,
  count(*) AS samples, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'derived_only') AS derived_only, count(*) FILTER (status = 'coverage_gap') AS coverage_gap, count(*) FILTER (status = 'contract_only') AS contract_only FROM r GROUP BY category""",
    "budget_prefix": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS size FROM lineitem),
s AS (SELECT *, CAST(sum(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM l)
SELECT l_orderkey, l_linenumber, spent, CASE WHEN (SELECT max(spent) FROM s m WHERE m.l_orderkey = s.l_orderkey) > 60 THEN 'partial' ELSE 'completed' END AS status FROM s WHERE spent <= 60""",
    "interface_path_terms": with_views(f"""WITH c AS (SELECT part_id, lower(regexp_replace(regexp_extract(value, '[^/]*$'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS leaf, lower(regexp_replace(value, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS whole FROM routes)
SELECT part_id, array_to_string(list_sort(list_distinct([t FOR t IN regexp_extract_all(leaf, '[a-z0-9]+') IF length(t) > 1 AND t NOT IN ({_list(TERM_STOPWORDS)})])), ' ') AS terms, array_to_string(regexp_extract_all(whole, '[a-z0-9]+'), ' ') AS search_text FROM c""", "routes"),
    "page_links": f"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS value, 'http_route' AS kind, '' AS component FROM pages), {_styled("h")}
SELECT category, subtype, count(*) AS links, count(DISTINCT page_id) AS pages FROM styled GROUP BY ALL""",
    "event_properties": "SELECT event_type, count(k) AS n, count(DISTINCT k) AS kinds, max(k) AS greatest FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) GROUP BY event_type",
    "semantic_overview": with_views("""WITH c AS (SELECT analysis_id FROM analyses WHERE is_current),
d AS (SELECT count(DISTINCT identifier) AS analyzed, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM analyses WHERE is_current AND status IN ('succeeded', 'partial')),
t AS (SELECT count(*) AS total FROM vulns WHERE relevance_level IN ('strong', 'likely'))
SELECT total, analyzed, greatest(0, total - analyzed) AS pending, (SELECT count(*) FROM interface_obs SEMI JOIN c USING (analysis_id)) AS interfaces, (SELECT count(*) FROM parameter_obs SEMI JOIN c USING (analysis_id)) AS parameters,
       prompt_tokens, completion_tokens FROM d, t""", "vulns", "analyses", "interface_obs", "parameter_obs"),
    "top_parameters": with_views("SELECT p.name AS label, count(*) AS n FROM parameter_obs p JOIN analyses a USING (analysis_id) WHERE is_current GROUP BY 1 ORDER BY n DESC, label LIMIT 8", "parameter_obs", "analyses"),
    "stage_results": """WITH r AS (SELECT 's' || (c_nationkey + 5) AS stage, c_nationkey % 3 = 0 OR c_custkey % 7 <> 0 AS whole, CASE WHEN c_custkey % 2 = 0 THEN 'd' || (c_custkey % 8) END AS code FROM customer),
g AS (SELECT stage, bool_and(whole) AS whole, count(*) AS results, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes FROM r GROUP BY stage)
SELECT 's' || n_nationkey AS stage, CASE WHEN results IS NULL THEN 'not_applicable' WHEN whole THEN 'completed' ELSE 'partial' END AS status, coalesce(results, 0) AS results,
       CASE WHEN results IS NULL THEN 'no selected sources' ELSE codes END AS diagnostics FROM nation LEFT JOIN g ON g.stage = 's' || n_nationkey""",
    "proposal_reasons": with_views(f"""WITH j AS (SELECT CASE WHEN place >= 50000 THEN 'budget' WHEN kind NOT IN ({_list(PROPOSAL_KINDS)}) THEN 'kind' WHEN place % 30 > 24 THEN 'target'
  WHEN CAST(substr(split_part(citations, ';', 1), 2) AS INT) > 7 OR CAST(substr(split_part(citations, ';', 2), 2) AS INT) > 7 THEN 'evidence' WHEN trim(summary) = '' THEN 'summary' WHEN lower(required_corroboration) = 'n/a' THEN 'corroboration'
  WHEN confidence > 0.9 THEN 'confidence' END AS reason, kind, target_ref, summary, citations, confidence, run_id FROM proposals)
SELECT reason, count(*) AS n, CASE WHEN reason IS NULL THEN count(DISTINCT (run_id, kind, target_ref, summary, list_distinct(string_split(citations, ';')), confidence)) ELSE 0 END AS ids FROM j GROUP BY reason""", "proposals"),
    "pivot_anchors": f"""WITH t AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(p_name || ' Status-menu_' || p_type), '[a-z0-9]+')) AS feature_token FROM part)
SELECT feature_token, count(*) AS gates FROM t WHERE length(feature_token) >= 4 AND feature_token NOT IN ({_list(GENERIC_TOKENS)}) GROUP BY 1""",
    "url_selectors": """WITH p AS (SELECT page_id, unnest(string_split(substr(url, instr(url, '?') + 1), '&')) AS part FROM pages WHERE contains(url, '?')),
s AS (SELECT CASE WHEN contains(part, '=') THEN instr(part, '=') ELSE instr(part, '/') END AS mark, part FROM p), f AS (SELECT substr(part, 1, mark - 1) AS name, substr(part, mark + 1) AS value FROM s WHERE mark > 1)
SELECT name, count(*) AS n, count(DISTINCT value) AS values FROM f WHERE value <> '' GROUP BY name""",
}
