"""Interface styles and routes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The seven styles and their subtypes.
STYLES = ("form_handler", "cgi_gateway", "hnap_soap", "resource_api", "web_action", "rpc_command", "management_route")
#: File names that many actions share, folders of management modules, words that tell nothing.
SHARED_CGI = ("cstecgi.cgi", "webproc", "apply.cgi", "cgi", "main")
MANAGEMENT_FOLDERS = ("admin", "web", "cgi", "management", "manage")
DATA_SUFFIXES, MEDIA_SUFFIXES = ("xml", "json"), ("jpg", "jpeg", "png", "gif", "mp4", "mjpg")
CALL_KINDS = ("rpc", "command", "topic", "socket", "device_node")
TERM_STOPWORDS = ("cgi", "api", "goform", "hnap")


def _starts(value: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | value.startswith(p)
    return out


def interface_style(value: Column, kind: Column | None = None, component: Column | None = None) -> Column:
    """One of ``STYLES``; empty for bare listeners."""
    v, k, c = (F.lower(F.coalesce(x, F.lit(""))) if x is not None else F.lit("") for x in (value, kind, component))
    return (
        F.when(_starts(v, "tcp://", "udp://") | (k == "network_listener"), "")
        .when(_starts(v, "/goform/", "/form/"), "form_handler")
        .when(_starts(v, "/cgi-bin/", "/scgi-bin/") | v.contains(".cgi"), "cgi_gateway")
        .when(v.contains("hnap") | v.contains("soap") | c.contains("soap") | v.startswith("/control/"), "hnap_soap")
        .when(_starts(v, "/api/", "/rest/", "/v1/", "/v2/"), "resource_api")
        .when(v.rlike(r"\.(?:asp|aspx|php|jsp|do|action)(?:/|$)"), "web_action")
        .when(k.isin(*CALL_KINDS), "rpc_command")
        .otherwise("management_route")
    )


def interface_subtype(value: Column, style: Column, kind: Column | None = None, component: Column | None = None) -> Column:
    """The routing architecture within a style; empty where there is no style."""
    raw = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "'+$", "")
    low, k = F.lower(raw), F.lower(F.coalesce(kind, F.lit(""))) if kind is not None else F.lit("")
    context = F.lower(F.concat(F.coalesce(value, F.lit("")), F.lit(" "), F.coalesce(component, F.lit("")) if component is not None else F.lit("")))
    slashes = F.length(low) - F.length(F.replace(low, F.lit("/"), F.lit("")))
    leaf, low_leaf = F.substring_index(raw, "/", -1), F.substring_index(low, "/", -1)
    letters = leaf.rlike("[A-Za-z]")
    web = F.when(low.rlike(r"\.(?:do|action)(?:/|$)"), "framework_action_dispatcher").when(low.rlike(r"\.(?:jsp|aspx)(?:/|$)"), "servlet_page_controller").when(slashes > 1, "namespaced_page_controller").otherwise("flat_page_controller")
    form = (
        F.when(raw.contains("*"), "goform_wildcard_dispatcher").when(low.startswith("/form/"), "form_namespace_registry").when(leaf.contains("_"), "goform_snake_registry")
        .when(letters & (leaf == F.lower(leaf)), "goform_lower_registry").when(letters & (leaf == F.upper(leaf)), "goform_symbol_registry").otherwise("goform_camel_registry")
    )
    cgi = (
        F.when(low.startswith("/scgi-bin/"), "scgi_gateway").when(low_leaf.isin(*SHARED_CGI), "shared_cgi_dispatcher")
        .when(low.startswith("/cgi-bin/") & (slashes > 2), "nested_cgi_module").when(low.startswith("/cgi-bin/"), "cgi_executable_registry").otherwise("external_cgi_handler")
    )
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[/.]+$", "")
    hnap = F.when(bare == "/hnap1", "hnap_envelope_dispatcher").when(bare.startswith("/hnap1/"), "hnap_uri_method").when(bare.startswith("/control/"), "upnp_service_control").otherwise("soap_service_endpoint")
    parts = F.split(low, "/")
    first, second, more = F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.coalesce(F.get(parts, F.lit(2)), F.lit("")), lambda n: F.size(parts) > n
    rooted = F.get(parts, F.lit(0)) == ""
    digits = lambda x: F.forall(F.split(x, "[.]"), lambda d: (d != "") & (F.translate(d, "0123456789", "") == "")) & (F.size(F.split(x, "[.]")) <= 2)
    numbered = lambda x: digits(x) | (x.startswith("v") & digits(F.substr(x, F.lit(2))))
    versioned = F.when(first == "api", numbered(second) & more(3)).otherwise(first.startswith("v") & numbered(first) & more(2))
    api = (
        F.when(rooted & versioned, "versioned_resource_router").when(rooted & (first == "rest") & more(2), "rest_resource_tree")
        .when(rooted & (first == "api") & more(3), "namespaced_api_router").otherwise("flat_api_registry")
    )
    rpc = (
        F.when(context.rlike("command|exec|shell|cmd"), "command_execution").when(context.rlike("topic|mqtt|message|publish|subscribe"), "message_topic")
        .when((k == "device_node") | F.trim(context).startswith("/dev/"), "device_node").otherwise("rpc_method")
    )
    suffixed = lambda *names: F.exists(parts, lambda x: x.contains(".") & F.substring_index(x, ".", -1).isin(*names))
    own = F.split(F.trim(F.coalesce(value, F.lit(""))), "/")
    alone = (F.size(own) == 2) & (F.get(own, F.lit(0)) == "") & F.get(own, F.lit(1)).rlike("^[A-Za-z]") & (F.regexp_replace(F.get(own, F.lit(1)), r"[\w-]", "") == "")
    management = (
        F.when(rooted & (first == "boafrm") & more(2), "boafrm_handler_registry").when(suffixed(*DATA_SUFFIXES), "structured_data_endpoint").when(suffixed(*MEDIA_SUFFIXES), "media_endpoint")
        .when(rooted & first.isin(*MANAGEMENT_FOLDERS) & more(2), "namespaced_management_router").when(F.coalesce(alone, F.lit(False)), "flat_named_management_handler").otherwise("unresolved_management_route")
    )
    out = F.lit("")
    for name, expression in zip(STYLES, (form, cgi, hnap, api, web, rpc, management)):
        out = F.when(style == name, expression).otherwise(out)
    return out


def camel_split(value: Column) -> Column:
    return F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2")


def search_terms(value: Column) -> Column:
    """Distinct terms of two letters and more, CamelCase split, without words that tell nothing."""
    terms = F.regexp_extract_all(F.lower(camel_split(value)), F.lit("([a-z0-9]+)"), 1)
    return F.array_except(F.filter(terms, lambda t: F.length(t) > 1), F.array(*map(F.lit, TERM_STOPWORDS)))


def search_text(value: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(camel_split(value)), F.lit("([a-z0-9]+)"), 1), " ")


def endpoint_component(endpoint: Column) -> Column:
    """The last path segment before any query."""
    return F.substring_index(F.regexp_replace(F.substring_index(endpoint, "?", 1), "/+$", ""), "/", -1)


def interface_identity(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), "^/+", "")


def display_path(identity: Column) -> Column:
    return F.when(identity.startswith("goform/"), F.concat(F.lit("/"), identity)).otherwise(identity)


def normalized_identity(value: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit("([a-z0-9]+)"), 1), " ")


def glob_pattern(pattern: Column) -> Column:
    """A case-sensitive glob (``*``, ``?``) as a whole-string regular expression."""
    p = F.regexp_replace(pattern, r"([\\.^$|()\[\]{}+])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(p, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def parameter_type(values: Column) -> Column:
    """boolean, integer, string or unknown, from the literals seen."""
    all_match = lambda pattern: F.forall(values, lambda v: F.lower(v).rlike(pattern))
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, "unknown").when(all_match("^(?:true|false)$"), "boolean").when(all_match(r"^[+-]?\d+$"), "integer").otherwise("string")
