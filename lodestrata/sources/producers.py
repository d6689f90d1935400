"""Table functions over file contents: requests, configurations, scripts and strings.

Each takes files (canonical_path, content) and gives rows with the byte span they stand at.
Contents are cut by regular expressions inside Arrow batches; one file is one small task, and
Spark deals out the files.  A file that is not UTF-8 text gives one row of status ``failed``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "canonical_path string, kind string, value string, detail string, namespace string, source_construct string, start_byte bigint, end_byte bigint, status string"
_COLUMNS = [c.split()[0] for c in ROW.split(", ")]
Found = tuple[str, str, str | None, str | None, str, int, int]


def table_function(scan: Callable[[str, str], Iterator[Found]], most_bytes: int = 8 << 20) -> Callable[[DataFrame], DataFrame]:
    """Files to rows; files over ``most_bytes`` are ``skipped_by_policy``."""

    def run(files: DataFrame) -> DataFrame:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows: list[tuple] = []
                for path, content in zip(batch["canonical_path"], batch["content"]):
                    if content is None or len(content) > most_bytes:
                        rows.append((path, "", "", None, None, "", 0, 0, "skipped_by_policy"))
                        continue
                    try:
                        text = bytes(content).decode("utf-8")
                    except UnicodeDecodeError:
                        rows.append((path, "", "", None, None, "", 0, 0, "failed"))
                        continue
                    place = _byte_places(text)
                    rows += [(path, k, v, d, n, c, place(a), place(b), "completed") for k, v, d, n, c, a, b in scan(path, text)]
                yield pd.DataFrame(rows, columns=_COLUMNS)

        return files.select("canonical_path", "content").mapInPandas(each, ROW)

    return run


def _byte_places(text: str) -> Callable[[int], int]:
    if text.isascii():
        return lambda i: i
    return lambda i: len(text[:i].encode())


class _Forms(HTMLParser):
    def __init__(self, text: str):
        super().__init__()
        self.lines = [0]
        for m in re.finditer("\n", text):
            self.lines.append(m.end())
        self.form: tuple | None = None
        self.found: list[tuple] = []

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "form" and a.get("action"):
            self.form = (a["action"], (a.get("method") or "GET").upper(), a.get("enctype") or "application/x-www-form-urlencoded", self._at(), len(self.get_starttag_text()), [])
        elif tag == "input" and self.form and a.get("name"):
            self.form[5].append(a["name"])

    def handle_endtag(self, tag):
        if tag == "form" and self.form:
            self.found.append(self.form)
            self.form = None


def _forms(path: str, text: str) -> Iterator[Found]:
    """Closed forms with an action: request, method and parameters."""
    parser = _Forms(text)
    parser.feed(text)
    parser.close()
    for action, method, encoding, at, size, names in parser.found:
        role = "read" if method == "GET" else "write"
        yield "request", action, json.dumps({"method": method, "role": role, "encoding": encoding, "parameters": names}, sort_keys=True), None, "html.form", at, at + size


_QUOTED = r"""(?P<q>["'])(?P<v>(?:\\.|(?!(?P=q)).)*)(?P=q)"""
_POST = re.compile(r"\$\.post\s*\(\s*" + _QUOTED + r"(?:\s*,\s*(?P<p>[\"'])(?P<b>(?:\\.|(?!(?P=p)).)*)(?P=p))?")
_GET_JSON = re.compile(r"\$\.getJSON\s*\(\s*" + _QUOTED + r"\s*(?P<plus>\+)?")
_RPC = re.compile(r"rpc\.declare\s*\(\s*\{(?P<body>[^{}]*)\}")
_SELECTORS = ("action", "cmd", "operation", "op")
_REQUEST_SELECTORS = ("action", "cmd", "command", "method", "operation", "topicurl")
_OBJECT_CALL = re.compile(r"(?P<name>\$\.ajax|\b[A-Za-z_$][\w$]*\.request)\s*\(\s*(?=\{)")
_SET_DATA = re.compile(r"\$\.GetSetData\.setData\s*\(\s*" + _QUOTED + r"\s*(?P<plus>\+)?[^,()]*,\s*(?=\{)")
_PAIR = re.compile(r"""(?P<key>[A-Za-z_$][\w$-]*|"[^"\n]*"|'[^'\n]*')\s*:\s*(?P<value>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[^,{}\[\]()]*)""")


def _object(text: str, at: int) -> tuple[dict[str, str | None], int]:
    """The outermost pairs of the object literal that begins at ``at``, and its end; values that are no strings are None."""
    depth, pairs, i = 0, {}, at
    while i < len(text):
        c = text[i]
        if c in "\"'" and depth != 1:
            quoted = re.compile(r"(?:\\.|[^\\\n])*?" + c).match(text, i + 1)
            i = quoted.end() if quoted else i + 1
            continue
        if depth == 1 and (m := _PAIR.match(text, i)):
            value = m["value"].strip()
            pairs.setdefault(m["key"].strip("\"'"), value[1:-1] if value[:1] in ("'", '"') and len(value) > 1 else None)
            i = m.end()
            continue
        depth += (c in "{[(") - (c in "}])")
        i += 1
        if depth == 0:
            break
    return pairs, i


def _javascript(path: str, text: str) -> Iterator[Found]:
    """jQuery posts, JSON reads and ajax calls, custom requests and declared RPC methods, outside comments."""
    masked = mask_comments(text)
    for m in _POST.finditer(masked):
        pairs = re.findall(r"(?:^|&)([A-Za-z_][\w.-]*)=([^&]*)", m["b"] or "")
        detail = {"method": "POST", "parameters": [n for n, _ in pairs], "selectors": {n: v for n, v in pairs if n in _SELECTORS}}
        yield "request", m["v"], json.dumps(detail, sort_keys=True), None, "jquery.post", m.start("v"), m.end("v")
    for m in _GET_JSON.finditer(masked):
        yield "request", m["v"], json.dumps({"method": "GET", "shape": "literal_prefix" if m["plus"] else "exact_literal"}, sort_keys=True), None, "jquery.getJSON", m.start("v"), m.end("v")
    for m in _OBJECT_CALL.finditer(masked):
        pairs, end = _object(masked, m.end())
        low = {k.lower(): v for k, v in pairs.items()}
        if not low.get("url"):
            continue
        kind = (low.get("contenttype") or "").lower()
        detail = {"method": (low.get("type") or low.get("method") or "").upper() or None, "representation": next((r for mark, r in (("xml", "xml"), ("json", "json"), ("x-www-form-urlencoded", "form_urlencoded")) if mark in kind), None)}
        data = re.compile(r"""\bdata["']?\s*:\s*(?=\{)""").search(masked, m.end(), end)
        fields = _object(masked, data.end())[0] if data else {}
        detail |= {"parameters": list(fields), "selectors": {k: v for k, v in fields.items() if v is not None and k.lower() in _REQUEST_SELECTORS}}
        yield "request", low["url"], json.dumps(detail, sort_keys=True), None, "jquery.ajax" if m["name"] == "$.ajax" else "custom.request", m.start(), end
    for m in _SET_DATA.finditer(masked):
        detail = {"method": "POST", "parameters": list(_object(masked, m.end())[0]), "shape": "literal_prefix" if m["plus"] else "exact_literal"}
        yield "request", m["v"], json.dumps(detail, sort_keys=True), None, "custom.GetSetData.setData", m.start("v"), m.end("v")
    for m in _RPC.finditer(masked):
        named = dict(re.findall(r"""(object|method)\s*:\s*["']([^"']+)["']""", m["body"]))
        if len(named) == 2:
            inputs = re.search(r"params\s*:\s*\[([^\]]*)\]", m["body"])
            detail = {"method": "POST", "parameters": re.findall(r"""["']([^"']+)["']""", inputs[1]) if inputs else []}
            yield "request", f"ubus://{named['object']}/{named['method']}", json.dumps(detail, sort_keys=True), None, "luci.rpc.declare", m.start(), m.end()


def mask_comments(text: str) -> str:
    """Comments as blanks of equal length; strings stay."""
    pattern = re.compile(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(/\*.*?\*/|//[^\n]*)""", re.S)
    return pattern.sub(lambda m: m[1] or re.sub(r"[^\n]", " ", m[2]), text)


def _lighttpd(path: str, text: str) -> Iterator[Found]:
    scopes: list[str] = []
    for m in re.finditer(r"[^\n]*\n?", text):
        line, at = re.sub(r"#.*$", "", m[0]).rstrip("\n"), m.start()
        if s := re.search(r"""^\s*\$HTTP\[\s*["']url["']\s*\]\s*=~\s*["'](.+?)["']\s*\{""", line):
            scopes.append(re.sub(r"^\^|\$$", "", s[1]))
        elif s := re.search(r"""^\s*\$SERVER\[\s*["']socket["']\s*\]\s*==\s*["'](?:[^"']*:)?(\d+)["']""", line):
            yield "listener", s[1], None, None, "lighttpd.socket", at + s.start(1), at + s.end(1)
        elif s := re.match(r"\s*server\.port\s*=\s*(\d+)", line):
            yield "listener", s[1], None, None, "lighttpd.server.port", at + s.start(1), at + s.end(1)
        elif s := re.match(r"""\s*server\.document-root\s*=\s*["']([^"']+)["']""", line):
            yield "document_root", s[1], None, "/", "lighttpd.server.document-root", at + s.start(1), at + s.end(1)
        elif (s := re.match(r"\s*(cgi\.assign)\s*=", line)) and scopes:
            yield "namespace_mapping", "cgi", "cgi_executor", scopes[-1], "lighttpd.cgi.assign", at + s.start(1), at + s.end(1)
        if line.strip().startswith("}") and scopes:
            scopes.pop()


def _nginx(path: str, text: str) -> Iterator[Found]:
    """Statements of server and location blocks; a location's mappings come when it closes."""
    blocks: list[dict] = []
    words: list[tuple[str, int, int]] = []
    for m in re.finditer(r"""#[^\n]*|"((?:\\.|[^"])*)"|'((?:\\.|[^'])*)'|[{};]|[^\s{};"'#]+""", text):
        token = m[0]
        if token.startswith("#"):
            continue
        if token == "{":
            name = words[-1][0] if words and words[0][0] == "location" else None
            blocks.append({"kind": words[0][0] if words else "", "namespace": name, "mappings": [], "internal": False, "auth": None, "users": None})
            words = []
        elif token == "}":
            if blocks:
                b = blocks.pop()
                for directive, (v, s, e) in b["mappings"]:
                    kind = {"alias": "internal_alias" if b["internal"] else "alias", "fastcgi_pass": "fastcgi", "proxy_pass": "reverse_proxy"}[directive]
                    yield "namespace_mapping", v, kind, b["namespace"], f"nginx.{directive}", s, e
                if b["kind"] in ("location", "server") and b["auth"]:
                    v, s, e = b["auth"]
                    if v.lower() == "off" or b["users"]:
                        yield "authentication", "off" if v.lower() == "off" else "basic", b["users"], b["namespace"], "nginx.auth_basic", s, e
            words = []
        elif token == ";":
            if words:
                directive, rest = words[0][0], words[1:]
                inner = next((b for b in reversed(blocks) if b["kind"] == "location"), None)
                scope = next((b for b in reversed(blocks) if b["kind"] in ("location", "server")), None)
                if directive == "listen" and rest:
                    yield "listener", rest[0][0], None, None, "nginx.listen", rest[0][1], rest[0][2]
                elif directive == "root" and rest:
                    yield "document_root", rest[0][0], None, scope["namespace"] if scope else None, "nginx.root", rest[0][1], rest[0][2]
                elif directive in ("alias", "fastcgi_pass", "proxy_pass") and rest and inner:
                    inner["mappings"].append((directive, rest[0]))
                elif directive == "internal" and inner:
                    inner["internal"] = True
                elif directive == "auth_basic" and rest and scope:
                    scope["auth"] = rest[0]
                elif directive == "auth_basic_user_file" and rest and scope:
                    scope["users"] = rest[0][0]
            words = []
        else:
            words.append((m[1] or m[2] or token if token[0] in "\"'" else token, m.start(), m.end()))


def _uhttpd(path: str, text: str) -> Iterator[Found]:
    kinds = {"listen_http": "listener", "listen_https": "listener", "home": "document_root", "cgi_prefix": "namespace_mapping", "lua_prefix": "namespace_mapping"}
    for m in re.finditer(r"""^[ \t]*(?:option|list)[ \t]+(\w+)[ \t]+(?:'([^'\n]*)'|"([^"\n]*)"|(\S+))""", text, re.M):
        if m[1] in kinds:
            value = next(x for x in m.groups()[1:] if x is not None)
            space, _, handler = value.partition("=") if m[1] == "lua_prefix" else (value, "", "cgi")
            mapped = kinds[m[1]] == "namespace_mapping"
            yield kinds[m[1]], handler if mapped else value, None, space if mapped else ("/" if m[1] == "home" else None), f"uhttpd.{m[1]}", m.start(), m.end()


_SCRIPTS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "php": (("parameter", r"""\$_(?:GET|POST|REQUEST)\s*\[\s*["']([^"']+)["']\s*\]""", "php.superglobal"), ("include", r"""\b(?:include|require)(?:_once)?\s*\(?\s*["']([^"']+)["']""", "php.include")),
    "asp": (("parameter", r"""(?i)Request_Form\s*\(\s*["']([^"']+)["']\s*\)""", "asp.request_form"), ("state", r"""(?i)TCWebApi_(?:set|commit)\s*\(\s*["']([^"']+)["']""", "asp.state")),
    "lua": (("route", r"""\bentry\s*\(\s*\{([^{}]*)\}""", "lua.entry"), ("parameter", r"""\bformvalue\s*\(\s*["']([^"']+)["']""", "lua.formvalue")),
    "shell": (("parameter", r"""\$\{?(QUERY_STRING|REQUEST_METHOD|CONTENT_LENGTH|FORM_\w+)\b""", "shell.environment"), ("state", r"""\b(?:nvram|uci)\s+(?:set|get)\s+([\w.@\[\]-]+)""", "shell.state")),
}


def script_language(path: str, text: str) -> str | None:
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    by_suffix = {"php": "php", "asp": "asp", "lua": "lua", "sh": "shell"}
    first = text.split("\n", 1)[0]
    return by_suffix.get(suffix) or ("lua" if first.startswith("#!") and "lua" in first else "shell" if first.startswith("#!") and "sh" in first else None)


def _script(path: str, text: str) -> Iterator[Found]:
    language = script_language(path, text)
    if language is None:
        return
    marks = {"shell": r"(?m)(?:^|(?<=\s))#[^\n]*", "lua": r"--\[\[.*?\]\]|--[^\n]*", "asp": r"<%--.*?--%>"}
    masked = mask_comments(text) if language == "php" else re.sub(marks[language], lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    for kind, pattern, construct in _SCRIPTS[language]:
        for m in re.finditer(pattern, masked):
            yield kind, m[1], None, None, construct, m.start(1), m.end(1)


def _json_kind(v) -> str:
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def _fixture(path: str, text: str) -> Iterator[Found]:
    """Fields of a JSON document with their pointers; items of arrays share ``/*``."""
    try:
        todo = [("", json.loads(text))]
    except json.JSONDecodeError:
        return
    while todo:
        pointer, value = todo.pop()
        if isinstance(value, dict):
            for name, child in value.items():
                at = f"{pointer}/{name.replace('~', '~0').replace('/', '~1')}"
                yield "field", name, _json_kind(child), at, "json.field", 0, 0
                todo.append((at, child))
        elif isinstance(value, list):
            todo += [(f"{pointer}/*", child) for child in value]


html_forms, javascript_requests, lighttpd, nginx, uhttpd, scripts, response_fields = (table_function(f) for f in (_forms, _javascript, _lighttpd, _nginx, _uhttpd, _script, _fixture))


def printable_strings(files: DataFrame, least: int = 4) -> DataFrame:
    """(canonical_path, value): runs of printable ASCII in binary contents, with their places."""
    run = re.compile(rb"[\x20-\x7e]{%d,}" % least)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, m[0].decode("ascii"), m.start(), m.end()) for p, c in zip(batch["canonical_path"], batch["content"]) for m in run.finditer(bytes(c or b""))]
            yield pd.DataFrame(rows, columns=["canonical_path", "value", "start_byte", "end_byte"])

    return files.select("canonical_path", "content").mapInPandas(each, "canonical_path string, value string, start_byte bigint, end_byte bigint")


def native_hints(strings: DataFrame) -> DataFrame:
    """Strings that look like endpoints, route tokens or servers."""
    v = F.col("value")
    kind = F.when(v.rlike(r"^/[A-Za-z0-9._/-]{2,}$"), "endpoint_literal").when(v.rlike(r"(?i)\b(?:httpd|lighttpd|nginx|boa|goahead)\b"), "server_hint").when(v.rlike(r"^[A-Za-z][A-Za-z0-9_]{2,63}$"), "route_token")
    return strings.withColumn("kind", kind).where("kind is not null")


def symbol_table(definitions: DataFrame) -> DataFrame:
    """(symbol, value, status): a symbol resolves only where it is defined exactly once."""
    counted = definitions.groupBy("symbol").agg(F.count("*").alias("n"), F.countDistinct("value").alias("values"), F.min("value").alias("value"))
    return counted.select("symbol", F.when(F.col("n") == 1, F.col("value")).alias("value"), F.when(F.col("n") == 1, "resolved").when(F.col("values") == 1, "ambiguous").otherwise("conflict").alias("status"))
