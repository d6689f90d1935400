"""Names of device models, selectors in upload URLs, places in files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for an unknown name, spellings of vendors, and labels.
UNKNOWN = ("", "n/a", "unknown", "unspecified")
VENDOR_LABELS = {
    "dlink": "D-Link", "d-link": "D-Link", "tplink": "TP-Link", "tp-link": "TP-Link", "totolink": "TOTOLINK", "tenda": "Tenda", "netgear": "NETGEAR", "linksys": "Linksys", "zyxel": "Zyxel",
}
NO_VENDOR_LABEL, NO_MODEL, MODEL_SUFFIX, NO_VERSION = "未知厂商", "未知型号", "固件", "版本未明确"
PACKAGE_WORDS = ("firmware", "software")


def title_case(value: Column) -> Column:
    """Each run of letters with a capital first, as in ``Tp-Link``."""
    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit("([A-Za-z]+|[^A-Za-z]+)"), 1), F.initcap), "")


def firmware_model(vendor: Column, product: Column, title: Column, summary: Column, cpes: Column) -> Column:
    """Struct key, label, vendor, model, version_summary, source and alignment of a vulnerability's device.

    Vendor and product win; where they are unknown, the first CPE names them.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    split = F.transform(F.coalesce(cpes, F.array().cast("array<string>")), lambda c: F.split(c, ":"))
    named = lambda at, least: F.transform(F.filter(split, lambda p: (F.size(p) > least) & ~p[at].isin("", "*", "-")), lambda p: p[at])
    spaced = lambda values: F.transform(values, lambda x: F.replace(F.replace(x, F.lit("\\_"), F.lit("_")), F.lit("_"), F.lit(" ")))
    cpe_vendor = F.coalesce(F.get(F.transform(named(3, 4), lambda x: F.replace(x, F.lit("_"), F.lit(" "))), F.lit(0)), F.lit(""))
    products = spaced(named(4, 5))
    labels = F.create_map(*(F.lit(x) for pair in VENDOR_LABELS.items() for x in pair))
    v = F.when(F.lower(text(vendor)).isin(*UNKNOWN), F.coalesce(labels[F.lower(cpe_vendor)], title_case(cpe_vendor))).otherwise(text(vendor))
    by_cpe = F.lower(text(product)).isin(*UNKNOWN)
    m = F.when(by_cpe, F.coalesce(F.get(products, F.lit(0)), F.lit(NO_MODEL))).otherwise(text(product))
    m = F.trim(F.regexp_replace(m, r"(?i)\s+(?:device\s+)?(?:firmware|software)$", ""))
    m = F.when((v != "") & F.startswith(F.lower(m), F.concat(F.lower(v), F.lit(" "))), F.trim(F.substr(m, F.length(v) + 1))).otherwise(m)
    words = F.filter(F.split(m, r"\s+"), lambda w: ~F.lower(w).isin(*PACKAGE_WORDS))
    m = F.when(by_cpe, F.array_join(F.transform(words, lambda w: F.when(w.rlike("[0-9]"), F.upper(w)).otherwise(title_case(w))), " ")).otherwise(m)
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1))
    theirs = F.array_except(tokens(F.array_join(products, " ")), F.array(*map(F.lit, PACKAGE_WORDS)))
    shared = F.size(F.array_intersect(theirs, tokens(F.concat_ws(" ", text(product), text(title), text(summary)))))
    aligned = (F.size(theirs) > 0) & (shared >= F.greatest(F.lit(1), F.floor(F.size(theirs) / 2)))
    versions = F.array_distinct(F.transform(named(5, 5), lambda x: F.regexp_replace(x, r"\\(.)", "$1")))
    return F.struct(
        F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", v, m)), r"\s+", " ")).alias("key"), F.trim(F.concat_ws(" ", v, m, F.lit(MODEL_SUFFIX))).alias("label"), F.when(v != "", v).otherwise(NO_VENDOR_LABEL).alias("vendor"), m.alias("model"),
        F.when(F.size(versions) > 0, F.array_join(versions, "、")).otherwise(NO_VERSION).alias("version_summary"), F.when(by_cpe, "cpe").otherwise("description").alias("source"),
        F.when(by_cpe, "cpe_fallback").when(aligned, "aligned").otherwise("description_primary").alias("alignment"),
    )


def url_selectors(url: Column) -> Column:
    """(name, value) pairs after the first ``?``: ``name=value``, or else ``name/value``; blank ones are none."""
    at = F.instr(url, "?")
    parts = F.when(at > 0, F.split(F.substr(url, at + 1), "&")).otherwise(F.array().cast("array<string>"))

    def pair(p: Column) -> Column:
        mark = F.when(F.contains(p, F.lit("=")), F.instr(p, "=")).otherwise(F.instr(p, "/"))
        return F.struct(F.substr(p, F.lit(1), mark - 1).alias("name"), F.substr(p, mark + 1).alias("value"), mark.alias("mark"))

    found = F.filter(F.transform(parts, pair), lambda x: (x["mark"] > 0) & (x["name"] != "") & (x["value"] != ""))
    return F.transform(found, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def plausible_object(path: Column, name: Column) -> Column:
    """An object is named like the plugin's file, or like it with ``-`` and more."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]+$", "")
    return (name == stem) | F.startswith(name, F.concat(stem, F.lit("-")))


def span_locator(start: Column, end: Column, start_line: Column | None = None, start_column: Column | None = None, end_line: Column | None = None, end_column: Column | None = None) -> Column:
    """Where a span stands: its bytes and, in text, its lines and columns."""
    if start_line is None:
        return F.format_string("binary:bytes=%d-%d", start, end)
    return F.format_string("text_utf8:bytes=%d-%d;lines=%d:%d-%d:%d", start, end, start_line, start_column, end_line, end_column)
