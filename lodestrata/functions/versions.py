"""Version, CPE and product-name algebra as column expressions.

A version's key is an array of structs (kind, number, text): digits before letters, shorter
prefixes first.  Such arrays compare as the versions do, so ranges need no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that stand for no version, and for no vendor or product.
NO_VERSION = ("", "*", "-", "n/a", "na", "none", "null", "unknown", "unspecified")
NO_IDENTITY = ("", "*", "-", "n/a", "na", "not applicable", "unknown", "unspecified")
#: Archive suffixes of file names.
ARCHIVES = "zip|bin|img|trx|chk|tar|gz|rar|exe"
#: Patterns of versions in file names, with dots and with a tag before a number.
DOTTED_VERSION = r"(?i)(?<![a-z0-9])([a-z]?\d+(?:[._-]\d+){1,6}(?:[a-z]+\d*)?)"
TAGGED_VERSION = r"(?i)(?:^|[_-])(?:fw|firmware|ver|version|bios|v)[_-]?(\d{3,8}[a-z]?)(?=[_.-]|$)"
#: Words that say nothing about a product.
NOISE = "firmware|software|router|gateway|device|series|version"
#: Vendor names that mean another.
VENDOR_ALIASES = {"netgearinc": "netgear", "axiscommunications": "axis", "hewlettpackardenterprise": "hpe"}
BOUNDS = ("version_start_including", "version_start_excluding", "version_end_including", "version_end_excluding")


def unquoted(value: Column) -> Column:
    """Percent escapes decoded, plus signs kept; text that does not decode stays as it is."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.instr(text, "%") == 0, text).otherwise(F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text))


def normalize_version(value: Column) -> Column:
    v = F.lower(F.trim(F.replace(unquoted(value), F.lit("\\"), F.lit(""))))
    v = F.regexp_replace(v, rf"\.(?:{ARCHIVES})$", "")
    v = F.regexp_replace(v, r"^(?:firmware|version|ver)[-_ ]*", "")
    v = F.regexp_replace(v, r"^v(?=[0-9])", "")
    return F.regexp_replace(v, r"^[ _-]+|[ _-]+$", "")


def meaningful_version(value: Column) -> Column:
    return ~normalize_version(value).isin(*NO_VERSION)


def version_key_of(normalized: Column) -> Column:
    tokens = F.regexp_extract_all(normalized, F.lit("([0-9]+|[a-z]+)"), 1)

    def token(t: Column) -> Column:
        digits = t.rlike("^[0-9]+$")
        return F.struct(
            F.when(digits, 0).otherwise(1).alias("kind"), F.when(digits, t.cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("number"), F.when(digits, "").otherwise(t).alias("word")
        )

    return F.transform(tokens, token)


def version_key(value: Column) -> Column:
    return version_key_of(normalize_version(value))


def _runs(normalized: Column) -> Column:
    return F.size(F.regexp_extract_all(normalized, F.lit("([0-9]+)"), 1))


def comparable(left: Column, right: Column) -> Column:
    """Of normalised versions: equal letter prefix, both one number or both several."""
    prefix = lambda v: F.regexp_extract(v, "^([a-z]+)(?=[0-9])", 1)
    a, b = _runs(left), _runs(right)
    return (prefix(left) == prefix(right)) & ((a == 1) == (b == 1)) & (a > 0) & (b > 0)


def same_version(left: Column, right: Column) -> Column:
    """Of normalised versions: equal keys that are not empty."""
    a, b = version_key_of(left), version_key_of(right)
    return (F.size(a) > 0) & (a == b)


def in_range(version: Column, *bounds: Column) -> Column:
    """Of normalised values: every present bound (start in, start ex, end in, end ex) is comparable and holds."""
    key = version_key_of(version)
    tests = (lambda k, b: k >= b, lambda k, b: k > b, lambda k, b: k <= b, lambda k, b: k < b)

    def holds(bound: Column, test) -> Column:
        absent = bound.isNull() | (bound == "")
        return absent | (comparable(version, bound) & test(key, version_key_of(bound)))

    return reduce(lambda p, q: p & q, (holds(b, t) for b, t in zip(bounds, tests)), F.size(key) > 0)


def constraint_text(version: Column, start_in: Column, start_ex: Column, end_in: Column, end_ex: Column) -> Column:
    """The claim as an interval, as its one version, or as all versions."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    left = F.when(some(start_in), "[").otherwise("(")
    right = F.when(some(end_in), "]").otherwise(")")
    low = F.coalesce(F.nullif(start_in, F.lit("")), F.nullif(start_ex, F.lit("")), F.lit("-∞"))
    high = F.coalesce(F.nullif(end_in, F.lit("")), F.nullif(end_ex, F.lit("")), F.lit("+∞"))
    bounded = some(start_in) | some(start_ex) | some(end_in) | some(end_ex)
    return F.when(bounded, F.concat(left, low, F.lit(", "), high, right)).when(meaningful_version(version), version).otherwise("all versions")


def identity(value: Column) -> Column:
    """Letters and digits of a product name without words that say nothing."""
    v = F.replace(F.replace(unquoted(value), F.lit("\\"), F.lit(" ")), F.lit("_"), F.lit(" "))
    return F.regexp_replace(F.lower(F.regexp_replace(v, rf"(?i)\b(?:{NOISE})\b", " ")), "[^a-z0-9]", "")


def vendor_identity(value: Column) -> Column:
    name = identity(value)
    out = name
    for alias, vendor in VENDOR_ALIASES.items():
        out = F.when(name == alias, vendor).otherwise(out)
    return out


def cpe_part(criteria: Column, part: str) -> Column:
    """Vendor, product or version of a CPE 2.3 or 2.2 name; null where it is neither."""
    parts = F.split(F.coalesce(criteria, F.lit("")), ":")
    at = {"vendor": 3, "product": 4, "version": 5}[part]
    modern = (F.size(parts) >= 6) & (F.get(parts, F.lit(0)) == "cpe") & (F.get(parts, F.lit(1)) == "2.3")
    older = F.startswith(F.coalesce(criteria, F.lit("")), F.lit("cpe:/")) & (F.size(parts) >= 5)
    return F.when(modern, F.get(parts, F.lit(at))).when(older, F.get(parts, F.lit(at - 1)))


def meaningful_identity(value: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(value, F.lit("")))).isin(*NO_IDENTITY)


def with_candidate_versions(df: DataFrame, filename: Column, declared: Column, into: str = "identities") -> DataFrame:
    """Add ordered version identities (raw, normalized, source, confidence), distinct by key.

    The declared version first, then dotted versions of the file name, then tagged numbers.
    Each step is a column of its own, so that no expression is repeated inside the next one.
    """
    stated = F.trim(F.coalesce(declared, F.lit("")))
    found = lambda pattern: F.regexp_extract_all(F.col("__name"), F.lit(pattern), 1)
    raw = lambda source, confidence: lambda r: F.struct(r.alias("raw"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))
    own = F.when(meaningful_version(F.col("__stated")) & ~F.col("__stated").rlike(rf"(?i)\.(?:{ARCHIVES})$"), F.array("__stated")).otherwise(F.array().cast("array<string>"))
    out = df.withColumn("__stated", stated).withColumn("__name", F.coalesce(F.nullif(filename, F.lit("")), stated))
    out = out.withColumn("__raws", F.concat(F.transform(own, raw("declared", "high")), F.transform(found(DOTTED_VERSION), raw("filename", "medium")), F.transform(found(TAGGED_VERSION), raw("filename", "low"))))
    out = out.withColumn("__all", F.transform("__raws", lambda x: F.struct(x["raw"].alias("raw"), normalize_version(x["raw"]).alias("normalized"), x["source"].alias("source"), x["confidence"].alias("confidence"))))
    tokens = lambda v: F.array_join(F.transform(F.regexp_extract_all(v, F.lit("([0-9]+|[a-z]+)"), 1), lambda t: F.regexp_replace(t, "^0+(?=[0-9])", "")), ".")
    out = out.withColumn("__kept", F.filter("__all", lambda x: ~x["normalized"].isin(*NO_VERSION) & x["normalized"].rlike("[0-9a-z]"))).withColumn("__keys", F.transform("__kept", lambda x: tokens(x["normalized"])))
    first = F.filter("__kept", lambda x, i: F.array_position("__keys", F.get("__keys", i)) == i + 1)
    return out.withColumn(into, first).drop("__stated", "__name", "__raws", "__all", "__kept", "__keys")
