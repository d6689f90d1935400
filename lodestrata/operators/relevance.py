"""Explainable firmware relevance: additive signals, clamped and banded."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.versions import unquoted

#: Terms of firmware, devices, vendors to watch, vendors of firmware only, other contexts.
FIRMWARE_TERMS = ("firmware", "embedded firmware", "firmware update", "bootloader", "u-boot", "uefi", "bios", "baseboard management controller", "bmc firmware", "flash memory", "system image", "device software", "embedded software", "secure boot", "trusted execution environment")
DEVICE_TERMS = (
    "router", "gateway", "network camera", "ip camera", "nas device", "network attached storage", "access point", "modem", "network switch", "printer", "iot device", "embedded device", "industrial control system", "programmable logic controller", "smart device", "firewall",
    "vpn appliance", "dvr", "nvr", "video recorder", "ip phone", "voip phone", "cable modem", "ont", "optical network terminal", "wireless controller", "storage appliance", "management controller", "medical device", "vehicle ecu", "smart tv", "set-top box",
)
WATCHED_VENDORS = ("cisco", "huawei", "siemens", "schneider electric", "rockwell automation", "abb", "honeywell", "dell", "hewlett packard enterprise", "lenovo", "supermicro", "canon", "brother", "xerox")
FIRMWARE_VENDORS = (
    "tp-link", "d-link", "netgear", "hikvision", "dahua", "ubiquiti", "openwrt", "qnap", "synology", "tenda", "mikrotik", "zyxel", "draytek", "ruijie", "mercusys", "totolink", "linksys", "belkin", "buffalo", "asus", "foscam", "reolink", "uniview", "axis communications", "hanwha",
    "asustor", "western digital", "moxa", "advantech", "phoenix contact", "omron", "mitsubishi electric", "american megatrends", "insyde",
)
OTHER_CONTEXTS = ("cloud service", "software as a service", "saas platform", "desktop application", "mobile application")
#: Weights of the signals.
WEIGHTS = {"firmware-term": 55, "device-term": 25, "firmware-vendor": 55, "watched-vendor": 25, "hardware-cpe": 30, "firmware-target-cpe": 65, "firmware-reference": 10, "non-firmware-context": -25}

#: What a signal says about its term.
REASONS = {
    "firmware-term": "the text names", "device-term": "the text speaks of a device:", "firmware-vendor": "a vendor of firmware only:", "watched-vendor": "a watched vendor, to be confirmed by a device or firmware:", "hardware-cpe": "the affected configuration holds hardware:",
    "firmware-target-cpe": "the target software is firmware:", "firmware-reference": "a reference leads to", "non-firmware-context": "the text is mainly about",
}


@dataclass(frozen=True)
class Policy:
    firmware: tuple[str, ...] = FIRMWARE_TERMS
    devices: tuple[str, ...] = DEVICE_TERMS
    watched: tuple[str, ...] = WATCHED_VENDORS
    vendors: tuple[str, ...] = FIRMWARE_VENDORS
    strong: int = 70
    likely: int = 50
    review: int = 35

    def __post_init__(self) -> None:
        if not 0 <= self.review <= self.likely <= self.strong <= 100:
            raise ValueError("thresholds must rise from review to strong within 0..100")
        if any(len(g) > 100 for g in (self.firmware, self.devices, self.watched, self.vendors)):
            raise ValueError("a group holds 100 terms at most")

    def updated(self, value: Mapping[str, object]) -> Policy:
        """This policy with the fields that a partial one gives."""
        return Policy.from_dict({f.name: getattr(self, f.name) for f in fields(self)} | dict(value))

    @classmethod
    def from_dict(cls, value: Mapping[str, object]) -> Policy:
        """Known fields only; terms are trimmed and empty ones left out."""
        kinds = {f.name: f.type for f in fields(cls)}
        terms = lambda v: tuple(t for t in (str(x).strip() for x in v) if t)
        return cls(**{k: terms(v) if "tuple" in kinds[k] else v for k, v in value.items() if k in kinds})


def normalized(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.replace(unquoted(value), F.lit("_"), F.lit(" "))), r"\s+", " "))


def normalized_term(term: str) -> str:
    """A term as texts are normalised."""
    return re.sub(r"\s+", " ", unquote(term).replace("_", " ").lower()).strip()


def _pattern(terms: Iterable[str]) -> str:
    return rf"(?U)(?<!\w)(?:{'|'.join(map(re.escape, terms))})(?!\w)"


def first_term(text: Column, terms: tuple[str, ...]) -> Column:
    """The first of ``terms`` that stands in a normalised text as whole words, as it is given; null if none does.

    One pattern of all tells whether any does; only then they are tried one by one.
    """
    known = {t: n for t in terms if (n := normalized_term(t))}
    if not known:
        return F.lit(None).cast("string")
    each = F.coalesce(*(F.when(text.contains(n) & text.rlike(_pattern([n])), F.lit(t)) for t, n in known.items()))
    return F.when(text.rlike(_pattern(dict.fromkeys(known.values()))), each)


def classify(records: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Add signals (array of name, weight, term and reason), relevance_score and relevance_level.

    ``term`` is the policy's term, or the CPE, that the signal rests on.  Needs title, summary,
    vendor, product, cpes and references.
    """
    text = normalized(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("title", "summary", "vendor", "product"))))
    names = normalized(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("vendor", "product", "title"))))
    out = records.withColumns({"__text": text, "__names": names, "__links": F.lower(F.array_join("references", " "))})
    parts = lambda c: F.split(F.lower(c), ":")
    hardware = F.filter("cpes", lambda c: ((F.size(parts(c)) >= 4) & (F.get(parts(c), F.lit(2)) == "h")) | (F.regexp_replace(F.coalesce(F.get(parts(c), F.lit(1)), F.lit("")), "^/+", "") == "h"))
    target = F.filter("cpes", lambda c: F.coalesce(F.get(parts(c), F.lit(10)).isin("firmware", "embedded"), F.lit(False)))
    found = {
        "firmware-term": first_term(F.col("__text"), policy.firmware), "device-term": first_term(F.col("__text"), policy.devices), "firmware-vendor": first_term(F.col("__names"), policy.vendors), "watched-vendor": first_term(F.col("__names"), policy.watched),
        "hardware-cpe": F.get(hardware, F.lit(0)), "firmware-target-cpe": F.get(target, F.lit(0)), "firmware-reference": first_term(F.col("__links"), ("firmware", "download")), "non-firmware-context": first_term(F.col("__text"), OTHER_CONTEXTS),
    }
    out = out.withColumns({f"__{n}": c for n, c in found.items()})
    # one row for one: a filter on what follows, also one that Spark infers, stops here and does not search the texts again
    out = out.select(*records.columns, F.explode(F.array(F.struct(*(F.col(f"`__{n}`").alias(n) for n in found)))).alias("__terms"))
    term = lambda n: F.col("__terms")[n]
    signal = lambda n: F.struct(F.lit(n).alias("name"), F.lit(WEIGHTS[n]).alias("weight"), term(n).alias("term"), F.concat(F.lit(f"{REASONS[n]} "), term(n)).alias("reason"))
    holds = {n: term(n).isNotNull() for n in found if n != "non-firmware-context"}
    holds["watched-vendor"] = holds["watched-vendor"] & term("firmware-vendor").isNull()
    out = out.withColumn("__found", F.array_compact(F.array(*(F.when(c, signal(n)) for n, c in holds.items()))))
    other = term("non-firmware-context").isNotNull() & ~F.exists("__found", lambda s: s["weight"] >= 55)
    out = out.withColumn("signals", F.when(other, F.array_append("__found", signal("non-firmware-context"))).otherwise(F.col("__found")))
    total = F.aggregate("signals", F.lit(0), lambda s, x: s + x["weight"])
    out = out.withColumn("relevance_score", F.greatest(F.lit(0), F.least(F.lit(100), total)))
    s = F.col("relevance_score")
    level = F.when(s >= policy.strong, "strong").when(s >= policy.likely, "likely").when(s >= policy.review, "review").otherwise("unrelated")
    return out.withColumn("relevance_level", level).drop("__terms", "__found")


def policy_issues(policies: DataFrame, key: str) -> DataFrame:
    """``key`` and rule of what speaks against policies (thresholds strong, likely, review; terms as arrays)."""
    ordered = (F.col("review") >= 0) & (F.col("review") <= F.col("likely")) & (F.col("likely") <= F.col("strong")) & (F.col("strong") <= 100)
    large = [F.when(F.size(c) > 100, F.lit(f"{c}_too_many")) for c in ("firmware", "devices", "watched", "vendors") if c in policies.columns]
    return policies.select(key, F.explode(F.array_compact(F.array(F.when(~F.coalesce(ordered, F.lit(False)), "thresholds_unordered"), *large))).alias("rule"))
