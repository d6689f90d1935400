"""Field-level merging of records from several sources, and histories of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestrata.functions.versions import meaningful_identity

#: Fixed value: the source whose texts win.
KEV_SOURCE = "cisa-kev"
#: How each field follows from a key's records in order of arrival.
LAST_MEANINGFUL = ("vendor", "product")
LAST = ("severity", "cvss_score", "cvss_vector", "cvss_version", "impact_score", "exploitability_score", "attack_vector", "attack_complexity", "privileges_required", "user_interaction", "scope", "kev_date_added", "kev_due_date", "ransomware_use", "required_action")
UNION = ("aliases", "cwes", "cpes", "references", "exploit_references")


def _rules(columns: list[str], order: str) -> dict[str, tuple[str, Column, Column]]:
    """The state of each rule over a key's records: how it is combined, its place, its value.

    A state is a struct of place and value, null where no record decides; ``min`` keeps the
    earliest place, ``max`` the latest.
    """
    have, o = set(columns), F.col(order)
    out: dict[str, tuple[str, Column, Column]] = {}
    for c in (c for c in ("title", "summary") if c in have):
        # a text stays open as long as the summary (or itself, without summaries) is empty
        open_text = F.coalesce(F.col("summary" if "summary" in have else c), F.lit("")) == ""
        out[f"{c}__kev"] = ("max", F.when(F.col("source") == KEV_SOURCE, o), F.col(c))
        out[f"{c}__first"] = ("min", F.when(~open_text, o), F.col(c))
        out[f"{c}__last"] = ("max", o, F.col(c))
    if "published_at" in have:
        out["published_at"] = ("min", F.when(F.coalesce("published_at", F.lit("")) != "", o), F.col("published_at"))
    if "modified_at" in have:
        out["modified_at"] = ("max", F.col("modified_at"), F.col("modified_at"))
    out |= {c: ("max", F.when(meaningful_identity(F.col(c)), o), F.col(c)) for c in LAST_MEANINGFUL if c in have}
    out |= {c: ("max", F.when(F.col(c).isNotNull(), o), F.col(c)) for c in LAST if c in have}
    if "kev" in have:
        out["kev"] = ("max", F.col("kev"), F.col("kev"))
    return out


def _united_lists(rows: DataFrame, by: list[str], lists: list[str]) -> DataFrame:
    """Lists of (place, at, value) as one list each of distinct values, in order of their first places.

    Each value is a row until it is known to be new, so only a key's distinct values meet.
    """
    value = lambda c: F.transform(F.coalesce(c, F.array().cast(rows.schema[c].dataType)), lambda x: F.struct(F.lit(c).alias("list"), x["place"].alias("place"), x["at"].alias("at"), x["value"].alias("value")))
    each = rows.select(*by, F.explode(F.concat(*map(value, lists))).alias("x")).select(*by, "x.*")
    firsts = each.groupBy(*by, "list", "value").agg(F.min(F.struct("place", "at")).alias("first")).select(*by, "list", F.struct("first.place", "first.at", "value").alias("x"))
    return firsts.groupBy(*by).agg(*(F.array_sort(F.collect_list(F.when(F.col("list") == c, F.col("x")))).alias(c) for c in lists))


def merge_states(records: DataFrame, order: str, key: str = "identifier") -> DataFrame:
    """The state of each key of ``records``, of which ``finished`` makes the merged record.

    Scalars are combined before the shuffle.  States of several sets of records are combined by
    ``combined_states``; a record in two of them counts once.
    """
    rules = _rules(records.columns, order)
    best = lambda how, place, value: (F.min if how == "min" else F.max)(F.when(place.isNotNull(), F.struct(place.alias("place"), value.alias("value"))))
    scalars = records.groupBy(key).agg(*(best(*rule).alias(c) for c, rule in rules.items()), F.array_sort(F.collect_set("source")).alias("sources"))
    lists = [c for c in UNION if c in records.columns]
    if not lists:
        return scalars
    placed = records.select(key, *(F.transform(c, lambda x, i: F.struct(F.col(order).alias("place"), i.alias("at"), x.alias("value"))).alias(c) for c in lists))
    return _with_lists(scalars, placed, [key], lists)


def _with_lists(scalars: DataFrame, placed: DataFrame, by: list[str], lists: list[str]) -> DataFrame:
    united = _united_lists(placed, by, lists)
    # the key may be null
    names = [f"__{c}" for c in by]
    other = united.select(*(F.col(c).alias(n) for c, n in zip(by, names)), *lists)
    same = [scalars[c].eqNullSafe(other[n]) for c, n in zip(by, names)]
    out = scalars.join(other, same, "left").drop(*names)
    return out.withColumns({c: F.coalesce(c, F.array().cast(united.schema[c].dataType)) for c in lists})


def combined_states(states: DataFrame, key: str = "identifier", *more: str) -> DataFrame:
    """One state of each key (and of ``more`` columns that follow from it)."""
    lists, by = [c for c in UNION if c in states.columns], [key, *more]
    least = lambda c: c.endswith("__first") or c == "published_at"
    scalars = [c for c in states.columns if c not in (*by, *lists, "sources")]
    out = states.groupBy(*by).agg(*((F.min if least(c) else F.max)(c).alias(c) for c in scalars), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"))
    return _with_lists(out, states.select(*by, *lists), by, lists) if lists else out


def finished(states: DataFrame, *more: str) -> DataFrame:
    """The merged records of states; columns of ``more`` pass through."""
    out = []
    for c in states.columns:
        if c in more:
            out.append(F.col(c))
        elif c.endswith("__kev"):
            name = c.removesuffix("__kev")
            out.append(F.coalesce(F.col(c)["value"], F.col(f"{name}__first")["value"], F.col(f"{name}__last")["value"]).alias(name))
        elif c.endswith(("__first", "__last")):
            continue
        elif c == "sources":
            out.append(F.array_join(c, ",").alias(c))
        elif c in UNION:
            out.append(F.transform(c, lambda x: x["value"]).alias(c))
        elif isinstance(states.schema[c].dataType, StructType):
            out.append(F.col(c)["value"].alias(c))
        else:
            out.append(F.col(c))
    return states.select(*out)


def merge_records(records: DataFrame, order: str, key: str = "identifier") -> DataFrame:
    """One record of each key, as if its records had been merged one by one in ``order``.

    Every rule is a fold that an aggregate expresses, so keys are combined before the shuffle
    and none gathers in one place: texts are the first record's until a KEV record comes, then
    the last KEV's; published is the first known, modified the greatest; vendor and product are
    the last meaningful, other scalars the last known; KEV sticks; lists are united in order of
    first occurrence, value by value.
    """
    return finished(merge_states(records, order, key))


def current_versions(versions: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """All versions, the first in ``order`` marked ``is_current``."""
    return versions.withColumn("is_current", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)


def to_compute(inputs: DataFrame, done: DataFrame, fingerprint: str) -> DataFrame:
    """Inputs whose (identifier, content, fingerprint) has no result yet."""
    keyed = inputs.withColumn("input_sha256", F.sha2(F.to_json(F.struct("identifier", "title", "summary")), 256)).withColumn("fingerprint", F.lit(fingerprint))
    return keyed.join(done.select("identifier", "input_sha256", "fingerprint"), ["identifier", "input_sha256", "fingerprint"], "left_anti")


def merge_observations(rules: DataFrame, model: DataFrame, key: list[str]) -> DataFrame:
    """Rule rows first, then model rows whose key (case apart) no rule row has."""
    both = rules.withColumn("rank", F.lit(0)).unionByName(model.withColumn("rank", F.lit(1)))
    w = Window.partitionBy(*(F.lower(F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in key)).orderBy("rank", *key)
    return both.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place", "rank")


def checked_union(batches: DataFrame, key: str) -> DataFrame:
    """Equal repeats become one row; repeats that differ raise an error."""
    content = F.to_json(F.struct(*sorted(batches.columns)))
    same = batches.withColumn("__content", content).dropDuplicates([key, "__content"])
    twice = same.groupBy(key).agg(F.count("*").alias("__n"))
    checked = same.join(twice, key).withColumn("__content", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("conflicting rows for "), F.col(key).cast("string")))).otherwise(F.col("__content")))
    return checked.where("__content is not null").select(*batches.columns)


def analysis_fingerprint(version: str, prompt: str, active: Column, base_url: Column, model: Column) -> Column:
    """What an analysis was made by: the analyser's version, and where a model took part its prompt, address and name."""
    by_model = F.concat(F.lit(f"{version}+{prompt}@"), F.rtrim(base_url, F.lit("/")), F.lit(":"), model)
    return F.when(F.coalesce(active, F.lit(False)), by_model).otherwise(version)


def bridge_replaced(bridge: DataFrame, records: DataFrame, column: str = "cwes", key: str = "identifier") -> DataFrame:
    """The bridge (key, value) in which each record's values replace those that it had; other keys stay."""
    value = [c for c in bridge.columns if c != key][0]
    kept = bridge.join(records.select(key).distinct(), key, "left_anti")
    return kept.unionByName(records.select(key, F.explode(column).alias(value)).distinct())


def records_rewritten(stored: DataFrame, merged: DataFrame, now: str, key: str = "identifier") -> DataFrame:
    """Merged records as they are stored: ``ingested_at`` of those known stays, ``updated_at`` is now."""
    known = stored.select(key, F.col("ingested_at").alias("__since"))
    return merged.join(known, key, "left").withColumns({"ingested_at": F.coalesce("__since", F.lit(now)), "updated_at": F.lit(now)}).drop("__since")
