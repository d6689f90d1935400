"""Symbols that files define for one another, resolved to a fixed point, and features that they gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.intervals import WIDTH, first_after
from lodestrata.operators.storage import settle, stable_id


def _parts(template: Column) -> Column:
    """Literals and {references} of a template, in order."""
    return F.regexp_extract_all(template, F.lit(r"\{\w+\}|[^{]+|\{"), F.lit(0))


def _reference(part: Column) -> Column:
    return F.nullif(F.regexp_extract(part, r"^\{(\w+)\}$", 1), F.lit(""))


def resolve_symbols(definitions: DataFrame) -> DataFrame:
    """symbol, path, value, status and round of every symbol of definitions (path, symbol, template).

    A template is text in which {name} stands for another symbol's value.  A symbol defined twice
    is ambiguous, or in conflict if the templates differ; one defined once is resolved when all
    that it names is.  A round handles only definitions that name a symbol that the last one
    resolved; what is left at the end is open: it names what is unknown, ambiguous or itself.
    """
    judged = definitions.groupBy("symbol").agg(F.count("*").alias("n"), F.countDistinct("template").alias("templates"), F.min("template").alias("template"), F.min("path").alias("path"))
    judged = settle(judged.withColumn("status", F.when(F.col("n") == 1, "open").when(F.col("templates") == 1, "ambiguous").otherwise("conflict")))
    parts = settle(judged.where("status = 'open'").select("symbol", F.posexplode_outer(_parts(F.col("template"))).alias("place", "part")).withColumn("uses", _reference(F.col("part"))))
    uses = parts.where("uses is not null").select("symbol", "uses")
    front = settle(parts.groupBy("symbol").agg(F.count("uses").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "").alias("value")).where("n = 0").select("symbol", "value", F.lit(0).alias("round")))
    known, n = front, 0
    while not front.isEmpty():
        n += 1
        again = uses.join(front.select(F.col("symbol").alias("uses")), "uses", "left_semi").select("symbol").distinct()
        mine = parts.join(again, "symbol", "left_semi").join(known.select(F.col("symbol").alias("uses"), F.col("value").alias("used")), "uses", "left")
        text = F.when(F.col("uses").isNull(), F.col("part")).otherwise(F.col("used"))
        whole = mine.groupBy("symbol").agg(F.bool_and(F.col("uses").isNull() | F.col("used").isNotNull()).alias("whole"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))), lambda x: x["text"]), "").alias("value"))
        front = settle(whole.where("whole").select("symbol", "value", F.lit(n).alias("round")))
        known = known.unionByName(front)
    met = judged.join(known, "symbol", "left")
    return met.select("symbol", "path", "value", F.when(F.col("round").isNotNull(), "resolved").otherwise(F.col("status")).alias("status"), "round")


def bind_consumers(consumers: DataFrame, symbols: DataFrame) -> DataFrame:
    """binding_id, symbol, value, definition_path and consumer_path: resolved symbols that other files use (path, symbol)."""
    good = symbols.where("status = 'resolved'").select("symbol", "value", F.col("path").alias("definition_path"))
    met = consumers.select(F.col("path").alias("consumer_path"), "symbol").distinct().join(good, "symbol").where("consumer_path <> definition_path")
    return met.select(stable_id("frontend-asset-binding", "consumer_path", "definition_path", "symbol", "value").alias("binding_id"), "symbol", "value", "definition_path", "consumer_path")


def stem(path: Column) -> Column:
    """The file's name without its folders and last suffix."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def feature_gates(macros: DataFrame, maps: DataFrame, reveals: DataFrame, routes: DataFrame, scripts: DataFrame, requests: DataFrame, within: int = WIDTH) -> DataFrame:
    """Features whose pages a build switches on or off: symbol, target, page, configured, enabled_value, status and requests.

    macros: path, symbol, value; only a symbol defined once counts.  maps: path, end, symbol,
    target, an entry of a modules map that ends at ``end``.  reveals: path, at, enabled_value, of
    which the first within ``within`` bytes after the map's end belongs to it.  routes: path,
    target, page.  scripts: page, script; only that of the page's own stem counts.  requests:
    path, request_id; a gate needs one at least.  A feature is enabled if its value is the
    revealed one.
    """
    once = macros.groupBy("symbol").agg(F.count("*").alias("n"), F.min("value").alias("configured")).where("n = 1").drop("n")
    shown = first_after(maps, reveals, "path", "end", "at", within).where("at is not null")
    paged = shown.join(once, "symbol").join(routes.groupBy("path", "target").agg(F.min("page").alias("page")), ["path", "target"])
    own = scripts.where(stem(F.col("page")) == stem(F.col("script"))).distinct()
    asked = requests.groupBy(F.col("path").alias("script")).agg(F.array_sort(F.collect_set("request_id")).alias("ids"))
    behind = own.join(asked, "script").groupBy("page").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("requests"))
    return paged.join(behind, "page").select("path", "symbol", "target", "page", "configured", "enabled_value", F.when(F.col("configured") == F.col("enabled_value"), "enabled").otherwise("disabled").alias("status"), "requests").distinct()
