"""Correlating what frontends call with what native code registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.interfaces import endpoint_component, glob_pattern
from lodestrata.operators.storage import settle


#: Pairs that one slice of a value's candidates may give, and pairs for each part of the join.
SLICE_PAIRS, PART_PAIRS = 1_000_000, 4_000_000


def _sides(frontend: DataFrame, hints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What exact literals ask for (candidate_id, kind, value) and what hints give (hint_id, kind, value), each once."""
    exact = frontend.where("endpoint_shape = 'exact_literal'")
    endpoint = exact.select("candidate_id", F.lit("endpoint_literal").alias("kind"), F.col("endpoint").alias("value"))
    route = exact.select("candidate_id", F.lit("route_token").alias("kind"), endpoint_component(F.col("endpoint")).alias("value")).where("value <> ''")
    return endpoint.unionByName(route).distinct(), hints.where("kind in ('endpoint_literal', 'route_token')").select("hint_id", "kind", "value").distinct()


def _basis(pairs: DataFrame) -> DataFrame:
    return pairs.select("candidate_id", "hint_id", F.when(F.col("kind") == "route_token", "route_token").otherwise("exact_endpoint").alias("match_basis"))


def _pairs(asked: DataFrame, given: DataFrame) -> DataFrame:
    """Every association, once.

    They can be the product of the candidates and the hints of few values.  So a value's candidates
    are dealt to slices of ``SLICE_PAIRS`` pairs, each of which meets all of its hints, and the
    slices to parts by the number of all pairs.  Only a candidate and a hint that both have
    several values of a kind can meet twice; no others are compared.
    """
    key = ["kind", "value"]
    sizes = asked.groupBy(*key).agg(F.count("*").alias("n")).join(given.groupBy(*key).agg(F.count("*").alias("m")), key)
    sizes = settle(sizes.select(*key, F.greatest(F.ceil(F.col("n") * F.col("m") / SLICE_PAIRS), F.lit(1)).cast("int").alias("slices"), (F.col("n") * F.col("m")).alias("pairs")))
    parts = max(1, min(10_000, (sizes.agg(F.sum("pairs")).first()[0] or 0) // PART_PAIRS + 1))
    several = lambda df, i: df.join(df.groupBy(i, "kind").agg((F.count("*") > 1).alias("several")), [i, "kind"])
    spread = sizes.select(*key, "slices")
    left = several(asked, "candidate_id").join(spread, key).withColumn("slice", F.pmod(F.xxhash64("candidate_id"), F.col("slices")).cast("int")).drop("slices").repartition(parts, *key, "slice")
    right = several(given, "hint_id").withColumnRenamed("several", "too").join(spread, key).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices").repartition(parts, *key, "slice")
    met = left.join(right.hint("shuffle_hash"), [*key, "slice"])
    twice = F.col("several") & F.col("too")
    return _basis(met.where(~twice)).unionByName(_basis(met.where(twice)).distinct())


def correlate(frontend: DataFrame, hints: DataFrame, budget: int | None = None) -> DataFrame:
    """Exact, case-sensitive associations (candidate_id, hint_id, match_basis).

    An exact literal endpoint equals an endpoint literal, or its last path component a route
    token.  With a budget the first associations in id order stay, and ``status`` says partial.
    """
    asked, given = _sides(frontend, hints)
    if budget is None:
        return _pairs(asked, given).withColumn("status", F.lit("completed"))
    # each of the first candidates that meet a hint has a pair, and of a value's hints no more than the first can be kept
    first = asked.join(given.select("kind", "value").distinct(), ["kind", "value"], "left_semi").select("candidate_id").distinct().orderBy("candidate_id").limit(budget + 1)
    few = settle(asked.join(first, "candidate_id", "left_semi"))
    near = given.join(few.select("kind", "value").distinct(), ["kind", "value"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("kind", "value").orderBy("hint_id"))).where(F.col("n") <= budget + 1)
    found = _basis(few.join(near, ["kind", "value"])).distinct()
    order = Window.orderBy("candidate_id", "hint_id", "match_basis")
    kept = found.orderBy("candidate_id", "hint_id", "match_basis").limit(budget + 1).withColumn("place", F.row_number().over(order))
    return kept.withColumn("status", F.when(F.max("place").over(Window.partitionBy()) > budget, "partial").otherwise("completed")).where(F.col("place") <= budget).drop("place")


def unmatched(frontend: DataFrame, associations: DataFrame) -> DataFrame:
    return frontend.join(associations, "candidate_id", "left_anti")


def uncorrelated(frontend: DataFrame, hints: DataFrame) -> DataFrame:
    """``frontend`` without the candidates that ``correlate`` associates with any hint; no pair is made."""
    asked, given = _sides(frontend, hints)
    return unmatched(frontend, asked.join(given.select("kind", "value").distinct(), ["kind", "value"], "left_semi").select("candidate_id").distinct())


def association_obligations(associations: DataFrame) -> DataFrame:
    """What each association still has to prove: its route's registration, then its handler."""
    needs = F.array(F.struct(F.lit(90).alias("priority"), F.lit("registers_route").alias("required_capability")), F.struct(F.lit(80).alias("priority"), F.lit("binds_handler").alias("required_capability")))
    return associations.select(F.concat_ws("|", "candidate_id", "hint_id").alias("target_ref"), F.explode(needs).alias("need")).select("target_ref", "need.*")


def set_difference(tokens: DataFrame) -> DataFrame:
    """Tokens of one side only: (side, token, places)."""
    distinct = tokens.groupBy("side", "token").agg(F.countDistinct("path").alias("places"))
    other = distinct.select("token", F.when(F.col("side") == "frontend", "native").otherwise("frontend").alias("side"))
    return distinct.join(other, ["side", "token"], "left_anti")


def classify_difference(side: Column, web_hits: Column, native_hits: Column, variant_hits: Column, direct: Column) -> Column:
    """The attribution of a one-sided token from where else it occurs."""
    front = F.when(native_hits > 0, "alternate_native_literal").when(web_hits > 0, "frontend_consumer_native_absent").when(direct, "frontend_operation_native_absent").otherwise("frontend_declaration_native_absent")
    back = F.when(web_hits > 0, "frontend_scope_gap").when(native_hits > 0, "cross_native_literal").when(variant_hits > 0, "cross_native_token_variant").otherwise("native_registration_no_frontend_reference")
    return F.when(side == "frontend", front).otherwise(back)


def _identifiers(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, __word, __n): how often each identifier stands in a key's texts, counted before anything meets by word."""
    words = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit("([A-Za-z0-9_]+)"), 1)).alias("__word"))
    return words.groupBy(key, "__word").agg(F.count("*").alias("__n"))


def token_hits(tokens: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, hits): identifier-bounded occurrences of tokens in texts.

    Texts are cut into identifiers once and joined by equality; no token meets a text that does
    not hold it, and a frequent one meets each key once.
    """
    words = _identifiers(texts, key, text)
    return words.withColumnRenamed("__word", "token").join(tokens.select("token").distinct(), "token").select("token", key, F.col("__n").alias("hits"))


def suffix_hits(tokens: DataFrame, texts: DataFrame, key: str, text: str, least: int = 2, most: int = 24) -> DataFrame:
    """(token, key, hits): identifiers that end in a token after ``least`` to ``most`` more characters.

    Each identifier is cut to its suffixes of those lengths, so the join is by equality here too.
    """
    long = F.length("__word")
    words = _identifiers(texts, key, text).where(long > least)
    fits = words.withColumn("size", F.explode(F.sequence(F.greatest(long - most, F.lit(1)), long - least))).select(key, "__n", F.expr("right(__word, size)").alias("token"))
    return fits.join(tokens.select("token").distinct(), "token").groupBy("token", key).agg(F.sum("__n").alias("hits"))


def parameter_clues(parameters: DataFrame, artifacts: DataFrame, budget: int = 8) -> DataFrame:
    """First artifacts (in path order, at most ``budget``) in which each parameter's name stands."""
    hits = token_hits(parameters.select(F.col("name").alias("token")), artifacts, "path", "content")
    place = Window.partitionBy("token").orderBy("path")
    return hits.withColumn("place", F.row_number().over(place)).where(F.col("place") <= budget).select(F.col("token").alias("name"), "path", "hits", "place")


def bus_operations(candidates: DataFrame) -> DataFrame:
    """operation_ref, object_name, method_name and evidence_ids of candidates that call the bus (endpoint ``ubus://object/method``).

    Equal repeats are one; a candidate that comes with two contents is an error.
    """
    rest = F.regexp_extract("endpoint", r"(?s)^ubus://(.*)$", 1)
    at = F.instr(rest, "/")
    parts = candidates.select(F.col("candidate_id").alias("operation_ref"), F.substr(rest, F.lit(1), at - 1).alias("object_name"), F.substr(rest, at + 1).alias("method_name"), "evidence_ids", at.alias("at"))
    found = parts.where("at > 0 and object_name <> '' and method_name <> ''").drop("at").distinct()
    twice = found.groupBy("operation_ref").agg(F.count("*").alias("n"))
    checked = found.join(twice, "operation_ref").withColumn("object_name", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("conflicting operation "), "operation_ref"))).otherwise(F.col("object_name")))
    return checked.drop("n")


#: Characters of a pattern's literal text by which it meets objects, and parts of the objects that patterns without any meet.
GRAM, SALTS = 3, 64


def acl_grants(operations: DataFrame, acl: DataFrame) -> DataFrame:
    """(acl_group, operation_ref): the object fits the group's glob and the method is listed or ``*``.

    Patterns without wildcards are an equi-join.  The others meet the distinct objects by the
    first characters of their longest literal piece, wherever that stands in an object, and are
    matched then.  Patterns of wildcards only fit every object that is long enough: they go to
    all parts of the objects, so no task gets them all.
    """
    ops = operations.withColumn("object_name", F.replace("object_name", F.lit("{dynamic}"), F.lit("dynamic-instance")))
    wild = F.col("object_pattern").rlike(r"[*?]")
    exact = acl.where(~wild).withColumn("object_name", F.col("object_pattern"))
    pieces = F.array_sort(F.transform(F.split("object_pattern", r"[*?]+"), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("text"))))
    globs = acl.where(wild).select("acl_group", "method", "object_pattern", F.left(F.get(pieces, F.lit(0))["text"], F.lit(GRAM)).alias("gram"), glob_pattern(F.col("object_pattern")).alias("pattern"))
    objects = ops.select("object_name").distinct()
    n = F.length("object_name")
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.greatest(n - i + 1, F.lit(1)))), lambda k: F.substr("object_name", i, k)))))
    matched = objects.select("object_name", F.explode(grams).alias("gram")).join(globs.where("gram <> ''"), "gram").where("object_name rlike pattern").select("acl_group", "object_name", "method")
    free = globs.where("gram = ''").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    any_of = objects.withColumn("salt", F.pmod(F.xxhash64("object_name"), F.lit(SALTS)).cast("int")).join(free, "salt").where("object_name rlike pattern").select("acl_group", "object_name", "method")
    grants = exact.select("acl_group", "object_name", "method").unionByName(matched).unionByName(any_of)
    return ops.join(grants, "object_name").where((F.col("method") == "*") | (F.col("method") == F.col("method_name"))).select("acl_group", "operation_ref").distinct()


def bind_operations(operations: DataFrame, plugins: DataFrame, natives: DataFrame) -> DataFrame:
    """Best binding of each operation: verified natives, then static plugin methods; else open."""
    key = ["object_name", "method_name"]
    proofs = natives.select(*key, F.lit(2).alias("rank"), F.lit("verified").alias("status"), "path").unionByName(plugins.select(*key, F.lit(1).alias("rank"), F.lit("static").alias("status"), "path"))
    best = proofs.groupBy(*key).agg(F.max_by(F.struct("status", "path"), F.struct("rank", "path")).alias("best"))
    return operations.join(best, key, "left").select(*operations.columns, F.coalesce("best.status", F.lit("open")).alias("binding_status"), F.col("best.path").alias("binding_path"))
