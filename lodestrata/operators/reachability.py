"""Whether requests in scripts are reached: call graphs from call sites, least proof paths, four states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.intervals import innermost
from lodestrata.operators.storage import settle

#: Constructs of call sites, and the kinds of roots that they make, first ones first.
FRAMEWORK, EVENT, DIRECT = "R.moduleView.initEvent", "javascript.event-registration", "javascript.direct-call"
ROOT_KINDS = ("framework_registered_callback", "event_registered_callback", "top_level_direct_call")
TOP_LEVEL = "top_level_declaration"


def call_graph(functions: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots (path, function_id, root, proof) and calls (path, caller, callee, proof) of scripts.

    functions: path, function_id, display_name (null for anonymous ones), body_start, body_end.
    sites: path, at, name, construct.  A name means a function only if its file defines it once.
    A site within a body is a call of the innermost function around it, one outside makes a root;
    a framework's registration always makes one.  ``root`` is the rank of the kind; proofs are
    (at, construct), of several the first.
    """
    named = functions.where("display_name is not null").groupBy("path", F.col("display_name").alias("name")).agg(F.count("*").alias("n"), F.min("function_id").alias("callee")).where("n = 1").drop("n")
    owners = functions.select("path", F.col("function_id").alias("caller"), "body_start", "body_end")
    known = innermost(sites.join(named, ["path", "name"]), owners, "path", "at", "body_start", "body_end")
    proof = F.struct("at", "construct")
    kind = F.when(F.col("construct") == FRAMEWORK, 0).when(F.col("caller").isNull(), F.when(F.col("construct") == EVENT, 1).otherwise(2))
    marked = settle(known.select("path", "at", "construct", "callee", "caller", kind.alias("root")))  # read for roots and for calls
    first = marked.where("root is not null").groupBy("path", F.col("callee").alias("function_id")).agg(F.min(F.struct("root", proof.alias("proof"))).alias("x")).select("path", "function_id", "x.root", "x.proof")
    calls = marked.where("root is null").groupBy("path", "caller", "callee").agg(F.min(proof).alias("proof"))
    return first, calls


def proof_paths(roots: DataFrame, calls: DataFrame) -> DataFrame:
    """path, function_id, distance, root, functions and proofs of every function that roots reach.

    The shortest path counts, of these the one of the first kind of root, then the first by its
    function ids.  Each round extends what the last one found and is written; rounds go on until
    nothing is new, however deep that is.
    """
    steps = settle(calls)
    front = settle(roots.select("path", "function_id", F.lit(0).alias("distance"), "root", F.array("function_id").alias("functions"), F.array("proof").alias("proofs")))
    found, distance = front, 0
    while True:
        distance += 1
        onward = front.withColumnRenamed("function_id", "caller").join(steps, ["path", "caller"])
        longer = onward.select("path", F.col("callee").alias("function_id"), F.struct("root", F.concat("functions", F.array("callee")).alias("functions"), F.concat("proofs", F.array("proof")).alias("proofs")).alias("x"))
        best = longer.groupBy("path", "function_id").agg(F.min("x").alias("x")).join(found.select("path", "function_id"), ["path", "function_id"], "left_anti")
        front = settle(best.select("path", "function_id", F.lit(distance).alias("distance"), "x.*"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def invocation_status(requests: DataFrame, functions: DataFrame, sites: DataFrame) -> DataFrame:
    """Each request (path, request_id, at) with its status, root_kind, owner, call_path and proofs.

    top_level_declaration: outside all bodies.  active_call_path: its function is reached.
    declared_but_unreached: it is not, and has a name that its file defines once.  unresolved:
    it has none, so that a call could not be told.
    """
    roots, calls = call_graph(functions, sites)
    reached = proof_paths(roots, calls)
    once = functions.where("display_name is not null").groupBy("path", "display_name").agg(F.count("*").alias("n")).where("n = 1").select("path", "display_name", F.lit(True).alias("once"))
    owners = functions.join(once, ["path", "display_name"], "left").select("path", "function_id", "display_name", "body_start", "body_end", "once")
    names = functions.select("path", F.col("function_id").alias("f"), F.col("display_name").alias("name"))
    spelled = reached.select("path", "function_id", F.posexplode("functions").alias("place", "f")).join(names, ["path", "f"]).where("name is not null")
    spelled = spelled.groupBy("path", "function_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("call_path"))
    owned = innermost(requests, owners, "path", "at", "body_start", "body_end")
    met = owned.join(reached.select("path", "function_id", "root", "proofs"), ["path", "function_id"], "left").join(spelled, ["path", "function_id"], "left")
    top, active = F.col("function_id").isNull(), F.col("root").isNotNull()
    status = F.when(top, TOP_LEVEL).when(active, "active_call_path").when(F.coalesce("once", F.lit(False)), "declared_but_unreached").otherwise("unresolved")
    kind = F.when(top, TOP_LEVEL).when(active, F.get(F.array(*map(F.lit, ROOT_KINDS)), F.col("root")))
    none = F.array().cast("array<string>")
    return met.select(*requests.columns, status.alias("status"), kind.alias("root_kind"), F.col("display_name").alias("owner"), F.coalesce("call_path", none).alias("call_path"), F.coalesce("proofs", F.array().cast(reached.schema["proofs"].dataType)).alias("proofs"))
