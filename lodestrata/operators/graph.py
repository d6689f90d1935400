"""Typed graph queries: narrowing, traversal by rounds, budgets and facets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.interfaces import search_text
from lodestrata.operators.storage import settle

FORWARD_ONLY = "calls"


@dataclass(frozen=True)
class GraphQuery:
    focus: tuple[str, ...] = ()
    text: str = ""
    node_kinds: tuple[str, ...] = ()
    edge_kinds: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    max_hops: int = 1
    #: Budgets; None for none.
    max_nodes: int | None = 1000
    max_edges: int | None = 2000

    def __post_init__(self) -> None:
        if self.max_hops < 0 or any(n is not None and n < 1 for n in (self.max_nodes, self.max_edges)):
            raise ValueError("hops must not be negative and budgets must be positive")
        for group in (self.focus, self.node_kinds, self.edge_kinds, self.statuses):
            if len(set(group)) != len(group):
                raise ValueError("filters must be unique")


def narrow(nodes: DataFrame, edges: DataFrame, query: GraphQuery) -> tuple[DataFrame, DataFrame]:
    """Allowed nodes, and allowed edges between them."""
    if query.node_kinds:
        nodes = nodes.where(F.col("node_kind").isin(*query.node_kinds))
    if query.statuses:
        nodes = nodes.where(F.col("status").isin(*query.statuses))
    if query.edge_kinds:
        edges = edges.where(F.col("edge_kind").isin(*query.edge_kinds))
    ids = nodes.select("node_id")
    edges = edges.join(ids.withColumnRenamed("node_id", "source_ref"), "source_ref", "left_semi").join(ids.withColumnRenamed("node_id", "target_ref"), "target_ref", "left_semi")
    return nodes, edges


def arcs(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Steps that a traversal may take: both ways, but ``calls`` forward only if ``directed``."""
    forward = edges.select(F.col("source_ref").alias("at"), F.col("target_ref").alias("to"))
    back = edges.where(F.col("edge_kind") != FORWARD_ONLY) if directed else edges
    return forward.unionByName(back.select(F.col("target_ref").alias("at"), F.col("source_ref").alias("to"))).distinct()


def reach(seeds: DataFrame, edges: DataFrame, hops: int, directed: bool = True) -> DataFrame:
    """(node_id, distance) of what the seeds reach within ``hops`` steps.

    Semi-naive: each round joins only the frontier and is written to the shared folder, so the
    plan stays short and a lost executor costs one round.
    """
    steps = settle(arcs(edges, directed)) if hops else None
    seen = settle(seeds.select("node_id").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for hop in range(1, hops + 1):
        found = frontier.select(F.col("node_id").alias("at")).join(steps, "at").select(F.col("to").alias("node_id")).distinct()
        frontier = settle(found.join(seen, "node_id", "left_anti").withColumn("distance", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def query_graph(nodes: DataFrame, edges: DataFrame, query: GraphQuery) -> tuple[DataFrame, DataFrame]:
    """Selected nodes (with distance) and edges, under the query's budgets.

    Text narrows the focus, or stands for it where there is none.  Nodes stay in order of
    (distance, node_id), then edges among them in order of edge_id; ``status`` says whether a
    budget cut any off.  Without a budget all stay, in no order, and no task gets them all.
    """
    nodes, edges = narrow(nodes, edges, query)
    seeds = nodes.where(F.col("node_id").isin(*query.focus)) if query.focus else None
    if query.text:
        texts = search_text(F.concat_ws(" ", "label", "status", "node_kind"))
        matches = nodes
        for token in query.text.lower().split():
            matches = matches.where(texts.contains(token))
        # a focus that is not in the graph leaves its place to the text
        if seeds is None or seeds.isEmpty():
            seeds = matches
        else:
            seeds = seeds.join(matches.select("node_id"), "node_id", "left_semi")
    chosen = nodes.select("node_id").withColumn("distance", F.lit(0)) if seeds is None else reach(seeds, edges, query.max_hops if query.focus else 0)
    met = nodes.join(chosen, "node_id")
    if query.max_nodes is None:
        kept = settle(met.withColumn("status_of_query", F.lit("completed")))
    else:
        place = Window.orderBy("distance", "node_id")  # over max_nodes + 1 rows at most
        top = met.orderBy("distance", "node_id").limit(query.max_nodes + 1).withColumn("place", F.row_number().over(place))
        top = top.withColumn("status_of_query", F.when(F.max("place").over(Window.partitionBy()) > query.max_nodes, "partial").otherwise("completed"))
        kept = settle(top.where(F.col("place") <= query.max_nodes).drop("place"))
    ids = kept.select("node_id")
    among = edges.join(ids.withColumnRenamed("node_id", "source_ref"), "source_ref", "left_semi").join(ids.withColumnRenamed("node_id", "target_ref"), "target_ref", "left_semi")
    return kept, among if query.max_edges is None else among.orderBy("edge_id").limit(query.max_edges)


def facets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(facet, value, n): node kinds, edge kinds and statuses."""
    count = lambda df, facet, column: df.groupBy(F.lit(facet).alias("facet"), F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return count(nodes, "node_kind", "node_kind").unionByName(count(edges, "edge_kind", "edge_kind")).unionByName(count(nodes, "status", "status"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node; a publishable graph has none."""
    ids = nodes.select("node_id")
    lost = lambda end: edges.join(ids.withColumnRenamed("node_id", end), end, "left_anti").select("edge_id", F.lit(end).alias("end"))
    return lost("source_ref").unionByName(lost("target_ref"))


def edge_identity(edges: DataFrame) -> DataFrame:
    """A stable id over kind, source, target and origin."""
    return edges.withColumn("edge_id", F.concat(F.lit("edge:"), F.sha2(F.to_json(F.array("edge_kind", "source_ref", "target_ref", F.coalesce("origin_ref", F.lit("")))), 256)))


def tree(nodes: DataFrame, edges: DataFrame, root_kind: str) -> DataFrame:
    """(parent, child, level, children, expandable): the tree that hangs below the nodes of ``root_kind``.

    An edge's source is a child of its target.  A node hangs at its least level, below the least
    of its parents there; roots have level 0 and no parent.  One round a level, each written, until
    nothing hangs below the last.
    """
    below = settle(edges.select(F.col("target_ref").alias("parent"), F.col("source_ref").alias("child")).distinct().join(nodes.select(F.col("node_id").alias("child")), "child", "left_semi"))
    placed = settle(nodes.where(F.col("node_kind") == root_kind).select(F.lit(None).cast("string").alias("parent"), F.col("node_id").alias("child"), F.lit(0).alias("level")))
    front, level = placed, 0
    while True:
        level += 1
        new = below.join(front.select(F.col("child").alias("parent")), "parent").join(placed.select("child"), "child", "left_anti")
        front = settle(new.groupBy("child").agg(F.min("parent").alias("parent")).select("parent", "child", F.lit(level).alias("level")))
        if front.isEmpty():
            break
        placed = placed.unionByName(front)
    children = placed.where("parent is not null").groupBy(F.col("parent").alias("child")).agg(F.count("*").alias("children"))
    n = F.coalesce("children", F.lit(0))
    return placed.join(children, "child", "left").select("parent", "child", "level", n.alias("children"), (n > 0).alias("expandable"))


#: Presets that show state, what they show besides, and the kinds of candidates that make them.
STATE_PRESETS = ("parameter_state", "completeness")
IMPORTED = (("native_configuration_text_import_flow", "native_configuration_url_document_flow"), ("imports_state",))
OVER_PROCESSES = (("native_configuration_url_ipc_flow", "native_configuration_url_consumer"), ("reads_state", "writes_state", "deletes_state", "persists_state"))


def view_presets(candidates: DataFrame, presets: DataFrame) -> DataFrame:
    """catalog_id, preset_id and edge_kinds of every catalogue: presets of state show what its candidates make of it.

    candidates: catalog_id, candidate_kind.  presets: preset_id, edge_kinds (array), a table of a few rows.
    """
    has = [F.bool_or(F.col("candidate_kind").isin(*kinds)).alias(f"has_{i}") for i, (kinds, _) in enumerate((IMPORTED, OVER_PROCESSES))]
    marks = candidates.groupBy("catalog_id").agg(*has)
    none = F.array().cast("array<string>")
    more = F.concat(*(F.when(F.coalesce(f"has_{i}", F.lit(False)), F.array(*map(F.lit, kinds))).otherwise(none) for i, (_, kinds) in enumerate((IMPORTED, OVER_PROCESSES))))
    listed = F.collect_list(F.struct("preset_id", "edge_kinds"))
    each = marks.join(presets.agg(listed.alias("presets")).hint("broadcast")).select("catalog_id", more.alias("more"), F.explode("presets").alias("p"))  # one row of presets
    return each.select("catalog_id", "p.preset_id", F.when(F.col("p.preset_id").isin(*STATE_PRESETS), F.array_union("p.edge_kinds", "more")).otherwise(F.col("p.edge_kinds")).alias("edge_kinds"))
