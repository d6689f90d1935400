"""Projecting a catalogue to a typed graph, and what is read off such graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.interfaces import display_path, interface_identity, parameter_type
from lodestrata.operators.graph import edge_identity
from lodestrata.operators.storage import settle

#: Node kind of each candidate kind; any other is an evidence candidate.
NODE_KINDS = {
    "request_interface": "interface", "frontend_invocation": "invocation", "frontend_feature_gate": "feature_gate", "native_route_binding": "route_binding", "native_handler": "handler", "native_relationship": "communication_relation",
    "runtime_principal": "runtime_principal", "ubus_backend_binding": "backend_binding", "ubus_access_grant": "access_grant", "response_fixture_contract": "response_contract", "native_nested_dispatch": "dispatch", "native_cgi_dispatch": "dispatch",
    "native_cgi_selector": "dispatch", "native_cross_elf_call": "communication_relation", "native_request_protection": "protection", "native_service_assembly": "service_assembly", "arm_literal_xref": "literal_xref", "arm_feature_pivot": "feature_pivot",
    "parameter_clue_assessment": "parameter_clue", "candidate_association": "association",
}


def node_kind(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in NODE_KINDS.items() for x in pair))[kind], F.lit("evidence_candidate"))


def project_graph(candidates: DataFrame, parameters: DataFrame, associations: DataFrame, obligations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and diagnostics of a catalogue.

    Candidates (candidate_id, candidate_kind, canonical_identity, claim_status, source_path,
    target_ref), their artifacts, parameters (parameter_id, owner_ref, name), associations
    (association_id, frontend_candidate_id, native_hint_id) and open obligations (obligation_id,
    target_ref).  Edges whose ends are not nodes are dropped and reported.
    """
    node = lambda df, i, kind, label, status, path: df.select(i.alias("node_id"), kind.alias("node_kind"), label.alias("label"), status.alias("status"), path.alias("source_path"))
    c, p, o = F.col, F.lit, obligations
    nodes = (
        node(candidates, c("candidate_id"), node_kind(c("candidate_kind")), c("canonical_identity"), c("claim_status"), c("source_path"))
        .unionByName(node(candidates.where("source_path <> ''").select("source_path").distinct(), F.concat(p("artifact:"), c("source_path")), p("artifact"), c("source_path"), p("supported"), c("source_path")))
        .unionByName(node(parameters, c("parameter_id"), p("parameter"), c("name"), p("supported"), p("")))
        .unionByName(node(o, c("obligation_id"), p("obligation"), c("required_capability"), c("status"), p("")))
    ).dropDuplicates(["node_id"])
    edge = lambda df, kind, source, target, origin: df.select(p(kind).alias("edge_kind"), source.alias("source_ref"), target.alias("target_ref"), origin.alias("origin_ref"))
    edges = (
        edge(candidates.where("source_path <> ''"), "declared_in_artifact", c("candidate_id"), F.concat(p("artifact:"), c("source_path")), c("candidate_id"))
        .unionByName(edge(parameters, "has_parameter", c("owner_ref"), c("parameter_id"), c("parameter_id")))
        .unionByName(edge(candidates.where("target_ref is not null"), "targets", c("candidate_id"), c("target_ref"), c("candidate_id")))
        .unionByName(edge(associations, "associated_with", c("frontend_candidate_id"), c("native_hint_id"), c("association_id")))
        .unionByName(edge(o, "requires_evidence_for", c("obligation_id"), c("target_ref"), c("obligation_id")))
    )
    ends = nodes.select(F.col("node_id").alias("end"))
    # of all edges only their names meet the nodes; ids are taken of those that are reported
    source, target = (ends.select(F.col("end").alias(i), p(True).alias(f"{i}_known")) for i in ("source_ref", "target_ref"))
    lost = edges.join(source, "source_ref", "left").join(target, "target_ref", "left").where("source_ref_known is null or target_ref_known is null")
    diagnostics = edge_identity(lost.select(*edges.columns)).dropDuplicates(["edge_id"]).select(F.concat(F.lit("unresolved_reference:"), "edge_kind", F.lit(":"), "origin_ref").alias("diagnostic"))
    edges = edge_identity(edges).dropDuplicates(["edge_id"])
    known = edges.join(ends.toDF("source_ref"), "source_ref", "left_semi").join(ends.toDF("target_ref"), "target_ref", "left_semi")
    return nodes, known, diagnostics


def induced_overlay(matches: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(identifier, node_id) of matched candidates, the edges between an identifier's nodes, and what no node stands for."""
    placed = matches.join(nodes.select(F.col("node_id")), matches["candidate_id"] == F.col("node_id")).select("identifier", "node_id").distinct()
    source = placed.select("identifier", F.col("node_id").alias("source_ref"))
    between = edges.join(source, "source_ref").join(placed.select("identifier", F.col("node_id").alias("target_ref")), ["identifier", "target_ref"]).select("identifier", "edge_id").distinct()
    return placed, between, matches.join(placed, "identifier", "left_anti").select("identifier").distinct()


def call_closure(calls: DataFrame, anchors: DataFrame, most_depth: int = 4) -> DataFrame:
    """(origin, function, depth): functions that anchors reach over calls, at their least depth.

    Only pairs that are new in a round go on to the next.
    """
    steps = settle(calls.select("caller", "callee").distinct())
    seen = settle(anchors.select(F.col("anchor").alias("origin"), F.col("anchor").alias("function"), F.lit(0).alias("depth")).distinct())
    front = seen
    for depth in range(1, most_depth + 1):
        new = front.join(steps, F.col("function") == F.col("caller")).select("origin", F.col("callee").alias("function")).distinct()
        front = settle(new.join(seen, ["origin", "function"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def resolve_exports(uses: DataFrame, exports: DataFrame, needed: DataFrame) -> DataFrame:
    """(path, name, target_path, status): the same file's export, else the only needed library's, else open."""
    own = uses.join(exports.select(F.col("path"), F.col("name"), F.lit(True).alias("own")), ["path", "name"], "left")
    libraries = needed.join(exports.select(F.col("path").alias("library"), "name"), "library").groupBy("path", "name").agg(F.count("*").alias("n"), F.min("library").alias("library"))
    met = own.join(libraries, ["path", "name"], "left")
    target = F.when(F.col("own"), F.col("path")).when(F.col("n") == 1, F.col("library"))
    return met.select("path", "name", target.alias("target_path"), F.when(target.isNotNull(), "resolved").otherwise("unresolved").alias("status"))


def interface_tree(interfaces: DataFrame, bindings: DataFrame, parameters: DataFrame) -> DataFrame:
    """Levels of component, interface and parameter: (level, node, parent, label, detail, children).

    An interface belongs to the component that binds its route, else to ``unbound``; a parameter's
    detail is the type its literals show.
    """
    named = interfaces.withColumn("identity", interface_identity(F.col("canonical_identity")))
    bound = bindings.groupBy(interface_identity(F.col("route")).alias("identity")).agg(F.min("component").alias("component"))
    own = named.join(bound, "identity", "left").withColumn("component", F.coalesce("component", F.lit("unbound")))
    kinds = parameters.groupBy("owner_ref", "name").agg(F.flatten(F.collect_list("selector_values")).alias("values"))
    leaves = kinds.join(own.select(F.col("candidate_id").alias("owner_ref")), "owner_ref", "left_semi").select(F.lit("parameter").alias("level"), F.concat_ws("#", "owner_ref", "name").alias("node"), F.col("owner_ref").alias("parent"), F.col("name").alias("label"), parameter_type(F.array_distinct("values")).alias("detail"), F.lit(0).cast("long").alias("children"))
    count = leaves.groupBy(F.col("parent").alias("candidate_id")).agg(F.count("*").alias("children"))
    middle = own.join(count, "candidate_id", "left").select(F.lit("interface").alias("level"), F.col("candidate_id").alias("node"), F.col("component").alias("parent"), display_path(F.col("identity")).alias("label"), F.lit("").alias("detail"), F.coalesce("children", F.lit(0)).alias("children"))
    top = middle.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children")).select(F.lit("component").alias("level"), "node", F.lit("firmware").alias("parent"), F.col("node").alias("label"), F.lit("").alias("detail"), "children")
    return top.unionByName(middle).unionByName(leaves)


def catalogue_listing(catalogs: DataFrame, candidates: DataFrame, contexts: DataFrame) -> DataFrame:
    """Catalogues with their counts; those without release context keep a null one."""
    counts = candidates.groupBy("catalog_id").agg(F.count("*").alias("candidates"), F.sum(F.size("evidence_ids")).alias("evidence_references"))
    return catalogs.join(counts, "catalog_id", "left").join(contexts, "catalog_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def candidate_detail(candidate_id: str, candidates: DataFrame, parameters: DataFrame, associations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(part, id) of what belongs to one candidate: parameters, associations, related candidates, evidence."""
    own = candidates.where(F.col("candidate_id") == candidate_id)
    touching = associations.where((F.col("frontend_candidate_id") == candidate_id) | (F.col("native_hint_id") == candidate_id))
    related = candidates.where(F.col("target_ref") == candidate_id)
    proofs = evidence.join(own.select(F.explode("evidence_ids").alias("evidence_id")), "evidence_id", "left_semi")
    part = lambda df, name, column: df.select(F.lit(name).alias("part"), F.col(column).alias("id"))
    return part(parameters.where(F.col("owner_ref") == candidate_id), "parameter", "parameter_id").unionByName(part(touching, "association", "association_id")).unionByName(part(related, "related", "candidate_id")).unionByName(part(proofs, "evidence", "evidence_id"))


def reasoning_request(obligations: DataFrame, candidates: DataFrame, n_obligations: int = 20, n_candidates: int = 24) -> tuple[DataFrame, DataFrame]:
    """The most urgent open obligations, and candidates, those that they name first."""
    top = obligations.where("status = 'open'").orderBy(F.desc("priority"), "obligation_id").limit(n_obligations)
    named = top.select(F.col("target_ref").alias("candidate_id"), F.lit(True).alias("named")).distinct()
    ranked = candidates.join(F.broadcast(named), "candidate_id", "left")  # n_obligations rows at most
    return top, ranked.orderBy(F.col("named").asc_nulls_last(), "candidate_id").limit(n_candidates).drop("named")


def bounded_list(values: Column, limit: int = 12) -> tuple[Column, Column]:
    """The first values, and how many more there are."""
    return F.slice(values, 1, limit), F.greatest(F.size(values) - limit, F.lit(0))


def root_candidates(markers: DataFrame, names: tuple[str, ...] = ("squashfs-root", "rootfs", "cpio-root")) -> DataFrame:
    """Roots of an unpacked image by markers found, then name; equal ones all stay (ambiguous)."""
    name = F.substring_index("root", "/", -1)
    preference = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), name), F.lit(0)), F.lit(len(names) + 1))
    place = F.rank().over(Window.partitionBy("image").orderBy(F.desc("markers"), preference))
    best = markers.withColumn("place", place).where("place = 1").drop("place")
    return best.withColumn("status", F.when(F.count("*").over(Window.partitionBy("image")) > 1, "ambiguous").otherwise("selected"))
