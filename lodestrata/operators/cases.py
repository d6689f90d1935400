"""Research cases: references and closures checked by joins, identities as digests from the leaves up."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cases:
    """Tables of cases, keyed by case_key.

    evidence: evidence_ref, kind, and what else identifies it.  claims: claim_id, statement,
    evidence_refs.  stages: stage_id, order, claim_ids, creates, resolves, rejects.  obligations:
    obligation_id, status (open, resolved, rejected), closure_refs.  cases: title, case_id (as
    recorded), counterfactuals, paper_uses and limitations (arrays).
    """

    cases: DataFrame
    evidence: DataFrame
    claims: DataFrame
    stages: DataFrame
    obligations: DataFrame


def _issue(rows: DataFrame, rule: str, detail: Column | str) -> DataFrame:
    return rows.select("case_key", F.lit(rule).alias("rule"), (F.col(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"))


def _repeated(rows: DataFrame, key: str, rule: str) -> DataFrame:
    return _issue(rows.groupBy("case_key", key).agg(F.count("*").alias("n")).where("n > 1"), rule, key)


def _holding(rows: DataFrame, detail: str, rules: dict[str, Column]) -> DataFrame:
    """An issue for each of ``rules`` that holds of a row, told in one pass; a row of which none holds makes no array."""
    return rows.where(reduce(Column.__or__, rules.values())).select("case_key", F.explode(F.array_compact(F.array(*(F.when(x, F.lit(n)) for n, x in rules.items())))).alias("rule"), F.col(detail).cast("string").alias("detail"))


#: What rows say of a key, by the kind of thing that the key names: it is there, or it is cited (and the rule that a citation of nothing breaks).
_SAID = (
    ("evidence", None), ("claim", None), ("obligation", None), ("stage", None), ("order", None), ("evidence", "claim_evidence_unknown"), ("evidence", "closure_evidence_unknown"),
    ("claim", "stage_claim_unknown"), ("obligation", "stage_creates_unknown"), ("obligation", "stage_resolves_unknown"), ("obligation", "stage_rejects_unknown"),
)
_KINDS = tuple(kind for kind, rule in _SAID if not rule)
_STATUS = ("open", "resolved", "rejected")


def _some(refs: Column | str) -> Column:
    return F.coalesce(refs, F.array().cast("array<string>"))


def _issues(c: Cases) -> DataFrame:
    """What ``case_issues`` returns: all that is said of a key is summed, on the map side first, and rules are told of the sums, so no row is repeated."""
    code = lambda kind, rule=None: _SAID.index((kind, rule))
    said = lambda key, *what: F.struct(F.lit(code(*what)).alias("code"), key.cast("string").alias("key"))
    each = lambda refs, *what: F.transform(_some(refs), lambda x: said(x, *what))
    col, no_order = F.col, F.lit(None).cast(c.stages.schema["order"].dataType).alias("order")
    s = col("status")
    status = F.when(s == _STATUS[0], 1).when(s == _STATUS[1], 2).when(s == _STATUS[2], 4).otherwise(0).alias("status")
    # arrays are made where they are exploded: a column would be made twice, once for the filter that Spark infers
    rows = [
        c.evidence.select("case_key", F.explode(F.array(said(col("evidence_ref"), "evidence"))).alias("x"), F.lit(0).alias("status"), no_order),
        c.claims.select("case_key", F.explode(F.concat(F.array(said(col("claim_id"), "claim")), each(F.array_distinct("evidence_refs"), "evidence", "claim_evidence_unknown"))).alias("x"), F.lit(0).alias("status"), no_order),
        c.obligations.select("case_key", F.explode(F.concat(F.array(said(col("obligation_id"), "obligation")), each(F.array_distinct("closure_refs"), "evidence", "closure_evidence_unknown"))).alias("x"), status, no_order),
        c.stages.select("case_key", F.explode(F.concat(
            F.array(said(col("stage_id"), "stage"), said(col("order"), "order")), each("claim_ids", "claim", "stage_claim_unknown"), *(each(n, "obligation", f"stage_{n}_unknown") for n in ("creates", "resolves", "rejects")),
        )).alias("x"), F.lit(0).alias("status"), "order"),
    ]
    told = reduce(DataFrame.unionByName, rows).select("case_key", "x.code", "x.key", "status", "order")
    moves = [code("obligation", f"stage_{n}_unknown") for n in ("creates", "resolves", "rejects")]
    kind, made, ended = reduce(lambda found, k: found.when(col("code").isin([i for i, (x, _) in enumerate(_SAID) if x == k]), _KINDS.index(k)), _KINDS, F), col("code") == moves[0], col("code").isin(moves[1:])
    told = told.withColumn("kind", kind).groupBy("case_key", "kind", "key").agg(
        F.count(F.when(col("code") < len(_KINDS), 1)).alias("known"), F.bit_or(F.expr("shiftleft(1, code)")).alias("said"), F.bit_or(F.when(col("code") == code("obligation"), col("status"))).alias("status"),
        F.min(F.when(made & col("key").isNotNull(), col("order"))).alias("made_at"), F.min(F.when(ended, col("order"))).alias("ended_at"),
    )
    # a reference without a key, or of no case, meets nothing
    met = col("key").isNotNull() & col("case_key").isNotNull()
    has = lambda *codes: col("said").bitwiseAND(sum(1 << x for x in codes)) != 0
    is_now, resolved, rejected = (lambda n: F.coalesce("status", F.lit(0)).bitwiseAND(1 << _STATUS.index(n)) != 0), met & has(moves[1]), met & has(moves[2])
    rules = {f"{k}_repeated": (col("kind") == i) & (col("known") > 1) for i, k in enumerate(_KINDS)} | {rule: has(i) & (~met | (col("known") == 0)) for i, (_, rule) in enumerate(_SAID) if rule}
    rules |= {
        "closed_before_created": has(*moves[1:]) & (col("made_at").isNull() | (col("made_at") >= col("ended_at"))), "never_created": has(code("obligation")) & (col("made_at").isNull() | ~met), "resolved_by_no_stage": is_now("resolved") & ~resolved, "rejected_by_no_stage": is_now("rejected") & ~rejected,
        "open_but_closed": is_now("open") & (resolved | rejected), "resolved_but_rejected": is_now("resolved") & rejected, "rejected_but_resolved": is_now("rejected") & resolved,
    }
    # a stage closes only what an earlier one created, and once; texts would keep the sums above from being hashed
    closing = c.stages.select("case_key", "stage_id", F.explode(F.concat(_some("resolves"), _some("rejects"))).alias("key")).groupBy("case_key", "key").agg(F.min("stage_id").alias("least"), F.max("stage_id").alias("most"))
    return _holding(told, "key", rules).unionByName(_issue(closing.where("least <> most"), "closed_twice", "key"))


def case_issues(c: Cases) -> DataFrame:
    """case_key, rule and detail of everything that speaks against a case as it stands."""
    return _issues(c)


#: The layers in which a case's digests are told: what is cited comes before what cites it.
_EVIDENCE, _CLAIM, _OBLIGATION, _STAGE, _CASE = range(5)
#: What a stage cites; its references begin with their place in this list.
_LISTS = {"claim_ids": _CLAIM, "creates": _OBLIGATION, "resolves": _OBLIGATION, "rejects": _OBLIGATION}


def _shown(digests: list[bytes]) -> bytes:
    return b'["%b"]' % b'","'.join(digests) if digests else b"[]"


def _leaves(refs: list[bytes], digests: dict[bytes, list[bytes]]) -> bytes:
    if len(refs) == 1:
        found = digests.get(refs[0], ())
        return b'["%b"]' % found[0] if len(found) == 1 else _shown(sorted(set(found)))
    return _shown(sorted({d for x in refs for d in digests.get(x, ())}))


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identities of cases whose rows (case_key, key, layer, id, head, refs) come together, in the order of layer and id; a head is a JSON object, or evidence's digest."""
    lists, stage_tail = list(_LISTS.values()), b',"p2":%b,"p3":%b,"p4":%b,"p5":%b}'
    listed = lambda x: x.to_numpy(zero_copy_only=False).tolist()
    case, known, parts, place, heads, cited = (), None, None, None, None, None

    def close() -> None:
        """The digests of the rows of one id, which cite together."""
        layer, name = place
        if layer == _STAGE:
            leaves = [b"[]"] * len(lists)
            for i in {x[0] - 48 for x in cited} if name is not None else ():
                leaves[i] = _leaves([x[1:] for x in cited if x[0] == 48 + i], known[lists[i]])
            tail = stage_tail % tuple(leaves)
        else:
            tail = b',"p2":%b}' % (b"null" if name is None else _leaves(cited, known[_EVIDENCE]))
        found = [sha256(head[:-1] + tail).hexdigest().encode() for head in heads]
        if name is not None:
            known[layer][name] = found
        parts[layer] += found

    for batch in batches:
        key, layers, ids, head, refs = (batch.column(c) for c in ("key", "layer", "id", "head", "refs"))
        flat, at, rows, identities = listed(refs.flatten()), 0, [], []
        for i, (k, layer, name, text, n) in enumerate(zip(listed(key), listed(layers), listed(ids), listed(head), listed(refs.value_lengths().fill_null(0)))):
            if place is not None and (k != case or name != place[1] or layer != place[0]):
                close()
                place = None
            if k != case:
                case, known, parts = k, [{} for _ in range(_CASE)], [[] for _ in range(_CASE)]
            if layer == _EVIDENCE:
                parts[layer].append(text)
                if name is not None:
                    known[layer].setdefault(name, []).append(text)
            elif layer == _CASE:
                rows.append(i)
                identities.append("research-case:" + sha256(text[:-1] + b',"p5":%b,"p6":%b,"p7":%b,"p8":%b}' % tuple(_shown(sorted(parts[x])) for x in (_EVIDENCE, _CLAIM, _STAGE, _OBLIGATION))).hexdigest())
            elif place is None:
                place, heads, cited = (layer, name), [text], flat[at : at + n]
            else:
                heads.append(text)
                cited += flat[at : at + n]
            at += n
        yield pa.RecordBatch.from_arrays([batch.column("case_key").take(pa.array(rows, pa.int64())), pa.array(identities, pa.string())], ["case_key", "replayed_id"])


def case_identities(c: Cases) -> DataFrame:
    """case_key and replayed_id: a digest of the case's own fields and of its parts' digests.

    A claim's digest holds those of its evidence, an obligation's those of what closes it, and a
    stage's those of its claims and obligations; so a change anywhere changes all above it.

    Rows are shuffled once, by their case, and digests are told only of sorted rows: digests would
    be most of the bytes.  A task holds the digests of one case.
    """

    content = lambda *own: F.to_json(F.struct(*(F.col(x).alias(f"p{i}") for i, x in enumerate(own))), {"ignoreNullFields": "false"})

    def rows(df: DataFrame, layer: int, id: Column, own: list[str], refs: Column | None = None) -> DataFrame:
        return df.select("case_key", F.lit(layer).alias("layer"), id.cast("string").alias("id"), content(*own).alias("head"), (F.lit(None) if refs is None else refs).cast("array<string>").alias("refs"))

    listed = F.concat(*(F.transform(F.array_compact(_some(n)), lambda x: F.concat(F.lit(str(i)), x)) for i, n in enumerate(_LISTS)))
    parts = [
        rows(c.evidence, _EVIDENCE, F.col("evidence_ref"), sorted(c.evidence.columns)), rows(c.claims, _CLAIM, F.col("claim_id"), ["claim_id", "statement"], F.array_compact(F.array_distinct("evidence_refs"))),
        rows(c.obligations, _OBLIGATION, F.col("obligation_id"), ["obligation_id", "status"], F.array_compact(F.array_distinct("closure_refs"))), rows(c.stages, _STAGE, F.col("stage_id"), ["stage_id", "order"], listed),
    ]
    # what is of no case meets none
    every = reduce(DataFrame.unionByName, (x.where("case_key is not null") for x in parts)).unionByName(rows(c.cases, _CASE, F.lit(None), ["case_key", "title", "counterfactuals", "paper_uses", "limitations"]))
    together = every.repartition("case_key").sortWithinPartitions("case_key", "layer", "id")
    head = F.when(F.col("layer") == _EVIDENCE, F.sha2("head", 256)).otherwise(F.col("head"))
    replayed = together.select("case_key", F.col("case_key").cast("string").cast("binary").alias("key"), "layer", F.col("id").cast("binary").alias("id"), head.cast("binary").alias("head"), F.col("refs").cast("array<binary>").alias("refs"))
    return replayed.mapInArrow(_replay, together.select("case_key", F.lit("").alias("replayed_id")).schema)


def corpus_issues(c: Cases, identities: DataFrame | None = None) -> DataFrame:
    """What speaks against a corpus of cases: those of ``case_issues``, identities that do not replay, thin or unfinished cases.

    identities: the cases' ``case_identities``, if they are there already.
    """
    replayed = c.cases.join(case_identities(c) if identities is None else identities, "case_key")
    # whether there are two kinds is told by the least and the greatest, without a row for each kind
    least, most = F.min("kind"), F.max("kind")
    kinds = c.cases.select("case_key").distinct().join(c.evidence.groupBy("case_key").agg(F.when(least.isNull(), 0).when(least == most, 1).otherwise(2).alias("kinds")), "case_key", "left")
    # a case that is there twice has these issues once
    once = [
        _issue(replayed.where("not replayed_id <=> case_id"), "identity_does_not_replay", "case_id"),
        _holding(c.cases.withColumn("none", F.lit("")), "none", {f"{n}_missing": F.coalesce(F.size(n), F.lit(0)) < 1 for n in ("counterfactuals", "paper_uses", "limitations")}),
    ]
    found = [_issues(c), _repeated(c.cases.withColumn("key", F.col("case_key")), "key", "case_repeated"), _issue(kinds.where("coalesce(kinds, 0) < 2"), "fewer_than_two_kinds_of_evidence", F.coalesce("kinds", F.lit(0))), reduce(DataFrame.unionByName, once).distinct()]
    return reduce(DataFrame.unionByName, found)
