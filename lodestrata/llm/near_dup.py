"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Every text is a set of weighted five-word shingles.  A shingle weighs one and one more for each of its
longer words (``LONG`` bytes or more): edits of the short words that every text is full of count
less than edits of those that tell texts apart.  Each shingle is a Poisson process whose rate is
its weight; its arrivals fall into random registers, a register keeps the shingle of its first
arrival, and a shingle stops as soon as its next arrival is later than all registers of its
text.  Two texts share a register with their probability Jaccard similarity.  As a shingle weighs
the same in every text, that is the weight of what two texts share over the weight of what either
has, the measure that links are verified by.  How often a shingle stands in a text does not count,
so a passage that is pasted many times does not hide a copy.  Bands of registers give buckets; what meets in a
bucket is compared by a packed sketch of all registers and then by the exact similarity.

Groups of copies never become all pairs.  Texts of equal shingle sets are one node; within a
bucket, nodes are compared with a few leaders only (the node that meets most others, and nodes
at random), and links become components.  Nodes of buckets that still hold several components
meet once more by their rarest shingles, and only bounds that hold for certain rule pairs out
there, so no link between components is lost, while members of one component are never
compared again.  Pairs of similarity 0.8 share a band with a probability of 0.9993, more similar
ones with a higher one; that is the only loss.

Defined results: texts without words (null, empty, white space) are classes of their own; repeated
rows are copies, of which one stays; a null doc_id ranks last; a very long text is read as a
whole by one task, and its shingles are one array.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import kernels
from lodestrata.llm.bitmap import bitmap, may_hold
from lodestrata.llm.common import fresh, join_groups, settle, text_digest
from lodestrata.llm.components import connected_components

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE, PERCENT = 5, 80
#: Bytes of a word that adds to its shingle's weight.  The weight, 1 to 6, stands in the shingle's last bits.
LONG, WEIGHT_BITS = 4, 3
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: Bits of each register in the sketch, and the sketch's 64-bit words.
SKETCH_BITS = 4
SKETCH_WORDS = REGISTERS * SKETCH_BITS // 64
#: Sketches of a pair that is verified at once differ in so many bits at most: 0.65 similar, over
#: four deviations below 0.8.  Pairs beyond stay apart there and meet in the second comparison.
MOST_BITS = int(REGISTERS * SKETCH_BITS * (1 - 0.65) / 2)
#: 64-bit words of the sketch that tells how much weight differs: for each weight its first word and how many it has.
PARITY_WORDS = 16
PARITY_OF = {1: (0, 1), 2: (0, 1), 3: (1, 2), 4: (3, 5), 5: (8, 5), 6: (13, 3)}
#: Leaders of each bucket in the first comparison.
LEADERS = 3
#: Nodes of one shingle that meet in one task of the second comparison.
MOST_TOGETHER = 4096


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (text, shingle) and the weight of each, which its last bits hold as well.

    Words are runs of anything but ASCII white space, A-Z folded.  A text of fewer than
    ``size`` words has one shingle, all its words; one without words has none.
    """
    d, s, e, h, counts = kernels.words(texts, kernels.FOLDED_WHITE_SPACE)
    long = np.concatenate([np.zeros(1, np.int64), np.cumsum(e - s >= LONG)])

    def weighted(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of ``n`` words of the words numbered ``at``, which follow one another in each text."""
        own, grams = kernels.ngrams(d[at], h[at], n)
        begin = at[: max(0, len(at) - n + 1)]
        begin = begin[d[begin] == d[at[n - 1 :]]] if len(begin) else begin
        return own, grams, 1 + long[begin + n] - long[begin]

    parts = [weighted(np.arange(len(h)), size), *(weighted(np.flatnonzero(counts[d] == n), n) for n in range(1, size))]
    d, h, w = (np.concatenate(x) for x in zip(*parts))
    low = np.uint64((1 << WEIGHT_BITS) - 1)
    keys = (h & ~low) | w.astype(np.uint64)
    order = np.lexsort((keys, d))
    d, keys = d[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (d[1:] != d[:-1])
    d, keys = d[new], keys[new]
    return d, keys, (keys & low).astype(np.int64)


def prob_minhash(d: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """The shingle in each register, (texts, registers); zeros for texts without shingles."""
    first, kept = np.full(texts * registers, np.inf), np.zeros(texts * registers, np.uint64)
    time, last, state = np.zeros(len(h)), np.full(texts, np.inf), kernels.mix(h + np.uint64(0x51ED270B))
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while len(h):
            state = state + step
            draw = kernels.mix(state)
            time = time - np.log(_uniform(draw)) / weight
            alive = time < last[d]
            d, h, weight, time, state = (x[alive] for x in (d, h, weight, time, state))
            slot = d * registers + (kernels.mix(state ^ step) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(first, slot, time)
            won = first[slot] == time
            kept[slot[won]] = h[won]
            touched = np.unique(d)
            last[touched] = first.reshape(texts, registers)[touched].max(axis=1)
    return kept.reshape(texts, registers)


def _sketch(texts: pa.Array) -> pa.Array:
    d, h, weight = shingles(texts)
    n = len(texts)
    sizes = np.bincount(d, weight, minlength=n).astype(np.int64)
    with np.errstate(over="ignore"):
        a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        np.add.at(a, d, kernels.mix(h + np.uint64(1)))
        np.add.at(b, d, kernels.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        registers = kernels.mix(prob_minhash(d, h, weight.astype(float), n))
        bands = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            bands = kernels.mix(bands * np.uint64(31) + registers[:, k::ROWS])
        bits = (registers & np.uint64((1 << SKETCH_BITS) - 1)).reshape(n, SKETCH_WORDS, -1)
        packed = np.bitwise_or.reduce(bits << (np.arange(bits.shape[2], dtype=np.uint64) * np.uint64(SKETCH_BITS)), axis=2)
    listed = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.view(np.int64).ravel()))
    return pa.StructArray.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(sizes, pa.int32()), listed(bands), listed(packed)], ["a", "b", "n", "bands", "sketch"])


def _per_batch(kernel):
    """An Arrow function that runs ``kernel`` on slices of bounded size."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([kernel(part) for _, part in kernels.batches(texts)]) if len(texts) else kernel(texts)

    return run


def sketch(text: Column) -> Column:
    """Struct: 128 bits of the shingle set (a, b), its weight n, band keys and packed sketch."""
    run = _per_batch(_sketch)

    @F.arrow_udf("struct<a: bigint, b: bigint, n: int, bands: array<bigint>, sketch: array<bigint>>")
    def signature(texts: pa.Array) -> pa.Array:
        return run(texts)

    return signature(text)


def shingle_set(text: Column) -> Column:
    """Struct: the distinct shingles as 64-bit values, and their parity sketch.

    In the sketch, each shingle flips one of the bits of its weight.  Two sketches never differ in
    more bits of a weight than the sets do in shingles of it, so they rule pairs out for certain.
    """
    first, many = (np.array([0, *(PARITY_OF[w][k] for w in sorted(PARITY_OF))]) for k in (0, 1))

    def kernel(texts: pa.Array) -> pa.Array:
        d, h, weight = shingles(texts)
        parity = np.zeros(len(texts) * PARITY_WORDS, np.uint64)
        bit = (h >> np.uint64(32)).astype(np.int64) % (64 * many[weight])
        np.bitwise_xor.at(parity, d * PARITY_WORDS + first[weight] + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
        sets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(d, minlength=len(texts)))), pa.int32()), pa.array(h.view(np.int64)))
        sketches = pa.ListArray.from_arrays(np.arange(0, len(parity) + 1, PARITY_WORDS, dtype=np.int32), pa.array(parity.view(np.int64)))
        return pa.StructArray.from_arrays([sets, sketches], ["shingles", "parity"])

    run = _per_batch(kernel)

    @F.arrow_udf("struct<shingles: array<bigint>, parity: array<bigint>>")
    def sets(texts: pa.Array) -> pa.Array:
        return run(texts)

    return sets(text)


def _differing_bits(x: str, y: str, words: int) -> Column:
    return reduce(lambda p, q: p + q, (F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(words)))


def _differing_weight(x: str, y: str) -> Column:
    """At most the weight in which two sets differ: bits of several weights count as the least of them."""
    least = [min(w for w, (at, n) in PARITY_OF.items() if at <= i < at + n) for i in range(PARITY_WORDS)]
    return reduce(lambda p, q: p + q, (w * F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i, w in enumerate(least)))


def _similar_sizes(x: str, y: str) -> Column:
    """Weights leave it possible that two nodes are similar enough."""
    return 100 * F.least(f"{x}.n", f"{y}.n") >= PERCENT * F.greatest(f"{x}.n", f"{y}.n")


def _similar_sketches(x: str, y: str) -> Column:
    """Weights and sketches make it likely enough that two nodes are similar enough."""
    return _similar_sizes(x, y) & (_differing_bits(f"{x}.sketch", f"{y}.sketch", SKETCH_WORDS) <= MOST_BITS)


def _weight(shingle: Column) -> Column:
    return shingle.bitwiseAND((1 << WEIGHT_BITS) - 1)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (x, y) those whose shingle sets are similar enough, by the weight of what they share."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("shingles").alias(f"{c}_set"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").withColumn("shared", F.array_intersect("x_set", "y_set"))
    common = F.aggregate("shared", F.lit(0).cast("long"), lambda sum_, s: sum_ + _weight(s))
    weighed = both.select("x", "y", common.alias("common"), (F.col("x_n") + F.col("y_n")).alias("sum"))
    return weighed.where(100 * F.col("common") >= PERCENT * (F.col("sum") - F.col("common"))).select("x", "y")


def _crossing_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y) of nodes of different components that may be similar enough: all that are, and few others.

    Of a set as similar as ``PERCENT`` to another, no more weight than the rest of a hundred may lack
    in the other; so the two share one of each other's rarest shingles before which no more
    weight stands.  Nodes meet by those alone, not by what a whole group has in common.
    Where a component holds most of a shingle's nodes, they do not meet each other.
    """
    tokens = nodes.select("id").join(sets.select("id", "shingles"), "id").select("id", F.explode("shingles").alias("shingle"))
    often = tokens.groupBy("shingle").agg(F.count("*").alias("often"))
    rarest = tokens.join(often, "shingle").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("ordered"))
    begin = F.struct(F.lit(0).cast("long").alias("before"), F.lit(0).alias("length"))
    within = lambda s, w: F.col("n") * (100 - PERCENT) >= s["before"] * 100
    walk = F.aggregate("ordered", begin, lambda s, x: F.struct((s["before"] + _weight(x["shingle"])).alias("before"), (s["length"] + F.when(within(s, x), 1).otherwise(0)).alias("length")))
    prefix = F.filter(F.slice("ordered", F.lit(1), walk["length"]), lambda x: x["often"] > 1)
    known = nodes.join(sets.select("id", "parity"), "id")
    rarest = rarest.join(nodes.select("id", "n"), "id").select("id", prefix.alias("prefix"))
    keyed = settle(known.join(rarest.select("id", F.explode("prefix").alias("p")), "id").select("id", "n", "parity", "met", "component", F.col("p.shingle").alias("shingle")))
    mixed = settle(
        keyed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", F.struct(-F.col("met"), "id")).alias("main"), F.count("*").alias("nodes"))
        .where("low < high").select("shingle", "main", "nodes")
    )
    around = settle(join_groups(keyed, mixed, ["shingle"], "nodes").withColumn("parts", F.floor(F.col("nodes") / MOST_TOGETHER) + 1))
    # one side of a frequent shingle is dealt out, the other goes to every part
    rest = around.where("component <> main").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    others = around.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # sets of weights a and b are similar enough if at most (100 - p) / (100 + p) of a + b differ
    parity = (100 + PERCENT) * _differing_weight("x.parity", "y.parity") <= (100 - PERCENT) * (F.col("x.n") + F.col("y.n"))
    crossing = (F.col("x.component") != F.col("y.component")) & _similar_sizes("x", "y") & parity
    meet = rest.alias("x").join(others.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.part") == F.col("y.part")) & crossing)
    return meet.select(F.least("x.id", "y.id").alias("x"), F.greatest("x.id", "y.id").alias("y")).distinct()


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, t, n (weight of the shingles), class_id, class_size and kept of every row; one row of each class is kept."""
    rows = docs.select("doc_id", text_digest(F.col("text")).alias("t"), sketch(F.col("text")).alias("s"))
    signed = settle(rows.select("doc_id", "t", "s.*", F.monotonically_increasing_id().alias("row")))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("t"), F.col("row"))
    grouped = signed.where("n > 0").groupBy("a", "b").agg(
        F.min(rank).alias("first"), F.count("*").alias("rows"), F.min(F.col("t")).alias("t"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    nodes = settle(grouped.withColumn("id", F.monotonically_increasing_id()))

    # buckets of two nodes and more, with a leader by each of a few priorities
    banded = nodes.select("id", "n", "sketch", F.explode("bands").alias("bucket"))
    leader = [F.min(F.struct((-F.col("met") if k == 0 else F.xxhash64(F.lit(k), F.col("id"))).alias("p"), F.col("id"), F.col("n"), F.col("sketch"))).alias(f"l{k}") for k in range(LEADERS)]
    full = settle(banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"))
    shared = settle(join_groups(banded.where(may_hold(bitmap(full.select("bucket")), F.col("bucket"))), full, ["bucket"], "members"))
    # the text that a group of near copies was made from meets more of them than any copy does
    central = shared.groupBy("id").agg(F.sum("members").alias("met"))
    members = settle(shared.drop("members").join(central, "id").select("bucket", "id", "n", "sketch", "met"))
    leaders = settle(members.groupBy("bucket").agg(F.count("*").alias("members"), *leader).select("bucket", "members", F.array(*(f"l{k}" for k in range(LEADERS))).alias("leaders")))
    stars = (
        join_groups(members, leaders, ["bucket"], "members").select(F.struct("id", "n", "sketch").alias("x"), F.explode(F.array_distinct("leaders")).alias("y"))
        .where((F.col("x.id") != F.col("y.id")) & _similar_sketches("x", "y"))
        .select(F.least("x.id", "y.id").alias("x"), F.greatest("x.id", "y.id").alias("y")).distinct()
    )

    # the shingle sets of nodes that share a bucket, read from one text each
    wanted = settle(members.select("id").distinct().join(nodes.select("id", "n", "t"), "id"))
    texts = docs.select(text_digest(F.col("text")).alias("t"), "text").where(may_hold(bitmap(wanted.select("t.a")), F.col("t.a"))).dropDuplicates(["t"])
    sets = settle(texts.join(wanted, "t").select("id", "n", shingle_set(F.col("text")).alias("s")).select("id", "n", "s.*"))

    links = settle(_verified(stars, sets))
    parts = connected_components(links)
    # nodes of buckets that hold several components may still have a link between these
    placed = members.join(parts.withColumnRenamed("id", "p_id"), F.col("id") == F.col("p_id"), "left").select("bucket", "id", "n", "met", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    apart = settle(placed.join(mixed.select("bucket"), "bucket", "left_semi").drop("bucket").dropDuplicates(["id"]))
    pairs = _crossing_pairs(apart, sets)
    more = settle(_verified(pairs, sets))
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))

    classed = nodes.join(parts.withColumnRenamed("id", "p_id"), F.col("id") == F.col("p_id"), "left").select("a", "b", "first", "rows", F.coalesce("component", "id").alias("component"))
    firsts = classed.groupBy("component").agg(F.min("first").alias("first"), F.sum("rows").alias("class_size"))
    node_class = settle(classed.select("a", "b", "rows", "component").join(firsts, "component").select("a", "b", "rows", "first", "class_size"))
    found = join_groups(signed.where("n > 0").select("doc_id", "t", "n", "row", "a", "b"), node_class, ["a", "b"], "rows").select(
        "doc_id", "t", "n", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept")
    )
    alone = signed.where("n = 0").select("doc_id", "t", "n", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, t (digest of the text), class_id, class_size and kept of every row.

    ``class_id`` is the doc_id of the class's first row (least doc_id, null last; then least
    digest), which alone is kept; of rows equal in both, one is.  Texts without words (null,
    empty, white space) have no shingles: each row is a class of its own and kept.  Other columns
    are ignored.
    """
    return _classes(docs).drop("n")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, all columns as they are."""
    rows = _classes(docs).where("n > 0").groupBy("doc_id", "t").agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
    rows = settle(rows.where("not stays or rows > 1"))
    key, hit = fresh(docs, "text_key"), fresh(docs, "class_row")
    mine = docs.withColumn(key, text_digest(F.col("text")))
    touched = may_hold(bitmap(rows.select("t.a")), F.col(key)["a"])
    r = rows.select(F.struct("*").alias(hit))
    joined = mine.where(touched).join(r, mine["doc_id"].eqNullSafe(r[hit]["doc_id"]) & (mine[key] == r[hit]["t"]), "left")
    # rows equal in doc_id and text, of which the class keeps one
    twins = joined.where(F.col(hit)["stays"]).dropDuplicates(["doc_id", key])
    return mine.where(~touched).select(*docs.columns).unionByName(joined.where(F.col(hit).isNull()).select(*docs.columns)).unionByName(twins.select(*docs.columns))
