"""Line dedup: a suffix array over line ids by prefix doubling, with built-in functions only.

All distinct texts, in order of their first doc_id, are one sequence of lines; a line's number in
it is its ``place``, and no run reaches beyond the end of its text.  A suffix's rank of level k
is the number of its first 2^k lines in sorted order.  Ranks of level k + 1 come from sorting the
pairs (rank of a suffix, rank of the one 2^k lines later).  Pairs that occur once are sorted out
for good, so each round moves only what is still repeated.

Suffixes that agree in their first n lines are an interval of the suffix array.  From the highest
level down, each suffix descends into the interval of the longest prefix in which an earlier
suffix stands: intervals are split by the rank of what follows, half the length each time.  The
first suffix of an interval stands for it in the wider one around it, so each level handles every
suffix once, and at most one more row for each interval.  Where the descent ends lies the exact length of
the longest earlier copy, and those lines of the later place are deleted.

Defined results: lines without a word are no part of runs and stay; null and empty texts have no
lines; rows equal in doc_id and text are one document and lose the same lines; a null doc_id ranks
last; a very long text is one row of line hashes until its lines are numbered, then a row a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.bitmap import bitmap, may_hold
from lodestrata.llm.common import free, fresh, join_groups, settle, text_digest

#: Lines of the shortest run whose later copies are deleted.
LEAST_LINES = 2
#: Words from which a single line is a run of its own, for callers that count by words as well.
LONG_WORDS = 20


def _long(line: Column, words: int | None) -> Column:
    """The line has ``words`` words or more; none has if ``words`` is None."""
    if words is None:
        return F.lit(False)
    return line.rlike(r"\A[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]" % (words - 1))


def line_places(docs: DataFrame, firsts: DataFrame, long_words: int | None = None) -> DataFrame:
    """place, t, at (number among the text's lines with a word), left (lines from here on), a, b, long.

    ``firsts``: the first document of each text t.  Each distinct text counts once.  Places follow
    (first document, t, at): ids that increase over range-sorted parts.
    """
    named = F.filter(
        F.transform(F.split(F.col("text"), "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), _long(x, long_words).alias("long"), x.rlike(r"[^\x20\x09-\x0D]").alias("full"))),
        lambda x: x["full"],
    )
    texts = docs.where("text is not null").select(text_digest(F.col("text")).alias("t"), named.alias("names")).where("size(names) > 0").dropDuplicates(["t"])
    ordered = texts.join(firsts.select("t", "first"), "t").repartitionByRange("first", "t").sortWithinPartitions("first", "t")
    lines = ordered.select("t", F.size("names").alias("n"), F.posexplode("names").alias("at", "x"))
    return lines.select(F.monotonically_increasing_id().alias("place"), "t", "at", (F.col("n") - F.col("at")).alias("left"), "x.a", "x.b", "x.long")


def _groups(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """What several suffixes share of ``keys``: n (how many), first (place) and rank, which increases with the keys."""
    found = suffixes.groupBy(*keys).agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
    return found.orderBy(*keys).withColumn("number", F.monotonically_increasing_id())


def rank_levels(lines: DataFrame) -> list[DataFrame]:
    """For each k: the suffixes whose first 2^k lines stand elsewhere as well (place, left, rank, first).

    The first level has t, at and long as well.  There single lines may be very frequent, so it
    splits off its large groups; joins of the later levels are written as they come, so that
    Spark's skew handling can split them.  What is joined grows with the corpus: nothing of it is broadcast.
    """
    out = lambda joined, *more: settle(joined.select("place", "left", F.col("number").alias("rank"), "first", *more))
    groups = settle(_groups(lines, ["a", "b"]))
    levels = [out(join_groups(lines.where(may_hold(bitmap(groups.select("a")), F.col("a"))), groups, ["a", "b"], "n"), "t", "at", "long")]
    while not levels[-1].isEmpty():
        shift = 1 << (len(levels) - 1)
        now = levels[-1].select("place", "left", "rank")
        later = now.select((F.col("place") - shift).alias("place"), F.col("rank").alias("rank_after"))
        # within the text: its lines have consecutive places
        pairs = now.where(F.col("left") >= 2 * shift).join(later.hint("merge"), "place")
        levels.append(out(pairs.join(_groups(pairs, ["rank", "rank_after"]).hint("merge"), ["rank", "rank_after"])))
    return levels[:-1]


def longest_copies(levels: list[DataFrame], least: int) -> DataFrame | None:
    """(place, length, source): the longest run from a place that also begins at an earlier one.

    Places whose run is shorter than ``least`` may lack.  ``source`` is the first place that has
    the run.  In the descent a row (place, source, length) means: the place stands in the interval
    of suffixes that agree with ``source`` in ``length`` lines.  The interval's first suffix has
    equal ``place`` and ``source`` there, besides its own row in the wider interval.
    """
    inside: DataFrame | None = None
    for k in reversed(range(len(levels))):
        size, level = 1 << k, levels[k]
        parts = []
        if inside is not None:
            # split intervals by the rank of the next ``size`` lines
            follows = F.when(F.col("left") >= F.col("length") + size, F.col("place") + F.col("length"))
            probe = inside.withColumn("next", follows).join(level.select(F.col("place").alias("next"), F.col("rank")).hint("merge"), "next", "left").drop("next")
            keys = ["source", "length", "rank"]
            shared = probe.where("rank is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1").drop("n")
            stays = F.struct(F.col("source"), F.col("length"))
            moves = F.struct(F.col("first").alias("source"), (F.col("length") + size).alias("length"))
            to = F.when(F.col("first").isNull(), F.array(stays)).when(F.col("place") > F.col("first"), F.array(moves)).otherwise(F.array(stays, moves))
            parts.append(probe.join(shared.hint("merge"), keys, "left").select("place", "left", F.explode(to).alias("x")).select("place", "left", "x.*"))
        if 2 * size > least:
            # suffixes that enter here have no earlier one on the next level; the level's firsts enter beside them
            rows = level.join(levels[k + 1].where("place > first").select("place").hint("merge"), "place", "left_anti") if k + 1 < len(levels) else level
            parts.append(rows.select("place", "left", F.col("first").alias("source"), F.lit(size).alias("length")))
        if parts:
            inside = settle(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    return None if inside is None else inside.where("place > source").select("place", "length", "source")


def deleted_lines(docs: DataFrame, least: int = LEAST_LINES, long_words: int | None = None) -> DataFrame:
    """A row for each text of which some row loses lines: t, first, copied, deleted, longest.

    ``deleted`` are the numbers, among lines with a word, of those that all rows of the text lose;
    ``longest`` is the longest run copied at once.  Where ``copied``, later documents than
    ``first`` have the same text, which is for them one run as a whole.
    """
    named = docs.where("text is not null").select(text_digest(F.col("text")).alias("t"), F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id")).alias("id"))
    firsts = settle(named.groupBy("t").agg(F.min("id").alias("first"), F.max("id").alias("last")).select("t", "first", (F.col("first") != F.col("last")).alias("copied")))
    lines = settle(line_places(docs, firsts, long_words))
    levels = rank_levels(lines)
    runs = longest_copies(levels, least)
    starts = [] if runs is None else [runs.where(F.col("length") >= least).select("place", "length", F.lit(least).alias("sure"))]
    if levels and long_words is not None and least > 1:
        starts.append(levels[0].where("long and place > first").select("place", F.lit(1).alias("length"), F.lit(1).alias("sure")))
    if not starts:
        return firsts.where("copied").select("*", F.lit(None).cast("array<int>").alias("deleted"), F.lit(None).cast("int").alias("longest"))
    found = starts[0] if len(starts) == 1 else starts[0].unionByName(starts[1])
    # what follows a start within its run is a start as well, down to the last ``least`` lines
    every = found.select("length", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("sure") - 1)).alias("place")).groupBy("place").agg(F.max("length").alias("length"))
    gone = every.join(levels[0].select("place", "t", "at").hint("merge"), "place").groupBy("t").agg(F.array_sort(F.collect_list("at")).alias("deleted"), F.max("length").cast("int").alias("longest"))
    return settle(firsts.join(gone.hint("merge"), "t", "left").where("copied or deleted is not null"))


def dedup_lines(docs: DataFrame, least: int = LEAST_LINES, into: str = "line_dedup", long_words: int | None = None) -> DataFrame:
    """``docs`` with deleted lines cut from ``text``, and a struct ``into``.

    n_lines (with a word), n_deleted, n_runs (stretches deleted), longest_run (lines of the
    longest stretch) and copied (lines of the longest run that stands at one earlier place; 0
    where nothing is deleted).  With ``long_words``, a line of so many words or more is a run by
    itself, so each of its later copies goes whatever stands beside it.  Lines without a word
    stay.  Null and empty texts stay as they are.  Other columns pass through; ``into`` must not
    be one of them.
    """
    free(docs, into)
    gone = deleted_lines(docs, least, long_words)
    key, hit, split, full, cut = (fresh(docs, n) for n in ("text_key", "gone_lines", "all_lines", "full_lines", "cut_lines"))
    mine = docs.withColumn(key, text_digest(F.col("text")))
    touched = may_hold(bitmap(gone.select(F.col("t.a").alias("h"))), F.col(key)["a"])
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    out = lambda text, *fields: [*(c for c in docs.columns if c != "text"), text.alias("text"), F.struct(*(f.cast("long").alias(n) for f, n in zip(fields, ("n_lines", "n_deleted", "n_runs", "longest_run", "copied")))).alias(into)]
    zero = F.lit(0)
    n_all = F.coalesce(F.size(F.filter(F.split(F.col("text"), "\n", -1), has_word)), zero)
    rest = mine.where(~F.coalesce(touched, F.lit(False))).select(*out(F.col("text"), n_all, zero, zero, zero, zero))

    g = gone.select(F.struct("*").alias(hit))
    wide = mine.where(touched).join(g.hint("merge"), mine[key] == g[hit]["t"], "left").withColumn(split, F.split(F.col("text"), "\n", -1))
    # numbers of the lines with a word
    wide = wide.withColumn(full, F.filter(F.transform(F.col(split), lambda x, i: F.when(has_word(x), i)), lambda i: i.isNotNull()))
    # the text's own row has no null: a row of a later document is a copy as a whole
    later = F.coalesce(F.col(hit)["copied"] & (F.struct(F.col("doc_id").isNull(), F.col("doc_id")) != F.struct(F.col(hit)["first"]["no_id"], F.col(hit)["first"]["doc_id"])), F.lit(False))
    n = F.size(full)
    none = F.array().cast("array<int>")
    all_of_it = F.when(n == 0, none).otherwise(F.sequence(zero, n - 1))
    alone = F.filter(all_of_it, lambda at: _long(F.get(F.col(split), F.get(F.col(full), at)), long_words))
    wide = wide.withColumn(cut, F.when(later, F.when(n >= least, all_of_it).otherwise(alone)).otherwise(F.coalesce(F.col(hit)["deleted"], none)))
    cuts = F.col(cut)
    stay = F.array_except(F.sequence(zero, F.size(split) - 1), F.transform(cuts, lambda at: F.get(F.col(full), at)))
    text = F.when(F.size(cuts) == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(split), i)), "\n"))
    begin = F.struct(F.lit(-2).alias("at"), zero.alias("now"), zero.alias("longest"), zero.alias("runs"))

    def step(s: Column, at: Column) -> Column:
        follows = s["at"] + 1 == at
        now = F.when(follows, s["now"] + 1).otherwise(1)
        return F.struct(at.alias("at"), now.alias("now"), F.greatest(s["longest"], now).alias("longest"), (s["runs"] + F.when(follows, 0).otherwise(1)).alias("runs"))

    stretches = F.aggregate(cuts, begin, step)
    longest = F.when(F.size(cuts) == 0, zero).when(later & (n >= least), n).when(later, F.lit(1)).otherwise(F.col(hit)["longest"])
    return wide.select(*out(text, n, F.size(cuts), stretches["runs"], stretches["longest"], longest)).unionByName(rest)


def drop_repeated_lines(docs: DataFrame, least: int = LEAST_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``docs`` without later copies of line runs and of long lines, same columns.

    A document whose every line is a later copy is a copy as a whole and goes.
    """
    name = fresh(docs, "line_dedup")
    out = dedup_lines(docs, least, name, long_words)
    whole = (F.col(name)["n_deleted"] > 0) & (F.col(name)["n_deleted"] == F.col(name)["n_lines"])
    return out.where(~whole).select(*docs.columns)


LINE_SQL = r"""
WITH d AS (
  SELECT doc_id, text, md5(coalesce(text, '')) AS t, string_split(text, chr(10)) AS lines FROM documents
), n AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, t) AS doc FROM (SELECT doc_id, t, any_value(lines) AS lines FROM d GROUP BY doc_id, t)
), l AS (
  SELECT doc, lines, unnest(range(len(lines))) AS line FROM n
), s AS (
  SELECT doc, line, lines[line + 1] AS body, len(regexp_extract_all(lines[line + 1], '[^\x20\x09-\x0D]+')) >= 20 AS long, row_number() OVER (PARTITION BY doc ORDER BY line) AS pos
  FROM l WHERE regexp_matches(lines[line + 1], '[^\x20\x09-\x0D]')
), pairs AS (
  SELECT x.doc, x.pos, y.doc AS of_doc, x.pos - y.pos AS shift
  FROM s x JOIN s y ON x.body = y.body AND (y.doc < x.doc OR (y.doc = x.doc AND y.pos < x.pos))
), islands AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc, of_doc, shift ORDER BY pos) AS island FROM pairs
), ends AS (
  SELECT doc, pos, max(pos) OVER (PARTITION BY doc, of_doc, shift, island) + 1 AS past FROM islands
), longest AS (
  SELECT e.doc, e.pos, max(past - e.pos) AS length FROM ends e JOIN s ON s.doc = e.doc AND s.pos = e.pos GROUP BY ALL HAVING max(past - e.pos) >= 2 OR bool_or(s.long)
), gone AS (
  SELECT DISTINCT doc, pos + o AS pos FROM longest, (VALUES (0), (1)) AS v(o) WHERE o = 0 OR length >= 2
), summed AS (
  SELECT doc, sum(n) AS n_deleted, count(*) AS n_runs, max(n) AS longest_run
  FROM (SELECT doc, run, count(*) AS n FROM (SELECT doc, pos - row_number() OVER (PARTITION BY doc ORDER BY pos) AS run FROM gone) GROUP BY ALL) GROUP BY ALL
), copied AS (
  SELECT doc, max(length) AS copied FROM longest GROUP BY ALL
), rebuilt AS (
  SELECT l.doc, string_agg(l.lines[l.line + 1], chr(10) ORDER BY l.line) FILTER (g.pos IS NULL) AS text
  FROM l LEFT JOIN s ON l.doc = s.doc AND l.line = s.line LEFT JOIN gone g ON s.doc = g.doc AND s.pos = g.pos
  GROUP BY ALL
)
SELECT d.doc_id, CASE WHEN x.n_deleted > 0 THEN coalesce(r.text, '') ELSE d.text END AS text,
       CAST(coalesce(len(list_filter(d.lines, lambda e: regexp_matches(e, '[^\x20\x09-\x0D]'))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(x.n_deleted, 0) AS BIGINT) AS n_deleted, CAST(coalesce(x.n_runs, 0) AS BIGINT) AS n_runs,
       CAST(coalesce(x.longest_run, 0) AS BIGINT) AS longest_run, CAST(coalesce(c.copied, 0) AS BIGINT) AS copied
FROM d JOIN n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.t = n.t
       LEFT JOIN summed x ON n.doc = x.doc LEFT JOIN copied c ON n.doc = c.doc LEFT JOIN rebuilt r ON n.doc = r.doc
"""
