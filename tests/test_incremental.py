"""Paged sources, huge arrays, keyed merging in batches: restarts, borders and replays."""

import glob
import gzip
import json
import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import merging
from lodestrata.plans import incremental_queries
from lodestrata.sources import arrays, paged
from lodestrata.streaming.keyed import CursorTable, KeyedTable, Summary

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def changes(spark):
    """Records of 500 minutes, none in some hours."""
    rows = spark.range(500).where("id % 180 < 100")
    return rows.select((F.lit(START) + F.expr("make_interval(0, 0, 0, 0, 0, id)")).alias("modified"), F.to_json(F.struct(F.concat(F.lit("CVE-"), "id").alias("id"))).alias("record"))


def feed(spark, path, stream=False, **options):
    spark.dataSource.register(paged.PagedFeed)
    return (spark.readStream if stream else spark.read).format("paged_feed").options(path=path, start=START.isoformat(), **options).load()


def test_pages_are_read_once(spark, changes, tmp_path):
    paged.record_pages(changes, f"{tmp_path}/p", START, 1, 7)
    want = sorted(r.record for r in changes.collect())
    for pages in (1, 3, 100):
        got = feed(spark, f"{tmp_path}/p", pages=str(pages))
        assert sorted(r.record for r in got.collect()) == want
        assert got.where("unix_timestamp(window_end) - unix_timestamp(window_start) <> 3600").isEmpty()
    parts = paged.page_ranges(paged.RecordedPages(f"{tmp_path}/p"), paged.RecordedPages(f"{tmp_path}/p").windows(round(START.timestamp() * 1000), None), 3)
    assert len(parts) > len({p.window for p in parts}) == 8  # full windows are several tasks' work
    until = feed(spark, f"{tmp_path}/p", end="2024-01-01T02:30:00+00:00")
    assert until.count() == 100  # whole windows only


def test_stream_goes_on_where_it_stopped(spark, changes, tmp_path):
    first, second = changes.where(F.col("modified") < F.lit("2024-01-01 04:00:00").cast("timestamp")), changes.where(F.col("modified") >= F.lit("2024-01-01 04:00:00").cast("timestamp"))

    def run():
        q = feed(spark, f"{tmp_path}/p", stream=True).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.record for r in spark.read.parquet(f"{tmp_path}/out").collect())

    paged.record_pages(first, f"{tmp_path}/p", START, 1, 9)
    assert run() == sorted(r.record for r in first.collect())
    assert run() == sorted(r.record for r in first.collect())  # nothing new
    # a gap: what follows has to wait
    paged.record_pages(second.where(F.col("modified") >= F.lit("2024-01-01 06:00:00").cast("timestamp")), f"{tmp_path}/p", datetime(2024, 1, 1, 6, tzinfo=timezone.utc), 1, 9)
    assert run() == sorted(r.record for r in first.collect())
    paged.record_pages(second.where(F.col("modified") < F.lit("2024-01-01 06:00:00").cast("timestamp")), f"{tmp_path}/p", datetime(2024, 1, 1, 4, tzinfo=timezone.utc), 2, 9)
    assert run() == sorted(r.record for r in changes.collect()) == sorted(r.record for r in feed(spark, f"{tmp_path}/p").collect())


def test_many_pages_lie_in_few_files_and_are_few_tasks_work(spark, changes, tmp_path, monkeypatch):
    monkeypatch.setattr(paged, "PAGES_PER_FILE", 20, raising=False)
    monkeypatch.setattr(paged, "SLICES", 7, raising=False)
    monkeypatch.setattr(paged, "TASKS", 10, raising=False)
    paged.record_pages(changes, f"{tmp_path}/p", START, 1, 2)
    files = glob.glob(f"{tmp_path}/p/window=*/start_index=*/*.txt")
    windows = {os.path.dirname(os.path.dirname(f)) for f in files}
    assert len(windows) == 8 and len(files) <= 2 * len(windows) < changes.count() / 10  # 30 pages of a full window
    source = paged.RecordedPages(f"{tmp_path}/p")
    parts = paged.page_ranges(source, source.windows(round(START.timestamp() * 1000), None), 1)
    assert len(parts) <= 10 + len(windows)
    want = [r.record for r in changes.orderBy("modified", "record").collect()]
    assert [r[4] for part in parts for r in paged.read_range(source, part)] == want
    rows = feed(spark, f"{tmp_path}/p", pages="1").collect()
    assert [r.record for r in sorted(rows, key=lambda r: (r.window_start, r.start_index, r.place))] == want


def test_a_batch_of_the_stream_is_few_tasks_work(changes, tmp_path, monkeypatch):
    monkeypatch.setattr(paged, "TASKS", 10, raising=False)
    paged.record_pages(changes, f"{tmp_path}/p", START, 1, 2)
    stream = paged.PagedStream(paged.RecordedPages(f"{tmp_path}/p"), round(START.timestamp() * 1000), None, 1)
    parts = stream.partitions(stream.initialOffset(), stream.latestOffset())
    assert len(parts) <= 10 + 8 and sum(b.num_rows for p in parts for b in stream.read(p)) == changes.count()


def test_numbering_and_pages_take_no_window_as_one_group(spark, tmp_path, monkeypatch):
    plans, text = [], type(spark.range(1).write).text
    same_moment = spark.range(30).select(F.lit(START).alias("modified"), F.format_string('{"id":"%02d"}', "id").alias("record"))
    later = spark.range(30).select((F.lit(START) + F.expr("interval 50 minutes")).alias("modified"), F.format_string('{"id":"x%02d"}', "id").alias("record"))
    monkeypatch.setattr(type(spark.range(1).write), "text", lambda w, *a, **k: plans.append(w._df._jdf.queryExecution().optimizedPlan().toString()) or text(w, *a, **k))
    paged.record_pages(later.unionByName(same_moment), f"{tmp_path}/p", START, 1, 7)
    ranked = [x for x in plans[0].splitlines() if "row_number" in x and "Window" in x]
    assert len(ranked) == 1 and "slice" in ranked[0] and "LeftOuter" not in plans[0]
    source = paged.RecordedPages(f"{tmp_path}/p")
    assert [json.loads(r[4])["id"] for p in paged.page_ranges(source, [(round(START.timestamp() * 1000), round(START.timestamp() * 1000) + 3_600_000)], 2) for r in paged.read_range(source, p)] == [f"{i:02}" for i in range(30)] + [f"x{i:02}" for i in range(30)]


def test_an_answer_in_a_folder_of_its_own(tmp_path):
    for at, ids in ((0, [1, 2]), (2, [3])):
        os.makedirs(f"{tmp_path}/p/window=0-10/start_index={at}")
        with open(f"{tmp_path}/p/window=0-10/start_index={at}/a.json", "w") as f:
            json.dump({"totalResults": 3, "vulnerabilities": [{"cve": i} for i in ids]}, f)
    source = paged.RecordedPages(f"{tmp_path}/p")
    assert [r[2:] for part in paged.page_ranges(source, source.windows(0, None), 1) for r in paged.read_range(source, part)] == [(0, 0, "1"), (0, 1, "2"), (2, 0, "3")]
    with pytest.raises(OSError):
        source.page((0, 10), 1)


class Answers:
    """A source whose pages are shorter than asked for, and whose last page is empty."""

    def __init__(self, sizes, total):
        self.sizes, self.total, self.asked = sizes, total, []

    def page(self, window, start_index):
        self.asked.append(start_index)
        at = 0
        for n in [*self.sizes, 0]:
            if at == start_index:
                return {"totalResults": self.total, "vulnerabilities": [{"cve": {"n": at + k}} for k in range(n)]}
            at += n
        return {"totalResults": self.total, "vulnerabilities": []}


@pytest.mark.parametrize("sizes,total", [([5, 5, 2], 12), ([4, 4], 12), ([], 0), ([3], 3)])
def test_pages_end_at_the_total_or_an_empty_page(sizes, total):
    source = Answers(sizes, total)
    rows = [json.loads(r[4])["n"] for part in paged.page_ranges(source, [(0, 1000)], 100) for r in paged.read_range(source, part)]
    assert rows == list(range(sum(sizes)))


def test_refused_options(spark, changes, tmp_path):
    with pytest.raises(ValueError):
        paged.record_pages(changes, f"{tmp_path}/p", datetime(2024, 1, 1), 1, 7)
    with pytest.raises(Exception, match="time zone"):
        spark.dataSource.register(paged.PagedFeed)
        spark.read.format("paged_feed").options(path="x", start="2024-01-01T00:00:00").load().collect()


def nested(r, depth):
    kind = r.randrange(6)
    if depth == 0 or kind < 2:
        return r.choice(['a"b', "x}{y", "\\", '\\\\"', "é[}", "", '",][', 1, None, "}}}", "\\}"])
    return [nested(r, depth - 1) for _ in range(r.randint(0, 3))] if kind < 4 else {str(i) + '"': nested(r, depth - 1) for i in range(r.randint(0, 3))}


@pytest.mark.parametrize("block", ["250", "10000000"])
def test_objects_of_arrays_over_any_blocks(spark, tmp_path, block):
    r, want = random.Random(4), {}
    for f in range(4):
        items = [{"cve": {"id": i, "v": nested(r, 3)}} if r.random() < 0.9 else nested(r, 2) for i in range(25)]
        document = {"format": "x", "other": [{"no": 1}, {"deep": [{"vulnerabilities": [{"q": 1}]}]}], "vulnerabilities": items, "z": [{"k": 2}], "vuln": {"vulnerabilities": [{"bad": 1}]}}
        text, name = json.dumps(document, ensure_ascii=bool(f % 2), indent=None if f < 2 else 1), f"{tmp_path}/f{f}.json"
        if f == 3:
            with gzip.open(name + ".gz", "wt") as file:
                file.write(text)
        else:
            with open(name, "w") as file:
                file.write(text)
        want[f"f{f}"] = sorted(json.dumps(x, sort_keys=True) for x in items if isinstance(x, dict))
    for name, text in (("empty", ""), ("none", '{"a": [{"b": 1}]}')):
        with open(f"{tmp_path}/{name}.json", "w") as file:
            file.write(text)
    with open(f"{tmp_path}/cut.json", "w") as file:
        file.write('{"vulnerabilities": [{"a": "' + "long " * 200 + '"}, {"b": [1, 2')
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = arrays.read_array(spark, str(tmp_path)).collect()
        cut = [x for x in rows if "/cut" in x.file]
        assert sum(x.whole for x in cut) == 1 and max(len(x.value) for x in cut if x.whole) > 1000
        assert all(x.whole for x in rows if "/cut" not in x.file)
        got = {f"f{f}": sorted(json.dumps(json.loads(x.value), sort_keys=True) for x in rows if f"/f{f}." in x.file) for f in range(4)}
        assert got == want and not [x for x in rows if "/empty" in x.file or "/none" in x.file]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_file_that_is_an_array(spark, tmp_path):
    with open(f"{tmp_path}/a.json", "w") as file:
        json.dump([{"a": [{"b": 1}]}, 3, [{"c": 1}], {"d": "]"}], file)
    assert [json.loads(r.value) for r in arrays.read_array(spark, f"{tmp_path}/a.json", None).collect()] == [{"a": [{"b": 1}]}, {"d": "]"}]


SCHEMA = "identifier string, source string, title string, summary string, published_at string, modified_at string, vendor string, severity string, kev boolean, cwes array<string>, references array<string>, arrived long"
SUMMARY = Summary(("severity", "vendor", "cwes"), ("cwes",))


def some_records(r, n):
    pick = lambda *x: r.choice(x)
    return [
        (pick("a", "b", "c", "d", "e", None), pick("nvd", "cisa-kev", "list"), pick(None, "", f"t{i}"), pick(None, "", f"s{i}"), pick(None, "", f"2020-{i}"), pick(None, f"2021-{i}"), pick(None, "n/a", f"v{i % 3}"), pick(None, "HIGH", "LOW"), pick(None, True, False),
         pick(None, [], [f"C{i % 4}", f"C{i % 3}"]), pick(None, [f"u{i % 5}", None]), i) for i in range(n)
    ]


def folded(rows):
    """Records merged one by one in the order of arrival."""
    out = {}
    for x in sorted(rows, key=lambda x: x[-1]):
        k, source, title, summary, published, modified, vendor, severity, kev, cwes, links, _ = x
        o = out.setdefault(k, {"sources": set(), "open": True, "kev_text": False, "title": None, "summary": None, "published_at": None, "modified_at": None, "vendor": None, "severity": None, "kev": None, "cwes": [], "references": []})
        if source == "cisa-kev":
            o["title"], o["summary"], o["kev_text"] = title, summary, True
        elif not o["kev_text"] and o["open"]:
            o["title"], o["summary"] = title, summary
        o["open"] = o["open"] and not summary
        o["sources"].add(source)
        o["published_at"] = o["published_at"] or published
        o["modified_at"] = max(filter(None, (o["modified_at"], modified)), default=None)
        o["vendor"] = vendor if vendor not in (None, "n/a") else o["vendor"]
        o["severity"] = severity or o["severity"]
        o["kev"] = kev if o["kev"] is None else o["kev"] or bool(kev)
        for name, values in (("cwes", cwes), ("references", links)):
            o[name] += [v for v in dict.fromkeys(values or []) if v not in o[name]]
    return {k: (o["published_at"] or None, o["modified_at"], o["vendor"], o["severity"], o["kev"], ",".join(sorted(o["sources"])), o["cwes"], o["references"]) for k, o in out.items()}


def plain(df):
    return {r.identifier: (r.published_at, r.modified_at, r.vendor, r.severity, r.kev, r.sources, r.cwes, r.references) for r in df.collect()}


def test_batches_in_any_order_and_twice(spark, tmp_path):
    r = random.Random(6)
    rows = some_records(r, 120)
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    whole = merging.merge_records(df(rows), "arrived")
    assert plain(whole) == folded(rows)
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "arrived", buckets=4)
    assert table.read().count() == 0 and table.apply(df([])) == []
    parts = [rows[i::4] for i in (2, 0, 3, 1)]
    for part in [*parts, parts[1], rows[:50]]:
        table.apply(df(part), SUMMARY)
    assert sorted(map(repr, table.read().select(*whole.columns).collect())) == sorted(map(repr, whole.collect()))
    # summaries count what the records are now, whatever they were
    want = {("all", ""): whole.count()}
    for c in ("severity", "vendor"):
        want |= {(c, x[c]): x["count"] for x in whole.where(F.col(c) != "").groupBy(c).count().collect()}
    cwes = whole.select(F.explode("cwes").alias("c")).groupBy("c").count().collect()
    want |= {("cwes", x["c"]): x["count"] for x in cwes} | {("distinct cwes", ""): len(cwes)}
    partial = table.summaries(SUMMARY)
    assert {(x.facet, x.value): x.n for x in Summary.totals(partial).collect()} == want
    top = Summary.top(partial, "vendor", 1).first()
    assert top.n == max(n for (f, _), n in want.items() if f == "vendor")


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "identifier string, source string, title string, arrived long", "arrived", buckets=16)
    row = lambda k, n: (f"k{k}", "nvd", f"t{n}", n)
    schema = table.schema
    table.apply(spark.createDataFrame([row(k, 0) for k in range(200)], schema), Summary(("title",)))
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/t/*/bucket=*/*.parquet")}
    before = files()
    touched = table.apply(spark.createDataFrame([row(3, 1), row(3, 2)], schema), Summary(("title",)))
    assert len(touched) == 1
    stayed = {f for f in before if f"bucket={touched[0]}/" not in f}
    assert len(stayed) >= 15 and all(files().get(f) == before[f] for f in stayed)
    assert table.read().count() == 200


def test_cursors(spark, tmp_path):
    cursors = CursorTable(spark, f"{tmp_path}/c")
    assert cursors.read().count() == 0 and cursors.of("nvd") is None
    save = lambda run, *rows: cursors.save(spark.createDataFrame(rows, "source string, cursor string"), run)
    save("a", ("nvd", "2024-01-02T00:00:00+00:00"), ("kev", "2024-01-01T00:00:00+00:00"))
    save("b", ("nvd", "2024-01-01T00:00:00+00:00"))
    save("b", ("nvd", "2024-01-01T00:00:00+00:00"))
    assert cursors.of("nvd") == datetime(2024, 1, 2, tzinfo=timezone.utc) and cursors.read().count() == 2


def test_a_record_of_the_feed_is_parsed_once(spark):
    records = spark.createDataFrame([(START, '{"id":"CVE-12","lastModified":"2024-01-01"}')], "window_end timestamp, record string")
    rows = incremental_queries._identified(records).join(spark.range(20).withColumnRenamed("id", "o_orderkey"), "o_orderkey")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "get_json_object" not in plan  # the join's filter on the key does not parse again
    assert [(r.o_orderkey, r.lastModified) for r in rows.collect()] == [(12, "2024-01-01")]
