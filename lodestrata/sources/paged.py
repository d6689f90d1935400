"""A source that answers in pages of time windows, as a Spark data source for batch and stream.

Records changed in a window of time are asked for page by page: each answer says how many records
the window has (``totalResults``) and brings some of them from an offset on (``startIndex``).  A
task reads a range of pages of one window, so neither a long history nor a full window is one
task's work; the answers of one file are all that a task holds.  As a stream, the offset is the end of the last
window read: windows are taken in once, in order, and a restart goes on after the last one
committed.

Answers come from an ``Exchange``.  ``RecordedPages`` reads them from a folder where each is a
line of JSON (milliseconds since 1970), in any order within
``window=<start>-<end>/start_index=<n>``, which holds the window's answers from ``n`` up to the
next such folder.  Any store that Arrow reads will do; Spark itself writes such folders
(``record_pages``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from itertools import islice
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lodestrata.operators.storage import scratch, settle

SCHEMA = "window_start timestamp, window_end timestamp, start_index int, place int, record string"
#: Pages that a task reads one after the other, at least.
PAGES_PER_TASK = 50
#: Tasks of one reading: with more pages a task reads more of them.
TASKS = 256
#: Answers that are recorded in one file.
PAGES_PER_FILE = 50
#: Equal parts of a window's time in which its records are numbered.
SLICES = 1024


_record = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


class Exchange(Protocol):
    def windows(self, since: int, until: int | None) -> list[tuple[int, int]]:
        """(start, end) of the windows that can be asked for, without gaps from ``since`` on."""

    def page(self, window: tuple[int, int], start_index: int) -> dict:
        """The answer with the window's records from ``start_index`` on."""


@dataclass(frozen=True)
class RecordedPages:
    """Recorded answers in a folder; those of the file read last are held."""

    path: str
    _held: dict = field(default_factory=dict, compare=False, repr=False)

    def __reduce__(self):
        return RecordedPages, (self.path,)

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def windows(self, since: int, until: int | None) -> list[tuple[int, int]]:
        from pyarrow import fs

        self._held.clear()
        store, base = self._open()
        names = (re.fullmatch(r"window=(\d+)-(\d+)", f.base_name) for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)))
        out, at = [], since
        for start, end in sorted((int(m[1]), int(m[2])) for m in names if m):
            if start == at and (until is None or end <= until):  # what follows a gap has to wait
                out.append((start, end))
                at = end
        return out

    def page(self, window: tuple[int, int], start_index: int) -> dict:
        if (window, start_index) not in self._held:
            self._held.clear()
            self._held.update({(window, n): line for n, line in self._file(window, start_index)})
        if (window, start_index) not in self._held:
            raise OSError(f"no recorded answer from {start_index} on for window {window} in {self.path}")
        return json.loads(self._held[window, start_index])

    def _file(self, window: tuple[int, int], start_index: int) -> Iterator[tuple[int, bytes]]:
        """The answers of the file that has to hold ``start_index``, each with its own."""
        from pyarrow import fs

        store, base = self._open()
        folder = f"{base}/window={window[0]}-{window[1]}"
        names = (re.fullmatch(r"start_index=(\d+)", f.base_name) for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)))
        first = max((n for n in (int(m[1]) for m in names if m) if n <= start_index), default=start_index)
        folder = f"{folder}/start_index={first}"
        files = [f for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        if len(files) != 1:
            raise OSError(f"{len(files)} files of recorded answers in {folder}")
        with store.open_input_stream(files[0].path) as f:
            for line in f.read().splitlines():
                told = re.match(rb'\{"resultsPerPage":\d+,"startIndex":(\d+),', line)  # as recorded here: no need to parse
                yield int(told[1]) if told else int(json.loads(line).get("startIndex", first)), line


@dataclass
class PageRange(InputPartition):
    window: tuple[int, int]
    begin: int
    end: int | None  # None: to the window's last record

    def __post_init__(self) -> None:
        super().__init__(None)


def page_ranges(exchange: Exchange, windows: list[tuple[int, int]], pages: int) -> list[PageRange]:
    """Ranges of about ``pages`` pages, of more if there were over ``TASKS`` ranges; the first answer of each window tells how much there is."""
    sizes = []
    for window in windows:
        first = exchange.page(window, 0)
        received = len(first.get("vulnerabilities", []))
        sizes.append((received, int(first.get("totalResults", received))))
    pages = max(pages, -(-sum(-(-total // received) for received, total in sizes if received) // TASKS))
    out = []
    for window, (received, total) in zip(windows, sizes):
        step = max(1, received * pages)
        cuts = list(range(0, max(total, 1), step)) if received else [0]
        out += [PageRange(window, a, b) for a, b in zip(cuts, [*cuts[1:], None])]
    return out


def read_range(exchange: Exchange, part: PageRange) -> Iterator[tuple]:
    """The records of a range, page by page until the window's total is reached or a page is empty."""
    start, end = (datetime.fromtimestamp(ms / 1000, timezone.utc) for ms in part.window)
    at = part.begin
    while part.end is None or at < part.end:
        answer = exchange.page(part.window, at)
        items = answer.get("vulnerabilities", [])
        most = len(items) if part.end is None else part.end - at
        for place, item in enumerate(items[:most]):
            yield start, end, at, place, _record(item.get("cve", item))
        at += len(items)
        if not items or at >= int(answer.get("totalResults", at)):
            return


def batches(rows: Iterator[tuple], size: int = 10_000) -> Iterator:
    """Rows of ``SCHEMA`` as Arrow batches, which Spark takes without looking at each value."""
    import pyarrow as pa

    time = pa.timestamp("us", "UTC")
    schema = pa.schema([("window_start", time), ("window_end", time), ("start_index", pa.int32()), ("place", pa.int32()), ("record", pa.string())])
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _milliseconds(text: str | None) -> int | None:
    if text is None:
        return None
    t = datetime.fromisoformat(text)
    if t.tzinfo is None:
        raise ValueError("both ends need a time zone")
    return round(t.timestamp() * 1000)


class PagedFeed(DataSource):
    """Options: path (of the recorded answers), start and end (times with a zone; end may lack), pages (of a task, at least)."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return SCHEMA

    def _parts(self) -> tuple[Exchange, int, int | None, int]:
        o = self.options
        start, end = _milliseconds(o.get("start")), _milliseconds(o.get("end"))
        if start is None or "path" not in o:
            raise ValueError("options path and start are needed")
        return RecordedPages(o["path"]), start, end, int(o.get("pages", PAGES_PER_TASK))

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(*self._parts())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStream(*self._parts())


class PagedReader(DataSourceReader):
    def __init__(self, exchange: Exchange, start: int, end: int | None, pages: int):
        self.exchange, self.start, self.end, self.pages = exchange, start, end, pages

    def partitions(self) -> list[PageRange]:
        return page_ranges(self.exchange, self.exchange.windows(self.start, self.end), self.pages)

    def read(self, partition: PageRange) -> Iterator:
        return batches(read_range(self.exchange, partition)) if partition.window else iter(())


class PagedStream(DataSourceStreamReader):
    """The offset is the end of the last window taken in."""

    def __init__(self, exchange: Exchange, start: int, end: int | None, pages: int):
        self.exchange, self.start, self.end, self.pages = exchange, start, end, pages

    def initialOffset(self) -> dict:
        return {"until": self.start}

    def latestOffset(self) -> dict:
        windows = self.exchange.windows(self.start, self.end)
        return {"until": windows[-1][1] if windows else self.start}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        return page_ranges(self.exchange, self.exchange.windows(start["until"], end["until"]), self.pages)

    def read(self, partition: PageRange) -> Iterator:
        return batches(read_range(self.exchange, partition))


def record_pages(records: DataFrame, path: str, start: datetime, hours: int, page_size: int) -> None:
    """Write ``records`` (modified, a time; record, JSON) as the answers that a source would give for its windows.

    Each window of ``hours`` from ``start`` to the last record has its pages, an empty one a page
    without records.  Records are numbered within their window by (modified, record): in slices of
    its time, each of which begins where those before it end, so no window is one task's work.
    """
    if start.tzinfo is None or not 1 <= hours <= 2880 or page_size < 1:
        raise ValueError("a start with a time zone, windows of 1 to 2880 hours and pages of one record or more")
    size, origin = hours * 3_600_000, round(start.timestamp() * 1000)
    since = F.unix_millis(F.col("modified").cast("timestamp")) - origin
    inside = records.withColumn("n", F.floor(since / size)).where("n >= 0").withColumn("slice", F.floor((since - F.col("n") * size) * SLICES / size))
    key = ["n", "slice"]
    with scratch(records.sparkSession):
        window = Window.partitionBy("n")  # of a row for each slice
        counts = inside.groupBy(*key).agg(F.count("*").alias("count"))
        slices = settle(counts.select(*key, (F.sum("count").over(window.orderBy("slice")) - F.col("count")).alias("before"), F.sum("count").over(window).alias("total")))
        at = F.row_number().over(Window.partitionBy(*key).orderBy("modified", "record")) - 1
        numbered = inside.withColumn("at", at).join(slices, key).withColumn("at", F.col("before") + F.col("at")).withColumn("page", F.floor(F.col("at") / page_size))
        item = F.struct("at", F.concat(F.lit('{"cve":'), "record", F.lit("}")).alias("item"))
        filed = numbered.select("n", F.floor(F.col("page") / PAGES_PER_FILE).alias("file"), "page", "total", item.alias("item")).repartition("n", "file")
        items = F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["item"]), ",")  # of a page's size
        pages = filed.groupBy("n", "file", "page").agg(F.max("total").alias("total"), items.alias("items"), F.count("*").alias("received"))
        last = slices.agg(F.max("n")).first()[0]
        every = records.sparkSession.range(0, -1 if last is None else last + 1).withColumnRenamed("id", "n")
        zero = F.lit(0).cast("long")
        empty = every.join(slices, "n", "left_anti").select("n", zero.alias("file"), zero.alias("page"), zero.alias("total"), F.lit("").alias("items"), zero.alias("received"))
        whole = pages.unionByName(empty)
        begin = (F.lit(origin) + F.col("n") * size).cast("string")
        answer = F.concat(F.lit('{"resultsPerPage":'), F.col("received"), F.lit(',"startIndex":'), F.col("page") * page_size, F.lit(',"totalResults":'), F.col("total"), F.lit(',"vulnerabilities":['), "items", F.lit("]}"))
        out = whole.select(answer.alias("value"), F.concat(begin, F.lit("-"), (F.lit(origin) + (F.col("n") + 1) * size).cast("string")).alias("window"), (F.col("file") * PAGES_PER_FILE * page_size).alias("start_index"))
        out.write.partitionBy("window", "start_index").mode("append").text(path)
