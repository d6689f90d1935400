"""Objects of one huge JSON array in a file, read in blocks of bounded size by many tasks.

Spark's text reader cuts files into blocks of bytes, and blocks into pieces at closing braces, so
no file and no line has to fit into a task.  What a block means depends on where it begins:
within a string or not, and how deep.  Both are found by composing what each block does to them:
a first scan gives, for each block, whether it has an odd number of quotes and how it changes the
depth from either start; sums over the blocks before then give its true start.  A second scan
gives the arrays opened and the objects that lie across blocks, a third the objects within them.
Compressed files are one block each, read as a stream.

Defined results: a file without the array has no rows; members of the array that are no objects
are passed over; an object that never ends (a file cut off) has a row with ``whole`` false;
empty files have no rows.  A key that holds a closing brace is not recognised.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators.storage import settle

_SIGN = np.zeros(256, np.int8)
_SIGN[[0x7B, 0x5B]], _SIGN[[0x7D, 0x5D]] = 1, -1
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z')
_TAIL = 4096  # bytes before an array's bracket in which its key stands
#: Blocks whose starts are sent to all tasks, about 100 bytes each; at 128 MB a block that is 128 TB.
MOST_BLOCKS = 1 << 20


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block (its first byte) and value of each piece, in the order of the file within a task."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(columns but the value, bytes) of consecutive pieces of one block, their braces put back."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index("value")).cast(pa.large_binary())
        others = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "value"]
        keys = list(zip(*(c.to_pylist() for c in others)))
        at = 0
        for key, same in groupby(keys):
            n = len(list(same))
            yield key, np.frombuffer(b"}".join([*(v.as_py() for v in values.slice(at, n)), b""]), np.uint8)
            at += n


def _quotes(b: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that no odd number of backslashes stands before."""
    quote = b == 0x22
    back = np.flatnonzero(b == 0x5C)
    if len(back):
        starts = back[np.flatnonzero(np.diff(back, prepend=-2) != 1)]
        ends = back[np.flatnonzero(np.diff(back, append=len(b) + 1) != 1)]
        odd = ends[(ends - starts) % 2 == 0] + 1
        odd = odd[odd < len(b)]
        quote[odd] = False
    return quote


def _depths(b: np.ndarray, in_string: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign of each structural bracket (0 for other bytes and within strings), and the depth after each byte."""
    inside = (np.cumsum(_quotes(b)) + in_string) % 2 == 1
    sign = np.where(inside, 0, _SIGN[b])
    return sign, depth + np.cumsum(sign, dtype=np.int64)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, list[int]] = {}
    for key, b in _runs(batches):
        effect = found.setdefault(key, [0, 0, 0])
        odd = (np.cumsum(_quotes(b)) + effect[0]) % 2
        effect[1] += int(_SIGN[b][odd == 0].sum())
        effect[2] += int(_SIGN[b][odd == 1].sum())
        effect[0] = int(odd[-1]) if len(b) else effect[0]
    if found:
        yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*found)), *(pa.array(x, pa.int64()) for x in zip(*found.values()))], ["file", "block", "odd", "outside", "within"])


def _block_starts(pieces: DataFrame) -> DataFrame:
    """in_string and depth at the beginning of each block: sums over the blocks before it in its file."""
    effects = pieces.mapInArrow(_effects, "file string, block long, odd long, outside long, within long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = effects.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    return known.withColumn("depth", F.coalesce(F.sum(F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("within"))).over(before), F.lit(0))).select("file", "block", "in_string", "depth")


class _Block:
    """Walks the bytes of one block: objects at the wanted depth, arrays opened above them, pieces at its ends."""

    def __init__(self, in_string: int, depth: int, array: bytes | None, level: int):
        self.in_string, self.depth, self.array, self.level = in_string, depth, array, level
        self.before = b""  # the end of what was walked
        self.object: list[bytes] | None = None  # the parts of the object that is open
        self.head: list[bytes] | None = [] if depth >= level + 2 else None  # while no object of this block is open or closed
        self.heads: list[bytes] = []

    def walk(self, b: np.ndarray) -> Iterator[tuple[bytes | None, bytes]]:
        """(name of the array, object) of each object that ends in ``b`` and began in the block."""
        sign, depth = _depths(b, self.in_string, self.depth)
        raw = b.tobytes()
        level = self.level
        opened = (sign == 1) & (b == 0x5B) & (depth == level + 1)
        begins = (sign == 1) & (b == 0x7B) & (depth == level + 2)
        ends = (sign == -1) & (b == 0x7D) & (depth == level + 1)
        at = 0
        for i in np.flatnonzero(opened | begins | ends).tolist():
            if opened[i]:
                key = _KEY.search(self.before + raw[max(0, i - _TAIL) : i]) if level else None
                self.array = (key[1] if key else b"") if level else b""
            elif begins[i]:
                self.object, at = [], i
                self.head = None
            elif self.object is not None:
                yield self.array, b"".join([*self.object, raw[at : i + 1]])
                self.object = None
            elif self.head is not None:  # it began in an earlier block
                self.heads = [*self.head, raw[at : i + 1]]
                self.head = None
        if self.object is not None:
            self.object.append(raw[at:])
        elif self.head is not None:
            self.head.append(raw)
        self.in_string = int((self.in_string + _quotes(b).sum()) % 2)
        self.depth = int(depth[-1]) if len(b) else self.depth
        self.before = (self.before + raw[-_TAIL:])[-_TAIL:]


def _borders(level: int):
    """What a block leaves to others: the last array opened, and the parts of objects across its ends."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walked: dict[tuple, _Block] = {}
        for key, b in _runs(batches):
            block = walked.setdefault(key, _Block(key[2], key[3], None, level))
            for _ in block.walk(b):
                pass
        for (file, number, *_), block in walked.items():
            tail = b"".join(block.object) if block.object is not None else None
            through = b"".join(block.head) if block.head is not None else None  # neither begins nor ends here
            head = b"".join(block.heads) if block.heads else None
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((file, pa.string()), (number, pa.int64()), (block.array, pa.binary()), (head, pa.binary()), (through, pa.binary()), (tail, pa.binary()))], ["file", "block", "array", "head", "through", "tail"])

    return find


def _objects(level: int, key: bytes):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walked: dict[tuple, _Block] = {}
        for (file, number, in_string, depth, array), b in _runs(batches):
            if (file, number) not in walked:
                walked = {(file, number): _Block(in_string, depth, array, level)}
            rows = [o for name, o in walked[file, number].walk(b) if name == key]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array([o.decode("utf-8", "replace") for o in rows], pa.string()), pa.array([True] * len(rows), pa.bool_())], ["file", "value", "whole"])

    return find


def read_array(spark: SparkSession, path: str, key: str | None = "vulnerabilities") -> DataFrame:
    """file, value (JSON of an object) and whole, for each object of the array below ``key`` of the file's object.

    Without ``key`` the file is the array itself.  Each block's start is a row that all tasks get:
    some hundred bytes for every ``spark.sql.files.maxPartitionBytes`` of input, which is to be
    raised where there are more than ``MOST_BLOCKS``.
    """
    level, name = (1, key.encode()) if key is not None else (0, b"")
    pieces = _pieces(spark, path)
    starts = settle(_block_starts(pieces))
    if (n := starts.count()) > MOST_BLOCKS:
        raise ValueError(f"{n} blocks: raise spark.sql.files.maxPartitionBytes")
    border_schema = "file string, block long, array binary, head binary, through binary, tail binary"
    borders = settle(pieces.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "in_string", "depth", "value").mapInArrow(_borders(level), border_schema))
    blocks = Window.partitionBy("file").orderBy("block")
    opened = borders.select("file", "block", F.last("array", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("array"), F.last("array", ignorenulls=True).over(blocks).alias("array_after"), "head", "through", "tail")
    states = settle(starts.join(opened.select("file", "block", "array"), ["file", "block"]))
    inner = pieces.join(F.broadcast(states), ["file", "block"]).select("file", "block", "in_string", "depth", "array", "value").mapInArrow(_objects(level, name), "file string, value string, whole boolean")
    # a tail begins an object, the blocks that it runs through and the next head follow
    parts = opened.where("head is not null or through is not null or tail is not null").withColumn("object", F.sum(F.col("tail").isNotNull().cast("int")).over(blocks))
    begun = parts.where("tail is not null").select("file", "object", "block", F.col("array_after").alias("array"), F.col("tail").alias("part"), F.lit(False).alias("ends"))
    # a block with a head and a tail ends one object and begins the next
    after = parts.select("file", (F.col("object") - F.col("tail").isNotNull().cast("int")).alias("object"), "block", F.lit(None).cast("binary").alias("array"), F.coalesce("head", "through").alias("part"), F.col("head").isNotNull().alias("ends")).where("part is not null and object > 0")
    # what comes after an object's end is no part of it
    ended = F.sum(F.col("ends").cast("int")).over(Window.partitionBy("file", "object").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    after = after.withColumn("ended", F.coalesce(ended, F.lit(0))).where("ended = 0").drop("ended")
    across = begun.unionByName(after).groupBy("file", "object").agg(F.max("array").alias("array"), F.transform(F.array_sort(F.collect_list(F.struct("block", F.base64("part").alias("part")))), lambda x: F.unbase64(x["part"])).alias("all"), F.bool_or("ends").alias("whole"))
    joined = F.aggregate("all", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return inner.unionByName(across.where(F.col("array") == F.lit(name)).select("file", F.decode(joined, "UTF-8").alias("value"), "whole"))
