"""Inventories of unpacked trees: files with digests, archive members as rows, budgets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """canonical_path, size, content_sha256 and content of every file below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:(?=/)", "")
    path = F.regexp_replace(F.col("path"), r"^[a-z]+:/*(?=/)", "")
    return files.select(F.ltrim(F.replace(path, base, F.lit("")), F.lit("/")).alias("canonical_path"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_sha256"), "content")


def archive_members(files: DataFrame, most_files: int = 10_000, most_bytes: int = 256 << 20) -> DataFrame:
    """One row for each member of ZIP files: parent_path, member_path, size, status, content.

    Members that would leave the archive are ``rejected``; those beyond an archive's budget of
    files or bytes are ``skipped``; both carry no content.  Broken archives have one ``failed`` row.
    """

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["canonical_path"], batch["content"]):
                rows: list[tuple] = []
                spent = 0
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for n, m in enumerate(z.infolist()):
                            if m.is_dir():
                                continue
                            outside = m.filename.startswith("/") or ".." in m.filename.split("/")
                            fits = n < most_files and spent + m.file_size <= most_bytes
                            status = "rejected" if outside else "completed" if fits else "skipped"
                            body = z.read(m) if status == "completed" else None
                            spent += m.file_size if body is not None else 0
                            rows.append((path, m.filename, m.file_size, status, body))
                except zipfile.BadZipFile:
                    rows.append((path, "", 0, "failed", None))
                yield pd.DataFrame(rows, columns=["parent_path", "member_path", "size", "status", "content"])

    archives = files.where(F.substring("content", 1, 2) == F.lit(b"PK")).select("canonical_path", "content")
    return archives.mapInPandas(expand, "parent_path string, member_path string, size bigint, status string, content binary")


def resolve_links(links: DataFrame, files: DataFrame, most_depth: int = 8) -> DataFrame:
    """(source_path, resolved_path, status) of symbolic links, followed inside the tree.

    ``links``: source_path and target_path, both canonical.  Statuses: resolved, missing, depth
    (a loop is a chain that never ends, so it ends as depth).
    """
    steps = links.select(F.col("source_path").alias("from_path"), F.col("target_path").alias("to_path"))
    now = links.select("source_path", F.col("target_path").alias("resolved_path"))
    for _ in range(most_depth):
        now = now.join(steps, F.col("resolved_path") == F.col("from_path"), "left").select("source_path", F.coalesce("to_path", "resolved_path").alias("resolved_path"))
    real = files.select(F.col("canonical_path").alias("resolved_path"), F.lit(True).alias("is_file"))
    still = steps.select(F.col("from_path").alias("resolved_path"), F.lit(True).alias("is_link"))
    met = now.join(real, "resolved_path", "left").join(still, "resolved_path", "left")
    return met.select("source_path", "resolved_path", F.when(F.col("is_link"), "depth").when(F.col("is_file"), "resolved").otherwise("missing").alias("status"))


def manifest_digest(files: DataFrame) -> DataFrame:
    """One digest over all paths and contents: bit-xor of row digests and their count, order-free."""
    row = F.xxhash64("canonical_path", "content_sha256")
    return files.agg(F.bit_xor(row).alias("mix"), F.count("*").alias("files")).select(F.sha2(F.concat_ws(":", "mix", "files"), 256).alias("manifest_sha256"))


def route_analyzers(files: DataFrame) -> DataFrame:
    """(canonical_path, analyzer): which producers see a file, by its content's start and suffix."""
    path = F.lower("canonical_path")
    text = lambda n: F.decode(F.substring("content", 1, n), "ISO-8859-1")
    found = F.array_compact(F.array(
        F.when(F.substring("content", 1, 4) == F.lit(b"\x7fELF"), "native"), F.when(path.rlike(r"\.(?:js|html?|asp)$"), "frontend"), F.when(path.rlike(r"\.(?:lua|php|asp|sh)$") | text(64).startswith("#!"), "script"),
        F.when(path.rlike(r"(?:lighttpd|nginx|httpd|uhttpd)[^/]*$"), "web_configuration"), F.when(path.endswith(".json"), "response_fixture"),
    ))
    return files.select("canonical_path", F.explode(found).alias("analyzer"))
