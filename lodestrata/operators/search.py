"""Full-text search as phrases over normalised token columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_text(*columns: str) -> list[Column]:
    """Each column as its tokens, one space around every one."""
    return [F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" ")) for c in columns]


def search(df: DataFrame, query: str, columns: tuple[str, ...], prefix: bool = False) -> DataFrame:
    """Rows that hold every term of ``query`` as a phrase in some column.

    Terms are runs of word characters, dots and dashes; a term of several tokens is a phrase.
    With ``prefix`` its last token may go on.  A query without terms finds nothing.
    """
    phrases = [" ".join(re.findall(r"[^\W_]+", t.lower())) for t in re.findall(r"[\w.-]+", query)]
    phrases = [p for p in phrases if p]
    if not phrases:
        return df.where(F.lit(False))
    texts = token_text(*columns)
    found = lambda p: reduce(lambda a, b: a | b, (t.contains(f" {p}" if prefix else f" {p} ") for t in texts))
    return df.where(reduce(lambda a, b: a & b, (found(p) for p in phrases)))
