"""Token counts; huge texts are encoded in overlapping chunks that are spliced again.

The tokenizer's pattern matches from left to right and never looks behind, and no token
crosses the pieces that the pattern makes.  So if two encodings of one text both begin a
piece at the same place, they agree from there on as far as both reach.  A chunk's encoding is
right from its first proven place on; its boundaries are proven up to a margin before its end,
as long as the longest added token, in which such a token or a longer piece could still begin.  Each chunk
is spliced to the one before at the first place in their overlap that begins a piece in both;
where there is none (one piece longer than the overlap), the overlap is widened.

A text is encoded by one task, which holds the encodings of two chunks.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import free, fresh

TOKENIZER = "byte_bpe_50k.json"
#: Characters of a chunk, of the first overlap, and (at least) before a chunk's end where nothing is proven.
CHUNK, OVERLAP, MARGIN = 1 << 13, 1 << 6, 16
MOST_TOKENS = 512


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """``path``: a file, or the name of one of the public tokenizers' files."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    from tokenizers import Tokenizer

    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def margin_of(tokenizer) -> int:
    """Characters before a chunk's end where a token that is never split could still begin."""
    return max([MARGIN, *(len(t.content) for t in tokenizer.get_added_tokens_decoder().values())])


class _Chunk:
    """The encoding of a part of the text from ``start``; places count from the text's begin."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        encoding = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.words, self.offsets = start, end, encoding.word_ids, encoding.offsets

    def before(self, place: int) -> int:
        """Tokens that begin before ``place``."""
        return bisect_left(self.offsets, (place - self.start, 0))

    def pieces(self, first: int, last: int) -> Iterator[int]:
        """Places from ``first`` to ``last`` where a piece begins."""
        i = self.before(first)
        while i < len(self.offsets) and (place := self.start + self.offsets[i][0]) <= last:
            if (i == 0 or self.words[i] is None or self.words[i] != self.words[i - 1]) and (i == 0 or self.offsets[i - 1][0] < self.offsets[i][0]):
                yield place
            i += 1


def count_tokens(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the whole text, holding the encoding of two chunks at most."""
    if len(text) <= chunk + overlap:
        return len(tokenizer.encode(text, add_special_tokens=False))
    margin = margin_of(tokenizer)
    total, synced, width = 0, 0, overlap  # all tokens before the place ``synced`` are counted
    own = _Chunk(tokenizer, text, 0, chunk + overlap)
    begin = 0
    while own.end < len(text):
        follower = begin + chunk
        after = _Chunk(tokenizer, text, follower, min(len(text), follower + chunk + overlap))
        first, last = max(follower + 1, synced), min(own.end, after.end) - margin
        theirs = set(after.pieces(first, last))
        common = next((p for p in own.pieces(first, last) if p in theirs), None)
        if common is None:  # encode further, from the last proven place, until both agree
            width *= 2
            own = _Chunk(tokenizer, text, synced, min(len(text), follower + width))
            continue
        total += own.before(common) - own.before(synced)
        synced, begin, own, width = common, follower, after, overlap
    return total + len(own.offsets) - own.before(synced)


def with_token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = MOST_TOKENS, into: str = "tokens") -> DataFrame:
    """Add a struct ``into``: n_bytes (UTF-8), n_tokens, over_limit, of every whole text.

    A null text counts as empty: 0 bytes, 0 tokens.  No special token is added; the strings of
    special tokens inside a text are read as the library does by default.  Repeated rows get
    equal counts; all other columns pass through; ``into`` must not be one of them.
    """
    free(docs, into)

    @F.arrow_udf("bigint")
    def counts(texts: pa.Array) -> pa.Array:
        t = load_tokenizer(tokenizer)
        out = [0] * len(texts)
        group: list[tuple[int, str]] = []
        held = 0

        def flush():
            for (i, _), e in zip(group, t.encode_batch_fast([x for _, x in group], add_special_tokens=False)):
                out[i] = len(e)
            group.clear()

        for i, value in enumerate(texts):
            text = value.as_py() or ""
            if len(text) > CHUNK + OVERLAP:
                out[i] = count_tokens(t, text)
                continue
            group.append((i, text))
            held += len(text)
            if held > 1 << 18:
                flush()
                held = 0
        flush()
        return pa.array(out, pa.int64())

    n = fresh(docs, "n_tokens_raw")
    return docs.withColumn(n, counts(F.col("text"))).withColumn(
        into, F.struct(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col(n).alias("n_tokens"), (F.col(n) > limit).alias("over_limit"))
    ).drop(n)
