"""Licence scans: a generalised suffix automaton of licence templates over word ids.

Streaming a text through the automaton gives its matching statistics: at every word, the
length of the longest run ending there that occurs in some template.  Maximal runs of
``LEAST`` words or more are chained per template, in text and template order with bounded
gaps, into spans; a chain that covers enough of its template gives that template's label.
A run of ``LEAST`` words begins with one of the templates' own word windows, so only places
where such a window stands (found for all texts of a batch at once) are streamed.  A run counts for
the templates that hold all of it.

Templates are rows (label, text); ``standard_templates`` reads the packaged ones.  A text is read
as a whole by one task; word ids are looked up only where it is streamed.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import kernels
from lodestrata.llm.common import free

#: Phrases whose words stand consecutively, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Public licence texts, file headers and notices: a file for each label, texts apart by a line of dashes.
TEMPLATE_FOLDER = Path(__file__).parent / "licenses"
#: Words of the shortest run that counts, words that a chain may skip, covered share that gives the label.
LEAST, GAP, COVERED = 3, 6, 0.8


def standard_templates(folder: Path = TEMPLATE_FOLDER) -> tuple[tuple[str, str], ...]:
    """(label, text) of the packaged templates."""
    return tuple((f.stem, text.strip()) for f in sorted(folder.glob("*.txt")) for text in f.read_text().split("\n----\n"))


def template_words(text: str) -> list[bytes]:
    folded = kernels.ALPHANUMERIC[np.frombuffer(text.encode(), np.uint8)].astype(np.uint8).tobytes()
    return [w for w in folded.split(b"\0") if w]


class SuffixAutomaton:
    """All substrings of several word-id sequences; each state knows where its runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for t, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].add((t, at + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]

    def _new(self, length: int, follow: dict[int, int], link: int, ends: list[set]) -> int:
        self.next.append(follow), self.length.append(length), self.link.append(link), ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int, ends: list[set]) -> int:
        twin = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, word: int, ends: list[set]) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word, ends)
        own, p = self._new(self.length[last] + 1, {}, 0, ends), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = own
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[own] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word, ends)
        return own

    def matches(self, ids: list[int], begin: int, least: int) -> tuple[list[tuple[int, int, int]], int]:
        """Maximal runs (start, length, state) from word ``begin`` until none goes on; and where that is.

        ids: -1 for words of no template.
        """
        found, state, length, at = [], 0, 0, begin
        while at < len(ids):
            word = ids[at]
            before = (state, length)
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if length <= before[1] and before[1] >= least:
                found.append((at - before[1], before[1], before[0]))
            at += 1
            if length < least and at - begin >= least:
                return found, at - length
        if length >= least:
            found.append((at - length, length, state))
        return found, at


class Scanner:
    def __init__(self, templates=None, phrases=PHRASES, least: int = LEAST, gap: int = GAP, covered: float = COVERED):
        templates = standard_templates() if templates is None else templates
        self.templates = [(label, words) for label, text in templates if (words := template_words(text or ""))]
        self.phrases = [(template_words(p), label) for p, label in phrases]
        self.least, self.gap, self.covered = least, gap, covered
        self.ids = {w: i for i, w in enumerate(sorted({w for _, words in self.templates for w in words}))}
        self.automaton = SuffixAutomaton([[self.ids[w] for w in words] for _, words in self.templates])
        self.seeds = np.unique(np.concatenate([np.zeros(0, np.uint64), *(self._windows(words, least) for _, words in self.templates if len(words) >= least)]))
        self.phrase_keys = [(self._windows(words, len(words))[0], words, label) for words, label in self.phrases]

    @staticmethod
    def _windows(words: list[bytes], n: int) -> np.ndarray:
        d, _, _, h, _ = kernels.words(pa.array([b" ".join(words).decode()]), kernels.ALPHANUMERIC)
        return kernels.ngrams(d, h, min(n, len(words)))[1]

    def chains(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, words covered, first word, end) of the best chain of each template."""
        open_chains: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # covered, first, text end, template end
        best: dict[int, tuple[int, int, int]] = {}
        for start, length, state in sorted(runs):
            for t, end in self.automaton.ends[state]:
                now = (length, start, start + length, end)
                still = []
                for covered, first, text_end, template_end in open_chains[t]:
                    if start - text_end > self.gap:
                        continue
                    still.append((covered, first, text_end, template_end))
                    skip = max(0, text_end - start, template_end - (end - length))  # words that both runs hold
                    if template_end < end and skip < length and end - length - template_end <= self.gap and covered + length - skip > now[0]:
                        now = (covered + length - skip, first, start + length, end)
                open_chains[t] = [*still, now]
                if t not in best or now[0] > best[t][0]:
                    best[t] = now[:3]
        return [(t, *b) for t, b in sorted(best.items())]

    def scan(self, texts: pa.Array) -> list[dict]:
        data, _ = kernels.buffers(texts)
        d, s, e, h, counts = kernels.words(texts, kernels.ALPHANUMERIC)
        raw = kernels.ALPHANUMERIC.astype(np.uint8)
        first_word = np.cumsum(counts) - counts
        out = [{"n_words": int(n), "n_base": 0, "first_word": None, "last_word": None, "base": set(), "labels": set(), "score": 0.0, "spans": []} for n in counts]
        word = lambda i: raw[data[s[i] : e[i]]].tobytes()
        for key, words, label in self.phrase_keys:
            n = len(words)
            if len(h) < n:
                continue
            for i in np.flatnonzero(self._at(d, h, n) == key):
                if d[i] == d[i + n - 1] and [word(i + k) for k in range(n)] == words:
                    o, at = out[d[i]], int(i - first_word[d[i]])
                    o["n_base"] += 1
                    o["base"].add(label)
                    o["first_word"] = at if o["first_word"] is None else min(at, o["first_word"])
                    o["last_word"] = at if o["last_word"] is None else max(at, o["last_word"])
        if len(h) >= self.least and len(self.seeds):
            windows = self._at(d, h, self.least)
            where = np.minimum(np.searchsorted(self.seeds, windows), len(self.seeds) - 1)
            hits = np.flatnonzero((self.seeds[where] == windows) & (d[: len(windows)] == d[self.least - 1 :]))
            for document in np.unique(d[hits]):
                a, n = int(first_word[document]), int(counts[document])
                mine, done, runs = hits[d[hits] == document] - a, 0, []
                ids: dict[int, int] = {}
                view = _LazyIds(lambda i, a=a: self.ids.get(word(a + i), -1), n, ids)
                for at in mine.tolist():
                    if at >= done:
                        found, done = self.automaton.matches(view, at, self.least)
                        runs += found
                o = out[document]
                for t, covered, begin, end in self.chains(runs):
                    label, template = self.templates[t]
                    share = covered / len(template)
                    o["score"] = max(o["score"], min(share, 1.0))
                    if share >= self.covered:
                        o["labels"].add(label)
                        o["spans"].append((label, begin, end, share))
        return out

    @staticmethod
    def _at(d: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """The hash of the n words from each place, across texts too."""
        return kernels.ngrams(np.zeros(len(h), np.int64), h, n)[1]


class _LazyIds:
    """Word ids of one text, looked up when read."""

    def __init__(self, read, n: int, seen: dict[int, int]):
        self.read, self.n, self.seen = read, n, seen

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if i not in self.seen:
            self.seen[i] = self.read(i)
        return self.seen[i]


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    """One automaton for each set of templates in a worker."""
    return Scanner(templates)


def scan_licenses(docs: DataFrame, into: str = "licenses", templates: tuple[tuple[str, str], ...] | DataFrame | None = None) -> DataFrame:
    """Add a struct ``into`` to every row; other columns pass through, ``into`` must not be one of them.

    ``templates``: rows (label, text), a small table of licences; the packaged ones if None.
    n_words, n_base (places of base phrases), first_word and last_word (least and greatest
    start, null without one), base_labels and labels (distinct, sorted, comma-joined; the second
    with the automaton's), score (largest covered share of a template) and spans (label, first
    word, end, share).  A null text is empty: no words, no labels, score 0.
    """
    free(docs, into)
    if templates is None:
        templates = standard_templates()
    elif isinstance(templates, DataFrame):  # a list of licences, which does not grow with the documents
        templates = tuple(sorted((r[0], r[1]) for r in templates.where("label is not null and text is not null").select("label", "text").collect()))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(templates))
    span = "struct<label: string, first_word: bigint, end_word: bigint, share: double>"

    @F.arrow_udf(f"struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, score: double, spans: array<{span}>>")
    def scan(texts: pa.Array) -> pa.Array:
        scanner = _scanner(shared.value)
        found = [x for _, part in kernels.batches(texts) for x in scanner.scan(part)]
        column = lambda k, kind: pa.array([x[k] for x in found], kind)
        joined = lambda f: pa.array([",".join(sorted(f(x))) for x in found], pa.string())
        spans = pa.array([[dict(zip(("label", "first_word", "end_word", "share"), s)) for s in x["spans"]] for x in found], pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64())])))
        return pa.StructArray.from_arrays(
            [*(column(k, pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")), joined(lambda x: x["base"]), joined(lambda x: x["base"] | x["labels"]), column("score", pa.float64()), spans],
            ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )

    return docs.withColumn(into, scan(F.col("text")))


#: Base columns of the query, for DuckDB.
BASE_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), p(label, phrase) AS (
  VALUES ('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']), ('reserved', ['all', 'rights', 'reserved'])
), hits AS (
  SELECT w.n, label, i - 1 AS start FROM w, p, unnest(range(1, len(words) + 1)) AS u(i) WHERE words[i] = phrase[1] AND words[i : i + len(phrase) - 1] = phrase
)
SELECT doc_id, CAST(len(any_value(words)) AS BIGINT) AS n_words, count(label) AS n_base, min(start) AS first_word, max(start) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM w LEFT JOIN hits USING (n) GROUP BY n, doc_id
"""
