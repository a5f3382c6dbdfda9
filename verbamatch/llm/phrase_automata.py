"""Repeated-phrase automata: every occurrence of every recurring passage.

A passage recurs if ``SPAN`` words or more of it stand in at least two documents.
The windows around repeated fingerprints (`_windows`) are the shards' input: they come
from a scan of all documents, and every occurrence of a recurring passage lies whole
in a window of the group of each fingerprint in it.  In each shard

* passages are confirmed: runs of SPAN words found in two documents, joined while the
  same places share them;
* the confirmed ones are compiled to an Aho-Corasick automaton over word symbols
  (pyahocorasick, integer sequences), for some ten thousand windows at a time;
* all windows of the shard's documents stream through it, and each match is an occurrence.

So a document meets only the automata that could match it; streaming each document
through every automaton would grow with the square of the corpus.  Around fingerprints at
more than ``HOT`` places no automaton is built: there runs of SPAN words are brought
together by hashes of their own, and those found in two documents are occurrences.

Defined results: null and empty texts and those under SPAN words hold none; texts of any
length are taken whole; a passage repeated within one document only doesn't recur; rows
that share a doc_id and the text are one document, and rows that share a doc_id only, or
have none, are told apart by their texts; ties don't arise, as every occurrence is
reported; an empty table gives none; other columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import as_id, likely, materialise, table
from ._text import U64, mix, powers
from ._windows import HOT, ROW, SPAN, groups, matrix, merged, repeated_windows
from .suffix_dedup import GRAMS_SQL, SPANS, SPANS_SQL, reported

SLICE = 20_000
STARTS = ROW - SPAN + 1


def run_hashes(h: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Hash of the SPAN words from each start of each row, told apart by group."""
    pw, inv = powers(ROW + 1)
    sums = np.zeros((len(m), ROW + 1), U64)
    np.cumsum((m.astype(U64) + U64(1)) * pw[:ROW], axis=1, out=sums[:, 1:])
    return mix((sums[:, SPAN:] - sums[:, :STARTS]) * inv[:STARTS] + mix(h)[:, None])


def confirm(h, doc, size, m) -> list[tuple[int, int, int]]:
    """Confirmed passages (row, start, end)."""
    key = run_hashes(h, m)
    row, off = np.nonzero(np.arange(STARTS)[None, :] + SPAN <= size[:, None])
    k = key[row, off]
    order = np.lexsort((off, row, k))
    k, row, off = k[order], row[order], off[order]
    if not len(k):
        return []
    head = np.concatenate([[True], k[1:] != k[:-1]])
    cls = np.cumsum(head) - 1
    # Rows come in order of documents within a group, so a class's documents are in order.
    other = np.concatenate([[True], doc[row[1:]] != doc[row[:-1]]]) | head
    sure = np.bincount(cls, other) >= 2
    mark = mix(row.astype(U64) + U64(1))
    at = np.flatnonzero(head)
    shared = np.add.reduceat(mark, at)
    first = at[sure]
    r, o, s = row[first], off[first], shared[sure]
    order = np.lexsort((o, r))
    r, o, s = r[order], o[order], s[order]
    if not len(r):
        return []
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1) | (s[1:] != s[:-1])])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(r)]]) - 1
    return list(zip(r[begin].tolist(), o[begin].tolist(), (o[end] + SPAN).tolist()))


def occurrences(passages: list[tuple[int, int, int]], size: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last offset of the matches in each row (-1: none); two matches in a row always overlap."""
    n = len(size)
    first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if not passages:
        return first, last
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for r, a, b in passages:
        machine.add_word(tuple(m[r, a:b].tolist()), b - a)
    machine.make_automaton()
    for r in range(n):
        low, high = ROW, -1
        for end, length in machine.iter(tuple(m[r, : size[r]].tolist())):
            if end - length + 1 < low:
                low = end - length + 1
            high = end + 1
        if high > 0:
            first[r], last[r] = low, high
    return first, last


def find_recurring(docs: DataFrame, slice_rows: int = SLICE, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word): maximal word ranges covered by recurring passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, slice_rows):
            rows = matrix(part)
            h, doc, _, _, size, m = rows
            found = reported(part.combine_chunks(), rows, *occurrences(confirm(h, doc, size, m), size, m))
            if found is not None:
                yield found

    windows, runs = repeated_windows(docs, hot)
    spans = windows.mapInArrow(run, SPANS)
    if runs is not None:
        key = ["r1", "r2"]
        several = materialise(runs.groupBy(*key).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select(*key), "hot-several")
        shared = likely(runs, key, several).join(several, key, "left_semi")
        spans = spans.union(shared.select("doc", F.col("start").cast("long"), (F.col("start") + SPAN).cast("long")))
    return merged(spans).select(as_id("doc").alias("doc_id"), "start_word", "end_word")


def op3_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_recurring(table(spark, sf_dir, "documents"))


QUERIES = {"op3_phrases": op3_phrases}

ORACLE = {
    "op3_phrases": GRAMS_SQL
    + ",\nhits AS (SELECT DISTINCT g.doc_id, g.i FROM g JOIN (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1) USING (gram)),"
    + SPANS_SQL.format(span=SPAN)
}
