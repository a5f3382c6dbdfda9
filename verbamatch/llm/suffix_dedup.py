"""Suffix-array deduplication with longest-previous-factor arrays.

For every word position the longest factor that starts there and also starts at an
earlier position (smaller doc_id, then smaller word index) is its LPF; where it
reaches ``SPAN`` words the factor is a later copy and is removed, so the first
occurrence stays.  LPF comes from the suffix array: the longest match with an earlier
position is with the previous or the next smaller position in suffix order (Crochemore
and Ilie, 2008).

One suffix array over 100 TB would need dozens of global sorts.  The windows around
repeated fingerprints (`_windows`) bring every run of SPAN words that occurs twice
into one group at each of its occurrences, so arrays over groups give the same
removals: they are built by prefix doubling, a few ten thousand windows at a time,
with words salted by group so that groups stay apart.  Around fingerprints at more than
``HOT`` places, runs of SPAN words are brought together by hashes of their own, and all but
the earliest of equal ones are later copies.

Defined results: null and empty texts and those under SPAN words lose nothing; texts of any
length are taken whole; a null doc_id comes after all others and is reported as null; rows
that share a doc_id and the text are one document, and rows that share a doc_id only are
two, the one with the smaller hash of its text first; a text that repeats itself keeps the
first round; an empty table gives none; extra columns of any name are carried along and not
looked at.  `drop_copies` cuts the ranges out of the texts, each up to the next word that
stays, keeps all rows and columns, and corrects n_chars where there is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import NODE, as_id, fresh, likely, mapped, marked, materialise, node, own_columns, table
from ._text import U64, WORD_SQL, chunks, mix, words
from ._windows import HOT, ROW, SPAN, groups, matrix, merged, repeated_windows

SLICE = 20_000


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of `text` in order of their first `depth` symbols at least, and the ranks by 1, 2, 4, ... symbols."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    ranks = [rank.astype(np.int32)]
    width, order = 1, None
    while order is None or width < depth:
        r = ranks[-1].astype(np.int64)
        key = (r + 1) * (n + 1)
        if width < n:
            key[:-width] += r[width:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int32)
        k = key[order]
        new[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]])).astype(np.int32)
        ranks.append(new)
        width *= 2
    return order, ranks


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes a and b, as far as the ranks tell."""
    n = len(ranks[0])
    length = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = a + length, b + length
        ok = (i < n) & (j < n)
        same = ok.copy()
        same[ok] = ranks[k][i[ok]] == ranks[k][j[ok]]
        length[same] += 1 << k
    return length


def previous_factors(value: list[int], lcp: list[int]) -> list[int]:
    """LPF of each suffix in suffix order, by its nearest smaller values on both sides.

    lcp[i]: common prefix of the suffixes i - 1 and i.  Equal values are the same place,
    so only strictly smaller ones count.
    """
    n = len(value)
    best = [0] * n
    for step in (1, -1):
        stack: list[tuple[int, int]] = []  # (value, common prefix with the stack entry below)
        for i in range(n) if step == 1 else range(n - 1, -1, -1):
            v = value[i]
            if step == 1:
                least = lcp[i] if i else 0
            else:
                least = lcp[i + 1] if i + 1 < n else 0
            while stack and stack[-1][0] >= v:
                low = stack.pop()[1]
                if low < least:
                    least = low
            if stack and least > best[i]:
                best[i] = least
            stack.append((v, least))
    return best


def later_copies(h, doc, pos, back, size, m) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first and last offset removed (-1: nothing)."""
    n = len(h)
    width = ROW + 1
    salt = (mix(h) >> U64(32)).astype(np.int64)
    text = np.empty((n, width), np.int64)
    text[:, :ROW] = m.astype(np.int64) ^ salt[:, None]
    ends = np.arange(width)[None, :] >= size[:, None]
    # Everything from a row's end on is a symbol of its own, so no match runs on.
    text[ends] = (1 << 33) + np.arange(int(ends.sum()))
    text = text.ravel()
    order, ranks = suffix_array(text, ROW)
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = common_prefix(ranks, order[:-1], order[1:])
    first, last = np.full(n, width, np.int64), np.full(n, -1, np.int64)
    long = lcp >= SPAN
    member = long.copy()
    member[:-1] |= long[1:]
    at = np.flatnonzero(member)
    if len(at):
        where = order[at]
        row, off = where // width, where % width
        value = (doc[row] << 33) + (pos[row] - back[row] + off)
        # Runs are kept apart by a common prefix of 0.
        factor = np.array(previous_factors(value.tolist(), np.where(long[at], lcp[at], 0).tolist()))
        hit = factor >= SPAN
        row, off, factor = row[hit], off[hit], factor[hit]
        np.minimum.at(first, row, off)
        np.maximum.at(last, row, off + factor)
    return np.where(last > 0, first, -1), last


SPANS = f"doc {NODE}, start_word long, end_word long"


def reported(part: pa.Table, rows: tuple[np.ndarray, ...], first: np.ndarray, last: np.ndarray) -> pa.RecordBatch | None:
    """SPANS of the rows of a table with an offset."""
    out = np.flatnonzero(last > 0)
    if not len(out):
        return None
    begin = rows[2][out] - rows[3][out]
    doc = part.column("doc").combine_chunks()
    return pa.RecordBatch.from_arrays([doc.take(pa.array(out)), pa.array(begin + first[out]), pa.array(begin + last[out])], names=["doc", "start_word", "end_word"])


def copies(docs: DataFrame, slice_rows: int = SLICE, hot: int = HOT) -> DataFrame:
    """SPANS of all later copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, slice_rows):
            rows = matrix(part)
            found = reported(part.combine_chunks(), rows, *later_copies(*rows))
            if found is not None:
                yield found

    windows, runs = repeated_windows(docs, hot)
    spans = windows.mapInArrow(run, SPANS)
    if runs is not None:
        place, key = F.struct("doc", "start"), ["r1", "r2"]
        first = materialise(runs.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").drop("last"), "hot-first")
        later = likely(runs, key, first).join(first, key).filter(place > F.col("first"))
        spans = spans.union(later.select("doc", F.col("start").cast("long"), (F.col("start") + SPAN).cast("long")))
    return merged(spans)


def find_copies(docs: DataFrame, slice_rows: int = SLICE, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word): maximal word ranges covered by later copies."""
    return copies(docs, slice_rows, hot).select(as_id("doc").alias("doc_id"), "start_word", "end_word")


def drop_copies(docs: DataFrame, slice_rows: int = SLICE, hot: int = HOT) -> DataFrame:
    """The documents without the ranges that `find_copies` names."""
    key, ranges, mark = fresh(docs, "doc_"), fresh(docs, "ranges_"), fresh(docs, "mark_")
    gone = copies(docs, slice_rows, hot).groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(ranges))
    gone = materialise(gone, "copies")
    wide = marked(docs.withColumn(key, node()), [key], gone, mark)
    whole = wide.filter(~F.col(mark)).select(*own_columns(docs))
    wide = wide.filter(F.col(mark)).join(gone, key, "left").select(*own_columns(docs), ranges)
    where = [c.lower() for c in docs.columns].index("text")
    counts = [i for i, c in enumerate(docs.columns) if c.lower() == "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns[:-1])
            texts, sizes, spans = cols[where].to_pylist(), [cols[i].to_pylist() for i in counts], batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi, raw, offs in chunks(cols[where].cast(pa.string())):
                w = words(raw, offs)
                for k in range(hi - lo):
                    if not spans[lo + k]:
                        continue
                    kept, at, own = [], offs[k], w.first[k]
                    for x in sorted(spans[lo + k], key=lambda x: x["start_word"]):
                        end = own + x["end_word"]
                        kept.append(raw[at : w.start[own + x["start_word"]]])
                        at = w.start[end] if end < w.first[k + 1] else offs[k + 1]
                    texts[lo + k] = b"".join(x.tobytes() for x in [*kept, raw[at : offs[k + 1]]]).decode()
                    for s in sizes:
                        s[lo + k] = len(texts[lo + k])
            cols[where] = pa.array(texts, cols[where].type)
            for i, s in zip(counts, sizes):
                cols[i] = pa.array(s, cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    return whole.union(mapped(wide, run, docs.schema))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}

SPANS_SQL = """
covered AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hits),
islands AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + {span} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM covered)
SELECT doc_id, CAST(min(i) - 1 AS BIGINT) AS start_word, CAST(max(i) - 1 + {span} AS BIGINT) AS end_word FROM islands GROUP BY doc_id, island
"""

GRAMS_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents),
g AS (SELECT doc_id, i, md5_number(array_to_string(list_slice(w, i, i + {SPAN - 1}), ' ')) AS gram
      FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - {SPAN - 1})) AS i) WHERE len(w) >= {SPAN})"""

ORACLE = {
    "op7_suffix_dedup": GRAMS_SQL
    + ",\nhits AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),"
    + SPANS_SQL.format(span=SPAN)
}
