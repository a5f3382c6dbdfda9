"""Windows of text around fingerprints that occur more than once.

Both repeated-passage operators need the same exact step: bring together all places
whose ``SPAN`` words might be equal.  Winnowing (Schleimer, Wilkerson and Aiken, 2003)
picks, among every ``SPAN - GRAM + 1`` consecutive grams of ``GRAM`` words, the one with the
least hash; two equal runs of SPAN words therefore hold a picked gram of the same
hash.  Only grams that were picked at two places or more travel on, each with the
words around it, keyed by its hash: every run of SPAN words that occurs twice arrives
whole in the same group at each of its occurrences, and nothing else is moved.

A gram at more than ``HOT`` places (a licence header's, say) makes no group.  There each run
of SPAN words around it is keyed by two 64-bit hashes of its own, so that only equal runs
meet, in aggregations that combine before the shuffle (`hot_runs`).  Groups are thus never
larger than HOT rows, whatever the data.

Where a text repeats itself with a short period the same gram is least again and
again; such chains are thinned so that each stretch of SPAN words keeps one (see `picked`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import NODE, likely, materialise, node
from ._text import U64, Words, chunks, grams, mix, powers, within, words

SPAN = 50
GRAM = 16
BACK = SPAN - GRAM
ROW = BACK + SPAN
HOT = 20_000
SCHEMA = f"h long, doc {NODE}, pos int, back int, tokens binary"


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    m, w = a, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(a) - width + 1], m[width - w : width - w + len(a) - width + 1])


def picked(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the picked grams of all texts.

    A chain is a run of picked grams of one hash at distances of at most half the
    window.  It keeps its first member in each half window and its last member, so
    each window that held a member of the chain still does.
    """
    width = SPAN - GRAM + 1
    g = grams(w.hash, GRAM)
    if len(g) < width:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    inside = within(w.first, GRAM, len(w.hash))
    least = sliding_min(g, width)
    good = within(w.first, SPAN, len(w.hash))
    # Position p is picked if a window [s, s + width) in its text has its hash as the least one.
    low = np.full(len(g) + width - 1, np.iinfo(np.uint64).min, U64)
    low[width - 1 : width - 1 + len(least)] = np.where(good, least, 0)
    # The greatest of the leasts over the windows that hold p equals g[p] exactly if p is picked.
    top = ~sliding_min(~low, width)
    p = np.flatnonzero((top[: len(g)] == g) & inside)
    h = g[p]
    if len(p):
        half = width // 2
        text = np.searchsorted(w.first, p, "right")
        start = np.ones(len(p), bool)
        start[1:] = (h[1:] != h[:-1]) | (p[1:] - p[:-1] > half) | (text[1:] != text[:-1])
        head = p[np.flatnonzero(start)][np.cumsum(start) - 1]
        part = (p - head) // half
        keep = start.copy()
        keep[1:] |= part[1:] != part[:-1]
        keep[:-1] |= start[1:]
        keep[-1] = True
        p, h = p[keep], h[keep]
    return p, h


def _wanted(batch: pa.RecordBatch, lo: int, hi: int, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, hash, text index) of the picked grams of rows lo..hi that the list in column 2 names."""
    p, h = picked(w)
    text = np.searchsorted(w.first, p, "right") - 1
    part = batch.column(2).slice(lo, hi - lo)
    wanted = part.flatten().to_numpy().view(U64)
    n = np.diff(part.offsets.to_numpy())
    # A gram is wanted in its own text only: compare (text, hash) pairs.
    salt = U64(0x9E3779B97F4A7C15)
    key = np.sort(wanted ^ (np.repeat(np.arange(hi - lo), n).astype(U64) * salt))
    if not len(key):
        return p[:0], h[:0], text[:0]
    mine = h ^ (text.astype(U64) * salt)
    hit = key[np.minimum(np.searchsorted(key, mine), len(key) - 1)] == mine
    return p[hit], h[hit], text[hit]


def repeated_windows(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame | None]:
    """Windows in groups, and the runs around grams that make no group (None: there are no such grams).

    Windows (SCHEMA): gram hash, document, place of the gram, words before it in the row,
    and the words as 32-bit hashes; sorted by hash, document and place.  Runs: (r1, r2, doc,
    start), one for each run of SPAN words around a hot gram.
    """
    own = docs.select(node().alias("doc"), F.col("text").cast("string").alias("text"))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, offs in chunks(batch.column(1)):
                w = words(raw, offs)
                p, h = picked(w)
                text = np.searchsorted(w.first, p, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(lo + text))], names=["h", "doc"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offs in chunks(batch.column(1)):
                w = words(raw, offs)
                p, h, text = _wanted(batch, lo, hi, w)
                if not len(p):
                    continue
                a = np.maximum(w.first[text], p - BACK)
                b = np.minimum(w.first[text + 1], p + SPAN)
                token = (w.hash >> U64(32)).astype(np.uint32)
                size = b - a
                cut = np.concatenate([[0], np.cumsum(size)])
                flat = token[np.repeat(a - cut[:-1], size) + np.arange(cut[-1])]
                tokens = pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(lo + text)), pa.array((p - w.first[text]).astype(np.int32)), pa.array((p - a).astype(np.int32)), tokens], names=["h", "doc", "pos", "back", "tokens"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offs in chunks(batch.column(1)):
                w = words(raw, offs)
                p, _, text = _wanted(batch, lo, hi, w)
                a = np.maximum(w.first[text], p - BACK)
                size = np.maximum(np.minimum(w.first[text + 1] - SPAN, p) + 1 - a, 0)
                cut = np.cumsum(size)
                start = np.unique(np.repeat(a - (cut - size), size) + np.arange(cut[-1] if len(cut) else 0))
                if not len(start):
                    continue
                text = np.searchsorted(w.first, start, "right") - 1
                keys = [pa.array(x.view(np.int64)) for x in run_keys(w.hash, start)]
                yield pa.RecordBatch.from_arrays([*keys, batch.column(0).take(pa.array(lo + text)), pa.array((start - w.first[text]).astype(np.int32))], names=["r1", "r2", "doc", "start"])

    found = own.mapInArrow(marks, f"h long, doc {NODE}")
    # A repeated row makes its grams count twice, which only lets more rows travel.
    counts = materialise(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "grams")

    def texts(which: Column) -> DataFrame:
        """(doc, text, hs) of the documents that hold a gram of these, once for each document."""
        own_counts = counts.filter(which).select("h")
        wanted = likely(found, ["h"], own_counts).join(own_counts, "h", "left_semi").groupBy("doc").agg(F.collect_set("h").alias("hs"))
        wanted = materialise(wanted, "wanted")
        return likely(own, ["doc"], wanted).dropDuplicates(["doc"]).join(wanted, "doc").select("doc", "text", "hs")

    is_hot = F.col("n") > hot
    windows = texts(~is_hot).mapInArrow(around, SCHEMA).repartition("h").sortWithinPartitions("h", "doc", "pos")
    if counts.filter(is_hot).isEmpty():
        return windows, None
    return windows, materialise(texts(is_hot).mapInArrow(runs, f"r1 long, r2 long, doc {NODE}, start int"), "hot-runs")


def run_keys(hashes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the SPAN words from each start on."""
    pw, inv = powers(len(hashes) + 1)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        sums = np.zeros(len(hashes) + 1, U64)
        np.cumsum(mix(hashes ^ U64(salt)) * pw[: len(hashes)], out=sums[1:])
        out.append(mix((sums[start + SPAN] - sums[start]) * inv[start]))
    return out[0], out[1]


def groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups of equal h, of about `rows` rows each."""
    held: list[pa.RecordBatch] = []
    n, tried = 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n < max(rows, 2 * tried):
            continue
        t = pa.Table.from_batches(held)
        h = t.column("h").to_numpy()
        change = np.flatnonzero(h[1:] != h[:-1]) + 1
        cut = 0
        for last in change.tolist():
            if last - cut >= rows or last == change[-1]:
                yield t.slice(cut, last - cut)
                cut = last
        t = t.slice(cut)
        held, n = t.to_batches(), t.num_rows
        tried = n
    if n:
        yield pa.Table.from_batches(held)


def matrix(t: pa.Table) -> tuple[np.ndarray, ...]:
    """(h, doc, pos, back, size, tokens) with documents numbered in order within each group, and the words right-padded into a matrix of ROW columns."""
    t = t.combine_chunks()
    col, doc = t.column("tokens").chunk(0), t.column("doc").chunk(0)
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    flat = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.uint32)
    size = np.diff(offs) // 4
    m = np.zeros((len(col), ROW), np.uint32)
    m[np.arange(ROW)[None, :] < size[:, None]] = flat
    h = t.column("h").to_numpy()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    for x in doc.flatten():
        x = x.to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return h.view(U64), np.cumsum(new), t.column("pos").to_numpy().astype(np.int64), t.column("back").to_numpy().astype(np.int64), size, m


def merged(spans: DataFrame) -> DataFrame:
    """Unions of overlapping or touching [start_word, end_word) of each doc."""
    w = Window.partitionBy("doc").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", (reach.isNull() | (F.col("start_word") > reach)).cast("int")).withColumn("island", F.sum("new").over(w))
    return islands.groupBy("doc", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("island")
