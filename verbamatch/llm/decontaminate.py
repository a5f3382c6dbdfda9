"""Benchmark decontamination by Wu-Manber multi-pattern search (Wu and Manber, 1994).

The test strings are all runs of ``ngram`` words of every benchmark item (the whole
item where it is shorter).  A block shift table says how far the search window may
move on for the block of bytes at its end; where that is zero, the hash of the
pattern's suffix selects a bucket of test strings, which are compared directly.
The table is driven for thousands of text segments at once with numpy, so each step
is one gather instead of one Python iteration.

The benchmark's size doesn't depend on the corpus, but is checked: it comes to the driver in
blocks of about ``BLOCK_BYTES``, each searched in a scan of its own, and its compiled tables
are cut into shards of ``max_pattern_bytes``, searched one after another in the same scan.
Each Python worker compiles a block's tables once.

Defined results: a null or empty text has no match; texts of any length are searched whole;
a null, empty or wordless item gives no test string; repeated items each report; equal rows
of documents report each; empty tables give no match; nulls in other columns don't matter,
nor do extra columns of any name, which `drop_leaks` carries along.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import fresh, mapped, own_columns, table
from ._text import U64, WORD_SQL, chunks, fold, mix, normal_text, strings, words

NGRAM = 13
BLOCK = 8
SEGMENT = 512
BLOCK_BYTES = 256 << 20
PATTERN_BYTES = 64 << 20


class WuManber:
    """Exact search for byte strings; `find` gives (end position, pattern index) pairs."""

    def __init__(self, patterns: list[bytes], table_bits: int = 22):
        self.patterns = patterns
        self.length = min(map(len, patterns))
        self.block = min(BLOCK, self.length)
        self.bits = table_bits
        m, b = self.length, self.block
        self.mask = U64((1 << (8 * b)) - 1)
        n_shift = m - b + 1
        self.shift = np.full(1 << table_bits, n_shift, np.int32)
        # The window covers the last m bytes of a pattern, so all patterns end alike.
        tails = np.frombuffer(b"".join(p[-m:] for p in patterns), np.uint8).reshape(len(patterns), m)
        for end in range(b, m + 1):
            code = np.zeros(len(patterns), U64)
            for j in range(b):
                code |= tails[:, end - b + j].astype(U64) << U64(8 * j)
            np.minimum.at(self.shift, self._slot(code), m - end)
        self.tail_hash = np.array([hash_bytes(p[-m:]) for p in patterns], U64)
        self.order = np.argsort(self.tail_hash, kind="stable")
        self.sorted_tail = self.tail_hash[self.order]

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (mix(code) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, b, n = self.length, self.block, len(text)
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        view = np.ndarray((n,), "<u8", padded, strides=(1,))
        pos = np.arange(0, n, SEGMENT, dtype=np.int64) + m - 1
        last = np.minimum(pos + SEGMENT, n)
        live = pos < last
        pos, last = pos[live], last[live]
        zero = []
        while len(pos):
            step = self.shift[self._slot(view[pos - b + 1] & self.mask)]
            at = step == 0
            if at.any():
                zero.append(pos[at])
            pos = pos + np.maximum(step, 1)
            live = pos < last
            if not live.all():
                pos, last = pos[live], last[live]
        if not zero:
            return none, none
        ends = np.sort(np.concatenate(zero))
        code = np.zeros(len(ends), U64)
        for j in range(m):
            code = code * U64(0x100000001B3) + text[ends - m + 1 + j]
        code = mix(code)
        lo, hi = np.searchsorted(self.sorted_tail, code), np.searchsorted(self.sorted_tail, code, "right")
        got_end, got_pat = [], []
        for k in np.flatnonzero(hi > lo):
            e = int(ends[k]) + 1
            for which in self.order[lo[k] : hi[k]]:
                p = self.patterns[which]
                if e >= len(p) and text[e - len(p) : e].tobytes() == p:
                    got_end.append(e)
                    got_pat.append(int(which))
        return np.array(got_end, np.int64), np.array(got_pat, np.int64)


def hash_bytes(b: bytes) -> np.uint64:
    h = 0
    for x in b:
        h = (h * 0x100000001B3 + x) & 0xFFFFFFFFFFFFFFFF
    return mix(np.array([h], U64))[0]


def test_strings(texts: list[str | None], ngram: int = NGRAM) -> dict[bytes, list[int]]:
    """Padded runs of `ngram` words -> indices of the items that hold them."""
    raw, offs = strings(pa.array(texts, pa.string()))
    w = words(raw, offs)
    body = w.folded.tobytes()
    found: dict[bytes, list[int]] = {}
    for k in range(len(texts)):
        own = [body[w.start[j] : w.end[j]] for j in range(w.first[k], w.first[k + 1])]
        if not own:
            continue
        for j in range(max(1, len(own) - ngram + 1)):
            p = b" " + b" ".join(own[j : j + ngram]) + b" "
            items = found.setdefault(p, [])
            if not items or items[-1] != k:
                items.append(k)
    return found


def compile_shards(patterns: list[bytes], max_pattern_bytes: int) -> list[tuple[WuManber, int]]:
    """One searcher for each run of patterns of similar length within the byte bound, with its first index.

    Patterns come sorted by length: a shard's window is as long as its shortest pattern.
    """
    out, lo = [], 0
    while lo < len(patterns):
        hi, size = lo, 0
        while hi < len(patterns) and (hi == lo or (size + len(patterns[hi]) <= max_pattern_bytes and len(patterns[hi]) < 4 * len(patterns[lo]))):
            size += len(patterns[hi])
            hi += 1
        out.append((WuManber(patterns[lo:hi]), lo))
        lo = hi
    return out


def blocks(bench: DataFrame, ngram: int) -> Iterator[tuple[list[int | None], list[bytes], list[list[int]]]]:
    """(item ids, test strings by length, items of each test string), of about BLOCK_BYTES of the benchmark at a time."""
    own = bench.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text"))
    n = 1 + (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES
    for k in range(n):
        got = (own if n == 1 else own.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k)).toArrow()
        found = test_strings(got.column(1).to_pylist(), ngram)
        patterns = sorted(found, key=lambda p: (len(p), p))
        yield got.column(0).to_pylist(), patterns, [found[p] for p in patterns]


_compiled: dict[str, list[tuple[WuManber, int]]] = {}


def compiled(name: str, patterns: Broadcast, max_pattern_bytes: int) -> list[tuple[WuManber, int]]:
    """The searchers of a block of patterns, compiled at their first use in a worker; the last two blocks stay."""
    if name not in _compiled:
        while len(_compiled) > 1:
            _compiled.pop(next(iter(_compiled)))
        _compiled[name] = compile_shards(patterns.value, max_pattern_bytes)
    return _compiled[name]


def _scan(column: pa.Array, shards: list[tuple[WuManber, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row base, row, pattern) of every occurrence."""
    for lo, hi, raw, offs in chunks(column):
        text = normal_text(fold(raw), offs)
        heads = np.flatnonzero(text == 10)
        for searcher, base in shards:
            ends, which = searcher.find(text)
            if len(ends):
                yield lo, np.searchsorted(heads, ends, "left") - 1, which + base


def find_leaks(docs: DataFrame, bench: DataFrame, ngram: int = NGRAM, max_pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """(doc_id, item_id, hits) for every document that holds a test string; hits: matching word positions."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def search(ids: list[int | None], patterns: list[bytes], items: list[list[int]]) -> DataFrame:
        name, context = uuid.uuid4().hex, docs.sparkSession.sparkContext
        sent, shared = context.broadcast(patterns), context.broadcast((ids, items))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards, (ids, items) = compiled(name, sent, max_pattern_bytes), shared.value
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                count: dict[tuple[int, int], int] = {}
                for lo, rows, which in _scan(batch.column(1), shards):
                    for r, p in zip(rows.tolist(), which.tolist()):
                        for item in items[p]:
                            count[lo + r, item] = count.get((lo + r, item), 0) + 1
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array([doc_ids[r] for r, _ in count], pa.int64()), pa.array([ids[i] for _, i in count], pa.int64()), pa.array(list(count.values()), pa.int64())], names=["doc_id", "item_id", "hits"])

        return own.mapInArrow(run, "doc_id long, item_id long, hits long")

    return reduce(DataFrame.union, (search(*block) for block in blocks(bench, ngram)))


def drop_leaks(docs: DataFrame, bench: DataFrame, ngram: int = NGRAM, max_pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """The documents without a test string, in one scan: no join, so null and repeated ids are safe."""
    text = fresh(docs, "text_")

    def search(rows: DataFrame, block: tuple) -> DataFrame:
        name, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(block[1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards = compiled(name, sent, max_pattern_bytes)
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                for lo, found, _ in _scan(batch.column(batch.num_columns - 1), shards):
                    bad[lo + found] = True
                kept = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
                yield kept.filter(pa.array(~bad))

        return mapped(rows.select(*own_columns(rows), F.col("text").cast("string").alias(text)), run, docs.schema)

    return reduce(search, blocks(bench, ngram), docs)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}

ORACLE = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + {NGRAM - 1}), ' ') AS gram
      FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - {NGRAM - 1}))) AS i) WHERE len(w) >= {NGRAM}),
g AS (SELECT doc_id, array_to_string(list_slice(w, i, i + {NGRAM - 1}), ' ') AS gram
      FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - {NGRAM - 1})) AS i) WHERE len(w) >= {NGRAM}),
long_hits AS (SELECT g.doc_id, p.item_id, count(*) AS hits FROM g JOIN p USING (gram) GROUP BY ALL),
short AS (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS gram FROM b WHERE len(w) BETWEEN 1 AND {NGRAM - 1}),
short_hits AS (SELECT d.doc_id, s.item_id, count(*) AS hits
      FROM d, short s, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i)
      WHERE starts_with(' ' || array_to_string(list_slice(w, i, i + {NGRAM - 2}), ' ') || ' ', s.gram) GROUP BY ALL)
SELECT doc_id, item_id, CAST(hits AS BIGINT) AS hits FROM long_hits
UNION ALL SELECT doc_id, item_id, CAST(hits AS BIGINT) AS hits FROM short_hits
"""
}
