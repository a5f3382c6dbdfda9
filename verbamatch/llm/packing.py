"""Packing in space-filling-curve order.

Every document becomes a hashed bag-of-words vector (feature hashing with signs,
log-damped counts, unit length), a fixed random matrix with columns of unit length projects
it to ``DIMS`` dimensions, each coordinate (within [-1, 1], whatever the text) is cut to
``BITS`` bits and the cell's place on the Hilbert curve (Skilling, 2004) is the document's
key.  A range sort by the key lays the corpus out along the curve, and the curve is cut
into sequences of ``context`` token ids: neighbours on the curve share a sequence, nothing
is padded but the last.  Ids are those of `token_store`'s vocabulary, 16 bits each, low byte
first; each document that has any is followed by ``END``.

Texts are tokenized once and written with their keys.  The range sort moves keys and
lengths only.  The running offset is global but needs no single task: sorted partitions
are checkpointed, their totals (one row a partition) come to the driver, and each
partition adds its base to its own running sum.  Offsets then join the ids by row.

Defined results: a null or empty text has no ids, key 0 and one piece of length 0 at its
place on the curve; a text without words has key 0; texts of any length are packed whole,
over as many sequences as they need; ties of the key go by doc_id (nulls first), then by a
hash of the text; repeated rows are packed as often as they occur; an empty table gives no
pieces; extra columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import materialise, shared_dir, table
from ._text import U64, chunks, mix, words
from .token_store import VOCABULARY, tokenizer

CONTEXT = 2048
FEATURES = 256
DIMS = 3
BITS = 16
SEED = 7
END = 50256  # the vocabulary leaves this id free


def projection(seed: int = SEED) -> np.ndarray:
    m = np.random.default_rng(seed).standard_normal((FEATURES, DIMS))
    return m / np.sqrt((m * m).sum(0))


def vectors(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Hashed, damped, unit-length vectors: one row for each of n texts."""
    h = mix(hashes ^ U64(0xA0761D6478BD642F))
    slot = (h >> U64(56)).astype(np.int64) % FEATURES
    sign = np.where(h & U64(1), 1.0, -1.0)
    v = np.bincount(doc * FEATURES + slot, sign, n * FEATURES).reshape(n, FEATURES)
    v = np.sign(v) * np.log1p(np.abs(v))
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cells(points: np.ndarray) -> np.ndarray:
    """Coordinates in [-1, 1] to unsigned cells of BITS bits."""
    return np.floor((np.round(points, 9) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)


def hilbert(x: np.ndarray) -> np.ndarray:
    """Place of each row of cells (n, DIMS) on the Hilbert curve, by Skilling's transpose form."""
    x = x.copy().T
    d = len(x)
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (BITS - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, h, curve_key, n_tokens, ids) of every document; h: hash of its text."""
    matrix = projection()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tokenizer = tokenizer(vocabulary)
        for batch in batches:
            for lo, hi, raw, offs in chunks(batch.column(2)):
                w = words(raw, offs)
                key = np.where(np.diff(w.first) > 0, hilbert(cells(vectors(w.hash, w.doc, hi - lo) @ matrix)), 0)
                ids, at = own_tokenizer.many(raw, offs)
                size = np.diff(at)
                has = size > 0
                ids = np.insert(ids, at[1:][has], END)
                at = at + np.concatenate([[0], np.cumsum(has)])
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(2 * at.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(key), pa.array(size + has), binary], names=["doc_id", "h", "curve_key", "n_tokens", "ids"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text).mapInArrow(run, "doc_id long, h long, curve_key long, n_tokens long, ids binary")


def cut(start: np.ndarray, length: np.ndarray, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (row, sequence, place in the sequence, tokens) of documents lying at start on the line."""
    first, last = start // context, np.maximum(start + length - 1, start) // context
    n = last - first + 1
    row = np.repeat(np.arange(len(start)), n)
    seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    lo = np.maximum(start[row], seq * context)
    hi = np.minimum(start[row] + length[row], (seq + 1) * context)
    return row, seq, lo - seq * context, hi - lo


def pack(docs: DataFrame, context: int = CONTEXT, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces: doc_id, seq_id, seq_start (place in the sequence), doc_start (token of the document), n_tokens, curve_key, ids."""
    shared_dir(docs.sparkSession)
    kept = materialise(curve_keys(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), "curve")
    order = ["curve_key", "doc_id", "h", "row"]
    placed = kept.select(*order, "n_tokens").repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n_tokens", F.spark_partition_id().alias("part")).checkpoint()
    # One row a partition.
    totals = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, run_to = {}, 0
    for part, n in totals:
        base[part] = run_to
        run_to += n

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(1).to_numpy()
            if at is None:
                at = base[batch.column(2)[0].as_py()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at + np.cumsum(length) - length)], names=["row", "start"])
            at += int(length.sum())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            start = batch.column("start").to_numpy()
            row, seq, place, n = cut(start, batch.column("n_tokens").to_numpy(), context)
            doc_start = seq * context + place - start[row]
            # The pieces of a batch follow one another as its documents' ids do.
            whole = batch.column("ids").cast(pa.large_binary())
            _, held, flat = whole.buffers()
            ends = np.frombuffer(held, np.int64)[whole.offset] + np.concatenate([[0], np.cumsum(2 * n)])
            ids = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), flat]).cast(pa.binary())
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), pa.array(seq), pa.array(place), pa.array(doc_start), pa.array(n), batch.column("curve_key").take(take), ids], names=["doc_id", "seq_id", "seq_start", "doc_start", "n_tokens", "curve_key", "ids"])

    starts = placed.mapInArrow(offsets, "row long, start long")
    return kept.drop("h").join(starts, "row").mapInArrow(pieces, "doc_id long, seq_id long, seq_start long, doc_start long, n_tokens long, curve_key long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """(seq_id, n_tokens, ids, parts) of every sequence, ready to train on; parts: (seq_start, doc_id, doc_start) of each document in it."""
    parts = pieces.filter("n_tokens > 0").groupBy("seq_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("seq_start", "doc_id", "doc_start", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    return parts.select("seq_id", "n_tokens", ids, F.transform("p", lambda x: F.struct(x["seq_start"].alias("seq_start"), x["doc_id"].alias("doc_id"), x["doc_start"].alias("doc_start"))).alias("parts"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
ORACLE: dict[str, str] = {}
