"""Language-model scoring by a probabilistic suffix tree (Ron, Singer and Tishby, 1996).

Symbols are the bytes of UTF-8, so every text of every language has a score.  Each text
is preceded by boundary symbols (0xFF, which UTF-8 never uses).

* Counting: every run of a context of DEPTH symbols and the symbol after it is counted
  over the whole corpus; counts of shorter contexts follow by leaving out the front.
* Retention: a context stays if it occurs ``min_count`` times at least, whatever the size
  of the corpus, and its next-symbol distribution diverges from that of the context
  without its first symbol: 2 N KL > ``penalty`` x (symbols seen) x ln(total).  Suffixes
  of retained contexts stay too, as do all contexts of one symbol.
* Smoothing: p(x|s) = (n(s,x) + d(s) p(x|parent)) / (N(s) + d(s)), d(s) being the number of
  distinct next symbols (Witten and Bell, 1991); the root's parent is uniform.
* Scoring: the tree grows with the corpus and is never in one place.  It is cut into
  shards by the last two symbols of the contexts; a shard works out the probability of
  each of its runs at the run's longest retained suffix.  Texts are put into groups of
  about GROUP_BYTES; each group asks for the runs that it holds, by a join, and adds up what
  it gets.  Texts outside the corpus ask for runs that it may not have; these count 0 there.
  The driver sees the counts of pairs of symbols only (65,536 numbers).

Defined results: a null or empty text has n_bytes 0, log2_prob 0 and bits_per_byte null;
texts of any length are scored whole; repeated rows count and are scored as often as they
occur; doc_id may be null; ties don't arise; extra columns of any name don't matter; an
empty table gives an empty result, and an empty corpus gives every symbol 1 in 257.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import discard, materialise, table
from ._text import U64, chunks, mix

MIN_COUNT = 2
GROUP_BYTES = 1 << 26
SHARD_ROWS = 1 << 20
DEPTH = 5
PENALTY = 0.5
EDGE = 0xFF
MERGE = 16


def padded(raw: np.ndarray, offs: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Each text behind `depth` boundary symbols, and where each text's own bytes begin."""
    n = len(offs) - 1
    out = np.full(len(raw) + depth * n, EDGE, np.uint8)
    if len(raw):
        out[np.arange(len(raw)) + depth * (1 + np.repeat(np.arange(n), np.diff(offs)))] = raw
    return out, offs[:-1] + depth * np.arange(1, n + 1)


def run_codes(raw: np.ndarray, offs: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """One number for each position: its `depth` symbols before it and itself, 8 bits each."""
    text, _ = padded(raw, offs, depth)
    at = np.flatnonzero(text != EDGE)
    code = np.zeros(len(at), U64)
    for j in range(depth, -1, -1):
        code = (code << U64(8)) | text[at - j]
    return code


def add_up(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[at], np.add.reduceat(count, at) if len(at) else count


def counted(column: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of depth + 1 symbols of a column of texts and how often each occurs."""
    codes: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for _, _, raw, offs in chunks(column):
        c, n = np.unique(run_codes(raw, offs, depth), return_counts=True)
        codes.append(c)
        counts.append(n)
        if len(codes) >= MERGE:
            c, n = add_up(codes, counts)
            codes, counts = [c], [n]
    return add_up(codes, counts) if codes else (np.zeros(0, U64), np.zeros(0, np.int64))


def run_log2(code: np.ndarray, n: np.ndarray, depth: int, pairs: np.ndarray, total: int, min_count: int, penalty: float) -> np.ndarray:
    """log2 probability of the last symbol of each run at its longest retained suffix.

    The runs are all those whose contexts end in certain pairs of symbols; pairs[c, x] is how often x follows c in the corpus.
    """
    size1, kinds1 = pairs.sum(1), np.count_nonzero(pairs, 1)
    used = np.count_nonzero(pairs.sum(0))
    root = (pairs.sum(0) + used / 257) / (total + used) if total else np.full(256, 1 / 257)
    prob = np.where((size1 >= min_count)[:, None], (pairs + kinds1[:, None] * root) / np.maximum(size1 + kinds1, 1)[:, None], root).ravel()
    # Contexts back to front, the symbol last: the runs of a context and of all that extend it are neighbours.
    key = np.zeros(len(code), U64)
    for j in range(1, depth + 1):
        key = (key << U64(8)) | ((code >> U64(8 * j)) & U64(255))
    key = (key << U64(8)) | (code & U64(255))
    order = np.argsort(key)
    key, n = key[order], n[order].astype(np.int64)
    levels = []
    for d in range(depth, 1, -1):
        context = key >> U64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        of = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(key)]])))
        # Runs that are asked for but don't occur count 0.
        kinds = np.add.reduceat((n > 0).astype(np.int64), first)
        size = np.add.reduceat(n, first)
        up_key = ((context >> U64(8)) << U64(8)) | (key & U64(255))
        if d > 2:
            up_key, up = np.unique(up_key, return_inverse=True)
            up_n = np.bincount(up, n).astype(np.int64)
        else:
            up = up_key.astype(np.int64)
        levels.append((n, first, kinds, of, size, up))
        if d > 2:
            key, n = up_key, up_n
    known = np.zeros(0, bool)
    keeps = []
    for i, (n, first, kinds, of, size, up) in enumerate(levels):
        if i + 1 < len(levels):
            up_n, up_size = levels[i + 1][0][up], levels[i + 1][4][levels[i + 1][3][up]]
        else:
            up_n, up_size = pairs.ravel()[up], size1[up >> 8]
        seen = n > 0
        gain = np.zeros(len(n))
        gain[seen] = n[seen] * np.log((n[seen] / size[of][seen]) / (up_n[seen] / up_size[seen]))
        gain = np.add.reduceat(gain, first)
        keep = (size >= min_count) & (2 * gain > penalty * kinds * np.log(max(total, 2)))
        if i:
            below = levels[i - 1]
            keep |= np.bincount(of[below[5][below[1]]], known, len(first)) > 0
        keeps.append(keep)
        known = keep
    for (n, first, kinds, of, size, up), keep in zip(reversed(levels), reversed(keeps)):
        base = prob[up]
        prob = np.where(keep[of], (n + kinds[of] * base) / np.maximum(size + kinds, 1)[of], base)
    if depth < 2:
        prob = prob[key.astype(np.int64)] if depth else root[key.astype(np.int64)]
    out = np.empty(len(code))
    out[order] = np.log2(prob)
    return out


class Lookup:
    """Values of 64-bit keys, found many at a time by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(2 * len(keys), 2).bit_length()
        self.keys, self.values, owner = np.zeros(1 << self.bits, U64), np.zeros(1 << self.bits, np.float32), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = owner[at] < 0
            owner[at[free]] = left[free]
            lost = owner[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(owner) - 1)
        self.used = owner >= 0
        self.keys[self.used], self.values[self.used] = keys[owner[self.used]], values[owner[self.used]]

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> U64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(keys)
        missed = np.flatnonzero((self.keys[at] != keys) | ~self.used[at])
        while len(missed):
            if not self.used[at[missed]].all():
                raise ValueError("a run of the text is not in the model")
            at[missed] = (at[missed] + 1) & (len(self.keys) - 1)
            missed = missed[(self.keys[at[missed]] != keys[missed]) | ~self.used[at[missed]]]
        return self.values[at]


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, text, grp) of the documents that have a text: groups of about GROUP_BYTES of it.

    Rows without id may be equal in great numbers, so their place in the input spreads them.
    """
    own = plain(docs).filter(F.octet_length("text") > 0)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return own.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text", place), F.lit(1 + size // GROUP_BYTES)).cast("int"))


def group_runs(own: DataFrame, depth: int) -> DataFrame:
    """(grp, code, n): how often each run of depth + 1 symbols occurs in each group."""

    def ask(texts: pa.Table) -> pa.Table:
        code, n = counted(texts.column("text"), depth)
        return pa.table({"grp": pa.array(np.full(len(code), texts.column("grp")[0].as_py(), np.int32)), "code": code.view(np.int64), "n": n})

    return materialise(own.groupBy("grp").applyInArrow(ask, "grp int, code long, n long"), "runs")


def score_corpus(docs: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT, penalty: float = PENALTY, corpus: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_bytes, log2_prob, bits_per_byte) of every document by the tree of all of them, or by that of another corpus."""
    own = grouped(docs)
    runs = group_runs(own, depth)
    known = runs if corpus is None else group_runs(grouped(corpus), depth)
    # At most 256 x 256 rows.
    top = known.groupBy(F.col("code").bitwiseAND(F.lit(0xFFFF if depth else 0xFF)).alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros((256, 256), np.int64)
    pairs.ravel()[top.column("pair").to_numpy()] = top.column("n").to_numpy()
    total = int(pairs.sum())
    shared = own.sparkSession.sparkContext.broadcast(pairs)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(codes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
            code = np.concatenate(codes)
            value = run_log2(code.view(U64), np.concatenate(counts), depth, shared.value, total, min_count, penalty)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(value, pa.float32())], names=["code", "log2"])

        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, code, n = (batch.column(k).to_numpy() for k in range(3))
            if sum(map(len, codes)) + len(code) > SHARD_ROWS:
                # Up to the last change of key everything is whole.
                at = int(np.searchsorted(key, key[-1]))
                if at or codes and (codes[-1][-1] >> 8) & 0xFFFF != key[0]:
                    yield done([*codes, code[:at]], [*counts, n[:at]])
                    codes, counts, code, n = [], [], code[at:], n[at:]
            codes.append(code)
            counts.append(n)
        if codes:
            yield done(codes, counts)

    every = known.select("code", "n") if corpus is None else known.select("code", "n").union(runs.select("code", F.lit(0)))
    counts = every.groupBy("code").agg(F.sum("n").alias("n")).select(F.shiftrightunsigned("code", 8).bitwiseAND(F.lit(0xFFFF)).alias("key"), "code", "n")
    model = counts.repartition("key").sortWithinPartitions("key").mapInArrow(shard, "code long, log2 float")
    asked = runs.select("grp", "code").join(model, "code")

    def add(texts: pa.Table, known: pa.Table) -> pa.Table:
        value = Lookup(known.column("code").to_numpy().view(U64), known.column("log2").to_numpy())
        totals, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
        for _, _, raw, offs in chunks(texts.column("text")):
            sizes.append(np.diff(offs))
            totals.append(np.bincount(np.repeat(np.arange(len(offs) - 1), sizes[-1]), value.of(run_codes(raw, offs, depth)), len(offs) - 1))
        t, n = np.concatenate(totals), np.concatenate(sizes)
        rate = pa.array(np.round(-t / np.maximum(n, 1), 6), mask=n == 0)
        return pa.table({"doc_id": texts.column("doc_id"), "n_bytes": n, "log2_prob": np.round(t, 3) + 0.0, "bits_per_byte": rate})

    scored = own.groupBy("grp").cogroup(asked.groupBy("grp")).applyInArrow(add, "doc_id long, n_bytes long, log2_prob double, bits_per_byte double")
    blank = plain(docs).filter("text IS NULL OR text = ''")
    return scored.union(blank.select("doc_id", F.lit(0).cast("long"), F.lit(0.0), F.lit(None).cast("double")))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))


QUERIES = {"op1_lm_score": op1_lm_score}
ORACLE: dict[str, str] = {}
