"""Near-duplicate groups by SuperMinHash (Ertl, 2017), banding, verification and union-find.

Elements are shingles of ``SHINGLE`` consecutive words (all words of a shorter text).
SuperMinHash gives each element one random permutation of the ``SIZE`` signature places
and the ranks 0 + r, 1 + r', ... along it; a place keeps its least value.  Values of
later ranks are larger, so a text's computation stops as soon as all its places are
below the next rank: after one step for long texts.  All texts of a batch take each
step together in numpy.

Equal texts are first reduced to one node each.  Signatures are cut into ``BANDS`` bands,
and a text is a candidate with those that share a band: with 40 bands of 4 places, 4 in
1,000 pairs at the threshold of 0.6 share none, and of pairs at 0.7, 2 in 100,000.  Verification compares sets of 64-bit
shingle hashes, made only for texts that have a candidate.  All pairs of a bucket would be
quadratic in a group of copies, but a group needs only enough pairs to connect it:

1. each member is verified against the least node of its bucket;
2. what is still apart in a bucket after that is verified pair by pair.

Pairs that (2) leaves out are already in one group, so the groups are those that
verifying all candidate pairs would give.  Groups are connected components, found by
alternating large-star and small-star steps (Kiveris et al., 2014), and the document
with the least doc_id stays.  Buckets and hubs are reduced by aggregations, which combine
before the shuffle, and joined back; no task has to hold one.

Defined results: texts without words (null, empty) are compared with nothing and stay;
texts of fewer words than a shingle are equal only to the same words; texts of any length
are taken whole; ids that are null come last; rows that share a doc_id and the text are
one document, of which `keep_first` keeps one row, and rows that share a doc_id only are
documents of their own; ties of the least doc_id go to the smaller hash of the text; empty
tables give empty results; extra columns of any name are carried along and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import NODE, as_id, discard, fresh, likely, marked, materialise, node, own_columns, table
from ._text import U64, WORD_SQL, Words, chunks, grams, mix, within, words

SHINGLE = 3
SIZE = 160
BANDS = 40
THRESHOLD = 0.6


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of all shingles, in order of the texts; repeated ones stay."""
    n = np.diff(w.first)
    g = grams(w.hash, SHINGLE)
    ok = within(w.first, SHINGLE, len(w.hash))
    at = np.flatnonzero(ok)
    text = np.searchsorted(w.first, at, "right") - 1
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        h = np.zeros(len(short), U64)
        for j in range(SHINGLE):
            has = n[short] > j
            h[has] = mix(h[has] + w.hash[w.first[short[has]] + j] + U64(j + 1))
        text, h = np.concatenate([text, short]), np.concatenate([g[at], h])
        order = np.argsort(text, kind="stable")
        return text[order], h[order]
    return text, g[at]


def signatures(text: np.ndarray, element: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """SuperMinHash signatures (n, size); infinite where a text has no element."""
    sig = np.full(n * size, np.inf)
    perm = None
    for j in range(size):
        if not len(text):
            break
        z = mix(element + U64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        r = (z >> U64(11)).astype(np.float64) / (1 << 53)
        k = j + (mix(z) % U64(size - j)).astype(np.int64)
        if j == 0:
            place = k
            chosen = k
        else:
            rows = np.arange(len(text))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(sig, text * size + place, r + j)
        open_ = sig.reshape(n, size).max(1) >= j + 1
        go = open_[text]
        if j == 0:
            text, element, chosen = text[go], element[go], chosen[go]
            perm = np.tile(np.arange(size, dtype=np.uint16), (len(text), 1))
            rows = np.arange(len(text))
            perm[rows, chosen] = 0
            perm[:, 0] = chosen
        elif not go.all():
            text, element, perm = text[go], element[go], perm[go]
    return sig.reshape(n, size)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    rows = sig.shape[1] // bands
    bits = np.ascontiguousarray(sig).view(U64).reshape(len(sig), bands, rows)
    key = np.arange(1, bands + 1, dtype=U64)[None, :] * U64(0xD6E8FEB86659FD93) + np.zeros((len(sig), 1), U64)
    for j in range(rows):
        key = mix(key + bits[:, :, j])
    return key


def content(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's words in order."""
    place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], np.diff(w.first))
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        v = mix(w.hash + mix(place.astype(U64) + U64(salt)))
        c = np.concatenate([np.zeros(1, U64), np.cumsum(v, dtype=U64)])
        out.append(c[w.first[1:]] - c[w.first[:-1]])
    return out[0], out[1]


def nodes(docs: DataFrame) -> DataFrame:
    return docs.select(node().alias("node"), F.col("text").cast("string").alias("text"))


def sketches(own: DataFrame) -> DataFrame:
    """(c1, c2, node, keys) of every text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offs in chunks(batch.column(1)):
                w = words(raw, offs)
                keys = band_keys(signatures(*shingles(w), hi - lo))
                a, b = content(w)
                has = np.flatnonzero(np.diff(w.first) > 0)
                flat = pa.array(keys[has].view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), flat)
                yield pa.RecordBatch.from_arrays([pa.array(a[has].view(np.int64)), pa.array(b[has].view(np.int64)), batch.column(0).take(pa.array(lo + has)), lists], names=["c1", "c2", "node", "keys"])

    return own.mapInArrow(run, f"c1 long, c2 long, node {NODE}, keys array<long>")


def shingle_sets(own: DataFrame) -> DataFrame:
    """(node, shingles): the sorted distinct shingle hashes of every text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, offs in chunks(batch.column(1)):
                text, h = shingles(words(raw, offs))
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                has, count = np.unique(text[new], return_counts=True)
                cut = np.concatenate([[0], np.cumsum(count)]) * 8
                sets = pa.Array.from_buffers(pa.large_binary(), len(has), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(h[new]))])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + has)), sets.cast(pa.binary())], names=["node", "shingles"])

    return own.mapInArrow(run, f"node {NODE}, shingles binary")


def verified(pairs: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose shingle sets have a Jaccard similarity of the threshold at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if min(len(s), len(t)) < (threshold - 1e-12) * max(len(s), len(t)):
                    keep.append(False)
                    continue
                both = np.concatenate([s, t])
                both.sort()
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(inter >= threshold * (len(both) - inter) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    # A repeated row has the same text again.
    sets = materialise(shingle_sets(likely(own, ["node"], asked).dropDuplicates(["node"])), "sets")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    out = materialise(both.select("a", "b", "s", "t").mapInArrow(run, f"a {NODE}, b {NODE}"), "verified")
    discard(asked, sets)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (a, b) with the least node that it is connected to."""
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before, last = state, now
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialise(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = materialise(small.filter("u <> v").distinct(), "edges")
        discard(large, last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())


def group(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of every document in a group of two or more."""
    own = nodes(docs)
    seen = materialise(sketches(own), "sketches")
    first = F.min(F.struct("node", "keys"))
    kinds = materialise(seen.groupBy("c1", "c2").agg(first.alias("first"), F.max("node").alias("last")).select("c1", "c2", F.col("first.node").alias("rep"), "last", F.col("first.keys").alias("keys")), "kinds")
    several = kinds.filter("rep < last").select("c1", "c2", "rep")
    copies = materialise(seen.select("c1", "c2", "node").join(several, ["c1", "c2"]).filter("node <> rep").select("node", "rep").distinct(), "copies")
    members = kinds.select(F.col("rep").alias("node"), F.xxhash64("rep").alias("nh"), F.explode("keys").alias("key"))
    # The least and the greatest hash tell whether a bucket has two nodes: sums that combine before the shuffle.
    shared = materialise(members.groupBy("key").agg(F.min("nh").alias("low"), F.max("nh").alias("high")).filter("low < high").select("key"), "shared")
    buckets = materialise(likely(members, ["key"], shared).join(shared, "key", "left_semi").select("key", "node"), "buckets")
    discard(seen, kinds, shared)
    least = buckets.groupBy("key").agg(F.min("node").alias("least"))
    tried = materialise(buckets.join(least, "key").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "tried")
    first = verified(tried, own, threshold)
    found = materialise(components(first), "groups")
    placed = materialise(buckets.join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "placed")
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    span = materialise(placed.join(split, "key", "left_semi"), "apart")
    discard(buckets, placed)
    x, y = span.alias("x"), span.alias("y")
    apart = x.join(y, F.col("x.key") == F.col("y.key")).filter("x.node < y.node AND x.root <> y.root").select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    # The pairs with the bucket's least node have been looked at already.
    rest = materialise(apart.join(tried, ["a", "b"], "left_anti"), "rest")
    discard(tried, span)
    if not rest.isEmpty():
        found = materialise(components(first.union(verified(rest, own, threshold))), "groups")
    # Copies stand beside the node that represents them, so they needn't take part in the search for components.
    roots = copies.select(F.col("rep").alias("node")).distinct().join(found, "node", "full").select("node", F.coalesce("root", "node").alias("root"))
    later = copies.join(roots.select(F.col("node").alias("rep"), "root"), "rep").select("node", "root")
    return roots.union(later)


def find_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id): every document that has a near copy, with the doc_id that stays of its group."""
    out = group(docs, threshold)
    return out.select(as_id("node").alias("doc_id"), as_id("root").alias("group_id"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without the later ones of each group, and with one row for each document."""
    key, mark = fresh(docs, "node_"), fresh(docs, "mark_")
    gone = materialise(group(docs, threshold).filter("node <> root").select(F.col("node").alias(key)), "gone")
    named = docs.withColumn(key, node())
    again = named.groupBy(key).agg(F.count("*").alias(mark)).filter(F.col(mark) > 1).select(key)
    wide = marked(named, [key], materialise(gone.union(again), "touched"), mark)
    left = wide.filter(F.col(mark)).join(gone, key, "left_anti").dropDuplicates([key])
    return wide.filter(~F.col(mark)).select(*own_columns(docs)).union(left.select(*own_columns(docs)))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op9_near_dedup": op9_near_dedup}

ORACLE = {
    "op9_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS x
      FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - {SHINGLE - 1}))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS common FROM s l JOIN s r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n k ON k.doc_id = a JOIN n m ON m.doc_id = b WHERE 10 * common >= {round(10 * THRESHOLD)} * (k.n + m.n - common)),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT a AS doc_id, least(min(b), a) AS group_id FROM c GROUP BY a
"""
}
