"""Kernels over blocks of texts: their terms, how often each occurs, and scores against many queries.

All work on the bytes of Arrow columns, so no Python string is made per word. A word gets a number
within its block and a pair of words the two numbers, so terms are counted by sorting integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text of a block in bytes. A text is never split, so a longer one is a block of its own.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 1 << 15
#: Rows of a batch that goes back to the JVM; products of postings and queries at a time.
OUT_ROWS, STEP = 1 << 16, 1 << 21

_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_") + list(range(128, 256))] = True
_SOLID = np.ones(256, bool)
_SOLID[[10, 32]] = False


class Kind(NamedTuple):
    """How texts fall into words: bytes of words, the least length in bytes, and whether pairs of neighbours count too."""

    word: np.ndarray
    least: int
    pairs: bool


#: For texts as index.spelled gives them; rows that share a position are lines of one text.
KINDS = {"tfidf": Kind(_WORD, 2, True), "bm25": Kind(_SOLID, 1, False)}


def words(texts: pa.Array, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, line, number) of every word in order, and the words by number. Lines are numbered over all rows."""
    off = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    buf = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    mask = kind.word[buf]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    # Rows touch each other without a separator.
    inner = off[:-1][off[:-1] < len(buf)]
    first[inner] = mask[inner]
    inner = inner[inner > 0]
    last[inner - 1] = mask[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = ends - starts
    if kind.least > 1:
        short = size < kind.least
        for k in range(kind.least - 1):
            at = starts[short & (size > k)] + k
            mask[at] = False
        starts, size = starts[~short], size[~short]
    row = np.searchsorted(off, starts, "right") - 1
    line = row + np.searchsorted(np.flatnonzero(buf == 10), starts)
    ends = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=ends[1:])
    found = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf[mask]))])
    coded = found.dictionary_encode()
    return row, line, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def plain(texts) -> pa.Array:
    """A column as one array of texts, nothing in place of nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    return pc.fill_null(texts.cast(pa.string()), "")


def packed(raw) -> bytes:
    """Bytes as they are shuffled: their number, then zstd."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(value: pa.BinaryScalar) -> pa.Buffer:
    raw = value.as_buffer()
    return pa.Codec("zstd").decompress(raw.slice(8), int.from_bytes(raw.slice(0, 8).to_pybytes(), "little"))


NULL = np.iinfo(np.int64).min


def positions(column) -> np.ndarray:
    """Positions as integers; a null one is NULL."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.int64()), NULL).to_numpy(zero_copy_only=False)


def column(pos: np.ndarray) -> pa.Array:
    return pa.array(pos, pa.int64(), mask=pos == NULL)


class Block(NamedTuple):
    """Postings (row, term, tf) of a block by row; distinct terms lie by bucket, with the bounds of the buckets and the rows `n` that hold each."""

    row: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    n: np.ndarray
    codes: np.ndarray
    vocabulary: pa.Array
    bounds: np.ndarray

    def terms(self) -> pa.Array:
        """Every distinct term of the block in its order."""
        v = len(self.vocabulary)
        pair = self.codes >= v
        first = np.where(pair, (self.codes - v) // max(v, 1), self.codes)
        second = np.where(pair, (self.codes - v) % max(v, 1), 0)
        joined = pc.binary_join_element_wise(self.vocabulary.take(pa.array(first)), self.vocabulary.take(pa.array(second)), " ")
        return pc.if_else(pa.array(pair), joined, self.vocabulary.take(pa.array(first)))


def block_of(texts: pa.Array, kind: Kind, buckets: int) -> Block:
    row, line, code, vocabulary = words(texts, kind)
    v = len(vocabulary)
    if kind.pairs:
        near = line[1:] == line[:-1]
        row, code = np.concatenate([row, row[1:][near]]), np.concatenate([code, v + code[:-1][near] * v + code[1:][near]])
    size = v + v * v
    if size and len(texts) > (1 << 62) // size:
        raise ValueError("a block has too many rows for its vocabulary")
    key, tf = np.unique(row * size + code, return_counts=True)
    row, code = np.divmod(key, max(size, 1))
    codes, term = np.unique(code, return_inverse=True)
    bucket = _bucket(codes, vocabulary, buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    term = place[term]
    return Block(row, term, tf, np.bincount(term, minlength=len(codes)), codes[order], vocabulary, np.searchsorted(bucket[order], np.arange(buckets + 1)))


def _bucket(codes: np.ndarray, vocabulary: pa.Array, buckets: int) -> np.ndarray:
    """By the words themselves, so that a term has the same bucket in all blocks."""
    v = len(vocabulary)
    if not v:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(crc32, vocabulary.cast(pa.binary()).to_pylist()), np.uint64, v)
    pair = codes >= v
    first, second = h[np.where(pair, (codes - v) // v, codes)], h[np.where(pair, (codes - v) % v, 0)]
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + np.where(pair, second * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1), np.uint64(0))
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (pos, text, ...) in pieces of about BLOCK_BYTES of text and BLOCK_ROWS at most."""
    for batch in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            to = min(at + BLOCK_ROWS, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, "right"))), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


class Asked(NamedTuple):
    """Terms that queries ask for, numbered as given: single words by the number of the word, pairs by a key of both words."""

    vocabulary: pa.Array
    single: np.ndarray
    pair_keys: np.ndarray
    pair_terms: np.ndarray
    count: int


def asked_for(terms: list[str], kind: Kind) -> Asked:
    split = [t.split(" ") if kind.pairs else [t] for t in terms]
    vocabulary = sorted({w for x in split for w in x})
    number = {w: i for i, w in enumerate(vocabulary)}
    single = np.full(len(vocabulary), -1, np.int64)
    keys, own = [], []
    for i, x in enumerate(split):
        if len(x) == 1:
            single[number[x[0]]] = i
        else:
            keys.append(number[x[0]] * len(vocabulary) + number[x[1]])
            own.append(i)
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return Asked(pa.array(vocabulary, pa.string()), single, np.array(keys, np.int64)[order], np.array(own, np.int64)[order], len(terms))


def found_in(texts: pa.Array, kind: Kind, asked: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, term, tf, words in the line of the term's first place, words in all) of what is asked for, by row and term."""
    row, line, code, vocabulary = words(texts, kind)
    known = pc.fill_null(pc.index_in(vocabulary, value_set=asked.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    word = known[code]
    held = np.flatnonzero(word >= 0)
    term = asked.single[word[held]]
    at, term = held[term >= 0], term[term >= 0]
    if len(asked.pair_keys):
        first = held[:-1][(held[1:] == held[:-1] + 1) & (line[held[1:]] == line[held[:-1]])]
        key = word[first] * len(asked.vocabulary) + word[first + 1]
        place = np.minimum(np.searchsorted(asked.pair_keys, key), len(asked.pair_keys) - 1)
        hit = asked.pair_keys[place] == key
        at, term = np.concatenate([at, first[hit]]), np.concatenate([term, asked.pair_terms[place[hit]]])
    key, start, tf = np.unique(row[at] * asked.count + term, return_index=True, return_counts=True)
    own, term = np.divmod(key, max(asked.count, 1))
    return own, term, tf, np.bincount(line)[line[at[start]]] if len(at) else term, len(row)


def products(own: np.ndarray, term: np.ndarray, value: np.ndarray, start: np.ndarray, query: np.ndarray, weight: np.ndarray, queries: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, query, score): sums of value x weight over the terms of each row and the queries from start[term] to start[term + 1]."""
    each = start[term + 1] - start[term]
    ends = np.cumsum(each)
    cuts = np.append(np.flatnonzero(np.diff(own)) + 1, len(own)) if len(own) else np.zeros(0, np.int64)
    at = k = 0
    while at < len(own):
        base = ends[at - 1] if at else 0
        k = max(k + 1, int(np.searchsorted(ends[cuts - 1], base + STEP, "right")))
        to = cuts[k - 1]
        n = each[at:to]
        place = np.repeat(start[term[at:to]] - (ends[at:to] - n - base), n) + np.arange(n.sum())
        rows = own[at:to] - own[at]
        key, part = np.repeat(rows, n) * queries + query[place], np.repeat(value[at:to], n) * weight[place]
        cells = (int(rows[-1]) + 1) * queries
        if cells <= 4 * STEP:
            full = np.bincount(key, part, cells)
            some = np.flatnonzero(full)
            total = full[some]
        else:
            some, back = np.unique(key, return_inverse=True)
            total = np.bincount(back, part, len(some))
        yield some // queries + own[at], some % queries, total
        at = to


def best_of(query: np.ndarray, pos: np.ndarray, score: np.ndarray, n: int, slack: np.ndarray | float) -> np.ndarray:
    """Places of each query's n best by score, ties by position, and of what lies within the query's slack of the last of them.

    The slack keeps whatever a later rounding could still put in another order; of equal scores n are enough.
    """
    if not len(query):
        return np.zeros(0, np.int64)
    order = np.lexsort((pos, -score, query))
    q, s = query[order], score[order]
    new = np.append(True, q[1:] != q[:-1])
    head = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    rank = np.arange(len(q)) - head[which]
    kth = s[np.minimum(head + n, np.append(head[1:], len(q))) - 1]
    equal = np.append(True, new[1:] | (s[1:] != s[:-1]))
    run = np.flatnonzero(equal)
    within = np.arange(len(q)) - run[np.cumsum(equal) - 1]
    margin = slack[q] if isinstance(slack, np.ndarray) else slack
    return order[(rank < n) | ((s >= kth[which] - margin) & (within < n))]
