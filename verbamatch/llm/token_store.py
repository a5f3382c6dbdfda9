"""Content-addressed store of token ids.

Texts become ids of a public byte-level BPE vocabulary (two bytes each; the file's path
is a parameter).  A rolling hash over ``WINDOW`` ids cuts each id stream where its low bits
are zero, so an insertion moves only the cuts near it; chunks shorter than ``SHORTEST`` go
on, and one of ``LONGEST`` ids is cut anyway.  A chunk's address is the SHA-256 of its
bytes.  The store has

* chunks: each address once, with its bytes;
* references: for each document the addresses in order, its recipe;
* manifests: for each document the number of its chunks and tokens and the Merkle root over
  its recipe, as they were when it was tokenized.

Texts are tokenized once and go through one shuffle, after which a sorted pass writes
chunks, references and manifests in one go.  A task sends a chunk's bytes once, to the
place of its address; rows without bytes go anywhere, so a chunk that a third of all
documents share is no burden to one task.

Pre-tokens follow the vocabulary's pattern with numpy over character classes; each
distinct pre-token is encoded once per worker.  Texts with an apostrophe, where the
pattern has contractions, are encoded as a whole; ids are the same either way.

Defined results: null and empty texts have no chunks and the root of nothing (SHA-256 of
the empty string); texts of any length are stored whole; rows that share a doc_id are told
apart by a hash of the text, and equal rows share one recipe, counted in `copies`; doc_id
may be null; an empty table gives an empty store; extra columns of any name don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import shared_dir, table
from ._text import U64, chunks, mix, powers

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW = 16
CUT_BITS = 8
SHORTEST = 64
LONGEST = 2048
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def classes() -> np.ndarray:
    """Character class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    # White space as Unicode's property has it; str.isspace also counts U+001C-U+001F.
    for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = SPACE
    return out


def pretokens(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts without apostrophes, given as code points one after another; first[k]: start of text k, and the end."""
    k = classes()[code]
    n = len(k)
    head = np.ones(n + 1, bool)
    head[1:-1] = k[1:] != k[:-1]
    head[first] = True
    begin = np.flatnonzero(head[:-1])
    end = np.concatenate([begin[1:], [n]])
    closes = np.zeros(n + 1, bool)
    closes[first] = True
    blank = (k[begin] == SPACE) & ~closes[end]
    last = end - 1
    # The last white space before a word is a token of its own, or the word's if it is a plain space.
    joins = blank & (code[last] == 32)
    splits = blank & (end - begin > 1)
    starts = head[:-1]
    starts[last[splits]] = True
    starts[last[joins]] = True
    starts[end[joins]] = False
    return np.flatnonzero(starts)


class Tokenizer:
    """Ids of texts, with a memory of pre-tokens: a table by hash with places in a pool of ids."""

    SLOTS = 20
    POOL = 1 << 22

    def __init__(self, path: str):
        self.encoding = encoding(path)
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(1 << self.SLOTS, U64)
        self.base = np.zeros(1 << self.SLOTS, np.int32)
        self.size = np.zeros(1 << self.SLOTS, np.int32)
        self.pool = np.zeros(0, np.uint16)

    def _ids(self, body: bytes, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, number of ids) of each pre-token body[a:b] of hash h."""
        if len(self.pool) > self.POOL:
            self._forget()
        slot = (h >> U64(64 - self.SLOTS)).astype(np.int64)
        base, size = self.base[slot].astype(np.int64), self.size[slot].astype(np.int64)
        miss = np.flatnonzero((self.key[slot] != h) | (size == 0))
        if len(miss):
            hm, at, which = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[at]
            new = [self.encoding.encode_ordinary(body[x:y].decode()) for x, y in zip(a[at].tolist(), b[at].tolist())]
            n = np.array([len(x) for x in new])
            start = len(self.pool) + np.cumsum(n) - n
            self.pool = np.concatenate([self.pool, np.fromiter((i for x in new for i in x), np.uint16)])
            place = slot[at]
            self.key[place], self.base[place], self.size[place] = hm, start, n
            base[miss], size[miss] = start[which], n[which]
        return base, size

    def many(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a chunk of texts."""
        n = len(offs) - 1
        if not len(raw):
            return np.zeros(0, np.uint16), np.zeros(n + 1, np.int64)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        body = raw.tobytes()
        code = np.frombuffer(body.decode().encode("utf-32-le"), np.uint32)
        first = np.searchsorted(lead, offs)  # a text's first character
        start = pretokens(code, first)
        edge = np.concatenate([lead, [len(raw)]])
        a = edge[start]
        b = np.concatenate([a[1:], [len(raw)]])
        pw, inv = powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, U64)
        np.cumsum((raw.astype(U64) + U64(1)) * pw[: len(raw)], out=sums[1:])
        h = mix((sums[b] - sums[a]) * inv[a] + (b - a).astype(U64))
        base, size = self._ids(body, h, a, b)
        cut = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(base - cut[:-1], size) + np.arange(cut[-1])]
        out = cut[np.searchsorted(start, first)]
        quoted = np.zeros(n, bool)
        quoted[np.searchsorted(first, np.flatnonzero(code == 39), "right") - 1] = True
        if quoted.any():
            parts = [np.array(self.encoding.encode_ordinary(body[offs[k] : offs[k + 1]].decode()), np.uint16) if quoted[k] else ids[out[k] : out[k + 1]] for k in range(n)]
            ids, out = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, out


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker: its memory serves all tasks that the worker runs."""
    return Tokenizer(path)


def cut_points(ids: np.ndarray, offs: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each id stream ids[offs[k] : offs[k + 1]], counted from its start."""
    n = len(ids)
    pw, inv = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(mix(ids.astype(U64) + U64(1)) * inv[:n], out=sums[1:])
    at = np.arange(n)
    begin = np.maximum(at + 1 - WINDOW, np.repeat(offs[:-1], np.diff(offs)))
    roll = (sums[1:] - sums[begin]) * pw[:n]
    wanted = np.flatnonzero((mix(roll) >> U64(64 - CUT_BITS)) == 0) + 1
    # A cut at a stream's end is the last one of its own stream.
    upto = np.searchsorted(wanted, offs, "right").tolist()
    wanted, offs = wanted.tolist(), offs.tolist()
    out = []
    for k in range(len(offs) - 1):
        first, size, i, most = offs[k], offs[k + 1] - offs[k], upto[k], upto[k + 1]
        ends, last = [], 0
        while last < size:
            while i < most and wanted[i] - first - last < SHORTEST:
                i += 1
            nearest = wanted[i] - first if i < most else size
            last = min(nearest, last + LONGEST, size)
            ends.append(last)
        out.append(ends)
    return out


def merkle(addresses: list[bytes]) -> bytes:
    """Root of the binary hash tree over the addresses; an odd one goes up as it is."""
    if not addresses:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + a).digest() for a in addresses]
    while len(level) > 1:
        up = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = up + level[len(level) - len(level) % 2 :]
    return level[0]


def write_store(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> None:
    """Write the table of chunks and references at `path`, partitioned by kind."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("text_hash"), F.col("text").cast("string").alias("text"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tokenizer, sent = tokenizer(vocabulary), set()
        for batch in batches:
            for lo, hi, raw, offs in chunks(batch.column(2)):
                ids, cut = own_tokenizer.many(raw, offs)
                body, begin = ids.tobytes(), (2 * cut).tolist()
                row, number, address, data, tokens = [], [], [], [], []
                for k, ends in enumerate(cut_points(ids, cut)):
                    last, recipe = begin[k], []
                    for end in ends:
                        piece = body[last : begin[k] + 2 * end]
                        last += len(piece)
                        a = hashlib.sha256(piece).digest()
                        recipe.append(a)
                        # A task sends each chunk's bytes once.
                        data.append(None if a in sent else piece)
                        sent.add(a)
                    m = len(recipe)
                    row += [lo + k] * (m + 1)
                    number += range(m + 1)
                    address += recipe
                    address.append(merkle(recipe))
                    data.append(None)
                    tokens += [None] * m
                    tokens.append((begin[k + 1] - begin[k]) // 2)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(number, pa.int32()), pa.array(address), pa.array(data, pa.binary()), pa.array(tokens, pa.int32())], names=["doc_id", "text_hash", "number", "address", "data", "tokens"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            told = batch.filter(batch.column(5).is_valid())
            batch = batch.filter(batch.column(5).is_null())
            m, n = told.num_rows, batch.num_rows
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(["manifest"] * m), *told.columns[:4], pa.nulls(m, pa.binary()), told.column(5)], names=NAMES)
            if not n:
                continue
            # Rows with the bytes of one address are neighbours.
            full = batch.filter(batch.column(4).is_valid())
            new = []
            for a in full.column(3).to_pylist():
                new.append(a != last)
                last = a
            kept = full.filter(pa.array(new, pa.bool_()))
            empty = pa.nulls(kept.num_rows, pa.int64())
            size = pa.array([len(x) // 2 for x in kept.column(4).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * kept.num_rows, pa.string()), empty, empty, pa.nulls(kept.num_rows, pa.int32()), kept.column(3), kept.column(4), size], names=NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(["reference"] * n), *batch.columns[:4], pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())], names=NAMES)

    rows = own.mapInArrow(tokenize, "doc_id long, text_hash long, number int, address binary, data binary, tokens int")
    route = F.when(F.col("data").isNull(), F.xxhash64("doc_id", "text_hash", "number", F.spark_partition_id())).otherwise(F.xxhash64("address"))
    rows = rows.withColumn("route", route).repartition("route").sortWithinPartitions("route", "address")
    rows.drop("route").mapInArrow(store, SCHEMA).write.partitionBy("kind").parquet(path)


NAMES = ["kind", "doc_id", "text_hash", "number", "address", "data", "size"]
SCHEMA = "kind string, doc_id long, text_hash long, number int, address binary, data binary, size int"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, copies, n_chunks, n_tokens, root, verified) of every recipe.

    Verified: every address of the recipe is in the store, the bytes stored there hash to
    it, and the recipe has the numbering, count, tokens and root that its manifest has from
    the time it was written, so following it gives the ids that were put in.  A document of
    which only the manifest or only references are left is not verified.
    """
    stored = spark.read.schema(SCHEMA).parquet(path)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [hashlib.sha256(x.as_buffer()).digest() == a.as_py() and 2 * s.as_py() == len(x.as_buffer()) for a, s, x in zip(*batch.columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["address", "size", "good"])

    known = stored.filter("kind = 'chunk'").select("address", "size", "data").mapInArrow(hashed, "address binary, size int, good boolean")
    used = stored.filter("kind = 'reference'").select("doc_id", "text_hash", "number", "address").join(known, "address", "left")
    own = ["doc_id", "text_hash"]
    lists = used.groupBy(*own, "number", "address").agg(F.count("*").alias("copies"), F.first("size").alias("size"), F.first("good").alias("good"))
    lists = lists.select(*own, "copies", F.struct("number", "address").alias("part"), "size", F.coalesce("good", F.lit(False)).alias("good"), F.lit(None).cast("struct<number:int,root:binary,size:int>").alias("told"))
    told = stored.filter("kind = 'manifest'").groupBy(*own, F.struct("number", F.col("address").alias("root"), "size").alias("told")).agg(F.count("*").alias("copies"))
    told = told.select(*own, "copies", F.lit(None).cast("struct<number:int,address:binary>").alias("part"), F.lit(None).cast("int").alias("size"), F.lit(True).alias("good"), "told")
    lists = lists.union(told).groupBy(*own).agg(
        F.coalesce(F.max(F.when(F.col("told").isNotNull(), F.col("copies"))), F.max("copies")).alias("copies"),
        F.sort_array(F.collect_list("part")).alias("recipe"),
        F.sum(F.coalesce("size", F.lit(0))).alias("n_tokens"),
        # Each reference and the manifest occur once a copy.
        (F.bool_and("good") & (F.min("copies") == F.max("copies")) & (F.count("told") == 1)).alias("verified"),
        F.max("told").alias("told"),
    )

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, told = batch.column(2).to_pylist(), batch.column(5).to_pylist()
            recipes = [[x["address"] for x in r] for r in parts]
            roots = [merkle(r) for r in recipes]
            good = [
                v and [x["number"] for x in r] == list(range(m["number"])) and root == m["root"] and n == m["size"]
                for v, r, root, n, m in zip(batch.column(4).to_pylist(), parts, roots, batch.column(3).to_pylist(), told)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(r) for r in recipes], pa.int64()), batch.column(3), pa.array([r.hex() for r in roots]), pa.array(good, pa.bool_())], names=["doc_id", "copies", "n_chunks", "n_tokens", "root", "verified"])

    return lists.select("doc_id", "copies", "recipe", "n_tokens", "verified", "told").mapInArrow(rooted, "doc_id long, copies long, n_chunks long, n_tokens long, root string, verified boolean")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text_hash, ids): every document's ids as bytes, put together from the store."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    known = stored.filter("kind = 'chunk'").select("address", "data")
    used = stored.filter("kind = 'reference'").select("doc_id", "text_hash", "number", "address").distinct().join(known, "address", "left")
    # A document without chunks has a manifest only.
    told = stored.filter("kind = 'manifest'").select("doc_id", "text_hash").distinct()
    used = used.select("doc_id", "text_hash", "number", "data").union(told.select("*", F.lit(-1), F.lit(b"")))
    parts = used.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("number", F.coalesce("data", F.lit(b"")).alias("data")))).alias("p"))
    return parts.select("doc_id", "text_hash", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("ids"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), path)
    return manifests(spark, path)


QUERIES = {"op4_token_store": op4_token_store}
ORACLE: dict[str, str] = {}
