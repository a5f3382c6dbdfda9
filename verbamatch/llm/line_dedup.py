"""Line deduplication by a deletion-neighbourhood join.

A line goes if an earlier one (smaller doc_id, then smaller line number) lies within
the edit bound: ``max_edits`` edits (Levenshtein, in characters) and ``MAX_RATE`` of the
longer line's characters.  Two lines within one edit share a variant with at most one
character deleted (as in FastSS, Bocek et al., 2007), so variants are emitted as hashed
keys, equal keys are joined, and each pair's distance is verified.  The bound is 0 or 1:
a line of n characters has n**k / k! variants of k deletions, which long lines rule out
for more.

Emitting all variants of all lines would cost a row for each character of the corpus.
Lines are first reduced to distinct ones; then only lines that share a half with another
one are let through: one edit leaves the first or the second half as it was, so each
line is keyed by both halves, cut as for its own length and as for one character less.
This loses no pair.  Only documents that hold such lines are shuffled, to fetch their
texts, and `drop_lines` shuffles only documents that lose a line.

White space around a line doesn't count, and lines of white space only are never
compared or removed.

Defined results: null and empty texts have no lines; ids that are null come after all
others; rows that share a doc_id and the text are one document, and of rows that share
a doc_id only, the one with the smaller hash of its text comes first; of equal lines in
one document the first stays; lines and texts of any length are compared whole; empty
tables give empty results; extra columns of any name are carried along and not looked
at.  `drop_lines` keeps all columns, corrects n_chars where there is one, and drops a
document only if it had lines and all are gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import NODE, as_id, discard, fresh, likely, mapped, marked, materialise, node, own_columns, table
from ._text import U64, chunks, mix, powers

MAX_EDITS = 1
MAX_RATE = 0.1
LEAST = 9  # characters of a line that can be within one edit and MAX_RATE of another
SPACE = b" \t\r\x0b\x0c"

_BLANK = np.zeros(256, bool)
for _b in SPACE + b"\n":
    _BLANK[_b] = True
_SECOND = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


class Lines:
    """The trimmed, non-empty lines of a chunk of texts, and hashes of any range of their bytes."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.raw = raw
        n = len(raw)
        cuts = np.flatnonzero(raw == 10)
        text_of_cut = np.searchsorted(offs, cuts, "right") - 1
        start = np.sort(np.concatenate([offs[:-1], cuts + 1]), kind="stable")
        end = np.sort(np.concatenate([offs[1:], cuts]), kind="stable")
        per = np.bincount(text_of_cut, minlength=len(offs) - 1) + 1
        text = np.repeat(np.arange(len(offs) - 1), per)
        number = np.arange(len(start)) - np.repeat(np.cumsum(per) - per, per)
        shown = np.flatnonzero(~_BLANK[raw])
        a, b = np.searchsorted(shown, start), np.searchsorted(shown, end)
        has = np.flatnonzero(b > a)
        self.text, self.number = text[has], number[has]
        self.start, self.end = shown[a[has]], shown[b[has] - 1] + 1
        self.pow, self.inv = powers(n + 1)
        self.sums = self._sums(raw.astype(U64) + U64(1))
        self.lead = np.flatnonzero((raw & 0xC0) != 0x80)
        self.first_char = np.searchsorted(self.lead, self.start)
        self.chars = np.searchsorted(self.lead, self.end) - self.first_char

    def _sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.pow[: len(values)], out=out[1:])
        return out

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inv[a] + (b - a).astype(U64))

    def second(self) -> np.ndarray:
        sums = self._sums(_SECOND[self.raw])
        return mix((sums[self.end] - sums[self.start]) * self.inv[self.start])

    def byte(self, line: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Byte at which a character of a line starts; the line's end for the one after its last."""
        at = self.first_char[line] + char
        inside = char < self.chars[line]
        return np.where(inside, self.lead[np.minimum(at, len(self.lead) - 1)], self.end[line])

    def halves(self, line: np.ndarray) -> np.ndarray:
        """Keys (lines, 4): the halves of each line as for its own length and as for one less."""
        out = []
        n = self.chars[line]
        for tag, size in ((0, n), (1, n - 1)):
            half = size // 2
            first = self.hash(self.start[line], self.byte(line, half))
            last = self.hash(self.byte(line, n - (size - half)), self.end[line])
            for side, h in ((0, first), (1, last)):
                out.append(mix(h ^ mix((size * 2 + side).astype(U64))))
        return np.stack(out, 1)

    def deletions(self, line: int) -> np.ndarray:
        """Hashes of a line and of it without each one of its characters."""
        n, s, e = self.chars[line], self.start[line], self.end[line]
        at = np.concatenate([self.lead[self.first_char[line] : self.first_char[line] + n], [e]])
        a, b = at[:-1], at[1:]
        head = (self.sums[a] - self.sums[s]) * self.inv[s]
        tail = (self.sums[e] - self.sums[b]) * self.inv[b] * self.pow[a - s]
        one = mix(head + tail + (e - s - (b - a)).astype(U64))
        return np.unique(np.concatenate([self.hash(np.array([s]), np.array([e])), one]))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, raw, offs in chunks(batch.column(1)):
            x = Lines(raw, offs)
            if not len(x.text):
                continue
            near = x.chars >= LEAST
            keys = x.halves(np.flatnonzero(near)).view(np.int64).ravel()
            cut = np.concatenate([[0], np.cumsum(np.where(near, 4, 0))]).astype(np.int32)
            cols = [pa.array(x.hash(x.start, x.end).view(np.int64)), pa.array(x.second().view(np.int64)), batch.column(0).take(pa.array(lo + x.text)), pa.array(x.number.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(cut), pa.array(keys))], names=["h1", "h2", "doc", "line", "halves"])


def earlier_lines(docs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(doc, line, edits, earlier_doc, earlier_line) of each line to go: the earliest one within the bound, and whether it is equal (0) or not (1)."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    own = docs.select(node().alias("doc"), F.col("text").cast("string").alias("text"))
    lines = materialise(own.mapInArrow(_keys, f"h1 long, h2 long, doc {NODE}, line int, halves array<long>"), "lines")
    place, same = F.struct("doc", "line"), ["h1", "h2"]
    heads = lines.groupBy(*same).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.any_value("halves").alias("halves"))
    if max_edits == 0:
        late = materialise(heads.filter("first < last").select(*same, F.col("first").alias("best"), F.lit(0).alias("edits")), "late")
    else:
        heads = materialise(heads, "heads")
        near = _near(own, heads)
        best = heads.select(*same, "first", "last").join(near, same, "left")
        best = best.select(*same, "last", F.least("first", "near").alias("best"), F.when(F.col("near") < F.col("first"), 1).otherwise(0).alias("edits"))
        late = materialise(best.filter("best < last").drop("last"), "late")
        discard(heads)
    gone = likely(lines.select(*same, "doc", "line"), same, late).join(late, same).filter(place > F.col("best"))
    return gone.select("doc", "line", "edits", F.col("best.doc").alias("earlier_doc"), F.col("best.line").alias("earlier_line"))


def _near(own: DataFrame, heads: DataFrame) -> DataFrame:
    """(h1, h2, near): the earliest other line within one edit of each of the distinct lines `heads`."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [{x["line"]: (x["h1"], x["h2"]) for x in xs} for xs in batch.column(2).to_pylist()]
            for lo, _, raw, offs in chunks(batch.column(1)):
                x = Lines(raw, offs)
                rows: list[tuple] = []
                for k, text, number in zip(range(len(x.text)), x.text.tolist(), x.number.tolist()):
                    got = wanted[lo + text].get(number)
                    if got is not None:
                        rows.append((*got, lo + text, number, raw[x.start[k] : x.end[k]].tobytes().decode(), x.deletions(k).view(np.int64)))
                if rows:
                    c = list(zip(*rows))
                    cut = np.concatenate([[0], np.cumsum([len(y) for y in c[5]])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(c[5])))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), batch.column(0).take(pa.array(c[2])), pa.array(c[3], pa.int32()), pa.array(c[4]), lists], names=["h1", "h2", "doc", "line", "text", "keys"])

    same = ["h1", "h2"]
    halves = heads.filter(F.size("halves") > 0).select(*same, "first", F.explode("halves").alias("key"))
    # The least and the greatest hash tell whether a key has two lines: sums that combine before the shuffle.
    shared = materialise(halves.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high").select("key"), "halves")
    asked = likely(halves, ["key"], shared).join(shared, "key", "left_semi").select(*same, "first").distinct()
    asked = materialise(asked.groupBy("first.doc").agg(F.collect_list(F.struct("first.line", *same)).alias("lines")), "asked")
    found = likely(own, ["doc"], asked).join(asked, "doc").select("doc", "text", "lines")
    # A repeated row brings the same lines again.
    found = materialise(found.mapInArrow(fetch, f"h1 long, h2 long, doc {NODE}, line int, text string, keys array<long>").dropDuplicates(same), "variants")
    discard(shared, asked)
    keyed = found.select(*same, F.explode("keys").alias("key"))
    shared = materialise(keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high").select("key"), "variant-keys")
    keyed = materialise(likely(keyed, ["key"], shared).join(shared, "key", "left_semi"), "keyed")
    x, y = keyed.alias("x"), keyed.alias("y")
    pairs = x.join(y, F.col("x.key") == F.col("y.key")).filter("x.h1 < y.h1").select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in same)).distinct()
    texts = found.select(*same, F.struct("doc", "line").alias("place"), "text")
    for s in "xy":
        pairs = pairs.join(texts.select(*(F.col(c).alias(f"{s}_{c}") for c in texts.columns)), [f"{s}_h1", f"{s}_h2"])
    longer = F.greatest(F.length("x_text"), F.length("y_text"))
    pairs = pairs.filter((F.levenshtein("x_text", "y_text", 1) == 1) & (longer * MAX_RATE >= 1))
    both = pairs.select(F.explode(F.array(*(F.struct(F.col(f"{s}_h1").alias("h1"), F.col(f"{s}_h2").alias("h2"), F.col(f"{o}_place").alias("at")) for s, o in ("xy", "yx")))).alias("e")).select("e.*")
    return both.groupBy(*same).agg(F.min("at").alias("near"))


def find_lines(docs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(doc_id, line_no, edits, earlier_doc_id, earlier_line_no) of every line to go; lines count from 0."""
    out = earlier_lines(docs, max_edits)
    return out.select(as_id("doc").alias("doc_id"), F.col("line").alias("line_no"), "edits", as_id("earlier_doc").alias("earlier_doc_id"), F.col("earlier_line").alias("earlier_line_no")).distinct()


def drop_lines(docs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """The documents without the lines that `find_lines` names."""
    gone = materialise(earlier_lines(docs, max_edits).groupBy("doc").agg(F.collect_set("line").alias("gone")), "gone")
    key, lines, mark = fresh(docs, "doc_"), fresh(docs, "gone_"), fresh(docs, "mark_")
    gone = gone.select(F.col("doc").alias(key), F.col("gone").alias(lines))
    wide = marked(docs.withColumn(key, node()), [key], gone, mark)
    whole = wide.filter(~F.col(mark)).select(*own_columns(docs))
    wide = wide.filter(F.col(mark)).join(gone, key, "left").select(*own_columns(docs), lines)
    where = [c.lower() for c in docs.columns].index("text")
    counts = [i for i, c in enumerate(docs.columns) if c.lower() == "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns[:-1])
            texts, sizes, keep = cols[where].to_pylist(), [cols[i].to_pylist() for i in counts], []
            for k, numbers in enumerate(batch.column(batch.num_columns - 1)):
                if not numbers.is_valid:
                    keep.append(True)
                    continue
                out = set(numbers.as_py())
                left = [x for i, x in enumerate(texts[k].split("\n")) if i not in out]
                keep.append(any(x.strip(SPACE.decode()) for x in left))
                texts[k] = "\n".join(left)
                for s in sizes:
                    s[k] = len(texts[k])
            cols[where] = pa.array(texts, cols[where].type)
            for i, s in zip(counts, sizes):
                cols[i] = pa.array(s, cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return whole.union(mapped(wide, run, docs.schema))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_lines(table(spark, sf_dir, "documents"))


QUERIES = {"op5_line_dedup": op5_line_dedup}

ORACLE = {
    "op5_line_dedup": f"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS x, unnest(generate_series(0, len(l) - 1)) AS line_no FROM t),
n AS (SELECT doc_id, line_no, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS x FROM u),
o AS (SELECT * FROM n WHERE x <> ''),
f AS (SELECT x, doc_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, line_no) AS r FROM o) WHERE r = 1),
v AS (SELECT x, md5_number(left(x, i - 1) || substr(x, i + 1)) AS k FROM f, LATERAL (SELECT unnest(generate_series(1, length(x) + 1)) AS i) WHERE length(x) >= {LEAST}),
p AS (SELECT DISTINCT a.x AS x, b.x AS y FROM v a JOIN v b ON a.k = b.k AND a.x <> b.x),
w AS (SELECT x, y FROM p WHERE abs(length(x) - length(y)) <= 1 AND greatest(length(x), length(y)) >= {round(1 / MAX_RATE)} AND len(list_filter(generate_series(1, greatest(length(x), length(y))),
      lambda i: left(x, i - 1) = left(y, i - 1) AND (substr(x, i + 1) = substr(y, i + 1) OR substr(x, i + 1) = substr(y, i) OR substr(x, i) = substr(y, i + 1)))) > 0),
c AS (SELECT f.x, f.doc_id AS d, f.line_no AS i, 0 AS edits FROM f
      UNION ALL SELECT w.x, f.doc_id, f.line_no, 1 FROM w JOIN f ON f.x = w.y),
b AS (SELECT x, d, i, edits FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY d, i) AS r FROM c) WHERE r = 1)
SELECT o.doc_id, CAST(o.line_no AS INTEGER) AS line_no, edits, b.d AS earlier_doc_id, CAST(b.i AS INTEGER) AS earlier_line_no
FROM o JOIN b USING (x) WHERE o.doc_id > b.d OR (o.doc_id = b.d AND o.line_no > b.i)
"""
}
