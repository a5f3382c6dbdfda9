"""Quality rules with risk-controlled thresholds.

Four scores say how bad a text looks (higher is worse): the share of symbols, of
capital letters, of words that repeat the word before, and a toxicity score from a
lexicon of words and word beginnings learned from labelled rows.  A document is
rejected when a score exceeds its stratum's cutoff.

Cutoffs are chosen so that, with confidence 1 - ``delta`` over everything chosen, no
stratum loses more than ``alpha`` of its acceptable documents:

* labels are split by a hash of doc_id into a training and a holdout half;
* for each rule and stratum the cutoffs of a fixed grid are tested from the most
  lenient on, each by the exact binomial tail of the acceptable holdout documents
  that it would reject; testing stops at the first failure (fixed-sequence testing
  needs no correction over cutoffs), and ``delta`` is divided by rules x strata
  (Bonferroni) while ``alpha`` is divided by the rules (union bound);
* of the certified cutoffs the one with the best balance on the training half is
  taken (the middle one of equals); a rule that catches nothing there stays off.

So a stratum with too few labels to certify anything loses no document.

``MAX_TRAIN`` bounds the labelled rows that the lexicon is fitted on (a hash sample);
scores, counts, thresholds and decisions cover all rows.

Defined results: a null or empty text scores 0 everywhere and is kept; texts of any
length are scored whole; a null lang is a stratum of its own (''); labels with a null in
doc_id, quality or toxic are left out; a document labelled twice counts by its worst
labels; repeated rows are judged alike; of cutoffs with equal balance (ties) the middle one
is taken; empty tables give empty results; without labels everything is kept; extra
columns of any name are carried along and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import fresh, mapped, materialise, own_columns, table
from ._text import U64, Words, chunks, segment_sum, words

ALPHA = 0.05
DELTA = 0.05
MAX_TRAIN = 20_000
LEAST_TOXIC = 5
LEAST_WEIGHT = 2.5
PREFIXES = (4, 5, 6)
FALSE_COST = 10.0
RULES = {
    "symbols": [0.5, 0.4, 0.3, 0.25, 0.2, 0.17, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02],
    "capitals": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeats": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05],
    "toxicity": [60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0],
}

_SYMBOL = np.zeros(256, bool)
for _b in b"#$%&*|!<>{}[]\\^~@_=+/`":
    _SYMBOL[_b] = True
_SPACE = np.zeros(256, bool)
for _b in b" \t\r\n\x0b\x0c":
    _SPACE[_b] = True


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed in logs."""
    if n == 0 or k >= n:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p <= 0)
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, exp(top) * sum(exp(t - top) for t in terms))


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson upper confidence bound on a proportion after k of n."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_tail(k, n, mid) > level else (lo, mid)
    return hi


class Lexicon:
    """Weights of words and word beginnings, looked up by hash behind a bitmap."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]
        self.map = np.zeros(1 << 20, bool)
        self.map[(hashes >> U64(44)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        if len(self.hashes):
            at = np.flatnonzero(self.map[(h >> U64(44)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            hit = self.hashes[i] == h[at]
            out[at[hit]] = self.weights[i[hit]]
        return out


def beginnings(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word indices, hashes) of whole words and of their beginnings."""
    yield np.arange(len(w.hash)), w.hash
    length = w.end - w.start
    for k in PREFIXES:
        which = np.flatnonzero(length > k)
        yield which, w.prefix_hash(which, k)


def score(raw: np.ndarray, offs: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Scores (texts, rules), in the order of RULES."""
    w = words(raw, offs)
    n = len(offs) - 1
    lead = (raw & 0xC0) != 0x80
    shown = segment_sum((lead & ~_SPACE[raw]).astype(np.int64), offs)
    symbols = segment_sum(_SYMBOL[raw].astype(np.int64), offs)
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    letters = segment_sum((ascii_letter | (raw >= 0xC3)).astype(np.int64), offs)
    capital = (raw >= 65) & (raw <= 90)
    i = np.flatnonzero(raw == 0xC3)
    nxt = raw[i + 1]
    capital[i[(nxt <= 0x9E) & (nxt != 0x97)]] = True
    capitals = segment_sum(capital.astype(np.int64), offs)
    same = np.zeros(len(w.hash), np.int64)
    same[1:] = w.hash[1:] == w.hash[:-1]
    heads = w.first[:-1]
    same[heads[heads < len(same)]] = 0
    repeats = segment_sum(same, w.first)
    weight = np.zeros(len(w.hash))
    for which, h in beginnings(w):
        weight[which] = np.maximum(weight[which], lexicon(h))
    toxic = np.bincount(w.doc, weight, n) if len(weight) else np.zeros(n)
    out = [symbols / np.maximum(shown, 1), capitals / np.maximum(letters, 1), repeats / np.maximum(np.diff(w.first) - 1, 1), toxic]
    return np.round(np.stack(out, 1), 6)


def _labels(labels: DataFrame) -> DataFrame:
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    return own.dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def _fold() -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2))


def fit_lexicon(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Lexicon:
    """Words and beginnings whose share of toxic documents is high even at the cautious end of its error."""
    train = _labels(labels).filter(_fold() == 0)
    n = train.count()
    share = min(1.0, max_train / max(n, 1))
    sample = train.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20))).select("doc_id", "toxic")
    # At most about max_train ids, whatever the corpus: the size is bounded by the filter above.
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy().astype(np.int64)
            for lo, hi, raw, offs in chunks(batch.column(0)):
                w = words(raw, offs)
                doc = w.doc
                pairs = [(h, doc[which]) for which, h in beginnings(w)]
                h, d = np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs])
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, t = h[new], label[lo + d[new]]
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                if len(at):
                    toxic = np.add.reduceat(t, at)
                    both = np.diff(np.concatenate([at, [len(h)]]))
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(toxic), pa.array(both - toxic)], names=["h", "a", "b"])

    counts = picked.select("text", "toxic").mapInArrow(run, "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    size = sample.groupBy().agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    n_toxic, n_clean = int(size["t"] or 0), int(size["n"]) - int(size["t"] or 0)
    low = F.greatest(F.col("a") - 1.64 * F.sqrt("a"), F.lit(0.0)) / max(n_toxic, 1)
    high = (F.col("b") + 1.64 * F.sqrt("b") + 1.35) / max(n_clean, 1)
    strong = counts.filter(F.col("a") >= LEAST_TOXIC).select("h", F.ln(low / high).alias("w")).filter(F.col("w") >= LEAST_WEIGHT).toArrow()
    return Lexicon(strong.column("h").to_numpy().view(U64), strong.column("w").to_numpy())


def scores(docs: DataFrame, lexicon: Lexicon, stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, one column for each rule) of every document, in one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score(raw, offs, lexicon) for _, _, raw, offs in chunks(batch.column(2))]
            if parts:
                s = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(s[:, j]) for j in range(len(RULES)))], names=["doc_id", "stratum", *RULES])

    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(stratum).cast("string"), F.lit("")), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{r} double" for r in RULES))


def calibrate(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Certified cutoffs by stratum and rule."""
    rows = scored.join(_labels(labels), "doc_id").withColumn("held", _fold() == 1)
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    kinds = {"held": F.col("held") & good, "good": ~F.col("held") & good}
    sums = [F.count_if(c).alias(k) for k, c in kinds.items()]
    for rule, grid in RULES.items():
        bad = ~F.col("held") & ((F.col("toxic") == 1) if rule == "toxicity" else (F.col("quality") == 0))
        for j, cutoff in enumerate(grid):
            over = F.col(rule) > cutoff
            sums += [F.count_if(over & c).alias(f"{k}_{rule}_{j}") for k, c in kinds.items()] + [F.count_if(over & bad).alias(f"bad_{rule}_{j}")]
        sums.append(F.count_if(bad).alias(f"bad_{rule}"))
    counts = rows.groupBy("stratum").agg(*sums).collect()  # a row a stratum
    level, risk = delta / max(1, len(RULES) * len(counts)), alpha / len(RULES)
    chosen: dict[str, dict[str, float]] = {}
    for r in counts:
        for rule, grid in RULES.items():
            certified = []
            for j in range(len(grid)):
                if binomial_tail(r[f"held_{rule}_{j}"], r["held"], risk) > level:
                    break
                certified.append(j)
            gain = {j: r[f"bad_{rule}_{j}"] / max(r[f"bad_{rule}"], 1) - FALSE_COST * r[f"good_{rule}_{j}"] / max(r["good"], 1) for j in certified}
            best = max(gain.values(), default=0.0)
            if best > 0:
                equal = [j for j in certified if gain[j] == best]
                chosen.setdefault(r["stratum"], {})[rule] = grid[equal[len(equal) // 2]]
    return chosen


def rejected(cutoffs: dict[str, dict[str, float]]) -> F.Column:
    """Condition over the columns of `scores`."""
    out = F.lit(False)
    for stratum, rules in cutoffs.items():
        for rule, cutoff in rules.items():
            out = out | ((F.col("stratum") == stratum) & (F.col(rule) > cutoff))
    return out


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, max_train: int = MAX_TRAIN, stratum: str = "lang") -> DataFrame:
    """The documents that no rule rejects, with all their columns: decided within one scan, without a join."""
    lexicon = fit_lexicon(docs, labels, max_train)
    cutoffs = calibrate(scores(docs, lexicon, stratum), labels, alpha, delta)
    text = fresh(docs, "text_")
    layer = fresh(docs, "stratum_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score(raw, offs, lexicon) for _, _, raw, offs in chunks(batch.column(batch.num_columns - 2))]
            if not parts:
                continue
            s = np.concatenate(parts)
            own = np.array(batch.column(batch.num_columns - 1).to_pylist(), object)
            bad = np.zeros(len(s), bool)
            for name, rules in cutoffs.items():
                for j, rule in enumerate(RULES):
                    if rule in rules:
                        bad |= (own == name) & (s[:, j] > rules[rule])
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2]).filter(pa.array(~bad))

    wide = docs.select(*own_columns(docs), F.col("text").cast("string").alias(text), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias(layer))
    return mapped(wide, run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept documents with their scores."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = materialise(scores(docs, fit_lexicon(docs, labels)), "quality-scores")
    return scored.filter(~rejected(calibrate(scored, labels)))


QUERIES = {"op6_quality": op6_quality}
ORACLE: dict[str, str] = {}
