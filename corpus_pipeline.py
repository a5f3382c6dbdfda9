"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept.
`run` writes each stage's result as Parquet to the shared folder and rereads it, so a
lost executor costs tasks, not stages; what a stage wrote for itself is deleted once its
result is there.  Nulls in any column, empty and long texts, ties, repeated rows and extra
columns of any name behave as the operators' docstrings say; empty tables give no
pieces.  The last stage gives token ids: `packing.sequences` puts them together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbamatch.llm._spark import discard, made, materialise, sweep, table
from verbamatch.llm.decontaminate import drop_leaks
from verbamatch.llm.line_dedup import drop_lines
from verbamatch.llm.near_dedup import keep_first
from verbamatch.llm.packing import pack
from verbamatch.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no risk-controlled rule rejects."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, up to one edit, earlier in the corpus."""
    return drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences along the Hilbert curve."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]

# The fitted lexicon, binomial cutoffs, token ids and Hilbert keys have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = last = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = made()
        docs = materialise(stage(spark, last, sf_dir), name.replace(" ", "-"))
        sweep(docs, before)
        if name != STAGES[0][0]:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
