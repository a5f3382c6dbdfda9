"""Pairwise similarities as Columns; string kernels run on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .text import phonetic

SHORT_CIRCUIT = 0.95


def _pairwise(kernel):
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0.0 if not x or not y else kernel(x, y) for x, y in zip(a, b)], dtype="float64")

    return score


def edit(a: Column, b: Column, method: str = "ratio") -> Column:
    """Indel similarity: `ratio`, `partial_ratio` or `token_sort_ratio`."""
    kernel = {"ratio": kernels.ratio, "partial_ratio": kernels.partial_ratio, "token_sort_ratio": kernels.token_sort_ratio}.get(method)
    if kernel is None:
        raise ValueError(f"unknown edit method {method!r}")
    return _pairwise(kernel)(a, b)


def sounds_like(a: Column, b: Column) -> Column:
    """Indel similarity of the phonetic forms, which the JVM makes."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(_pairwise(kernels.ratio)(phonetic(a), phonetic(b)))


def pair_cosine(a: Column, b: Column) -> Column:
    return _pairwise(kernels.pair_cosine)(a, b)


def _values(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"<[a-zA-Z0-9_\-]+:[^>]+>"), F.lit(0)))


def entity_overlap(a: Column, b: Column, targets: tuple[str, ...] | None = None) -> Column:
    """1.0 if every tag value of the side with fewer distinct tags is part of a value of the other side; stays in the JVM."""

    def tags(text: Column) -> Column:
        found = _values(text)
        return F.filter(found, lambda t: F.regexp_extract(t, "<([^:]+):", 1).isin(list(targets))) if targets else found

    def inner(tag: Column) -> Column:
        return F.regexp_extract(tag, "<[^:]+:([^>]+)>", 1)

    s, t = tags(a), tags(b)
    few, many = F.when(F.size(s) <= F.size(t), s).otherwise(t), F.when(F.size(s) <= F.size(t), t).otherwise(s)
    every = F.forall(few, lambda x: F.exists(many, lambda y: F.contains(inner(y), inner(x))))
    return F.when((F.size(few) > 0) & every, 1.0).otherwise(0.0)


def components(df: DataFrame, a: Column, b: Column, active: list[str], shortcut: bool = True) -> tuple[DataFrame, dict[str, Column]]:
    """df with columns `_entity` and `_kernels`, and each active score in terms of these; scores that a full entity match makes needless are null.

    Entities are compared in the JVM.  Spark runs a UDF for all rows of a CASE, so texts that
    need no kernel reach it as nulls, which it passes over.
    """
    names = tuple(n for n in kernels.SCORES if n in active)
    blank = a.isNull() | b.isNull() | (a == "") | (b == "")
    df = df.withColumn("_entity", F.when(blank, 0.0).otherwise(entity_overlap(a, b)) if "entity" in names else F.lit(None).cast("double"))
    needless = blank | F.coalesce(F.col("_entity") >= 1, F.lit(False)) if shortcut and "entity" in names else blank
    kernel = {"cosine": kernels.pair_cosine, "edit": kernels.ratio, "phonetic": kernels.ratio}
    text = [n for n in names if n != "entity"]
    parts = {"entity": F.col("_entity")} if "entity" in names else {}
    if not text:
        return df.withColumn("_kernels", F.lit(None).cast("double")), parts

    @F.pandas_udf(", ".join(f"{n} double" for n in text))
    def score(x: pd.Series, y: pd.Series, u: pd.Series, v: pd.Series) -> pd.DataFrame:
        rows = {n: [None if s is None else kernel[n](s, t) for s, t in (zip(u, v) if n == "phonetic" else zip(x, y))] for n in text}
        return pd.DataFrame(rows, columns=text, dtype="float64")

    def sent(c: Column) -> Column:
        return F.when(~needless, c)

    sounds = [sent(phonetic(c)) if "phonetic" in names else F.lit(None).cast("string") for c in (a, b)]
    # The UDF's own output is a column: an expression around it would be merged into its uses, and run with each.
    df = df.withColumn("_kernels", score(sent(a), sent(b), *sounds))
    return df, parts | {n: F.when(blank, 0.0).otherwise(F.col("_kernels")[n]) for n in text}


def weighted(parts: dict[str, Column], weights: dict[str, float], entity: Column | None = None) -> Column:
    """Sum of weight x score over the positive weights; 0.95 where all entities match."""
    terms = [parts[n] * F.lit(float(w)) for n, w in weights.items() if w > 0 and n in parts]
    total = terms[0] if terms else F.lit(0.0)
    for t in terms[1:]:
        total = total + t
    return F.when(entity >= 1, SHORT_CIRCUIT).otherwise(total) if entity is not None else total


def algorithm_name(algorithm: Callable) -> str:
    return getattr(algorithm, "__name__", None) or type(algorithm).__name__


def custom(a: Column, b: Column, algorithm: Callable) -> Column:
    """Scores by a callable of two texts, or by the `compare` method of an object."""
    compare = getattr(algorithm, "compare", algorithm)

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float(compare(s or "", t or "")) for s, t in zip(x, y)], dtype="float64")

    return score(a, b)
