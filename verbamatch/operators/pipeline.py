"""Preprocessing as a fold of DataFrame stages."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..errors import StageConfigError, StageProcessingError
from ..functions import bulk, entities, text

Stage = Callable[[DataFrame, str], DataFrame]


def clean_stage(**flags: bool) -> Stage:
    def stage(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn(column, text.clean(F.col(column), **flags))

    return stage


def entity_stage(names: Iterable[str] | None = None, as_of: date | None = None) -> Stage:
    def stage(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn(column, entities.tag(F.col(column), names, as_of))

    return stage


def tokenize_stage() -> Stage:
    def stage(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn(column, F.array_join(text.tokenize(F.col(column)), " "))

    return stage


def stopword_stage(use_default: bool = True, custom: Iterable[str] = ()) -> Stage:
    def stage(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn(column, F.array_join(text.drop_stopwords(text.blank_tokens(F.col(column)), use_default, custom), " "))

    return stage


def lemma_stage(lemmatizer: Callable[[list[str]], list[str]] | None = None) -> Stage:
    """Lemmas by a plug-in called once per Arrow batch with all its tokens but tags; without one, tokens stay."""

    def stage(df: DataFrame, column: str) -> DataFrame:
        return df if lemmatizer is None else df.withColumn(column, lemmas(F.col(column), lemmatizer))

    return stage


def lemmas(col: Column, lemmatizer: Callable[[list[str]], list[str]]) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        split = [t.split() if t is not None else None for t in texts]
        plain = [w for ws in split if ws for w in ws if not w.startswith("<")]
        found = iter(lemmatizer(plain) if plain else [])
        return pd.Series([None if ws is None else " ".join(w if w.startswith("<") else next(found) or w for w in ws) for ws in split], dtype=object)

    return run(col)


class Pipeline:
    """Stages applied in order to one column."""

    def __init__(self, stages: Iterable[Stage] = ()):
        self.stages = list(stages)

    def add_stage(self, stage: Stage) -> Pipeline:
        if not callable(stage):
            raise StageConfigError(f"a stage must be callable, not {stage!r}")
        self.stages.append(stage)
        return self

    def process(self, df: DataFrame, column: str, strict: bool = False) -> DataFrame:
        """df with the column gone through all stages; with `strict` a null in it raises, else it stays null."""
        if strict:
            refuse_nulls(df, column)

        def step(now: DataFrame, stage: Stage) -> DataFrame:
            try:
                return stage(now, column)
            except (AnalysisException, TypeError, ValueError, OSError, RuntimeError) as e:
                raise StageProcessingError(getattr(stage, "__qualname__", repr(stage)).split(".")[0], e) from e

        return reduce(step, self.stages, df)


def refuse_nulls(df: DataFrame, column: str) -> None:
    if not df.filter(F.col(column).isNull()).limit(1).isEmpty():
        raise StageProcessingError("input", TypeError(f"column {column!r} holds a null"))


def pipeline_for(config: MatchConfig, as_of: date | None = None) -> Pipeline:
    tags = [entity_stage(config.entities, as_of)] if config.mode == "smart" else []
    return Pipeline([*tags, clean_stage(), tokenize_stage(), stopword_stage(), lemma_stage(config.lemmatizer)])


def prepared(df: DataFrame, source: str, target: str, config: MatchConfig, preprocess: bool = True, once: bool = True, as_of: date | None = None) -> DataFrame:
    """df with `target`: the prepared text, or the text itself without preprocessing.

    Where a UDF or plug-in takes part and `once` is set, each distinct text goes through it once.
    """
    if config.strict:
        refuse_nulls(df, source)
    if not preprocess:
        return df.withColumn(target, F.col(source))
    if config.mode == "basic" and config.lemmatizer is None:
        return df.withColumn(target, bulk.prepare(F.col(source).cast("string")))
    run = pipeline_for(config, as_of)
    if not once:
        return run.process(df.withColumn(target, F.col(source)), target)
    distinct = run.process(df.select(F.col(source).alias("_raw")).distinct().withColumn("_done", F.col("_raw")), "_done")
    joined = df.join(distinct, df[source].eqNullSafe(distinct["_raw"]), "left")
    return joined.select(*[df[c] for c in df.columns], F.col("_done").alias(target))
