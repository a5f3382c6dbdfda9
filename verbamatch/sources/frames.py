"""Tables of other libraries and plain lists, taken in at the door."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def spark_frame(table: Any, spark: SparkSession | None = None) -> DataFrame:
    """A Spark DataFrame of: a Spark, pandas, Arrow or other frame with to_arrow, to_pandas or columns, a mapping of columns, or a list of rows as dicts.

    Columns of other frames are read by name, each with tolist, to_list or as an iterable.
    """
    if isinstance(table, DataFrame):
        return table
    spark = spark or session()
    for way in ("to_arrow", "to_pandas"):
        if not isinstance(table, (pd.DataFrame, pa.Table)) and callable(getattr(table, way, None)):
            table = getattr(table, way)()
    if isinstance(table, pd.DataFrame):
        table = pa.Table.from_pandas(table, preserve_index=False)
    if isinstance(table, pa.Table):
        return spark.createDataFrame(table)
    if isinstance(table, (list, tuple)):
        return spark.createDataFrame(pa.Table.from_pylist(list(table)))
    names = list(table) if isinstance(table, Mapping) else list(getattr(table, "columns", ()))
    if not names:
        raise TypeError(f"not a table: {type(table).__name__}")
    return spark.createDataFrame(pa.table({str(n): _column(table[n]) for n in names}))


def _column(values: Any) -> list:
    for way in ("tolist", "to_list"):
        if callable(getattr(values, way, None)):
            return getattr(values, way)()
    return list(values)


def text_frame(texts: Any, key: str, column: str, spark: SparkSession | None = None) -> DataFrame:
    """(key, column) of a table that has them, or of plain texts, numbered as they come."""
    if isinstance(texts, Iterable) and not isinstance(texts, (str, Mapping, DataFrame)) and not hasattr(texts, "columns"):
        own = list(texts)
        if all(t is None or isinstance(t, str) for t in own):
            return (spark or session()).createDataFrame(list(enumerate(own)), f"{key} long, {column} string")
        texts = own
    return spark_frame(texts, spark)
