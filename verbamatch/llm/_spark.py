"""Session helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import shared_dir, small_batches

FILTER_BITS = 1 << 25
NODE = "struct<no:int,id:bigint,h:bigint>"


_made: list[DataFrame] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    _made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made[:] = [x for x in _made if x is not t]


def sweep(kept: DataFrame, before: int) -> None:
    """Delete what has been materialised since there were `before` tables, but `kept`, which has everything that is still needed."""
    discard(*(x for x in _made[before:] if x is not kept))


def made() -> int:
    return len(_made)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of df by their literal names, which may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def mapped(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """mapInArrow over columns of any name: it looks them up by name, which fails on dots, so they go in numbered."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node() -> Column:
    """Identity of a row's document (NODE): its doc_id and a hash of its text; a row without id sorts after all others.

    Equal rows are one document; rows that share an id but not the text are two.
    """
    own = F.col("doc_id").cast("long")
    return F.struct(F.when(own.isNull(), 1).otherwise(0).alias("no"), F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"))


def as_id(column: str) -> Column:
    """The doc_id of a node."""
    return F.when(F.col(column)["no"] == 0, F.col(column)["id"])


def marked(df: DataFrame, columns: list[str], wanted: DataFrame, name: str) -> DataFrame:
    """df with a column `name`: true for every row whose `columns` are those of a row of `wanted`, and for few others.

    A bitmap with about 16 bits for each wanted key, of FILTER_BITS bits (4 MB) at most,
    is made by an aggregation and broadcast.  Its size is bounded whatever the data; where
    there are more keys than it can tell apart it marks more rows, never fewer.  `wanted`
    is read twice, so it should be materialised.
    """
    bits = min(FILTER_BITS, 1 << max(12, (16 * wanted.count()).bit_length()))
    slot = F.pmod(F.xxhash64(*columns, F.lit(7)), F.lit(bits))
    at, mask, word = fresh(df, "slot_"), fresh(df, "mask_"), fresh(df, "word_")
    words = wanted.select(slot.alias(at)).groupBy(F.shiftright(at, 6).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({at} & 63 as int))")).alias(mask))
    both = df.withColumn(at, slot).withColumn(fresh(df, "word_of_"), F.shiftright(at, 6))
    both = both.join(F.broadcast(words), F.col(fresh(df, "word_of_")) == F.col(word), "left")
    hit = F.expr(f"coalesce(({mask} & shiftleft(1L, cast({at} & 63 as int))) <> 0, false)")
    return both.select(*own_columns(df), hit.alias(name))


def likely(df: DataFrame, columns: list[str], wanted: DataFrame) -> DataFrame:
    """The rows of df that `marked` marks: what a join with `wanted` needs, without shuffling the rest."""
    name = fresh(df, "likely_")
    return marked(df, columns, wanted, name).filter(F.col(name)).select(*own_columns(df))
