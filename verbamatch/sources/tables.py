"""The tables that the registered queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes from fewer files than there are cores, as a file may be a single split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, candidate) of all documents."""
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("candidate")))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query) of all benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, candidate): name, type and brand of all parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("candidate"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): each distinct part name under the least key that has it."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("query")).agg(F.min("p_partkey").alias("query_id")).select("query_id", "query")


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): all ordered pairs of distinct part names."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("a")).crossJoin(names.select(F.col("p_name").alias("b")))
