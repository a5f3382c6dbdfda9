"""Catalogues of prepared texts on disk, valid as long as texts and settings stay the same."""

from __future__ import annotations

import hashlib
import json
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..operators.pipeline import prepared

VERSION = "2"


def fingerprint(candidates: DataFrame, config: MatchConfig, as_of: date | None = None) -> str:
    """Hash of all (pos, candidate) rows and of what preparation depends on: settings, the day that relative dates count from, and the lemmatizer's code; order of rows doesn't matter."""
    sums = [F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\x00", F.col("pos").cast("string"), F.coalesce("candidate", F.lit("\x01"))), 256), i, 12), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)")) for i in (1, 13, 25)]
    parts = candidates.agg(F.count("*"), *sums).first()
    day = (as_of or date.today()).isoformat() if config.mode == "smart" and (not config.entities or "date" in config.entities) else None
    code = hashlib.sha256(cloudpickle.dumps(config.lemmatizer)).hexdigest() if config.lemmatizer else None
    settings = [VERSION, config.mode, list(config.entities or ()), day, code]
    return hashlib.sha256(json.dumps([list(map(str, parts)), settings]).encode()).hexdigest()


def save_catalog(prepared_rows: DataFrame, path: str, mark: str) -> None:
    """Write (pos, candidate, p_candidate) with the fingerprint as a partition, replacing what was there."""
    prepared_rows.select("pos", "candidate", "p_candidate").withColumn("mark", F.lit(mark)).write.mode("overwrite").partitionBy("mark").parquet(path)


def load_catalog(spark: SparkSession, path: str, mark: str) -> DataFrame | None:
    """The saved catalogue if it is there, readable and of this fingerprint."""
    try:
        rows = spark.read.schema("pos long, candidate string, p_candidate string, mark string").parquet(path).filter(F.col("mark") == mark)
        return None if rows.isEmpty() else rows.drop("mark")
    except (AnalysisException, Py4JJavaError):
        return None


def preprocess_catalog(candidates: DataFrame, path: str, config: MatchConfig | None = None, as_of: date | None = None) -> DataFrame:
    """(pos, candidate, p_candidate), from the catalogue at `path` if it is still valid, else prepared and saved there."""
    config = config or MatchConfig()
    spark = candidates.sparkSession
    mark = fingerprint(candidates, config, as_of)
    found = load_catalog(spark, path, mark)
    if found is None:
        save_catalog(prepared(candidates, "candidate", "p_candidate", config, as_of=as_of), path, mark)
        found = spark.read.schema("pos long, candidate string, p_candidate string, mark string").parquet(path).drop("mark")
    return found
