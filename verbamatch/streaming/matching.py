"""Streams of queries against a fixed index.

Preparation has no state and works on streams as it is.  Ranking needs all candidates
of a query at once, so each micro-batch of queries is matched as a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.matcher import Matcher
from ..operators.pipeline import prepared
from ..sources.shared import settled


def prepare_stream(queries: DataFrame, matcher: Matcher) -> DataFrame:
    """A stream of (query_id, query) with p_query."""
    return prepared(queries, "query", "p_query", matcher.config, once=False, as_of=matcher.as_of)


def match_stream(queries: DataFrame, candidates: DataFrame, matcher: Matcher, path: str, top_n: int = 50, min_cosine: float = 0.1) -> DataStreamWriter:
    """Writer that appends each micro-batch's matches to Parquet at `path`, once per batch id."""
    own, fitted = matcher.fit(candidates)
    if fitted.kind == "dense":  # the others are written
        fitted = fitted._replace(postings=matcher.keep(fitted.postings))

    def run(batch: DataFrame, batch_id: int) -> None:
        asked = prepared(batch, "query", "p_query", matcher.config, as_of=matcher.as_of)
        best = matcher.retrieve(asked, own, fitted, top_n, min_cosine).select("query_id", "pos", F.col("score").alias("cos_score"), F.col("rank").alias("cos_rank"))
        rows = matcher.matched(settled(best, "best"), own).join(asked, "query_id")
        # Overwriting the batch's own folder makes a repeated batch harmless.
        matcher.rescore(rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return queries.writeStream.foreachBatch(run)
