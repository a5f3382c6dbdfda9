"""Linear and rank fusion as windows and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINEAR = "map<string,struct<score:double,weight:double>>"


def detail_map(entries: list[tuple[str, Column | None]], kind: str) -> Column:
    """Map of name -> struct, without the entries whose struct is null."""
    pairs = F.array(*(F.when(s.isNotNull(), F.struct(F.lit(n).alias("key"), s.alias("value"))) for n, s in entries))
    return F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull())).cast(kind)


def fuse_ranked(rows: DataFrame, weights: dict[str, float], k: int = 60, fused_weights: dict[str, float] | None = None, query: str = "query_id", tie: str = "cos_rank") -> DataFrame:
    """Reciprocal rank fusion over the score columns named in `weights`, within each query.

    Each algorithm ranks by its score, ties by `tie`.  Rows of equal text are one
    candidate: their contributions add up, and details show its last rank.
    """
    own = {n: float((fused_weights or {}).get(n, 1.0)) for n in weights}
    most = sum(w / (k + 1) for w in own.values())
    for n in own:
        order = Window.partitionBy(query).orderBy(F.round(n, 9).desc(), F.col(tie).asc())
        rows = rows.withColumn(f"_rank_{n}", F.row_number().over(order))
    parts = {n: F.lit(w) / (F.lit(float(k)) + F.col(f"_rank_{n}")) for n, w in own.items()}
    total = reduce(lambda a, b: a + b, (F.sum(p) for p in parts.values()))
    last = [
        F.max_by(F.struct(F.col(f"_rank_{n}").cast("int").alias("rank"), F.col(n).alias("raw_score"), p.alias("rrf_contribution"), F.lit(own[n]).alias("weight")), F.col(f"_rank_{n}")).alias(f"_last_{n}")
        for n, p in parts.items()
    ]
    out = rows.groupBy(query, "candidate").agg((F.least(F.lit(1.0), total / most) if most > 0 else F.lit(0.0)).alias("score"), F.min(tie).alias(tie), F.min("pos").alias("pos"), *last)
    details = F.map_from_arrays(F.array(*(F.lit(n) for n in own)), F.array(*(F.col(f"_last_{n}") for n in own)))
    return out.select(query, "pos", "candidate", "score", F.lit("rrf").alias("fusion"), details.alias("details"), tie)


def fuse_lists(rankings: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Fuse given rankings: rows (algo, algo_idx, position from 1, candidate, score).

    A candidate that an earlier list holds and a later one doesn't takes that list's size
    + 1 as its rank there, with raw score 0; lists before a candidate's first one don't
    count for it.  Result: candidate, score, details, in no order; `first_seen` breaks ties.
    """
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("algo") == name, F.lit(float(w))).otherwise(weight)
    present = rankings.withColumn("weight", weight).withColumn("part", F.col("weight") / (k + F.col("position")))
    lists = present.groupBy("algo", "algo_idx").agg(F.count("*").alias("size"), F.first("weight").alias("weight"))
    seen = present.groupBy("candidate").agg(F.min(F.struct("algo_idx", "position")).alias("first_seen"))
    merged = present.groupBy("candidate", "algo", "algo_idx").agg(F.sum("part").alias("sum"), F.max_by(F.struct(F.col("position").cast("int").alias("rank"), F.col("score").alias("raw_score"), F.col("part").alias("rrf_contribution"), F.col("weight").alias("weight")), "position").alias("detail"))
    # One row for each list of the call: few, whatever the rankings hold.
    every = seen.crossJoin(F.broadcast(lists)).join(merged.drop("algo_idx"), ["candidate", "algo"], "left")
    penalty = F.col("weight") / (k + F.col("size") + 1)
    absent = F.struct((F.col("size") + 1).cast("int").alias("rank"), F.lit(0.0).alias("raw_score"), penalty.alias("rrf_contribution"), F.col("weight").alias("weight"))
    late = F.col("detail").isNull() & (F.col("algo_idx") > F.col("first_seen.algo_idx"))
    every = every.select("candidate", "first_seen", "algo", "weight", F.coalesce("sum", F.when(late, penalty)).alias("sum"), F.coalesce("detail", F.when(late, absent)).alias("detail"))
    most = lists.agg(F.sum(F.col("weight") / (k + 1)).alias("most"))
    out = every.filter(F.col("sum").isNotNull()).groupBy("candidate").agg(F.sum("sum").alias("sum"), F.min("first_seen").alias("first_seen"), F.map_from_entries(F.collect_list(F.struct("algo", "detail"))).alias("details"))
    return out.crossJoin(F.broadcast(most)).select("candidate", F.when(F.col("most") > 0, F.least(F.lit(1.0), F.col("sum") / F.col("most"))).otherwise(0.0).alias("score"), F.lit("rrf").alias("fusion"), "details", "first_seen")
