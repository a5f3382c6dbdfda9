"""Weight calibration against labelled pairs."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALGORITHMS, MatchConfig
from ..functions import similarity
from ..functions.encoders import dot, encode
from .fusion import detail_map
from .pipeline import prepared


class Report(NamedTuple):
    """metrics: a row a configuration, best F1 first; errors: the missed pairs of the best one."""

    best_weights: dict[str, float]
    metrics: DataFrame
    errors: DataFrame

    def show(self, n: int = 20) -> None:
        self.metrics.show(n, truncate=False)
        self.errors.show(n, truncate=False)


class Calibrator:
    """Scores each pair's components once, then weighs them by every configuration (weights as given, not normalised)."""

    def __init__(self, configurations: list[dict[str, float]], config: MatchConfig | None = None, threshold: float = 0.65):
        self.configurations = [dict(c) for c in configurations]
        self.config = config or MatchConfig()
        self.threshold = threshold

    def components(self, gold: DataFrame) -> DataFrame:
        """(query, target, match, cosine, entity, edit, phonetic, semantic)."""
        c = self.config
        used = {n for w in self.configurations for n, v in w.items() if v > 0}
        rows = gold.select("query", "target", "match")
        for column in ("query", "target"):
            rows = rows.withColumn(f"_t_{column}", F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
            rows = prepared(rows, f"_t_{column}", f"_p_{column}", c)
        a, b = F.coalesce("_p_query", F.lit("")), F.coalesce("_p_target", F.lit(""))
        rows, parts = similarity.components(rows, a, b, [n for n in ALGORITHMS if n in used], shortcut=False)
        semantic = dot(encode(a, c.encoder), encode(b, c.encoder)) if "semantic" in used else F.lit(0.0)
        blank = (a == "") | (b == "")
        return rows.select("query", "target", "match", *(F.coalesce(parts.get(n, F.lit(0.0)), F.lit(0.0)).alias(n) for n in similarity.kernels.SCORES), F.when(blank, 0.0).otherwise(semantic).alias("semantic"), blank.alias("blank"))

    def scored(self, gold: DataFrame) -> DataFrame:
        """Component rows for each configuration, with `config_id`, `weights` and `score`."""
        spark = gold.sparkSession
        configs = spark.createDataFrame([(i, {k: float(v) for k, v in w.items()}) for i, w in enumerate(self.configurations)], "config_id int, weights map<string,double>")
        # One row for each configuration of the call.
        rows = self.components(gold).crossJoin(F.broadcast(configs))

        def weight(n: str):
            return F.greatest(F.coalesce(F.col("weights")[n], F.lit(0.0)), F.lit(0.0))

        total = sum((weight(n) * F.col(n) for n in ALGORITHMS[1:]), weight(ALGORITHMS[0]) * F.col(ALGORITHMS[0]))
        score = F.when(F.col("blank"), 0.0).when((weight("entity") > 0) & (F.col("entity") >= 1), similarity.SHORT_CIRCUIT).otherwise(total)
        return rows.withColumn("score", score)

    def metrics(self, gold: DataFrame) -> DataFrame:
        """(config_id, weights, tp, fp, fn, tn, precision, recall, f1_score, rank): best first, ties by order of configuration."""
        hit, true = F.round("score", 9) >= self.threshold, F.col("match")
        counts = self.scored(gold).groupBy("config_id").agg(
            F.first("weights").alias("weights"), F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn")
        )
        p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
        out = counts.withColumn("precision", p).withColumn("recall", r)
        f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
        best = Window.orderBy(F.round("f1_score", 12).desc(), "config_id")  # a row a configuration
        return out.withColumn("f1_score", f1).withColumn("rank", F.row_number().over(best))

    def errors(self, gold: DataFrame, config_id: int) -> DataFrame:
        """Pairs that should match and don't, with details and the `offender`: the active component with the least score, if below 1."""
        weights = {n: w for n, w in self.configurations[config_id].items() if w > 0}
        rows = self.scored(gold).filter((F.col("config_id") == config_id) & (F.round("score", 9) < self.threshold) & F.col("match"))
        entries = [(n, F.when(~F.col("blank"), F.struct(F.col(n).alias("score"), F.lit(float(w)).alias("weight")))) for n, w in weights.items()]
        low = F.least(*(F.col(n) for n in weights)) if len(weights) > 1 else F.col(next(iter(weights))) if weights else F.lit(1.0)
        offender = F.lit(None).cast("string")
        for n in reversed(weights):
            offender = F.when(F.col(n) == low, F.lit(n)).otherwise(offender)
        offender = F.when(~F.col("blank") & (low < 1), offender)
        return rows.select("query", "target", "score", detail_map(entries, "map<string,struct<score:double,weight:double>>").alias("details"), offender.alias("offender"), F.when(offender.isNotNull(), low).alias("lowest"))

    def time_profile(self, gold: DataFrame) -> DataFrame:
        """(config_id, weights, f1_score, total_time_ms): what each configuration takes on its own, components included."""
        rows = []
        for i, w in enumerate(self.configurations):
            began = time.perf_counter()
            f1 = Calibrator([w], self.config, self.threshold).metrics(gold).first()["f1_score"]
            rows.append((i, {k: float(v) for k, v in w.items()}, f1, 1000 * (time.perf_counter() - began)))
        return gold.sparkSession.createDataFrame(rows, "config_id int, weights map<string,double>, f1_score double, total_time_ms double")

    def evaluate(self, gold: DataFrame) -> Report:
        if gold.isEmpty():
            raise ValueError("the gold standard is empty")
        table = self.metrics(gold)
        best = table.filter("rank = 1").first()["config_id"]
        return Report(self.configurations[best], table.orderBy("rank"), self.errors(gold, best))
