"""The matcher: pairwise comparison, retrieve-and-rerank, table search, linkage, reranking."""

from __future__ import annotations

import asyncio
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import similarity
from ..functions.encoders import dot, encode, unload
from ..sources.frames import spark_frame, text_frame
from ..sources.shared import settled, shared_dir
from . import fusion, index
from .pipeline import prepared, refuse_nulls

STRATEGIES = ("vectorized", "parallel")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def literal(name: str) -> Column:
    """A column by its literal name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, name: str, order: str | None = None) -> DataFrame:
    """df with dense positions from 0 in the order of a column (or of the rows as Spark reads them).

    Each row's place in its partition is added to the number of rows in the partitions
    before, so no single task sees all rows; rows are settled first, as both passes must
    see the same partitions.
    """
    at, part, base = fresh(df, "at_"), fresh(df, "part_"), fresh(df, "base_")
    shared_dir(df.sparkSession)
    rows = (df if order is None else df.orderBy(literal(order))).withColumn(at, F.monotonically_increasing_id()).checkpoint()
    sizes = rows.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count("*").alias(base))
    # One row a partition.
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.select(part, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    return rows.join(sums, F.shiftright(at, 33) == F.col(part)).select(*map(literal, df.columns), (F.col(base) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def texts(spark: SparkSession, values: Iterable[str], key: str, column: str) -> DataFrame:
    """In-memory texts with their positions."""
    return spark.createDataFrame(list(enumerate(values)), f"{key} long, {column} string")


class Matcher:
    """Operations under one configuration. Positions are identity: `pos` of candidates and `query_id` of queries are given by the caller."""

    def __init__(self, config: MatchConfig | None = None, as_of: date | None = None):
        self.config = config or MatchConfig()
        self.as_of = as_of
        self._kept: list[DataFrame] = []

    # --- pairs ---

    def compare(self, df: DataFrame, left: str, right: str, preprocess: bool = True) -> DataFrame:
        """df with `score` and `details` (algorithm -> score, weight, short_circuit) of its two text columns."""
        c, df = self.config, spark_frame(df)
        if c.algorithm is not None:
            return self._own_algorithm(df, left, right, preprocess)
        both = prepared(df, left, "_p_left", c, preprocess, as_of=self.as_of)
        both = prepared(both, right, "_p_right", c, preprocess, as_of=self.as_of)
        a, b = F.col("_p_left"), F.col("_p_right")
        weights = {n: w for n, w in c.active.items() if w > 0}
        both, parts = similarity.components(both, a, b, list(weights))
        if "semantic" in weights:
            both = both.withColumn("_semantic", dot(encode(a, c.encoder), encode(b, c.encoder)))
            parts["semantic"] = F.col("_semantic")
        empty = a.isNull() | b.isNull() | (a == "") | (b == "")
        entity = parts["entity"] if "entity" in weights else None
        score = F.when(empty, 0.0).otherwise(similarity.weighted(parts, weights, entity))
        full = F.coalesce(entity >= 1, F.lit(False)) if entity is not None else F.lit(False)

        def entry(n: str) -> Column:
            here = ~empty & (~full | F.lit(n == "entity"))
            flag = F.when(full, F.lit(True)) if n == "entity" else F.lit(None).cast("boolean")
            return F.when(here, F.struct(parts[n].alias("score"), F.lit(float(weights[n])).alias("weight"), flag.alias("short_circuit")))

        details = fusion.detail_map([(n, entry(n)) for n in weights], "map<string,struct<score:double,weight:double,short_circuit:boolean>>")
        return both.withColumn("score", score).withColumn("details", details).drop("_p_left", "_p_right", "_entity", "_kernels", "_semantic")

    explain = compare

    def _own_algorithm(self, df: DataFrame, left: str, right: str, preprocess: bool) -> DataFrame:
        """compare by the caller's algorithm alone; its name is the only entry of the details."""
        c = self.config
        both = prepared(df, left, "_p_left", c, preprocess, as_of=self.as_of)
        both = prepared(both, right, "_p_right", c, preprocess, as_of=self.as_of)
        both = both.withColumn("score", similarity.custom(F.col("_p_left"), F.col("_p_right"), c.algorithm))
        entry = F.struct(F.col("score"), F.lit(1.0).alias("weight"), F.lit(None).cast("boolean").alias("short_circuit"))
        return both.withColumn("details", F.create_map(F.lit(similarity.algorithm_name(c.algorithm)), entry)).drop("_p_left", "_p_right")

    # --- retrieve and rerank ---

    def fit(self, candidates: DataFrame, preprocess: bool = True) -> tuple[DataFrame, index.Index]:
        """(prepared candidates, index) of (pos, candidate); null texts are left out."""
        c = self.config
        if c.strict:
            refuse_nulls(candidates, "candidate")
        own = prepared(candidates.select("pos", "candidate").filter(F.col("candidate").isNotNull()), "candidate", "p_candidate", c, preprocess, as_of=self.as_of)
        if preprocess and not self._plain:
            own = settled(own, "prepared")
        if c.index == "bm25":
            return own, index.fit_bm25(own, c.bm25_k1, c.bm25_b)
        if c.index == "dense":
            return own, index.fit_dense(own, c.encoder)
        return own, index.fit_tfidf(own)

    @property
    def _plain(self) -> bool:
        """Preparation is basic and cheap to repeat; where it isn't, each text goes through plug-ins once and is written."""
        return self.config.mode == "basic" and self.config.lemmatizer is None

    def matched(self, best: DataFrame, own: DataFrame, preprocess: bool = True) -> DataFrame:
        """best with `candidate` and `p_candidate`; of candidates that were not written prepared, only these few are prepared again."""
        if not preprocess or not self._plain:
            return best.join(own.select("pos", "candidate", "p_candidate"), "pos")
        return prepared(best.join(own.select("pos", "candidate"), "pos"), "candidate", "p_candidate", self.config)

    def retrieve(self, queries: DataFrame, own: DataFrame, fitted: index.Index, top_n: int, min_cosine: float) -> DataFrame:
        """(query_id, pos, score, rank) of prepared queries."""
        if fitted.kind == "bm25":
            scores = index.score_bm25(fitted, queries, best=top_n)
        elif fitted.kind == "dense":
            return index.top(index.score_dense(fitted, queries, self.config.encoder, best=top_n), top_n, min_cosine)
        else:
            scores = index.score_tfidf(fitted, queries, top_n)
        if min_cosine <= 0 and fitted.kind == "tfidf":
            # A collection without a single term has no index, so nothing to fill up with.
            own = own.select("pos").join(F.broadcast(fitted.postings.filter("norm > 0").select(F.lit(True).alias("_any")).limit(1)))
        return index.top(scores, top_n, min_cosine, own, queries)

    def compare_many_to_many(self, queries: DataFrame, candidates: DataFrame, top_n: int = 50, min_cosine: float = 0.1, strategy: str = "vectorized", n_workers: int | None = None, preprocess: bool = True) -> DataFrame:
        """(query_id, query, pos, candidate, score, details, rank) from (query_id, query) and (pos, candidate).

        `strategy` and `n_workers` don't change results; tasks run in parallel in any case.
        """
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
        queries, candidates = text_frame(queries, "query_id", "query"), text_frame(candidates, "pos", "candidate")
        if self.config.strict:
            refuse_nulls(queries, "query")
        asked = prepared(queries.select("query_id", "query").filter(F.col("query").isNotNull()), "query", "p_query", self.config, preprocess, as_of=self.as_of)
        if preprocess:
            asked = settled(asked, "queries")
        own, fitted = self.fit(candidates, preprocess)
        best = self.retrieve(asked, own, fitted, top_n, min_cosine).select("query_id", "pos", F.col("score").alias("cos_score"), F.col("rank").alias("cos_rank"))
        rows = self.matched(settled(best, "best"), own, preprocess).join(asked.select("query_id", "query", "p_query"), "query_id")
        out = self.rescore(rows)
        return out.join(asked.select("query_id", "query"), "query_id").select("query_id", "query", "pos", "candidate", "score", "details", "rank")

    def rescore(self, rows: DataFrame) -> DataFrame:
        """Hybrid scores of (query_id, p_query, pos, candidate, p_candidate, cos_score, cos_rank), by linear or rank fusion."""
        c = self.config
        if c.algorithm is not None:
            if c.fusion == "rrf":
                # Rankings are of the hybrid's parts, which there are none of.
                return self._ranked(rows.limit(0).select("query_id", "pos", "candidate", F.lit(0.0).alias("score"), F.create_map().cast(fusion.LINEAR).alias("details"), "cos_rank"))
            scored = rows.withColumn("score", similarity.custom(F.col("p_query"), F.col("p_candidate"), c.algorithm))
            entry = F.struct(F.col("score"), F.lit(1.0).alias("weight"))
            return self._ranked(scored.withColumn("details", F.create_map(F.lit(similarity.algorithm_name(c.algorithm)), entry)).select("query_id", "pos", "candidate", "score", "details", "cos_rank"))
        weights = {n: w for n, w in c.active.items() if w > 0}
        kernels = [n for n in weights if n in ("entity", "edit", "phonetic")]
        linear = c.fusion == "linear"
        rows, parts = similarity.components(rows, F.col("p_query"), F.col("p_candidate"), kernels, shortcut=linear)
        parts = {"cosine": F.col("cos_score")} | parts
        if "semantic" in weights:
            if c.index == "dense" and c.reuse_dense:
                parts["semantic"] = F.col("cos_score")
            else:
                rows = rows.withColumn("_semantic", dot(encode(F.col("p_query"), c.encoder), encode(F.col("p_candidate"), c.encoder)))
                parts["semantic"] = F.col("_semantic")
        if linear:
            return self._linear(rows, parts, weights)
        for n in weights:
            rows = rows.withColumn(n, parts[n])
        fused = fusion.fuse_ranked(rows, weights, c.rrf_k, c.rrf_weights)
        return self._ranked(fused)

    def _linear(self, rows: DataFrame, parts: dict[str, Column], weights: dict[str, float]) -> DataFrame:
        entity = parts["entity"] if "entity" in weights else None
        full = F.coalesce(entity >= 1, F.lit(False)) if entity is not None else F.lit(False)
        shown = {"cosine": self.config.active.get("cosine", 0.0)} | weights
        entries = [(n, F.when(~full | F.lit(n == "entity"), F.struct(parts[n].alias("score"), F.lit(float(w)).alias("weight")))) for n, w in shown.items()]
        out = rows.withColumn("score", similarity.weighted(parts, weights, entity)).withColumn("details", fusion.detail_map(entries, fusion.LINEAR))
        return self._ranked(out.select("query_id", "pos", "candidate", "score", "details", "cos_rank"))

    @staticmethod
    def _ranked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("cos_rank").asc())
        return rows.withColumn("rank", F.row_number().over(order)).drop("cos_rank")

    def compare_batch(self, query: str, candidates: DataFrame, top_n: int = 50, min_cosine: float = 0.1, strategy: str = "vectorized", n_workers: int | None = None, preprocess: bool = True) -> DataFrame:
        """One text against (pos, candidate)."""
        candidates = text_frame(candidates, "pos", "candidate")
        asked = texts(candidates.sparkSession, [query], "query_id", "query")
        return self.compare_many_to_many(asked, candidates, top_n, min_cosine, strategy, n_workers, preprocess).drop("query_id", "query")

    async def compare_batch_async(self, *args, **kwargs) -> list:
        return await asyncio.to_thread(lambda: self.compare_batch(*args, **kwargs).orderBy("rank").collect())

    async def compare_many_to_many_async(self, *args, **kwargs) -> list:
        return await asyncio.to_thread(lambda: self.compare_many_to_many(*args, **kwargs).orderBy("query_id", "rank").collect())

    # --- tables ---

    def compare_dataframe(self, df: DataFrame, text_column: str, query: str, top_n: int = 50, min_cosine: float = 0.1, preprocess: bool = True, order: str | None = None) -> DataFrame:
        """Rows of df like the query with `score` (in place of a column of that name), best first; of rows of equal text the first in `order` counts."""
        df = spark_frame(df)
        pos, text, score = (fresh(df, n) for n in ("pos_", "text_", "score_"))
        rows = numbered(df, pos, order)
        found = self.compare_batch(query, rows.select(F.col(pos).alias("pos"), literal(text_column).cast("string").alias("candidate")), top_n, min_cosine, preprocess=preprocess)
        best = found.groupBy(F.col("candidate").alias(text)).agg(F.max("score").alias(score))
        # At most top_n texts are looked for; of each only the first row's position goes on.
        heads = rows.select(literal(text_column).cast("string").alias(text), pos).join(best, text).groupBy(text, score).agg(F.min(pos).alias(pos))
        kept = [literal(c) for c in df.columns if c.lower() != "score"]
        return rows.join(heads.select(pos, score), pos).orderBy(F.round(score, 9).desc(), pos).select(*kept, F.col(score).alias("score"))

    def record_linkage(self, df_a: DataFrame, df_b: DataFrame, col_a: str, col_b: str, top_n: int = 5, min_cosine: float = 0.1, preprocess: bool = True, order_a: str | None = None, order_b: str | None = None) -> DataFrame:
        """(index_a, text_a, index_b, text_b, score, details): pairs by score, best first; index_b is the first row of its text."""

        def positions(df: DataFrame, column: str, order: str | None, pos: str, text: str) -> DataFrame:
            df = spark_frame(df)
            own = df.select(literal(column).cast("string").alias(text), *([literal(order).alias("order_")] if order else []))
            return numbered(own, pos, "order_" if order else None).select(pos, text)

        a, b = positions(df_a, col_a, order_a, "query_id", "query"), positions(df_b, col_b, order_b, "pos", "candidate")
        found = self.compare_many_to_many(a, b, top_n, min_cosine, preprocess=preprocess)
        first = b.groupBy("candidate").agg(F.min("pos").alias("index_b"))
        pairs = found.join(first, "candidate").orderBy(F.round("score", 9).desc(), "query_id", "rank")
        return pairs.select(F.col("query_id").alias("index_a"), F.col("query").alias("text_a"), "index_b", F.col("candidate").alias("text_b"), "score", "details")

    def rerank_vector_results(self, query: str | DataFrame, hits: DataFrame, preprocess_query: bool = True, preprocess_candidates: bool = False) -> DataFrame:
        """(query_id, id, candidate, score, vector_score, details, rank) of external hits (text, score, and if any id, query_id, pos).

        The external score stands in for the cosine; nothing is filtered. Hits of equal text show the last one's id and score.
        """
        hits = spark_frame(hits)
        for name in ("text", "score"):
            if name not in hits.columns:
                raise ValueError(f"hits have no column {name!r}")
        spark = hits.sparkSession
        asked = texts(spark, [query], "query_id", "query") if isinstance(query, str) else query
        asked = prepared(asked, "query", "p_query", self.config, preprocess_query, as_of=self.as_of)
        own = hits if "query_id" in hits.columns else hits.withColumn("query_id", F.lit(0).cast("long"))
        own = own if "id" in own.columns else own.withColumn("id", F.lit(None).cast("string"))
        own = own if "pos" in own.columns else numbered(own, "pos")
        rows = own.select("query_id", "pos", "id", F.col("text").alias("candidate"), F.col("score").cast("double").alias("cos_score"))
        rows = prepared(rows, "candidate", "p_candidate", self.config, preprocess_candidates, as_of=self.as_of)
        scored = self.rescore(rows.withColumn("cos_rank", F.col("pos")).join(asked.select("query_id", "p_query"), "query_id"))
        last = rows.groupBy("query_id", "candidate").agg(F.max_by(F.struct("id", F.col("cos_score").alias("vector_score")), "pos").alias("_o"))
        return scored.join(last, ["query_id", "candidate"]).select("query_id", "_o.id", "candidate", "score", "_o.vector_score", "details", "rank")

    # --- caches ---

    def keep(self, df: DataFrame) -> DataFrame:
        """Persist an index or prepared table until clear_cache."""
        self._kept.append(df.persist())
        return self._kept[-1]

    def clear_cache(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()

    def unload_embeddings_model(self, name: str | None = None) -> None:
        unload(name)
