"""Pairwise scores, retrieve-and-rerank, linkage, fusion and calibration over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SMART, MatchConfig
from ..functions import similarity
from ..functions.encoders import letter_encoder
from ..operators.calibration import Calibrator
from ..operators.fusion import fuse_lists
from ..operators.matcher import Matcher
from ..sources.tables import benchmark, documents, name_pairs, part_labels, part_names, table
from . import sql

TOP = 5
QUERY = "blue bolt large"
CONFIGS = [{"edit": 1.0}, {"cosine": 1.0}, {"cosine": 0.5, "edit": 0.5}, {"cosine": 0.4, "edit": 0.3, "phonetic": 0.3}]
THRESHOLD = 0.65


def _pair_score(score):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return name_pairs(spark, sf_dir).select("a", "b", F.round(score(F.col("a"), F.col("b")), 6).alias("score"))

    return query


def entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each part's size tag lies within its key's tag."""
    a = F.concat(F.lit("<size:"), F.col("p_size").cast("string"), F.lit("> x"))
    b = F.concat(F.lit("y <key:"), F.col("p_partkey").cast("string"), F.lit(">"))
    return table(spark, sf_dir, "part").select("p_partkey", similarity.entity_overlap(a, b).alias("score"))


def _details(field: str, *names: str) -> list[Column]:
    return [F.round(F.col("details")[n][field], 6).alias(n) for n in names]


def _hybrid(config: MatchConfig, *shown: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Matcher(config).compare(name_pairs(spark, sf_dir), "a", "b")
        return found.select("a", "b", F.round("score", 6).alias("score"), *_details("score", *shown))

    return query


def hybrid_short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tagged texts: a full entity match scores 0.95, others their edit similarity's share."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<size:"), F.col("p_size").cast("string"), F.lit(">")).alias("a"), F.concat(F.lit("<key:"), F.col("p_partkey").cast("string"), F.lit(">")).alias("b"))
    found = Matcher(MatchConfig.smart(weights={"entity": 1.0, "edit": 3.0})).compare(rows, "a", "b", preprocess=False)
    return found.select("p_partkey", F.round("score", 6).alias("score"), F.coalesce(F.col("details")["entity"]["short_circuit"], F.lit(False)).alias("short_circuit"))


def _many_to_many(config: MatchConfig, field: str, *shown: str):
    """Every distinct part name against the labels of all parts."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Matcher(config).compare_many_to_many(part_names(spark, sf_dir), part_labels(spark, sf_dir), TOP, 0.1)
        return found.select("query_id", "pos", "candidate", F.round("score", 6).alias("score"), *_details(field, *shown), "rank")

    return query


def hybrid_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs against brands of all parts: both hold numbers, which are tagged and found in each other or not."""
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("pacote "), F.col("p_size").cast("string"), F.lit(" "), F.col("p_name")).alias("a"), F.concat_ws(" ", "p_brand", "p_name").alias("b")).distinct()
    found = Matcher(MatchConfig.smart(entities=("number",))).compare(rows, "a", "b")
    return found.select("a", "b", F.round("score", 6).alias("score"), *_details("score", *SMART), F.coalesce(F.col("details")["entity"]["short_circuit"], F.lit(False)).alias("short_circuit"))


def m2m_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand with a name against the labels of all parts: brands are tagged numbers, some within others."""
    asked = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("query_id"), F.min("p_name").alias("name")).select("query_id", F.concat_ws(" ", "p_brand", "name").alias("query"))
    found = Matcher(MatchConfig.smart(entities=("number",))).compare_many_to_many(asked, part_labels(spark, sf_dir), 3 * TOP, 0.1)
    return found.select("query_id", "pos", "candidate", F.round("score", 6).alias("score"), *_details("score", "cosine", "entity", "edit", "phonetic"), "rank")


def m2m_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against all documents, whole texts rescored."""
    found = Matcher(MatchConfig()).compare_many_to_many(benchmark(spark, sf_dir), documents(spark, sf_dir), TOP, 0.1)
    return found.select("query_id", F.col("pos").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def compare_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Matcher(MatchConfig()).compare_batch(QUERY, part_labels(spark, sf_dir), 50, 0.1)
    return found.select("pos", "candidate", F.round("score", 6).alias("score"), "rank")


def dataframe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("label", F.concat_ws(" ", "p_name", "p_type"))
    found = Matcher(MatchConfig()).compare_dataframe(rows, "label", QUERY, 50, 0.1, order="p_partkey")
    return found.select("p_partkey", "label", "p_brand", F.round("score", 6).alias("score"))


def record_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    rows = part_labels(spark, sf_dir)
    found = Matcher(MatchConfig()).record_linkage(names, rows, "p_name", "candidate", TOP, 0.1, order_a="p_name", order_b="pos")
    return found.select("index_a", "text_a", "index_b", "text_b", F.round("score", 6).alias("score"))


def _rerank(config: MatchConfig):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), (F.col("p_size") / 50).alias("score"))
        found = Matcher(config).rerank_vector_results(QUERY, hits, preprocess_candidates=True)
        return found.select("id", "candidate", F.round("score", 6).alias("score"), F.round("vector_score", 6).alias("vector_score"), "rank")

    return query


def _rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking for each part type: name and size of its parts, by price."""
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("algo"), F.concat_ws(" ", "p_name", "p_size").alias("candidate"), (1000 / F.col("p_retailprice")).alias("score"), "p_partkey")
    types = rows.select("algo").distinct().withColumn("algo_idx", F.row_number().over(Window.orderBy("algo")))  # a row a type
    order = Window.partitionBy("algo").orderBy(F.round("score", 9).desc(), "p_partkey")
    return rows.join(types, "algo").select("algo", "algo_idx", F.row_number().over(order).alias("position"), "candidate", "score")


def rrf_fuse_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates absent from later lists take a penalty rank there; equal ones of a list add up."""
    out = fuse_lists(_rankings(spark, sf_dir), 60, {"ECONOMY": 2.0})
    return out.select("candidate", F.round("score", 6).alias("score"), F.col("details")["SMALL"]["rank"].alias("rank_small"), F.round(F.col("details")["SMALL"]["raw_score"], 6).alias("raw_small"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names match if their last words are equal."""
    rows = name_pairs(spark, sf_dir)
    return rows.select(F.col("a").alias("query"), F.col("b").alias("target"), (F.substring_index("a", " ", -1) == F.substring_index("b", " ", -1)).alias("match"))


def calibrate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Calibrator(CONFIGS, MatchConfig(), THRESHOLD).metrics(_gold(spark, sf_dir))
    return found.select("config_id", "tp", "fp", "fn", "tn", *(F.round(n, 6).alias(n) for n in ("precision", "recall", "f1_score")), "rank")


def worst_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Calibrator(CONFIGS, MatchConfig(), THRESHOLD).errors(_gold(spark, sf_dir), 2)
    return found.select("query", "target", F.round("score", 6).alias("score"), "offender", F.round("lowest", 6).alias("lowest"))


QUERIES = {
    "edit_ratio": _pair_score(similarity.edit),
    "token_sort_ratio": _pair_score(lambda a, b: similarity.edit(a, b, "token_sort_ratio")),
    "partial_ratio": _pair_score(lambda a, b: similarity.edit(a, b, "partial_ratio")),
    "phonetic_sim": _pair_score(similarity.sounds_like),
    "pair_cosine": _pair_score(similarity.pair_cosine),
    "entity_overlap": entity_overlap,
    "hybrid_compare": _hybrid(MatchConfig()),
    "hybrid_explain": _hybrid(MatchConfig.smart(), *SMART),
    "hybrid_short_circuit": hybrid_short_circuit,
    "hybrid_entities": hybrid_entities,
    "m2m_linear": _many_to_many(MatchConfig(), "score", "cosine", "edit"),
    "m2m_smart": _many_to_many(MatchConfig.smart(), "score", "cosine", "entity", "edit", "phonetic"),
    "m2m_bm25": _many_to_many(MatchConfig(index="bm25"), "score", "cosine", "edit"),
    "m2m_rrf": _many_to_many(MatchConfig(fusion="rrf"), "rank", "cosine", "edit"),
    "m2m_rrf_weighted": _many_to_many(MatchConfig(fusion="rrf", rrf_weights={"cosine": 0.5}), "rank", "cosine", "edit"),
    "m2m_dense_semantic": _many_to_many(MatchConfig(index="dense", use_embeddings=True, encoder=letter_encoder), "score", "cosine", "edit", "semantic"),
    "m2m_semantic_apart": _many_to_many(MatchConfig(index="dense", use_embeddings=True, encoder=letter_encoder, reuse_dense=False), "score", "cosine", "edit", "semantic"),
    "m2m_entities": m2m_entities,
    "m2m_documents": m2m_documents,
    "compare_batch": compare_batch,
    "dataframe_search": dataframe_search,
    "record_linkage": record_linkage,
    "vector_rerank": _rerank(MatchConfig()),
    "vector_rerank_rrf": _rerank(MatchConfig(fusion="rrf")),
    "rrf_fuse_missing": rrf_fuse_missing,
    "calibrate_weights": calibrate_weights,
    "worst_errors": worst_errors,
}

_NAMES = "np AS (SELECT x.p_name AS a, y.p_name AS b FROM (SELECT DISTINCT p_name FROM part) x, (SELECT DISTINCT p_name FROM part) y)"


def _on_pairs(form: str) -> str:
    """Indel ratio of a form of both names."""
    return f"""WITH RECURSIVE {_NAMES}, fp AS (SELECT a AS a0, b AS b0, {form.format("a")} AS a, {form.format("b")} AS b FROM np),{sql.common_length("fp")}
SELECT a0 AS a, b0 AS b, round({sql.ratio("lcs", "fp.a", "fp.b")}, 6) AS score FROM fp JOIN lcs USING (a, b)"""


def _partial(s: str, t: str) -> str:
    """Rows (a0, b0, a, b) of a text and each window of the other of its length, which may hang over the ends."""
    return f"SELECT a AS a0, b AS b0, {s} AS a, substr({t}, greatest(i, 0) + 1, i + length({s}) - greatest(i, 0)) AS b FROM np, LATERAL (SELECT unnest(range(1 - length({s}), length({t}))) AS i)"


_SORTED = "array_to_string(list_sort(string_split({}, ' ')), ' ')"
_NUMBERED = "regexp_replace({}, '(\\d+)', '<number:\\1>', 'g')"


def _scored(pairs: str, form: str) -> str:
    """CTEs ending in sc (a0, b0, a, b, cosine, edit, phonetic): scores of a form of both texts of the pairs np."""
    return f"""WITH RECURSIVE {pairs}, fp AS (SELECT a AS a0, b AS b0, {sql.prepared(form.format("a"))} AS a, {sql.prepared(form.format("b"))} AS b FROM np),{sql.common_length("fp")},{sql.pair_cosine("fp")},
sp AS (SELECT a AS x, b AS y, {sql.sounds("a")} AS a, {sql.sounds("b")} AS b FROM (SELECT DISTINCT a, b FROM fp)),{sql.common_length("sp", "lcp")},
ph AS (SELECT x AS a, y AS b, {sql.ratio("lcp", "sp.a", "sp.b")} AS phonetic FROM sp JOIN lcp USING (a, b)),
sc AS (SELECT a0, b0, a, b, cosine, {sql.ratio("lcs", "fp.a", "fp.b")} AS edit, phonetic FROM fp JOIN lcs USING (a, b) JOIN pc USING (a, b) JOIN ph USING (a, b))"""


_SCORED = _scored(_NAMES, "{}")
# Each of the texts has one number tag at most; the side without more of them must be within the other.
_TAG = "regexp_extract({}, '<number:([^>]+)>', 1)"
_WITHIN = f"({_TAG.format('a')} <> '' AND {_TAG.format('b')} <> '' AND contains({_TAG.format('b')}, {_TAG.format('a')}))"

_LABEL = "concat_ws(' ', p_name, p_type, p_brand)"
_PARTS = f"cands AS (SELECT p_partkey AS pos, {_LABEL} AS candidate, {sql.prepared(_LABEL)} AS p FROM part)"
_ASKED = f"qs AS (SELECT min(p_partkey) AS query_id, p_name AS query, {sql.prepared('p_name')} AS p FROM part GROUP BY p_name)"
# Retrieved rows with their edit similarity: (query_id, query, pos, candidate, score, rank, a, b, edit).
_EDITED = f"""rr AS (SELECT query_id, query, pos, candidate, score, rank, qs.p AS a, cands.p AS b FROM best JOIN qs USING (query_id) JOIN cands USING (pos)),{sql.common_length("rr")},
ed AS (SELECT rr.*, {sql.ratio("lcs", "rr.a", "rr.b")} AS edit FROM rr JOIN lcs USING (a, b))"""
_FOUND = f"WITH RECURSIVE {_PARTS}, {_ASKED},{sql.tfidf()}, {sql.topped(TOP, 0.1)}, {_EDITED}"
# The only entities of the labels are the brands' numbers.
_TAGGED = sql.prepared(f"regexp_replace({_LABEL}, '(\\d+)', '<number:\\1>', 'g')")
_FOUND_SMART = _FOUND.replace(f"{sql.prepared(_LABEL)} AS p", f"{_TAGGED} AS p")
_FOUND_BM25 = f"WITH RECURSIVE {_PARTS}, {_ASKED},{sql.bm25(1.2, 0.75)}, normed AS (SELECT query_id, pos, score / max(score) OVER (PARTITION BY query_id) AS score FROM scores), {sql.topped(TOP, 0.1, 'normed')}, {_EDITED}"
_PARTS_TAGGED = _PARTS.replace(f"{sql.prepared(_LABEL)} AS p", f"{_TAGGED} AS p")
_FOUND_DENSE = f"WITH RECURSIVE {_PARTS}, {_ASKED},{sql.dense()}, {sql.topped(TOP, 0.1)}, {_EDITED}"
_SOUNDED = f""", ss AS (SELECT DISTINCT a AS x, b AS y, {sql.sounds("a")} AS a, {sql.sounds("b")} AS b FROM rr),{sql.common_length("ss", "lcp")},
ep AS (SELECT ed.*, {sql.ratio("lcp", "ss.a", "ss.b")} AS phonetic FROM ed JOIN ss ON ed.a = ss.x AND ed.b = ss.y JOIN lcp ON lcp.a = ss.a AND lcp.b = ss.b)"""


def _by_score(score: str, tie: str = "rank", part: str = "PARTITION BY query_id ") -> str:
    return f"CAST(row_number() OVER ({part}ORDER BY round({score}, 9) DESC, {tie}) AS INTEGER)"


def _linear(source: str, score: str, shown: str) -> str:
    return f" SELECT query_id, pos, candidate, round(total, 6) AS score, {shown}, {_by_score('total')} AS rank FROM (SELECT *, {score} AS total FROM {source})"


def _fused(source: str, cosine: float, part: str = "PARTITION BY query_id ", keys: str = "query_id, ") -> str:
    """CTE fu: rank fusion of cosine (score) and edit, rows of equal text merged."""
    return f"""rk AS (SELECT *, {_by_score("score", part=part)} AS rc, {_by_score("edit", part=part)} AS re FROM {source}),
fu AS (SELECT {keys}candidate, min(pos) AS pos, min(rank) AS cos_rank, least(1.0, sum({cosine} / (60 + rc) + 1.0 / (60 + re)) / ({cosine + 1} / 61)) AS total, max(rc) AS cosine, max(re) AS edit FROM rk GROUP BY {keys}candidate)"""


def _rrf(cosine: float) -> str:
    return f"{_FOUND}, {_fused('ed', cosine)} SELECT query_id, pos, candidate, round(total, 6) AS score, cosine, edit, {_by_score('total', 'cos_rank')} AS rank FROM fu"


_ONE = f"qs AS (SELECT CAST(0 AS BIGINT) AS query_id, '{QUERY}' AS query, {sql.prepared(f"'{QUERY}'")} AS p)"
_NAME_TYPE = "concat_ws(' ', p_name, p_type)"
_HITS = f"""WITH RECURSIVE hits AS (SELECT p_partkey AS pos, p_partkey AS rank, p_brand AS id, {_NAME_TYPE} AS candidate, p_size / 50 AS score, {sql.prepared(f"'{QUERY}'")} AS a, {sql.prepared(_NAME_TYPE)} AS b FROM part),{sql.common_length("hits")},
ed AS (SELECT hits.*, {sql.ratio("lcs", "hits.a", "hits.b")} AS edit FROM hits JOIN lcs USING (a, b)),
la AS (SELECT candidate, max_by(id, pos) AS last_id, max_by(score, pos) AS vector_score FROM hits GROUP BY candidate)"""
_CONFIGS = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS config_id, *, " + " + ".join(f"{w} * {n}" for n, w in c.items()) + " AS total FROM gold" for i, c in enumerate(CONFIGS))
_GOLD = f"{_SCORED}, gold AS (SELECT *, string_split(a0, ' ')[-1] = string_split(b0, ' ')[-1] AS match FROM sc)"

ORACLE = {
    "edit_ratio": _on_pairs("{}"),
    "token_sort_ratio": _on_pairs(_SORTED),
    "partial_ratio": f"""WITH RECURSIVE {_NAMES}, wp AS ({_partial("a", "b")} WHERE length(a) <= length(b) UNION ALL {_partial("b", "a")} WHERE length(b) <= length(a)),{sql.common_length("wp")}
SELECT a0 AS a, b0 AS b, round(max({sql.ratio("lcs", "wp.a", "wp.b")}), 6) AS score FROM wp JOIN lcs USING (a, b) GROUP BY a0, b0""",
    "phonetic_sim": _on_pairs(sql.sounds("{}")),
    "pair_cosine": f"WITH {_NAMES},{sql.pair_cosine('np')} SELECT a, b, round(cosine, 6) AS score FROM pc",
    "entity_overlap": "SELECT p_partkey, CASE WHEN contains(CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR)) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM part",
    "hybrid_compare": f"{_SCORED} SELECT a0 AS a, b0 AS b, round(0.5 * cosine + 0.5 * edit, 6) AS score FROM sc",
    "hybrid_explain": f"""{_SCORED} SELECT a0 AS a, b0 AS b, round(0.45 * cosine + 0.25 * edit + 0.2 * phonetic, 6) AS score,
  round(cosine, 6) AS cosine, round(edit, 6) AS edit, round(phonetic, 6) AS phonetic, CAST(0.0 AS DOUBLE) AS entity FROM sc""",
    "hybrid_short_circuit": f"""WITH RECURSIVE tg AS (SELECT p_partkey, '<size:' || p_size || '>' AS a, '<key:' || p_partkey || '>' AS b, contains(CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR)) AS short_circuit FROM part),{sql.common_length("tg")}
SELECT p_partkey, round(CASE WHEN short_circuit THEN 0.95 ELSE 0.75 * {sql.ratio("lcs", "tg.a", "tg.b")} END, 6) AS score, short_circuit FROM tg JOIN lcs USING (a, b)""",
    "hybrid_entities": f"""{_scored("np AS (SELECT DISTINCT 'pacote ' || p_size || ' ' || p_name AS a, concat_ws(' ', p_brand, p_name) AS b FROM part)", _NUMBERED)}
SELECT a0 AS a, b0 AS b, round(CASE WHEN full_ THEN 0.95 ELSE 0.45 * cosine + 0.25 * edit + 0.2 * phonetic END, 6) AS score, CASE WHEN NOT full_ THEN round(cosine, 6) END AS cosine,
  CASE WHEN NOT full_ THEN round(edit, 6) END AS edit, CASE WHEN NOT full_ THEN round(phonetic, 6) END AS phonetic, CAST(full_ AS DOUBLE) AS entity, full_ AS short_circuit FROM (SELECT *, {_WITHIN} AS full_ FROM sc)""",
    "m2m_entities": f"""WITH RECURSIVE {_PARTS_TAGGED}, qs AS (SELECT min(p_partkey) AS query_id, p_brand || ' ' || min(p_name) AS query, {sql.prepared(_NUMBERED.format("p_brand || ' ' || min(p_name)"))} AS p FROM part GROUP BY p_brand),
{sql.tfidf()}, {sql.topped(3 * TOP, 0.1)}, {_EDITED}{_SOUNDED} SELECT query_id, pos, candidate, round(total, 6) AS score, CASE WHEN NOT full_ THEN round(score, 6) END AS cosine, CAST(full_ AS DOUBLE) AS entity,
  CASE WHEN NOT full_ THEN round(edit, 6) END AS edit, CASE WHEN NOT full_ THEN round(phonetic, 6) END AS phonetic, {_by_score('total')} AS rank
  FROM (SELECT *, CASE WHEN full_ THEN 0.95 ELSE 0.45 * score + 0.25 * edit + 0.2 * phonetic END AS total FROM (SELECT *, {_WITHIN} AS full_ FROM ep))""",
    "m2m_dense_semantic": _FOUND_DENSE + _linear("ed", "0.7 * score + 0.3 * edit", "round(score, 6) AS cosine, round(edit, 6) AS edit, round(score, 6) AS semantic"),
    "m2m_semantic_apart": _FOUND_DENSE + _linear("ed", "0.7 * score + 0.3 * edit", "round(score, 6) AS cosine, round(edit, 6) AS edit, round(score, 6) AS semantic"),
    "m2m_linear": _FOUND + _linear("ed", "0.5 * score + 0.5 * edit", "round(score, 6) AS cosine, round(edit, 6) AS edit"),
    "m2m_smart": _FOUND_SMART + _SOUNDED + _linear("ep", "0.45 * score + 0.25 * edit + 0.2 * phonetic", "round(score, 6) AS cosine, CAST(0.0 AS DOUBLE) AS entity, round(edit, 6) AS edit, round(phonetic, 6) AS phonetic"),
    "m2m_bm25": _FOUND_BM25 + _linear("ed", "0.5 * score + 0.5 * edit", "round(score, 6) AS cosine, round(edit, 6) AS edit"),
    "m2m_rrf": _rrf(1.0),
    "m2m_rrf_weighted": _rrf(0.5),
    "compare_batch": f"WITH RECURSIVE {_PARTS}, {_ONE},{sql.tfidf()}, {sql.topped(50, 0.1)}, {_EDITED} SELECT pos, candidate, round(total, 6) AS score, {_by_score('total')} AS rank FROM (SELECT *, 0.5 * score + 0.5 * edit AS total FROM ed)",
    "dataframe_search": f"""WITH RECURSIVE cands AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_partkey, p_brand, {_NAME_TYPE} AS candidate, {sql.prepared(_NAME_TYPE)} AS p FROM part), {_ONE},{sql.tfidf()}, {sql.topped(50, 0.1)}, {_EDITED}
SELECT p_partkey, cands.candidate AS label, p_brand, round(total, 6) AS score FROM (SELECT candidate, max(0.5 * score + 0.5 * edit) AS total FROM ed GROUP BY candidate) t
JOIN cands ON cands.pos = (SELECT min(c.pos) FROM cands c WHERE c.candidate = t.candidate)""",
    "record_linkage": f"""WITH RECURSIVE cands AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, {_LABEL} AS candidate, {sql.prepared(_LABEL)} AS p FROM part),
qs AS (SELECT row_number() OVER (ORDER BY p_name) - 1 AS query_id, p_name AS query, {sql.prepared("p_name")} AS p FROM (SELECT DISTINCT p_name FROM part)),{sql.tfidf()}, {sql.topped(TOP, 0.1)}, {_EDITED},
fi AS (SELECT candidate, min(pos) AS index_b FROM cands GROUP BY candidate)
SELECT query_id AS index_a, query AS text_a, index_b, candidate AS text_b, round(0.5 * score + 0.5 * edit, 6) AS score FROM ed JOIN fi USING (candidate)""",
    "vector_rerank": f"""{_HITS} SELECT last_id AS id, candidate, round(total, 6) AS score, round(vector_score, 6) AS vector_score, {_by_score("total", part="")} AS rank
FROM (SELECT *, 0.5 * score + 0.5 * edit AS total FROM ed) JOIN la USING (candidate)""",
    "vector_rerank_rrf": f"{_HITS}, {_fused('ed', 1.0, '', '')} SELECT last_id AS id, candidate, round(total, 6) AS score, round(vector_score, 6) AS vector_score, {_by_score('total', 'cos_rank', '')} AS rank FROM fu JOIN la USING (candidate)",
    "rrf_fuse_missing": """WITH ty AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS algo_idx FROM (SELECT DISTINCT p_type FROM part)),
r AS (SELECT p_type AS algo, algo_idx, concat_ws(' ', p_name, p_size) AS candidate, 1000 / p_retailprice AS score, CASE WHEN p_type = 'ECONOMY' THEN 2.0 ELSE 1.0 END AS weight,
  row_number() OVER (PARTITION BY p_type ORDER BY round(1000 / p_retailprice, 9) DESC, p_partkey) AS position FROM part JOIN ty USING (p_type)),
li AS (SELECT algo, algo_idx, weight, count(*) AS size FROM r GROUP BY ALL),
se AS (SELECT candidate, min(algo_idx) AS first FROM r GROUP BY candidate),
me AS (SELECT candidate, algo, sum(weight / (60.0 + position)) AS part, max(position) AS rank, max_by(score, position) AS raw FROM r GROUP BY candidate, algo),
ev AS (SELECT se.candidate, li.algo, coalesce(part, CASE WHEN algo_idx > first THEN weight / (61.0 + size) END) AS part, coalesce(rank, CASE WHEN algo_idx > first THEN size + 1 END) AS rank, coalesce(raw, CASE WHEN algo_idx > first THEN 0.0 END) AS raw
  FROM se CROSS JOIN li LEFT JOIN me ON me.candidate = se.candidate AND me.algo = li.algo)
SELECT candidate, round(least(1.0, sum(part) / (SELECT sum(weight / 61.0) FROM li)), 6) AS score, CAST(max(CASE WHEN algo = 'SMALL' THEN rank END) AS INTEGER) AS rank_small, round(max(CASE WHEN algo = 'SMALL' THEN raw END), 6) AS raw_small FROM ev GROUP BY candidate""",
    "calibrate_weights": f"""{_GOLD}, cf AS ({_CONFIGS}), co AS (SELECT config_id, count(*) FILTER (hit AND match) AS tp, count(*) FILTER (hit AND NOT match) AS fp, count(*) FILTER (NOT hit AND match) AS fn, count(*) FILTER (NOT hit AND NOT match) AS tn
  FROM (SELECT *, round(total, 9) >= {THRESHOLD} AS hit FROM cf) GROUP BY config_id),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM co), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1 FROM pr)
SELECT config_id, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1_score, CAST(row_number() OVER (ORDER BY round(f1, 12) DESC, config_id) AS INTEGER) AS rank FROM f""",
    "worst_errors": f"""{_GOLD} SELECT a0 AS query, b0 AS target, round(0.5 * cosine + 0.5 * edit, 6) AS score, CASE WHEN least(cosine, edit) < 1 THEN CASE WHEN cosine <= edit THEN 'cosine' ELSE 'edit' END END AS offender,
  CASE WHEN least(cosine, edit) < 1 THEN round(least(cosine, edit), 6) END AS lowest FROM gold WHERE match AND round(0.5 * cosine + 0.5 * edit, 9) < {THRESHOLD}""",
}
