"""Preparation and entity extraction over whole tables."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import entities, text
from ..operators.pipeline import prepared
from ..sources.catalog import preprocess_catalog
from ..sources.shared import scratch
from ..sources.tables import documents, spread, table
from . import sql

AS_OF = date(2024, 4, 25)
#: Rows with entities of every kind, which go with the documents.
SAMPLES = [
    (-1, "Custou R$ 1.500,50 e outro de 30 reais, ou BRL 12.5"),
    (-2, "Comprei 2kg de arroz e 1.5l de suco, mais 3,25 mm"),
    (-3, "Eu tenho três gatos e 2 cachorros, dez peixes e 0,5 bolo"),
    (-4, "O evento será dia 25 de abril de 2024 às 10h, ou em 03/05/2024 ou 12-11-2023"),
    (-5, "Eu comprei isso ontem e vou devolver amanhã"),
    (-6, "Temos o S22 Ultra, o iPhone 13 e a peça XJ-900; GN 500 por R$ 5.000"),
    (-7, ""),
]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).unionByName(spark.createDataFrame(SAMPLES, "doc_id long, text string"))


TEXTS = "(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in SAMPLES) + ") AS v(doc_id, text))"


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.clean(F.col("text")).alias("cleaned"))


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.tokenize(text.clean(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).cast("long").alias("n"))


def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens left by the built-in list, and by a list of one's own instead."""
    tokens = text.tokenize(text.clean(F.col("text")))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(text.drop_stopwords(tokens), " ").alias("kept"), F.array_join(text.drop_stopwords(tokens, False, ("de", "la", "the")), " ").alias("kept_own")
    )


def preprocess_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.prepare(F.col("text")).alias("prepared"))


def contractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.expand_contractions(F.lower("text")).alias("expanded"))


def text_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.text_key(F.col("text")).alias("key"))


def phonetic_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.phonetic(F.col("text")).alias("sounds"))


def dedup_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct text prepared once, with the number of rows that share it."""
    rows = table(spark, sf_dir, "documents").groupBy("text").agg(F.count("*").alias("n"))
    return rows.select(text.text_key(F.col("text")).alias("key"), "n", text.prepare(F.col("text")).alias("prepared"))


def catalog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue written, and read back by a second call because its fingerprint still holds."""
    rows, path = documents(spark, sf_dir), scratch(spark, "catalogue")
    preprocess_catalog(rows, path)
    return preprocess_catalog(rows, path)


def collapse_model_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", entities.collapse_models(F.col("text")).alias("collapsed"))


def _extracted(rows: DataFrame, names: Iterable[str], known: entities.Registry = entities.registry) -> DataFrame:
    found = rows.select("doc_id", F.explode(entities.extract(F.col("text"), names, AS_OF, known)).alias("e"))
    return found.groupBy("doc_id", F.col("e.entity_type").alias("entity_type"), F.col("e.value").alias("value")).agg(F.count("*").alias("n"))


def _extract(*names: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _extracted(_texts(spark, sf_dir), names)

    return query


def _handles(text: str, today: date) -> Iterable[entities.Entity]:
    return [entities.Entity("handle", m.group()[1:], *m.span(), m.group()) for m in re.finditer(r"[@#][A-Za-z0-9_]+", text)]


def custom_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined extractor, in a registry of its own so that it stays out of other queries."""
    own = entities.Registry()
    own.register("handle", _handles)
    return _extracted(_texts(spark, sf_dir), ["handle"], own)


def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of every extractor with its place."""
    return _texts(spark, sf_dir).select("doc_id", F.explode(entities.extract(F.col("text"), ENTITIES, AS_OF)).alias("e")).select("doc_id", "e.*")


def normalize_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", entities.tag(F.col("text"), ENTITIES, AS_OF).alias("tagged"))


def preprocess_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(_texts(spark, sf_dir), "text", "prepared", MatchConfig.smart(entities=ENTITIES), as_of=AS_OF).select("doc_id", "prepared")


ENTITIES = ("date", "dimension", "money", "number", "product_model")

QUERIES = {
    "clean_text": clean_text,
    "tokenize": tokenize,
    "stopword_filter": stopword_filter,
    "preprocess_basic": preprocess_basic,
    "contractions": contractions,
    "text_sha256": text_sha256,
    "phonetic_hash": phonetic_hash,
    "dedup_preprocess": dedup_preprocess,
    "catalog_roundtrip": catalog_roundtrip,
    "collapse_model_spaces": collapse_model_spaces,
    "extract_money": _extract("money"),
    "extract_date": _extract("date"),
    "extract_dimension": _extract("dimension"),
    "extract_number": _extract("number"),
    "extract_product_model": _extract("product_model"),
    "custom_extractor": custom_extractor,
    "entity_spans": entity_spans,
    "normalize_entities": normalize_entities,
    "preprocess_smart": preprocess_smart,
}

# Words beyond ASCII as underscores, other characters beyond it as spaces: word boundaries are then those of Unicode.
MASKED = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F\P{L}çÇêÊ]', '_', 'g'), '[^\x00-\x7FçÇêÊ]', ' ', 'g')"


def _values(kind: str, matches: str, value: str) -> str:
    """Values of the matches m of each text, counted."""
    return f"""SELECT doc_id, '{kind}' AS entity_type, value, count(*) AS n FROM
  (SELECT doc_id, {value} AS value FROM (SELECT doc_id, unnest({matches}) AS m FROM {TEXTS}))
  WHERE value IS NOT NULL GROUP BY ALL"""


_FLOAT = "CAST(CAST(replace({x}, ',', '.') AS DOUBLE) AS VARCHAR)"
_WORDS = " ".join(f"WHEN '{w}' THEN '{n}'" for n, ws in ((0, "zero"), (1, "um uma"), (2, "dois duas"), (3, "três tres"), (4, "quatro"), (5, "cinco"), (6, "seis"), (7, "sete"), (8, "oito"), (9, "nove"), (10, "dez"), (100, "cem"), (1000, "mil")) for w in ws.split())
_MONTHS = "lower(m)"
for _month, _n in (("janeiro", 1), ("fevereiro", 2), ("março", 3), ("marco", 3), ("abril", 4), ("maio", 5), ("junho", 6), ("julho", 7), ("agosto", 8), ("setembro", 9), ("outubro", 10), ("novembro", 11), ("dezembro", 12)):
    _MONTHS = f"replace({_MONTHS}, '{_month}', '{_n:02d}')"
_YMD = " , ".join(f"try_strptime(regexp_replace({_MONTHS}, '\\s+de\\s+|-', '/', 'g'), '{p}')" for p in ("%d/%m/%Y", "%m/%d/%Y", "%d/%m/%y", "%m/%d/%y"))
_DATE = f"""CASE lower(m) WHEN 'hoje' THEN '2024-04-25' WHEN 'ontem' THEN '2024-04-24' WHEN 'amanhã' THEN '2024-04-26' ELSE strftime(coalesce({_YMD}), '%Y-%m-%d') END"""

_MONEY_VALUE = r"CAST(TRY_CAST(CASE WHEN contains(regexp_extract(m, '[\d.,]+'), ',') THEN replace(replace(regexp_extract(m, '[\d.,]+'), '.', ''), ',', '.') ELSE regexp_extract(m, '[\d.,]+') END AS DOUBLE) AS VARCHAR)"
_NUMBER_VALUE = rf"CASE WHEN regexp_matches(m, '^\d') THEN regexp_replace({_FLOAT.format(x='m')}, '\.0$', '') ELSE CASE lower(m) {_WORDS} END END".replace("CAST(replace(m", "TRY_CAST(replace(m")
_SIZE_VALUE = _FLOAT.format(x=r"regexp_extract(m, '[\d.,]+')") + r" || ':' || lower(regexp_extract(m, '[A-Za-z]+'))"
# (place in ENTITIES, type, whether on the masked text, pattern, value of a match m)
_PATTERNS = [
    (0, "date", False, r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", _DATE),
    (0, "date", False, r"(?i)\b\d{1,2}\s+de\s+[A-Za-zçÇ]+\s+de\s+\d{2,4}\b", _DATE),
    (0, "date", False, r"(?i)\b(?:amanhã|ontem|hoje)", _DATE),
    (1, "dimension", False, r"(?i)\d+(?:[.,]\d+)?\s*(?:kg|g|mg|m|cm|mm|l|ml)\b", _SIZE_VALUE),
    (2, "money", False, r"(?i)(?:R\$|BRL)\s*[\d.,]+|[\d.,]+\s+(?:reais|centavos|BRL)", _MONEY_VALUE),
    (3, "number", True, r"\b\d+(?:[.,]\d+)?\b", _NUMBER_VALUE),
    (3, "number", True, r"\b[a-zA-ZçÇêÊ]+\b", _NUMBER_VALUE),
    (4, "productmodel", True, r"\b(?:[A-Za-z]+-?\d+[A-Za-z\d]*|\d+-?[A-Za-z]+[A-Za-z\d]*)\b", "upper(m)"),
]


def _spans(texts: str) -> str:
    """CTEs tx (doc_id, text) and sp (doc_id, rank, entity_type, value, start, stop): places follow from the lengths of matches and of what is between them."""
    parts = []
    for rank, kind, masked, pattern, value in _PATTERNS:
        x = MASKED if masked else "text"
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS entity_type, {value} AS value, start, start + length(m) AS stop FROM (
  SELECT doc_id, ms[i] AS m, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS INTEGER) AS start
  FROM (SELECT doc_id, string_split_regex({x}, '{pattern}') AS gaps, regexp_extract_all({x}, '{pattern}') AS ms FROM tx), LATERAL (SELECT unnest(generate_series(1, len(ms))) AS i))""")
    return f"WITH tx AS ({texts}), sa AS ({' UNION ALL '.join(parts)}), sp AS (SELECT * FROM sa WHERE value IS NOT NULL)"


_COLLAPSED = rf"SELECT doc_id, regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_])([A-Za-z]{{2,4}})\s+([A-Za-z]*\d[A-Za-z\d]*(?:-[A-Za-z\d]+)*)\b', '\1\2\3', 'g') AS text FROM {TEXTS}"
# Tags in place of matches, of overlapping ones the first: a fold over the matches in order.
_TAGGED = f"""{_spans(_COLLAPSED)},
li AS (SELECT doc_id, list({{'out': '<' || entity_type || ':' || value || '>', 'at': start, 'stop': CAST(stop AS INTEGER)}} ORDER BY start, rank) AS es FROM sp GROUP BY doc_id),
fo AS (SELECT tx.doc_id, text, CASE WHEN es IS NULL THEN {{'out': '', 'at': 0, 'stop': 0}} ELSE list_reduce(es, lambda a, e: CASE WHEN e.at < a.stop THEN a ELSE
  {{'out': a.out || substr(text, a.stop + 1, e.at - a.stop) || e.out, 'at': e.at, 'stop': e.stop}} END, {{'out': '', 'at': 0, 'stop': 0}}) END AS f FROM tx LEFT JOIN li ON li.doc_id = tx.doc_id),
tg AS (SELECT doc_id, f.out || substr(text, f.stop + 1) AS tagged FROM fo)"""

ORACLE = {
    "clean_text": f"SELECT doc_id, {sql.cleaned('text')} AS cleaned FROM documents",
    "tokenize": f"SELECT doc_id, array_to_string(t, ' ') AS tokens, len(t) AS n FROM (SELECT doc_id, {sql.tokens(sql.cleaned('text'))} AS t FROM documents)",
    "stopword_filter": f"""SELECT conv_id, turn, array_to_string({sql.kept_tokens("t")}, ' ') AS kept,
  array_to_string(list_filter(t, lambda w: w NOT IN ('de', 'la', 'the')), ' ') AS kept_own FROM (SELECT conv_id, turn, {sql.tokens(sql.cleaned("text"))} AS t FROM conversations)""",
    "preprocess_basic": f"SELECT doc_id, {sql.prepared('text')} AS prepared FROM documents",
    "contractions": f"SELECT conv_id, turn, regexp_replace({sql.expanded('lower(text)')}, '^\\s+|\\s+$', '', 'g') AS expanded FROM conversations",
    "text_sha256": "SELECT doc_id, sha256(text) AS key FROM documents",
    "phonetic_hash": f"SELECT doc_id, {sql.sounds(sql.single_spaced('text'))} AS sounds FROM documents",
    "dedup_preprocess": f"SELECT sha256(text) AS key, n, {sql.prepared('text')} AS prepared FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)",
    "catalog_roundtrip": f"SELECT doc_id AS pos, text AS candidate, {sql.prepared('text')} AS p_candidate FROM documents",
    "collapse_model_spaces": rf"SELECT doc_id, regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_])([A-Za-z]{{2,4}})\s+([A-Za-z]*\d[A-Za-z\d]*(?:-[A-Za-z\d]+)*)\b', '\1\2\3', 'g') AS collapsed FROM {TEXTS}",
    "extract_money": _values(
        "money",
        r"regexp_extract_all(text, '(?i)(?:R\$|BRL)\s*[\d.,]+|[\d.,]+\s+(?:reais|centavos|BRL)')",
        r"CAST(TRY_CAST(CASE WHEN contains(regexp_extract(m, '[\d.,]+'), ',') THEN replace(replace(regexp_extract(m, '[\d.,]+'), '.', ''), ',', '.') ELSE regexp_extract(m, '[\d.,]+') END AS DOUBLE) AS VARCHAR)",
    ),
    "extract_date": _values(
        "date", r"list_concat(list_concat(regexp_extract_all(text, '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b'), regexp_extract_all(text, '(?i)\b\d{1,2}\s+de\s+[A-Za-zçÇ]+\s+de\s+\d{2,4}\b')), regexp_extract_all(text, '(?i)\b(?:amanhã|ontem|hoje)'))", _DATE
    ),
    "extract_dimension": _values("dimension", r"regexp_extract_all(text, '(?i)\d+(?:[.,]\d+)?\s*(?:kg|g|mg|m|cm|mm|l|ml)\b')", _FLOAT.format(x=r"regexp_extract(m, '[\d.,]+')") + r" || ':' || lower(regexp_extract(m, '[A-Za-z]+'))"),
    "extract_number": _values(
        "number",
        rf"list_concat(regexp_extract_all({MASKED}, '\b\d+(?:[.,]\d+)?\b'), regexp_extract_all({MASKED}, '\b[a-zA-ZçÇêÊ]+\b'))",
        rf"CASE WHEN regexp_matches(m, '^\d') THEN regexp_replace({_FLOAT.format(x=chr(109))}, '\.0$', '') ELSE CASE lower(m) {_WORDS} END END".replace("CAST(replace(m", "TRY_CAST(replace(m"),
    ),
    "extract_product_model": _values("productmodel", rf"regexp_extract_all({MASKED}, '\b(?:[A-Za-z]+-?\d+[A-Za-z\d]*|\d+-?[A-Za-z]+[A-Za-z\d]*)\b')", "upper(m)"),
    "entity_spans": f"""{_spans(f"SELECT * FROM {TEXTS}")} SELECT doc_id, entity_type, value, start, CAST(stop AS INTEGER) AS "end", substr(text, start + 1, stop - start) AS text_matched FROM sp JOIN tx USING (doc_id)""",
    "normalize_entities": f"{_TAGGED} SELECT doc_id, tagged FROM tg",
    "preprocess_smart": f"{_TAGGED} SELECT doc_id, {sql.prepared('tagged')} AS prepared FROM tg",
    "custom_extractor": _values("handle", "regexp_extract_all(text, '[@#][A-Za-z0-9_]+')", "substr(m, 2)"),
}
