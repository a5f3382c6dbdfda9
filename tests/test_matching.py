import asyncio
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests import brute
from verbamatch import Calibrator, MatchConfig, Matcher, StageProcessingError, fuse_lists, spark_frame
from verbamatch.functions import entities, kernels, similarity
from verbamatch.functions.encoders import encode, hashing_encoder, lazy, unload
from verbamatch.operators import index
from verbamatch.operators.matcher import texts
from verbamatch.sources import catalog
from verbamatch.streaming.matching import match_stream, prepare_stream

TODAY = date(2024, 4, 25)
WORDS = "samsung galaxy s22 ultra iphone pro max capa pelicula mouse dell tv 55 polegadas geladeira frost".split()


def corpus(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))) for _ in range(n)]


def frame(spark, rows, key="pos", column="candidate"):
    return texts(spark, rows, key, column)


# --- entities ---


@pytest.mark.parametrize(
    "names, line, want",
    [
        (["money"], "Custou R$ 1.500,50 e outro de 30 reais.", ["1500.5", "30.0"]),
        (["dimension"], "Comprei 2kg de arroz e 1.5l de suco.", ["2.0:kg", "1.5:l"]),
        (["number"], "Eu tenho três gatos e 2 cachorros.", ["3", "2"]),
        (["date"], "O evento será dia 25 de abril de 2024 às 10h.", ["2024-04-25"]),
        (["date"], "Eu comprei isso ontem e vou devolver amanhã.", ["2024-04-24", "2024-04-26"]),
        (["date"], "31/02/2024 e 12/25/2023 e 1/2/24", ["2023-12-25", "2024-02-01"]),
        (["product_model"], "Temos o S22 Ultra e a peça XJ-900.", ["S22", "XJ-900"]),
    ],
)
def test_extractors(names, line, want):
    assert [str(e.value) for e in entities.inspect(line, entities.registry.choose(names), TODAY)] == want


def test_tags_take_the_first_of_overlapping_matches(spark):
    rows = [(0, "Eu comprei 2kg de arroz por R$ 30,00 ontem!"), (1, "GN 500 por 30 reais"), (2, None), (3, "")]
    got = spark.createDataFrame(rows, "i int, t string").select("i", entities.tag(F.col("t"), None, TODAY).alias("g")).orderBy("i").collect()
    assert [r.g for r in got] == ["Eu comprei <dimension:2.0:kg> de arroz por <money:30.0> <date:2024-04-24>!", "<productmodel:GN500> <productmodel:POR30> reais", None, ""]


def test_extracted_spans_and_custom_extractor(spark):
    own = entities.Registry()
    own.register("shout", lambda t, today: [entities.Entity("shout", m.group(), *m.span(), m.group()) for m in entities.re.finditer(r"[A-Z]{3,}", t)])
    df = spark.createDataFrame([("say HELLO 7",)], "t string")
    got = df.select(entities.extract(F.col("t"), ["shout", "number"], TODAY, own).alias("e")).first().e
    assert [(e.entity_type, e.value, e.start, e.end, e.text_matched) for e in got] == [("shout", "HELLO", 4, 9, "HELLO"), ("number", "7", 10, 11, "7")]
    with pytest.raises(ValueError):
        own.get("none such")
    assert "shout" not in entities.registry.available()


# --- pairs ---


def test_common_length_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 80))) for _ in "ab")
        assert kernels.common_length(a, b) == brute.lcs(a, b)


def test_edit_examples(spark):
    rows = [("cachorro", "cachorro"), ("cachorro", "gato"), ("", "x"), (None, "x")]
    got = [r.s for r in spark.createDataFrame(rows, "a string, b string").select(similarity.edit(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == 1.0 and got[1] < 0.4 and got[2:] == [0.0, 0.0]
    assert kernels.partial_ratio("gato", "o gato do vizinho") == 1.0
    assert kernels.token_sort_ratio("iphone 13 pro max", "pro max iphone 13") == 1.0
    with pytest.raises(ValueError):
        similarity.edit(F.col("a"), F.col("b"), "none such")


def test_partial_ratio_against_all_windows():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in "ab")
        s, t = sorted((a, b), key=len)
        sides = [(s, t), (t, s)] if len(s) == len(t) else [(s, t)]
        want = max(brute.ratio(x, y[max(0, i) : i + len(x)]) for x, y in sides for i in range(1 - len(x), len(y)))
        assert kernels.partial_ratio(a, b) == pytest.approx(want)


def test_phonetic_examples(spark):
    rows = [("exceção", "esessao"), ("casa", "kaza"), ("paçoca", "pasoka")]
    got = [r.s for r in spark.createDataFrame(rows, "a string, b string").select(similarity.sounds_like(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] > 0.7 and got[1] > 0.7 and got[2] > 0.7


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("<productmodel:GN500>", "<productmodel:GN500> mais", 1.0),
        ("<number:1>", "x <number:100>", 1.0),
        ("<money:1> <money:2>", "<number:1>", 1.0),
        ("<money:7>", "<number:1>", 0.0),
        ("x", "<number:1>", 0.0),
        ("", "", 0.0),
    ],
)
def test_entity_overlap_in_both_forms(spark, a, b, want):
    assert kernels.entity_overlap(a, b) == want
    assert spark.createDataFrame([(a, b)], "a string, b string").select(similarity.entity_overlap(F.col("a"), F.col("b"))).first()[0] == want


def compared(spark, config, a, b, preprocess=True):
    return Matcher(config, TODAY).compare(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b", preprocess).first()


def test_pairs_end_to_end(spark):
    smart = MatchConfig.smart()
    r = compared(spark, smart, "<productmodel:GN500>", "<productmodel:GN500> outros termos no texto", False)
    assert r.score == 0.95 and set(r.details) == {"entity"} and r.details["entity"].short_circuit
    assert compared(spark, MatchConfig.basic(), "", "").score == 0.0
    assert compared(spark, MatchConfig.basic(), None, "x").score == 0.0
    assert compared(spark, MatchConfig.basic(), "geladeira frost free", "geladeira frost free").score >= 0.9
    assert 0.5 < compared(spark, MatchConfig.basic(), "iphone 13 pro", "iphone pro 13").score <= 1.0
    assert compared(spark, MatchConfig.basic(), "geladeira", "foguete espacial").score < 0.3
    assert compared(spark, MatchConfig.smart(entities=("product_model",)), "GN500", "Lista [GN 400, GN 500, GN 600, XT 20]").score > 0.65


def test_settings_are_checked():
    for bad in ({"mode": "x"}, {"fusion": "x"}, {"index": "x"}, {"weights": {"x": 1.0}}, {"index": "dense"}, {"use_embeddings": True}):
        with pytest.raises(ValueError):
            MatchConfig(**bad)
    assert sum(MatchConfig.smart().active.values()) == pytest.approx(1.0)
    assert MatchConfig(weights={}).active == pytest.approx({"cosine": 0.35, "edit": 0.35, "phonetic": 0.15, "entity": 0.15})


# --- retrieval and reranking against plain Python ---


@pytest.mark.parametrize("kind", ["tfidf", "bm25", "dense"])
@pytest.mark.parametrize("fusion", ["linear", "rrf"])
@pytest.mark.parametrize("least", [0.0, 0.2])
def test_many_to_many_against_plain_python(spark, kind, fusion, least):
    own, asked = corpus(4, 60), [*corpus(9, 7), "nothing of this", ""]
    config = MatchConfig(index=kind, fusion=fusion, encoder=hashing_encoder)
    got = Matcher(config).compare_many_to_many(frame(spark, asked, "query_id", "query"), frame(spark, own), 6, least).collect()
    prepared = [brute.prepare(t) for t in own]
    for i, q in enumerate(map(brute.prepare, asked)):
        scores = {"tfidf": brute.tfidf, "bm25": brute.bm25, "dense": lambda c, x: brute.dense(c, x, hashing_encoder)}[kind](prepared, q)
        if kind == "bm25" and max(scores) > 0:
            scores = [s / max(scores) for s in scores]
        found = brute.best(scores, 6, least)
        want = brute.rerank(q, prepared, found, {"cosine": 0.5, "edit": 0.5}, fusion)
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert sorted(round(r.score, 6) for r in mine) == sorted(round(s, 6) for _, s in want), (q, mine, want)
        assert [r.score for r in mine] == sorted((r.score for r in mine), reverse=True)
        if fusion == "linear":
            assert {r.pos for r in mine} == {p for p, _ in found}


def test_results_do_not_depend_on_partitions(spark):
    own, asked = frame(spark, corpus(4, 50)), frame(spark, corpus(8, 5), "query_id", "query")
    one = Matcher().compare_many_to_many(asked.repartition(1), own.repartition(1), 5, 0.0).collect()
    many = Matcher().compare_many_to_many(asked.repartition(3), own.repartition(7), 5, 0.0, strategy="parallel").collect()

    def plain(rows):
        return sorted((r.query_id, r["rank"], r.pos, round(r.score, 9)) for r in rows)

    assert plain(one) == plain(many)


def test_empty_sides_and_unknown_strategy(spark):
    own, none = frame(spark, corpus(4, 5)), frame(spark, [], "query_id", "query")
    assert Matcher().compare_many_to_many(none, own).count() == 0
    assert Matcher().compare_many_to_many(frame(spark, ["tv"], "query_id", "query"), frame(spark, []), 5, 0.0).count() == 0
    with pytest.raises(ValueError):
        Matcher().compare_batch("x", own, strategy="none such")


def test_batch_examples(spark):
    rows = ["capa para samsung", "samsung s22 ultra preto", "mesa", "iphone 13 azul"]
    got = Matcher(MatchConfig.smart(entities=("product_model",)), TODAY).compare_batch("samsung s22 ultra", frame(spark, rows), 3, 0.0).orderBy("rank").collect()
    assert len(got) == 3 and got[0].candidate == "samsung s22 ultra preto"
    later = asyncio.run(Matcher().compare_batch_async("samsung", frame(spark, rows), 3, 0.0))
    assert len(later) == 3
    both = asyncio.run(Matcher().compare_many_to_many_async(frame(spark, ["samsung"], "query_id", "query"), frame(spark, rows), 2, 0.0))
    assert [r["rank"] for r in both] == [1, 2]


def test_dense_scores_serve_as_semantic_ones(spark):
    rows = frame(spark, ["carro flex", "geladeira"])
    weights = {"cosine": 0.5, "semantic": 0.5}
    reused = Matcher(MatchConfig(index="dense", weights=weights, encoder=hashing_encoder)).compare_batch("carro", rows, 5, 0.0).collect()
    apart = Matcher(MatchConfig(index="dense", weights=weights, encoder=hashing_encoder, reuse_dense=False)).compare_batch("carro", rows, 5, 0.0).collect()
    assert {r.pos: round(r.score, 5) for r in reused} == {r.pos: round(r.score, 5) for r in apart}
    assert all(r.details["semantic"].score == r.details["cosine"].score for r in reused)
    made = lazy(lambda: hashing_encoder, "stand-in")
    assert made(["x"]) == hashing_encoder(["x"])
    unload("stand-in")
    unload()


def test_workers_load_anew_after_unloading(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write("x")
        return hashing_encoder

    rows, made = frame(spark, ["a"]).coalesce(1), lazy(load, "counted")
    for _ in range(2):
        rows.select(encode(F.col("candidate"), made)).collect()
    before = len(open(log).read())
    unload("counted")
    rows.select(encode(F.col("candidate"), made)).collect()
    assert len(open(log).read()) == before + 1


def test_tables(spark):
    rows = [(1, "televisão samsung 55 polegadas", 2500.0), (2, "geladeira electrolux frost free", 3200.0), (3, "televisão samsung 55 polegadas", 1.0)]
    df = spark.createDataFrame(rows, "id int, produto string, preco double")
    got = Matcher().compare_dataframe(df, "produto", "televisão samsung", order="id").collect()
    assert [(r.id, r.preco) for r in got] == [(1, 2500.0)] and 0 < got[0].score <= 1
    a = spark.createDataFrame([("televisão samsung",), ("notebook dell",)], "texto string")
    b = spark.createDataFrame([("tv samsung 55 polegadas",), ("geladeira electrolux",), ("laptop dell inspiron i5",), ("tv samsung 55 polegadas",)], "descricao string")
    pairs = Matcher().record_linkage(a, b, "texto", "descricao", top_n=2).collect()
    assert {(r.index_a, r.index_b) for r in pairs} == {(0, 0), (1, 2)} and len(pairs) == 3


def test_tables_with_any_column_names(spark):
    rows = [(1, "tv samsung 55", 9.5, 7, "p"), (2, "geladeira frost", 8.5, 7, "q"), (3, "tv samsung", 7.5, 7, "r"), (4, None, 0.0, 7, "s")]
    df = spark.createDataFrame(rows, "_n int, candidate string, score double, pos_ int, `a.b` string")
    got = Matcher().compare_dataframe(df, "candidate", "tv samsung", order="_n")
    assert got.columns == ["_n", "candidate", "pos_", "a.b", "score"]
    found = [tuple(r) for r in got.collect()]
    assert [r[:4] for r in found] == [(3, "tv samsung", 7, "r"), (1, "tv samsung 55", 7, "p")] and found[0][4] > found[1][4]
    dotted = spark.createDataFrame([("tv samsung", 2), ("tv 55", 1)], "`t.x` string, query_id int")
    pairs = Matcher().record_linkage(dotted, df, "t.x", "candidate", order_a="query_id", order_b="_n").collect()
    assert [r.score for r in pairs] == sorted((r.score for r in pairs), reverse=True) and pairs[0].text_a == pairs[0].text_b == "tv samsung"


class Columns:
    """A frame of no library: columns by name."""

    columns = ("id", "produto")

    def __getitem__(self, name):
        return {"id": range(3), "produto": ("televisão samsung", "geladeira", "notebook dell")}[name]


def test_tables_of_other_kinds(spark):
    pandas, arrow = pytest.importorskip("pandas"), pytest.importorskip("pyarrow")
    data = {"id": [0, 1, 2], "produto": ["televisão samsung", "geladeira", "notebook dell"]}
    rows = [dict(zip(data, v)) for v in zip(*data.values())]
    for table in (pandas.DataFrame(data), arrow.table(data), data, rows, Columns()):
        got = Matcher().compare_dataframe(table, "produto", "samsung televisão").collect()
        assert [(r.id, r.produto) for r in got] == [(0, "televisão samsung")]
        assert Matcher().record_linkage(table, pandas.DataFrame({"x": ["notebook dell i5"]}), "produto", "x").first().text_a == "notebook dell"
    assert Matcher().compare_batch("dell", data["produto"]).first().candidate == "notebook dell"
    assert Matcher().compare_many_to_many(["dell", "samsung"], data["produto"], 1).count() == 2
    with pytest.raises(TypeError):
        spark_frame(3)


def test_own_algorithm_replaces_the_hybrid(spark):
    def first_letters(a, b):
        return float(a[:1] == b[:1])

    config = MatchConfig(algorithm=first_letters)
    r = Matcher(config).compare(spark.createDataFrame([("tv", "tela")], "a string, b string"), "a", "b").first()
    assert r.score == 1.0 and r.details["first_letters"].weight == 1.0
    got = Matcher(config).compare_batch("tv samsung", frame(spark, ["samsung tv", "tv samsung", "mesa"]), 5, 0.0).orderBy("rank").collect()
    assert [(x.candidate, x.score) for x in got] == [("tv samsung", 1.0), ("samsung tv", 0.0), ("mesa", 0.0)]
    assert Matcher(MatchConfig(algorithm=first_letters, fusion="rrf")).compare_batch("tv", frame(spark, ["tv"])).count() == 0


def test_strict_matchers_refuse_nulls(spark):
    rows = frame(spark, ["a", None])
    assert Matcher().compare_batch("a", rows, 5, 0.0).count() <= 2
    with pytest.raises(StageProcessingError):
        Matcher(MatchConfig(strict=True)).compare_batch("a", rows)
    with pytest.raises(StageProcessingError):
        Matcher(MatchConfig(strict=True)).compare(spark.createDataFrame([(None, "x")], "a string, b string"), "a", "b")


def test_vector_hits(spark):
    rows = [("doc1", "Samsung Galaxy S22 Ultra", 0.9), ("doc2", "Apple iPhone 15", 0.8), ("doc3", "Mouse MX", 0.7), ("doc4", "Peças GN500 originais", 0.45)]
    hits = spark.createDataFrame(rows, "id string, text string, score double")
    got = Matcher(MatchConfig.smart(), TODAY).rerank_vector_results("GN500", hits, True, True).orderBy("rank").collect()
    assert len(got) == 4 and got[0].id == "doc4" and got[0].score >= 0.9 and got[0].vector_score == 0.45
    assert Matcher().rerank_vector_results("x", hits.drop("id")).filter("id IS NULL").count() == 4
    for missing in ("text", "score"):
        with pytest.raises(ValueError):
            Matcher().rerank_vector_results("x", hits.drop(missing))


# --- fusion ---


def ranked(spark, lists):
    rows = [(a, i, p, c, s) for i, (a, xs) in enumerate(lists) for p, (c, s) in enumerate(xs, 1)]
    return spark.createDataFrame(rows, "algo string, algo_idx int, position int, candidate string, score double")


def test_fusion_formula_and_absent_candidates(spark):
    got = {r.candidate: r for r in fuse_lists(ranked(spark, [("cosine", [("X", 0.9), ("Y", 0.5)]), ("edit", [("Y", 0.8), ("X", 0.3)])])).collect()}
    assert got["X"].score == pytest.approx((1 / 61 + 1 / 62) / (2 / 61)) == got["Y"].score
    got = {r.candidate: r for r in fuse_lists(ranked(spark, [("cosine", [("A", 0.9), ("B", 0.5)]), ("edit", [("A", 0.8), ("C", 0.7)])])).collect()}
    assert got["B"].details["edit"]["rank"] == 3 and got["B"].details["edit"]["raw_score"] == 0.0
    assert set(got["C"].details) == {"edit"}  # lists before its first one don't count
    got = {r.candidate: r for r in fuse_lists(ranked(spark, [("cosine", [("A", 1.0)]), ("edit", [("A", 1.0)])]), weights={"cosine": 0.5}).collect()}
    assert got["A"].details["edit"]["weight"] == 1.0 and got["A"].score == pytest.approx(1.0)


# --- calibration ---


def test_calibration(spark):
    gold = spark.createDataFrame([("casa", "caza", True), ("celular", "cel", False), ("teste", "teste", True)], "query string, target string, match boolean")
    found = Calibrator([{"cosine": 1.0}, {"edit": 1.0}]).evaluate(gold)
    assert found.best_weights == {"edit": 1.0}
    by = {r.config_id: r for r in found.metrics.collect()}
    assert by[1].f1_score == 1.0 and by[0].f1_score < 1 and found.errors.count() == 0
    profile = Calibrator([{"cosine": 1.0}, {"edit": 1.0}]).time_profile(gold).collect()
    assert [r.config_id for r in profile] == [0, 1] and profile[1].f1_score == 1.0 and all(r.total_time_ms > 0 for r in profile)
    missed = Calibrator([{"cosine": 1.0}, {"edit": 1.0}]).errors(gold, 0).collect()
    assert [(r.query, r.offender, r.lowest) for r in missed] == [("casa", "cosine", 0.0)]
    blank = spark.createDataFrame([("teste limpo", "teste limpo", True), ("", "algum lixo", False), ("  ", "", False)], gold.schema)
    assert Calibrator([{"cosine": 1.0}]).evaluate(blank).metrics.first().f1_score > 0.99
    with pytest.raises(ValueError):
        Calibrator([{"cosine": 1.0}]).evaluate(gold.limit(0))


# --- catalogue, caches, streams ---


def test_catalogue_follows_texts_and_settings(spark, tmp_path):
    rows, path = frame(spark, ["Peças do Zé", "x"]), f"file://{tmp_path}/c"
    first = catalog.preprocess_catalog(rows, path)
    assert {r.p_candidate for r in first.collect()} == {"pecas ze", "x"}
    mark = catalog.fingerprint(rows, MatchConfig())
    assert catalog.load_catalog(spark, path, mark) is not None
    assert catalog.load_catalog(spark, path, catalog.fingerprint(rows, MatchConfig.smart())) is None
    assert catalog.load_catalog(spark, path, catalog.fingerprint(frame(spark, ["other"]), MatchConfig())) is None
    assert catalog.load_catalog(spark, f"file://{tmp_path}/none", mark) is None
    smart = MatchConfig.smart()
    assert catalog.fingerprint(rows, smart, TODAY) != catalog.fingerprint(rows, smart, date(2024, 4, 26))
    one, two = MatchConfig(lemmatizer=lambda ts: ts), MatchConfig(lemmatizer=lambda ts: [t[:3] for t in ts])
    assert catalog.fingerprint(rows, one) != catalog.fingerprint(rows, two)


def test_kept_tables_are_forgotten(spark):
    m = Matcher()
    df = m.keep(frame(spark, ["a"]))
    assert df.is_cached
    m.clear_cache()
    assert not df.is_cached


def test_stream_equals_batch(spark, tmp_path):
    own, asked = frame(spark, corpus(4, 40)), frame(spark, corpus(6, 9), "query_id", "query")
    asked.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    writer = match_stream(stream, own, Matcher(), f"file://{tmp_path}/out", 4, 0.1)
    writer.trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/offsets").start().awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").select("query_id", "pos", F.round("score", 6)).collect()
    want = Matcher().compare_many_to_many(asked, own, 4, 0.1).select("query_id", "pos", F.round("score", 6)).collect()
    assert sorted(got) == sorted(want)
    assert prepare_stream(stream, Matcher()).isStreaming


def test_indexes_of_nothing(spark):
    none = spark.createDataFrame([], "pos long, p_candidate string")
    asked = spark.createDataFrame([(0, "x y")], "query_id long, p_query string")
    assert index.score_tfidf(index.fit_tfidf(none), asked).count() == 0
    assert index.score_bm25(index.fit_bm25(none), asked).count() == 0
    assert index.score_dense(index.fit_dense(none, hashing_encoder), asked, hashing_encoder).count() == 0
