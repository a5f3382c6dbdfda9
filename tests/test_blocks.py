import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from verbamatch.functions.encoders import encode
from verbamatch.functions.entities import extract, tag
from verbamatch.functions.pieces import BYTES, ROWS, pieces
from verbamatch.operators import blocks, index

CANDIDATES = "pos long, p_candidate string"
QUERIES = "query_id long, p_query string"


def terms_of(text):
    out = Counter()
    for line in text.split("\n"):
        words = re.findall(r"\w\w+", line)
        out.update(words + [f"{x} {y}" for x, y in zip(words, words[1:])])
    return out


def texts(n, seed=1):
    pick = random.Random(seed)
    words = ["de", "casa", "azul", "x", "gn-500", "água", "são", "<n:1>", "a.b", "_", "zz"]
    return ["", "a", "um\ndois tres\nx", *(" ".join(pick.choices(words, k=pick.randint(0, 9))) for _ in range(n))]


@pytest.mark.parametrize("buckets", [1, 5])
def test_f1_terms_of_a_block(buckets):
    rows = texts(60)
    block = blocks.block_of(pa.array(rows), blocks.KINDS["tfidf"], buckets)
    names = block.terms().to_pylist()
    got = Counter()
    for r, t, n in zip(block.row.tolist(), block.term.tolist(), block.tf.tolist()):
        got[r, names[t]] = n
    assert got == Counter({(i, t): n for i, x in enumerate(rows) for t, n in terms_of(x).items()})
    assert dict(zip(names, block.n.tolist())) == Counter(t for x in rows for t in terms_of(x))


def test_f6_a_term_has_the_same_bucket_in_every_block():
    seen = {}
    for seed in range(3):
        block = blocks.block_of(pa.array(texts(30, seed)), blocks.KINDS["tfidf"], 7)
        for k in range(7):
            for t in block.terms()[block.bounds[k] : block.bounds[k + 1]].to_pylist():
                assert seen.setdefault(t, k) == k


def test_f2_what_queries_ask_for_is_found():
    rows, wanted = texts(60), ["casa", "casa azul", "água de", "missing", "de de"]
    row, term, tf, _, _ = blocks.found_in(pa.array(rows), blocks.KINDS["tfidf"], blocks.asked_for(wanted, blocks.KINDS["tfidf"]))
    got = {(r, wanted[t]): n for r, t, n in zip(row.tolist(), term.tolist(), tf.tolist())}
    assert got == {(i, t): terms_of(x)[t] for i, x in enumerate(rows) for t in wanted if terms_of(x)[t]}


def test_f3_products_in_many_steps(monkeypatch):
    monkeypatch.setattr(blocks, "STEP", 3)
    pick = np.random.default_rng(0)
    own, term = np.divmod(np.unique(pick.integers(0, 200, 90)), 10)
    start = np.arange(0, 31, 3)
    query, weight, value = pick.integers(0, 4, 30), pick.random(30), pick.random(len(own))
    want = np.zeros((20, 4))
    for r, t, v in zip(own, term, value):
        for k in range(start[t], start[t + 1]):
            want[r, query[k]] += v * weight[k]
    got = np.zeros((20, 4))
    for r, q, s in blocks.products(own, term, value, start, query, weight, 4):
        got[r, q] += s
    assert np.allclose(got, want)


def test_f9_best_keeps_near_ties_and_no_more_equal_ones_than_needed():
    pos, score = np.arange(100), np.full(100, 0.5)
    score[60:] = 0.5 - 1e-12
    kept = blocks.best_of(np.zeros(100, np.int64), pos, score, 3, index.SLACK)
    assert sorted(pos[kept].tolist()) == [0, 1, 2, 60, 61, 62]


@pytest.mark.parametrize("kind", ["tfidf", "bm25"])
def test_f1_f7_only_the_best_leave_the_tasks(spark, kind):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts(400))], CANDIDATES).coalesce(1)
    asked = spark.createDataFrame([(1, "casa azul"), (2, "água de casa casa")], QUERIES)
    fit, score = (index.fit_tfidf, index.score_tfidf) if kind == "tfidf" else (index.fit_bm25, index.score_bm25)
    fitted = fit(rows)
    every, some = score(fitted, asked), score(fitted, asked, best=3)
    assert some.count() < every.count() / 4

    def best(scores):
        return [(r.query_id, r.pos, round(r.score, 9), r["rank"]) for r in index.top(scores, 3, 0.1).orderBy("query_id", "rank").collect()]

    assert best(some) == best(every)


def test_f4_f8_rows_of_one_position_are_one_candidate(spark):
    rows = spark.createDataFrame([(1, "aa bb"), (1, "cc aa"), (2, "aa"), (None, "bb dd")], CANDIDATES).repartition(4)
    weights = index.tfidf_weights(rows).collect()
    assert {(r.pos, r.term) for r in weights} == {(1, "aa"), (1, "bb"), (1, "cc"), (1, "aa bb"), (1, "cc aa"), (2, "aa"), (None, "bb"), (None, "dd"), (None, "bb dd")}
    assert {r.term: r.df for r in index.document_frequency(rows).collect()}["aa"] == 2
    found = index.score_bm25(index.fit_bm25(rows), spark.createDataFrame([(7, "aa bb")], QUERIES), False).collect()
    assert sorted((str(r.pos) for r in found)) == ["1", "2", "None"]


def test_f5_a_task_gets_few_blocks_whatever_the_partitions(spark, monkeypatch):
    rows = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts(400))], CANDIDATES)
    want = sorted((r.pos, r.text, round(r.norm, 9)) for r in index.fit_tfidf(rows).postings.collect())
    monkeypatch.setattr(index.blocks, "BLOCK_BYTES", 200)
    monkeypatch.setattr(index, "TASKS", 10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        dealt, _, buckets, tasks = index._in_blocks(rows)
        count = dealt.agg({"block": "max"}).first()[0] + 1
        emitted = index._emitted(dealt, buckets)
        assert count > 30 and tasks == 10 and dealt.rdd.getNumPartitions() == emitted.rdd.getNumPartitions() == 10
        assert dealt.selectExpr("spark_partition_id()").distinct().count() > 5
        normed, _ = index._weighed(rows, lambda t, block, raw, norm: index._pieces([t["pos"].combine_chunks(), index.blocks.plain(t["text"]), pa.array(norm)], ["pos", "text", "norm"]), "pos long, text string, norm double")
        assert normed.rdd.getNumPartitions() == 10
        assert sorted((r.pos, r.text, round(r.norm, 9)) for r in normed.collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [index._tasks(n) for n in (1, 10, 80, 800)] == [1, 10, 10, 100]


def test_f10_queries_in_several_passes(spark, monkeypatch):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts(50))], CANDIDATES)
    asked = spark.createDataFrame([(i, "casa azul de zz") for i in range(6)], QUERIES)
    fitted = index.fit_bm25(rows)
    want = sorted(map(tuple, index.score_bm25(fitted, asked, False).collect()))
    monkeypatch.setattr(index, "MOST", 5)
    assert sorted(map(tuple, index.score_bm25(fitted, asked, False).collect())) == want


def test_f11_f12_f13_texts_go_through_python_in_pieces(spark):
    rows = ["x" * (BYTES // 3)] * 10 + [None] + ["y"] * (3 * ROWS) + ["z" * (2 * BYTES)]
    made = list(pieces(pa.array(rows)))
    assert [t for p in made for t in p] == rows
    assert all(len(p) <= ROWS and (len(p) == 1 or sum(len(t or "") for t in p) <= BYTES) for p in made)

    def encoder(batch):
        assert len(batch) <= ROWS
        return [[float(len(t)), 1.0] for t in batch]

    df = spark.range(3 * ROWS).coalesce(1).selectExpr("id", "concat('GN 500, ', id, ' reais') AS t")
    got = df.select("id", tag("t", ["money"]).alias("g"), extract("t", ["money"]).alias("e"), encode(df.t, encoder).alias("v")).orderBy("id").collect()
    assert [r.g for r in got] == [f"GN500, <money:{float(i)}>" for i in range(3 * ROWS)]
    assert got[5].e[0].text_matched == "5 reais" and len(got[5].v) == 2
