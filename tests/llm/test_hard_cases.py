"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verbamatch.llm import decontaminate, line_dedup, near_dedup, packing, phrase_automata, pii, quality, suffix_dedup, suffix_tree_lm, token_store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, `key` int, h double, doc string, text_ string, stratum string, stratum_ string, rank_ int, gone_ int, doc_ int, node_ int, `a.b` string, `mark_` int"
LONG = "palavra comprida é aqui " * 20_000


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", len(text) if text is not None else None, "n", 1, 0.5, "d", "t", "u", "v", 1, 2, 3, 4, "dotted", 5)


@pytest.fixture(scope="module")
def messy(spark):
    rows = [
        row(1, "One line of ordinary text that stands here.\nAnd another line of it, quite unlike the first."),
        row(1, "One line of ordinary text that stands here.\nAnd another line of it, quite unlike the first."),
        row(2, None),
        row(3, ""),
        row(4, " \n\t\n "),
        row(None, "A text without any id, of some ten words or so."),
        row(None, None, None),
        row(5, LONG),
        row(6, "solo", None),
        row(7, "💥 §§ ¿? 漢字かな交じり文 \x00   end"),
        row(8, "x" * 200_000),
        (None,) * 18,
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (5, None, 0), (6, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(0, "ten words or so"), (1, None), (None, "ordinary text that stands"), (2, ""), (3, "...")], "item_id long, text string")


def count(df):
    return len(df.collect())


def test_every_operator_takes_them(spark, messy, labels, bench, tmp_path):
    n = messy.count()
    assert count(suffix_tree_lm.score_corpus(messy)) == n
    assert {(r.doc_id, r.item_id, r.hits) for r in decontaminate.find_leaks(messy, bench).collect()} == {(1, None, 1), (None, 0, 1)}
    assert count(decontaminate.drop_leaks(messy, bench)) == n - 3
    recurring = phrase_automata.find_recurring(messy)
    assert count(recurring) == 0  # only one document repeats itself
    copies = suffix_dedup.find_copies(messy).collect()
    assert [(r.doc_id, r.start_word, r.end_word) for r in copies] == [(5, 4, 80_000)]
    token_store.write_store(messy, str(tmp_path / "s"))
    assert all(r.verified for r in token_store.manifests(spark, str(tmp_path / "s")).collect())
    assert count(line_dedup.find_lines(messy)) == 0
    assert count(line_dedup.drop_lines(messy)) == n
    assert count(quality.keep_good(messy, labels)) == n
    assert count(quality.scores(messy, quality.fit_lexicon(messy, labels))) == n
    assert count(pii.find_pii(messy)) == 0
    assert count(near_dedup.find_groups(messy)) == 0
    assert count(suffix_dedup.drop_copies(messy)) == n
    kept = near_dedup.keep_first(messy)
    assert kept.columns == messy.columns
    assert count(kept) == n - 2  # the repeated row of 1, and one of the two rows without id and text
    pieces = packing.pack(messy).collect()
    assert len({(r.seq_id, r.seq_start) for r in pieces if r.n_tokens}) == sum(r.n_tokens > 0 for r in pieces)


def test_empty_tables(spark, messy, labels, bench, tmp_path):
    none = messy.limit(0)
    outs = [
        suffix_tree_lm.score_corpus(none),
        suffix_tree_lm.score_corpus(none, corpus=messy),
        decontaminate.find_leaks(none, bench),
        decontaminate.drop_leaks(none, bench),
        phrase_automata.find_recurring(none),
        suffix_dedup.find_copies(none),
        line_dedup.find_lines(none),
        line_dedup.drop_lines(none),
        quality.keep_good(none, labels),
        pii.find_pii(none),
        near_dedup.find_groups(none),
        near_dedup.keep_first(none),
        packing.pack(none),
    ]
    assert [count(x) for x in outs] == [0] * len(outs)
    assert count(decontaminate.find_leaks(messy, bench.limit(0))) == 0
    assert count(decontaminate.drop_leaks(messy, bench.limit(0))) == messy.count()
    token_store.write_store(none, str(tmp_path / "s"))
    assert count(token_store.manifests(spark, str(tmp_path / "s"))) == 0


def test_repeated_lines_with_clashing_columns(messy):
    twice = messy.withColumn("doc_id", F.col("doc_id") + 100).union(messy)
    left = {r.doc_id: r for r in line_dedup.drop_lines(twice).filter("doc_id is not null").collect()}
    assert 101 not in left and 105 not in left and left[1].text.startswith("One line")
    assert left[104].text == " \n\t\n " and left[102].text is None
    assert left[1].node_ == 4 and left[1].doc == "d"


@pytest.mark.parametrize("at", range(5))
def test_every_stage_takes_them(spark, messy, labels, bench, tmp_path, at):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    stage, n = corpus_pipeline.STAGES[at][1], messy.count()
    out = stage(spark, messy, str(tmp_path))
    if at < 4:
        assert out.schema.simpleString() == messy.schema.simpleString()
        rows = out.collect()
        # Near dedup merges equal rows; the benchmark has parts of three rows.
        assert len(rows) == [n, n, n - 2, n - 3][at]
        assert all(r["a.b"] == "dotted" and r["node_"] == 4 for r in rows if r["lang"] or r["doc_id"] is not None)
        assert {r.text for r in rows} == {r.text for r in messy.collect() if at < 3 or r.text is None or "ordinary" not in r.text and "ten words" not in r.text}
    else:
        pieces = out.collect()
        assert sum(r.n_tokens for r in pieces) == sum(len(r.ids) // 2 for r in pieces) > 100_000
        assert sorted(r.doc_id for r in pieces if r.doc_start == 0 and r.doc_id is not None) == [1, 1, 2, 3, 4, 5, 6, 7, 8]
    none = stage(spark, messy.limit(0), str(tmp_path))
    assert count(none) == 0
    assert count(stage(spark, messy.filter("text is null"), str(tmp_path))) == (2 if at == 2 else 3)
