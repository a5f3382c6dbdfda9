"""The pipeline against a brute-force version, and the registered queries against their SQL."""

import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from verbamatch import llm
from verbamatch.llm import packing
from verbamatch.llm._spark import table

from .test_operators import distance, hashed, naive_pack, naive_quality, naive_words, prose

SF = "/root/testdata/sf0.001"


def connect():
    con = duckdb.connect()
    for t in "documents benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = connect().execute(llm.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(map(plain, r)) for r in got.select(*names).collect()) == Counter(tuple(map(plain, r)) for r in want.fetchall())


def brute(spark, sf_dir):
    """All stages in plain Python."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = {r.doc_id: r.f for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).alias("f")).collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    good, _ = naive_quality(rows, {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}, fold)
    kept = {r[0] for r in good}
    texts = {d: t for d, t, _ in rows if d in kept}

    seen, near, out = set(), [], {}
    for d in sorted(texts):
        left = []
        for x in texts[d].split("\n"):
            key = x.strip(" \t\r\x0b\x0c")
            if not key:
                left.append(x)
                continue
            gone = key in seen
            if not gone and len(key) >= 9:
                gone = any(abs(len(y) - len(key)) <= 1 and max(len(y), len(key)) >= 10 and (y[: len(key) // 2 - 1] == key[: len(key) // 2 - 1] or y[-(len(key) // 2 - 1) :] == key[-(len(key) // 2 - 1) :]) and distance(y, key) <= 1 for y in near)
            if key not in seen:
                seen.add(key)
                near.append(key) if len(key) >= 9 else None
            if not gone:
                left.append(x)
        if any(x.strip(" \t\r\x0b\x0c") for x in left) or not texts[d].strip(" \t\r\x0b\x0c\n"):
            out[d] = "\n".join(left)

    sets = {}
    for d, t in out.items():
        w = naive_words(t)
        sets[d] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    root = {d: d for d in out}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(out)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = {d: t for d, t in out.items() if find(d) == d}

    grams = set()
    for r in table(spark, sf_dir, "benchmark").collect():
        w = naive_words(r.text)
        grams |= {" " + " ".join(w[i : i + 13]) + " " for i in range(max(1, len(w) - 12))} if w else set()
    out = {d: t for d, t in out.items() if not any(g in " " + " ".join(naive_words(t)) + " " for g in grams)}
    return naive_pack(hashed(spark.createDataFrame(list(out.items()), "doc_id long, text string")), packing.CONTEXT)


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(20)
    docs, labels = [], []
    bench = [(i, prose(rng, rng.randint(8, 30))) for i in range(6)]
    lines = [prose(rng, 6) for _ in range(6)]
    for i in range(700):
        text = "\n".join([prose(rng, rng.randint(1, 25)) for _ in range(rng.randint(1, 4))])
        kind = rng.random()
        bad = toxic = 0
        if kind < 0.1:
            text = text.replace(" ", "### ") + " ###"
            bad = 1
        elif kind < 0.2:
            text += " moron scumbag moron trashy scumbag"
            toxic = 1
        elif kind < 0.3:
            text += "\n" + rng.choice(lines) + rng.choice(["", "q"])
        elif kind < 0.4 and docs:
            text = " ".join(w if rng.random() > 0.04 else "swap" for w in rng.choice(docs)[1].split(" "))
        elif kind < 0.45:
            text += " " + rng.choice(bench)[1].title() + " and more"
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1 - bad, toxic))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert 200 < len({p[0] for p in want}) < 650


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]
    assert "pipeline" in __spark_entry__.queries()
