import random

import pyarrow as pa
from pyspark.sql import functions as F

from verbamatch.config import MatchConfig
from verbamatch.functions import bulk
from verbamatch.operators.pipeline import pipeline_for, prepared

PARTS = ["a", "b", " ", "  ", "\t", "\r\n", "\n", "\r", "\\n", "\\r\\n", "\\rn", "\\", " da ", " nums ", " numas ", "nums", "à", " às ", "é", "Ç", "ß", "İ", "K", "Ａ", "𝐀", "Ⅷ", "½", "ﬁ", "…", "\xa0", "\x85", "　"]
PARTS += ["<", "<x:1>", ">", "<a de b>", "$", "-", "_", ":", ".", ",", "'", "\x0b", "\x1c", "\x00", "σς", "de", "o", "uns", "中", "🙂", "№", "A", "Z9", "é", "\x7f"]


def test_f3_f4_f6_f7_bulk_preparation_is_that_of_the_stages(spark):
    pick = random.Random(5)
    rows = [(i, "".join(pick.choices(PARTS, k=pick.randint(0, 14)))) for i in range(4000)] + [(-1, None), (-2, "")]
    rows += [(10_000 + c, f"a{chr(c)}b {chr(c)}") for c in range(0x3000)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(4)
    both = pipeline_for(MatchConfig()).process(df.withColumn("p", F.col("t")), "p").withColumn("q", bulk.prepare(F.col("t")))
    assert both.filter(~F.col("p").eqNullSafe(F.col("q"))).limit(5).collect() == []


def test_f3_f4_f6_f7_basic_preparation_needs_no_interpreted_expressions(spark):
    plan = prepared(spark.createDataFrame([("A",)], "t string"), "t", "p", MatchConfig())._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "lambda" not in plan


def test_f3_f4_f6_f7_texts_are_prepared_in_bounded_pieces():
    rows = ["x" * (bulk.BYTES // 3)] * 7 + [None] + ["de Y"] * (2 * bulk.ROWS) + ["z " * bulk.BYTES]
    made = list(bulk.slices(pa.array(rows)))
    assert [t for p in made for t in p.to_pylist()] == rows
    assert all(len(p) == 1 or len(p) <= bulk.ROWS and p.nbytes < 2 * bulk.BYTES for p in made)
    got = bulk.prepare_all(pa.array(rows)).to_pylist()
    assert got[7] is None and got[8] == "y" and len(got) == len(rows)
