import pyarrow as pa
from pyspark.sql import functions as F

from verbamatch.llm._spark import materialise
from verbamatch.sources.shared import BATCH_BYTES, BATCH_SETTING


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])


def test_pipeline_texts_reach_python_in_batches_of_bounded_size(spark):
    rows = spark.range(3000).coalesce(1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    spark.conf.unset(BATCH_SETTING)
    try:
        seen = [r.n for r in materialise(rows.mapInArrow(sizes, "n long"), "sizes").collect()]
        assert sum(seen) > 30_000_000 and max(seen) < 2 * BATCH_BYTES
        spark.conf.set(BATCH_SETTING, str(8 * BATCH_BYTES))
        materialise(rows.limit(1), "kept")
        assert spark.conf.get(BATCH_SETTING) == str(8 * BATCH_BYTES)
    finally:
        spark.conf.unset(BATCH_SETTING)
