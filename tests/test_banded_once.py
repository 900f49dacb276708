"""A band's ratio is computed once a row."""

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.profiling import banded_sample


def test_a_ratio_is_computed_once_for_its_band(spark):
    docs = spark.createDataFrame([(1, "the cat of the house"), (2, "chat noir"), (3, None), (4, "12")], "doc_id long, text string")
    out = banded_sample(docs.select("doc_id", X.function_word_ratio(F.col("text")).alias("r")), F.col("r"), [0, 0.05, 0.2, 0.5, 1.01], 5, F.col("doc_id")).select("band", "doc_id")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted(map(tuple, out.collect())) == [(0, 2), (0, 4), (3, 1)]
