"""Collated keys against folded ones: what joins under folding joins under the collation; the known differences."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import udf as U

WORDS = ["École", "ecole", "ÉCOLE", "straße", "STRASSE", "Ώρα", "ωρα", "Ёлка", "елка", "naïve", "Naive", "a-b", "ab", "a b", "12", "", "漢字", "かな", "Å", "A\u030a", "ÿ", "y"]


def test_what_folding_joins_the_collation_joins(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    groups = lambda key: sorted(sorted(r["ws"]) for r in df.groupBy(key.alias("k")).agg(F.collect_list("w").alias("ws")).collect())
    assert groups(X.any_script_key(F.col("w"))) == groups(U.fold_any(F.col("w")))
    joined = df.alias("a").join(df.alias("b"), X.any_script_key(F.col("a.w")) == X.any_script_key(F.col("b.w"))).count()
    assert joined == sum(len(g) ** 2 for g in groups(U.fold_any(F.col("w"))))


@pytest.mark.parametrize("a, b", [("ﬁn", "fin"), ("Ｆull", "full"), ("ΟΔΟΣ", "οδος")])
def test_further_pairs_that_the_collation_joins(spark, a, b):
    one = spark.createDataFrame([(a, b)], "a string, b string")
    assert one.where(X.any_script_key(F.col("a")) == X.any_script_key(F.col("b"))).count() == 1
