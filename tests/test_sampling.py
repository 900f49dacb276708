"""The cut by hash against ordering everything."""

import random

from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.operators import ranking as R


def test_the_first_by_hash_and_few_others(spark):
    rng = random.Random(6)
    for keys in ([rng.randrange(-(1 << 63), 1 << 63) for _ in range(20_000)], [rng.randrange(1 << 20) for _ in range(5000)], [7] * 300, [], [3, None]):
        df = spark.createDataFrame([(k,) for k in keys], "k long")
        for n in (1, 50, 10_000):
            got = sorted(r["k"] for r in R.least_by_hash(df, F.col("k"), n).where("k is not null").collect())
            known = sorted(k for k in keys if k is not None)
            assert got[:n] == known[:n]
            assert len(got) <= 2 * n + 1 or len(set(got[n:])) == 1


def test_test_pairs_take_the_first_readers(spark):
    rows = [(u, i) for u in range(500) for i in range(u % 4)]
    pairs = spark.createDataFrame(rows, "user_id long, item_id long")
    got = {r["user_id"] for r in E.test_pairs(pairs, 40, 3).collect()}
    order = pairs.select("user_id").distinct().where("user_id % 4 > 1").orderBy(E.hashed(3, "user_id")).limit(40)
    assert got == {r["user_id"] for r in order.collect()}
