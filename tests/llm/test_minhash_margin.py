from math import comb

import pytest

from pyspark.sql import functions as F

from tidemark.llm import minhash


@pytest.mark.parametrize("threshold", [0.85, 0.8])
def test_the_estimate_loses_fewer_pairs_than_the_bands(spark, threshold):
    n, rows = minhash.MINIMA, []
    for differ in range(n + 1):
        bits = sum(1 << (2 * k) for k in range(differ))
        words = [(bits >> (64 * k)) & ((1 << 64) - 1) for k in range(3)]
        rows.append((differ, *[w - (1 << 64) if w >> 63 else w for w in words]))
    df = spark.createDataFrame(rows, "differ int, a_sig_0 long, a_sig_1 long, a_sig_2 long")
    df = df.select("*", *[F.lit(0).cast("long").alias(f"b_sig_{k}") for k in range(3)], F.lit(100).alias("a_n"), F.lit(100).alias("b_n"))
    kept = {r["differ"] for r in df.where(minhash._likely(threshold, "a", "b")).collect()}
    equal = threshold + (1 - threshold) / 4
    lost = sum(comb(n, d) * (1 - equal) ** d * equal ** (n - d) for d in range(n + 1) if d not in kept)
    bands = (1 - threshold ** (n // minhash.BANDS)) ** minhash.BANDS
    assert 0 < len(kept) < n + 1 and lost < bands
