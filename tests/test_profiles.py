"""Exact quantiles by selection and hexagonal bins, against NumPy and a search for the nearest centre."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import profiling as P


@pytest.mark.parametrize("name", ["whole", "ties", "spread", "one", "two", "infinite"])
def test_quantiles_equal_numpy(spark, name):
    rng = random.Random(7)
    values = {
        "whole": [rng.randint(0, 500) for _ in range(3000)],
        "ties": [1.5] * 800 + [2.5] * 800 + [rng.random() for _ in range(50)],
        "spread": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(2000)] + [1.7e308, -1.7e308, 5e-324, 0.0],
        "one": [3.25],
        "two": [1.0, 2.0],
        "infinite": [float("inf"), float("-inf"), float("-inf"), 1.0, 2.0, 7.0],
    }[name]
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    with np.errstate(invalid="ignore"):
        got = P.quantiles(df, F.col("x"), *shares)
    ordered = sorted(float(v) for v in values)
    for share, value in zip(shares, got, strict=True):
        at = share * (len(ordered) - 1)
        a, b = ordered[math.floor(at)], ordered[math.ceil(at)]
        want = a if a == b or at == math.floor(at) else a + (b - a) * (at - math.floor(at))
        assert value == want or math.isnan(want) and math.isnan(value) or value == pytest.approx(want, rel=1e-12)


def test_quantiles_of_nothing_and_of_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (3.0,)], "x double")
    assert P.quantiles(df.where("x is null"), F.col("x"), 0.5) == [None]
    low, middle, high = P.quantiles(df, F.col("x"), 0.0, 0.5, 1.0)
    assert (low, middle) == (1.0, 3.0) and math.isnan(high)


@pytest.mark.parametrize("log", [False, True])
def test_hexagons_take_the_nearest_centre(spark, log):
    rng = random.Random(3)
    points = [(rng.uniform(0.1, 50), rng.uniform(0.1, 50)) for _ in range(1500)]
    df = spark.createDataFrame([*points, (None, 1.0), (float("nan"), 1.0), (0.0 if log else None, 2.0)], "x double, y double")
    width = 0.2 if log else 3.0
    out = P.hexagons(df, F.col("x"), F.col("y"), width, log=log).collect()
    height, want = width * math.sqrt(3) / 2, {}
    for x, y in points:
        x, y = (math.log10(x), math.log10(y)) if log else (x, y)
        centres = [(q, r) for r in range(math.floor(y / height) - 1, math.floor(y / height) + 3) for q in [*range(math.floor(x / width - r / 2) - 1, math.floor(x / width - r / 2) + 3)]]
        best = min(centres, key=lambda c: (x - (c[0] + c[1] / 2) * width) ** 2 + (y - c[1] * height) ** 2)
        want[best] = want.get(best, 0) + 1
    assert {(r["q"], r["r"]): r["n"] for r in out} == want
    assert all(r["x"] == pytest.approx((r["q"] + r["r"] / 2) * width) and r["y"] == pytest.approx(r["r"] * height) for r in out)
