"""Popularity percentiles, and what they are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def readers(interactions: DataFrame) -> DataFrame:
    """(item_id, n_readers): distinct users per item."""
    return interactions.select("item_id", "user_id").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("n_readers"))


#: Ranges of values per doubling.
RANGES = 64


def percentile(items: DataFrame, column: str, name: str) -> DataFrame:
    """Add the mean rank of `column` among its positive values, as a share of their number; null for the others, NaN included.

    Ranks come from the histogram of distinct values. Those are ordered within ranges of like size, and only the
    ranges' counts, at most RANGES for each doubling from the smallest to the largest value, in one task.
    """
    hist = items.where((F.col(column) > 0) & ~F.isnan(column)).groupBy(F.col(column).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    hist = hist.withColumn("_range", F.floor(F.log2("_x") * RANGES))
    sums = hist.groupBy("_range").agg(F.sum("_n").alias("_all"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_range", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_start"), F.sum("_all").over(W.partitionBy()).alias("_total"))
    within = W.partitionBy("_range").orderBy("_x").rowsBetween(W.unboundedPreceding, -1)
    placed = hist.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(starts, "_range")
    ranks = placed.select("_x", ((F.col("_start") + F.col("_before") + (F.col("_n") + 1) / 2) / F.col("_total")).alias(name))
    return items.join(ranks, items[column] == ranks["_x"], "left").drop("_x")


def popularity(items: DataFrame, sources: tuple[str, ...], how: str = "max") -> DataFrame:
    """Add `popularity`: the largest or the mean percentile over the sources, 0 if none is positive."""
    if how not in ("max", "mean"):
        raise ValueError(f"how must be max or mean, not {how!r}")
    missing = [c for c in sources if c not in items.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    names = [f"_p{k}" for k in range(len(sources))]
    for source, name in zip(sources, names, strict=True):
        items = percentile(items, source, name)
    present = F.filter(F.array(*names), lambda x: x.isNotNull())
    mean = F.aggregate(present, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(present), F.lit(0))
    return items.withColumn("popularity", F.coalesce(F.array_max(present) if how == "max" else mean, F.lit(0.0))).drop(*names)


def without_hidden(items: DataFrame, hidden: DataFrame, column: str = "n_readers") -> DataFrame:
    """items with the hidden (user_id, item_id) pairs taken off their counts, never under 0."""
    n = hidden.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    left = F.greatest(F.col(column) - F.coalesce("_n", F.lit(0)), F.lit(0))
    return items.join(n, "item_id", "left").withColumn(column, left).drop("_n")
