"""Profiles of tables: shared texts, rollups, bands and counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from .ranking import written


def shared_text_groups(items: DataFrame) -> DataFrame:
    """Per distinct normalised text of items (title, author, text): n_items, n_authors, n_titles and the first item_id.

    The key is a digest, so long texts are not shuffled; distinct counts are made by Spark's two-step aggregates.
    """
    digest = F.md5(X.normalized_text(F.col("text")))
    return items.withColumn("digest", digest).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_distinct("author").alias("n_authors"), F.count_distinct("title").alias("n_titles"), F.min("item_id").alias("first_id")
    )


def classified(groups: DataFrame) -> DataFrame:
    """Add kind: unique, duplicate, or boilerplate if several authors or over three titles share the text."""
    spread = (F.col("n_authors") >= 2) | (F.col("n_titles") > 3)
    return groups.withColumn("kind", F.when(F.col("n_items") == 1, "unique").when(spread, "boilerplate").otherwise("duplicate"))


def shared_mask(items: DataFrame, least_titles: int = 2) -> DataFrame:
    """(item_id, shared): whether at least so many distinct titles have the item's text."""
    d = items.withColumn("digest", F.md5(X.normalized_text(F.col("text"))))
    wide = d.groupBy("digest").agg(F.count_distinct("title").alias("n")).where(F.col("n") >= least_titles)
    return d.join(wide, "digest", "left").select("item_id", F.col("n").isNotNull().alias("shared"))


def value_counts(df: DataFrame, *columns: str | Column) -> DataFrame:
    """(columns, n): the rows of each combination of values; two columns give the cells of a contingency table."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def top_and_other(df: DataFrame, column: str, n: int) -> DataFrame:
    """(column, n) for the n most frequent values, the others summed into Other. Only n rows are put in order."""
    counts = value_counts(df, column)
    top = counts.orderBy(F.desc("n"), column).limit(n).select(F.col(column).alias("_v"), F.lit(True).alias("_top"))
    marked = counts.join(F.broadcast(top), F.col(column).eqNullSafe(F.col("_v")), "left")
    return marked.groupBy(F.when(F.col("_top"), F.col(column)).otherwise(F.lit("Other")).alias(column)).agg(F.sum("n").alias("n"))


def crosstab(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """A contingency table: a row per value of `rows`, and for each of the stated values of `columns` its count."""
    wide = df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1)))
    return wide.select(rows, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(str(v)) for v in values])


#: Ranges into which a round of the selection cuts the values between which a rank lies.
CUTS = 1024


def quantiles(df: DataFrame, value: Column, *shares: float) -> list[float | None]:
    """Exact quantiles with linear interpolation, one for each share; nulls are left out, NaN is above every number.

    Distributed selection: a round counts values per range between the least and the largest that a wanted rank can
    have, and only the range that holds it goes on, until that is one value. No task holds more than CUTS counters per
    wanted rank, however many distinct values there are; each round reads the written values once.
    """
    held = written(df.select(value.cast("double").alias("x")).where("x is not null"))
    row = held.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("x")).alias("nan"), F.min("x").alias("low"), F.max(F.when(~F.isnan("x"), F.col("x"))).alias("high")).first()
    n, numbers = row["n"], row["n"] - row["nan"]
    if n == 0:
        return [None] * len(shares)
    places = [q * (n - 1) for q in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    # Per rank: values from low to high, of which `before` lie below low.
    open_ranks, found = {r: (row["low"], row["high"], 0) for r in ranks if r < numbers}, {r: math.nan for r in ranks if r >= numbers}
    while open_ranks:
        for r in [r for r, (low, high, _) in open_ranks.items() if low == high]:
            found[r] = open_ranks.pop(r)[0]
        if not open_ranks:
            break
        bands = sorted(set(open_ranks.values()))
        counts = _counted(held, bands)
        for r, band in list(open_ranks.items()):
            below = band[2]
            for low, high, count in counts[bands.index(band)]:
                if r < below + count:
                    open_ranks[r] = (low, high, below)
                    break
                below += count
    low, share = [found[math.floor(p)] for p in places], [p - math.floor(p) for p in places]
    return [a if s == 0 else a + (found[math.ceil(p)] - a) * s if a != found[math.ceil(p)] else a for a, s, p in zip(low, share, places, strict=True)]


def _counted(held: DataFrame, bands: list[tuple[float, float, int]]) -> list[list[tuple[float, float, int]]]:
    """For each band the least and largest value and the number of values in each of its ranges that has some."""
    cells = []
    for k, (low, high, _) in enumerate(bands):
        # Halves, as the width of a band may be more than a double holds.
        share = (F.col("x") / 2 - low / 2) / (high / 2 - low / 2) if math.isfinite(low) and math.isfinite(high) else F.when(F.col("x") == low, 0.0).when(F.col("x") == high, 1.0).otherwise(0.5)
        cell = F.least(F.floor(F.least(share, F.lit(1.0)) * CUTS), F.lit(CUTS - 1))
        # The ends stand alone, so that every round makes a band narrower.
        cell = F.when(F.col("x") == low, -1).when(F.col("x") == high, CUTS).otherwise(cell)
        cells.append(F.when(F.col("x").between(low, high) & ~F.isnan("x"), F.struct(F.lit(k).alias("k"), cell.cast("int").alias("cell"))))
    rows = held.select("x", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c"))
    out: list[list] = [[] for _ in bands]
    grouped = rows.groupBy("c").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n"))
    for r in sorted(grouped.collect(), key=lambda r: (r["c"]["k"], r["c"]["cell"])):
        out[r["c"]["k"]].append((r["low"], r["high"], r["n"]))
    return out


def described(df: DataFrame, value: Column, **shares: float) -> DataFrame:
    """One row: n, mean, low, a column per named quantile, high. Quantiles are exact, by distributed selection."""
    n = df.select(value.alias("n"))
    exact = [F.lit(x).cast("double").alias(name) for name, x in zip(shares, quantiles(df, value, *shares.values()), strict=True)]
    return n.agg(F.count("n").alias("n"), F.avg("n").alias("mean"), F.min("n").alias("low"), *exact, F.max("n").alias("high"))


def hexagons(df: DataFrame, x: Column, y: Column, width: float, height: float | None = None, log: bool = False) -> DataFrame:
    """(q, r, x, y, n): rows per hexagon with a point on top, in axial coordinates, with its centre; null, NaN and infinite values have none.

    `width` is a hexagon's from side to side along x, `height` the distance of its rows along y, by default that of
    regular hexagons. With log, both axes are in powers of ten, and values of 0 and less have no place. A point goes to the
    nearest centre in those units: its cube coordinates are rounded, the one that moves most is made to fit.
    """
    height = width * math.sqrt(3) / 2 if height is None else height
    axis = lambda v: F.when(v > 0, F.log10(v)) if log else v.cast("double")
    points = df.select(axis(x).alias("x"), axis(y).alias("y")).where("abs(x) < double('infinity') and abs(y) < double('infinity')")
    r = F.col("y") / height
    q = F.col("x") / width - r / 2
    near = points.select(q.alias("q"), r.alias("r"), (-q - r).alias("s")).select("*", *[F.floor(F.col(c) + 0.5).alias(f"r{c}") for c in "qrs"])
    off = {c: F.abs(F.col(f"r{c}") - F.col(c)) for c in "qrs"}
    fixed_q = F.when((off["q"] > off["r"]) & (off["q"] > off["s"]), -F.col("rr") - F.col("rs")).otherwise(F.col("rq"))
    fixed_r = F.when((off["q"] > off["r"]) & (off["q"] > off["s"]), F.col("rr")).when(off["r"] > off["s"], -F.col("rq") - F.col("rs")).otherwise(F.col("rr"))
    cells = near.select(fixed_q.cast("long").alias("q"), fixed_r.cast("long").alias("r")).groupBy("q", "r").agg(F.count(F.lit(1)).alias("n"))
    return cells.select("q", "r", ((F.col("q") + F.col("r") / 2) * width).alias("x"), (F.col("r") * height).alias("y"), "n")


def repeats(df: DataFrame, **keys: tuple[str, ...]) -> DataFrame:
    """One row: for each named key, how many rows repeat the values of another in its columns."""
    return df.agg(*[(F.count(F.lit(1)) - F.count_distinct(*columns)).alias(name) for name, columns in keys.items()])


def counts_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: for each named condition, how many rows meet it; with isNull() the nulls of a column."""
    return df.agg(*[F.count_if(x).alias(name) for name, x in conditions.items()])


def share_of(condition: Column) -> Column:
    """The share of rows that meet a condition, as an aggregate; where it is null it isn't met."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def dense_counts(df: DataFrame, value: Column, lo: int, hi: int) -> DataFrame:
    """(value, n) for every whole number from lo to hi, 0 where none occurs."""
    every = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("value"))
    counts = df.groupBy(value.cast("int").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def banded_sample(df: DataFrame, ratio: Column, edges: list[float], n: int, order: Column) -> DataFrame:
    """n rows of each half-open band [edges[i], edges[i+1]) in the given order.

    The band comes from an explode, below which a filter of bands cannot go: a costly ratio is computed once a row.
    """
    of = lambda r: F.coalesce(*[F.when((r >= lo) & (r < hi), F.lit(i)) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])
    rows = df.withColumn("band", F.explode(F.filter(F.transform(F.array(ratio), of), lambda band: band.isNotNull())))
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("band").orderBy(order))).where(F.col("_n") <= n).drop("_n")
