"""Ranking: top-k, distributed ranks, rank fusion, re-ranking and list rules.

Everywhere the order is score (to nine places) descending, then item_id: a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import step_path


def best() -> tuple[Column, Column]:
    return F.desc("score"), F.asc("item_id")


def best_first(*keys: str):
    return W.partitionBy(*keys).orderBy(*best())


def rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round("score", 9))


def top_k(scores: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best rows per key (query_id) with their rank; Spark keeps k per task before the shuffle."""
    return first_k(rounded(scores), k, keys or ("query_id",), best())


def first_k(rows: DataFrame, k: int, keys: tuple[str, ...] | list[str], order: tuple[Column, ...] | list[Column]) -> DataFrame:
    """The first k rows per key in the given order, with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def least_by_hash(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """The rows with the n smallest keys, whole numbers spread like hashes, and no more than about as many others.

    A histogram of the keys' leading bits finds the cut; where one bar alone holds far more than n, its next bits are
    counted. So no task orders rows that cannot be among the first n. Pass written rows: each count reads them once.
    """
    kept, open_bar, have = None, F.lit(True), 0
    for bits in (52, 40, 28, 16, 4, 0):
        bar = F.shiftright(key, bits)
        bars = sorted((r["bar"], r["n"]) for r in rows.where(open_bar).groupBy(bar.alias("bar")).agg(F.count(F.lit(1)).alias("n")).collect() if r["bar"] is not None)
        for value, count in bars:
            if have + count >= n:
                kept, open_bar = bar <= value, bar == value
                break
            have += count
        else:
            return rows if kept is None else rows.where(kept)
        if count <= n:
            break
    return rows.where(kept)


def sweep(first: DataFrame, second: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """(query_id, item_id, alpha, score): the fusion for several weights; ranks are made once, only the blend differs."""
    return fused(first.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))), second, F.col("alpha")).drop("first_rank", "second_rank")


def without_seeds(scores: DataFrame, seeds: DataFrame) -> DataFrame:
    return scores.join(seeds.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")


def completed(scores: DataFrame, items: DataFrame, queries: list | DataFrame) -> DataFrame:
    """A row for every item and query, with score 0 where there was none. Queries are a stated set: ids, or (query_id)."""
    if isinstance(queries, DataFrame):
        packed = queries.select("query_id").distinct().agg(F.collect_list("query_id").alias("_queries"))
        every = items.select("item_id").join(F.broadcast(packed)).select("item_id", F.explode("_queries").alias("query_id"))
    else:
        every = items.select("item_id").withColumn("query_id", F.explode(F.array(*map(F.lit, queries))))
    return every.join(scores, ["query_id", "item_id"], "left").select("query_id", "item_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder: what is read several times is made once."""
    path = step_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(scores: DataFrame, key: str = "query_id") -> DataFrame:
    """The rank of every row within its key, without sorting a key in one task.

    Rows are dealt by range of (key, score, item_id); each range ranks its own rows, shifted by the number of
    the key's rows in earlier ranges: one count per key and range.
    """
    rows = rounded(scores)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, F.col(key), *best()).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = dealt.withColumn("_nth", F.row_number().over(best_first(key, "_range")))
    return within.join(starts, [key, "_range"]).withColumn("rank", F.col("_before") + F.col("_nth")).drop("_range", "_nth", "_before")


def running(rows: DataFrame, keys: list[str], order: list[Column], **sums: Column) -> DataFrame:
    """Add, by name, the sum of a column over the key's rows before a row in a total order, without gathering a key in one task.

    As for `ranked`, rows are dealt by range; each range sums its own rows, from the sums of the ranges before it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = rows.withColumns({f"_x_{n}": x for n, x in sums.items()})
    dealt = written(valued.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "_range").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums])
    within = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = dealt.withColumns({n: F.coalesce(F.sum(f"_x_{n}").over(within), F.lit(0)) for n in sums})
    return own.join(starts, [*keys, "_range"]).select(*rows.columns, *[(F.col(n) + F.col(f"_s_{n}")).alias(n) for n in sums])


def fused(first: DataFrame, second: DataFrame, alpha: float | Column = 0.5, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rank tables (query_id, item_id, rank); an item that either lacks drops out.

    Ranks are over all items of each model, seeds and zero scores included; filter afterwards. `alpha` may be a column
    of `first`, as for a sweep.
    """
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    more = [c for c in first.columns if c not in ("query_id", "item_id", "rank", "score")]
    a = first.select("query_id", "item_id", *more, F.col("rank").alias("first_rank"))
    b = second.select("query_id", "item_id", F.col("rank").alias("second_rank"))
    score = alpha / (k + F.col("first_rank")) + (1 - alpha) / (k + F.col("second_rank"))
    return a.join(b, ["query_id", "item_id"]).withColumn("score", F.round(score, 9))


def reranked(scores: DataFrame, popularity: DataFrame, beta: float = 0.2, candidates: int = 200) -> DataFrame:
    """(query_id, item_id, score, similarity, popularity): the best candidates, similarity scaled within them, blended."""
    top = top_k(scores, candidates)
    per_query = W.partitionBy("query_id")
    lo, hi = F.min("score").over(per_query), F.max("score").over(per_query)
    scaled = top.withColumn("similarity", (F.col("score") - lo) / (hi - lo + 1e-12))
    blend = (1 - beta) * F.col("similarity") + beta * F.coalesce("popularity", F.lit(0.0))
    return scaled.drop("score", "rank").join(popularity.select("item_id", "popularity"), "item_id", "left").withColumn("score", blend)


def capped(scores: DataFrame, authors: DataFrame, own: DataFrame, per_author: int | None = 2, per_own: int | None = 2) -> DataFrame:
    """At most per_author items of an author and per_own of the query's (query_id, own_author); unknown authors are free.

    Going best first under such caps keeps each author's first ones, so a rank within the author decides.
    """
    rows = rounded(scores).join(authors.select("item_id", "author"), "item_id", "left").join(own, "query_id", "left")
    nth = F.row_number().over(best_first("query_id", "author"))
    cap = F.when(F.col("author") == F.col("own_author"), F.lit(per_own)).otherwise(F.lit(per_author))
    keep = F.col("author").isNull() | cap.isNull() | (F.col("_nth") <= cap)
    return rows.withColumn("_nth", nth).where(keep).drop("_nth", "own_author")


def first_copies(scores: DataFrame, keys: DataFrame, own: DataFrame) -> DataFrame:
    """The best item of each dedup key per query, none with the query's own key (query_id, own_key)."""
    rows = rounded(scores).join(keys.select("item_id", "dedup_key"), "item_id").join(own, "query_id", "left")
    rows = rows.where(~F.coalesce(F.col("dedup_key") == F.col("own_key"), F.lit(False)))
    nth = F.row_number().over(best_first("query_id", "dedup_key"))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "own_key")
