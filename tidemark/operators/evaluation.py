"""Leave-one-out evaluation: test pairs, ranks of the targets, metrics and a paired test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from . import ranking as R


def hashed(seed: int, *columns: str) -> Column:
    """A portable seeded order: md5 of the seed and the columns, joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def liked(interactions: DataFrame, candidates: DataFrame, least: float = 7) -> DataFrame:
    """(user_id, item_id) rated `least` or better, on the candidates (item_id)."""
    return interactions.where(F.col("rating") >= least).join(candidates.select("item_id"), "item_id", "left_semi").select("user_id", "item_id")


def liked_per_reader(pairs: DataFrame) -> DataFrame:
    """(user_id, items) of readers with two liked items or more."""
    return pairs.groupBy("user_id").agg(F.array_sort(F.collect_set("item_id")).alias("items")).where(F.size("items") >= 2)


def _least_two(rows: DataFrame, keys: list[str], key: Column) -> DataFrame:
    """(keys, query, target): each group's first and second item in the order of key; Spark keeps two per task."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(key, "item_id"))
    two = rows.withColumn("_n", nth).where("_n <= 2").groupBy(*keys)
    return two.agg(F.max(F.when(F.col("_n") == 1, F.col("item_id"))).alias("query"), F.max(F.when(F.col("_n") == 2, F.col("item_id"))).alias("target")).where("target is not null")


def _first_readers(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """The rows of n readers (user_id) in seeded order; a histogram of their hashes leaves few others to order."""
    rows = R.written(rows)
    key = F.conv(F.substring(hashed(seed, "user_id"), 1, 15), 16, 10).cast("long")
    return R.least_by_hash(rows, key, n).orderBy(hashed(seed, "user_id"), "user_id").limit(n)


def test_pairs(pairs: DataFrame, n: int, seed: int) -> DataFrame:
    """(user_id, query, target): n readers in seeded order, two of their liked items each."""
    return _first_readers(_least_two(pairs.distinct(), ["user_id"], hashed(seed, "user_id", "item_id")), n, seed)


def related_pairs(pairs: DataFrame, tags: DataFrame, n: int, seed: int) -> DataFrame:
    """(user_id, query, target, tag): as test_pairs, but both items share a tag of tags (item_id, tag).

    The tag is the reader's first in seeded order that two liked items have; no pairs are formed to find it.
    """
    tagged = pairs.distinct().join(tags.select("item_id", "tag").distinct(), "item_id")
    both = _least_two(tagged, ["user_id", "tag"], hashed(seed, "user_id", "item_id"))
    one = both.groupBy("user_id").agg(F.min_by(F.struct("query", "target", "tag"), hashed(seed, "user_id", "tag")).alias("x"))
    return _first_readers(one.select("user_id", "x.query", "x.target", "x.tag"), n, seed)


def target_ranks(top: DataFrame, queries: DataFrame, models: list[str]) -> DataFrame:
    """(model, query_id, target_rank): the target's place in its query's list of each named model, 0 if absent."""
    names = top.sparkSession.createDataFrame([(m,) for m in models], "model string")
    found = top.select("model", "query_id", F.col("item_id").alias("target"), "rank")
    every = queries.select("query_id", "target").join(F.broadcast(names)).join(found, ["model", "query_id", "target"], "left")
    return every.select("model", "query_id", F.coalesce("rank", F.lit(0)).alias("target_rank"))


def metrics(top: DataFrame, queries: DataFrame, items: DataFrame, models: list[str]) -> DataFrame:
    """One row for each of the named models, over top (model, query_id, item_id, rank), queries (query_id, query, target)
    and items (item_id, author, popularity).

    Authors are compared by their keys; an unknown author is nobody's. coverage counts the distinct items recommended. A
    model without any list has rates and coverage of 0, and null where there is nothing to average.
    """
    names = top.sparkSession.createDataFrame([(m,) for m in models], "model string")
    keyed = items.select("item_id", "popularity", X.author_key(F.col("author")).alias("author"))
    a = keyed.select(F.col("item_id").alias("query"), F.col("author").alias("q_author"))
    b = keyed.select(F.col("item_id").alias("target"), F.col("author").alias("t_author"))
    q = queries.join(a, "query", "left").join(b, "target", "left").withColumn("same", F.coalesce(F.col("q_author") == F.col("t_author"), F.lit(False)))
    found = top.select("model", "query_id", F.col("item_id").alias("target"), "rank")
    per_query = q.join(F.broadcast(names)).join(found, ["model", "query_id", "target"], "left")
    hit = F.col("rank").isNotNull().cast("double")
    hits = per_query.groupBy("model").agg(
        F.avg(hit).alias("hit_rate"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"),
        F.avg(F.when(F.col("same"), hit)).alias("hit_same_author"),
        F.avg(F.when(~F.col("same"), hit)).alias("hit_other_author"),
    )
    lists = top.join(keyed, "item_id").join(q.select("query_id", "q_author"), "query_id")
    own = F.coalesce(F.col("author") == F.col("q_author"), F.lit(False)).cast("double")
    lists = lists.groupBy("model").agg(F.count_distinct("item_id").alias("coverage"), F.avg("popularity").alias("avg_popularity"), F.avg(own).alias("by_query_author"))
    error = F.sqrt(F.col("hit_rate") * (1 - F.col("hit_rate")) / F.col("n"))
    return hits.join(lists, "model", "left").withColumn("std_error", error).fillna(0, ["coverage"])


def discordant(ranks_a: DataFrame, ranks_b: DataFrame) -> DataFrame:
    """One row (only_a, only_b): queries whose target only one model found."""
    b = ranks_b.select("query_id", F.col("target_rank").alias("b"))
    both = ranks_a.select("query_id", F.col("target_rank").alias("a")).join(b, "query_id")
    return both.agg(F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("only_b"))


def mcnemar_p(only_a: int, only_b: int) -> float:
    """The p-value of the paired test with continuity correction; 1 without discordant queries."""
    n = only_a + only_b
    return 1.0 if n == 0 else math.erfc(math.sqrt((abs(only_a - only_b) - 1) ** 2 / n / 2))


def compared(top: DataFrame, queries: DataFrame, reference: str, models: list[str]) -> DataFrame:
    """(model, only_model, only_reference, p): each of the named models against the reference on the same queries.

    The counts, one row per model, come to the driver, which has the p-values' error function.
    """
    hits = top.join(queries.select("query_id", F.col("target").alias("item_id")), ["query_id", "item_id"], "left_semi").select("model", "query_id")
    known = hits.where(F.col("model") == reference).select("query_id", F.lit(True).alias("known"))
    own = hits.join(known, "query_id", "left").groupBy("model").agg(F.count_if(F.col("known").isNull()).alias("only_model"), F.count_if("known").alias("both")).collect()
    counts = {r["model"]: (r["only_model"], r["both"]) for r in own}
    found = counts.get(reference, (0, 0))[1]
    rows = [(m, only, found - both, mcnemar_p(only, found - both)) for m in models for only, both in [counts.get(m, (0, 0))]]
    return top.sparkSession.createDataFrame(rows, "model string, only_model long, only_reference long, p double")
