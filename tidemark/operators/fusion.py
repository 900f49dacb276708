"""Reciprocal rank fusion of two scored lists without a row for every item.

A rank is over all candidates of a model, those that score zero included. Only items with a score other than zero have
rows; they rank by their scores, and an item that scores zero ranks behind the positive ones by its place in the order
of ids, less the scored items before it: counted, not sorted. Nor is every item fused. The first k of a list give
a score that the k-th best must reach; what ranks too low in both lists to reach it is never looked at, so what is
fused are the heads of the two lists, of a depth that depends on k and the weights alone.

For many queries scored pairs are too many for rows; a `BlockList` gives the same heads and ranks from blocks of scores.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import ranking as R
from .blocks import BlockList

#: The constant of the fusion: weight / (K + rank).
K = 60


def placed(items: DataFrame) -> DataFrame:
    """(item_id, place): items numbered from 1 by id, written."""
    return R.written(R.running(items.select("item_id"), [], [F.col("item_id")], place=F.lit(1)).withColumn("place", F.col("place") + 1))


@dataclass(frozen=True)
class RankList:
    """A model's candidates by rank: rows (query_id, item_id, place, score, rank) of scores other than zero, written;
    ends (query_id, high, held): how many scores of a query are above zero and how many are not zero; items (item_id,
    place), all n candidates, numbered by id."""

    rows: DataFrame
    ends: DataFrame
    items: DataFrame
    n: int

    def heads(self, queries: DataFrame, d: int) -> list[DataFrame]:
        """(query_id, item_id), in parts, with ranks up to d among them."""
        return [self.rows.where(F.col("rank") <= d).select("query_id", "item_id"), first_zeros(self, queries, d, self.items, self.n)]

    def heads_among(self, queries: DataFrame, d: int, items: DataFrame, n: int) -> list[DataFrame]:
        """(query_id, item_id), in parts, the first d of the n items (item_id, place) among them."""
        both = self.rows.join(items.select("item_id"), "item_id", "left_semi")
        return [R.first_k(both, d, ("query_id",), (F.col("rank"),)).select("query_id", "item_id"), first_zeros(self, queries, d, items, n)]

    def ranks_of(self, pairs: DataFrame, name: str) -> DataFrame:
        return ranks_of(self, pairs, name)


def rank_list(scores: DataFrame, items: DataFrame) -> RankList:
    """The list of (query_id, item_id, score) over candidates numbered by `placed`; scores of others are left out.

    Pass written scores: they are counted, their ranges found, and dealt.
    """
    scored = R.rounded(scores).where("score <> 0").join(items, "item_id").select("query_id", "item_id", "place", "score")
    in_order = R.ranked(scored)
    ends = R.written(scored.groupBy("query_id").agg(F.count_if(F.col("score") > 0).alias("high"), F.count(F.lit(1)).alias("held")))
    n = items.count()
    below = F.when(F.col("score") < 0, F.lit(n) - F.col("held")).otherwise(F.lit(0))
    rows = in_order.join(ends, "query_id").select("query_id", "item_id", "place", "score", (F.col("rank") + below).alias("rank"))
    return RankList(R.written(rows), ends, items, n)


def first_zeros(given: RankList, queries: DataFrame, most: int, among: DataFrame, n: int) -> DataFrame:
    """(query_id, item_id): the first `most` items by id that score zero, for queries with fewer than `most` positive scores.

    `among` are the n candidates (item_id, place) to look through: as many places as the query has scored items, and `most`.
    """
    short = queries.join(given.ends, "query_id", "left").fillna(0, ["high", "held"]).where((F.col("high") < most) & (F.col("held") < given.n))
    places = short.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(n), F.col("held") + most).cast("long"))).alias("place"))
    zeros = places.join(among, "place").join(given.rows, ["query_id", "item_id"], "left_anti")
    return R.first_k(zeros, most, ("query_id",), (F.col("item_id"),)).select("query_id", "item_id")


def _scored_before(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, bucket, start, bits) for the wanted (query_id, bucket): the scored places of a bucket as a bitmap, and how many
    come before it. Places are bits, 4 KB a bucket made before the shuffle, so scored rows are neither sorted by id nor moved."""
    place = F.bitmap_bucket_number("place").alias("bucket")
    bits = R.written(rows.groupBy("query_id", place).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")))
    wanted = wanted.distinct()
    counts = bits.select("query_id", "bucket", F.bitmap_count("bits").alias("n")).unionByName(wanted.withColumn("n", F.lit(0).cast("long")))
    earlier = W.partitionBy("query_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.groupBy("query_id", "bucket").agg(F.sum("n").alias("n")).select("query_id", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return starts.join(wanted, ["query_id", "bucket"], "left_semi").join(bits, ["query_id", "bucket"], "left")


def _bits_below(bits: str, bit: str) -> Column:
    """How many bits of a bitmap (null: none) are set below a position."""
    whole = F.floor(F.col(bit) / 8).cast("int")
    last = F.conv(F.hex(F.substring(bits, whole + 1, F.lit(1))), 16, 10).cast("long")
    below = F.expr(f"shiftleft(1L, cast({bit} % 8 as int)) - 1L")
    return F.coalesce(F.bitmap_count(F.substring(bits, F.lit(1), whole)) + F.bit_count(last.bitwiseAND(below)), F.lit(0))


def ranks_of(given: RankList, pairs: DataFrame, name: str) -> DataFrame:
    """pairs (query_id, item_id), all of them candidates, with their rank under a name."""
    known = R.written(pairs.join(given.rows.select("query_id", "item_id", F.col("rank").cast("long").alias(name)), ["query_id", "item_id"], "left"))
    unscored = known.where(F.col(name).isNull()).select("query_id", "item_id")
    if unscored.isEmpty():
        return known
    asked = unscored.join(given.items, "item_id").withColumns({"bucket": F.bitmap_bucket_number("place"), "bit": F.bitmap_bit_position("place")})
    of_them = given.rows.join(unscored.select("query_id").distinct(), "query_id", "left_semi")
    counted = asked.join(_scored_before(of_them, asked.select("query_id", "bucket")), ["query_id", "bucket"]).withColumn("before", F.col("start") + _bits_below("bits", "bit"))
    ends = counted.join(given.ends, "query_id", "left").fillna(0, ["high"])
    zero = ends.select("query_id", "item_id", (F.col("high") + F.col("place") - F.col("before")).alias(name))
    return known.where(F.col(name).isNotNull()).unionByName(zero)


def depth(k: int, alphas: tuple[float, ...], same: bool) -> int:
    """How deep a list may have to be read for the k best.

    The k-th best scores at least w / (K + k), w being the larger of the two weights, or the second where only the
    second list's candidates are all in both. An item behind rank d in both lists scores less than 1 / (K + d).
    """
    weights = [max(a, 1 - a) if same else 1 - a for a in alphas]
    return max((math.floor((K + k) / w) - K for w in weights if w > 0), default=k)


def fused_heads(first: RankList | BlockList, second: RankList | BlockList, seeds: DataFrame, k: int, alphas: tuple[float, ...] = (0.5,), most_seeds: int = 1) -> DataFrame:
    """(query_id, item_id, alpha, score): for each query of seeds (query_id, item_id) and weight of the first list, rows
    among which are its k best items but for its seeds, and no seed. `most_seeds` bounds the seeds of a query.

    The candidates of the second list must be candidates of the first. Items that neither list scores come in only as
    far as k and the weights ask: the first ones by id.
    """
    queries = R.written(seeds.select("query_id").distinct())
    same = first.n == second.n
    need = k + most_seeds
    d = depth(need, alphas, same)
    heads = first.heads(queries, d) + second.heads(queries, d)
    if not same and max(alphas) == 1:
        # The first list alone decides, over the second one's candidates.
        heads += first.heads_among(queries, need, second.items, second.n)
    pairs = reduce(DataFrame.unionByName, heads).distinct().join(seeds.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    if not same:
        pairs = pairs.join(second.items.select("item_id"), "item_id", "left_semi").select("query_id", "item_id")
    pairs = R.written(pairs)
    with ThreadPoolExecutor(2) as pool:
        by_first, by_second = pool.map(lambda given, name: given.ranks_of(pairs, name), (first, second), ("first_rank", "second_rank"))
    ranked = by_first.join(by_second, ["query_id", "item_id"])
    swept = ranked.withColumn("alpha", F.explode(F.array(*map(F.lit, map(float, alphas)))))
    score = F.col("alpha") / (K + F.col("first_rank")) + (1 - F.col("alpha")) / (K + F.col("second_rank"))
    return swept.select("query_id", "item_id", "alpha", F.round(score, 9).alias("score"))

