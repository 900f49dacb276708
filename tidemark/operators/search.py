"""Finding items by typed titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from .similarity import trigrams

ACCEPT, SUGGEST, MARGIN = 0.9, 0.6, 0.1


def query_grams(spark: SparkSession, query: str, idf: DataFrame) -> DataFrame:
    """(term, w): the unit vector of a query over the 3-grams that the index knows."""
    words = spark.range(1).select(X.word_trigrams(X.normalize_title(F.lit(query))).alias("g"))
    counts = words.select(F.explode("g").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    weights = idf.join(counts, "term").select("term", (F.col("tf") * F.col("idf")).alias("w"))
    return weights.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy())))


class TitleIndex:
    """The 3-grams of the titles of items (item_id, title), made once and written; every typed title is looked up in them."""

    def __init__(self, items: DataFrame):
        self.spark = items.sparkSession
        self.postings, self.idf = trigrams(items)

    def scores(self, query: str) -> DataFrame:
        """(item_id, match) for items that share a 3-gram with the query."""
        grams = query_grams(self.spark, query, self.idf)
        return self.postings.join(grams, "term").groupBy("item_id").agg(F.round(F.sum(F.col("weight") * F.col("w")), 9).alias("match"))


def search(items: DataFrame, query: str, n: int = 5, index: TitleIndex | None = None) -> DataFrame:
    """The best n of items (item_id, title, author, has_description, popularity), cut at the first poor match.

    Adds rank, match, ranked (match with small bonuses) and status, the same for all rows. Without an index of the
    items' titles one is made for this search.
    """
    bonus = 0.05 * F.col("has_description").cast("int") + 0.05 * F.col("author").isNotNull().cast("int") + 0.1 * F.col("popularity")
    scored = items.join((index or TitleIndex(items)).scores(query), "item_id").withColumn("ranked", F.round(F.col("match") + bonus, 9))
    # The cut needs the first n rows alone.
    top = scored.orderBy(F.desc("ranked"), "item_id").limit(n)
    order = W.orderBy(F.desc("ranked"), "item_id")
    top = top.withColumn("rank", F.row_number().over(order))
    cut = F.min(F.when(F.col("match") < SUGGEST, F.col("rank"))).over(W.partitionBy())
    kept = top.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col("rank") < F.col("_cut"))).drop("_cut")
    second = F.lead("ranked").over(order)
    clear = (F.col("match") >= ACCEPT) & (second.isNull() | (F.col("ranked") - second >= MARGIN - 1e-12))
    kept = kept.withColumn("_clear", (F.col("rank") == 1) & clear)
    status = F.when(F.max("_clear").over(W.partitionBy()), F.lit("match")).otherwise(F.lit("did_you_mean"))
    kept = kept.withColumn("status", status).where((F.col("status") != "match") | (F.col("rank") == 1))
    return kept.drop("_clear")


def find_substring(items: DataFrame, query: str, n: int) -> DataFrame:
    hit = F.contains(F.lower("title"), F.lower(F.lit(query)))
    return items.where(hit).orderBy(F.desc("popularity"), "item_id").limit(n)
