"""Building one catalogue from two sources: keys, duplicates, aliases and the merge.

Groups are reduced by aggregates with map-side combine, so a key that most rows share is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def keyed(items: DataFrame) -> DataFrame:
    return items.withColumn("key", X.match_key(F.col("title"), F.col("author")))


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of the rows equal in keys the one that comes first in order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def deduplicated(items: DataFrame) -> DataFrame:
    """Of items (item_id, key, popularity, ...) the most popular of each key; ties to the smaller id. Rows without key stay."""
    best = first_of(items.where("key is not null"), ["key"], -F.col("popularity"), F.col("item_id"))
    return best.unionByName(items.where("key is null"))


def aliases(items: DataFrame) -> DataFrame:
    """(item_id, kept_id) for every row with a key."""
    kept = items.where("key is not null").groupBy("key").agg(F.min_by("item_id", F.struct(-F.col("popularity"), F.col("item_id"))).alias("kept_id"))
    return items.join(kept, "key").select("item_id", "kept_id")


def remapped(interactions: DataFrame, alias: DataFrame) -> DataFrame:
    joined = interactions.join(alias, "item_id", "left").withColumn("item_id", F.coalesce("kept_id", "item_id"))
    return joined.select(*interactions.columns)


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per item of two deduplicated sources (item_id, key, title, author, description, tags, popularity).

    Matched on key; rows without key match nothing. The first source wins column by column, the second gives the id.
    """
    a = first.select(F.coalesce("key", F.concat(F.lit("a-nokey:"), F.col("item_id"))).alias("k"), *[F.col(c).alias(f"a_{c}") for c in first.columns])
    b = second.select(F.coalesce("key", F.concat(F.lit("b-nokey:"), F.col("item_id"))).alias("k"), *[F.col(c).alias(f"b_{c}") for c in second.columns])
    source = F.when(F.col("a_description").isNotNull(), F.lit("a")).when(F.col("b_description").isNotNull(), F.lit("b"))
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    return a.join(b, "k", "full_outer").select(
        F.coalesce(F.col("b_item_id").cast("string"), F.concat(F.lit("a:"), F.col("a_item_id"))).alias("item_id"),
        F.col("a_item_id").alias("a_id"),
        F.col("b_item_id").alias("b_id"),
        *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in ("title", "author", "description")],
        source.alias("description_source"),
        X.combine_tags(F.col("a_tags"), F.col("b_tags")).alias("tags"),
        number("a_popularity").alias("a_popularity"),
        number("b_popularity").alias("b_popularity"),
        F.coalesce("a_description", "b_description").isNotNull().alias("has_description"),
    )


def single_source(items: DataFrame) -> DataFrame:
    """The same layout from the first source alone."""
    nothing = items.sparkSession.createDataFrame([], items.schema)
    return merged(items, nothing)


def report(catalog: DataFrame) -> DataFrame:
    """One row of counts."""
    has_a, has_b = F.col("a_id").isNotNull(), F.col("b_id").isNotNull()
    return catalog.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(has_a).alias("in_a"),
        F.count_if(has_b).alias("in_b"),
        F.count_if(has_a & has_b).alias("matched"),
        F.count_if("has_description").alias("described"),
    )


def assert_unique(df: DataFrame, column: str = "item_id") -> DataFrame:
    twice = df.groupBy(column).count().where("count > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError(f"{column} {twice.first()[0]!r} is not unique")
    return df
