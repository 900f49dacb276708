"""The two raw sources of a catalogue: a list of items in one CSV, and a folder of CSVs with items, authors, subjects and interactions.

Both become items (item_id, title, author, description, tags, popularity), cleaned and in English.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog
from .tables import read_text_table

# The columns of the files.
LISTED = ["bookId", "title", "author", "description", "genres", "numRatings", "language"]
ITEMS, AUTHORS, SUBJECTS = ["work_id", "title", "author_id", "description", "language"], ["author_id", "name"], ["work_id", "subjects"]


def listed_items(spark: SparkSession, path: str) -> DataFrame:
    """The first source. Of rows that share an id the first of the file stays."""
    rows = read_text_table(spark, path, LISTED, order="nth")
    one = catalog.first_of(rows, ["bookId"], F.col("nth")).where(X.is_english(F.col("language")))
    return one.select(
        F.col("bookId").alias("item_id"),
        "title",
        X.first_author_by_comma(F.col("author")).alias("author"),
        X.clean_description(F.col("description")).alias("description"),
        X.list_literal(F.col("genres")).alias("tags"),
        X.count_or_zero(F.col("numRatings")).alias("popularity"),
    )


def shelf_items(spark: SparkSession, folder: str) -> DataFrame:
    """The second source: items joined with their author's name, their subjects and the number of their readers."""
    items = read_text_table(spark, f"{folder}/books.csv", ITEMS).where(X.is_english(F.col("language")))
    authors = read_text_table(spark, f"{folder}/authors.csv", AUTHORS)
    subjects = read_text_table(spark, f"{folder}/books_to_subjects.csv", SUBJECTS).where(F.col("subjects") != X.NO_SUBJECT)
    tags = subjects.groupBy("work_id").agg(F.array_sort(F.collect_list("subjects")).alias("tags"))
    pairs = read_text_table(spark, f"{folder}/interactions.csv", ["user_id", "work_id"]).distinct()
    readers = pairs.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))
    joined = items.join(authors, "author_id", "left").join(tags, "work_id", "left").join(readers, "work_id", "left")
    return joined.select(
        F.col("work_id").alias("item_id"),
        "title",
        X.first_author_by_semicolon(F.col("name")).alias("author"),
        X.clean_description(F.nullif(F.col("description"), F.lit(X.NO_DESCRIPTION))).alias("description"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("n", F.lit(0)).alias("popularity"),
    )


def interactions(spark: SparkSession, path: str, items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(user_id, item_id, rating): of each reader and kept item of the catalogue the first rating; dropped copies count for the kept one."""
    rows = read_text_table(spark, path, ["user_id", "work_id", "rating"], {"rating": "double"}, "nth").withColumnRenamed("work_id", "item_id")
    known = catalog.remapped(rows, aliases).join(items.select("item_id"), "item_id", "left_semi")
    return catalog.first_of(known, ["user_id", "item_id"], F.col("nth")).select("user_id", "item_id", "rating")
