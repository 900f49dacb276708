"""Readers per item kept up to date from a stream of interactions, with a popularity table per batch.

Every (reader, item) counts once. The state that tells which have been seen is Spark's, bounded by a watermark; what
has been counted stands in a table with one part per batch, so a batch that runs again replaces its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import popularity as pop

SCHEMA = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("at", T.TimestampType())])


def arrivals(spark: SparkSession, folder: str, per_batch: int | None = None) -> DataFrame:
    """The stream of Parquet files (user_id, item_id, at) that are dropped into a folder, at most per_batch files at once."""
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)


def first_seen(stream: DataFrame, within: str = "30 days") -> DataFrame:
    """Each (reader, item) of a stream once. Rows more than `within` behind the latest are late and left out, as are null
    readers, items and times; a pair that comes again later than that counts again, the price of bounded state."""
    known = stream.where("user_id is not null and item_id is not null and at is not null")
    return known.withWatermark("at", within).dropDuplicatesWithinWatermark(["user_id", "item_id"])


def keep_counts(stream: DataFrame, table: str, checkpoint: str, within: str = "30 days", once: bool = True) -> StreamingQuery:
    """Count new readers per item into `table` (batch, item_id, n), a part per batch; `once` ends when all files are read.

    Counts are reduced before they are written. After a failure the batch in hand runs again and overwrites its part, so
    nothing is lost or counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{table}/batch={number}")

    out = first_seen(stream, within).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def readers(spark: SparkSession, table: str) -> DataFrame:
    """(item_id, n_readers) over all batches so far."""
    counted = spark.read.schema("item_id string, n long, batch long").parquet(table)
    return counted.groupBy("item_id").agg(F.sum("n").alias("n_readers"))


def popularity(spark: SparkSession, table: str, items: DataFrame) -> DataFrame:
    """items (item_id, any other columns) with n_readers so far and their popularity; items without readers have 0."""
    joined = items.join(readers(spark, table), "item_id", "left").withColumn("n_readers", F.coalesce("n_readers", F.lit(0)))
    return pop.popularity(joined, ("n_readers",))
