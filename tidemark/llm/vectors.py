"""Vector tables as shards, and queries against all shards in blocks: what both vector searches share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

#: Vectors per shard at least, and queries that meet a shard in one row: both a few MB, so neither is copied for little work.
SHARD_ROWS, QUERY_BLOCK = 8192, 8192
#: Bytes of a shard's components at most: 200,000 vectors of 64 doubles.
SHARD_BYTES = 100 << 20


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<double>): rows with an id whose vector has no null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and size(x) > 0")
    return rows.where(F.forall("x", finite))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(class_id, x, ids): each distinct vector once, with the k + 1 smallest ids that have it.

    More ids of one vector can never be among a query's k nearest; the window's limit is applied before the
    shuffle too, so a vector that a third of all rows share moves a few rows per task.
    """
    nth = F.row_number().over(W.partitionBy("x").orderBy("vec_id"))
    few = rows.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    return few.groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("class_id"), "x", "ids")


def shard_ranges(classes: DataFrame, shard_rows: int | None = None) -> tuple[DataFrame, int]:
    """((d, first, shards): the shards of each vector length, one after another; their number).

    One row per length: a vector meets only those of its own length. As every query meets every shard, shards are as
    large as leaves two for each core, within SHARD_ROWS and what a task's memory holds; `shard_rows` fixes their size.
    """
    n = classes.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    shared = F.ceil(F.col("n") / (2 * classes.sparkSession.sparkContext.defaultParallelism))
    size = F.lit(shard_rows) if shard_rows else F.greatest(F.lit(SHARD_ROWS), F.least(shared, F.floor(F.lit(SHARD_BYTES) / (8 * F.col("d")))))
    n = n.select("d", F.ceil(F.col("n") / size).cast("int").alias("shards"))
    before = F.coalesce(F.sum("shards").over(W.orderBy("d").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = materialise(n.select("d", before.cast("int").alias("first"), "shards"))
    return ranges, int(ranges.agg(F.sum("shards")).first()[0] or 0)


def with_shard(rows: DataFrame, ranges: DataFrame, column: str, name: str) -> DataFrame:
    """Add the shard of each row (x, column) by a hash of column."""
    joined = rows.withColumn("d", F.size("x")).join(ranges, "d")
    return joined.withColumn(name, F.col("first") + F.pmod(F.xxhash64(column), F.col("shards")).cast("int"))


def sharded(classes: DataFrame, ranges: DataFrame, shards: int, build, schema: str) -> DataFrame:
    """One row per shard, made by build(shard, ids, matrix) and written to the shared folder."""
    dealt = with_shard(classes, ranges, "class_id", "shard").select("shard", "class_id", "x").repartitionById(max(1, shards), F.col("shard"))

    def run(batches):
        parts = [p for p in batches if len(p)]
        if parts:
            pdf = pd.concat(parts).sort_values("class_id")
            yield build(int(pdf["shard"].iloc[0]), pdf["class_id"].to_numpy(np.int64), np.stack(pdf["x"].to_numpy()).astype(np.float64))

    return materialise(dealt.mapInPandas(run, schema))


def blocks_of(queries: DataFrame, *by: str) -> DataFrame:
    """(by, queries): queries (query_id, ...) packed into rows of at most about QUERY_BLOCK for each value of `by`."""
    number = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // QUERY_BLOCK)))).alias("_block")
    return queries.groupBy(*by, number).agg(F.collect_list(F.struct(*queries.columns)).alias("queries")).drop("_block")


def search(index: DataFrame, cells: DataFrame, look_up, score: str) -> DataFrame:
    """Hits (query_id, class_id, score) of look_up(index row, query rows) for every cell (shard, queries)."""
    kind = {"long": "int64", "double": "float64"}[score]

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, classes, scores = zip(*hits, strict=True) if (hits := look_up(row, row.queries)) else ((), (), ())
                yield pd.DataFrame({"query_id": np.array(ids, np.int64), "class_id": np.array(classes, np.int64), "score": np.array(scores, kind)})

    return index.join(cells, "shard").mapInPandas(run, f"query_id long, class_id long, score {score}")


def best(hits: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows per query, ties to the smaller vec_id, never the query's own."""
    first = W.partitionBy("query_id").orderBy(F.desc("score"), "class_id")
    few = materialise(hits.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).drop("nth"))
    each = few.join(classes.select("class_id", "ids"), "class_id").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
