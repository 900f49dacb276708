"""Exact top-k by inner product over KD-trees, one per shard.

Trees split at medians and keep tight bounding boxes. A query visits nodes best first by the largest inner
product that a box allows and stops once that is under its kth score. A query's home shard is searched first;
the kth score found there goes with the query to all other shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vectors import best, blocks_of, distinct_vectors, search, shard_ranges, sharded, usable, with_shard

LEAF = 64
TREE = "shard int, dimension int, ids binary, points binary, lo binary, hi binary, nodes binary"


def build_tree(shard: int, ids: np.ndarray, points: np.ndarray) -> pd.DataFrame:
    """Flat tree: points in leaf order; per node its span, children (-1: leaf) and box."""
    order, nodes, lo, hi = np.arange(len(ids)), [], [], []
    todo = [(0, len(ids), -1)]
    while todo:
        start, stop, parent = todo.pop()
        me = len(nodes)
        part = points[order[start:stop]]
        lo.append(part.min(axis=0))
        hi.append(part.max(axis=0))
        nodes.append([start, stop, -1, -1])
        if parent >= 0:
            nodes[parent][2 if nodes[parent][2] < 0 else 3] = me
        if stop - start > LEAF:
            axis, middle = int(np.argmax(hi[-1] - lo[-1])), (start + stop) // 2
            order[start:stop] = order[start:stop][np.argpartition(part[:, axis], middle - start)]
            todo += [(start, middle, me), (middle, stop, me)]
    blob = lambda a, kind: np.ascontiguousarray(a, dtype=kind).tobytes()
    row = (shard, points.shape[1], blob(ids[order], np.int64), blob(points[order], np.float64), blob(lo, np.float64), blob(hi, np.float64), blob(nodes, np.int64))
    return pd.DataFrame([row], columns=[f.split()[0] for f in TREE.split(", ")])


_INT = np.frompyfunc(int, 1, 1)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they stop at the nearest end."""
    reach = np.abs(points).max(initial=0) * np.abs(query).max(initial=0) * len(query)
    if reach < 2**53:
        return (points @ query).astype(np.int64)
    exact = _INT(points) @ _INT(query)
    return np.array([max(LEAST, min(MOST, x)) for x in exact], dtype=np.int64)


def visit(tree, queries, k: int) -> list[tuple[int, int, int]]:
    """The k + 1 best classes of a tree per query, none of them under the bound that the query brings."""
    d = tree.dimension
    ids = np.frombuffer(tree.ids, np.int64)
    points, lo, hi = (np.frombuffer(b, np.float64).reshape(-1, d) for b in (tree.points, tree.lo, tree.hi))
    nodes = np.frombuffer(tree.nodes, np.int64).reshape(-1, 4).tolist()
    out = []
    for q in queries:
        x = np.asarray(q["x"], dtype=np.float64)
        up, down = np.maximum(x, 0), np.minimum(x, 0)
        # The margin covers the rounding of the sum, which goes with its terms, not with what is left of them.
        bounds = (hi @ up + lo @ down + 1e-12 * (np.abs(hi) @ up - np.abs(lo) @ down)).tolist()
        kth, found, heap = LEAST if q["bound"] is None else int(q["bound"]), [], [(-bounds[0], 0)]
        while heap and min(-heap[0][0], MOST) >= kth:
            _, node = heapq.heappop(heap)
            start, stop, left, right = nodes[node]
            if left >= 0:
                for child in (left, right):
                    if min(bounds[child], MOST) >= kth or kth == LEAST:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            scores = _products(points[start:stop], x)
            for i in np.flatnonzero(scores >= kth):
                heapq.heappush(found, (int(scores[i]), -int(ids[start + i])))
                if len(found) > k + 1:
                    heapq.heappop(found)
            if len(found) > k:
                kth = max(kth, found[0][0])
        out += [(q["query_id"], -i, s) for s, i in found]
    return out


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): per query the k rows of largest integer inner product.

    Components become floor(scale * x). Queries are rows whose vec_id is divisible by `every`, candidates all
    rows of the same length but the query's own; ties go to the smaller vec_id, rows equal in id and vector count
    once. Scores are exact integers; beyond 64 bits they stop at the nearest end and count as ties there. Vectors
    that are null or empty, or hold null or non-finite components, take no part. Components of 2^53 / scale and
    more are whole numbers already.
    """
    rows = materialise(usable(vectors).select("vec_id", F.transform("x", lambda v: _floor(v, scale)).alias("x")))
    classes = materialise(distinct_vectors(rows, k))
    ranges, shards = shard_ranges(classes)
    index = sharded(classes, ranges, shards, build_tree, TREE)
    asked = rows.where(F.col("vec_id") % every == 0).join(classes.select("class_id", "x"), "x").select(F.col("vec_id").alias("query_id"), "x", "class_id").distinct()
    queries = materialise(with_shard(asked, ranges, "class_id", "home").select("query_id", "x", "home", "first", "shards"))

    plain = queries.select("query_id", "x", F.lit(None).cast("long").alias("bound"), F.col("home").alias("shard"))
    at_home = materialise(search(index, blocks_of(plain, "shard"), lambda row, qs: visit(row, qs, k), "long"))
    kth = at_home.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query_id", F.get("s", F.lit(k)).alias("bound"))
    bounded = materialise(queries.join(kth, "query_id", "left"))
    packed = materialise(blocks_of(bounded, "first", "shards"))
    away = packed.withColumn("shard", F.explode(F.sequence("first", F.col("first") + F.col("shards") - 1))).withColumn("queries", F.filter("queries", lambda q: q["home"] != F.col("shard")))
    rest = search(index, away.where(F.size("queries") > 0).select("shard", "queries"), lambda row, qs: visit(row, qs, k), "long")
    return best(at_home.union(rest), classes, k)


def _floor(v, scale: int):
    """floor(scale * v) as a double: Spark's floor goes through a long, so what has no fraction stays as it is."""
    scaled = v * F.lit(float(scale))
    return F.when(F.abs(scaled) < F.lit(2.0**53), F.floor(scaled).cast("double")).otherwise(scaled)
