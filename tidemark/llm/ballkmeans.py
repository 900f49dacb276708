"""Ball k-means over whole-number vectors: exact Lloyd rounds that compare members with the centroids near them only.

A cluster is a ball: its centroid and a radius that no member exceeds. Another centroid can win a member only if it
stands within twice the member's distance from its own centroid; those within twice the radius are the ball's
neighbours. Neighbours in order of distance cut the ball into a stable core, whose members keep their cluster without
a comparison, and annuli, whose members meet only the neighbours up to their own annulus. Radii travel from round to
round with the sums that move the centroids, so a round is one pass over the vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Components up to this size are computed with in 64-bit floats, exactly; larger ones in whole numbers of any size.
EXACT = 1 << 20
MOST_LONG = (1 << 63) - 1
#: Vectors compared at once.
BLOCK = 4096


@dataclass
class Balls:
    """Centroids, and per cluster a bound of its radius with its neighbours in order: what a round hands to tasks.

    centroids are lists of whole numbers; neighbours[i] holds (squared distance of the centroids, j), nearest first, or
    there are none at all as long as no vector has a cluster: then everyone meets everyone.
    """

    centroids: list[list[int]]
    neighbours: list[list[tuple[int, int]]] | None


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def balls(centroids: list[list[int]], radii: list[float] | None) -> Balls:
    """With radii, each ball's neighbours: (squared distance, number) of the centroids within twice its radius."""
    if radii is None:
        return Balls(centroids, None)
    near = []
    for i, c in enumerate(centroids):
        within = (2 * radii[i]) ** 2 * (1 + 1e-9)
        others = [(squared(c, o), j) for j, o in enumerate(centroids) if j != i]
        near.append(sorted((d, j) for d, j in others if d <= within))
    return Balls(centroids, near)


def _distances(x: np.ndarray, c: list[list[int]]) -> np.ndarray:
    """Squared distances of rows to centroids, in the rows' kind of number."""
    m = np.array(c, dtype=x.dtype)
    return ((x[:, None, :] - m[None, :, :]) ** 2).sum(axis=2) if x.dtype == object else (x * x).sum(1)[:, None] - 2 * (x @ m.T) + (m * m).sum(1)[None, :]


def _own(x: np.ndarray, c: list[int]) -> np.ndarray:
    d = x - np.array(c, dtype=x.dtype)
    return (d * d).sum(axis=1)


def assign(x: np.ndarray, cluster: np.ndarray, state: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """(clusters, squared distances, comparisons with centroids) of the rows of x, ties to the smaller number."""
    n, everyone = len(x), range(len(state.centroids))
    if state.neighbours is None:
        d = _distances(x, state.centroids)
        new = d.argmin(axis=1)
        return new, d[np.arange(n), new], n * len(state.centroids)
    new, best, met = cluster.copy(), np.zeros(n, dtype=x.dtype), n
    for i in everyone:
        members = np.flatnonzero(cluster == i)
        if not len(members):
            continue
        own = _own(x[members], state.centroids[i])
        best[members] = own
        near = state.neighbours[i]
        # The annulus of a member: the number of neighbours within twice its distance. 0 is the stable core.
        edges = np.array([d for d, _ in near], dtype=x.dtype if x.dtype == object else np.float64)
        annulus = np.searchsorted(edges, 4 * own, side="right") if len(near) else np.zeros(len(members), np.int64)
        for k in range(len(near)):
            # Ring by ring: the members of annulus k + 1 and beyond meet neighbour k.
            rows = members[annulus > k]
            if not len(rows):
                break
            j = near[k][1]
            d = _own(x[rows], state.centroids[j])
            met += len(rows)
            wins = (d < best[rows]) | ((d == best[rows]) & (j < new[rows]))
            new[rows[wins]], best[rows[wins]] = j, d[wins]
    return new, best, met


def whole_vectors(vectors: DataFrame, scale: int = 64, length: int = 64) -> DataFrame:
    """(vec_id, x array<long>): rows whose vector has `length` components, none null or non-finite, as floor(scale * x).

    Components beyond the 64-bit whole numbers stop at their ends.
    """
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(v * scale).cast("long"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = vectors.where(F.size("embedding") == length).select("vec_id", "embedding")
    return rows.where(F.forall(F.col("embedding").cast("array<double>"), finite)).select("vec_id", x.alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the k rows with the smallest digests of seed and vec_id, in their order; null ids come last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["x"] for r in rows.select(digest.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()]


def _numbers(column: pa.Array) -> np.ndarray:
    """A list<long> column as a matrix, of floats where those are exact, else of Python's whole numbers."""
    flat = column.flatten().to_numpy()
    x = flat.reshape(len(column), -1)
    return x.astype(np.float64) if not len(flat) or max(-int(flat.min()), int(flat.max())) <= EXACT else x.astype(object)


ROUND = "vec_id long, x array<long>, cluster int, distance long"


def step(rows: DataFrame, state: Balls) -> DataFrame:
    """rows (vec_id, x, cluster) assigned anew, with their squared distance; distances stop at the largest long."""
    wide = max((abs(v) for c in state.centroids for v in c), default=0) > EXACT

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _numbers(part.column(1))
                x = x.astype(object) if wide and x.dtype != object else x
                new, d, _ = assign(x, part.column(2).to_numpy(zero_copy_only=False).astype(np.int64), state)
                kept = pa.array([min(int(v), MOST_LONG) for v in d], pa.int64()) if x.dtype == object else pa.array(d.astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(new, pa.int32()), kept], names=["vec_id", "x", "cluster", "distance"])

    return rows.select("vec_id", "x", "cluster").mapInArrow(run, ROUND)


def summed(rows: DataFrame, length: int) -> list:
    """One row per cluster: n, the sums of its components, the largest distance and all distances; made in tasks first."""
    sums = [F.sum(F.col("x")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(length)]
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"), *sums).collect()


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, length: int = 64) -> tuple[DataFrame, list[list[int]], dict[int, int]]:
    """(rows (vec_id, x, cluster, distance), the final centroids, each non-empty cluster's sum of distances).

    vectors has (vec_id, embedding, any other columns). Rows whose vector is null, of another length, or holds null or
    non-finite components take no part. Repeated rows and ids are rows of their own; rows without id are clustered
    but start no cluster before those with one. With fewer than k rows there are as many clusters; without rows none.
    What passes through the driver is k centroids of `length` components.
    """
    rows = materialise(whole_vectors(vectors, scale, length).withColumn("cluster", F.lit(-1)))
    centroids = first_centroids(rows, k, seed)
    radii = None
    for turn in range(rounds + 1):
        before, rows = rows, materialise(step(rows, balls(centroids, radii)))
        discard(before)
        sums = {r["cluster"]: r for r in summed(rows, length)}
        if turn == rounds:
            break
        moved = [[int(sums[i][f"s{c}"]) // sums[i]["n"] for c in range(length)] if i in sums else old for i, old in enumerate(centroids)]
        # A member is at most as far from the moved centroid as from the old one and the move together.
        radii = [(sums[i]["far"] ** 0.5 + squared(old, new) ** 0.5) * (1 + 1e-9) if i in sums else 0.0 for i, (old, new) in enumerate(zip(centroids, moved, strict=True))]
        if any(s["far"] == MOST_LONG for s in sums.values()):
            radii = None  # the distance was cut off: everyone meets everyone
        centroids = moved
    return rows, centroids, {i: int(s["inertia"]) for i, s in sums.items()}


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, length: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for the rows that `clustered` keeps.

    Sums of distances stop at the largest long.
    """
    rows, centroids, inertia = clustered(vectors, k, rounds, seed, scale, length)
    spark, every = rows.sparkSession, min(sum(inertia.values()), MOST_LONG)
    known = spark.createDataFrame([(i, min(v, MOST_LONG), every, ",".join(map(str, centroids[i]))) for i, v in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid string")
    joined = rows.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def clusters_sql(k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, length: int = 64) -> str:
    """The same clusters by comparing every vector with every centroid."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {length})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS INTEGER) AS i, x FROM v QUALIFY i < {k})",
    ]
    for n in range(rounds + 1):
        distance = f"CAST(list_sum(list_transform(range(1, {length + 1}), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j]))) AS BIGINT)"
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min({{'d': {distance}, 'i': c.i}}) AS b FROM v, c{n} c GROUP BY r)")
        if n < rounds:
            sums = f"SELECT i, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM (SELECT b.i AS i, j, CAST(sum(x[j]) AS HUGEINT) AS s, count(*) AS n FROM a{n}, (SELECT unnest(range(1, {length + 1})) AS j) GROUP BY 1, 2) GROUP BY i"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT o.i, coalesce(list_transform(m.x, lambda e: CAST(e AS BIGINT)), o.x) AS x FROM c{n} o LEFT JOIN ({sums}) m ON m.i = o.i)")
    last = f"SELECT vec_id, b.i AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.i) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.i = b.i"
    return f"WITH {', '.join(parts)} {last}"
