"""Ball k-means against rounds that compare every vector with every centroid, in whole numbers of any size."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import ballkmeans as B
from tidemark.llm import registry

FIELDS = "vec_id long, embedding array<double>, cluster string, x int, distance string, centroid string"


def brute(rows, k, rounds, seed, scale, length):
    limit = lambda v: max(-(1 << 63), min((1 << 63) - 1, math.floor(v * scale))) if abs(v * scale) < 1e300 else (1 << 63) - 1 if v > 0 else -(1 << 63)
    kept = [(i, [limit(x) for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]
    for turn in range(rounds + 1):
        found = [min((B.squared(x, c), j) for j, c in enumerate(centroids)) for _, x in kept]
        if turn < rounds:
            for j in range(len(centroids)):
                if own := [x for (_, x), (_, c) in zip(kept, found, strict=True) if c == j]:
                    centroids[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    top = (1 << 63) - 1
    each = [sum(min(d, top) for d, c in found if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, min(d, top), min(each[c], top), min(sum(each), top), digest[c]) for (i, _), (d, c) in zip(kept, found, strict=True)), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1, "d", "e") for i, v in rows], FIELDS)


def grouped(n, length, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, length))
    return [(i, (centres[rng.integers(5)] + rng.normal(0, spread, length)).tolist()) for i in range(n)]


@pytest.mark.parametrize("k,rounds,length", [(4, 3, 8), (9, 5, 3), (1, 2, 4), (30, 3, 5)])
def test_equals_plain_rounds(spark, k, rounds, length):
    rows = grouped(600, length, k) + [(7, [0.25] * length), (7, [0.25] * length), (None, [0.5] * length)]
    assert got(B.clusters(table(spark, rows), k, rounds, 1, 64, length)) == brute(rows, k, rounds, 1, 64, length)


def test_awkward_vectors(spark):
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 0.0]), (5, [float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0])]
    rows += [(10 + i, [i / 4, -i / 8, 0.0]) for i in range(20)] + [(40, [1e18, -1e18, 3.0]), (41, [1e300, 0.0, 0.0]), (42, [2e7, 1.0, 1.0]), (43, [2e7, 1.5, 1.0]), (10, [0.0, 0.0, 0.0])]
    assert got(B.clusters(table(spark, rows), 6, 3, 1, 64, 3)) == brute(rows, 6, 3, 1, 64, 3)


def test_few_and_no_vectors(spark):
    assert got(B.clusters(table(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]), 16, 3, 1, 64, 2)) == brute([(1, [1.0, 0.0]), (2, [0.0, 1.0])], 16, 3, 1, 64, 2)
    assert B.clusters(table(spark, [(1, None)]), 16, 3, 1, 64, 2).count() == 0


def test_balls_save_comparisons():
    """Clear groups: after the first round most members are in stable cores and meet their own centroid alone."""
    x = np.floor(64 * np.array([v for _, v in grouped(2000, 16, 3, 0.02)]))
    ones = np.zeros(len(x), np.int64)
    centroids = [x[i].astype(int).tolist() for i in range(0, 2000, 125)]
    found, d, met = B.assign(x, ones, B.balls(centroids, None))
    assert met == len(x) * len(centroids)
    moved = [np.floor(x[found == j].mean(0)).astype(int).tolist() if (found == j).any() else c for j, c in enumerate(centroids)]
    radii = [(d[found == j].max() ** 0.5 if (found == j).any() else 0) + B.squared(a, b) ** 0.5 for j, (a, b) in enumerate(zip(centroids, moved, strict=True))]
    again, best, met = B.assign(x, found, B.balls(moved, radii))
    every, want, _ = B.assign(x, ones, B.balls(moved, None))
    assert (again == every).all() and (best == want).all() and met < len(x) * len(centroids) / 2


def test_the_query_equals_its_twin(spark, oracle, rows_of):
    folder = "/root/testdata/sf0.001"
    assert rows_of(registry.QUERIES["op12_ball_kmeans"](spark, folder)) == oracle(registry.ORACLE["op12_ball_kmeans"], folder)
