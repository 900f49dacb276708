"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard.

Each shard's graph is built by one task over a bounded number of vectors and written as flat neighbour arrays,
one row per shard. Queries meet every shard in blocks; each shard returns its best, scored exactly on the
original vectors, and the results are merged.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vectors import best, blocks_of, distinct_vectors, search, shard_ranges, sharded, usable

#: Links per node above the ground layer (twice as many on it), and breadth of search when building and asking.
LINKS, BUILD_BREADTH, ASK_BREADTH = 16, 64, 160
GRAPH = "shard int, dimension int, entry int, ids binary, vectors binary, layers array<binary>"


def _walk(unit: np.ndarray, links: np.ndarray, query: np.ndarray, entries: list[tuple[float, int]], breadth: int, seen: np.ndarray, mark: int) -> list[tuple[float, int]]:
    """Greedy best-first search in one layer: the `breadth` most similar nodes found, best first."""
    for _, e in entries:
        seen[e] = mark
    best_found = list(entries)
    heapq.heapify(best_found)
    frontier = [(-s, e) for s, e in entries]
    heapq.heapify(frontier)
    while frontier:
        s, node = heapq.heappop(frontier)
        if len(best_found) >= breadth and -s < best_found[0][0]:
            break
        near = links[node]
        near = near[near >= 0]
        near = near[seen[near] != mark]
        if not len(near):
            continue
        seen[near] = mark
        sims = unit[near] @ query
        if len(best_found) >= breadth:
            good = sims > best_found[0][0]
            near, sims = near[good], sims[good]
        for sim, e in zip(sims.tolist(), near.tolist(), strict=True):
            if len(best_found) < breadth:
                heapq.heappush(best_found, (sim, e))
            elif sim > best_found[0][0]:
                heapq.heapreplace(best_found, (sim, e))
            else:
                continue
            heapq.heappush(frontier, (-sim, e))
    return sorted(best_found, reverse=True)


def _diverse(unit: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
    """Neighbours nearer to the new node than to any neighbour kept before, then the nearest of the rest."""
    nodes = np.array([e for _, e in found])
    sims = np.array([s for s, _ in found])
    between = unit[nodes] @ unit[nodes].T
    kept: list[int] = []
    closest = np.full(len(nodes), -np.inf)
    for i in range(len(nodes)):
        if sims[i] > closest[i]:
            kept.append(i)
            if len(kept) == most:
                break
            closest = np.maximum(closest, between[i])
    if len(kept) < most:
        chosen = set(kept)
        kept += [i for i in range(len(nodes)) if i not in chosen][: most - len(kept)]
    return nodes[kept].tolist()


def build_graph(shard: int, ids: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
    """Insert the vectors one by one, in an order and with levels that depend on the ids alone.

    A neighbour list has room for half as many links again; when that is full, it is cut back to its size by the
    rule that chose it, so that links to other parts of the graph stay.
    """
    n = len(ids)
    unit = (vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))).astype(np.float32)
    rng = np.random.default_rng(shard)
    levels = np.minimum(6, np.floor(-np.log(rng.random(n)) / np.log(LINKS))).astype(int)
    most = [LINKS * (1 if level else 2) for level in range(levels.max(initial=0) + 1)]
    layers = [np.full((n, m + m // 2), -1, np.int32) for m in most]
    degree = [np.zeros(n, np.int64) for _ in layers]

    def cut_back(level: int, node: int) -> None:
        near = layers[level][node, : degree[level][node]]
        sims = unit[near] @ unit[node]
        order = np.lexsort((near, -sims))
        kept = _diverse(unit, list(zip(sims[order].tolist(), near[order].tolist(), strict=True)), most[level])
        layers[level][node] = -1
        layers[level][node, : len(kept)] = kept
        degree[level][node] = len(kept)

    seen = np.zeros(n, np.int64)
    entry, top, mark = 0, int(levels[0]) if n else 0, 0
    for node in range(1, n):
        query = unit[node]
        found = [(float(unit[entry] @ query), entry)]
        for level in range(top, -1, -1):
            mark += 1
            low = level <= levels[node]
            found = _walk(unit, layers[level], query, found[:1] if not low else found, BUILD_BREADTH if low else 1, seen, mark)
            if not low:
                continue
            links, count = layers[level], degree[level]
            near = _diverse(unit, found, LINKS)
            links[node, : len(near)] = near
            count[node] = len(near)
            for other in near:
                if count[other] == links.shape[1]:
                    cut_back(level, other)
                links[other, count[other]] = node
                count[other] += 1
        if levels[node] > top:
            entry, top = node, int(levels[node])
    for level in range(top + 1):
        for node in np.flatnonzero(degree[level] > most[level]).tolist():
            cut_back(level, node)
    flat = [np.ascontiguousarray(x[:, :m]).tobytes() for x, m in zip(layers[: top + 1], most, strict=False)]
    row = (shard, vectors.shape[1], entry, ids.tobytes(), np.ascontiguousarray(vectors).tobytes(), flat)
    return pd.DataFrame([row], columns=[f.split()[0] for f in GRAPH.split(", ")])


def _summed(products: np.ndarray) -> np.ndarray:
    """Sums along the last axis from left to right, as SQL adds: equal vectors give equal scores in any layout."""
    return np.add.accumulate(products, axis=-1)[..., -1]


def ask(graph, queries, k: int) -> list[tuple[int, int, float]]:
    """The k + 1 most similar classes of a shard per query, with exact cosines in double precision."""
    d = graph.dimension
    ids, vectors = np.frombuffer(graph.ids, np.int64), np.frombuffer(graph.vectors, np.float64).reshape(-1, d)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    unit = (vectors / norms[:, None]).astype(np.float32)
    layers = [np.frombuffer(b, np.int32).reshape(len(ids), -1) for b in graph.layers]
    seen, mark, out = np.zeros(len(ids), np.int64), 0, []
    for q in queries:
        x = np.asarray(q["x"], dtype=np.float64)
        exact = np.sqrt(_summed(x * x))
        query = (x / exact).astype(np.float32)
        found = [(float(unit[graph.entry] @ query), graph.entry)]
        for level in range(len(layers) - 1, -1, -1):
            mark += 1
            found = _walk(unit, layers[level], query, found[:1], 1 if level else ASK_BREADTH, seen, mark)
        near = np.array([e for _, e in found[: 4 * (k + 1)]])
        scores = _summed(vectors[near] * x) / (np.sqrt(_summed(vectors[near] ** 2)) * exact)
        first = np.lexsort((ids[near], -scores))[: k + 1]
        out += [(q["query_id"], int(ids[near[i]]), float(scores[i])) for i in first]
    return out


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): per query the k nearest rows found by cosine.

    Queries are rows whose vec_id is divisible by `every`, candidates all rows of the same length but the query's
    own; ties go to the smaller vec_id, rows equal in id and vector count once. Every row is indexed, equal vectors
    under one node. Vectors that are null, empty or zero, or hold null or non-finite components, take no part.
    """
    rows = materialise(usable(vectors).where(F.exists("x", lambda v: v != 0)))
    classes = materialise(distinct_vectors(rows, k))
    ranges, shards = shard_ranges(classes)
    index = sharded(classes, ranges, shards, build_graph, GRAPH)
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "x").distinct()
    packed = materialise(blocks_of(asked.withColumn("d", F.size("x")).join(ranges, "d").drop("d"), "first", "shards"))
    cells = packed.select(F.explode(F.sequence("first", F.col("first") + F.col("shards") - 1)).alias("shard"), "queries")
    return best(search(index, cells, lambda row, qs: ask(row, qs, k), "double"), classes, k)
