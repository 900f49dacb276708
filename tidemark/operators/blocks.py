"""Ranks of scored items, counted where blocks of scores are made.

A list over all candidates of many queries has queries times items scores. Here they are never rows: a task makes the
scores of a block of queries with a block of items as a matrix, and only counts and heads leave it. The first of a list
are the first of each task's, merged. The rank of any other item is one more than the better ones, added up over the
blocks. What is moved and written grows with the queries, the pairs asked for and the items, not with their product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from threading import Lock

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking as R
from . import similarity as M

#: Items and queries of a block at most, and scores that are held at once: 16 MB.
ITEMS, QUERIES, SCORES = 1 << 15, 256, 1 << 21
#: From a block's columns (lists of one row) a function that gives the scores of some of its queries with all its items.
Scoring = Callable[[dict, int], Callable[[int, int], np.ndarray]]


def _numpy(at: dict, name: str) -> np.ndarray:
    return at[name].flatten().to_numpy(zero_copy_only=False)


def _by_terms(at: dict, size: int):
    words = at["terms"].flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(words.dictionary) + 1))
    item, weight = _numpy(at, "ats")[order], _numpy(at, "weights")[order]
    nth, w = _numpy(at, "ns"), _numpy(at, "ws")
    known = pc.fill_null(pc.index_in(at["asked_terms"].flatten(), value_set=words.dictionary), -1).to_numpy(zero_copy_only=False)

    def scores(low: int, high: int) -> np.ndarray:
        out = np.zeros((high - low, size))
        for i in np.flatnonzero((nth >= low) & (nth < high) & (known >= 0)):
            rows = slice(ends[known[i]], ends[known[i] + 1])
            out[nth[i] - low, item[rows]] += w[i] * weight[rows]
        return out

    return scores


def _by_vectors(at: dict, size: int):
    item, nth, held, asked = _numpy(at, "ats"), _numpy(at, "ns"), at["vectors"].flatten(), at["profiles"].flatten()
    length_i, length_q = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (held, asked))
    matrix = lambda x, some, n: x.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(np.float64)
    items = {n: (item[some], matrix(held, some, n)) for n in np.unique(length_i[length_i > 0]) for some in [np.flatnonzero(length_i == n)]}

    def scores(low: int, high: int) -> np.ndarray:
        out = np.zeros((high - low, size))
        for n, (places, b) in items.items():
            some = np.flatnonzero((nth >= low) & (nth < high) & (length_q == n))
            if len(some):
                out[np.ix_(nth[some] - low, places)] = matrix(asked, some, n) @ b.T
        return out

    return scores


def _whole(scores: np.ndarray) -> np.ndarray:
    """Scores to nine places, halves away from zero, as whole numbers of 1e-9; what is not a number ranks first."""
    out = np.abs(scores)
    out *= 1e9
    out += 0.5
    np.floor(out, out=out)
    np.copysign(out, scores, out=out)
    out[np.isnan(out)] = np.inf
    return out


def _blocks(batches, scoring: Scoring) -> Iterator[tuple[dict, int, int, Iterator[tuple[int, np.ndarray]]]]:
    """(columns, first query of the block, first place, (first query, scores of some queries)...) of each cell."""
    for batch in batches:
        for row in range(batch.num_rows):
            at = dict(zip(batch.schema.names, (column.slice(row, 1) for column in batch.columns), strict=True))
            first, start, size, queries = (at[name][0].as_py() for name in ("first_query", "start", "size", "queries"))
            scores, step = scoring(at, size), max(1, SCORES // size)
            yield at, first, start, ((low, _whole(scores(low, min(low + step, queries)))) for low in range(0, queries, step))


def _first(row: np.ndarray, places: np.ndarray, d: int) -> np.ndarray:
    """Where the d best of a row are, ties by place; places ascend."""
    if len(row) <= d:
        return np.arange(len(row))
    least = np.partition(row, len(row) - d)[len(row) - d]
    above = np.flatnonzero(row > least)
    return np.concatenate([above, np.flatnonzero(row == least)[: d - len(above)]])


def _heads(batches, scoring: Scoring, d: int):
    """(nth, place, score): each query's d best of what a task scores."""
    best, current = {}, None

    def out():
        if best:
            nth = np.repeat(np.fromiter(best, np.int64), [len(p) for p, _ in best.values()]) + current
            place, score = (np.concatenate([kept[i] for kept in best.values()]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(nth), pa.array(place), pa.array(score / 1e9)], names=["nth", "place", "score"])

    for _, first, start, parts in _blocks(batches, scoring):
        if first != current:
            yield from out()
            best, current = {}, first
        for low, scores in parts:
            for q, row in enumerate(scores, low):
                places, had = best.get(q, (np.empty(0, np.int64), np.empty(0)))
                some = np.flatnonzero(row >= had[-1]) if len(had) == d else np.arange(len(row))
                if len(some):
                    some = some[_first(row[some], some, d)]
                    places, had = np.concatenate([places, some + start]), np.concatenate([had, row[some]])
                    order = np.lexsort((places, -had))[:d]
                    best[q] = places[order], had[order]
    yield from out()


def _scored(batches, scoring: Scoring):
    """(nth, place, score) of the pairs asked for, score in whole numbers of 1e-9."""
    for at, first, start, parts in _blocks(batches, scoring):
        nth, place, size = _numpy(at, "pair_ns"), _numpy(at, "pair_places") - start, at["size"][0].as_py()
        inside = (place >= 0) & (place < size)
        nth, place = nth[inside], place[inside]
        for low, scores in parts:
            own = (nth >= low) & (nth < low + len(scores))
            columns = [nth[own].astype(np.int64) + first, place[own] + start, scores[nth[own] - low, place[own]]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["nth", "place", "score"])


def _better(batches, scoring: Scoring):
    """(nth, place, better): of each pair asked for, how many items of what a task scores come before it."""
    nth = place = better = current = None

    def out():
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array(nth.astype(np.int64) + current), pa.array(place), pa.array(better)], names=["nth", "place", "better"])

    for at, first, start, parts in _blocks(batches, scoring):
        if first != current:
            yield from out()
            current, nth = first, _numpy(at, "pair_ns")
            order = np.argsort(nth, kind="stable")
            nth, place, asked = nth[order], _numpy(at, "pair_places")[order], _numpy(at, "pair_scores")[order]
            better = np.zeros(len(nth), np.int64)
        for low, scores in parts:
            ends = np.searchsorted(nth, np.arange(low, low + len(scores) + 1))
            ordered = np.sort(scores, axis=1)
            for row, sorted_row, a, b in zip(scores, ordered, ends[:-1], ends[1:], strict=True):
                score, local = asked[a:b], place[a:b] - start
                upto, below = np.searchsorted(sorted_row, score, "right"), np.searchsorted(sorted_row, score, "left")
                counts = len(row) - upto + np.where(local >= len(row), upto - below, 0)
                for i in np.flatnonzero((local > 0) & (local < len(row)) & (upto - below > 1)):
                    counts[i] += np.count_nonzero(row[: local[i]] == score[i])
                better[a:b] += counts
    yield from out()


@dataclass
class BlockList:
    """A model's ranks of all n candidates `items` (item_id, place: numbered by id from 1), zero scores included, for `queries`
    (query_id, nth, query_block); `asked` are the queries' blocks, `held` the items', both written."""

    items: DataFrame
    n: int
    queries: DataFrame
    asked: DataFrame
    held: DataFrame
    scoring: Scoring
    #: The same list over other candidates (item_id, place).
    over: Callable[[DataFrame], BlockList]
    #: Heads are made so deep at least.
    deep: int = 0
    _head: tuple[int, DataFrame] | None = None
    _lock: Lock = field(default_factory=Lock)

    def _cells(self, work: Callable, schema: str, pairs: DataFrame | None = None, *args) -> DataFrame:
        scoring, asked = self.scoring, self.asked
        if pairs is not None:
            names = [c for c in pairs.columns if c not in ("query_block", "nth")]
            packed = pairs.groupBy("query_block").agg(F.collect_list(F.struct((F.col("nth") % QUERIES).cast("int").alias("n"), *names)).alias("pairs"))
            asked = asked.join(packed.select("query_block", F.col("pairs.n").alias("pair_ns"), *[F.col(f"pairs.{c}").alias(f"pair_{c}s") for c in names]), "query_block")
        blocks = max(1, -(-self.queries.count() // QUERIES))
        cells = self.held.join(asked.repartition(blocks).hint("shuffle_replicate_nl"))
        return cells.mapInArrow(lambda batches: work(batches, scoring, *args), schema)

    def head(self, d: int) -> DataFrame:
        """(query_id, item_id, score, rank) of ranks up to d."""
        with self._lock:
            if self._head is None or self._head[0] < d:
                deepest = max(d, self.deep)
                each = self._cells(_heads, "nth long, place long, score double", None, deepest)
                first = R.first_k(each, deepest, ("nth",), (F.desc("score"), F.asc("place")))
                self._head = deepest, R.written(first.join(self.queries, "nth").join(self.items, "place").select("query_id", "item_id", "score", "rank"))
        return self._head[1].where(F.col("rank") <= d)

    def heads(self, queries: DataFrame, d: int) -> list[DataFrame]:
        return [self.head(d).join(queries, "query_id", "left_semi").select("query_id", "item_id")]

    def heads_among(self, queries: DataFrame, d: int, items: DataFrame, n: int) -> list[DataFrame]:
        """The first d that are in items (item_id, place)."""
        return self.over(items).heads(queries, d)

    def ranks_of(self, pairs: DataFrame, name: str) -> DataFrame:
        """pairs (query_id, item_id), all of them candidates, with their rank under a name."""
        known = pairs if self._head is None else pairs.join(self._head[1].select("query_id", "item_id", F.col("rank").cast("long").alias(name)), ["query_id", "item_id"], "left")
        known = R.written(known if name in known.columns else known.withColumn(name, F.lit(None).cast("long")))
        rest = known.where(F.col(name).isNull()).join(self.queries, "query_id").join(self.items, "item_id")
        rest = R.written(rest.select("query_id", "item_id", "query_block", "nth", "place"))
        if rest.isEmpty():
            return known
        scored = self._cells(_scored, "nth long, place long, score double", rest.select("query_block", "nth", "place"))
        scored = R.written(scored.withColumn("query_block", F.floor(F.col("nth") / QUERIES)))
        better = self._cells(_better, "nth long, place long, better long", scored).groupBy("nth", "place").agg((F.sum("better") + 1).alias(name))
        return known.where(F.col(name).isNotNull()).unionByName(rest.join(better, ["nth", "place"]).select("query_id", "item_id", name))


def _dealt(rows: DataFrame, blocks: DataFrame, key: str, **columns: Column) -> DataFrame:
    """blocks with lists of the rows' columns that have their key."""
    packed = rows.groupBy(key).agg(F.collect_list(F.struct(*[c.alias(n) for n, c in columns.items()])).alias("rows"))
    return blocks.join(packed, key, "left").select(*blocks.columns, *[F.col(f"rows.{n}").alias(n) for n in columns])


def _listed(seeds: DataFrame, items: DataFrame, asked: DataFrame, ask: dict[str, Column], held: DataFrame, hold: dict[str, Column], size: int, scoring: Scoring, over: Callable) -> BlockList:
    """A list for asked rows (query_id, ...) and held rows (item_id, ...), of which columns are packed."""
    spark, n = items.sparkSession, items.count()
    numbered = R.running(seeds.select("query_id").distinct(), [], [F.col("query_id")], nth=F.lit(1))
    queries = R.written(numbered.select("query_id", "nth", F.floor(F.col("nth") / QUERIES).alias("query_block")))
    of_queries = queries.groupBy("query_block").agg((F.first("query_block") * QUERIES).alias("first_query"), F.count(F.lit(1)).alias("queries"))
    asked = _dealt(asked.join(queries, "query_id"), of_queries, "query_block", ns=(F.col("nth") % QUERIES).cast("int"), **ask)
    blocks = -(-n // size)
    of_items = spark.range(blocks).select(F.col("id").alias("block"), (F.col("id") * size + 1).alias("start"), F.least(F.lit(size), F.lit(n) - F.col("id") * size).alias("size"))
    rows = held.join(items, "item_id").withColumn("block", F.floor((F.col("place") - 1) / size))
    held = _dealt(rows, of_items, "block", ats=((F.col("place") - 1) % size).cast("int"), **hold)
    # A file for each block: a block is a long row, and files are read in batches of rows.
    return BlockList(items, n, queries, R.written(asked), R.written(held.repartition(max(1, blocks), "block")), scoring, over)


def by_terms(seeds: DataFrame, postings: DataFrame, items: DataFrame) -> BlockList:
    """The list of seeds (query_id, item_id) over postings (item_id, term, weight), candidates items (item_id, place)."""
    asked = M.profiles(seeds, postings)
    over = lambda others: by_terms(seeds, postings, others)
    ask, hold = {"asked_terms": F.col("term"), "ws": F.col("weight")}, {"terms": F.col("term"), "weights": F.col("weight")}
    return _listed(seeds, items, asked, ask, postings, hold, ITEMS, _by_terms, over)


def by_vectors(seeds: DataFrame, vectors: DataFrame, items: DataFrame) -> BlockList:
    """The list of seeds (query_id, item_id) over vectors (item_id, vector), candidates items (item_id, place)."""
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 1
    over = lambda others: by_vectors(seeds, vectors, others)
    size = max(1, min(ITEMS, 2 * M.ITEM_BLOCK // max(1, longest)))
    return _listed(seeds, items, M.dense_profiles(seeds, vectors), {"profiles": F.col("profile")}, vectors, {"vectors": F.col("vector")}, size, _by_vectors, over)
