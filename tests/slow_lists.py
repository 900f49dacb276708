"""The slow version of the lists: each query scored against the whole catalogue in arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


class Postings:
    """Items as sparse rows, and the items of each term; items outside `ids` are left out."""

    def __init__(self, postings: DataFrame, ids: np.ndarray):
        t = postings.select("item_id", "term", "weight").toArrow()
        item = t["item_id"].to_numpy()
        place = np.searchsorted(ids, item)
        known = ids[np.minimum(place, len(ids) - 1)] == item if len(ids) else np.zeros(len(item), bool)
        place, weight = place[known], t["weight"].to_numpy()[known]
        term = t["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[known]
        self.by_item, self.by_term = self._dealt(place, term, weight, len(ids)), self._dealt(term, place, weight, int(term.max(initial=-1)) + 1)
        self.terms = np.diff(self.by_item[0])

    @staticmethod
    def _dealt(key, other, weight, n):
        order = np.lexsort((other, key))
        return np.searchsorted(key[order], np.arange(n + 1)), other[order], weight[order]

    def scores(self, seed: int) -> np.ndarray:
        out = np.zeros(len(self.terms))
        at, terms, weights = self.by_item
        start, items, item_weights = self.by_term
        for k in range(at[seed], at[seed + 1]):
            rows = slice(start[terms[k]], start[terms[k] + 1])
            out[items[rows]] += weights[k] * item_weights[rows]
        return out


class Catalogue:
    """items (item_id, popularity, has_description), postings of texts and readers, and vectors, as arrays by item_id."""

    def __init__(self, items: DataFrame, tfidf: DataFrame, vectors: DataFrame, cf: DataFrame, least_readers: int = 5):
        t = items.select("item_id", "popularity", "has_description").toArrow().sort_by("item_id")
        self.ids, self.popularity = t["item_id"].to_numpy(), t["popularity"].to_numpy()
        self.content = t["has_description"].to_numpy(zero_copy_only=False).astype(bool)
        self.tfidf, self.cf = Postings(tfidf, self.ids), Postings(cf, self.ids)
        self.supported = self.content & (self.cf.terms >= least_readers)
        known = vectors.join(items.select("item_id"), "item_id", "left_semi").select("item_id", "vector").toArrow()
        rows = np.array(known["vector"].to_pylist(), dtype=np.float64).reshape(len(known), -1)
        self.vectors = np.zeros((len(self.ids), rows.shape[1]))
        self.vectors[np.searchsorted(self.ids, known["item_id"].to_numpy())] = rows

    def lists(self, item_id: int, k: int, alphas: tuple[float, ...] | None = None):
        """(model, places, scores) of each model, or of the text and vector blend per alpha, for one seed."""
        seed = int(np.searchsorted(self.ids, item_id))
        if seed == len(self.ids) or self.ids[seed] != item_id:
            return
        score = {"tfidf": np.round(self.tfidf.scores(seed), 9), "embeddings": np.round(self.vectors @ self.vectors[seed], 9)}
        text, dense = _ranks(score["tfidf"], self.content), _ranks(score["embeddings"], self.content)
        if alphas is not None:
            for a in alphas:
                yield f"alpha={a}", *_best(_fused(text, dense, a), _but(self.content, seed), k)
            return
        score["cf"] = np.round(self.cf.scores(seed), 9)
        for model, allowed in (("tfidf", self.content), ("embeddings", self.content), ("cf", self.supported)):
            yield model, *_best(score[model], _but(allowed, seed) & (score[model] > 0), k)
        everything = np.ones(len(self.ids), bool)
        yield "popularity", *_best(np.round(self.popularity, 9), _but(everything, seed), k)
        hybrid = _fused(text, dense, 0.5)
        yield "hybrid", *_best(hybrid, _but(self.content, seed), k)
        places, base = _best(hybrid, _but(self.content, seed), 200)
        if len(places):
            blend = np.full(len(self.ids), -np.inf)
            blend[places] = np.round(0.8 * (base - base.min()) / (base.max() - base.min() + 1e-12) + 0.2 * self.popularity[places], 9)
            yield "hybrid_popular", *_best(blend, np.isfinite(blend), k)
        yield "hybrid_cf", *_best(_fused(text, _ranks(score["cf"], self.supported), 0.5), _but(self.supported, seed), k)


def _but(allowed: np.ndarray, seed: int) -> np.ndarray:
    out = allowed.copy()
    out[seed] = False
    return out


def _ranks(scores: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The rank of every allowed item, ties by id; seeds and zero scores included."""
    places = np.flatnonzero(allowed)
    ranks = np.zeros(len(scores))
    ranks[places[np.argsort(-scores[places], kind="stable")]] = np.arange(1, len(places) + 1)
    return ranks


def _fused(first: np.ndarray, second: np.ndarray, alpha: float, k: int = 60) -> np.ndarray:
    return np.round(alpha / (k + first) + (1 - alpha) / (k + second), 9)


def _best(scores: np.ndarray, allowed: np.ndarray, k: int):
    places = np.flatnonzero(allowed)
    places = places[np.argsort(-scores[places], kind="stable")[:k]]
    return places, scores[places]


def lists(catalogue: Catalogue, queries: list[tuple[int, int]], k: int = 10, alphas: tuple[float, ...] | None = None) -> list[tuple]:
    """(model, query_id, item_id, score, rank) for queries (query_id, item_id)."""
    out = []
    for query_id, item_id in queries:
        for model, places, scores in catalogue.lists(item_id, k, alphas):
            out += [(model, query_id, int(catalogue.ids[p]), float(s), n) for n, (p, s) in enumerate(zip(places, scores, strict=True), 1)]
    return sorted(out)
