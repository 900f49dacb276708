"""The public query interface: search titles, look items up, recommend.

Arguments are checked on the driver as a caller expects (ValueError, KeyError); results are lazy DataFrames.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import models
from .operators import popularity as pop
from .operators import ranking as R
from .operators import search as S
from .operators import similarity as M
from .sources import raw, tables

MOST_SEEDS, MIN_READERS, ALPHA, BETA = 20, 5, 0.5, 0.2
#: The largest lists that a request may ask for.
MOST_FOUND, MOST_POPULAR, MOST_RECOMMENDED = 20, 100, 50
SOURCES = ("a_popularity", "b_popularity")
CONTENT_MODELS = ("tfidf", "embeddings", "hybrid", "hybrid_popular")
READER_MODELS = ("cf", "hybrid_cf")


class Engine:
    """Models over a catalogue (item_id, title, author, description, tags, has_description, and popularity counts).

    `vectors` (item_id, vector) adds embeddings, hybrid and hybrid_popular; `interactions` (user_id, item_id) adds
    cf and hybrid_cf. Postings and the title index are made at the first request that needs them, once, and written to
    the shared folder.
    """

    def __init__(self, catalog: DataFrame, sources: tuple[str, ...], vectors: DataFrame | None = None, interactions: DataFrame | None = None):
        self.spark = catalog.sparkSession
        items = pop.popularity(catalog, sources)
        self.items = R.written(items.withColumn("text", X.model_text(F.col("title"), F.col("tags"), F.col("description"))))
        self.vectors, self.interactions = vectors, interactions
        self.models = ["popularity", "tfidf"]
        if vectors is not None:
            self.models += ["embeddings", "hybrid", "hybrid_popular"]
        if interactions is not None:
            self.models += ["cf", "hybrid_cf"]

    @cached_property
    def titles(self) -> S.TitleIndex:
        return S.TitleIndex(self.items.select("item_id", "title"))

    @cached_property
    def tfidf(self) -> M.PostingIndex:
        return M.PostingIndex(M.tfidf(self.items.select("item_id", "text")))

    @cached_property
    def cf(self) -> M.PostingIndex:
        return M.PostingIndex(M.reader_postings(self.interactions))

    def model(self, name: str) -> models.Model:
        """A model by name; only what it is made of is built."""
        tfidf = self.tfidf if name != "popularity" else None
        vectors = self.vectors if name in ("embeddings", "hybrid", "hybrid_popular") else None
        cf = self.cf if name in READER_MODELS else None
        return next(m for m in models.standard(self.items, tfidf, vectors, cf, MIN_READERS, ALPHA, BETA) if m.name == name)

    # --- look-ups ---------------------------------------------------------------------------------------------

    def get(self, item_id, full: bool = False) -> dict:
        """One item's fields; `full` adds the whole description and the tags. KeyError if unknown."""
        row = self._shown(self.items.where(F.col("item_id") == item_id), full).first()
        if row is None:
            raise KeyError(item_id)
        return row.asDict()

    def popular(self, k: int = 10) -> DataFrame:
        """The k (1 to 100) most popular items."""
        _within("k", k, MOST_POPULAR)
        best = R.rounded(self.items.select(F.lit(1).alias("query_id"), "item_id", F.col("popularity").alias("score"))).orderBy(*R.best()).limit(k)
        return self._results(R.top_k(best, k))

    def search_titles(self, query: str, n: int = 5) -> tuple[str, list[dict]]:
        """('match', [item]), ('did_you_mean', items) or ('not_found', []); n is 1 to 20."""
        _within("n", n, MOST_FOUND)
        if not 1 <= len(query) <= 200:
            raise ValueError("a title has 1 to 200 characters")
        rows = S.search(self.items.select("item_id", "title", "author", "has_description", "popularity"), query, n, self.titles).orderBy("rank").collect()
        if not rows:
            return "not_found", []
        return rows[0]["status"], [{"item_id": r["item_id"], "title": r["title"], "author": r["author"], "match": round(r["match"], 3)} for r in rows]

    # --- recommendations --------------------------------------------------------------------------------------

    def recommend(self, item_ids: list, model: str = "popularity", k: int = 10) -> DataFrame:
        """The k (1 to 50) best items for 1 to 20 seeds: item_id, title, author, description, score, rank."""
        _within("k", k, MOST_RECOMMENDED)
        ids = list(dict.fromkeys(item_ids))
        if model not in self.models:
            raise ValueError(f"no model {model!r}; there are {sorted(self.models)}")
        if not 1 <= len(ids) <= MOST_SEEDS:
            raise ValueError(f"1 to {MOST_SEEDS} items are needed, not {len(ids)}")
        known = {r[0] for r in self.items.where(F.col("item_id").isin(ids)).select("item_id").collect()}
        if unknown := [i for i in ids if i not in known]:
            raise KeyError(unknown)
        if model in CONTENT_MODELS:
            self._need(self.tfidf, ids, "has text")
        if model in READER_MODELS:
            self._need(self.cf, ids, "has readers")
        return self._results(self._top(model, ids, k))

    def recommend_by_title(self, title: str, model: str = "popularity", k: int = 10) -> tuple[str, object]:
        """('match', DataFrame), or the status and suggestions of the search."""
        status, found = self.search_titles(title)
        return (status, self.recommend([found[0]["item_id"]], model, k)) if status == "match" else (status, found)

    def _seeds(self, ids: list) -> DataFrame:
        kind = self.items.schema["item_id"].dataType.simpleString()
        return self.spark.createDataFrame([(1, i) for i in ids], f"query_id int, item_id {kind}")

    def _top(self, model: str, ids: list, k: int) -> DataFrame:
        """(query_id, item_id, score, rank) of a model for one query, seeds left out."""
        return models.Lists(self._seeds(ids), len(ids)).top(self.model(model), k)

    def _need(self, postings: M.PostingIndex, ids: list, what: str) -> None:
        asked = self._seeds(ids)
        if postings.of("item_id", asked).join(asked, "item_id", "left_semi").isEmpty():
            raise ValueError(f"none of the items {what}")

    def _shown(self, rows: DataFrame, full: bool = False) -> DataFrame:
        text = F.col("description") if full else X.snippet(F.col("description")).alias("description")
        return rows.select("item_id", "title", "author", text, *(["tags"] if full else []), *[c for c in ("score", "rank") if c in rows.columns])

    def _results(self, top: DataFrame) -> DataFrame:
        shown = top.select("item_id", F.round("score", 4).alias("score"), "rank")
        return self._shown(shown.join(self.items, "item_id")).orderBy("rank")


def _within(name: str, value: int, most: int) -> None:
    if not 1 <= value <= most:
        raise ValueError(f"{name} is 1 to {most}, not {value}")


def open_engine(spark: SparkSession, catalog_path: str, interactions_path: str | None = None) -> Engine:
    """The engine of a built catalogue: with vectors if its cache exists, with readers if interactions are given."""
    catalog = tables.read_table(spark, catalog_path)
    inter = None
    if interactions_path:
        inter = raw.interactions(spark, interactions_path, catalog, tables.read_aliases(spark, catalog_path))
    return Engine(catalog, SOURCES, tables.cached_vectors(catalog, catalog_path), inter)
