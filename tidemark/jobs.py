"""The offline jobs as commands: python -m tidemark.jobs catalog | embed | evaluate ..."""

from __future__ import annotations

import argparse
import importlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import MIN_READERS, SOURCES
from .functions import text as X
from .functions import udf as U
from .operators import catalog, evaluation, models
from .operators import popularity as pop
from .operators import ranking as R
from .operators import similarity as M
from .sources import raw, tables

RATES = ("hit_rate", "std_error", "hit_same_author", "hit_other_author", "by_query_author")
PLACES = {"mrr": 4, "coverage": 0, "avg_popularity": 2, "p": 3}


def build_catalog(spark: SparkSession, listed: str, shelf: str | None, out: str) -> DataFrame:
    """Build a catalogue from one source or two, write it with its alias table, and return its report."""
    first = catalog.deduplicated(catalog.keyed(raw.listed_items(spark, listed)))
    if shelf is None:
        merged = catalog.single_source(first)
    else:
        second = R.written(catalog.keyed(raw.shelf_items(spark, shelf)))
        merged = catalog.merged(first, catalog.deduplicated(second))
        tables.write_aliases(catalog.aliases(second), out)
    tables.write_table(catalog.assert_unique(R.written(merged)), out)
    return catalog.report(tables.read_table(spark, out))


def build_vectors(spark: SparkSession, catalog_path: str, make_embedder=lambda: U.hashed_words) -> None:
    """Embed every item's text once, in batches, into the catalogue's cache."""
    items = tables.read_table(spark, catalog_path)
    text = items.select("item_id", X.model_text(F.col("title"), F.col("tags"), F.col("description")).alias("text"))
    tables.write_vectors(U.embed(text, make_embedder), catalog_path)


def evaluate(spark: SparkSession, catalog_path: str, interactions_path: str, n: int = 2000, seed: int = 0, alphas: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> dict[str, DataFrame]:
    """Metric rows of every model on both test sets, and of the hybrid per alpha: {report name: DataFrame}.

    Adds p against tfidf and each model's ms_per_query: the time of its lists, and of the scores, ranks and fused heads
    they are made of, also where other models share these. Items are numbered, as lists are keyed by whole numbers.
    """
    items = tables.read_table(spark, catalog_path)
    numbered = R.written(items.withColumn("nth", F.monotonically_increasing_id()))
    number = numbered.select("item_id", F.col("nth").alias("number"))
    inter = raw.interactions(spark, interactions_path, items, tables.read_aliases(spark, catalog_path))
    rated = R.written(inter.join(number, "item_id").select(F.xxhash64("user_id").alias("user_id"), F.col("number").alias("item_id"), "rating"))
    vectors = tables.cached_vectors(items, catalog_path)
    if vectors is None:
        raise FileNotFoundError(f"no vectors beside {catalog_path}; run the embed job first")
    vectors = R.written(vectors.join(number, "item_id").select(F.col("number").alias("item_id"), "vector"))
    renumbered = numbered.drop("item_id").withColumnRenamed("nth", "item_id")
    text = M.tfidf(renumbered.select("item_id", X.model_text(F.col("title"), F.col("tags"), F.col("description")).alias("text")))
    liked = R.written(evaluation.liked(rated, renumbered.where("has_description")))
    tags = renumbered.select("item_id", F.explode(X.informative_tags(F.col("tags"))).alias("tag"))
    sets = {"all_pairs": evaluation.test_pairs(liked, n, seed), "related_pairs": evaluation.related_pairs(liked, tags, n, seed)}
    out = {}
    for name, chosen in sets.items():
        q = R.written(chosen.select(F.col("user_id").alias("query_id"), "query", "target"))
        hidden = q.select(F.col("query_id").alias("user_id"), F.col("target").alias("item_id"))
        train = R.written(rated.join(hidden, ["user_id", "item_id"], "left_anti"))
        known = R.written(pop.popularity(pop.without_hidden(renumbered, hidden, SOURCES[1]), SOURCES).select("item_id", "author", "popularity", "has_description"))
        known_models = models.standard(known, text, vectors, R.written(M.reader_postings(train)), MIN_READERS)
        made = models.Lists(q.select("query_id", F.col("query").alias("item_id")), 1)
        top, took = made.every(known_models)
        names, readers = list(took), max(1, q.count())
        each = spark.createDataFrame([(m, 1000 * s / readers) for m, s in took.items()], "model string, ms_per_query double")
        rows = evaluation.metrics(top, q, known, names).join(each, "model")
        out[name] = rows.join(evaluation.compared(top, q, "tfidf", names), "model")
        if name == "all_pairs":
            began = time.perf_counter()
            swept = R.written(made.swept(next(m for m in known_models if m.name == "hybrid"), alphas))
            ms = 1000 * (time.perf_counter() - began) / readers
            out[f"{name}_alphas"] = evaluation.metrics(swept, q, known, [f"alpha={a}" for a in alphas]).withColumn("ms_per_query", F.lit(ms))
    return out


def shown(metrics: DataFrame) -> DataFrame:
    """Metric rows for reading: rates in per cent to two places, the rest rounded."""
    rounded = {c: F.round(F.col(c) * 100, 2) for c in RATES} | {c: F.round(c, places) for c, places in PLACES.items()} | {"ms_per_query": F.round("ms_per_query", 1)}
    return metrics.withColumns({c: x for c, x in rounded.items() if c in metrics.columns})


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark.jobs", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    build = jobs.add_parser("catalog", help="build a catalogue and its alias table")
    build.add_argument("listed", help="CSV of the first source")
    build.add_argument("--shelf", help="folder of the second source")
    build.add_argument("--single-source", action="store_true", help="from the first source alone")
    build.add_argument("--out", default="catalog.parquet")
    embed = jobs.add_parser("embed", help="embed a catalogue's texts into its cache")
    embed.add_argument("catalog", nargs="?", default="catalog.parquet")
    embed.add_argument("--embedder", help="module:factory of a callable from texts to vectors; a stand-in without it")
    score = jobs.add_parser("evaluate", help="score every model on hidden pairs")
    score.add_argument("catalog")
    score.add_argument("interactions")
    score.add_argument("--queries", type=int, default=2000)
    score.add_argument("--seed", type=int, default=0)
    score.add_argument("--results", help="folder for one CSV per report")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if given.job == "catalog":
        if not given.single_source and not given.shelf:
            parser.error("--shelf or --single-source is needed")
        build_catalog(spark, given.listed, None if given.single_source else given.shelf, given.out).show()
    elif given.job == "embed":
        module, _, factory = (given.embedder or "").partition(":")
        build_vectors(spark, given.catalog, *([getattr(importlib.import_module(module), factory)] if module else []))
    else:
        for name, rows in evaluate(spark, given.catalog, given.interactions, given.queries, given.seed).items():
            kept = R.written(rows)
            print(name)
            shown(kept).orderBy("model").show(50, truncate=False)
            if given.results:
                tables.write_results(kept.coalesce(1), f"{given.results}/{name}_seed{given.seed}")
    tables.clear_steps(spark)


if __name__ == "__main__":
    main()
