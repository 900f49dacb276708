"""From raw files to a catalogue, vectors, an engine and an evaluation, by the jobs and their commands."""

import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.engine import open_engine
from tidemark.functions import udf as U
from tidemark.operators import evaluation, profiling
from tidemark.operators import similarity as M
from tidemark.plans.queries import QUERIES
from tidemark.sources import raw, tables

LONG = "a description that is long enough to be kept as one, number {} of the lot of them"
SUBJECTS = ["sea stories", "mountains", "cookery", "gardens"]


def write(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows([header, *rows])


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base = tmp_path_factory.mktemp("raw")
    rng = random.Random(2)
    listed = [
        ("10", "Harbour Lights, a Novel", "Ann Lee, Bo Chu (Editor)", LONG.format(1), "['Fiction', 'Sea']", "40", "English"),
        ("10", "a second row of the id", "Nobody", "", "[]", "1", "English"),
        ("11", "Harbour Lights, a novel", "Ann Lee", "too short", "oops", "7", "en"),
        ("12", "Phares du port", "Ann Lee", LONG.format(2), "[]", "99", "French"),
        ("13", 'A "quoted"\ntitle', "Dee Ito", "", "", "many", ""),
    ]
    write(base / "listed.csv", raw.LISTED, listed)
    shelf = base / "shelf"
    shelf.mkdir()
    items = [("w1", "Harbour Lights, a Novel", "a1", "No description available", "en"), ("w2", "Harbour lights, a novel", "a1", LONG.format(3), "eng"), ("w3", "Autre", "a2", LONG.format(4), "fr")]
    items += [(f"w{i}", f"Tale {chr(97 + i % 26)}{chr(97 + i // 26)} of the {rng.choice(SUBJECTS)}", "a2", LONG.format(i), "en") for i in range(4, 40)]
    write(shelf / "books.csv", raw.ITEMS, items)
    write(shelf / "authors.csv", raw.AUTHORS, [("a1", "Lee, Ann; Chu, Bo"), ("a2", "Ito, Dee")])
    write(shelf / "books_to_subjects.csv", raw.SUBJECTS, [("w1", "[NO_SUBJECT]"), ("w1", "Sea"), *((f"w{i}", SUBJECTS[i % 4]) for i in range(4, 40))])
    reads = [("u1", "w1", "8"), ("u1", "w1", "9"), ("u1", "w2", "3"), ("u2", "w2", "x"), ("u3", "gone", "9")]
    reads += [(f"r{u}", f"w{i}", str(rng.randint(5, 10))) for u in range(30) for i in rng.sample(range(4, 40), 12)]
    write(shelf / "interactions.csv", ["user_id", "work_id", "rating"], reads)
    return base


@pytest.fixture(scope="module")
def built(spark, files):
    path = str(files / "out" / "catalog.parquet")
    return path, jobs.build_catalog(spark, str(files / "listed.csv"), str(files / "shelf"), path).first().asDict()


def test_the_catalogue_of_two_sources(spark, files, built):
    path, report = built
    rows = {r["item_id"]: r for r in tables.read_table(spark, path).collect()}
    # The two listed rows and the two shelf rows of one book are one item; the most popular of each stands for it.
    assert report == {"items": 38, "in_a": 2, "in_b": 37, "matched": 1, "described": 37}
    one = rows["w2"]
    assert (one["a_id"], one["title"], one["author"], one["description"], one["a_popularity"], one["b_popularity"]) == ("10", "Harbour Lights, a Novel", "Ann Lee", LONG.format(1), 40, 2)
    assert one["tags"][:2] == ["fiction", "sea"]
    assert (rows["a:13"]["title"], rows["a:13"]["a_popularity"], rows["a:13"]["has_description"]) == ('A "quoted"\ntitle', 0, False)
    aliases = {tuple(r) for r in tables.read_aliases(spark, path).collect()}
    assert {("w1", "w2"), ("w2", "w2")} <= aliases
    inter = raw.interactions(spark, str(files / "shelf" / "interactions.csv"), tables.read_table(spark, path), tables.read_aliases(spark, path))
    assert sorted(tuple(r) for r in inter.where("item_id = 'w2'").collect()) == [("u1", "w2", 8.0), ("u2", "w2", None)]
    assert inter.where("user_id = 'u3'").isEmpty()


def test_a_single_source_has_the_same_layout(spark, files, built):
    path = str(files / "out" / "single.parquet")
    jobs.main(["catalog", str(files / "listed.csv"), "--single-source", "--out", path])
    rows = tables.read_table(spark, path)
    assert rows.schema == tables.read_table(spark, built[0]).schema
    assert sorted(r["item_id"] for r in rows.collect()) == ["a:10", "a:13"]
    assert tables.read_aliases(spark, path).isEmpty()
    with pytest.raises(SystemExit):
        jobs.main(["catalog", str(files / "listed.csv")])


def test_vectors_are_cached_and_checked(spark, files, built, tmp_path):
    path = built[0]
    items = tables.read_table(spark, path)
    assert tables.cached_vectors(items, str(files / "out" / "single.parquet")) is None
    jobs.main(["embed", path])
    vectors = tables.cached_vectors(items, path)
    assert vectors.count() == items.count() and tables.beside(path, "vectors").endswith("/catalog_vectors.parquet")
    with pytest.raises(ValueError):
        tables.cached_vectors(items.where("item_id <> 'w2'"), path)


def test_the_opened_engine_and_the_evaluation(spark, files, built):
    path, reads = built[0], str(files / "shelf" / "interactions.csv")
    jobs.build_vectors(spark, path)
    engine = open_engine(spark, path, reads)
    assert sorted(engine.models) == ["cf", "embeddings", "hybrid", "hybrid_cf", "hybrid_popular", "popularity", "tfidf"]
    assert open_engine(spark, path).models == ["popularity", "tfidf", "embeddings", "hybrid", "hybrid_popular"]
    assert [r["rank"] for r in engine.recommend(["w5"], "hybrid_cf", 3).collect()] == [1, 2, 3]
    reports = jobs.evaluate(spark, path, reads, n=25, seed=1)
    assert list(reports) == ["all_pairs", "all_pairs_alphas", "related_pairs"]
    rows = {r["model"]: r for r in reports["all_pairs"].collect()}
    assert rows.keys() == set(engine.models) and rows["tfidf"]["p"] == 1 and rows["cf"]["n"] == 25
    assert rows["cf"]["p"] == pytest.approx(evaluation.mcnemar_p(rows["cf"]["only_model"], rows["cf"]["only_reference"]))
    alphas = {r["model"]: r for r in reports["all_pairs_alphas"].collect()}
    assert alphas.keys() == {f"alpha={a}" for a in (0.0, 0.25, 0.5, 0.75, 1.0)}
    assert alphas["alpha=0.5"]["hit_rate"] == pytest.approx(rows["hybrid"]["hit_rate"])
    shown = {r["model"]: r for r in jobs.shown(reports["all_pairs"]).collect()}
    assert shown["cf"]["hit_rate"] == pytest.approx(round(100 * rows["cf"]["hit_rate"], 2)) and shown["cf"]["ms_per_query"] > 0
    results = str(files / "results")
    jobs.main(["evaluate", path, reads, "--queries", "10", "--results", results])
    again = spark.read.option("header", True).csv(f"{results}/all_pairs_seed0")
    assert again.count() == 7 and {"model", "hit_rate", "p"} <= set(again.columns)


def test_text_tables_prune_columns(spark, files):
    path = str(files / "listed.csv")
    plan = tables.read_text_table(spark, path, ["bookId", "title"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<bookId:string,title:string>" in plan
    assert tables.read_text_table(spark, path, []).columns == raw.LISTED


def test_embedding_query_equals_the_embedder(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["item_id"]: r["vector"] for r in QUERIES["embed_batch"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    want = U.hashed_words([t[:1500] for t in texts.values()]).astype(np.float32)
    assert all(np.array_equal(np.array(got[i], np.float32), w) for i, w in zip(texts, want, strict=True))


def test_many_dense_queries_go_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i), 1.0]) for i in range(20)] + [(20, [1.0, 2.0, 3.0]), (21, [])]
    vectors = spark.createDataFrame(rows, "item_id long, vector array<float>")
    asked = vectors.selectExpr("item_id as query_id", "cast(vector as array<double>) as profile")
    want = {(a, b): sum(x * y for x, y in zip(u, v, strict=True)) for a, u in rows for b, v in rows if len(u) == len(v) > 0}
    for queries, items in ((1 << 20, 1 << 20), (6, 10), (1 << 20, 4)):
        monkeypatch.setattr(M, "QUERY_BLOCK", queries)
        monkeypatch.setattr(M, "ITEM_BLOCK", items)
        out = M.dense_similar(asked, vectors).collect()
        assert {(r["query_id"], r["item_id"]): r["score"] for r in out} == want and len(out) == len(want)
    assert M.dense_similar(asked.limit(0), vectors).count() == 0 and M.dense_similar(asked, vectors.limit(0)).count() == 0


def test_profiles_by_example(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), (None, None), ("c", 9)], "k string, n int")
    assert {tuple(r) for r in profiling.top_and_other(df, "k", 2).collect()} == {("a", 2), (None, 1), ("Other", 2)}
    assert profiling.described(df, F.col("n"), half=0.5).first().asDict() == {"n": 4, "mean": 4.25, "low": 1, "half": 3.5, "high": 9}
    assert tuple(profiling.repeats(df, k=("k",), both=("k", "n")).first()) == (2, 1)
    assert tuple(profiling.counts_where(df, no_k=F.col("k").isNull(), big=F.col("n") > 4).first()) == (1, 2)
    assert {tuple(r) for r in profiling.crosstab(df.where("k is not null"), "k", "n", [1, 5]).collect()} == {("a", 1, 0), ("b", 0, 1), ("c", 0, 0)}
    assert profiling.value_counts(df, "k").where("k = 'a'").first()["n"] == 2
    assert df.agg(profiling.share_of(F.col("n") > 1)).first()[0] == pytest.approx(0.6)
