"""Cleaners by example, and the engine's answers and errors on a small catalogue."""

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions import text as X
from tidemark.functions import udf as U
from tidemark.operators import catalog, evaluation, popularity
from tidemark.sources import tables

CASES = [
    (X.normalize_title, "The Lamplighter of Quay Street (Harbour Tales, #4)", "lamplighter of quay street"),
    (X.normalize_title, "Salt & the Miller's Daughter: Collected", "salt and the millers daughter"),
    (X.normalize_title, "Café Straße", "cafe strasse"),
    (X.normalize_title, "The", "the"),
    (X.normalize_title, "A An Thing", "an thing"),
    (X.normalize_title, ": sub only", None),
    (X.normalize_title, "[note]", None),
    (X.normalize_title, None, None),
    (X.display_author, "Varga, M.E.", "M.E. Varga"),
    (X.display_author, "Okoro, Jr.", "Okoro Jr."),
    (X.author_key, "M. E. Varga", "varga_m"),
    (X.author_key, "Varga, M.E.", "varga_m"),
    (X.author_key, "Quillon", "quillon"),
    (X.author_key, "Brand#12", "brand"),
    (X.first_author_by_comma, "M.E. Varga, Petra Lind (Editor)", "M.E. Varga"),
    (X.first_author_by_comma, "Ann Lee (Editor, Translator)", "Ann Lee (Editor"),
    (X.first_author_by_semicolon, "Varga, M.E.; Lind, P.", "M.E. Varga"),
    (X.is_english, " EN ", True),
    (X.is_english, None, True),
    (X.is_english, "fr", False),
    (X.clean_description, "x" * 49, None),
    (X.clean_description, "x" * 50, "x" * 50),
    (X.list_literal, "['a', \"b's\"]", ["a", "b's"]),
    (X.list_literal, "oops", []),
    (X.list_literal, None, []),
    (U.any_list_literal, "['a', 1]", ["a", "1"]),
    (U.any_list_literal, " [ 'it\\'s', \"two, 'three'\", -2.50, None, True, ] ", ["it's", "two, 'three'", "-2.5", "None", "True"]),
    (U.any_list_literal, "['a' 'b']", ["ab"]),
    (U.any_list_literal, "[['a'], 'b']", ["['a']", "b"]),
    (U.any_list_literal, "[u'a', r'\\n', ('x', 1), {'k': [2]}, -1.5]", ["a", "\\n", "('x', 1)", "{'k': [2]}", "-1.5"]),
    (U.any_list_literal, "['a', f()]", []),
    (U.any_list_literal, "['a'] + ['b']", []),
    (U.any_list_literal, "['a', b]", []),
    (U.any_list_literal, "{'a': 1}", []),
    (U.any_list_literal, "[]", []),
    (U.any_list_literal, None, []),
    (U.fold_any, "ÉCOLE Straße Ώ ﬁn", "ecole strasse ω fin"),
    (U.fold_any, None, None),
    (X.count_or_zero, "12.9", 12),
    (X.count_or_zero, "many", 0),
    (X.edition_year, "09/14/21", 1921),
    (X.edition_year, "January 2004", 2004),
    (X.snippet, "ab " * 101, ("ab " * 100).rstrip() + "…"),
]


@pytest.mark.parametrize("f, given, wanted", CASES)
def test_cleaners(spark, f, given, wanted):
    got = spark.createDataFrame([(given,)], "x string").select(f(F.col("x"))).first()[0]
    assert got == wanted


def test_percentile_shares_ranks_between_ties(spark):
    rows = spark.createDataFrame(list(enumerate([0, 1, 1, 2, 5])), "item_id int, n int")
    got = {r["item_id"]: r["p"] for r in popularity.percentile(rows, "n", "p").collect()}
    assert got == {0: None, 1: 0.375, 2: 0.375, 3: 0.75, 4: 1.0}
    wide = [1e-9, 2.5, float("nan"), 2.5, -1.0, 1e12, None, 0.0, 2.500001, 7e11]
    ranks = {r["item_id"]: r["p"] for r in popularity.percentile(spark.createDataFrame(list(enumerate(wide)), "item_id int, x double"), "x", "p").collect()}
    assert ranks == {0: 1 / 6, 1: 2.5 / 6, 2: None, 3: 2.5 / 6, 4: None, 5: 1.0, 6: None, 7: None, 8: 4 / 6, 9: 5 / 6}
    with pytest.raises(ValueError):
        popularity.popularity(rows, ("n",), "sum")
    with pytest.raises(KeyError):
        popularity.popularity(rows, ("m",))


def test_paired_test():
    assert evaluation.mcnemar_p(10, 4) == pytest.approx(0.181449, abs=1e-6)
    assert evaluation.mcnemar_p(1, 1) == pytest.approx(0.479500, abs=1e-6)
    assert evaluation.mcnemar_p(0, 0) == 1


def test_text_tables_keep_words_like_na_and_drop_empty_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,n\n1,NA,3\n2,"",x\n')
    rows = tables.read_text_table(spark, str(tmp_path / "a.csv"), ["id", "name", "n"], {"n": "int"}).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "NA", 3), ("2", None, None)]
    with pytest.raises(KeyError):
        tables.read_text_table(spark, str(tmp_path / "a.csv"), ["id", "author"])
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none.parquet"))


def test_duplicates_without_a_key_stay_and_unique_ids_are_enforced(spark):
    rows = spark.createDataFrame([(1, "k", 2), (2, "k", 5), (3, "k", 5), (4, None, 1), (4, None, 1)], "item_id int, key string, popularity int")
    kept = catalog.deduplicated(rows)
    assert sorted(r["item_id"] for r in kept.collect()) == [2, 4, 4]
    with pytest.raises(ValueError):
        catalog.assert_unique(kept)
    assert {tuple(r) for r in catalog.aliases(rows).collect()} == {(1, 2), (2, 2), (3, 2)}


@pytest.fixture(scope="module")
def engine(spark):
    words = ["dragon castle", "dragon river", "castle river", "kitchen garden", "garden soup", "soup kitchen"]
    items = spark.createDataFrame(
        [(str(i), f"Volume {w}", f"Author {i % 2}", f"{w} story", ["tale"], i != 5, i) for i, w in enumerate(words)],
        "item_id string, title string, author string, description string, tags array<string>, has_description boolean, n int",
    )
    vectors = spark.createDataFrame([(str(i), [float(i < 3), float(i >= 3), i / 10]) for i in range(6)], "item_id string, vector array<double>")
    reads = spark.createDataFrame([(u, str(i)) for u in range(6) for i in range(3 if u < 5 else 1)], "user_id int, item_id string")
    return Engine(items, ("n",), vectors, reads)


@pytest.mark.parametrize("model", ["popularity", "tfidf", "embeddings", "hybrid", "hybrid_popular", "cf", "hybrid_cf"])
def test_models_never_return_a_seed(engine, model):
    rows = engine.recommend(["0", "0"], model, 9).collect()
    assert rows and "0" not in {r["item_id"] for r in rows}
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    if model not in ("popularity",):
        assert "5" not in {r["item_id"] for r in rows}


def test_requests_are_checked(engine):
    with pytest.raises(ValueError):
        engine.recommend([])
    with pytest.raises(ValueError):
        engine.recommend([str(i) for i in range(21)])
    with pytest.raises(ValueError):
        engine.recommend(["0"], "magic")
    with pytest.raises(KeyError):
        engine.recommend(["99"])
    with pytest.raises(KeyError):
        engine.get("99")
    with pytest.raises(ValueError):
        engine.recommend(["4"], "cf")
    assert engine.get("3", full=True)["tags"] == ["tale"]
    for k in (0, 51):
        with pytest.raises(ValueError):
            engine.recommend(["0"], k=k)
    for k in (0, 101):
        with pytest.raises(ValueError):
            engine.popular(k)
    for n in (0, 21):
        with pytest.raises(ValueError):
            engine.search_titles("volume", n)
    for title in ("", "x" * 201):
        with pytest.raises(ValueError):
            engine.search_titles(title)
    shown = engine.recommend(["0"], "popularity", 2).collect()
    assert [(r["item_id"], r["title"], r["author"], r["rank"]) for r in shown] == [("5", "Volume soup kitchen", "Author 1", 1), ("4", "Volume garden soup", "Author 0", 2)]
    assert all(round(r["score"], 4) == r["score"] for r in shown)


def test_titles(engine):
    status, found = engine.search_titles("volume dragon castle")
    assert status == "match" and found[0]["item_id"] == "0"
    assert engine.search_titles("zzz qqq") == ("not_found", [])
    status, found = engine.search_titles("volume dragon")
    assert status == "did_you_mean" and len(found) > 1
    status, rows = engine.recommend_by_title("Volume Dragon Castle", "tfidf", 2)
    assert status == "match" and rows.count() == 2
