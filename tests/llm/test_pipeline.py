"""The five stages of the corpus pipeline, one by one on awkward tables, and the whole against brute force."""

from collections import Counter

import pytest

import corpus_pipeline
from test_minhash import brute as near_brute
from test_packing_mixing import check_packing, expected_pieces, water_levels
from test_substrings import brute as passage_brute

from tidemark.llm import registry, toxicity

#: The columns of documents, and such as an operator's own names might clash with.
CLASHING = "n_words string, n_removed long, kept_text string, score string, clauses string, key long, text_key string, _nth int, nth int, _key_a string, row string, copy int, repeats int, size string, target string, kept string, rep string, component long, place string, length long, sequence_id long, piece string, copies string, in_1 string, in_lang string, in_0 string, `a.b` string, clause string, y int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
OWN = " ".join(f"o{i}" for i in range(60))
KEEPING = corpus_pipeline.STAGES[:-1]


def row(doc_id, text, source="s", n_chars=None):
    names = [f.rsplit(" ", 1) for f in CLASHING.split(", ")]
    return (doc_id, text, "en", source, n_chars, *("v" if kind == "string" else 3 for _, kind in names))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [row(1, None), row(1, None), row(2, "", n_chars=0), row(3, " \n\t"), row(None, "some words here", None), row(None, None, None)]
    rows += [row(4, "same text in two rows"), row(4, "same text in two rows"), row(5, "one id"), row(5, "and another text"), row(5, None)]
    rows += [row(6, long, "t", len(long)), row(7, f"{passage} the end of it", "t", 1), row(8, f"begin with {passage} {OWN}", None, 1), row(9, "tie a b c d e", "u"), row(10, "tie a b c d e", "u")]
    rows += [row(11, "far" + " " * 1_500_000 + "apart", "u"), row(12, "\n" * 1_500_000, "u")]
    return spark.createDataFrame(rows, DOCS)


def written(spark, df, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stage") / "out")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name, stage", KEEPING)
def test_a_stage_keeps_the_columns_of_awkward_rows(spark, folder, awkward, name, stage):
    out = stage(spark, awkward, folder)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in awkward.schema]
    rows, before = out.collect(), Counter(tuple(r) for r in awkward.collect())
    rest = {tuple(r)[5:] for r in rows}
    assert rest == {tuple(r)[5:] for r in before} and rows
    if name == "toxicity":
        assert Counter(tuple(r) for r in rows) == before
    elif name == "minhash_near_dedup":
        got = sorted((str(r["doc_id"]), r["text"] or "") for r in rows)
        gone = Counter({("10", "tie a b c d e"): 1, ("4", "same text in two rows"): 1})
        assert Counter(got) == Counter((str(r[0]), r[1] or "") for r in before.elements()) - gone
    elif name == "substring_dedup":
        assert len(rows) == sum(before.values())
        changed = {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows if r["doc_id"] == 8}
        assert changed == {8: (f"begin with {OWN}", 11 + len(OWN))}
        assert Counter(tuple(r) for r in rows if r["doc_id"] != 8) == Counter({r: n for r, n in before.items() if r[0] != 8})
    else:
        taken = Counter(tuple(r) for r in rows)
        assert all(taken[r] <= 3 * before[r] for r in taken)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_a_stage_of_an_empty_table(spark, folder, awkward, name, stage):
    assert stage(spark, awkward.limit(0), folder).count() == 0


def test_packing_stage_of_awkward_rows(spark, folder, awkward):
    rows = corpus_pipeline.pack_sequences(spark, awkward, folder).collect()
    check_packing(rows, 1024)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected_pieces([(r["doc_id"], r["text"]) for r in awkward.collect()])


def test_stages_against_brute_force(spark, tmp_path_factory):
    """Each stage on what the one before it kept, over whole tables."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = steps[name] = written(spark, stage(spark, docs, sf), tmp_path_factory)
    assert all(steps[name].columns == columns for name, _ in KEEPING)

    def texts(df):
        return {r["doc_id"]: r["text"] for r in df.collect()}

    every = texts(spark.read.parquet(f"{sf}/documents.parquet"))
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxic_scores(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    clean = texts(steps["toxicity"])
    assert clean == {i: t for i, t in every.items() if not scores[i]}
    unique = texts(steps["minhash_near_dedup"])
    assert unique == {i: clean[i] for i, (_, c) in near_brute(list(clean.items()), 80).items() if i == c}
    cut = texts(steps["substring_dedup"])
    assert {i: " ".join((t or "").split()) for i, t in cut.items()} == {i: kept for i, (_, _, kept) in passage_brute(list(unique.items()), 50).items()}
    mixed = steps["source_mixing"].collect()
    sizes, taken, source = Counter(), Counter(), {r["doc_id"]: r["source"] for r in steps["substring_dedup"].collect()}
    for i, t in cut.items():
        sizes[source[i]] += len((t or "").split())
    for r in mixed:
        assert r["text"] == cut[r["doc_id"]]
        taken[r["source"]] += len((r["text"] or "").split())
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    largest = max(len((t or "").split()) for t in cut.values())
    assert all(abs(taken[s] - t) < largest for s, t in water_levels(sizes).items())
    packed = docs.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == expected_pieces([(r["doc_id"], r["text"]) for r in mixed])
    assert check_packing(packed, 1024) <= 1.02 * sum(r["length"] for r in packed) / 1024 + 1


def test_the_registered_pipeline_runs_all_stages(spark):
    out = registry.QUERIES["pipeline"](spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    check_packing(out.collect(), 1024)
