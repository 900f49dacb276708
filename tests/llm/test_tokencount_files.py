import numpy as np

from test_tokencount import DOCS, counts
from tidemark.llm import tokencount


def test_files_over_the_row_limit_are_read_by_range(spark, tmp_path):
    rng = np.random.default_rng(7)
    lengths = [int(x) for x in rng.integers(0, 900, 400)] + [9000, 0, 3]
    ids = np.array([x for n in lengths for x in [*rng.integers(0, 50, n).tolist(), 50]], "<u2")
    folder = tmp_path / "two words #1"
    folder.mkdir()
    ids.tofile(folder / "a.bin")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        blocks = tokencount.read_flat(spark, str(folder), block_tokens=100)
        out = tokencount.document_lengths(blocks, 50).orderBy("ordinal").collect()
        assert blocks.selectExpr("spark_partition_id() as p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [r["n_tokens"] for r in out] == lengths
    assert [r["ordinal"] for r in out] == list(range(len(lengths)))


def test_documents_are_counted_by_the_scan_of_files(spark, monkeypatch):
    read, scanned = tokencount.read_flat, []
    monkeypatch.setattr(tokencount, "read_flat", lambda s, path, *a: scanned.append(path) or read(s, path, *a))
    rows = [(1, None), (2, ""), (3, "some words"), (3, "other"), (None, "long " * 3000)]
    df = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], DOCS)
    out = tokencount.token_counts(df).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in out} == set(counts(rows)) and len(out) == len(rows)
    assert len(scanned) == 1
