from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import registry, tokencount

DOCS = "doc_id long, text string, block long, file string"


@pytest.mark.parametrize("block, run", [(1, 7), (3, 2), (8, 1), (1000, 1024)])
def test_scan_of_flat_files(spark, tmp_path, monkeypatch, block, run):
    monkeypatch.setattr(tokencount, "RUN_BLOCKS", run)
    rng = np.random.default_rng(block)
    want = Counter()
    for name in ("a", "b", "c", "empty", "tail"):
        lengths = [] if name == "empty" else [int(x) for x in rng.integers(0, 30, 40)] + [0, 0, 200]
        ids = [x for n in lengths for x in [*rng.integers(0, 50, n).tolist(), 50]]
        want.update((n, True) for n in lengths)
        if name == "tail":
            ids += [1, 2, 3]
            want[3, False] += 1
        np.array(ids, "<u4").tofile(tmp_path / f"{name}.bin")
    out = tokencount.document_lengths(tokencount.read_flat(spark, str(tmp_path), "<u4", block), 50, "<u4").collect()
    assert Counter((r["n_tokens"], r["ended"]) for r in out) == want
    for name in ("a", "b", "c"):
        ordinals = sorted(r["ordinal"] for r in out if r["file"].endswith(f"/{name}.bin"))
        assert ordinals == list(range(43))


def counts(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)


@pytest.mark.parametrize("unit", [" ", "\t", "\n", " \n"])
def test_very_long_white_space(spark, unit):
    run = unit * (2_000_000 // len(unit))
    rows = [(1, run), (2, f"a{run}b"), (3, f"one {run}"), (4, "plain")]
    out = tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == counts(rows)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "three word text"), (3, "long " * 70_000), (4, "same"), (4, "same"), (5, "<|endoftext|>")]
    df = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], DOCS)
    out = tokencount.token_counts(df).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == counts(rows)
    assert tokencount.token_counts(df.limit(0)).count() == 0
    small = tokencount.document_lengths(tokencount.flat_blocks(df, block_tokens=2)).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in small) == counts(rows)


def test_query_matches_tokenizers(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter((r["doc_id"], r["n_tokens"]) for r in registry.op5_token_counts(spark, sf).collect()) == counts(rows)
