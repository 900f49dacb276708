import re
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import components, minhash, registry

DOCS = "doc_id long, text string, source string, rep long, key string"


def shingles(text, width=5):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    by = defaultdict(list)
    for i, s in sets.items():
        by[s].append(i)
    keys = [s for s in by if s]
    root = {s: s for s in keys}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    holders = defaultdict(list)
    for s in keys:
        for x in s:
            holders[x].append(s)
    for s in keys:
        for o in {o for x in s for o in holders[x]}:
            if o is not s and 100 * len(s & o) >= percent * len(s | o):
                root[find(s)] = find(o)
    least = defaultdict(lambda: 1 << 62)
    for s in keys:
        least[find(s)] = min(least[find(s)], *by[s])
    return {i: (len(s), least[find(s)] if s else i) for i, s in sets.items()}


def got(df):
    rows = df.collect()
    for r in rows:
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "k") for i, t in rows], DOCS)


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(registry.op6_minhash_near_dedup(spark, sf)) == brute(rows)


def test_awkward_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base), (3, base.upper()), (5, base + " end"), (1, None), (2, ""), (4, " \t\n"), (6, "one two"), (8, "One  Two"), (7, "one two three")]
    rows += [(20, "a b c d e f " * 5000), (21, "a b c d e f " * 6000), (30, "Ä b c d e"), (31, "ä b c d e")]
    assert got(minhash.near_duplicates(frame(spark, rows))) == brute(rows)
    out = minhash.near_duplicates(frame(spark, [(None, base), (1, base), (1, base)])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in out) == [("1", 1, True), ("1", 1, True), ("None", None, True)]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(frame(spark, rows), percent=50)


@pytest.mark.parametrize("drift", [1, 4])
def test_large_group_of_near_copies(spark, drift, monkeypatch):
    """Copies that each differ from a base, or drift away from one another in a chain."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "FEW", 4)
    rng = np.random.default_rng(drift)
    words = [f"w{i}" for i in range(300)]
    rows, current = [], list(words)
    for k in range(120):
        copy = list(current)
        for at in rng.integers(0, 300, 4 if drift == 1 else 3):
            copy[at] = f"x{k}_{at}"
        if drift > 1 and k % drift == 0:
            current = copy
        rows.append((int(1000 - k), " ".join(copy)))
    rows.append((5000, " ".join(words)))
    assert got(minhash.near_duplicates(frame(spark, rows))) == brute(rows)


def test_query_matches_its_twin(spark, oracle, rows_of):
    sf, name = "/root/testdata/sf0.01", "op6_minhash_near_dedup"
    assert rows_of(registry.QUERIES[name](spark, sf)) == oracle(registry.ORACLE[name], sf)


def test_rows_of_one_id_and_a_hot_group(spark):
    """Texts of one doc_id are linked each by its own; a bucket of 5,000 near copies in which a third of the rows are equal."""
    base = [f"w{i}" for i in range(60)]
    other = " ".join(f"o{i}" for i in range(60))
    rows = [(1, other), (1, "short text of five words"), (1, None), (2, other), (2, "nobody has this text at all"), (3, None)]
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert out == [(1, 0, 1), (1, 1, 1), (1, 56, 1), (2, 2, 2), (2, 56, 1), (3, 0, 3)]
    kept = sorted((r["doc_id"], r["text"] or "") for r in minhash.without_near_duplicates(frame(spark, rows)).collect())
    assert kept == [(1, ""), (1, other), (1, "short text of five words"), (2, "nobody has this text at all"), (3, "")]

    hot = [(10_000 + k, " ".join(base)) for k in range(1_700)]
    hot += [(20_000 + k, " ".join([*base[:-1], f"x{k}"])) for k in range(3_300)]
    found = got(minhash.near_duplicates(frame(spark, hot)))
    assert found == {i: (56, 10_000) for i, _ in hot}


def test_clashing_columns_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    schema = "doc_id long, text string, text_key string, nth int, component_id string, in_2 long, kept string"
    df = spark.createDataFrame([(2, text, "t", 7, "c", 1, "k"), (1, text, "t", 8, "c", 1, "k"), (1, text, "t", 8, "c", 1, "k"), (None, text, None, None, None, None, None), (3, None, "t", 9, "c", 2, "k")], schema)
    out = minhash.without_near_duplicates(df)
    assert out.schema == df.schema
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, text, "t", 8, "c", 1, "k"), (None, text, None, None, None, None, None), (3, None, "t", 9, "c", 2, "k")], key=str)
    assert minhash.without_near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 4)]
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 160)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
