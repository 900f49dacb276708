import math
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import hnsw, kdtree, registry, vectors

ROWS = "vec_id long, embedding array<float>, label int, x string, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], ROWS)


def brute(rows, measure, k=5, every=50, usable=lambda v: True):
    rows = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and usable(v)]
    rows = list({(i, tuple(map(float, np.float32(v)))) for i, v in rows})
    out = {}
    for q, x in rows:
        if q % every == 0:
            scored = sorted((-measure(np.array(x), np.array(y)), i) for i, y in rows if i != q and len(x) == len(y))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def got(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(out)


def product(x, y):
    return sum(int(math.floor(256 * a)) * int(math.floor(256 * b)) for a, b in zip(x.tolist(), y.tolist(), strict=True))


def cosine(x, y):
    return float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())))


@pytest.fixture(scope="module")
def awkward():
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(200)] + [(7, rows[7][1]), (2000, None), (2050, [0.0] * 8), (2100, [math.nan] * 8), (2150, [1.0, None] * 4), (2200, [math.inf] + [1.0] * 7), (None, [1.0] * 8)]
    return rows + [(2250, [2 * x for x in rows[50][1]]), (2300, []), (2350, [3.0e4] * 8)]


def test_top_products(spark, awkward, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 64)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    monkeypatch.setattr(kdtree, "LEAF", 4)
    assert got(kdtree.top_products(frame(spark, awkward))) == brute(awkward, product)


def test_nearest(spark, awkward, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 64)
    want, found = brute(awkward, cosine, usable=any), got(hnsw.nearest(frame(spark, awkward)))
    assert found.keys() == want.keys()
    assert found[50][:4] == [(i, pytest.approx(1)) for i in (1000, 1001, 1002, 1003)]
    hits = sum(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(want[q], found[q]))
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_few_rows(spark):
    for op in (hnsw.nearest, kdtree.top_products):
        assert op(frame(spark, [])).count() == 0
        assert op(frame(spark, [(50, [1.0, 2.0])])).count() == 0
        assert [(r["query_id"], r["vec_id"]) for r in op(frame(spark, [(50, [1.0, 2.0]), (3, [2.0, 1.0])])).collect()] == [(50, 3)]


@pytest.mark.parametrize("name", ["op7_hnsw_neighbours", "op9_kdtree_top_products"])
def test_the_query_matches_sql(spark, oracle, rows_of, name):
    sf = "/root/testdata/sf0.01"
    assert rows_of(registry.QUERIES[name](spark, sf)) == oracle(registry.ORACLE[name], sf)


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, found = brute(rows, cosine, usable=any), got(registry.op7_hnsw_neighbours(spark, sf))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert all(abs(s - cosine(*(np.float64(dict(rows)[v]) for v in (q, i)))) < 1e-12 for q in list(found)[:5] for i, s in found[q])


def test_lengths_apart(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 16)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=(3, 5, 8)[i % 3]).tolist()) for i in range(450)]
    assert got(kdtree.top_products(frame(spark, rows))) == brute(rows, product)
    want, found = brute(rows, cosine), got(hnsw.nearest(frame(spark, rows)))
    assert found.keys() == want.keys()
    assert all(sorted(i for i, _ in want[q]) == sorted(i for i, _ in found[q]) for q in want)


def test_large_products_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "LEAF", 2)
    big = 2.0**19  # floor(256 * x) is 2^27: products from 2^54 on
    wide = "vec_id long, embedding array<double>"
    rows = [(50, [big, 2.0**-8]), (1, [big, 1 / 256]), (2, [big, 2 / 256]), (3, [big, 2 / 256]), (4, [-big, 0.0]), (5, [0.0, 0.0])]
    out = [(r["vec_id"], r["score"]) for r in sorted(kdtree.top_products(spark.createDataFrame(rows, wide)).collect(), key=lambda r: r["rank"])]
    assert out == [(2, 2**54 + 2), (3, 2**54 + 2), (1, 2**54 + 1), (5, 0), (4, -(2**54))]
    # Beyond 64 bits: scores stop at the ends and are ties there.
    rows = [(50, [2.0**60, 1.0]), (1, [2.0**60, 1.0]), (2, [2.0**61, 0.0]), (3, [-(2.0**60), 5.0]), (4, [0.5, 0.0])]
    out = [(r["vec_id"], r["score"]) for r in sorted(kdtree.top_products(spark.createDataFrame(rows, wide)).collect(), key=lambda r: r["rank"])]
    assert out == [(1, 2**63 - 1), (2, 2**63 - 1), (4, 2**63 - 1), (3, -(2**63))]
