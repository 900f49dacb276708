"""The position-table n-grams and the draw, against a plain version over whole tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import registry, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, key long, bucket int, n string, w1 string, score string, rank int, total long, before int"


def grams(text, orders=2):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + n]) for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=25, least=20, orders=2, buckets=10_000, seed=7):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    held = [(i, *grams(t, orders)) for i, t in docs]
    s = Counter(bucket(g) for _, _, gs in held for g in gs)
    t = Counter(bucket(g) for x in target for g in grams(x, orders)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (total_s + buckets)) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, w, gs in held:
        weight = sum(gain[bucket(g)] for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = n
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


def rows():
    long = " ".join(f"w{i % 997}" for i in range(40_000))
    texts = [(1, None), (2, ""), (3, " ,.;\n"), (4, "Ärger über DIE Sache, no. 7! " * 9), (5, long), (6, "tie of words " * 10), (7, "tie of words " * 10), (7, "tie of words " * 10), (None, "no id at all " * 8), (8, "x"), (9, "under_score joins not " * 7)]
    return texts + [(100 + i, f"benchmark passage number {i} about rivers and stones " * 4) for i in range(40)]


@pytest.mark.parametrize("orders,percent", [(2, 25), (3, 60), (1, 100)])
def test_equals_the_plain_version(spark, orders, percent):
    docs = spark.createDataFrame([(i, t, 1, 2, "n", "w", "s", 3, 4, 5) for i, t in rows()], DOCS).repartition(3)
    target = ["rivers and stones", None, "", "about rivers, and more"]
    aimed = spark.createDataFrame([(t, 1) for t in target], "text string, key int")
    assert got(resampling.resampled(docs, aimed, percent, orders=orders)) == brute(rows(), target, percent, orders=orders)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(rows(), "doc_id long, text string")
    assert resampling.resampled(none, some).count() == 0
    assert got(resampling.resampled(some, none)) == brute(rows(), [])


def test_the_query_equals_its_twin(spark, oracle, rows_of):
    folder = "/root/testdata/sf0.001"
    assert rows_of(registry.QUERIES["op11_importance_resampling"](spark, folder)) == oracle(registry.ORACLE["op11_importance_resampling"], folder)
