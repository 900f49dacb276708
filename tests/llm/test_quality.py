import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import quality, registry
from tidemark.llm.words import mix

DOCS = "doc_id long, text string, lang string, score string, ids string"


def test_machine_equals_the_pairwise_sum():
    rng = np.random.default_rng(0)
    model = {"w0": 0.3, "w": rng.normal(size=50), "v": rng.normal(size=(50, 4))}
    ids, value, at = rng.integers(0, 50, 20), rng.normal(size=20), np.array([0, 7, 8, 20])
    for row, logit in enumerate(quality.machine_scores(model, ids, value, at)):
        i, x = ids[at[row] : at[row + 1]], value[at[row] : at[row + 1]]
        pairs = sum(model["v"][i[a]] @ model["v"][i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert logit == pytest.approx(0.3 + model["w"][i] @ x + pairs)


def test_features_do_not_depend_on_the_batch():
    texts = ["", None, "One two two\nthree", "x" * 100_000, "ÄÖ ü | ***", " \n"]
    ids, value, at = quality.features(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        i, v, a = quality.features(pa.array([t], pa.string()))
        assert ids[at[k] : at[k + 1]].tolist() == i.tolist() and value[at[k] : at[k + 1]].tolist() == v.tolist() and a[-1] == len(i)


def slow_features(text):
    """(feature ids, values) of one text, by the definitions and without arrays."""
    text = text or ""
    raw, words, lines = text.encode(), re.findall(r"[^ \t-\r]+", text.lower()), text.split("\n")
    n, per = max(len(raw), 1), max(len(words), 1)
    letters = max(sum(chr(b).isalpha() and b < 128 for b in raw), 1)
    marks = set(b".,'\"-!?;:()")
    plain = lambda b: b < 128 and (chr(b).isalnum() or chr(b).isspace())
    trigrams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    share = {
        "upper": sum(65 <= b <= 90 for b in raw) / letters,
        "digit": sum(48 <= b <= 57 for b in raw) / n,
        "space": sum(b < 128 and chr(b).isspace() for b in raw) / n,
        "punctuation": sum(b in marks for b in raw) / n,
        "symbol": sum(b < 128 and not plain(b) and b not in marks and b != 124 for b in raw) / n,
        "pipe": raw.count(b"|") / n,
        "other_script": sum(b >= 128 for b in raw) / n,
        "mean_word": sum(map(len, words)) / per / 24,
        "long_word": sum(len(w) > 14 for w in words) / per,
        "distinct_words": len(set(words)) / per,
        "top_word": max(Counter(words).values(), default=0) / per,
        "same_as_previous": sum(a == b for a, b in zip(words, words[1:], strict=False)) / per,
        "distinct_trigrams": len(set(trigrams)) / max(len(words) - 2, 1),
        "distinct_lines": len(set(lines)) / len(lines),
        "short_lines": sum(len(x.encode()) < 30 for x in lines) / len(lines),
        "capital_words": sum(bool(re.match("[A-Z]", w)) for w in re.findall(r"[^ \t-\r]+", text)) / per,
        "ends_in_letter": float(bool(raw) and raw[-1] < 128 and chr(raw[-1]).isalpha()),
    }
    ids = []
    for k, name in enumerate(quality.STATISTICS):
        x = min(max(share[name], 0), 1)
        ids.append(k * quality.BINS + min(quality.BINS - 1, math.floor(math.asin(math.sqrt(x)) / (math.pi / 2) * quality.BINS)))
    for k, x in enumerate((len(raw) / 16, len(words) / 2, len(lines) - 1), len(quality.STATISTICS)):
        ids.append(k * quality.BINS + min(quality.BINS - 1, math.floor(1.5 * math.log2(1 + x))))
    values = [0.25] * len(ids)
    for w in set(words):
        ids.append(int(mix(np.array([xxhash.xxh3_64_intdigest(w.encode())], np.uint64))[0]) % quality.WORD_BUCKETS + quality.FIRST_WORD)
        values.append(1 / math.sqrt(len(set(words))))
    return ids, values


TEXTS = ["", None, "One two two\nthree", "Große Wörter | und *** Zeichen: 12, 34!\n\n", " \n", "a", "The end. The end. The end.\nThe end.", "extraordinarilylongword SHOUT 99% (x)"]


def test_features_and_scores_against_a_slow_version():
    rng = np.random.default_rng(1)
    model = {"w0": 0.1, "w": rng.normal(size=quality.SIZE), "v": rng.normal(size=(quality.SIZE, 3))}
    ids, value, at = quality.features(pa.array(TEXTS, pa.string()))
    scores = quality.machine_scores(model, ids, value, at)
    for k, text in enumerate(TEXTS):
        i, x = slow_features(text)
        got = sorted(zip(ids[at[k] : at[k + 1]].tolist(), np.round(value[at[k] : at[k + 1]], 5).tolist(), strict=True))
        assert got == sorted(zip(i, np.round(np.float32(x), 5).tolist(), strict=True)), text
        pairs = sum(float(model["v"][a] @ model["v"][b]) * y * z for p, (a, y) in enumerate(zip(i, x, strict=True)) for b, z in list(zip(i, x, strict=True))[:p])
        assert scores[k] == pytest.approx(0.1 + sum(model["w"][a] * y for a, y in zip(i, x, strict=True)) + pairs, rel=1e-4)


def test_the_sample_is_bounded_by_its_features(spark, monkeypatch):
    rows = [(i, f"text number {i} " + "more words here " * (i % 5)) for i in range(60)]
    df = spark.createDataFrame([(i, t, None, "s", "c") for i, t in rows], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "calibrated", lambda ids, value, at, y: seen.append((len(ids), len(y))))
    quality.train(df, labels)
    whole = seen[-1]
    assert whole[1] == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(60))
    quality.train(df, labels, most_features=whole[0] // 2)
    assert 0 < seen[-1][0] <= whole[0] // 2 and 0 < seen[-1][1] < whole[1]
    quality.train(df, labels, most_features=0)
    assert seen[-1] == (0, 0)


@pytest.mark.parametrize("sf, most_missed", [("sf0.01", 1), ("sf0.1", 6)])
def test_query_separates_held_out_rows(spark, sf, most_missed):
    """At the threshold of the contract, with few labels and with many."""
    folder = f"/root/testdata/{sf}"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = registry.op8_quality(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    hit = {0: [0, 0], 1: [0, 0]}
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and r["doc_id"] in labels:
            hit[labels[r["doc_id"]]][r["predicted"] == labels[r["doc_id"]]] += 1
    assert hit[1][1] > 0.99 * sum(hit[1]) and hit[0][0] <= most_missed and sum(hit[0]) > 5


def test_few_rows_are_calibrated_on_rows_that_no_machine_has_seen():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["fine", "calm", "river", "stone", "plain"], 30)) + "." for _ in range(60)] + ["!!! $$$ BUY " * int(rng.integers(3, 9)) for _ in range(12)]
    y = np.array([1] * 60 + [0] * 12, np.float32)
    order = rng.permutation(72)
    ids, value, at = quality.features(pa.array([texts[k] for k in order], pa.string()))
    model = quality.calibrated(ids, value, at, y[order])
    assert model["slope"] > 0
    p = 1 / (1 + np.exp(-(model["slope"] * quality.machine_scores(model, ids, value, at) + model["shift"])))
    assert ((p >= 0.3) == (y[order] > 0)).all()
    alone = quality.calibrated(*quality.rows_of(ids, value, at, np.flatnonzero(y[order] > 0)), np.ones(60, np.float32))
    assert (alone["slope"], alone["shift"]) == (1.0, 0.0)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "some text"), (3, "fine words " * 30_000), (4, "x"), (4, "x")]
    df = spark.createDataFrame([(i, t, None, "s", "c") for i, t in rows], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, 0), (4, 1, 0), (4, 0, 0), (None, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        out = quality.quality_scores(df, labels).collect()
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in rows)
        assert all(0 <= r["score"] <= 1 for r in out)
    assert quality.quality_scores(df.limit(0), none).count() == 0
