import re
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import registry, substrings

DOCS = "doc_id long, text string, source string, first long, anchor string, start string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "k", "z") for i, t in rows], DOCS)


def brute(rows, width):
    words = {i: re.findall(r"[^ \t-\r]+", t or "") for i, t in rows}
    least = defaultdict(lambda: 1 << 62)
    for i, w in words.items():
        for k in range(len(w) - width + 1):
            least[tuple(w[k : k + width])] = min(least[tuple(w[k : k + width])], i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def got(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()}


@pytest.mark.parametrize("width", [6, 50])
def test_shared_passages_anywhere(spark, width):
    rng = np.random.default_rng(width)
    words = [f"w{i}" for i in range(4000)]
    line = [f"common{i}" for i in range(width + 3)]
    rows = []
    for i in range(60):
        text = list(rng.choice(words, int(rng.integers(0, 6 * width))))
        for _ in range(3):
            at, n = int(rng.integers(0, 3000)), int(rng.integers(width - 2, 3 * width))
            cut = int(rng.integers(0, len(text) + 1))
            text[cut:cut] = words[at : at + n]
        rows.append((int(i * 7 % 61), " ".join(text + line * int(rng.integers(0, 3)))))
    rows += [(100, "a " * 900), (101, "a  a\n" * 400), (102, "b a " * 300), (103, "a"), (104, None), (105, ""), (106, " " + rows[0][1] + "\n")]
    assert got(substrings.remove_duplicates(frame(spark, rows), width)) == brute(rows, width)
    # The parse: copies are what they say, do not overlap, and cover what is removed.
    texts = {i: (t or "").split() for i, t in rows}
    copied = defaultdict(list)
    for r in substrings.factors(frame(spark, rows), width).collect():
        a, n, b = r["start"], r["length"], r["ref_start"]
        assert r["ref_doc"] < r["doc_id"] and texts[r["doc_id"]][a : a + n] == texts[r["ref_doc"]][b : b + n] and n > 0
        copied[r["doc_id"]].append((a, n, r["ref_doc"], b))
    for i, (_, removed, _) in brute(rows, width).items():
        spans = sorted(copied[i])
        assert sum(n for _, n, _, _ in spans) == removed
        for (a, n, d, b), (a2, n2, d2, b2) in zip(spans, spans[1:], strict=False):
            assert a + n <= a2 and not (a + n == a2 and d == d2 and b + n == b2)
            assert a + n == a2 or n2 >= width
        assert not spans or spans[0][1] >= width


def test_rows_without_id_repeats_and_nothing(spark):
    text = " ".join(f"w{i}" for i in range(80))
    out = substrings.remove_duplicates(frame(spark, [(1, text), (1, text), (None, text), (2, text)])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in out) == [("1", 0), ("1", 0), ("2", 80), ("None", 0)]
    assert substrings.remove_duplicates(frame(spark, [])).count() == 0
    kept = substrings.remove_duplicates(frame(spark, [(1, " x \n y")])).first()
    assert (kept["text"], kept["kept_text"], kept["source"]) == (" x \n y", "x y", "s")


def test_greedy_parse():
    width = 5
    # One copy over several runs of one diagonal; repeated runs do no harm.
    assert substrings.parse([(3, 4, 1, 10), (7, 6, 1, 14), (3, 4, 1, 10)], width) == [(3, 14, 1, 10)]
    # Two references: the second begins behind the first one's end.
    assert substrings.parse([(0, 3, 1, 0), (3, 10, 2, 50)], width) == [(0, 7, 1, 0), (7, 10, 2, 54)]
    # A window that begins in a copy and runs past its end lengthens what is copied.
    assert substrings.parse([(0, 1, 1, 0), (2, 1, 2, 30)], width) == [(0, 5, 1, 0), (5, 2, 2, 33)]
    # A literal lies between copies; nothing copies nothing.
    assert substrings.parse([(20, 1, 4, 0), (0, 1, 1, 0)], width) == [(0, 5, 1, 0), (20, 5, 4, 0)]
    assert substrings.parse([], width) == []


def test_rows_of_one_id_are_cut_by_their_own_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(70)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, b + " " + a), (2, "short"), (2, None), (3, a), (3, b)]
    out = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.remove_duplicates(frame(spark, rows)).collect())
    assert out == [(1, 70, 0), (2, 0, 0), (2, 1, 0), (2, 130, 70), (3, 60, 60), (3, 70, 70)]


def test_clashing_columns(spark):
    a = " ".join(f"a{i}" for i in range(70))
    schema = "doc_id long, text string, n_chars int, n_words string, kept_text string, key long, copies string, new_text string, in_2 string, of_doc long"
    df = spark.createDataFrame([(i, a, 9, "w", "k", 5, "c", "n", "i", 8) for i in (1, 2)] + [(3, None, None, "w", "k", 5, "c", "n", "i", 8)], schema)
    out = substrings.without_duplicates(df)
    assert out.schema == df.schema
    assert sorted(tuple(r) for r in out.collect()) == [(1, a, 9, "w", "k", 5, "c", "n", "i", 8), (2, "", 0, "w", "k", 5, "c", "n", "i", 8), (3, None, None, "w", "k", 5, "c", "n", "i", 8)]
    cut = substrings.remove_duplicates(df)
    assert len(cut.columns) == len(set(cut.columns)) == 11
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["key"]) for r in cut.collect()) == [(1, 70, 0, 5), (2, 70, 70, 5), (3, 0, 0, 5)]


def test_query_matches_sql(spark, oracle, rows_of):
    sf = "/root/testdata/sf0.01"
    name = "op4_substring_dedup"
    assert rows_of(registry.QUERIES[name](spark, sf)) == oracle(registry.ORACLE[name], sf)
