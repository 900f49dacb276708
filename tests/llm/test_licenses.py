import re
from collections import Counter

from tidemark.llm import licenses, registry

DOCS = "doc_id long, text string, score string, labels string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text):
    words = WORD.findall(lowered(text))
    places, base = [], set()
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    labels, score = set(base), 1.0 if places else 0.0
    for i in range(0, max(len(words) - 32, 1), 32):
        for label, template in licenses.TEMPLATES:
            t = set(template.split())
            share = len(t & set(words[i : i + 64])) / len(t)
            if share >= licenses.THRESHOLD - 1e-12:
                labels.add(label)
                score = max(score, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)


def got(df):
    return Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in df.collect())


def test_notices_and_awkward_texts(spark):
    rows = [(i, "noise words\n" + t + "\nmore of the same") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    rows += [(50, None), (51, ""), (52, "MIT License, mit\nLICENSE mitlicense mit-license"), (53, "the mit é license apache/license"), (None, "GNU General Public\nLicense")]
    rows += [(60, "word " * 5000 + licenses.TEMPLATES[0][1] + " word" * 5000), (61, "software " * 9000), (62, licenses.TEMPLATES[5][1].upper()), (62, licenses.TEMPLATES[5][1].upper())]
    rows += [(63, " ".join(licenses.TEMPLATES[0][1].split()[:15])), (64, " ".join(licenses.TEMPLATES[0][1].split()[4:])), (65, "İ MIT License mit license")]
    df = spark.createDataFrame([(i, t, "s", "l") for i, t in rows], DOCS)
    assert got(licenses.scan(df)) == Counter((i, *brute(t)) for i, t in rows)
    assert licenses.scan(df.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(registry.op3_license_scan(spark, sf)) == Counter((i, *brute(t)) for i, t in rows)


def test_query_matches_its_twin(spark, oracle, rows_of):
    sf = "/root/testdata/sf0.001"
    assert rows_of(registry.op3_license_scan(spark, sf)) == oracle(registry.ORACLE["op3_license_scan"], sf)


def test_long_templates_and_none(spark):
    long = " ".join(f"w{i}" for i in range(100))
    texts = [(1, "x " * 77 + long), (2, "x " * 77 + " ".join(long.split()[:79])), (3, " ".join(long.split()[:80]) + " MIT License"), (4, "w1 " * 500)]
    df = spark.createDataFrame([(i, t, "s", "l") for i, t in texts], DOCS)
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(df, (("long", long),)).collect()}
    assert out == {1: ("long", 1.0), 2: ("", 0.0), 3: ("long,mit", 1.0), 4: ("", 0.0)}
    assert {r["labels"] for r in licenses.scan(df, ()).collect()} == {"", "mit"}


def test_matches_are_exact_and_skewed_words_do_no_harm(spark):
    rows = [(i, "permission is hereby granted free of charge " * 30 + licenses.TEMPLATES[i % 15][1]) for i in range(300)]
    df = spark.createDataFrame([(i, t, "s", "l") for i, t in rows], DOCS)
    pairs = licenses.block_matches(*licenses.scanned(df))
    got = {(r["doc_id"], r["first_word"], r["template"], round(r["containment"], 9)) for r in pairs.collect()}
    expected = set()
    for i, text in rows:
        words = WORD.findall(lowered(text))
        for start in range(0, max(len(words) - 32, 1), 32):
            for k, (_, template) in enumerate(licenses.TEMPLATES):
                t = set(template.split())
                share = len(t & set(words[start : start + 64])) / len(t)
                if share >= licenses.THRESHOLD - 1e-12:
                    expected.add((i, start, k, round(share, 9)))
    assert got == expected and pairs.count() == len(expected)


def test_phrase_places_take_linear_time():
    words = [b"mit", b"license"] * 200_000
    assert len(licenses._phrase_places(words)) == 200_000
