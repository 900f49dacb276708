import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import registry, toxicity

DOCS = "doc_id long, text string, lang string, score string, clauses string"


@pytest.fixture(scope="module")
def grammar():
    return toxicity.compiled()


@pytest.mark.parametrize(
    ("text", "patterns"),
    [
        ("an idiot", {"insult"}),
        ("idiot", set()),
        ("IDIOT! Scum. you", set()),
        ("idiot scum", {"insult"}),
        ("Idiot of a man", {"insult"}),
        ("idiot, you", {"insult+target"}),
        ("You idiot", {"insult+target"}),
        ("an idiot, you", {"insult", "insult+target"}),
        ("not an idiot", {"insult+negation"}),
        ("they said he is a clown", {"insult+target+report"}),
        ("he said nothing. a clown", {"insult"}),
        ("never said you idiot", {"insult+target+negation+report"}),
        ("I will hurt you", {"threat", "threat+target"}),
        ("not. an idiot", {"insult"}),
        ("not one two three idiot", {"insult"}),
        ("idiot one two three you", {"insult"}),
        ("a scumbag idiotically", set()),
    ],
)
def test_patterns(grammar, text, patterns):
    found, clauses = toxicity.pattern_weights(text, toxicity.Tagger({}), *grammar)
    assert {p for p, w in zip(toxicity.PATTERNS, found) if w} == patterns
    assert clauses == (1 if patterns else 0)


def test_query_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = registry.op2_toxicity(spark, sf).collect()
    assert len(rows) == 10_000
    right = wrong = 0
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and r["doc_id"] in labels:
            right += r["predicted"] == labels[r["doc_id"]]
            wrong += r["predicted"] != labels[r["doc_id"]]
    assert right > 0.97 * (right + wrong)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", "c") for i, t in rows], DOCS)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "you idiot"), (3, "fine words " * 50_000 + "you idiot"), (4, "fine"), (4, "fine"), (5, "\n.!")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 0, None), (4, 1, 0), (4, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        out = toxicity.toxic_scores(frame(spark, rows), labels).collect()
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in rows)
        assert {r["predicted"] for r in out if r["doc_id"] in (1, 2, 4, 5)} == {0}
        assert [r["predicted"] for r in out if r["doc_id"] in (None, 3)] == [1, 1]
    assert toxicity.toxic_scores(frame(spark, []), none).count() == 0
    kept = toxicity.without_toxic(frame(spark, rows), none)
    assert kept.columns == ["doc_id", "text", "lang", "score", "clauses"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 4, 5]


def test_words_are_mined_from_labels(spark):
    docs = [(i, f"plain text number {i}" + (f" then qxzor{i % 3}ab" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    out = toxicity.toxic_scores(frame(spark, [*docs, (1000, "a qxzor1ab word"), (1001, "a qxzornew word")]), labels).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in out if r["doc_id"] < 1001)
    assert [r["predicted"] for r in out if r["doc_id"] == 1001] == [0]


def test_copies_are_no_evidence_and_mined_words_get_tags(spark):
    toxic = [f"plain number {i} and glurm you now" for i in range(30)] + [f"here {i} they frabjous ones" for i in range(30)] + ["one copied sentence of grovelblat"] * 60
    clean = [f"here is plain number {i} for you and now they are many" for i in range(600)]
    rows = spark.createDataFrame([(t, 1) for t in toxic] + [(t, 0) for t in clean], "text string, y int")
    words = toxicity.mined_words(rows)
    assert words.keys() == {"glurm", "frabjous", "ones"}
    assert words["glurm"][0] == toxicity.THREAT and words["frabjous"][0] == toxicity.INSULT


def slow_patterns(tags):
    """The grammar's definition by looking around each marked word, without any machine."""
    reach = lambda i, tag: any(t == tag for t in tags[max(0, i - toxicity.REACH[tag]) : i])
    out = []
    for i, tag in enumerate(tags):
        if tag not in (toxicity.INSULT, toxicity.THREAT) or len(tags) == 1:
            continue
        name = "insult" if tag == toxicity.INSULT else "threat"
        target, negation, report = reach(i, toxicity.TARGET), reach(i, toxicity.NEGATION), reach(i, toxicity.REPORT)
        rest = ("+negation" if negation else "") + ("+report" if report else "")
        after = tags[i + 1 : i + 1 + toxicity.REACH[toxicity.TARGET]]
        stop = next((k for k, t in enumerate(after) if t in (toxicity.INSULT, toxicity.THREAT)), len(after))
        follows = toxicity.TARGET in after[:stop]
        if not (i == 0 and tags[1] == toxicity.TARGET):
            out.append(name + ("+target" if target else "") + rest)
        if follows and not target:
            out.append(name + "+target" + rest)
    return set(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=14))
def test_the_composed_machine_against_its_definition(tags):
    words = {0: "word", 1: "idiot", 2: "kill", 3: "you", 4: "not", 5: "said"}
    found, matched = toxicity.pattern_weights(" ".join(words[t] for t in tags), toxicity.Tagger({}), *toxicity.compiled())
    assert {p for p, w in zip(toxicity.PATTERNS, found, strict=True) if w} == slow_patterns(tags)
    assert matched == bool(slow_patterns(tags))


def test_without_the_grammar_scores_are_worse(monkeypatch):
    """Ablation: the same words, once said at someone and once denied or reported."""
    bad = ["you are an idiot number {}", "they are scum for {}", "I will hurt you {}", "you {} moron"]
    good = ["you are not an idiot number {}", "he said that they are scum for {}", "nobody wrote that I will hurt you {}", "not one {} moron"]
    texts = [(t.format(i), y) for i in range(40) for y, some in ((1, bad), (0, good)) for t in some]
    y = np.array([y for _, y in texts], dtype=float)
    fold = np.arange(len(texts)) % 5 == 0

    def right():
        x = toxicity.squash([toxicity.pattern_weights(t, toxicity.Tagger({}), *toxicity.compiled())[0] for t, _ in texts])
        b = toxicity.fit_logistic(x[~fold], y[~fold], np.ones((~fold).sum()), 0.05)
        return (((x[fold] @ b[:-1] + b[-1]) > 0) == (y[fold] > 0)).mean()

    assert right() == 1
    monkeypatch.setattr(toxicity, "LEXICON", {tag: words if tag in (toxicity.INSULT, toxicity.THREAT) else "" for tag, words in toxicity.LEXICON.items()})
    assert right() < 0.8


def slow_mining(rows):
    """Mined words by whole lists of clauses in memory."""
    known = {w for tag in (toxicity.INSULT, toxicity.THREAT) for w in toxicity.LEXICON[tag].split()}
    targets, reach = set(toxicity.LEXICON[toxicity.TARGET].split()), toxicity.REACH[toxicity.TARGET]
    seen, explained = set(), 0
    for text, y in rows:
        plain = toxicity.clauses(text or "")
        if not known & set(plain.split()):
            explained += y
            seen |= {(tuple(c.split()), y) for c in plain.split("\n") if c.split()}
    if not explained:
        return {}
    nats = math.log(max(len(seen), 1) / max(sum(y for _, y in seen), 1))
    out = {}
    for w in {w for c, y in seen if y for w in c}:
        pos, neg = (sum(w in c for c, y in seen if y == side) for side in (1, 0))
        e = pos * nats - neg * toxicity.AGAINST
        if e >= toxicity.EVIDENCE and pos >= max(toxicity.LEAST_CLAUSES, toxicity.LEAST_SHARE * explained):
            # A clause counts once for each label that it stands under.
            places = [(c, i) for c, _ in seen for i, x in enumerate(c) if x == w]
            before = sum(bool(targets & set(c[max(0, i - reach) : i])) for c, i in places)
            after = sum(bool(targets & set(c[i + 1 : i + 1 + reach])) for c, i in places)
            out[w] = (toxicity.THREAT if after > max(2 * before, toxicity.LEAST_CLAUSES) else toxicity.INSULT, min(2.0, 0.5 + math.log1p(e) / 4))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mining_against_a_slow_version(spark, seed):
    rng = np.random.default_rng(seed)
    common, marks, at = ["plain", "river", "and", "number", "here", "the"], ["glurm", "frab", "snix"], ["you", "they", "du"]
    rows = []
    for i in range(400):
        y = int(i % 3 == 0)
        words = [*rng.choice(common, 4), str(i % 50), *rng.choice(at, 1)] + ([str(rng.choice(marks))] if y or rng.random() < 0.02 else [])
        rows.append((" ".join(map(str, rng.permutation(words))) + str(rng.choice([". ", "! ", "\n"])) + " ".join(rng.choice(common, 3)), y))
    rows += [("copied frab line", 1)] * 50 + [(None, 1), ("", 0), ("you idiot glurm", 1)]
    got = toxicity.mined_words(spark.createDataFrame(rows, "text string, y int"))
    want = slow_mining(rows)
    assert {w: (t, round(x, 9)) for w, (t, x) in got.items()} == {w: (t, round(x, 9)) for w, (t, x) in want.items()} and want


def test_the_fit_comes_to_rest_where_labels_are_all_but_separable():
    """Rows (patterns, label, documents) cut down from check_l: insults mark all toxic ones but one, which has a denied insult alone."""
    k = len(toxicity.PATTERNS)
    toxic = (
        "2:2 x1, 0:1 x19, 0:2 x71, 0:2 4:1 x2, 0:2 4:2 x1, 0:2 4:4 8:2 x1, 0:5 4:1 x2, 0:6 4:2 x1, 0:6 2:2 x1, 0:7 x29, 0:7 4:1 x2, 0:9 2:2 x3, 0:9 2:4 4:2 6:2 8:2 x1, 0:10 4:1 x2, 0:10 4:2 x1, 0:11 x16, "
        "0:15 x9, 0:15 2:2 x1, 0:16 x5, 0:16 4:1 x4, 0:17 x5, 0:17 4:2 8:2 x1, 0:17 4:2 8:4 x1, 0:17 4:6 8:2 x1, 0:17 2:2 x1, 0:18 x8, 0:18 4:1 x1, 0:21 4:2 8:4 x1, 0:23 x2, 0:27 2:2 x1, 0:28 x1, 0:28 4:2 8:2 x1, "
        "0:29 x1, 0:29 2:2 x1, 0:29 2:2 4:2 x1, 0:38 2:2 x1, 0:38 2:4 x1, 0:40 x2, 0:40 4:6 8:6 x1, 0:41 x2, 0:43 4:3 x1, 0:51 4:1 x1, 0:53 x1, 0:56 4:1 x1, 0:64 2:2 4:2 8:4 x1, 0:69 4:2 x2, 0:69 4:3 x1, 0:70 x1, 0:83 x1"
    )
    rows = [({}, 0, 4447)] + [(dict(tuple(map(int, p.split(":"))) for p in some.split()[:-1]), 1, int(some.split("x")[1])) for some in toxic.split(", ")]
    seen = np.array([[of.get(p, 0) for p in range(k)] for of, _, _ in rows], dtype=float)
    x = np.vstack((toxicity.squash(seen), np.log1p(2 * np.eye(k)), np.zeros((1, k))))
    y = np.array([y for _, y, _ in rows] + [toxicity.prior(p) for p in toxicity.PATTERNS] + [0.0])
    weight = np.array([n for _, _, n in rows] + [1] * (k + 1), dtype=float)
    b = toxicity.fit_logistic(x, y, weight, 0.05)
    slope = x.T @ (weight * (y - 1 / (1 + np.exp(-(x @ b[:-1] + b[-1]))))) - 0.05 * b[:-1]
    assert np.abs(slope).max() < 1e-5
    assert ((x[: len(rows)] @ b[:-1] + b[-1] >= 0) != (y[: len(rows)] == 1)).sum() <= 1
