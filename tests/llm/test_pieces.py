"""Merge-type encoding by backtracking against the library, text by text and over a whole table."""

import hashlib
import random

import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor

from tidemark.llm import pieces, registry


@pytest.fixture(scope="module")
def encoder():
    return pieces.merge_encoder(pieces.default_model())


def test_random_characters_and_pieces(encoder):
    rng = random.Random(11)
    letters, known = "aabbcdeheltnS  ▁\n\té́ß漢字🙂<0x>s\0.ＡA", [p.replace("▁", " ") for p in encoder.ids]
    for _ in range(8000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert encoder.encode(text) == encoder.library.encode(text), text
        text = "".join(rng.choice(known) for _ in range(rng.randint(1, 8)))
        assert encoder.encode(text) == encoder.library.encode(text), text


@pytest.mark.parametrize("unit", ["a", " ", "ab", "\n", "\t ", "é", "🙂", "th er", "<s>", "." * 7 + "x"])
def test_very_long_runs(encoder, unit):
    text = unit * (200_000 // len(unit))
    assert encoder.encode(text) == encoder.library.encode(text)


def test_a_long_word_steps_back_without_trying_a_place_twice(encoder):
    rng = random.Random(2)
    text = "".join(rng.choice("etaoinshr") for _ in range(100_000))
    assert encoder.encode(text) == encoder.library.encode(text)


def test_kept_words_give_way(encoder, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_KEPT", 50)
    rng = random.Random(3)
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcdefgh,.") for _ in range(rng.randint(1, 9))) for _ in range(30))
        assert encoder.encode(text) == encoder.library.encode(text)
        assert len(encoder.kept) <= 50


def expected(rows):
    sp, out = SentencePieceProcessor(model_file=pieces.default_model()), []
    for i, text in rows:
        ids = sp.encode(text or "", add_eos=True)
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in df.collect()), key=repr)


def test_awkward_rows_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "same"), (4, "same"), (None, "no id"), (5, "x" * 300_000), (6, "wörd \0 � ￿ ▁"), (7, "</s> <s> <unk> <0x0A>")]
    df = spark.createDataFrame([(i, t, [1], "n") for i, t in rows], "doc_id long, text string, ids array<int>, n_tokens string")
    assert got(pieces.digests(df)) == expected(rows)
    assert pieces.digests(df.limit(0)).count() == 0
    plain = {r["doc_id"]: r["ids"] for r in pieces.encoded(df, end=False).collect()}
    assert plain[2] == [] and plain[4] == pieces.merge_encoder(pieces.default_model()).library.encode("same")


def test_the_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    assert got(registry.QUERIES["op13_piece_tokens"](spark, folder)) == expected(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
