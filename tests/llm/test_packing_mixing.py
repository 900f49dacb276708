import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import mixing, packing, registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length long, _rank string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 7, "x") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(50, "a <|endoftext|> b", "a"), (51, "<|endoftext|>", "a"), (52, "<|endoftext |> <|endoftext|><|endoftext|>x", None), (0, None, "a"), (1, "", "a"), (2, " \n", None), (3, "word " * 3000, "b"), (4, "one two", "b"), (4, "one two", "b"), (None, "x y z", None)]
    return docs(spark, rows + [(10 + i, "same text here", "a") for i in range(200)])


def check_packing(rows, capacity):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r["length"] <= capacity
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("capacity", [8, 64, 1024])
def test_pack_fills_sequences_without_gaps(spark, capacity):
    rng = np.random.default_rng(capacity)
    lengths = [int(x) for x in rng.integers(1, capacity + 1, 500)] + [3] * 300
    df = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    n = check_packing(packing.pack(df, capacity).collect(), capacity)
    bins = []
    for length in sorted(lengths, reverse=True):  # best-fit decreasing over single pieces
        fit = [i for i, room in enumerate(bins) if room >= length]
        i = min(fit, key=lambda i: bins[i]) if fit else len(bins)
        bins[i:] = bins[i:] or [capacity]
        bins[i] -= length
    assert n <= len(bins)


def test_pack_rejects_long_pieces_and_accepts_none(spark):
    schema = "doc_id long, piece int, length long"
    assert packing.pack(spark.createDataFrame([], schema), 8).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 9)], schema), 8)


def expected_pieces(rows, capacity=1024):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = Counter()
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            out[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return out


def test_packed_documents_awkward(spark, awkward):
    rows = packing.packed_documents(awkward).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected_pieces([(r["doc_id"], r["text"]) for r in awkward.collect()])
    check_packing(rows, 1024)


@pytest.mark.parametrize("unit", [" ", "\t", "\n", " \n"])
def test_very_long_white_space(spark, unit):
    run = unit * (2_000_000 // len(unit))
    rows = [(1, run), (2, f"a{run}b"), (3, f"one {run}"), (4, "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.packed_documents(df).collect()
    check_packing(out, 1024)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected_pieces(rows)


def test_a_source_named_nul_is_not_the_null_source(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), (None, "\0", "a")[i % 3], "en", 1) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    check_mix(mixing.mix(df).collect())


def test_packing_query_matches_tokenizers(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.op1_best_fit_packing(spark, sf).collect()
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected_pieces(map(tuple, texts))
    assert check_packing(rows, 1024) <= 1.005 * sum(r["length"] for r in rows) / 1024


def test_token_pieces_hold_the_ids(spark):
    r = packing.token_pieces(docs(spark, [(1, "hello world", "a")])).first()
    assert list(np.frombuffer(r["ids"], "<u4")) == [31373, 995, 2]


def test_pack_with_any_columns(spark):
    schema = "doc_id long, piece int, length long, place string, slot_length string, rank_from long, sequence_id string, _salt int"
    df = spark.createDataFrame([(i, 0, 3, "p", "s", 5, "old", 7) for i in range(9)], schema)
    rows = packing.pack(df, 8).collect()
    assert check_packing(rows, 8) == 5 and {(r["place"], r["slot_length"], r["rank_from"], r["_salt"]) for r in rows} == {("p", "s", 5, 7)}


def test_assembled_sequences_hold_every_id(spark):
    """Exact round trip: packed sequences cut back into pieces give every document's ids."""
    texts = {i: " ".join(f"word{k}" for k in range(i * 37 % 400)) for i in range(30)}
    pieces = packing.token_pieces(docs(spark, [(i, t, "a") for i, t in texts.items()]), 64)
    placed = packing.pack(pieces, 64)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.assemble(placed).collect()}
    for r in placed.collect():
        assert (whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == np.frombuffer(r["ids"], "<u4")).all()
    assert sum(map(len, whole.values())) == sum(r["length"] for r in placed.collect())


def water_levels(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / weight > most * sizes[s]]
        if not over:
            return fixed | {s: left * w[s] / weight for s in rest}
        fixed |= {s: most * sizes[s] for s in over}


def check_mix(rows):
    sizes, taken, targets = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["repeats"]
        targets[r["source"]] = r["target"]
        assert 0 <= r["repeats"] <= 3
    want = water_levels(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s])
        assert all(r["source_size"] == sizes[s] for r in rows if r["source"] == s)
    return taken, targets


def test_mix_awkward(spark, awkward):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count()
    taken, targets = check_mix(rows)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 3000
    key = lambda rows: sorted((str(r["doc_id"]), r["repeats"]) for r in rows)
    assert key(rows) == key(mixing.mix(awkward.repartition(3)).collect())


def test_mix_query_hits_its_targets(spark):
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    taken, targets = check_mix(rows)
    assert max(abs(taken[s] - t) for s, t in targets.items()) <= 1


def test_many_sources_share_by_water_level(spark):
    rng = np.random.default_rng(4)
    sizes = {f"s{i:04}": int(x) for i, x in enumerate(rng.lognormal(3, 2, 500))} | {None: 90, "": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    out = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = water_levels(sizes)
    assert out.keys() == want.keys() and all(out[s] == pytest.approx(want[s]) for s in want)


def test_sizes_and_targets_match_sql(spark, oracle):
    """The part of the mix that SQL can express: sizes, sources' sizes, and targets by sharing again and again."""
    sf = "/root/testdata/sf0.001"
    sql = r"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    s AS (SELECT source, sum(size) AS n FROM d GROUP BY source), w AS (SELECT source, n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
    o AS (SELECT *, row_number() OVER (ORDER BY 3 * n / w, source NULLS LAST) AS k, count(*) OVER () AS m, sum(n) OVER () AS total FROM w),
    l AS (SELECT *, (total - coalesce(sum(3 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
    f AS (SELECT min_by(level, k) FILTER (level * w <= 3 * n) AS level FROM l)
    SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(least(3 * n, f.level * w), 6) AS target FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source, f"""
    rows = registry.op10_source_mixing(spark, sf).collect()
    names, want = oracle(sql.replace("\\\\", "\\"), sf)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in rows), key=repr) == want


def test_mixed_rows_repeat_and_keep_columns(spark):
    schema = "doc_id long, text string, source string, row string, copy int, repeats int, _times long"
    rows = [(1, "a b c", "a", "r", 1, 2, 3)] * 40 + [(2, "a b", "b", "r", 1, 2, 3), (None, "x", None, None, None, None, None), (3, None, "b", "r", 1, 2, 3)]
    df = spark.createDataFrame(rows, schema)
    out = mixing.mixed_rows(df)
    assert out.schema == df.schema
    got = Counter(tuple(r) for r in out.collect())
    sums = Counter()
    for r in mixing.mix(df).collect():
        sums[r["doc_id"], r["source"]] += r["repeats"]
    assert {(k[0], k[2]): n for k, n in got.items()} == {k: n for k, n in sums.items() if n}
    assert mixing.mixed_rows(df.limit(0)).count() == 0


def test_mix_of_nothing(spark, awkward):
    assert mixing.mix(awkward.limit(0)).count() == 0
    assert {r["repeats"] for r in mixing.mix(awkward.where("doc_id < 3")).collect()} == {0}


@pytest.mark.parametrize("seed", range(20))
def test_fit_budget_against_all_sums(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(1, 60), 6, replace=False))
    counts = rng.integers(1, 4, 6)
    sums = {0}
    for s, c in zip(sizes, counts):
        sums = {x + int(s) * k for x in sums for k in range(int(c) + 1)}
    budget = int(rng.integers(0, int(sizes @ counts) + 1))
    picked = mixing.fit_budget(sizes, counts, budget)
    assert (picked >= 0).all() and (picked <= counts).all()
    # The proportional share is fixed first, so the best sum overall may be missed, never by a whole document.
    assert abs(int(sizes @ picked) - budget) <= max(1, min(abs(x - budget) for x in sums) + int(sizes[0]))
