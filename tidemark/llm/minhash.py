"""Near-duplicate documents by b-bit MinHash.

Signatures hold the low bits of 80 minima, packed; 20 bands of 4 whole minima give candidates, whose similarity
is first estimated from bit counts, corrected for chance collisions, and then confirmed on the full shingle
sets. Documents with equal sets form one class, numbered by `rep`, so copies never meet as pairs. Within a bucket, classes are
first held against one pivot, the class that shares most buckets; only classes of a bucket still in different
components are then compared with one another, where an exact prefix filter over their rarest shingles leaves
few pairs. A pair at similarity 0.85 shares no band with a probability
of 4e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACES, Scratch, discard, materialise, set_aside
from .components import components
from .words import Prefixes, hash_words, lower_ascii, mix, word_lists

MINIMA, BANDS, BITS = 80, 20, 2
#: An estimate this far under the threshold rules a pair out: a pair at 0.85 with 53 or fewer equal minima, 9e-8 of them.
MARGIN = 0.29
#: Classes per block when the rest of a bucket is compared; a row for each class and block is dealt out.
BLOCK = 2048
#: Up to so many classes of a key meet in a plain join.
FEW = 32
SIGNED = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, sig_0 long, sig_1 long, sig_2 long, bands array<long>"

_RNG = np.random.default_rng(20260101)
_FLIP = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a few MB of text each (a longer text stands alone)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, grouped by text and sorted; offsets of each text's).

    A text with fewer than `width` words has its whole sequence as its one shingle; without words, none.
    """
    words, at = word_lists(lower_ascii(texts))
    prefixes = Prefixes(hash_words(words))
    n = np.diff(at)
    each = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), each)
    first = np.concatenate(([0], np.cumsum(each)))
    start = np.arange(first[-1]) - first[doc] + at[:-1][doc] if len(doc) else np.zeros(0, np.int64)
    grams = prefixes.spans(start, start + np.minimum(width, n)[doc])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(n)))))


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """Per document and text_key, a digest of its text: set size, a 128-bit set identity, the packed low bits of its minima and its band keys."""

    def sign(batches):
        for batch in batches:
            for part in slices(batch, 2):
                grams, at = shingle_sets(part.column(2), width)
                some = np.flatnonzero(np.diff(at))
                starts = at[some]
                minima = np.empty((len(some), MINIMA), np.uint64)
                for j in range(MINIMA if len(some) else 0):
                    minima[:, j] = np.minimum.reduceat((grams ^ _FLIP[j]) * _ODD[j], starts)
                low = (minima[:, :, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
                packed = np.zeros((len(some), 24), np.uint8)
                packed[:, : MINIMA * BITS // 8] = np.packbits(low.reshape(len(some), MINIMA * BITS).astype(np.uint8), axis=1)
                rows = mix(minima).reshape(len(some), BANDS, MINIMA // BANDS)
                weights = np.arange(1, 2 * MINIMA // BANDS, 2, dtype=np.uint64)
                keys = mix((rows * weights).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[0])
                identity = np.zeros((part.num_rows, 2), np.uint64)
                sig = np.zeros((part.num_rows, 3), np.int64)
                if len(some):
                    identity[some, 0] = np.add.reduceat(mix(grams), starts)
                    identity[some, 1] = np.add.reduceat(mix(grams ^ _FLIP[0]), starts)
                    sig[some] = packed.view(np.int64)
                per = np.zeros(part.num_rows + 1, np.int32)
                per[some + 1] = BANDS
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        part.column(1),
                        pa.array(np.diff(at).astype(np.int64)),
                        pa.array(np.ascontiguousarray(identity[:, 0]).view(np.int64)),
                        pa.array(np.ascontiguousarray(identity[:, 1]).view(np.int64)),
                        *(pa.array(np.ascontiguousarray(sig[:, k])) for k in range(3)),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(per, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "sig_0", "sig_1", "sig_2", "bands"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(sign, SIGNED)


def _likely(threshold: float, a: str, b: str):
    """Whether the sizes allow the threshold and the collision-corrected estimate comes within MARGIN of it."""
    pairs = F.lit(0x5555555555555555)
    differ = sum(F.bit_count((x := F.col(f"{a}_sig_{k}").bitwiseXOR(F.col(f"{b}_sig_{k}"))).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(pairs)) for k in range(3))
    chance = 2.0**-BITS
    estimate = ((F.lit(float(MINIMA)) - differ) / MINIMA - chance) / (1 - chance)
    small, large = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    return (estimate >= threshold - MARGIN) & (small >= F.lit(threshold - 1e-9) * large)


def _with(pairs: DataFrame, side: str, rows: DataFrame) -> DataFrame:
    """Attach rows of `rep` to one side of pairs (a, b), its columns prefixed by the side."""
    named = rows.select(*[F.col(c).alias(side if c == "rep" else f"{side}_{c}") for c in rows.columns])
    return pairs.join(named, side)


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def check(batches):
        for batch in batches:
            for part in slices(slice_source(batch), 4):
                a, a_at = shingle_sets(part.column("a_text"), width)
                b, b_at = shingle_sets(part.column("b_text"), width)
                keep = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    x, y = a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]]
                    common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                    keep[i] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep))

    def slice_source(batch):
        both = pc.binary_join_element_wise(pc.fill_null(batch.column("a_text"), ""), pc.fill_null(batch.column("b_text"), ""), "")
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "a_text", "b_text")), both], names=["a", "b", "a_text", "b_text", "both"])

    joined = _with(_with(pairs, "a", texts), "b", texts)
    return materialise(joined.select("a", "b", "a_text", "b_text").mapInArrow(check, "a long, b long"))


def _shingles(texts: DataFrame, width: int) -> DataFrame:
    """(rep, shingle): the distinct shingle hashes of each text."""

    def cut(batches):
        for batch in batches:
            for part in slices(batch, 1):
                grams, at = shingle_sets(part.column(1), width)
                reps = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(at))))
                yield pa.RecordBatch.from_arrays([reps, pa.array(grams.view(np.int64))], names=["rep", "shingle"])

    return texts.select("rep", "text").mapInArrow(cut, "rep long, shingle long")


def _prefixes(members: DataFrame, texts: DataFrame, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """members (rep, label, n, sig_*) by the shared shingles (key) of their prefixes, with the place of each.

    With shingles in order of frequency among the members, rarest first, two sets over the threshold share one
    of their first n - ceil(percent * n / 100) + 1. Shingles of one member stand first and match nothing, so a
    member with enough of them has no link left to find.
    """
    shingles = scratch(_shingles(texts.join(members.select("rep"), "rep", "left_semi"), width))
    common = scratch(shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    of_rep = W.partitionBy("rep")
    shared = shingles.join(common, "shingle").join(members, "rep")
    shared = shared.withColumn("own", F.col("n") - F.count(F.lit(1)).over(of_rep)).withColumn("nth", F.row_number().over(of_rep.orderBy("df", "shingle")))
    length = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    placed = shared.withColumn("place", F.col("own") + F.col("nth")).where(F.col("place") <= length)
    return placed.select(F.col("shingle").alias("key"), "place", *members.columns)


def _rest_pairs(members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Candidate pairs of members (key, place, rep, label, n, sig_*) with one key and different labels.

    Position filter: past their first common shingle, two sets share at most what is left of either, which
    must reach the overlap that the threshold asks of their sizes. Keys whose members have one label are
    done. Few members of a key meet in a join; many are dealt into blocks of about BLOCK by a hash, and every
    two blocks meet in one group of at most two blocks' rows, where positions and bit counts rule pairs out
    before any row is made.
    """
    threshold = percent / 100
    members = scratch(members)
    keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    keys = scratch(keys.where("lo <> hi").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), (F.col("size") <= FEW).alias("few")))
    dealt = scratch(members.join(keys, "key"))

    few = dealt.where("few").drop("few", "blocks")
    side = lambda s: few.select("key", *[F.col(c).alias(s if c == "rep" else f"{s}_{c}") for c in few.columns if c != "key"])
    small = side("a").join(side("b"), "key").where("a < b and a_label <> b_label")
    overlap = F.ceil((F.col("a_n") + F.col("b_n")) * percent / (100 + percent) - F.lit(1e-9))
    small = small.where(1 + F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) >= overlap)
    small = small.where(_likely(threshold, "a", "b")).select("a", "b").distinct()

    many = dealt.where("not few").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    meets = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = meets.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "place", "rep", "label", "n", "sig_0", "sig_1", "sig_2")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["block"] == pdf["i"]], pdf[pdf["block"] == pdf["j"]]
        out = [np.zeros((0, 2), np.int64)]
        sig = right[["sig_0", "sig_1", "sig_2"]].to_numpy().view(np.uint64)
        n, label, rep, place = (right[c].to_numpy() for c in ("n", "label", "rep", "place"))
        for row in left.itertuples(index=False) if pdf["label"].nunique() > 1 else ():
            x = sig ^ np.array([row.sig_0, row.sig_1, row.sig_2], np.int64).view(np.uint64)
            differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
            estimate = (1 - differ / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS)
            fits = 1 + np.minimum(n - place, row.n - row.place) >= np.ceil((n + row.n) * percent / (100 + percent) - 1e-9)
            hit = rep[(label != row.label) & fits & (estimate >= threshold - MARGIN)]
            out.append(np.column_stack((np.minimum(hit, row.rep), np.maximum(hit, row.rep))))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"]).astype("int64")

    large = cells.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()
    return small.union(large).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept, component) for every row of docs (doc_id, text).

    Documents are linked if 100 * intersection >= percent * union over their sets of distinct `width`-word
    shingles; component_id is the smallest doc_id reachable. Documents without words are linked with nothing.
    Rows that share a doc_id are told apart by text_key, a digest of the text, and linked each by its own text; a
    null doc_id links nothing: its component is null and it is kept. `component` tells components apart where
    unlinked texts share a doc_id; its numbers mean nothing else and are null without words. `percent` may be 80 or
    more, for which the bands are laid out.
    """
    if percent < 80:
        raise ValueError("the bands are laid out for a similarity of 0.8 or more")
    threshold = percent / 100
    scratch = Scratch()
    signed = materialise(signatures(docs, width))
    some = signed.where("n_shingles > 0 and doc_id is not null")
    first = F.min_by(F.struct("doc_id", "text_key", "n_shingles", "sig_0", "sig_1", "sig_2", "bands"), F.struct("doc_id", "text_key")).alias("x")
    grouped = some.groupBy("set_a", "set_b").agg(first)
    sets = materialise(grouped.select(F.monotonically_increasing_id().alias("rep"), "set_a", "set_b", "x.doc_id", "x.text_key", F.col("x.n_shingles").alias("n"), "x.sig_0", "x.sig_1", "x.sig_2", "x.bands"))
    classes = sets.select("rep", "n", "sig_0", "sig_1", "sig_2")
    banded = sets.select(F.explode("bands").alias("key"), "rep", F.col("doc_id").alias("id"))
    shared = scratch(banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    members = scratch(banded.join(shared, "key"))
    score = scratch(members.groupBy("rep").agg(F.sum("members").alias("score")))
    # The pivot of a bucket: the class that shares most; of equals the one with the smallest document.
    chosen = F.max(F.struct("score", (-F.col("id")).alias("least"), "rep")).alias("p")
    pivots = scratch(members.select("key", "rep", "id").join(score, "rep").groupBy("key").agg(chosen).select("key", F.col("p.rep").alias("pivot")))
    stars = members.join(pivots, "key").where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    likely = scratch(_with(_with(stars, "a", classes), "b", classes).where(_likely(threshold, "a", "b")).select("a", "b"))

    texts = _texts(docs, sets, members, scratch)
    links = _confirm(likely, texts, percent, width)
    found = components(links)

    # What the pivots left apart: buckets whose classes are still in more than one component.
    labelled = members.select("key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = scratch(labelled.select("key", "rep", F.coalesce("component", "rep").alias("label")))
    apart = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    open_reps = labelled.join(scratch(apart), "key").select("rep", "label").distinct()
    rest = scratch(open_reps.join(classes, "rep"))
    pairs = scratch(_rest_pairs(_prefixes(rest, texts, percent, width, scratch), percent, scratch).join(likely, ["a", "b"], "left_anti"))
    more = _confirm(pairs, texts, percent, width)
    discard(found)
    found = components(links.union(more))
    discard(links, more)
    scratch.drop()

    # Classes are numbered as they come; a component's id is its smallest document.
    linked = sets.select("rep", "set_a", "set_b", "doc_id").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = materialise(linked.groupBy("component").agg(F.min("doc_id").alias("c")))
    ids = materialise(linked.join(least, "component").select("set_a", "set_b", "c", "component"))
    discard(sets, found, least)
    joined = signed.select("doc_id", "text_key", "n_shingles", "set_a", "set_b").join(ids, ["set_a", "set_b"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id")))
    return joined.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "component")


def _texts(docs: DataFrame, sets: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """One text for each class that shares a bucket."""
    wanted = scratch(sets.select("rep", "doc_id", "text_key").join(members.select("rep").distinct(), "rep"))
    # The wanted rows grow with the documents, so they are never broadcast.
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(wanted.hint("merge"), ["doc_id", "text_key"])
    return scratch(texts.groupBy("rep").agg(F.min("text").alias("text")))


def without_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs with one row of each group of near copies: its smallest doc_id; of that one's texts and rows the first by digest.

    Rows whose texts are not linked stay apart even if they share a doc_id. Rows without words or without doc_id are
    nobody's copies and stay.
    """
    apart, names = set_aside(docs, "doc_id", "text")
    wordless = ~F.coalesce(F.col("text").rlike(f"[^{SPACES}]"), F.lit(False)) | F.col("doc_id").isNull()
    found = near_duplicates(apart.where(~wordless).select("doc_id", "text"), percent, width)
    kept = found.where("kept").groupBy("component").agg(F.min("component_id").alias("doc_id"), F.min("text_key").alias("text_key"))
    keyed = apart.where(~wordless).withColumn("text_key", F.xxhash64("text"))
    same = keyed.join(materialise(kept.select("doc_id", "text_key")).hint("merge"), ["doc_id", "text_key"], "left_semi")
    nth = F.row_number().over(W.partitionBy("doc_id", "text_key").orderBy(F.xxhash64(*apart.columns)))
    one = same.withColumn("nth", nth).where("nth = 1").select(*apart.columns)
    return one.unionByName(apart.where(wordless)).select(*[F.col(names[c]).alias(c) for c in docs.columns])
