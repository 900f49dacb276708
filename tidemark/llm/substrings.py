"""Exact substring deduplication by relative Lempel-Ziv parsing against an index of reference blocks.

The index. Every window of `width` words belongs to its least `GRAM`-word hash, its anchor; consecutive windows
with one anchor form a block, about 16 windows long. Equal windows have equal anchors wherever they stand, so
text that recurs falls into blocks with the same anchor. The index holds, for each anchor and block content, its
first place: the smallest document with it, and where it starts there. The corpus is one reference, indexed in all
its blocks, relative to which every document is parsed.

The look-up. A block with an earlier first place is copied from there as a whole. Where an anchor has several block
contents, a shared passage begins or ends within a block: there the first places of single windows are looked up,
and only for the first holder of each content, since later holders copy the block.

The parse. Blocks and windows that follow one another at their first places make one factor, a copy of words from
an earlier document. Going left to right, the parse takes the longest factor at each word and goes on behind it; at
a factor's end the windows that begin in it and run past it are checked too, and lengthen what is copied. Factors
of `width` words and more, and their checked ends, are the duplicate spans; words between them are literals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, set_aside
from .minhash import slices
from .words import Prefixes, hash_words, sliding_min, word_lists

#: Words per anchor candidate; a window of 50 words holds 34 of them, so a block has about 17 windows.
GRAM = 17
#: Windows per block at most: a block of one repeated phrase is cut, which costs no match.
LONGEST = 256
BLOCKS = "doc_id long, key long, anchor long, content long, start int, windows int"
COPIES = "array<struct<start:long,length:long,ref_doc:long,ref_start:long>>"


def _hashed(texts: pa.Array, width: int) -> tuple[Prefixes, np.ndarray, np.ndarray, np.ndarray]:
    """(prefix hashes, each text's word offsets, starts of all windows, the text of each window)."""
    words, at = word_lists(texts)
    n = np.maximum(np.diff(at) - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.concatenate(([0], np.cumsum(n)))
    starts = np.arange(first[-1]) - first[doc] + at[:-1][doc] if len(doc) else np.zeros(0, np.int64)
    return Prefixes(hash_words(words)), at, starts, doc


def reference_blocks(docs: DataFrame, width: int = 50) -> DataFrame:
    """The blocks of every document (doc_id, key, text): (doc_id, key, anchor, content, start word, number of windows)."""
    gram = min(GRAM, width)

    def cut(batches):
        for batch in batches:
            for part in slices(batch, 2):
                prefixes, at, starts, doc = _hashed(part.column(2), width)
                if not len(starts):
                    continue
                anchors = sliding_min(prefixes.grams(gram), width - gram + 1)[starts]
                new = np.ones(len(starts), bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])
                run = np.flatnonzero(new)
                within = np.arange(len(starts)) - np.repeat(run, np.diff(np.append(run, len(starts))))
                begin = np.flatnonzero(within % LONGEST == 0)
                count = np.diff(np.append(begin, len(starts)))
                content = prefixes.spans(starts[begin], starts[begin] + count + width - 1)
                rows = pa.array(doc[begin])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(anchors[begin].view(np.int64)), pa.array(content.view(np.int64)), pa.array((starts[begin] - at[doc[begin]]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["doc_id", "key", "anchor", "content", "start", "windows"],
                )

    return docs.select("doc_id", "key", "text").mapInArrow(cut, BLOCKS)


def _boundary_windows(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, anchor, window, start): the windows of the listed blocks of texts (doc_id, key, text, blocks)."""

    def cut(batches):
        for batch in batches:
            for part in slices(batch, 2):
                prefixes, at, _, _ = _hashed(part.column(2), width)
                lists = part.column(3)
                blocks = lists.flatten()
                begin, count, anchor = (np.asarray(blocks.field(c)).astype(np.int64) for c in ("start", "windows", "anchor"))
                doc = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(lists)))
                each = np.repeat(np.arange(len(begin)), count)
                offset = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                start = begin[each] + offset
                at_word = start + at[doc[each]]
                window = prefixes.spans(at_word, at_word + width).view(np.int64)
                rows = pa.array(doc[each])
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(anchor[each]), pa.array(window), pa.array(start.astype(np.int32))], names=["doc_id", "key", "anchor", "window", "start"])

    return texts.mapInArrow(cut, "doc_id long, key long, anchor long, window long, start int")


def first_places(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, key, start, windows, ref_doc, ref_start): runs of `width`-word windows that an earlier document holds, and where.

    Of docs (doc_id, key, text). Earlier means a smaller doc_id, on the input as given. Rows without doc_id are
    neither references nor parsed.
    """
    known = docs.where("doc_id is not null")
    blocks = materialise(reference_blocks(known, width))
    # An anchor of one document matters to no other; one with a single content has no factor boundary.
    anchors = blocks.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("content").alias("c_lo"), F.max("content").alias("c_hi"))
    shared = materialise(anchors.where("lo < hi").select("anchor", (F.col("c_lo") != F.col("c_hi")).alias("varied")))
    shared_blocks = materialise(blocks.join(shared, "anchor"))
    first = F.min(F.struct("doc_id", "start"))
    index = materialise(shared_blocks.groupBy("anchor", "content").agg(first.alias("ref")))
    placed = materialise(shared_blocks.join(index, ["anchor", "content"]))
    discard(blocks, shared, shared_blocks, index)
    copied = lambda rows, windows: rows.where(F.col("ref.doc_id") < F.col("doc_id")).select("doc_id", "key", "start", windows.alias("windows"), F.col("ref.doc_id").alias("ref_doc"), F.col("ref.start").alias("ref_start"))
    open_ends = placed.where((F.col("ref.doc_id") == F.col("doc_id")) & F.col("varied"))
    listed = materialise(open_ends.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "windows", "anchor")).alias("blocks")))
    # What is listed or copied grows with the documents, so neither is broadcast.
    windows = materialise(_boundary_windows(known.join(listed.hint("merge"), ["doc_id", "key"]).select("doc_id", "key", "text", "blocks"), width))
    seen = windows.groupBy("anchor", "window").agg(first.alias("ref"), F.max("doc_id").alias("last")).where(F.col("ref.doc_id") < F.col("last"))
    discard(listed)
    late = windows.join(materialise(seen.select("anchor", "window", "ref")), ["anchor", "window"])
    return copied(placed, F.col("windows")).union(copied(late, F.lit(1)))


def parse(runs: list, width: int) -> list[tuple[int, int, int, int]]:
    """The greedy parse of one document: copies (start, length, ref_doc, ref_start), left to right, without overlap.

    `runs` (start, windows, ref_doc, ref_start) are windows with their first places, each window in one run at most
    (repeated runs do no harm). A copy shorter than `width` ends a window that begins in the copy before it.
    """
    factors: list[list[int]] = []
    for start, windows, ref_doc, ref_start in sorted(set(runs)):
        if factors:
            last = factors[-1]
            if start == last[0] + last[1] and ref_doc == last[2] and ref_start == last[3] + last[1]:
                last[1] += windows
                continue
        factors.append([start, windows, ref_doc, ref_start])
    copies, done = [], 0
    for start, windows, ref_doc, ref_start in factors:
        at, end = max(done, start), start + windows + width - 1
        if end > at:
            copies.append((at, end - at, ref_doc, ref_start + at - start))
            done = end
    return copies


def _parsed(runs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, copies) of the documents that copy anything."""
    listed = runs.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "windows", "ref_doc", "ref_start")).alias("runs"))

    def run(batches):
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "ref_doc", "ref_start")]))
        for batch in batches:
            copies = []
            for found in batch.column(2):
                rows = found.values
                columns = (rows.field(c).to_pylist() for c in ("start", "windows", "ref_doc", "ref_start"))
                copies.append([dict(zip(("start", "length", "ref_doc", "ref_start"), c, strict=True)) for c in parse(list(zip(*columns, strict=True)), width)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(copies, kind)], names=["doc_id", "key", "copies"])

    return materialise(listed.mapInArrow(run, f"doc_id long, key long, copies {COPIES}"))


def factors(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, start, length, ref_doc, ref_start): every copy of the parse of docs (doc_id, text), places in words.

    The words [start, start + length) of doc_id are the words from ref_start on of ref_doc.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    return _parsed(first_places(keyed, width), width).select("doc_id", F.inline("copies"))


def _cut(docs: DataFrame, width: int) -> tuple[DataFrame, dict[str, str]]:
    """(docs under the names of set_aside, with new_text, n_words, n_removed and kept_text; those names)."""
    apart, names = set_aside(docs, "doc_id", "text")
    columns, keyed = apart.columns, apart.withColumn("key", F.xxhash64("text"))
    copies = _parsed(first_places(keyed.select(F.col("doc_id").cast("long"), "key", "text"), width), width)
    joined = keyed.join(copies.withColumnsRenamed({"doc_id": "of_doc", "key": "of_key"}).hint("merge"), (F.col("doc_id") == F.col("of_doc")) & (F.col("key") == F.col("of_key")), "left")

    def cut(batches):
        for batch in batches:
            kept_texts, texts, n_words, n_removed = [], [], [], []
            for text, copies in zip(batch.column("text").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                words, kept, at = (text or "").encode().split(), [], 0
                for c in copies or ():
                    kept += words[at : c["start"]]
                    at = c["start"] + c["length"]
                kept += words[at:]
                kept_texts.append(b" ".join(kept).decode())
                texts.append(kept_texts[-1] if copies else text)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
            made = [pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], names=[*columns, "new_text", "n_words", "n_removed", "kept_text"])

    schema = T.StructType(list(apart.schema.fields))
    for name, kind in (("new_text", "string"), ("n_words", "long"), ("n_removed", "long"), ("kept_text", "string")):
        schema = schema.add(name, kind)
    return joined.select(*columns, "copies").mapInArrow(cut, schema), names


def remove_duplicates(docs: DataFrame, width: int = 50) -> DataFrame:
    """The columns of docs with `text` cut to its kept words, and n_words, n_removed, kept_text.

    Words are runs of characters other than ASCII white space, unchanged. A word goes if a window of `width`
    consecutive words over it also starts in a document with a smaller doc_id; windows are judged on the
    input. `kept_text` joins the kept words by one space (null text: ''); `text` stays as it is, byte for
    byte, where nothing is removed. Rows that share a doc_id are not earlier for one another, and each is cut by
    its own text; rows without doc_id stay whole. Columns of docs with the names of the new ones give way.
    """
    cut, names = _cut(docs, width)
    new = ("n_words", "n_removed", "kept_text")
    own = [F.col("new_text" if c == "text" else names[c]).alias(c) for c in docs.columns if c not in new]
    return cut.select(*own, *new)


def without_duplicates(docs: DataFrame, width: int = 50) -> DataFrame:
    """docs, all rows and columns, with `text` cut as by remove_duplicates, and `n_chars`, where docs has it, made to fit."""
    cut, names = _cut(docs, width)
    length = F.when(F.col("n_removed") > 0, F.length("new_text")) if "n_chars" in names else None
    fitted = {"text": F.col("new_text")}
    if length is not None:
        fitted["n_chars"] = F.coalesce(length.cast(docs.schema["n_chars"].dataType), F.col(names["n_chars"]))
    return cut.select(*[fitted.get(c, F.col(names[c])).alias(c) for c in docs.columns])


def removal_digests(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of remove_duplicates."""
    cut = remove_duplicates(docs.select("doc_id", "text"), width)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
