"""Best-fit packing of tokenised documents into fixed-length training sequences.

The plan is made over a histogram of piece lengths, never over documents: best-fit decreasing places counts of
equal lengths into groups of equally filled sequences. Its size depends on the sequence length alone (at most
`capacity` lengths meeting at most `capacity` residual sizes), so it may pass through the driver and be
broadcast. Pieces then take the planned slots by joining on their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import default_vocabulary, materialise, salt_buckets, salted_rank, set_aside, token_ids

PIECES = "doc_id long, piece int, start long, length long, ids binary"
SLOTS = "slot_length long, rank_from long, rank_to long, first_sequence long, per_sequence long, slot_offset long"


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Tokenise whole texts (null: empty), end each with end_id and cut only those longer than capacity.

    Ids are those of the vocabulary file by `tokenizers`, its special tokens' strings included. Cut documents have
    pieces of exactly `capacity` ids but for the first, which takes the remainder. `ids` holds the piece's ids as little-endian unsigned 32-bit integers.
    """
    path = vocabulary or default_vocabulary()

    def cut(batches):
        for batch in batches:
            doc, piece, start, length, ids = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                all_ids = np.append(token_ids(path, text, True), end_id).astype("<u4")
                first = len(all_ids) % capacity or capacity
                edges = [0, *range(first, len(all_ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(all_ids[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, rank_from, rank_to, first_sequence, per_sequence, slot_offset).

    Pieces of a length with rank in [rank_from, rank_to) go, per_sequence at a time, to the sequences from
    first_sequence on, side by side from slot_offset.
    """
    slots, room, open_by_room, made = [], [], {}, 0

    def leave_open(space: int, first: int, last: int) -> None:
        if space and last > first:
            if space not in open_by_room:
                open_by_room[space] = []
                insort(room, space)
            open_by_room[space].append((first, last))

    for length in sorted((n for n in counts if n > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(room, length)
            if at < len(room):
                space = room[at]
                first, last = open_by_room[space].pop()
                if not open_by_room[space]:
                    del open_by_room[space], room[at]
            else:
                space, first = capacity, made
                made = last = made + -(-left // (capacity // length))
            each = space // length
            full = min(last - first, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, capacity - space))
                leave_open(space - each * length, first, first + full)
                rank, left, first = rank + full * each, left - full * each, first + full
            if left and first < last:
                slots.append((length, rank, rank + left, first, left, capacity - space))
                leave_open(space - left * length, first, first + 1)
                rank, left, first = rank + left, 0, first + 1
            leave_open(space, first, last)
    return slots


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length <= capacity, any other columns).

    Every row is placed once, repeated rows included; an empty table stays empty. Sequences have no gaps:
    offsets start at 0 and each piece begins where the one before it ends. `pieces` is read twice, so pass a
    written table where it is costly. Other columns ride along; any named sequence_id or offset give way.

    A length has few slots (5 on average for 3 million lengths of log-normal spread), so a piece tries its length's.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"piece lengths must be within 1..{capacity}")
    apart, names = set_aside(pieces, "doc_id", "piece", "length")
    slots = spark.createDataFrame(best_fit_plan(counts, capacity), SLOTS)
    ranked = salted_rank(apart, ["length"], [F.col("doc_id"), F.col("piece")], salt_buckets(sum(counts.values())), "place")
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & F.col("place").between(F.col("rank_from"), F.col("rank_to") - 1))
    nth = F.col("place") - F.col("rank_from")
    return placed.select(
        *[F.col(n).alias(c) for c, n in names.items() if c not in ("sequence_id", "offset")],
        (F.col("first_sequence") + F.floor(nth / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("slot_offset") + F.pmod(nth, F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Tokenise, cut and pack docs (doc_id, text, any other columns); a digest stands for the ids so that only narrow rows are shuffled.

    Null and empty texts are one piece, the end id; texts of any length and any white space are tokenised whole; repeated
    rows and rows without doc_id are packed each. An empty table stays empty.
    """
    pieces = token_pieces(docs, capacity, end_id, vocabulary)
    narrow = materialise(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(narrow, capacity)


def assemble(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, from placed pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda joined, part: F.concat(joined, part["ids"]))
    return rows.select("sequence_id", "length", whole.alias("ids"))
