"""Document lengths of flat, unindexed token files by a separator scan.

A file is a run of token ids with an end-of-document id after each document. It is read as fixed-size blocks that
know nothing of documents: every block is searched for the separator in one vectorised comparison, and a prefix
scan over the blocks of a file carries the last separator's place to the next, so that documents cut by a block's
edge, or longer than many blocks, are measured whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import step_path
from .common import default_vocabulary, materialise, token_ids

#: Ids per block; the vocabulary's end-of-document id fits unsigned 16-bit files.
BLOCK_TOKENS, END_OF_DOCUMENT, KIND = 1 << 16, 50256, "<u2"
#: Blocks of a file that one row of the listing asks for.
RANGE_BLOCKS = 64
#: Blocks of a file whose carries are scanned together.
RUN_BLOCKS = 1024
BLOCKS = "file string, block long, start long, data binary"
ENDS = "file string, block long, start long, n long, first long, last long, gaps array<long>, doc_ids array<long>"


def read_flat(spark: SparkSession, path: str, kind: str = KIND, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, start, data): blocks of the flat files under path, of any size.

    Files are listed without their content and cut into byte ranges; each range is dealt out and read by offset,
    from a path that all executors see. Files of a store that only Spark opens are read whole, each below its 2 GB
    row limit.
    """
    step = block_tokens * np.dtype(kind).itemsize
    found = spark.read.format("binaryFile").load(path)
    one = found.select("path").first()
    if one and not one["path"].startswith("file:"):
        return _read_whole(found, step, block_tokens)

    def cut(batches):
        for batch in batches:
            for name, at, upto in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                with open("/" + name.removeprefix("file:").lstrip("/"), "rb") as f:
                    f.seek(at)
                    for k in range(at // step, -(-upto // step)):
                        yield pa.RecordBatch.from_pylist([{"file": name, "block": k, "start": k * block_tokens, "data": f.read(min(step, upto - k * step))}], _arrow(BLOCKS))

    size = F.lit(step * RANGE_BLOCKS)
    starts = found.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, size.cast("long"))).alias("at"))
    ranges = starts.select("path", "at", F.least(F.col("at") + size, "length").alias("upto"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return ranges.repartition(parts, "path", "at").mapInArrow(cut, BLOCKS)


def _read_whole(found: DataFrame, step: int, block_tokens: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, at in enumerate(range(0, len(content), step)):
                    yield pa.RecordBatch.from_pylist([{"file": name, "block": k, "start": k * block_tokens, "data": content[at : at + step]}], _arrow(BLOCKS))

    return found.select("path", "content").mapInArrow(cut, BLOCKS)


def write_flat(docs: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Tokenise documents into flat files in a local or mounted folder, one per task; (file, ordinal, doc_id) of what was written.

    A file is named by its task's attempt: those of attempts that were lost have no rows here.
    """
    path = vocabulary or default_vocabulary()

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name, ordinal = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.bin", 0
        with open(f"{folder}/{name}", "wb") as f:
            for batch in batches:
                for text in batch.column(1).to_pylist():
                    f.write(np.append(token_ids(path, text, False), END_OF_DOCUMENT).astype(KIND).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0).cast(pa.int64())], names=["file", "ordinal", "doc_id"])
                ordinal += n

    return materialise(docs.select("doc_id", "text").mapInArrow(write, "file string, ordinal long, doc_id long"))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def flat_blocks(docs: DataFrame, vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenise documents into flat files, one per input partition, as blocks with a sidecar of document ids.

    (file, block, start, data, doc_ids): doc_ids lists, in order, the documents that end in the block.
    """
    path = vocabulary or default_vocabulary()
    schema = _arrow(BLOCKS + ", doc_ids array<long>")

    def write(batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}"
        held, size, block, ids = [], 0, 0, []

        def cut(last=False):
            nonlocal held, size, block, ids
            flat = np.concatenate(held) if held else np.zeros(0, KIND)
            at, ends = 0, np.flatnonzero(flat == END_OF_DOCUMENT)
            while len(flat) - at >= block_tokens or last and at < len(flat):
                part = flat[at : at + block_tokens]
                done = np.searchsorted(ends, at + len(part)) - np.searchsorted(ends, at)
                yield pa.RecordBatch.from_pylist([{"file": name, "block": block, "start": block * block_tokens, "data": part.tobytes(), "doc_ids": ids[:done]}], schema)
                ids, block, at = ids[done:], block + 1, at + block_tokens
            held, size = [flat[at:]], max(0, len(flat) - at)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(np.append(token_ids(path, text, False), END_OF_DOCUMENT).astype(KIND))
                ids.append(doc_id)
                size += len(held[-1])
                if size >= 8 * block_tokens:
                    yield from cut()
        yield from cut(last=True)

    return docs.select("doc_id", "text").mapInArrow(write, BLOCKS + ", doc_ids array<long>")


def document_lengths(blocks: DataFrame, end: int = END_OF_DOCUMENT, kind: str = KIND) -> DataFrame:
    """(file, ordinal, n_tokens, ended, doc_id): every document of flat files, separators not counted.

    Ids after a file's last separator make a last document with ended false. doc_id comes from a doc_ids column
    if blocks have one, else it is null. Blocks are scanned apart and their ends written; narrow rows, one a block, are
    scanned within runs of RUN_BLOCKS blocks, and one row a run meets per file. Files without ids have no documents.
    """
    sidecar = "doc_ids" in blocks.columns

    def scan(batches):
        for batch in batches:
            names = batch.schema.names
            rows = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["data"], kind)
                ends = np.flatnonzero(ids == end)
                rows.append({"file": row["file"], "block": row["block"], "start": row["start"], "n": len(ids), "first": row["start"] + int(ends[0]) if len(ends) else None, "last": row["start"] + int(ends[-1]) if len(ends) else None, "gaps": (np.diff(ends) - 1).tolist(), "doc_ids": row["doc_ids"] if "doc_ids" in names else None})
            yield pa.RecordBatch.from_pylist(rows, _arrow(ENDS))

    found = materialise(blocks.select("file", "block", "start", "data", *(["doc_ids"] if sidecar else [])).mapInArrow(scan, ENDS))
    count = F.when(F.col("first").isNotNull(), F.size("gaps") + 1).otherwise(0)
    narrow = found.select("file", "block", F.floor(F.col("block") / RUN_BLOCKS).alias("run"), "last", count.alias("count"))
    earlier = W.partitionBy("file").orderBy("run")
    runs = narrow.groupBy("file", "run").agg(F.max("last").alias("last"), F.sum("count").alias("count"), F.max("block").alias("end"))
    upto = earlier.rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("file", "run", F.max("last").over(upto).alias("run_last"), F.sum("count").over(upto).alias("run_count"), F.when(F.lead("run").over(earlier).isNull(), F.col("end")).alias("final"))
    within = W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = narrow.select("file", "block", "run", F.max("last").over(within).alias("own_last"), F.sum("count").over(within).alias("own_count")).join(runs, ["file", "run"])
    before = before.select(
        "file", "block", F.coalesce(F.greatest("own_last", "run_last"), F.lit(-1)).alias("previous"), (F.coalesce("own_count", F.lit(0)) + F.coalesce("run_count", F.lit(0))).alias("done"), F.coalesce(F.col("final") == F.col("block"), F.lit(False)).alias("final")
    )
    carried = found.join(before, ["file", "block"])
    whole = F.when(F.col("first").isNotNull(), F.concat(F.array(F.col("first") - F.col("previous") - 1), F.col("gaps"))).otherwise(F.array().cast("array<long>"))
    stop = F.col("start") + F.col("n") - 1
    tail = F.when(F.col("final") & (stop > F.greatest("last", "previous")), F.array(stop - F.greatest("last", "previous"))).otherwise(F.array().cast("array<long>"))
    listed = carried.select("file", "done", "doc_ids", F.size(whole).alias("ended"), F.posexplode(F.concat(whole, tail)).alias("k", "n_tokens"))
    return listed.select("file", (F.col("done") + F.col("k")).alias("ordinal"), "n_tokens", (F.col("k") < F.col("ended")).alias("ended"), F.get("doc_ids", F.col("k")).alias("doc_id"))


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal) per row of docs (doc_id, text, any other columns).

    Null and empty texts have 0 tokens, texts of any length and any run of white space are counted whole, and repeated
    rows and rows without doc_id each. Documents are written as flat files among the tables between steps and measured
    by the scan of those files. Where Python cannot open the shared folder, the blocks are scanned as they are made.
    """
    spark = docs.sparkSession
    base = step_path(spark)
    if not base.startswith(("file:", "/")):
        return document_lengths(flat_blocks(docs, vocabulary)).select("doc_id", "n_tokens", "file", "ordinal")
    folder = "/" + base.removeprefix("file:").lstrip("/")
    os.makedirs(folder)
    written = write_flat(docs, folder, vocabulary)
    lengths = document_lengths(read_flat(spark, f"file://{folder}")).select(F.substring_index("file", "/", -1).alias("file"), "ordinal", "n_tokens")
    # Both sides grow with the documents, so neither is broadcast.
    return written.join(lengths.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", F.substring("file", 1, 11).alias("file"), "ordinal")
