"""Helpers that several operators share: tables, lineage cuts, ranks and tokens."""

from __future__ import annotations

import json
from contextlib import contextmanager
from functools import lru_cache
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import step_path

#: ASCII white space, as the contracts of the word operators list it.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch while tables are written: texts reach Python a few MB at a time.
BATCH_BYTES = "8m"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def small_batches(spark: SparkSession):
    """Within it, Spark hands rows to Python in batches of at most BATCH_BYTES."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = step_path(spark)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no plan still to be run reads."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Materialised tables between steps, deleted together once no plan still to be run reads them."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(materialise(df))
        return self.tables[-1]

    def drop(self) -> None:
        discard(*self.tables)
        self.tables.clear()


def set_aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """(docs with the columns other than needed renamed by their place, old name -> new name).

    Between this and the renaming back no column that an operator adds can clash with one of docs.
    """
    names = {c: c if c in needed else f"in_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def salt_buckets(rows: int, per_bucket: int = 8192, least: int = 64) -> int:
    """How many salt values keep any one key's rows in a bucket near per_bucket, even if it holds all rows."""
    return max(least, -(-rows // per_bucket))


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], buckets: int, name: str = "rank") -> DataFrame:
    """Add the 0-based rank of each row within keys, without gathering a key in one task.

    A row's salt is a hash of its order columns. Rows are ranked within (keys, salt) and shifted by the
    number of rows of the key in smaller salts, so the order is (salt, order): seeded by content, the same
    on each run, and independent of partitioning. Only (key, salt) counts meet by key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    null_safe = [x for i, k in enumerate(keys) for x in (F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}"), F.col(k).isNull().alias(f"_z{i}"))]
    names = [f"_{kind}{i}" for i in range(len(keys)) for kind in "kz"]
    salted = salted.select("*", *null_safe)
    counts = salted.groupBy(*names, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*names).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*names, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = salted.withColumn("_rn", F.row_number().over(W.partitionBy(*names, "_salt").orderBy(*order)))
    joined = ranked.join(starts, [*names, "_salt"])
    return joined.withColumn(name, F.col("_start") + F.col("_rn") - 1).drop(*names, "_salt", "_rn", "_start")


def prefix_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, by name, the sum of each column over the rows before a row in a total order, without sorting all in one task.

    Rows are dealt by range; each range sums its own rows, from the sum of the ranges before it: one row per range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(rows.withColumns({f"x_{n}": c for n, c in sums.items()}).repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    totals = dealt.groupBy("range").agg(*[F.sum(f"x_{n}").alias(f"t_{n}") for n in sums])
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("range", *[F.coalesce(F.sum(f"t_{n}").over(before), F.lit(0)).alias(f"s_{n}") for n in sums])
    within = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = dealt.withColumns({n: F.coalesce(F.sum(f"x_{n}").over(within), F.lit(0)) for n in sums})
    return own.join(starts, "range").select(*rows.columns, *[(F.col(n) + F.col(f"s_{n}")).alias(n) for n in sums])


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def default_vocabulary() -> str:
    """Place of the byte-level BPE vocabulary, read by the executors from their own Python installation."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers JSON file with its special tokens, in a faster implementation.

    encode_to_numpy(text, allowed_special="all") gives the ids that tokenizers gives without added special tokens;
    allowed_special=() reads the special tokens' strings as ordinary text. Its patterns give up on runs of white space
    of about a million characters; token_ids does not.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    letters, special = _byte_letters(), {t["content"]: t["id"] for t in held["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): rank for token, rank in held["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def whole_encoder(path: str, special: bool):
    """The vocabulary by `tokenizers` itself: slower, for texts of any shape."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    return tokenizer


def token_ids(path: str, text: str | None, special: bool):
    """The ids of a whole text (null: none) as unsigned 32-bit numbers, as `tokenizers` gives them.

    `special` tells whether the special tokens' strings in a text stand for those tokens. Texts whose white space is
    too long for the faster implementation go to `tokenizers`.
    """
    try:
        return encoder(path).encode_to_numpy(text or "", allowed_special="all" if special else set(), disallowed_special=())
    except ValueError:
        import numpy as np

        return np.array(whole_encoder(path, special).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
