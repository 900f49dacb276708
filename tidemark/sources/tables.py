"""Readers and writers. Text files are read as strings under the columns asked for; only the empty string is null."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; a missing one is named in the error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no table at {path}; build it first or pass another path") from error


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def quoted_line_ends(spark: SparkSession, path: str) -> dict[str, bool]:
    """For each text file under path whether a quoted value holds a line end, or may.

    A line that begins outside quotes and ends within them has an odd number of quotes; where every line has an even
    number, no line end is quoted. One pass over the lines, which Spark deals out in parts of files; a row per file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (F.regexp_count("value", F.lit('"')) % 2).alias("odd"))
    return {r["file"]: bool(r["odd"]) for r in lines.groupBy("file").agg(F.max("odd").alias("odd")).collect()}


def read_text_table(spark: SparkSession, path: str, columns: list[str], types: dict[str, str] | None = None, order: str | None = None) -> DataFrame:
    """Columns of a headed CSV as strings, '' as null; `types` narrows some of them, null where a value doesn't fit.

    No columns: all that the header names. The projection reaches the scan. Files are read in parts by many tasks; only
    those with quoted line ends are read whole, by one task each, and have \n for such a line end. `order` names a column to add by which rows sort as
    they stand in the files, the files by name.
    """
    whole = quoted_line_ends(spark, path)
    kinds = [(many, files) for many in (False, True) if (files := sorted(f for f, quoted in whole.items() if quoted == many))]
    out = None
    for many, files in kinds or [(False, path)]:
        raw = spark.read.option("header", True).option("multiLine", many).option("escape", '"').csv(files)
        wanted = columns or raw.columns
        missing = [c for c in wanted if c not in raw.columns]
        if missing:
            raise KeyError(f"{path} lacks the columns {missing}")
        strings = [F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in wanted]
        place = [F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias(order)] if order else []
        part = raw.select(*strings, *place).withColumns({c: F.col(f"`{c}`").try_cast(kind) for c, kind in (types or {}).items()})
        out = part if out is None else out.unionByName(part)
    return out


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables between steps, seen by the driver and all executors: spark.checkpoint.dir.

    Where the session names none, a local master gets a folder of this machine; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def step_path(spark: SparkSession) -> str:
    """A new place in the shared folder for a table between steps, under this application's name."""
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear_steps(spark: SparkSession) -> None:
    """Delete the tables between steps of this application; results that still read them must be saved before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# --- the alias table beside a catalogue -----------------------------------------------------------------------

ALIASES = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("kept_id", T.StringType())])


def beside(path: str, name: str) -> str:
    """A table's place beside a catalogue: shop/books.parquet and aliases give shop/books_aliases.parquet."""
    return f"{path.removesuffix('/').removesuffix('.parquet')}_{name}.parquet"


def write_aliases(aliases: DataFrame, catalog_path: str) -> None:
    write_table(aliases.select(*[F.col(f.name).cast(f.dataType) for f in ALIASES]), beside(catalog_path, "aliases"))


def read_aliases(spark: SparkSession, catalog_path: str) -> DataFrame:
    """The alias table of a catalogue; one without, as of a single source, has no aliases."""
    try:
        return read_table(spark, beside(catalog_path, "aliases")).select(*ALIASES.names)
    except FileNotFoundError:
        return spark.createDataFrame([], ALIASES)


# --- the vector cache of a catalogue --------------------------------------------------------------------------


def id_mismatches(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """(item_id, side): ids that only the catalogue or only the vectors hold."""
    a, b = items.select("item_id").distinct(), vectors.select("item_id").distinct()
    return a.join(b, "item_id", "left_anti").withColumn("side", F.lit("catalog")).union(b.join(a, "item_id", "left_anti").withColumn("side", F.lit("vectors")))


def write_vectors(vectors: DataFrame, catalog_path: str) -> None:
    """The vectors (item_id, vector) of a catalogue into its cache."""
    write_table(vectors.select("item_id", F.col("vector").cast("array<float>")), beside(catalog_path, "vectors"))


def read_vectors(items: DataFrame, path: str) -> DataFrame:
    """Cached vectors of exactly the catalogue's items."""
    vectors = read_table(items.sparkSession, path)
    if not id_mismatches(items, vectors).isEmpty():
        raise ValueError(f"the ids at {path} are not the catalogue's; build the vectors again")
    return vectors


def cached_vectors(items: DataFrame, catalog_path: str) -> DataFrame | None:
    """The vectors in a catalogue's cache, or None without a cache; ids are checked."""
    try:
        read_table(items.sparkSession, beside(catalog_path, "vectors"))
    except FileNotFoundError:
        return None
    return read_vectors(items, beside(catalog_path, "vectors"))
