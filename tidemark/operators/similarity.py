"""Items as postings (item_id, term, weight), and the similarity joins over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.tables import step_path
from .ranking import best, first_k, rounded, without_seeds, written

#: Components that one row holds at most of a dense search's queries, and of its items: 8 MB of each meet in a task.
QUERY_BLOCK, ITEM_BLOCK = 1 << 20, 1 << 20


def normalised(postings: DataFrame) -> DataFrame:
    """Weights of each item scaled to unit length. Squares are summed before the shuffle, one row per item and task.

    Postings are moved once, and met with their norms by hash: nothing is sorted, so nothing spills.
    """
    norms = postings.groupBy("item_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    return postings.join(norms.hint("shuffle_hash"), "item_id").withColumn("weight", F.col("weight") / F.col("_norm")).drop("_norm")


def _idf(counts: DataFrame, items: DataFrame, least: int = 1, share: float = 1.0) -> DataFrame:
    """(term, df, idf) over counts (item_id, term), for terms in at least `least` and at most `share` of items."""
    total = items.agg(F.count(F.lit(1)).alias("total"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = df.join(F.broadcast(total)).where((F.col("df") >= least) & (F.col("df") <= share * F.col("total")))
    return kept.select("term", "df", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))


#: Terms up to which a vocabulary goes to every task, some 15 MB; a larger one is shuffled, the counts with it, and they meet by hash.
SMALL_VOCABULARY = 200_000


def _weighted(counts: DataFrame, idf: DataFrame, tf) -> DataFrame:
    """Unit-length postings of written counts (item_id, term, tf) and a written vocabulary."""
    known = idf.select("term", "idf")
    known = F.broadcast(known) if known.count() <= SMALL_VOCABULARY else known.hint("shuffle_hash")
    return normalised(counts.join(known, "term").select("item_id", "term", (tf * F.col("idf")).alias("weight")))


def _one_text(items: DataFrame) -> DataFrame:
    """items (item_id, text) with one row per item: texts of the same item one after another, on lines of their own."""
    items = items.select("item_id", "text")
    if items.groupBy("item_id").count().where("count > 1").isEmpty():
        return items
    return items.groupBy("item_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))


def term_counts(items: DataFrame, stop_words=X.STOP_WORDS) -> DataFrame:
    """(item_id, term, tf) of items (item_id, text), without stop words.

    An item's words are sorted and their runs counted within its row, so words are not shuffled.
    """
    words = _one_text(items).select("item_id", F.sort_array(F.filter(X.tokens(F.col("text")), lambda w: ~w.isin(*stop_words))).alias("w")).where("size(w) > 0")
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    runs = F.transform("s", lambda start, nth: F.struct(F.get("w", start).alias("term"), (F.coalesce(F.get("s", nth + 1), F.size("w")) - start).cast("long").alias("tf")))
    return words.select("item_id", "w", starts.alias("s")).select("item_id", F.inline(runs))


def vocabulary(items: DataFrame, least: int = 2, share: float = 0.5, stop_words=X.STOP_WORDS) -> DataFrame:
    """(term, df, idf) for terms in at least `least` items and at most `share` of them."""
    return _idf(term_counts(items, stop_words), items, least, share)


def tfidf_weights(items: DataFrame, least: int = 2, share: float = 0.5, stop_words=X.STOP_WORDS, of: DataFrame | None = None) -> DataFrame:
    """Unit-length postings with sublinear term frequency and smooth inverse document frequency, of all items or of those in `of` (item_id).

    Texts are read once, as their counts are written; the vocabulary is always that of all items.
    """
    counts = written(term_counts(items, stop_words))
    idf = written(_idf(counts, items, least, share))
    return _weighted(counts if of is None else counts.join(written(of.select("item_id")), "item_id", "left_semi"), idf, 1 + F.log("tf"))


def tfidf(items: DataFrame, least: int = 2, share: float = 0.5, stop_words=X.STOP_WORDS, of: DataFrame | None = None) -> DataFrame:
    """`tfidf_weights`, written, as similarity reads them twice."""
    return written(tfidf_weights(items, least, share, stop_words, of))


def trigram_counts(items: DataFrame) -> DataFrame:
    """(item_id, term, tf) over the padded word 3-grams of the normalised titles of items (item_id, title)."""
    grams = items.select("item_id", F.explode(X.word_trigrams(X.normalize_title(F.col("title")))).alias("term"))
    return grams.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def trigrams(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings of the titles' 3-grams, (term, idf)), both written."""
    counts = written(trigram_counts(items))
    idf = written(_idf(counts, items).select("term", "idf"))
    return written(_weighted(counts, idf, F.col("tf"))), idf


def reader_postings(interactions: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Readers as terms: every distinct (item_id, user_id) weighs 1 / sqrt(readers of the item).

    With `of` (item_id) only of the readers of those items, which is all that their similarity reads. Pass written
    interactions then: they are read three times, and few rows but the counts per item are moved.
    """
    pairs = interactions.select("item_id", F.col("user_id").alias("term")).where("item_id is not null and term is not null").distinct()
    readers = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    if of is not None:
        asked = written(interactions.join(F.broadcast(of.select("item_id").distinct()), "item_id", "left_semi").select("user_id").distinct())
        pairs = interactions.join(asked, "user_id", "left_semi").select("item_id", F.col("user_id").alias("term")).where("item_id is not null").distinct()
    return pairs.join(readers, "item_id").select("item_id", "term", (1 / F.sqrt("n")).alias("weight"))


def vector_postings(vectors: DataFrame) -> DataFrame:
    """A dense (item_id, vector) table in the same long form, its terms the components' places."""
    return vectors.select("item_id", F.posexplode("vector").alias("term", "weight")).withColumn("weight", F.col("weight").cast("double"))


#: Folders that laid-out postings are dealt to.
BUCKETS = 64


class PostingIndex:
    """Postings laid out for look-up, once in folders by hash of the term and once by hash of the item.

    Within a folder files are sorted by that key and carry Bloom filters of it, so a look-up of some keys opens the
    folders of their hashes alone and moves no postings. `bounds` has each term's number of postings and largest weight.
    """

    def __init__(self, postings: DataFrame):
        self.postings = written(postings.select("item_id", "term", "weight"))
        self.by = {key: self._laid_out(key) for key in ("term", "item_id")}
        self.bounds = written(term_bounds(self.postings))

    def _laid_out(self, key: str) -> DataFrame:
        spark, path = self.postings.sparkSession, step_path(self.postings.sparkSession)
        dealt = self.postings.withColumn("bucket", _bucket(key)).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", key)
        dealt.write.partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
        return spark.read.schema(dealt.schema).parquet(path)

    def of(self, key: str, wanted: DataFrame) -> DataFrame:
        """The folders (item_id, term, weight) that may hold rows with a key of `wanted`; at most BUCKETS numbers come to the driver."""
        buckets = sorted(r[0] for r in wanted.select(_bucket(key).alias("bucket")).distinct().collect())
        return self.by[key].where(F.col("bucket").isin(buckets)).drop("bucket")


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _of(postings: DataFrame | PostingIndex, key: str, wanted: DataFrame) -> DataFrame:
    return postings.of(key, wanted) if isinstance(postings, PostingIndex) else postings


def profiles(seeds: DataFrame, postings: DataFrame | PostingIndex) -> DataFrame:
    """(query_id, term, weight): per query the sum, not the mean, of its seeds' vectors.

    Seeds are written, so Spark knows how few they are and leaves the postings in place.
    """
    seeds = written(seeds.select("query_id", "item_id"))
    return seeds.join(_of(postings, "item_id", seeds), "item_id").groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))


def similar(seeds: DataFrame, postings: DataFrame | PostingIndex) -> DataFrame:
    """(query_id, item_id, score) for items that share a term with a query's seeds (query_id, item_id).

    An equi-join over the terms of the seeds only. The profile is written, so Spark knows its size: it broadcasts it when
    that allows, and the postings stay in place, and splits frequent terms otherwise.
    """
    p = written(profiles(seeds, postings).withColumnRenamed("weight", "w"))
    return p.join(_of(postings, "term", p), "term").groupBy("query_id", "item_id").agg(F.sum(F.col("w") * F.col("weight")).alias("score"))


#: Postings of the rarest terms that a bounded search adds up first, as a multiple of the list it looks for.
FIRST_POSTINGS = 50
#: Sums of bounds and of scores may differ by this where they are equal.
SLACK = 1e-7


def term_bounds(postings: DataFrame) -> DataFrame:
    """(term, df, high): each term's postings and their largest weight."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("high"))


def _added(terms: DataFrame, postings: DataFrame | PostingIndex, items: DataFrame | None) -> DataFrame:
    """(query_id, item_id, score) over some terms (query_id, term, w) of the queries' profiles."""
    sums = terms.select("query_id", "term", "w").join(_of(postings, "term", terms), "term").groupBy("query_id", "item_id").agg(F.sum(F.col("w") * F.col("weight")).alias("score"))
    return sums if items is None else sums.join(items.select("item_id"), "item_id", "left_semi").select("query_id", "item_id", "score")


@dataclass(frozen=True)
class BoundedSearch:
    """The k best items per query over postings with weights above zero, without adding up every pair that shares a term.

    `profile` (query_id, term, w, df, most) has each term's share of a score at most. The rarest terms alone give partial
    scores, and the k-th of those is a `threshold` that the k-th best reaches. Terms whose shares together stay below it
    are not `essential`: an item that has no other term cannot enter the list. `candidates` are items with an essential
    term that can still reach the threshold; only theirs are the remaining terms looked up for.
    """

    profile: DataFrame
    essential: DataFrame
    candidates: DataFrame
    postings: DataFrame | PostingIndex

    def scores(self) -> DataFrame:
        """(query_id, item_id, score) of the candidates, the k best of each query among them."""
        rest = self.essential.where("not needed").select("query_id", "term", "w")
        found = self.candidates.select("query_id", "item_id").join(_of(self.postings, "item_id", self.candidates), "item_id").join(rest, ["query_id", "term"])
        more = found.groupBy("query_id", "item_id").agg(F.sum(F.col("w") * F.col("weight")).alias("more"))
        return self.candidates.join(more, ["query_id", "item_id"], "left").select("query_id", "item_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def bounded(seeds: DataFrame, postings: DataFrame | PostingIndex, k: int, items: DataFrame | None = None) -> BoundedSearch:
    """A bounded search for the k best of items (all without), seeds left out, per query of seeds (query_id, item_id)."""
    bounds = postings.bounds if isinstance(postings, PostingIndex) else term_bounds(postings)
    known = profiles(seeds, postings).withColumnRenamed("weight", "w").join(bounds, "term")
    profile = written(known.select("query_id", "term", "w", "df", (F.col("w") * F.col("high")).alias("most")))
    earlier = W.partitionBy("query_id").orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)
    rare = profile.withColumn("_before", F.coalesce(F.sum("df").over(earlier), F.lit(0))).where(F.col("_before") < FIRST_POSTINGS * k)
    partial = rounded(without_seeds(_added(rare, postings, items), seeds))
    threshold = first_k(partial, k, ("query_id",), best()).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    upto = W.partitionBy("query_id").orderBy("most", "term").rowsBetween(W.unboundedPreceding, 0)
    together = profile.withColumn("_sum", F.sum("most").over(upto)).join(threshold, "query_id", "left").fillna(0.0, ["least"])
    essential = written(together.withColumn("needed", F.col("_sum") >= F.col("least") - SLACK).drop("_sum"))
    rest = essential.groupBy("query_id").agg(F.sum(F.when(~F.col("needed"), F.col("most")).otherwise(0.0)).alias("rest"), F.max("least").alias("least"))
    reached = without_seeds(_added(essential.where("needed"), postings, items), seeds).join(rest, "query_id")
    candidates = reached.where(F.col("score") + F.col("rest") >= F.col("least") - SLACK).select("query_id", "item_id", "score")
    return BoundedSearch(profile, essential, written(candidates), postings)


def best_similar(seeds: DataFrame, postings: DataFrame | PostingIndex, k: int, items: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, score): rows of `similar` among which are each query's k best, and no seeds."""
    return bounded(seeds, postings, k, items).scores()


def _blocks(rows: DataFrame, key: str, vector: str, components: int) -> DataFrame:
    """(block, keys, vectors): rows dealt by hash of their key into blocks of about so many components."""
    rows = rows.where(F.size(vector) > 0)
    held = rows.agg(F.sum(F.size(vector))).first()[0] or 0
    block = F.pmod(F.xxhash64(key), F.lit(max(1, -(-held // components)))).alias("block")
    packed = rows.groupBy(block).agg(F.collect_list(F.struct(F.col(key), F.col(vector).cast("array<double>").alias("v"))).alias("rows"))
    return packed.select("block", F.col(f"rows.{key}").alias(f"{key}s"), F.col("rows.v").alias(f"{vector}s"))


def dense_similar(profile: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, item_id, score): inner products of (query_id, profile) with every (item_id, vector) of its length.

    A stated set of queries against all rows, in blocks: both sides are packed into rows of bounded size, and each
    block of queries meets each block of items once, as two matrices. Nothing is broadcast, and any number of queries
    goes; vectors are read as many times as there are blocks of queries. Products of 0 to nine places have no row.
    """
    asked, held = profile.schema["query_id"].dataType, vectors.schema["item_id"].dataType
    q, v = _blocks(profile, "query_id", "profile", QUERY_BLOCK), _blocks(vectors, "item_id", "vector", ITEM_BLOCK)
    parts = int(profile.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = v.drop("block").repartition(parts).join(q.drop("block").hint("shuffle_replicate_nl"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                at = dict(zip(batch.schema.names, (column.slice(row, 1) for column in batch.columns), strict=True))
                asked_ids, item_ids = at["query_ids"].flatten(), at["item_ids"].flatten()
                yield from _products(asked_ids, at["profiles"].flatten(), item_ids, at["vectors"].flatten())

    return cells.select("query_ids", "profiles", "item_ids", "vectors").mapInArrow(run, T.StructType([T.StructField("query_id", asked), T.StructField("item_id", held), T.StructField("score", T.DoubleType())]))


def _products(asked_ids: pa.Array, asked: pa.Array, item_ids: pa.Array, items: pa.Array, most: int = 1 << 18):
    """Batches of (query_id, item_id, score) for two lists of vectors, of about `most` products each."""
    length_q, length_i = np.asarray(pc.list_value_length(asked)), np.asarray(pc.list_value_length(items))
    for n in np.intersect1d(length_q, length_i):
        some_q, some_i = pa.array(np.flatnonzero(length_q == n)), pa.array(np.flatnonzero(length_i == n))
        matrix = lambda x: x.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        a, b = matrix(asked.take(some_q)), matrix(items.take(some_i))
        for start in range(0, len(a), step := max(1, most // len(b))):
            scores = a[start : start + step] @ b.T
            of_q, of_i = np.nonzero(np.round(scores, 9))
            columns = [asked_ids.take(some_q.take(pa.array(of_q + start))), item_ids.take(some_i.take(pa.array(of_i))), pa.array(scores[of_q, of_i])]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "item_id", "score"])


def dense_profiles(seeds: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, profile): component-wise sums of the seeds' vectors."""
    long = profiles(seeds, vector_postings(vectors))
    return long.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("term", "weight"))), lambda x: x["weight"]).alias("profile"))


def shared_terms(a: int, b: int, postings: DataFrame, n: int = 10) -> DataFrame:
    """The n terms that add most to the similarity of two items."""
    left = postings.where(F.col("item_id") == a).select("term", F.col("weight").alias("w"))
    right = postings.where(F.col("item_id") == b)
    rows = left.join(right, "term").select("term", F.round(F.col("w") * F.col("weight"), 9).alias("score"))
    return rows.orderBy(F.desc("score"), "term").limit(n).select("term", F.round("score", 3).alias("score"))
