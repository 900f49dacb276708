"""Importance resampling towards a target distribution, by n-grams from position tables.

Words are exploded with their positions; within a document, ordered by position, lead() puts the following words
beside each one, so a row holds its n-grams of every order. N-grams are hashed into buckets, grouped, and a bucket's
gain is the logarithm of how much likelier the target's texts hold it. A document's weight is its mean gain; Gumbel
noise of its doc_id turns the highest weights into a draw without replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, prefix_sums

# ASCII letters, and what words are made of: ASCII letters and digits, and everything beyond ASCII.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order, ASCII letters in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def features(texts: DataFrame, key: str, orders: int = 2, buckets: int = 10_000) -> DataFrame:
    """(key, bucket, n, n_words): per key how many n-grams of 1 to `orders` words fall into each bucket.

    n_words is the share of n that single words have, so its sum over a key is the number of its words. `key` must
    tell rows of texts (key, text) apart. Whole texts are dealt by key once: the position window and the counts then
    need no further shuffle, and a text of any length is sorted by Spark, which spills.
    """
    dealt = texts.select(key, "text").repartition(F.col(key))
    placed = dealt.select(key, F.posexplode(words(F.col("text"))).alias("position", "w1"))
    following = W.partitionBy(key).orderBy("position")
    tabled = placed.select("*", *[F.lead("w1", k - 1).over(following).alias(f"w{k}") for k in range(2, orders + 1)])
    grams = [F.when(F.col(f"w{n}").isNotNull(), F.concat_ws(" ", *[f"w{k}" for k in range(1, n + 1)])) for n in range(1, orders + 1)]
    listed = tabled.select(key, F.posexplode(F.array(*grams)).alias("order", "gram")).where("gram is not null")
    bucket = (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int").alias("bucket")
    return listed.groupBy(key, bucket).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("order") == 0).alias("n_words"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) for every bucket, from (bucket, n) of source and target: counts are smoothed by 1."""
    spark = source.sparkSession
    counted = lambda df, name: df.groupBy("bucket").agg(F.sum("n").alias(name))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counted(source, "s"), "bucket", "left").join(counted(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    # One row per bucket: a number that the caller fixes.
    both = materialise(both)
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = ((F.col("t") + 1) * F.lit(total["s"] + buckets).cast("double")) / ((F.col("s") + 1) * F.lit(total["t"] + buckets).cast("double"))
    return both.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = 7) -> Column:
    """Gumbel noise in thousandths, from a digest of the seed and doc_id (null: the empty string)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, orders: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs (doc_id, text, any other columns).

    target has text. weight is the floored mean gain of a row's n-grams, 0 without any (null and empty texts, texts
    without words); score adds the noise of doc_id. Of the N rows with least_words words or more, the percent * N / 100
    (floored) with the highest scores are drawn and numbered by rank from 1, ties to the smaller doc_id, null ids first;
    rank is null for the others. Rows that repeat a doc_id are rows of their own, with the same noise; rows that are
    equal throughout take ranks side by side. Texts of any length count whole; empty tables stay empty, and an empty
    target leaves gains that favour rare n-grams.
    """
    rows = materialise(docs.select("doc_id", "text").withColumn("key", F.monotonically_increasing_id()))
    found = materialise(features(rows, "key", orders, buckets))
    aimed = features(target.select("text").withColumn("key", F.monotonically_increasing_id()), "key", orders, buckets)
    # Bounded by the number of buckets.
    gain = F.broadcast(gains(found, aimed, buckets))
    sums = found.join(gain, "bucket").groupBy("key").agg(F.sum("n").alias("n_features"), F.sum("n_words").alias("n_words"), F.sum(F.col("n") * F.col("gain")).alias("total"))
    joined = rows.select("key", "doc_id").join(sums, "key", "left").fillna(0, ["n_features", "n_words", "total"])
    # The floor of total / n_features in whole numbers.
    mean = F.expr("(total - pmod(total, n_features)) div n_features")
    weight = F.when(F.col("n_features") > 0, mean).otherwise(F.lit(0)).cast("long")
    scored = materialise(joined.select("doc_id", "n_features", "n_words", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.where(enough).count() // 100
    ranked = prefix_sums(scored, [F.desc("score"), F.asc_nulls_first("doc_id")], {"before": enough.cast("long")})
    rank = F.when(enough & (F.col("before") < drawn), F.col("before") + 1).cast("long")
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def resampled_sql(percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7) -> str:
    """The same draw for one and two words in DuckDB SQL, which has no CRC-32: it is folded byte by byte."""
    number = lambda h: f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, len({h}) + 1), lambda d: CAST(instr('0123456789abcdef', substr({h}, d, 1)) - 1 AS BIGINT))), lambda a, d: a * 16 + d)"
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    grams = "SELECT {key}, w[i] AS g FROM (SELECT {key}, w, unnest(range(1, len(w) + 1)) AS i FROM {t}) UNION ALL SELECT {key}, w[i] || ' ' || w[i + 1] FROM (SELECT {key}, w, unnest(range(1, len(w))) AS i FROM {t})"
    return f"""WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents), b AS MATERIALIZED (SELECT 0 AS r, {split} AS w FROM benchmark),
dg AS MATERIALIZED (SELECT r, g, count(*) AS n FROM ({grams.format(key="r", t="d")}) GROUP BY ALL), bg AS MATERIALIZED (SELECT g, count(*) AS n FROM ({grams.format(key="r", t="b")}) GROUP BY g),
bytes AS (SELECT g, lower(hex(encode(g))) AS h FROM (SELECT g FROM dg UNION SELECT g FROM bg)),
crc AS MATERIALIZED (SELECT g, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(h) // 2 + 1), lambda i: CAST((instr('0123456789abcdef', substr(h, 2 * i - 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, 2 * i, 1)) - 1 AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {buckets} AS k FROM bytes, tab),
s AS (SELECT k, sum(n) AS s FROM dg JOIN crc USING (g) GROUP BY k), t AS (SELECT k, sum(n) AS t FROM bg JOIN crc USING (g) GROUP BY k),
tot AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS ss, coalesce((SELECT sum(t) FROM t), 0) AS tt),
gain AS (SELECT k, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ss + {buckets} AS DOUBLE)) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(tt + {buckets} AS DOUBLE)))) AS BIGINT) AS gain FROM (SELECT unnest(range({buckets})) AS k) LEFT JOIN s USING (k) LEFT JOIN t USING (k), tot),
m AS (SELECT r, CAST(sum(n) AS BIGINT) AS f, CAST(sum(n * gain) AS BIGINT) AS total FROM dg JOIN crc USING (g) JOIN gain USING (k) GROUP BY r),
e AS (SELECT r, doc_id, len(w) AS words, coalesce(f, 0) AS n_features, coalesce((total - ((total % f) + f) % f) // f, 0) AS weight, substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS h FROM d LEFT JOIN m USING (r)),
x AS (SELECT r, doc_id, words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((CAST({number("h")} AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM e),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM x WHERE words >= {least_words} QUALIFY rank <= {percent} * count(*) OVER () // 100)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(rank AS BIGINT) AS rank FROM x LEFT JOIN drawn USING (r)"""
