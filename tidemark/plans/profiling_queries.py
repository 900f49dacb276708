"""Queries that profile tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import profiling as P
from ..operators.catalog import first_of
from ..sources.tables import table
from .registry import query

c, lit = F.col, F.lit
DIGEST_SQL = r"md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\p{Z}]+', ' ', 'g')))"
GROUPS_SQL = f"SELECT {DIGEST_SQL} AS digest, count(*) AS n_items, count(DISTINCT source) AS n_authors, count(DISTINCT lang) AS n_titles, min(doc_id) AS first_id FROM documents GROUP BY 1"


def _texts(spark, d):
    return table(spark, d, "documents").select(c("doc_id").alias("item_id"), c("lang").alias("title"), c("source").alias("author"), "text")


@query("SELECT nullif(lang, 'de') AS lang, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark, d):
    return P.value_counts(table(spark, d, "documents"), F.nullif(c("lang"), lit("de")).alias("lang"))


@query(r"SELECT split_part(regexp_replace(c_mktsegment || ',  x', '\s+', ' ', 'g'), ',', 1) AS author, count(*) AS n FROM customer GROUP BY 1")
def value_counts_author(spark, d):
    author = F.split_part(F.regexp_replace(F.concat("c_mktsegment", lit(",  x")), r"\s+", " "), lit(","), lit(1))
    return P.value_counts(table(spark, d, "customer"), author.alias("author"))


@query("SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in ("en", "fr", "de", "es")) + " FROM documents GROUP BY source")
def crosstab(spark, d):
    return P.crosstab(table(spark, d, "documents"), "source", "lang", ["en", "fr", "de", "es"])


@query("SELECT count(n) AS n, round(avg(n), 6) AS mean, min(n) AS low, round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS q50, round(quantile_cont(n, 0.9), 6) AS q90, max(n) AS high FROM (SELECT length(text) AS n FROM documents)")
def describe_length(spark, d):
    found = P.described(table(spark, d, "documents"), F.length("text").cast("long"), q25=0.25, q50=0.5, q90=0.9)
    return found.withColumns({x: F.round(x, 6) for x in ("mean", "q25", "q50", "q90")})


@query("SELECT CAST(least(floor(n_chars / 500), 40) AS BIGINT) AS bin, CAST(floor(ln(1 + n_chars)) AS BIGINT) AS log_bin, count(*) AS n FROM documents GROUP BY 1, 2")
def histogram(spark, d):
    linear, log = F.least(F.floor(c("n_chars") / 500), lit(40)).cast("long"), F.floor(F.log(1 + c("n_chars"))).cast("long")
    return P.value_counts(table(spark, d, "documents"), linear.alias("bin"), log.alias("log_bin"))


@query("WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS r FROM s) SELECT CASE WHEN r <= 10 THEN source ELSE 'Other' END AS source, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def top_n_other(spark, d):
    return P.top_and_other(table(spark, d, "documents"), "source", 10)


@query("SELECT CAST(value AS INTEGER) AS value, count(o_orderkey) AS n FROM range(1990, 2011) t(value) LEFT JOIN orders ON year(o_orderdate) = value GROUP BY 1")
def dense_year_counts(spark, d):
    return P.dense_counts(table(spark, d, "orders"), F.year("o_orderdate"), 1990, 2010)


@query("SELECT count(*) - count(DISTINCT p_name) AS by_title, count(*) - count(DISTINCT (p_name, p_type)) AS by_both FROM part")
def duplicate_counts(spark, d):
    return P.repeats(table(spark, d, "part"), by_title=("p_name",), by_both=("p_name", "p_type"))


@query("SELECT count(*) FILTER (nullif(event_type, 'error') IS NULL) AS event_type, count(*) FILTER (value IS NULL) AS value, count(*) FILTER (props = '{\"k\": 7}') AS sentinel FROM events")
def null_counts(spark, d):
    kind = F.nullif(c("event_type"), lit("error"))
    return P.counts_where(table(spark, d, "events"), event_type=kind.isNull(), value=c("value").isNull(), sentinel=c("props") == '{"k": 7}')


@query("SELECT count(*) FILTER (n_chars < 100) AS short, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END), 6) AS long_share, count(*) FILTER (lang = 'en') AS english FROM documents")
def conditional_shares(spark, d):
    share = F.round(P.share_of(c("n_chars") > 1000), 6)
    return table(spark, d, "documents").agg(F.count_if(c("n_chars") < 100).alias("short"), share.alias("long_share"), F.count_if(c("lang") == "en").alias("english"))


@query(f"SELECT *, CASE WHEN n_items = 1 THEN 'unique' WHEN n_authors >= 2 OR n_titles > 3 THEN 'boilerplate' ELSE 'duplicate' END AS kind FROM ({GROUPS_SQL})")
def classify_shared_text(spark, d):
    return P.classified(P.shared_text_groups(_texts(spark, d)))


@query(f"SELECT doc_id AS item_id, n_authors >= 2 AS shared FROM documents JOIN ({GROUPS_SQL}) ON {DIGEST_SQL} = digest")
def shared_description_mask(spark, d):
    return P.shared_mask(_texts(spark, d).withColumn("title", c("author")), 2)


@query(f"SELECT {DIGEST_SQL} AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_text(spark, d):
    docs = table(spark, d, "documents").select(F.md5(X.normalized_text(c("text"))).alias("digest"), "doc_id")
    return first_of(docs, ["digest"], c("doc_id"))


HEX_SQL = """WITH p AS ({points}), c AS (SELECT x / {w} - y / {h} / 2 AS q, y / {h} AS r FROM p), s AS (SELECT *, -q - r AS s FROM c),
n AS (SELECT *, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(s + 0.5) AS rs FROM s), o AS (SELECT *, abs(rq - q) AS oq, abs(rr - r) AS o_r, abs(rs - s) AS os FROM n),
f AS (SELECT CAST(CASE WHEN oq > o_r AND oq > os THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN oq > o_r AND oq > os THEN rr WHEN o_r > os THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM o)
SELECT q, r, round((q + r / 2) * {w}, 6) AS x, round(r * {h}, 6) AS y, count(*) AS n FROM f GROUP BY q, r"""


def _hexagons(spark, d, name, x, y, width, height, log=False):
    cells = P.hexagons(table(spark, d, name), x, y, width, height, log)
    return cells.select("q", "r", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


@query(HEX_SQL.format(points="SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem", w="2.0::DOUBLE", h="4000.0::DOUBLE"))
def hexbin_counts(spark, d):
    """Lines per hexagon of quantity and price."""
    return _hexagons(spark, d, "lineitem", c("l_quantity"), c("l_extendedprice"), 2.0, 4000.0)


@query(HEX_SQL.format(points="SELECT log10(n_chars) AS x, log10(length(text)) AS y FROM documents WHERE n_chars > 0 AND length(text) > 0", w="0.125::DOUBLE", h="0.125::DOUBLE"))
def hexbin_log_counts(spark, d):
    """Documents per hexagon of stated and real length, in powers of ten."""
    return _hexagons(spark, d, "documents", c("n_chars"), F.length("text"), 0.125, 0.125, True)
