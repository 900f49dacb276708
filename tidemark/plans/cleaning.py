"""Queries of value cleaners, filters and the catalogue build, over the driver's tables.

Items are parts (title p_name, author p_type, tags p_type and p_brand); the two catalogue sources are the even
and the odd parts; interactions are the orders' lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import udf as U
from ..operators import catalog, popularity
from ..operators.profiling import banded_sample
from ..sources.tables import id_mismatches, table
from .registry import projection, query

c, lit = F.col, F.lit
LABELS = ", ".join(f"'{x}'" for x in X.ENGLISH_LABELS)
UNKNOWN = ", ".join(f"'{x}'" for x in X.UNKNOWN_LABELS)
SUFFIXES = ", ".join(f"'{x}'" for x in X.NAME_SUFFIXES)


def fold_sql(x: str) -> str:
    return f"strip_accents(replace(lower({x}), 'ß', 'ss'))"


def title_sql(x: str) -> str:
    plain = rf"regexp_replace({fold_sql(x)}, '\s*\(.*?\)|\s*\[.*?\]', '', 'g')"
    plain = f"replace(split_part({plain}, ':', 1), '&', ' and ')"
    plain = rf"trim(regexp_replace(regexp_replace({plain}, '[^\p{{L}}\p{{N}}_ ]', '', 'g'), '\s+', ' ', 'g'))"
    return f"nullif(regexp_replace({plain}, '^(the|a|an) ', ''), '')"


def author_sql(x: str) -> str:
    """display_author"""
    name = rf"trim(regexp_replace({x}, '\s*\(.*?\)', '', 'g'))"
    last, first = f"trim(split_part({name}, ',', 1))", f"trim(split_part({name}, ',', 2))"
    suffix = rf"regexp_replace(lower({first}), '^\.+|\.+$', '', 'g') IN ({SUFFIXES})"
    swapped = f"CASE WHEN {suffix} THEN {last} || ' ' || {first} ELSE {first} || ' ' || {last} END"
    return rf"nullif(trim(regexp_replace(CASE WHEN len(string_split({name}, ',')) = 2 THEN {swapped} ELSE {name} END, '\s+', ' ', 'g')), '')"


def key_sql(x: str) -> str:
    """author_key"""
    tokens = rf"list_filter(regexp_extract_all({fold_sql(author_sql(x))}, '[\p{{L}}\p{{Nl}}\p{{No}}]+'), lambda t: t NOT IN ({SUFFIXES}))"
    return f"CASE len({tokens}) WHEN 0 THEN NULL WHEN 1 THEN {tokens}[1] ELSE {tokens}[-1] || '_' || left({tokens}[1], 1) END"


html_title = lambda: F.regexp_extract("html", "<title>(.*?)</title>", 1)
HTML_TITLE_SQL = "regexp_extract(html, '<title>(.*?)</title>', 1)"
person = lambda: F.concat(c("c_mktsegment"), F.element_at(F.array(*map(lit, (", J.R.R.", ", Jr.", " Ann (Editor)", "; Lee, Bo", ", Ann (Tr.), Bo"))), F.pmod(c("c_nationkey"), lit(5)) + 1))
PERSON_SQL = "(c_mktsegment || ([', J.R.R.', ', Jr.', ' Ann (Editor)', '; Lee, Bo', ', Ann (Tr.), Bo'])[c_nationkey % 5 + 1])"


def _customer(name, f, sql):
    projection(name, "customer", lambda: {"c_custkey": c("c_custkey"), "value": f(person())}, f"SELECT c_custkey, {sql} AS value FROM customer")



projection("scan_catalog", "part", lambda: {x: c(x) for x in ("p_partkey", "p_name", "p_type")}, "SELECT p_partkey, p_name, p_type FROM part")
projection("fold_text", "documents", lambda: {"doc_id": c("doc_id"), "folded": X.fold(c("text"))}, f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents")
projection("normalize_title", "pages", lambda: {"page_id": c("page_id"), "title": X.normalize_title(html_title())}, f"SELECT page_id, {title_sql(HTML_TITLE_SQL)} AS title FROM pages")
_customer("display_author", X.display_author, author_sql(PERSON_SQL))
_customer("author_key", X.author_key, key_sql(PERSON_SQL))
_customer("first_author_comma", X.first_author_by_comma, rf"nullif(trim(regexp_replace(split_part({PERSON_SQL}, ',', 1), '\s*\(.*?\)', '', 'g')), '')")
_customer("first_author_semicolon", X.first_author_by_semicolon, author_sql(f"split_part({PERSON_SQL}, ';', 1)"))
CLEAN = r"trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
projection("clean_description", "pages", lambda: {"page_id": c("page_id"), "description": X.clean_description(c("html"))}, f"SELECT page_id, CASE WHEN length(d) >= 50 THEN d END AS description FROM (SELECT page_id, {CLEAN.format('html')} AS d FROM pages)")
projection(
    "filter_english", "documents", lambda: {"doc_id": c("doc_id"), "lang": c("lang")},
    f"SELECT doc_id, lang FROM documents WHERE CASE WHEN lang IS NULL OR lower(trim(lang)) IN ({UNKNOWN}) THEN true ELSE lower(trim(lang)) IN ({LABELS}) END", lambda: X.is_english(c("lang")),
)
list_column = lambda: F.when(c("p_size") % 9 == 0, lit("oops")).otherwise(F.concat(lit("['"), c("p_type"), lit("', \""), c("p_brand"), lit("\"]")))
projection("parse_list_literal", "part", lambda: {"p_partkey": c("p_partkey"), "items": F.array_join(X.list_literal(list_column()), "|")}, "SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_type || '|' || p_brand END AS items FROM part")
projection("parse_any_list_literal", "part", lambda: {"p_partkey": c("p_partkey"), "items": F.array_join(U.any_list_literal(list_column()), "|")}, "SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_type || '|' || p_brand END AS items FROM part")
projection("sentinel_to_null", "events", lambda: {"event_id": c("event_id"), "event_type": F.nullif(c("event_type"), lit("error"))}, "SELECT event_id, nullif(event_type, 'error') AS event_type FROM events")
number_column = lambda: F.when(c("p_size") % 7 == 0, lit("n/a")).otherwise(c("p_retailprice").cast("string"))
projection("coerce_numeric", "part", lambda: {"p_partkey": c("p_partkey"), "n": X.count_or_zero(number_column())}, "SELECT p_partkey, coalesce(CAST(trunc(try_cast(CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE CAST(p_retailprice AS VARCHAR) END AS DOUBLE)) AS BIGINT), 0) AS n FROM part")
tags_column = lambda: F.array("p_type", "p_brand")
ORDERED = "list_filter({0}, lambda t, i: list_position({0}, t) = i)"
COMBINED = ORDERED.format("list_filter(list_transform([p_type, p_brand, ' ' || lower(p_type), ''], lambda t: lower(trim(t))), lambda t: t <> '')")
projection("combine_tags", "part", lambda: {"p_partkey": c("p_partkey"), "tags": F.array_join(X.combine_tags(tags_column(), F.array(F.concat(lit(" "), F.lower("p_type")), lit(""))), "|")}, f"SELECT p_partkey, array_to_string({COMBINED}, '|') AS tags FROM part")
projection("match_key", "part", lambda: {"p_partkey": c("p_partkey"), "key": X.match_key(c("p_name"), F.nullif(c("p_type"), lit("PROMO")))}, f"SELECT p_partkey, {title_sql('p_name')} || '|' || {key_sql(chr(40) + 'nullif(p_type, ' + repr('PROMO') + '))')} AS key FROM part")
projection("build_text", "part", lambda: {"p_partkey": c("p_partkey"), "text": X.model_text(c("p_name"), tags_column(), F.nullif(c("p_brand"), lit("Brand#1")))}, "SELECT p_partkey, p_name || '. ' || p_type || ', ' || p_brand || '. ' || coalesce(nullif(p_brand, 'Brand#1'), '') AS text FROM part")
projection("truncate_text", "documents", lambda: {"doc_id": c("doc_id"), "text": F.substring("text", 1, 1500)}, "SELECT doc_id, left(text, 1500) AS text FROM documents")
projection("snippet", "documents", lambda: {"doc_id": c("doc_id"), "snippet": X.snippet(c("text"))}, "SELECT doc_id, CASE WHEN length(text) > 300 THEN regexp_replace(left(text, 300), ' [^ ]*$', '') || '…' ELSE text END AS snippet FROM documents")
STOP_TAGS = ", ".join(f"'{t}'" for t in X.UNINFORMATIVE_TAGS)
projection("informative_tags", "part", lambda: {"p_partkey": c("p_partkey"), "tags": F.array_join(X.informative_tags(F.array("p_type", lit(" Fiction"), "p_brand")), "|")}, f"SELECT p_partkey, array_to_string(list_filter([lower(p_type), 'fiction', lower(p_brand)], lambda t: t NOT IN ({STOP_TAGS})), '|') AS tags FROM part")
WORDS_SQL = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{Nl}\p{No}]+')"
FUNCTION_SQL = ", ".join(f"'{w}'" for w in X.FUNCTION_WORDS)
RATIO = f"(SELECT doc_id, lang, CASE WHEN text IS NULL THEN NULL WHEN len({WORDS_SQL}) = 0 THEN 0.0 ELSE len(list_filter({WORDS_SQL}, lambda w: w IN ({FUNCTION_SQL})))::DOUBLE / len({WORDS_SQL}) END AS r FROM documents)"
projection("english_word_ratio", "documents", lambda: {"doc_id": c("doc_id"), "ratio": F.round(X.function_word_ratio(c("text")), 6)}, f"SELECT doc_id, round(r, 6) AS ratio FROM {RATIO}")
projection("filter_english_text", "documents", lambda: {"doc_id": c("doc_id"), "lang": c("lang")}, f"SELECT doc_id, lang FROM {RATIO} WHERE r >= 0.05", lambda: X.is_english_text(c("text")))
projection("title_and_subtitle", "part", lambda: {"p_partkey": c("p_partkey"), "title": X.title_and_subtitle(c("p_name"), F.nullif(c("p_type"), lit("SMALL")))}, "SELECT p_partkey, p_name || coalesce(': ' || nullif(p_type, 'SMALL'), '') AS title FROM part")
date_column = lambda: F.when(c("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MM/dd/yy"))
projection("edition_year", "orders", lambda: {"o_orderkey": c("o_orderkey"), "year": X.edition_year(date_column())}, "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 OR year(o_orderdate) BETWEEN 1921 AND 2020 THEN year(o_orderdate) END AS INTEGER) AS year FROM orders")
projection("extract_int", "customer", lambda: {"c_custkey": c("c_custkey"), "n": X.first_integer(c("c_name"))}, r"SELECT c_custkey, try_cast(regexp_extract(c_name, '(\d+)', 1) AS BIGINT) AS n FROM customer")
projection("year_of_date", "orders", lambda: {"o_orderkey": c("o_orderkey"), "year": X.year_of(F.when(c("o_orderstatus") == "P", lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))}, "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders")
projection("normalized_text", "documents", lambda: {"doc_id": c("doc_id"), "digest": F.md5(X.normalized_text(c("text")))}, r"SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\p{Z}]+', ' ', 'g'))) AS digest FROM documents")


@query(r"SELECT doc_id, strip_accents(replace(lower(text), 'ß', 'ss')) AS folded FROM documents")
def fold_any_script(spark, d):
    return table(spark, d, "documents").select("doc_id", U.fold_any("text").alias("folded"))


@query(f"SELECT band, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('7:' || doc_id)) AS n FROM (SELECT doc_id, CAST(CASE WHEN r < 0.05 THEN 0 WHEN r < 0.2 THEN 1 WHEN r < 0.5 THEN 2 ELSE 3 END AS INTEGER) AS band FROM {RATIO} WHERE r >= 0 AND r < 1.01)) WHERE n <= 5")
def ratio_bands(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.function_word_ratio(c("text")).alias("r"))
    return banded_sample(docs, c("r"), [0, 0.05, 0.2, 0.5, 1.01], 5, F.md5(F.concat(lit("7:"), c("doc_id")))).select("band", "doc_id")


@query("SELECT item_id, side FROM (SELECT doc_id AS item_id, 'catalog' AS side FROM documents ANTI JOIN embeddings ON doc_id = vec_id UNION ALL SELECT vec_id, 'vectors' FROM embeddings ANTI JOIN documents ON doc_id = vec_id)")
def embedding_id_check(spark, d):
    items = table(spark, d, "documents").select(c("doc_id").alias("item_id"))
    return id_mismatches(items, table(spark, d, "embeddings").select(c("vec_id").alias("item_id")))


# --- catalogue ------------------------------------------------------------------------------------------------

description_column = lambda: F.concat(lit("<p>"), c("p_name"), lit("</p> "), c("p_type"), lit(" made by "), c("p_brand"), lit(" for use in every household and workshop"))
ITEMS_SQL = f"""i AS (SELECT p_partkey AS item_id, p_name AS title, nullif(p_type, 'PROMO') AS author,
  {CLEAN.format("CASE WHEN p_size >= 15 THEN '<p>' || p_name || '</p> ' || p_type || ' made by ' || p_brand || ' for use in every household and workshop' END")} AS description,
  [lower(p_type), lower(p_brand)] AS tags, p_size AS popularity, {title_sql("p_name")} || '|' || {key_sql("(nullif(p_type, 'PROMO'))")} AS key FROM part),
best AS (SELECT key, item_id % 2 AS s, arg_min(item_id, (-popularity, item_id)) AS kept_id FROM i WHERE key IS NOT NULL GROUP BY ALL),
kept AS (SELECT i.*, i.item_id % 2 AS s FROM i LEFT JOIN best ON i.key = best.key AND i.item_id % 2 = best.s WHERE i.key IS NULL OR i.item_id = kept_id)"""
MERGED_SQL = f"""WITH {ITEMS_SQL}, a AS (SELECT *, coalesce(key, 'a-nokey:' || item_id) AS k FROM kept WHERE s = 0), b AS (SELECT *, coalesce(key, 'b-nokey:' || item_id) AS k FROM kept WHERE s = 1),
m AS (SELECT coalesce(CAST(b.item_id AS VARCHAR), 'a:' || a.item_id) AS item_id, a.item_id AS a_id, b.item_id AS b_id, coalesce(a.title, b.title) AS title, coalesce(a.author, b.author) AS author,
  coalesce(a.description, b.description) AS description, CASE WHEN a.description IS NOT NULL THEN 'a' WHEN b.description IS NOT NULL THEN 'b' END AS description_source,
  array_to_string({ORDERED.format("list_concat(coalesce(a.tags, []), coalesce(b.tags, []))")}, '|') AS tags, CAST(coalesce(a.popularity, 0) AS BIGINT) AS a_popularity, CAST(coalesce(b.popularity, 0) AS BIGINT) AS b_popularity,
  coalesce(a.description, b.description) IS NOT NULL AS has_description FROM a FULL OUTER JOIN b ON a.k = b.k)"""


def catalog_items(spark, d):
    parts = table(spark, d, "part")
    text = X.clean_description(F.when(c("p_size") >= 15, description_column()))
    author = F.nullif(c("p_type"), lit("PROMO"))
    return catalog.keyed(parts.select(c("p_partkey").alias("item_id"), c("p_name").alias("title"), author.alias("author"), text.alias("description"), tags_column().alias("tags"), c("p_size").alias("popularity")))


def catalog_sources(spark, d):
    items = catalog_items(spark, d)
    return [catalog.deduplicated(items.where(c("item_id") % 2 == s)) for s in (0, 1)]


def full_catalog(spark, d):
    return catalog.merged(*catalog_sources(spark, d))


@query(f"{MERGED_SQL} SELECT * FROM m")
def merge_sources(spark, d):
    return full_catalog(spark, d).withColumn("tags", F.array_join("tags", "|"))


@query(f"{MERGED_SQL} SELECT count(*) AS items, count(a_id) AS in_a, count(b_id) AS in_b, count(*) FILTER (a_id IS NOT NULL AND b_id IS NOT NULL) AS matched, count(*) FILTER (has_description) AS described FROM m")
def catalog_report(spark, d):
    return catalog.report(full_catalog(spark, d))


@query(f"WITH {ITEMS_SQL} SELECT 'a:' || item_id AS item_id, title, author, description, CAST(popularity AS BIGINT) AS a_popularity, CAST(0 AS BIGINT) AS b_popularity FROM kept WHERE s = 0")
def catalog_single_source(spark, d):
    return catalog.single_source(catalog_sources(spark, d)[0]).select("item_id", "title", "author", "description", "a_popularity", "b_popularity")


@query(f"WITH {ITEMS_SQL} SELECT item_id, key, popularity FROM kept")
def dedup_by_key(spark, d):
    a, b = catalog_sources(spark, d)
    return a.unionByName(b).select("item_id", "key", "popularity")


@query(f"WITH {ITEMS_SQL} SELECT item_id, arg_min(item_id, (-popularity, item_id)) OVER (PARTITION BY key) AS kept_id FROM i WHERE key IS NOT NULL")
def dedup_aliases(spark, d):
    return catalog.aliases(catalog_items(spark, d))


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def dedup_first(spark, d):
    return catalog.first_of(table(spark, d, "part").select("p_name", "p_partkey"), ["p_name"], c("p_partkey"))


# --- interactions ---------------------------------------------------------------------------------------------

INTER_SQL = """raw AS (SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity / 5 AS rating, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
inter AS (SELECT user_id, item_id, arg_min(rating, (l_orderkey, l_linenumber, rating)) AS rating FROM raw GROUP BY ALL),
readers AS (SELECT item_id, count(*) AS n_readers FROM inter GROUP BY ALL)""".replace("raw GROUP BY ALL", "raw GROUP BY user_id, item_id")


def interactions(spark, d):
    """(user_id, item_id, rating), one row per pair: the first in order of order and line."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), c("l_orderkey") == c("o_orderkey"))
    raw = lines.select(c("o_custkey").alias("user_id"), c("l_partkey").alias("item_id"), (c("l_quantity") / 5).alias("rating"), "l_orderkey", "l_linenumber")
    return catalog.first_of(raw, ["user_id", "item_id"], c("l_orderkey"), c("l_linenumber"), c("rating")).select("user_id", "item_id", "rating")


@query(f"WITH {INTER_SQL} SELECT * FROM inter")
def interactions_dedup(spark, d):
    return interactions(spark, d)


@query(f"WITH {INTER_SQL} SELECT p_partkey AS item_id, coalesce(n_readers, 0) AS n_readers FROM part LEFT JOIN readers ON p_partkey = item_id")
def readers_per_item(spark, d):
    n = popularity.readers(interactions(spark, d))
    items = table(spark, d, "part").select(c("p_partkey").alias("item_id"))
    return items.join(n, "item_id", "left").select("item_id", F.coalesce("n_readers", lit(0)).alias("n_readers"))


@query(f"WITH {INTER_SQL}, {ITEMS_SQL}, al AS (SELECT item_id, arg_min(item_id, (-popularity, item_id)) OVER (PARTITION BY key) AS kept_id FROM i WHERE key IS NOT NULL) SELECT coalesce(kept_id, inter.item_id) AS item_id, count(*) AS n, count(DISTINCT user_id) AS users FROM inter LEFT JOIN al ON inter.item_id = al.item_id GROUP BY 1")
def alias_remap(spark, d):
    rows = catalog.remapped(interactions(spark, d), catalog.aliases(catalog_items(spark, d)))
    return rows.groupBy("item_id").agg(F.count(lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"WITH {INTER_SQL} SELECT item_id, count(*) AS n FROM inter SEMI JOIN (SELECT p_partkey FROM part WHERE p_size > 25) ON item_id = p_partkey GROUP BY item_id")
def semi_join_items(spark, d):
    wanted = table(spark, d, "part").where("p_size > 25").select(c("p_partkey").alias("item_id"))
    return interactions(spark, d).join(wanted, "item_id", "left_semi").groupBy("item_id").agg(F.count(lit(1)).alias("n"))


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 3) ON s_nationkey = n_nationkey")
def lookup_author(spark, d):
    names = table(spark, d, "nation").where("n_nationkey <> 3").select(c("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, d, "supplier").join(names, "s_nationkey", "left").select("s_suppkey", "n_name")


@query("WITH t AS (SELECT DISTINCT l_partkey, o_orderpriority AS tag FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority <> '4-NOT SPECIFIED') SELECT p_partkey, coalesce(string_agg(tag, '|' ORDER BY tag), '') AS tags FROM part LEFT JOIN t ON p_partkey = l_partkey GROUP BY p_partkey")
def tags_by_item(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), c("l_orderkey") == c("o_orderkey"))
    tagged = lines.where("o_orderpriority <> '4-NOT SPECIFIED'").groupBy(c("l_partkey").alias("p_partkey")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("tags"))
    return table(spark, d, "part").join(tagged, "p_partkey", "left").select("p_partkey", F.coalesce(F.array_join("tags", "|"), lit("")).alias("tags"))


@query("SELECT p_partkey, unnest([lower(p_type), lower(p_brand)]) AS tag FROM part")
def explode_tags(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(X.combine_tags(tags_column())).alias("tag"))


@query(r"SELECT min(w) AS word, count(*) AS n FROM (SELECT regexp_extract(text, '^\S+') AS w FROM documents) WHERE w <> '' GROUP BY strip_accents(replace(lower(w), 'ß', 'ss'))")
def collated_first_words(spark, d):
    """First words of documents, grouped by their caseless and accentless key."""
    words = table(spark, d, "documents").select(F.regexp_extract("text", r"^\S+", 0).alias("w")).where("w <> ''")
    return words.groupBy(X.any_script_key(c("w")).alias("key")).agg(F.min("w").alias("word"), F.count(lit(1)).alias("n")).select("word", "n")
