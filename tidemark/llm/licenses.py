"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A text's blocks are windows of BLOCK_WORDS words, each begun half a block after the one before, over the whole word
sequence: lines do not matter, as notices are wrapped. A block matches a template if it holds at least a share of
the template's distinct words. Template words get one global order, the rarest in the corpus's blocks first. Blocks
and templates meet in an equi-join on the words of the templates' prefixes: a block over the threshold holds one of
a template's first `size - need + 1` words (prefix filter), has at least `need` of the ordered words (length filter),
and from the first shared word on enough words of both are left to reach `need` (positional filter). Pairs that pass
are verified on their whole sets.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Phrases and their labels.
PHRASES = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}
#: Notices as their licenses word them; the label before the template.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc", "this work is licensed under a creative commons attribution license"),
    ("cc", "licensed under cc by 4 0"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "licensed under cc by sa 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without prior written permission"),
)
THRESHOLD = 0.8
#: Words per block; twice the longest template where that is more, so that any run as long as a template lies in one block.
BLOCK_WORDS = 64

#: Bytes to words: A-Z lowered; letters, digits and bytes beyond ASCII stay; the rest parts words.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def text_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


def text_blocks(words: list[bytes], size: int):
    """(first word, words) of a text's blocks."""
    for start in range(0, max(len(words) - size // 2, 1), size // 2):
        yield start, words[start : start + size]


def template_words(templates=TEMPLATES) -> list[list[bytes]]:
    return [list(dict.fromkeys(text_words(text))) for _, text in templates]


def block_size(templates=TEMPLATES) -> int:
    return max([BLOCK_WORDS, *(2 * len(text_words(text)) for _, text in templates)])


def word_order(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """Template words by the number of the corpus's blocks that hold them, rarest first: one row per word comes back."""
    vocabulary, size = frozenset(w for words in template_words(templates) for w in words), block_size(templates)

    def count(batches):
        found = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = text_words(text)
                if not vocabulary.isdisjoint(words):
                    for _, block in text_blocks(words, size):
                        found.update(vocabulary.intersection(block))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {bytes(r["word"]): r["n"] for r in rows}
    return {w: place for place, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}


def template_table(spark, order: dict[bytes, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(word, t_place, template, label, t_words, need): a row for each word of each template's prefix."""
    rows = []
    for k, ((label, _), words) in enumerate(zip(templates, template_words(templates), strict=True)):
        ordered = sorted(order[w] for w in words)
        need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
        rows += [(w, place, k, label, ordered, need) for place, w in enumerate(ordered[: len(ordered) - need + 1])]
    return spark.createDataFrame(rows, "word int, t_place int, template int, label string, t_words array<int>, need int")


def _phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every phrase, by jumping from one first word to the next."""
    found = []
    for phrase, label in PHRASES.items():
        parts, at = phrase.split(), -1
        for _ in range(words.count(parts[0])):
            at = words.index(parts[0], at + 1)
            if words[at : at + len(parts)] == parts:
                found.append((at, label))
    return sorted(found)


SCAN = "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<start:long,words:array<int>>>"
_ARROW = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")),
        ("base", pa.list_(pa.string())),
        ("blocks", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.list_(pa.int32()))]))),
    ]
)


def scanned(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(one row per row of docs with its phrases and the blocks that a template can match, the template table).

    `row` tells rows apart. A block's words are the places of its template words in the global order, ascending;
    blocks without a prefix word, or with fewer ordered words than any template needs, are left out.
    """
    order = word_order(docs, templates)
    table = template_table(docs.sparkSession, order, templates, threshold)
    prefix = {r[0] for r in table.select("word").distinct().collect()}
    prefix_words, least = frozenset(w for w, place in order.items() if place in prefix), min((r[0] for r in table.select("need").collect()), default=0)
    size, known = block_size(templates), frozenset(order)

    def scan(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, places, blocks = text_words(text), [], []
                distinct = frozenset(words)
                if b"license" in distinct:
                    places = _phrase_places(words)
                if not prefix_words.isdisjoint(distinct):
                    for start, block in text_blocks(words, size):
                        if not prefix_words.isdisjoint(block) and len(held := known.intersection(block)) >= least:
                            blocks.append({"start": start, "words": sorted(map(order.__getitem__, held))})
                out.append((row, doc_id, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, sorted({label for _, label in places}), blocks))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)

    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCAN)), table


def block_matches(found: DataFrame, table: DataFrame) -> DataFrame:
    """(row, doc_id, first_word, template, label, containment): every block of scanned rows over a template's threshold."""
    blocks = found.select("row", "doc_id", F.explode("blocks").alias("b")).select("row", "doc_id", F.col("b.start").alias("first_word"), F.col("b.words").alias("words"))
    tokens = blocks.select("*", F.posexplode("words").alias("place", "word"))
    left = F.least(F.size("words") - F.col("place"), F.size("t_words") - F.col("t_place"))
    pairs = tokens.join(table, "word").where((F.size("words") >= F.col("need")) & (left >= F.col("need")))
    shared = F.size(F.array_intersect("words", "t_words"))
    checked = pairs.withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
    return checked.select("row", "doc_id", "first_word", "template", "label", (F.col("shared") / F.size("t_words")).alias("containment")).distinct()


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z lowered. n_base counts the places
    where a phrase's words stand consecutively; first_word and last_word are the smallest and largest start
    (null without any). labels adds those of matched templates; label lists are distinct, sorted and joined by
    commas. score is 1 with a phrase, else the largest containment over the threshold, else 0. Null and empty
    texts have no words; repeated rows are scanned apart; without templates only phrases count.
    """
    found, table = scanned(docs, templates, threshold)
    each = block_matches(found, table).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    joined = found.drop("blocks").join(each, "row", "left")
    labels = F.concat("base", F.coalesce("more", F.array().cast("array<string>")))
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", listed(F.col("base")).alias("base_labels"), listed(labels).alias("labels"), score.alias("score"))


def scan_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan as DuckDB SQL over documents."""
    lists = [f"({k}, '{label}', [{', '.join(repr(w.decode()) for w in words)}])" for k, ((label, _), words) in enumerate(zip(templates, template_words(templates), strict=True))]
    phrases = [f"([{', '.join(repr(w) for w in p.decode().split())}], '{label}')" for p, label in PHRASES.items()]
    size = block_size(templates)
    return f"""WITH t(template, label, words) AS (VALUES {', '.join(lists)}), ph(p, label) AS (VALUES {', '.join(phrases)}),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row, list_distinct(w[i + 1:i + {size}]) AS s FROM (SELECT row, w, unnest(range(0, greatest(len(w) - {size // 2}, 1), {size // 2})) AS i FROM d)),
m AS (SELECT row, label, shared / len(words) AS c FROM (SELECT row, label, words, len(list_intersect(s, words)) AS shared FROM b, t) WHERE shared >= ceil({threshold} * len(words) - 1e-9)),
p AS (SELECT row, i, label FROM (SELECT row, w, unnest(range(0, len(w))) AS i FROM d), ph WHERE w[i + 1:i + len(p)] = p),
pr AS (SELECT row, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY row),
al AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM p UNION ALL SELECT row, label FROM m) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(pr.n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(pr.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
CASE WHEN pr.n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN pr USING (row) LEFT JOIN al USING (row) LEFT JOIN (SELECT row, max(c) AS c FROM m GROUP BY row) USING (row)"""
