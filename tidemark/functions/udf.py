"""Arrow functions for what column expressions cannot do: models, and the rare ends of Unicode and literals."""

from __future__ import annotations

import ast
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=1)
def combining_marks() -> dict[int, None]:
    """The translation table that drops every combining mark of Unicode."""
    return dict.fromkeys(c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c)))


#: Texts that `fold_any` has as Python strings at a time.
FOLDED_AT_ONCE = 64


def folded(text: str | None) -> str | None:
    """Casefolded and stripped of combining marks; ASCII has none."""
    if text is None or text.isascii():
        return text and text.lower()
    return unicodedata.normalize("NFKD", text.casefold()).translate(combining_marks())


@F.arrow_udf(T.StringType())
def fold_any(texts: pa.Array) -> pa.Array:
    """Casefolded and stripped of combining marks, for every script; a batch is held as Arrow, and a few texts as strings."""
    some = [pa.array(map(folded, texts.slice(k, FOLDED_AT_ONCE).to_pylist()), pa.string()) for k in range(0, len(texts), FOLDED_AT_ONCE)]
    return pa.concat_arrays(some) if some else pa.array([], pa.string())


def list_items(literal: str | None) -> list[str]:
    """The items of a Python list literal, each as its str(); an empty list for everything else.

    Items may be any literal: strings with prefixes, escapes and quotes of every kind, adjacent strings, numbers,
    constants, and lists, tuples, sets and dicts within one another.
    """
    text = (literal or "").strip(" \t\n\f\r")
    if text[:1] != "[":
        return []
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return []
    return [str(x) for x in value] if isinstance(value, list) else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def any_list_literal(values: pd.Series) -> pd.Series:
    """List literals to their items as text; everything else to an empty list."""
    return values.map(list_items)


def hashed_words(texts: list[str], dimension: int = 64) -> np.ndarray:
    """A stand-in embedder: unit vectors of signed word hashes."""
    out = np.zeros((len(texts), dimension))
    for row, text in enumerate(texts):
        for word in text.lower().split():
            digest = sum((i + 1) * b for i, b in enumerate(word.encode()))
            out[row, digest % dimension] += 1 if digest // dimension % 2 else -1
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def embed(items: DataFrame, make_embedder: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 512, most_chars: int = 1500) -> DataFrame:
    """(item_id, vector) of items (item_id, text): the embedder is made once per task and fed in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = make_embedder()
        for pdf in frames:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                yield pd.DataFrame({"item_id": part["item_id"], "vector": list(np.asarray(embedder(part["text"].tolist()), dtype=np.float32))})

    cut = items.select("item_id", F.substring(F.coalesce("text", F.lit("")), 1, most_chars).alias("text"))
    return cut.mapInPandas(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, vector array<float>")
