"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact size. Each source's budget becomes whole repeats of the source plus a
remainder below its size; a bounded-knapsack dynamic programme over the size counts fits the remainder, and
seeded documents are then selected by count within their size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prefix_sums, salt_buckets, salted_rank, set_aside, word_count

#: No document is taken more often than this, and no target exceeds so many times its source.
MOST_REPEATS = 3
#: The dynamic programme runs over the last part of a budget only: a multiple of the largest size, at most this.
LAST_BUDGET = 1 << 17
PLAN = "source string, size long, repeats long, picked long"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Sources by code point, null last, get the weights in turn and share the total; a target stops at
    MOST_REPEATS times its source and the excess is shared again by weight. That fixed point is a water level:
    with sources in order of ceiling per weight, those under the level are at their ceilings, and the level is the
    first that the ceiling of its own source holds. Sources may be many: ranks and sums go by ranges.
    """
    named = prefix_sums(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], {"nth": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int"))
    s = named.select("source", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * MOST_REPEATS).alias("ceiling"))
    s = materialise(prefix_sums(s, [F.col("ceiling") / F.col("w"), F.col("source").asc_nulls_last()], {"filled": F.col("ceiling"), "under": F.col("w")}))
    every = s.agg(F.sum("source_size").alias("total"), F.sum("w").alias("w")).first()
    level = (F.lit(every["total"]) - F.col("filled")) / (F.lit(every["w"]) - F.col("under"))
    # `under` grows along the order, equal ceilings per weight included.
    first = s.select("ceiling", "w", "under", level.alias("level")).where(F.col("level") * F.col("w") <= F.col("ceiling")).agg(F.min_by("level", "under")).first()[0]
    ceiling = F.col("ceiling").cast("double")
    target = ceiling if first is None else F.least(F.lit(first) * F.col("w"), ceiling)
    return s.select("source", "source_size", target.alias("target"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to pick so that their sum comes as near to budget as can be found.

    A proportional share of each size comes first, so the pick looks like its source. What is left of the
    budget is lowered by single documents, largest first, to LAST_BUDGET or a few times the largest size; a
    bounded knapsack over bit sets, one per group of equal items, then reaches every sum that the remaining
    documents can make. The best sum overall may be missed, as the share is fixed first; the result is off by less
    than one document, and on real counts by nothing or a few words.
    """
    picked = np.zeros(len(sizes), dtype=np.int64)
    total = int(sizes @ counts)
    if budget <= 0 or total == 0:
        return picked
    if budget >= total:
        return counts.copy()
    picked = (counts.astype(object) * budget // total).astype(np.int64)
    left = budget - int(sizes @ picked)
    last = int(min(LAST_BUDGET, 4 * sizes.max()))
    order = np.argsort(-sizes, kind="stable")
    while left > last:
        before = left
        for i in order:
            if left > last and picked[i] < counts[i] and sizes[i] <= left:
                picked[i] += 1
                left -= int(sizes[i])
        if left == before:
            break
    cap, seen, steps = left + int(sizes.max()), 1, []
    mask = (1 << (cap + 1)) - 1
    for i in order[::-1]:
        spare, size, k = int(min(counts[i] - picked[i], cap // max(1, sizes[i]))), int(sizes[i]), 1
        if size <= 0:
            continue
        while spare > 0 and not seen >> left & 1:
            take = min(k, spare)
            steps.append((i, take, seen))
            seen |= seen << take * size & mask
            spare, k = spare - take, k * 2
        if seen >> left & 1:
            break
    low = (seen & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = seen >> left
    high = left + (above & -above).bit_length() - 1 if above else -1
    goal = high if high >= 0 and high - left < left - low else low
    for i, take, was in reversed(steps):
        if not was >> goal & 1:
            picked[i] += take
            goal -= take * int(sizes[i])
    return picked


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    repeats = min(MOST_REPEATS, int(target // whole)) if whole else 0
    budget = 0 if repeats == MOST_REPEATS else round(target - repeats * whole)
    return pdf[["source", "size"]].assign(repeats=repeats, picked=fit_budget(sizes, counts, budget))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, *carry): how often each document enters the mix.

    size counts the runs of characters other than ASCII white space (null text: 0). Null sources form one
    source; repeated rows are separate documents; documents without words are taken 0 times. The same input
    and seed give the same mix on any partitioning, up to the order of rows equal in doc_id and size.
    """
    narrow = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carry))
    hist = materialise(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = materialise(source_targets(sources, weights))
    rows = hist.agg(F.sum("n")).first()[0] or 0
    # The plan sees a source's counts, at most one row per distinct size.
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    h = hist.join(targets, same(hist, targets)).select(hist["source"], "size", "n", "source_size", "target")
    plan = h.groupBy("source").applyInPandas(_plan, PLAN)
    plan = plan.join(targets, same(plan, targets)).select(plan["source"].alias("p_source"), F.col("size").alias("p_size"), "repeats", "picked", "source_size", "target")
    seeded = [F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id")]
    ranked = salted_rank(narrow, ["source", "size"], seeded, salt_buckets(rows), "_rank")
    joined = ranked.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    times = F.when(F.col("size") > 0, F.col("repeats") + (F.col("_rank") < F.col("picked")).cast("long")).otherwise(F.lit(0))
    return joined.select("doc_id", "source", "size", "source_size", "target", times.cast("long").alias("repeats"), *carry)


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """The rows of docs (doc_id, text, source, any other columns), each as often as the mix takes it.

    Rows are numbered in a written copy, so that equal rows stay apart and none is repeated more than MOST_REPEATS times.
    """
    apart, names = set_aside(docs, "doc_id", "text", "source")
    numbered = materialise(apart.withColumn("row", F.monotonically_increasing_id()))
    times = mix(numbered, weights, seed, ("row",)).where("repeats > 0").select("row", F.col("repeats").cast("int"))
    taken = numbered.join(times.hint("merge"), "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return taken.select(*[F.col(names[c]).alias(c) for c in docs.columns])
