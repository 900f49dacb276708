"""Quality by a factorisation machine over hashed words, structure statistics and text metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairwise interactions in
time linear in the number of features. Features are made in Arrow batches on the executors; the machine is
fitted on a bounded sample of labelled rows and scores every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialise
from .minhash import slices
from .toxicity import fit_logistic, held_out, training_rows
from .words import Prefixes, hash_words, mix, word_lists

#: Buckets for hashed words, after those of the statistics; factors per feature; labelled rows, and their features, used at most.
WORD_BUCKETS, FACTORS, MOST_ROWS, MOST_FEATURES = 1 << 15, 6, 12_000, 12_000_000
BINS = 24
STATISTICS = (
    "upper digit space punctuation symbol pipe other_script mean_word long_word distinct_words top_word same_as_previous distinct_trigrams distinct_lines short_lines capital_words ends_in_letter".split()
)
METADATA = ("n_chars", "n_words", "n_lines")
FIRST_WORD = (len(STATISTICS) + len(METADATA)) * BINS
SIZE = FIRST_WORD + WORD_BUCKETS

_CLASSES = np.full(256, 6, np.uint8)  # 6: beyond ASCII
for _c in range(128):
    _ch = chr(_c)
    _CLASSES[_c] = 0 if _ch.isupper() else 1 if _ch.islower() else 2 if _ch.isdigit() else 3 if _ch.isspace() else 4 if _ch in ".,'\"-!?;:()" else 7 if _ch == "|" else 5


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[at[1:]] - total[at[:-1]]


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct values, largest multiplicity) per document."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
    count = np.diff(np.append(new, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, d[new], count)
    return np.bincount(d[new], minlength=n).astype(float), most


def _bins(ratio: np.ndarray) -> np.ndarray:
    """Shares from 0 to 1, finer near both ends."""
    x = np.clip(np.nan_to_num(ratio), 0, 1)
    return np.minimum(BINS - 1, np.floor((np.arcsin(np.sqrt(x)) / (np.pi / 2)) * BINS)).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids, values, offsets by text). Empty and null texts have the statistics of nothing."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), texts.cast(pa.string())), "")[0].as_buffer()
    kind = _CLASSES[np.frombuffer(joined, np.uint8)]
    chars = np.maximum(sizes, 1)
    share = {name: _sums(kind == k, at) / chars for name, k in (("upper", 0), ("digit", 2), ("space", 3), ("punctuation", 4), ("symbol", 5), ("pipe", 7), ("other_script", 6))}
    letters = np.maximum(_sums(kind <= 1, at), 1)
    share["upper"] = _sums(kind == 0, at) / letters
    last = np.where(sizes > 0, kind[np.maximum(at[1:] - 1, 0)] if len(kind) else 0, 9)
    share["ends_in_letter"] = (last <= 1).astype(float)

    words, w_at = word_lists(pc.utf8_lower(texts))
    hashes, n_words = hash_words(words), np.diff(w_at)
    doc = np.repeat(np.arange(n), n_words)
    per = np.maximum(n_words, 1)
    lengths = np.asarray(pc.utf8_length(words)).astype(float)
    share["mean_word"] = _sums(lengths, w_at) / per / 24
    share["long_word"] = _sums(lengths > 14, w_at) / per
    distinct, top = _distinct(hashes, doc, n)
    share["distinct_words"], share["top_word"] = distinct / per, top / per
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    share["same_as_previous"] = _sums(same, w_at) / per
    grams = Prefixes(hashes).grams(3)
    inside = doc[: len(grams)] == doc[2 : 2 + len(grams)] if len(grams) else np.zeros(0, bool)
    share["distinct_trigrams"] = _distinct(grams[inside], doc[: len(grams)][inside], n)[0] / np.maximum(n_words - 2, 1)
    lines = pc.split_pattern(texts, "\n")
    l_at = np.asarray(lines.offsets, dtype=np.int64) - lines.offsets[0].as_py()
    flat = lines.flatten()
    n_lines = np.diff(l_at)
    share["distinct_lines"] = _distinct(hash_words(flat), np.repeat(np.arange(n), n_lines), n)[0] / np.maximum(n_lines, 1)
    share["short_lines"] = _sums(np.asarray(pc.binary_length(flat)) < 30, l_at) / np.maximum(n_lines, 1)
    starts = np.asarray(pc.fill_null(pc.match_substring_regex(word_lists(texts)[0], r"^[A-Z]"), False))
    share["capital_words"] = _sums(starts, w_at) / per if len(starts) == w_at[-1] else np.zeros(n)

    binned = [_bins(share[s]) for s in STATISTICS]
    binned += [np.minimum(BINS - 1, np.floor(1.5 * np.log2(1 + x))).astype(np.int64) for x in (sizes / 16, n_words / 2, n_lines - 1)]
    stats = np.stack([b + k * BINS for k, b in enumerate(binned)], axis=1)

    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, bool)
    word, word_doc = (mix(h[new]) % np.uint64(WORD_BUCKETS)).astype(np.int64) + FIRST_WORD, d[new]
    ids = np.concatenate((stats.reshape(-1), word))
    owner = np.concatenate((np.repeat(np.arange(n), stats.shape[1]), word_doc))
    value = np.concatenate((np.full(stats.size, 0.25), 1 / np.sqrt(np.maximum(distinct, 1))[word_doc]))
    by_doc = np.argsort(owner, kind="stable")
    return ids[by_doc], value[by_doc].astype(np.float32), np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def machine_scores(model: dict, ids: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logits, by the sum-of-squares identity."""
    linear = np.add.reduceat(model["w"][ids] * value, at[:-1])
    weighted = model["v"][ids] * value[:, None]
    total = np.add.reduceat(weighted, at[:-1], axis=0)
    squares = np.add.reduceat(weighted * weighted, at[:-1], axis=0)
    return model["w0"] + linear + 0.5 * (total * total - squares).sum(axis=1)


#: Rows of a mini-batch, and passes over the sample and steps that training takes at least: few rows are passed more often.
MINI_BATCH, LEAST_EPOCHS, LEAST_STEPS = 128, 10, 600


def fit(ids: np.ndarray, value: np.ndarray, at: np.ndarray, y: np.ndarray, rate: float = 0.1, seed: int = 3) -> dict:
    """Logistic loss by AdaGrad over mini-batches of a bounded sample."""
    batches = max(1, len(y) // MINI_BATCH)
    epochs = max(LEAST_EPOCHS, -(-LEAST_STEPS // batches))
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    model = {"w0": np.float32(np.log(share / (1 - share))), "w": np.zeros(SIZE, np.float32), "v": rng.normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32)}
    gw, gv = np.full(SIZE, 1e-2, np.float32), np.full((SIZE, FACTORS), 1e-2, np.float32)
    lengths = np.diff(at)
    for _ in range(epochs if 0 < y.sum() < len(y) else 0):
        order = rng.permutation(len(y))
        for part in np.array_split(order, batches):
            n = lengths[part]
            sub_at = np.concatenate(([0], np.cumsum(n)))
            pick = np.repeat(at[part] - sub_at[:-1], n) + np.arange(sub_at[-1])
            i, x = ids[pick], value[pick]
            owner = np.repeat(np.arange(len(part)), n)
            slope = (1 / (1 + np.exp(-np.clip(machine_scores(model, i, x, sub_at), -30, 30))) - y[part]).astype(np.float32)
            weighted = model["v"][i] * x[:, None]
            total = np.add.reduceat(weighted, sub_at[:-1], axis=0)
            each = slope[owner]
            uniq, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, each * x, len(uniq)).astype(np.float32) + 1e-4 * model["w"][uniq]
            raw = (each * x)[:, None] * (total[owner] - weighted)
            dv = np.stack([np.bincount(back, raw[:, f], len(uniq)) for f in range(FACTORS)], axis=1).astype(np.float32) + 1e-3 * model["v"][uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            model["w"][uniq] -= rate * dw / np.sqrt(gw[uniq])
            model["v"][uniq] -= 0.3 * rate * dv / np.sqrt(gv[uniq])
    return model


def rows_of(ids: np.ndarray, value: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids, values, offsets) of some rows, in their order."""
    n = np.diff(at)[rows]
    new_at = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
    pick = np.repeat(at[:-1][rows] - new_at[:-1], n) + np.arange(new_at[-1])
    return ids[pick], value[pick], new_at


def calibrated(ids: np.ndarray, value: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict:
    """A machine fitted on all rows, with the line (slope, shift) that turns its logits into those of probabilities.

    Each half of the rows is scored by a machine fitted on the other half; a logistic regression of the labels on those
    logits, which no machine has seen, gives the line. Without rows of both labels in both halves logits stay as they are.
    """
    model = fit(ids, value, at, y) | {"slope": 1.0, "shift": 0.0}
    halves = [np.arange(k, len(y), 2) for k in (0, 1)]
    if any(len(set(y[half])) < 2 for half in halves):
        return model
    logits = np.zeros(len(y))
    for own, other in (halves, halves[::-1]):
        logits[own] = machine_scores(fit(*rows_of(ids, value, at, other), y[other]), *rows_of(ids, value, at, own))
    # Targets short of 0 and 1, as one more row of each kind was seen on the other side.
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = fit_logistic(logits[:, None], target, np.ones(len(y)), 1e-3)
    return model | ({"slope": float(slope), "shift": float(shift)} if slope > 0 else {})


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, most_features: int = MOST_FEATURES) -> dict:
    """Fit on at most `most` labelled rows outside the held-out fold, the first with `most_features` features in all.

    Features, not texts, come to the driver: eight bytes each.
    """

    def extract(batches):
        for batch in batches:
            for part in slices(batch, 1):
                ids, value, at = features(part.column(1))
                rows = range(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([ids[at[r] : at[r + 1]].astype("<u4").tobytes() for r in rows], pa.binary()),
                        pa.array([value[at[r] : at[r + 1]].tobytes() for r in rows], pa.binary()),
                    ],
                    names=["nth", "y", "n", "ids", "value"],
                )

    made = materialise(training_rows(docs, labels, "quality", most).mapInArrow(extract, "nth long, y int, n long, ids binary, value binary"))
    # The window runs over the chosen rows' lengths alone; rows of one document come together.
    sums = made.groupBy("nth").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(W.orderBy("nth").rowsBetween(W.unboundedPreceding, 0)))
    rows = made.join(sums.where(F.col("upto") <= most_features).select("nth"), "nth", "left_semi").select("y", "ids", "value").toArrow()
    discard(made)
    y = np.asarray(rows["y"].to_pylist(), dtype=np.float32)
    ids = np.frombuffer(b"".join(rows["ids"].to_pylist()), "<u4").astype(np.int64)
    value = np.frombuffer(b"".join(rows["value"].to_pylist()), np.float32)
    at = np.concatenate(([0], np.cumsum([len(b) // 4 for b in rows["ids"].to_pylist()]))).astype(np.int64)
    # Rows arrive in any order; sorted by content, reruns agree.
    key = sorted(range(len(y)), key=lambda r: (y[r], ids[at[r] : at[r + 1]].tobytes()))
    ids, value, at = rows_of(ids, value, at, np.array(key, np.int64)) if len(y) else (ids, value, at)
    return calibrated(ids, value, at, y[key])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; predicted is 1 from a score of 0.3 on.

    Null and empty texts are scored by the statistics of nothing, texts of any length by all of it, repeated rows alike.
    Without labels of both kinds every score is the share of label 1 (0.5 without labels). Null ids are scored, not held
    out; columns other than doc_id and text are not read. Empty tables stay empty.
    """
    model = train(docs, labels)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                logit = model["slope"] * machine_scores(model, *features(part.column(1))) + model["shift"]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30))))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
