"""Toxicity by a weighted finite-state pattern grammar.

Words become tags (insult, threat, target, negation, report) through a lexicon: built-in words, and whole words
mined from labelled clauses. Four small transducers over the tags are composed into one machine that runs over a
clause: negation and reported speech reach over the next words, targets join the insults beside them, and the last
one emits the matched patterns. A pattern takes an insult or threat and at least one more word of its clause: a
word that stands alone matches nothing. What is scored are clauses: a clause has its strongest weight of each
pattern, and a logistic layer turns the sums over a document's clauses into its score.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import least_by_hash
from .common import materialise, set_aside

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
LEXICON = {
    INSULT: "idiot idiots moron morons scum loser losers stupid clown clowns pathetic worthless trash disgusting dumb imbecile fool filth vermin garbage bastard bastards arsehole asshole bitch "
    "dummkopf abschaum versager arschloch hurensohn wertlos imbécile connard connasse ordure minable estúpido imbécil basura inútil asqueroso",
    THREAT: "kill murder hang shoot burn beat stab destroy hurt töte erschieße umbringen verprügeln tuer égorger frapper matar matarte golpear destruir",
    TARGET: "you your yours yourself they them their he she him her people du dich dein ihr euch tu toi vous votre tú te usted ustedes",
    NEGATION: "not no never neither nor without isn aren wasn don doesn didn nicht kein keine nie pas jamais sans nunca jamás sin",
    REPORT: "said says say called claimed claims wrote reported quoted alleged sagte behauptete nannte dit affirme appelé dijo afirma llamó",
}
#: Words over which a negation, a report or a target reaches.
REACH = {NEGATION: 3, REPORT: 8, TARGET: 3}
#: The last transducer's output; the logistic layer weighs these.
PATTERNS = [f"{kind}{target}{negated}{reported}" for kind, target, negated, reported in product(("insult", "threat"), ("", "+target"), ("", "+negation"), ("", "+report"))]

#: Added to a pattern that belongs to the marked word before the present one.
PREVIOUS = len(PATTERNS)

#: Bounds of what is learned: labelled rows used; what a mined word needs: evidence in nats, clauses, and clauses as a
#: share of the rows to explain.
MOST_ROWS, EVIDENCE, LEAST_CLAUSES, LEAST_SHARE = 20_000, 12.0, 4, 0.02
#: Nats that a clause of label 0 takes off a word's evidence.
AGAINST = 8.0

_BREAKS = {ord(c): "\n" for c in ".!?;:\n\r"} | {ord(c): " " for c in map(chr, range(128)) if not c.isalnum() and c not in ".!?;:\n\r"}


def clauses(text: str) -> str:
    """Lower-cased text, one clause a line, words apart by spaces."""
    return text.lower().translate(_BREAKS)


# --- transducers: (state, symbol) -> (state, symbol), total functions over small ranges -----------------------


def reach_of(tag: int, mark: int, reach: int):
    """Remember `tag` for `reach` symbols and set the bit `mark` on the symbols it reaches. Symbols: (tag, bits)."""

    def step(state, symbol):
        kind, bits = symbol
        if kind == tag:
            return reach, symbol
        return max(0, state - 1), (kind, bits | mark if state else bits)

    return step, 0


def emit(state, symbol):
    """Turn marked insults and threats into patterns.

    A clause's first word waits for a second one; where that is marked itself, PREVIOUS tells the first one's pattern.
    A target soon after an insult without one adds the pattern with it. State: 0 at the clause's start, 1 with nothing
    open, else (kind, bits, distance, waits) of the last insult or threat.
    """
    kind, bits = symbol
    out = []
    if isinstance(state, tuple):
        was, had, far, waits = state
        code = (8 if was == THREAT else 0) + had
        if waits:
            out.append(code + PREVIOUS if kind in (INSULT, THREAT) else code | 4 if kind == TARGET else code)
        elif kind == TARGET and not had & 4 and far < REACH[TARGET]:
            out.append(code | 4)
    if kind in (INSULT, THREAT):
        if state != 0:
            out.append((8 if kind == THREAT else 0) + bits)
        return (kind, bits, 0, state == 0), out
    if isinstance(state, tuple) and kind != TARGET and far + 1 < REACH[TARGET]:
        return (was, had, far + 1, False), out
    return 1, out


def compose(first, second):
    """The machine that feeds the output of one machine to the other."""
    (f, f0), (g, g0) = first, second

    def step(state, symbol):
        a, middle = f(state[0], symbol)
        b, out = g(state[1], middle)
        return (a, b), out

    return step, (f0, g0)


@lru_cache(maxsize=1)
def compiled() -> tuple[list[list[int]], list[list[list[int]]]]:
    """The composed grammar as tables: next state and emitted patterns by (state, tag)."""
    machine = compose(
        compose(reach_of(NEGATION, 2, REACH[NEGATION]), reach_of(REPORT, 1, REACH[REPORT])),
        compose(reach_of(TARGET, 4, REACH[TARGET]), (emit, 0)),
    )
    step, start = machine
    number, queue, goes, says = {start: 0}, [start], [], []
    while queue:
        state = queue.pop(0)
        goes.append([])
        says.append([])
        for tag in range(6):
            after, out = step(state, (tag, 0))
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            goes[-1].append(number[after])
            says[-1].append(out)
    return goes, says


class Tagger(dict):
    """word -> (tag, weight), filled on demand: built-in words, then mined ones (word -> (tag, weight))."""

    def __init__(self, mined: dict[str, tuple[int, float]]):
        self.known = mined | {w: (tag, 1.0) for tag, words in LEXICON.items() for w in words.split()}

    def __missing__(self, word: str):
        if len(self) > 500_000:
            self.clear()
        self[word] = self.known.get(word, (OTHER, 0.0))
        return self[word]


def pattern_weights(text: str | None, tags: Tagger, goes, says) -> tuple[list[float], int]:
    """(per pattern the sum over clauses of the clause's largest weight, number of clauses that match), whole text."""
    out, matched = [0.0] * len(PATTERNS), 0
    plain = clauses(text or "")
    if not any(tags[w][0] in (INSULT, THREAT) for w in set(plain.split())):
        return out, 0
    for clause in plain.split("\n"):
        tagged = [tags[w] for w in clause.split()]
        if not any(tag in (INSULT, THREAT) for tag, _ in tagged):
            continue
        state, weight, best = 0, 0.0, {}
        for tag, w in tagged:
            before, weight = weight, w if tag in (INSULT, THREAT) else weight
            for pattern in says[state][tag]:
                of, value = (pattern - PREVIOUS, before) if pattern >= PREVIOUS else (pattern, weight)
                best[of] = max(best.get(of, 0.0), value)
            state = goes[state][tag]
        for pattern, w in best.items():
            out[pattern] += w
        matched += bool(best)
    return out, matched


def training_rows(docs: DataFrame, labels: DataFrame, column: str, most: int = MOST_ROWS) -> DataFrame:
    """(nth, text, y): at most `most` labelled rows outside the held-out fold, chosen by nth, a hash of doc_id.

    Held out are rows whose crc32(doc_id as text) mod 5 is 0. Null labels are left out; of several labels for
    one document the larger counts.
    """
    usable = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    nth = F.xxhash64(F.lit(5), "doc_id")
    labelled = materialise(usable.groupBy("doc_id").agg((F.max(column) > 0).cast("int").alias("y")).withColumn("nth", nth))
    chosen = least_by_hash(labelled, F.col("nth"), most).orderBy("nth", "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("nth", "text", "y")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def mined_words(rows: DataFrame) -> dict[str, tuple[int, float]]:
    """Words that mark label 1 in rows (text, y) where no built-in word does: word -> (tag, weight).

    Evidence is counted over distinct clauses, so copies of a document add nothing. A word is a threat if targets
    stand after it more often than before it, as after a verb, else an insult.
    """

    def open_clauses(batches):
        known = Tagger({})
        for batch in batches:
            out = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain = clauses(text or "")
                if not any(known[w][0] in (INSULT, THREAT) for w in set(plain.split())):
                    out.append((None, y))
                    out += [(" ".join(words), y) for c in set(plain.split("\n")) if (words := c.split())]
            texts, ys = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(ys, pa.int32())], names=["clause", "y"])

    # A null clause stands for each row.
    found = materialise(rows.mapInArrow(open_clauses, "clause string, y int").groupBy("clause", "y").agg(F.count(F.lit(1)).alias("n")))
    positive = F.col("y") == 1
    totals = found.agg(
        F.sum(F.when(positive & F.col("clause").isNull(), F.col("n"))).alias("rows"),
        F.count_if(positive & F.col("clause").isNotNull()).alias("pos"),
        F.count_if(F.col("clause").isNotNull()).alias("every"),
    ).first()
    if not totals["rows"]:
        return {}
    plain = found.where("clause is not null")

    def count(batches):
        counts = Counter(), Counter()
        for batch in batches:
            for clause, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y].update(set(clause.split()))
        keys = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(keys), 50_000):
            some = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([counts[y][k] for k in some], pa.int64()) for y in (1, 0))], names=["word", "pos", "neg"])

    nats = math.log(max(totals["every"], 1) / max(totals["pos"], 1))
    least = max(LEAST_CLAUSES, LEAST_SHARE * totals["rows"])
    words = plain.select("clause", "y").mapInArrow(count, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    marked = words.withColumn("e", F.col("pos") * nats - F.col("neg") * AGAINST).where((F.col("e") >= EVIDENCE) & (F.col("pos") >= least))
    # Each marks a share of the rows, so their number is bounded by the words of a text over that share.
    weights = {r["word"]: min(2.0, 0.5 + math.log1p(r["e"]) / 4) for r in marked.collect()}

    def sides(batches):
        targets = frozenset(LEXICON[TARGET].split())
        near = {}
        for batch in batches:
            for clause in batch.column(0).to_pylist():
                line = clause.split()
                if not weights.keys().isdisjoint(line) and not targets.isdisjoint(line):
                    for i, w in enumerate(line):
                        if w in weights:
                            both = near.setdefault(w, [0, 0])
                            both[0] += not targets.isdisjoint(line[max(0, i - REACH[TARGET]) : i])
                            both[1] += not targets.isdisjoint(line[i + 1 : i + 1 + REACH[TARGET]])
        yield pa.RecordBatch.from_arrays([pa.array(list(near), pa.string()), *(pa.array([v[k] for v in near.values()], pa.int64()) for k in (0, 1))], names=["word", "before", "after"])

    placed = plain.select("clause").mapInArrow(sides, "word string, before long, after long").groupBy("word").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    threats = {r["word"] for r in placed.where(F.col("after") > F.greatest(2 * F.col("before"), F.lit(LEAST_CLAUSES))).select("word").collect()}
    return {w: (THREAT if w in threats else INSULT, weight) for w, weight in sorted(weights.items())}


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept (last column) is free.

    Where labels are all but separable a whole step can overshoot, and the next ones run away: a step is halved until the loss falls.
    """
    x = np.column_stack((x, np.ones(len(x))))
    b = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])

    def loss(b):
        z = x @ b
        return weight @ (np.logaddexp(0, z) - y * z) + b @ penalty @ b / 2

    now = loss(b)
    for _ in range(100):
        p = (1 + np.tanh(x @ b / 2)) / 2
        slope = x.T @ (weight * (y - p)) - penalty @ b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, slope)
        size = 1.0
        while (then := loss(b + size * step)) > now - 1e-4 * size * (slope @ step) and size > 1e-10:
            size /= 2
        if then >= now:
            break
        b, now = b + size * step, then
        if np.abs(size * step).max() < 1e-8:
            break
    return b


def squash(weights: np.ndarray) -> np.ndarray:
    """Pattern weights grow with the number of matches, ever less."""
    return np.log1p(2 * np.asarray(weights, dtype=float))


def prior(pattern: str) -> float:
    """What a pattern says before there are examples: an insult at someone, neither denied nor reported, is toxic."""
    return 0.2 if "negation" in pattern else 0.3 if "report" in pattern or "target" not in pattern else 0.9


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> dict:
    """Mine words and fit the pattern weights on at most `most` labelled rows outside the held-out fold.

    Without labels of both kinds the built-in lexicon and the patterns' priors decide alone.
    """
    rows = materialise(training_rows(docs, labels, "toxic", most).select("text", "y"))
    words = mined_words(rows)

    def weigh(batches):
        tags, machine = Tagger(words), compiled()
        for pdf in batches:
            x = [(*pattern_weights(t, tags, *machine)[0], y) for t, y in zip(pdf["text"], pdf["y"], strict=True)]
            yield pd.DataFrame(x, columns=[*(f"p{k}" for k in range(len(PATTERNS))), "y"]).astype(float)

    fields = ", ".join(f"p{k} double" for k in range(len(PATTERNS))) + ", y double"
    # Equal rows are counted by Spark; most documents match nothing.
    seen = rows.mapInPandas(weigh, fields)
    counted = seen.groupBy(*seen.columns).count().toPandas()
    # Made-up rows that keep a pattern without examples on the side of its prior.
    made_up = np.log1p(2 * np.eye(len(PATTERNS)))
    x = np.vstack((squash(counted[[f"p{k}" for k in range(len(PATTERNS))]].to_numpy()), made_up, np.zeros((1, len(PATTERNS)))))
    y = np.concatenate((counted["y"], np.array([prior(p) for p in PATTERNS]), [0.0]))
    weight = np.concatenate((counted["count"], np.ones(len(PATTERNS)), [1.0]))
    return {"words": words, "weights": fit_logistic(x, y, weight, 0.05).tolist()}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score (0 to 1) and clauses, the number of matched clauses; null and empty texts match nothing."""
    b = np.array(model["weights"])
    columns = docs.columns

    def run(batches):
        tags, machine = Tagger(model["words"]), compiled()
        for batch in batches:
            found = [pattern_weights(t, tags, *machine) for t in batch.column("text").to_pylist()]
            x = squash(np.array([w for w, _ in found]).reshape(len(found), len(PATTERNS)))
            p = 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array([n for _, n in found], pa.int64())], names=[*columns, "score", "clauses"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("clauses", T.LongType())]))


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, clauses) for every row of docs (doc_id, text, any other columns).

    Null and empty texts match nothing and get the score of that; texts count whole at any length. Repeated rows are
    scored each, alike; rows without doc_id are scored, are not held out and learn nothing. Empty tables stay empty.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs less those scored 0.5 or more, with its own columns, whatever their names.

    Null and empty texts stay, repeated rows stay or go together, and texts count whole at any length.
    """
    apart, names = set_aside(docs, "text")
    return score(apart, train(docs, labels)).where("score < 0.5").select(*[F.col(names[c]).alias(c) for c in docs.columns])
