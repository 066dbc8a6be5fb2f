"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, reported speech, clause end, other). Five small
weighted transducers read the symbols; their composition is one deterministic table, which runs
once over the clauses that hold an insult or a threat. An arc of the composition multiplies the
weight of the word by the factors of all five (a negated or reported insult counts less, one
aimed at somebody more) and adds their constants (a threat that reaches its target).

Insult terms are a fixed list plus whole words and word beginnings learned from labelled rows; a
term's weight is its log-odds. Counting and scoring run in Spark; a logistic curve of two
parameters turns a text's sum of clause weights into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wattline.llm.common import stored
from wattline.llm.shingles import sets, shingle_hashes

OTHER, INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT, END = range(8)

# Common words of each class in English, French, German and Spanish.
WORDS = {
    INSULT: "idiot idiots idiota idiotas moron morons imbecile imbécile imbécil dumb stupid stupide estúpido estúpida dumm dummkopf fool loser losers clown clowns scum trash garbage worthless pathetic disgusting filthy vermin parasite crétin cretin connard abruti salaud trottel arschloch abschaum versager tonto basura escoria inútil asqueroso bastard creep",
    THREAT: "kill hurt destroy beat stab shoot murder crush burn tuer frapper détruire töten schlagen vernichten matar golpear destruir",
    MODAL: "will gonna shall going should must vais va werde wird werden voy vamos",
    TARGET: "you your youre u he she they them him her those these people tu toi vous ton votre du dich dein ihr euch sie tú usted ustedes ellos",
    NEGATION: "not no never isnt arent dont doesnt wasnt without pas jamais non nicht kein keine nie nunca jamás sin",
    REPORT: "said says say called calls claimed reported quoted wrote according dit appelé selon sagte nannte laut dijo llamó según",
}
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:\n]+")
UNSEEN = 4.0  # weight of a listed insult that labels say nothing about
PREFIXES = range(3, 9)


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol) -> (next state, factor, constant); a missing arc keeps the state, factor 1."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, float, float]]

    def step(self, state: int, symbol: int) -> tuple[int, float, float]:
        return self.arcs.get((state, symbol), (0 if symbol == END else state, 1.0, 0.0))

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: both read the same symbols, factors multiply, constants add."""
        arcs = {}
        for a, b, s in product(range(self.states), range(other.states), range(8)):
            (x, f, c), (y, g, d) = self.step(a, s), other.step(b, s)
            arcs[a * other.states + b, s] = (x * other.states + y, f * g, c + d)
        return Transducer(self.states * other.states, arcs)


def grammar() -> Transducer:
    insult = Transducer(2, {(0, INSULT): (1, 1.0, 0.0), (1, INSULT): (1, 1.0, 0.5)})  # several in a clause
    target = Transducer(2, {(0, TARGET): (1, 1.0, 0.0), (1, INSULT): (1, 1.25, 0.0)})
    negation = Transducer(4, {(s, NEGATION): (3, 1.0, 0.0) for s in range(4)} | {(s, w): (s - 1, 0.25 if w == INSULT else 1.0, -2.0 if w == THREAT else 0.0) for s in (1, 2, 3) for w in (OTHER, INSULT, THREAT, MODAL, TARGET, REPORT)})
    reported = Transducer(2, {(0, REPORT): (1, 1.0, 0.0), (1, INSULT): (1, 0.5, 0.0), (1, THREAT): (1, 1.0, -1.0)})
    threat = Transducer(3, {(0, MODAL): (1, 1.0, 0.0), (1, THREAT): (2, 1.0, 2.0), (2, TARGET): (0, 1.0, 3.0)})
    return insult @ target @ negation @ reported @ threat


class Scorer:
    """Sums of clause weights; lexicon maps learned words and word beginnings (ending in *) to weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.table, self.lexicon, self.seen = grammar(), lexicon, {}
        self.fixed = {w: (k, 1.0) for k, ws in WORDS.items() for w in ws.split()}

    def symbol(self, word: str) -> tuple[int, float]:
        if word[0] in ".!?;:\n":
            return END, 0.0
        best = max((self.lexicon.get(x, 0.0) for x in (word, *(word[:k] + "*" for k in PREFIXES if len(word) > k))), default=0.0)
        kind, _ = self.fixed.get(word.replace("'", "").replace("’", ""), (OTHER, 0.0))
        if kind == INSULT:
            return INSULT, best or UNSEEN
        return (INSULT, best) if best > 0 and kind == OTHER else (kind, 1.0)

    def weigh(self, text: str) -> float:
        """The sum of the positive weights of the text's clauses."""
        seen, codes, triggered = self.seen, [], False
        for word in TOKEN.findall(text.lower()):
            code = seen.get(word)
            if code is None:
                if len(seen) > 1 << 18:
                    seen.clear()
                code = seen[word] = self.symbol(word)
            codes.append(code)
            triggered |= code[0] in (INSULT, THREAT)
        if not triggered:
            return 0.0
        total = clause = 0.0
        state = 0
        for kind, weight in codes:
            state, factor, constant = self.table.step(state, kind)
            clause += constant + (factor * weight if kind == INSULT else 0.0)
            if kind == END:
                total, clause = total + max(clause, 0.0), 0.0
        return total + max(clause, 0.0)


def _terms(batches) -> Iterator[pa.RecordBatch]:
    """(term, label) once for each text: words and word beginnings."""
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(re.findall(r"[^\W_]+", (text or "").lower()))
            terms = [*words, *{w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}]
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([label] * len(terms), pa.int32())], names=["term", "label"])


def _families(batches) -> Iterator[pa.RecordBatch]:
    """Rows with the least hash of their three-word shingles: near copies mostly share it."""
    for batch in batches:
        least = []
        for _, _, h, b in shingle_hashes(batch.column(0), 3):
            h, b = sets(h, b)
            least += [int(h[b[i]]) >> 1 if b[i + 1] > b[i] else None for i in range(len(b) - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=[*batch.schema.names, "family"])


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    slope: float
    base: float


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and base of a logistic curve, by Newton's method with a little shrinkage."""
    a = np.stack([x, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * np.array([w[0] * 0.1, w[1] * 0.01])
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.diag([0.1, 0.01])
        step = np.linalg.solve(hess, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def bounded(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """About `most` rows, chosen by a hash of the key; all rows where there are fewer."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def learn(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", sample: int = 20_000, terms: int = 5_000) -> Model:
    """Fit on at most about `sample` labelled rows (text, label 0 or 1, key for the choice of rows).

    Near copies count once for a term. A term needs max(4, 1.5 %) of the toxic families and log-odds
    of 2.5; of those the `terms` strongest are kept. Without labels the fixed list is all there is.
    """
    rows = stored(bounded(labelled.where(f"{label} in (0, 1)").select(text, F.col(label).cast("int").alias("label"), key), F.col(key), sample).select(text, "label"), "labelled")
    marked = rows.mapInArrow(_families, f"{text} string, label int, family long").where("family is not null")
    single = stored(marked.dropDuplicates(["label", "family"]).select(text, "label"), "families")
    totals = {r.label: r["count"] for r in single.groupBy("label").count().collect()}
    good, bad = totals.get(0, 0), totals.get(1, 0)
    lexicon: dict[str, float] = {}
    if good and bad:
        counted = single.mapInArrow(_terms, "term string, label int").groupBy("term").agg(F.sum("label").alias("bad"), F.count_if(F.col("label") == 0).alias("good"))
        odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
        found = counted.where(F.col("bad") >= max(4, math.ceil(0.015 * bad))).withColumn("odds", odds).where("odds >= 2.5")
        lexicon = {r.term: r.odds for r in found.orderBy(F.desc("odds"), "term").limit(terms).collect()}
    scored = weigh(rows, lexicon, text).groupBy("label", F.round(F.log1p("__wl_weight"), 2).alias("x")).count()
    points = [(r.x, r.label, r["count"]) for r in scored.collect()]  # at most a few hundred distinct values
    if not (good and bad):
        return Model(lexicon, 3.0, -4.0)
    x, y = np.repeat([p[0] for p in points], [p[2] for p in points]), np.repeat([p[1] for p in points], [p[2] for p in points])
    return Model(lexicon, *_curve(x.astype(float), y.astype(float)))


def weigh(docs: DataFrame, lexicon: dict[str, float], text: str = "text") -> DataFrame:
    """docs with `__wl_weight`: the sum of clause weights of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            got = [scorer.weigh(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, "__wl_weight"])

    return docs.mapInArrow(run, docs.withColumn("__wl_weight", F.lit(0.0)).schema)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score` (0 to 1) from each whole text; null and empty texts get the score of a text without matches.

    Very long texts are read whole; repeated rows get equal scores; an empty table stays empty. A column named score is replaced,
    one named __wl_weight is not kept; other names stay.
    """
    names = [c for c in docs.columns if c != "score"]
    curve = 1 / (1 + F.exp(-(F.lit(model.slope) * F.log1p("__wl_weight") + F.lit(model.base))))
    return weigh(docs.select(*names), model.lexicon, text).select(*names, curve.alias("score"))
