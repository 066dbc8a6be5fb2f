"""Quality classifier: a linear support vector machine on indicators scaled by naive Bayes log-count ratios.

Features are indicators of byte 3- and 4-grams, hashed, and of n-grams of one repeated word (the
same word twice, three and five times in a row). Each is scaled by the log ratio of its smoothed
shares in the two classes; dual coordinate descent fits the hinge loss on a bounded sample of
labelled rows, and a logistic curve fitted on held-back rows of it turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattline.llm.common import stored, utf8
from wattline.llm.shingles import word_hashes
from wattline.llm.toxicity import _curve, bounded

DIM = 1 << 18
MOST_FEATURES = 1 << 25  # of all texts that are fitted on: 128 MB on the driver
REPEATS = (2, 3, 5)


class Indicators:
    """Distinct feature numbers of a text, found by marking a table, without sorting."""

    def __init__(self):
        self.marks = np.zeros(DIM + len(REPEATS), bool)

    def of(self, data: np.ndarray, again: list[int]) -> np.ndarray:
        marks = self.marks
        x = data.astype(np.uint32)
        if len(x) >= 3:
            three = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
            keys = [(three * np.uint32(2654435761)) >> np.uint32(14)]
            if len(x) >= 4:
                keys.append(((three[:-1] * np.uint32(2246822519) ^ x[3:] * np.uint32(3266489917)) * np.uint32(668265263)) >> np.uint32(14))
            for k in keys:
                marks[k] = True
        for i in again:
            marks[DIM + i] = True
        out = np.flatnonzero(marks)
        marks[out] = False
        return out


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Feature numbers of each text; null is empty."""
    data, at = utf8(column)
    own = Indicators()
    for i in range(len(at) - 1):
        part = data[at[i] : at[i + 1]]
        h, _ = word_hashes(part, np.array([0, len(part)]))
        again = []
        run = h[1:] == h[:-1]
        for j, n in enumerate(REPEATS):
            if len(run) >= n - 1 and (np.lib.stride_tricks.sliding_window_view(run, n - 1).all(1).any() if n > 2 else run.any()):
                again.append(j)
        yield own.of(part, again)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # ratio times support vector weight, one for each feature
    bias: float
    slope: float
    base: float


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Hinge loss with an L2 penalty; one dual variable at a time is set to its best value in [0, cost]."""
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    norm = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            grad = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - grad / norm[i], 0.0), cost[i])
            if (d := (new - alpha[i]) * y[i]) != 0.0:
                w[rows[i]] += d * values[i]
                bias += d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w, bias


def learn(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", sample: int = 4_000, penalty: float = 1.0) -> Model:
    """Fit on at most about `sample` labelled rows (text, label 0 or 1, key for the choice of rows), fewer if they have more than MOST_FEATURES features."""
    rows = bounded(labelled.where(f"{label} in (0, 1)").select(text, F.col(label).cast("int").alias("label"), F.xxhash64(key).alias("k")), F.col("k"), sample)

    def found(batches):
        for batch in batches:
            got = [f.astype(np.int32) for f in features(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["f", "label", "k"])

    made = stored(rows.mapInArrow(found, "f array<int>, label int, k long"), "features")
    total = made.agg(F.sum(F.size("f"))).first()[0] or 0
    if total > MOST_FEATURES:
        made = made.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(MOST_FEATURES / total * (1 << 30)))
    got = made.toArrow().sort_by("k")
    f = [np.asarray(x.values) for x in got.column("f")]
    y = np.where(np.asarray(got.column("label")) == 1, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(DIM + len(REPEATS), np.float32), 0.0, 0.0, 3.0 if (y > 0).all() else -3.0)
    back = np.arange(len(y)) % 4 == 3  # held back for the curve
    share = []
    for kind in (1.0, -1.0):
        n = np.bincount(np.concatenate([f[i] for i in np.flatnonzero((y == kind) & ~back)] or [np.zeros(0, np.int64)]), minlength=DIM + len(REPEATS)) + 1.0
        share.append(n / (((y == kind) & ~back).sum() + 2.0))
    ratio = np.log(share[0] / share[1])
    train = np.flatnonzero(~back)
    rare = {k: 0.5 / max(1e-9, (y[train] == k).mean()) for k in (1.0, -1.0)}
    w, bias = dual_descent([f[i] for i in train], y[train], ratio, penalty * np.array([rare[k] for k in y[train]]))
    scaled = (w * ratio).astype(np.float32)
    margin = np.array([scaled[f[i]].sum() / np.sqrt(max(1, len(f[i]))) + bias for i in np.flatnonzero(back)])
    slope, base = _curve(margin, (y[back] > 0).astype(float), ridge=1.0)
    return Model(scaled, bias, slope, base)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score` (0 to 1) from each whole text; null and empty texts have no features, so the bias decides.

    Very long texts are read whole; repeated rows get equal scores; an empty table stays empty. A column named score is replaced.
    """
    names = [c for c in docs.columns if c != "score"]
    docs = docs.select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            margin = np.array([m.weights[f].sum(dtype=np.float64) / np.sqrt(max(1, len(f))) + m.bias for f in features(column)])
            got = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.base, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)
