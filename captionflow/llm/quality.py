"""Quality classifier: naive Bayes support vectors.

Documents are sets of n-gram indicators: n-grams of word shapes (case, first and
last byte class, symbols, length, repeats of the previous word) and of folded
words, hashed into a fixed number of slots. Indicators are scaled by the log-count
ratio of the two classes, counted over every labelled training row; a linear
hinge-loss model over the scaled indicators is fitted by dual coordinate descent
on a bounded sample of the training rows; a logistic curve, fitted on sample rows
set aside, turns margins into scores of 0 to 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import texthash
from .common import bound_batches, first_by_bytes, held_out, size_checked, text_or_empty

SHAPE_SLOTS = 1 << 15
WORD_SLOTS = 1 << 16
SLOTS = SHAPE_SLOTS + WORD_SLOTS
#: Most training rows of each class that the hinge-loss fit reads.
SAMPLE_PER_CLASS = 3000
#: Most bytes of indicators of the sample, which the driver holds.
SAMPLE_BYTES = 256 << 20
THRESHOLD = 0.3
COST = 1.0
EPOCHS = 12
U64 = np.uint64

# byte classes of the first and last byte of a word
_CLASS = np.zeros(256, U64)
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[ord(c) for c in ".,;:!?"]] = [4, 5, 6, 7, 8, 9]
_CLASS[[ord(c) for c in "'\"()"]] = 10
_CLASS[[ord(c) for c in "#*$%&|<>"]] = [11, 12, 13, 14, 15, 16, 17, 18]
_CLASS[0x80:] = 19
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_ODD = (~texthash.ALNUM & ~texthash.SPACE).astype(np.int64)


def features(data: np.ndarray) -> np.ndarray:
    """The sorted slots of a text's indicators (UTF-8 bytes)."""
    h, start, end = texthash.words(data, ~texthash.SPACE)
    if not len(h):
        return np.zeros(0, np.int32)
    size = end - start
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    odd = np.concatenate(([0], np.cumsum(_ODD[data])))
    n_upper, n_odd = upper[end] - upper[start], odd[end] - odd[start]
    shape = _CLASS[data[start]] * U64(32) + _CLASS[data[end - 1]]
    shape = shape * U64(8) + np.minimum(n_odd, 7).astype(U64)
    shape = shape * U64(4) + np.where(n_upper == 0, 0, np.where(n_upper + n_odd == size, 2, 1)).astype(U64)
    shape = shape * U64(8) + np.searchsorted([1, 2, 4, 8, 16, 32], size, "left").astype(U64)
    repeat = np.zeros(len(h), U64)
    repeat[1:] = h[1:] == h[:-1]
    shape = shape * U64(2) + repeat
    flag = np.zeros(SLOTS, bool)
    for n in (1, 2, 3):
        flag[(texthash.grams(shape, n, n) % U64(SHAPE_SLOTS)).astype(np.int64)] = True
        flag[(texthash.grams(repeat, n, 7 + n) % U64(SHAPE_SLOTS)).astype(np.int64)] = True
    for n in (1, 2):
        flag[SHAPE_SLOTS + (texthash.grams(h, n, n) % U64(WORD_SLOTS)).astype(np.int64)] = True
    return np.flatnonzero(flag).astype(np.int32)


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) that models may learn from. Label rows with a null id or label are
    ignored; of several for an id the largest counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()) \
        .groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))


def training_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, y, text) of the documents with a label to learn from."""
    return docs.select("doc_id", text_or_empty().alias("text")).where(~held_out()).join(known, "doc_id")


def sample_labels(known: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` labels of each class, those of least hashed id; chosen
    before any text is read, and so few that they are broadcast. A class of many is
    thinned by hash first, so the ordering sees about twice the bound."""
    order, picked = F.xxhash64(F.col("doc_id").cast("string")), None
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    for y in (0, 1):
        part = known.where(F.col("y") == y)
        if sizes.get(y, 0) > 2 * per_class:
            part = part.where(F.pmod(F.xxhash64("doc_id", F.lit(y)), F.lit(sizes[y])) < 2 * per_class)
        part = part.withColumn("o", order).orderBy("o", "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    return F.broadcast(picked)


def class_counts(rows: DataFrame, features: Callable[[np.ndarray], np.ndarray] = features, slots: int = SLOTS) -> np.ndarray:
    """Rows of each class that have each indicator, over all training rows: counted
    in each task, then summed; at most two numbers a slot reach the driver."""
    def count(batches):
        n = np.zeros((2, slots), np.int64)
        for b in batches:
            for y, data in zip(b.column("y").to_pylist(), texthash.rows(b.column("text"))):
                n[y][features(data)] += 1
        some = np.flatnonzero(n.any(axis=0))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[0][some]), pa.array(n[1][some])],
                                             ["slot", "n0", "n1"])
    out = np.zeros((2, slots), np.int64)
    for r in rows.select("y", "text").mapInArrow(count, "slot int, n0 long, n1 long") \
            .groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect():
        out[:, r["slot"]] = r["n0"], r["n1"]
    return out


def log_count_ratio(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = counts[1] + smooth, counts[0] + smooth
    return np.log((p / p.sum()) / (q / q.sum()))


def sample_rows(docs: DataFrame, known: DataFrame, per_class: int) -> list[tuple[int, np.ndarray]]:
    """(class, slots) of the documents of a bounded sample of labels, in a fixed order:
    at most ``per_class`` of each class, and ``SAMPLE_BYTES`` of slots in all."""
    slots = F.arrow_udf(lambda c: pa.array([features(d).tobytes() for d in texthash.rows(c)], pa.binary()), "binary")
    rows = training_rows(docs, sample_labels(known, per_class)).select("o", "doc_id", "y", slots("text").alias("slots"))
    kept = first_by_bytes(rows, ["o", "doc_id", "slots"], lambda r: len(r["slots"]), SAMPLE_BYTES)
    return [(r["y"], np.frombuffer(r["slots"], np.int32)) for r in kept]


def dual_coordinate_descent(x: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray,
                            epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model: rows are unit vectors of ``scale`` at their slots,
    plus a constant; ``y`` is -1 or 1; ``cost`` bounds each dual variable."""
    values = [scale[i] for i in x]
    norms = [math.sqrt(float(v @ v)) or 1.0 for v in values]
    values = [v / n for v, n in zip(values, norms)]
    q = np.array([float(v @ v) + 1.0 for v in values])
    w, b, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(x))
    order = np.arange(len(x))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        worst = 0.0
        for i in order:
            slope = y[i] * (float(w[x[i]] @ values[i]) + b) - 1.0
            new = min(max(alpha[i] - slope / q[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[x[i]] += step * values[i]
                b += step
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w * scale, b


def logistic_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins (Newton steps on targets
    drawn in by one count, as Platt's method has them)."""
    n1, n0 = max(1, int((y > 0).sum())), max(1, int((y <= 0).sum()))
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, math.log((n1 + 1) / (n0 + 1))
    z = np.stack([margin, np.ones_like(margin)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = z @ (p - t) + 1e-3 * np.array([a, 0])
        hess = (z * (p * (1 - p) + 1e-9)) @ z.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


@dataclass
class QualityModel:
    weight: np.ndarray   # by slot, of an indicator before the row is made a unit vector
    scale: np.ndarray
    shift: float
    slope: float
    level: float

    def margin(self, slots: np.ndarray) -> float:
        s = self.scale[slots]
        return float(self.weight[slots].sum() / (math.sqrt(float(s @ s)) or 1.0)) + self.shift

    def score(self, slots: np.ndarray) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * self.margin(slots) + self.level, -30.0), 30.0)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality). With
    no training rows, or of one class alone, every score is that of the prior."""
    bound_batches(docs.sparkSession)
    known = training_labels(labels, "quality")
    counts = class_counts(training_rows(docs, size_checked(known)))
    sample = sample_rows(docs, known, per_class)
    x = [s for _, s in sample]
    y = np.array([1.0 if t else -1.0 for t, _ in sample])
    n1, n0 = int((y > 0).sum()), int((y < 0).sum())
    if not n1 or not n0:
        return QualityModel(np.zeros(SLOTS), log_count_ratio(counts), 0.0, 1.0, math.log((n1 + 1) / (n0 + 1)))
    aside = np.arange(len(x)) % 4 == 3 if min(n0, n1) >= 8 else np.ones(len(x), bool)
    learn = ~aside if min(n0, n1) >= 8 else aside
    if (aside != learn).all():  # margins of rows set aside are only fair if the ratios do not know them
        for i in np.flatnonzero(aside):
            counts[int(y[i] > 0)][x[i]] -= 1
    scale = log_count_ratio(counts)
    pick = np.flatnonzero(learn)
    cost = COST * np.where(y[pick] > 0, 1.0, n1 / n0)
    w, b = dual_coordinate_descent([x[i] for i in pick], y[pick], scale, cost)
    model = QualityModel(w, scale, b, 1.0, 0.0)
    model.slope, model.level = logistic_fit(np.array([model.margin(x[i]) for i in np.flatnonzero(aside)]), y[aside])
    return model


def score_column(model: QualityModel, text: Column) -> Column:
    """The score of each text; null and empty texts get the model's base score."""
    small = QualityModel(model.weight.astype(np.float32), model.scale.astype(np.float32), model.shift, model.slope, model.level)
    @F.arrow_udf("double")
    def quality(column: pa.Array) -> pa.Array:
        return pa.array([small.score(features(d)) for d in texthash.rows(column)], pa.float64())
    return quality(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; each row is scored on its
    own whole text, however long, so repeated rows and null ids are kept. Null and empty
    texts get the model's base score; an empty table gives no rows; columns other than
    doc_id and text are not read."""
    bound_batches(docs.sparkSession)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns, whatever
    their names. Repeated rows and null ids are judged one by one by their whole text; null
    and empty texts have the model's base score and stay if it reaches the threshold; of an
    empty table nothing stays. Without labels of both classes the prior decides for all."""
    model = fit(docs, labels)
    return docs.where(score_column(model, F.col("text")) >= threshold)
