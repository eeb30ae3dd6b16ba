"""Toxicity by a classifier chain.

Categories are predicted one after another by linear (logistic) models over hashed
word indicators; the model of a category also gets the probabilities of the
categories before it. In training these are out-of-fold predictions, so that a
later model sees earlier probabilities as honest as those it will get in use.

One label is given, so the earlier categories are found in the labelled rows: the
indicators that tell toxic documents from others, by their counts over all training
rows, fall into two groups by which of them occur together in toxic documents (the sign
of their loading on the first principal direction). A category's labels are the toxic
documents with an indicator of its group; the last category is the label itself.
Indicators are chosen anew for every fold, from counts without the fold's rows, so an
out-of-fold prediction owes nothing to the row it is made for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import texthash
from .common import bound_batches, first_by_bytes, held_out, size_checked
from .quality import SAMPLE_BYTES, class_counts, sample_labels, training_labels, training_rows

SLOTS = 1 << 18
#: Bytes of a word's start that make an indicator of their own.
PREFIXES = (5, 7)
#: Most training rows of each class that the fits read.
SAMPLE_PER_CLASS = 4000
#: An indicator has a weight if its counts in the classes of some category differ so
#: clearly (log-likelihood ratio of independence, in nats times two).
MIN_RATIO = 20.0
THRESHOLD = 0.4
FOLDS = 5
U64 = np.uint64

NAMES = ("group_1", "group_2", "toxic")


def features(data: np.ndarray) -> np.ndarray:
    """The sorted slots of the words (letters and digits, ASCII letters lowered) and
    of the first bytes of longer words."""
    h, start, end = texthash.words(data, texthash.ALNUM)
    every = np.concatenate([h, *(texthash.prefixes(data, start, end, n) for n in PREFIXES)])
    return np.unique((every % U64(SLOTS)).astype(np.int32))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _minimise(f, w: np.ndarray, steps: int = 60, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS; ``f`` gives the value and the gradient."""
    value, g = f(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, coef = g.copy(), []
        for s, y, rho in reversed(past):
            coef.append(rho * (s @ d))
            d -= coef[-1] * y
        if past:
            s, y, _ = past[-1]
            d *= (s @ y) / (y @ y)
        for (s, y, rho), c in zip(past, reversed(coef)):
            d += (c - rho * (y @ d)) * s
        slope, size = g @ d, 1.0 if past else 1.0 / max(1e-12, float(np.linalg.norm(g)))
        for _ in range(25):
            new_value, new_g = f(w - size * d)
            if new_value <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = -size * d, new_g - g
        if s @ y > 1e-12:
            past = [*past[1 - memory:], (s, y, 1 / (s @ y))]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        w, value, g = w + s, new_value, new_g
        if done:
            break
    return w


def logistic(x: list[np.ndarray], dense: np.ndarray, y: np.ndarray, slots: int, ridge: float = 1e-3
             ) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic model over indicators (``x``: slots of each row) and dense columns. Returns the weights of the slots and of the dense columns, and
    the shift."""
    size = np.array([len(i) for i in x], np.int64)
    at = np.concatenate(x) if size.sum() else np.zeros(0, np.int32)
    who = np.repeat(np.arange(len(x)), size)
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    # halfway between the classes as they come and classes of equal weight
    weight = np.where(y > 0, math.sqrt(n0 / n1), 1.0)
    weight /= max(weight.sum(), 1.0)
    k = dense.shape[1]

    def loss(w):
        z = np.bincount(who, w[at], len(x)) + dense @ w[slots:slots + k] + w[-1]
        g = weight * (_sigmoid(z) - y)
        grad = np.concatenate((np.bincount(at, g[who], slots)[:slots], dense.T @ g, [g.sum()]))
        grad[:-1] += ridge * w[:-1]
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge / 2 * (w[:-1] @ w[:-1])), grad

    w = _minimise(loss, np.zeros(slots + k + 1))
    return w[:slots], w[slots:slots + k], float(w[-1])


@dataclass
class Chain:
    names: tuple[str, ...]
    slot_of: np.ndarray          # slot -> column of the weights, -1: none
    weight: np.ndarray           # by category and column
    earlier: list[np.ndarray]    # by category, of the probabilities before it
    shift: list[float]

    def predict(self, slots: np.ndarray) -> list[float]:
        cols = self.slot_of[slots]
        cols = cols[cols >= 0]
        p: list[float] = []
        for k in range(len(self.names)):
            z = float(self.weight[k][cols].sum()) + self.shift[k] + float(self.earlier[k] @ np.array(p))
            p.append(float(_sigmoid(z)))
        return p


def telling(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """By slot, the log-likelihood ratio statistic of indicator and class, 0 where the
    indicator is no likelier in class 1. ``counts``: rows of class 0 and 1 that have an
    indicator; ``rows``: rows of each class."""
    with_1, with_any = counts[1].astype(float), counts.sum(axis=0).astype(float)
    n1, n = float(rows[1]), float(rows.sum())
    if not n:
        return np.zeros(counts.shape[1])
    out = np.zeros(counts.shape[1])
    for seen, of in ((with_1, n1), (with_any - with_1, n - n1)):
        for part, whole in ((seen, with_any), (of - seen, n - with_any)):
            mean = whole * of / n
            out += 2 * np.where(part > 0, part * np.log(np.maximum(part, 1e-9) / np.maximum(mean, 1e-9)), 0)
    return np.where(with_1 * n > with_any * n1, out, 0)


def counted(x: list[np.ndarray], y: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Rows of each class (``y``: 0 or 1) among ``which`` that have each indicator."""
    return np.array([np.bincount(np.concatenate([np.zeros(0, np.int32), *(x[i] for i in which if y[i] == t)]), minlength=SLOTS)
                     for t in (0, 1)])


def groups(x: list[np.ndarray], slots: np.ndarray, rounds: int = 100) -> np.ndarray:
    """For each of ``slots`` its group, 0 or 1: the sign of its loading on the first
    principal direction of the rows ``x`` over these slots."""
    at = np.full(SLOTS, -1)
    at[slots] = np.arange(len(slots))
    cols = [c[c >= 0] for c in (at[i] for i in x)]
    who, col = np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate([np.zeros(0, np.int64), *cols]).astype(np.int64)
    mean = np.bincount(col, minlength=len(slots)) / max(1, len(cols))
    v = np.cos(np.arange(len(slots)) + 1.0)  # any start that is not symmetric
    for _ in range(rounds):
        score = np.bincount(who, v[col], len(cols)) - mean @ v
        v = np.bincount(col, score[who], len(slots)) - mean * score.sum()
        size = np.linalg.norm(v)
        if not size:
            break
        v /= size
    return (v > 0).astype(int)


def category_labels(x: list[np.ndarray], y: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Rows by categories: the toxic rows with an indicator of each group, and all toxic ones."""
    toxic = [x[i] for i in np.flatnonzero(y > 0)]
    of = np.full(SLOTS, -1)
    of[slots] = groups(toxic, slots)
    out = np.zeros((len(x), 3))
    out[:, 2] = y
    for i in np.flatnonzero(y > 0):
        for k in (0, 1):
            out[i, k] = float((of[x[i]] == k).any())
    return out


def fit_chain(x: list[np.ndarray], y: np.ndarray, names: tuple[str, ...], folds: int = FOLDS, counts: np.ndarray | None = None,
              rows: np.ndarray | None = None) -> Chain:
    """``y``: rows by categories, 0 or 1. ``counts`` and ``rows``: indicators and rows of each
    class of the last category over all training rows, these included (else only these)."""
    every, last = np.arange(len(x)), y[:, -1] if len(x) else np.zeros(0)
    if counts is None:
        counts, rows = counted(x, last, every), np.array([(last == 0).sum(), (last == 1).sum()])

    def columns(without: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], int]:
        """slot -> column for the indicators that tell, by counts without some rows."""
        less = np.array([(last[without] == t).sum() for t in (0, 1)])
        known = np.flatnonzero(telling(counts - counted(x, last, without), rows - less) >= MIN_RATIO)
        slot_of = np.full(SLOTS, -1, np.int32)
        slot_of[known] = np.arange(len(known))
        return slot_of, [c[c >= 0] for c in (slot_of[i] for i in x)], len(known)
    fold = every % folds
    slot_of, cols, n = columns(every[:0])
    parts = [columns(every[fold == f]) for f in range(folds)] if len(names) > 1 else []
    out_of_fold = np.zeros((len(x), 0))
    weight, earlier, shift = [], [], []
    for k in range(len(names)):
        w, e, b = logistic(cols, out_of_fold, y[:, k], n)
        weight.append(w)
        earlier.append(e)
        shift.append(b)
        if k + 1 < len(names):  # the last one feeds no other
            p = np.zeros(len(x))
            for f, (_, own, m) in enumerate(parts):
                learn, rest = every[fold != f], every[fold == f]
                wf, ef, bf = logistic([own[i] for i in learn], out_of_fold[learn], y[learn, k], m)
                for i in rest:
                    p[i] = _sigmoid(wf[own[i]].sum() + out_of_fold[i] @ ef + bf)
            out_of_fold = np.column_stack((out_of_fold, p))
    return Chain(names, slot_of, np.array(weight).reshape(len(names), n).astype(np.float32), earlier, shift)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Chain:
    """The chain from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic). Indicators are
    counted over all training rows; the models are fitted on at most ``per_class`` rows of
    each class, those of least hashed id, and ``SAMPLE_BYTES`` of indicators. With no
    training rows every probability is one half or less."""
    bound_batches(docs.sparkSession)
    known = training_labels(labels, "toxic")
    every = training_rows(docs, size_checked(known))
    counts = class_counts(every, features, SLOTS)
    sizes = {r["y"]: r["n"] for r in every.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = F.arrow_udf(lambda c: pa.array([features(d).tobytes() for d in texthash.rows(c)], pa.binary()), "binary")
    rows = training_rows(docs, sample_labels(known, per_class)).select("o", "doc_id", "y", slots("text").alias("slots"))
    sample = first_by_bytes(rows, ["o", "doc_id", "slots"], lambda r: len(r["slots"]), SAMPLE_BYTES)
    x = [np.frombuffer(r["slots"], np.int32) for r in sample]
    y = np.array([float(r["y"]) for r in sample])
    whole = np.array([sizes.get(0, 0), sizes.get(1, 0)])
    known_slots = np.flatnonzero(telling(counts, whole) >= MIN_RATIO)
    return fit_chain(x, category_labels(x, y, known_slots), NAMES, counts=counts, rows=whole)


def chain_column(chain: Chain, text: Column) -> Column:
    """A struct of the categories' probabilities; null text counts as empty."""
    names = chain.names

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def toxicity(column: pa.Array) -> pa.Array:
        p = [chain.predict(features(d)) for d in texthash.rows(column)]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in p], pa.float64()) for k in range(len(names))], list(names))
    return toxicity(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, p_<category>..., predicted): predicted is 1 where the last
    category's probability reaches the threshold. Every row is scored on its own
    whole text: repeated rows and null ids stay, an empty table gives no rows."""
    bound_batches(docs.sparkSession)
    p = docs.select("doc_id", held_out().alias("held_out"), chain_column(chain, F.col("text")).alias("p"))
    return p.select("doc_id", "held_out", *[F.col("p")[n].alias(f"p_{n}") for n in chain.names],
                    (F.col("p")[chain.names[-1]] >= threshold).cast("int").alias("predicted"))
