"""Quality classifier: a linear SVM over n-gram indicators scaled by naive Bayes log-count ratios.

Features are hashed indicators of byte 2- to 4-grams, lower-cased word uni- and bigrams, and 3-grams of "same word as
before" flags.  Each is scaled by its class log-count ratio, rows get unit length, and a hinge-loss model is fitted by
dual coordinate descent.  A logistic curve on rows that the SVM hasn't seen turns margins into scores.

The fit takes at most SAMPLE_ROWS labelled rows, those first in a hash order; scoring covers every whole text.
Null text counts as empty and gets the score of no features.  Without labelled rows every score is 0.5; with one class
it is that class's smoothed share.  Repeated rows get equal scores; no row depends on another.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, pieces

BITS = 18
SAMPLE_ROWS = 6_000
CUT = 0.3
C = 1.0
EPOCHS = 12
_GRAM = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_PAIR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def indicators(text: str | None, scratch: np.ndarray) -> np.ndarray:
    """Sorted ids of the features that the whole text has; scratch is an all-false array of 2**BITS."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.empty(0, np.int32)
    b = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
    for n in (2, 3, 4):
        if len(b) >= n:
            h = b[: len(b) - n + 1] * _GRAM[0]
            for k in range(1, n):
                h = (h ^ (h >> np.uint32(15))) * _GRAM[k] + b[k : len(b) - n + 1 + k]
            scratch[(h * _GRAM[0] + np.uint32(n)) >> np.uint32(32 - BITS)] = True
    words = data.lower().split()
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    scratch[w >> np.uint64(64 - BITS)] = True
    if len(w) > 1:
        scratch[((w[:-1] * _PAIR ^ w[1:]) * _MIX) >> np.uint64(64 - BITS)] = True
        same = (w[1:] == w[:-1]).astype(np.int64)
        if len(same) >= 3:
            scratch[1 + same[:-2] + 2 * same[1:-1] + 4 * same[2:]] = True
    found = np.flatnonzero(scratch).astype(np.int32)
    scratch[found] = False
    return found


def ratios(rows: list[np.ndarray], good: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)
    for x, y in zip(rows, good, strict=True):
        (p if y else q)[x] += 1
    r = np.log((p / p.sum()) / (q / q.sum()))
    r[(p == alpha) & (q == alpha)] = 0
    return r


def dual_descent(rows: list[np.ndarray], unit: Callable[[np.ndarray], np.ndarray], good: np.ndarray, c: float = C, epochs: int = EPOCHS) -> np.ndarray:
    """L2-regularised hinge loss; the last weight is the bias. Classes weigh alike in total.  unit: the values of a row, made when needed."""
    w = np.zeros((1 << BITS) + 1)
    y = np.where(good, 1.0, -1.0)
    cost = c * len(y) / (2 * np.where(good, max(1, good.sum()), max(1, (~good).sum())))
    alpha, square = np.zeros(len(y)), np.array([v @ v + 1 for v in map(unit, rows)])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            values = unit(rows[i])
            g = y[i] * (w[rows[i]] @ values + w[-1]) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * values
                w[-1] += step
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    t = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-4 * ab)
        ab -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(max(ab[0], 1e-3)), float(ab[1])


class Model:
    """Everything that scoring needs; its size is fixed by BITS."""

    def __init__(self, texts: list[str | None], labels: list[int]):
        good = np.asarray(labels, bool)
        self.weight = self.ratio = None
        self.constant = 0.5 if not len(good) else float((good.sum() + 1) / (len(good) + 2))
        if not len(good) or good.all() or not good.any():
            return
        scratch = np.zeros(1 << BITS, bool)
        rows = [indicators(t, scratch) for t in texts]
        fit = np.arange(len(rows)) % 5 != 4
        if len(set(good[~fit])) < 2 or len(set(good[fit])) < 2:
            fit[:] = True
        r = ratios([x for x, f in zip(rows, fit, strict=True) if f], good[fit])
        self.ratio = r.astype(np.float32)
        take = np.flatnonzero(fit)
        w = dual_descent([rows[i] for i in take], self.unit, good[fit])
        self.weight, self.bias = (w[:-1] * r).astype(np.float32), float(w[-1])
        seen = ~fit if not fit.all() else fit
        self.slope, self.intercept = logistic(np.array([self.margin(rows[i]) for i in np.flatnonzero(seen)]), good[seen])

    def unit(self, x: np.ndarray) -> np.ndarray:
        v = self.ratio[x].astype(np.float64)
        return v / (np.sqrt(v @ v) or 1.0)

    def margin(self, x: np.ndarray) -> float:
        v = self.ratio[x].astype(np.float64)
        return float(self.weight[x].sum(dtype=np.float64) / (np.sqrt(v @ v) or 1.0) + self.bias)

    def score(self, text: str | None, scratch: np.ndarray) -> float:
        if self.weight is None:
            return self.constant
        z = self.slope * self.margin(indicators(text, scratch)) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most sample_rows labelled documents for which learn holds."""
    own = docs.where(learn).select("doc_id", "text")
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = bounded_sample(own.join(marks, "doc_id"), sample_rows, "doc_id", "text").select("text", "quality").collect()
    return Model([r["text"] for r in some], [r["quality"] for r in some])


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scratch = np.zeros(1 << BITS, bool)
        for batch in batches:
            scores = [shared.value.score(t, scratch) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= cut) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows that the classifier accepts, with all columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        scratch = np.zeros(1 << BITS, bool)
        for batch in pieces(batches):
            yield batch.filter(pa.array([shared.value.score(t, scratch) >= cut for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
