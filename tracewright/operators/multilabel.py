"""One logistic model per class, all trained in the same passes over the rows.

Each class has its own quasi-Newton search (limited-memory BFGS), written as a
generator that yields the point it wants evaluated. A pass takes the points of
all classes at once: two matrix products per batch give every class's loss and
gradient, a task sends one row per class, and Spark adds these up. So the
number of jobs is that of the slowest class, whatever the number of classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import vectors as vc
from tracewright.operators.pooling import matrix_of
from tracewright.operators.vector_stats import width_of
from tracewright.session import settle

# Weight of half the squared length of the coefficients (without intercept) against the summed loss.
PENALTY = 1.0
TOLERANCE = 1e-6
MEMORY = 10
CHUNK = 4096


def search(start: np.ndarray, most_steps: int, tolerance: float):
    """Minimise a smooth function: yields points, is sent (value, gradient), returns the last point accepted.

    Ends when no entry of the gradient exceeds ``tolerance``, or when no step along it lowers the value.
    """
    x = start
    value, grad = yield x
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most_steps):
        if np.abs(grad).max() <= tolerance:
            break
        q, shares = grad.copy(), []
        for s, y in reversed(moves):
            a = (s @ q) / (s @ y)
            shares.append(a)
            q -= a * y
        if moves:
            s, y = moves[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(np.abs(grad).sum(), 1.0)
        for (s, y), a in zip(moves, reversed(shares)):
            q += s * (a - (y @ q) / (s @ y))
        slope, step = -(grad @ q), 1.0
        if slope >= 0:
            moves = []
            continue
        while True:
            trial = x - step * q
            new, new_grad = yield trial
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
            if step < 1e-10:
                return x
        s, y = trial - x, new_grad - grad
        if s @ y > 1e-12 * (y @ y):
            moves = [*moves, (s, y)][-MEMORY:]
        x, value, grad = trial, new, new_grad
    return x


@dataclass
class Weights:
    """Coefficients with the intercept last, one row per class; ``constant`` holds the label of classes that have just one, NaN elsewhere."""

    matrix: np.ndarray
    constant: np.ndarray
    scans: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.matrix[:, :-1].T + self.matrix[:, -1]
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
        return np.where(np.isnan(self.constant), p, self.constant)


def _labels(column, k: int) -> np.ndarray:
    """0/1 labels of the first ``k`` classes; null and missing ones are 0."""
    return (matrix_of(column, k)[0] > 0).astype(np.float64)


def _evaluate(points: DataFrame, trials: dict[int, np.ndarray], k: int, width: int, hinge: bool = False) -> dict[int, tuple[float, np.ndarray]]:
    """Loss and gradient for the points of all classes, in one pass."""
    shared = points.sparkSession.sparkContext.broadcast((np.array(list(trials)), np.stack(list(trials.values()))))

    def run(batches):
        import pyarrow as pa

        classes, w = shared.value
        loss, grad = np.zeros(len(classes)), np.zeros(w.shape)
        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(a, CHUNK)
                x, y = matrix_of(batch.column(0), width)[0].astype(np.float64, copy=False), _labels(batch.column(1), k)[:, classes]
                z = x @ w[:, :-1].T + w[:, -1]
                if hinge:
                    side = 2.0 * y - 1.0
                    short = np.maximum(0.0, 1.0 - side * z)
                    loss += (short * short).sum(axis=0)
                    error = -2.0 * side * short
                else:
                    loss += (np.logaddexp(0.0, z) - y * z).sum(axis=0)
                    error = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - y
                grad[:, :-1] += error.T @ x
                grad[:, -1] += error.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int32()), pa.array(loss), pa.array(grad.tolist(), pa.list_(pa.float64()))], ["class", "loss", "grad"])

    sums = points.select("vec", "bits").mapInArrow(run, "class int, loss double, grad array<double>").groupBy("class").agg(
        F.sum("loss").alias("loss"), vector_to_array(Summarizer.sum(array_to_vector("grad"))).alias("grad")).collect()
    shared.destroy()
    out = {}
    for r in sums:
        w, grad = trials[r["class"]], np.array(r["grad"])
        grad[:-1] += PENALTY * w[:-1]
        out[r["class"]] = (r["loss"] + PENALTY / 2 * float(w[:-1] @ w[:-1]), grad)
    return out


def label_counts(points: DataFrame, k: int) -> tuple[int, np.ndarray]:
    """Rows, and rows with each label."""

    def run(batches):
        import pyarrow as pa

        n, held = 0, np.zeros(k, np.int64)
        for batch in batches:
            n += batch.num_rows
            held += _labels(batch.column(0), k).sum(axis=0).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, k), pa.int32()), pa.array(np.append([n], held))], ["class", "n"])

    found = {r["class"]: r["n"] for r in points.select("bits").mapInArrow(run, "class int, n bigint").groupBy("class").agg(F.sum("n").alias("n")).collect()}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(k)])


def fit(points: DataFrame, k: int, most_steps: int = 1000, tolerance: float = TOLERANCE, hinge: bool = False) -> Weights:
    """Models of the ``k`` classes over (vec, bits), settled; half the squared coefficients are added to the summed loss.

    ``tolerance`` is for the gradient of the mean loss. A class without
    positive or without negative rows gets no model but that constant. Null
    entries of a vector count as 0. ``hinge`` takes squared hinge losses, for margins, in place of logistic ones.
    """
    width = width_of(points, "vec")
    n, held = label_counts(points, k)
    constant = np.where(held == 0, 0.0, np.where(held == n, 1.0, np.nan))
    matrix = np.zeros((k, width + 1))
    runs = {c: search(matrix[c].copy(), most_steps, tolerance * n) for c in range(k) if np.isnan(constant[c])}
    trials, scans = {c: next(r) for c, r in runs.items()}, 1
    while trials:
        scans += 1
        answers = _evaluate(points, trials, k, width, hinge)
        nxt = {}
        for c in trials:
            try:
                nxt[c] = runs[c].send(answers[c])
            except StopIteration as end:
                matrix[c] = end.value
        trials = nxt
    return Weights(matrix, constant, scans)


def cells(points: DataFrame, weights: Weights, classes: list[str], row_id: str) -> DataFrame:
    """(row_id, class, y_true, score): one row per row of ``points`` (row_id, vec, bits) and class."""
    kind = points.schema[row_id].dataType
    schema = T.StructType([T.StructField(row_id, kind), T.StructField("class", T.StringType()), T.StructField("y_true", T.IntegerType()), T.StructField("score", T.DoubleType())])
    shared = points.sparkSession.sparkContext.broadcast((weights, classes))

    def run(batches):
        import pyarrow as pa

        own, names = shared.value
        k, width = len(names), own.matrix.shape[1] - 1
        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(a, CHUNK)
                p = own.scores(matrix_of(batch.column(1), width)[0].astype(np.float64, copy=False))
                row = pa.array(np.repeat(np.arange(batch.num_rows), k))
                name = pa.array(names).take(pa.array(np.tile(np.arange(k), batch.num_rows)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), name, pa.array(_labels(batch.column(2), k).astype(np.int32).ravel()), pa.array(p.ravel())],
                                                 [row_id, "class", "y_true", "score"])

    return points.select(row_id, "vec", "bits").mapInArrow(run, schema)


def prepared(rows: DataFrame, vector: str, bits: str, row_id: str, name: str) -> DataFrame:
    return settle(rows.select(row_id, vc.as_doubles(F.col(vector)).alias("vec"), F.col(bits).cast("array<double>").alias("bits")), name)
