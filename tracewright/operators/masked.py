"""Masked reconstruction: hidden entries of a vector are predicted from its visible ones by a low-rank model.

The model is x = mean + basis * z. Given the basis, z of a row follows from its
visible entries by a small ridge regression; given all z, the basis follows from
sums over rows, one small matrix per dimension. Both steps are one pass: tasks
send a row per dimension, Spark adds these up, the driver solves them. What is
hidden is drawn anew in every pass, by digest, and is an exact share of a row.
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
from tracewright.operators.vector_stats import dimension_stats, width_of
from tracewright.session import settle

RATIO = 0.15
ROUNDS = 12
RIDGE = 1e-2
CHUNK = 2048


@dataclass
class Basis:
    mean: np.ndarray
    matrix: np.ndarray  # width x rank
    ridge: float

    def codes(self, x: np.ndarray, visible: np.ndarray) -> np.ndarray:
        """z of each row from its visible entries; x has the mean taken off."""
        rank = self.matrix.shape[1]
        squares = (self.matrix[:, :, None] * self.matrix[:, None, :]).reshape(len(self.matrix), rank * rank)
        left = (visible @ squares).reshape(-1, rank, rank) + self.ridge * np.eye(rank)
        return np.linalg.solve(left, ((visible * x) @ self.matrix)[:, :, None])[:, :, 0]


def hidden_entries(ids: np.ndarray, width: int, ratio: float, seed: int) -> np.ndarray:
    """0/1 per row and entry: exactly round(ratio * width) entries of each row, at least one, chosen by digests of row id, place and seed."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) ^ (np.arange(width, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed))[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    out = np.zeros(h.shape)
    np.put_along_axis(out, np.argsort(h, axis=1, kind="stable")[:, :max(1, round(ratio * width))], 1.0, axis=1)
    return out


def _chunks(batches, width: int, place: int, key: int):
    """(batch, ids, x, missing) in bounded pieces; missing entries of a vector are never visible and never counted."""
    for whole in batches:
        for a in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(a, CHUNK)
            x, there = matrix_of(batch.column(place), width)
            yield batch, batch.column(key).to_numpy(), x.astype(np.float64, copy=False), None if there is None else ~there


def fit(rows: DataFrame, vector: str, rank: int = 8, row_id: str = "row_id", ratio: float = RATIO, rounds: int = ROUNDS, seed: int = 42) -> Basis | None:
    """The basis over all rows; ``rank`` is at most half the width. None without rows."""
    points = settle(rows.where(F.col(vector).isNotNull()).select(F.xxhash64(row_id).alias("id"), vc.as_doubles(F.col(vector)).alias("vec")), "masked-points")
    width = width_of(points, "vec")
    if not width:
        return None
    whole = points.where(~F.exists("vec", lambda x: x.isNull()) & (F.size("vec") == width))
    stats = dimension_stats(whole, "vec").first()
    if stats["mean"] is None:
        return None
    mean, scale = np.array(stats["mean"]), float(np.sqrt(np.mean(np.square(stats["dev"])))) or 1.0
    rank = max(1, min(rank, width // 2))
    start = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, rank)))[0] * scale
    basis = Basis(mean, start, RIDGE * scale * scale)
    for step in range(rounds):
        shared = points.sparkSession.sparkContext.broadcast(basis)

        def run(batches, step=step, shared=shared):
            import pyarrow as pa

            own = shared.value
            left, right = np.zeros((width, rank * rank)), np.zeros((width, rank))
            for _, ids, x, missing in _chunks(batches, width, 1, 0):
                visible = 1.0 - hidden_entries(ids, width, ratio, seed + step)
                if missing is not None:
                    visible[missing] = 0.0
                x = x - own.mean
                z = own.codes(x, visible)
                left += visible.T @ (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
                right += (visible * x).T @ z
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(np.concatenate([left, right], axis=1).tolist(), pa.list_(pa.float64()))], ["place", "sums"])

        found = points.mapInArrow(run, "place int, sums array<double>").groupBy("place").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).collect()
        shared.destroy()
        matrix = np.zeros((width, rank))
        for r in found:
            sums = np.array(r["sums"])
            matrix[r["place"]] = np.linalg.solve(sums[:rank * rank].reshape(rank, rank) + basis.ridge * np.eye(rank), sums[rank * rank:])
        basis = Basis(mean, matrix, basis.ridge)
    return basis


def score(rows: DataFrame, vector: str, basis: Basis | None, row_id: str = "row_id", ratio: float = RATIO, masks: int = 4, seed: int = 7, out: str = "score") -> DataFrame:
    """Add the mean error over hidden entries, for ``masks`` draws of them.

    Null for rows without a vector and without a model; entries that are missing
    are neither visible nor counted.
    """
    rows = rows.drop(out)
    if basis is None:
        return rows.withColumn(out, F.lit(None).cast("double"))
    keyed = rows.withColumn("__key", F.xxhash64(row_id))
    shared = rows.sparkSession.sparkContext.broadcast(basis)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    place, key, width = keyed.columns.index(vector), len(rows.columns), len(basis.mean)

    def run(batches):
        import pyarrow as pa

        own = shared.value
        for batch, ids, x, missing in _chunks(batches, width, place, key):
            total, n = np.zeros(len(x)), np.zeros(len(x))
            centred = x - own.mean
            for m in range(masks):
                hidden = hidden_entries(ids, width, ratio, seed + m)
                visible = 1.0 - hidden
                if missing is not None:
                    hidden[missing] = visible[missing] = 0.0
                gap = own.codes(centred, visible) @ own.matrix.T - centred
                total += (hidden * gap * gap).sum(axis=1)
                n += hidden.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.divide(total, n, out=np.zeros_like(total), where=n > 0), pa.float64(), mask=n == 0)], [*batch.schema.names[:-1], out])

    return keyed.mapInArrow(run, schema)
