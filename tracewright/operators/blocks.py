"""Exact distance work between two sets of vectors, in bounded blocks.

Both sides are cut into cells around a few pivot vectors. A right-hand row is
sent only to the cells it can still matter for, by two exact lower bounds on
its distance to anything in the cell (triangle inequality and the plane
between two pivots). Cells are cut into blocks of a fixed number of rows, and
one task sees one pair of blocks; what leaves it is a small result per row,
never the pairs. The method is that of published pivot-based nearest-neighbour
joins for MapReduce.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.numbers import draw_key

# Rows whose distances to as many others a task holds at once.
BLOCK_ROWS = 2048
# A block that is sent has up to so many times these rows, and up to so many bytes; the fewer blocks there are, the fewer
# copies of a row are sent. There are at least so many pairs of blocks if there are rows for it, so that all cores have work.
WIDE = 32
WIDE_BYTES = 48 << 20
LEAST_PAIRS = 64
MAX_PIVOTS = 256
# A right side counted to be smaller than this is handed to every task whole.
LOCAL_BYTES = 16 << 20


def pairwise_squared(a: np.ndarray, b: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
    """Squared distances; ``norms`` are those of the rows of ``b``, if known."""
    norms = (b * b).sum(1) if norms is None else norms
    d2 = (a * a).sum(1)[:, None] + norms[None, :]
    product = a @ b.T
    product *= 2.0
    d2 -= product
    return np.maximum(d2, 0.0, out=d2)


def stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def pick_pivots(points: DataFrame, n_rows: int, block_rows: int, seed: int = 42) -> np.ndarray:
    """Vectors with the smallest draw keys; at most MAX_PIVOTS reach the driver."""
    n = int(min(MAX_PIVOTS, max(1, n_rows // (16 * block_rows))))
    top = (points.select("vec", draw_key(seed, F.col("id")).alias("key"), "id")
           .orderBy("key", "id").limit(n).collect())
    return np.array([r["vec"] for r in top], dtype=np.float64)


def assign_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot (``cell``) and the distance to it (``own``)."""
    schema = T.StructType(points.schema.fields + [
        T.StructField("cell", T.IntegerType()), T.StructField("own", T.DoubleType())])

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                d = np.sqrt(pairwise_squared(stack(pdf["vec"]), pivots))
                cell = d.argmin(1)
                yield pdf.assign(cell=cell.astype("int32"), own=d[np.arange(len(d)), cell])

    return points.mapInPandas(assign, schema)


def left_radii(left: DataFrame) -> dict:
    """(grp, cell) -> (rows, radius) for the cells that hold left rows; groups x pivots entries."""
    rows = left.groupBy("grp", "cell").agg(F.count("*").alias("n"), F.max("own").alias("radius")).collect()
    return {(r["grp"], r["cell"]): (r["n"], r["radius"]) for r in rows}


def _send(pivots: np.ndarray, radii: dict, reach: dict, counting: bool):
    """Function over batches of right rows: the rows to send to each cell, or their number."""
    gaps = np.sqrt(pairwise_squared(pivots, pivots))
    by_group: dict = {}
    for (grp, cell), (_, radius) in radii.items():
        by_group.setdefault(grp, []).append((cell, radius, reach[(grp, cell)]))

    def send(batches):
        for pdf in batches:
            for grp, part in pdf.groupby("grp", sort=False):
                targets = by_group.get(grp)
                if not targets:
                    continue
                d = np.sqrt(pairwise_squared(stack(part["vec"]), pivots))
                own = d.argmin(1)
                near = d[np.arange(len(d)), own]
                for cell, radius, limit in targets:
                    bound = d[:, cell] - radius
                    gap = gaps[own, cell]
                    plane = np.where(gap > 0, (d[:, cell] ** 2 - near ** 2) / (2 * np.where(gap > 0, gap, 1)), 0.0)
                    # The slack covers rounding in the distances, so no row is lost.
                    hit = np.maximum(bound, plane) <= limit * (1 + 1e-9) + 1e-9
                    if not hit.any():
                        continue
                    if counting:
                        yield pd.DataFrame({"grp": [grp], "cell": [cell], "n": [int(hit.sum())]})
                    else:
                        yield part[hit].assign(cell=np.int32(cell))

    return send


def block_count(n: int, block_rows: int, wide: int, least: int) -> int:
    """Blocks of ``wide`` times ``block_rows`` rows; ``least`` of them if they don't get smaller than ``block_rows``."""
    return max(-(-n // (wide * block_rows)), min(-(-n // block_rows), least))


def _pairs_left(n_left: dict, n_right: dict) -> float:
    """Share of the pairs of a group's rows that cells don't rule out; both sides are the same rows."""
    rows: dict = {}
    for (grp, _), n in n_left.items():
        rows[grp] = rows.get(grp, 0) + n
    return sum(n * n_right.get(key, 0) for key, n in n_left.items()) / max(1, sum(n * n for n in rows.values()))


def pair_blocks(left: DataFrame, right: DataFrame, fn: Callable, schema: str, reach: Callable | float = math.inf,
                pivots: np.ndarray | None = None, block_rows: int = BLOCK_ROWS,
                local_bytes: int = LOCAL_BYTES, fold: Callable | None = None, twin: bool = False) -> DataFrame:
    """Run ``fn(left_pdf, right_pdf)`` on every pair of blocks that can hold a pair within reach.

    Both sides carry ``grp``, ``id``, ``vec`` and any further columns; only rows
    of one group meet. ``reach`` is a distance, or a function of the cell radii
    that gives one per (grp, cell). ``fn`` gets some rows of a left block and all
    of a right one, about ``block_rows`` squared pairs at once. With ``fold`` it
    gets ``block_rows`` rows of each, and ``fold`` makes the results of one pair of blocks smaller. With ``twin`` both sides
    are the same rows with the same columns; where there are no cells, two blocks then meet in one task for both directions, so
    about half as many copies of a row are sent.
    """
    spark = left.sparkSession
    out_names = [f.split()[0] for f in schema.split(",")]
    measured = right.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("w")).first()
    if measured["n"] * 8 * ((measured["w"] or 0) + 16) <= local_bytes:
        return _against_all(left, right.toPandas(), fn, schema, block_rows)
    if pivots is None or len(pivots) <= 1:
        n_left = {(r["grp"], 0): r["n"] for r in left.groupBy("grp").agg(F.count("*").alias("n")).collect()}
        n_right = {(r["grp"], 0): r["n"] for r in right.groupBy("grp").agg(F.count("*").alias("n")).collect()}
        left, sent = left.withColumn("cell", F.lit(0)), right.withColumn("cell", F.lit(0))
    else:
        left = assign_cells(left, pivots)
        radii = left_radii(left)
        limits = reach(radii) if callable(reach) else {key: reach for key in radii}
        grp_type = right.schema["grp"].dataType.simpleString()
        counted = right.mapInPandas(_send(pivots, radii, limits, True), f"grp {grp_type}, cell int, n bigint")
        n_left = {key: n for key, (n, _) in radii.items()}
        n_right = {(r["grp"], r["cell"]): r["n"]
                   for r in counted.groupBy("grp", "cell").agg(F.sum("n").alias("n")).collect()}
        if twin and _pairs_left(n_left, n_right) > 0.5:  # cells that rule out little only add copies
            return pair_blocks(left.drop("cell", "own"), right, fn, schema, reach, None, block_rows, local_bytes, fold, twin)
        right_schema = T.StructType(right.schema.fields + [T.StructField("cell", T.IntegerType())])
        sent = right.mapInPandas(_send(pivots, radii, limits, False), right_schema)
        left = left.drop("own")

    both = [(key, n_left[key], n) for key, n in n_right.items() if key in n_left]
    wide = max(1, min(WIDE, WIDE_BYTES // (8 * ((measured["w"] or 0) + 16) * block_rows)))
    least = math.isqrt(LEAST_PAIRS // max(1, len(both))) or 1
    plan = [(*key, block_count(n, block_rows, wide, least), block_count(m, block_rows, wide, least)) for key, n, m in both]
    grp_type = left.schema["grp"].dataType.simpleString()
    # groups x pivots rows
    plan_df = F.broadcast(spark.createDataFrame(plan, f"grp {grp_type}, cell int, lb bigint, rb bigint"))
    slot = F.xxhash64("id")

    def spread(side: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        placed = side.join(plan_df, ["grp", "cell"]).withColumn(own, F.pmod(slot, F.col(own_n)))
        first = F.col("bl") if twin and own == "bl" else F.lit(0).cast("bigint")
        last = F.col("br") if twin and own == "br" else F.col(other_n) - 1
        placed = (placed.withColumn(other, F.explode(F.sequence(first, last)))
                  .drop("lb", "rb"))
        # Fresh column identities: both sides may come from one table.
        return placed.select(*[F.col(c).alias(c) for c in placed.columns])

    twin = twin and (pivots is None or len(pivots) <= 1)
    keys = ["grp", "cell", "bl", "br"]
    a = spread(left, "bl", "lb", "br", "rb").groupBy(*keys)
    b = spread(sent, "br", "rb", "bl", "lb").groupBy(*keys)

    def sweep(x: pd.DataFrame, y: pd.DataFrame) -> list:
        across = block_rows if fold else len(y)
        step = max(1, block_rows * block_rows // across)
        # A part of the right block stays one object, so fn can keep what it made of it.
        others = [y.iloc[j:j + across] for j in range(0, len(y), across)]
        return [fn(x.iloc[i:i + step], other) for i in range(0, len(x), step) for other in others]

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame(columns=out_names)
        parts = sweep(x, y) + (sweep(y, x) if twin and key[2] != key[3] else [])
        out = pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)
        return fold(out) if fold else out

    return a.cogroup(b).applyInPandas(run, schema)


def _against_all(left: DataFrame, right: pd.DataFrame, fn: Callable, schema: str, block_rows: int) -> DataFrame:
    groups = {grp: part for grp, part in right.groupby("grp", sort=False)}

    def run(batches):
        for pdf in batches:
            for grp, rows in pdf.groupby("grp", sort=False):
                other = groups.get(grp)
                if other is None:
                    continue
                for i in range(0, len(rows), block_rows):
                    for j in range(0, len(other), block_rows):
                        yield fn(rows.iloc[i:i + block_rows], other.iloc[j:j + block_rows])

    return left.mapInPandas(run, schema)
