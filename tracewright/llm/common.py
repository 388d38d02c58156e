"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import settle

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; other columns of the input can't clash with names used inside."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def remainder_of_id(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a published finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= _MIX
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


_POWERS: dict = {}
POWERS = (1 << 20) + 1


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n; the first 2**20 are kept for the life of a worker, longer ones aren't."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, POWERS)
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        up[0] = down[0] = 1
        up[1:], down[1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size == POWERS:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def released(run):
    """``run`` over batches, after which the worker gives freed memory back to the system, as it stays for other stages."""
    def through(*batches):
        try:
            yield from run(*batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not the GNU library
                pass
    return through


class Rolling:
    """Polynomial hashes of any stretch of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = len(data)
        up, self.down = powers(n + 1, base)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        """The hash of every stretch of ``width`` bytes."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def text_arrays(column) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of an Arrow string column in one array, and the n + 1 offsets of its rows; null is empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the joined bytes, and the first word of each row (n + 1 numbers)."""
    solid = ~IS_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    begins[rows] |= solid[rows]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = offsets[1:] - 1
    last = last[(last >= 0) & (offsets[1:] > offsets[:-1])]
    ends[last] |= solid[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def slices(batch, most_bytes: int = 1 << 20, column: str = "text"):
    """Cut an Arrow batch into pieces of about ``most_bytes`` of text (one row at least), so that arrays stay small."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(batch.num_columns)],
                                             batch.schema.names)


def _stars(rows: DataFrame, small: bool) -> DataFrame:
    """Rows (a, b), sorted by a and then b, to the star of each a: every b, or with ``small`` also a, points to the smallest."""

    def run(batches):
        import pyarrow as pa

        last_a = last_b = low = None
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            if not len(a):
                continue
            begin = np.concatenate(([a[0] != last_a], a[1:] != a[:-1]))
            again = np.concatenate(([a[0] == last_a and b[0] == last_b], (a[1:] == a[:-1]) & (b[1:] == b[:-1])))
            place = np.maximum.accumulate(np.where(begin, np.arange(len(a)), -1))
            smallest = np.where(place >= 0, np.minimum(a, b)[np.maximum(place, 0)], low if low is not None else 0)
            last_a, last_b, low = a[-1], b[-1], smallest[-1]
            x, m = b[~again], smallest[~again]
            if small:
                x, m = np.concatenate([x, a[begin]]), np.concatenate([m, smallest[begin]])
            else:
                keep = b[~again] > a[~again]
                x, m = x[keep], m[keep]
            x, m = x[x != m], m[x != m]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(m)], ["a", "b"])

    return rows.repartition("a").sortWithinPartitions("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, component) of every node on an edge (a, b) to another node; the component is its smallest id.

    The published alternation of large and small stars, each of them one sort
    by node that streams over its neighbours, so a node with very many needs no
    memory. A round is written to the shared folder; their number grows with
    the logarithm of the size.
    """
    now, state = settle(edges.select("a", "b").where("a <> b"), "edges"), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = settle(_stars(_stars(both, False), True), "stars")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == (mark["n"], mark["h"]):
            break
        state = mark["n"], mark["h"]
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return settle(now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(ends), "components")
