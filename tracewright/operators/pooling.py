"""Mean vectors of token lists as a product of a sparse count matrix with a vector table, in blocks.

The most used tokens whose vectors fit a byte limit travel to every task, and
rows are multiplied where they lie. All other tokens leave their rows as
(row, number of the token, count) and meet their vectors in blocks of
dimensions, and the partial sums are added per row. What is shuffled is a number
per different rare token of a row and block, and one vector per row, never one
per block of the vocabulary or token use. Words that are built from n-grams are
built where their rows lie while the n-gram table fits.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators.joining import BROADCAST_BYTES, explode_values, lookup_join
from tracewright.session import settle

# Bytes of vectors that travel to every task, and of one block of dimensions of the rest.
HOT_BYTES = 128 << 20
BLOCK_BYTES = 128 << 20
# Uses of rare tokens that meet a block of dimensions in one place.
SLICE_ROWS = 64 << 20
# Numbers that a product holds at once.
CELLS = 1 << 21


def matrix_of(column, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """An Arrow column of number lists as a matrix, and a mask of the entries that are there if some aren't.

    Null lists, null entries and those beyond the end of a short list aren't there (0 in the matrix); those beyond ``width`` are left out.
    """
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    sizes = np.zeros(len(column), np.int64) if not len(column) else np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    kind = np.float32 if pa.types.is_float32(flat.type) else np.float64
    if (sizes == width).all() and not flat.null_count:
        return flat.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width), None
    row = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    known = flat.is_valid().to_numpy(zero_copy_only=False) & (at < width)
    matrix, there = np.zeros((len(column), width), kind), np.zeros((len(column), width), bool)
    matrix[row[known], at[known]] = flat.fill_null(0).to_numpy(zero_copy_only=False)[known]
    there[row[known], at[known]] = True
    return matrix, there


class Keys:
    """Keys of a part of the vocabulary."""

    def __init__(self, keys):
        self.keys = keys

    def find(self, keys) -> np.ndarray:
        """Place of each key of an Arrow array, -1 if it isn't there."""
        import pyarrow.compute as pc

        return pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)


class Vectors(Keys):
    """A part of the vocabulary: keys and their vectors."""

    def __init__(self, keys, column, width: int):
        super().__init__(keys)
        self.matrix, self.there = matrix_of(column, width)

    def sums(self, row: np.ndarray, at: np.ndarray, weight: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Weighted sum of vectors for each of ``rows`` rows, and the sum of weights: per dimension if entries are missing, one otherwise."""
        total = add_by_row(self.matrix, row, at, weight, rows)
        if self.there is None:
            return total, np.bincount(row, weight, rows)[:, None]
        return total, add_by_row(self.there, row, at, weight, rows)


def add_by_row(matrix: np.ndarray, row: np.ndarray, at: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """out[row] += weight * matrix[at], in double precision; ``row`` is sorted."""
    out = np.zeros((rows, matrix.shape[1]))
    if not len(row):
        return out
    step = max(1, CELLS // max(1, matrix.shape[1]))
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    weight = weight.astype(np.float64)
    for r, a, b in zip(row[first].tolist(), first.tolist(), [*first[1:].tolist(), len(row)]):
        for c in range(a, b, step):
            out[r] += weight[c:min(c + step, b)] @ matrix[at[c:min(c + step, b)]].astype(np.float64)
    return out


def token_counts(lists) -> tuple[object, np.ndarray, np.ndarray, np.ndarray]:
    """Different tokens of an Arrow column of token lists, and sorted (row, token, count); null tokens don't count."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    which = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    row, which = row[which >= 0], which[which >= 0]
    n = max(len(coded.dictionary), 1)
    key, count = np.unique(row * n + which, return_counts=True)
    return coded.dictionary, key // n, key % n, count


def _list(values: np.ndarray):
    import pyarrow as pa

    values = np.ascontiguousarray(values, np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _means(total: np.ndarray, weight: np.ndarray):
    """Rows without any weight are zeros; single dimensions without are null."""
    import pyarrow as pa

    weight = np.broadcast_to(weight, total.shape)
    mean = np.divide(total, weight, out=np.zeros_like(total), where=weight > 0).astype(np.float32)
    gone = (weight == 0) & (weight > 0).any(axis=1)[:, None]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(mean) + 1) * mean.shape[1], pa.int32()), pa.array(mean.ravel(), mask=gone.ravel() if gone.any() else None))


def key_bytes(df: DataFrame, width: int) -> int:
    """Bytes a key with its vector takes at most: 64 for the key."""
    return 64 + width * (4 if df.schema["vec"].dataType.simpleString() == "array<float>" else 8)


def collect_vectors(df: DataFrame, key: str, width: int) -> Vectors:
    """A table (key, vec) that was counted to be small, in key order."""
    table = df.select(key, "vec").orderBy(key).toArrow()
    return Vectors(table.column(0).combine_chunks(), table.column(1), width)


def gram_slots(word: str, buckets: int, seed: int) -> list[int]:
    """Bucket of every n-gram of 3 to 6 characters of a word between boundary marks."""
    marked, lead, md5 = f"<{word}>", f"{seed}:".encode(), hashlib.md5
    if marked.isascii():
        marked = marked.encode()
        grams = [marked[i:i + n] for n in range(3, 7) for i in range(len(marked) - n + 1)]
    else:
        grams = [marked[i:i + n].encode() for n in range(3, 7) for i in range(len(marked) - n + 1)]
    return [int.from_bytes(md5(lead + g).digest()[:4]) % buckets for g in grams]


class Subwords:
    """Vectors of words outside the vocabulary, from the vectors of their hashed n-grams."""

    def __init__(self, vectors: Vectors, buckets: int, seed: int):
        self.vectors, self.buckets, self.seed = vectors, buckets, seed

    def build(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean vector of each word and which entries are there."""
        import pyarrow as pa

        slots = [gram_slots(w, self.buckets, self.seed) for w in words]
        row = np.repeat(np.arange(len(words)), [len(s) for s in slots])
        at = self.vectors.find(pa.array([x for s in slots for x in s], self.vectors.keys.type))
        total, n = self.vectors.sums(row[at >= 0], at[at >= 0], np.ones(int((at >= 0).sum())), len(words))
        n = np.broadcast_to(n, total.shape)
        return np.divide(total, n, out=np.zeros_like(total), where=n > 0), n > 0


def _pool_here(rows: DataFrame, hot: Vectors, tokens: str, out: str, subwords: Subwords | None = None) -> DataFrame:
    """Pool rows where they lie; the vectors in ``hot`` are all there are."""
    rows = rows.drop(out)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    shared = rows.sparkSession.sparkContext.broadcast((hot, subwords))
    place = rows.columns.index(tokens)

    def run(batches):
        import pyarrow as pa

        vectors, extra = shared.value
        width = vectors.matrix.shape[1]
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                words, row, which, count = token_counts(batch.column(place))
                at = vectors.find(words)[which] if len(words) else which
                known = at >= 0
                total, n = vectors.sums(row[known], at[known], count[known], batch.num_rows)
                if extra is not None and not known.all():
                    new, index = np.unique(which[~known], return_inverse=True)
                    built, there = extra.build(words.take(pa.array(new)).to_pylist())
                    total = total + add_by_row(built, row[~known], index, count[~known], batch.num_rows)
                    n = np.broadcast_to(n, (batch.num_rows, width)) + add_by_row(there, row[~known], index, count[~known], batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, _means(total, n)], [*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def _others(rows: DataFrame, hot: Vectors, tokens: str) -> DataFrame:
    """(__row, token, n): the tokens of each row that aren't hot, with their counts."""
    shared = rows.sparkSession.sparkContext.broadcast(Keys(hot.keys))

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                words, row, which, count = token_counts(batch.column(1))
                rest = (shared.value.find(words)[which] if len(words) else which) < 0
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[rest])), words.take(pa.array(which[rest])), pa.array(count[rest], pa.int64())],
                                                 ["__row", "token", "n"])

    return rows.select("__row", tokens).mapInArrow(run, "__row bigint, token string, n bigint")


PARTS = "__row bigint, at int, total array<double>, weight array<double>"


def _hot_sums(rows: DataFrame, hot: Vectors, tokens: str) -> DataFrame:
    """(__row, at, total, weight) of the hot tokens of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                words, row, which, count = token_counts(batch.column(1))
                at = shared.value.find(words)[which] if len(words) else which
                known = at >= 0
                total, n = shared.value.sums(row[known], at[known], count[known], batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(len(total)), pa.int32()), _list(total), _list(n)], ["__row", "at", "total", "weight"])

    return rows.select("__row", tokens).mapInArrow(run, PARTS)


def _built_sums(entries: DataFrame, subwords: Subwords) -> DataFrame:
    """(__row, at, total, weight) of words that are built from n-grams: entries (__row, words: array of (token, n)), a row each."""
    shared = entries.sparkSession.sparkContext.broadcast(subwords)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                lists = batch.column(1)
                flat = lists.flatten()
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                coded = pc.dictionary_encode(flat.field(0))
                which, count = coded.indices.to_numpy().astype(np.int64), flat.field(1).to_numpy()
                built, there = shared.value.build(coded.dictionary.to_pylist())
                total, n = add_by_row(built, row, which, count, len(lists)), add_by_row(there, row, which, count, len(lists))
                n = n[:, :1] if (n == n[:, :1]).all() else n
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(len(total)), pa.int32()), _list(total), _list(n)], ["__row", "at", "total", "weight"])

    return entries.mapInArrow(run, PARTS)


def _block_sums(entries: DataFrame, vectors: DataFrame, width: int, part: int, slices: int) -> DataFrame:
    """(__row, at, total, weight) of each row and each block of ``part`` dimensions: entries (__row, uses: array of (id, n)), a row
    each, against vectors (id, vec).

    A block holds its dimensions of all vectors, so a row gets every number
    once, however many vectors it uses. Vectors of a block come before its
    entries and are all a task holds; the entries stream past them.
    """
    blocks = -(-width // part)
    kind, uses = vectors.schema["vec"].dataType.simpleString(), "array<struct<id: bigint, n: bigint>>"
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    left = vectors.select("id", "vec", block).select("id", "block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.slice("vec", F.col("block") * part + 1, F.lit(part)).alias("vec"))
    left = left.select("block", "slice", F.lit(-1).cast("bigint").alias("__row"), "id", F.lit(None).cast(uses).alias("uses"), "vec")
    right = entries.select("__row", "uses", block).select("block", F.pmod(F.xxhash64("__row"), F.lit(slices)).cast("int").alias("slice"), "__row", F.lit(0).cast("bigint").alias("id"), "uses", F.lit(None).cast(kind).alias("vec"))
    rows = left.unionByName(right).repartition("block", "slice").sortWithinPartitions("block", "slice", "__row", "id")

    def run(batches):
        import pyarrow as pa

        now, held, keys, matrix, there = None, [], None, None, None
        for batch in batches:
            where = batch.column(0).to_numpy() * slices + batch.column(1).to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else []
            for a, b in zip(begin, [*begin[1:], len(where)]):
                piece = batch.slice(a, b - a)
                if where[a] != now:
                    now, held, keys, matrix, there = where[a], [], None, None, None
                first = int(where[a]) // slices * part
                cut = int(np.searchsorted(piece.column(2).to_numpy(), 0))
                if cut:
                    held.append(piece.slice(0, cut).select([3, 5]))
                if cut == piece.num_rows or not held and keys is None:
                    continue
                if keys is None:
                    table = pa.Table.from_batches(held)
                    held = []
                    keys = table.column(0).to_numpy()
                    matrix, there = matrix_of(table.column(1), min(part, width - first))
                    del table
                for c in range(cut, piece.num_rows, 1024):
                    some = piece.slice(c, 1024)
                    flat = some.column(4).flatten()
                    row = np.repeat(np.arange(some.num_rows), some.column(4).value_lengths().to_numpy())
                    at, n = np.searchsorted(keys, flat.field(0).to_numpy()), flat.field(1).to_numpy()
                    total = add_by_row(matrix, row, at, n, some.num_rows)
                    weight = np.bincount(row, n, some.num_rows)[:, None] if there is None else add_by_row(there, row, at, n, some.num_rows)
                    yield pa.RecordBatch.from_arrays([some.column(2), pa.array(np.full(len(total), first), pa.int32()), _list(total), _list(weight)], ["__row", "at", "total", "weight"])

    return rows.mapInArrow(run, PARTS)


def _add_up(parts: DataFrame, width: int, out: str) -> DataFrame:
    """One (__row, mean) per row from its partial sums, each from dimension ``at`` on, with one weight for all or one for each."""

    def run(batches):
        import pyarrow as pa

        last = None
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                ids = batch.column(0).to_numpy()
                sizes, many = batch.column(2).value_lengths().to_numpy().astype(np.int64), batch.column(3).value_lengths().to_numpy()
                row, first = np.repeat(np.arange(len(ids)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
                place = np.arange(len(row)) - first
                total, weight = np.zeros((len(ids), width)), np.zeros((len(ids), width))
                total[row, batch.column(1).to_numpy()[row] + place] = batch.column(2).flatten().to_numpy()
                of = (np.cumsum(many) - many)[row] + np.where(many[row] == 1, 0, place)
                weight[row, batch.column(1).to_numpy()[row] + place] = batch.column(3).flatten().to_numpy()[of]
                first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                ids, total, weight = ids[first], np.add.reduceat(total, first, axis=0), np.add.reduceat(weight, first, axis=0)
                if last is not None and last[0][0] == ids[0]:
                    total[0] += last[1][0]
                    weight[0] += last[2][0]
                elif last is not None:
                    ids, total, weight = np.concatenate([last[0], ids]), np.concatenate([last[1], total]), np.concatenate([last[2], weight])
                last = ids[-1:], total[-1:], weight[-1:]
                if len(ids) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[:-1]), _means(total[:-1], weight[:-1])], ["__row", out])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(last[0]), _means(last[1], last[2])], ["__row", out])

    schema = T.StructType([T.StructField("__row", T.LongType()), T.StructField(out, T.ArrayType(T.FloatType()))])
    return parts.repartition("__row").sortWithinPartitions("__row", "at").mapInArrow(run, schema)


def pooled(rows: DataFrame, vocab: DataFrame, width: int, tokens: str, out: str, limit: int = HOT_BYTES, block_bytes: int = BLOCK_BYTES,
           slice_rows: int = SLICE_ROWS, subwords: Subwords | None = None) -> DataFrame:
    """``rows`` with the mean vector of the tokens that ``vocab`` (token, vec; settled) knows, as array<float>.

    Repeats count, null tokens don't. A row without a known token gets zeros, a
    dimension that no known token has is null. With ``subwords`` all other
    tokens are built from their n-grams.
    """
    n, one = vocab.count(), key_bytes(vocab, width)
    most = limit // one
    if n <= most:
        return _pool_here(rows, collect_vectors(vocab, "token", width), tokens, out, subwords)
    rows = settle(rows.drop(out).withColumn("__row", F.monotonically_increasing_id()), "pool-rows")
    used = settle(explode_values(rows, [], tokens, "token").groupBy("token").agg(F.count("*").alias("n")).join(vocab.select("token"), "token", "left_semi"), "pool-used")
    hot = settle(used.orderBy(F.desc("n"), "token").limit(most).select("token"), "pool-hot")
    held = collect_vectors(vocab.join(F.broadcast(hot), "token", "left_semi"), "token", width)
    rare = settle(used.join(F.broadcast(hot), "token", "left_anti").withColumn("id", F.monotonically_increasing_id()), "pool-rare")
    size = rare.agg(F.count("*").alias("tokens"), F.sum("n").alias("uses")).first()
    parts = _hot_sums(rows, held, tokens)
    if size["tokens"] or subwords is not None:
        ids = rare.select("token", "id")
        ids.is_settled = True
        others = lookup_join(_others(rows, held, tokens), ids, ["token"], "inner" if subwords is None else "left", row_bytes=32)
        use, word = F.struct("id", "n"), F.struct("token", "n")
        others = settle(others.groupBy("__row").agg(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), use))).alias("uses"),
                                                    F.sort_array(F.collect_list(F.when(F.col("id").isNull(), word))).alias("words")), "pool-others")
        if size["tokens"]:
            wide = 4 if vocab.schema["vec"].dataType.simpleString() == "array<float>" else 8
            part, slices = min(width, max(1, block_bytes // (wide * size["tokens"]))), -(-size["uses"] // slice_rows)
            cold = vocab.join(F.broadcast(ids) if 64 * size["tokens"] <= BROADCAST_BYTES else ids, "token").select("id", "vec")
            parts = parts.unionByName(_block_sums(others.where(F.size("uses") > 0).select("__row", "uses"), cold, width, part, slices))
        if subwords is not None:
            parts = parts.unionByName(_built_sums(others.where(F.size("words") > 0).select("__row", "words"), subwords))
    return rows.join(_add_up(parts, width, out), "__row").drop("__row")


def pooled_subwords(rows: DataFrame, vocab: DataFrame, buckets: DataFrame, n_buckets: int, width: int, tokens: str, out: str, seed: int,
                    limit: int = HOT_BYTES) -> DataFrame:
    """Like ``pooled``; a token outside ``vocab`` stands for the mean vector of its n-grams in ``buckets`` (bucket, vec; settled).

    A token none of whose n-grams has a bucket doesn't count. Where the buckets
    fit half the limit, or with the vocabulary all of it, words are built where they occur. Otherwise each
    distinct unknown word is built once, as a pool over its buckets, and joins the vocabulary.
    """
    size = buckets.count() * key_bytes(buckets, width)
    if 2 * size <= limit or size + vocab.count() * key_bytes(vocab, width) <= limit:
        grams = Subwords(collect_vectors(buckets, "bucket", width), n_buckets, seed)
        return pooled(rows, vocab, width, tokens, out, limit - size, subwords=grams)
    words = explode_values(rows, [], tokens, "token").distinct().join(vocab.select("token"), "token", "left_anti")

    def slots(batches):
        import pyarrow as pa

        for batch in batches:
            found = [[str(s) for s in gram_slots(w, n_buckets, seed)] for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["token", "slots"])

    keyed = settle(buckets.select(F.col("bucket").cast("string").alias("token"), "vec"), "pool-buckets")
    known = settle(words.mapInArrow(slots, "token string, slots array<string>"), "pool-words")
    known = known.withColumn("own", F.monotonically_increasing_id())
    held = explode_values(known, ["token", "own"], "slots", "slot").join(keyed.select(F.col("token").alias("slot")), "slot", "left_semi")
    known = settle(known.join(held.select("own").distinct(), "own", "left_semi").drop("own"), "pool-known")
    built = pooled(known, keyed, width, "slots", "vec", limit)
    full = vocab.select("token", F.col("vec").cast("array<double>").alias("vec")).unionByName(built.select("token", F.col("vec").cast("array<double>").alias("vec")))
    return pooled(rows, settle(full, "pool-vocabulary"), width, tokens, out, limit)
