"""Pack token ids into sequences of one length: concatenate all texts and cut."""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import IS_SPACE, slices, text_arrays
from tracewright.operators.joining import lookup_join
from tracewright.session import settle

LENGTH = 2048
END = 1
SLICE = 2 << 20
# Chunks of text whose ids a worker remembers, twice: those used of late, and the ones before.
KNOWN = 100_000
# So many partitions have their offsets added up in one group.
PARTS = 1024


_ALNUM = np.zeros(256, bool)
_ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_BEFORE_WORD = _SIGN.copy()
_BEFORE_WORD[ord("'")] = False  # 's, 't and so on are pieces
# First bytes of chunks: white space, or of characters that aren't.
_FIRST = IS_SPACE.copy()
_FIRST[0x21:0x7F] = _FIRST[0xC3:0xE0] = _FIRST[0xE4:0xF5] = True


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where texts can be cut without a change of ids: begins of texts, white space behind a character that isn't,
    and between ASCII letters or digits and other ASCII signs.

    The pre-tokenizer never lets a piece go on across such a place, and none
    looks back. Behind a character that might be white space beyond ASCII
    (lead bytes C2, E1, E2, E3) no cut is made, nor between an apostrophe and a letter.
    """
    solid = (data > 0x20) & (data < 0x7F)
    if len(data) > 2:
        solid[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        solid[2:] |= (data[:-2] >= 0xE4) & (data[:-2] <= 0xEF)
    cut = IS_SPACE[data]
    cut[0:1] = True
    cut[1:] &= solid[:-1]
    cut[1:] |= (_ALNUM[data[:-1]] & _SIGN[data[1:]]) | (_BEFORE_WORD[data[:-1]] & _ALNUM[data[1:]])
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Token ids of many texts; a chunk between two cuts goes through the tokenizer when it isn't remembered."""

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # A token of a byte-level vocabulary is written with one character a byte.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        # Ids are kept in two bytes where they fit.
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of different chunks. Those that end in a visible ASCII character and don't begin with one that might be white
        space beyond ASCII go through the tokenizer in one text.

        There, a line end is put before chunks that don't begin with white
        space; it is a piece, and a token, of its own.
        """
        out: list[bytes] = []
        for a in range(0, len(chunks), 1 << 14):
            some = chunks[a:a + (1 << 14)]
            joined = np.frombuffer(b"".join(some), np.uint8)
            size = np.fromiter(map(len, some), np.int64, len(some))
            upto = np.cumsum(size)
            head, tail = joined[upto - size], joined[upto - 1]
            plain = (tail > 0x20) & (tail < 0x7F) & _FIRST[head]
            found = self._plain(joined[np.repeat(plain, size)], size[plain], ~IS_SPACE[head[plain]])
            odd = self.tokenizer.encode_batch_fast([some[i].decode() for i in np.flatnonzero(~plain).tolist()], add_special_tokens=False)
            one, other = iter(found), iter(odd)
            out += [next(one) if p else array("I", next(other).ids).tobytes() for p in plain.tolist()]
        return out

    def _plain(self, data: np.ndarray, size: np.ndarray, lead: np.ndarray) -> list[bytes]:
        """The ids of joined chunks; where ``lead`` holds, a line end goes before the chunk."""
        upto = np.cumsum(size)
        text = np.insert(data, (upto - size)[lead], 0x0A).tobytes().decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        last = np.searchsorted(np.cumsum(self.bytes[ids]), upto + np.cumsum(lead)) + 1
        first = np.concatenate([[0], last[:-1]]) + lead if len(size) else last
        raw = ids.tobytes()
        return [raw[x:y] for x, y in zip((4 * first).tolist(), (4 * last).tolist())]

    def look_up(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk, 32 bits each."""
        if len(self.known) > KNOWN:
            self.known, self.before = {}, self.known
        known = self.known
        out = list(map(known.get, chunks))
        missing = [i for i, e in enumerate(out) if e is None]
        old = list(map(self.before.get, [chunks[i] for i in missing]))
        new = [i for i, e in zip(missing, old) if e is None]
        for places, found in ((missing, old), (new, self.encode([chunks[i] for i in new]))):
            for i, e in zip(places, found):
                out[i] = e
                if e is not None:
                    known[chunks[i]] = e
        return out

    def ids(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by ``end``, and the n + 1 offsets of the texts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        starts = chunk_starts(data, offsets)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pc.dictionary_encode(chunks)
        which, parts = coded.indices.to_numpy(), self.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, begin = np.frombuffer(b"".join(parts), np.uint32), np.cumsum(sizes) - sizes
        n = sizes[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        edges = upto[np.searchsorted(starts, offsets)]
        kind = np.int32 if max(upto[-1], len(flat)) < 1 << 31 else np.int64
        at = np.repeat((begin[which] - upto[:-1]).astype(kind), n)
        at += np.arange(upto[-1], dtype=kind)
        return np.insert(flat[at], edges[1:], np.uint32(end)), edges + np.arange(len(edges))


_ENCODER: list = []


def encoder_of(definition: str) -> Encoder:
    """The encoder of a worker; only the last definition's is kept."""
    if not _ENCODER or _ENCODER[0] != definition:
        _ENCODER[:] = [definition, Encoder(definition)]
    return _ENCODER[1]


def binary(data: np.ndarray, offsets: np.ndarray):
    """An Arrow binary column of stretches of ``data``, given by n + 1 places in bytes; nothing is copied."""
    import pyarrow as pa

    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def binary_bytes(column) -> tuple[memoryview, np.ndarray]:
    """The bytes of an Arrow binary column, and the n + 1 places of its values there."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    return memoryview(data if data is not None else b""), places


def tokenise(docs: DataFrame, definition: str, keep: list[str], end: int = END) -> DataFrame:
    """The columns ``keep`` with ids (those of the text, then ``end``; 16 or 32 bits each, little-endian, in one binary value, which
    Spark passes on as it is), their number, and place: partition and ids before in it."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.shiftright(F.monotonically_increasing_id(), 33).cast("int").alias("__part"),
                       F.col("text").cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        import pyarrow as pa

        encoder, before = None, 0
        for batch in batches:
            encoder = encoder or encoder_of(shared.value)
            for part in slices(batch, SLICE, "__text"):
                ids, edges = encoder.ids(*text_arrays(part.column(part.num_columns - 1)), end)
                kind = encoder.kind if end < 1 << 16 else np.dtype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(before + edges[:-1]), pa.array(np.diff(edges)), binary(ids.astype(kind, copy=False), kind.itemsize * edges)],
                    [*part.schema.names[:-1], "__before", "__n", "__ids"])
                before += int(edges[-1])

    found = settle(rows.mapInArrow(run, f"{fields}, __before bigint, __n bigint, __ids binary"), "packing-ids")
    shared.destroy()
    return found


def part_offsets(tokens: DataFrame) -> DataFrame:
    """Ids in all partitions before each: sums inside groups of partitions, then over the groups."""
    sums = tokens.groupBy("__part").agg(F.sum("__n").alias("n")).withColumn("group", F.expr(f"__part div {PARTS}"))
    inside = Window.partitionBy("group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("group").agg(F.sum("n").alias("all")).select("group", F.coalesce(F.sum("all").over(across), F.lit(0)).alias("first"))
    return sums.withColumn("n", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(groups, "group").select("__part", (F.col("n") + F.col("first")).alias("__offset"))


def pack(docs: DataFrame, definition: str, keep: list[str] | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece of a text of ``docs`` (text, ...): the columns ``keep`` (default doc_id), doc_tokens, start (ids of the text before
    the piece), length, sequence_id, offset (in the sequence) and ids (binary, little-endian, 32 bits each).

    ``definition`` is the JSON of a byte-level tokenizer. Texts follow each
    other in the order in which the table is read, each closed by id ``end``;
    every ``length`` ids are a sequence, so only the last can be shorter. The
    first pass writes the ids and their number before in the partition, the
    second adds the total of all partitions before and cuts. No row is
    shuffled; only one sum per partition travels.

    Null and empty texts have the closing id alone, texts of any length are cut
    as often as needed, repeated rows are packed each for itself, an empty
    table gives no row, other columns don't matter. Another split of the input
    gives another order, with the same texts and lengths.
    """
    keep = ["doc_id"] if keep is None else keep
    tokens = tokenise(docs, definition, keep, end)
    placed = lookup_join(tokens, part_offsets(tokens), ["__part"], "inner", row_bytes=32)
    placed = placed.select(*[F.col(f"`{c}`") for c in keep], F.col("__n").alias("__doc_tokens"), (F.col("__before") + F.col("__offset")).alias("__first"), "__ids")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in placed.schema.fields[:-3])
    own = len(keep)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            first, n = batch.column(own + 1).to_numpy(), batch.column(own).to_numpy()
            pieces = (first + n - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + first[row] // length
            begin = np.maximum(first[row], sequence * length)
            stop = np.minimum((first + n)[row], (sequence + 1) * length)
            data, offsets = binary_bytes(batch.column(own + 2))
            size = int(offsets[-1] - offsets[0]) // max(int(n.sum()), 1)  # bytes of an id
            raw = memoryview(np.frombuffer(data, f"<u{size or 4}", int(n.sum()), int(offsets[0])).astype("<u4", copy=False)).cast("B")
            upto = (np.cumsum(n) - n)[row] + begin - first[row]
            values = n[row], begin - first[row], stop - begin, sequence, begin % length
            for a in range(0, len(row), 4096):  # the ids of a batch leave in bounded batches
                b = min(a + 4096, len(row))
                packed = [raw[4 * i:4 * (i + k)].tobytes() for i, k in zip(upto[a:b].tolist(), (stop - begin)[a:b].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(row[a:b])) for c in batch.columns[:own]], *[pa.array(v[a:b]) for v in values], pa.array(packed, pa.binary())],
                    [*batch.schema.names[:own], "doc_tokens", "start", "length", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(cut, f"{fields}doc_tokens bigint, start bigint, length bigint, sequence_id bigint, offset bigint, ids binary")


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """The sequences of packed pieces: sequence_id, ids (binary), lengths (of its pieces, in order).

    A task puts together the sequences that it holds in full. Only boundary
    records, pieces of sequences that two tasks share (or of the last, shorter
    one), are shuffled: a few thousand ids for each end of a partition.
    """
    rows = pieces.select("sequence_id", "offset", "length", "ids").sortWithinPartitions("sequence_id", "offset")

    def run(batches):
        import pyarrow as pa

        def out(records):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in records], pa.int64()), pa.array([r[1] for r in records], pa.int64()),
                                               pa.array([r[2] for r in records], pa.list_(pa.int64())), pa.array([r[3] for r in records], pa.binary()),
                                               pa.array([sum(r[2]) == length for r in records])], ["sequence_id", "offset", "lengths", "ids", "whole"])

        def close(held):
            if sum(h[2] for h in held) == length:
                return [(held[0][0], 0, [h[2] for h in held], b"".join(h[3] for h in held))]
            return [(s, o, [n], ids) for s, o, n, ids in held]

        held = []
        for batch in batches:
            done = []
            for record in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[0][0] != record[0]:
                    done += close(held)
                    held = []
                held.append(record)
            if done:
                yield out(done)
        if held:
            yield out(close(held))

    found = settle(rows.mapInArrow(run, "sequence_id bigint, offset bigint, lengths array<bigint>, ids binary, whole boolean"), "packed-sequences")
    shared = found.where(~F.col("whole")).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "lengths", "ids"))).alias("p"))
    shared = shared.select("sequence_id", F.aggregate("p", F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids"), F.flatten("p.lengths").alias("lengths"))
    return found.where("whole").select("sequence_id", "ids", "lengths").unionByName(shared)
