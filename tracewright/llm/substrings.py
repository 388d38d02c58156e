"""Remove long repeated byte strings from documents, by sorting suffixes.

Sorting a suffix for every byte would move each text two hundred times. Instead
a window of 200 bytes is stood for by its anchor, the 40-byte string in it with
the least hash (a minimiser). Equal windows have equal anchors at equal places,
so only suffixes that begin at an anchor need sorting. Windows that follow each
other and share an anchor form one stretch; stretches that are equal in full
are told by a digest. The others, and one of each equal set, go with their text
to ranges of leading bytes cut by sampled splitters. A range sorts its suffixes,
and the texts in front of the anchors backwards, by multikey quicksort on
8-byte tokens, and common prefixes of neighbours say which windows are equal.
All suffixes with one beginning are in one range, so no match lies across a
boundary; a beginning with very many stretches is taken out and its windows
are compared by digest over the whole cluster.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Rolling, mix, slices, text_arrays
from tracewright.operators.joining import lookup_join
from tracewright.session import settle

WINDOW = 200
ANCHOR = 40
STARTS = WINDOW - ANCHOR + 1
# Stretches with one anchor that are sorted in one task; beyond it windows are compared by digest.
CROWD = 20_000
_PLACE = 24
_BASE2 = 0xD1B54A32D192ED03


def stretches(data: np.ndarray, offsets: np.ndarray):
    """For joined texts: row, first window, length, place of the anchor, anchor hash and two digests of every stretch."""
    parts, span = [], (1 << _PLACE) - 2 * WINDOW
    for shift in range(0, max(len(data) - WINDOW + 1, 0), span):
        parts.append(_stretches(data[shift:shift + span + WINDOW - 1], np.clip(offsets - shift, 0, None), shift))
    if not parts:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 3
    return [np.concatenate(x) for x in zip(*parts)]


def _stretches(data, offsets, shift):
    n = len(data)
    windows = n - WINDOW + 1
    offsets = np.minimum(offsets, n)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    lead = int(offsets[0])
    row = np.concatenate([np.full(lead, -1), row]) if lead else row
    valid = np.zeros(windows + 1, bool)
    valid[:windows] = row[:windows] == row[WINDOW - 1:WINDOW - 1 + windows]
    rolling = Rolling(data)
    gram = rolling.windows(ANCHOR)
    low = np.uint64((1 << _PLACE) - 1)
    v = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    blocks = -(-len(v) // STARTS) + 1
    padded = np.full(blocks * STARTS, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(v)] = v
    square = padded.reshape(blocks, STARTS)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:windows], ahead[STARTS - 1:STARTS - 1 + windows]) & low).astype(np.int64)
    edge = np.ones(windows + 1, bool)
    edge[1:windows] = place[1:] != place[:-1]
    edge[:windows] |= ~valid[:windows]
    edge[1:] |= ~valid[:-1]
    at = np.flatnonzero(edge)
    first = at[valid[at]]
    after = at[np.searchsorted(at, first, side="right")]
    end = after - 1 + WINDOW
    anchor = place[first]
    tag = ((end - first) << 20 | (anchor - first)).astype(np.uint64)
    one, two = mix(rolling.of(first, end) ^ tag), mix(Rolling(data, _BASE2).of(first, end) + tag)
    own = row[first]
    return own, first + shift, end - first, anchor - first, gram[anchor], one, two


def sort_tokens(words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows of 8-byte tokens: order, and the common prefix with the row before, in bytes.

    Rows that tie on a token are parted by the next one, all others are done.
    """
    n = len(words)
    order = np.argsort(words[:, 0], kind="stable")
    first = words[order, 0]
    new = np.concatenate(([True], first[1:] != first[:-1]))
    for j in range(1, words.shape[1] + 1):
        group = np.cumsum(new)
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            break
        key = words[:, j] if j < words.shape[1] else length
        rows = order[tied]
        by = np.lexsort((key[rows], group[tied]))
        order[tied] = rows = rows[by]
        differs = np.concatenate(([True], key[rows][1:] != key[rows][:-1])) | new[tied]
        if j < words.shape[1]:
            new[tied] |= differs
    same = np.zeros(n, np.int64)
    if n > 1:
        a, b = words[order[1:]], words[order[:-1]]
        unequal = a != b
        at = np.where(unequal.any(axis=1), unequal.argmax(axis=1), words.shape[1])
        k = np.minimum(at, words.shape[1] - 1)
        x = np.take_along_axis(a, k[:, None], 1)[:, 0] ^ np.take_along_axis(b, k[:, None], 1)[:, 0]
        bits = np.frexp((x >> np.uint64(32)).astype(np.float64))[1]
        bits = np.where(bits > 0, bits + 32, np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])
        same[1:] = np.minimum(np.where(at < words.shape[1], at * 8 + (64 - bits) // 8, at * 8), np.minimum(length[order[1:]], length[order[:-1]]))
    return order, same


def _tokens(pieces: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), ">u8").astype(np.uint64).reshape(len(pieces), width // 8)


def repeated_windows(texts: list[bytes], off: np.ndarray) -> np.ndarray:
    """For stretches with their anchor at ``off``: which windows (by bytes before the anchor, 0 to 160) occur in another stretch."""
    length = np.array([len(t) for t in texts])
    right = [t[o:o + WINDOW] for t, o in zip(texts, off.tolist())]
    left = [t[:o][::-1] for t, o in zip(texts, off.tolist())]
    found = np.zeros((len(texts), STARTS), bool)
    classes = []
    for side, width in ((left, -(-STARTS // 8) * 8), (right, WINDOW)):
        order, same = sort_tokens(_tokens(side, width), np.array([len(x) for x in side]))
        classes.append((order, same))
    ids = np.empty((2, len(texts)), np.int64)
    for d in range(STARTS):
        part = np.flatnonzero((off >= d) & (off - (length - WINDOW) <= d))
        if len(part) < 2:
            continue
        for i, depth in enumerate((d, WINDOW - d)):
            order, same = classes[i]
            ids[i, order] = np.cumsum(same < depth) if depth else 0
        _, inverse, count = np.unique(ids[0, part] * len(texts) * 2 + ids[1, part], return_inverse=True, return_counts=True)
        found[part, d] = count[inverse] > 1
    return found


def _spans(found: np.ndarray, rows: np.ndarray, anchor: np.ndarray):
    """Row, start and end of the bytes that runs of marked windows cover."""
    padded = np.zeros((len(found), STARTS + 2), np.int8)
    padded[:, 1:-1] = found
    step = np.diff(padded, axis=1)
    i, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return rows[i], anchor[i] - (high - 1), anchor[i] - low + WINDOW


SPAN = "row bigint, start bigint, stop bigint"


def _batch(names, *arrays):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)


def _decide(batches):
    """From stretches sorted by anchor and digest: spans of stretches that occur again in full (need -1), and for anchors
    with several different stretches one of each (need 1 if it occurs once, else 0).

    ``known`` is 1 for a stretch that stands for equal ones seen beside it, and
    2 for those, which pass through.
    """
    names = ["ah", "c1", "c2", "row", "start", "size", "off"]
    out = ["need", *names]
    held = None      # first row of the content that may go on: values, whether it was given out as repeated
    head = None      # the only content of an anchor so far: values and need
    several = None   # the anchor known to have several contents
    for batch in _and_end(batches):
        cols = [batch.column(c).to_numpy() for c in names] if batch is not None else [np.zeros(0, np.int64)] * 7
        known = batch.column("known").to_numpy() if batch is not None else np.zeros(0, np.int8)
        if (known == 2).any():
            yield _batch(out, np.full(int((known == 2).sum()), -1, np.int8), *[c[known == 2] for c in cols])
            cols, known = [c[known < 2] for c in cols], known[known < 2]
        given = False
        if held is not None:
            cols, known = [np.concatenate(([h], c)) for h, c in zip(held[0], cols)], np.concatenate(([0], known))
            given = held[1]
        n = len(cols[0])
        if not n:
            continue
        ah, c1, c2 = cols[:3]
        begin = np.flatnonzero(np.concatenate(([True], (ah[1:] != ah[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]))))
        count = np.diff(np.append(begin, n))
        again = (count > 1) | np.logical_or.reduceat(known == 1, begin)
        if given:
            again[0] = True
        rows = np.repeat(again, count)
        if given:
            rows[0] = False
        if rows.any():
            yield _batch(out, np.full(int(rows.sum()), -1, np.int8), *[c[rows] for c in cols])
        if batch is not None:
            last = begin[-1]
            held = [c[last] for c in cols], bool(again[-1])
            begin, again = begin[:-1], again[:-1]
        if not len(begin):
            continue
        reps, need = [c[begin] for c in cols], np.where(again, 0, 1).astype(np.int8)
        if head is not None:
            reps, need = [np.concatenate(([h], c)) for h, c in zip(head[0], reps)], np.concatenate(([head[1]], need))
        a = reps[0]
        first = np.concatenate(([True], a[1:] != a[:-1]))
        alone = first & np.concatenate((first[1:], [True]))
        if several is not None:
            alone &= a != several
        end = len(a) - 1
        several_last = not alone[end]
        head = ([c[end] for c in reps], need[end]) if alone[end] else None
        several = a[end] if several_last else None
        keep = ~alone
        if keep.any():
            yield _batch(out, need[keep], *[c[keep] for c in reps])


def _and_end(batches):
    yield from batches
    yield None


def _runs_of_two(batches):
    """From windows sorted by digest: those that occur at least twice."""
    names, held = ["h1", "h2", "row", "start"], None
    for batch in _and_end(batches):
        cols = [batch.column(c).to_numpy() for c in names] if batch is not None else [np.zeros(0, np.int64)] * 4
        given = False
        if held is not None:
            cols, given = [np.concatenate(([h], c)) for h, c in zip(held[0], cols)], held[1]
        n = len(cols[0])
        if not n:
            continue
        begin = np.flatnonzero(np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))))
        count = np.diff(np.append(begin, n))
        again = count > 1
        again[0] |= given
        rows = np.repeat(again, count)
        rows[0] &= not given
        if batch is not None:
            held = [c[begin[-1]] for c in cols], bool(again[-1])
        if rows.any():
            yield _batch(SPAN.replace(" bigint", "").split(", "), cols[2][rows], cols[3][rows], cols[3][rows] + WINDOW)


def repeated_spans(store: DataFrame) -> DataFrame:
    """(row, start, stop): byte spans that windows seen elsewhere cover, from (row, packed: zstd text, n_bytes); spans overlap."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1 << 18, "packed"):
                codec = pa.Codec("zstd")
                size = part.column("n_bytes").to_numpy()
                raw = [codec.decompress(p.as_buffer(), int(n), asbytes=True) if n else b"" for p, n in zip(part.column("packed"), size)]
                data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum(size)))
                own, first, length, off, ah, c1, c2 = stretches(data, offsets)
                if not len(own):
                    continue
                # Equal stretches of this piece: the first stands for them, the others go anywhere.
                order = np.lexsort((c2, c1, ah))
                same = (ah[order[1:]] == ah[order[:-1]]) & (c1[order[1:]] == c1[order[:-1]]) & (c2[order[1:]] == c2[order[:-1]])
                known = np.zeros(len(own), np.int8)
                known[order[:-1][same]] = 1
                known[order[1:][same]] = 2
                deal = np.where(known == 2, mix(ah + (first.astype(np.uint64) << np.uint64(20))), ah)
                yield _batch(["deal", "known", "ah", "c1", "c2", "row", "start", "size", "off"], deal.view(np.int64), known, ah.view(np.int64), c1.view(np.int64),
                             c2.view(np.int64), part.column("row").to_numpy()[own], (first - offsets[own]).astype(np.int64), length.astype(np.int64), off.astype(np.int64))

    kinds = "ah bigint, c1 bigint, c2 bigint, row bigint, start bigint, size bigint, off bigint"
    rows = store.select("row", "packed", "n_bytes").where(F.col("n_bytes") >= WINDOW).mapInArrow(cut, f"deal bigint, known tinyint, {kinds}")
    marked = settle(rows.repartition("deal").sortWithinPartitions("ah", "c1", "c2", "row", "start").mapInArrow(_decide, f"need tinyint, {kinds}"), "suffix-stretches")
    whole = marked.where("need = -1").select("row", "start", (F.col("start") + F.col("size")).alias("stop"))
    open_ = marked.where("need >= 0")
    crowds = settle(open_.groupBy("ah").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("ah", F.lit(True).alias("crowd")), "suffix-crowds")
    asked = lookup_join(open_, crowds, ["ah"], "left", row_bytes=24).groupBy("row").agg(
        F.collect_list(F.struct("need", "start", "size", "off", F.coalesce("crowd", F.lit(False)).alias("crowd"))).alias("asked"))

    def fetch(batches):
        import pyarrow as pa

        for batch in batches:
            codec, out, held = pa.Codec("zstd"), [], 0
            for row, packed, n, asked in zip(batch.column("row").to_pylist(), batch.column("packed"), batch.column("n_bytes").to_pylist(), batch.column("asked")):
                text = codec.decompress(packed.as_buffer(), n, asbytes=True)
                for a in asked.as_py():
                    piece = text[a["start"]:a["start"] + a["size"]]
                    out.append((row, a["need"], a["start"], a["off"], a["crowd"], piece[a["off"]:a["off"] + 16], piece))
                    held += len(piece)
                if held > 8 << 20:
                    yield _pack(out)
                    out, held = [], 0
            if out:
                yield _pack(out)

    kinds = "row bigint, need tinyint, start bigint, off bigint, crowd boolean, lead binary, text binary"
    texts = store.select("row", "packed", "n_bytes").join(asked, "row").mapInArrow(fetch, kinds)
    texts = settle(texts, "suffix-texts")
    sorted_spans = texts.where("not crowd").repartitionByRange("lead").mapInArrow(_sort_range, SPAN)

    def digests(batches):
        for batch in batches:
            for part in slices(batch, 1 << 20, "text"):
                pieces = part.column("text").to_pylist()
                data = np.frombuffer(b"".join(pieces), np.uint8)
                size = np.array([len(p) for p in pieces])
                count = size - WINDOW + 1
                begin = np.repeat(np.cumsum(size) - size, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = np.repeat(part.column("start").to_numpy(), count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                yield _batch(["h1", "h2", "row", "start"], Rolling(data).of(begin, begin + WINDOW).view(np.int64), Rolling(data, _BASE2).of(begin, begin + WINDOW).view(np.int64),
                             np.repeat(part.column("row").to_numpy(), count), start)

    spans = whole.unionByName(sorted_spans)
    if crowds.limit(1).count():
        windows = texts.where("crowd").select("row", "start", "text").mapInArrow(digests, "h1 bigint, h2 bigint, row bigint, start bigint")
        spans = spans.unionByName(windows.repartition("h1").sortWithinPartitions("h1", "h2").mapInArrow(_runs_of_two, SPAN))
    return spans


def _pack(rows: list):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["row", "need", "start", "off", "crowd", "lead", "text"])


def _sort_range(batches):
    """One range of leading bytes: sort, and give the spans of windows that occur again."""
    import pyarrow as pa

    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    texts, off = table.column("text").to_pylist(), table.column("off").to_numpy()
    found = repeated_windows(texts, off)
    found[table.column("need").to_numpy() == 0] = False
    rows, start, stop = _spans(found, table.column("row").to_numpy(), table.column("start").to_numpy() + off)
    yield _batch(["row", "start", "stop"], rows, start, stop)


def remove_repeats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text, ...; default doc_id) with n_bytes, spans (removed runs of bytes, start and stop) and
    kept (the remaining bytes).

    A byte goes if a string of 200 bytes that covers it also starts anywhere
    else, in the same text or another, as the input stands. Matches don't cross
    texts. Rows are told apart though all columns be equal, so of two equal
    rows both lose what is long enough.

    Null and empty texts, and those under 200 bytes, stay as they are (null as
    empty). Very long ones are cut into pieces that overlap by a window. An
    empty table gives an empty result. Other columns don't matter.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_arrays(batch.column("__text"))
            codec, view = pa.Codec("zstd", 3), memoryview(data)
            packed = [codec.compress(view[a:b], asbytes=True) if b > a else b"" for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(offsets)), pa.array(packed, pa.binary())], [*batch.schema.names[:-1], "n_bytes", "packed"])

    store = settle(rows.mapInArrow(pack, f"{fields}, n_bytes bigint, packed binary").withColumn("row", F.monotonically_increasing_id()), "suffix-store")
    spans = repeated_spans(store).groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("found"))

    def finish(batches):
        import pyarrow as pa

        run = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            codec, removed, rest = pa.Codec("zstd"), [], []
            for packed, n, found in zip(batch.column("packed"), batch.column("n_bytes").to_pylist(), batch.column("found").to_pylist()):
                text, merged, kept, at = codec.decompress(packed.as_buffer(), n, asbytes=True) if n else b"", [], [], 0
                for s in sorted((x["start"], x["stop"]) for x in found or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                for a, b in merged:
                    kept.append(text[at:a])
                    at = b
                removed.append([{"start": a, "stop": b} for a, b in merged])
                rest.append(b"".join([*kept, text[at:]]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], batch.column("n_bytes"), pa.array(removed, run), pa.array(rest, pa.binary())],
                                             [*keep, "n_bytes", "spans", "kept"])

    return store.join(spans, "row", "left").select(*[f"`{c}`" for c in keep], "n_bytes", "packed", "found").mapInArrow(
        finish, f"{fields}, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary")
