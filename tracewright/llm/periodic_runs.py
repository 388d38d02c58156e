"""Find stretches of words that repeat with a period, by string synchronising sets at dyadic scales."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import mix, slices, text_arrays, words_of

LEAST_LENGTH, LEAST_TIMES = 6, 4
# Periods below this are found by comparing the text with itself, shifted; from here on scale by scale.
SMALL = 8
SLICE = 1 << 20
CELLS = 1 << 20


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal stretch of true entries."""
    edge = np.diff(same.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _small(x: np.ndarray) -> list[np.ndarray]:
    """(start, end, period) of runs with a period below SMALL."""
    found = []
    for q in range(1, min(SMALL, len(x))):
        start, stop = _stretches(x[q:] == x[:-q])
        long = stop - start + q >= max(LEAST_LENGTH, LEAST_TIMES * q)
        start, stop = start[long], stop[long]
        for r in (r for r in range(1, q) if q % r == 0):  # a shorter period that divides q rules q out
            at = start[:, None] + np.arange(q)
            own = (x[at] != x[at + r]).any(axis=1)
            start, stop = start[own], stop[own]
        found.append(np.stack([start, stop + q, np.full(len(start), q)]))
    return found


def _least(ids: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` + 1 entries in a row; width is a power of two."""
    done = 1
    while done < width:
        ids = np.minimum(ids[:-done], ids[done:])
        done *= 2
    return np.minimum(ids[:-1], ids[1:])


def _extend(x: np.ndarray, at: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
    """Move each place on in direction ``step`` while the word there equals the one a period later."""
    at, alive, width = at.copy(), np.arange(len(at)), 16
    while len(alive):
        left = []
        for part in np.array_split(alive, max(1, len(alive) * width // CELLS)):
            here = at[part, None] + step * np.arange(width)
            there = here + period[part, None]
            inside = (here >= 0) & (there < len(x))
            same = inside & (x[np.where(inside, here, 0)] == x[np.where(inside, there, 0)])
            n = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
            at[part] += step * n
            left.append(part[n == width])
        alive = np.concatenate(left)
        width = min(2 * width, CELLS)
    return at


def synchronising(names: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """Places of the synchronising set at one scale.

    ``names`` tells the stretches of ``scale`` words apart, ``periodic`` marks
    those in a highly periodic region. A place belongs to the set if the least
    hash among the stretches that begin at it and up to ``scale`` behind it,
    periodic ones aside, is the first or the last of these. So equal contexts
    of 2 * ``scale`` words agree on whether they belong, and outside of highly
    periodic regions every ``scale`` places hold a member.
    """
    ids = mix(names.astype(np.uint64) + np.uint64(1))
    ids[periodic] = ~np.uint64(0)
    least = _least(ids, scale)
    n = len(least)
    return np.flatnonzero(((least == ids[:n]) & ~periodic[:n]) | ((least == ids[scale:scale + n]) & ~periodic[scale:scale + n]))


def _double(names: np.ndarray, width: int) -> np.ndarray:
    """Names of stretches twice as long: equal if and only if both halves are; stretches past the end are all different."""
    n = len(names)
    second = np.arange(n) + (1 << 31)
    second[:max(n - width, 0)] = names[width:]
    return np.unique((names.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), return_inverse=True)[1].astype(np.int64)


def runs_of(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run in ``x``, sorted by start and then period.

    ``x`` numbers words from 0 (equal words, equal numbers); at each place in ``edges`` (the first 0, the last the
    end) stands a number that occurs once, so that runs don't cross texts.
    """
    found = _small(x)
    at, names, width = np.arange(len(x)), x.astype(np.int64), 1
    ends, sizes = edges, np.diff(edges) - 1
    scale = SMALL
    while len(sizes) and sizes.max() >= LEAST_TIMES * scale:
        while width < scale:
            names, width = _double(names, width), 2 * width
        # Only texts that are long enough for a run of this scale go on.
        long = np.flatnonzero(sizes >= LEAST_TIMES * scale)
        if len(long) < len(sizes):
            stay = np.zeros(len(at) + 1, np.int64)
            stay[ends[long]] += 1
            stay[ends[long + 1]] -= 1
            stay = np.cumsum(stay[:-1]) > 0
            stay[-1] = True
            at, names, sizes = at[stay], names[stay], sizes[long]
            ends = np.concatenate([[0], np.cumsum(sizes + 1)])
        y = x[at]
        periodic = np.zeros(len(at) + 1, np.int64)
        start, stop, q = np.concatenate(found, axis=1)
        inside = (q * LEAST_TIMES <= scale) & (stop - start >= scale)
        place = np.searchsorted(at, start[inside])
        known = at[place] == start[inside]
        np.add.at(periodic, place[known], 1)
        np.add.at(periodic, place[known] + (stop - start)[inside][known] - scale + 1, -1)
        p = synchronising(names, scale, np.cumsum(periodic[:-1]) > 0)
        # Two neighbours of one context propose their distance as a period.
        context = _double(names, scale)
        order = np.argsort(context[p], kind="stable")
        p, same = p[order], context[p[order]]
        d = np.diff(p)
        good = (same[1:] == same[:-1]) & (d >= scale) & (d < 2 * scale)
        p, d = p[:-1][good], d[good]
        if len(p):
            order = np.lexsort((p, d))
            p, d = p[order], d[order]
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 2 * scale)]))
            first, last, d = p[new], np.append(p[new[1:] - 1], p[-1]) + 2 * scale, d[new]
            first, last = _extend(y, first - 1, d, -1) + 1, _extend(y, last, d, 1)
            runs = np.unique(np.stack([first, last + d, d]), axis=1)
            runs = runs[:, runs[1] - runs[0] >= np.maximum(LEAST_LENGTH, LEAST_TIMES * runs[2])]
            found.append(np.stack([at[runs[0]], at[runs[0]] + runs[1] - runs[0], runs[2]]))
        names, width = context, 2 * scale
        scale *= 2
    start, stop, q = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((q, start))
    return start[order], stop[order], q[order]


def word_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for every word, equal for equal words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    solid = np.zeros(len(data) + 1, np.int8)
    solid[start] += 1
    solid[end] -= 1
    letters = np.ascontiguousarray(data[np.cumsum(solid[:-1]) > 0])
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return pc.dictionary_encode(words).indices.to_numpy().astype(np.int64)


def _texts(column):
    """Per text of an Arrow column: number of words, runs (three arrays), first run of each text, and the collapsed bytes."""
    data, offsets = text_arrays(column)
    begin, end, first = words_of(data, offsets)
    count = np.diff(first)
    edges = first + np.arange(len(first))
    x = np.empty(first[-1] + len(first), np.int64)
    words = np.ones(len(x), bool)
    words[edges] = False
    numbers = word_numbers(data, begin, end) if len(begin) else np.zeros(0, np.int64)
    x[words] = numbers
    x[edges] = len(begin) + np.arange(len(edges))
    start, stop, q = runs_of(x, edges)
    owner = np.searchsorted(edges, start, "right") - 1
    gone = np.zeros(len(x) + 1, np.int64)
    np.add.at(gone, start + q, 1)
    np.add.at(gone, stop, -1)
    gone = (np.cumsum(gone[:-1]) > 0)[words]
    some = np.unique(owner)
    view = data.tobytes()
    kept = [b" ".join(view[a:b].split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    for i in some.tolist():
        stay = np.flatnonzero(~gone[first[i]:first[i + 1]]) + first[i]
        kept[i] = b" ".join([view[a:b] for a, b in zip(begin[stay].tolist(), end[stay].tolist())])
    place = np.searchsorted(owner, np.arange(len(count) + 1))
    return count, start - edges[owner] - 1, stop - start, q, place, kept


def find_runs(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text, ...; default doc_id) with n_words, runs (start, length, period; by start, then period) and collapsed.

    Words are runs of anything but ASCII white space, numbered from 0. A run is
    a stretch with smallest period q, at least 6 words and 4 periods long, that
    can't be made longer on either side. ``collapsed`` holds the words, joined
    by one space, without those that some run contains after its first period.

    A period of 8 and more is found at the scale t with t <= q < 2t: within
    the first t words of a run lies a member of the synchronising set, its
    context of 2t words returns one period later, and no sooner. Proposals are
    compared word by word. Stretches of a scale's length that lie in runs of a
    quarter of that period are left out of the set; these runs are known from
    smaller scales, the smallest from shifted comparison.

    A task works on its texts alone, nothing is shuffled; memory grows with
    the longest text (about 100 bytes a word). Null and empty texts have no
    words, no runs and an empty ``collapsed``. Repeated rows each get their row,
    an empty table gives an empty result, other columns don't matter.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, SLICE, "__text"):
                count, start, length, q, place, kept = _texts(part.column(part.num_columns - 1))
                items = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(q)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(count, pa.int64()), pa.ListArray.from_arrays(pa.array(place, pa.int32()), items), pa.array(kept, pa.binary()).cast(pa.string())],
                    [*part.schema.names[:-1], "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"{fields}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
