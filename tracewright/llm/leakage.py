"""Benchmark decontamination: latent semantic search for benchmark items in documents, then word by word checks.

Documents are written once as sequences of benchmark words. Their passages (32
words, every 16) make a TF-IDF matrix over all documents; a randomised
singular value decomposition, with one small sum per task, gives a latent
space. Every passage is compared there with every item of a block by cosine;
items of 16 words and fewer also with passages of their own size. Beside that,
every place is looked up among the word sequences of the items, so whole copies
don't depend on the cosine. Candidates are checked by the longest common
subsequence of item and document and by the item's telling words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import LOWER, Rolling, columns, released, slices, text_arrays
from tracewright.session import settle

UNIT = 16
PART = 64


@dataclass(frozen=True)
class Settings:
    """rank: of the decomposition; cosine: least similarity of a candidate, times the root of the share of a passage that the
    item's words can fill; share: of an item's words that must be found in
    order; telling: share of its rarest words that must be found; near: share of an item's words, of 24 at most, that a candidate
    passage must have in any order before it is checked; items: items per block; least: shorter items (in
    words) are never reported, those under 8 words only if found whole."""
    rank: int = 96
    cosine: float = 0.5
    share: float = 0.7
    telling: float = 0.5
    near: float = 0.45
    items: int = 1024
    least: int = 3


_SPLIT = np.ones(256, bool)
_SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows and the first word of each row (n + 1 numbers).

    Words are runs of ASCII letters, digits and bytes beyond ASCII; A-Z and the
    letters of Latin-1 in lower case.
    """
    low = LOWER[data]
    lead = np.flatnonzero(low[:-1] == 0xC3) + 1
    lead = lead[(low[lead] >= 0x80) & (low[lead] <= 0x9E) & (low[lead] != 0x97)]
    low[lead] += 0x20
    solid = ~_SPLIT[low]
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], solid[:-1])) & ~cut[:-1]
    after = np.concatenate((solid[1:], [False])) & ~cut[1:]
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return Rolling(low).of(start, end), np.searchsorted(start, offsets)


class Vocabulary:
    """Words of a block of items as sorted hashes; a bit map in front rules most other words out."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.hashes >> np.uint64(44)] = True

    def __len__(self):
        return len(self.hashes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of every hash, -1 for others."""
        out = np.full(len(h), -1, np.int32)
        maybe = np.flatnonzero(self.bits[h >> np.uint64(44)])
        at = np.searchsorted(self.hashes, h[maybe])
        at[at == len(self.hashes)] = 0
        out[maybe] = np.where(self.hashes[at] == h[maybe], at, -1)
        return out


@dataclass
class Items:
    """Parts (up to 64 words) of the items of a block and their passages."""
    ids: list = field(default_factory=list)      # item id of each part
    words: list = field(default_factory=list)    # word places of each part
    part: list = field(default_factory=list)     # part of each passage
    offset: list = field(default_factory=list)   # first word of each passage in its part


def block_items(rows: list) -> tuple[Vocabulary, Items]:
    import pyarrow as pa

    h, first = word_hashes(*text_arrays(pa.array([r[1] for r in rows], pa.string())))
    vocabulary, items = Vocabulary(h), Items()
    places = vocabulary.find(h)
    for (item, _), a, b in zip(rows, first[:-1], first[1:]):
        parts = max(1, -(-(b - a) // PART))
        for p in range(parts):
            words = places[a + (b - a) * p // parts:a + (b - a) * (p + 1) // parts]
            if len(words):
                for offset in range(0, max(1, len(words) - UNIT), UNIT):
                    items.part.append(len(items.ids))
                    items.offset.append(offset)
                items.ids.append(item)
                items.words.append(words)
    return vocabulary, items


def _starts(first: np.ndarray, unit: int) -> np.ndarray:
    """The first unit of each document (n + 1)."""
    return np.concatenate(([0], np.cumsum(-(-np.diff(first) // unit))))


def _units(tokens: list[bytes], kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word places of several documents, the first word of each (n + 1), and the first unit of each (n + 1)."""
    flat = np.frombuffer(b"".join(tokens), kind).astype(np.int32)
    first = np.concatenate(([0], np.cumsum([len(t) // np.dtype(kind).itemsize for t in tokens])))
    return flat, first, _starts(first, UNIT)


def _run_sums(rows: np.ndarray, at: np.ndarray, begin: np.ndarray, most: int = 32) -> np.ndarray:
    """Sums of ``rows[at]`` over the runs of ``at`` that start at ``begin``: the j-th entries of all runs are added at once.

    A run of more than ``most`` entries is added up in stretches first.
    """
    size = np.diff(np.append(begin, len(at)))
    if size.max(initial=0) > most:
        parts = -(-size // most)
        upto = np.cumsum(parts)
        nth = np.arange(upto[-1]) - np.repeat(upto - parts, parts)
        part = _run_sums(rows, at, np.repeat(begin, parts) + nth * most, most)
        return _run_sums(part, np.arange(len(part)), upto - parts, most)
    order = np.argsort(-size, kind="stable")  # longer runs first, so those with a j-th entry are in front
    first, out = begin[order], rows[at[begin[order]]]
    longer = len(size) - np.cumsum(np.bincount(size, minlength=1))
    for j in range(1, len(longer) - 1):
        out[:longer[j]] += rows[at[first[:longer[j]] + j]]
    back = np.empty_like(out)
    back[order] = out
    return back


def _sums(flat, first, units, table, size=UNIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row sums of ``table`` over the known words of each unit, and the known words with their units."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    unit = units[row] + (np.arange(len(flat)) - first[row]) // size
    known = flat >= 0
    word, unit = flat[known], unit[known]
    out = np.zeros((units[-1], table.shape[1]), np.float32)
    if len(word):
        begin = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        out[unit[begin]] = _run_sums(table, word, begin)
    return out, word, unit


def _passages(sums: np.ndarray, units: np.ndarray) -> np.ndarray:
    """A passage is a unit and the next one of the same document."""
    out = sums.copy()
    joined = np.ones(len(sums), bool)
    joined[units[1:][units[1:] > units[:-1]] - 1] = False
    out[:-1][joined[:-1]] += sums[1:][joined[:-1]]
    return out


def _pieces(batch, kind, most=60_000):
    """Rows of a batch in runs of about ``most`` words: doc rows a to b and their arrays."""
    tokens = batch.column("tokens").to_pylist()
    size = np.cumsum([len(t) // np.dtype(kind).itemsize for t in tokens]) // most
    edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(tokens)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield a, b, *_units(tokens[a:b], kind)


def _tokens(docs: DataFrame, keep: list[str], vocabulary: Vocabulary, kind) -> DataFrame:
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, column="__text"):
                h, first = word_hashes(*text_arrays(part.column("__text")))
                places = shared.value.find(h).astype(kind)
                out = pa.array([places[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], out], [*part.schema.names[:-1], "tokens"])

    found = settle(rows.mapInArrow(released(run), f"{fields}, tokens binary"), "leak-tokens")
    shared.destroy()
    return found


def _weights(tokens: DataFrame, words: int, kind) -> np.ndarray:
    """Inverse document frequency of the words, from all units of all documents."""

    def run(batches):
        import pyarrow as pa

        count, n = np.zeros(words, np.int64), 0
        for batch in batches:
            for _, _, flat, first, units in _pieces(batch, kind):
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                unit = units[row] + (np.arange(len(flat)) - first[row]) // UNIT
                known = flat >= 0
                pair = np.unique(unit[known].astype(np.int64) * words + flat[known])
                count += np.bincount(pair % words, minlength=words)
                n += units[-1]
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(count[at], n))], ["word", "n"])

    found = {r["word"]: r["n"] for r in tokens.select("tokens").mapInArrow(released(run), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n, df = found.pop(-1, 0), np.zeros(words)
    if found:
        df[list(found)] = list(found.values())
    return np.log((1 + n) / (1 + df)) + 1


def _latent(tokens: DataFrame, items: Items, idf: np.ndarray, kind, rank: int) -> np.ndarray:
    """Right singular vectors of the passages, words x rank, times idf.

    With A the passages (rows of unit length) and a random matrix O, tasks add
    up their part of A'(A O), and an orthogonal basis of the sum spans the leading
    singular vectors. Passages of the items enter with the weight that gives
    them as much mass as all documents.
    """
    words = len(idf)
    start = (np.random.default_rng(29).normal(size=(words, rank)) * idf[:, None]).astype(np.float32)
    squares = (idf ** 2).astype(np.float32)[:, None]
    shared = tokens.sparkSession.sparkContext.broadcast((np.concatenate([start, squares], 1), idf.astype(np.float32)))
    chunk = 256

    def add(total, flat, first, units, table, weight):
        sums, word, unit = _sums(flat, first, units, table)
        full = _passages(sums, units)
        y = full[:, :-1] / np.maximum(full[:, -1:], 1e-9)  # projected, and scaled by the row's length twice
        back = y.copy()
        inner = np.ones(len(y), bool)
        inner[units[:-1][units[1:] > units[:-1]]] = False
        back[1:][inner[1:]] += y[:-1][inner[1:]]  # a unit is in its own passage and the one before
        order = np.argsort(word, kind="stable")
        word, unit = word[order], unit[order]
        if len(word):
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            total[word[begin]] += weight[word[begin]][:, None] * _run_sums(back, unit, begin)
        return int(units[-1])

    def run(batches):
        import pyarrow as pa

        table, weight = shared.value
        total, n = np.zeros((words, rank), np.float32), 0
        for batch in batches:
            for _, _, flat, first, units in _pieces(batch, kind):
                n += add(total, flat, first, units, table, weight)
        if n:
            places = list(range(0, words, chunk))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([total[p:p + chunk].tobytes() for p in places], pa.binary()),
                                              pa.array([n] * len(places), pa.int64())], ["place", "sums", "n"])

    def join(table):
        import pyarrow as pa

        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("sums").to_pylist())
        return pa.table({"place": table.column("place")[:1], "sums": pa.array([total.tobytes()], pa.binary()),
                         "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})

    kinds = "place int, sums binary, n bigint"
    found = tokens.select("tokens").mapInArrow(released(run), kinds).groupBy("place").applyInArrow(join, kinds).collect()
    sketch = np.zeros((words, rank))
    for r in found:
        part = np.frombuffer(r["sums"]).reshape(-1, rank)
        sketch[r["place"]:r["place"] + len(part)] = part
    flat, first, units = _units([w.astype(np.int32).tobytes() for w in items.words], np.int32)
    own = np.zeros((words, rank), np.float32)
    own_n = add(own, flat, first, units, *shared.value)
    shared.destroy()
    sketch += own * (max(found[0]["n"] if found else 0, 1) / max(own_n, 1))
    basis, size, _ = np.linalg.svd(sketch, full_matrices=False)
    return (basis[:, size > 1e-9 * max(size.max(), 1e-30)] * idf[:, None]).astype(np.float32)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


class Checker:
    """Longest common subsequences of many (part, stretch of words) at once, one bit per word of a part."""

    def __init__(self, items: Items, idf: np.ndarray, s: Settings):
        self.words, self.s = len(idf), s
        self.length = np.array([len(w) for w in items.words])
        key, mask = [], []
        self.telling = np.zeros(len(items.words), np.uint64)
        for p, w in enumerate(items.words):
            for i, x in enumerate(w.tolist()):
                key.append(p * self.words + x)
                mask.append(1 << i)
            rare = np.argsort(-idf[w], kind="stable")[:max(1, len(w) // 4)]
            self.telling[p] = sum(1 << int(i) for i in rare)
        order = np.argsort(key, kind="stable")
        key, mask = np.array(key, np.int64)[order], np.array(mask, np.uint64)[order]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        self.key, self.mask = key[begin], np.bitwise_or.reduceat(mask, begin)
        self.dense = self.held = None

    def spread(self) -> None:
        """Same answers, looked up faster; made in the task, so that it doesn't travel."""
        if self.dense is None and len(self.length) * self.words <= 1 << 22:
            self.dense = np.zeros(len(self.length) * self.words, np.uint64)
            self.dense[self.key] = self.mask
            self.held = self.dense != 0

    def masks(self, part, word):
        key = part.astype(np.int64) * self.words + word
        if self.dense is not None:
            return np.where(word >= 0, self.dense[np.where(word >= 0, key, 0)], np.uint64(0))
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((word >= 0) & (self.key[at] == key), self.mask[at], np.uint64(0))

    def near(self, part, flat, begin, end, width=2 * UNIT):
        """Whether enough words of a passage (from ``begin``, ``width`` at most, up to ``end``) are in the part at all."""
        count = np.zeros(len(part), np.int32)
        base = part.astype(np.int64) * self.words
        for t in range(width):
            at = begin + t
            word = np.where(at < end, flat[np.minimum(at, len(flat) - 1)], -1)
            if self.held is not None:
                count += self.held[base + np.maximum(word, 0)] & (word >= 0)
            else:
                count += self.masks(part, word) != 0
        return count >= self.s.near * np.minimum(self.length[part], 24)

    def common(self, part, flat, begin, end):
        """Length of the common subsequence, and the share of telling words seen."""
        v = np.full(len(part), 0xFFFFFFFFFFFFFFFF, np.uint64)
        seen = np.zeros(len(part), np.uint64)
        for t in range(int((end - begin).max())):
            at = begin + t
            m = self.masks(part, np.where(at < end, flat[np.minimum(at, len(flat) - 1)], -1))
            u = v & m
            v = (v + u) | (v - u)
            seen |= m
        telling = self.telling[part]
        return np.bitwise_count(~v).astype(np.int64), np.bitwise_count(seen & telling) / np.bitwise_count(telling)

    def passes(self, part, found, told):
        n = self.length[part]
        need = np.where(n < 8, n, np.ceil(self.s.share * n))
        return (n >= self.s.least) & (found >= need) & (told >= self.s.telling)


class Sequences:
    """The word sequences of all parts that can be reported, by hash."""

    def __init__(self, items: Items, least: int):
        flat, first, _ = _units([w.astype(np.int32).tobytes() for w in items.words], np.int32)
        rolling, size = Rolling(flat + 1), np.diff(first)
        part = np.flatnonzero(size >= least)
        self.sizes = np.unique(size[part])
        self.head = int(min(self.sizes.min(initial=8), 8))
        self.heads = Vocabulary(rolling.of(first[part], first[part] + self.head))
        whole = rolling.of(first[part], first[part + 1])
        self.whole = Vocabulary(whole)
        place = self.whole.find(whole)
        order = np.argsort(place, kind="stable")
        self.parts, self.first = part[order], np.searchsorted(place[order], np.arange(len(self.whole) + 1))

    def find(self, flat, first) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, part and place of the sequences found, each once a document."""
        none = np.zeros(0, np.int64)
        if not len(self.sizes):
            return none, none, none
        rolling = Rolling(flat + 1)
        at = np.flatnonzero(self.heads.find(rolling.windows(self.head)) >= 0)
        row = np.searchsorted(first, at, side="right") - 1
        rows, which, places = [none], [none], [none]
        for size in self.sizes.tolist():
            fits = at + size <= first[row + 1]
            x, y = at[fits], row[fits]
            found = self.whole.find(rolling.of(x, x + size))
            x, y, found = x[found >= 0], y[found >= 0], found[found >= 0].astype(np.int64)
            _, one = np.unique(y * len(self.whole) + found, return_index=True)
            rows.append(y[one]), which.append(found[one]), places.append(x[one])
        row, which, place = np.concatenate(rows), np.concatenate(which), np.concatenate(places)
        copies = self.first[which + 1] - self.first[which]
        nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        return np.repeat(row, copies), self.parts[np.repeat(self.first[which], copies) + nth], np.repeat(place, copies)


def _targets(items: Items, latent: np.ndarray, s: Settings) -> list:
    """(unit, directions, least cosine, part, offset) of the items' passages, for each size of passage.

    An item of n words can't fill more than about n of the w words of a passage, so the cosine asked for is scaled by the root of n / w.
    """
    flat, first, units = _units([w.astype(np.int32).tobytes() for w in items.words], np.int32)
    part, offset, size = np.array(items.part), np.array(items.offset), np.diff(first)
    both = _passages(_sums(flat, first, units, latent)[0], units)[units[part] + offset // UNIT]
    bar = lambda n, unit: (s.cosine * np.sqrt(np.minimum(n / (2 * unit), 1))).astype(np.float32)
    out = [(UNIT, _unit_rows(both).T.copy(), bar(size[part] - offset, UNIT), part, offset)]
    unit = UNIT // 2
    while unit:
        part = np.flatnonzero((size > unit) & (size <= 2 * unit) & (size >= s.least))
        if len(part):
            units = _starts(first, unit)
            both = _passages(_sums(flat, first, units, latent, unit)[0], units)[units[part]]
            out.append((unit, _unit_rows(both).T.copy(), bar(size[part], unit), part, np.zeros(len(part), np.int64)))
        unit //= 2
    return out


def _search(tokens: DataFrame, keep: list[str], items: Items, idf, latent, kind, item_type: str, s: Settings) -> DataFrame:
    shared = tokens.sparkSession.sparkContext.broadcast((latent, _targets(items, latent, s), Sequences(items, s.least), items.ids, Checker(items, idf, s)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields[:-1])

    def run(batches):
        import pyarrow as pa

        latent, targets, sequences, ids, checker = shared.value
        checker.spread()
        for batch in batches:
            for a, b, flat, first, units in _pieces(batch, kind):
                if not len(flat):
                    continue
                row, part, begin = sequences.find(flat, first)
                begin = begin.astype(np.int64)
                checks = [np.stack([row, part, begin, begin + checker.length[part]], 1)]
                for unit, goals, bar, parts, offsets in targets:
                    units = _starts(first, unit)
                    passages = _unit_rows(_passages(_sums(flat, first, units, latent, unit)[0], units))
                    for i in range(0, len(passages), 2048):
                        x, y = np.nonzero(passages[i:i + 2048] @ goals >= bar)
                        x += i
                        row = np.searchsorted(units, x, side="right") - 1
                        near = checker.near(parts[y], flat, first[row] + (x - units[row]) * unit, first[row + 1], 2 * unit)
                        x, y, row = x[near], y[near], row[near]
                        part = parts[y]
                        back = unit if unit == UNIT else 2 * unit
                        begin = first[row] + np.maximum((x - units[row]) * unit - back - offsets[y], 0)
                        end = np.minimum(begin + checker.length[part] + 3 * UNIT, first[row + 1])
                        checks.append(np.stack([row, part, begin, end], 1))
                # Candidates of one part with one beginning are one check.
                row, part, begin, end = np.unique(np.concatenate(checks), axis=0).T
                if not len(row):
                    continue
                found, told = checker.common(part, flat, begin, end)
                good = checker.passes(part, found, told)
                best = {}
                for r, p, n in zip(row[good].tolist(), part[good].tolist(), found[good].tolist()):
                    old = best.get((r, ids[p]))
                    if old is None or n * old[1] > old[0] * int(checker.length[p]):
                        best[r, ids[p]] = n, int(checker.length[p])
                if best:
                    rows = pa.array([a + r for r, _ in best])
                    yield pa.RecordBatch.from_arrays([
                        *[batch.column(c).take(rows) for c in keep], pa.array([i for _, i in best], pa.string() if item_type == "string" else pa.int64()),
                        pa.array([n for n, _ in best.values()], pa.int32()), pa.array([n for _, n in best.values()], pa.int32())],
                        [*keep, "item_id", "common_words", "item_words"])

    found = settle(tokens.mapInArrow(released(run), f"{fields}, item_id {item_type}, common_words int, item_words int"), "leaks")
    shared.destroy()
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, s: Settings = Settings()) -> DataFrame:
    """One row per document and benchmark item that it holds: the columns ``keep`` of ``docs`` (default doc_id), item_id,
    common_words (longest common subsequence) and item_words.

    ``docs`` has text, ``benchmark`` has item_id (a number, or else text) and
    text. An item of over 64 words is leaked if one of its equal parts is; counts
    are those of the part found best. A part that stands in a document word
    for word is always found; others are if a passage is near enough in the
    latent space. Items go in blocks of 1024 against all
    passages of all documents; what is collected and broadcast is bounded by
    the words of a block.

    Null, empty and wordless texts hold nothing and leak nothing; very long ones
    are searched whole. Rows with equal text get equal answers, repeated items
    are found each. Empty tables give an empty result. Other columns don't matter.
    """
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    item_type = "bigint" if benchmark.schema["item_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    items = settle(columns(benchmark, "item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
                   .select(F.col("item_id").cast(item_type).alias("item_id"), "text"), "leak-items")
    blocks, found = max(1, -(-items.count() // s.items)), []
    for i in range(blocks):
        rows = sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect())
        vocabulary, parts = block_items([tuple(r) for r in rows])
        if not parts.ids:
            continue
        kind = np.int16 if len(vocabulary) < 1 << 15 else np.int32
        tokens = _tokens(docs, keep, vocabulary, kind)
        idf = _weights(tokens, len(vocabulary), kind)
        latent = _latent(tokens, parts, idf, kind, min(s.rank, len(vocabulary)))
        found.append(_search(tokens, keep, parts, idf, latent, kind, item_type, s))
    if not found:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields)
        return spark.createDataFrame([], f"{fields}, item_id {item_type}, common_words int, item_words int")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
