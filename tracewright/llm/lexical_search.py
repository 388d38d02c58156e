"""Ranked search by words: term at a time, rarest first, with a limit on accumulators that loses nothing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import LOWER, Rolling, slices, text_arrays, words_of
from tracewright.operators.joining import lookup_join
from tracewright.session import settle

K1, B = 8, 75  # of the score: length weighs B hundredths
BITS = 1 << 22
# Items of one block have about so many different words in sum; a block travels to every task.
BLOCK_TERMS = 1 << 20
SLICE = 1 << 20
# Counts of different words that a task holds before it passes them on.
HELD = 1 << 19

# Words hold ASCII letters and digits and everything beyond ASCII; the rest separates. Only A-Z change case.
TERM_BYTES = LOWER.copy()
TERM_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def terms_of(column) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digest of every word in an Arrow column of texts, and the n + 1 offsets of the texts."""
    data, offsets = text_arrays(column)
    data = TERM_BYTES[data]
    start, end, first = words_of(data, offsets)
    return Rolling(data).of(start, end) if len(start) else np.zeros(0, np.uint64), first


def counted(terms: np.ndarray, row: np.ndarray, rows: int):
    """Different words of each row with their counts: offsets of rows, words, counts."""
    order = np.lexsort((terms, row))
    terms, row = terms[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])])) if len(terms) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(terms)))
    return np.searchsorted(row[new], np.arange(rows + 1)), terms[new], counts


def word_table(texts: DataFrame, keep: list[str], bits: np.ndarray | None = None) -> DataFrame:
    """The columns ``keep`` with n (all words), terms (different ones as digests) and tfs; only words whose bit is set, if bits are given."""
    rows = texts.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared = None if bits is None else texts.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        import pyarrow as pa

        known = None if shared is None else np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for part in slices(batch, SLICE, "__text"):
                terms, first = terms_of(part.column(part.num_columns - 1))
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                if known is not None:
                    stay = known[(terms % np.uint64(BITS)).astype(np.int64)]
                    terms, row = terms[stay], row[stay]
                edges, terms, tfs = counted(terms, row, part.num_rows)
                edges = pa.array(edges, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(np.diff(first)), pa.ListArray.from_arrays(edges, pa.array(terms.view(np.int64))), pa.ListArray.from_arrays(edges, pa.array(tfs, pa.int64()))],
                    [*part.schema.names[:-1], "n", "terms", "tfs"])

    found = settle(rows.mapInArrow(run, f"{fields}, n bigint, terms array<bigint>, tfs array<bigint>"), "search-words")
    if shared is not None:
        shared.destroy()
    return found


def term_bits(items: DataFrame) -> np.ndarray:
    """One bit for each word of the items, by digest; of fixed size whatever the number of items."""
    found = items.select(F.explode("terms").alias("t")).select(F.pmod("t", F.lit(BITS)).alias("bit")).distinct().collect()
    bits = np.zeros(BITS, bool)
    bits[[r["bit"] for r in found]] = True
    return bits


def document_counts(index: DataFrame) -> DataFrame:
    """Rows that hold each word: counted in the tasks, then added up."""

    def run(batches):
        import pyarrow as pa

        held, n = [], 0
        out = lambda t, c: pa.RecordBatch.from_arrays([pa.array(t), pa.array(c, pa.int64())], ["term", "df"])
        for batch in batches:
            held.append(np.unique(batch.column(0).flatten().to_numpy(), return_counts=True))
            n += len(held[-1][0])
            if n > HELD:
                terms, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
                held = [(terms, np.bincount(at, np.concatenate([h[1] for h in held])).astype(np.int64))]
                n = len(terms)
                if n > HELD // 2:
                    yield out(*held[0])
                    held, n = [], 0
        if n:
            yield out(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    return settle(index.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")), "search-counts")


class Block:
    """Items that travel to every task: their words rarest first, with weight times repeats."""

    def __init__(self, rows: list, total: int, words: int, k: int):
        self.items = [r["item"] for r in rows]
        self.total, self.words, self.k = total, words, k
        self.vocabulary = np.array(sorted({e["term"] for r in rows for e in r["entries"]}), np.int64)
        self.lists = []
        for r in rows:
            entries = sorted(r["entries"], key=lambda e: (e["df"], e["term"]))
            weight = np.array([e["tf"] * math.floor(1000 * math.log((2 * total + 2) / (2 * e["df"] + 1))) for e in entries], np.int64)
            self.lists.append((np.searchsorted(self.vocabulary, np.array([e["term"] for e in entries], np.int64)), weight))


class Search:
    """The best documents so far of every item of a block, over the documents a task has seen."""

    def __init__(self, block: Block):
        self.block = block
        self.best: list[list] = [[] for _ in block.items]

    def postings(self, n: np.ndarray, edges: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        """Inverted lists over some documents: edges by word, document, share of the word's weight in thousandths of thousandths."""
        b, total, words = self.block, self.block.total, self.block.words
        at = np.minimum(np.searchsorted(b.vocabulary, terms), len(b.vocabulary) - 1)
        mine = b.vocabulary[at] == terms
        doc = np.repeat(np.arange(len(n)), np.diff(edges))[mine]
        at, tf = at[mine], tfs[mine]
        if B * int(n.max(initial=0)) * total < 1 << 63:
            m = 100 - B + B * n * total // words
        else:
            m = np.array([100 - B + B * int(x) * total // words for x in n], np.int64)
        share = 1_000_000_000 * tf // (1000 * tf + K1 * m[doc])
        order = np.argsort(at, kind="stable")
        return np.searchsorted(at[order], np.arange(len(b.vocabulary) + 1)), doc[order], share[order]

    def add(self, ids, n: np.ndarray, edges: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Look at more documents; ``ids`` is an Arrow array."""
        import pyarrow as pa

        if not len(self.block.vocabulary):
            return
        first, doc, share = self.postings(n, edges, terms, tfs)
        top = np.zeros(len(first) - 1, np.int64)
        full = np.flatnonzero(np.diff(first))
        if not len(full):
            return
        top[full] = np.maximum.reduceat(share, first[full])
        score = np.zeros(len(n), np.int64)
        for i, (words, weight) in enumerate(self.block.lists):
            found = self.one(words, weight, first, doc, share, top, score, self.least(i))
            if len(found):
                known = ids.take(pa.array(found)).to_pylist()
                mine = self.best[i] + [(-s, x is None, x) for s, x in zip(score[found].tolist(), known)]
                self.best[i] = sorted(mine, key=lambda e: (e[0], e[1], 0 if e[1] else e[2]))[:self.block.k]
            score[:] = 0

    def least(self, i: int) -> int:
        """The score of the k-th document so far; 1 if there are fewer."""
        best = self.best[i]
        return -best[-1][0] if len(best) == self.block.k else 1

    def one(self, words, weight, first, doc, share, top, score, least) -> np.ndarray:
        """Documents whose score for one item is at least that of the k-th best; ``score`` gets the scores.

        Rarest word first. While the words to come could lift a new document to
        the k-th partial score, their postings open accumulators. From then on,
        only open ones that can still reach it are updated.
        """
        k = self.block.k
        rest = np.append(np.cumsum((weight * top[words])[::-1])[::-1], 0)
        open_ = None
        for j, w in enumerate(words.tolist()):
            if rest[j] < least:
                break
            if rest[j] <= (high := int(score.max(initial=0))) and high and len(score) > k:
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
                if rest[j] < least:
                    break
            at = slice(first[w], first[w + 1])
            score[doc[at]] += weight[j] * share[at]
        else:
            j = len(words)
        if j < len(words):
            open_ = np.flatnonzero((score > 0) & (score + rest[j] >= least))
            for j in range(j, len(words)):
                docs, w = doc[first[words[j]]:first[words[j] + 1]], words[j]
                place = np.searchsorted(docs, open_)
                hit = np.flatnonzero(place < len(docs))
                hit = hit[docs[place[hit]] == open_[hit]]
                score[open_[hit]] += weight[j] * share[first[w] + place[hit]]
                if len(open_) > k:
                    least = max(least, int(np.partition(score[open_], len(open_) - k)[len(open_) - k]))
                open_ = open_[score[open_] + rest[j + 1] >= least]
            return open_[score[open_] >= least]
        found = np.flatnonzero(score >= least)
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
        return found


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", k: int = 10) -> DataFrame:
    """The ``k`` documents (text, ...) with the highest scores for each row of ``items`` (text, ...): item_id, rank, doc_id, score.

    A document's score adds up w * (10**9 * tf div (1000 * tf + 8 * m)) over the
    item's words, repeats included; w falls with the number of documents that
    hold the word, m grows with the document's length. Only scores above 0,
    equal scores by ascending doc_id, null ones last.

    Documents are read once: a table holds, per document, the words that some
    item has (told by a bit table of fixed size) with their counts. Document
    frequencies come from it. Then each task builds inverted lists over its
    documents and works through every item's words, rarest first, keeping k
    documents per item; these few rows are ranked over all tasks. Items travel
    in blocks of about a million words; a block more reads the table of words,
    not the texts, once more. Words are told apart by 64-bit digests.

    Null and empty texts have no words: such an item gets no row and such a
    document is none. Repeated documents are ranked each for itself, and every
    row of ``items`` is an item of its own though its id be null or repeated.
    Whole texts of any length; other columns don't matter; empty tables give an
    empty result.
    """
    wanted = word_table(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id}`").alias("item_id"), F.col("text")), ["item", "item_id"])
    index = word_table(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), "text"), ["doc_id"], term_bits(wanted))
    sums = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("total"), F.sum("n").alias("words")).first()
    entries = wanted.select("item", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select("item", F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf"))
    entries = lookup_join(entries, document_counts(index), ["term"], "inner", row_bytes=32)
    size = wanted.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_TERMS))
    by_item = settle(entries.groupBy("item").agg(F.collect_list(F.struct("term", "tf", "df")).alias("entries"))
                     .withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "search-items")
    kind = index.schema["doc_id"].dataType.simpleString()
    parts = [_search_block(index, by_item.where(F.col("block") == b), sums["total"], sums["words"] or 1, k, kind) for b in range(blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return lookup_join(ranked, settle(wanted.select("item", "item_id"), "search-ids"), ["item"], "inner", row_bytes=32).select("item_id", "rank", "doc_id", "score")


def _search_block(index: DataFrame, items: DataFrame, total: int, words: int, k: int, kind: str) -> DataFrame:
    """Up to k documents per item and task."""
    import pyarrow as pa

    shared = index.sparkSession.sparkContext.broadcast(Block(sorted(items.collect(), key=lambda r: r["item"]), total, words, k))
    target = index.select("doc_id").schema

    def run(batches):
        own = None
        for batch in batches:
            own = own or Search(shared.value)
            terms = batch.column(2)
            edges = np.concatenate([[0], np.cumsum(np.diff(terms.offsets.to_numpy()))])
            own.add(batch.column(0), batch.column(1).to_numpy(), edges, terms.flatten().to_numpy(), batch.column(3).flatten().to_numpy())
        if own is not None:
            rows = [(item, e[2], -e[0]) for item, best in zip(own.block.items, own.best) for e in best]
            from pyspark.sql.pandas.types import to_arrow_type

            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], to_arrow_type(target.fields[0].dataType)),
                                              pa.array([r[2] for r in rows], pa.int64())], ["item", "doc_id", "score"])

    found = settle(index.select("doc_id", "n", "terms", "tfs").mapInArrow(run, f"item bigint, doc_id {kind}, score bigint"), "search-best")
    shared.destroy()
    return found
