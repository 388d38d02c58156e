"""Similarity join of word shingle sets by their count vectors, and the groups that its links make.

A set is a point whose coordinates count its shingles per hash group. Two sets
of Jaccard similarity t differ in at most (1 - t) / (1 + t) of their summed
sizes, R shingles, so if the coordinates are cut into R + 1 + m slabs, more than
m slabs agree in full. Sets that agree on a slab meet through a shuffle on it,
and pairs that meet often enough are connected to small clusters. Inside a cluster a packed R-tree
over the count vectors bounds the overlap with a box by summed coordinate
minima, and pairs that pass are verified on the sets. The slabs go before the
tree because boxes in so many dimensions would overlap across a whole corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import LOWER, Rolling, columns, components, mix, released, slices, text_arrays, words_of
from tracewright.operators.joining import lookup_join
from tracewright.session import settle

GROUPS = 64
# Sets of a cluster that are compared in one task; larger clusters are cut.
BLOCK = 512
HUBS = 16
LEAF = 32
# Sets on one slab whose pairs are counted; a slab with more is common and stands back for the others.
COMMON = 16
# Bits of a slab's key, whole bytes.
KEY = 48
_SHIFT = 24
_STEP = np.uint64(0xD6E8FEB86659FD93)
_CLASS = np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets link from a Jaccard similarity of ``percent`` / 100."""
    words: int = 5
    percent: int = 80

    def least_overlap(self, sizes):
        """Smallest intersection of a linked pair with these summed sizes."""
        return -(-self.percent * sizes // (100 + self.percent))

    def edges(self, upto: int) -> list[int]:
        out = [1]
        while out[-1] <= upto:
            out.append(max(out[-1] + 1, ceil(out[-1] * 1.3)))
        return out

    def slabs(self, low: int, high: int) -> tuple[int, int]:
        """Number of slabs for pairs whose smaller set has low .. high - 1 shingles, and m, how many of them may go unused."""
        differ = (high - 1) * (100 - self.percent) // self.percent
        spare = 1 + ceil(0.35 * differ) if differ else 0
        return differ + 1 + spare, spare


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each row; ASCII letters in lower case.

    A row with fewer words is one shingle, a row without words has none.
    """
    start, end, first = words_of(data, offsets)
    if not len(start):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    h = Rolling(LOWER[data]).of(start, end)
    full = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for j in range(words):
        full = full * _STEP + h[j:j + len(full)]
    full, out = mix(full), []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            s = np.sort(full[a:b - words + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            one = np.uint64(b - a)
            for x in h[a:b]:
                one = np.uint64((int(one) * int(_STEP) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([one])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slab_keys(s: np.ndarray, rule: Rule, edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the slabs of one sorted set: its own size class, and the smaller classes it can link into.

    Beside each key stands its class and the set's slack, m less the empty slabs.
    Linked sets agree on more than m slabs. A set with slack 0 or more leaves
    its empty slabs out: some other slab agrees, as one that agrees is empty on
    both sides. A set without gives all its slabs. Keys are cut to KEY bits, which make the rows sent and kept smaller; two
    slabs that share a key by chance bring a pair to the check more, never one less.
    """
    n, keys, info = len(s), [], []
    k = int(np.searchsorted(edges, n, side="right")) - 1
    mixed = mix(s ^ _CLASS)
    while k >= 0:
        low, high = edges[k], edges[k + 1]
        if n >= high and n * rule.percent > (high - 1) * 100:
            break
        count, spare = rule.slabs(low, high)
        slab = ((s >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate(([True], slab[1:] != slab[:-1])))
        tag = mix(np.array([k + 1], np.uint64))
        own = mix(np.add.reduceat(mixed, begin) + slab[begin] * _STEP + tag)
        slack = spare - (count - len(begin))
        if slack < 0:
            empty = np.ones(count, bool)
            empty[slab[begin].astype(np.int64)] = False
            own = np.append(own, mix(np.flatnonzero(empty).astype(np.uint64) * _STEP + tag))
        keys.append(own)
        info.append(np.full(len(own), (k << _SHIFT) + max(slack, -1) + 1, np.int64))
        k -= 1
    return np.concatenate(keys) >> np.uint64(64 - KEY), np.concatenate(info)


def packed_keys(keys: np.ndarray, info: np.ndarray) -> bytes:
    """KEY bits of each key, then runs of equal info (info, length), then the number of runs."""
    begin = np.flatnonzero(np.concatenate(([True], info[1:] != info[:-1])))
    runs = np.stack([info[begin], np.diff(np.append(begin, len(info)))])
    return keys.view(np.uint8).reshape(-1, 8)[:, :KEY // 8].tobytes() + runs.tobytes() + np.int64(len(begin)).tobytes()


def unpacked_keys(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and info from ``packed_keys``."""
    n = int.from_bytes(raw[-8:], "little")
    runs = np.frombuffer(raw[-8 - 16 * n:-8], np.int64).reshape(2, n)
    info = np.repeat(runs[0], runs[1])
    wide = np.zeros((len(info), 8), np.uint8)
    wide[:, :KEY // 8] = np.frombuffer(raw, np.uint8, len(info) * (KEY // 8)).reshape(-1, KEY // 8)
    return wide.view(np.int64).ravel(), info


def set_table(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, and its slab keys, one row per document; written once."""

    def run(batches):
        import pyarrow as pa

        edges = rule.edges(1024)
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*text_arrays(part.column("text")), rule.words)
                most = max(map(len, sets))
                if most >= edges[-1]:
                    edges = rule.edges(2 * most)
                sums = [(int(s.sum()), int(mix(s + _STEP).sum())) if len(s) else (0, 0) for s in sets]
                marks = mix(np.array(sums, np.uint64)).view(np.int64)
                keys = [packed_keys(*slab_keys(s, rule, edges)) if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]),
                                                  pa.array(marks[:, 1]), pa.array(keys, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return settle(columns(docs, "doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, n_shingles bigint, f1 bigint, f2 bigint, keys binary"), "jaccard-sets")


def _pairs(node: np.ndarray, info: np.ndarray, begin: np.ndarray, count: np.ndarray):
    """All pairs inside runs of at most COMMON rows."""
    left, right = [], []
    for g in range(2, COMMON + 1):
        at = begin[count == g]
        if len(at):
            i, j = np.triu_indices(g, 1)
            left.append((at[:, None] + i).ravel())
            right.append((at[:, None] + j).ravel())
    if not left:
        return None
    left, right = np.concatenate(left), np.concatenate(right)
    other = node[left] != node[right]
    left, right = left[other], right[other]
    return node[left], node[right], info[left], info[right]


def _meet(batches):
    """From (key, node, info) sorted by key and node: a row (a, b, ia, ib) per pair on a slab, and for slabs with more
    than COMMON sets a row (a, key, ia) per set."""
    import pyarrow as pa

    def pair_rows(found):
        n = len(found[0])
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.nulls(n, pa.int64()), pa.array(found[2]), pa.array(found[3])], ["a", "b", "key", "ia", "ib"])

    def common_rows(key, node, info):
        n = len(key)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(n, pa.int64()), pa.array(key), pa.array(info), pa.nulls(n, pa.int64())], ["a", "b", "key", "ia", "ib"])

    held = [np.zeros(0, np.int64)] * 3
    common = None  # the key of a run that is known to be common and was passed on in part
    for batch in batches:
        key, node, info = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "node", "info")))
        if not len(key):
            continue
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(begin, len(key)))
        over = (count > COMMON) | (key[begin] == common) if common is not None else count > COMMON
        done = np.ones(len(begin), bool)
        done[-1] = over[-1]  # the last run may go on
        found = _pairs(node, info, begin[done & ~over], count[done & ~over])
        if found is not None and len(found[0]):
            yield pair_rows(found)
        rows = np.repeat(over, count)
        if rows.any():
            yield common_rows(key[rows], node[rows], info[rows])
        common = key[-1] if over[-1] else None
        held = [np.zeros(0, np.int64)] * 3 if over[-1] else [x[begin[-1]:] for x in (key, node, info)]
    if len(held[0]) > 1:
        found = _pairs(held[1], held[2], np.array([0]), np.array([len(held[0])]))
        if found is not None and len(found[0]):
            yield pair_rows(found)


def _candidates(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets that may link; nodes: (node, keys).

    A pair must agree on more than m slabs. What is neither empty nor common of
    these it shares in slabs whose pairs are counted, so fewer meetings than
    slack - common slabs + 1 rule it out. Sets with more common slabs than
    slack also meet the others of this sort on their common slabs.
    """

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            keys = [unpacked_keys(k) for k in batch.column("keys").to_pylist()]
            both = [np.concatenate(x) for x in zip(*keys)] if keys else np.zeros((2, 0), np.int64)
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k, _ in keys]))
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), batch.column("node").take(at), pa.array(both[1])], ["key", "node", "info"])

    def stars(batches):
        import pyarrow as pa

        last_key = last_first = None
        for batch in batches:
            key, node = batch.column("key").to_numpy(), batch.column("a").to_numpy()
            if not len(key):
                continue
            begin = np.concatenate(([key[0] != last_key], key[1:] != key[:-1]))
            place = np.maximum.accumulate(np.where(begin, np.arange(len(key)), -1))
            first = np.where(place >= 0, node[np.maximum(place, 0)], last_first if last_first is not None else 0)
            last_key, last_first = key[-1], first[-1]
            pairs = np.unique(np.stack([node, first], 1)[node != first], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    rows = nodes.select("node", "keys").mapInArrow(released(spread), "key bigint, node bigint, info bigint")
    met = settle(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(released(_meet), "a bigint, b bigint, key bigint, ia bigint, ib bigint"), "jaccard-met")
    kind = lambda c: F.shiftright(c, _SHIFT)
    slack = lambda c: F.col(c).bitwiseAND((1 << _SHIFT) - 1) - 1
    common = met.where(F.col("b").isNull()).select("a", "key", kind("ia").alias("k"), slack("ia").alias("slack"))
    count = settle(common.groupBy("a", "k").agg(F.count("*").alias("h"), F.min("slack").alias("slack")), "jaccard-common")
    pairs = met.where(F.col("b").isNotNull()).groupBy("a", "b", kind("ia").alias("k")).agg(
        F.count("*").alias("n"), F.min(slack("ia")).alias("sa"), F.min(slack("ib")).alias("sb"))
    pairs = lookup_join(pairs, count.select("a", "k", F.col("h").alias("ha")), ["a", "k"], "left", row_bytes=48)
    pairs = lookup_join(pairs, count.select(F.col("a").alias("b"), "k", F.col("h").alias("hb")), ["b", "k"], "left", row_bytes=48)
    need = lambda s, h: F.col(s) - F.coalesce(F.col(h), F.lit(0))
    pairs = pairs.where(F.col("n") > F.greatest(need("sa", "ha"), need("sb", "hb"), F.lit(0))).select("a", "b")
    crowded = lookup_join(common, count.where("h > slack").select("a", "k"), ["a", "k"], "inner", row_bytes=32)
    shared = crowded.select("key", "a").repartition("key").sortWithinPartitions("key", "a").mapInArrow(released(stars), "a bigint, b bigint")
    return settle(pairs.unionByName(shared).distinct(), "jaccard-cells")


def link_block(nodes: np.ndarray, labels: np.ndarray, probe: np.ndarray, base: np.ndarray, sets: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Links that join different components of the given sets: pairs of a ``probe`` and a ``base`` set (masks).

    Sets with equal labels are taken as joined. Every pair that could join two
    components is ruled out by its bound or verified.
    """
    size = np.array([len(s) for s in sets])
    vec = np.stack([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=GROUPS) for s in sets]).astype(np.int32)
    order = np.lexsort((*vec.T[:2], size))
    order = order[base[order]]
    leaves = [order[i:i + LEAF] for i in range(0, len(order), LEAF)]
    boxes = np.stack([vec[x].max(axis=0) for x in leaves])
    least = np.array([size[x].min() for x in leaves])
    most = np.array([size[x].max() for x in leaves])
    _, group = np.unique(np.concatenate([labels, nodes]), return_inverse=True)
    comp, same = group[:len(labels)].copy(), {}
    for i, x in enumerate(nodes.tolist()):  # one id may stand for several rows
        if x in same:
            comp[comp == comp[i]] = comp[same[x]]
        same.setdefault(x, i)
    links = []
    for i in np.flatnonzero(probe):
        reach = np.minimum(boxes, vec[i]).sum(axis=1)
        near = np.flatnonzero((reach >= rule.least_overlap(size[i] + least)) & (least * rule.percent <= size[i] * 100) & (size[i] * rule.percent <= most * 100))
        if not len(near):
            continue
        others = np.concatenate([leaves[x] for x in near])
        others = others[comp[others] != comp[i]]
        others = others[np.minimum(vec[others], vec[i]).sum(axis=1) >= rule.least_overlap(size[i] + size[others])]
        for j in others:
            if comp[i] != comp[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= rule.percent * (size[i] + size[j] - both):
                    links.append((int(nodes[i]), int(nodes[j])))
                    comp[comp == comp[j]] = comp[i]
    return links


def _verify(members: DataFrame, rule: Rule) -> DataFrame:
    """Links inside each group of (part, node, label, probe, base, set)."""

    def run(table):
        import pyarrow as pa

        nodes, labels = table.column("node").to_numpy(), table.column("label").to_numpy()
        probe, base = table.column("probe").to_numpy(), table.column("base").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        links = link_block(nodes, labels, probe, base, sets, rule) if len(sets) > 1 and probe.any() and base.any() else []
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return settle(members.groupBy("part").applyInArrow(run, "a bigint, b bigint"), "jaccard-links")


def set_groups(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id bigint, text, ...).

    component_id is the smallest doc_id that links reach. Equal sets are one
    point from the start. No pair that could join two groups is skipped: a
    cluster of at most 512 sets is compared in one task; a larger one first in
    blocks, each with the cluster's 16 smallest ids, and, if more than one
    group is left, every set outside the largest group against all others in
    blocks.

    Null or empty text, or one without words: no shingles, linked with nothing.
    Rows with one doc_id are one document. A null doc_id takes no part in links
    but gets the component of equal sets, else null. An empty table gives an
    empty result. Other columns don't matter.
    """
    table = set_table(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), rule)
    copies = table.where((F.col("n_shingles") > 0)).groupBy("f1", "f2").agg(F.count("*").alias("c"), F.min("doc_id").alias("node")).where("c > 1")
    rows = lookup_join(table, settle(copies.drop("c"), "jaccard-copies"), ["f1", "f2"], "left", row_bytes=48)
    rows = rows.withColumn("node", F.coalesce("node", "doc_id"))
    nodes = rows.where((F.col("node") == F.col("doc_id")) & (F.col("n_shingles") > 0))
    clusters = components(_candidates(nodes))
    sizes = settle(clusters.groupBy("component").agg(F.count("*").alias("c")), "jaccard-sizes")
    placed = settle(lookup_join(clusters, sizes, ["component"], "inner", row_bytes=32), "jaccard-placed")
    sets = settle(_sets_of(docs, placed.select(F.col("id").alias("doc_id"), "component", "c"), rule), "jaccard-members")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("c") / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks)
    flags = [F.col("node").alias("label"), F.lit(True).alias("base"), "set"]
    small = sets.select(F.concat_ws(":", "component", own).alias("part"), "node", F.lit(True).alias("probe"), *flags)
    hubs = _hubs(placed)
    spread = (lookup_join(sets.where(F.col("c") > BLOCK), hubs.select(F.col("id").alias("node"), F.lit(True).alias("hub")), ["node"], "inner", row_bytes=16)
              .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).where(F.col("block") != own)
              .select(F.concat_ws(":", "component", "block").alias("part"), "node", F.lit(True).alias("probe"), *flags))
    links = _verify(small.unionByName(spread), rule)
    links = settle(links.unionByName(_rest(sets.where(F.col("c") > BLOCK), links, rule)), "jaccard-all-links")
    groups = components(links).select(F.col("id").alias("node"), "component")
    narrow = rows.select("doc_id", "n_shingles", "node")
    return lookup_join(narrow, settle(groups, "jaccard-groups"), ["node"], "left", row_bytes=32).select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))


def _hubs(placed: DataFrame) -> DataFrame:
    """The smallest ids of each large cluster."""
    first = placed.where(F.col("c") > BLOCK).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("component", "salt").orderBy("id"))).where(F.col("r") <= HUBS)
    return settle(first.withColumn("r", F.row_number().over(Window.partitionBy("component").orderBy("id"))).where(F.col("r") <= HUBS).select("id"), "jaccard-hubs")


def _sets_of(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """component, c, node and the set itself of the wanted documents (doc_id, component, c)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*text_arrays(part.column("text")), rule.words)
                yield pa.RecordBatch.from_arrays([part.column("component"), part.column("c"), part.column("doc_id"),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], ["component", "c", "node", "set"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = lookup_join(rows, wanted, ["doc_id"], "inner", row_bytes=32)
    return found.mapInArrow(released(run), "component bigint, c bigint, node bigint, set binary").where(F.octet_length("set") > 0)


def _rest(large: DataFrame, links: DataFrame, rule: Rule) -> DataFrame:
    """Links of large clusters that are still in several groups: sets outside the largest group against all."""
    if large.limit(1).count() == 0:
        return links.limit(0)
    groups = components(links).select(F.col("id").alias("node"), F.col("component").alias("label"))
    marked = settle(lookup_join(large, settle(groups, "jaccard-part-groups"), ["node"], "left", row_bytes=32)
                    .withColumn("label", F.coalesce("label", "node")), "jaccard-large")
    counts = marked.groupBy("component", "label").agg(F.count("*").alias("n"))
    tops = counts.groupBy("component").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("groups"))
    tops = settle(tops.where("groups > 1").select("component", F.col("top.label").alias("main")), "jaccard-tops")
    left = lookup_join(marked, tops, ["component"], "inner", row_bytes=48)
    # Sizes of linked sets differ by the similarity at most, so only neighbouring steps of size can link.
    step = F.floor(F.log(F.octet_length("set") / 8) / float(np.log(100 / rule.percent) * (1 + 1e-9))).cast("int")
    left = settle(left.withColumn("step", step).withColumn("out", F.col("label") != F.col("main")), "jaccard-left")
    near = F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("at")
    many = (left.select("component", near, F.lit(1).alias("b"), F.lit(0).alias("p"))
            .unionByName(left.where("out").select("component", F.col("step").alias("at"), F.lit(0).alias("b"), F.lit(1).alias("p"))))
    many = many.groupBy("component", "at").agg(F.sum("b").alias("b"), F.sum("p").alias("p")).where("p > 0")
    many = settle(many.select("component", "at", F.ceil(F.col("b") / BLOCK).cast("int").alias("n_base"), F.ceil(F.col("p") / BLOCK).cast("int").alias("n_probe")), "jaccard-steps")
    base = lookup_join(left.select("component", "node", "label", "set", near), many, ["component", "at"], "inner", row_bytes=48)
    base = base.withColumn("i", F.pmod(F.xxhash64("node"), F.col("n_base"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_probe") - 1)))
    probe = lookup_join(left.where("out").select("component", "node", "label", "set", F.col("step").alias("at")), many, ["component", "at"], "inner", row_bytes=48)
    probe = probe.withColumn("j", F.pmod(F.xxhash64("node"), F.col("n_probe"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_base") - 1)))
    part = F.concat_ws(":", "component", "at", "i", "j").alias("part")
    sides = [x.select(part, "node", "label", F.lit(p).alias("probe"), F.lit(not p).alias("base"), "set") for x, p in ((base, False), (probe, True))]
    return _verify(sides[0].unionByName(sides[1]), rule)
