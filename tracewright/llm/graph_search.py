"""Nearest neighbours: a neighbour graph built by NN-descent in Spark joins, and greedy search along it.

Nodes are the distinct vectors; copies hang on their node and come back at the
end. The graph starts from exact neighbours inside small cells of random
projection trees. Each round joins every node with its neighbours and some of
the nodes that point to it, and compares these with each other. Tasks work on
blocks of nodes and fetch each vector once per block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.joining import lookup_join
from tracewright.session import settle


@dataclass(frozen=True)
class Settings:
    """degree: neighbours kept per node; trees and cell: the start; rounds of NN-descent; reverse: pointing nodes that
    take part in a round; offers: best pairs a node takes from one comparison; beam: length of the search list; step:
    nodes opened per query and hop; hops: most hops; block: nodes per task, and twice as many in a round of NN-descent at
    most; queries: queries per task at most; spread: tasks of a round or a hop, as far as these sizes allow."""
    degree: int = 32
    trees: int = 4
    cell: int = 1024
    rounds: int = 3
    reverse: int = 24
    offers: int = 12
    beam: int = 320
    step: int = 64
    hops: int = 12
    block: int = 4096
    queries: int = 128
    spread: int = 8

    def round_blocks(self, n: int) -> int:
        """Blocks of a round over ``n`` nodes.

        Until a block is much smaller than n / (degree + reverse) it fetches most nodes, so blocks of one size would fetch rows
        with the square of n, and a fixed number fetches in proportion. Where there must be more, a node is still
        fetched by no more blocks than there are nodes in whose surroundings it stands, degree + reverse in the mean.
        """
        return max(self.spread, -(-n // (2 * self.block)))

    def query_parts(self, starts: int) -> int:
        """Tasks of a search; likewise, and a query opens a bounded number of nodes a hop."""
        return max(1, min(self.spread, -(-starts // 16)), -(-starts // self.queries))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part: id and vector not null, all components finite and not all zero, and the
    commonest length (the larger of two)."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))
    top = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return rows.where(F.size("vec") == (top["n"] if top else 0))


def _stack(column, kind, width=None) -> np.ndarray:
    """Rows of a binary column without nulls as one array, read where they lie."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.zeros(0, kind)
    if len(column):
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
        flat = np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]].view(kind)
    return flat if width is None else flat.reshape(-1, width)


def _best(node: np.ndarray, other: np.ndarray, dist: np.ndarray, keep: int):
    """The ``keep`` nearest distinct others of every node, sorted by node and distance, ties by id."""
    order = np.lexsort((dist, other, node))
    node, other, dist = node[order], other[order], dist[order]
    new = np.concatenate(([True], (node[1:] != node[:-1]) | (other[1:] != other[:-1]))) if len(node) else np.zeros(0, bool)
    node, other, dist = node[new], other[new], dist[new]
    order = np.lexsort((other, dist, node))
    node, other, dist = node[order], other[order], dist[order]
    begin = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
    rank = np.arange(len(node)) - np.repeat(begin, np.diff(np.append(begin, len(node))))
    keep = rank < keep
    return node[keep], other[keep], dist[keep]


def _lists(node: np.ndarray, other: np.ndarray, dist: np.ndarray):
    """One row per node from sorted flat arrays: node, ids, dists."""
    import pyarrow as pa

    begin = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
    ends = np.append(begin[1:], len(node))
    return pa.table({"node": pa.array(node[begin], pa.int64()),
                     "ids": pa.array([other[a:b].astype(np.int64).tobytes() for a, b in zip(begin, ends)], pa.binary()),
                     "dists": pa.array([dist[a:b].astype(np.float32).tobytes() for a, b in zip(begin, ends)], pa.binary())})


LISTS = "node bigint, ids binary, dists binary"


def _flat(table):
    ids = table.column("ids").to_pylist()
    count = np.array([len(x) // 8 for x in ids], np.int64)
    node = np.repeat(table.column("node").to_numpy(), count)
    return node, np.frombuffer(b"".join(ids), np.int64), _stack(table.column("dists"), np.float32)


def _split(x: np.ndarray, rows: np.ndarray, size: int, rng) -> list[np.ndarray]:
    if len(rows) <= size:
        return [rows]
    order = rows[np.argsort(x[rows] @ rng.normal(size=x.shape[1]).astype(np.float32), kind="stable")]
    half = len(order) // 2
    return _split(x, order[:half], size, rng) + _split(x, order[half:], size, rng)


def _cells(nodes: DataFrame, dim: int, n: int, s: Settings) -> DataFrame:
    """(tree, node, part, leaf, of, ids, dists): exact neighbours inside the cells of each tree; leaf of the leaves of a part.

    Each tree sorts the nodes by the signs of their projections on random
    directions; ranges of that order are cut further inside a task.
    """
    planes = np.random.default_rng(17).normal(size=(dim, 16 * s.trees)).astype(np.float32)

    def codes(batches):
        import pyarrow as pa

        for batch in batches:
            signs = (_stack(batch.column("vec"), np.float32, dim) @ planes > 0).reshape(-1, s.trees, 16)
            code = (signs * (1 << np.arange(15, -1, -1))).sum(axis=2)
            at = pa.array(np.repeat(np.arange(batch.num_rows), s.trees))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(s.trees, dtype=np.int32), batch.num_rows)), pa.array(code.ravel().astype(np.int32)),
                                              batch.column("node").take(at), batch.column("vec").take(at)], ["tree", "code", "node", "vec"])

    def inside(batches):
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        order = np.lexsort((table.column("node").to_numpy(), table.column("tree").to_numpy()))
        tree, node = table.column("tree").to_numpy()[order], table.column("node").to_numpy()[order]
        x = _stack(table.column("vec"), np.float32, dim)[order]
        sq = (x * x).sum(axis=1)
        for t in np.unique(tree):
            rng = np.random.default_rng(int(t) + 31)
            leaves = _split(x, np.flatnonzero(tree == t), s.cell, rng)
            for leaf, rows in enumerate(leaves):
                k = min(s.degree, len(rows) - 1)
                ids, dists = np.zeros((len(rows), 0), np.int64), np.zeros((len(rows), 0), np.float32)
                if k > 0:
                    d = sq[rows][:, None] + sq[rows][None] - 2 * x[rows] @ x[rows].T
                    np.fill_diagonal(d, np.inf)
                    near = np.argpartition(d, k - 1, axis=1)[:, :k]
                    ids, dists = node[rows][near], np.take_along_axis(d, near, 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), t, np.int32)), pa.array(node[rows]), pa.array(np.full(len(rows), leaf, np.int32)), pa.array(np.full(len(rows), len(leaves), np.int32)),
                    pa.array([r.tobytes() for r in ids], pa.binary()), pa.array([r.astype(np.float32).tobytes() for r in dists], pa.binary())],
                    ["tree", "node", "leaf", "of", "ids", "dists"])

    parts = max(1, -(-n * s.trees // (4 * s.block)))
    spread = nodes.mapInArrow(codes, "tree int, code int, node bigint, vec binary").repartitionByRange(parts, "tree", "code", "node")
    out = spread.mapInArrow(inside, "tree int, node bigint, leaf int, of int, ids binary, dists binary")
    return settle(out.withColumn("part", F.spark_partition_id()), "graph-cells")


def _places(cells: DataFrame, n: int, s: Settings) -> DataFrame:
    """(node, block): the order of tree 0 cut into blocks; its nodes fill a range of parts that are about equal."""
    first = cells.where("tree = 0")
    parts = (first.agg(F.max("part").alias("p")).first()["p"] or 0) + 1
    place = (F.col("part") + F.col("leaf") / F.col("of")) * F.lit(s.round_blocks(n) / parts)
    return settle(first.select("node", F.floor(place).cast("int").alias("block")), "graph-place")


PACKED = "home int, nodes binary, ids binary, dists binary"


def _packed(node: np.ndarray, other: np.ndarray, dist: np.ndarray, homes: int) -> dict:
    """Offers sorted by home, the block that keeps a node's list; one row for each home."""
    import pyarrow as pa

    home = ((node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % homes
    order = np.argsort(home, kind="stable")
    home = home[order]
    begin = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1]))) if len(home) else np.zeros(0, np.int64)
    ends = np.append(begin[1:], len(home))
    cut = lambda x, kind: pa.array([x[order][a:b].astype(kind).tobytes() for a, b in zip(begin, ends)], pa.binary())
    return {"home": pa.array(home[begin].astype(np.int32), pa.int32()), "nodes": cut(node, np.int64), "ids": cut(other, np.int64), "dists": cut(dist, np.float32)}


def _merge(lists: DataFrame, n: int, keep: int, s: Settings, offers: DataFrame | None = None) -> DataFrame:
    """The nearest ``keep`` of all lists (node, ids, dists) and packed offers of each node."""
    homes = max(1, -(-n // s.block))

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict(_packed(*_flat(batch), homes))

    def run(table):
        node, other = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("nodes", "ids"))
        return _lists(*_best(node, other, _stack(table.column("dists"), np.float32), keep))

    rows = lists.select("node", "ids", "dists").mapInArrow(pack, PACKED)
    rows = rows if offers is None else rows.unionByName(offers)
    return settle(rows.groupBy("home").applyInArrow(run, LISTS), "graph-lists")


def _around(lists: DataFrame, n: int, reverse: int, s: Settings) -> DataFrame:
    """(node, members): own neighbours and up to ``reverse`` of the nodes that point here, drawn by digest."""

    def both(batches):
        import pyarrow as pa

        for batch in batches:
            node, other, _ = _flat(batch)
            turned = np.repeat([False, True], len(node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, other])), pa.array(np.concatenate([other, node])), pa.array(turned)], ["node", "other", "turned"])

    def run(table):
        import pyarrow as pa

        node, other, turned = (table.column(c).to_numpy(zero_copy_only=False) if c == "turned" else table.column(c).to_numpy() for c in ("node", "other", "turned"))
        draw = ((other.astype(np.uint64) ^ (node.astype(np.uint64) << np.uint64(21))) * np.uint64(0x9E3779B97F4A7C15)).astype(np.float64)
        a, b, _ = _best(node[turned], other[turned], draw[turned], reverse)
        pair = np.unique(np.stack([np.concatenate([node[~turned], a]), np.concatenate([other[~turned], b])], 1), axis=0)
        out = _lists(pair[:, 0], pair[:, 1], np.zeros(len(pair), np.float32))
        return pa.table({"node": out.column("node"), "members": out.column("ids")})

    blocks = max(1, -(-n // s.block))
    rows = lists.select("node", "ids", "dists").mapInArrow(both, "node bigint, other bigint, turned boolean")
    return settle(rows.groupBy(F.pmod(F.xxhash64("node"), F.lit(blocks))).applyInArrow(run, "node bigint, members binary"), "graph-around")


def _wanted(rows: DataFrame, by: str) -> DataFrame:
    """Distinct (by, node) over the members of rows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            members = batch.column("members").to_pylist()
            pair = np.stack([np.repeat(batch.column(by).to_numpy(), [len(m) // 8 for m in members]), np.frombuffer(b"".join(members), np.int64)], 1)
            pair = np.unique(pair, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].astype(np.int32)), pa.array(pair[:, 1])], [by, "node"])

    return rows.select(by, "members").mapInArrow(run, f"{by} int, node bigint").distinct()


def _descend(lists: DataFrame, place: DataFrame, nodes: DataFrame, n: int, dim: int, s: Settings) -> DataFrame:
    """One round: members of every node's surroundings are compared with each other, and each keeps its nearest."""
    around = settle(_around(lists, n, s.reverse, s).join(place, "node"), "graph-groups")
    last = lists.select("node", F.substring("dists", -4, 4).alias("worst"), (F.octet_length("dists") >= 4 * s.degree).alias("full"))
    fetched = _wanted(around, "block").join(nodes, "node").join(last, "node", "left")

    homes = max(1, -(-n // s.block))

    def run(groups, vectors):
        import pyarrow as pa

        ids = vectors.column("node").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        x = _stack(vectors.column("vec"), np.float32, dim)[order]
        full = np.array(vectors.column("full").to_pylist(), dtype=object)[order] == True  # noqa: E712
        worst = np.array([np.frombuffer(w, np.float32)[0] if w and len(w) == 4 else np.inf for w in vectors.column("worst").to_pylist()], np.float32)[order]
        worst[~full] = np.inf
        sq = (x * x).sum(axis=1)
        members = [np.searchsorted(ids, np.frombuffer(m, np.int64)) for m in groups.column("members").to_pylist()]
        members.sort(key=len)
        found = []
        for i in range(0, len(members), 128):
            part = members[i:i + 128]
            width = max(map(len, part))
            if width < 2:
                continue
            m = np.zeros((len(part), width), np.int64)
            real = np.zeros((len(part), width), bool)
            for r, p in enumerate(part):
                m[r, :len(p)], real[r, :len(p)] = p, True
            v = x[m]
            d = sq[m][:, :, None] + sq[m][:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
            d[~real] = np.inf
            d.transpose(0, 2, 1)[~real] = np.inf
            d[:, np.arange(width), np.arange(width)] = np.inf
            k = min(s.offers, width - 1)
            near = np.argpartition(d, k - 1, axis=2)[:, :, :k]
            dist = np.take_along_axis(d, near, 2)
            ok = dist < worst[m][:, :, None]
            other = np.take_along_axis(np.broadcast_to(m[:, None, :], d.shape), near, 2)
            found.append(_best(np.broadcast_to(m[:, :, None], near.shape)[ok], other[ok], dist[ok], s.degree))
        empty = np.zeros(0, np.int64)
        a, b, d = _best(*(np.concatenate(c) for c in zip(*found)), s.degree) if found else (empty, empty, empty)
        return pa.table(_packed(ids[a], ids[b], d, homes))

    offers = around.select("node", "members", "block").groupBy("block").cogroup(
        fetched.select("block", "node", "vec", "worst", "full").groupBy("block")).applyInArrow(run, PACKED)
    return _merge(lists, n, s.degree, s, offers)


def build_graph(nodes: DataFrame, dim: int, s: Settings = Settings()) -> DataFrame:
    """(node, ids, dists): near neighbours of every node of ``nodes`` (node, vec: float32 bytes), nearest first."""
    n = nodes.count()
    cells = _cells(nodes, dim, n, s)
    place = _places(cells, n, s)
    lists = _merge(cells, n, s.degree, s)
    for _ in range(s.rounds if n > s.cell else 0):
        lists = _descend(lists, place, nodes, n, dim, s)
    return lists


def search(starts: DataFrame, graph: DataFrame, nodes: DataFrame, dim: int, s: Settings = Settings()) -> DataFrame:
    """(node, ids, dists): the best nodes found for each node of ``starts``, itself excluded, nearest first.

    Every query starts at its own node. A hop opens the nearest unopened nodes of
    its list, fetches their surroundings and keeps the best; it ends when a
    list has no unopened node.
    """
    n = nodes.count()
    ways = _around(graph, n, s.degree * 2, s)
    parts = s.query_parts(starts.count())
    state = settle(starts.select("node").join(nodes, "node").select(
        F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("part"), "node", "vec", F.lit(b"").alias("ids"), F.lit(b"").alias("dists"), F.lit(b"").alias("opened")), "graph-state")

    def opens(batches):
        import pyarrow as pa

        for batch in batches:
            nexts = []
            for me, ids, opened in zip(*(batch.column(c).to_pylist() for c in ("node", "ids", "opened"))):
                ids, opened = np.frombuffer(ids, np.int64), np.frombuffer(opened, bool)
                nexts.append((ids[~opened][:s.step] if len(ids) else np.array([me], np.int64)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(nexts, pa.binary())], ["part", "members"])

    def hop(own, ways_here, vectors):
        import pyarrow as pa

        ids = vectors.column("node").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], _stack(vectors.column("vec"), np.float32, dim)[order]
        sq = (x * x).sum(axis=1)
        way = dict(zip(ways_here.column("node").to_pylist(), ways_here.column("members").to_pylist()))
        out = [[], [], []]
        for me, vec, have, dist, opened in zip(*(own.column(c).to_pylist() for c in ("node", "vec", "ids", "dists", "opened"))):
            have, dist, opened = np.frombuffer(have, np.int64), np.frombuffer(dist, np.float32), np.frombuffer(opened, bool).copy()
            now = np.flatnonzero(~opened)[:s.step]
            asked = have[now] if len(have) else np.array([me])
            opened[now] = True
            new = np.unique(np.frombuffer(b"".join(way.get(a, b"") for a in asked.tolist()), np.int64))
            new = new[~np.isin(new, have) & (new != me)]
            at = np.searchsorted(ids, new)
            v = np.frombuffer(vec, np.float32)
            d = sq[at] - 2 * x[at] @ v + v @ v
            have, dist, opened = np.append(have, new), np.append(dist, d).astype(np.float32), np.append(opened, np.zeros(len(new), bool))
            order = np.lexsort((have, dist))[:s.beam]
            for o, c in zip(out, (have, dist, opened)):
                o.append(c[order].tobytes())
        return pa.table({"part": own.column("part"), "node": own.column("node"), "vec": own.column("vec"), **{
            c: pa.array(o, pa.binary()) for c, o in zip(("ids", "dists", "opened"), out)}})

    for _ in range(s.hops):
        asked = state.mapInArrow(opens, "part int, members binary").where(F.octet_length("members") > 0)
        if asked.limit(1).count() == 0:
            break
        found = settle(_wanted(asked, "part").join(ways, "node"), "graph-open")
        fetched = _wanted(found, "part").join(nodes, "node")
        pieces = (found.select("part", "node", "members", F.lit(None).cast("binary").alias("vec"))
                  .unionByName(fetched.select("part", "node", F.lit(None).cast("binary").alias("members"), "vec")))

        def step(own, rest):
            import pyarrow.compute as pc

            if not own.num_rows:
                return own
            is_way = pc.is_valid(rest.column("members"))
            return hop(own, rest.filter(is_way), rest.filter(pc.invert(is_way)))

        state = settle(state.groupBy("part").cogroup(pieces.groupBy("part")).applyInArrow(step, state.schema), "graph-state")
    return state.select("node", "ids", "dists")


def nearest(vectors: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """(query, rank, id, score): the ``k`` nearest rows found for each row where ``queries`` (a condition on the input) holds.

    Euclidean distance in double precision on the original vectors; the query's
    own row is no candidate; ties go to the smaller id; all candidates if there
    are fewer than k. Copies of a vector are one node, so however many there
    are, they take one place in the graph, and its k + 1 smallest ids answer
    for all of them.

    Left out, as query and as candidate: null ids, vectors that are null, empty
    or zero, hold null or non-finite components, or differ in length from most.
    Repeated rows of an id count once. An empty table gives an empty result.
    Other columns don't matter.
    """
    rows = settle(usable(vectors, id_col, vec_col).dropDuplicates(["id"]), "graph-rows")
    asked = vectors.where(queries).select(F.col(id_col).cast("bigint").alias("id")).distinct()
    schema = "query bigint, rank int, id bigint, score double"
    first = rows.select(F.size("vec").alias("n")).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = first["n"]
    keyed = rows.select("id", "vec", F.sha2(F.array_join(F.col("vec"), ",").cast("binary"), 256).alias("same"))
    heads = settle(keyed.groupBy("same").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "graph-same")
    keyed = keyed.join(heads, "same")
    members = keyed.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1)
    members = settle(members.select("node", "id"), "graph-members")

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            flat = batch.column("vec").flatten().to_numpy()
            wide = flat.reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([v.tobytes() for v in wide.astype(np.float32)], pa.binary()),
                                              pa.array([v.tobytes() for v in wide], pa.binary())], ["node", "vec", "exact"])

    both = settle(keyed.where("id = node").select("node", "vec").mapInArrow(pack, "node bigint, vec binary, exact binary"), "graph-nodes")
    nodes = both.select("node", "vec")
    graph = build_graph(nodes, dim, s)
    query_nodes = settle(asked.join(keyed.select("id", "node"), "id"), "graph-queries")
    found = search(query_nodes.select("node").distinct(), graph, nodes, dim, s)

    def cut(batches):  # twice as many as asked for, so that the order in double precision decides
        import pyarrow as pa

        for batch in batches:
            ids = [np.append(np.frombuffer(x, np.int64)[:2 * k], me) for x, me in zip(batch.column("ids").to_pylist(), batch.column("node").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(np.repeat(np.arange(len(ids)), [len(x) for x in ids]))),
                                              pa.array(np.concatenate(ids))], ["query_node", "node"])

    pairs = found.mapInArrow(cut, "query_node bigint, node bigint")
    exact = both.select("node", "exact")
    pairs = pairs.join(exact, "node").join(exact.select(F.col("node").alias("query_node"), F.col("exact").alias("mine")), "query_node")

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            d = _stack(batch.column("exact"), np.float64, dim) - _stack(batch.column("mine"), np.float64, dim)
            yield pa.RecordBatch.from_arrays([batch.column("query_node"), batch.column("node"), pa.array(np.sqrt((d * d).sum(axis=1)))], ["query_node", "node", "score"])

    near = pairs.mapInArrow(measure, "query_node bigint, node bigint, score double").join(members, "node")
    order = Window.partitionBy("query_node").orderBy("score", "id")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    near = settle(near.groupBy(F.col("query_node").alias("node")).agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near")), "graph-near")
    out = lookup_join(query_nodes.withColumnRenamed("id", "query"), near, ["node"], "inner", row_bytes=32 * (k + 1))
    out = out.withColumn("near", F.slice(F.filter("near", lambda x: x["id"] != F.col("query")), 1, k))
    return out.select("query", F.posexplode("near").alias("pos", "x")).select(
        "query", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
