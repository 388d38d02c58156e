"""Find secrets: fixed patterns, and a character convolutional network over every other candidate and its surroundings."""

from __future__ import annotations

import hashlib
import re
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.ranking import exact_quantile
from tracewright.session import settle

# Fixed patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "network")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
PLAIN = re.compile(r"[^\W\d_]{6,}")
BEFORE, INSIDE, AFTER = 32, 48, 16
WIDTH = BEFORE + INSIDE + AFTER
RECALL = 0.98
# Different labelled windows that one task trains on between two means of all weights; rounds, and passes in each.
GROUP = 50_000
ROUNDS, PASSES = 3, 2
NAMES = ("embed", "kernel", "bias", "out", "shift")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted. Patterns of a run that is all one class match it whole, so
    a least length inside the pattern and a test after the match come to the same."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of 12 and more characters of keys and codes that hold a digit and aren't a plain number."""
    return [m.span() for m in CANDIDATE.finditer(text) if not (s := m[0]).isalpha() and any(c.isdigit() for c in s) and any(c.isalpha() for c in s)]


_CLASS = np.zeros(256, np.uint8)  # 1 space, 2.. letters, digits and signs; other bytes 0
for _i in range(33, 127):
    _CLASS[_i] = _i - 31
_CLASS[[9, 10, 13, 32]] = 1


def window(text: str, start: int, end: int) -> bytes:
    """The characters before, in and after a span in fixed places, one byte each; characters beyond ASCII are one class."""
    def part(s, n, left):
        b = s.encode("ascii", "replace")[:n]
        return b.rjust(n, b"\0") if left else b.ljust(n, b"\0")
    return part(text[max(0, start - BEFORE):start], BEFORE, True) + part(text[start:end], INSIDE, False) + part(text[end:end + AFTER], AFTER, False)


@dataclass
class Network:
    """Embedding, one convolution, maxima over the surroundings and over the value, one output; scale and shift calibrate it."""
    embed: np.ndarray   # 96 x d
    kernel: np.ndarray  # width * d x filters
    bias: np.ndarray
    out: np.ndarray     # 2 * filters
    shift: np.ndarray   # 1
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def forward(self, codes: np.ndarray):
        d = self.embed.shape[1]
        width = len(self.kernel) // d
        x = self.embed[codes]
        cols = np.lib.stride_tricks.sliding_window_view(x, width, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - width + 1, width * d)
        a = np.maximum(cols @ self.kernel + self.bias, 0)
        value = np.zeros(a.shape[1], bool)
        value[BEFORE:BEFORE + INSIDE] = True
        inner, outer = a[:, value], a[:, ~value]
        at = inner.argmax(axis=1), outer.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(inner, at[0][:, None], 1)[:, 0], np.take_along_axis(outer, at[1][:, None], 1)[:, 0]], axis=1)
        return cols, a, at, value, pooled, pooled @ self.out + self.shift[0]

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated, in blocks of 512 rows."""
        if not len(codes):
            return np.zeros(0)
        z = np.concatenate([self.forward(codes[i:i + 512])[-1] for i in range(0, len(codes), 512)])
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -60, 60)))


def untrained(rng: np.random.Generator, filters=16, d=8, width=5) -> Network:
    return Network(rng.normal(0, 0.3, (96, d)), rng.normal(0, (2 / (width * d)) ** 0.5, (width * d, filters)), np.zeros(filters), rng.normal(0, 0.2, 2 * filters), np.zeros(1))


def descend(net: Network, codes: np.ndarray, truth: np.ndarray, weight: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Fit ``net`` on weighted windows (Adam), in batches of 128."""
    d, filters = net.embed.shape[1], len(net.bias)
    width = len(net.kernel) // d
    first, second, step = {n: 0.0 for n in NAMES}, {n: 0.0 for n in NAMES}, 0
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for i in range(0, len(order), 128):
            rows = order[i:i + 128]
            cols, a, at, value, pooled, z = net.forward(codes[rows])
            g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - truth[rows]) * weight[rows] / weight[rows].sum()
            grads = {"out": pooled.T @ g, "shift": np.array([g.sum()])}
            back = g[:, None] * net.out * (pooled > 0)
            da = np.zeros_like(a)
            for half, (places, spots) in enumerate(((np.flatnonzero(value), at[0]), (np.flatnonzero(~value), at[1]))):
                np.put_along_axis(da, places[spots][:, None], back[:, half * filters:(half + 1) * filters][:, None]
                                  + np.take_along_axis(da, places[spots][:, None], 1), 1)
            grads["kernel"] = np.tensordot(cols, da, ((0, 1), (0, 1)))
            grads["bias"] = da.sum(axis=(0, 1))
            dx = (da @ net.kernel.T).reshape(len(rows), -1, width, d)
            grads["embed"] = np.zeros_like(net.embed)
            for k in range(width):
                np.add.at(grads["embed"], codes[rows][:, k:k + dx.shape[1]], dx[:, :, k])
            step += 1
            for n in NAMES:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                getattr(net, n)[...] -= 0.004 * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)


def train(codes: np.ndarray, truth: np.ndarray, filters=16, d=8, width=5, epochs=6, recall=RECALL, seed=5) -> Network:
    """Fit on two thirds of a few labelled windows, calibrate and set the threshold on the rest; ``fit`` does so for a table.

    The threshold is the highest one that keeps ``recall`` of the true findings,
    and at least one half.
    """
    rng = np.random.default_rng(seed)
    net = untrained(rng, filters, d, width)
    apart = np.arange(len(codes)) % 3 == 2
    if not len(codes) or truth.min() == truth.max():
        net.threshold = 2.0  # nothing to tell apart: adds nothing
        return net
    descend(net, codes[~apart], truth[~apart], np.ones(int((~apart).sum())), epochs, rng)
    test_x, test_y = (codes[apart], truth[apart]) if apart.any() and truth[apart].any() else (codes, truth)
    z = np.concatenate([net.forward(test_x[i:i + 512])[-1] for i in range(0, len(test_x), 512)])
    scale, offset = 1.0, 0.0
    for _ in range(200):  # logistic calibration
        p = 1 / (1 + np.exp(-np.clip(scale * z + offset, -60, 60)))
        scale -= 0.1 * ((p - test_y) * z).mean() / (1e-3 + (z * z).mean())
        offset -= 0.5 * (p - test_y).mean()
    net.scale, net.offset = float(scale), float(offset)
    found = np.sort(net.probability(test_x[test_y == 1]))
    net.threshold = max(0.5, float(found[int((1 - recall) * len(found))]) if len(found) else 0.5)
    return net


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, base (start, kind, end), spots (start, end) and windows of the
    candidates outside base spans, and ``labelled``: windows of true findings and of plain words, for training."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], [], []]
            for value in batch.column("__text"):
                text = value.as_py() or ""
                base, spots = base_spans(text), candidates(text)
                lone = [s for s in spots if not any(b[0] < s[1] and s[0] < b[2] for b in base)] if base else spots
                true = [s for s in spots if len(lone) < len(spots) and s not in lone]
                word = PLAIN.search(text, len(text) // 2)
                out[0].append(np.array(base, np.int32).tobytes())
                out[1].append(np.array(lone, np.int32).tobytes())
                out[2].append(b"".join(window(text, *s) for s in lone))
                out[3].append(b"".join(window(text, *s) for s in true))
                out[4].append(window(text, *word.span()) if word else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, pa.binary()) for c in out]],
                                             [*batch.schema.names[:-1], "base", "spots", "windows", "found", "plain"])

    return rows.mapInArrow(run, f"{kinds}, base binary, spots binary, windows binary, found binary, plain binary")


def labelled_windows(scanned: DataFrame) -> DataFrame:
    """(truth, code, n): every different window of true findings (1) and of plain words (0), and how often it occurs.

    Findings of the fixed patterns are the labels; what they don't cover is
    unlabelled and takes no part.
    """
    cut = lambda name, truth: scanned.where(F.octet_length(name) > 0).select(F.lit(truth).alias("truth"), F.explode(F.transform(
        F.sequence(F.lit(0), (F.octet_length(name) / WIDTH).cast("int") - 1), lambda i: F.substring(F.col(name), i * WIDTH + 1, F.lit(WIDTH)))).alias("code"))
    return cut("found", 1).unionByName(cut("plain", 0)).groupBy("truth", "code").agg(F.count("*").alias("n"))


def _matrix(column) -> np.ndarray:
    return _CLASS[np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)]


def fit(scanned: DataFrame, group: int = GROUP, recall: float = RECALL, seed: int = 5) -> Network:
    """Train on all labelled windows but every third by digest; calibrate and set the threshold on these.

    Windows are dealt to groups by digest. In a round each group is trained in
    one task from the same weights, and the mean over groups goes on; a group
    sends its weights, some ten KB. Both classes weigh the same.
    """
    windows = settle(labelled_windows(scanned), "secret-windows")
    sizes = {r["truth"]: r for r in windows.groupBy("truth").agg(F.count("*").alias("rows"), F.sum("n").alias("n"),
                                                                 F.count_if(F.pmod(F.crc32("code"), F.lit(3)) == 2).alias("apart")).collect()}
    net = untrained(np.random.default_rng(seed))
    if len(sizes) < 2:
        net.threshold = 2.0  # nothing to tell apart: adds nothing
        return net
    held, rest = F.pmod(F.crc32("code"), F.lit(3)) == 2, F.pmod(F.crc32("code"), F.lit(3)) != 2
    if not sizes[0]["apart"] or not sizes[1]["apart"] or any(r["apart"] == r["rows"] for r in sizes.values()):
        held = rest = F.lit(True)
    share = F.when(F.col("truth") == 1, 1.0 / sizes[1]["n"]).otherwise(1.0 / sizes[0]["n"]) * F.col("n") * (sizes[0]["n"] + sizes[1]["n"]) / 2
    groups = -(-sum(r["rows"] for r in sizes.values()) // group)
    dealt = windows.where(rest).select("truth", "code", share.alias("weight"), F.pmod(F.xxhash64("code"), F.lit(groups)).cast("int").alias("grp"))
    for step in range(ROUNDS):
        _round(dealt, net, [seed, step])
    spark = scanned.sparkSession
    shared = spark.sparkContext.broadcast(net)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            codes = _matrix(batch.column(1))
            z = np.concatenate([shared.value.forward(codes[i:i + 512])[-1] for i in range(0, len(codes), 512)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(z), batch.column(3)], ["truth", "n", "z", "weight"])

    scored = settle(windows.where(held).select("truth", "code", "n", share.alias("weight")).mapInArrow(score, "truth int, n bigint, z double, weight double"), "secret-scores")
    told = LogisticRegression(labelCol="truth", weightCol="weight", regParam=1e-6, standardization=False).fit(
        scored.select("truth", "weight", array_to_vector(F.array("z")).alias("features")))
    net.scale, net.offset = float(told.coefficients[0]), float(told.intercept)
    true = scored.where(F.col("truth") == 1).select((1 / (1 + F.exp(-(F.col("z") * net.scale + net.offset)))).alias("p"))
    net.threshold = max(0.5, exact_quantile(true, "p", 1 - recall).first()["quantile"])
    return net


def _round(dealt: DataFrame, net: Network, seed: list[int]) -> None:
    """Train every group from ``net`` and set it to the mean of their weights, by the windows they have."""
    shared = dealt.sparkSession.sparkContext.broadcast(net)

    def run(key, table):
        import pyarrow as pa

        own = deepcopy(shared.value)
        table = table.sort_by([("code", "ascending"), ("truth", "ascending")])
        descend(own, _matrix(table["code"]), table["truth"].to_numpy().astype(float), table["weight"].to_numpy(), PASSES, np.random.default_rng([*seed, key[0].as_py()]))
        return pa.table({"grp": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([table.num_rows], pa.int64()),
                         "weights": pa.array([np.concatenate([getattr(own, n).ravel() for n in NAMES])], pa.list_(pa.float64()))})

    parts = sorted(dealt.groupBy("grp").applyInArrow(run, "grp int, n bigint, weights array<double>").collect())
    shared.destroy()
    mean = np.average([r["weights"] for r in parts], axis=0, weights=[r["n"] for r in parts])
    for n in NAMES:
        now = getattr(net, n)
        now[...] = mean[:now.size].reshape(now.shape)
        mean = mean[now.size:]


def find_secrets(docs: DataFrame, keep: list[str] | None = None, net: Network | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text, ...; default doc_id) with spans: array of (start, end, kind), by start.

    Kinds assign, access and hex are the matches of the fixed patterns; kind
    network is a candidate outside all of them that the network takes for a
    secret. Starts and ends count code points, end exclusive. Texts are read
    once; candidates and their windows are written and scored apart.

    Null and empty texts have no spans. Repeated rows each get their row. An
    empty table gives an empty result. Other columns of the input don't matter.
    """
    keep = ["doc_id"] if keep is None else keep
    scanned = settle(scan(docs, keep), "secret-spots")
    net = fit(scanned) if net is None else net
    held = docs.sparkSession.sparkContext.broadcast(net)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scanned.schema.fields[:len(keep)])

    def run(batches):
        import pyarrow as pa

        net = held.value
        row = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
        for batch in batches:
            codes = _CLASS[np.frombuffer(b"".join(batch.column("windows").to_pylist()), np.uint8).reshape(-1, WIDTH)]
            yes, at, out = net.probability(codes) >= net.threshold, 0, []
            for base, spots in zip(batch.column("base").to_pylist(), batch.column("spots").to_pylist()):
                base, spots = np.frombuffer(base, np.int32).reshape(-1, 3).tolist(), np.frombuffer(spots, np.int32).reshape(-1, 2).tolist()
                more = [(s, 3, e) for (s, e), y in zip(spots, yes[at:at + len(spots)]) if y]
                at += len(spots)
                out.append([{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in sorted([*map(tuple, base), *more])])
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(out, pa.list_(row))], [*batch.schema.names[:len(keep)], "spans"])

    return scanned.select(*[f"`{c}`" for c in keep], "base", "spots", "windows").mapInArrow(run, f"{kinds}, spans array<struct<start: int, end: int, kind: string>>")


def brute_force(text: str | None) -> tuple[list, str]:
    """The base spans of one text straight from the patterns, and their digest; for tests."""
    found = []
    for kind, pattern, group, least in ((0, ASSIGN, 2, 12), (1, re.compile("AKIA[A-Z0-9]+"), 0, 18), (2, re.compile("[0-9a-f]+"), 0, 16)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    spans = [f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)]
    return spans, hashlib.sha256(",".join(spans).encode()).hexdigest()
