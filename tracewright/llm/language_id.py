"""Language of a text: multinomial logistic regression on TF-IDF character n-grams, with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import released

BINS = 1 << 15
ORDERS = 3
# Training texts per language the weights are fitted on, in expectation; document frequencies come from all.
SAMPLE = 1000
UNKNOWN = "und"
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_LETTER: list = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the character 1- to 3-grams of a text and their counts; empty if it has no letter.

    Lower case; everything but letters is a gap between words.
    """
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters()[code], code, 32)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code = code[keep]
    if not (code != 32).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.concatenate(([32], code, [32])).astype(np.uint64)
    h, found = code * _FACTORS[0], []
    for order in range(ORDERS):
        if order:
            if len(code) <= order:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _FACTORS[order] + code[order:] * _FACTORS[0]
        found.append(((h * _FACTORS[2]) >> np.uint64(49)).astype(np.int64))
    counts = np.bincount(np.concatenate(found), minlength=BINS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BINS + 1 rows, the last is the constant
    temperature: float

    def logits(self, at, counts) -> np.ndarray:
        return weigh(at, counts, self.idf) @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = grams(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        z = self.logits(at, counts) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def ftrl(rows: list, classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.05, epochs=4, seed=7) -> np.ndarray:
    """Weights by follow-the-regularised-leader with an elastic-net penalty; rows hold (bins, values, class)."""
    z = np.zeros((BINS + 1, classes))
    n = np.zeros((BINS + 1, classes))

    def solve(zi, ni, penalty):
        w = (np.sign(zi) * penalty - zi) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= penalty, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = solve(z[at], n[at], l1)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return solve(z, n, l1)


def calibrate(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden section on its logarithm.

    One more wrong answer than seen is allowed for, so that texts told apart
    without an error don't drive it to zero.
    """
    wrong = 1 / (len(logits) + 2)

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        s = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
        return -((1 - wrong) * s[np.arange(len(s)), truth].mean() + wrong * s.mean())

    a, b, ratio = np.log(0.02), np.log(10.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, train: Column, sample: int = SAMPLE) -> Model:
    """Train on the rows of ``docs`` (text, lang, ...) where ``train`` holds, lang isn't null and the text has a letter.

    Document frequencies are counted over all of them. The weights are fitted on
    about ``sample`` texts of each language, whole, drawn by digest; every fifth
    of these sets the temperature instead. Without training rows the model
    knows no language.
    """
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))

    def frequencies(batches):
        import pyarrow as pa

        df = np.zeros(BINS, np.int64)
        n = 0
        for batch in batches:
            for text in batch.column("text"):
                at, _ = grams(text.as_py())
                df[at] += 1
                n += bool(len(at))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n))], ["bin", "n"])

    sums = {r["bin"]: r["n"] for r in rows.select("text").mapInArrow(released(frequencies), "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    total, idf = sums.pop(-1, 0), np.zeros(BINS)
    if sums:
        idf[list(sums)] = np.log((1 + total) / (1 + np.array(list(sums.values()), float))) + 1
    shares = {r["lang"]: sample / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return Model([], idf, np.zeros((BINS + 1, 0)), 1.0)
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30))

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(y, *grams(t)) for t, y in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist())]
            found = [f for f in found if len(f[1])]
            if found:
                yield pa.RecordBatch.from_arrays([
                    pa.array([f[0] for f in found]), pa.array([f[1].astype(np.int32).tobytes() for f in found], pa.binary()),
                    pa.array([f[2].astype(np.int32).tobytes() for f in found], pa.binary())], ["lang", "at", "counts"])

    found = sorted(chosen.mapInArrow(released(features), "lang string, at binary, counts binary").collect(), key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["counts"])))
    langs = sorted({r["lang"] for r in found})
    data = []
    for r in found:
        at, counts = np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["counts"], np.int32)
        data.append((np.append(at, BINS), np.append(weigh(at, counts, idf), 1.0), langs.index(r["lang"])))
    apart = [d for i, d in enumerate(data) if i % 5 == 4] or data
    weights = ftrl([d for i, d in enumerate(data) if i % 5 != 4] or data, len(langs))
    temperature = calibrate(np.stack([x @ weights[at] for at, x, _ in apart]), np.array([y for *_, y in apart])) if langs else 1.0
    return Model(langs, idf, weights, temperature)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` (text, ...) with lang_pred and score, the calibrated probability of that language.

    ``und`` with score 0 where the text is null, empty or has no letter, or the
    model knows no language. Whole texts of any length; only the text is looked
    at. Equal texts get equal results, ties go to the first language in code
    point order. Columns of the input called lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.idf.astype(np.float32), model.weights.astype(np.float32), model.temperature))
    place = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        own = Model(*shared.value)
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(released(run), schema)
