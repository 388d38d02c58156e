"""Pooling in blocks against a plain version; hot tokens, nulls, short vectors, tables beyond every limit."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import embedding as em
from tracewright.operators import pooling as pl


def plain_vector(word, vocab, buckets, n, width):
    if word in vocab:
        return vocab[word]
    marked = f"<{word}>"
    slots = [int(hashlib.md5(f"42:{marked[i:i + k]}".encode()).hexdigest()[:8], 16) % n for k in range(3, 7) for i in range(len(marked) - k + 1)]
    return plain_mean([buckets[s] for s in slots if s in buckets], width) if buckets and any(s in buckets for s in slots) else None


def plain_mean(vectors, width):
    out = []
    for d in range(width):
        have = [v[d] for v in vectors if v is not None and d < len(v) and v[d] is not None]
        out.append(sum(have) / len(have) if have else None)
    return out


def plain_pool(tokens, vocab, width, buckets=None, n=1):
    vectors = [plain_vector(t, vocab, buckets, n, width) for t in tokens or [] if t is not None]
    vectors = [v for v in vectors if v is not None]
    mean = plain_mean(vectors, width)
    return [0.0] * width if all(x is None for x in mean) else mean


def rows_and_words(seed, count=300):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(120)]
    share = 1 / np.arange(1, 121)
    lists = [["hot"] * int(rng.integers(0, 40)) + [words[i] for i in rng.choice(120, int(rng.integers(0, 30)), p=share / share.sum())] for _ in range(count)]
    lists += [[], None, [None, "w1", None], ["never"], ["never", "hot"]]
    return [(i // 2, t) for i, t in enumerate(lists)] + [(None, ["w1", "hot"])], words


def check(spark, df, want, out="embedding"):
    """Rows as multisets, as row ids repeat."""
    got = df.select("row_id", "tokens", out).collect()
    assert len(got) == len(want)
    key = lambda i, t: (str(i), str(t))
    for r, w in zip(sorted(got, key=lambda r: key(r[0], r[1])), sorted(want, key=lambda w: key(w[0], w[1]))):
        assert (r[0], r[1]) == (w[0], w[1])
        assert [x is None for x in r[2]] == [x is None for x in w[2]]
        assert [x for x in r[2] if x is not None] == pytest.approx([x for x in w[2] if x is not None], rel=1e-5, abs=1e-6)


SHAPES = {"whole": lambda v, i: v, "missing": lambda v, i: v[:3] if i % 5 == 0 else [None if (i + d) % 4 == 0 else x for d, x in enumerate(v)] if i % 3 == 0 else v,
          "absent": lambda v, i: None if i == 1 else v}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_pool_equals_plain_means(spark, shape):
    rows, words = rows_and_words(1)
    rng = np.random.default_rng(2)
    vocab = {w: SHAPES[shape](rng.normal(size=6).tolist(), i) for i, w in enumerate([*words[:90], "hot", "unused"])}
    table = spark.createDataFrame(list(vocab.items()), "token string, vec array<double>")
    df = spark.createDataFrame(rows, "row_id bigint, tokens array<string>").repartition(5)
    want = [(i, t, plain_pool(t, vocab, 6)) for i, t in rows]
    check(spark, em.mean_pool(df, table, 6), want)
    vocab_settled = em.settle(table, "vocab-test")
    one = pl.key_bytes(vocab_settled, 6)
    for limit, block in ((0, 10 * one), (20 * one, 1), (89 * one, 1 << 20)):  # no, some, all but one of the used tokens are hot
        check(spark, pl.pooled(df, vocab_settled, 6, "tokens", "embedding", limit, block, 200), want)
    assert em.mean_pool(df.limit(0), table, 6).count() == 0
    check(spark, em.mean_pool(df, table.limit(0), 6), [(i, t, [0.0] * 6) for i, t in rows])


@pytest.mark.parametrize("limit", [pl.HOT_BYTES, 3000])
def test_subwords_equal_plain_means(spark, limit):
    rows, words = rows_and_words(3, 80)
    rows += [(900, ["walking", "walks", "é", "w3", "x"])]
    rng = np.random.default_rng(4)
    vocab = {w: rng.normal(size=5).tolist() for w in [*words[:20], "hot"]}
    buckets = {b: rng.normal(size=5).tolist() for b in range(50) if b % 7}
    buckets[8] = [1.0, None, 2.0]
    v = spark.createDataFrame(list(vocab.items()), "token string, vec array<double>")
    b = spark.createDataFrame(list(buckets.items()), "bucket int, vec array<double>")
    df = spark.createDataFrame(rows, "row_id bigint, tokens array<string>").repartition(3)
    check(spark, em.subword_pool(df, v, b, 50, 5, limit=limit), [(i, t, plain_pool(t, vocab, 5, buckets, 50)) for i, t in rows])


def test_rows_leave_blocks_with_each_number_once(spark):
    """However many blocks the vectors need, a row's partial sums are as long as one vector."""
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([(i, rng.normal(size=7).tolist()) for i in range(200)], "id bigint, vec array<double>")
    entries = spark.createDataFrame([(r, [(int(i), 1 + r % 2) for i in np.sort(rng.choice(200, 50, False))]) for r in range(40)],
                                    "__row bigint, uses array<struct<id: bigint, n: bigint>>")
    table = {r["id"]: np.array(r["vec"]) for r in vectors.collect()}
    for part, slices in ((1, 3), (3, 2), (7, 1)):
        got = pl._block_sums(entries, vectors, 7, part, slices).collect()
        for r in entries.collect():
            own = sorted((g["at"], g["total"], g["weight"]) for g in got if g["__row"] == r["__row"])
            assert [x for _, total, _ in own for x in total] == pytest.approx(sum(table[u["id"]] * u["n"] for u in r["uses"]))
            assert all(weight == [sum(u["n"] for u in r["uses"])] for *_, weight in own)


def test_unknown_words_are_built_in_their_rows(spark, monkeypatch):
    """A vocabulary beyond the limit doesn't make a table of all words that aren't in it."""
    rows, words = rows_and_words(9, 120)
    rows += [(900, ["walking", "walks", "é", "w3", "x"])]
    rng = np.random.default_rng(10)
    vocab = {w: rng.normal(size=5).tolist() for w in [*words[:60], "hot"]}
    buckets = {b: rng.normal(size=5).tolist() for b in range(8)}
    v = spark.createDataFrame(list(vocab.items()), "token string, vec array<double>")
    b = spark.createDataFrame(list(buckets.items()), "bucket int, vec array<double>")
    df = spark.createDataFrame(rows, "row_id bigint, tokens array<string>").repartition(3)
    names, write = [], pl.settle
    monkeypatch.setattr(pl, "settle", lambda d, name="step": names.append(name) or write(d, name))
    check(spark, em.subword_pool(df, v, b, 9, 5, limit=2500), [(i, t, plain_pool(t, vocab, 5, buckets, 9)) for i, t in rows])
    assert "pool-others" in names and "pool-vocabulary" not in names


def test_partitions_do_not_matter(spark):
    rows, words = rows_and_words(5)
    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(w, rng.normal(size=4).tolist()) for w in [*words, "hot"]], "token string, vec array<double>")
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "row_id bigint, tokens array<string>")

    def run(n, limit):
        return {r[0]: r[1] for r in em.mean_pool(df.repartition(n), table, 4, limit=limit).select("row_id", "embedding").collect()}

    assert run(1, pl.HOT_BYTES) == run(9, pl.HOT_BYTES)
    a, b = run(2, 1500), run(7, 1500)
    assert all(a[i] == pytest.approx(b[i]) for i in a)


def test_counts_are_taken_before_the_product(spark):
    """A token that makes up nearly all of a row is one entry."""
    import pyarrow as pa

    words, row, which, count = pl.token_counts(pa.array([["a"] * 10**5 + ["b"], None, ["b", None]]))
    assert [(words[int(w)].as_py(), int(r), int(c)) for r, w, c in zip(row, which, count)] == [("a", 0, 10**5), ("b", 0, 1), ("b", 2, 1)]


@pytest.mark.parametrize("width", [2, 300])
def test_sequences_have_one_null_rule(spark, width):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(12):
        for pos in range(4):
            v = rng.normal(size=width).round(3).tolist()
            if pos == 1:
                v[i % width] = None
            rows.append((i, pos, [1, 1, 0, 1, None][(i + pos) % 5], v[:1] if pos == 3 and i % 4 == 0 else v))
    rows += [(50, 0, 1, [None] * width), (51, 0, 0, [1.0] * width)]
    got = {r["row_id"]: r for r in em.pool_sequences(spark.createDataFrame(rows, "row_id int, pos int, mask int, vec array<double>"), width).collect()}
    by_row = {}
    for r in rows:
        by_row.setdefault(r[0], []).append(r)
    for i, held in by_row.items():
        for d in range(width):
            seen = [r[3][d] for r in held if r[2] and d < len(r[3]) and r[3][d] is not None]
            assert got[i]["mean_vec"][d] == pytest.approx(sum(seen) / len(seen) if seen else 0.0, abs=1e-9)
            assert got[i]["max_vec"][d] == (max(seen) if seen else -1e9)


def test_labels(spark):
    vocab = spark.createDataFrame([("brute", [1.0, 0.0]), ("force", [0.0, 2.0]), ("leak", [4.0, 4.0])], "token string, vec array<double>")
    rows = spark.createDataFrame([(1, ["brute_force", "leak", "leak"]), (2, []), (3, None), (4, ["nothing"])], "row_id int, labels array<string>")
    got = {r["row_id"]: list(r["label_embedding"]) for r in em.embed_labels(rows, vocab, 2).collect()}
    assert got[1] == pytest.approx([8.5 / 3, 9 / 3], rel=1e-6) and got[2] == got[3] == got[4] == [0.0, 0.0]
