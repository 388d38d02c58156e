"""Lexical search, packing and periodic runs against plain versions."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from tests.llm.helpers import DOCS, odd_documents, prose, words
from tracewright.llm import lexical_search, packing, periodic_runs
from tracewright.llm.queries import QUERIES, with_periods

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return odd_documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# lexical search

def plain_search(docs, items, k=10):
    sets = [(i, Counter(TERM.findall((t or "").translate(AZ)))) for i, t in docs]
    total, length = sum(1 for _, c in sets if c), sum(sum(c.values()) for _, c in sets)
    df = Counter(t for _, c in sets for t in c)
    out = []
    for item, text in items:
        wanted, scores = Counter(TERM.findall((text or "").translate(AZ))), []
        for i, c in sets:
            m = 25 + (75 * sum(c.values()) * total) // length if c else 0
            s = sum(r * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in wanted.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, e[3], -e[0]) for rank, e in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "The quick BROWN fox, fox!"), (2, None), (3, ""), (4, "É é à la carte"), (4, "ab cd ef"), (None, "x only here"), (7, "unseen-words qqqq")]


def search_rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_search_odd_tables(spark, docs, none, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = ITEMS + [(100 + i, t) for i, (_, t) in enumerate(rows) if t][:30]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = plain_search(rows, items)
    assert search_rows(lexical_search.search(docs, table)) == want
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 500)  # several blocks of items
    assert search_rows(lexical_search.search(docs.repartition(5), table)) == want
    assert lexical_search.search(none, table).collect() == [] and lexical_search.search(docs, table.limit(0)).collect() == []


def test_search_ties_and_text_ids(spark):
    rows = [(f"d{i:03d}", "same words here" if i % 3 else f"same other {i}") for i in range(90)] + [(None, "same words here")]
    table = spark.createDataFrame(rows, "doc_id string, text string").repartition(6)
    got = lexical_search.search(table, spark.createDataFrame([(1, "words here"), (2, "89 30")], "item_id bigint, text string")).collect()
    best = sorted([r for r in got if r["item_id"] == 1], key=lambda r: r["rank"])
    assert [r["doc_id"] for r in best] == [f"d{i:03d}" for i in range(90) if i % 3][:10] and [r["rank"] for r in best] == list(range(1, 11))
    assert [r["doc_id"] for r in got if r["item_id"] == 2] == ["d030"]


def test_search_limits_accumulators():
    """Common words behind the cut open no accumulators, and the result stays that of a full count."""
    rng = np.random.default_rng(3)
    n = 5000
    entries = [{"term": t, "tf": 1, "df": d} for t, d in enumerate([12, 15, 20, 3000, 4000, 4500])]

    block = lexical_search.Block([{"item": 0, "entries": entries}], n, n * 50, 10)
    has = [sorted(rng.choice(12 if i < 3 else n, e["df"] if i >= 3 else 12, replace=False)) for i, e in enumerate(entries)]
    sets = [set(h) for h in has]
    per = [[t for t in range(6) if d in sets[t]] for d in range(n)]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in per])])
    terms, tfs = np.array([t for p in per for t in p]), np.ones(edges[-1], np.int64)
    search = lexical_search.Search(block)
    first, doc, share = search.postings(np.full(n, 50), edges, terms, tfs)
    top = np.array([share[first[i]:first[i + 1]].max() for i in range(6)])
    score = np.zeros(n, np.int64)
    found = search.one(*block.lists[0], first, doc, share, top, score, 1)
    full = np.zeros(n, np.int64)
    for w, c in zip(*block.lists[0]):
        full[doc[first[w]:first[w + 1]]] += c * share[first[w]:first[w + 1]]
    assert np.count_nonzero(score) <= 12 < np.count_nonzero(full)
    best = np.sort(full)[-10:]
    assert sorted(full[found])[-10:] == best.tolist() and (score[found] == full[found]).all()


# packing

@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


@lru_cache(1)
def tokenizer(definition):
    t = Tokenizer.from_str(definition)
    t.encode_special_tokens = True
    return t


def direct(definition, text):
    return tokenizer(definition).encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_are_those_of_whole_texts(definition):
    import pyarrow as pa

    from tracewright.llm.common import text_arrays

    rng = random.Random(9)
    signs = ["a", "b", "don't", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "﻿", "é", "ж", "中", "😀", "7", "!", "<|endoftext|>", "\x7f", "\x00", "'s"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", prose(rng, 3000), "a" * 5000, " " * 700]
    encoder = packing.Encoder(definition)
    for _ in range(2):  # the second time from what is remembered
        ids, edges = encoder.ids(*text_arrays(pa.array(texts)), 1)
        for i, t in enumerate(texts):
            assert ids[edges[i]:edges[i + 1]].tolist() == direct(definition, t), repr(t)


@pytest.mark.parametrize("length", [7, 2048])
def test_pieces_tile_texts_and_sequences(spark, docs, none, definition, length, monkeypatch):
    monkeypatch.setattr(packing, "PARTS", 2)
    rows = docs.withColumn("mark", F.monotonically_increasing_id()).repartition(7, "mark").cache()
    pieces = packing.pack(rows, definition, ["doc_id", "mark"], length).cache()
    texts = {r["mark"]: direct(definition, r["text"]) for r in rows.collect()}
    total, by_text, by_sequence = sum(map(len, texts.values())), {}, {}
    for r in pieces.collect():
        ids = list(struct.unpack(f"<{r['length']}I", r["ids"]))
        assert r["length"] > 0 and r["doc_tokens"] == len(texts[r["mark"]]) and ids == texts[r["mark"]][r["start"]:r["start"] + r["length"]]
        by_text.setdefault(r["mark"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], ids))
    for mark, ids in texts.items():
        at = 0
        for start, n in sorted(by_text[mark]):
            assert start == at
            at += n
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(-(-total // length)))
    for s, found in by_sequence.items():
        at = 0
        for offset, n, _ in sorted(found):
            assert offset == at
            at += n
        assert at == (length if s < total // length else total % length)
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces, length).collect()}
    assert sorted(whole) == sorted(by_sequence)
    for s, found in by_sequence.items():
        assert list(struct.unpack(f"<{len(whole[s]['ids']) // 4}I", whole[s]["ids"])) == [i for f in sorted(found) for i in f[2]]
        assert list(whole[s]["lengths"]) == [f[1] for f in sorted(found)]
    assert packing.pack(none, definition).count() == 0


def test_registered_packing(spark, definition):
    got = QUERIES["op12_packing"](spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len({r["doc_id"] for r in got}) == len(texts)
    for r in got[::5]:
        ids = direct(definition, texts[r["doc_id"]])[r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r["ids_crc32"]
    assert sum(r["length"] for r in got) == 2048 * max(r["sequence_id"] for r in got) + max(r["offset"] + r["length"] for r in got if r["sequence_id"] == max(x["sequence_id"] for x in got))


# periodic runs

def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                s = w[i:j + q]
                if not any(q % r == 0 and all(s[k] == s[k + r] for k in range(len(s) - r)) for r in range(1, q)):
                    out.append((i, j - i + q, q))
            i = j
    return sorted(out, key=lambda t: (t[0], t[2]))


def plain_collapse(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def periodic_text(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return " ".join(rng.choice("ab") for _ in range(rng.randrange(300)))
    if kind == 1:
        w = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 400))]
        a = rng.randrange(len(w))
        p = 1 + (len(w) - a) // rng.randrange(3, 11)
        return " \n".join(w[a + (i - a) % p] if i >= a else c for i, c in enumerate(w))
    if kind == 2:
        out = []
        for _ in range(rng.randrange(1, 6)):
            b = [rng.choice("abc") for _ in range(rng.randrange(1, 40))] * rng.randrange(1, 4)
            out += b * rng.randrange(1, 7)
        return "\t".join(out)
    if kind == 3:
        x = ["a"]
        for _ in range(9):
            x = x + (["b" if c == "a" else "a" for c in x] if rng.random() < .7 else x)
        return " ".join(x)
    x, y = ["a"], ["a", "b"]  # many overlapping runs of different periods
    for _ in range(10):
        x, y = y, y + x
    return " ".join(y)


def test_runs(spark):
    rng = random.Random(5)
    texts = [periodic_text(rng) for _ in range(120)] + [None, "", "  ", "a", "a a a a a a", "a a a a a", " é é é é é é é ", "A a A a A a A a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r for r in periodic_runs.find_runs(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want = plain_runs(w)
        assert [tuple(r) for r in got[i]["runs"]] == want, t
        assert got[i]["n_words"] == len(w) and got[i]["collapsed"] == plain_collapse(w, want)


def test_runs_of_long_text(spark):
    rng = random.Random(2)
    block = [f"w{rng.randrange(50)}" for _ in range(4001)]
    w = [f"u{i}" for i in range(500)] + block * 5 + block[:17] + ["end"] + ["x"] * 9
    row = periodic_runs.find_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id bigint, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(500, 4001 * 5 + 17, 4001), (len(w) - 9, 9, 1)]


def test_synchronising_sets_are_consistent_and_dense():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 3, 400), np.tile(rng.integers(0, 9, 30), 8), rng.integers(0, 3, 200)])
    for scale in (8, 16):
        names, width = x.astype(np.int64), 1
        while width < scale:
            names, width = periodic_runs._double(names, width), 2 * width
        s = set(periodic_runs.synchronising(names, scale, np.zeros(len(x), bool)).tolist())
        seen = {}
        for i in range(len(x) - 2 * scale + 1):
            assert seen.setdefault(x[i:i + 2 * scale].tobytes(), i in s) == (i in s)
        assert all(s & set(range(i, i + scale)) for i in range(len(x) - 3 * scale))


def test_runs_odd_tables(docs, none):
    got = periodic_runs.find_runs(docs, ["doc_id", "key", "source"]).collect()
    assert len(got) == docs.count() and got[0].asDict().keys() == {"doc_id", "key", "source", "n_words", "runs", "collapsed"}
    assert periodic_runs.find_runs(none).collect() == []


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_registered_runs(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, DATA).collect()}
    assert sorted(got) == sorted(texts)
    planted = 0
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else x for k, x in enumerate(w)]
            planted += 1
        runs, r = plain_runs(w) if len(w) < 1500 else None, got[i]
        if runs is None:
            continue
        best = None
        for x in runs:
            if best is None or x[1] * best[2] > best[1] * x[2]:
                best = x
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None)) and r["n_runs"] == len(runs)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)) and r["collapsed_sha256"] == sha(plain_collapse(w, runs))
    assert planted > 5


def test_planted_periods_of_odd_ids(spark, docs):
    rows = docs.select("doc_id", "text")
    got = Counter((r["doc_id"], tuple(words(r["text"]))) for r in with_periods(rows).collect())
    assert sum(got.values()) == rows.count()
    left = [r for r in rows.collect() if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 10]
    assert not Counter((r["doc_id"], tuple(words(r["text"]))) for r in left) - got
