"""Plain versions of the operators and a small table with every odd case."""

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, shard string, taken string, `key` string, src string, score string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_documents(spark, seed=1, count=60):
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, and columns with clashing names."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(3, 120)) for _ in range(count)]
    texts += [texts[0], texts[0], texts[1].replace(texts[1].split()[2], "zz", 1), None, "", " \t\n", "x", prose(rng, 6000), "a" * 3000, "12 34 56", "é" * 300]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 7 else None, len(t or ""), "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[2], None, None, None, *[None] * 6), (None, "only here " * 9, None, None, None, *[None] * 6)]
    return spark.createDataFrame(rows, DOCS)


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups_of(sets, percent):
    """Smallest key of each group that links make; sets: key -> set."""
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def repeated_bytes(texts, width=200):
    """Removed marks of each text."""
    seen = Counter(t[p:p + width] for t in texts for p in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if seen[t[p:p + width]] > 1:
                gone[p:p + width] = b"\1" * width
        out.append(gone)
    return out
