"""Inner steps of the operators on training text, against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import graph_search, jaccard, language_model, leakage, packing


def test_sums_of_runs_equal_those_of_a_loop():
    rng = np.random.default_rng(3)
    rows = rng.integers(-9, 9, (50, 7)).astype(np.float32)
    for sizes in ([1], [3, 1, 2], [1, 40, 1, 2000, 33, 32, 64, 65], rng.integers(1, 90, 60).tolist()):
        at = rng.integers(0, 50, sum(sizes))
        begin = np.cumsum(sizes) - sizes
        want = np.stack([rows[at[b:b + n]].sum(axis=0) for b, n in zip(begin, sizes)])
        assert np.array_equal(leakage._run_sums(rows, at, begin), want)


def test_a_round_fetches_vectors_in_proportion_to_their_number(spark):
    rng = np.random.default_rng(5)
    made = []
    for n in (3000, 15000):
        x = rng.normal(size=(n, 4)).astype(np.float32)
        nodes = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "node bigint, vec binary")
        s = graph_search.Settings(block=512, cell=128, degree=8, trees=2)
        place = graph_search._places(graph_search._cells(nodes, 4, n, s), n, s)
        sizes = [r["count"] for r in place.groupBy("block").count().collect()]
        assert sum(sizes) == n and max(sizes) <= 4 * s.block
        made.append(len(sizes))
    assert made[0] >= 4 and made[1] <= 2.5 * made[0]
    big = graph_search.Settings()
    assert [big.round_blocks(n) for n in (10_000, 50_000, 8_192_000)] == [8, 8, 1000]
    assert [big.query_parts(n) for n in (1, 103, 513, 12_800)] == [1, 7, 8, 100]


def test_binary_columns_are_read_where_they_lie():
    import pyarrow as pa

    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    column = pa.array([v.tobytes() for v in x], pa.binary())
    for c in (column, pa.chunked_array([column.slice(0, 1), column.slice(1)])):
        assert np.array_equal(graph_search._stack(c, np.float32, 3), x)
    assert np.array_equal(graph_search._stack(column.slice(2), np.float32, 3), x[2:])
    assert graph_search._stack(column.slice(4), np.float32, 3).shape == (0, 3)
    assert len(graph_search._stack(pa.array([b""], pa.binary()), np.float32)) == 0


def test_slab_keys_come_back_whole_and_take_six_bytes():
    rng = np.random.default_rng(7)
    rule = jaccard.Rule()
    for n in (1, 2, 40, 700):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        keys, info = jaccard.slab_keys(s, rule, rule.edges(2000))
        raw = jaccard.packed_keys(keys, info)
        back, again = jaccard.unpacked_keys(raw)
        assert np.array_equal(back, keys.view(np.int64)) and np.array_equal(again, info)
        assert (back >= 0).all() and (back < 1 << 48).all() and len(raw) < 6 * len(keys) + 16 * len(keys) + 9
    assert len(raw) < 7 * len(keys)


def test_remembered_words_give_the_ids_of_fresh_ones(monkeypatch):
    monkeypatch.setattr(language_model, "REMEMBERED", 60)
    rng, memory, asked = np.random.default_rng(9), language_model.Memory(), 0
    lists = {h: rng.integers(0, 99, h % 4).tolist() for h in range(200)}
    for top in (40, 40, 60, 200, 50):
        hashes = np.unique(rng.integers(0, top, 45)).astype(np.uint64)

        def encode(new):
            nonlocal asked
            asked += len(new)
            some = [lists[int(h)] for h in hashes[new]]
            return np.array([x for one in some for x in one], np.int64), np.array([len(x) for x in some], np.int64)

        before = asked
        flat, count = memory.look_up(hashes, encode)
        assert flat.tolist() == [x for h in hashes.tolist() for x in lists[h]] and count.tolist() == [len(lists[h]) for h in hashes.tolist()]
        assert len(memory.hashes) <= 60 + len(hashes) and (np.diff(memory.hashes.astype(np.int64)) > 0).all()
        if top == 40 and before:
            assert asked - before < len(hashes)
    rows = rng.integers(0, 5, 30)
    values = rng.integers(-4, 4, (30, 3)).astype(np.float32)
    want = np.zeros((6, 3), np.float32)
    np.add.at(want, rows, values)
    assert np.array_equal(language_model.row_sums(rows, values, 6), want)


def test_chunks_of_both_sorts_are_looked_up_in_place(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "KNOWN", 6)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    want = lambda c: np.array(encoder.tokenizer.encode(c.decode(), add_special_tokens=False).ids, np.uint32).tobytes()
    chunks = [" über".encode(), b"plain", b" word", " né".encode(), b"'s", b" ", b"x1", "\u00a0y".encode(), b" end."]
    for some in (chunks, chunks[::-1], chunks[2:5], [b" ", "ß".encode()], [], chunks):
        assert encoder.look_up(some) == [want(c) for c in some]
    assert encoder.encode([b"a"]) == [want(b"a")] and encoder.encode(["é".encode()]) == [want("é".encode())]
    asked = []
    monkeypatch.setattr(encoder, "encode", lambda new: asked.append(new) or [want(c) for c in new])
    assert encoder.look_up([b" end.", b"fresh"]) == [want(b" end."), want(b"fresh")] and asked == [[b"fresh"]]


def test_the_class_layer_trains_and_scores_as_written_out(monkeypatch):
    # The steps in pieces, the sums without the largest taken off first, and the same where numbers leave the range of floats.
    rng = np.random.default_rng(4)
    docs, end = [rng.integers(0, 60, n) for n in (0, 3, 40, 700, 5000)], 60
    counts = np.bincount(np.concatenate(docs), minlength=61)
    flat, offsets = np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    inputs, targets, _ = language_model.stream(flat, offsets, end)

    def trained(scale):
        net = language_model.new_network(counts, np.arange(61) % language_model.CLASSES, np.random.default_rng(2))
        net.out *= scale
        language_model.fit(net, flat, offsets, end, 2, np.random.default_rng(3), 0.004)
        return net

    net = trained(np.float32(1))
    whole = net.log_probability(inputs, targets, net.tables())
    assert np.allclose(whole, net.log_probability(inputs, targets, net.tables(), block=3), atol=1e-4)
    monkeypatch.setattr(language_model, "_in_range", lambda total: False)
    careful = trained(np.float32(1))
    for name in net.PARAMETERS:
        assert np.allclose(getattr(net, name), getattr(careful, name), atol=2e-3)
    assert np.allclose(whole, net.log_probability(inputs, targets, net.tables()), atol=1e-4)
    monkeypatch.undo()
    wild = trained(np.float32(400))  # exponents in the hundreds
    assert all(np.isfinite(getattr(wild, name)).all() for name in net.PARAMETERS)
    score = wild.log_probability(inputs, targets, wild.tables())
    assert np.isfinite(score).all() and (score[targets < 0] == 0).all()


def test_different_numbers_come_as_from_unique():
    numbers = np.random.default_rng(6).integers(0, 2 ** 64, 50, dtype=np.uint64)[np.random.default_rng(7).integers(0, 50, 400)]
    for some in (numbers, numbers.view(np.int64), numbers[:0]):
        want = np.unique(some, return_index=True, return_inverse=True)
        assert all(np.array_equal(a, b) for a, b in zip(language_model.different(some), want))


def test_a_step_of_training_holds_only_a_piece_of_the_class_layer():
    import tracemalloc

    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 60, 4000)]
    net = language_model.new_network(np.bincount(docs[0], minlength=61), np.arange(61), np.random.default_rng(2))
    made = language_model.class_powers(np.ones((8, 3), np.float32), np.ones((3, language_model.CLASSES), np.float32), place := np.empty((16, language_model.CLASSES), np.float32), False)
    assert np.shares_memory(made, place) and np.allclose(made, np.exp(3))
    tracemalloc.start()
    net.log_probability(*language_model.stream(docs[0], np.array([0, 4000]), 60)[:2], net.tables())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 128 * language_model.HALF * language_model.CLASSES * 4


def test_ids_to_pack_travel_as_bytes(spark):
    import public_tokenizers
    import pyarrow as pa

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    texts = {1: "Some words, and some words again.", 2: None, 3: "", 4: "über x1  y " * 30}
    rows = packing.tokenise(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(2), definition, ["doc_id"])
    assert rows.schema["__ids"].dataType.simpleString() == "binary"  # arrays of numbers are copied one by one
    plain = packing.Encoder(definition).tokenizer
    # Ids take two bytes unless one, here that of the end, doesn't fit.
    wide = packing.tokenise(rows.select("doc_id").withColumn("text", F.lit("a b")), definition, ["doc_id"], end=70_000)
    assert all(np.frombuffer(r["__ids"], "<u4")[-1] == 70_000 and len(r["__ids"]) == 4 * r["__n"] for r in wide.collect())
    docs = rows.select("doc_id").withColumn("text", F.lit("a b"))
    ends = packing.pack(docs, definition, end=70_000).collect()
    assert sum(list(np.frombuffer(r["ids"], "<u4")).count(70_000) for r in ends) == 4 and all(len(r["ids"]) == 4 * r["length"] for r in ends)
    for r in rows.collect():
        ids = np.frombuffer(r["__ids"], "<u2")
        assert ids.tolist() == [*plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, packing.END] and r["__n"] == len(ids)
    values = [b"abc", b"", b"defg", b"h"]
    for column in (pa.array(values), pa.array(values)[1:], pa.array(values, pa.large_binary())[2:3], pa.array(values)[:0]):
        raw, begin = packing.binary_bytes(column)
        assert [raw[a:a + len(x)].tobytes() for a, x in zip(begin.tolist(), column.to_pylist())] == column.to_pylist() and len(begin) == len(column) + 1
    assert packing.binary(np.frombuffer(b"abcdefgh", np.uint8), np.array([0, 3, 3, 8])).to_pylist() == [b"abc", b"", b"defgh"]
