"""Operators against brute force on small inputs, including hot keys, copies and every large-data path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import labels as lb
from tracewright.functions import numbers as nu
from tracewright.functions import text as tx
from tracewright.functions import vectors as vc
from tracewright.operators import balance as bl
from tracewright.operators import clustering as cl
from tracewright.operators import embedding as em
from tracewright.operators import metrics as mt
from tracewright.operators import ranking as rk
from tracewright.operators import taxonomy as tn
from tracewright.operators import vector_stats as vs
from tracewright.operators.components import connected_components
from tracewright.operators.joining import lookup_join
from tracewright.operators.neighbors import nearest
from tracewright.session import settle


def frame(spark, x, **more):
    rows = [(int(i), [float(v) for v in r], *[m[i] for m in more.values()]) for i, r in enumerate(x)]
    kinds = "".join(f", {n} {'int' if isinstance(v[0], int) else 'string'}" for n, v in more.items())
    return settle(spark.createDataFrame(rows, "row_id bigint, vec array<double>" + kinds).repartition(4))


def points_with_copies(n=240, d=3, seed=1):
    """A third of the rows are copies of one vector; the rest lie in blobs."""
    r = np.random.default_rng(seed)
    x = np.vstack([r.normal(c, 0.4, (n // 6, d)) for c in (0, 3, 6, 9)])
    return np.vstack([x, np.tile(x[0], (n // 3, 1))])[r.permutation(n // 6 * 4 + n // 3)]


def brute_nearest(x, k, groups=None):
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        ok = [j for j in range(len(x)) if j != i and (groups is None or groups[i] == groups[j])]
        out[i] = sorted(ok, key=lambda j: (d[j], j))[:k]
    return out


@pytest.mark.parametrize("layout", [{}, {"local_bytes": 0}, {"local_bytes": 0, "block_rows": 7}])
def test_nearest(spark, layout):
    x = points_with_copies()
    df = frame(spark, x)
    got = {}
    for r in nearest(df, df, 4, **layout).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.neighbor_id))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == brute_nearest(x, 4)


def test_nearest_by_group_and_other_side(spark):
    x = points_with_copies(120)
    groups = [f"g{i % 3}" for i in range(len(x))]
    df = frame(spark, x, g=groups)
    got = {}
    for r in nearest(df, df, 3, by="g", local_bytes=0, block_rows=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.neighbor_id))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == brute_nearest(x, 3, groups)
    a, b = df.where("row_id < 50"), df.where("row_id >= 50")
    near = {r.query_id: r.neighbor_id for r in nearest(a, b, 1, skip_self=False, local_bytes=0, block_rows=5).collect()}
    for i in range(50):
        d = ((x[50:] - x[i]) ** 2).sum(1)
        assert near[i] == 50 + int(np.flatnonzero(np.isclose(d, d.min(), rtol=0, atol=0))[0])


def brute_dbscan(x, eps, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = d.sum(1) >= m
    label, now = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] == -1:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] == -1:
                    label[j] = now
                    if core[j]:
                        todo += [int(t) for t in np.flatnonzero(d[j]) if label[t] == -1]
            now += 1
    return label


@pytest.mark.parametrize("layout", [{}, {"local_bytes": 0, "block_rows": 9}])
def test_dbscan(spark, layout):
    x = points_with_copies(180, 2)
    df = frame(spark, x)
    got = {r.row_id: r.cluster for r in cl.dbscan(df, "vec", 0.3, 5, fill_noise=False, **layout).collect()}
    want = brute_dbscan(x, 0.3, 5)
    assert [got[i] for i in range(len(x))] == want.tolist()
    assert len(set(want)) > 2
    filled = {r.row_id: r.cluster for r in cl.dbscan(df, "vec", 0.3, 5, **layout).collect()}
    for i in np.flatnonzero(want == -1):
        d = np.where(want >= 0, ((x - x[i]) ** 2).sum(1), np.inf)
        assert filled[i] == want[int(d.argmin())]


@pytest.mark.parametrize("sample_rows", [3, 40])
def test_dbscan_after_a_sample(spark, sample_rows):
    x = points_with_copies(180, 2)
    layout = {"local_bytes": 0, "block_rows": 9, "sample_rows": sample_rows}
    for eps, m in ((0.3, 5), (0.15, 3), (0.05, 2)):  # with border rows, noise and many small clusters
        got = {r.row_id: r.cluster for r in cl.dbscan(frame(spark, x), "vec", eps, m, fill_noise=False, **layout).collect()}
        assert [got[i] for i in range(len(x))] == brute_dbscan(x, eps, m).tolist()


def test_dbscan_of_dense_rows_compares_few_of_them_with_all(spark, monkeypatch):
    x = np.concatenate([np.random.default_rng(7).normal(size=(300, 2)), [[9.0, 9.0], [9.1, 9.0], [5.0, 5.0]]])
    met, pair_blocks = [], cl.bk.pair_blocks
    monkeypatch.setattr(cl.bk, "pair_blocks", lambda left, right, *a, **kw: met.append(left.count()) or pair_blocks(left, right, *a, **kw))
    got = {r.row_id: r.cluster for r in cl.dbscan(frame(spark, x), "vec", 1.5, 3, fill_noise=False, local_bytes=0, block_rows=16, sample_rows=60).collect()}
    assert [got[i] for i in range(len(x))] == brute_dbscan(x, 1.5, 3).tolist()
    assert met and max(met) < 0.2 * len(x)  # all rows before


def test_dbscan_all_noise(spark):
    df = frame(spark, np.arange(12).reshape(6, 2) * 10.0)
    assert {r.cluster for r in cl.dbscan(df, "vec", 0.5, 5).collect()} == {-1}


def test_components(spark):
    r = np.random.default_rng(3)
    star = [(0, i) for i in range(1, 40)]
    chain = [(i, i + 1) for i in range(100, 160)]
    loose = [(int(a) + 200, int(b) + 200) for a, b in r.integers(0, 60, (40, 2)) if a != b]
    edges = spark.createDataFrame(star + chain + loose, "a bigint, b bigint")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v
    for a, b in star + chain + loose:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {v: root(v) for v in list(parent)}


def brute_silhouette(x, y):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        same = (y == y[i]) & (np.arange(len(x)) != i)
        if not same.any():
            s.append(0.0)
            continue
        a, b = d[i][same].mean(), min(d[i][y == c].mean() for c in set(y) if c != y[i])
        s.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(s))


@pytest.mark.parametrize("layout", [{}, {"local_bytes": 0, "block_rows": 11}])
def test_silhouette(spark, layout):
    x = points_with_copies(90, 3)
    y = [int(v) for v in np.random.default_rng(0).integers(0, 3, len(x))]
    y[5] = 9
    df = frame(spark, x, label=y)
    assert cl.silhouette(df, "vec", "label", **layout).first()[0] == pytest.approx(brute_silhouette(x, np.array(y)), abs=1e-6)
    one = df.withColumn("label", F.lit(1))
    assert cl.silhouette(one, "vec", "label").first()[0] == 0.0


def test_lookup_join_hot_keys(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"))
    lookup = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = rows.join(lookup, "k", "left").collect()
    got = lookup_join(rows, lookup, ["k"], "left", limit=0).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 350, "big").otherwise("small").alias("g"))
    a = rk.draw_rank(df.repartition(1), ["g"], ["id"]).collect()
    b = rk.draw_rank(df.repartition(8), ["g"], ["id"]).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    big = sorted(r["rank"] for r in a if r.g == "big")
    assert big == list(range(1, 351))
    folds = rk.stratified_folds(df, "g", ["id"]).groupBy("g", "fold").count().collect()
    assert {(r.g, r["count"]) for r in folds} == {("big", 70), ("small", 30)}
    parts = rk.stratified_split(df, "g", ["id"]).groupBy("g", "part").count().collect()
    assert {(r.g, r.part, r["count"]) for r in parts} == {
        ("big", "train", 280), ("big", "test", 70), ("small", "train", 120), ("small", "test", 30)}


def test_running_totals(spark):
    r = np.random.default_rng(2)
    rows = {(g, float(s)) for g, s in zip(["a"] * 900 + ["b"] * 100, np.round(r.exponential(0.01, 1000), 5))}
    rows = [(g, s, int(r.integers(0, 5))) for g, s in sorted(rows)]
    got = rk.running_totals(spark.createDataFrame(rows, "g string, score double, n bigint"), ["g"], "score", ["n"]).collect()
    for x in got:
        assert x.cum_n == sum(n for g, s, n in rows if g == x.g and s >= x.score)


def cells_frame(spark, pairs):
    return spark.createDataFrame([(i, "c", y, s) for i, (y, s) in enumerate(pairs)], "row_id int, class string, y_true int, score double")


def test_auc_known_value_and_invariance(spark):
    cells = cells_frame(spark, [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3)])
    assert mt.roc_auc(cells).first().auc == pytest.approx(0.875)
    assert mt.roc_auc(cells.withColumn("score", F.exp("score") * 5)).first().auc == pytest.approx(0.875)
    assert mt.roc_auc(cells.withColumn("y_true", F.lit(1))).first().auc == 0.0
    assert mt.average_precision(cells).first().average_precision == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_thresholds(spark):
    cells = cells_frame(spark, [(1, 0.62), (1, 0.7), (0, 0.58), (0, 0.2)])
    best = mt.best_f1_thresholds(cells).first()
    assert (best.threshold, best.f1) == (0.6, 1.0)
    none = mt.best_f1_thresholds(cells.withColumn("y_true", F.lit(0))).first()
    assert (none.threshold, none.f1) == (0.5, 0.0)
    assert mt.youden_thresholds(cells).first().threshold == 0.62


def test_bootstrap(spark):
    cells = cells_frame(spark, [(i % 2, 0.0) for i in range(400)]).withColumn("y_pred", (F.col("row_id") % 4 != 0).cast("int"))
    r = mt.bootstrap_f1(cells).first()
    assert r.low < r.f1 < r.high and r.high - r.low < 0.15
    assert mt.bootstrap_f1(cells.repartition(3)).first() == r


def test_rand_index_and_information(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "t int, c int")
    assert cl.adjusted_rand(rows, "t", "c").first().ari == pytest.approx(0.571428571)
    assert cl.mutual_information(rows, "t", "c").first().nmi == pytest.approx(0.8)
    one = rows.withColumn("t", F.lit(1))
    assert cl.adjusted_rand(one, "t", "c").first().ari == 0.0


def test_standardize_uses_population_deviation(spark):
    df = frame(spark, [[0.0, 5.0], [2.0, 5.0]])
    assert sorted(map(list, (r.scaled for r in vs.standardize(df, "vec").collect()))) == [[-1.0, 0.0], [1.0, 0.0]]


def test_reconstruction_score(spark):
    x = np.random.default_rng(5).normal(size=(60, 5))
    got = {r.row_id: r.score for r in vs.reconstruction_scores(frame(spark, x), "vec", 2).collect()}
    c = x - x.mean(0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    want = ((c - c @ v[:2].T @ v[:2]) ** 2).mean(1)
    assert [got[i] for i in range(60)] == pytest.approx(want.tolist())


def imbalanced(spark):
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(0, 1, (60, 3)), r.normal(2, 1, (20, 3)), r.normal(-2, 1, (7, 3)), [[9.0, 9.0, 9.0]]])
    return x, frame(spark, x, label=[0] * 60 + [1] * 20 + [2] * 7 + [3])


def test_smote_fills_classes_and_stays_on_segments(spark):
    x, df = imbalanced(spark)
    made = bl.smote(df).collect()
    counts = {}
    for r in made:
        counts[r.label] = counts.get(r.label, 0) + 1
        a, b = x[r.seed_id], x[r.neighbor_id] if r.neighbor_id is not None else x[r.seed_id]
        p = np.array(r.vec)
        gap = np.linalg.norm(a - p) + np.linalg.norm(p - b) - np.linalg.norm(a - b)
        assert abs(gap) < 1e-9
    assert counts == {1: 40, 2: 53, 3: 59}
    again = bl.smote(df.repartition(7)).collect()
    assert sorted(map(str, made)) == sorted(map(str, again))


def test_long_runs_of_copies(spark, monkeypatch):
    monkeypatch.setattr(bl, "COPY_RUN", 4)
    _, df = imbalanced(spark)
    copies = bl.random_oversample(df, below=None)
    assert copies.count() == copies.distinct().count() == 40 + 53 + 59


@pytest.mark.parametrize("variant", ["borderline", "adasyn", "kmeans_smote", "smote_enn", "smote_tomek"])
def test_variants_keep_originals_or_clean(spark, variant):
    _, df = imbalanced(spark)
    rows = bl.balance(df, variant).collect()
    old = [r for r in rows if not r.is_synthetic]
    if variant not in bl.CLEANED_VARIANTS:
        assert sorted(r.row_id for r in old) == list(range(88))
    assert len({(r.row_id, r.copy, r.is_synthetic) for r in rows}) == len(rows)


def test_paths(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 0, 0.8, 1, 0.7), (2, 0, 0.9, 0, 0.8, 1, 0.7), (3, 1, 0.4, 0, 0.8, 1, 0.7),
                                  (4, 1, 0.9, 7, 0.5, 1, 0.4)],
                                 "row_id int, c0 int, p0 double, c1 int, p1 double, c2 int, p2 double")
    out = tn.predict_paths(rows, [("c0", "p0"), ("c1", "p1"), ("c2", "p2")])
    got = {r.row_id: (list(r.path), r.final_prediction, round(r.anomaly_score, 6)) for r in out.collect()}
    assert got == {
        1: (["root", "anomaly", "web_attacks", "xss_attacks"], "xss_attacks", 1.0), 2: (["root", "normal"], "normal", 0.0),
        3: (["root"], "unknown", 0.5), 4: (["root", "anomaly", "web_attacks"], "web_attacks", 0.9)}
    paths = [set(v[0]) for v in got.values()]
    pairs = [(a, b) for i, a in enumerate(paths) for b in paths[i + 1:]]
    want = np.mean([len(a & b) / len(a | b) for a, b in pairs])
    assert tn.path_consistency(out).first().path_consistency == pytest.approx(want)


def test_literal_paths_have_two_nodes(spark):
    paths = {r.name: list(r.path) for r in tn.literal_paths(tn.taxonomy_table(spark)).collect()}
    assert paths["xss_attacks"] == ["web_attacks", "xss_attacks"] and paths["root"] == ["root"]


def test_label_expressions(spark):
    texts = ['["A-b ", "a_b", "", null]', '"x"', "null", "not json", "[]", '["C"]']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = [list(r[0]) for r in df.select(lb.labels_from_json(F.col("j"))).collect()]
    assert got == [["a_b"], ["x"], [], [], [], ["c"]]


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("The _x ab1cd 42 " + "y" * 16 + " Été",)], "t string")
    assert list(df.select(tx.tokens(F.col("t"))).first()[0]) == ["the", "ab", "cd", "été"]
    grams = df.select(tx.char_ngrams(F.lit("ab"))).first()[0]
    assert sorted(grams) == sorted(["<ab", "ab>", "<ab>"])


def test_top_attention(spark):
    df = spark.createDataFrame([([9.0, 3.0, 1.0, 2.0],), ([9.0],)], "a array<double>")
    got = [list(r[0]) for r in df.select(vc.top_attention(F.col("a"), 5)).collect()]
    assert got == [[1.0, 2.0, 3.0, 0.0, 0.0], [0.0] * 5]


def test_fixed_decimals_round_like_printf(spark):
    values = [0.48995, 0.0075, 1234.5678, 0.5, 2.675]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(nu.fixed(F.col("v"), 4)).collect()] == [f"{v:.4f}" for v in values]


def test_wide_vectors_give_the_same_results(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(i // 3, i % 3, int(i % 3 != 1 and i > 2), [float(t) for t in r.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, pos int, mask int, vec array<double>")

    def results():
        pooled = sorted(em.pool_sequences(df, 4).collect())
        means = sorted(vs.mean_vector(df, "vec", ["row_id"], 4).collect())
        return [np.array([[*p.first_vec, *p.mean_vec, *p.max_vec] for p in pooled]), np.array([m["mean"] for m in means])]
    narrow = results()
    monkeypatch.setattr(vs, "WIDE", 2)
    for a, b in zip(narrow, results()):
        assert np.allclose(a, b, atol=1e-9)
    assert (narrow[0][0][4:8] == 0).all() and (narrow[0][0][8:] == -1e9).all()


def test_mean_pool_hot_tokens_beyond_broadcast(spark):
    words = ["the"] * 6 + ["rare", "other", "unknown"]
    rows = spark.createDataFrame([(i, words[: 3 + i % 7]) for i in range(60)] + [(99, ["unknown"]), (100, [])],
                                 "row_id bigint, tokens array<string>")
    vocab = spark.createDataFrame([("the", [1.0, 0.0]), ("rare", [0.0, 4.0]), ("other", [2.0, 2.0])], "token string, vec array<double>")
    small = {r.row_id: list(r.embedding) for r in em.mean_pool(rows, vocab, 2).collect()}
    large = {r.row_id: list(r.embedding) for r in em.mean_pool(rows, vocab, 2, limit=0).collect()}
    assert small == large and small[99] == small[100] == [0.0, 0.0]
    assert small[5] == pytest.approx([8 / 8, 6 / 8])


def test_a_row_is_sent_to_few_blocks(spark):
    """Copies of a row grow with the blocks of the other side, so these are wide; all pairs meet once."""
    import pandas as pd

    from tracewright.operators import blocks as bk

    rows = spark.createDataFrame([(0, i, [float(i), 1.0]) for i in range(400)], "grp int, id bigint, vec array<double>")
    one = lambda x, y: pd.DataFrame({"x": [len(x)], "y": [len(y)]})
    got = bk.pair_blocks(rows, rows, one, "x bigint, y bigint", block_rows=4, local_bytes=0).collect()
    assert sum(r["x"] * r["y"] for r in got) == 400 * 400
    assert sum(r["x"] for r in got) <= 400 * 8
    assert [bk.block_count(n, 2048, 32, 8) for n in (1, 5000, 120_000, 720_000, 6_000_000)] == [1, 3, 8, 11, 92]


def test_links_of_a_pair_of_blocks_are_folded():
    import pandas as pd

    from tracewright.operators.clustering import _stars

    got = _stars(pd.DataFrame({"a": [5, 4, 9, 9, 7], "b": [4, 2, 8, 8, 9]}))
    assert sorted(zip(got["a"], got["b"])) == [(4, 2), (5, 2), (8, 7), (9, 7)]
    assert not len(_stars(pd.DataFrame({"a": [], "b": []})))
