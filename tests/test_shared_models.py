"""Models trained in shared passes against plain versions."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tracewright.operators import balance as bl
from tracewright.operators import clustering as cl
from tracewright.operators import isolation as iso
from tracewright.operators import linkage as lk
from tracewright.operators import masked as mk
from tracewright.operators import models as md
from tracewright.operators import multilabel as ml
from tracewright.operators import shared_scan as ss
from tracewright.operators import vector_stats as vs


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, v.tolist() if v is not None else None) for i, v in enumerate(x)], "row_id bigint, vec array<double>")


def blobs(seed, sizes, width=3, spread=0.3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=width) * 10 + rng.normal(size=(n, width)) * spread for n in sizes])


# k-means

def plain_silhouette(x, own):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    out = []
    for i in range(len(x)):
        mine = own == own[i]
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][mine].sum() / (mine.sum() - 1)
        b = min((d[i][own == c].mean() for c in set(own) - {own[i]}), default=None)
        out.append(0.0 if b is None or max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(out))


def test_all_models_in_few_passes(spark):
    x = blobs(1, [60, 50, 40, 30])
    points = ss.prepared(table(spark, x).repartition(4), "vec")
    few, many = ss.fit(points, [4]), ss.fit(points, list(range(2, 21)))
    assert [m.k for m in many.models] == list(range(2, 21)) and few.scans <= 25 and many.scans <= 25
    scores = ss.silhouettes(points, many.models)
    rows = ss.assign(table(spark, x), "vec", {f"k{m.k}": m for m in many.models}).orderBy("row_id").collect()
    for m, s in zip(many.models, scores):
        own = np.array([r[f"k{m.k}"] for r in rows])
        assert (own == ((x[:, None] - m.centres[None]) ** 2).sum(-1).argmin(1)).all()
        assert m.sizes.tolist() == [int((own == c).sum()) for c in range(m.k)]
        assert s == pytest.approx(plain_silhouette(x, own), abs=1e-9)
    assert max(zip(scores, range(2, 21)))[1] == 4
    four = next(m for m in many.models if m.k == 4)
    assert sorted(four.sizes.tolist()) == [30, 40, 50, 60]


def test_centres_are_means_and_layout_does_not_matter(spark):
    x = blobs(2, [80, 20, 20], 5, 1.0)
    a, b = (ss.fit(ss.prepared(table(spark, x).repartition(n), "vec"), [3], starts=3).models[0] for n in (1, 7))
    assert np.allclose(np.sort(a.centres, 0), np.sort(b.centres, 0), atol=1e-6)
    assert np.allclose(a.centres, a.sums / a.sizes[:, None], atol=1e-3)


def test_odd_tables_for_kmeans(spark):
    copies = np.repeat(np.array([[1.0, 2.0], [5.0, 5.0]]), 40, axis=0)
    points = ss.prepared(table(spark, copies), "vec")
    m = ss.fit(points, [5]).models[0]
    assert len(m.centres) == 2 and sorted(m.sizes.tolist()) == [40, 40]
    assert ss.fit(ss.prepared(table(spark, []), "vec"), [2]).models == []
    some = table(spark, [*copies, None])
    labels = cl.kmeans(some, "vec", 2).groupBy("cluster").count().collect()
    assert sorted((str(r[0]), r[1]) for r in labels) == [("0", 40), ("1", 40), ("None", 1)]
    assert cl.kmeans(table(spark, []), "vec", 3).collect() == []


def test_k_search_picks_the_number_of_groups(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(n, 3)) * 0.3 + 10 * np.eye(3)[i] for i, n in enumerate([50, 40, 45])])
    assert cl.best_k(table(spark, x), "vec") == 3
    labels = [r["cluster"] for r in cl.pseudo_labels(table(spark, x), "vec").orderBy("row_id").collect()]
    assert [len(set(labels[a:b])) for a, b in ((0, 50), (50, 90), (90, 135))] == [1, 1, 1] and len(set(labels)) == 3


# isolation forest

def plain_scores(forest, x):
    def walk(node, v, level):
        if forest.left[node] == node:
            return forest.depth[node]
        return walk(forest.left[node] if v[forest.feature[node]] < forest.cut[node] else forest.right[node], v, level + 1)
    c = 2 * (np.log(forest.rows - 1) + 0.5772156649015329) - 2 * (forest.rows - 1) / forest.rows
    return np.array([2 ** (-np.mean([walk(r, v, 0) for r in forest.roots]) / c) for v in x])


def test_isolation_scores_and_planted_outliers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 6))
    x[::150] += 9.0 * np.sign(rng.normal(size=(10, 6)))
    rows = table(spark, [*x, None]).repartition(5)
    forest = iso.fit(rows, "vec")
    assert len(forest.roots) == 100 and forest.rows == 256 and forest.levels == 8
    got = iso.score(rows, "vec", forest).orderBy("row_id").collect()
    mine = np.array([r["outlier_score"] for r in got[:-1]])
    assert got[-1]["outlier_score"] is None
    assert np.allclose(mine[:200], plain_scores(forest, x[:200]))
    assert set(np.argsort(-mine)[:10]) == set(range(0, 1500, 150))
    flagged = iso.flag_outliers(iso.score(rows, "vec", forest), 0.1).where("is_outlier").select("row_id").collect()
    cut = np.sort(-mine)[int(np.ceil(0.1 * 1500)) - 1]
    assert {r[0] for r in flagged} == set(np.flatnonzero(-mine < cut)) and len(flagged) in range(120, 150)


def test_every_leaf_holds_its_rows():
    """Sizes of the leaves of a tree add up: depth = level + mean depth of the rows left."""
    rng = np.random.default_rng(5)
    sample = np.repeat(rng.normal(size=(40, 3)), 3, axis=0)  # copies can't be set apart
    forest = iso.grow(sample, 5, 64, 1)
    scores = forest.scores(sample)
    assert ((scores > 0) & (scores < 1)).all()
    assert np.allclose(scores[0::3], scores[1::3]) and forest.levels == 6


def test_odd_tables_for_forests(spark):
    assert iso.fit(table(spark, []), "vec") is None
    assert [r["outlier_score"] for r in iso.score(table(spark, [np.ones(2)]), "vec", None).collect()] == [None]
    same = table(spark, [np.ones(3)] * 30)
    assert len({r["outlier_score"] for r in iso.score(same, "vec", iso.fit(same, "vec")).collect()}) == 1


# Ward linkage

def plain_ward(x):
    clusters = {i: (1, v) for i, v in enumerate(x)}
    heights = []
    while len(clusters) > 1:
        best = min(((na * nb / (na + nb) * ((a - b) ** 2).sum(), i, j) for (i, (na, a)), (j, (nb, b)) in itertools.combinations(sorted(clusters.items()), 2)))
        d, i, j = best
        (na, a), (nb, b) = clusters.pop(i), clusters.pop(j)
        clusters[i] = (na + nb, (na * a + nb * b) / (na + nb))
        heights.append(np.sqrt(2 * d))
    return np.array(heights)


@pytest.mark.parametrize("layout", [{}, {"local_clusters": 5, "block_rows": 16, "local_bytes": 0}])
def test_ward_heights(spark, layout):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(40, 3)), rng.normal(size=(30, 3)) + 6])
    x = np.concatenate([x, x[:8]])
    merges = lk.ward_merges(table(spark, x).repartition(3), "vec", **layout).collect()
    assert np.allclose(sorted(r["height"] for r in merges), np.sort(plain_ward(x)), atol=1e-7)
    assert len({r["b"] for r in merges}) == len(x) - 1 and all(r["a"] < r["b"] for r in merges)


def test_ward_neighbours_are_exact_and_a_right_block_is_made_ready_once(monkeypatch):
    rng, made = np.random.default_rng(8), []
    monkeypatch.setattr(lk, "stack", lambda column, f=lk.stack: made.append(len(column)) or f(column))
    monkeypatch.setattr(lk, "TILE_COLUMNS", 50)
    for scale, offset, sizes, whole in ((1, 0, 1, False), (1, 0, 9, False), (1e-9, 1e3, 4, False), (1e12, 0, 3, False), (1, 0, 2, True), (0, 5, 1, True)):
        v = rng.normal(size=(230, 6)) * scale + offset
        v = np.round(v * 1.2) if whole else v  # many ties
        v[0] = v[0] + 1e25 * (offset == 0 and scale == 1)  # beyond single precision next to the others
        n, ids = rng.integers(1, sizes + 1, len(v)).astype(float), rng.permutation(500)[:len(v)]
        block = pd.DataFrame({"id": ids, "vec": list(v), "n": n})
        left, right, near = block.iloc[:200], block.iloc[30:], lk._nearest()
        made.clear()
        got = pd.concat([near(left.iloc[i:i + 70], right) for i in range(0, 200, 70)])
        assert made.count(200) == 1
        d = ((v[:200, None] - v[None, 30:]) ** 2).sum(axis=2) * (n[:200, None] * n[None, 30:] / (n[:200, None] + n[None, 30:]))
        d[ids[:200, None] == ids[None, 30:]] = np.inf
        want = [min((d[i, j], ids[30 + j]) for j in np.flatnonzero(d[i] == d[i].min())) for i in range(200)]
        assert np.allclose(got["d"], [w[0] for w in want], rtol=1e-12, atol=0) and (got["nb"].to_numpy() == [w[1] for w in want]).mean() > (0.99 if whole else 0.999)


def test_ward_of_300_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    done = lk.finish(np.arange(300), np.ones(300), x)
    assert np.allclose(sorted(m[2] for m in done), np.sort(lk_heights(x)), atol=1e-8)


def lk_heights(x):
    """Plain Ward with a distance table, one merge at a time."""
    n, mean, heights = np.ones(len(x)), x.copy(), []
    d = ((x[:, None] - x[None]) ** 2).sum(-1) / 2
    np.fill_diagonal(d, np.inf)
    for _ in range(len(x) - 1):
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        heights.append(np.sqrt(2 * d[i, j]))
        mean[i] = (n[i] * mean[i] + n[j] * mean[j]) / (n[i] + n[j])
        n[i] += n[j]
        d[j], d[:, j] = np.inf, np.inf
        new = n[i] * n / (n[i] + n) * ((mean - mean[i]) ** 2).sum(1)
        new[~np.isfinite(d[i])] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
    return np.array(heights)


def test_ward_clusters(spark):
    x = blobs(8, [30, 20, 10])
    rows = table(spark, [*x, None])
    got = [r["cluster"] for r in lk.ward_clusters(rows, "vec", 3).orderBy("row_id").collect()]
    assert got == [0] * 30 + [1] * 20 + [2] * 10 + [None]
    same = table(spark, [np.ones(2)] * 7)
    assert {r["cluster"] for r in lk.ward_clusters(same, "vec", 1).collect()} == {0}
    assert len({r["cluster"] for r in lk.ward_clusters(table(spark, x[:4]), "vec", 9).collect()}) == 4
    assert lk.ward_clusters(table(spark, []), "vec", 2).collect() == []


# classes in shared passes

def labelled(spark, k=4, n=600, width=5, seed=9):
    rng = np.random.default_rng(seed)
    x, w = rng.normal(size=(n, width)) * 2 + 1, rng.normal(size=(k, width))
    y = (rng.random((n, k)) < 1 / (1 + np.exp(-(x @ w.T) / 3))).astype(int)
    y[:, -1] = 1  # one class that all rows have
    y[:, -2] = 0
    return x, y, spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "row_id bigint, vec array<double>, label_vector array<int>")


def test_coefficients_equal_single_fits(spark):
    x, y, rows = labelled(spark)
    points = ml.prepared(rows.repartition(3), "vec", "label_vector", "row_id", "ml-test")
    weights = ml.fit(points, 4, tolerance=1e-9)
    assert weights.constant[2:].tolist() == [0.0, 1.0] and np.isnan(weights.constant[:2]).all()
    for c in range(2):
        data = rows.select(array_to_vector("vec").alias("features"), F.col("label_vector")[c].cast("double").alias("label"))
        one = LogisticRegression(maxIter=1000, tol=1e-12, regParam=1 / len(x), standardization=False).fit(data)
        assert np.allclose(weights.matrix[c], [*one.coefficients, one.intercept], atol=1e-4)


def test_passes_do_not_grow_with_classes(spark):
    x, y, rows = labelled(spark)
    points = ml.prepared(rows, "vec", "label_vector", "row_id", "ml-test")
    again = ml.prepared(rows.withColumn("label_vector", F.flatten(F.array_repeat(F.slice("label_vector", 1, 2), 10))), "vec", "label_vector", "row_id", "ml-test")
    assert ml.fit(again, 20).scans == ml.fit(points, 2).scans


def test_cells_of_classes(spark):
    x, y, rows = labelled(spark)
    got = md.score_classes(rows.where("row_id < 400"), rows.where("row_id >= 400"), list("abcd"))
    assert got.columns == ["row_id", "class", "y_true", "score"]
    by_class = {}
    for r in got.collect():
        by_class.setdefault(r["class"], []).append(r)
    assert all(len(v) == 200 for v in by_class.values()) and {r["score"] for r in by_class["c"]} == {0.0} and {r["score"] for r in by_class["d"]} == {1.0}
    assert all(r["y_true"] == y[r["row_id"], 0] for r in by_class["a"])
    hit = [(r["score"] > 0.5) == bool(r["y_true"]) for r in by_class["a"] + by_class["b"]]
    assert np.mean(hit) > 0.6


# SVM oversampling

def test_ring_is_seeded_along_its_rim(spark):
    """A disc of rare rows inside a ring of common ones: support vectors lie on the rim of the disc, not at its centre."""
    rng = np.random.default_rng(3)
    angle, radius = rng.uniform(0, 2 * np.pi, 150), np.sqrt(rng.uniform(0, 1, 150))
    disc = np.stack([radius * np.cos(angle), radius * np.sin(angle)], 1)
    angle, radius = rng.uniform(0, 2 * np.pi, 500), rng.uniform(1.3, 2, 500)
    ring = np.stack([radius * np.cos(angle), radius * np.sin(angle)], 1)
    rows = table(spark, np.concatenate([disc, ring])).withColumn("label", F.when(F.col("row_id") < 150, 1).otherwise(0))
    scored = {r["row_id"]: r["margin"] for r in bl.margins(rows, "label", gamma=1.0).collect()}
    inside = np.array([scored[i] <= 1 for i in range(150)])
    r = np.linalg.norm(disc, axis=1)
    assert 0 < inside.sum() < 150 and r[inside].mean() > r[~inside].mean() + 0.2
    assert np.mean([scored[i] > 0 for i in range(650)]) > 0.97
    made = bl.svm_smote(rows, gamma=1.0).collect()
    assert len(made) == 350 and {m["seed_id"] for m in made} == set(np.flatnonzero(inside))
    for m in made[::7]:
        a, b, p = disc[m["seed_id"]], disc[m["neighbor_id"]], np.array(m["vec"])
        t = (p - a) @ (b - a) / max((b - a) @ (b - a), 1e-12)
        assert -1e-9 <= t <= 1 + 1e-9 and np.allclose(p, a + t * (b - a))


def test_products_of_fourier_features_stand_for_the_kernel(spark):
    x = np.random.default_rng(4).normal(size=(40, 3))
    f = np.array([r["features"] for r in bl.fourier_features(table(spark, x), 3, 4000, 0.7, 1).orderBy("row_id").collect()])
    want = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(f @ f.T - want).max() < 0.1


# masked reconstruction

def low_rank(seed=1, n=600):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) @ rng.normal(size=(3, 20)) + rng.normal(size=(n, 20)) * 0.05 + 2.0
    bad = np.arange(0, n, 60)
    x[bad] = np.roll(x[bad], 7, axis=1)
    return x, bad


def auc(score, bad):
    order = np.argsort(np.argsort(score))
    pos = np.isin(np.arange(len(score)), bad)
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_masked_errors_find_rows_that_break_the_pattern(spark):
    x, bad = low_rank()
    rows = table(spark, [*x, None])
    basis = mk.fit(rows.repartition(4), "vec", 3)
    got = mk.score(rows, "vec", basis).orderBy("row_id").collect()
    assert got[-1]["score"] is None
    mine = np.array([r["score"] for r in got[:-1]])
    pca = {r["row_id"]: r["score"] for r in vs.reconstruction_scores(table(spark, x), "vec", 3).collect()}
    assert set(np.argsort(-mine)[:10]) == set(bad) and auc(mine, bad) >= auc(np.array([pca[i] for i in range(600)]), bad)
    again = {r["row_id"]: r["score"] for r in mk.score(rows.repartition(7), "vec", mk.fit(rows.repartition(1), "vec", 3)).collect()}
    assert np.allclose(mine, [again[i] for i in range(600)])


def test_masked_errors_equal_a_plain_version():
    x, _ = low_rank(2, 40)
    rng = np.random.default_rng(3)
    basis = mk.Basis(x.mean(axis=0), rng.normal(size=(20, 3)), 0.1)
    hidden = mk.hidden_entries(np.arange(40), 20, 0.15, 5)
    assert (hidden.sum(axis=1) == 3).all() and len({h.tobytes() for h in hidden}) > 30
    z = basis.codes(x - basis.mean, 1 - hidden)
    for i in range(40):
        seen = hidden[i] == 0
        b = basis.matrix[seen]
        assert np.allclose(z[i], np.linalg.solve(b.T @ b + 0.1 * np.eye(3), b.T @ (x[i] - basis.mean)[seen]))


def test_masked_odd_tables(spark):
    assert mk.fit(table(spark, []), "vec") is None
    x, _ = low_rank(4, 60)
    lists = [v.tolist() for v in x]
    lists[3][2] = None
    lists[5] = lists[5][:10]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "row_id bigint, vec array<double>")
    got = mk.score(rows, "vec", mk.fit(rows, "vec", 3)).collect()
    assert len(got) == 60 and all(r["score"] is not None and np.isfinite(r["score"]) for r in got)


def test_silhouettes_from_labels_need_no_copies_of_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5)) + 3 * rng.integers(0, 3, 300)[:, None]
    a, b, alone = rng.integers(0, 4, 300), rng.integers(-2, 1, 300) * 10**10, np.zeros(300, int)
    b[7] = 5  # a row alone in its cluster
    rows = [(i, x[i].tolist(), int(a[i]), None if i % 50 == 3 else int(b[i]), int(alone[i]), None) for i in range(300)] + [(300, None, 1, 1, 0, None)]
    df = spark.createDataFrame(rows, "row_id int, vec array<double>, a int, b bigint, alone int, nothing int")

    def brute(keep, label):
        x2, label = x[keep], label[keep]
        d = ((x2[:, None] - x2[None]) ** 2).sum(2)
        score = []
        for i, own in enumerate(label):
            mine = label == own
            if mine.sum() == 1 or mine.all():
                score.append(0.0)
                continue
            near = d[i][mine].sum() / (mine.sum() - 1)
            far = min(d[i][label == c].mean() for c in set(label.tolist()) - {own})
            score.append((far - near) / max(far, near))
        return np.mean(score)

    every = np.ones(300, bool)
    want = {"a": brute(every, a), "b": brute(np.arange(300) % 50 != 3, b), "alone": 0.0}
    for parts in (1, 7):
        out = ss.labelled_silhouettes(df.repartition(parts), "vec", ["a", "b", "alone", "nothing"])
        got = {r["labels"]: r["silhouette"] for r in out.collect()}
        assert set(got) == set(want) and all(abs(got[c] - want[c]) < 1e-9 for c in want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # what a row is compared with comes to it in the task
