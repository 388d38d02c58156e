"""Edges of joins, means, quantiles, tests and trees."""

import os

import pytest
from pyspark.sql import functions as F

from tracewright.operators import metrics as mt
from tracewright.operators import vector_stats as vs
from tracewright.operators.joining import lookup_join, measured_bytes
from tracewright.operators.neighbors import nearest
from tracewright.operators.ranking import exact_quantile, stratified_split
from tracewright.session import settle
from tracewright.sources import logs as lg


def test_copies_are_their_own_neighbours_in_both_call_forms(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "row_id bigint, vec array<double>")
    want = {(1, 1), (2, 1), (3, 3)}
    for base in (rows, rows.select("*")):
        got = nearest(rows, base, 1, skip_self=False).collect()
        assert {(r["query_id"], r["neighbor_id"]) for r in got} == want


@pytest.mark.parametrize("width", [2, 300])
def test_mean_leaves_out_null_entries_at_every_width(spark, width):
    rows = [(1, [float(i) for i in range(width)]), (1, [None] + [4.0] * (width - 1)), (1, [2.0]), (2, [None] * width)]
    got = {r["g"]: r["mean"] for r in vs.mean_vector(spark.createDataFrame(rows, "g int, v array<double>"), "v", ["g"], width).collect()}
    assert got[1][0] == pytest.approx(1.0) and got[1][1] == pytest.approx(2.5) and got[1][-1] == pytest.approx((width - 1 + 4) / 2)
    assert got[2] == [None] * width


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.95, 1.0])
def test_exact_quantile(spark, share):
    import math

    values = [((i * 7919) % 30011) / 7 for i in range(30000)] + [5.0] * 3000
    rows = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)] + [(0, None)], "g int, v double").repartition(7)
    got = {r["g"]: r["quantile"] for r in exact_quantile(rows, "v", share, ["g"]).collect()}
    for g in (0, 1):
        mine = sorted(v for i, v in enumerate(values) if i % 2 == g)
        assert got[g] == mine[max(1, math.ceil(len(mine) * share)) - 1]
    assert exact_quantile(rows, "v", share).first()["quantile"] == sorted(values)[max(1, math.ceil(len(values) * share)) - 1]


def test_p_values_of_students_t(spark):
    known = [(12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (2.776, 4, 0.05), (2.571, 5, 0.05), (3.169, 10, 0.01), (2.779, 26, 0.01), (0.0, 4, 1.0), (-2.776, 4, 0.05)]
    rows = spark.createDataFrame(known, "t double, df int, p double").withColumn("got", mt.t_p_value(F.col("t"), F.col("df"))).collect()
    for r in rows:
        assert r["got"] == pytest.approx(r["p"], abs=2e-4)


def test_small_lookups_leave_the_large_side_in_place(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        rows = settle(spark.range(5000).select((F.col("id") % 7).cast("string").alias("class"), F.col("id").alias("row_id"), (F.col("id") / 5000).alias("score")), "rows")
        cuts = rows.groupBy("class").agg(F.avg("score").alias("threshold"))
        for out in (mt.apply_thresholds(rows, cuts), stratified_split(rows, "class", ["row_id"])):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_long_texts_count_in_the_size_of_a_lookup(spark):
    rows = settle(spark.createDataFrame([(1, "x" * 100_000)], "k int, v string"), "long")
    assert measured_bytes(rows, 64) >= 100_000
    joined = lookup_join(spark.range(3).select(F.col("id").cast("int").alias("k")), rows, ["k"], "left", limit=1000)
    assert sorted((r["k"], len(r["v"] or "")) for r in joined.collect()) == [(0, 0), (1, 100_000), (2, 0)]


def test_trees_with_hidden_names(spark, tmp_path):
    def write(path, text):
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_text(text)

    write("a/x.log", "one\n\ntwo\n")
    write("a/_d/z.log", "three\n")
    write("a/_d/.e/y.log", "four\n")
    write("a/.skip.log", "never\n")
    write("a/_SUCCESS", "")
    got = sorted((r["rel_path"], r["line_no"], r["value"]) for r in lg.read_log_lines(spark, str(tmp_path)).collect())
    assert got == [("a/_d/.e/y.log", 1, "four"), ("a/_d/z.log", 1, "three"), ("a/x.log", 1, "one"), ("a/x.log", 3, "two")]
    assert sorted(r["rel_path"] for r in lg.list_files(spark, str(tmp_path)).collect()) == ["a/_d/.e/y.log", "a/_d/z.log", "a/x.log"]
    write("a/b/_y.log", "lost\n")
    with pytest.raises(ValueError, match="_y.log"):
        lg.read_log_lines(spark, str(tmp_path))


def test_registered_models_have_the_operators_sizes(spark, monkeypatch):
    """Networks, forests, folds and vectors of the registered queries are as large as the operators' defaults."""
    import inspect

    from catalog import QUERIES
    from tests.conftest import DATA
    from tracewright.operators import embedding, models, taxonomy

    class Called(Exception):
        pass

    def sizes(module, name, query):
        signature = inspect.signature(getattr(module, name))

        def call(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            raise Called(bound.arguments)

        monkeypatch.setattr(module, name, call)
        with pytest.raises(Called) as caught:
            QUERIES[query](spark, DATA)
        monkeypatch.undo()
        return caught.value.args[0]

    paths = sizes(taxonomy, "fit_predict", "h05_h09_trained_paths")
    assert (paths["hidden"], paths["epochs"]) == ((256, 128, 64), 50)
    assert sizes(models, "forest_evaluation", "v03_forest_detection")["trees"] == 100
    folds = sizes(models, "cross_validate", "v02_a17_cross_validation")
    assert (folds["k"], folds["trees"]) == (5, 100)
    for name, query in (("mean_pool", "f02_j04_mean_pool"), ("subword_pool", "f04_subword_pool")):
        pooled = sizes(embedding, name, query)
        assert pooled["width"] == 300 and len(pooled["vocab"].select("vec").first()["vec"]) == 300


def test_the_reach_of_long_rows_keeps_all_neighbours():
    import numpy as np
    import pandas as pd

    from tracewright.operators import neighbors as nb

    rng = np.random.default_rng(4)
    d2 = rng.integers(0, 500, (40, 3001)).astype(float)  # with ties
    for k in (1, 4, 11):
        exact = np.partition(d2, k - 1, axis=1)[:, k - 1]
        reach = nb._reach_of_rows(d2, k)
        assert (reach >= exact).all() and ((d2 <= reach[:, None]).sum(1) >= k).all()
        assert (nb._reach_of_rows(d2[:, :k], k) == d2[:, :k].max(1)).all()
    side = lambda n, first: pd.DataFrame({"grp": 0, "id": np.arange(n) + first, "vec": list(rng.normal(size=(n, 5))), "ids": [np.array([i + first]) for i in range(n)]})
    x, sides, top = side(30, 0), [side(2000, 100), side(1500, 5000)], nb._top_of_block(4)
    for y in (*sides, sides[0]):  # what is kept of one right side isn't used for another
        got = top(x, y)
        a, b = np.stack(x["vec"]), np.stack(y["vec"])
        want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
        assert all(np.array_equal(ids, y["id"].to_numpy()[np.argsort(w, kind="stable")[:4]]) for ids, w in zip(got["ids"], want))


@pytest.mark.parametrize("shift", [0.0, 50.0])  # cells rule out nothing, or most
def test_rows_against_themselves_send_half_the_copies(spark, monkeypatch, shift):
    import numpy as np

    from tracewright.operators import blocks as bk

    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 12)) + shift * rng.integers(0, 3, 400)[:, None]
    x[300:330] = x[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, vec array<double>")
    monkeypatch.setattr(bk, "WIDE", 2)
    monkeypatch.setattr(bk, "LEAST_PAIRS", 1)
    got = {(r["query_id"], r["rank"]): r["neighbor_id"] for r in nearest(rows, rows, 3, block_rows=20, local_bytes=0).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(400), d.shape), np.round(d, 9)), axis=1)[:, :3]
    assert got == {(i, r + 1): int(want[i, r]) for i in range(400) for r in range(3)}
    seen = spark.sparkContext.accumulator(0)

    def fn(a, b):
        seen.add(len(a) * len(b))
        return a[["grp", "id"]].assign(n=len(b))

    side = rows.selectExpr("0 AS grp", "row_id AS id", "vec")
    plain, both = (bk.pair_blocks(side, side, fn, "grp int, id bigint, n bigint", block_rows=20, local_bytes=0, twin=t) for t in (False, True))
    tops = [r.groupBy("id").agg(F.sum("n").alias("n")).where("n <> 400").count() for r in (plain, both)]
    assert tops == [0, 0] and seen.value == 2 * 400 * 400
