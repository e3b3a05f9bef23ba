"""Metrics, outlier factors of every point, training of one against others, grids, guards, trees on unknown values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from learnmill.functions import guards
from learnmill.functions import scalar as S
from learnmill.operators import medoids as M
from learnmill.operators import neighbors as N
from learnmill.operators import stats, tree


def cloud(spark, n=60, p=4, seed=1):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) for _ in range(p)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, v array<double>")


DISTANCES = {"euclidean": math.dist, "manhattan": lambda a, b: sum(abs(x - y) for x, y in zip(a, b, strict=True)), "chebyshev": lambda a, b: max(abs(x - y) for x, y in zip(a, b, strict=True))}


@pytest.mark.parametrize("metric", DISTANCES)
def test_range_join_of_arrays(spark, metric):
    rows, points = cloud(spark)
    d = DISTANCES[metric]
    want = {(i, j) for i, a in rows for j, b in rows if d(a, b) <= 2.0}
    assert {(r["i"], r["j"]) for r in N.range_join(points, points, 2.0, metric).collect()} == want
    assert N.range_join(points.limit(0), points.limit(0), 2.0, metric).count() == 0


def test_range_join_takes_a_callable(spark):
    rows, points = cloud(spark, 20)
    double = lambda a, b: 2 * N.METRICS["manhattan"](a, b)
    assert N.range_join(points, points, 4.0, double).count() == sum(2 * DISTANCES["manhattan"](a, b) <= 4 for _, a in rows for _, b in rows)


def test_every_point_has_an_outlier_factor(spark):
    points = spark.createDataFrame([(i, float(i % 5), float(i // 5)) for i in range(20)] + [(99, 500.0, 500.0)], "id long, x double, y double")
    got = {r["id"]: r["factor"] for r in N.outlier_factor(points, 3, 0.5).collect()}
    assert len(got) == 21 and max(got, key=got.get) == 99
    assert N.outlier_factor(points.limit(2), 5, 0.5).count() == 2


def test_outlier_factors_of_many_copies_do_not_expand_pairs(spark):
    """40 places of 60 points each: equal to brute force, by pairs of places only."""
    r = random.Random(3)
    at = [(r.gauss(0, 1), r.gauss(0, 1)) for _ in range(40)]
    xy = [at[i % 40] for i in range(2400)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(xy)], "id long, x double, y double")
    d = {(a, b): math.sqrt((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) for a in range(40) for b in range(40)}
    kd = [sorted(d[a, b] for b in range(40))[2] for a in range(40)]
    w = {(a, b): 60 - (a == b) for a, b in d if d[a, b] <= kd[a]}
    n = [sum(w.get((a, b), 0) for b in range(40)) for a in range(40)]
    lrd = [n[a] / sum(k * max(kd[j], d[a, j]) for (i, j), k in w.items() if i == a) for a in range(40)]
    want = [sum(k * lrd[j] for (i, j), k in w.items() if i == a) / n[a] / lrd[a] for a in range(40)]
    got = {x["id"]: x["factor"] for x in N.outlier_factor(points, 3, 2.0).collect()}
    assert len(got) == 2400 and all(abs(got[i] - want[i % 40]) < 1e-9 for i in range(2400))
    near = N._near_places(N._places(points, "euclidean")[0], 10.0, 3, 2.0, "euclidean")
    assert near.count() == len(w)


def test_link_distances_by_blocks(spark):
    rows, points = cloud(spark, 40)
    labelled = points.withColumn("label", F.col("id") % 3)
    d = {(a, b): [math.dist(x, y) for i, x in rows if i % 3 == a for j, y in rows if j % 3 == b and (a != b or i < j)] for a in range(3) for b in range(a, 3)}
    got = {(r["a"], r["b"]): (r["single"], r["complete"], r["average"]) for r in M.link_distances(labelled).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)}
    for k, v in got.items():
        assert v == pytest.approx((min(d[k]), max(d[k]), sum(d[k]) / len(d[k])))
    assert {r["label"]: r["s"] for r in M.diameters(labelled).collect()} == pytest.approx({a: max(d[a, a]) for a in range(3)})
    parts = M._pairs_of_blocks(labelled, False, block=4).groupBy("a", "b").agg(F.min("least").alias("m"), F.sum("n").alias("n"))
    assert {(r["a"], r["b"]): (r["m"], r["n"]) for r in parts.collect()} == {k: (pytest.approx(min(d[k])), len(d[k])) for k in got}


def test_multi_class_training(spark):
    r = random.Random(2)
    centres = {"a": (0, 0), "b": (6, 0), "c": (0, 6)}
    rows = [(c, x + r.gauss(0, 0.5), y + r.gauss(0, 0.5)) for c, (x, y) in centres.items() for _ in range(20)] + [(None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "label string, x double, y double")
    for train in (stats.one_versus_rest_train, stats.one_versus_one_train):
        models = train(df.withColumnRenamed("y", "z"), "label", lambda d: stats.mean_difference(d, ["x", "z"]))
        out = stats.multi_class_predict(df.withColumnRenamed("y", "z"), models, lambda m: stats.linear_score(m, ["x", "z"])).where("label is not null")
        assert len(models) == 3 and out.where("label <> predicted").count() <= 1
    assert stats.one_versus_rest_train(df.where("label = 'a'"), "label", lambda d: None) == {}


def test_grids():
    assert stats.grid_of({"a": [1, 2], "b": (0.0, 1.0, 3)}) == [{"a": a, "b": b} for a in (1, 2) for b in (0.0, 0.5, 1.0)]


def test_normal_cdf(spark):
    xs = [-7.0, -3.0, -1.0, 0.0, 0.5, 2.0, 5.5, 7.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(S.normal_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs], abs=1e-9)


def test_guards(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", [3.0, 4.0])], "n int, s string, v array<double>")
    assert guards.check_columns(df, ["n"]) is df and guards.check_vectors(df, "v") == 2 and guards.check_sequence([1, 2]) == (1, 2) and guards.check_same_length(a=[1], b=[2]) == 1
    for bad in (lambda: guards.check_columns(df, ["s"]), lambda: guards.check_columns(df, ["z"]), lambda: guards.check_vectors(df.where("false"), "v"), lambda: guards.check_sequence("ab"), lambda: guards.check_same_length(a=[1], b=[])):
        with pytest.raises(ValueError):
            bad()


def test_unknown_values_get_the_parents_majority(spark):
    rows = [(c, x, int(c == "u")) for c in "uvw" for x in range(6)]
    df = spark.createDataFrame([(c, float(x), y) for c, x, y in rows], "c string, x double, label int")
    cfg = tree.TreeConfig({"c": False, "x": True}, "label", max_depth=2)
    t, seen = tree.grow(df, cfg), tree.categories(df, cfg)
    new = spark.createDataFrame([("u", 1.0, 1), ("v", 1.0, 0), (None, 1.0, 0), ("never", 1.0, 0)], "c string, x double, label int")
    got = {r["c"]: (r["leaf"], r["predicted"]) for r in t.predict(new, seen).collect()}
    majority = t.decide(t.nodes[0])[0]
    assert seen == {"c": ["u", "v", "w"]} and got[None] == got["never"] == (0, majority) and got["u"][1] == 1 and got["v"][1] == 0


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """6000 users in 300 places."""
    folder = str(tmp_path_factory.mktemp("many"))
    r = random.Random(8)
    at = [[r.gauss(0, 1) for _ in range(3)] for _ in range(300)]
    spark.createDataFrame([(u, x) for u in range(6000) for x in at[u % 300]], "user_id long, value double").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["cddual_fit", "smo_fit", "multisvm_fit"])
def test_dual_solvers_take_over_5000_users(spark, many_users, name):
    from learnmill.operators import kernel
    from learnmill.plans.models import _all_users
    from learnmill.plans.registry import QUERIES

    got = QUERIES[name](spark, many_users).toPandas()
    ids, x, y = _all_users(spark, many_users)
    if name == "cddual_fit":
        v = got.to_numpy()[0]
        short = np.maximum(1 - y * (x @ v), 0)
        assert np.abs(v - 2 * (x * (y * short)[:, None]).sum(0)).max() < 1e-2  # of sums of thousands
        return
    assert sorted(got["id"]) == list(ids)
    got = got.set_index("id").loc[ids]
    if name == "smo_fit":
        m = kernel.smo(kernel.kernel_matrix(x, x, 0.5), y, 1.0)
        assert np.abs(got["score"].to_numpy() - (kernel.kernel_matrix(x, x, 0.5) @ (m.alpha * y) - m.threshold)).max() < 0.05
    else:
        assert (got["label"] == got["predicted"]).mean() > 0.97


def test_process_by_features_equals_the_whole_matrix():
    from learnmill.operators import gp, kernel

    x = np.repeat(np.random.default_rng(1).normal(size=(30, 2)), 4, 0)
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0, 1.0, -1.0)
    m, k = gp.laplace(x, y, 0.5), kernel.kernel_matrix(x, x, 0.5)
    f = kernel.kernel_matrix(x, m.pivots, 0.5) @ m.to_features.T @ m.mean
    p = 1 / (1 + np.exp(-f))
    assert np.abs(k @ ((y + 1) / 2 - p) - f).max() < 1e-4  # the mode's condition over all 120 rows
    w = np.sqrt(p * (1 - p))
    want = -np.log1p(np.exp(-y * f)).sum() - 0.5 * m.mean @ m.mean - 0.5 * np.linalg.slogdet(np.eye(120) + w[:, None] * k * w)[1]
    assert m.log_evidence == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("name", ["gpc_laplace", "gpc_ep", "gpc_search"])
def test_processes_take_over_5000_users(spark, many_users, name):
    from learnmill.plans.models import _all_users
    from learnmill.plans.registry import QUERIES

    ids, _, y = _all_users(spark, many_users)
    got = QUERIES[name](spark, many_users).toPandas().set_index("id")["p"]
    assert sorted(got.index) == list(ids) and ((got.loc[ids].to_numpy() > 0.5) == (y > 0)).mean() > 0.97


def test_search_of_the_precision_fits_each_once():
    from types import SimpleNamespace

    from learnmill.operators import gp

    fits = []
    found = gp.search_precision(lambda t: fits.append(t) or SimpleNamespace(log_evidence=-abs(math.log(t / 0.7))), 0.05, 5.0, 6)
    assert found == pytest.approx(0.7, rel=1e-3) and len(fits) == 6 + 2 + 19


def test_laplace_over_many_different_rows_holds_no_feature_of_a_row():
    import tracemalloc

    from learnmill.operators import gp

    x = np.random.default_rng(2).normal(size=(20_000, 2))
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0, 1.0, -1.0)
    tracemalloc.start()
    m = gp.laplace(x, y, 0.5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * len(x) * len(m.mean) / 2


@pytest.mark.parametrize(("response", "precision"), [("logistic", 0.1), ("logistic", 1.0), ("probit", 0.5)])
def test_products_of_features_equal_pivots(response, precision):
    from learnmill.operators import gp, kernel

    r = np.random.default_rng(3)
    x, times = r.normal(size=(2500, 2)) * [1, 2] + [5, 0], r.integers(1, 40, 2500).astype(float)
    y = np.where(x[:, 0] - 5 + 0.3 * x[:, 1] + r.normal(size=2500) / 4 > 0, 1.0, -1.0)
    products = gp.features_of(x, precision)
    assert isinstance(products, gp.Products)
    start = gp.mode(gp.features_of(x, 1.2 * precision), y, times, response).values
    a, b, c = gp.mode(products, y, times, response), gp.mode(gp.Pivots(x, precision), y, times, response), gp.mode(products, y, times, response, start=start)
    assert a.log_evidence == pytest.approx(b.log_evidence, abs=1e-5) and c.log_evidence == pytest.approx(b.log_evidence, abs=1e-5)
    models = a.model(), b.model()
    assert np.abs(gp.probability(models[0], x) - gp.probability(models[1], x)).max() < 1e-5
    assert np.abs(models[0].features(x[:99]) @ models[0].features(x[500:]).T - kernel.kernel_matrix(x[:99], x[500:], precision)).max() < 1e-9
    assert isinstance(gp.features_of(x * 1000, precision), gp.Pivots) and isinstance(gp.features_of(x[:20], precision), gp.Pivots)


@pytest.mark.parametrize("column", [0, 1])
def test_products_take_a_constant_column(column):
    from learnmill.operators import gp

    x = np.random.default_rng(4).normal(size=(3000, 2))
    y = np.where(x[:, 1 - column] > 0.1, 1.0, -1.0)
    x[:, column] = 2.5
    assert isinstance(gp.features_of(x, 0.5), gp.Products)
    assert gp.laplace(x, y, 0.5).log_evidence == pytest.approx(gp.mode(gp.Pivots(x, 0.5), y, np.ones(3000)).log_evidence, abs=1e-5)


def test_optics_walks_over_points_without_a_table_of_neighbours(spark):
    """The order over points, with copies and ties, is that over the neighbours' table; its plan joins nothing."""
    r = random.Random(6)
    at = [(float(r.randrange(5)), r.gauss(0, 1)) for _ in range(40)]
    points = spark.createDataFrame([(7 * i % 120, [*at[i % 40]]) for i in range(120)], "id long, v array<double>")
    for metric in ("euclidean", "manhattan", "chebyshev"):
        order = N.optics(points, 4, 1.5, metric)
        assert "Join" not in order._jdf.queryExecution().toString()
        assert order.collect() == N.optics(points, 4, 1.5, N.METRICS[metric]).collect()
    flat = points.select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    got = N.optics(flat, 4, 1.5)
    assert "Join" not in got._jdf.queryExecution().toString() and [x["id"] for x in got.collect()] == [x["id"] for x in N.optics(points, 4, 1.5).collect()]


def test_degrees_of_arrays_come_from_blocks(spark):
    """Points exactly at the radius count; nothing is joined pair by pair."""
    points = spark.createDataFrame([(i, [float(i % 4), float(i // 4 % 4), 0.1]) for i in range(64)], "id long, v array<double>")
    at = [(i % 4, i // 4 % 4) for i in range(64)]
    got = N.eps_degree(points, 1.0)
    assert {r["id"]: r["degree"] for r in got.collect()} == {i: sum(math.dist(a, b) <= 1 for b in at) for i, a in enumerate(at)}
    assert "MapInPandas" in got._jdf.queryExecution().toString()
