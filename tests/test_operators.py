"""Operators against hand-computed answers and independent twins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from learnmill.operators import gp, hmm, kernel, linear, medoids, mixture, neighbors, nn, prep, stats, tree


def points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "id long, x double, y double")


def test_normalize_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = prep.normalize(df, ["a", "b"]).collect()
    assert sorted(round(r["a"], 6) for r in got) == [-0.707107, 0.707107]
    assert [r["b"] for r in got] == [0.0, 0.0]


def test_grid_maximum_is_in_last_bin_and_one_mode_is_needed(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "a double")
    assert [r["code_a"] for r in prep.grid_codes(df, ["a"], prep.grid_knots(df, ["a"], bins=5)).orderBy("a").collect()] == [0, 2, 4]
    with pytest.raises(ValueError):
        prep.grid_knots(df, ["a"])


def test_folds_are_contiguous(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    got = {r["k"]: r["fold"] for r in stats.folds(df, "k", 3).collect()}
    assert [got[i] for i in range(10)] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def brute_dbscan(xy, min_points, radius):
    n = len(xy)
    near = [[j for j in range(n) if math.dist(xy[i], xy[j]) <= radius] for i in range(n)]
    core = [len(a) >= min_points for a in near]
    label = [None] * n
    k = 0
    for i in range(n):
        if core[i] and label[i] is None:
            stack, label[i] = [i], k
            while stack:
                for j in near[stack.pop()]:
                    if core[j] and label[j] is None:
                        label[j] = k
                        stack.append(j)
            k += 1
    return [label[i] if core[i] else min((label[j] for j in near[i] if core[j]), default=-1) for i in range(n)]


@pytest.mark.parametrize("min_points", [3, 4])
def test_dbscan_matches_brute_force(spark, min_points):
    r = random.Random(4)
    xy = [(r.gauss(c, 0.4), r.gauss(c, 0.4)) for c in (0, 3) for _ in range(30)] + [(10.0, 10.0)]
    got = {r["id"]: r["cluster"] for r in neighbors.dbscan(points(spark, xy), min_points, 0.5).collect()}
    assert [got[i] for i in range(len(xy))] == brute_dbscan(xy, min_points, 0.5)


def test_optics_cut_agrees_with_dbscan_on_cores(spark):
    r = random.Random(5)
    p = points(spark, [(r.gauss(c, 0.3), r.gauss(c, 0.3)) for c in (0, 3) for _ in range(25)])
    cut = {r["id"]: r["cluster"] for r in neighbors.optics_cut(neighbors.optics(p, 4, 5.0), 0.5).collect()}
    db = [r for r in neighbors.dbscan(p, 4, 0.5).collect() if r["core"]]
    pairs = {(r["cluster"], cut[r["id"]]) for r in db}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_medoid_assignment_ties_take_the_smaller_id(spark):
    p = points(spark, [(0, 0), (2, 0), (1, 0)])
    got = {r["id"]: r["medoid"] for r in medoids.assign(p, p.where("id < 2")).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_em_does_not_lower_the_likelihood_and_families_fit(spark):
    r = np.random.default_rng(1)
    xy = np.concatenate([r.normal(-2, 1, (60, 2)), r.normal(2, 0.5, (40, 2))])
    p = points(spark, xy.tolist()).cache()
    m = mixture.Mixture(np.array([0.5, 0.5]), np.array([[-1.0, -1], [1, 1]]), np.array([np.eye(2)] * 2))
    lls = []
    for _ in range(4):
        m = mixture.em_step(p, ["x", "y"], m)
        lls.append(m.log_likelihood)
    assert all(b >= a - 1e-9 for a, b in zip(lls, lls[1:], strict=False))
    n, w = np.array([30.0, 20.0]), np.array([[[40.0, 5], [5, 10]], [[8.0, -3], [-3, 30]]])

    def value(covs):
        return -0.5 * sum(k * np.log(np.linalg.det(c)) + np.trace(np.linalg.solve(c, s)) for k, c, s in zip(n, covs, w, strict=True))

    best = value(mixture.family_covariances("l_kD_kA_kD_k", n, w))
    for f in mixture.FAMILIES:
        assert value(mixture.family_covariances(f, n, w)) <= best + 1e-9
    with pytest.raises(ValueError):
        mixture.family_of(same_direction=True)


def test_viterbi_and_forward_match_all_paths():
    m = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.4, 0.6]]), np.array([0.0, 2.0]), np.array([1.0, 1.5]))
    b = m.log_emissions(np.array([0.1, 1.9, 0.4, 2.2]))
    import itertools

    every = {}
    for path in itertools.product((0, 1), repeat=4):
        every[path] = math.log(m.start[path[0]]) + sum(math.log(m.moves[i][j]) for i, j in zip(path, path[1:], strict=False)) + sum(b[t][s] for t, s in enumerate(path))
    path, ll = hmm.viterbi(m, b)
    assert tuple(path) == max(every, key=every.get) and abs(ll - max(every.values())) < 1e-12
    evidence = math.log(sum(math.exp(v) for v in every.values()))
    a, z = hmm.forward(m, b), hmm.backward(m, b)
    assert all(abs(hmm.log_sum(a[t] + z[t], 0) - evidence) < 1e-9 for t in range(4))


def design(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 2))
    y = np.where(x[:, 0] - 0.5 * x[:, 1] + r.normal(0, 0.5, 60) > 0, 1.0, -1.0)
    return linear.Design(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "x1 double, x2 double, y double").coalesce(1).cache(), ["x1", "x2"])


def test_l1_solvers_reach_the_same_objective(spark):
    d = design(spark)
    found = [linear.l1_objective(d, v, 0.5) for v in (linear.cdn(d, 0.5, passes=12), linear.bbr(d, 0.5, passes=15), linear.new_glmnet(d, 0.5, rounds=8))]
    assert max(found) - min(found) < 1e-3


def test_squared_hinge_solvers_agree(spark):
    d = design(spark)
    found = [linear.svm_objective(d, v, 1.0, "l2") for v in (linear.trust_region(d, 1.0), linear.mfn(d, 1.0), kernel.dual_coordinates(d, 1.0, "l2"))]
    assert max(found) - min(found) < 1e-3
    with pytest.raises(ValueError):
        linear.fit_svm(d, 1.0, "mfn", "l1")


def test_smo_meets_its_conditions():
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 2))
    y = np.where(x[:, 0] > 0, 1.0, -1.0)
    k = kernel.kernel_matrix(x, x, 0.5)
    m = kernel.smo(k, y, 1.0, tol=1e-4)
    assert abs((m.alpha * y).sum()) < 1e-9 and (m.alpha >= -1e-12).all() and (m.alpha <= 1 + 1e-9).all()
    assert (np.sign(k @ (m.alpha * y) - m.threshold) == y).mean() > 0.9


def test_gaussian_process_separates():
    x = np.linspace(-2, 2, 20)[:, None]
    y = np.where(x[:, 0] > 0, 1.0, -1.0)
    for model in (gp.laplace(x, y, 1.0), gp.expectation_propagation(x, y, 1.0)):
        p = gp.probability(model, np.array([[-1.5], [1.5]]))
        assert p[0] < 0.3 and p[1] > 0.7


def test_tree_splits_routes_and_prunes(spark):
    rows = spark.createDataFrame([(float(i), "a" if i % 2 else "b", int(i >= 5)) for i in range(10)], "v double, c string, y int")
    t = tree.grow(rows, tree.TreeConfig({"v": True, "c": False}, "y", max_depth=3))
    assert t.nodes[0].attribute == "v" and t.nodes[0].value == 4.5 and len(t.leaves()) == 2
    assert t.predict(rows).where("predicted <> y").count() == 0
    assert {r for _, r, _ in t.rules()} == {"v <= 4.5", "v > 4.5"}
    path = t.cost_complexity_path()
    assert [len(x.leaves()) for _, x in path] == [2, 1]


def test_network_gradient_matches_differences():
    conv = nn.Convolution(4, 3, 2, 2)
    net = nn.Network((conv, nn.Full(conv.n_out, 3), nn.Full(3, 2, "none")))
    r = np.random.default_rng(0)
    w, x, y = net.start(1), r.normal(size=(5, 16)), np.array([0, 1, 1, 0, 1])
    _, g = net.loss_gradient(w, x, y)
    for i in range(0, net.size, 3):
        e = np.zeros(net.size)
        e[i] = 1e-5
        assert abs((net.loss_gradient(w + e, x, y)[0] - net.loss_gradient(w - e, x, y)[0]) / 2e-5 - g[i]) < 1e-5


def test_empty_tables(spark):
    none = points(spark, [])
    assert neighbors.dbscan(none, 3, 1.0).count() == 0
    assert neighbors.range_join(none, none, 1.0).count() == 0
    assert stats.class_stats(none, "id").count() == 0
    assert prep.grid_codes(none, ["x"], prep.grid_knots(none, ["x"], bins=3)).count() == 0


def test_distance_outliers_match_brute_force(spark):
    r = random.Random(9)
    xy = [(r.gauss(0, 1), r.gauss(0, 1)) for _ in range(60)] + [(9.0, 9.0)]
    most = int(61 * 0.1 + 1e-9)
    want = {i for i, a in enumerate(xy) if sum(math.dist(a, b) <= 1.0 for b in xy) <= most}
    assert {x["id"] for x in neighbors.distance_outliers(points(spark, xy), 0.9, 1.0).select(F.col("id")).collect()} == want


@pytest.mark.parametrize("name", ["multisvm_fit", "smo_fit", "cddual_fit", "gpc_laplace"])
def test_sequential_solvers_train_on_every_user(spark, tmp_path, monkeypatch, name):
    """250 users, of whom the first 200 alone give another model."""
    from learnmill.plans import models
    from learnmill.plans.registry import QUERIES

    r = random.Random(12)
    events = [(10 * u, r.gauss(0 if u < 200 else 3, 1)) for u in range(250) for _ in range(4)]
    spark.createDataFrame(events, "user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    users = {u["id"]: (u["x"], u["y"]) for u in models.user_points(spark, str(tmp_path)).collect()}
    sizes = []
    solver = {"multisvm_fit": (kernel, "multi_class_dual"), "smo_fit": (kernel, "smo"), "cddual_fit": (kernel, "dual_coordinates"), "gpc_laplace": (gp, "laplace")}[name]
    solve = getattr(*solver)
    monkeypatch.setattr(*solver, lambda d, *a, **k: (sizes.append(d.df.count() if name == "cddual_fit" else len(d)), solve(d, *a, **k))[1])
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert sizes == [250]
    if name == "multisvm_fit":
        assert {g["id"]: g["label"] for g in got} == {i: int(x > 0) + int(y > 0) for i, (x, y) in users.items()}
        assert sum(g["label"] == g["predicted"] for g in got) > 225
    elif name != "cddual_fit":
        assert {g["id"] for g in got} == set(users)
    monkeypatch.setattr(kernel.bounded, "__defaults__", (249, ()))
    with pytest.raises(ValueError, match="at most 249"):
        QUERIES[name](spark, str(tmp_path))
