"""Vector and mixture emissions, the whole CLIQUE search, the clustering interface, expectation propagation for the logistic response."""

import itertools
import math

import numpy as np
import pytest

from learnmill.operators import clique as C
from learnmill.operators import gp, hmm, tree
from learnmill.operators.cluster import Cluster
from learnmill.operators.mixture import Mixture


def sequences_of(spark, lengths=(5, 6, 4), seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, t, [float(v) for v in r.normal(3.0 * (t % 2), 1.0, 2)]) for i, n in enumerate(lengths) for t in range(n)]
    return rows, spark.createDataFrame(rows, "seq_id long, ts long, obs array<double>")


def two_states():
    return hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.0, 0.5], [2.0, 2.5]]), np.array([[[1.0, 0.2], [0.2, 1.5]], [[2.0, 0.0], [0.0, 1.0]]]))


def as_mixtures(m):
    return hmm.MixtureHmm(m.start, m.moves, tuple(Mixture(np.array([1.0]), m.means[[i]], m.variances[[i]]) for i in range(2)), ("l_kD_kA_kD_k",) * 2)


def density(x, mean, cov):
    d = np.asarray(x) - mean
    return math.exp(-0.5 * d @ np.linalg.inv(cov) @ d) / (2 * math.pi * math.sqrt(np.linalg.det(cov)))


def test_vector_emissions_against_all_paths(spark):
    rows, seqs = sequences_of(spark)
    m = two_states()
    want, starts = 0.0, np.zeros(2)
    for i in {r[0] for r in rows}:
        x = [r[2] for r in rows if r[0] == i]
        total = np.zeros(2)
        for path in itertools.product(range(2), repeat=len(x)):
            p = m.start[path[0]] * math.prod(m.moves[a, b] for a, b in itertools.pairwise(path))
            total[path[0]] += p * math.prod(density(v, m.means[s], m.variances[s]) for v, s in zip(x, path, strict=True))
        want += math.log(total.sum())
        starts += total / total.sum()
    after, ll = hmm.baum_welch_step(seqs, m)
    assert ll == pytest.approx(want)
    assert after.start == pytest.approx(starts / starts.sum())
    assert after.moves.sum(axis=1) == pytest.approx([1, 1])


def test_evidence_does_not_fall(spark):
    _, seqs = sequences_of(spark, (30, 25), 5)
    m, seen = hmm.start_gaussian(seqs, 2), []
    for _ in range(4):
        m, ll = hmm.baum_welch_step(seqs, m)
        seen.append(ll)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(seen))
    assert sorted(round(v) for v in m.means[:, 0]) == [0, 3]
    assert hmm.segmental_step(seqs, m).variances.shape == (2, 2, 2)
    paths = hmm.state_paths(seqs, m).collect()
    assert len(paths) == 55 and {r["state"] for r in paths} == {0, 1}


def test_one_component_is_a_gaussian(spark):
    _, seqs = sequences_of(spark, (20, 15), 7)
    m = two_states()
    plain, ll = hmm.baum_welch_step(seqs, m)
    mixed, same = hmm.mixture_step(seqs, as_mixtures(m), weighed=True)
    assert same == pytest.approx(ll)
    for i in range(2):
        assert mixed.parts[i].means[0] == pytest.approx(plain.means[i])
        assert mixed.parts[i].covs[0] == pytest.approx(plain.variances[i], abs=1e-6)


def test_mixture_emissions(spark):
    _, seqs = sequences_of(spark, (40, 40), 9)
    m = hmm.start_mixtures(seqs, [2, 1], ["lB", "l_kI"])
    assert [len(p.weights) for p in m.parts] == [2, 1] and m.start.sum() == pytest.approx(1)
    norms = np.linalg.norm(np.concatenate([p.means for p in m.parts]), axis=1)
    assert norms[0] == norms.min()
    found, ll = hmm.fit(seqs, m, max_rounds=3, weighed=True)
    assert math.isfinite(ll)
    assert found.parts[0].covs[0] == pytest.approx(found.parts[0].covs[1]) and found.parts[0].covs[0][0, 1] == pytest.approx(0)
    assert found.parts[1].covs[0] == pytest.approx(found.parts[1].covs[0][0, 0] * np.eye(2))
    # unweighed, every row counts once in each state's mixture
    one, _ = hmm.mixture_step(seqs, as_mixtures(two_states()))
    assert one.parts[0].means[0] == pytest.approx(one.parts[1].means[0])


def blobs(spark):
    rows = [(i, 0.1 * (i % 10), 0.1 * (i % 9), float(i % 7)) for i in range(60)] + [(100 + i, 8 + 0.1 * (i % 10), 8 + 0.1 * (i % 9), float(i % 7)) for i in range(60)] + [(500, 4.4, 0.0, 3.0)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, z double")


@pytest.mark.parametrize("interest", [None, "entropy", "mdl", lambda measured: {m[0] for m in measured}])
def test_clique_search(spark, interest):
    rows, points = blobs(spark)
    found, model = C.fit_rows(points, "id", ["x", "y"], support=20, levels=2, bins=8, interest=interest)
    got = {r["id"]: r["cluster"] for r in found.collect()}
    assert len(got) == len(rows) and got[500] == -1
    assert {got[r[0]] for r in rows if r[0] < 100} == {0} and {got[r[0]] for r in rows if 100 <= r[0] < 500} == {1}
    new = spark.createDataFrame([(1, 0.2, 0.3), (2, 4.0, 4.0)], "id long, x double, y double")
    assert {r["id"]: r["cluster"] for r in C.predict_rows(new, "id", model).collect()} == {1: 0, 2: -1}


def test_clique_takes_the_subspace_with_fewest_units(spark):
    _, points = blobs(spark)
    members = C.memberships(points.selectExpr("id", "cast(x >= 4 as long) x", "cast(z as long) z"), "id", ["x", "z"])
    assert {tuple(r["subspace"]) for r in C.deepest_clusters(members, 5, 1).collect()} == {(0,)}
    assert C.deepest_clusters(members, 1000, 2).count() == 0


def test_interest_of_subspaces():
    measured = [((0,), 100, 1.0), ((1,), 90, 0.5), ((2,), 20, 2.0), ((3,), 11, 3.0), ((4,), 10, 0.1)]
    assert C.keep_by_entropy(measured, 0.5) == {(4,), (1,)}
    assert C.keep_by_entropy(measured, 1.0, 1.5) == {(0,), (1,), (4,)}
    cost = {}
    for i in range(2, 4):
        sides = [100, 90, 20, 11, 10][:i], [100, 90, 20, 11, 10][i:]
        means = [sum(s) / len(s) for s in sides]
        cost[i] = sum(math.log2(abs(c - m)) for s, m in zip(sides, means, strict=True) for c in s) + sum(map(math.log2, means))
    cut = min(cost, key=cost.get)
    assert C.keep_by_code_length(measured) == {(i,) for i in range(cut)}
    assert C.keep_by_code_length([((i,), 5, 0.0) for i in range(4)]) == {(i,) for i in range(4)}


def test_cluster_interface(spark):
    _, points = blobs(spark)
    flat = points.select("id", "x", "y")
    new = spark.createDataFrame([(1, 0.2, 0.3), (2, 8.2, 8.3)], "id long, x double, y double")
    for how in ({"algorithm": "dbscan", "min_points": 3, "radius": 0.5}, {"algorithm": "clarans", "k": 2, "max_neighbors": 5}, {"algorithm": "clique", "id_col": "id", "columns": ["x", "y"], "support": 20, "levels": 2, "bins": 8}):
        tool = Cluster(**how)
        got = {r["id"]: r["cluster"] for r in tool.train(flat).collect()}
        assert len(got) == 121 and got[0] != got[100]
        assert {r["id"]: r["cluster"] for r in tool.predict(new).collect()} == {1: got[0], 2: got[100]}
    with pytest.raises(ValueError):
        Cluster("other")


def test_expectation_propagation_for_the_logistic_response():
    x, y = np.array([[0.0], [0.4], [1.5], [2.0]]), np.array([-1.0, -1.0, 1.0, 1.0])
    # the moments of a tilted Gaussian, against sums over a fine grid
    grid = np.linspace(-30, 30, 400_001)
    bell = np.exp(-((grid - 0.7) ** 2) / (2 * 2.0)) / (1 + np.exp(grid))
    mean = (bell * grid).sum() / bell.sum()
    terms = list(zip(gp.PROBIT_WEIGHTS.tolist(), gp.PROBIT_SCALES.tolist(), strict=True))
    mass, slope, bend = gp.tilted(-1.0, 0.7, 2.0, terms)
    assert mass == pytest.approx(bell.sum() * (grid[1] - grid[0]) / math.sqrt(2 * math.pi * 2.0), abs=1e-4)
    assert 0.7 + 2.0 * slope == pytest.approx(mean, abs=1e-2)
    assert 2.0 + 4.0 * bend == pytest.approx((bell * (grid - mean) ** 2).sum() / bell.sum(), abs=2e-2)
    m = gp.expectation_propagation(x, y, 1.0, response="logistic")
    p = gp.probability(m, np.array([[0.0], [1.0], [2.0]]))
    assert m.response == "logistic" and p[0] < 0.5 < p[2] and m.log_evidence < 0
    assert abs(m.log_evidence - gp.laplace(x, y, 1.0).log_evidence) < 0.3


def test_multiway_tree(spark):
    rows = [(c, x, {"a": 0, "b": 1, "c": int(x > 2)}[c]) for c in "abc" for x in range(6)]
    df = spark.createDataFrame([(c, float(x), y) for c, x, y in rows], "cat string, x double, label int")
    t = tree.grow(df, tree.TreeConfig({"cat": False, "x": True}, "label", max_depth=2, multiway=True))
    assert t.nodes[0].op == "in" and sorted(t.nodes[0].children) == ["a", "b", "c"]
    assert all(r["predicted"] == r["label"] for r in t.predict(df).collect())
    assert {rule for _, rule, _ in t.rules()} == {"cat = a", "cat = b", "cat = c and x <= 2.5", "cat = c and x > 2.5"}
    # an unknown category and a null get the parent's majority
    new = spark.createDataFrame([("z", 1.0), (None, 1.0)], "cat string, x double")
    assert {r["leaf"] for r in t.predict(new).collect()} == {0}
    assert len(t.cost_complexity_path()[-1][1].leaves()) == 1
    assert tree.surrogate_importance(t, df)["cat"] == pytest.approx(t.nodes[0].gain)
    assert tree.grow(df, tree.TreeConfig({"cat": False}, "label", multiway=True, leaf_min_rows=7)).leaves() == [0]
