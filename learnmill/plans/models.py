"""Queries on mixtures, sequences, linear models, kernels, trees and networks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from learnmill.operators import gp, hmm, kernel, linear, mixture, nn, tree
from learnmill.operators.linear import Design
from learnmill.sources.tables import SQL_DOCS, SQL_LINES, SQL_SEQ, SQL_USERS, SQL_VEC, labelled_documents, line_points, sequences, table, user_points, vectors

from .registry import query, rounded

XY = ["x", "y"]
START = mixture.Mixture(np.array([0.5, 0.5]), np.array([[-0.5, -0.5], [0.5, 0.5]]), np.array([np.eye(2), np.eye(2)]))


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in rows], schema)


# --- mixtures: two components with identity covariances to start from

_LP = f"WITH {SQL_USERS}, lp AS (SELECT id, x, y, ln(0.5) - ln(2 * pi()) - 0.5 * (pow(x + 0.5, 2) + pow(y + 0.5, 2)) AS l0, ln(0.5) - ln(2 * pi()) - 0.5 * (pow(x - 0.5, 2) + pow(y - 0.5, 2)) AS l1 FROM p), r AS (SELECT *, greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS ll FROM lp)"


@query(f"{_LP} SELECT id, round(exp(l0 - ll), 6) + 0.0::DOUBLE AS p0, round(ll, 6) + 0.0::DOUBLE AS ll FROM r")
def gmm_estep(spark, sf_dir):
    rows = mixture.posteriors(user_points(spark, sf_dir), XY, START)
    return rows.select("id", rounded(F.exp(F.col("lp")[0] - F.col("ll"))).alias("p0"), rounded(F.col("ll")).alias("ll"))


_EM = ", ".join(f"sum(exp(l{k} - ll)) AS n{k}, sum(exp(l{k} - ll) * x) AS sx{k}, sum(exp(l{k} - ll) * y) AS sy{k}, sum(exp(l{k} - ll) * x * x) AS xx{k}, sum(exp(l{k} - ll) * x * y) AS xy{k}, sum(exp(l{k} - ll) * y * y) AS yy{k}" for k in (0, 1))


def _sql_moments(head: str, sums: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, n{k} / (n0 + n1) AS w, sx{k} / n{k} AS mx, sy{k} / n{k} AS my, xx{k} / n{k} - pow(sx{k} / n{k}, 2) AS vxx, xy{k} / n{k} - sx{k} * sy{k} / n{k} / n{k} AS vxy, yy{k} / n{k} - pow(sy{k} / n{k}, 2) AS vyy, n{k} AS n FROM s" for k in (0, 1))
    return f"{head}, s AS (SELECT {sums} FROM r), m AS ({parts})"


_ROUNDED = "SELECT k, round(w, 6) AS w, round(mx, 6) + 0.0::DOUBLE AS mx, round(my, 6) + 0.0::DOUBLE AS my, "


@query(_sql_moments(_LP, _EM) + f" {_ROUNDED} round(vxx, 6) + 0.0::DOUBLE AS vxx, round(vxy, 6) + 0.0::DOUBLE AS vxy, round(vyy, 6) + 0.0::DOUBLE AS vyy FROM m")
def gmm_mstep(spark, sf_dir):
    return _mixture_frame(spark, mixture.em_step(user_points(spark, sf_dir), XY, START))


def _mixture_frame(spark, m):
    rows = [(k, float(m.weights[k]), *map(float, m.means[k]), float(m.covs[k][0, 0]), float(m.covs[k][0, 1]), float(m.covs[k][1, 1])) for k in range(len(m.weights))]
    return frame(spark, rows, "k long, w double, mx double, my double, vxx double, vxy double, vyy double")


@query(f"{_LP} SELECT id, (l1 > l0)::BIGINT AS component FROM lp")
def cem_assign(spark, sf_dir):
    return mixture.cem_assign(user_points(spark, sf_dir), XY, START).select("id", "component")


_CEM = ", ".join(f"sum((c = {k})::INT)::DOUBLE AS n{k}, sum(x) FILTER (c = {k}) AS sx{k}, sum(y) FILTER (c = {k}) AS sy{k}, sum(x * x) FILTER (c = {k}) AS xx{k}, sum(x * y) FILTER (c = {k}) AS xy{k}, sum(y * y) FILTER (c = {k}) AS yy{k}" for k in (0, 1))
_HARD = _sql_moments(f"{_LP}, r2 AS (SELECT *, (l1 > l0)::INT AS c FROM lp)", _CEM).replace("FROM r)", "FROM r2)")


def _cem(family, sql):
    def run(spark, sf_dir):
        return _mixture_frame(spark, mixture.cem_step(user_points(spark, sf_dir), XY, START, family))

    run.__name__ = "cem_" + {"lI": "common_sphere", "l_kI": "spherical", "lB": "common_diagonal", "l_kB_k": "diagonal", "lDAD": "common_cov", "l_kD_kA_kD_k": "full_cov"}[family]
    return query(_HARD + f" {_ROUNDED} {sql}")(run)


_POOL = "(SELECT sum({} * n) / sum(n) FROM m)"
_cem("lI", f"round({_POOL.format('(vxx + vyy) / 2')}, 6) AS vxx, 0.0::DOUBLE AS vxy, round({_POOL.format('(vxx + vyy) / 2')}, 6) AS vyy FROM m")
_cem("l_kI", "round((vxx + vyy) / 2, 6) AS vxx, 0.0::DOUBLE AS vxy, round((vxx + vyy) / 2, 6) AS vyy FROM m")
_cem("lB", f"round({_POOL.format('vxx')}, 6) AS vxx, 0.0::DOUBLE AS vxy, round({_POOL.format('vyy')}, 6) AS vyy FROM m")
_cem("l_kB_k", "round(vxx, 6) AS vxx, 0.0::DOUBLE AS vxy, round(vyy, 6) AS vyy FROM m")
_cem("lDAD", f"round({_POOL.format('vxx')}, 6) AS vxx, round({_POOL.format('vxy')}, 6) + 0.0::DOUBLE AS vxy, round({_POOL.format('vyy')}, 6) AS vyy FROM m")
_cem("l_kD_kA_kD_k", "round(vxx, 6) AS vxx, round(vxy, 6) + 0.0::DOUBLE AS vxy, round(vyy, 6) AS vyy FROM m")


@query()
def cem_families(spark, sf_dir):
    """One step of every covariance family, with the log likelihood before it."""
    p = user_points(spark, sf_dir).cache()
    rows = []
    for f in mixture.FAMILIES:
        m = mixture.cem_step(p, XY, START, f)
        rows.append((f, float(np.linalg.det(m.covs[0])), float(np.linalg.det(m.covs[1])), m.log_likelihood))
    return frame(spark, rows, "family string, det0 double, det1 double, log_likelihood double")


@query()
def gmm_fit(spark, sf_dir):
    return _mixture_frame(spark, mixture.fit_em(user_points(spark, sf_dir).cache(), XY, START, max_rounds=15))


# --- sequences: two states

TWO = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([50.0, 150.0]), np.array([2500.0, 10000.0]))
_EMIT = f"WITH RECURSIVE {SQL_SEQ}, o AS (SELECT seq_id, t, -0.5 * (ln(2 * pi() * 2500) + pow(obs - 50, 2) / 2500) AS b0, -0.5 * (ln(2 * pi() * 10000) + pow(obs - 150, 2) / 10000) AS b1, max(t) OVER (PARTITION BY seq_id) AS n FROM q)"
_LSE = "(greatest({a}, {b}) + ln(exp({a} - greatest({a}, {b})) + exp({b} - greatest({a}, {b}))))"
_FWD = _EMIT + f", f(seq_id, t, a0, a1) AS (SELECT seq_id, t, ln(0.6) + b0, ln(0.4) + b1 FROM o WHERE t = 1 UNION ALL SELECT o.seq_id, o.t, {_LSE.format(a='(a0 + ln(0.8))', b='(a1 + ln(0.3))')} + b0, {_LSE.format(a='(a0 + ln(0.2))', b='(a1 + ln(0.7))')} + b1 FROM f JOIN o ON o.seq_id = f.seq_id AND o.t = f.t + 1)"
_BWD = _FWD + f", z(seq_id, t, z0, z1) AS (SELECT seq_id, t, 0.0::DOUBLE, 0.0::DOUBLE FROM o WHERE t = n UNION ALL SELECT p.seq_id, p.t, {_LSE.format(a='(ln(0.8) + o.b0 + z0)', b='(ln(0.2) + o.b1 + z1)')}, {_LSE.format(a='(ln(0.3) + o.b0 + z0)', b='(ln(0.7) + o.b1 + z1)')} FROM z JOIN o ON o.seq_id = z.seq_id AND o.t = z.t JOIN o p ON p.seq_id = z.seq_id AND p.t = z.t - 1)"


def _states(sql0, sql1):
    return f"SELECT seq_id, t, 0::BIGINT AS state, round({sql0}, 6) + 0.0::DOUBLE AS v FROM w UNION ALL SELECT seq_id, t, 1::BIGINT, round({sql1}, 6) + 0.0::DOUBLE FROM w"


@query(_FWD + ", w AS (SELECT * FROM f) " + _states("a0", "a1"))
def hmm_forward(spark, sf_dir):
    return hmm.recursions(sequences(spark, sf_dir), TWO).select("seq_id", "t", "state", rounded(F.col("log_alpha")).alias("v"))


@query(_BWD + ", w AS (SELECT * FROM z) " + _states("z0", "z1"))
def hmm_backward(spark, sf_dir):
    return hmm.recursions(sequences(spark, sf_dir), TWO).select("seq_id", "t", "state", rounded(F.col("log_beta")).alias("v"))


@query(_BWD + f", w AS (SELECT f.*, z0, z1, {_LSE.format(a='(a0 + z0)', b='(a1 + z1)')} AS ev FROM f JOIN z USING (seq_id, t)) " + _states("exp(a0 + z0 - ev)", "exp(a1 + z1 - ev)"))
def hmm_posterior(spark, sf_dir):
    return hmm.recursions(sequences(spark, sf_dir), TWO).select("seq_id", "t", "state", rounded(F.col("posterior")).alias("v"))


@query(_FWD + f" SELECT f.seq_id, round({_LSE.format(a='a0', b='a1')}, 6) AS log_evidence FROM f JOIN o ON f.seq_id = o.seq_id AND f.t = o.t WHERE f.t = o.n")
def hmm_evidence(spark, sf_dir):
    return hmm.log_evidence(sequences(spark, sf_dir), TWO).select("seq_id", rounded(F.col("log_evidence")).alias("log_evidence"))


_VIT = _EMIT + """, v(seq_id, t, v0, v1, k0, k1) AS (SELECT seq_id, t, ln(0.6) + b0, ln(0.4) + b1, 0, 0 FROM o WHERE t = 1 UNION ALL
SELECT o.seq_id, o.t, greatest(v0 + ln(0.8), v1 + ln(0.3)) + b0, greatest(v0 + ln(0.2), v1 + ln(0.7)) + b1, (v1 + ln(0.3) > v0 + ln(0.8))::INT, (v1 + ln(0.7) > v0 + ln(0.2))::INT FROM v JOIN o ON o.seq_id = v.seq_id AND o.t = v.t + 1),
g(seq_id, t, state, ll) AS (SELECT v.seq_id, v.t, (v1 > v0)::INT, greatest(v0, v1) FROM v JOIN o ON o.seq_id = v.seq_id AND o.t = v.t WHERE v.t = o.n UNION ALL
SELECT g.seq_id, g.t - 1, CASE WHEN g.state = 0 THEN v.k0 ELSE v.k1 END, g.ll FROM g JOIN v ON v.seq_id = g.seq_id AND v.t = g.t WHERE g.t > 1)"""


@query(_VIT + " SELECT seq_id, t, state::BIGINT AS state, round(ll, 6) AS log_likelihood FROM g")
def hmm_viterbi(spark, sf_dir):
    return hmm.state_paths(sequences(spark, sf_dir), TWO).withColumn("log_likelihood", rounded(F.col("log_likelihood")))


@query(_VIT + ", m AS (SELECT seq_id, state AS i, coalesce(lead(state) OVER (PARTITION BY seq_id ORDER BY t), state) AS j FROM g) SELECT seq_id, i::BIGINT AS i, j::BIGINT AS j, count(*) AS n FROM m GROUP BY 1, 2, 3")
def hmm_trans_counts(spark, sf_dir):
    return hmm.move_counts(hmm.state_paths(sequences(spark, sf_dir), TWO), 2)


def _hmm_frame(spark, m, ll):
    return frame(spark, [(k, float(m.start[k]), float(m.moves[k][0]), float(m.moves[k][1]), float(m.means[k]), float(m.variances[k]), float(ll)) for k in range(2)], "state long, start double, to0 double, to1 double, mean double, variance double, log_evidence double")


@query()
def hmm_baum_welch(spark, sf_dir):
    return _hmm_frame(spark, *hmm.fit(sequences(spark, sf_dir), TWO, max_rounds=4, warm_rounds=1))


#: Observations of two numbers, the value and its logarithm, under full covariances, and a state with a mixture.
PAIRS = hmm.Hmm(TWO.start, TWO.moves, np.array([[50.0, 4.0], [150.0, 5.0]]), np.array([[[2500.0, 10.0], [10.0, 1.0]], [[10000.0, 20.0], [20.0, 1.0]]]))
MIXED = hmm.MixtureHmm(TWO.start, TWO.moves, (mixture.Mixture(np.array([0.7, 0.3]), PAIRS.means, PAIRS.variances), mixture.Mixture(np.array([1.0]), PAIRS.means[1:], PAIRS.variances[1:])), ("l_kD_kA_kD_k", "l_kD_kA_kD_k"))


def _pairs(spark, sf_dir):
    return sequences(spark, sf_dir).withColumn("obs", F.array("obs", F.log("obs")))


def _sql_pairs(b0, b1):
    """The forward recursion over log emissions b0 and b1, made of the densities g0 and g1."""
    dense = "-ln(2 * pi()) - 0.5 * ln({a}::DOUBLE * 1 - {b}::DOUBLE * {b}) - 0.5 * (pow(obs - {m}, 2) - 2 * {b} * (obs - {m}) * (ln(obs) - {w}) + {a}::DOUBLE * pow(ln(obs) - {w}, 2)) / ({a}::DOUBLE - {b}::DOUBLE * {b})"
    g = f"g AS (SELECT seq_id, t, {dense.format(a=2500, b=10, m=50, w=4)} AS g0, {dense.format(a=10000, b=20, m=150, w=5)} AS g1, max(t) OVER (PARTITION BY seq_id) AS n FROM q)"
    return f"WITH RECURSIVE {SQL_SEQ}, {g}, o AS (SELECT seq_id, t, n, {b0} AS b0, {b1} AS b1 FROM g)" + _FWD[len(_EMIT) :] + ", w AS (SELECT * FROM f) " + _states("a0", "a1")


@query(_sql_pairs("g0", "g1"))
def hmm_vector_forward(spark, sf_dir):
    return hmm.recursions(_pairs(spark, sf_dir), PAIRS).select("seq_id", "t", "state", rounded(F.col("log_alpha")).alias("v"))


@query(_sql_pairs(_LSE.format(a="(ln(0.7) + g0)", b="(ln(0.3) + g1)"), "g1"))
def hmm_mixture_forward(spark, sf_dir):
    return hmm.recursions(_pairs(spark, sf_dir), MIXED).select("seq_id", "t", "state", rounded(F.col("log_alpha")).alias("v"))


# --- linear losses and one pass of solvers

W = [0.3, -0.2]
_Z = "0.3::DOUBLE * x1 - 0.2::DOUBLE * x2"
_SQL_LOSS = {
    "hinge": ("greatest(0, 1 - y * z)", "CASE WHEN y * z < 1 THEN -y ELSE 0 END"),
    "sqhinge": ("pow(greatest(0, 1 - y * z), 2)", "CASE WHEN y * z < 1 THEN -2 * y * (1 - y * z) ELSE 0 END"),
    "logistic": ("greatest(-y * z, 0) + ln(1 + exp(-abs(y * z)))", "(1 / (1 + exp(-y * z)) - 1) * y"),
}
_NAMES = {"hinge": "l1", "sqhinge": "l2", "logistic": "logistic"}


def _loss_query(name):
    f, g = _SQL_LOSS[name]

    def run(spark, sf_dir):
        d = Design(line_points(spark, sf_dir), ["x1", "x2"])
        value, gradient = linear.value_and_gradient(d, np.array(W), _NAMES[name])
        return frame(spark, [(round(value, 3), *(round(float(x), 3) for x in gradient))], "loss double, g1 double, g2 double")

    run.__name__ = f"{name}_loss_grad"
    return query(f"WITH {SQL_LINES}, z AS (SELECT *, {_Z} AS z FROM d) SELECT round(sum({f}), 3) + 0.0::DOUBLE AS loss, round(sum(({g}) * x1), 3) + 0.0::DOUBLE AS g1, round(sum(({g}) * x2), 3) + 0.0::DOUBLE AS g2 FROM z")(run)


for _name in _SQL_LOSS:
    _loss_query(_name)


@query(f"WITH {SQL_LINES}, z AS (SELECT *, 1 / (1 + exp(-y * ({_Z}))) AS s, 1.0::DOUBLE * x1 + 0.5::DOUBLE * x2 AS u FROM d) SELECT round(sum(s * (1 - s) * u * x1), 3) + 0.0::DOUBLE AS h1, round(sum(s * (1 - s) * u * x2), 3) + 0.0::DOUBLE AS h2 FROM z")
def tron_hessvec(spark, sf_dir):
    h = linear.hessian_product(Design(line_points(spark, sf_dir), ["x1", "x2"]), np.array(W), np.array([1.0, 0.5]), "logistic")
    return frame(spark, [tuple(round(float(x), 3) for x in h)], "h1 double, h2 double")


@query(f"WITH {SQL_LINES}, z AS (SELECT *, {_Z} AS z, 1.0::DOUBLE * x1 + 0.5::DOUBLE * x2 AS u FROM d) SELECT round(coalesce(sum(2 * u * x1) FILTER (y * z < 1), 0), 3) + 0.0::DOUBLE AS h1, round(coalesce(sum(2 * u * x2) FILTER (y * z < 1), 0), 3) + 0.0::DOUBLE AS h2 FROM z")
def tr_hessvec(spark, sf_dir):
    h = linear.hessian_product(Design(line_points(spark, sf_dir), ["x1", "x2"]), np.array(W), np.array([1.0, 0.5]), "l2")
    return frame(spark, [tuple(round(float(x), 3) for x in h)], "h1 double, h2 double")


def _steps(head, steps, out):
    """WITH head, then named steps, then the select."""
    return f"WITH {head}, " + ", ".join(f"{n} AS ({s})" for n, s in steps) + f" {out}"


def _sql_pegasos(k):
    steps = [("w0", "SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b")]
    for i in range(1, k + 1):
        g = ", ".join(f"sum(CASE WHEN y * (a * x1 + b * x2) < 1 THEN -y * x{j} ELSE 0 END) AS g{j}" for j in (1, 2))
        steps += [(f"g{i}", f"SELECT any_value(a) AS a, any_value(b) AS b, {g} FROM d, w{i - 1}"), (f"u{i}", f"SELECT a - (1000 * a + g1) / ({i} * 1000) AS a, b - (1000 * b + g2) / ({i} * 1000) AS b FROM g{i}")]
        steps.append((f"w{i}", f"SELECT a / greatest(1, sqrt(a * a + b * b) * sqrt(1000)) AS a, b / greatest(1, sqrt(a * a + b * b) * sqrt(1000)) AS b FROM u{i}"))
    return _steps(SQL_LINES, steps, f"SELECT round(a, 6) + 0.0::DOUBLE AS w1, round(b, 6) + 0.0::DOUBLE AS w2 FROM w{k}")


def _weights(spark, v):
    return frame(spark, [tuple(float(x) for x in v)], "w1 double, w2 double")


@query(_sql_pegasos(3))
def pegasos_3steps(spark, sf_dir):
    return _weights(spark, linear.pegasos(Design(line_points(spark, sf_dir).cache(), ["x1", "x2"]), 1000.0, "l1", steps=3))


def _sql_split():
    steps = [("h", "SELECT 0.25 * 0.01 * sum(x1 * x1) AS h1, 0.25 * 0.01 * sum(x2 * x2) AS h2 FROM d"), ("w0", "SELECT 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2, 0.0::DOUBLE AS m1, 0.0::DOUBLE AS m2")]
    for k, (name, j, sign) in enumerate((("p1", 1, 1), ("p2", 2, 1), ("m1", 1, -1), ("m2", 2, -1)), 1):
        g = f"SELECT 0.01 * sum((1 / (1 + exp(-y * ((p1 - m1) * x1 + (p2 - m2) * x2))) - 1) * y * x{j}) AS g FROM d, w{k - 1}"
        cols = ", ".join(f"{c} + greatest(-{c}, -({sign} * g + 1) / h{j}) AS {c}" if c == name else c for c in ("p1", "p2", "m1", "m2"))
        steps += [(f"g{k}", g), (f"w{k}", f"SELECT {cols} FROM w{k - 1}, g{k}, h")]
    return _steps(SQL_LINES, steps, "SELECT round(p1 - m1, 6) + 0.0::DOUBLE AS w1, round(p2 - m2, 6) + 0.0::DOUBLE AS w2 FROM w4")


@query(_sql_split())
def sgd_1pass(spark, sf_dir):
    return _weights(spark, linear.coordinate_descent_split(Design(line_points(spark, sf_dir).cache(), ["x1", "x2"]), 0.01, 4))


def _sql_cdsvm():
    steps = [("h", "SELECT 2 * sum(x1 * x1) AS h1, 2 * sum(x2 * x2) AS h2 FROM d"), ("w0", "SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b")]
    for k, (c, j) in enumerate((("a", 1), ("b", 2)), 1):
        g = f"SELECT 10 * any_value({c}) + sum(CASE WHEN y * (a * x1 + b * x2) < 1 THEN -2 * y * (1 - y * (a * x1 + b * x2)) * x{j} ELSE 0 END) AS g, 10 + sum(CASE WHEN y * (a * x1 + b * x2) < 1 THEN 2 * x{j} * x{j} ELSE 0 END) AS c FROM d, w{k - 1}"
        size = f"CASE WHEN c / ((10 + h{j}) / 2 + 0.01) >= 1 THEN 1 ELSE pow(0.9::DOUBLE, ceil(ln(c / ((10 + h{j}) / 2 + 0.01)) / ln(0.9))) END"
        cols = f"a - {size} * g / c AS a, b" if c == "a" else f"a, b - {size} * g / c AS b"
        steps += [(f"g{k}", g), (f"w{k}", f"SELECT {cols} FROM w{k - 1}, g{k}, h")]
    return _steps(SQL_LINES, steps, "SELECT round(a, 6) + 0.0::DOUBLE AS w1, round(b, 6) + 0.0::DOUBLE AS w2 FROM w2")


@query(_sql_cdsvm())
def cdsvm_1pass(spark, sf_dir):
    return _weights(spark, linear.cdsvm(Design(line_points(spark, sf_dir).cache(), ["x1", "x2"]), 10.0, passes=1))


def _fit(name, solve):
    def run(spark, sf_dir):
        d = Design(labelled_documents(spark, sf_dir).repartition(2).cache(), ["x1", "x2"])
        v = solve(d)
        return _weights(spark, v)

    run.__name__ = name
    return query()(run)


_fit("bbr_fit", lambda d: linear.bbr(d, 0.1, passes=6))
_fit("cdn_fit", lambda d: linear.cdn(d, 0.1, passes=6))
_fit("glmnet_fit", lambda d: linear.new_glmnet(d, 0.1, rounds=6))
_fit("tron_fit", lambda d: linear.tron(d, 0.1, rounds=8))
_fit("trust_region_fit", lambda d: linear.trust_region(d, 1.0, "l2", rounds=8))
_fit("cmls_fit", lambda d: linear.cmls(d, 1.0, "l2", passes=6))
_fit("mfn_fit", lambda d: linear.mfn(d, 1.0, rounds=6))


@query(f"WITH {SQL_DOCS} SELECT id, round({_Z}, 6) + 0.0::DOUBLE AS score, (CASE WHEN {_Z} > 0 THEN 1 ELSE -1 END)::BIGINT AS predicted FROM d")
def linear_predict_doc(spark, sf_dir):
    return linear.predict(labelled_documents(spark, sf_dir), ["x1", "x2"], W).select("id", rounded(F.col("score")).alias("score"), "predicted")


# --- kernels: the support is one vector of each label, the one with the smallest id


@query(f"WITH {SQL_VEC}, s AS (SELECT label, arg_min(v, id) AS u, (CASE WHEN label % 2 = 0 THEN 0.5 ELSE -0.5 END)::DOUBLE AS c FROM v GROUP BY label) SELECT v.id, round(sum(c * exp(-0.5 * pow(list_distance(v.v, u), 2))) - 0.1, 6) + 0.0::DOUBLE AS score FROM v, s GROUP BY v.id")
def svm_kernel_score(spark, sf_dir):
    v = vectors(spark, sf_dir)
    s = v.groupBy("label").agg(F.min_by("v", "id").alias("v")).select("v", F.when(F.col("label") % 2 == 0, 0.5).otherwise(-0.5).alias("coef"))
    return kernel.kernel_score(v.select("id", "v"), "v", s, 0.1, 0.5).select("id", rounded(F.col("score")).alias("score"))


def _all_users(spark, sf_dir):
    """(id, x, y) of every user, by id, as the training set of the sequential solvers; equal users are not merged; over ``kernel.MOST_ROWS`` users raise. y is a label by x."""
    got = kernel.bounded(user_points(spark, sf_dir), ["id", *XY], exact=("id",))
    order = got["id"].argsort()
    x = np.stack([got[c][order] for c in XY], 1)
    if np.isnan(x).any():
        raise ValueError("a user has no mean or spread")
    return got["id"][order], x, np.where(x[:, 0] + 0.3 * x[:, 1] > 0, 1.0, -1.0)


@query()
def smo_fit(spark, sf_dir):
    """SMO on all users; every user is scored."""
    _, x, y = _all_users(spark, sf_dir)
    x, y, n = kernel.merged(x, y)
    m = kernel.smo(kernel.KernelColumns(x, 0.5), y, 1.0, weight=n)
    held = m.alpha > 1e-12
    scores = kernel.kernel_sums(user_points(spark, sf_dir), "id", XY, x[held], (m.alpha * y)[held], 0.5, m.threshold)
    return scores.select("id", rounded(F.col("scores")[0]).alias("score"))


@query()
def multisvm_fit(spark, sf_dir):
    """The multi-class dual on all users, with a prediction for every user."""
    _, x, _ = _all_users(spark, sf_dir)
    x, y, n = kernel.merged(x, (x[:, 0] > 0).astype(int) + (x[:, 1] > 0).astype(int))
    alpha = kernel.multi_class_dual(kernel.KernelColumns(x, 0.5), y.astype(int), 3, weight=n)
    held = np.abs(alpha).max(1) > 1e-12
    users = user_points(spark, sf_dir)
    scores = kernel.kernel_sums(users, "id", XY, x[held], alpha[held], 0.5)
    label = users.select(F.col("id").alias("i"), ((F.col("x") > 0).cast("long") + (F.col("y") > 0).cast("long")).alias("label"))
    return label.join(scores, F.col("i") == F.col("id")).select("id", "label", (F.array_position("scores", F.array_max("scores")) - 1).alias("predicted"))


@query()
def cddual_fit(spark, sf_dir):
    _, x, y = _all_users(spark, sf_dir)
    df = spark.createDataFrame(pa.table({"x1": x[:, 0], "x2": x[:, 1], "y": y}))
    return _weights(spark, kernel.dual_coordinates(Design(df, ["x1", "x2"]), 1.0, "l2"))


def _gp_query(name, fit):
    def run(spark, sf_dir):
        _, x, y = _all_users(spark, sf_dir)
        return gp.predict(user_points(spark, sf_dir), "id", XY, fit(x, y)).withColumn("p", rounded(F.col("p")))

    run.__name__ = name
    return query()(run)


_gp_query("gpc_laplace", lambda x, y: gp.laplace(x, y, 0.5))
_gp_query("gpc_ep", lambda x, y: gp.expectation_propagation(x, y, 0.5))
_gp_query("gpc_search", lambda x, y: gp.laplace_search(x, y, 0.05, 5.0, 6))


# --- trees over lineitem: is a line returned?


def _tree_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_linestatus", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))


CONFIG = tree.TreeConfig({"l_quantity": True, "l_discount": True, "l_linestatus": False}, "label", max_depth=2)
_T = "t AS (SELECT l_quantity AS q, l_discount AS c, l_linestatus AS s, (l_returnflag = 'R')::INT AS y FROM lineitem)"


def _sql_splits(where="TRUE", node=0):
    per = f"per AS (SELECT 0 AS k, q AS num, NULL AS cat, count(*) AS n, sum(1 - y) AS w0, sum(y) AS w1 FROM t WHERE {where} GROUP BY q UNION ALL SELECT 1, c, NULL, count(*), sum(1 - y), sum(y) FROM t WHERE {where} GROUP BY c UNION ALL SELECT 2, NULL, s, count(*), sum(1 - y), sum(y) FROM t WHERE {where} GROUP BY s)"
    cum = "cum AS (SELECT *, CASE WHEN num IS NULL THEN w0 ELSE sum(w0) OVER o END AS l0, CASE WHEN num IS NULL THEN w1 ELSE sum(w1) OVER o END AS l1, sum(w0) OVER (PARTITION BY k) AS a0, sum(w1) OVER (PARTITION BY k) AS a1, lead(num) OVER (PARTITION BY k ORDER BY num) AS nx, count(*) OVER (PARTITION BY k) AS nv FROM per WINDOW o AS (PARTITION BY k ORDER BY num ROWS UNBOUNDED PRECEDING))"
    gini = "(1 - pow({0} / ({0} + {1}), 2) - pow({1} / ({0} + {1}), 2))"
    gain = f"((a0 + a1) / (SELECT count(*) FROM t) * ({gini.format('a0', 'a1')} - ((l0 + l1) * {gini.format('l0', 'l1')} + (a0 - l0 + a1 - l1) * {gini.format('(a0 - l0)', '(a1 - l1)')}) / (a0 + a1)))"
    return f"{per}, {cum}, sp AS (SELECT {node} AS node, k, CASE WHEN num IS NOT NULL THEN (num + nx) / 2 END AS threshold, cat, {gain} AS gain, (l0 + l1)::BIGINT AS n_left FROM cum WHERE (num IS NOT NULL AND nx - num > 1e-8) OR (num IS NULL AND nv > 1))"


@query(f"WITH {_T}, {_sql_splits()} SELECT k::BIGINT AS k, coalesce(round(threshold, 6), -1.0::DOUBLE) AS threshold, coalesce(cat, '') AS cat, round(gain, 9) + 0.0::DOUBLE AS gain, n_left FROM sp")
def gini_splits_line(spark, sf_dir):
    """Every split of the root, with its gain."""
    rows = _tree_rows(spark, sf_dir).withColumn("node", F.lit(0))
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    scale = {c: 1 / sum(totals.values()) for c in totals}
    s = tree.split_table(rows, "node", CONFIG, sorted(totals), scale)
    return s.select(F.col("k").cast("long").alias("k"), F.coalesce(rounded(F.col("threshold")), F.lit(-1.0)).alias("threshold"), F.coalesce("cat", F.lit("")).alias("cat"), rounded(F.col("gain"), 9).alias("gain"), "n_left")


@query(f"WITH {_T}, {_sql_splits()} SELECT ['l_quantity', 'l_discount', 'l_linestatus'][k + 1] AS attribute, coalesce(round(threshold, 6), -1.0::DOUBLE) AS threshold, coalesce(cat, '') AS cat, round(gain, 9) AS gain FROM sp ORDER BY round(gain, 12) DESC, k, threshold, cat LIMIT 1")
def tree_root_line(spark, sf_dir):
    t = tree.grow(_tree_rows(spark, sf_dir), tree.TreeConfig(CONFIG.attributes, "label", max_depth=1))
    n = t.nodes[0]
    return frame(spark, [(n.attribute, float(n.value) if n.op == "<=" else -1.0, "" if n.op == "<=" else n.value, round(float(n.gain), 9))], "attribute string, threshold double, cat string, gain double") if n.attribute is None else spark.createDataFrame([(n.attribute, round(float(n.value), 6) if n.op == "<=" else -1.0, "" if n.op == "<=" else n.value, round(float(n.gain), 9))], "attribute string, threshold double, cat string, gain double")


def _grown(spark, sf_dir):
    return tree.grow(_tree_rows(spark, sf_dir).cache(), CONFIG)


_MULTIWAY = """WITH t AS (SELECT p_brand, p_type, (p_size > 25)::INT AS y FROM part), c AS (SELECT 0 AS k, p_brand AS cat, count(*) AS n, sum(y) AS s FROM t GROUP BY 2 UNION ALL SELECT 1, p_type, count(*), sum(y) FROM t GROUP BY 2),
a AS (SELECT count(*) AS n, sum(y) AS s FROM t), g AS (SELECT k, count(*) AS children, any_value(1 - pow(a.s / a.n, 2) - pow(1 - a.s / a.n, 2)) - sum(c.n / a.n * (1 - pow(c.s / c.n, 2) - pow(1 - c.s / c.n, 2))) AS gain FROM c, a GROUP BY k)
SELECT ['p_brand', 'p_type'][k + 1] AS attribute, children, round(gain, 9) + 0.0::DOUBLE AS gain FROM g ORDER BY round(gain, 12) DESC, k LIMIT 1"""


@query(_MULTIWAY)
def tree_multiway_part(spark, sf_dir):
    """The root's split into all categories of an attribute at once."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_type", F.when(F.col("p_size") > 25, 1).otherwise(0).alias("label"))
    n = tree.grow(rows, tree.TreeConfig({"p_brand": False, "p_type": False}, "label", max_depth=1, multiway=True)).nodes[0]
    return spark.createDataFrame([(n.attribute, len(n.children), round(float(n.gain), 9) + 0.0)], "attribute string, children long, gain double")


@query()
def tree_nodes_line(spark, sf_dir):
    t = _grown(spark, sf_dir)
    return spark.createDataFrame([(i, n.parent if n.parent is not None else -1, n.attribute or "", str(n.value or ""), float(n.gain), float(sum(n.counts.values()))) for i, n in t.nodes.items()], "node long, parent long, attribute string, value string, gain double, weight double")


@query()
def tree_route_line(spark, sf_dir):
    return _grown(spark, sf_dir).predict(_tree_rows(spark, sf_dir)).groupBy("leaf", "label", "predicted").agg(F.count("*").alias("n"))


@query()
def tree_rules_line(spark, sf_dir):
    return spark.createDataFrame([(leaf, text, int(label)) for leaf, text, label in _grown(spark, sf_dir).rules()], "leaf long, rule string, label long")


@query()
def tree_risk_line(spark, sf_dir):
    return frame(spark, [(i, r, rt, n, -1.0 if g is None else g) for i, r, rt, n, g in _grown(spark, sf_dir).risks()], "node long, risk double, subtree_risk double, leaves long, g double")


@query()
def weakest_link_line(spark, sf_dir):
    return frame(spark, [(k, a, len(t.leaves())) for k, (a, t) in enumerate(_grown(spark, sf_dir).cost_complexity_path())], "step long, alpha double, leaves long")


@query()
def tree_cv_prune_cust(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", F.when(F.col("c_acctbal") > 4000, 1).otherwise(0).alias("label")).withColumn("fold", F.col("c_custkey") % 3).cache()
    _, costs = tree.cross_validated_prune(c, tree.TreeConfig({"c_acctbal": True, "c_mktsegment": False}, "label", max_depth=2), "fold", 3)
    return frame(spark, costs, "alpha double, cost double")


@query()
def tree_importance_line(spark, sf_dir):
    t = _grown(spark, sf_dir)
    return spark.createDataFrame([(a, round(float(v), 9)) for a, v in tree.surrogate_importance(t, _tree_rows(spark, sf_dir)).items()], "attribute string, importance double")


# --- networks

_W = [0.1, 0.5, -0.4, -0.2, 0.3, 0.6, 0.05, 0.7, -0.3, -0.05, -0.6, 0.2]


@query("""WITH d AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS a, p_retailprice / 1000.0::DOUBLE AS b FROM part), h AS (SELECT p_partkey, tanh(0.1 + 0.5 * a - 0.4 * b) AS h1, tanh(-0.2 + 0.3 * a + 0.6 * b) AS h2 FROM d),
o AS (SELECT p_partkey, 0.05 + 0.7 * h1 - 0.3 * h2 AS o1, -0.05 - 0.6 * h1 + 0.2 * h2 AS o2 FROM h) SELECT p_partkey, (o2 > o1)::BIGINT AS label, round(exp(greatest(o1, o2)) / (exp(o1) + exp(o2)), 6) AS p FROM o""")
def mlp_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("a"), (F.col("p_retailprice") / 1000.0).alias("b"))
    net = nn.Network((nn.Full(2, 2), nn.Full(2, 2, "none")))
    return nn.predict(rows, "p_partkey", ["a", "b"], net, np.array(_W)).withColumn("p", rounded(F.col("p")))


@query()
def mlp_fit(spark, sf_dir):
    rows = user_points(spark, sf_dir).withColumn("label", (F.col("x") > 0).cast("int")).cache()
    net = nn.Network((nn.Full(2, 3), nn.Full(3, 2, "none")))
    _, losses = nn.train(rows, XY, "label", net, net.start(1), rounds=4, inner=4)
    return frame(spark, [(k, float(f)) for k, f in enumerate(losses)], "step long, loss double")


@query()
def conv_forward(spark, sf_dir):
    """A network over the embeddings taken as 8 x 8 planes, with seeded weights."""
    v = vectors(spark, sf_dir).select("id", *(F.col("v")[i].alias(f"v{i}") for i in range(64)))
    conv = nn.Convolution(8, 3, 2, 2)
    net = nn.Network((conv, nn.Full(conv.n_out, 3, "none")))
    return nn.predict(v, "id", [f"v{i}" for i in range(64)], net, net.start(2)).withColumn("p", rounded(F.col("p")))


@query("SELECT r * 3 + c AS place, i * 3 + j AS k, (r + i) * 5 + c + j AS unit FROM range(0, 3) a(r), range(0, 3) b(c), range(0, 3) d(i), range(0, 3) e(j)")
def conv_index(spark, sf_dir):
    return spark.createDataFrame([(p, k, int(u)) for p, row in enumerate(nn.window_index(5, 3)) for k, u in enumerate(row)], "place long, k long, unit long")
