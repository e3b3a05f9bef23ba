"""Queries on preparation, losses, kernels, sets, grids, resampling and covariance."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnmill.functions import scalar as S
from learnmill.operators import prep, stats
from learnmill.sources.tables import SQL_DOCS, SQL_VEC, labelled_documents, table, vectors

from .registry import query, rounded

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) + 0.0::DOUBLE AS z FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)")
def zscore_customer(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return prep.normalize(df, ["c_acctbal"]).select("c_custkey", rounded(F.col("c_acctbal")).alias("z"))


@query("SELECT c_custkey, round(c_acctbal, 4) + 0.0::DOUBLE AS c_acctbal FROM customer")
def unnormalize_customer(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    stats_row = prep.moments(df, ["c_acctbal"])
    return prep.unnormalize(prep.normalize(df, ["c_acctbal"]), stats_row, ["c_acctbal"]).select("c_custkey", rounded(F.col("c_acctbal"), 4).alias("c_acctbal"))


@query("SELECT p_partkey, round(p_size * ln(p_size) - p_size, 6) + 0.0::DOUBLE AS stirling FROM part")
def stirling_part(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rounded(S.log_factorial(F.col("p_size").cast("double"))).alias("stirling"))


@query("WITH m AS (SELECT avg(p_size) AS mu FROM part) SELECT round(sum(-(p_size * ln(mu) - mu - (p_size * ln(p_size) - p_size))), 4) + 0.0::DOUBLE AS nll FROM part, m")
def poisson_nll_part(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("y"))
    return df.crossJoin(F.broadcast(df.agg(F.avg("y").alias("mu")))).agg(rounded(F.sum(S.poisson_loss(F.col("y"), F.col("mu"))), 4).alias("nll"))


@query(f"WITH {SQL_DOCS} SELECT round(sum(CASE WHEN y = 1 THEN -ln(greatest(1 / (1 + exp(-(0.5 * x1 + 0.1 * x2))), 1e-8)) ELSE -ln(greatest(1 - 1 / (1 + exp(-(0.5 * x1 + 0.1 * x2))), 1e-8)) END), 5) + 0.0::DOUBLE AS nll FROM d")
def logistic_nll_doc(spark, sf_dir):
    d = labelled_documents(spark, sf_dir)
    mu = S.sigmoid(0.5 * F.col("x1") + 0.1 * F.col("x2"))
    return d.agg(rounded(F.sum(S.logistic_loss_of_probability(F.col("y"), mu)), 5).alias("nll"))


@query("SELECT l_quantity, round(exp(-((l_quantity - 25) / 10) * ((l_quantity - 25) / 10) / 2) / sqrt(2 * pi()), 9) + 0.0::DOUBLE AS pdf, count(*) AS n FROM lineitem GROUP BY l_quantity")
def normal_pdf_line(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    return counts.select("l_quantity", rounded(S.normal_pdf((F.col("l_quantity") - 25) / 10), 9).alias("pdf"), "n")


@query(f"WITH {SQL_DOCS}, g AS (SELECT y, x1, x2, 1 / (1 + exp(-(0.5 * x1 + 0.1 * x2))) - (y + 1) / 2 AS r FROM d) SELECT round(sum(r * x1), 5) + 0.0::DOUBLE AS g1, round(sum(r * x2), 5) + 0.0::DOUBLE AS g2 FROM g")
def logloss_grad_doc(spark, sf_dir):
    d = labelled_documents(spark, sf_dir)
    r = S.logistic_gradient(F.col("y"), 0.5 * F.col("x1") + 0.1 * F.col("x2"))
    return d.agg(rounded(F.sum(r * F.col("x1")), 5).alias("g1"), rounded(F.sum(r * F.col("x2")), 5).alias("g2"))


@query("SELECT p_partkey, abs(p_retailprice - 950) <= 0.5 AS near, p_retailprice <= 950 + 1e-8 AS below, p_retailprice >= 950 - 1e-8 AS above FROM part")
def tolerance_part(spark, sf_dir):
    p = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", S.isclose(p, F.lit(950.0), 0.5).alias("near"), S.less_equal(p, F.lit(950.0)).alias("below"), S.large_equal(p, F.lit(950.0)).alias("above"))


def _pairs(spark, sf_dir):
    # a kernel is between two sets: the query set is every vector with an id divisible by 50, against all
    v = vectors(spark, sf_dir)
    few = F.broadcast(v.where(F.col("id") % 50 == 0).select(F.col("id").alias("j"), F.col("v").alias("u")))
    return v.crossJoin(few)


_PAIRS = f"WITH {SQL_VEC} SELECT a.id AS i, b.id AS j, {{}} AS k FROM v a, v b WHERE b.id % 50 = 0"


@query(_PAIRS.format("round(list_dot_product(a.v, b.v), 6) + 0.0::DOUBLE"))
def linear_kernel_emb(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("id").alias("i"), "j", rounded(S.dot(F.col("v"), F.col("u"))).alias("k"))


@query(_PAIRS.format("round(pow(list_distance(a.v, b.v), 2), 6) + 0.0::DOUBLE"))
def sqdist_emb(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("id").alias("i"), "j", rounded(S.squared_distance(F.col("v"), F.col("u"))).alias("k"))


@query(_PAIRS.format("round(exp(-0.5 * pow(list_distance(a.v, b.v), 2)), 6) + 0.0::DOUBLE"))
def rbf_emb(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("id").alias("i"), "j", rounded(S.rbf(F.col("v"), F.col("u"), 0.5)).alias("k"))


@query(_PAIRS.format("round(-pow(list_distance(a.v, b.v), 2) * exp(-0.5 * pow(list_distance(a.v, b.v), 2)), 6) + 0.0::DOUBLE"))
def rbf_derivative_emb(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("id").alias("i"), "j", rounded(S.rbf_derivative(F.col("v"), F.col("u"), 0.5)).alias("k"))


@query("SELECT p_size, min(p_partkey) AS first_order, count(*) AS n, dense_rank() OVER (ORDER BY p_size) - 1 AS rank FROM part GROUP BY p_size")
def unique_index_counts_part(spark, sf_dir):
    return prep.unique(table(spark, sf_dir, "part"), "p_size", "p_partkey")


def _order_lists(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")))).alias("b"))
    return li


_LISTS = "WITH o AS (SELECT l_orderkey, coalesce(list_sort(list(DISTINCT l_linenumber) FILTER (l_returnflag <> 'R')), []) AS a, coalesce(list_sort(list(DISTINCT l_linenumber) FILTER (l_linestatus = 'O')), []) AS b FROM lineitem GROUP BY 1) "


def _text(column):
    return F.concat_ws(",", column.cast("array<string>")).alias("s")


@query(_LISTS + "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS s FROM o")
def set_union(spark, sf_dir):
    return _order_lists(spark, sf_dir).select("l_orderkey", _text(S.sorted_union(F.col("a"), F.col("b"))))


@query(_LISTS + "SELECT l_orderkey, coalesce(array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ','), '') AS s FROM o")
def set_difference(spark, sf_dir):
    return _order_lists(spark, sf_dir).select("l_orderkey", _text(S.sorted_difference(F.col("a"), F.col("b"))))


@query(_LISTS + "SELECT l_orderkey, coalesce(array_to_string(list_filter(a, lambda x: list_contains(b, x)), ','), '') AS s FROM o")
def set_intersection(spark, sf_dir):
    return _order_lists(spark, sf_dir).select("l_orderkey", _text(S.sorted_intersection(F.col("a"), F.col("b"))))


@query(_LISTS + "SELECT l_orderkey, (coalesce(nullif(list_position(a, 3), 0), 0) - 1)::BIGINT AS at, len(list_filter(a, lambda x: x < 3))::BIGINT AS left_most, (len(list_filter(a, lambda x: x <= 3)) - 1)::BIGINT AS right_most FROM o")
def sorted_search(spark, sf_dir):
    a = F.col("a")
    return _order_lists(spark, sf_dir).select("l_orderkey", F.coalesce(S.search(a, F.lit(3)), F.lit(-1)).cast("long").alias("at"), S.left_most(a, F.lit(3)).cast("long").alias("left_most"), S.right_most(a, F.lit(3)).cast("long").alias("right_most"))


@query("""WITH e AS (SELECT DISTINCT user_id, event_id // 100 AS v FROM events), i AS (SELECT user_id, v, v - row_number() OVER (PARTITION BY user_id ORDER BY v) AS g FROM e)
SELECT user_id, v, min(v) OVER (PARTITION BY user_id, g) AS "left", max(v) OVER (PARTITION BY user_id, g) AS "right" FROM i""")
def run_ends_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.expr("event_id div 100").alias("v"))
    return prep.continuous_runs(e, "user_id", "v")


_GRID = "WITH r AS (SELECT min(p_size)::DOUBLE AS a0, max(p_size)::DOUBLE AS a1, min(p_retailprice) AS b0, max(p_retailprice) AS b1 FROM part), g AS (SELECT p_partkey, least(greatest(floor((p_size - a0) / ((a1 - a0) / 7)), 0), 6)::BIGINT AS code_p_size, least(greatest(floor((p_retailprice - b0) / ((b1 - b0) / 9)), 0), 8)::BIGINT + 7 AS code_p_retailprice FROM part, r) "
_AXES = ["p_size", "p_retailprice"]


def _grid(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", *_AXES)
    (lo1, w1, _), (lo2, w2, _) = prep.grid_knots(p, _AXES, bins=7)[0], prep.grid_knots(p, _AXES, bins=9)[1]
    return prep.grid_codes(p, _AXES, [(lo1, w1, 7), (lo2, w2, 9)])


@query(_GRID + "SELECT p_partkey, code_p_size, code_p_retailprice FROM g")
def grid_codes_part(spark, sf_dir):
    return _grid(spark, sf_dir).select("p_partkey", "code_p_size", "code_p_retailprice")


@query(_GRID + "SELECT 0::BIGINT AS axis, code_p_size AS code, count(*) AS n FROM g GROUP BY 2 UNION ALL SELECT 1::BIGINT, code_p_retailprice, count(*) FROM g GROUP BY 2")
def grid_hist_part(spark, sf_dir):
    return prep.grid_histogram(_grid(spark, sf_dir), _AXES)


@query("WITH r AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), k AS (SELECT lo - (ceil((hi - lo) / 13.7) * 13.7 - (hi - lo)) / 2 AS a, ceil((hi - lo) / 13.7) AS n FROM r) SELECT p_partkey, least(greatest(floor((p_retailprice - a) / 13.7::DOUBLE), 0), n - 1)::BIGINT AS code FROM part, k".replace("13.7)", "13.7::DOUBLE)").replace("* 13.7 ", "* 13.7::DOUBLE "))
def grid_size_mode(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return prep.grid_codes(p, ["p_retailprice"], prep.grid_knots(p, ["p_retailprice"], width=13.7)).select("p_partkey", F.col("code_p_retailprice").alias("code"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(abs(c_acctbal)), 4) + 0.0::DOUBLE AS weight FROM customer GROUP BY 1")
def class_stats_customer(spark, sf_dir):
    return stats.class_stats(table(spark, sf_dir, "customer"), "c_mktsegment", F.abs("c_acctbal")).withColumn("weight", rounded(F.col("weight"), 4))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) + 0.0::DOUBLE AS weight FROM lineitem GROUP BY 1")
def class_weights_line(spark, sf_dir):
    return stats.class_stats(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_quantity")).withColumn("weight", rounded(F.col("weight"), 4))


@query("WITH t AS (SELECT c_mktsegment, count(*) AS a FROM customer GROUP BY 1), s AS (SELECT sum(a) AS z FROM t), n AS (SELECT c_nationkey, c_mktsegment, count(*) AS k FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment, round(a / z * k / a, 9) + 0.0::DOUBLE AS p FROM n JOIN t USING (c_mktsegment), s")
def class_probs_customer(spark, sf_dir):
    return stats.class_probabilities(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment").withColumn("p", rounded(F.col("p"), 9))


@query("SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) // (SELECT ceil(count(*) / 7)::BIGINT FROM customer))::BIGINT AS fold FROM customer")
def kfold_customer(spark, sf_dir):
    return stats.folds(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7)


@query("""WITH d AS (SELECT c_acctbal, k AS draw, ('0x' || substr(md5(c_custkey || '-' || k || '-0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM customer, range(0, 5) t(k)),
w AS (SELECT draw, c_acctbal, CASE WHEN u < 0.367879441 THEN 0 WHEN u < 0.735758882 THEN 1 WHEN u < 0.919698603 THEN 2 WHEN u < 0.981011843 THEN 3 WHEN u < 0.996340153 THEN 4 WHEN u < 0.999405815 THEN 5 ELSE 6 END AS w FROM d)
SELECT draw, sum(w)::BIGINT AS n, round(sum(w * c_acctbal) / sum(w), 5) + 0.0::DOUBLE AS mean FROM w GROUP BY draw""")
def bootstrap_hash(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return stats.bootstrap(df, "c_custkey", lambda d: d.groupBy("draw").agg(F.sum("w").alias("n"), rounded(F.sum(F.col("w") * F.col("c_acctbal")) / F.sum("w"), 5).alias("mean")), 5)


@query("""WITH f AS (SELECT p_partkey % 5 AS fold, p_size / 50.0::DOUBLE AS x, p_retailprice / 1000.0::DOUBLE AS y FROM part), s AS (SELECT fold, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM f GROUP BY 1), t AS (SELECT sum(xx) AS txx, sum(xy) AS txy FROM s),
g AS (SELECT unnest([0.1, 1.0, 10.0, 100.0])::DOUBLE AS penalty)
SELECT penalty, round(sum(yy - 2 * ((txy - xy) / (txx - xx + penalty)) * xy + pow((txy - xy) / (txx - xx + penalty), 2) * xx), 6) + 0.0::DOUBLE AS loss FROM s, t, g GROUP BY penalty""")
def cv_ridge_grid(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("fold"), (F.col("p_size") / 50.0).alias("x"), (F.col("p_retailprice") / 1000.0).alias("y"))
    return stats.cross_validate_ridge(p, "x", "y", "fold", [0.1, 1.0, 10.0, 100.0]).withColumn("loss", rounded(F.col("loss")))


def _class_means(spark, sf_dir):
    v = vectors(spark, sf_dir)
    m = v.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
    m = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("c"))
    return v, F.broadcast(m.withColumnRenamed("label", "cls"))


_MEANS = f"WITH {SQL_VEC}, e AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM v), m AS (SELECT label AS cls, list(a ORDER BY k) AS c FROM (SELECT label, k, avg(x) AS a FROM e GROUP BY 1, 2) GROUP BY 1) "


@query(_MEANS + ", s AS (SELECT id, cls, round(list_dot_product(v.v, c), 9) AS score FROM v, m) SELECT id, arg_max(cls, score * 1e6 - cls * 1e-9) AS label FROM s GROUP BY id")
def ovr_argmax_emb(spark, sf_dir):
    v, m = _class_means(spark, sf_dir)
    scores = v.select("id", "v").crossJoin(m).select("id", F.col("cls").alias("label"), F.round(S.dot(F.col("v"), F.col("c")), 9).alias("score"))
    return stats.one_versus_rest(scores, "id", "label", "score")


@query(_MEANS + """, s AS (SELECT id, a.cls AS a, b.cls AS b, round(list_dot_product(v.v, a.c), 9) - round(list_dot_product(v.v, b.c), 9) AS d FROM v, m a, m b WHERE a.cls < b.cls),
w AS (SELECT id, a AS cls, (d > 0)::INT AS k FROM s UNION ALL SELECT id, b, (d < 0)::INT FROM s), t AS (SELECT id, cls, sum(k) AS n FROM w GROUP BY 1, 2) SELECT id, arg_max(cls, n * 1000 - cls) AS label FROM t GROUP BY id""")
def ovo_vote_emb(spark, sf_dir):
    v, m = _class_means(spark, sf_dir)
    s = v.select("id", "v").crossJoin(m.select(F.col("cls").alias("a"), F.col("c").alias("ca"))).crossJoin(m.select(F.col("cls").alias("b"), F.col("c").alias("cb"))).where("a < b")
    s = s.select("id", "a", "b", (F.round(S.dot(F.col("v"), F.col("ca")), 9) - F.round(S.dot(F.col("v"), F.col("cb")), 9)).alias("score"))
    return stats.one_versus_one(s, "id", "a", "b", "score")


_LONG = "WITH l AS (SELECT l_quantity AS a0, l_extendedprice / 1000.0::DOUBLE AS a1, l_discount * 100 AS a2, l_tax * 100 AS a3 FROM lineitem)"


def _line(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a0"), (F.col("l_extendedprice") / 1000.0).alias("a1"), (F.col("l_discount") * 100).alias("a2"), (F.col("l_tax") * 100).alias("a3"))


_COV = " UNION ALL ".join(f"SELECT {i}::BIGINT AS i, {j}::BIGINT AS j, round(covar_samp(a{i}, a{j}), 6) + 0.0::DOUBLE AS value FROM l" for i in range(4) for j in range(4))


@query(f"{_LONG} {_COV}")
def cov_line(spark, sf_dir):
    return stats.matrix_frame(spark, stats.covariance(_line(spark, sf_dir), ["a0", "a1", "a2", "a3"], 1))


@query("WITH c AS (SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT), (0, 1), (1, 0), (1, 1)) t(i, j)), l AS (SELECT l_quantity AS a0, l_extendedprice / 1000.0::DOUBLE AS a1 FROM lineitem), s AS (SELECT covar_pop(a0, a0) AS s00, covar_pop(a0, a1) AS s01, covar_pop(a1, a1) AS s11 FROM l) SELECT i, j, round(CASE WHEN i = 0 AND j = 0 THEN s00 WHEN i = 1 AND j = 1 THEN s11 ELSE s01 END, 6) + 0.0::DOUBLE AS value FROM c, s")
def constcorr_shrink_two_line(spark, sf_dir):
    """With two columns the target equals the sample, so any intensity gives the sample back."""
    return stats.matrix_frame(spark, stats.constant_correlation_shrinkage(_line(spark, sf_dir).select("a0", "a1"), ["a0", "a1"])[0])


def _sql_constcorr3() -> str:
    """Three columns, written out by a template over index pairs."""
    r3 = range(3)
    pr = [(i, j) for i in r3 for j in r3 if i <= j]
    s = ", ".join(f"avg(d{i}*d{j}) AS s{i}{j}" for i, j in pr)
    sym = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    v = ", ".join(f"avg(pow(d{i}*d{j} - s{i}{j}, 2)) AS v{i}{j}" for i, j in pr)
    t = ", ".join(f"avg((d{i}*d{i} - s{i}{i}) * (d{i}*d{j} - {sym(i, j)})) AS t{i}{j}" for i in r3 for j in r3 if i != j)
    rbar = "(" + " + ".join(f"s{i}{j} / sqrt(s{i}{i} * s{j}{j})" for i, j in pr if i < j) + ") / 3"
    pi = " + ".join(f"{1 if i == j else 2} * v{i}{j}" for i, j in pr)
    rho = " + ".join(f"v{i}{i}" for i in r3) + " + r / 2 * (" + " + ".join(f"sqrt(s{j}{j} / s{i}{i}) * t{i}{j} + sqrt(s{i}{i} / s{j}{j}) * t{j}{i}" for i in r3 for j in r3 if i != j) + ")"
    gamma = " + ".join(f"2 * pow(s{i}{j} - r * sqrt(s{i}{i} * s{j}{j}), 2)" for i, j in pr if i < j)
    cells = " UNION ALL ".join(f"SELECT {i}::BIGINT AS i, {j}::BIGINT AS j, round({'s%d%d' % (i, i) if i == j else f'k * r * sqrt(s{i}{i} * s{j}{j}) + (1 - k) * {sym(i, j)}'}, 5) + 0.0::DOUBLE AS value FROM z" for i in r3 for j in r3)
    return f"{_LONG}, x AS (SELECT {', '.join(f'a{i} - avg(a{i}) OVER () AS d{i}' for i in r3)} FROM l), s AS (SELECT {s}, count(*) AS n FROM x), q AS (SELECT {v}, {t} FROM x, s), r AS (SELECT *, {rbar} AS r FROM s, q), z AS (SELECT *, least(greatest((({pi}) - ({rho})) / ({gamma}) / n, 0), 1) AS k FROM r) {cells}"


@query(_sql_constcorr3())
def constcorr_shrink_line(spark, sf_dir):
    return stats.matrix_frame(spark, stats.constant_correlation_shrinkage(_line(spark, sf_dir), ["a0", "a1", "a2"])[0], 5)


def _sql_oas() -> str:
    r = range(3)
    s = ", ".join(f"covar_samp(a{i}, a{j}) AS s{i}{j}" for i in r for j in r)
    t2 = " + ".join(f"s{i}{j} * s{i}{j}" for i in r for j in r)
    cells = " UNION ALL ".join(f"SELECT {i}::BIGINT AS i, {j}::BIGINT AS j, round((1 - k) * s{i}{j}{' + k * t1 / 3' if i == j else ''}, 5) + 0.0::DOUBLE AS value FROM z" for i in r for j in r)
    return f"{_LONG}, s AS (SELECT {s}, count(*) AS n FROM l), t AS (SELECT *, s00 + s11 + s22 AS t1, {t2} AS t2 FROM s), z AS (SELECT *, least(greatest(((1 - 2 / 3.0::DOUBLE) * t2 + t1 * t1) / ((n + 1 - 2 / 3.0::DOUBLE) * (t2 - t1 * t1 / 3)), 0), 1) AS k FROM t) {cells}"


@query(_sql_oas())
def oas_shrink_line(spark, sf_dir):
    return stats.matrix_frame(spark, stats.oas_shrinkage(_line(spark, sf_dir), ["a0", "a1", "a2"])[0], 5)


@query("""WITH x AS (SELECT c_custkey, c_acctbal / 4000.0::DOUBLE - 1.0 AS x FROM customer), t AS (SELECT c_custkey, x, unnest(range(0, 61)) AS n FROM x)
SELECT c_custkey, round(0.5 + exp(-any_value(x) * any_value(x) / 2) / sqrt(2 * pi()) * sum(x * power(x * x / 2, n) * sqrt(pi()) / (2 * gamma(n + 1.5::DOUBLE))), 6) AS cdf FROM t GROUP BY 1""")
def normal_cdf_customer(spark, sf_dir):
    x = F.col("c_acctbal") / 4000.0 - 1.0
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(S.normal_cdf(x), 6).alias("cdf"))


_FLAGS = "WITH d AS (SELECT l_returnflag AS label, l_quantity / 50.0::DOUBLE AS x1, l_discount * 10.0::DOUBLE AS x2, l_tax * 10.0::DOUBLE AS x3 FROM lineitem), c AS (SELECT DISTINCT label FROM d)"


def _flags(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), (F.col("l_quantity") / 50.0).alias("x1"), (F.col("l_discount") * 10.0).alias("x2"), (F.col("l_tax") * 10.0).alias("x3"))


def _predicted(spark, sf_dir, train_all):
    rows, columns = _flags(spark, sf_dir), ["x1", "x2", "x3"]
    models = train_all(rows, "label", lambda d: stats.mean_difference(d, columns))
    out = stats.multi_class_predict(rows, models, lambda m: F.round(stats.linear_score(m, columns), 9))
    return out.groupBy("label", "predicted").agg(F.count("*").alias("n"))


_SCORE = "round((m.a1 - m.b1) * (d.x1 - (m.a1 + m.b1) / 2) + (m.a2 - m.b2) * (d.x2 - (m.a2 + m.b2) / 2) + (m.a3 - m.b3) * (d.x3 - (m.a3 + m.b3) / 2), 9)"


@query(_FLAGS + f""", r AS (SELECT row_number() OVER () AS i, * FROM d),
m AS (SELECT c.label AS c, avg(x1) FILTER (d.label = c.label) AS a1, avg(x2) FILTER (d.label = c.label) AS a2, avg(x3) FILTER (d.label = c.label) AS a3, avg(x1) FILTER (d.label <> c.label) AS b1, avg(x2) FILTER (d.label <> c.label) AS b2, avg(x3) FILTER (d.label <> c.label) AS b3 FROM c, d GROUP BY 1),
s AS (SELECT d.i, d.label, m.c, {_SCORE} AS s FROM r d, m), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, c) AS k FROM s)
SELECT label, c AS predicted, count(*) AS n FROM k WHERE k = 1 GROUP BY 1, 2""")
def one_versus_rest_line(spark, sf_dir):
    return _predicted(spark, sf_dir, stats.one_versus_rest_train)


@query(_FLAGS + f""", r AS (SELECT row_number() OVER () AS i, * FROM d), a AS (SELECT label, avg(x1) AS x1, avg(x2) AS x2, avg(x3) AS x3 FROM d GROUP BY 1),
m AS (SELECT p.label AS f, q.label AS g, p.x1 AS a1, p.x2 AS a2, p.x3 AS a3, q.x1 AS b1, q.x2 AS b2, q.x3 AS b3 FROM a p JOIN a q ON p.label < q.label),
s AS (SELECT d.i, d.label, m.f, m.g, {_SCORE} AS s FROM r d, m), v AS (SELECT i, label, f AS c, (s > 0)::INT AS v FROM s UNION ALL SELECT i, label, g, (s < 0)::INT FROM s),
t AS (SELECT i, label, c, sum(v) AS v FROM v GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, c) AS k FROM t)
SELECT label, c AS predicted, count(*) AS n FROM k WHERE k = 1 GROUP BY 1, 2""")
def one_versus_one_line(spark, sf_dir):
    return _predicted(spark, sf_dir, stats.one_versus_one_train)


@query("""WITH d AS (SELECT p_partkey % 4 AS fold, p_size / 50.0::DOUBLE AS x, p_retailprice / 1000.0::DOUBLE AS y FROM part),
g AS (SELECT penalty, power FROM (VALUES (0.0::DOUBLE), (10.0), (100.0)) a(penalty), (VALUES (0.5::DOUBLE), (1.0), (2.0)) b(power)), f AS (SELECT DISTINCT fold FROM d),
b AS (SELECT penalty, power, f.fold, sum(pow(x, power) * y) / (sum(pow(x, power) * pow(x, power)) + penalty) AS b FROM g, f, d WHERE d.fold <> f.fold GROUP BY 1, 2, 3)
SELECT penalty, power, round(sum((y - b * pow(x, power)) * (y - b * pow(x, power))), 6) AS loss FROM b JOIN d ON b.fold = d.fold GROUP BY 1, 2""")
def cross_validate_part(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 4).alias("fold"), (F.col("p_size") / 50.0).alias("x"), (F.col("p_retailprice") / 1000.0).alias("y")).cache()

    def slope(some, penalty, power):
        t = F.pow("x", F.lit(power))
        r = some.agg(F.sum(t * F.col("y")).alias("xy"), F.sum(t * t).alias("xx")).first()
        return r["xy"] / (r["xx"] + penalty), power

    found = stats.cross_validate(rows, "fold", {"penalty": [0.0, 10.0, 100.0], "power": [0.5, 1.0, 2.0]}, slope, lambda m: F.pow(F.col("y") - m[0] * F.pow("x", F.lit(m[1])), F.lit(2.0)))
    return spark.createDataFrame([(p["penalty"], p["power"], round(loss, 6)) for p, loss in found], "penalty double, power double, loss double")
