"""Class statistics, covariance and its shrinkage, resampling, one-against-others prediction."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_stats(df: DataFrame, label: str, weight: Column | None = None) -> DataFrame:
    """(label, n, weight): rows and summed weights of each class; a null weight counts as 1."""
    w = F.coalesce(weight, F.lit(1.0)) if weight is not None else F.lit(1.0)
    return df.groupBy(label).agg(F.count("*").alias("n"), F.sum(w).alias("weight"))


def class_probabilities(df: DataFrame, node: str, label: str, priors: dict | None = None) -> DataFrame:
    """(node, label, p): prior of the class x share of the class's rows that are in the node."""
    inside = df.groupBy(node, label).agg(F.count("*").alias("_n"))
    totals = df.groupBy(label).agg(F.count("*").alias("_all")).withColumn("_sum", F.sum("_all").over(Window.partitionBy(F.lit(1))))
    prior = F.col("_all") / F.col("_sum")
    if priors:
        prior = F.create_map(*(F.lit(x) for kv in priors.items() for x in kv))[F.col(label)]
    totals = totals.select(F.col(label).alias("_label"), "_all", prior.alias("_prior"))
    return inside.join(F.broadcast(totals), F.col(label) == F.col("_label")).select(node, label, (F.col("_prior") * F.col("_n") / F.col("_all")).alias("p"))


def covariance(df: DataFrame, columns: list[str], ddof: int = 0) -> np.ndarray:
    """Covariance matrix from one aggregate."""
    pairs = list(itertools.combinations_with_replacement(range(len(columns)), 2))
    f = F.covar_samp if ddof else F.covar_pop
    row = df.agg(*(f(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    s = np.zeros((len(columns),) * 2)
    for i, j in pairs:
        s[i, j] = s[j, i] = row[f"c{i}_{j}"]
    return s


def matrix_frame(spark, matrix: np.ndarray, digits: int = 6) -> DataFrame:
    """(i, j, value) rows of a small matrix."""
    return spark.createDataFrame([(i, j, round(float(x), digits) + 0.0) for (i, j), x in np.ndenumerate(matrix)], "i long, j long, value double")


def constant_correlation_shrinkage(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, float]:
    """Sample covariance (n) shrunk to a target of equal correlations, and the intensity.

    One pass takes means, a second all products of deviations up to the fourth order that the intensity needs."""
    p = len(columns)
    first = df.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns))).first()
    d = [F.col(c) - first[f"m{i}"] for i, c in enumerate(columns)]
    wanted = {("S", i, j): d[i] * d[j] for i in range(p) for j in range(i, p)}
    wanted |= {("Q", i, j): d[i] * d[i] * d[j] * d[j] for i in range(p) for j in range(i, p)}
    wanted |= {("T", i, j): d[i] * d[i] * d[i] * d[j] for i in range(p) for j in range(p) if i != j}
    names = list(wanted)
    row = df.agg(*(F.avg(wanted[k]).alias("_".join(map(str, k))) for k in names)).first()
    got = {k: row["_".join(map(str, k))] for k in names}
    s = np.array([[got["S", min(i, j), max(i, j)] for j in range(p)] for i in range(p)])
    sd = np.sqrt(np.diag(s))
    r = np.mean([s[i, j] / (sd[i] * sd[j]) for i in range(p) for j in range(i + 1, p)]) if p > 1 else 0.0
    target = r * np.outer(sd, sd)
    np.fill_diagonal(target, np.diag(s))
    var = np.array([[got["Q", min(i, j), max(i, j)] - s[i, j] ** 2 for j in range(p)] for i in range(p)])
    pi = var.sum()
    rho = np.trace(var)
    for i in range(p):
        for j in range(p):
            if i != j:
                a_iiij = got["T", i, j] - s[i, i] * s[i, j]
                a_jjij = got["T", j, i] - s[j, j] * s[i, j]
                rho += r / 2 * (sd[j] / sd[i] * a_iiij + sd[i] / sd[j] * a_jjij)
    gamma = ((s - target) ** 2).sum()
    k = float(np.clip((pi - rho) / gamma / first["n"], 0, 1)) if gamma > 0 else 1.0
    return k * target + (1 - k) * s, k


def oas_shrinkage(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, float]:
    """Sample covariance (n - 1) shrunk to a scaled identity by the oracle-approximating intensity."""
    p, n = len(columns), df.count()
    s = covariance(df, columns, 1)
    t1, t2 = np.trace(s), np.trace(s @ s)
    rho = float(np.clip(((1 - 2 / p) * t2 + t1**2) / ((n + 1 - 2 / p) * (t2 - t1**2 / p)), 0, 1))
    return (1 - rho) * s + rho * t1 / p * np.eye(p), rho


def folds(df: DataFrame, order: str, n_folds: int) -> DataFrame:
    """df with fold (from 0): contiguous runs of ceil(N / n) rows in the order of a key. Ranks come from range partitions and
    their sizes, not from one sorted task."""
    total = df.count()
    size = max(1, -(-total // n_folds))
    parts = df.repartitionByRange(max(1, min(200, total // 100_000 + 1)), order).withColumn("_part", F.spark_partition_id())
    local = parts.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn("fold", F.floor((F.col("_before") + F.col("_row") - 1) / size).cast("long")).select(*df.columns, "fold")


def bootstrap_weights(df: DataFrame, key: str, draws: int, seed: int = 0) -> DataFrame:
    """df x draws with (draw, w): how often each row is in a sample with replacement, by a Poisson(1) weight from an MD5 of
    key, draw and seed; so any engine draws the same."""
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.col("draw").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 4294967296.0
    out = df.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long")))).withColumn("_u", u)
    w = F.lit(6)
    for k, most in reversed(list(enumerate(POISSON_STEPS))):
        w = F.when(F.col("_u") < most, k).otherwise(w)
    return out.withColumn("w", w.cast("long")).drop("_u")


#: Cumulative Poisson(1) probabilities of 0 to 5, rounded to nine places.
POISSON_STEPS = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815)


def bootstrap(df: DataFrame, key: str, train: Callable[[DataFrame], DataFrame], draws: int, seed: int = 0) -> DataFrame:
    """train gets the weighted rows of all draws at once and aggregates by draw."""
    return train(bootstrap_weights(df, key, draws, seed))


def cross_validate_ridge(df: DataFrame, x: str, y: str, fold: str, grid: list[float]) -> DataFrame:
    """(penalty, loss): summed squared error over held-out folds of a slope through the origin, for each penalty of the grid.
    All folds and penalties come from one pass of sums by fold."""
    sums = df.groupBy(fold).agg(F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"))
    everything = Window.partitionBy(F.lit(1))
    rest = sums.withColumns({"t_xx": F.sum("xx").over(everything) - F.col("xx"), "t_xy": F.sum("xy").over(everything) - F.col("xy")})
    tried = rest.withColumn("penalty", F.explode(F.array(*(F.lit(float(g)) for g in grid))))
    b = F.col("t_xy") / (F.col("t_xx") + F.col("penalty"))
    return tried.groupBy("penalty").agg(F.sum(F.col("yy") - 2 * b * F.col("xy") + b * b * F.col("xx")).alias("loss"))


def one_versus_rest(scores: DataFrame, row: str, label: str, score: str) -> DataFrame:
    """(row, label): the class with the highest score; of equals the smallest."""
    return scores.groupBy(row).agg(F.max_by(label, F.struct(F.col(score), -F.col(label))).alias(label))


def one_versus_one(scores: DataFrame, row: str, first: str, second: str, score: str) -> DataFrame:
    """(row, label): a positive score is a vote for the first class, a negative for the second, 0 for none; the smallest class
    of those with most votes."""
    vote = F.explode(F.array(F.struct(F.col(first).alias("label"), (F.col(score) > 0).cast("long").alias("v")), F.struct(F.col(second).alias("label"), (F.col(score) < 0).cast("long").alias("v")))).alias("b")
    votes = scores.select(row, vote).groupBy(row, "b.label").agg(F.sum("b.v").alias("votes"))
    return votes.groupBy(row).agg(F.max_by("label", F.struct(F.col("votes"), -F.col("label"))).alias("label"))


def one_versus_rest_train(df: DataFrame, label: str, train: Callable[[DataFrame], object]) -> dict:
    """class -> model: train gets df with y, +1 for rows of the class and -1 for all others, once for each class in order. Rows
    without a label are left out; a single class has no model."""
    classes = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
    rows = df.where(F.col(label).isNotNull())
    return {c: train(rows.withColumn("y", F.when(F.col(label) == c, 1.0).otherwise(-1.0))) for c in classes} if len(classes) > 1 else {}


def one_versus_one_train(df: DataFrame, label: str, train: Callable[[DataFrame], object]) -> dict:
    """(first, second) -> model for each pair of classes in order: train gets the rows of both with y, +1 for the first and -1 for the second."""
    classes = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
    return {(a, b): train(df.where(F.col(label).isin(a, b)).withColumn("y", F.when(F.col(label) == a, 1.0).otherwise(-1.0))) for a, b in itertools.combinations(classes, 2)}


def multi_class_predict(df: DataFrame, models: dict, score: Callable[[object], Column]) -> DataFrame:
    """df with predicted, by models of either kind of training; score makes a model's score of a row. Against the rest the highest score wins, one
    against one the class with most votes (a positive score is one for the first); of equals the smallest class. All inside the row."""
    if not models:
        return df.withColumn("predicted", F.lit(None))
    if not isinstance(next(iter(models)), tuple):
        best = F.array_max(F.array(*(F.struct(score(m).alias("s"), F.lit(-i).alias("k")) for i, m in enumerate(models.values()))))
        names = F.array(*(F.lit(c) for c in models))
        return df.withColumn("predicted", F.element_at(names, (1 - best["k"]).cast("int")))
    classes = sorted({c for pair in models for c in pair})
    votes = {c: F.lit(0) for c in classes}
    for (a, b), m in models.items():
        s = score(m)
        votes[a], votes[b] = votes[a] + (s > 0).cast("int"), votes[b] + (s < 0).cast("int")
    best = F.array_max(F.array(*(F.struct(votes[c].alias("s"), F.lit(-i).alias("k")) for i, c in enumerate(classes))))
    return df.withColumn("predicted", F.element_at(F.array(*(F.lit(c) for c in classes)), (1 - best["k"]).cast("int")))


def mean_difference(df: DataFrame, columns: list[str]) -> tuple[list[float], float]:
    """A closed-form classifier of rows with y = +1 or -1: the weights are the difference of the classes' means, and the border lies
    halfway between them."""
    m = {r["y"]: r for r in df.groupBy("y").agg(*(F.avg(c).alias(c) for c in columns)).collect()}
    w = [m[1.0][c] - m[-1.0][c] for c in columns]
    return w, -sum(x * (m[1.0][c] + m[-1.0][c]) / 2 for x, c in zip(w, columns, strict=True))


def linear_score(model: tuple[list[float], float], columns: list[str]) -> Column:
    w, b = model
    out = F.lit(float(b))
    for x, c in zip(w, columns, strict=True):
        out = out + F.lit(float(x)) * F.col(c)
    return out


def grid_of(parameters: dict[str, list | tuple]) -> list[dict]:
    """All combinations of the parameters' values, the last parameter running fastest. A tuple (start, stop, count) stands for evenly spaced values."""
    values = [np.linspace(*v).tolist() if isinstance(v, tuple) and len(v) == 3 else list(v) for v in parameters.values()]
    return [dict(zip(parameters, c, strict=True)) for c in itertools.product(*values)]


def cross_validate(df: DataFrame, fold: str, parameters: dict, train: Callable[..., object], loss: Callable[[object], Column]) -> list[tuple[dict, float]]:
    """(parameters, summed loss over held-out folds) for every point of the grid, best first (of equals the first in the grid). train(rows, **parameters) gives a
    model of the rows of all folds but one, loss(model) a row's loss; each fold is one training and one sum."""
    numbers = sorted(r[0] for r in df.select(fold).distinct().collect())
    out = []
    for some in grid_of(parameters):
        total = 0.0
        for k in numbers:
            model = train(df.where(F.col(fold) != k), **some)
            total += df.where(F.col(fold) == k).agg(F.sum(loss(model))).first()[0] or 0.0
        out.append((some, total))
    return sorted(out, key=lambda x: x[1])
