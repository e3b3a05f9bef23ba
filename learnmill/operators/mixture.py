"""Gaussian mixtures: EM, and classification EM over the covariance families lambda D A D'.

Each step is one pass of weighted moments by component over the rows; the small matrices are handled on the driver. Rows have the
columns given; parameters are (weights, means, covariances).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    log_likelihood: float = float("-inf")


def log_density(columns: list[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Gaussian log density as a Column, the quadratic form written out."""
    p = len(columns)
    inverse, (_, logdet) = np.linalg.inv(cov), np.linalg.slogdet(cov)
    d = [F.col(c) - float(m) for c, m in zip(columns, mean, strict=True)]
    q = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            q = q + d[i] * d[j] * float(inverse[i, j] * (1 if i == j else 2))
    return F.lit(-0.5 * (p * np.log(2 * np.pi) + logdet)) - 0.5 * q


def posteriors(df: DataFrame, columns: list[str], m: Mixture) -> DataFrame:
    """df with lp (array of log weight + log density) and ll (their log of summed exponentials)."""
    lp = F.array(*(log_density(columns, m.means[k], m.covs[k]) + float(np.log(m.weights[k])) for k in range(len(m.weights))))
    out = df.withColumn("lp", lp).withColumn("_top", F.array_max("lp"))
    return out.withColumn("ll", F.col("_top") + F.log(F.aggregate("lp", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top"))))).drop("_top")


def _moments(df: DataFrame, columns: list[str], k: int, share) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Summed shares, shares x columns, shares x products, and ll, of all components in one aggregate."""
    p, wanted = len(columns), {}
    for c in range(k):
        r = share(c)
        wanted[f"n{c}"] = F.sum(r)
        for i in range(p):
            wanted[f"s{c}_{i}"] = F.sum(r * F.col(columns[i]))
            for j in range(i, p):
                wanted[f"q{c}_{i}_{j}"] = F.sum(r * F.col(columns[i]) * F.col(columns[j]))
    row = df.agg(*(v.alias(n) for n, v in wanted.items()), F.sum("ll").alias("ll")).first()
    n = np.array([row[f"n{c}"] or 0.0 for c in range(k)])
    s = np.array([[row[f"s{c}_{i}"] or 0.0 for i in range(p)] for c in range(k)])
    q = np.array([[[row[f"q{c}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)] for c in range(k)])
    return n, s, q, row["ll"]


def em_step(df: DataFrame, columns: list[str], m: Mixture) -> Mixture:
    rows = posteriors(df, columns, m)
    n, s, q, ll = _moments(rows, columns, len(m.weights), lambda c: F.exp(F.col("lp")[c] - F.col("ll")))
    means = s / n[:, None]
    covs = q / n[:, None, None] - means[:, :, None] * means[:, None, :]
    return Mixture(n / n.sum(), means, covs, float(ll))


def fit_em(df: DataFrame, columns: list[str], start: Mixture, tol: float = 1e-6, max_rounds: int = 100) -> Mixture:
    """EM until the log likelihood of the step's start changes by at most tol."""
    m, last = start, float("-inf")
    for _ in range(max_rounds):
        m = em_step(df, columns, m)
        if abs(m.log_likelihood - last) <= tol:
            break
        last = m.log_likelihood
    return m


def start_from_labels(df: DataFrame, columns: list[str], label: str, k: int) -> Mixture:
    """Weights, means and covariances (n) of labels 0..k-1."""
    rows = df.withColumn("ll", F.lit(0.0))
    n, s, q, _ = _moments(rows, columns, k, lambda c: F.when(F.col(label) == c, 1.0).otherwise(0.0))
    means = s / n[:, None]
    return Mixture(n / n.sum(), means, q / n[:, None, None] - means[:, :, None] * means[:, None, :])


def start_by_kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 1, max_rounds: int = 20) -> Mixture:
    """The mixture of the clusters that k-means finds. A cluster with fewer rows than columns has a covariance that is made regular by a small ridge."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="_v").transform(df.select(*columns))
    model = KMeans(k=k, seed=seed, maxIter=max_rounds, featuresCol="_v", predictionCol="_label").fit(rows)
    m = start_from_labels(model.transform(rows), columns, "_label", k)
    if not np.isfinite(m.means).all():
        raise ValueError(f"fewer than {k} clusters")
    ridge = np.array([1e-6 * max(1.0, float(np.trace(c))) for c in m.covs])
    return Mixture(m.weights, m.means, m.covs + ridge[:, None, None] * np.eye(len(columns)))


FAMILIES = ("lI", "l_kI", "lB", "l_kB", "lB_k", "l_kB_k", "lDAD", "l_kDAD", "lD_kAD_k", "l_kD_kAD_k", "lD_kA_kD_k", "l_kD_kA_kD_k")


def family_of(identity=False, diagonal=False, same_size=False, same_shape=False, same_direction=False) -> str:
    """The covariance family that flags name; a shared direction alone is refused."""
    size = "l" if same_size else "l_k"
    if identity:
        return size + "I"
    if diagonal:
        return size + ("B" if same_shape else "B_k")
    if same_direction and not same_shape:
        raise ValueError("a common direction needs a common shape")
    if same_shape:
        return size + ("DAD" if same_direction else "D_kAD_k")
    return size + "D_kA_kD_k"


def family_covariances(family: str, n: np.ndarray, w: np.ndarray, tol: float = 1e-6, max_rounds: int = 100) -> np.ndarray:
    """Maximum likelihood covariances of a family, from sizes n and scatter matrices w (k, p, p)."""
    k, p = w.shape[:2]
    total, eye = n.sum(), np.eye(p)
    diag = np.array([np.diag(np.diag(x)) for x in w])
    unit = lambda a: a / np.linalg.det(a) ** (1 / p)

    def common_shape(parts: np.ndarray) -> np.ndarray:
        """lambda_k C with one C of determinant 1, by turns."""
        size = np.array([np.trace(x) / (m * p) for x, m in zip(parts, n, strict=True)])
        last = np.inf
        for _ in range(max_rounds):
            shape = unit((parts / size[:, None, None]).sum(axis=0))
            size = np.array([np.trace(x @ np.linalg.inv(shape)) / (m * p) for x, m in zip(parts, n, strict=True)])
            now = p * (n * np.log(size)).sum()
            if abs(last - now) <= tol:
                break
            last = now
        return size[:, None, None] * shape

    if family == "lI":
        return np.repeat((np.trace(w.sum(axis=0)) / (total * p) * eye)[None], k, axis=0)
    if family == "l_kI":
        return np.array([np.trace(x) / (m * p) * eye for x, m in zip(w, n, strict=True)])
    if family == "lB":
        return np.repeat(diag.sum(axis=0)[None] / total, k, axis=0)
    if family == "l_kB":
        return common_shape(diag)
    if family == "lB_k":
        shapes, sizes = np.array([unit(x) for x in diag]), np.array([np.linalg.det(x) ** (1 / p) for x in diag])
        return sizes.sum() / total * shapes
    if family == "l_kB_k":
        return diag / n[:, None, None]
    if family == "lDAD":
        return np.repeat(w.sum(axis=0)[None] / total, k, axis=0)
    if family == "l_kDAD":
        return common_shape(w)
    values, turns = zip(*((v[::-1], d[:, ::-1]) for v, d in map(np.linalg.eigh, w)), strict=True)
    values, turns = np.array(values), np.array(turns)
    turned = lambda a: np.array([d @ x @ d.T for d, x in zip(turns, a, strict=True)])
    spread = np.array([np.diag(v) for v in values])
    if family == "lD_kAD_k":
        return turned(np.repeat(spread.sum(axis=0)[None] / total, k, axis=0))
    if family == "l_kD_kAD_k":
        return turned(common_shape(spread))
    if family == "lD_kA_kD_k":
        sizes = np.array([np.linalg.det(x) ** (1 / p) for x in w])
        return sizes.sum() / total * np.array([unit(x) for x in w])
    if family == "l_kD_kA_kD_k":
        return w / n[:, None, None]
    raise ValueError(f"no family {family}")


def cem_assign(df: DataFrame, columns: list[str], m: Mixture) -> DataFrame:
    """df with component (the smallest of those with the largest log posterior), lp and ll, the winning one."""
    rows = posteriors(df, columns, m)
    return rows.withColumn("ll", F.array_max("lp")).withColumn("component", (F.array_position("lp", F.array_max("lp")) - 1).cast("long"))


def cem_step(df: DataFrame, columns: list[str], m: Mixture, family: str) -> Mixture:
    rows = cem_assign(df, columns, m)
    n, s, q, ll = _moments(rows, columns, len(m.weights), lambda c: F.when(F.col("component") == c, 1.0).otherwise(0.0))
    if (n <= 0).any():
        raise ValueError("a component has lost all its rows")
    means = s / n[:, None]
    scatter = q - n[:, None, None] * means[:, :, None] * means[:, None, :]
    return Mixture(n / n.sum(), means, family_covariances(family, n, scatter), float(ll))


def fit_cem(df: DataFrame, columns: list[str], start: Mixture, family: str = "l_kD_kA_kD_k", tol: float = 1e-6, max_rounds: int = 100) -> Mixture:
    m, last = start, float("-inf")
    for _ in range(max_rounds):
        m = cem_step(df, columns, m, family)
        if abs(m.log_likelihood - last) <= tol:
            break
        last = m.log_likelihood
    return m
