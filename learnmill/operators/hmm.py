"""Hidden Markov models over many sequences.

Each sequence is folded on its own: the observations of a sequence, sorted by time, go through a grouped function, so sequences are
processed in parallel and one sequence is in one task (its recursion is sequential by nature). Training sums expected counts over sequences.
Observations are numbers, or arrays of one length; emissions are Gaussian, or mixtures of Gaussians with a covariance family for each state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnmill.plans.session import ensure_package

from .mixture import Mixture, family_covariances, start_by_kmeans


def log_gaussian(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log densities of the rows of x."""
    half = np.linalg.cholesky(cov)
    z = np.linalg.solve(half, (x - mean).T)
    return -0.5 * (len(mean) * np.log(2 * np.pi) + (z**2).sum(axis=0)) - np.log(np.diag(half)).sum()


@dataclass(frozen=True)
class Hmm:
    """Start probabilities, moves, and Gaussian emissions: means and variances by state for numbers, means (k, p) and covariances (k, p, p) for arrays."""

    start: np.ndarray
    moves: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def log_emissions(self, x: np.ndarray) -> np.ndarray:
        if self.means.ndim > 1:
            return np.stack([log_gaussian(x, m, c) for m, c in zip(self.means, self.variances, strict=True)], axis=1)
        return -0.5 * (np.log(2 * np.pi * self.variances) + (x[:, None] - self.means) ** 2 / self.variances)


@dataclass(frozen=True)
class MixtureHmm:
    """Start probabilities, moves, and by state a mixture of Gaussians over arrays with the name of its covariance family."""

    start: np.ndarray
    moves: np.ndarray
    parts: tuple[Mixture, ...]
    families: tuple[str, ...]

    def log_parts(self, x: np.ndarray, state: int) -> np.ndarray:
        """Log weight and density of each component of a state, by row."""
        m = self.parts[state]
        with np.errstate(divide="ignore"):
            return np.stack([np.log(w) + log_gaussian(x, mean, cov) for w, mean, cov in zip(m.weights, m.means, m.covs, strict=True)], axis=1)

    def log_emissions(self, x: np.ndarray) -> np.ndarray:
        return np.stack([log_sum(self.log_parts(x, i), 1) for i in range(len(self.parts))], axis=1)


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def forward(m: Hmm, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        a, moves = np.empty_like(b), np.log(m.moves)
        a[0] = np.log(m.start) + b[0]
    for t in range(1, len(b)):
        a[t] = b[t] + log_sum(a[t - 1][:, None] + moves, 0)
    return a


def backward(m: Hmm, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        moves = np.log(m.moves)
    out = np.zeros_like(b)
    for t in range(len(b) - 2, -1, -1):
        out[t] = log_sum(moves + b[t + 1] + out[t + 1], 1)
    return out


def viterbi(m: Hmm, b: np.ndarray) -> tuple[np.ndarray, float]:
    """The best path, of equals by the smaller state, and its log likelihood."""
    with np.errstate(divide="ignore"):
        v, moves = np.log(m.start) + b[0], np.log(m.moves)
    back = np.zeros(b.shape, int)
    for t in range(1, len(b)):
        every = v[:, None] + moves
        back[t] = every.argmax(axis=0)
        v = every.max(axis=0) + b[t]
    path = np.empty(len(b), int)
    path[-1] = v.argmax()
    for t in range(len(b) - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return path, float(v.max())


def _by_sequence(sequences: DataFrame, run, schema: str) -> DataFrame:
    ensure_package(sequences.sparkSession)
    kind = "array<double>" if _arrays(sequences) else "double"

    def fold(pdf):
        x = pdf.sort_values("ts")["obs"].to_numpy()
        return run(pdf["seq_id"].iloc[0], np.stack(x) if kind != "double" else x)

    return sequences.select("seq_id", "ts", F.col("obs").cast(kind).alias("obs")).groupBy("seq_id").applyInPandas(fold, schema)


def _arrays(sequences: DataFrame) -> bool:
    return sequences.schema["obs"].dataType.typeName() == "array"


def recursions(sequences: DataFrame, m: Hmm) -> DataFrame:
    """(seq_id, t, state, log_alpha, log_beta, posterior), t from 1."""

    def run(seq, x):
        b = m.log_emissions(x)
        a, z = forward(m, b), backward(m, b)
        evidence = log_sum(a[-1], 0)
        n, k = b.shape
        return pd.DataFrame({"seq_id": seq, "t": np.repeat(np.arange(1, n + 1), k), "state": np.tile(np.arange(k), n), "log_alpha": a.ravel(), "log_beta": z.ravel(), "posterior": np.exp(a + z - evidence).ravel()})

    return _by_sequence(sequences, run, "seq_id long, t long, state long, log_alpha double, log_beta double, posterior double")


def state_paths(sequences: DataFrame, m: Hmm) -> DataFrame:
    """(seq_id, t, state, log_likelihood) of each sequence's best path."""

    def run(seq, x):
        path, ll = viterbi(m, m.log_emissions(x))
        return pd.DataFrame({"seq_id": seq, "t": np.arange(1, len(path) + 1), "state": path, "log_likelihood": ll})

    return _by_sequence(sequences, run, "seq_id long, t long, state long, log_likelihood double")


def move_counts(paths: DataFrame, n_states: int) -> DataFrame:
    """(seq_id, i, j, n) of moves along the paths, with one more stay in the last state, so that rows sum to the states' counts."""
    from pyspark.sql import Window

    order = Window.partitionBy("seq_id").orderBy("t")
    return paths.select("seq_id", F.col("state").alias("i"), F.coalesce(F.lead("state").over(order), F.col("state")).alias("j")).groupBy("seq_id", "i", "j").agg(F.count("*").alias("n"))


def log_evidence(sequences: DataFrame, m: Hmm) -> DataFrame:
    """(seq_id, log_evidence) by a fold in Catalyst, for two states: an aggregate over the sequence's sorted observations."""
    if len(m.start) != 2:
        raise ValueError("the fold is written for two states")

    def lse(a, b):
        top = F.greatest(a, b)
        return top + F.log(F.exp(a - top) + F.exp(b - top))

    def emit(x, k):
        return F.lit(float(-0.5 * np.log(2 * np.pi * m.variances[k]))) - (x - float(m.means[k])) * (x - float(m.means[k])) / float(2 * m.variances[k])

    la = np.log(m.moves)

    def step(s, r):
        x, first = r["obs"], s["a0"].isNull()
        a0 = F.when(first, F.lit(float(np.log(m.start[0])))).otherwise(lse(s["a0"] + float(la[0, 0]), s["a1"] + float(la[1, 0])))
        a1 = F.when(first, F.lit(float(np.log(m.start[1])))).otherwise(lse(s["a0"] + float(la[0, 1]), s["a1"] + float(la[1, 1])))
        return F.struct((a0 + emit(x, 0)).alias("a0"), (a1 + emit(x, 1)).alias("a1"))

    rows = sequences.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("ts", "obs"))).alias("o"))
    none = F.struct(F.lit(None).cast("double").alias("a0"), F.lit(None).cast("double").alias("a1"))
    return rows.select("seq_id", F.aggregate("o", none, step, lambda s: lse(s["a0"], s["a1"])).alias("log_evidence"))


def _expected(m, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of the states by row, expected moves, and the log evidence of a sequence."""
    b = m.log_emissions(x)
    a, z = forward(m, b), backward(m, b)
    evidence = log_sum(a[-1], 0)
    with np.errstate(divide="ignore"):
        xi = np.exp(a[:-1, :, None] + np.log(m.moves) + (b[1:] + z[1:])[:, None, :] - evidence).sum(axis=0)
    return np.exp(a + z - evidence), xi, float(evidence)


def _summed(sequences: DataFrame, statistics) -> np.ndarray:
    """The arrays that ``statistics`` makes of each sequence, end to end, summed over sequences by Spark: rows (place, value), added up before they move."""

    def run(seq, x):
        flat = np.concatenate([np.ravel(part) for part in statistics(x)])
        return pd.DataFrame({"k": np.arange(len(flat)), "v": flat})

    found = _by_sequence(sequences, run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    return np.array([r["v"] for r in found])


def _split(flat: np.ndarray, *shapes: tuple[int, ...]) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(shape)) for shape in shapes])
    return [part.reshape(shape) for part, shape in zip(np.split(flat, ends[:-1]), shapes, strict=True)]


def _chances(counts: np.ndarray, floor: float) -> np.ndarray:
    counts = np.maximum(counts, floor)
    return counts / counts.sum(axis=-1, keepdims=True)


def baum_welch_step(sequences: DataFrame, m: Hmm, floor: float = 1e-8) -> tuple[Hmm, float]:
    """One EM step over all sequences: each gives its expected counts, the sums are taken by Spark."""
    k, p = len(m.start), 1 if m.means.ndim == 1 else m.means.shape[1]

    def statistics(x):
        g, xi, evidence = _expected(m, x)
        rows = x.reshape(len(x), -1)
        return g[0], xi, g.sum(axis=0), g.T @ rows, np.einsum("tk,ti,tj->kij", g, rows, rows), evidence

    start, moves, n, s, q, ll = _split(_summed(sequences, statistics), (k,), (k, k), (k,), (k, p), (k, p, p), (1,))
    mean = s / n[:, None]
    covs = q / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    if m.means.ndim == 1:
        mean, covs = mean[:, 0], np.maximum(covs[:, 0, 0], floor)
    else:
        covs = covs + floor * np.eye(p)
    return Hmm(start / start.sum(), _chances(moves, floor), mean, covs), float(ll[0])


def mixture_step(sequences: DataFrame, m: MixtureHmm, floor: float = 1e-8, weighed: bool = False) -> tuple[MixtureHmm, float]:
    """One step over all sequences for mixtures: start and moves by expected counts, each state's mixture by classification EM with its covariance family. A row
    belongs to the component with the largest posterior in each state's mixture; with ``weighed``, it counts there as much as its posterior of the state."""
    k, p = len(m.start), m.parts[0].means.shape[1]
    sizes = [len(part.weights) for part in m.parts]

    def statistics(x):
        g, xi, evidence = _expected(m, x)
        out = [g[0], xi, evidence]
        for i, size in enumerate(sizes):
            share = (m.log_parts(x, i).argmax(axis=1)[:, None] == np.arange(size)) * (g[:, i, None] if weighed else 1.0)
            out += [share.sum(axis=0), share.T @ x, np.einsum("tc,ti,tj->cij", share, x, x)]
        return out

    start, moves, ll, *rest = _split(_summed(sequences, statistics), (k,), (k, k), (1,), *(shape for c in sizes for shape in ((c,), (c, p), (c, p, p))))
    parts = []
    for i, (n, s, q) in enumerate(zip(rest[::3], rest[1::3], rest[2::3], strict=True)):
        if (n <= 0).any():
            raise ValueError(f"a component of state {i} has lost all its rows")
        means = s / n[:, None]
        scatter = q - n[:, None, None] * means[:, :, None] * means[:, None, :] + floor * np.eye(p)
        parts.append(Mixture(n / n.sum(), means, family_covariances(m.families[i], n, scatter)))
    return MixtureHmm(start / start.sum(), _chances(moves, floor), tuple(parts), m.families), float(ll[0])


def _columns(sequences: DataFrame) -> tuple[DataFrame, list[str]]:
    """The observations as columns x0, x1..."""
    if not _arrays(sequences):
        return sequences.select(F.col("obs").cast("double").alias("x0")), ["x0"]
    p = sequences.agg(F.max(F.size("obs"))).first()[0]
    return sequences.select(*(F.col("obs")[i].cast("double").alias(f"x{i}") for i in range(p))), [f"x{i}" for i in range(p)]


def start_gaussian(sequences: DataFrame, k: int, seed: int = 1) -> Hmm:
    """k states from the clusters of k-means over all observations; all moves are as likely."""
    m = start_by_kmeans(*_columns(sequences), k, seed)
    moves = np.full((k, k), 1 / k)
    return Hmm(m.weights, moves, m.means, m.covs) if _arrays(sequences) else Hmm(m.weights, moves, m.means[:, 0], m.covs[:, 0, 0])


def start_mixtures(sequences: DataFrame, sizes: list[int], families: list[str], seed: int = 1) -> MixtureHmm:
    """States with as many components as ``sizes`` tells, from the clusters of one k-means: each state takes the free cluster with the mean of
    smallest norm and those nearest to it."""
    m = start_by_kmeans(*_columns(sequences), sum(sizes), seed)
    free = np.argsort(np.linalg.norm(m.means, axis=1), kind="stable").tolist()
    parts, start = [], []
    for size in sizes:
        first = free[0]
        own = sorted(free, key=lambda c: (c != first, float(((m.means[c] - m.means[first]) ** 2).sum())))[:size]
        free = [c for c in free if c not in own]
        start.append(m.weights[own].sum())
        parts.append(Mixture(m.weights[own] / m.weights[own].sum(), m.means[own], m.covs[own]))
    k = len(sizes)
    return MixtureHmm(np.array(start), np.full((k, k), 1 / k), tuple(parts), tuple(families))


def segmental_step(sequences: DataFrame, m: Hmm, floor: float = 1e-8) -> Hmm:
    """One step of hard EM: parameters re-counted along the best paths."""
    k = len(m.start)
    paths = state_paths(sequences, m).cache()
    moves = np.full((k, k), floor)
    for r in move_counts(paths, k).groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        moves[r["i"], r["j"]] += r["n"]
    start = np.full(k, floor)
    for r in paths.where("t = 1").groupBy("state").count().collect():
        start[r["state"]] += r["count"]
    from pyspark.sql import Window

    obs = sequences.withColumn("t", F.row_number().over(Window.partitionBy("seq_id").orderBy("ts")).cast("long")).join(paths, ["seq_id", "t"])
    means, variances = m.means.copy(), m.variances.copy()
    if means.ndim > 1:
        p = means.shape[1]
        both = [F.covar_pop(F.col("obs")[i], F.col("obs")[j]) for i in range(p) for j in range(p)]
        for r in obs.groupBy("state").agg(F.array(*(F.avg(F.col("obs")[i]) for i in range(p))).alias("a"), F.array(*both).alias("v")).collect():
            means[r["state"]], variances[r["state"]] = r["a"], np.reshape(r["v"], (p, p)) + floor * np.eye(p)
    else:
        for r in obs.groupBy("state").agg(F.avg("obs").alias("a"), F.var_pop("obs").alias("v")).collect():
            means[r["state"]], variances[r["state"]] = r["a"], max(r["v"], floor)
    paths.unpersist()
    return Hmm(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), means, variances)


def fit(sequences: DataFrame, m: Hmm | MixtureHmm, tol: float = 1e-6, max_rounds: int = 50, warm_rounds: int = 0, weighed: bool = False) -> tuple[Hmm | MixtureHmm, float]:
    """Baum-Welch until the summed log evidence changes by at most tol, after ``warm_rounds`` of segmental k-means (Gaussian emissions only)."""
    mixed = isinstance(m, MixtureHmm)
    for _ in range(0 if mixed else warm_rounds):
        m = segmental_step(sequences, m)
    last = float("-inf")
    for _ in range(max_rounds):
        m, ll = mixture_step(sequences, m, weighed=weighed) if mixed else baum_welch_step(sequences, m)
        if abs(ll - last) <= tol:
            break
        last = ll
    return m, last
