"""Linear classifiers: L1-regularised logistic regression and linear SVMs, by several solvers.

Objectives: L1 logistic C sum w_i log(1 + exp(-y_i x_i v)) + |v|_1; SVM lambda/2 |v|^2 + sum w_i loss. No intercept. A design holds the rows'
columns; every solver works on sums that Spark takes over them (loss, gradient, curvature, Hessian products), never on collected rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnmill.functions.scalar import log1p_exp, sigmoid


@dataclass(frozen=True)
class Design:
    df: DataFrame
    columns: list[str]
    label: str = "y"
    weight: str | None = None

    @property
    def y(self) -> Column:
        return F.col(self.label)

    @property
    def w(self) -> Column:
        return F.coalesce(F.col(self.weight), F.lit(1.0)) if self.weight else F.lit(1.0)

    def score(self, v) -> Column:
        z = F.lit(0.0)
        for c, b in zip(self.columns, v, strict=True):
            z = z + F.col(c) * float(b)
        return z

    def sums(self, **wanted: Column) -> dict[str, float]:
        row = self.df.agg(*(F.sum(c).alias(n) for n, c in wanted.items())).first()
        return {n: row[n] or 0.0 for n in wanted}


# --- losses: value, slope and curvature by the score z, for a label y of -1 or 1


def loss_parts(loss: str, y: Column, z: Column) -> tuple[Column, Column, Column]:
    if loss == "logistic":
        s = sigmoid(y * z)
        return log1p_exp(-y * z), (s - 1) * y, s * (1 - s)
    active = y * z < 1
    if loss == "l1":
        return F.when(active, 1 - y * z).otherwise(0.0), F.when(active, -y).otherwise(0.0), F.lit(0.0)
    if loss == "l2":
        return F.when(active, (1 - y * z) * (1 - y * z)).otherwise(0.0), F.when(active, -2 * y * (1 - y * z)).otherwise(0.0), F.when(active, 2.0).otherwise(0.0)
    raise ValueError(f"no loss {loss}")


def value_and_gradient(d: Design, v: np.ndarray, loss: str) -> tuple[float, np.ndarray]:
    f, g, _ = loss_parts(loss, d.y, d.score(v))
    got = d.sums(f=d.w * f, **{f"g{i}": d.w * g * F.col(c) for i, c in enumerate(d.columns)})
    return got["f"], np.array([got[f"g{i}"] for i in range(len(d.columns))])


def hessian_product(d: Design, v: np.ndarray, direction: np.ndarray, loss: str) -> np.ndarray:
    _, _, h = loss_parts(loss, d.y, d.score(v))
    got = d.sums(**{f"h{i}": d.w * h * d.score(direction) * F.col(c) for i, c in enumerate(d.columns)})
    return np.array([got[f"h{i}"] for i in range(len(d.columns))])


def hessian(d: Design, v: np.ndarray, loss: str) -> np.ndarray:
    p = len(d.columns)
    _, _, h = loss_parts(loss, d.y, d.score(v))
    got = d.sums(**{f"h{i}_{j}": d.w * h * F.col(d.columns[i]) * F.col(d.columns[j]) for i in range(p) for j in range(i, p)})
    return np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])


def l1_objective(d: Design, v: np.ndarray, c: float) -> float:
    return c * value_and_gradient(d, v, "logistic")[0] + np.abs(v).sum()


def svm_objective(d: Design, v: np.ndarray, penalty: float, loss: str) -> float:
    return penalty / 2 * float(v @ v) + value_and_gradient(d, v, loss)[0]


# --- L1 logistic: coordinates in order


def newton_move(g: float, h: float, v: float) -> float:
    """Minimum of g d + h d^2 / 2 + |v + d|."""
    if h <= 0:
        return -v
    if g + 1 <= h * v:
        return -(g + 1) / h
    if g - 1 >= h * v:
        return -(g - 1) / h
    return -v


def _coordinate(d: Design, v: np.ndarray, j: int, c: float) -> tuple[float, float]:
    _, g, h = loss_parts("logistic", d.y, d.score(v))
    x = F.col(d.columns[j])
    got = d.sums(g=d.w * g * x, h=d.w * h * x * x)
    return c * got["g"], c * got["h"]


def cdn(d: Design, c: float, passes: int = 20, tol: float = 1e-6, sigma: float = 0.01, beta: float = 0.5, start=None) -> np.ndarray:
    """Coordinate Newton with an Armijo search on the objective's difference."""
    v = np.zeros(len(d.columns)) if start is None else np.array(start, float)
    for _ in range(passes):
        most = 0.0
        for j in range(len(v)):
            g, h = _coordinate(d, v, j, c)
            step = newton_move(g, h, v[j])
            if abs(step) <= 1e-15:
                continue
            slope, size, now = g * step + abs(v[j] + step) - abs(v[j]), 1.0, l1_objective(d, v, c)
            for _ in range(30):
                new = v.copy()
                new[j] += size * step
                if l1_objective(d, new, c) - now <= sigma * size * slope:
                    v, most = new, max(most, abs(size * step))
                    break
                size *= beta
        if most <= tol:
            break
    return v


def bbr(d: Design, c: float, passes: int = 20, tol: float = 1e-6, start=None) -> np.ndarray:
    """Cyclic coordinates, each with a trust region and a bound of the curvature inside it."""
    v = np.zeros(len(d.columns)) if start is None else np.array(start, float)
    delta = np.ones(len(v))
    for _ in range(passes):
        most = 0.0
        for j in range(len(v)):
            x, r = F.col(d.columns[j]), d.y * d.score(v)
            reach = float(delta[j]) * F.abs(x)
            u = F.abs(r) - reach
            bound = F.when(u <= 0, 0.25).otherwise(1 / (2 + F.exp(u) + F.exp(-u)))
            _, g, _ = loss_parts("logistic", d.y, d.score(v))
            got = d.sums(g=d.w * g * x, h=d.w * bound * x * x)
            g, h = c * got["g"], max(c * got["h"], 1e-12)
            if v[j] == 0:
                move = -(g + 1) / h if g + 1 < 0 else -(g - 1) / h if g - 1 > 0 else 0.0
            else:
                s = np.sign(v[j])
                move = -(g + s) / h
                if s * (v[j] + move) < 0:
                    move = -v[j]
            move = float(np.clip(move, -delta[j], delta[j]))
            v[j] += move
            delta[j] = max(2 * abs(move), delta[j] / 2)
            most = max(most, abs(move))
        if most <= tol:
            break
    return v


def coordinate_descent_split(d: Design, c: float, steps: int, seed: int | None = None, start=None) -> np.ndarray:
    """Coordinates of the split v = v+ - v-, with the fixed bound 0.25 C sum w x^2; in order, or drawn from a seed."""
    p = len(d.columns)
    both = np.zeros(2 * p) if start is None else np.concatenate([np.maximum(start, 0), np.maximum(-np.asarray(start), 0)])
    got = d.sums(**{f"h{i}": d.w * F.col(x) * F.col(x) for i, x in enumerate(d.columns)})
    bound = [max(0.25 * c * got[f"h{i}"], 1e-12) for i in range(p)]
    draw = np.random.default_rng(seed)
    for k in range(steps):
        i = int(draw.integers(2 * p)) if seed is not None else k % (2 * p)
        j, sign = i % p, 1 if i < p else -1
        g, _ = _coordinate(d, both[:p] - both[p:], j, c)
        both[i] += max(-both[i], -(sign * g + 1) / bound[j])
    return both[:p] - both[p:]


def new_glmnet(d: Design, c: float, rounds: int = 30, tol: float = 1e-6, sigma: float = 0.01, beta: float = 0.5, inner: int = 100) -> np.ndarray:
    """A quadratic model each round, minimised by coordinates on the driver's p x p matrix, then one line search."""
    v, inner_tol = np.zeros(len(d.columns)), 1.0
    for _ in range(rounds):
        f, g = value_and_gradient(d, v, "logistic")
        g, h = c * g, c * hessian(d, v, "logistic") + 1e-12 * np.eye(len(v))
        step, used = np.zeros(len(v)), 0
        for used in range(1, inner + 1):
            most = 0.0
            for j in range(len(v)):
                move = newton_move(g[j] + h[j] @ step, h[j, j], v[j] + step[j])
                step[j] += move
                most = max(most, abs(move))
            if most <= inner_tol * 1e-3:
                break
        if used == 1:
            inner_tol /= 4
        slope, now, size = g @ step + np.abs(v + step).sum() - np.abs(v).sum(), c * f + np.abs(v).sum(), 1.0
        for _ in range(30):
            if l1_objective(d, v + size * step, c) - now <= sigma * size * slope:
                break
            size *= beta
        v = v + size * step
        if np.abs(size * step).max() <= tol:
            break
    return v


def tron(d: Design, c: float, rounds: int = 50, tol: float = 1e-6) -> np.ndarray:
    """Trust region Newton on the split v = v+ - v- >= 0: a projected gradient (Cauchy) point, then conjugate gradients over free variables."""
    p = len(d.columns)
    u = np.zeros(2 * p)
    join = lambda a: a[:p] - a[p:]

    def full(a):
        f, g = value_and_gradient(d, join(a), "logistic")
        return c * f + a.sum(), np.concatenate([c * g, -c * g]) + 1

    def product(a, s):
        h = c * hessian_product(d, join(a), join(s), "logistic")
        return np.concatenate([h, -h]) + 1e-10 * s

    f, g = full(u)
    radius = np.linalg.norm(g)
    for _ in range(rounds):
        projected = np.where(u > 0, g, np.minimum(g, 0))
        if np.abs(projected).max() <= tol:
            break
        size, s = 1.0, np.zeros(2 * p)
        for _ in range(40):
            s = np.maximum(u - size * g, 0) - u
            if np.linalg.norm(s) <= radius and g @ s + 0.5 * s @ product(u, s) <= 0.01 * (g @ s):
                break
            size /= 2
        free = (u + s > 0).astype(float)
        r = -(g + product(u, s)) * free
        q, rr, goal = r.copy(), r @ r, 0.01 * (r @ r)
        for _ in range(2 * p):
            if rr <= max(goal, 1e-20):
                break
            hq = product(u, q) * free
            a = rr / max(q @ hq, 1e-20)
            new = s + a * q
            if np.linalg.norm(new) > radius:
                break
            s = new
            r = r - a * hq
            q, rr = r + (r @ r) / rr * q, r @ r
        s = np.maximum(u + s, 0) - u
        model = g @ s + 0.5 * s @ product(u, s)
        new_f, new_g = full(u + s)
        ratio = (new_f - f) / model if model < 0 else 0.0
        if ratio > 1e-3:
            u, f, g = u + s, new_f, new_g
        n = np.linalg.norm(s)
        radius = max(0.25 * min(n, radius), 1e-12) if ratio < 0.25 else max(radius, 4 * n) if ratio > 0.75 else radius
    return join(u)


L1_SOLVERS = {"bbr": bbr, "cdn": cdn, "glmnet": new_glmnet, "tron": tron, "sgd": lambda d, c, **k: coordinate_descent_split(d, c, k.pop("steps", 40 * len(d.columns)), **k)}


# --- linear SVM


def pegasos(d: Design, penalty: float, loss: str = "l1", steps: int = 50, project: bool = True, fraction: float = 1.0, seed: int = 0, start=None) -> np.ndarray:
    """Projected sub-gradients with rate 1 / (k lambda); with a fraction, each step looks at rows drawn by a seeded hash and scales their sum up."""
    v = np.zeros(len(d.columns)) if start is None else np.array(start, float)
    for k in range(1, steps + 1):
        rows, scale = d, 1.0
        if fraction < 1:
            h = F.pmod(F.xxhash64(*d.columns, d.label, F.lit(seed + k)), F.lit(1_000_000)) < int(fraction * 1_000_000)
            rows, scale = Design(d.df.where(h), d.columns, d.label, d.weight), 1 / fraction
        v = v - (penalty * v + scale * value_and_gradient(rows, v, loss)[1]) / (k * penalty)
        norm = np.linalg.norm(v)
        if project and norm > 1 / np.sqrt(penalty):
            v = v / (norm * np.sqrt(penalty))
    return v


def cdsvm(d: Design, penalty: float, passes: int = 20, tol: float = 1e-6, beta: float = 0.9, sigma: float = 0.01, start=None) -> np.ndarray:
    """Primal coordinate Newton for the squared hinge."""
    v = np.zeros(len(d.columns)) if start is None else np.array(start, float)
    xx = d.sums(**{f"h{i}": d.w * F.col(x) * F.col(x) for i, x in enumerate(d.columns)})
    for _ in range(passes):
        most = 0.0
        for j, name in enumerate(d.columns):
            _, g, h = loss_parts("l2", d.y, d.score(v))
            got = d.sums(g=d.w * g * F.col(name), h=d.w * h * F.col(name) * F.col(name))
            slope, curve = penalty * v[j] + got["g"], penalty + got["h"]
            size, limit = 1.0, curve / ((penalty + 2 * xx[f"h{j}"]) / 2 + sigma)
            while size > limit:
                size *= beta
            v[j] -= size * slope / curve
            most = max(most, abs(size * slope / curve))
        if most <= tol:
            break
    return v


def cmls(d: Design, penalty: float, loss: str = "l2", passes: int = 20, start=None) -> np.ndarray:
    """Coordinates by relaxed least squares: rows beyond the margin count by a factor that shrinks from 1 to 0; each coordinate has a trust region."""
    v = np.zeros(len(d.columns)) if start is None else np.array(start, float)
    delta = np.full(len(v), 10.0)
    for k in range(passes):
        soft = 1 - k / max(1, passes - 1)
        for j, name in enumerate(d.columns):
            x, r = F.col(name), d.y * d.score(v)
            if loss == "logistic":
                _, g, h = loss_parts("logistic", d.y, d.score(v))
                reach = float(delta[j]) * F.abs(x)
                u = F.abs(r) - reach
                bound = F.when(u <= 0, 0.25).otherwise(1 / (2 + F.exp(u) + F.exp(-u)))
            else:
                full = F.when(r < 1, 1.0).otherwise(soft)
                g, bound = -2 * d.y * (1 - r) * full, 2 * full
            got = d.sums(g=d.w * g * x, h=d.w * bound * x * x)
            move = float(np.clip(-(got["g"] + penalty * v[j]) / (got["h"] + penalty), -delta[j], delta[j]))
            v[j] += move
            delta[j] = 2 * abs(move) + 0.1
    return v


def trust_region(d: Design, penalty: float, loss: str = "l2", rounds: int = 50, tol: float = 1e-6) -> np.ndarray:
    """Trust region Newton with conjugate gradients on Hessian products."""
    v = np.zeros(len(d.columns))
    value = lambda a: (lambda f, g: (penalty / 2 * a @ a + f, penalty * a + g))(*value_and_gradient(d, a, loss))
    f, g = value(v)
    radius = first = np.linalg.norm(g)
    for _ in range(rounds):
        if np.linalg.norm(g) <= tol * max(1.0, first):
            break
        s, r = np.zeros(len(v)), -g
        q, rr = r.copy(), r @ r
        for _ in range(10 * len(v)):
            if np.sqrt(rr) <= 0.1 * np.linalg.norm(g):
                break
            hq = penalty * q + hessian_product(d, v, q, loss)
            a = rr / (q @ hq)
            if np.linalg.norm(s + a * q) > radius:
                sq, qq, ss = s @ q, q @ q, s @ s
                a = (-sq + np.sqrt(sq * sq + qq * (radius**2 - ss))) / qq
                s, r = s + a * q, r - a * hq
                break
            s, r = s + a * q, r - a * hq
            q, rr = r + (r @ r) / rr * q, r @ r
        model = g @ s + 0.5 * s @ (penalty * s + hessian_product(d, v, s, loss))
        new_f, new_g = value(v + s)
        ratio = (new_f - f) / model if model < 0 else 0.0
        n = np.linalg.norm(s)
        if ratio > 1e-4:
            v, f, g = v + s, new_f, new_g
        radius = 0.25 * min(n, radius) if ratio < 0.25 else max(radius, 2 * n) if ratio > 0.75 else radius
        if radius < 1e-14:
            break
    return v


def exact_line_search(d: Design, v: np.ndarray, to: np.ndarray, penalty: float, bins: int = 64, rounds: int = 12) -> float:
    """The step t >= 0 along to - v that minimises the squared-hinge objective. The derivative is linear between the rows' jump points and
    grows with t; each round sums it at ``bins`` steps in one pass and narrows to the piece where it changes sign."""
    s = to - v
    z0, z1 = d.score(v), d.score(s)

    def slopes(ts):
        parts = {f"d{i}": F.when(d.y * (z0 + t * z1) < 1, d.w * -2 * d.y * (1 - d.y * (z0 + t * z1)) * z1).otherwise(0.0) for i, t in enumerate(ts)}
        got = d.sums(**parts)
        return [penalty * float((v + t * s) @ s) + got[f"d{i}"] for i, t in enumerate(ts)]

    lo, hi = 0.0, 1.0
    while slopes([hi])[0] < 0 and hi < 2**40:
        lo, hi = hi, 2 * hi
    for _ in range(rounds):
        ts = [lo + (hi - lo) * i / bins for i in range(bins + 1)]
        at = slopes([float(t) for t in ts])
        k = next((i for i in range(1, bins + 1) if at[i] >= 0), bins)
        lo, hi, a, b = ts[k - 1], ts[k], at[k - 1], at[k]
        if b == a:
            return lo
        guess = lo - a * (hi - lo) / (b - a)
        if abs(slopes([guess])[0]) <= 1e-9 * max(1.0, abs(a), abs(b)):
            return guess
    return (lo + hi) / 2


def mfn(d: Design, penalty: float, rounds: int = 30, tol: float = 1e-6) -> np.ndarray:
    """Finite Newton for the squared hinge: ridge least squares on the active rows, then the exact line search."""
    v = np.zeros(len(d.columns))
    for _ in range(rounds):
        active = d.df.where(d.y * d.score(v) < 1)
        a = Design(active, d.columns, d.label, d.weight)
        p = len(d.columns)
        got = a.sums(**{f"g{i}": a.w * a.y * F.col(c) for i, c in enumerate(a.columns)}, **{f"h{i}_{j}": a.w * F.col(a.columns[i]) * F.col(a.columns[j]) for i in range(p) for j in range(i, p)})
        h = 2 * np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) + penalty * np.eye(p)
        to = np.linalg.solve(h, 2 * np.array([got[f"g{i}"] for i in range(p)]))
        if np.abs(to - v).max() <= tol:
            return to
        v = v + exact_line_search(d, v, to, penalty) * (to - v)
    return v


#: Which losses a solver takes.
SVM_SOLVERS = {"pegasos": ("l1", "l2", "logistic"), "tr": ("l2", "logistic"), "cmls": ("l2", "logistic"), "mfn": ("l2",), "cdsvm": ("l2",), "cddual": ("l1", "l2")}


def fit_svm(d: Design, penalty: float, solver: str = "tr", loss: str = "l2", **how) -> np.ndarray:
    if loss not in SVM_SOLVERS.get(solver, ()):
        raise ValueError(f"solver {solver} does not take loss {loss}")
    if solver == "pegasos":
        return pegasos(d, penalty, loss, **how)
    if solver == "tr":
        return trust_region(d, penalty, loss, **how)
    if solver == "cmls":
        return cmls(d, penalty, loss, **how)
    if solver == "cddual":
        from .kernel import dual_coordinates

        return dual_coordinates(d, penalty, loss, **how)
    return (mfn if solver == "mfn" else cdsvm)(d, penalty, **how)


def predict(d: DataFrame, columns: list[str], v) -> DataFrame:
    """d with score and predicted (+1 for a positive score, else -1)."""
    z = Design(d, columns).score(v)
    return d.withColumn("score", z).withColumn("predicted", F.when(F.col("score") > 0, 1).otherwise(-1).cast("long"))
