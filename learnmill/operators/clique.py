"""CLIQUE: dense grid units level by level, clusters of units that share a face, interest measures, maximal regions.

Units are rows (subspace, bins, n): sorted axes and their bins as arrays. Input rows are (id, axis, bin) in long form, so that a level is one
join and one count, whatever the number of axes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neighbors import _checkpoints, connected_labels
from .prep import grid_codes, grid_knots


def collapsed(coded: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with equal bins as one: (row, *columns, w); row is a number of the combination that holds for one table, w how many rows have it. Counting units needs no
    more, and levels join far fewer rows."""
    _checkpoints(coded.sparkSession)
    return coded.groupBy(*columns).agg(F.count("*").alias("w")).withColumn("row", F.monotonically_increasing_id()).checkpoint()


def memberships(coded: DataFrame, id_col: str, columns: list[str], weight: str | None = None) -> DataFrame:
    """(id, axis, bin, w) from columns of bins; a row counts as many as its weight tells, else 1."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("axis"), F.col(c).cast("long").alias("bin")) for i, c in enumerate(columns)))).alias("u")
    return coded.select(F.col(id_col).alias("id"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"), cells).select("id", "u.axis", "u.bin", "w")


def first_units(members: DataFrame, support: int) -> DataFrame:
    units = members.groupBy("axis", "bin").agg(F.sum("w").alias("n")).where(F.col("n") >= support)
    return units.select(F.array("axis").alias("subspace"), F.array("bin").alias("bins"), "n")


def inside(members: DataFrame, units: DataFrame) -> DataFrame:
    """(id, subspace, bins, w) of the rows in first-level units."""
    m = members.select("id", "w", F.array("axis").alias("subspace"), F.array("bin").alias("bins"))
    return m.join(units.select("subspace", "bins"), ["subspace", "bins"], "left_semi")


def next_units(level: DataFrame, base: DataFrame, units: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """Units one dimension up, and which rows they hold. level and base: (id, subspace, bins) of this level and of the first. A unit whose faces are not
    all dense cannot be dense; counting alone decides, as a unit's rows are in all its faces."""
    b = base.select(F.col("id").alias("i"), F.col("subspace").alias("axis"), F.col("bins").alias("bin"))
    level = level.select("id", "subspace", "bins", "w")
    grown = level.join(b, (F.col("id") == F.col("i")) & (F.col("axis")[0] > F.element_at("subspace", -1))).select(level["id"], F.concat("subspace", "axis").alias("subspace"), F.concat("bins", "bin").alias("bins"), level["w"].alias("w"))
    dense = grown.groupBy("subspace", "bins").agg(F.sum("w").alias("n")).where(F.col("n") >= support)
    return dense, grown.join(dense.select("subspace", "bins"), ["subspace", "bins"], "left_semi")


def units_up_to(members: DataFrame, support: int, levels: int) -> list[DataFrame]:
    units = first_units(members, support)
    base = level = inside(members, units)
    out = [units]
    for _ in range(levels - 1):
        units, level = next_units(level, base, units, support)
        out.append(units)
    return out


def faces(units: DataFrame) -> DataFrame:
    """(subspace, a, b): bins of two units of a subspace that share a face: one bin differs, by 1. Each unit names the neighbours above it, so the join is on equality."""
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.size("bins") - 1), lambda k: F.transform(F.col("bins"), lambda x, i: F.when(i == k, x + 1).otherwise(x)))).alias("b")
    above = units.select("subspace", F.col("bins").alias("a"), steps)
    return above.join(units.select(F.col("subspace").alias("s"), F.col("bins").alias("t")), (F.col("subspace") == F.col("s")) & (F.col("b") == F.col("t")), "left_semi")


def unit_clusters(units: DataFrame, min_objects: int) -> DataFrame:
    """(subspace, bins, n, cluster): connected units of each subspace with at least min_objects rows together; the cluster is named by its
    smallest unit, as text."""
    key = lambda s, b: F.concat_ws("|", F.concat_ws(",", s), F.concat_ws(",", F.transform(b, lambda x: F.lpad(x.cast("string"), 9, "0"))))
    nodes = units.select(key(F.col("subspace"), F.col("bins")).alias("id"))
    f = faces(units)
    up = f.select(key(F.col("subspace"), F.col("a")).alias("i"), key(F.col("subspace"), F.col("b")).alias("j"))
    labels = connected_labels(up.union(up.select("j", "i").toDF("i", "j")), nodes)
    named = units.withColumn("k", key(F.col("subspace"), F.col("bins"))).join(labels, F.col("k") == F.col("id"))
    return named.withColumn("_all", F.sum("n").over(Window.partitionBy("label"))).where(F.col("_all") >= min_objects).select("subspace", "bins", "n", F.col("label").alias("cluster"))


def subspace_coverage(units: DataFrame) -> DataFrame:
    return units.groupBy("subspace").agg(F.sum("n").alias("coverage"), F.count("*").alias("n_units"))


def subspace_entropy(units: DataFrame) -> DataFrame:
    """(subspace, entropy) of the shares of a subspace's units."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("subspace"))
    return units.withColumn("p", p).groupBy("subspace").agg(F.sum(-F.col("p") * F.log("p")).alias("entropy"))


def mdl_cut(coverage: DataFrame, keep: int = 2) -> DataFrame:
    """(rank, coverage, code_length): subspaces by coverage from the top, and the bits of coding the first ``rank`` and the others by
    their means; the cut with the fewest bits is where interesting ones end. Cuts with a deviation of 0 have null."""
    order = Window.orderBy(F.desc("coverage"), "subspace")
    ranked = coverage.select(F.row_number().over(order).alias("rank"), "coverage")
    cuts = ranked.select(F.col("rank").alias("cut"), F.lit(1).alias("one"))
    every = ranked.crossJoin(cuts.where(F.col("cut") >= keep)).withColumn("kept", F.col("rank") <= F.col("cut"))
    mean = F.avg("coverage").over(Window.partitionBy("cut", "kept"))
    rows = every.withColumn("m", F.ceil(mean)).withColumn("dev", F.abs(F.col("coverage") - F.col("m")))
    part = rows.groupBy("cut", "kept").agg(F.sum(F.when(F.col("dev") > 1e-8, F.log2("dev"))).alias("bits"), F.max(F.when(F.col("dev") <= 1e-8, 1).otherwise(0)).alias("flat"), F.first("m").alias("m"))
    total = part.groupBy("cut").agg(F.sum(F.col("bits") + F.log2("m")).alias("bits"), F.max("flat").alias("flat"), F.count("*").alias("parts"))
    return total.where("parts = 2").select(F.col("cut").cast("long").alias("rank"), F.when(F.col("flat") == 0, F.col("bits")).alias("code_length"))


def maximal_regions(clusters: DataFrame) -> DataFrame:
    """(subspace, cluster, lows, highs): rectangles that cover a cluster's units. From each unit not yet covered, in order, a rectangle grows axis by
    axis, as far as all its units are there; then rectangles that the union of larger ones covers go, smallest first."""

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        units = {tuple(int(x) for x in b) for b in pdf["bins"]}
        left, boxes = sorted(units), []

        def full(lo, hi):
            n = 1
            for a, b in zip(lo, hi, strict=True):
                n *= b - a + 1
            return n <= len(units) and n == sum(all(a <= x <= b for x, a, b in zip(u, lo, hi, strict=True)) for u in units)

        while left:
            lo = list(left[0])
            hi = list(lo)
            for axis in range(len(lo)):
                for bound, step in ((lo, -1), (hi, 1)):
                    while True:
                        bound[axis] += step
                        if not full(lo, hi):
                            bound[axis] -= step
                            break
            boxes.append((tuple(lo), tuple(hi)))
            left = [u for u in left if not all(a <= x <= b for x, a, b in zip(u, lo, hi, strict=True))]
        held = lambda box: {u for u in units if all(a <= x <= b for x, a, b in zip(u, *box, strict=True))}
        kept = sorted(set(boxes), key=lambda b: (len(held(b)), b))
        for box in list(kept):
            others = set().union(*(held(b) for b in kept if b != box)) if len(kept) > 1 else set()
            if held(box) <= others:
                kept.remove(box)
        first = pdf.iloc[0]
        return pd.DataFrame([(list(first["subspace"]), first["cluster"], list(lo), list(hi)) for lo, hi in sorted(kept)], columns=["subspace", "cluster", "lows", "highs"])

    return clusters.groupBy("cluster").applyInPandas(cover, "subspace array<long>, cluster string, lows array<long>, highs array<long>")


def predict(members: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, cluster): the last cluster with a rectangle around the row; null if none. regions are few and of one subspace."""
    sides = regions.select("cluster", F.posexplode("subspace").alias("k", "ax"), "lows", "highs").select("cluster", "ax", F.expr("lows[k]").alias("lo"), F.expr("highs[k]").alias("hi"), "lows", "highs")
    held = members.join(sides, (F.col("axis") == F.col("ax")) & F.col("bin").between(F.col("lo"), F.col("hi")))
    hit = held.groupBy("id", "cluster", "lows", "highs").agg(F.count("*").alias("c")).where(F.col("c") == F.size("lows"))
    best = hit.groupBy(F.col("id").alias("i")).agg(F.max("cluster").alias("cluster"))
    return members.select("id").distinct().join(best, F.col("id") == F.col("i"), "left").select("id", "cluster")


# --- interest of subspaces, and the whole search. Subspaces come to the driver as (axes, coverage, entropy): their number depends on the axes and levels, not on the rows.

Measured = list[tuple[tuple[int, ...], int, float]]


def keep_by_code_length(measured: Measured, keep_ratio: float = 0.0) -> set[tuple[int, ...]]:
    """Subspaces before the cut with the least bits for coverages as deviations from the means of both sides, by coverage from the top. At least two stay, and
    ``keep_ratio`` of them; cuts with a deviation of zero are passed over; without a cut all stay."""
    ranked = sorted(measured, key=lambda m: (-m[1], m[0]))
    coverage = [m[1] for m in ranked]
    n = len(ranked)
    best, cut = math.inf, n
    for i in range(int(max(2, n * min(1.0, max(0.0, keep_ratio)))), n - 1):
        bits = 0.0
        for side in (coverage[:i], coverage[i:]):
            mean = sum(side) / len(side)
            away = [abs(c - mean) for c in side]
            bits += math.inf if min(away) <= 1e-5 * mean else sum(map(math.log2, away)) + math.log2(mean)
        if bits < best:
            best, cut = bits, i
    return {m[0] for m in ranked[:cut]}


def keep_by_entropy(measured: Measured, keep_ratio: float = 1.0, max_entropy: float = math.inf) -> set[tuple[int, ...]]:
    """Of the subspaces with an entropy under ``max_entropy``, the share ``keep_ratio`` with the lowest."""
    low = sorted((m for m in measured if m[2] < max_entropy), key=lambda m: (m[2], m[0]))
    return {m[0] for m in low[: int(len(low) * min(1.0, max(0.0, keep_ratio)))]}


MEASURES: dict[str, Callable[..., set[tuple[int, ...]]]] = {"mdl": keep_by_code_length, "entropy": keep_by_entropy}


def measured_subspaces(units: DataFrame) -> Measured:
    both = subspace_coverage(units).join(subspace_entropy(units), "subspace")
    return sorted((tuple(r["subspace"]), r["coverage"], r["entropy"]) for r in both.collect())


def _of_subspaces(df: DataFrame, kept: set[tuple[int, ...]]) -> DataFrame:
    return df.where(F.concat_ws(",", F.col("subspace").cast("array<string>")).isin([",".join(map(str, k)) for k in sorted(kept)]))


def deepest_clusters(members: DataFrame, support: int, levels: int, min_objects: int | None = None, interest: str | Callable | None = None, **how) -> DataFrame:
    """(subspace, bins, n, cluster) of one subspace: of those of the deepest level with dense units, at most ``levels``, the one with the fewest units in clusters
    of at least ``min_objects`` rows (``support`` if not given), of equals the first. ``interest`` is mdl, entropy, or a callable from the measured subspaces of a
    level (and ``how``) to those that stay; a subspace is looked at only if all its faces stayed."""
    _checkpoints(members.sparkSession)
    least = support if min_objects is None else min_objects
    measure = MEASURES[interest] if isinstance(interest, str) else interest

    def pruned(units: DataFrame, level: DataFrame) -> tuple[DataFrame, DataFrame, set | None]:
        if measure is None:
            return units, level, None
        kept = set(measure(measured_subspaces(unit_clusters(units, least)), **how))
        return _of_subspaces(units, kept), _of_subspaces(level, kept), kept

    units = first_units(members, support).checkpoint()
    base = inside(members, units).checkpoint()
    units, level, kept = pruned(units, base)
    for _ in range(levels - 1):
        grown, rows = next_units(level, base, units, support)
        if kept is not None:
            found = {tuple(r["subspace"]) for r in grown.select("subspace").distinct().collect()}
            whole = {s for s in found if all(s[:i] + s[i + 1 :] in kept for i in range(len(s)))}
            grown, rows = _of_subspaces(grown, whole), _of_subspaces(rows, whole)
        grown = grown.checkpoint()
        if grown.isEmpty():
            break
        units, level, kept = pruned(grown, rows.checkpoint())
    clusters = unit_clusters(units, least).checkpoint()
    best = clusters.groupBy("subspace").agg(F.count("*").alias("units")).orderBy("units", "subspace").select("subspace").limit(1)
    return clusters.join(F.broadcast(best), "subspace", "left_semi")


@dataclass(frozen=True)
class CliqueModel:
    """What predict_rows needs: the axes, their knots, and (subspace, cluster, lows, highs) with clusters numbered from 0."""

    columns: tuple[str, ...]
    knots: tuple[tuple[float, float, int], ...]
    regions: DataFrame


def fit_rows(rows: DataFrame, id_col: str, columns: list[str], support: int, levels: int, bins: int, min_objects: int | None = None, interest: str | Callable | None = None, **how) -> tuple[DataFrame, CliqueModel]:
    """(id, cluster) of all rows, and the model: the whole search on a grid of ``bins`` bins an axis. Rows with equal codes are searched as one. A row in no
    region has -1; nulls are in no bin."""
    knots = grid_knots(rows, columns, bins=bins)
    codes = [f"code_{c}" for c in columns]
    few = collapsed(grid_codes(rows, columns, knots).dropna(subset=codes).select(*codes), codes)
    clusters = deepest_clusters(memberships(few, "row", codes, "w"), support, levels, min_objects, interest, **how)
    number = (F.dense_rank().over(Window.orderBy("cluster")) - 1).cast("long")
    model = CliqueModel(tuple(columns), tuple(knots), maximal_regions(clusters).withColumn("cluster", number).checkpoint())
    return predict_rows(rows, id_col, model), model


def predict_rows(rows: DataFrame, id_col: str, model: CliqueModel) -> DataFrame:
    """(id, cluster): the last cluster with a region around the row, on the model's knots; -1 if none."""
    columns = list(model.columns)
    coded = grid_codes(rows, columns, list(model.knots))
    members = memberships(coded, id_col, [f"code_{c}" for c in columns])
    return predict(members, model.regions).withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long")))
