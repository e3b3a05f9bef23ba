"""Neighbourhoods by a bucketed range join, and what is built on them: DBSCAN, OPTICS, local outlier factors and
distance-based outliers. Points are rows (id, x, y) in the plane, or (id, v) with arrays of any length and a metric.

The plane is cut into square cells of the radius; a point meets the points of its own cell and of the eight around it by an
equi-join on cells, and the exact distance decides. The number of points near a point bounds the work, not the square of all. Arrays are
first mapped to a plane by their distances to two pivots: by the triangle inequality, points within the radius are within it there too, in each axis.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnmill.functions.scalar import squared_distance


#: Distances of two array columns. A callable of two columns may be given instead, if it keeps the triangle inequality.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": lambda a, b: F.sqrt(squared_distance(a, b)),
    "manhattan": lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x),
    "chebyshev": lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))),
}
Metric = str | Callable[[Column, Column], Column]


def metric_of(metric: Metric) -> Callable[[Column, Column], Column]:
    return METRICS[metric] if isinstance(metric, str) else metric


def coordinates(points: DataFrame) -> list[str]:
    return ["v"] if "v" in points.columns else ["x", "y"]


def _in_plane(left: DataFrame, right: DataFrame, metric: Metric) -> tuple[DataFrame, DataFrame]:
    """Both sides with x, y: distances to two points of the right side, those with the smallest hashes of their ids."""
    d = metric_of(metric)
    pivots = [r["v"] for r in right.where("v is not null").orderBy(F.xxhash64("id"), "id").limit(2).collect()] or [[]]
    axes = [d(F.col("v"), F.array(*(F.lit(float(x)) for x in p))) for p in (pivots[0], pivots[-1])]
    return tuple(side.select("id", "v", axes[0].alias("x"), axes[1].alias("y")) for side in (left, right))


def _cells(points: DataFrame, width: float, reach: int) -> DataFrame:
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)))).alias("s")
    return points.select("*", steps).select(*points.columns, (F.floor(F.col("x") / width) + F.col("s.a")).alias("cx"), (F.floor(F.col("y") / width) + F.col("s.b")).alias("cy"))


def range_join(left: DataFrame, right: DataFrame, radius: float, metric: Metric = "euclidean") -> DataFrame:
    """(i, j, d2) of all points of left and right with a distance of at most radius, each within itself included; d2 is the squared distance. metric
    is for points with arrays; points in the plane are Euclidean."""
    arrays = "v" in left.columns
    if arrays:
        left, right = _in_plane(left, right, metric)
    # in the plane of the pivots distances are rounded: cells a little wider lose nothing
    width = radius * (1 + 1e-9) + 1e-9 if arrays else radius
    own = ["v"] if arrays else ["x", "y"]
    a = _cells(left, width, 0).select(F.col("id").alias("i"), *(F.col(c).alias(c + "i") for c in own), "cx", "cy")
    b = _cells(right, width, 1).select(F.col("id").alias("j"), *(F.col(c).alias(c + "j") for c in own), "cx", "cy")
    if arrays:
        met = a.join(b, ["cx", "cy"]).select("i", "j", metric_of(metric)(F.col("vi"), F.col("vj")).alias("d")).where(F.col("d") <= radius)
        return met.select("i", "j", (F.col("d") * F.col("d")).alias("d2"))
    d2 = (F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj")) + (F.col("yi") - F.col("yj")) * (F.col("yi") - F.col("yj"))
    return a.join(b, ["cx", "cy"]).select("i", "j", d2.alias("d2")).where(F.col("d2") <= radius * radius)


def connected_labels(edges: DataFrame, nodes: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, label): the smallest node reachable over edges (i, j), given in both directions. Each round takes the least label around, then
    follows it once (a label is itself a node), so long chains halve; each round's table is checkpointed."""
    _checkpoints(edges.sparkSession)
    edges = edges.where("i <> j").select("i", "j").checkpoint()
    labels = nodes.select("id", F.col("id").alias("label")).checkpoint()
    for _ in range(max_rounds):
        around = edges.join(labels, F.col("j") == F.col("id")).groupBy(F.col("i").alias("n")).agg(F.min("label").alias("least"))
        near = labels.join(around, F.col("id") == F.col("n"), "left").select("id", F.least("label", F.coalesce("least", "label")).alias("label"), F.col("label").alias("old"))
        jump = near.select(F.col("id").alias("n"), F.col("label").alias("further"))
        new = near.join(jump, F.col("label") == F.col("n"), "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "old").checkpoint()
        labels = new.select("id", "label")
        if new.where("label <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def _checkpoints(spark) -> None:
    import tempfile

    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="learnmill-"))


def eps_degree(points: DataFrame, radius: float, metric: Metric = "euclidean") -> DataFrame:
    """(id, degree): points within the radius, itself included. Arrays with the Euclidean metric are counted by products of blocks; distances
    too close to the radius for that are made again term by term."""
    if "v" in points.columns and metric == "euclidean":
        return _degrees_by_blocks(points, radius)
    return range_join(points, points, radius, metric).groupBy(F.col("i").alias("id")).agg(F.count("*").alias("degree"))


def _degrees_by_blocks(points: DataFrame, radius: float, rows: int = 2000) -> DataFrame:
    there = points.select("id", "v").where(metric_of("euclidean")(F.col("v"), F.col("v")) == 0)
    n = -(-there.count() // rows) or 1
    block = F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")
    blocks = there.select("id", "v", block, F.size("v").alias("size")).groupBy("block", "size").agg(F.collect_list(F.struct("id", "v")).alias("all")).select("size", F.col("all.id").alias("ids"), F.flatten("all.v").alias("values"))
    right = blocks.select(F.col("size").alias("other"), F.col("values").alias("others"))
    kind = points.schema["id"].dataType.simpleString()

    def count(batches):
        for pdf in batches:
            for ids, size, u, w in pdf[["ids", "size", "values", "others"]].itertuples(index=False):
                a, b = (np.asarray(z, float).reshape(-1, size) if size else np.zeros((1, 0)) for z in (u, w))
                sa, sb = (a * a).sum(1), (b * b).sum(1)
                d2 = sa[:, None] + sb[None] - 2 * (a @ b.T)
                slack = 1e-12 * (size + 8) * (radius * radius + sa.max() + sb.max())
                degree = (d2 < radius * radius - slack).sum(1)
                i, j = np.nonzero(np.abs(d2 - radius * radius) <= slack)
                total = np.zeros(len(i))
                for c in range(size):
                    t = a[i, c] - b[j, c]
                    total += t * t
                np.add.at(degree, i[np.sqrt(total) <= radius], 1)
                yield pd.DataFrame({"id": ids, "degree": degree})

    pairs = blocks.join(right, F.col("size") == F.col("other")).select("ids", "size", "values", "others").repartition(min(n * n, 200))
    return pairs.mapInPandas(count, f"id {kind}, degree long").groupBy("id").agg(F.sum("degree").alias("degree")).where("degree > 0")


def dbscan(points: DataFrame, min_points: int, radius: float, metric: Metric = "euclidean") -> DataFrame:
    """(id, core, cluster): clusters are numbered from 0 by their smallest core point; a border point takes the cluster with the smallest
    core among its core neighbours'; noise is -1."""
    near = range_join(points, points, radius, metric).select("i", "j")
    core = near.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select("id")
    to_core = near.join(core.withColumnRenamed("id", "c"), F.col("j") == F.col("c"), "left_semi")
    between = to_core.join(core.withColumnRenamed("id", "c"), F.col("i") == F.col("c"), "left_semi")
    labels = connected_labels(between, core)
    numbers = labels.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("cluster"))
    of_core = labels.join(numbers, "label").select(F.col("id").alias("c"), "cluster")
    reached = to_core.join(of_core, F.col("j") == F.col("c")).groupBy(F.col("i").alias("r")).agg(F.min("cluster").alias("cluster"))
    return points.select("id").join(reached, F.col("id") == F.col("r"), "left").join(of_core.select(F.col("c").alias("k"), F.col("cluster").alias("own")), F.col("id") == F.col("k"), "left").select("id", F.col("own").isNotNull().alias("core"), F.coalesce("own", "cluster", F.lit(-1)).cast("long").alias("cluster"))


def predict_dbscan(new: DataFrame, points: DataFrame, labels: DataFrame, radius: float, metric: Metric = "euclidean") -> DataFrame:
    """(id, cluster) of new points: the smallest cluster of a core point within the radius, else -1."""
    cores = points.join(labels.where("core").select("id", "cluster"), "id")
    found = range_join(new.select("id", *coordinates(new)), cores.select("id", *coordinates(points)), radius, metric).join(cores.select(F.col("id").alias("c"), "cluster"), F.col("j") == F.col("c"))
    found = found.groupBy(F.col("i").alias("r")).agg(F.min("cluster").alias("cluster"))
    return new.select("id").join(found, F.col("id") == F.col("r"), "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def core_distance(points: DataFrame, min_points: int, radius: float, metric: Metric = "euclidean") -> DataFrame:
    """(id, core_distance): distance of the min_points-th nearest point, itself included; null beyond the radius."""
    order = Window.partitionBy("i").orderBy("d2", "j")
    ranked = range_join(points, points, radius, metric).withColumn("k", F.row_number().over(order)).where(F.col("k") == min_points)
    return points.select("id").join(ranked.select(F.col("i").alias("r"), F.sqrt("d2").alias("core_distance")), F.col("id") == F.col("r"), "left").select("id", "core_distance")


def optics(points: DataFrame, min_points: int, radius: float, metric: Metric = "euclidean") -> DataFrame:
    """(pos, id, core_distance, reachability): the cluster order, starting from the smallest unvisited id; of equal keys the smallest id is
    next. Undefined distances are infinite. The order is one sequential walk in a single group. It holds the points and makes the distances from one point at
    a time; only for a metric given as a callable it needs the table of neighbours, held as three arrays."""
    own = coordinates(points)
    walked = "pos long, id long, core_distance double, reachability double"
    if own == ["v"] and metric not in METRICS:
        near = range_join(points, points, radius, metric).select("i", "j", F.sqrt("d2").alias("d"))

        def of_table(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["i", "j"])
            ids, starts = np.unique(pdf["i"].to_numpy(), return_index=True)
            ends, to, d = np.append(starts[1:], len(pdf)), np.searchsorted(ids, pdf["j"].to_numpy()), pdf["d"].to_numpy()
            return _walk(ids, min_points, lambda i: (to[starts[i] : ends[i]], d[starts[i] : ends[i]]))

        return near.groupBy(F.lit("all")).applyInPandas(of_table, walked)

    def of_points(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        axes = [pdf[c].to_numpy() for c in own] if own != ["v"] else list(np.ascontiguousarray(np.stack(pdf["v"].tolist()).T))
        # places in the order of the first axis, along which no neighbour is further than the radius
        order = np.argsort(axes[0], kind="stable")
        line = [x[order] for x in axes]
        reach = radius * (1 + 1e-9) + 1e-9 * float(np.abs(line[0]).max())
        first, last = np.searchsorted(line[0], axes[0] - reach, "left"), np.searchsorted(line[0], axes[0] + reach, "right")

        def around(i):
            part = slice(first[i], last[i])
            if own == ["v"] and metric == "chebyshev":
                d = np.max([np.abs(x[part] - a[i]) for x, a in zip(line, axes)], axis=0)
            else:
                steps = (x[part] - a[i] for x, a in zip(line, axes))
                d = sum(np.abs(t) if own == ["v"] and metric == "manhattan" else t * t for t in steps)
            if own != ["v"]:
                near = d <= radius * radius
                return order[part][near], np.sqrt(d[near])
            d = np.sqrt(d) if metric == "euclidean" else d
            near = d <= radius
            return order[part][near], np.sqrt(d[near] * d[near])

        return _walk(pdf["id"].to_numpy(), min_points, around)

    if own == ["v"]:
        there = points.where(metric_of(metric)(F.col("v"), F.col("v")) == 0)
    else:
        there = points.where((F.col("x") - F.col("x") == 0) & (F.col("y") - F.col("y") == 0))
    return there.where("id is not null").select("id", *own).groupBy(F.lit("all")).applyInPandas(of_points, walked)


def _walk(ids: np.ndarray, min_points: int, around: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """The order over places 0, 1, ... of ascending ids; around gives a place's neighbours, itself included, and their distances."""
    n = len(ids)
    reach, core, seeds, order = np.full(n, np.inf), np.full(n, np.inf), np.full(n, np.inf), np.empty(n, int)
    done, start = np.zeros(n, bool), 0
    for pos in range(n):
        i = int(seeds.argmin())  # the first of equal ones, which has the smallest id
        if seeds[i] == np.inf:
            while done[start]:
                start += 1
            i = start
        done[i], seeds[i], order[pos] = True, np.inf, i
        j, d = around(i)
        if len(d) >= min_points:
            core[i] = np.partition(d, min_points - 1)[min_points - 1]
            r = np.maximum(core[i], d)
            less = (r < reach[j]) & ~done[j]
            j, r = j[less], r[less]
            reach[j] = seeds[j] = r
    return pd.DataFrame({"pos": np.arange(n), "id": ids[order], "core_distance": core[order], "reachability": reach[order]})


def optics_cut(order: DataFrame, radius: float) -> DataFrame:
    """(id, cluster) of an OPTICS order cut at a radius: a core point reached from further away opens a cluster, another point
    so reached is noise."""
    opens = (F.col("reachability") > radius) & (F.col("core_distance") <= radius)
    seen = F.sum(F.when(opens, 1).otherwise(0)).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return order.select("id", F.when((F.col("reachability") > radius) & (F.col("core_distance") > radius), -1).otherwise(seen).cast("long").alias("cluster"))


def steep_areas(order: DataFrame, xi: float, min_points: int, min_length: int = 1) -> DataFrame:
    """(start, stop) positions of the clusters between steep areas of an OPTICS order's reachability plot, extracted
    hierarchically: a down area is paired with a later up area if nothing between them rises over either by 1 - xi."""

    def extract(pdf: pd.DataFrame) -> pd.DataFrame:
        r = [*pdf.sort_values("pos")["reachability"].tolist(), math.inf]
        n = len(r) - 1

        def steep(t, up):
            a, b = (r[t], r[t + 1]) if up else (r[t + 1], r[t])
            if b == math.inf:
                return a < math.inf
            return a <= b * (1 - xi) + 1e-10

        def area(start, up):
            stop, flat, t = start, 0, start + 1
            while t < n and (r[t + 1] >= r[t] if up else r[t + 1] <= r[t]):
                if steep(t, up):
                    stop, flat = t, 0
                else:
                    flat += 1
                    if flat >= min_points:
                        break
                t += 1
            return stop

        downs, out, mib, t = [], [], 0.0, 0
        while t < n:
            mib = max(mib, r[t])
            if steep(t, False) or steep(t, True):
                downs = [[s, e, max(m, mib)] for s, e, m in downs if max(m, mib) <= r[s] * (1 - xi)]
            if steep(t, False):
                stop = area(t, False)
                if stop - t + 1 >= min_length:
                    downs.append([t, stop, 0.0])
                t, mib = stop + 1, r[stop + 1]
            elif steep(t, True):
                stop = area(t, True)
                for s, _, m in downs if stop - t + 1 >= min_length else []:
                    end_level = r[stop + 1]
                    if end_level * (1 - xi) < m:
                        continue
                    a, b = s, stop
                    if r[s] * (1 - xi) >= end_level:
                        while a < t and r[a + 1] > end_level:
                            a += 1
                    elif end_level * (1 - xi) >= r[s]:
                        while b > t and r[b] > r[s]:
                            b -= 1
                    if b - a + 1 >= min_points:
                        out.append((a, b))
                t, mib = stop + 1, r[stop + 1]
            else:
                t += 1
        return pd.DataFrame(sorted(set(out)), columns=["start", "stop"])

    return order.groupBy(F.lit("all")).applyInPandas(extract, "start long, stop long")


def _places(points: DataFrame, metric: Metric) -> tuple[DataFrame, float]:
    """(id, coordinates, x, y, n): each place once, by the smallest id there, with the number of its points; and a bound of all distances. Points without a distance to themselves are left out."""
    c = coordinates(points)
    if c == ["v"]:
        there = points.where(metric_of(metric)(F.col("v"), F.col("v")) == 0)
    else:
        there = points.where((F.col("x") - F.col("x") == 0) & (F.col("y") - F.col("y") == 0))
    found = there.where("id is not null").groupBy(*c).agg(F.min("id").alias("id"), F.count("*").alias("n")).checkpoint()
    if c == ["v"]:
        plane = _in_plane(found, found, metric)[0].select("id", "x", "y")
        found = found.join(plane, "id").checkpoint()
        far = 2 * (found.agg(F.max("x")).first()[0] or 0.0)  # by the triangle inequality, over the first pivot
    else:
        e = found.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
        far = math.hypot(e[0] or 0.0, e[1] or 0.0)
    return found, far * (1 + 1e-9)


#: The finest cells of the search for neighbours are 2 ** -FINEST as wide as all places.
FINEST = 20


def _near_places(places: DataFrame, far: float, k: int, radius: float, metric: Metric) -> DataFrame:
    """(i, j, d2, r, nj): for each place, the places at its first k distinct distances, with the rank of the distance. A place is first
    searched within the width of the smallest cell of its own with 2 k places (or radius, if less); what is found too little for is searched twice as far."""
    width = lambda level: far * 2.0**-level
    none = "i long, j long, d2 double, r int, nj long"
    if places.isEmpty():
        return places.sparkSession.createDataFrame([], none)
    least = max(0, math.ceil(math.log2(far / radius))) if far > 0 else 0
    cell = lambda w: (F.floor(F.col("x") / w).alias("cx"), F.floor(F.col("y") / w).alias("cy"))
    wide = F.lit(far if far > 0 else 1.0) * F.pow(F.lit(2.0), -F.col("level"))
    levels = F.explode(F.sequence(F.lit(least), F.lit(max(least, FINEST)))).alias("level")
    celled = places.select("id", "x", "y", levels).select("id", "level", *cell(wide))
    full = celled.groupBy("level", "cx", "cy").agg(F.count("*").alias("c")).where(F.col("c") >= 2 * k).drop("c")
    deepest = celled.join(full, ["level", "cx", "cy"]).groupBy(F.col("id").alias("e")).agg(F.max("level").alias("level"))
    left = places.drop("n").join(deepest, F.col("id") == F.col("e"), "left").withColumn("level", F.coalesce("level", F.lit(least))).drop("e").checkpoint()
    own = coordinates(places)
    served = None
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("s")
    while True:
        used = sorted(r["level"] for r in left.select("level").distinct().collect())
        if not used:
            break
        # a little wider than the radius: distances to the pivots are rounded
        wider = wide * (1 + 1e-9) + 1e-9 * (1 if own == ["v"] else 0)
        a = left.select("*", *cell(wider), steps).select(F.col("id").alias("i"), "level", *(F.col(c).alias(c + "i") for c in own), (F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy"))
        b = places.select("*", F.explode(F.array(*map(F.lit, used))).alias("level")).select(F.col("id").alias("j"), "level", *(F.col(c).alias(c + "j") for c in own), F.col("n").alias("nj"), *cell(wider))
        if own == ["v"]:
            d = metric_of(metric)(F.col("vi"), F.col("vj"))
            met = a.join(b, ["level", "cx", "cy"]).withColumn("d", d).where(F.col("d") <= wide).withColumn("d2", F.col("d") * F.col("d"))
        else:
            d2 = (F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj")) + (F.col("yi") - F.col("yj")) * (F.col("yi") - F.col("yj"))
            met = a.join(b, ["level", "cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= wide * wide)
        near = met.select("i", "j", "d2", "nj", "level").withColumn("r", F.dense_rank().over(Window.partitionBy("i").orderBy("d2"))).where(F.col("r") <= k).checkpoint()
        all_seen = [x for x in used if width(x) >= far]
        enough = near.groupBy(F.col("i").alias("e")).agg(F.max("r").alias("found"), F.max("level").alias("level")).where((F.col("found") >= k) | F.col("level").isin(all_seen)).select("e")
        part = near.join(enough, F.col("i") == F.col("e"), "left_semi").select("i", "j", "d2", "r", "nj")
        served = part if served is None else served.union(part)
        left = left.join(enough, F.col("id") == F.col("e"), "left_anti").withColumn("level", F.col("level") - 1).checkpoint()
    return served.checkpoint()


def k_distance_neighbors(points: DataFrame, k: int, radius: float, metric: Metric = "euclidean") -> DataFrame:
    """(i, j, d, k_distance): for each point, the points at its first ``k`` distinct distances (0 to itself included). radius bounds the first search; it is
    doubled for the points that it holds too few for, until all are served or have seen every point. Points at one place are searched for once."""
    _checkpoints(points.sparkSession)
    c = coordinates(points)
    points = points.select("id", *c).checkpoint()  # sums may differ in their last bits when they are made again, and no place would fit
    places, far = _places(points, metric)
    near = _near_places(places, far, k, radius, metric)
    there = points.select("id", *c).join(places.select(F.col("id").alias("p"), *c), c).select("id", "p")
    pairs = near.join(there.select(F.col("p").alias("i"), F.col("id").alias("a")), "i").join(there.select(F.col("p").alias("j"), F.col("id").alias("b")), "j")
    far_of = near.groupBy("i").agg(F.sqrt(F.max("d2")).alias("k_distance"))
    return pairs.join(far_of, "i").select(F.col("a").alias("i"), F.col("b").alias("j"), F.sqrt("d2").alias("d"), "k_distance")


def outlier_factor(points: DataFrame, k: int, radius: float, metric: Metric = "euclidean") -> DataFrame:
    """(id, factor): mean local reachability density of a point's neighbours by its own; neighbours do not include itself. radius bounds the first search.
    Every point that has another point gets a factor. Points at one place share theirs: each place is reckoned once, and weighs as many as it has."""
    _checkpoints(points.sparkSession)
    c = coordinates(points)
    points = points.select("id", *c).checkpoint()  # sums may differ in their last bits when they are made again, and no place would fit
    places, far = _places(points, metric)
    near = _near_places(places, far, k, radius, metric).select("i", "j", F.sqrt("d2").alias("d"), (F.col("nj") - (F.col("i") == F.col("j")).cast("long")).alias("w")).where("w > 0")
    k_distance = near.groupBy(F.col("i").alias("n")).agg(F.max("d").alias("kd"))
    reach = near.join(k_distance, F.col("j") == F.col("n")).select("i", "w", F.greatest("kd", "d").alias("r"))
    sums = reach.groupBy("i").agg(F.sum("w").alias("count"), F.sum(F.col("w") * F.col("r")).alias("sum"))
    density = sums.select("i", F.when(F.col("sum") > 0, F.col("count") / F.col("sum")).otherwise(F.lit(math.inf)).alias("lrd"))
    theirs = density.select(F.col("i").alias("n"), F.col("lrd").alias("their"))
    mean = near.join(theirs, F.col("j") == F.col("n")).groupBy("i").agg((F.sum(F.col("w") * F.col("their")) / F.sum("w")).alias("m"))
    factors = mean.join(density, "i").select(F.col("i").alias("p"), (F.col("m") / F.col("lrd")).alias("factor"))
    of_place = places.join(factors, F.col("id") == F.col("p")).select(*c, "factor")
    return points.select("id", *c).join(of_place, c).select("id", "factor")


def distance_outliers(points: DataFrame, share: float, distance: float, metric: Metric = "euclidean") -> DataFrame:
    """(id, n_near): points with at most int(N (1 - share)) points within the distance, itself included.

    In the plane, points in a cell so small that all its points are near each other, with more points than that, are passed over before
    the join; cells of width distance / (2 sqrt 2) and the exact count decide for the others."""
    most = int(points.count() * (1 - share) + 1e-9)
    left = points.select("id", *coordinates(points))
    if "v" not in points.columns:
        w = distance / (2 * math.sqrt(2))
        celled = left.withColumns({"gx": F.floor(F.col("x") / w), "gy": F.floor(F.col("y") / w)})
        crowded = celled.groupBy("gx", "gy").agg(F.count("*").alias("n")).where(F.col("n") > most).select("gx", "gy")
        left = celled.join(crowded, ["gx", "gy"], "left_anti").select("id", "x", "y")
    return range_join(left, points, distance, metric).groupBy(F.col("i").alias("id")).agg(F.count("*").alias("n_near")).where(F.col("n_near") <= most)
