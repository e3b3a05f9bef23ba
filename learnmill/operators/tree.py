"""Classification trees, grown a level at a time.

The tree is a table of nodes on the driver; rows keep a node_id. Each level is one aggregate of class weights by (node, attribute, value), windowed
cumulative sums over the values, and the best split of each node; rows are routed by the new nodes and the next level follows.
Pure nodes are not split.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Node:
    node_id: int
    parent: int | None
    depth: int
    counts: dict = field(default_factory=dict)
    attribute: str | None = None
    op: str | None = None  # "<=" or "=": rows that fit go left; "in": each category has a child, left is the first
    value: object = None
    left: int | None = None
    right: int | None = None
    gain: float = 0.0
    children: dict | None = None

    def kids(self) -> list[int]:
        return [] if self.left is None else list(self.children.values()) if self.children else [self.left, self.right]


@dataclass(frozen=True)
class TreeConfig:
    """Attributes: name -> True for continuous. cost[predicted][actual]; priors by class. multiway: a categorical attribute splits into all its categories at once."""

    attributes: dict
    label: str
    impurity: str = "gini"
    max_depth: int = 5
    leaf_min_rows: int = 1
    leaf_min_weight: float = 0.0
    min_decrease: float = 0.0
    left_most: bool = False
    weight: str | None = None
    priors: dict | None = None
    cost: dict | None = None
    multiway: bool = False


def impurity(shares: Column, kind: str) -> Column:
    if kind == "gini":
        return 1 - F.aggregate(shares, F.lit(0.0), lambda s, p: s + p * p)
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p)).otherwise(0.0))


def _shares(weights: list[Column]) -> Column:
    total = sum(weights[1:], weights[0])
    return F.array(*(F.when(total > 0, w / total).otherwise(0.0) for w in weights))


def split_table(rows: DataFrame, node: str, cfg: TreeConfig, classes: list, scale: dict) -> DataFrame:
    """(node, k, threshold, cat, gain, n_left, n_right, cats): every split of every node. ``scale`` turns a class's weight into its share of the prior: prior / class weight.

    Values of continuous attributes are split between neighbours (at their middle, or at the left one); of categorical ones, one value against the others, or, if
    multiway, all values at once: then threshold and cat are null, and cats has the values."""
    w = F.coalesce(F.col(cfg.weight), F.lit(1.0)) if cfg.weight else F.lit(1.0)
    names = list(cfg.attributes)
    # continuous values stay numbers and categories stay strings, side by side
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), (F.col(a).cast("double") if cfg.attributes[a] else F.lit(None).cast("double")).alias("num"), (F.lit(None).cast("string") if cfg.attributes[a] else F.col(a).cast("string")).alias("cat")) for i, a in enumerate(names)))).alias("c")
    long = rows.select(F.col(node).alias("node"), F.col(cfg.label).alias("y"), w.alias("w"), cells).select("node", "y", "w", "c.k", "c.num", "c.cat").where("num is not null or cat is not null")
    per = long.groupBy("node", "k", "num", "cat").agg(F.count("*").alias("n"), *(F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0.0)).alias(f"w{i}") for i, c in enumerate(classes)))
    whole = Window.partitionBy("node", "k")
    upto = whole.orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    order = whole.orderBy("num")
    parts = ["n", *(f"w{i}" for i in range(len(classes)))]
    per = per.withColumns({f"all_{p}": F.sum(p).over(whole) for p in parts} | {f"l_{p}": F.when(F.col("num").isNotNull(), F.sum(p).over(upto)).otherwise(F.col(p)) for p in parts} | {"next": F.lead("num").over(order), "n_values": F.count("*").over(whole), "least": F.min("n").over(whole)})
    per = per.withColumns({f"r_{p}": F.col(f"all_{p}") - F.col(f"l_{p}") for p in parts})
    prior = [scale[c] for c in classes]
    adjusted = lambda side: [F.col(f"{side}w{i}") * prior[i] for i in range(len(classes))]
    raw = lambda side: sum((F.col(f"{side}w{i}") for i in range(1, len(classes))), F.col(f"{side}w0"))
    here = sum(adjusted("all_")[1:], adjusted("all_")[0])
    parent = impurity(_shares(adjusted("all_")), cfg.impurity)
    both = (raw("l_") * impurity(_shares(adjusted("l_")), cfg.impurity) + raw("r_") * impurity(_shares(adjusted("r_")), cfg.impurity)) / raw("all_")
    multi = None
    if cfg.multiway and not all(cfg.attributes.values()):
        sides = per.where("cat is not null").withColumns({"_in": raw("l_") * impurity(_shares(adjusted("l_")), cfg.impurity), "_w": raw("l_"), "_all": raw("all_"), "_here": here, "_parent": parent})
        multi = sides.groupBy("node", "k").agg(F.sort_array(F.collect_list("cat")).alias("cats"), F.sum("_in").alias("inside"), F.min("n").alias("n_left"), F.min("_w").alias("least_w"), *(F.first(c).alias(c) for c in ("_all", "_here", "_parent")))
        multi = multi.where((F.size("cats") > 1) & (F.col("n_left") >= cfg.leaf_min_rows) & (F.col("least_w") >= cfg.leaf_min_weight))
        multi = multi.select("node", "k", F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("string").alias("cat"), (F.col("_here") * (F.col("_parent") - F.col("inside") / F.col("_all"))).alias("gain"), "n_left", F.lit(None).cast("long").alias("n_right"), "cats")
        per = per.where("cat is null")
    fits = (F.col("l_n") >= cfg.leaf_min_rows) & (F.col("r_n") >= cfg.leaf_min_rows) & (raw("l_") >= cfg.leaf_min_weight) & (raw("r_") >= cfg.leaf_min_weight)
    fits &= F.when(F.col("num").isNotNull(), F.col("next").isNotNull() & (F.col("next") - F.col("num") > 1e-8)).otherwise((F.col("n_values") > 1) & (F.col("least") >= cfg.leaf_min_rows))
    at = F.col("num") if cfg.left_most else (F.col("num") + F.col("next")) / 2
    binary = per.where(fits).select("node", "k", F.when(F.col("num").isNotNull(), at).alias("threshold"), "cat", (here * (parent - both)).alias("gain"), F.col("l_n").alias("n_left"), F.col("r_n").alias("n_right"), F.lit(None).cast("array<string>").alias("cats"))
    return binary if multi is None else binary.unionByName(multi)


def best_splits(table: DataFrame, min_decrease: float = 0.0, digits: int = 12) -> DataFrame:
    """One row a node: the largest gain (compared to ``digits`` places), of equals the first attribute and the smallest value."""
    order = Window.partitionBy("node").orderBy(F.desc("g"), "k", "threshold", "cat")
    return table.withColumn("g", F.round("gain", digits)).where(F.col("g") >= min_decrease).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "g")


@dataclass
class Tree:
    cfg: TreeConfig
    nodes: dict[int, Node]
    classes: list
    scale: dict

    # --- posteriors, labels and risks from node counts

    def mass(self, n: Node) -> dict:
        """p(class, node)"""
        return {c: n.counts.get(c, 0.0) * self.scale[c] for c in self.classes}

    def decide(self, n: Node) -> tuple[object, float]:
        """The node's label and its risk p(t) r(t): the largest share, or the least expected cost; of equals the first class."""
        m = self.mass(n)
        cost = lambda p: sum(m[a] * (self.cfg.cost[p][a] if self.cfg.cost else float(a != p)) for a in self.classes)
        label = min(self.classes, key=lambda p: (round(cost(p), 12), self.classes.index(p)))
        return label, cost(label)

    def leaves(self, start: int = 0) -> list[int]:
        n = self.nodes[start]
        return [start] if n.left is None else [leaf for kid in n.kids() for leaf in self.leaves(kid)]

    def below(self, start: int) -> list[int]:
        n = self.nodes[start]
        return [start, *(i for kid in n.kids() for i in self.below(kid))]

    def risks(self) -> list[tuple[int, float, float, int, float | None]]:
        """(node, R(t), R(T_t), leaves, g) of every reachable node; g is None at leaves."""
        out = []
        for i in sorted(self.below(0)):
            leaves = self.leaves(i)
            r, rt = self.decide(self.nodes[i])[1], sum(self.decide(self.nodes[k])[1] for k in leaves)
            out.append((i, r, rt, len(leaves), (r - rt) / (len(leaves) - 1) if len(leaves) > 1 else None))
        return out

    def collapsed(self, ids) -> Tree:
        nodes = {i: replace(n) for i, n in self.nodes.items()}
        for i in ids:
            nodes[i].left = nodes[i].right = nodes[i].attribute = nodes[i].children = None
        out = Tree(self.cfg, nodes, self.classes, self.scale)
        live = set(out.below(0))
        out.nodes = {i: n for i, n in nodes.items() if i in live}
        return out

    def simple_prune(self) -> Tree:
        """Collapses nodes whose subtree has no smaller risk than they have."""
        return self.collapsed([i for i, r, rt, n, _ in self.risks() if n > 1 and r <= rt + 1e-12])

    def cost_complexity_path(self) -> list[tuple[float, Tree]]:
        """(alpha, tree): the nested sequence by weakest links, from the simply pruned tree to the root."""
        tree = self.simple_prune()
        out = [(0.0, tree)]
        while tree.nodes[0].left is not None:
            links = [(g, i) for i, _, _, _, g in tree.risks() if g is not None]
            least = min(g for g, _ in links)
            tree = tree.collapsed([i for g, i in links if g <= least + 1e-12])
            out.append((least, tree))
        return out

    def at_alpha(self, alpha: float) -> Tree:
        """The tree of the largest jump point that is at most alpha."""
        return [t for a, t in self.cost_complexity_path() if a <= alpha + 1e-15][-1]

    # --- rows

    def route(self, rows: DataFrame, out: str = "leaf", seen: dict[str, list] | None = None) -> DataFrame:
        """rows with the id of the node they reach: a leaf, or the node that asks for a value which is null, or is a category that ``seen`` (attribute -> categories of
        the training rows, see categories()) does not have; such a row gets that node's majority."""

        def walk(i: int) -> Column:
            n = self.nodes[i]
            if n.left is None:
                return F.lit(i)
            value = F.col(n.attribute).cast("double" if n.op == "<=" else "string")
            if n.children:
                reached = F.lit(i)
                for category, kid in n.children.items():
                    reached = F.when(value == category, walk(kid)).otherwise(reached)
                return reached
            stays = value.isNull()
            if n.op != "<=" and seen and n.attribute in seen:
                stays = stays | ~value.isin([str(x) for x in seen[n.attribute]])
            test = value <= float(n.value) if n.op == "<=" else value == str(n.value)
            return F.when(stays, F.lit(i)).when(test, walk(n.left)).otherwise(walk(n.right))

        return rows.withColumn(out, walk(0).cast("long"))

    def predict(self, rows: DataFrame, seen: dict[str, list] | None = None) -> DataFrame:
        labels = F.create_map(*(F.lit(x) for i in self.below(0) for x in (i, self.decide(self.nodes[i])[0])))
        return self.route(rows, seen=seen).withColumn("predicted", labels[F.col("leaf").cast("int")])

    def rules(self) -> list[tuple[int, str, object]]:
        """(leaf, conditions, label): each leaf's path, simplified: the largest lower and smallest upper bound of an attribute, one equality or all inequalities."""
        out = []
        for leaf in self.leaves():
            bounds: dict[str, list] = {}
            i = leaf
            while self.nodes[i].parent is not None:
                p = self.nodes[self.nodes[i].parent]
                if p.children:
                    bounds.setdefault(p.attribute, []).append(("=", next(c for c, kid in p.children.items() if kid == i)))
                else:
                    bounds.setdefault(p.attribute, []).append((p.op if p.left == i else {"<=": ">", "=": "!="}[p.op], p.value))
                i = p.node_id
            parts = []
            for a in sorted(bounds):
                low = [v for op, v in bounds[a] if op == ">"]
                high = [v for op, v in bounds[a] if op == "<="]
                same = [v for op, v in bounds[a] if op == "="]
                parts += [f"{a} > {max(low):g}"] if low else []
                parts += [f"{a} <= {min(high):g}"] if high else []
                parts += [f"{a} = {same[0]}"] if same else [f"{a} != {v}" for v in sorted(v for op, v in bounds[a] if op == "!=")]
            out.append((leaf, " and ".join(parts), self.decide(self.nodes[leaf])[0]))
        return out


def categories(rows: DataFrame, cfg: TreeConfig) -> dict[str, list]:
    """The categories of each categorical attribute, for Tree.predict."""
    names = [a for a, continuous in cfg.attributes.items() if not continuous]
    found = rows.agg(*(F.sort_array(F.collect_set(F.col(a).cast("string"))).alias(a) for a in names)).first() if names else {}
    return {a: list(found[a]) for a in names}


def grow(rows: DataFrame, cfg: TreeConfig) -> Tree:
    """A tree of up to max_depth levels. The driver holds nodes and one best split a node, never rows."""
    w = F.coalesce(F.col(cfg.weight), F.lit(1.0)) if cfg.weight else F.lit(1.0)
    totals = {r["y"]: r["w"] for r in rows.groupBy(F.col(cfg.label).alias("y")).agg(F.sum(w).alias("w")).collect()}
    classes = sorted(totals)
    every = sum(totals.values())
    scale = {c: (cfg.priors or {c: totals[c] / every})[c] / totals[c] for c in classes}
    tree = Tree(cfg, {0: Node(0, None, 0, totals)}, classes, scale)
    names, active = list(cfg.attributes), [0]
    for depth in range(cfg.max_depth):
        active = [i for i in active if sum(v > 0 for v in tree.nodes[i].counts.values()) > 1]
        if not active:
            break
        placed = tree.route(rows, "_node").where(F.col("_node").isin(active))
        splits = best_splits(split_table(placed, "_node", cfg, classes, scale), cfg.min_decrease).collect()
        fresh = []
        for s in sorted(splits, key=lambda s: s["node"]):
            n = tree.nodes[s["node"]]
            n.attribute, n.gain = names[s["k"]], s["gain"]
            kids = list(range(len(tree.nodes), len(tree.nodes) + len(s["cats"] or "12")))
            n.left, n.right = kids[:2]
            if s["cats"]:
                n.op, n.children = "in", dict(zip(s["cats"], kids, strict=True))
            else:
                n.op, n.value = ("<=", s["threshold"]) if s["cat"] is None else ("=", s["cat"])
            for i in kids:
                tree.nodes[i] = Node(i, n.node_id, depth + 1)
            fresh += kids
        if not fresh:
            break
        for r in tree.route(rows, "_node").where(F.col("_node").isin(fresh)).groupBy("_node", F.col(cfg.label).alias("y")).agg(F.sum(w).alias("w")).collect():
            tree.nodes[r["_node"]].counts[r["y"]] = r["w"]
        active = fresh
    return tree


def test_cost(tree: Tree, rows: DataFrame) -> float:
    """Average cost of the tree's predictions."""
    cfg = tree.cfg
    p = tree.predict(rows)
    if not cfg.cost:
        return float(p.agg(F.avg((F.col("predicted") != F.col(cfg.label)).cast("double")).alias("c")).first()["c"] or 0.0)
    got = p.groupBy("predicted", F.col(cfg.label).alias("y")).count().collect()
    return sum(cfg.cost[r["predicted"]][r["y"]] * r["count"] for r in got) / max(1, sum(r["count"] for r in got))


def cross_validated_prune(rows: DataFrame, cfg: TreeConfig, fold: str, n_folds: int) -> tuple[Tree, list[tuple[float, float]]]:
    """The pruned tree with the least cross-validated cost, and (alpha, cost) of each; alphas are the geometric middles of the jump points."""
    whole = grow(rows, cfg)
    jumps = [a for a, _ in whole.cost_complexity_path()]
    middles = [math.sqrt(a * b) for a, b in zip(jumps, jumps[1:], strict=False)] + [jumps[-1] * 1.01]
    costs = np.zeros(len(middles))
    for f in range(n_folds):
        part = grow(rows.where(F.col(fold) != f), cfg)
        held = rows.where(F.col(fold) == f)
        known: dict[tuple, float] = {}
        for k, a in enumerate(middles):
            t = part.at_alpha(a)
            key = tuple(sorted(t.leaves()))
            if key not in known:
                known[key] = test_cost(t, held)
            costs[k] += known[key] / n_folds
    return whole.at_alpha(middles[int(costs.argmin())]), list(zip(middles, costs.tolist(), strict=True))


def surrogate_importance(tree: Tree, rows: DataFrame) -> dict[str, float]:
    """For each attribute, the summed gain of its own splits and, elsewhere, of its split that best agrees with the node's own. A multiway split has no
    surrogates: it counts for its own attribute alone."""
    cfg, names = tree.cfg, list(tree.cfg.attributes)
    out = dict.fromkeys(names, 0.0)
    for i in tree.below(0):
        n = tree.nodes[i]
        if n.left is None:
            continue
        if n.children:
            out[n.attribute] += n.gain
            continue
        test = F.col(n.attribute).cast("double") <= float(n.value) if n.op == "<=" else F.col(n.attribute).cast("string") == n.value
        here = _rows_below(tree, rows, i).withColumn("_side", F.when(F.coalesce(test, F.lit(False)), "l").otherwise("r")).withColumn("_one", F.lit(0))
        sides = TreeConfig(cfg.attributes, "_side", "gini", leaf_min_rows=cfg.leaf_min_rows)
        agree = split_table(here, "_one", sides, ["l", "r"], {"l": 1.0, "r": 1.0})
        per = best_splits(agree.withColumn("node", F.col("k")))
        chosen = {r["k"]: r for r in per.collect()}
        own = split_table(here, "_one", cfg, tree.classes, tree.scale)
        gains = {(r["k"], r["threshold"], r["cat"]): r["gain"] for r in own.join(F.broadcast(per.select(F.col("k").alias("k2"), F.col("threshold").alias("t2"), F.col("cat").alias("c2"))), (F.col("k") == F.col("k2")) & F.col("threshold").eqNullSafe(F.col("t2")) & F.col("cat").eqNullSafe(F.col("c2"))).collect()}
        for k, r in chosen.items():
            out[names[k]] += n.gain if names[k] == n.attribute else gains.get((k, r["threshold"], r["cat"]), 0.0)
    return out


def _rows_below(tree: Tree, rows: DataFrame, i: int) -> DataFrame:
    return tree.route(rows, "_leaf").where(F.col("_leaf").isin(tree.leaves(i))).drop("_leaf")
