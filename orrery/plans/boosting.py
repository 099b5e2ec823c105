"""Gradient boosting as a driver loop over Spark aggregates.

A round makes gradients as columns.  Where rows times features are few (Params.task_cells, counted first) one task then
grows the whole tree from its arrays; else each level is one job that returns the histograms of the smaller child of
every split, and the larger child's are the parent's less these.  Both ways use the same search (operators/splits.py)
on the same sums, so they give the same trees.  A node's best split depends on its rows alone, so best-first growth is
replayed from the levels with a heap.  Rows are sampled by hash, so results don't depend on partitioning.  Ties go to
the smaller feature, missing direction and bin; gains are rounded to 12 digits before they are compared.

Only histograms, quantiles and sums over eras reach the driver.  With an era penalty, histograms by era stay on the
cluster and only their variances by cell leave it."""

from __future__ import annotations

import dataclasses
import heapq
import json
import math
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.objectives import Objective
from ..functions.safe import clip
from ..operators import bundling
from ..operators import eras as E
from ..operators import tree as T
from ..operators.ordered import mixed
from ..operators.splits import Nodes, Rule, Sums, best, candidates, leaf_value
from ..sources.tables import forget, written

GROWTHS = ("leafwise", "depthwise", "symmetric", "hybrid")


@dataclass
class Params:
    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6
    max_leaves: int = 31
    growth: str = "leafwise"
    symmetric_depth: int = 3
    max_bins: int = 255
    exact_edges: bool = False
    edges: dict[str, list[float]] | None = None
    bundle: bool = False
    bundle_threshold: float = 0.0
    categorical: list[str] = field(default_factory=list)
    cat_smoothing: float = 10.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    min_child_weight: float = 1.0
    min_child_samples: int = 1
    adaptive: bool = False
    adaptive_alpha: float = 0.5
    adaptive_mu: float = 1.0
    monotone: dict[int, int] = field(default_factory=dict)
    subsample: float = 1.0
    colsample: float = 1.0
    goss: bool = False
    goss_top: float = 0.2
    goss_other: float = 0.1
    time_decay: float | None = None
    #: Ordered boosting: gradients of a row are made from its own score alone, so every permutation gives the same.
    ordered: bool = False
    permutations: int = 4
    dart: bool = False
    era_dart: bool = False
    era_dart_scale: float = 20.0
    drop_rate: float = 0.1
    skip_drop: float = 0.0
    clip_tau: float | None = None
    noise_eta: float = 0.0
    temporal_rho: float | None = None
    orthogonal: list[str] = field(default_factory=list)
    orthogonal_strength: float = 1.0
    exposure_lambda: float = 0.0
    era_method: str | None = None
    era_temperature: float = 1.0
    era_floor: float = 0.0
    era_clip: float | None = None
    era_beta: float = 0.0
    early_stopping: int | None = None
    sharpe_patience: int | None = None
    sharpe_threshold: float | None = None
    seed: int = 0
    cut_every: int = 5
    task_cells: int = 20_000_000

    def __post_init__(self):
        if self.growth not in GROWTHS:
            raise ValueError(f"growth must be one of {GROWTHS}")
        if not 1 < self.max_bins < 32_767 or self.max_depth < 1 or self.max_leaves < 2 or self.n_estimators < 1:
            raise ValueError("max_bins must lie in 2..32766, max_depth and n_estimators from 1, max_leaves from 2")
        for name in ("subsample", "colsample", "goss_top", "goss_other"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in (0, 1]")
        if any(s not in (-1, 0, 1) for s in self.monotone.values()):
            raise ValueError("monotone constraints are -1, 0 or 1")

    def rule(self, round_: int) -> Rule:
        shared = {f.name: getattr(self, f.name) for f in dataclasses.fields(Rule) if hasattr(self, f.name) and f.name != "monotone"}
        return Rule(**shared, progress=round_ / self.n_estimators, monotone=tuple((f, s) for f, s in sorted(self.monotone.items()) if s))


@dataclass
class Node:
    id: int
    depth: int
    g: float
    h: float
    c: int
    gain: float = 0.0
    split: tuple[int, int, int] | None = None  # feature, bin, direction of missing values
    left: int = -1
    right: int = -1
    value: float = 0.0
    low: float = -math.inf
    high: float = math.inf


@dataclass
class Tree:
    nodes: dict[int, Node]
    rate: float
    missing: int

    def route(self, bins: Column, give) -> Column:
        """give(node) at the leaf that a row reaches."""

        def walk(i: int) -> Column:
            node = self.nodes[i]
            if node.split is None:
                return F.lit(give(node))
            f, b, nan_dir = node.split
            x = bins[f]
            left = (x <= b) & (x != self.missing)
            return F.when(left | (x == self.missing) if nan_dir == 0 else left, walk(node.left)).otherwise(walk(node.right))

        return walk(0)

    def leaves(self) -> list[Node]:
        return [n for n in self.nodes.values() if n.split is None]

    def arrays(self) -> tuple[Nodes, np.ndarray]:
        """The tree for whole arrays of rows, and the value of each of its nodes."""
        ids = sorted(self.nodes)
        at = {i: k for k, i in enumerate(ids)}
        rows = [(*(n.split or (-1, 0, 0)), at.get(n.left, -1), at.get(n.right, -1)) for n in map(self.nodes.get, ids)]
        return Nodes(rows, self.missing), np.array([self.nodes[i].value for i in ids])


def grow(p: Params, rule: Rule, features: list[int], missing: int, histograms, penalties=None) -> Tree:
    """A tree of the levels that histograms(tree, nodes) describes; penalties(tree, nodes) gives the era penalty."""
    tree = Tree({0: Node(0, 0, 0.0, 0.0, 0)}, p.learning_rate, missing)
    known = histograms(tree, [0])
    root = tree.nodes[0]
    root.g, root.h, root.c = (float(x[0].sum()) for x in known[0])
    shared_levels = p.max_depth if p.growth == "symmetric" else p.symmetric_depth if p.growth == "hybrid" else 0
    frontier = [0]
    for depth in range(p.max_depth):
        penalty = penalties(tree, frontier) if penalties else {}
        found = {i: candidates(known[i], rule, features, penalty.get(i)) for i in frontier if tree.nodes[i].c >= 2 * max(1, p.min_child_samples)}
        if depth < shared_levels:
            # one split for the whole level: gains are summed over the nodes that allow it
            allowed = [np.isfinite(x[0]) for x in found.values()]
            total = sum((np.where(ok, x[0], 0.0) for ok, x in zip(allowed, found.values(), strict=True)), 0.0)
            one = best(np.where(np.any(allowed, 0), total, -np.inf)) if found else None
            splits = {i: one for i, x in found.items() if one and np.isfinite(x[0][one])}
        else:
            splits = {i: at for i, x in found.items() if (at := best(x[0]))}
        smaller, parents = [], {}
        for i, at in splits.items():
            node, (gain, g, h, c) = tree.nodes[i], found[i]
            node.gain, node.split = float(gain[at]), (at[0], at[2], at[1])
            left, right = len(tree.nodes), len(tree.nodes) + 1
            node.left, node.right = left, right
            tree.nodes[left] = Node(left, depth + 1, float(g[at]), float(h[at]), int(c[at]), low=node.low, high=node.high)
            tree.nodes[right] = Node(right, depth + 1, node.g - float(g[at]), node.h - float(h[at]), int(node.c - c[at]), low=node.low, high=node.high)
            _bound(tree, node, rule)
            small, big = (left, right) if tree.nodes[left].c <= tree.nodes[right].c else (right, left)
            smaller.append(small)
            parents[big] = (i, small)
        frontier = [k for i in splits for k in (tree.nodes[i].left, tree.nodes[i].right)]
        if not frontier or depth + 1 == p.max_depth:
            break
        made = histograms(tree, smaller)
        known = made | {big: tuple(x - y for x, y in zip(known[i], made[small], strict=True)) for big, (i, small) in parents.items()}
    if p.growth in ("leafwise", "hybrid"):
        _replay(tree, p.max_leaves, shared_levels)
    for node in tree.leaves():
        node.value = float(np.clip(leaf_value(node.g, node.h, rule), node.low, node.high))
    return tree


def _bound(tree: Tree, node: Node, rule: Rule) -> None:
    """Below a split on a constrained feature, values stay on their side of the middle of the two children's."""
    sign = dict(rule.monotone).get(node.split[0], 0)
    if sign:
        left, right = tree.nodes[node.left], tree.nodes[node.right]
        middle = sum(float(np.clip(leaf_value(n.g, n.h, rule), n.low, n.high)) for n in (left, right)) / 2
        lower, upper = (left, right) if sign > 0 else (right, left)
        lower.high, upper.low = min(lower.high, middle), max(upper.low, middle)


def _replay(tree: Tree, max_leaves: int, shared: int) -> None:
    """Keeps the splits that best-first growth to max_leaves takes, after the shared levels."""
    heap, taken = [], set()

    def offer(i: int) -> None:
        node = tree.nodes[i]
        if node.split is not None:
            if node.depth < shared:
                taken.add(i)
                offer(node.left), offer(node.right)
            else:
                heapq.heappush(heap, (-float(f"{node.gain:.12g}"), i))

    offer(0)
    leaves = len(taken) + 1
    while heap and leaves < max_leaves:
        _, i = heapq.heappop(heap)
        taken.add(i)
        leaves += 1
        for j in (tree.nodes[i].left, tree.nodes[i].right):
            offer(j)
    keep, stack = {}, [0]
    while stack:
        i = stack.pop()
        node = keep[i] = tree.nodes[i]
        if i in taken:
            stack += [node.left, node.right]
        else:
            node.split, node.left, node.right = None, -1, -1
    tree.nodes = dict(sorted(keep.items()))


def drop_set(p: Params, round_: int, trees: int, variances: list[float]) -> list[int]:
    """The trees that this round leaves out: each with drop_rate, or, where era variances are known, more likely the more
    its rank correlation varies between eras.  One tree at least stays."""
    rng = random.Random(p.seed * 31 + round_)
    if not trees or not (p.dart or p.era_dart) or rng.random() < p.skip_drop:
        return []
    chance = [p.drop_rate] * trees
    if p.era_dart and len(variances) >= trees:
        middle = float(np.median(variances[:trees]))
        chance = [1 / (1 + math.exp(min(-p.era_dart_scale * (v - middle), 700.0))) for v in variances[:trees]]
    dropped = [k for k in range(trees) if rng.random() < chance[k]]
    if len(dropped) == trees:
        dropped.remove(rng.randrange(trees))
    return dropped


def packed(trees: list[tuple[Tree, float]]):
    """A column function of bins: the trees' values, weighted, in Arrow batches."""
    arrays = [(*tree.arrays(), weight) for tree, weight in trees]

    import pandas as pd

    @F.pandas_udf("double")
    def total(bins):
        out = np.zeros(len(bins))
        if len(bins):
            rows = np.stack(bins.to_numpy())
            for nodes, values, weight in arrays:
                out += weight * values[nodes.reach(rows)]
        return pd.Series(out)

    return total


class Booster:
    """fit() learns from a frame of row, features, label (and era, time); transform() adds `prediction`.  The columns may
    have any names.  Rows of one era without value are an era of their own."""

    def __init__(self, params: Params, objective: Objective, features: list[str], label: str = "label", row: str = "row_id", era: str | None = None, order: str | None = None):
        self.p, self.objective, self.features = params, objective, features
        self.label, self.row, self.era, self.order = label, row, era, order or row
        self.trees: list[Tree] = []
        self.losses: list[float] = []
        self.era_history: list[DataFrame] = []
        self.tree_variances: list[float] = []
        self.held: list[DataFrame] = []
        self.encoders: dict[str, tuple[DataFrame, float]] = {}

    # -- gradients -----------------------------------------------------------------------------------------------

    def gradients(self, df: DataFrame) -> DataFrame:
        """g and h: objective, time smoothing, era weights, exposure, era clip, projection, clip and noise, in this order."""
        p, y, s = self.p, F.col("label"), F.col("pred")
        objective = self.objective.at(len(self.trees), p.n_estimators) if self.objective.at else self.objective
        if objective.frame:
            df = objective.frame(df).withColumnsRenamed({"grad": "g", "hess": "h"})
        else:
            df = df.withColumn("g", objective.grad(y, s).cast("double")).withColumn("h", objective.hess(y, s).cast("double"))
        if p.temporal_rho:
            df = E.temporal_gradient(df, "order", "pred", p.temporal_rho, ["era"] if self.era else [], self.small).withColumn("g", F.col("g") + F.col("tgrad")).drop("tgrad")
        if p.era_method and self.era:
            weights = E.era_weights(E.era_spearman(df, "era", "pred", "label", "row", self.small), p.era_method, p.era_temperature, p.era_floor)
            df = E.by_era(df, weights.select("era", "row_weight"), "era").withColumn("g", F.col("g") * F.col("row_weight")).withColumn("h", F.col("h") * F.col("row_weight")).drop("row_weight")
        if p.exposure_lambda:
            df = self._hold(df)
            df = E.exposure_gradient(df, "x", len(self.features), "pred").withColumn("g", F.col("g") + p.exposure_lambda * F.col("egrad")).drop("egrad")
        if p.era_clip and self.era:
            df = E.mad_clip(df, "era", "g", p.era_clip, self.small).withColumn("g", F.col("clipped")).drop("clipped")
        if p.orthogonal or p.noise_eta or p.goss or p.time_decay is not None:  # these read the gradients more than once
            df = self._hold(df)
        if p.orthogonal:
            named = df.select("*", *[F.coalesce(F.col("x")[self.features.index(f)], F.lit(0.0)).alias(f"_o{k}") for k, f in enumerate(p.orthogonal)])
            cols = [f"_o{k}" for k in range(len(p.orthogonal))]
            df = E.neutralize(named, "g", cols, p.orthogonal_strength, 1e-4).withColumn("g", F.col("neutral")).drop("neutral", *cols)
        if p.clip_tau or p.noise_eta:
            std = df.agg(F.stddev_pop("g")).first()[0] or 0.0 if p.noise_eta else 0.0
            g = clip(F.col("g"), -p.clip_tau, p.clip_tau) if p.clip_tau else F.col("g")
            seed = p.seed * 1000003 + 2 * len(self.trees)
            u = [(mixed(df, "row", seed + k) + 0.5) / float(1 << 32) for k in (0, 1)]
            df = df.withColumn("g", g + (F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * math.pi * u[1]) * p.noise_eta * std if p.noise_eta else 0.0))
        return df

    def _hold(self, df: DataFrame) -> DataFrame:
        """df kept until the round's end; lost parts are made again."""
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.held[-1]

    def sample(self, df: DataFrame) -> DataFrame:
        p, seed = self.p, self.p.seed * 1000003 + len(self.trees)
        if p.time_decay is not None and self.era:
            df = E.weighted_goss(df, "g", "row", "order", p.time_decay, p.goss_top, p.goss_other, seed)
        elif p.goss:
            df = E.goss(df, "g", "row", p.goss_top, p.goss_other, seed)
        elif p.subsample < 1:
            return df.where(mixed(df, "row", seed) < int(p.subsample * (1 << 32)))
        else:
            return df
        return df.withColumn("g", F.col("g") * F.col("weight")).withColumn("h", F.col("h") * F.col("weight")).drop("weight")

    # -- trees ---------------------------------------------------------------------------------------------------

    def grow(self, df: DataFrame) -> Tree:
        """A tree for rows with bins, g and h."""
        p, rule = self.p, self.p.rule(len(self.trees))
        width = len(self.bundles)
        features = list(range(width))
        if p.colsample < 1:
            features = sorted(random.Random(p.seed * 7919 + len(self.trees)).sample(features, max(1, int(width * p.colsample))))
        eras = p.era_beta and self.era
        if self.rows * width <= p.task_cells and not eras:
            tree = self._in_one_task(df.select("bins", "g", "h"), rule, features, width)
        else:
            kept = df.persist(StorageLevel.MEMORY_AND_DISK)  # read by every level
            count = lambda tree, wanted: T.node_histograms(kept, tree.arrays()[0], wanted, width)
            tree = grow(p, rule, features, self.missing, count, (lambda tree, wanted: self._penalties(kept, tree, wanted, width)) if eras else None)
            kept.unpersist()
        if self.objective.leaf is not None:
            self._leaves_by_residual(df, tree)
        return tree

    def _in_one_task(self, df: DataFrame, rule: Rule, features: list[int], width: int) -> Tree:
        p, missing = self.p, self.missing

        def run(batches):
            import pyarrow as pa

            parts = [T.arrays(batch, width) for batch in batches if batch.num_rows]
            bins, g, h = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros((0, width), np.int16), np.zeros(0), np.zeros(0))

            def histograms(tree, wanted):
                nodes = tree.arrays()[0]
                sums = Sums(wanted, width, missing + 1, len(nodes.feature))
                sums.add(nodes.reach(bins), bins, g, h)
                return sums.by_node()

            tree = grow(p, rule, features, missing, histograms)
            yield pa.RecordBatch.from_pydict({"tree": [json.dumps([dataclasses.asdict(n) for n in tree.nodes.values()])]})

        rows = json.loads(df.coalesce(1).mapInArrow(run, "tree string").first()["tree"])
        nodes = {r["id"]: Node(**r | {"split": tuple(r["split"]) if r["split"] else None}) for r in rows}
        return Tree(nodes, p.learning_rate, missing)

    def _penalties(self, df: DataFrame, tree: Tree, wanted: list[int], width: int) -> dict[int, np.ndarray]:
        at = df.withColumn("node", tree.route(F.col("bins"), lambda n: n.id)).where(F.col("node").isin(wanted))
        found = T.era_penalty(T.histogram(at, "bins", ["node", "era"]), self.p.reg_lambda, self.missing, ["node"]).toArrow()
        out = {i: np.full((width, 2, self.missing), np.inf) for i in wanted}  # a bin without rows is no threshold
        for node, f, b, d, v in zip(*(found[c].to_pylist() for c in ("node", "feature", "bin", "nan_dir", "penalty")), strict=True):
            out[node][f, d, b] = v
        return out

    def _leaves_by_residual(self, df: DataFrame, tree: Tree) -> None:
        leaf = df.select(tree.route(F.col("bins"), lambda n: n.id).alias("leaf"), (F.col("label") - F.col("pred")).alias("r"))
        for r in leaf.groupBy("leaf").agg(self.objective.leaf(F.col("r")).alias("v")).collect():
            node = tree.nodes[r["leaf"]]
            node.value = min(max(float(r["v"]), node.low), node.high)

    def _value(self, tree: Tree) -> Column:
        return tree.route(F.col("bins"), lambda n: float(n.value))

    # -- fitting -------------------------------------------------------------------------------------------------

    def _encoded(self, df: DataFrame) -> DataFrame:
        for f, (table, mean) in self.encoders.items():
            df = T.target_lookup(df, table, f, mean, "_code").withColumn(f, F.col("_code")).drop("_code")
        return df

    def _state(self, df: DataFrame) -> DataFrame:
        named = df.select(
            F.col(self.row).alias("_row"), F.col(self.label).cast("double").alias("_label"), (F.col(self.era) if self.era else F.lit(0)).alias("_era"), F.col(self.order).alias("_order"),
            *[F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f"_f{k}") for k, f in enumerate(self.features)], *[F.col(c).alias(f"_with_{k}") for k, c in enumerate(self.objective.columns)],
        )
        x = [F.col(f"_f{k}") for k in range(len(self.features))]
        bins = T.bin_column(x, [self.edges[f] for f in self.features], self.missing, self.bundles)
        return named.select(F.col("_row").alias("row"), F.array(*x).alias("x"), bins.alias("bins"), F.col("_label").alias("label"), F.col("_era").alias("era"), F.col("_order").alias("order"), F.lit(self.base).alias("pred"), *[F.col(f"_with_{k}").alias(f"with_{c}") for k, c in enumerate(self.objective.columns)])

    def fit(self, df: DataFrame, valid: DataFrame | None = None) -> "Booster":
        p = self.p
        for f in p.categorical:
            self.encoders[f] = (written(T.target_table(df, f, self.label, p.cat_smoothing)), df.agg(F.avg(self.label)).first()[0] or 0.0)
        train = df
        for f in p.categorical:
            train = T.ordered_target(train, f, self.label, self.row, p.cat_smoothing, p.seed, "_code").withColumn(f, F.col("_code")).drop("_code")
        self.edges = p.edges or T.bin_edges(train, self.features, p.max_bins, p.exact_edges)
        self.missing = p.max_bins
        names = bundling.find_bundles(train, self.edges, p.bundle_threshold, p.max_bins) if p.bundle else [[f] for f in self.features]
        self.bundles = [[self.features.index(f) for f in b] for b in names]
        self.base = float(train.agg(self.objective.init(F.col(self.label).cast("double"))).first()[0] or 0.0)
        state = written(self._state(train))
        self.rows = state.count()
        self.small = E.small_groups(state, ["era"]) if self.era else False
        held = written(self._state(self._encoded(valid))) if valid is not None else None
        tables, pending = [state, held], []  # as written last, and the trees since
        best_, self.best_round, waited = None, -1, 0
        for t in range(p.n_estimators):
            dropped = drop_set(p, t, len(self.trees), self.tree_variances)
            view = state
            if dropped:
                view = state.withColumn("pred", F.col("pred") - packed([(self.trees[k], self.trees[k].rate) for k in dropped])("bins"))
            tree = self.grow(self.sample(self.gradients(view)))
            while self.held:
                self.held.pop().unpersist()
            if self.era and (p.sharpe_threshold is not None or p.era_dart):
                one = E.era_sharpe(E.era_spearman(view.withColumn("pred", self._value(tree)), "era", "pred", "label", "row", self.small)).first()
                self.tree_variances.append((one["std_corr"] or 0.0) ** 2)
                if p.sharpe_threshold is not None and (one["sharpe"] or 0.0) < p.sharpe_threshold:
                    tree.rate *= max(one["sharpe"] or 0.0, 0.0) / p.sharpe_threshold if p.sharpe_threshold > 0 else 1.0
            k = len(dropped)  # the dropped trees and the new one share their weight
            tree.rate /= 1 + k
            pending += [(tree, tree.rate), *((self.trees[i], -self.trees[i].rate / (1 + k)) for i in dropped)]
            for i in dropped:
                self.trees[i].rate *= k / (1 + k)
            self.trees.append(tree)
            state, held = (x and x.withColumn("pred", F.col("pred") + packed(pending)("bins")) for x in tables)
            if (t + 1) % p.cut_every == 0:
                spent, tables, pending = tables, [x and written(x) for x in (state, held)], []
                forget(*filter(None, spent))
                state, held = tables
            if held is not None and (p.early_stopping or p.sharpe_patience):
                now = self._held_loss(held)
                self.losses.append(now)
                if best_ is None or now < best_:
                    best_, self.best_round, waited = now, t, 0
                else:
                    waited += 1
                    if waited >= (p.sharpe_patience or p.early_stopping):
                        break
        if self.best_round < 0 or p.dart or p.era_dart:
            self.best_round = len(self.trees) - 1
        self.train_state = state
        return self

    def _held_loss(self, held: DataFrame) -> float:
        if self.p.sharpe_patience and self.era:
            rhos = E.era_spearman(held, "era", "pred", "label", "row")
            return -(E.era_sharpe(rhos).first()["sharpe"] or 0.0)
        return held.agg(F.avg(self.objective.loss(F.col("label"), F.col("pred")))).first()[0]

    # -- the model -----------------------------------------------------------------------------------------------

    def nodes(self) -> list[tuple]:
        """The model as rows (tree, rate, node, feature, bin, threshold, nan_dir, left, right, value, gain); feature is the
        number of a bundle, and of one with a single feature a row goes left below the threshold."""
        out = []
        for k, tree in enumerate(self.trees[: self.best_round + 1]):
            for n in tree.nodes.values():
                f, b, d = n.split or (-1, 0, 0)
                edges = self.edges[self.features[self.bundles[f][0]]] if n.split and len(self.bundles[f]) == 1 else []
                out.append((k, tree.rate, n.id, f, b, float(edges[b]) if b < len(edges) else float("inf"), d, n.left, n.right, float(n.value), float(n.gain)))
        return out

    NODES = "tree int, rate double, node int, feature int, bin int, threshold double, nan_dir int, `left` int, `right` int, value double, gain double"

    def save(self, path: str, spark: SparkSession) -> None:
        """The model as tables: nodes, and one row of what scoring needs besides."""
        spark.createDataFrame(self.nodes(), self.NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        about = {"features": self.features, "label": self.label, "row": self.row, "era": self.era, "order": self.order, "edges": self.edges, "bundles": self.bundles, "missing": self.missing, "base": self.base, "objective": self.objective.name, "params": dataclasses.asdict(self.p), "encoders": {f: m for f, (_, m) in self.encoders.items()}}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        for f, (table, _) in self.encoders.items():
            table.write.mode("overwrite").parquet(f"{path}/encoder_{self.features.index(f)}")

    @staticmethod
    def load(path: str, spark: SparkSession, objective: Objective) -> "Booster":
        """A saved model; its objective is given again, as it may hold any function."""
        about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
        if about["objective"] != objective.name:
            raise ValueError(f"the model was fitted with {about['objective']}")
        params = about["params"] | {"monotone": {int(k): v for k, v in about["params"]["monotone"].items()}}
        out = Booster(Params(**params), objective, about["features"], about["label"], about["row"], about["era"], about["order"])
        out.edges, out.bundles, out.missing, out.base = about["edges"], about["bundles"], about["missing"], about["base"]
        out.encoders = {f: (spark.read.parquet(f"{path}/encoder_{out.features.index(f)}"), m) for f, m in about["encoders"].items()}
        trees: dict[int, Tree] = {}
        for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            tree = trees.setdefault(r["tree"], Tree({}, r["rate"], out.missing))
            split = (r["feature"], r["bin"], r["nan_dir"]) if r["feature"] >= 0 else None
            tree.nodes[r["node"]] = Node(r["node"], 0, 0.0, 0.0, 0, r["gain"], split, r["left"], r["right"], r["value"])
        out.trees = [trees[k] for k in sorted(trees)]
        out.best_round = len(out.trees) - 1
        return out

    def raw_score(self, df: DataFrame, out: str = "raw") -> DataFrame:
        """df with the base and the trees' values, in Arrow batches; no shuffle (but for category tables), works on streams too."""
        import pandas as pd

        cuts = [np.array(self.edges[f], float) for f in self.features]
        trees = [(*t.arrays(), t.rate) for t in self.trees[: self.best_round + 1]]
        base, missing, bundles = self.base, self.missing, self.bundles

        @F.pandas_udf("double")
        def score(*cols):
            bins = T.to_bins([np.asarray(c, float) for c in cols], cuts, missing, bundles)
            total = np.full(len(bins), base)
            for nodes, values, rate in trees:
                total += rate * values[nodes.reach(bins)]
            return pd.Series(total)

        raw = df
        codes = []
        for k, (f, (table, mean)) in enumerate(self.encoders.items()):
            codes.append(f"_code{k}")
            raw = T.target_lookup(raw, table, f, mean, codes[-1])
        named = dict(zip(self.encoders, codes, strict=True))
        return raw.withColumn(out, score(*[F.col(named.get(f, f)).cast("double") for f in self.features])).drop(*codes)

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.raw_score(df, "_raw").withColumn(out, self.objective.link(F.col("_raw"))).drop("_raw")

    def neutralize(self, df: DataFrame, features: list[str], proportion: float = 1.0, era: str | None = None) -> DataFrame:
        """Predictions less their projection on the features, over all rows or era by era: (row, neutral)."""
        scored = self.transform(df)
        if era:
            return E.neutralize_by_era(scored, era, self.row, "prediction", features, proportion)
        return E.neutralize(scored, "prediction", features, proportion).select(self.row, "neutral")

    def feature_exposure(self, df: DataFrame, features: list[str], by: list[str] = ()) -> DataFrame:
        return E.exposure(self.transform(df), "prediction", features, by)

    def importances(self, kind: str = "gain") -> dict[str, float]:
        """Share of each feature (of a bundle: its first) in all trees' gains or splits."""
        sums = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for n in tree.nodes.values():
                if n.split:
                    sums[self.features[self.bundles[n.split[0]][0]]] += n.gain if kind == "gain" else 1.0
        total = sum(sums.values()) or 1.0
        return {f: v / total for f, v in sums.items()}
