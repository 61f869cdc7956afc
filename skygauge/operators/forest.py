"""Random forest on histograms, for squared error.

Features are binned as for boosting. Every tree sees each row as often as a hash of the row's values says (Poisson, so
that the choice does not depend on how rows are dealt out; equal rows are drawn together), and looks at all features at
each node. A cut's gain is what it adds to the sum of ``G^2 / W``; both sides need ``minInstancesPerNode`` draws.

* Trees do not depend on each other, so they are grown side by side. A table of up to TASK_ROWS rows is sent to all
  tasks, each of which grows whole trees.
* Of a larger table no task sees all rows: nodes with more than TASK_ROWS draws are cut by jobs that sum targets and
  draws of every (tree, node, feature, bin), and the rows of each node below go to the task that grows what is under it.
  A job takes so many trees that SHIPPED_ROWS rows move at once.
* Inside a task the rows of each feature stay in the order of (node, bin). All cuts of all nodes of a level are compared
  by running sums over that order, so that a level costs what its rows cost, however many nodes it has.
* Targets are whole multiples of a power of two, so sums and trees are the same by all of these ways.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, Broadcast
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.operators.boosting import MOST_BINS, _blocks, _hashed, _loaded, _met, _unpacked, bin_cuts
from skygauge.operators.trees import TreeScorer, tree_groups
from skygauge.session import ship_package, stage

TASK_ROWS = 2**20
SHIPPED_ROWS = 20_000_000
# Bits of a target: the sums of a block, drawn several times, are exact in doubles.
TARGET_BITS = 34
# Of G^2 / W, which is exact to about 1e-16.
LEAST_GAIN = 1e-12


@dataclass
class Nodes:
    """A tree, or what is under one of its nodes: the children of node i are ``left[i]`` (``bin <= cut``) and ``left[i] + 1``.

    ``feature`` is -1 in leaves; ``total`` and ``draws`` are sums of targets and of rows as often as drawn.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    total: np.ndarray
    draws: np.ndarray

    @classmethod
    def root(cls, total: int, draws: int) -> Nodes:
        return cls(np.array([-1], np.int16), np.array([0], np.int16), np.array([0], np.int32), np.array([total], np.int64), np.array([draws], np.int64))

    def cut_at(self, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, total: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Cuts leaves; ``total`` and ``draws`` are those of the left children. The left children."""
        left = len(self.feature) + 2 * np.arange(len(at))
        self.feature[at], self.cut[at], self.left[at] = feature, cut, left
        pairs = lambda whole, part: np.column_stack([part, whole[at] - part]).ravel()
        self._add(np.full(2 * len(at), -1), np.zeros(2 * len(at)), np.zeros(2 * len(at)), pairs(self.total, total), pairs(self.draws, draws))
        return left

    def graft(self, at: int, under: Nodes) -> None:
        """Puts a tree in the place of a leaf; its root is the leaf."""
        moved = np.where(under.feature >= 0, under.left + len(self.feature) - 1, 0)
        self.feature[at], self.cut[at], self.left[at] = under.feature[0], under.cut[0], moved[0]
        self._add(under.feature[1:], under.cut[1:], moved[1:], under.total[1:], under.draws[1:])

    def _add(self, *columns: np.ndarray) -> None:
        for name, more in zip(("feature", "cut", "left", "total", "draws"), columns, strict=True):
            have = getattr(self, name)
            setattr(self, name, np.append(have, more.astype(have.dtype)))

    def place(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row; ``bins`` is (features, rows)."""
        node, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        while True:
            by = self.feature[node]
            if (by < 0).all():
                return node
            node = np.where(by >= 0, self.left[node] + (bins[by, rows] > self.cut[node]), node)


@dataclass(frozen=True)
class _Growth:
    """What a task needs to know to grow trees."""

    trees: int
    depth: int
    least: int
    rate: float
    seed: int
    base: float
    scale: float
    widths: np.ndarray

    def draws(self, key: np.ndarray, tree: int) -> np.ndarray:
        """How often a tree sees each row: Poisson, by a hash of the row's key."""
        shares = np.cumsum(np.exp(-self.rate) * np.cumprod(np.append(1.0, self.rate / np.arange(1, 30))))
        return np.searchsorted(shares, _hashed(key, self.seed, tree) / 2.0**53, side="right")

    def targets(self, y: np.ndarray) -> np.ndarray:
        return np.rint((y - self.base) * self.scale).astype(np.int64)

    def gain(self, gl: np.ndarray, wl: np.ndarray, g: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What cuts add to the sum of G^2 / W; -inf where a side has too few draws or the cut adds nothing."""
        wr, whole = w - wl, g.astype(float) ** 2 / np.maximum(w, 1)
        added = gl.astype(float) ** 2 / np.maximum(wl, 1) + (g - gl).astype(float) ** 2 / np.maximum(wr, 1) - whole
        return np.where((wl >= self.least) & (wr >= self.least) & (added > LEAST_GAIN * whole), added, -np.inf)

    # -- inside a task ------------------------------------------------------------------

    def whole_tree(self, bins: np.ndarray, target: np.ndarray, key: np.ndarray, tree: int) -> Nodes:
        draws = self.draws(key, tree)
        seen = np.flatnonzero(draws)
        return self.under(bins.take(seen, axis=1), target[seen], draws[seen], self.depth)

    def under(self, bins: np.ndarray, target: np.ndarray, draws: np.ndarray, depth: int) -> Nodes:
        """A tree over these rows, level by level; ``bins`` is (features, rows)."""
        target = target * draws
        nodes = Nodes.root(target.sum(), draws.sum())
        orders = {f: np.argsort(b, kind="stable").astype(np.int32) for f, b in enumerate(bins) if len(b) and b.min() < b.max()}
        if not orders:
            return nodes
        level, counts = np.zeros(1, np.int64), np.array([len(target)])
        for left_over in range(depth, 0, -1):
            best, feature, cut, gl, wl = self._best_cuts(bins, target, draws, orders, counts, nodes.total[level], nodes.draws[level])
            use = np.flatnonzero(best > -np.inf)
            if not len(use):
                break
            left = nodes.cut_at(level[use], feature[use], cut[use], gl[use], wl[use])
            if left_over == 1:
                break
            # Children that may be cut, in order, and the rows in them.
            children = np.column_stack([left, left + 1]).ravel()
            going = nodes.draws[children] >= 2 * self.least
            kind = np.uint16 if len(children) < 2**16 - 1 else np.uint32
            none = np.iinfo(kind).max
            rank = np.where(going, np.cumsum(going) - 1, none).astype(kind)
            of, row = np.repeat(np.arange(len(level)), counts), next(iter(orders.values()))
            place = np.full(len(level), -1)
            place[use] = np.arange(len(use))
            at = place[of]
            side = bins[feature[of], row] > cut[of]
            new = np.full(len(target), none, kind)
            new[row] = np.where(at >= 0, rank[2 * at + side], none)
            level, alive = children[going], new[row]
            counts = np.bincount(alive[alive != none], minlength=len(level))
            if not len(level):
                break
            orders = {f: _regrouped(order, new, none) for f, order in orders.items()}
        return nodes

    def _best_cuts(self, bins, target, draws, orders, counts, g, w) -> tuple[np.ndarray, ...]:
        """The best cut of each node of a level: gain, feature, cut, targets and draws left of it."""
        n = len(counts)
        best, feature, cut = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        left = np.zeros((2, n), np.int64)
        of = np.repeat(np.arange(n, dtype=np.int32), counts)
        inside = of[1:] == of[:-1]
        before_g, before_w = np.cumsum(g) - g, np.cumsum(w) - w
        for f, order in orders.items():
            bin_ = bins[f].take(order)
            at = np.flatnonzero((bin_[1:] != bin_[:-1]) & inside)
            if not len(at):
                continue
            node = of[at]
            gl = np.cumsum(target.take(order))[at] - before_g[node]
            wl = np.cumsum(draws.take(order))[at] - before_w[node]
            gain = self.gain(gl, wl, g[node], w[node])
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            top = np.maximum.reduceat(gain, first)
            hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(first, len(node)))))
            hit = hit[np.append(True, node[hit][1:] != node[hit][:-1])]
            better = top > best[node[first]]
            hit = hit[better]
            to = node[hit]
            best[to], feature[to], cut[to], left[0, to], left[1, to] = gain[hit], f, bin_[at[hit]], gl[hit], wl[hit]
        return best, feature, cut, *left

    # -- nodes of more rows than a task takes ---------------------------------------------

    def tops(self, blocks: RDD, trees: list[int]) -> tuple[dict[int, Nodes], list[tuple[int, int, int]]]:
        """Trees down to nodes of at most TASK_ROWS draws, and these nodes as (tree, node, depth left)."""
        found = {t: Nodes.root(0, 0) for t in trees}
        open_ = {t: np.zeros(1, np.int64) for t in trees}
        under: list[tuple[int, int, int]] = []
        for left_over in range(self.depth, -1, -1):
            first = left_over == self.depth
            for t in [] if first else trees:
                large = found[t].draws[open_[t]] > TASK_ROWS
                under += [(t, int(i), left_over) for i in open_[t][~large] if left_over and found[t].draws[i] >= 2 * self.least]
                open_[t] = open_[t][large]
            asked = {t: at for t, at in open_.items() if len(at)}
            if not asked or not left_over:
                break
            sums = dict(zip(asked, np.split(self._summed(blocks, found, asked), np.cumsum([len(a) for a in asked.values()])[:-1], axis=1), strict=True))
            for t, (g, w) in sums.items():
                if first:
                    of_one = slice(0, self.widths[0])
                    found[t] = Nodes.root(g[0, of_one].sum(), w[0, of_one].sum())
                    if w[0, of_one].sum() <= TASK_ROWS:
                        continue
                open_[t] = self._cut(found[t], open_[t], g, w)
            if first:
                small = [t for t in trees if found[t].draws[0] <= TASK_ROWS]
                under += [(t, 0, self.depth) for t in small if found[t].draws[0] >= 2 * self.least]
                open_.update({t: np.zeros(0, np.int64) for t in small})
        return found, under

    def _cut(self, nodes: Nodes, at: np.ndarray, g: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Cuts nodes by their sums (nodes x bins of all features); their children."""
        best = np.full(len(at), -np.inf)
        feature, cut, left = np.zeros(len(at), int), np.zeros(len(at), int), np.zeros((2, len(at)), np.int64)
        ends, rows = np.cumsum(self.widths), np.arange(len(at))
        for f, (a, b) in enumerate(zip(ends - self.widths, ends, strict=True)):
            gl, wl = g[:, a:b].cumsum(axis=1), w[:, a:b].cumsum(axis=1)
            gain = self.gain(gl, wl, gl[:, -1:], wl[:, -1:])
            k = gain.argmax(axis=1)
            to = np.flatnonzero(gain[rows, k] > best)
            best[to], feature[to], cut[to], left[0, to], left[1, to] = gain[to, k[to]], f, k[to], gl[to, k[to]], wl[to, k[to]]
        use = np.flatnonzero(best > -np.inf)
        first = nodes.cut_at(at[use], feature[use], cut[use], left[0, use], left[1, use])
        return np.column_stack([first, first + 1]).ravel()

    def _summed(self, blocks: RDD, found: dict[int, Nodes], asked: dict[int, np.ndarray]) -> np.ndarray:
        """Targets and draws by (tree and node, bin of all features)."""
        ends = np.cumsum(self.widths)

        def run(part: Iterator) -> Iterator[np.ndarray]:
            total = np.zeros((2, sum(map(len, asked.values())), int(ends[-1])), np.int64)
            for bins, y, _, key in part:
                target, first = self.targets(y), 0
                for t, at in asked.items():
                    draws = self.draws(key, t)
                    slot = np.full(len(found[t].feature), -1)
                    slot[at] = np.arange(len(at))
                    of = np.where(draws > 0, slot[found[t].place(bins)], -1)
                    here = np.flatnonzero(of >= 0)
                    own, w = total[:, first : first + len(at)], draws[here].astype(float)
                    of, g, cells = of[here] * MOST_BINS, target[here] * w, len(at) * MOST_BINS
                    for row, a, b in zip(bins, ends - self.widths, ends, strict=True):
                        cell = of + row.take(here)
                        for k, x in enumerate((g, w)):
                            own[k, :, a:b] += np.bincount(cell, x, cells).astype(np.int64).reshape(-1, MOST_BINS)[:, : b - a]
                    first += len(at)
            yield total

        return sum(_met(blocks.mapPartitions(run)).collect())

    def grown_under(self, blocks: RDD, found: dict[int, Nodes], under: list[tuple[int, int, int]]) -> list[tuple[int, Nodes]]:
        """(number in ``under``, tree below this node): the rows of each node meet in one task."""
        numbers = {(t, i): k for k, (t, i, _) in enumerate(under)}

        def dealt(part: Iterator) -> Iterator[tuple]:
            for bins, y, _, key in part:
                target = self.targets(y)
                for t in sorted({t for t, _, _ in under}):
                    draws = self.draws(key, t)
                    seen = np.flatnonzero(draws)
                    leaf = found[t].place(bins.take(seen, axis=1))
                    for i in np.unique(leaf).tolist():
                        if (t, i) in numbers:
                            rows = seen[leaf == i]
                            yield numbers[t, i], (bins.take(rows, axis=1), target[rows], draws[rows].astype(np.uint8))

        def grown(part: Iterator[tuple]) -> Iterator[tuple[int, Nodes]]:
            parts: dict[int, list] = {}
            for k, rows in part:
                parts.setdefault(k, []).append(rows)
            for k in sorted(parts):
                bins, target, draws = (np.concatenate(x, axis=-1) for x in zip(*parts.pop(k), strict=True))
                yield k, self.under(bins, target, draws.astype(np.int64), under[k][2])

        return blocks.mapPartitions(dealt).partitionBy(len(under), lambda k: k).mapPartitions(grown).collect()


def _regrouped(order: np.ndarray, new: np.ndarray, none: int) -> np.ndarray:
    """Rows in the order of their new nodes, and as before inside each; those without a node are left out."""
    to = new.take(order)
    going = np.flatnonzero(to != none)
    order, to = order.take(going), to.take(going)
    return order.take(np.argsort(to, kind="stable"))


# -- model ------------------------------------------------------------------------------


@dataclass
class ForestTrees:
    """A fitted forest: a prediction is the mean of the leaves a row reaches."""

    features: list[str]
    base: float
    scale: float
    rows: int
    thresholds: list[np.ndarray]
    trees: list[Nodes] = field(repr=False)

    def scorer(self, first: int, last: int) -> TreeScorer:
        """Trees ``first`` to ``last`` as one set of arrays."""
        trees = self.trees[first : last + 1]
        sizes = np.array([len(t.feature) for t in trees])
        roots = np.cumsum(sizes) - sizes
        stack = lambda name: np.concatenate([getattr(t, name) for t in trees])
        feature, here = stack("feature"), np.arange(sizes.sum())
        leaf = feature < 0
        left = np.where(leaf, here, stack("left") + np.repeat(roots, sizes)).astype(np.int32)
        starts = np.cumsum([0, *map(len, self.thresholds)])
        threshold = np.full(len(feature), np.inf)
        threshold[~leaf] = np.concatenate([*self.thresholds, []])[starts[feature[~leaf]] + stack("cut")[~leaf]]
        draws = stack("draws")
        depth, level = 0, np.zeros(0) if leaf.all() else roots[~leaf[roots]]
        while len(level):
            level = np.concatenate([left[level], left[level] + 1])
            level, depth = level[~leaf[level]], depth + 1
        return TreeScorer(
            feature=np.where(leaf, 0, feature).astype(np.int32), threshold=threshold, left=left, right=np.where(leaf, here, left + 1).astype(np.int32),
            value=self.base + stack("total") / self.scale / np.maximum(draws, 1), cover=draws.astype(float), roots=roots.astype(np.int32),
            weights=np.full(len(trees), 1 / len(self.trees)), depth=depth,
        )

    def groups(self, most: int) -> Iterator[TreeScorer]:
        """Trees as arrays, in groups of about ``most`` nodes."""
        for first, last in tree_groups({k: len(t.feature) for k, t in enumerate(self.trees)}, most):
            yield self.scorer(first, last)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the column ``prediction``; a missing feature goes right at each cut."""
        spark = df.sparkSession
        ship_package(spark)
        sent: list[Broadcast] = [spark.sparkContext.broadcast(g) for g in self.groups(1_000_000)]

        def predict(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            total = np.zeros(len(x))
            for group in sent:
                total += group.value.predict(x)
            return pd.Series(total)

        once = F.pandas_udf(predict, "double").asNondeterministic()
        return df.withColumn("prediction", once(*[F.col(f).cast("double") for f in self.features]))

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes as Parquet and one line of JSON, over what was there."""
        about = {"forest": True, "features": self.features, "base": self.base, "scale": self.scale, "rows": self.rows, "thresholds": [t.tolist() for t in self.thresholds]}
        parts = [pd.DataFrame({"tree": k, "id": np.arange(len(t.feature)), **vars(t)}) for k, t in enumerate(self.trees)]
        spark.createDataFrame(pd.concat(parts)).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestTrees:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "id"])
        names = ("feature", "cut", "left", "total", "draws")
        trees = [Nodes(*[part[n].to_numpy() for n in names]) for _, part in nodes.groupby("tree")]
        return cls(about["features"], about["base"], about["scale"], about["rows"], [np.array(t) for t in about["thresholds"]], trees)


class HistogramForest(RandomForestRegressor):
    """Fits ``ForestTrees`` by the settings of Spark's forest; rows with a missing feature or target are left out."""

    def fit_trees(self, train: DataFrame, features: list[str]) -> ForestTrees:
        if self.getFeatureSubsetStrategy() != "all" or self.getMinInfoGain() or self.getMinWeightFractionPerNode():
            raise ValueError("all features at each node, and no least gain or share of rows")
        spark, target = train.sparkSession, self.getLabelCol()
        ship_package(spark)
        known = train.select(target, *[f for f in features if f != target]).na.drop("any")
        y = F.col(target)
        about = known.agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.min(y).alias("lo"), F.max(y).alias("hi")).first()
        n = about["n"]
        if not n:
            raise ValueError("no rows to fit")
        base = float(f"{about['mean']:.10g}")
        cuts = bin_cuts(known, features, min(self.getMaxBins(), MOST_BINS))
        # From the base as it is rounded, as a constant target may lie beside it.
        spread = max(float(about["hi"]) - base, base - float(about["lo"]), 1e-200)
        scale = float(2.0 ** (min(TARGET_BITS, 59 - int(np.ceil(np.log2(n)))) - 1 - np.ceil(np.log2(spread))))
        growth = _Growth(
            self.getNumTrees(), self.getMaxDepth(), max(self.getMinInstancesPerNode(), 1), self.getSubsamplingRate(),
            self.getSeed(), base, scale, np.array([len(c) + 1 for c in cuts]),
        )
        saved = stage(_blocks(known, features, target, cuts, base), "blocks")
        grow = _sent_to_all if n <= TASK_ROWS else _dealt_out
        return ForestTrees(list(features), base, scale, n, cuts, grow(saved, n, growth))


def _sent_to_all(saved: DataFrame, n: int, growth: _Growth) -> list[Nodes]:
    """Whole trees, each in one task."""
    context = saved.sparkSession.sparkContext
    blocks = [_unpacked(*r) for r in saved.collect()]
    bins, y, key = (np.concatenate([b[k] for b in blocks], axis=-1) for k in (0, 1, 3))
    sent = context.broadcast((bins, growth.targets(y), key))
    trees = context.parallelize(range(growth.trees), min(growth.trees, 4 * context.defaultParallelism))
    grown = trees.map(lambda t: growth.whole_tree(*sent.value, t)).collect()
    sent.destroy()
    return grown


def _dealt_out(saved: DataFrame, n: int, growth: _Growth) -> list[Nodes]:
    """Large nodes by jobs over all rows, what is under them in one task each."""
    blocks = _loaded(saved, n)
    at_once = max(1, int(SHIPPED_ROWS / n))
    grown: list[Nodes] = []
    for first in range(0, growth.trees, at_once):
        trees = list(range(first, min(first + at_once, growth.trees)))
        found, under = growth.tops(blocks, trees)
        for k, nodes in sorted(growth.grown_under(blocks, found, under) if under else [], key=lambda x: x[0]):
            found[under[k][0]].graft(under[k][1], nodes)
        grown += [found[t] for t in trees]
    blocks.unpersist()
    return grown
