"""Gradient boosting on histograms, for squared error.

Features are binned once. Rows are kept in blocks of BLOCK_ROWS (bins of one byte, target, prediction so far). For
each level of a tree, one job sums the gradients and counts the rows of every (node, feature, bin): each
task does so for its blocks, and its sums go to the driver, which adds them up. Of two children only the one with fewer
rows is summed; the other has what is left of their parent. With more than MEET tasks, sums meet in MEET places first. So
the driver sees at most ``MEET x 2^(depth - 1) x features x bins`` numbers, whatever the number of rows.

A model has hundreds of trees with several levels, and each level needs the one before: about two thousand short
jobs in a row. So these are jobs on an RDD of blocks, as planning a query would take longer than to run it; all else is
DataFrame work. Every Python stage of a job waits about a tenth of a second, whatever it does, so a level has but one.
Up to TASK_BLOCKS blocks are one partition, whose task goes on from level to level by itself: no sums
have to meet, and the trees are the same.

* A leaf's value is ``-G / (H + penalty)`` times the rate; a cut's gain is half of what it adds to the sum of
  ``G^2 / (H + penalty)``. Both sides of a cut need ``least_weight``, a gain ``least_gain``.
* Rows and columns are drawn anew for each tree: a row by a hash of its values, so that the choice does not depend
  on how rows are dealt out (equal rows are drawn together), columns by a seeded generator.
* Gradients are whole multiples of a power of two, so that sums do not depend on the order of addition:
  a table gives the same trees with any number of partitions, and again after a lost executor.
* A feature with at most ``bins`` values is cut at its values, any other at approximate quantiles.
* The rows a tree sees are picked once and kept until it is grown. Every MOVE_ROUNDS trees the predictions move on, so
  that a task applies few trees only; every SAVE_ROUNDS trees they are staged, and lineage ends there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.operators.trees import TreeScorer
from skygauge.session import ship_package, stage

BLOCK_ROWS = 16_384
# A task that goes on by itself takes longer than all jobs of a tree together from about a million rows on.
TASK_BLOCKS = 12
MEET = 32
# Tasks of more rows than this are made more.
TASK_ROWS = 4_000_000
MOVE_ROUNDS = 5
SAVE_ROUNDS = 100
ROUNDS_A_JOB = 100
# Bins of a feature are one byte.
MOST_BINS = 256
# Bits of a gradient: a block's sums are exact in doubles, all sums in longs.
GRADIENT_BITS = 38
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    rate: float = 0.05
    depth: int = 6
    row_share: float = 0.8
    column_share: float = 0.8
    penalty: float = 1.0
    least_weight: float = 1.0
    least_gain: float = 0.0
    bins: int = MOST_BINS
    seed: int = 42


@dataclass
class Tree:
    """A tree in heap order: the children of node i are 2i + 1 (``bin <= cut``) and 2i + 2.

    ``feature`` is -1 where a node is not cut; ``cut`` counts bins, ``threshold`` is its value.
    """

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n), np.zeros(n), np.zeros(n))

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row after ``levels`` cuts; ``bins`` is (features, rows)."""
        node = np.zeros(bins.shape[1], np.int64)
        for level in range(levels):
            node = self.step(bins, node, level, np.arange(len(bins)))
        return node

    def step(self, bins: np.ndarray, node: np.ndarray, level: int, row_of: np.ndarray) -> np.ndarray:
        """Nodes after one more cut; ``row_of[f]`` is the row of ``bins`` that holds feature f."""
        first, n = 2**level - 1, bins.shape[1]
        at = first + np.flatnonzero(self.feature[first : 2 * first + 1] >= 0)
        if not len(at):
            return node
        if level == 0:
            return 1 + (bins[row_of[self.feature[0]]] > self.cut[0])
        # For each node up to this level; no bin is above the cut of a node that stays.
        start, cut, child = np.zeros(2 * first + 1, np.int64), np.full(2 * first + 1, MOST_BINS, np.int16), np.arange(2 * first + 1)
        start[at], cut[at], child[at] = row_of[self.feature[at]] * n, self.cut[at], 2 * at + 1
        right = bins.ravel().take(start.take(node) + np.arange(n)) > cut.take(node)
        return child.take(node) + right


# -- binning ----------------------------------------------------------------------------


def bin_cuts(train: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper bounds of all bins of each feature but the last bin's."""
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"2 to {MOST_BINS} bins")
    values = F.array(*[F.col(f).cast("double") for f in features])
    long = train.select(F.posexplode(values).alias("k", "v")).groupBy("k")
    grid = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    # A row for each feature, with a sketch or, where it has few values, the set of them.
    sketches = {r["k"]: r for r in long.agg(F.approx_count_distinct("v", 0.02).alias("n"), F.percentile_approx("v", grid).alias("q")).collect()}
    few = [k for k, r in sketches.items() if r["n"] <= 1.2 * bins]
    narrow = train.select(F.posexplode(values).alias("k", "v")).filter(F.col("k").isin(few)).groupBy("k")
    sets = {r["k"]: np.unique(r["v"]) for r in narrow.agg(F.collect_set("v").alias("v")).collect()} if few else {}
    exact = {k: v[:-1] for k, v in sets.items() if len(v) <= bins}
    return [exact[k] if k in exact else np.unique(sketches[k]["q"]) for k in range(len(features))]


def _row_key(features: list[str], target: str) -> Column:
    return F.xxhash64(F.lit("row"), target, *features)


def _packed(block: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([len(block[1])], pa.int32()), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in block]],
        names=["rows", "bins", "target", "margin", "key"],
    )


BLOCK = "rows int, bins binary, target binary, margin binary, key binary"


def _blocks(train: DataFrame, features: list[str], target: str, cuts: list[np.ndarray], base: float) -> DataFrame:
    """Rows as blocks; their prediction so far is ``base``."""
    values = train.select(
        F.col(target).cast("double").alias("y"), _row_key(features, target).alias("key"),
        *[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0

        def block() -> pa.RecordBatch:
            bins, y, key = (np.concatenate(x, axis=-1) for x in zip(*kept, strict=True))
            kept.clear()
            return _packed((bins, y, np.full(len(y), base), key))

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                numbers = lambda c, part=part: part.column(c).to_numpy(zero_copy_only=False)
                bins = np.stack([np.searchsorted(c, numbers(f"f{k}")).astype(np.uint8) for k, c in enumerate(cuts)])
                kept.append((bins, numbers("y"), numbers("key")))
                rows += part.num_rows
                if rows >= BLOCK_ROWS:
                    yield block()
                    rows = 0
        if rows:
            yield block()

    return values.mapInArrow(run, BLOCK)


Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Drawn = tuple[np.ndarray, np.ndarray]


def _unpacked(n: int, bins: bytes, target: bytes, margin: bytes, key: bytes) -> Block:
    """Bins (features, rows), target, prediction so far and key of a block's rows."""
    return np.frombuffer(bins, np.uint8).reshape(-1, n), np.frombuffer(target), np.frombuffer(margin), np.frombuffer(key, np.uint64)


def _loaded(blocks: DataFrame, rows: int) -> RDD:
    """Saved blocks as arrays, kept where they are read; a lost one is read again.

    No more partitions than full blocks: small tables would pay for tasks without work. The blocks are dealt out
    evenly over as many tasks as run side by side, or a multiple of it: each of two thousand jobs waits for its last task.
    """
    if rows < TASK_BLOCKS * BLOCK_ROWS:
        dealt = blocks.coalesce(1)
    else:
        cores = blocks.sparkSession.sparkContext.defaultParallelism
        dealt = blocks.repartition(min(rows // BLOCK_ROWS, cores * max(1, round(rows / (TASK_ROWS * cores)))))
    return dealt.rdd.map(lambda r: _unpacked(*r)).persist(StorageLevel.MEMORY_AND_DISK)


# -- one level --------------------------------------------------------------------------


def _hashed(key: np.ndarray, seed: int, round_: int) -> np.ndarray:
    """A number below 2^53 for each key, another one for each tree."""
    h = key ^ np.uint64((seed * 0x9E3779B97F4A7C15 + round_ * 0xD1B54A32D192ED03) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(11)


def _drawn(key: np.ndarray, seed: int, round_: int, share: float) -> np.ndarray:
    """Which rows a tree sees, by a hash of their key."""
    return np.ones(len(key), bool) if share >= 1 else _hashed(key, seed, round_) < share * 2.0**53


CUT = np.dtype([("gain", float), *[(name, np.int64) for name in ("gl", "hl", "g", "h", "cut")]])


@dataclass
class _Growth:
    """What a task needs to know to grow a tree: what is drawn, and trees not yet in the saved predictions."""

    done: list[Tree]
    round: int
    widths: np.ndarray
    scale: float
    settings: Settings

    def __post_init__(self):
        rng = np.random.default_rng([self.settings.seed, self.round])
        count = max(1, int(self.settings.column_share * len(self.widths)))
        #: Features of this tree, in order, the place of each one's bins in a row of sums, and the row of its bins.
        self.columns = np.sort(rng.permutation(len(self.widths))[:count])
        self.ends = np.cumsum(self.widths[self.columns])
        self.starts = self.ends - self.widths[self.columns]
        self.row_of = np.zeros(len(self.widths), np.int64)
        self.row_of[self.columns] = np.arange(count)

    def drawn(self, block: Block) -> Drawn:
        """What this tree sees: bins of its features and gradients of its rows."""
        bins, y, margin, key = block
        margin = _with_trees(bins, margin, self.done, self.settings.depth)
        seen = np.flatnonzero(_drawn(key, self.settings.seed, self.round, self.settings.row_share))
        return bins[self.columns].take(seen, axis=1), np.rint((margin[seen] - y[seen]) * self.scale)

    def placed(self, drawn: Drawn, tree: Tree, level: int) -> np.ndarray:
        node = np.zeros(len(drawn[1]), np.int64)
        for k in range(level):
            node = tree.step(drawn[0], node, k, self.row_of)
        return node

    def summed_nodes(self, tree: Tree, level: int) -> np.ndarray:
        """Nodes of a level whose rows are summed: the root, or of two children the one with fewer rows."""
        if level == 0:
            return np.zeros(1, int)
        parent = np.arange(2 ** (level - 1) - 1, 2**level - 1)
        parent = parent[tree.feature[parent] >= 0]
        return 2 * parent + 1 + (tree.cover[2 * parent + 2] < tree.cover[2 * parent + 1])

    def sums(self, placed: Iterator[tuple[Drawn, np.ndarray]], nodes: np.ndarray, depth: int) -> np.ndarray:
        """Gradient sums and row counts: (2, ``nodes``, bins of all features)."""
        total = np.zeros((2, len(nodes), int(self.ends[-1])), np.int64)
        slot = np.full(2 ** (depth + 1) - 1, -1)
        slot[nodes] = np.arange(len(nodes))
        cells = len(nodes) * MOST_BINS
        for (bins, gradient), node in placed:
            of = slot[node]
            here = np.flatnonzero(of >= 0)
            of, gradient = of[here] * MOST_BINS, gradient[here]
            # A block's sums are exact in doubles.
            for row, a, b in zip(bins, self.starts, self.ends, strict=True):
                at = of + row.take(here)
                total[0, :, a:b] += np.bincount(at, gradient, cells).astype(np.int64).reshape(-1, MOST_BINS)[:, : b - a]
                total[1, :, a:b] += np.bincount(at, minlength=cells).reshape(-1, MOST_BINS)[:, : b - a]
        return total

    def completed(self, total: np.ndarray, tree: Tree, level: int, before: np.ndarray | None) -> np.ndarray:
        """Sums of all nodes of a level from those of ``summed_nodes`` and all nodes of the level before."""
        if before is None:
            return total
        at = self.summed_nodes(tree, level) - (2**level - 1)
        whole = np.zeros((2, 2**level, total.shape[2]), np.int64)
        whole[:, at] = total
        whole[:, at ^ 1] = before[:, at // 2] - total
        return whole

    def best_cut(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """For each node the best cut by one feature, from its sums (nodes x bins).

        Rows of gain, gl, hl (left of the cut), g, h (in all) and cut.
        """
        gl, hl = g.cumsum(axis=1), h.cumsum(axis=1)
        g, h = gl[:, -1:], hl[:, -1:]
        of = lambda a, b: (a / self.scale) ** 2 / np.maximum(b + self.settings.penalty, 1e-300)
        gain = (of(gl, hl) + of(g - gl, h - hl) - of(g, h)) / 2
        least = max(self.settings.least_weight, 1)
        gain[(hl < least) | (h - hl < least)] = -np.inf
        cut, node = gain.argmax(axis=1), np.arange(len(gain))
        out = np.empty(len(gain), CUT)
        for name, x in zip(CUT.names, (gain[node, cut], gl[node, cut], hl[node, cut], g[:, 0], h[:, 0], cut), strict=True):
            out[name] = x
        return out

    def best_cuts(self, sums: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for f, a, b in zip(self.columns.tolist(), self.starts, self.ends, strict=True):
            yield f, self.best_cut(sums[0, :, a:b], sums[1, :, a:b])

    def grown(self, cuts_of, thresholds: list[np.ndarray]) -> Tree:
        """A tree, level by level; ``cuts_of(tree, level)`` gives the best cuts by each feature."""
        depth, scale = self.settings.depth, self.scale
        tree = Tree.empty(depth)
        value = lambda g, h: -(g / scale) / (h + self.settings.penalty) * self.settings.rate
        for level in range(depth):
            best, by = None, None
            for f, cuts in sorted(cuts_of(tree, level), key=lambda x: x[0]):
                if best is None:
                    best, by = cuts.copy(), np.full(len(cuts), f)
                better = cuts["gain"] > best["gain"]
                best[better], by[better] = cuts[better], f
            at = 2**level - 1 + np.arange(2**level)
            if level == 0:
                tree.value[0], tree.cover[0] = value(best["g"][0], best["h"][0]), best["h"][0]
            use = np.flatnonzero(best["gain"] > max(self.settings.least_gain, LEAST_GAIN))
            if not len(use):
                break
            at, best, by = at[use], best[use], by[use]
            tree.feature[at], tree.cut[at] = by, best["cut"]
            tree.threshold[at] = [thresholds[f][c] for f, c in zip(by, best["cut"], strict=True)]
            left, right = 2 * at + 1, 2 * at + 2
            tree.value[left], tree.cover[left] = value(best["gl"], best["hl"]), best["hl"]
            g, h = best["g"] - best["gl"], best["h"] - best["hl"]
            tree.value[right], tree.cover[right] = value(g, h), h
        return tree

    @contextmanager
    def over(self, blocks: RDD):
        """Cuts of a level by a job over all blocks."""
        kept = blocks.map(self.drawn).persist(StorageLevel.MEMORY_AND_DISK)
        before = None

        def cuts_of(tree: Tree, level: int) -> Iterator[tuple[int, np.ndarray]]:
            nonlocal before
            nodes = self.summed_nodes(tree, level)

            def run(part: Iterator[Drawn]) -> Iterator[np.ndarray]:
                yield self.sums(((d, self.placed(d, tree, level)) for d in part), nodes, self.settings.depth)

            total = sum(_met(kept.mapPartitions(run)).collect())
            before = self.completed(total, tree, level, before)
            return self.best_cuts(before)

        try:
            yield cuts_of
        finally:
            kept.unpersist()

    def within(self, blocks: list[Block]):
        """Cuts of a level inside the task that has all blocks."""
        drawn = [self.drawn(b) for b in blocks]
        place = [np.zeros(len(gradient), np.int64) for _, gradient in drawn]
        before = None

        def cuts_of(tree: Tree, level: int) -> Iterator[tuple[int, np.ndarray]]:
            nonlocal place, before
            if level:
                place = [tree.step(d[0], p, level - 1, self.row_of) for d, p in zip(drawn, place, strict=True)]
            total = self.sums(zip(drawn, place, strict=True), self.summed_nodes(tree, level), self.settings.depth)
            before = self.completed(total, tree, level, before)
            return self.best_cuts(before)

        return cuts_of


def _met(sums: RDD) -> RDD:
    """Sums of at most MEET tasks, added up in as many places where there are more."""
    if sums.getNumPartitions() <= MEET:
        return sums
    dealt = sums.mapPartitionsWithIndex(lambda k, part: ((k % MEET, x) for x in part))
    return dealt.partitionBy(MEET, lambda k: k).mapPartitions(lambda part: [reduce(np.add, (x for _, x in part))])


def _grown_within(blocks: Iterator[Block], growth: _Growth, rounds: int, thresholds: list[np.ndarray]) -> Iterator[Tree]:
    """Trees of ``rounds`` rounds in the one task there is: its sums are all sums, so none of them has to leave it."""
    kept = [_applied(b, growth.done, growth.settings.depth) for b in blocks]
    for k in range(rounds):
        own = replace(growth, done=[], round=growth.round + k)
        tree = own.grown(own.within(kept), thresholds)
        kept = [_applied(b, [tree], growth.settings.depth) for b in kept]
        yield tree


def _with_trees(bins: np.ndarray, margin: np.ndarray, trees: list[Tree], depth: int) -> np.ndarray:
    for tree in trees:
        margin = margin + tree.value[tree.place(bins, depth)]
    return margin


def _applied(block: Block, done: list[Tree], depth: int) -> Block:
    """A block with the values of ``done`` in its prediction."""
    bins, y, margin, key = block
    return bins, y, _with_trees(bins, margin, done, depth), key


def _moved_on(blocks: DataFrame, done: list[Tree], depth: int) -> DataFrame:
    """Blocks with the values of ``done`` in their predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _packed(_applied(_unpacked(*row), done, depth))

    return blocks.mapInArrow(run, BLOCK)


# -- model ------------------------------------------------------------------------------


@dataclass
class BoostedTrees:
    """A fitted model: ``base`` and the values of all trees add up to a prediction."""

    features: list[str]
    base: float
    rows: int
    trees: list[Tree]
    settings: Settings = field(default_factory=Settings)

    def scorer(self, trees: list[Tree] | None = None, with_base: bool = True) -> TreeScorer:
        """Nodes of ``trees`` (all unless told otherwise) as one set of arrays; the base is a tree of one leaf."""
        trees = self.trees if trees is None else trees
        size = 2 ** (self.settings.depth + 1) - 1
        first = (np.arange(len(trees)) * size).repeat(size)
        stack = lambda name, kind: np.concatenate([np.empty(0, kind), *[getattr(t, name) for t in trees]]).astype(kind)
        feature = stack("feature", np.int32)
        here = np.arange(len(feature))
        leaf = feature < 0
        inside = here - first
        out = {
            "feature": np.where(leaf, 0, feature).astype(np.int32),
            "threshold": np.where(leaf, np.inf, stack("threshold", float)),
            "left": np.where(leaf, here, first + 2 * inside + 1).astype(np.int32),
            "right": np.where(leaf, here, first + 2 * inside + 2).astype(np.int32),
            "value": stack("value", float),
            "cover": stack("cover", float),
        }
        roots, n = np.arange(len(trees)) * size, len(feature)
        if with_base:
            last = {"feature": 0, "threshold": np.inf, "left": n, "right": n, "value": self.base, "cover": self.rows}
            out = {k: np.append(v, np.array(last[k], v.dtype)) for k, v in out.items()}
            roots = np.append(roots, n)
        return TreeScorer(roots=roots.astype(np.int32), weights=np.ones(len(roots)), depth=self.settings.depth, **out)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the column ``prediction``; a missing feature goes right at each cut."""
        spark = df.sparkSession
        ship_package(spark)
        sent = spark.sparkContext.broadcast(self.scorer())

        def predict(*columns: pd.Series) -> pd.Series:
            return pd.Series(sent.value.predict(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

        inputs = [F.col(f).cast("double") for f in self.features]
        # Else the optimizer may copy the call to every place that uses its result.
        once = F.pandas_udf(predict, "double").asNondeterministic()
        return df.withColumn("prediction", once(*inputs))

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes as Parquet and one line of JSON, over what was there."""
        about = {"features": self.features, "base": self.base, "rows": self.rows, "settings": asdict(self.settings)}
        names = ["feature", "cut", "threshold", "value", "cover"]
        rows = [
            (t, i, *[getattr(tree, n)[i].item() for n in names])
            for t, tree in enumerate(self.trees)
            for i in range(len(tree.feature))
        ]
        schema = "tree int, id int, feature int, cut int, threshold double, value double, cover double"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "id"])
        trees = [
            Tree(
                part["feature"].to_numpy(np.int16), part["cut"].to_numpy(np.int16), part["threshold"].to_numpy(),
                part["value"].to_numpy(), part["cover"].to_numpy(),
            )
            for _, part in nodes.groupby("tree")
        ]
        return cls(about["features"], about["base"], about["rows"], trees, Settings(**about["settings"]))


@dataclass(frozen=True)
class HistogramBoosting:
    """Fits ``BoostedTrees``; rows with a missing feature or target are left out."""

    settings: Settings
    target: str

    def fit(self, train: DataFrame, features: list[str]) -> BoostedTrees:
        ship_package(train.sparkSession)
        settings = self.settings
        known = train.select(self.target, *[f for f in features if f != self.target]).na.drop("any")
        y = F.col(self.target)
        about = known.agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.min(y).alias("lo"), F.max(y).alias("hi")).first()
        n = about["n"]
        if not n:
            raise ValueError("no rows to fit")
        # Ten digits: the last ones of a mean depend on the order of addition.
        base = float(f"{about['mean']:.10g}")
        cuts = bin_cuts(known, features, settings.bins)
        spread = max(float(about["hi"]) - float(about["lo"]), 1e-300)
        bits = min(GRADIENT_BITS, 61 - int(np.ceil(np.log2(n))))
        scale = 2.0 ** (bits - 1 - np.ceil(np.log2(spread)))
        widths = np.array([len(c) + 1 for c in cuts])
        saved = stage(_blocks(known, features, self.target, cuts, base), "blocks")
        blocks = _loaded(saved, n)
        trees: list[Tree] = []
        # Trees that are not yet in the predictions of the blocks, and in the saved ones.
        done: list[Tree] = []
        since: list[Tree] = []
        while len(trees) < settings.rounds:
            growth = _Growth(done, len(trees), widths, scale, settings)
            if blocks.getNumPartitions() == 1:
                count = min(ROUNDS_A_JOB, settings.rounds - len(trees))
                new = blocks.mapPartitions(lambda part, g=growth, k=count: _grown_within(part, g, k, cuts)).collect()
            else:
                with growth.over(blocks) as cuts_of:
                    new = [growth.grown(cuts_of, cuts)]
            trees += new
            done, since = done + new, since + new
            if len(trees) == settings.rounds or len(done) < MOVE_ROUNDS:
                continue
            if len(since) >= SAVE_ROUNDS:
                saved = stage(_moved_on(saved, since, settings.depth), "blocks")
                moved, since = _loaded(saved, n), []
            else:
                moved = blocks.map(lambda b, own=done: _applied(b, own, settings.depth)).persist(StorageLevel.MEMORY_AND_DISK)
                moved.count()
            blocks.unpersist()
            blocks, done = moved, []
        blocks.unpersist()
        return BoostedTrees(list(features), base, n, trees, settings)
