"""Gradient-boosted regression trees with L1 and L2 terms, on sums of histograms.

Each feature is cut into at most 256 bins.  A tree grows level by level: for
every open node, feature and bin the gradients and their number are summed, each
cut is scored from these sums, and the best one of a node is taken::

    weight = -soft(G, l1) / (H + l2)      gain = soft(G, l1)^2 / (H + l2), summed over both sides

(squared error: the gradient is prediction minus target, the hessian is 1).  The
sums are all that a level needs from the rows.  Tasks make them from their own
rows, Spark adds them up, and at most ``2^depth x features x bins`` sums come to
the driver, whatever the number of rows.  Training rows that fit one task
(``BLOCK_ROWS``) have their sums there already, so the same growth runs inside
that task and training is a single job.

Gradients are whole multiples of a unit that is a power of two, so sums are
exact: trees do not depend on partitions or on the order of rows.  Rows and columns of
a tree are drawn by a hash of the row's id, the tree and the seed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcast.session import materialize

#: Training rows that one task holds.
BLOCK_ROWS = 50_000
#: Trees between two writes of the predictions, where rows are spread over tasks.
WRITE_TREES = 10
#: A cut must gain more than this.
LEAST_GAIN = 1e-6

TREE = "tree int, node int, feature int, cut double, bin int, weight double"


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    rate: float = 0.05
    depth: int = 4
    rows: float = 0.8
    columns: float = 0.8
    l1: float = 0.1
    l2: float = 1.0
    least_rows: int = 1
    bins: int = 256
    seed: int = 42


@dataclass
class Tree:
    """Nodes by their place in a heap: 0, then 2k+1 and 2k+2 below k.  A leaf has no feature (-1)."""

    feature: np.ndarray
    bin: np.ndarray
    weight: np.ndarray

    def step(self, bins: np.ndarray, node: np.ndarray) -> bool:
        """Moves rows of bins one level down, in place; whether any was at an inner node."""
        inner = np.flatnonzero(self.feature[node] >= 0)
        at = node[inner]
        node[inner] = 2 * at + 1 + (bins[inner, self.feature[at]] >= self.bin[at])
        return bool(len(inner))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row of bins ends, as far as the tree has grown."""
        node = np.zeros(len(bins), dtype=np.int64)
        while self.step(bins, node):
            pass
        return node


def hash32(ids: np.ndarray, salt: int) -> np.ndarray:
    """32 mixed bits of 32-bit ids."""
    x = ids.astype(np.uint64) ^ np.uint64(salt & 0xFFFFFFFF)
    low = np.uint64(0xFFFFFFFF)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & low
    return x ^ (x >> np.uint64(16))


def salt_of(settings: Settings, tree: int) -> int:
    return settings.seed * 1_000_003 + tree * 7_919


def drawn_rows(ids: np.ndarray, settings: Settings, tree: int) -> np.ndarray:
    return hash32(ids, salt_of(settings, tree)) < settings.rows * 2.0**32


def drawn_columns(n: int, settings: Settings, tree: int) -> np.ndarray:
    order = np.argsort(hash32(np.arange(n), salt_of(settings, tree) + 104_729), kind="stable")
    return np.sort(order[: max(1, int(settings.columns * n))])


def unit_of(largest: float) -> float:
    """A power of two of which the largest target is about 2^30."""
    return 2.0 ** (int(np.ceil(np.log2(largest))) - 30) if largest > 0 else 1.0


def in_units(x: np.ndarray, unit: float) -> np.ndarray:
    return np.floor(x / unit + 0.5).astype(np.int64)


def soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def histograms(bins: np.ndarray, gradient: np.ndarray, node: np.ndarray, first: int, width: int, n_bins: int) -> np.ndarray:
    """Sums of gradients and rows, by node of a level, feature and bin.

    Of at most 2^22 rows at a time, so that sums of whole numbers are exact in doubles.
    """
    n = bins.shape[1]
    here = (node >= first) & (node < first + width)
    cell = (((node[here] - first)[:, None] * n + np.arange(n)) * n_bins + bins[here]).ravel()
    size = width * n * n_bins
    sums = np.bincount(cell, weights=np.repeat(gradient[here], n), minlength=size)
    return np.stack([sums.astype(np.int64), np.bincount(cell, minlength=size)]).reshape(2, width, n, n_bins)


def grow(level_sums: Callable[[Tree, int, int], np.ndarray], features: np.ndarray, settings: Settings, unit: float) -> Tree:
    """One tree from the sums of its levels; ``level_sums(tree, first, width)`` gives those of the
    nodes ``first`` to ``first + width - 1``."""
    nodes = 2 ** (settings.depth + 1) - 1
    tree = Tree(np.full(nodes, -1), np.zeros(nodes, dtype=np.int64), np.zeros(nodes))

    def part(s: np.ndarray, n: np.ndarray) -> np.ndarray:
        t = soft(s, settings.l1)
        return t * t / (n + settings.l2)

    def weight(s, n):
        return -soft(s, settings.l1) / (n + settings.l2)

    open_ = np.array([0])
    for level in range(settings.depth):
        first, width = 2**level - 1, 2**level
        sums = level_sums(tree, first, width)[:, open_ - first][:, :, features]
        left = np.cumsum(sums, axis=3)
        (g, h), (g_left, h_left) = left[:, :, :, -1:], left[:, :, :, :-1]
        g, g_left = g * unit, g_left * unit
        g_right, h_right = g - g_left, h - h_left
        if level == 0:
            tree.weight[0] = weight(g[0, 0, 0], h[0, 0, 0])
        gain = part(g_left, h_left) + part(g_right, h_right) - part(g, h)
        gain[(h_left < settings.least_rows) | (h_right < settings.least_rows)] = -np.inf
        # The first of equal gains: the feature listed first, then the lowest cut.
        flat = gain.reshape(len(open_), -1)
        if not flat.shape[1]:
            break
        best = flat.argmax(axis=1)
        at = np.arange(len(open_))
        split = flat[at, best] > LEAST_GAIN
        f, cut = np.divmod(best, gain.shape[2])
        node, at, f, cut = open_[split], at[split], f[split], cut[split]
        tree.feature[node], tree.bin[node] = features[f], cut + 1
        tree.weight[2 * node + 1] = weight(g_left[at, f, cut], h_left[at, f, cut])
        tree.weight[2 * node + 2] = weight(g_right[at, f, cut], h_right[at, f, cut])
        open_ = np.sort(np.concatenate([2 * node + 1, 2 * node + 2]))
        if not len(open_):
            break
    return tree


def block_trees(bins: np.ndarray, target: np.ndarray, ids: np.ndarray, n_bins: int, settings: Settings, base: float, unit: float) -> Iterator[Tree]:
    """All trees from rows that are in one place."""
    prediction = np.full(len(target), base)
    for t in range(settings.rounds):
        gradient = in_units(prediction - target, unit)
        drawn = drawn_rows(ids, settings, t)
        own, g = bins[drawn], gradient[drawn]
        node = np.zeros(len(own), dtype=np.int64)

        def sums(tree: Tree, first: int, width: int) -> np.ndarray:
            if first:
                tree.step(own, node)
            return histograms(own, g, node, first, width, n_bins)

        tree = grow(sums, drawn_columns(bins.shape[1], settings, t), settings, unit)
        yield tree
        prediction = prediction + settings.rate * tree.weight[tree.leaves(bins)]


class BoostedTrees:
    """A fitted model."""

    def __init__(self, features: list[str], cuts: list[list[float]], base: float, trees: list[Tree], settings: Settings):
        self.features, self.cuts, self.base, self.trees, self.settings = features, cuts, base, trees, settings

    def nodes(self) -> list[tuple]:
        """``tree, node, feature, cut, weight`` of all nodes; a row goes left where its feature is below the cut."""
        rows = []
        for t, tree in enumerate(self.trees):
            there = [0]
            for node in there:
                f = int(tree.feature[node])
                cut = self.cuts[f][tree.bin[node] - 1] if f >= 0 else None
                rows.append((t, node, self.features[f] if f >= 0 else None, cut, float(tree.weight[node])))
                there += [2 * node + 1, 2 * node + 2] if f >= 0 else []
        return rows

    def predict(self, columns: list[np.ndarray]) -> np.ndarray:
        """Predictions of rows that are given by columns."""
        out = np.full(len(columns[0]), self.base)
        if self.trees:
            bins = _binned(columns, self.cuts)
            for tree in self.trees:
                out += self.settings.rate * tree.weight[tree.leaves(bins)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``: whole batches of rows walk the trees together.

        A hundred trees as one expression are too much for the planner where a
        recursive forecast nests them.
        """

        @F.pandas_udf("double")
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(self.predict([c.to_numpy(np.float64) for c in columns]))

        return df.withColumn("prediction", run(*(F.col(c).cast("double") for c in self.features)))


def cut_points(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """For each feature the values at which a bin begins: its quantiles, without the smallest value.

    Up to ``bins`` rows every value is one.
    """
    shares = [(k + 1) / bins for k in range(bins)]
    found = rows.agg(
        *(F.percentile_approx(c, F.lit(shares), F.lit(100 * bins)).alias(f"q{k}") for k, c in enumerate(features)),
        *(F.min(c).alias(f"m{k}") for k, c in enumerate(features)),
    ).first()
    return [sorted({float(x) for x in found[f"q{k}"] or ()} - {float(found[f"m{k}"])} if found[f"m{k}"] is not None else []) for k in range(len(features))]


def _binned(columns: list[np.ndarray], cuts: list[list[float]]) -> np.ndarray:
    return np.column_stack([np.searchsorted(np.array(c), x, side="right") for x, c in zip(columns, cuts, strict=True)]).astype(np.int64)


def row_ids(*columns: Column | str) -> Column:
    """32 bits that name a row by the text of its columns (a value that SQL engines agree on)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("long")


def fit(rows: DataFrame, features: Sequence[str], target: str, row_id: Column, settings: Settings = Settings()) -> BoostedTrees:
    """A model of ``target`` on ``features``; ``row_id`` is a number of 32 bits for each row
    (see :func:`row_ids`), by which rows are drawn.

    Rows with a null feature or target are left out; without any other row the
    model predicts 0.
    """
    names = list(features)
    own = rows.select(row_id.alias("id"), F.col(target).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(names)))
    own = materialize(own.dropna())
    columns = [f"x{k}" for k in range(len(names))]
    facts = own.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.max(F.abs("y")).alias("largest")).first()
    if not facts["n"]:
        return BoostedTrees(names, [[] for _ in names], 0.0, [], settings)
    cuts = cut_points(own, columns, settings.bins)
    unit = unit_of(facts["largest"])
    base = float(np.floor(facts["mean"] / unit + 0.5) * unit)
    n_bins = max(len(c) for c in cuts) + 1
    if facts["n"] <= BLOCK_ROWS:
        trees = _in_one_task(own, columns, cuts, n_bins, settings, base, unit)
    else:
        trees = _over_tasks(own, columns, cuts, n_bins, settings, base, unit)
    return BoostedTrees(names, cuts, base, trees, settings)


def _in_one_task(own: DataFrame, columns, cuts, n_bins, settings, base, unit) -> list[Tree]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        bins = _binned([rows[c].to_numpy() for c in columns], cuts)
        for t, tree in enumerate(block_trees(bins, rows.y.to_numpy(), rows.id.to_numpy(), n_bins, settings, base, unit)):
            yield pd.DataFrame({"tree": t, "node": np.arange(len(tree.feature)), "feature": tree.feature, "cut": 0.0, "bin": tree.bin, "weight": tree.weight})

    table = own.coalesce(1).mapInPandas(run, TREE).toPandas().sort_values(["tree", "node"])
    return [Tree(t.feature.to_numpy(), t.bin.to_numpy(np.int64), t.weight.to_numpy()) for _, t in table.groupby("tree")]


def _over_tasks(own: DataFrame, columns, cuts, n_bins, settings, base, unit) -> list[Tree]:
    n = len(columns)

    def prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bins = _binned([b[c].to_numpy() for c in columns], cuts).astype(np.uint16)
            yield pd.DataFrame({"id": b.id, "y": b.y, "p": base, "bins": [r.tobytes() for r in bins]})

    kept = "id long, y double, p double, bins binary"

    def read(b: pd.DataFrame, since: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
        bins = np.frombuffer(b"".join(b.bins), dtype=np.uint16).reshape(len(b), n).astype(np.int64)
        prediction = b.p.to_numpy()
        for tree in since:
            prediction = prediction + settings.rate * tree.weight[tree.leaves(bins)]
        return bins, prediction

    table = materialize(own.mapInPandas(prepared, kept))
    trees: list[Tree] = []
    since: list[Tree] = []
    for t in range(settings.rounds):

        def level_sums(tree: Tree, first: int, width: int) -> np.ndarray:
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = np.zeros((2, width, n, n_bins), dtype=np.int64)
                for b in batches:
                    if len(b):
                        # A batch has far fewer than 2^22 rows.
                        bins, prediction = read(b, since)
                        drawn = drawn_rows(b.id.to_numpy(), settings, t)
                        gradient = in_units(prediction - b.y.to_numpy(), unit)[drawn]
                        total += histograms(bins[drawn], gradient, tree.leaves(bins[drawn]), first, width, n_bins)
                cell = np.flatnonzero(total[1].ravel())
                yield pd.DataFrame({"cell": cell, "g": total[0].ravel()[cell], "h": total[1].ravel()[cell]})

            found = table.mapInPandas(run, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
            out = np.zeros((2, width * n * n_bins), dtype=np.int64)
            out[:, found.cell.to_numpy()] = np.stack([found.g.to_numpy(), found.h.to_numpy()])
            return out.reshape(2, width, n, n_bins)

        trees.append(grow(level_sums, drawn_columns(n, settings, t), settings, unit))
        since.append(trees[-1])
        if len(since) == WRITE_TREES and t + 1 < settings.rounds:

            def advanced(batches: Iterator[pd.DataFrame], since=tuple(since)) -> Iterator[pd.DataFrame]:
                for b in batches:
                    if len(b):
                        yield b.assign(p=read(b, list(since))[1])

            table = materialize(table.mapInPandas(advanced, kept))
            since = []
    return trees
