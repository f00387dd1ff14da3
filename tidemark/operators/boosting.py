"""Gradient boosting of many folds and targets at once.

Every (fold, target) pair has trees of its own, and all of them grow together: a level of a tree is one aggregate
of gradients by (pair, node, feature, bin), whatever the number of pairs. Each task adds up the cells of its rows in arrays
first, so what is shuffled does not grow with the rows. What comes to the driver is one row for each pair and node, the split;
the trees go back with the next tasks, which find the rows' scores from them: the rows are stored once, as bins, and never
again. A model reads the training rows of its fold only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.functions.tables import Table

Cuts = dict[str, list[float]]
LEAST = 1e-3  # least sum of second derivatives on either side of a split


def cut_points(df: DataFrame, columns: Sequence[str], bins: int = 32) -> Cuts:
    """Approximate quantiles of each column, between which its values are not told apart."""
    found = df.approxQuantile(list(columns), [k / bins for k in range(1, bins)], 1 / (16 * bins))
    return {c: sorted(set(x)) for c, x in zip(columns, found)}


def _bin(column: str, at: list[float]) -> Column:
    return sum(((F.col(column) > x).cast("short") for x in at), F.lit(0)).cast("short")


class _Tree:
    """A growing tree of one pair, as arrays by node: the root is 1, the children of k are 2 k and 2 k + 1."""

    def __init__(self, depth: int) -> None:
        self.features, self.at = [0] * (1 << depth), [None] * (1 << depth)  # no split: all go left
        self.leaves = np.zeros(1 << depth)

    def nodes(self, bins: list[np.ndarray], levels: int) -> np.ndarray:
        """The node that each row reaches after so many splits."""
        node = np.ones(len(bins[0]), np.int16)
        for level in range(levels):
            right = np.zeros(len(node), bool)
            for k in range(1 << level, 2 << level):
                if self.at[k] is not None:
                    above = bins[self.features[k]] > self.at[k]
                    right |= above if level == 0 else above & (node == k)
            node = 2 * node + right
        return node


class _Model:
    """The trees of one pair and its score before the first."""

    def __init__(self, pair: int, start: float) -> None:
        self.pair, self.start, self.trees = pair, start, []

    def raw(self, bins: list[np.ndarray], depth: int, rate: float) -> np.ndarray:
        """Scores of all trees that are grown, as log odds."""
        out = np.full(len(bins[0]), self.start)
        for tree in self.trees:
            out += rate * tree.leaves[tree.nodes(bins, depth) - (1 << depth)]
        return out


Models = dict[tuple[int, int], _Model]  # by fold and place of the target


def _by_model(batch: pa.RecordBatch, models: Models, features: int, targets: int) -> Iterator[tuple[int, _Model, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Place of the target, model, places of the rows, their bins and labels, for each model that has rows in the batch."""
    column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    folds, labels = column("fold"), [column(f"_y{t}") for t in range(targets)]
    bins = [column(f"_b{f}") for f in range(features)]
    for fold in np.unique(folds):
        for t in range(targets):
            if model := models.get((int(fold), t)):
                at = np.flatnonzero((folds == fold) & ~np.isnan(labels[t]))
                if len(at):
                    yield t, model, at, [b[at] for b in bins], labels[t][at]


def _splits(train: DataFrame, models: Models, grown: dict[int, _Tree], level: int, sizes: list[int], targets: int, depth: int, rate: float, l2: float) -> list:
    """The best split of each node of a level, with the sums on its left side and of the whole node."""
    first, wide = 1 << level, max(sizes)

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, model, _, bins, y in _by_model(batch, models, len(sizes), targets):
                p = 1 / (1 + np.exp(-model.raw(bins, depth, rate)))
                g, h = p - y, p * (1 - p)
                base = (grown[model.pair].nodes(bins, level).astype(np.int64) - first) * wide
                mine = sums.setdefault(model.pair, np.zeros((3, len(sizes), first * wide)))
                for f, b in enumerate(bins):
                    cell = base + b
                    for i, weights in enumerate((g, h, None)):
                        mine[i, f] += np.bincount(cell, weights, first * wide)
        for pair, mine in sums.items():
            feature, cell = np.nonzero(mine[2])
            ints = [np.full(len(cell), pair), first + cell // wide, feature, cell % wide]
            arrays = [*(pa.array(x.astype(np.int32)) for x in ints), *(pa.array(mine[i, feature, cell]) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(arrays, names=["pair", "node", "feature", "bin", "g", "h"])

    cells = train.mapInArrow(cells_of, "pair int, node int, feature int, bin int, g double, h double")
    # what a task sends is summed up already: one exchange by node serves all that follows
    cells = cells.repartition(min(len(grown) << level, _cores(train)), "pair", "node")
    cells = cells.groupBy("pair", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    whole = Window.partitionBy("pair", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as there are bins
    cells = cells.withColumns({"gl": F.sum("g").over(upto), "hl": F.sum("h").over(upto), "gt": F.sum("g").over(whole), "ht": F.sum("h").over(whole)})
    part = lambda g, h: g * g / (h + l2)
    gain = part(F.col("gl"), F.col("hl")) + part(F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")) - part(F.col("gt"), F.col("ht"))
    allowed = (F.col("hl") >= LEAST) & (F.col("ht") - F.col("hl") >= LEAST)
    # compared to nine places, so that the order of sums decides no tie; then the first feature and bin
    gain = F.when(allowed, F.round(gain, 9)).otherwise(F.lit(-1.0))
    order = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    best = F.max_by(F.struct(gain.alias("gain"), "feature", "bin", "gl", "hl", "gt", "ht"), order)
    return cells.groupBy("pair", "node").agg(best.alias("s")).select("pair", "node", "s.*").collect()  # pairs x nodes


def _cores(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def boosted_scores(
    members: DataFrame,
    columns: Sequence[str],
    targets: Sequence[str],
    trees: int = 20,
    depth: int = 3,
    rate: float = 0.1,
    l2: float = 1.0,
    cuts: Cuts | None = None,
    keys: tuple[str, ...] = ("symbol", "ts"),
) -> DataFrame:
    """``keys, fold, target, label, score``: each fold's test rows, scored by the model of its training rows, for every target.

    ``members`` has a row for each fold and role (``train``, ``test``) of a row. Targets are 0 or 1; rows without one of the columns
    or the target take no part. A fold whose training rows have one class only gives no scores. ``depth`` splits on the way to a
    leaf, second-order steps of ``rate``, no sampling: scores are the same on any partitioning but for rounding.
    """
    if cuts is None:  # two passes: what both read is stored
        members = Table(members.select(*dict.fromkeys([*keys, "fold", "role", *columns, *targets])), "members").rows
        cuts = cut_points(members, columns)
    bins = [_bin(c, at).alias(f"_b{f}") for f, (c, at) in enumerate(cuts.items())]
    labels = [F.col(t).cast("double").alias(f"_y{k}") for k, t in enumerate(targets)]
    data = members.dropna(subset=list(columns)).select(*keys, F.col("fold").cast("int").alias("fold"), "role", *bins, *labels)
    data = data.where(F.col("fold").isNotNull() & F.coalesce(*[F.col(f"_y{t}") for t in range(len(targets))]).isNotNull())
    # a few files for each core, whatever the number of series; a batch of rows is of few folds
    rows = Table(data.repartition(2 * _cores(members), *keys).sortWithinPartitions("role", "fold"), "boosted").rows
    means = rows.where("role = 'train'").groupBy("fold").agg(*[F.avg(f"_y{t}").alias(f"_p{t}") for t in range(len(targets))]).orderBy("fold").collect()
    shares = {(r["fold"], t): r[f"_p{t}"] for r in means for t in range(len(targets))}
    shares = {k: p for k, p in shares.items() if p is not None and 0 < p < 1}
    if not shares:
        raise ValueError("no fold has training rows of two classes")
    models: Models = {k: _Model(n, math.log(p / (1 - p))) for n, (k, p) in enumerate(shares.items())}
    sizes = [len(at) + 1 for at in cuts.values()]
    train = rows.where("role = 'train'").select("fold", *[f"_b{f}" for f in range(len(sizes))], *[f"_y{t}" for t in range(len(targets))])
    for _ in range(trees):
        grown = {m.pair: _Tree(depth) for m in models.values()}
        for level in range(depth):
            for s in _splits(train, models, grown, level, sizes, len(targets), depth, rate, l2):
                tree, node = grown[s["pair"]], s["node"]
                found = s["gain"] > 0
                if found:
                    tree.features[node], tree.at[node] = s["feature"], s["bin"]
                if level == depth - 1:
                    left, right = ((s["gl"], s["hl"]), (s["gt"] - s["gl"], s["ht"] - s["hl"])) if found else ((s["gt"], s["ht"]),) * 2
                    at = 2 * node - (1 << depth)
                    tree.leaves[at], tree.leaves[at + 1] = -left[0] / (left[1] + l2), -right[0] / (right[1] + l2)
        for m in models.values():
            m.trees.append(grown[m.pair])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, model, at, mine, _ in _by_model(batch, models, len(sizes), len(targets)):
                taken = batch.select([*keys, "fold", f"_y{t}"]).take(pa.array(at))
                names = pa.array([targets[t]] * len(at), pa.string())
                columns = [*taken.columns[: len(keys) + 1], names, taken.column(len(keys) + 1), pa.array(model.raw(mine, depth, rate))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "fold", "target", "label", "raw"])

    shape = StructType([*(rows.schema[k] for k in (*keys, "fold")), StructField("target", StringType()), StructField("label", DoubleType()), StructField("raw", DoubleType())])
    out = rows.where("role = 'test'").drop("role").mapInArrow(scores, shape)
    return out.select(*keys, "fold", "target", "label", (1 / (1 + F.exp(-F.col("raw")))).alias("score"))
