"""A random forest whose trees grow together, level by level, from counts that tasks take of binned rows.

Spark ML's forest spends most of its time on boxed look-ups for each row, tree and level.  Here a row
is one byte per feature, tasks route blocks of rows through all trees in numpy, Spark adds up their
counts per node, and only chosen splits reach the driver.  What is learned is the same kind of model:
Poisson(1) draws of the rows for each tree, a random subset of about sqrt(features) for each node, cuts
between at most 32 bins per feature, weighted Gini gain, leaves where no split gains anything.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from math import ceil, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need neither this package nor Spark ML on their path

BINS = 32
SAMPLE = 10_000  # rows that place the cuts, as Spark ML takes
BLOCK = 1 << 14  # rows packed together
COUNTED = 8  # blocks counted together
STEP = 4  # levels after which rows in finished leaves are dropped from a pass
CELLS = 1 << 24  # counts that a task holds in one pass over the rows; trees beyond them wait for the next
CHUNK = 64  # nodes whose counts travel together
_LEAF = 255  # a cut that sends every row to the "left", which for a leaf is itself

# number of times a row is drawn, for each value of 16 random bits
_DRAWS = np.searchsorted(
    np.cumsum([exp(-1) / factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)
).astype(np.uint8)


# ---------------------------------------------------------------------------
# bins
# ---------------------------------------------------------------------------

def cuts_of(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts between neighbouring values: all of them, or ``bins - 1`` that part the weight evenly."""
    v, place = np.unique(values, return_inverse=True)
    at = np.arange(len(v) - 1)
    if len(at) > bins - 1:
        upto = np.cumsum(np.bincount(place, weights))
        stride = upto[-1] / bins
        at, target = [], stride
        for i in range(len(v) - 1):
            if abs(upto[i] - target) < abs(upto[i + 1] - target):
                at.append(i)
                target += stride
        at = np.array(at[: bins - 1], int)
    with np.errstate(invalid="ignore", over="ignore"):
        middle = (v[at] + v[at + 1]) / 2
    return np.where(middle < v[at + 1], middle, v[at])  # the lower value where no middle lies between


def binned(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """One byte per feature and row: ``x`` is at most cut ``b`` exactly where its bin is at most ``b``."""
    out = np.empty((len(cuts), len(columns[0])), np.uint8)
    for f, (x, c) in enumerate(zip(columns, cuts, strict=True)):
        if np.isnan(x).any():
            raise ValueError("a feature of the classifier is null or not a number")
        out[f] = np.searchsorted(c, x, "left")
    return out


def _packed(rows: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    """Rows as written blocks of bins and classes, dealt evenly over the cores."""

    def block(number: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        x, y = (np.concatenate(p, axis=-1) for p in zip(*parts, strict=True))
        name = (TaskContext.get().partitionId() << 32) + number
        return pa.RecordBatch.from_pydict({
            "block": pa.array([name], pa.int64()), "x": pa.array([x.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, number = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            y, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            parts.append((binned(columns, cuts), y.astype(np.uint16)))
            held += batch.num_rows
            if held >= BLOCK:
                yield block(number, parts)
                parts, held, number = [], 0, number + 1
        if parts:
            yield block(number, parts)

    blocks = rows.select("_y", *[F.col(f).cast("double") for f in features]).mapInArrow(run, "block bigint, x binary, y binary")
    return materialise(materialise(blocks).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism))


# ---------------------------------------------------------------------------
# one level
# ---------------------------------------------------------------------------

def routed(x: np.ndarray, rows: np.ndarray, nodes: np.ndarray, levels: int, at: np.ndarray) -> np.ndarray:
    """The node each row reaches from ``at``.  A node is its left child << 16 | feature << 8 | cut; the right child comes next."""
    n, flat = x.shape[1], x.reshape(-1)
    for _ in range(levels):
        here = nodes.take(at)
        seen = flat.take((here >> 8 & 255) * n + rows)
        at = (here >> 16) + (seen > (here & 255))
    return at


def _drawn(seed: int, tree: int, blocks: list[tuple[int, int]], bootstrap: bool) -> np.ndarray:
    if not bootstrap:
        return np.ones(sum(n for _, n in blocks), np.uint8)
    bits = [np.random.default_rng([seed, tree, b]).integers(0, 1 << 16, n, np.uint16) for b, n in blocks]
    return _DRAWS.take(np.concatenate(bits))


def _counts(blocks: DataFrame, open_nodes: dict, level: int, n_features: int, n_classes: int, seed: int, bootstrap: bool) -> DataFrame:
    """Drawn rows per tree, open node, offered feature, bin and class, in chunks of nodes, one row per task."""

    def add(total: dict, held: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        x, y = np.concatenate([h[1] for h in held], axis=1), np.concatenate([h[2] for h in held]).astype(np.int64)
        n, flat = len(y), x.reshape(-1)
        for tree, (nodes, slots, offered) in open_nodes.items():
            drawn = _drawn(seed, tree, [(b, len(c)) for b, _, c in held], bootstrap)
            rows = np.flatnonzero(drawn)
            at, going = np.zeros(len(rows), np.int64), (slots >= 0) | (nodes & 255 != _LEAF)
            for done in range(0, level, STEP):
                at = routed(x, rows, nodes, min(STEP, level - done), at)
                kept = np.flatnonzero(going.take(at))
                rows, at = rows.take(kept), at.take(kept)
            slot = slots.take(at)
            times, cls, k = drawn.take(rows).astype(np.float64), y.take(rows), offered.shape[1]
            size = len(offered) * BINS * n_classes
            if tree not in total:
                total[tree] = np.zeros((k, size), np.int64)
            base = slot * (BINS * n_classes) + cls
            for j in range(k):
                seen = flat.take(offered[:, j].take(slot) * n + rows)
                total[tree][j] += np.bincount(base + seen.astype(np.int64) * n_classes, times, size).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = {}, []
        for batch in batches:
            for name, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((name, np.frombuffer(x, np.uint8).reshape(n_features, -1), np.frombuffer(y, np.uint16)))
                if len(held) == COUNTED:
                    add(total, held)
                    held = []
        if held:
            add(total, held)
        for tree, counts in total.items():
            by_node = counts.reshape(counts.shape[0], -1, BINS, n_classes).transpose(1, 0, 2, 3)
            for chunk in range(0, len(by_node), CHUNK):
                some = by_node[chunk : chunk + CHUNK]
                if some.any():
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([tree], pa.int32()), "chunk": pa.array([chunk], pa.int32()),
                        "counts": pa.array([some.astype(np.uint32).tobytes()], pa.binary())})  # a partition has no 2^28 rows

    return blocks.mapInArrow(run, "tree int, chunk int, counts binary")


def best_splits(counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For counts by node, offered feature, bin and class: the place of the best feature (-1: none gains), its cut, all rows and those on the left, by class."""
    left = counts.cumsum(axis=2)
    every = left[:, :1, -1:, :]
    right = every - left

    def impure(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = c * weights
        n = w.sum(axis=-1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return n, np.where(n > 0, 1 - ((w / n[..., None]) ** 2).sum(axis=-1), 0.0)

    (n, whole), (nl, il), (nr, ir) = impure(every), impure(left), impure(right)
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = whole - (nl * il + nr * ir) / n
    gain = np.where((left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0), gain, -1.0)
    best = gain.reshape(len(gain), -1).argmax(axis=1)
    feature, cut = np.divmod(best, gain.shape[2])
    node = np.arange(len(gain))
    return np.where(gain[node, feature, cut] > 0, feature, -1), cut, every[:, 0, 0], left[node, feature, cut]


def _split(counted: DataFrame, n_offered: int, n_classes: int, weights: np.ndarray) -> DataFrame:
    def best(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in parts.column("counts").to_pylist())
        feature, cut, every, left = best_splits(total.reshape(-1, n_offered, BINS, n_classes), weights)
        found = np.column_stack([feature, cut, every, left]).astype(np.int64)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()),
                         "found": pa.array([found.tobytes()], pa.binary())})

    return counted.groupBy("tree", "chunk").applyInArrow(best, "tree int, chunk int, found binary")


# ---------------------------------------------------------------------------
# forest
# ---------------------------------------------------------------------------

class _Tree:
    """Nodes of a tree that grows, and those of them that are still to be split."""

    def __init__(self, n_classes: int):
        self.nodes, self.counts = np.array([_LEAF], np.int64), np.zeros((1, n_classes), np.int64)
        self.open, self.levels = np.array([0]), 0

    def grow(self, found: np.ndarray, offered: np.ndarray) -> None:
        """Takes the splits found for the open nodes; children with rows of several classes are open next."""
        c = self.counts.shape[1]
        if not self.levels:
            self.counts[0] = found[0, 2 : 2 + c]
        at = np.flatnonzero(found[:, 0] >= 0)
        place, cut, every, left = found[at, 0], found[at, 1], found[at, 2 : 2 + c], found[at, 2 + c :]
        child = len(self.nodes) + 2 * np.arange(len(at))
        self.nodes[self.open[at]] = child << 16 | offered[at, place] << 8 | cut
        new = np.arange(len(self.nodes), len(self.nodes) + 2 * len(at))
        self.nodes = np.concatenate([self.nodes, new << 16 | _LEAF])
        counts = np.stack([left, every - left], axis=1).reshape(-1, c)
        self.counts = np.concatenate([self.counts, counts])
        self.open = new[(counts > 0).sum(axis=1) > 1]
        self.levels += bool(len(at))


def fit_forest(rows: DataFrame, features: Sequence[str], trees: int = 300, depth: int = 12, seed: int = 42) -> ForestModel:
    """Forest on ``features`` of rows with a class number ``_y`` and a weight ``_w`` that the class decides.

    Each level is one pass over the packed rows, or several where the nodes to split need more than
    ``CELLS`` counts; a task holds some of its blocks and these counts, the driver the trees.
    """
    per_class = {int(r[0]): (r[1], r[2]) for r in rows.groupBy("_y").agg(F.max("_w"), F.count("*")).collect()}
    if not per_class:
        raise ValueError("no rows to learn from")
    if len(features) > 256:
        raise ValueError("at most 256 features")
    n_classes, n_rows = max(per_class) + 1, sum(n for _, n in per_class.values())
    weights = np.array([per_class.get(c, (0.0, 0))[0] for c in range(n_classes)], float)
    whole = rows.select(F.col("_y").cast("int").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    sample = (whole if n_rows <= SAMPLE else whole.sample(SAMPLE / n_rows, seed=seed)).toPandas()
    cuts = [cuts_of(sample[f].dropna().to_numpy(float), weights[sample["_y"][sample[f].notna()]]) for f in features]
    blocks = _packed(whole, features, cuts)
    bootstrap = trees > 1
    n_offered = ceil(sqrt(len(features))) if bootstrap else len(features)
    forest, room = [_Tree(n_classes) for _ in range(trees)], CELLS // (n_offered * BINS * n_classes)
    for level in range(depth):
        waiting = [t for t in range(trees) if len(forest[t].open)]
        while waiting:
            group, held = {}, 0
            while waiting and (not group or held + len(forest[waiting[0]].open) <= room):
                t = waiting.pop(0)
                tree = forest[t]
                slots = np.full(len(tree.nodes), -1, np.int64)
                slots[tree.open] = np.arange(len(tree.open))
                dice = np.random.default_rng([seed, t, level, 1]).random((len(tree.open), len(features)))
                group[t] = tree.nodes, slots, np.argsort(dice, axis=1)[:, :n_offered]
                held += len(tree.open)
            found = {t: np.full((len(g[2]), 2 + 2 * n_classes), -1, np.int64) for t, g in group.items()}
            for g in found.values():
                g[:, 2:] = 0  # a tree that drew no row keeps an empty root
            counted = _counts(blocks, group, level, len(features), n_classes, seed, bootstrap)
            for r in _split(counted, n_offered, n_classes, weights).collect():
                some = np.frombuffer(r["found"], np.int64).reshape(-1, 2 + 2 * n_classes)
                found[r["tree"]][r["chunk"] : r["chunk"] + len(some)] = some
            for t, (_, _, offered) in group.items():
                forest[t].grow(found[t], offered)
    return ForestModel(features, cuts, [(t.nodes, t.counts * weights, t.levels) for t in forest])


class ForestModel(Model, MLWritable, MLReadable):
    """Trees that vote with the class shares of the leaf a row falls into.

    Adds ``rawPrediction`` (sum of the votes by class), ``probability`` and ``_p``, the class number
    with the most; of equal ones the first.  A tree is its nodes (see ``routed``), the weight of
    each class in each node, and its number of levels.
    """

    def __init__(self, features: Sequence[str] = (), cuts: Sequence[np.ndarray] = (), trees: Sequence[tuple] = ()):
        super().__init__()
        self.features, self.cuts, self.trees = list(features), list(cuts), list(trees)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cuts, trees = self.cuts, []
        for nodes, counts, levels in self.trees:
            total = counts.sum(axis=1, keepdims=True)
            trees.append((nodes, counts / np.where(total > 0, total, 1.0), levels))

        @F.arrow_udf("array<double>")
        def votes(*columns: pa.Array) -> pa.Array:
            x = binned([c.to_numpy(zero_copy_only=False) for c in columns], cuts)
            rows, root, out = np.arange(x.shape[1]), np.zeros(x.shape[1], np.int64), np.zeros((x.shape[1], trees[0][1].shape[1]))
            for nodes, shares, levels in trees:
                out += shares.take(routed(x, rows, nodes, levels, root), axis=0)
            ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.reshape(-1)))

        v = F.col("_votes")
        total = F.greatest(F.aggregate(v, F.lit(0.0), lambda a, b: a + b), F.lit(1.0))
        return dataset.withColumn("_votes", votes(*[F.col(f).cast("double") for f in self.features])).withColumns({
            "rawPrediction": array_to_vector(v),
            "probability": array_to_vector(F.transform(v, lambda x: x / total)),
            "_p": (F.array_position(v, F.array_max(v)) - 1).cast("double"),
        }).drop("_votes")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        more = {"features": self.model.features, "cuts": [c.tolist() for c in self.model.cuts]}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=more)
        rows = [(i, levels, bytearray(nodes.tobytes()), bytearray(counts.tobytes())) for i, (nodes, counts, levels) in enumerate(self.model.trees)]
        self.sparkSession.createDataFrame(rows, "tree int, levels int, nodes binary, counts binary").write.parquet(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        trees = []
        for r in sorted(self.sparkSession.read.parquet(f"{path}/data").collect(), key=lambda r: r["tree"]):
            nodes = np.frombuffer(r["nodes"], np.int64)
            trees.append((nodes, np.frombuffer(r["counts"], float).reshape(len(nodes), -1), r["levels"]))
        model = ForestModel(meta["features"], [np.array(c, float) for c in meta["cuts"]], trees)
        model._resetUid(meta["uid"])
        return model
