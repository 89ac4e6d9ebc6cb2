"""Exact k nearest neighbours over two large tables.

Training rows form a tree of two levels: about the square root of the leaves as cells, each around a pivot, and as many leaves in
a cell around pivots of its own.  Pivots are training vectors chosen by hash; counts and radii of cells and leaves are all that
the driver holds, at most ``LEAVES`` of them.

A test row first meets the leaf it falls into.  Its k-th distance there (or what the cells' counts and radii promise, if that is
less) bounds its search: by the triangle inequality it then meets only leaves whose ball reaches into that distance, cells first, leaves of
those cells next.  Within a leaf both sides are cut into blocks of bounded size by a hash of the key, so a leaf that holds a third
of the rows becomes many blocks.  A task sees a pair of blocks and returns at most k rows per test row; no pair of rows is
ever emitted.  Copies of one training vector are reduced first to the k smallest keys, which is all that can matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cartwave.operators.sampling import key_hash
from cartwave.session import cut

# most leaves, rows of a leaf that are worth another one, and most rows per block: all fixed, whatever the data
LEAVES = 4096
LEAF = 512
BLOCK = 4096
SALTS = 64


def _away(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows x pivots."""
    out = np.empty((len(rows), len(pivots)))
    for i, p in enumerate(pivots):
        out[:, i] = np.sqrt(((rows - p) ** 2).sum(axis=1))
    return out


@dataclass
class PivotTree:
    """Pivots of the cells and of each cell's leaves; a leaf's number is ``first[cell]`` plus its place in the cell."""

    cells: np.ndarray
    leaves: list[np.ndarray]
    counts: np.ndarray | None = None  # rows per leaf
    radii: np.ndarray | None = None  # of the leaves, around their pivots
    cell_counts: np.ndarray | None = None
    cell_radii: np.ndarray | None = None

    @property
    def first(self) -> np.ndarray:
        return np.cumsum([0, *[len(p) for p in self.leaves]])

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, distance to its pivot, distance to the cell's pivot) of each row."""
        away = _away(rows, self.cells)
        cell = away.argmin(axis=1)
        leaf, near = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for c in np.unique(cell):
            at = np.flatnonzero(cell == c)
            inside = _away(rows[at], self.leaves[c])
            best = inside.argmin(axis=1)
            leaf[at], near[at] = self.first[c] + best, inside[np.arange(len(at)), best]
        return leaf, near, away[np.arange(len(rows)), cell]

    def reach(self, rows: np.ndarray, bound: np.ndarray, k: int) -> list[list[int]]:
        """Per row the leaves that may hold one of its k neighbours, all of which lie within ``bound``."""
        away = _away(rows, self.cells)
        far = np.where(self.cell_counts > 0, away + self.cell_radii, np.inf)
        order = far.argsort(axis=1)
        enough = (np.cumsum(self.cell_counts[order], axis=1) >= k).argmax(axis=1)
        promised = far[np.arange(len(rows)), order[np.arange(len(rows)), enough]]
        promised[self.cell_counts.sum() < k] = np.inf
        most = np.minimum(bound, promised)
        most = most + 1e-9 * (1 + np.where(np.isfinite(most), most, 0))
        out: list[list[int]] = [[] for _ in rows]
        open_ = (away - self.cell_radii <= most[:, None]) & (self.cell_counts > 0)
        for c in np.flatnonzero(open_.any(axis=0)):
            at = np.flatnonzero(open_[:, c])
            span = slice(self.first[c], self.first[c + 1])
            hit = (_away(rows[at], self.leaves[c]) - self.radii[span] <= most[at, None]) & (self.counts[span] > 0)
            for i, j in zip(*np.nonzero(hit), strict=True):
                out[at[i]].append(int(self.first[c] + j))
        return out


def _chosen(rows: DataFrame, each: int) -> DataFrame:
    """Up to ``each`` distinct vectors per cell, by hash of the smallest key."""
    once = rows.groupBy("cell", "x").agg(F.min("key").alias("key")).withColumn("_h", key_hash(["key"], 0))
    salted = once.withColumn("_s", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    return _pick(_pick(salted, ["cell", "_s"], ["_h", "key"], each), ["cell"], ["_h", "key"], each)


def _pivots(rows: DataFrame, n: int) -> PivotTree:
    """A tree with about n / LEAF leaves, at most ``LEAVES``, without counts."""
    leaves = max(1, min(LEAVES, n // LEAF))
    wide = ceil(sqrt(leaves))
    top = np.array([r["x"] for r in _chosen(rows.withColumn("cell", F.lit(0)), wide).select("x").collect()], dtype=float)
    if len(top) <= 1:
        return PivotTree(top, [top])

    @F.pandas_udf("int")
    def cell(x: pd.Series) -> pd.Series:
        return pd.Series(_away(np.stack(x.to_numpy()), top).argmin(axis=1) if len(x) else [], dtype="int32")

    found = _chosen(rows.select("key", "x", cell("x").alias("cell")), ceil(leaves / wide)).select("cell", "x").collect()
    inside = [np.array([r["x"] for r in found if r["cell"] == c], dtype=float).reshape(-1, top.shape[1]) for c in range(len(top))]
    # a cell that only its pivot's copies would have is a leaf of its own
    return PivotTree(top, [p if len(p) else top[c : c + 1] for c, p in enumerate(inside)])


def _placed(rows: DataFrame, tree: PivotTree) -> DataFrame:
    """Rows with ``leaf`` and the distances ``near`` to its pivot and ``wide`` to the cell's, stored."""

    @F.pandas_udf("leaf int, near double, wide double")
    def run(x: pd.Series) -> pd.DataFrame:
        found = tree.place(np.stack(x.to_numpy())) if len(x) else ([], [], [])
        return pd.DataFrame(dict(zip(("leaf", "near", "wide"), found, strict=True))).astype({"leaf": "int32"})

    return cut(rows.withColumn("_p", run("x")).select("*", "_p.*").drop("_p"))


def grown(rows: DataFrame) -> tuple[DataFrame, PivotTree]:
    """Training rows (key, label, x) with their leaves, and the tree with its counts and radii."""
    tree = _pivots(rows, rows.count())
    if len(tree.cells) == 0:
        raise ValueError("no training rows")
    placed = _placed(rows, tree)
    table = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("near").alias("r"), F.max("wide").alias("w")).collect()
    leaves, wide = tree.first[-1], np.zeros(tree.first[-1])
    tree.counts, tree.radii = np.zeros(leaves, np.int64), np.zeros(leaves)
    for r in table:
        tree.counts[r["leaf"]], tree.radii[r["leaf"]], wide[r["leaf"]] = r["n"], r["r"], r["w"]
    tree.cell_counts = np.add.reduceat(tree.counts, tree.first[:-1])
    tree.cell_radii = np.maximum.reduceat(wide, tree.first[:-1])
    return placed, tree


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows paired by broadcasting, summed feature by feature."""
    d = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for f in range(a.shape[-1]):
        d += (a[..., f] - b[..., f]) ** 2
    return d


def _least(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and places of the k nearest ``b`` of every ``a``, both rows x k; ties go to the earlier place.

    A matrix product gives distances up to a rounding error that is known; only rows that may be among the k nearest within that
    error are measured feature by feature.  Values that are not finite, or too large for the product, are measured so at once.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        centre = b.mean(axis=0)
        near_a, near_b = a - centre, b - centre
        size_a, size_b = (near_a**2).sum(axis=1), (near_b**2).sum(axis=1)
        rough = size_a[:, None] + size_b - 2 * (near_a @ near_b.T)
    error = 8 * (a.shape[1] + 8) * np.finfo(float).eps * (size_a + size_b.max())
    if not (np.isfinite(rough).all() and np.isfinite(error).all()):
        d = _squares(a[:, None], b[None])
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(d, order, 1), order
    edge = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * error
    row, place = np.nonzero(rough <= edge[:, None])
    d = _squares(a[row], b[place])
    order = np.lexsort((place, d, row))
    # every row has k candidates at least
    first = np.searchsorted(row, np.arange(len(a)))[:, None] + np.arange(k)
    return d[order][first], place[order][first]


def _block_neighbours(k: int):
    """Nearest k rows of one training block for every row of one test block."""

    def run(test: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        if len(test) == 0 or len(train) == 0:
            return pd.DataFrame({"test_id": [], "d": [], "key": [], "label": []})
        # rows are in key order, so ties go to the smaller key
        train = train.sort_values("key", kind="stable")
        a, b = np.stack(test["x"].to_numpy()), np.stack(train["x"].to_numpy())
        keys, labels = train["key"].to_numpy(), train["label"].to_numpy()
        ids = test["test_id"].to_numpy()
        take = min(k, len(b))
        parts = []
        step = max(1, 1_000_000 // len(b))
        for at in range(0, len(a), step):
            d, near = _least(a[at : at + step], b, take)
            parts.append((np.repeat(ids[at : at + step], take), d.ravel(), keys[near].ravel(), labels[near].ravel()))
        cols = [np.concatenate(c) for c in zip(*parts)]
        return pd.DataFrame(dict(zip(("test_id", "d", "key", "label"), cols)))

    return run


def _pick(rows: DataFrame, groups: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _met(asked: DataFrame, known: DataFrame, tree: PivotTree, k: int) -> DataFrame:
    """The k nearest rows that each (test_id, x, leaf) finds in its leaf, block by block."""
    counts = {r["leaf"]: r["n"] for r in asked.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = [(leaf, -(-n // BLOCK), -(-int(tree.counts[leaf]) // BLOCK)) for leaf, n in counts.items() if tree.counts[leaf]]
    types = dict(asked.dtypes)["test_id"], dict(known.dtypes)["key"]
    schema = f"test_id {types[0]}, d double, key {types[1]}, label double"
    if not blocks:
        return asked.sparkSession.createDataFrame([], schema)
    # at most LEAVES rows
    table = F.broadcast(asked.sparkSession.createDataFrame(blocks, "leaf int, tblocks long, sblocks long"))
    keys = ["leaf", "tblock", "sblock"]
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = (
        asked.join(table, "leaf").withColumn("tblock", F.pmod(F.xxhash64("test_id"), F.col("tblocks")))
        .withColumn("sblock", every("sblocks")).select(*keys, "test_id", "x")
    )
    right = (
        known.join(table, "leaf").withColumn("sblock", F.pmod(F.xxhash64("key"), F.col("sblocks")))
        .withColumn("tblock", every("tblocks")).select(*keys, "key", "label", "x")
    )
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_block_neighbours(k), schema)


def further_leaves(asked: DataFrame, own: DataFrame, tree: PivotTree, k: int) -> DataFrame:
    """(test_id, x, leaf): the leaves beyond its own that a test row must meet, given the neighbours found in its own."""

    @F.pandas_udf("array<int>")
    def reach(x: pd.Series, leaf: pd.Series, bound: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        found = []
        step = 1024
        for i in range(0, len(x), step):
            found += tree.reach(np.stack(x.to_numpy()[i : i + step]), bound.to_numpy()[i : i + step], k)
        return pd.Series([[v for v in f if v != mine] for f, mine in zip(found, leaf, strict=True)])

    kth = own.groupBy("test_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("d"))).otherwise(F.lit(float("inf"))).alias("bound")
    )
    bounded = asked.join(kth, "test_id", "left").fillna(float("inf"), ["bound"])
    return bounded.withColumn("leaf", F.explode(reach("x", "leaf", "bound"))).select("test_id", "x", "leaf")


def nearest_vectors(known: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest of ``known`` (key, label, x) per row of ``asked`` (test_id, x): ``test_id, d, key, label``."""
    # copies of a vector: the k smallest keys per salt, then per vector
    salted = known.withColumn("_s", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    reduced = cut(_pick(_pick(salted, ["x", "_s"], ["key"], k), ["x"], ["key"], k).drop("_s"))
    placed, tree = grown(reduced)
    waiting = _placed(asked, tree)
    own = _pick(_met(waiting.select("test_id", "x", "leaf"), placed, tree, k), ["test_id"], ["d", "key"], k)
    if len(tree.counts) == 1:
        return own
    own = cut(own)
    further = cut(further_leaves(waiting, own, tree, k))
    return _pick(own.unionByName(_met(further, placed, tree, k)), ["test_id"], ["d", "key"], k)


def nearest(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    k: int,
    train_key: str,
    test_key: str,
    target: str = "target",
) -> DataFrame:
    """The k nearest training rows per test row: ``test_id, d, key, label``.

    ``d`` is the squared Euclidean distance; ties go to the smaller training key.
    """
    x = F.array(*[F.col(f).cast("double") for f in features])
    known = train.select(F.col(train_key).alias("key"), F.col(target).cast("double").alias("label"), x.alias("x"))
    return nearest_vectors(known, test.select(F.col(test_key).alias("test_id"), x.alias("x")), k)


def vote(neighbours: DataFrame, test_key: str) -> DataFrame:
    """Most frequent label among the neighbours, the smaller one on a tie; ``score`` is the share of label 1."""
    return (
        neighbours.groupBy("test_id", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("test_id")
        .agg(
            F.max_by("label", F.struct("n", -F.col("label"))).alias("prediction"),
            (F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("score"),
        )
        .withColumnRenamed("test_id", test_key)
    )


def average(neighbours: DataFrame, test_key: str) -> DataFrame:
    """Mean label of the neighbours."""
    return (
        neighbours.groupBy("test_id")
        .agg(F.avg("label").alias("prediction"))
        .withColumnRenamed("test_id", test_key)
    )
