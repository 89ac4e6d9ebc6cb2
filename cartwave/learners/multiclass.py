"""Boosting over thousands of classes, for many train/test splits at once.

A row is stored once: its bins, its class (0 to classes - 1) and, per split, whether the split trains on it.  Only a model of fixed size
lives on the driver; weights and probabilities of a row follow from its bins and the model, so no round writes anything per row.
Each round is one or a few jobs over the stored rows that serve all splits:

* ``boost_stumps`` (SAMME): tasks sum the rows' weights per (split, feature, bin, class); a task hands on one row per (split, feature),
  whatever the number of its rows, and the sums of a (split, feature), at most bins x classes, give its best stump by Gini impurity.
* ``boost_softmax``: one tree per round whose leaves hold a value per class, in place of a tree per class.  Splits are scored on the
  gradient of the softmax loss projected to ``SKETCH`` random directions, so histograms do not grow with the classes; leaf values are
  exact Newton steps per class.  Rows that take the same path through all trees share their probabilities, which are worked out once
  per path and not per row.

Sums are plain aggregates with partial sums per task: nothing is gathered per class or node beyond the bins' table, which depends on the
grid and not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwave.session import cut

BINS = 32
SKETCH = 8
CHUNK = 32  # rows whose probabilities a task holds at once, few enough for a core's cache
GATHER = 1 << 17  # rows that a task sums at once
HELD = 1 << 24  # sums per (split, feature, bin, class) that a task holds
_TINY = 1e-10


@dataclass(frozen=True)
class Edges:
    """Range of each feature; a value's bin is its place in 32 equal parts of the range, values outside go to the ends."""

    low: tuple[float, ...]
    high: tuple[float, ...]

    def bins_of(self, features: Sequence[str]):
        one = [
            F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col(f).cast("double") - a) / (b - a) * BINS))).cast("int")
            if b > a else F.lit(0)
            for f, a, b in zip(features, self.low, self.high, strict=True)
        ]
        return F.array(*one)


def edges_of(rows: DataFrame, features: Sequence[str]) -> Edges:
    low, high = ([f(F.col(c).cast("double")) for c in features] for f in (F.min, F.max))
    found = list(rows.agg(*[x.alias(f"c{i}") for i, x in enumerate([*low, *high])]).first())
    return Edges(tuple(found[: len(features)]), tuple(found[len(features) :]))


@dataclass(frozen=True)
class Quantiles:
    """Up to 31 cuts of each feature at even shares of its rows; a value's bin is how many cuts lie below it."""

    cuts: tuple[tuple[float, ...], ...]

    def bins_of(self, features: Sequence):
        def below(feature, cuts):
            return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < feature)) if cuts else F.lit(0)

        return F.array(*map(below, features, self.cuts))


def quantiles_of(rows: DataFrame, features: Sequence) -> Quantiles:
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(f, shares).alias(f"c{i}") for i, f in enumerate(features)]).first()
    # nothing lies above the largest value
    tops = rows.agg(*[F.max(f).alias(f"c{i}") for i, f in enumerate(features)]).first()
    return Quantiles(tuple(tuple(sorted({c for c in cuts or () if c < top})) for cuts, top in zip(found, tops, strict=True)))


def prepared(rows: DataFrame, features: Sequence[str], target: str, trains: Sequence, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, class, bins, trains) stored; ``trains`` are boolean columns, one per split.  A null feature counts as its lowest value."""
    edges = edges_of(rows, features)
    bins = F.transform(edges.bins_of(features), lambda b: F.coalesce(b, F.lit(0)))
    return cut(rows.select(*keep, F.col(target).cast("int").alias("class"), bins.alias("bins"), F.array(*trains).alias("trains")))


def few_parts(rows: DataFrame) -> DataFrame:
    """No more parts than cores: a task's sums are as large as the table of cells, however few rows it has."""
    return rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))


def _arrays(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(batch):
        return np.zeros((0, 0), int), np.zeros(0, int), np.zeros((0, 0), bool)
    return (
        np.stack(batch["bins"].to_numpy()).astype(np.int64), batch["class"].to_numpy().astype(np.int64),
        np.stack(batch["trains"].to_numpy()).astype(bool),
    )


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of an Arrow batch that has rows, without an object per row; bins are bytes."""
    bins, trains = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("bins", "trains"))
    return bins.astype(np.uint8), batch.column("class").to_numpy(zero_copy_only=False).astype(np.int64), trains.astype(bool)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bins, classes, trains) of about ``GATHER`` rows at a time."""
    held: list[tuple] = []
    for batch in batches:
        if batch.num_rows:
            held.append(_matrices(batch))
        if sum(len(own) for _, own, _ in held) >= GATHER:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


# -- stumps ------------------------------------------------------------------------


@dataclass(frozen=True)
class Stump:
    feature: int
    bin: int  # rows up to this bin go left
    left: int  # class of each side
    right: int
    error: float
    alpha: float = 0.0

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.where(bins[:, self.feature] <= self.bin, self.left, self.right)


def _weights(stumps: Sequence[Stump], bins: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Boosting weights up to a factor, at most 1."""
    power = np.zeros(len(bins))
    for s in stumps:
        power += s.alpha * ((s.predict(bins) != classes) - 1.0)
    return np.exp(np.maximum(power, -700))


def cell_sums(bins: np.ndarray, own: np.ndarray, w: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the cells (feature, bin, class) that hold rows, in order, and the sums of the weights in them."""
    nf = bins.shape[1]
    if BINS * classes <= 16 * len(bins):
        # few cells for the rows: counted without sorting; no weight is zero
        held = np.concatenate([np.bincount(b.astype(np.int64) * classes + own, w, BINS * classes) for b in bins.T])
        keys = np.flatnonzero(held)
        return keys, held[keys]
    place = (np.arange(nf) * BINS + bins) * classes + own[:, None]
    keys, back = np.unique(place, return_inverse=True)
    return keys, np.bincount(back.ravel(), np.repeat(w, nf))


def best_stump(held: np.ndarray) -> tuple[float, int, int, int, float]:
    """(gain, bin, left, right, error) of the best cut of one feature from its sums (bins x classes); no cut: all go left.

    The gain is the sum of squared class weights over the weight, of both sides, so that the largest gain has the least impurity.
    """
    left = np.cumsum(held, axis=0)
    total = left[-1]
    right = total - left
    a, b = left.sum(1), right.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left * left).sum(1) / a + (right * right).sum(1) / b
    gain[(a <= 0) | (b <= _TINY * total.sum())] = -1.0
    at = int(np.argmax(gain))
    if gain[at] < 0:
        at = BINS - 1
    sides = int(np.argmax(left[at])), int(np.argmax(right[at]) if gain[at] >= 0 else np.argmax(total))
    hit = left[at, sides[0]] + (right[at, sides[1]] if gain[at] >= 0 else 0.0)
    return float(gain[at]), at, *sides, float(1 - hit / total.sum())


def _width(rows: DataFrame) -> int:
    """Number of features, 0 without rows."""
    first = rows.select(F.size("bins").alias("n")).first()
    return first["n"] if first else 0


def stump_round(
    rows: DataFrame, classes: int, known: Sequence[Sequence[Stump]], open_: Sequence[int], nf: int | None = None
) -> dict[int, Stump]:
    """The best next stump of each open split, without its weight."""
    known, open_ = [list(k) for k in known], list(open_)

    cells = (_width(rows) if nf is None else nf) * BINS * classes
    if not cells or not open_:
        return {}

    def sums_of(some: Sequence[int]):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for bins, own, trains in _gathered(batches):
                for s in some:
                    at = trains[:, s]
                    if at.any():
                        b, c = bins[at], own[at]
                        keys, w = cell_sums(b, c, _weights(known[s], b, c), classes)
                        held.setdefault(s, np.zeros(cells))[keys] += w
            for s, table in held.items():
                features = table.reshape(-1, BINS * classes)
                places = [np.flatnonzero(f) for f in features]
                edges = np.cumsum([0, *map(len, places)]).astype(np.int32)
                columns = (np.concatenate(places).astype(np.int32), np.concatenate([f[at] for f, at in zip(features, places, strict=True)]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(features), s, np.int32)), pa.array(np.arange(len(features), dtype=np.int32)),
                    *(pa.ListArray.from_arrays(edges, pa.array(c)) for c in columns),
                ], ["split", "feature", "place", "w"])

        return sums

    def best(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(BINS * classes)
        for place, w in zip(table["place"], table["w"], strict=True):
            held[place] += w
        return pd.DataFrame([(*key, *best_stump(held.reshape(BINS, classes)))], columns=["split", "feature", "gain", "bin", "left", "right", "error"])

    # as many splits in a pass as a task can hold the sums of
    step, found = max(1, HELD // cells), []
    for i in range(0, len(open_), step):
        tables = few_parts(rows.select("class", "bins", "trains")).mapInArrow(
            sums_of(open_[i : i + step]), "split int, feature int, place array<int>, w array<double>")
        found += tables.groupBy("split", "feature").applyInPandas(
            best, "split int, feature int, gain double, bin int, left int, right int, error double").collect()
    out: dict[int, tuple[float, Stump]] = {}
    for r in sorted(found, key=lambda r: r["feature"]):
        if r["split"] not in out or r["gain"] > out[r["split"]][0]:
            out[r["split"]] = r["gain"], Stump(r["feature"], r["bin"], r["left"], r["right"], r["error"])
    return {s: stump for s, (_, stump) in out.items()}


def boost_stumps(rows: DataFrame, classes: int, splits: int, rounds: int = 50, rate: float = 1.0) -> list[list[Stump]]:
    """SAMME per split: a list of weighted stumps."""
    done: list[list[Stump]] = [[] for _ in range(splits)]
    open_, nf = list(range(splits)), _width(rows)
    for _ in range(rounds):
        found = stump_round(rows, classes, done, open_, nf)
        still = []
        for s in open_:
            stump = found.get(s)
            if stump is None:
                continue
            # a stump that is no better than a guess ends the split's boosting
            if stump.error >= 1 - 1 / max(classes, 2) and done[s]:
                continue
            alpha = rate * (log((1 - stump.error + _TINY) / (stump.error + _TINY)) + log(max(classes - 1, 1)))
            done[s].append(Stump(stump.feature, stump.bin, stump.left, stump.right, stump.error, max(alpha, _TINY)))
            if stump.error > _TINY:
                still.append(s)
        open_ = still
        if not open_:
            break
    return done


def stump_classes(stumps: Sequence[Stump], classes: int) -> Callable[[np.ndarray], np.ndarray]:
    """Class with the largest vote per row of bins, the smaller one on a tie."""

    def some(bins: np.ndarray) -> np.ndarray:
        votes = np.zeros((len(bins), classes))
        for s in stumps:
            votes[np.arange(len(bins)), s.predict(bins)] += s.alpha
        return votes.argmax(1)

    def run(bins: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(some(bins[i : i + CHUNK]) for i in range(0, len(bins), CHUNK))])

    return run


# -- softmax trees -----------------------------------------------------------------


@dataclass
class VectorTree:
    """A tree in heap order: node n splits on (feature, bin) into 2n and 2n + 1; leaves hold one value per class."""

    depth: int
    feature: np.ndarray
    bin: np.ndarray
    values: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        at = np.ones(len(bins), np.int64)
        for _ in range(levels):
            at = 2 * at + (bins[np.arange(len(bins)), self.feature[at]] > self.bin[at])
        return at

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        return self.nodes(bins, self.depth) - (1 << self.depth)


@dataclass
class SoftmaxModel:
    prior: np.ndarray
    rate: float
    trees: list[VectorTree]

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.repeat(self.prior[None], len(bins), 0)
        for t in self.trees:
            step = t.values[t.leaves(bins)]
            step *= self.rate
            out += step
        return out

    def paths(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a row of each path through all trees, the path of each row)."""
        code, span = np.zeros(len(bins), np.int64), 1
        for t in self.trees:
            if span << t.depth > 1 << 62:
                held, code = np.unique(code, return_inverse=True)
                span = len(held)
            code, span = (code << t.depth) + t.leaves(bins), span << t.depth
        _, first, back = np.unique(code, return_index=True, return_inverse=True)
        return first, back

    def probabilities(self, bins: np.ndarray) -> np.ndarray:
        p = self.scores(bins)
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p


def _training(batches: Iterator[pa.RecordBatch], splits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(split, bins, classes) of the rows that a split trains on."""
    for bins, own, trains in _gathered(batches):
        for s in range(splits):
            at = trains[:, s]
            if at.any():
                yield s, bins[at], own[at]


def _level(rows: DataFrame, models: list[SoftmaxModel], growing: list[VectorTree], level: int, nf: int, sketch: np.ndarray) -> None:
    """Choose the splits of the nodes of one level of all splits' trees."""
    k, splits = sketch.shape[1], len(models)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for s, bins, own in _training(batches, splits):
            first, path = models[s].paths(bins)
            mean = np.concatenate([models[s].probabilities(bins[first[i : i + CHUNK]]) @ sketch for i in range(0, len(first), CHUNK)])
            values = [*(sketch[own] - mean[path]).T, np.ones(len(own))]
            node = growing[s].nodes(bins, level) - (1 << level)
            held = tables.setdefault(s, np.zeros((k + 1, 1 << level, nf, BINS)))
            for f in range(nf):
                place = node * BINS + bins[:, f]
                for held_one, value in zip(held, values, strict=True):
                    held_one[:, f] += np.bincount(place, value, BINS << level).reshape(-1, BINS)
        for s, held in tables.items():
            held = held.reshape(k + 1, -1)
            used = np.flatnonzero(held[k])
            edges = np.arange(0, len(used) * (k + 1) + 1, k + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used), s, np.int32)), pa.array(used.astype(np.int64)),
                pa.ListArray.from_arrays(edges, pa.array(held[:, used].T.ravel())),
            ], ["split", "place", "sums"])

    out = rows.mapInArrow(sums, "split int, place long, sums array<double>")
    total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(k + 1)]
    found = out.groupBy("split", "place").agg(*total).toPandas()
    for s, table in found.groupby("split"):
        held = np.zeros(((1 << level) * nf * BINS, k + 1))
        held[table["place"].to_numpy()] = table[[f"s{i}" for i in range(k + 1)]].to_numpy()
        left = held.reshape(1 << level, nf, BINS, k + 1).cumsum(2)
        right = left[:, :, -1:] - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sum((x[..., :k] ** 2).sum(-1) / x[..., k] for x in (left, right))
        gain[(left[..., k] <= 0) | (right[..., k] <= 0)] = -1
        for node in range(1 << level):
            f, b = np.unravel_index(int(np.argmax(gain[node])), gain[node].shape)
            at = (1 << level) + node
            # a node that cannot be cut sends all rows left
            growing[s].feature[at], growing[s].bin[at] = (f, b) if gain[node, f, b] >= 0 else (0, BINS)


def _leaf_values(rows: DataFrame, models: list[SoftmaxModel], growing: list[VectorTree], classes: int) -> None:
    """Newton steps per leaf and class: (K - 1) / K * sum of y - p / sum of p (1 - p)."""
    splits, leaves = len(models), 1 << growing[0].depth

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for s, bins, own in _training(batches, splits):
            first, path = models[s].paths(bins)
            leaf = growing[s].leaves(bins)
            held = tables.setdefault(s, np.zeros((2, leaves, classes)))
            held[0] += np.bincount(leaf * classes + own, minlength=leaves * classes).reshape(leaves, classes)
            met = np.bincount(leaf * len(first) + path, minlength=leaves * len(first)).reshape(leaves, -1).astype(float)
            for i in range(0, len(first), CHUNK):
                p = models[s].probabilities(bins[first[i : i + CHUNK]])
                held[0] -= met[:, i : i + CHUNK] @ p
                held[1] += met[:, i : i + CHUNK] @ (p * (1 - p))
        for s, held in tables.items():
            leaf, c = np.nonzero(held[1])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.astype(np.int32)) for x in (np.full(len(leaf), s), leaf, c)), *(pa.array(h[leaf, c]) for h in held)],
                ["split", "leaf", "class", "up", "down"],
            )

    out = rows.mapInArrow(sums, "split int, leaf int, class int, up double, down double")
    found = out.groupBy("split", "leaf", "class").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).toPandas()
    for t in growing:
        t.values = np.zeros((leaves, classes))
    for s, t in found.groupby("split"):
        step = (classes - 1) / classes * t["up"].to_numpy() / np.maximum(t["down"].to_numpy(), 1e-150)
        growing[s].values[t["leaf"].to_numpy(), t["class"].to_numpy()] = step


def boost_softmax(
    rows: DataFrame, classes: int, splits: int, rounds: int = 10, depth: int = 3, rate: float = 0.1, seed: int = 0, sketch: int = SKETCH
) -> list[SoftmaxModel]:
    """Softmax boosting per split with vector-valued trees."""
    counts = (
        rows.select("class", F.posexplode("trains").alias("split", "in")).where("in")
        .groupBy("split", "class").agg(F.count(F.lit(1)).alias("n")).toPandas()
    )
    models = []
    for s in range(splits):
        mine = counts[counts["split"] == s]
        prior = np.zeros(classes)
        prior[mine["class"].to_numpy(int)] = mine["n"].to_numpy()
        models.append(SoftmaxModel(np.log(np.maximum(prior / max(prior.sum(), 1), 1e-12)), rate, []))
    rng = np.random.default_rng(seed)
    rows = few_parts(rows.select("class", "bins", "trains"))
    nf = _width(rows) or 1
    for _ in range(rounds):
        directions = rng.normal(size=(classes, sketch)) / np.sqrt(sketch) if sketch < classes else np.eye(classes)
        growing = [VectorTree(depth, np.zeros(1 << depth, np.int64), np.full(1 << depth, BINS)) for _ in range(splits)]
        for level in range(depth):
            _level(rows, models, growing, level, nf, directions)
        _leaf_values(rows, models, growing, classes)
        for m, t in zip(models, growing, strict=True):
            m.trees.append(t)
    return models


def softmax_classes(model: SoftmaxModel) -> Callable[[np.ndarray], np.ndarray]:
    def run(bins: np.ndarray) -> np.ndarray:
        first, path = model.paths(bins)
        found = [model.scores(bins[first[i : i + CHUNK]]).argmax(1) for i in range(0, len(first), CHUNK)]
        return np.concatenate([np.zeros(0, np.int64), *found])[path]

    return run


# -- prediction ----------------------------------------------------------------------


def predicted(rows: DataFrame, deciders: Sequence[Callable[[np.ndarray], np.ndarray]], key: str) -> DataFrame:
    """(split, key, prediction) of the rows that each split leaves out."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins, own, trains = _arrays(batch)
            for s in range(len(deciders)) if len(own) else ():
                at = np.flatnonzero(~trains[:, s])
                if len(at):
                    yield pd.DataFrame({"split": np.int32(s), key: batch[key].to_numpy()[at], "prediction": deciders[s](bins[at]).astype(np.int32)})

    return rows.mapInPandas(run, f"split int, {key} {kind}, prediction int")
