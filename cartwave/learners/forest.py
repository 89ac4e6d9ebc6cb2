"""One regression forest per group, all groups grown at once by aggregation.

Trees grow level by level: every row walks to its node, contributes to a histogram
per (tree, node, feature, bin), and the histograms give the best split of every open
node.

A group of at most ``WHOLE_ROWS`` rows times trees is grown where its rows meet after
one shuffle, all levels and trees at once; it is small by that bound, however many
groups there are.  A larger group is never gathered in one task.  For those a level is
one pass over their rows; histograms are sums, combined on the map side, and only the
split table (groups x trees x 2^depth rows) is carried between levels; it is written
to the shared folder each time, and the rows are read again from the binned table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from cartwave.operators.joins import spread_join
from cartwave.session import cut

# a model table is broadcast only if its arrays together stay below this size
BROADCAST_BYTES = 64_000_000

# a group is grown in one task if its rows times the trees are no more than this
WHOLE_ROWS = 200_000


def _small_rows(trees: int, depth: int, outputs: int) -> int:
    """How many groups' models fit a broadcast; a model's size is fixed."""
    return BROADCAST_BYTES // (trees * (1 << depth + 1) * 8 * (1 + outputs))


# fixed values: distribution function of Poisson(1) at 0..5, for bootstrap weights
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)


@dataclass(frozen=True)
class GroupedForest:
    """Grown trees: per group the bin edges, split codes and node means of all trees."""

    model: DataFrame
    groups: tuple[str, ...]
    features: tuple[str, ...]
    outputs: tuple[str, ...]
    row_id: str
    trees: int
    depth: int
    bins: int

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``pred_<output>``; null where the group has no model."""
        packed = rows.withColumn("_x", F.array(*[F.col(f).cast("double") for f in self.features]))
        small = _small_rows(self.trees, self.depth, len(self.outputs))
        joined = spread_join(packed, self.model, self.groups, [self.row_id], small_rows=small)
        full = (1 << self.depth + 1) - 1
        walked = joined.withColumn("_b", F.expr(_bin_sql(self.bins))).withColumn(
            "_node", F.expr(_walk_sql(self.trees, self.depth, self.depth))
        )
        means = {}
        for j, name in enumerate(self.outputs):
            # trees that saw no row of the group have no mean and do not vote
            votes = f"filter(transform(_node, (n, t) -> mean{j}[t * {full} + n - 1]), v -> v is not null)"
            means[f"pred_{name}"] = F.expr(
                f"aggregate({votes}, 0D, (a, v) -> a + v) / nullif(size({votes}), 0)"
            )
        used = [f"mean{j}" for j in range(len(self.outputs))]
        return walked.withColumns(means).drop("_x", "_b", "_node", "lo", "hi", "codes", *used)


def _bin_sql(bins: int) -> str:
    """Bin of each feature on the group's own range, -1 for a constant feature.

    Values outside the range are clamped.
    """
    return (
        "transform(_x, (v, i) -> case when hi[i] > lo[i] then "
        f"cast(greatest(0, least({bins - 1}, floor((v - lo[i]) / (hi[i] - lo[i]) * {bins}))) as int) "
        "else -1 end)"
    )


def _walk_sql(trees: int, depth: int, steps: int) -> str:
    """Per tree the node reached after ``steps`` levels, or where its path ends.

    ``codes`` holds feature * 64 + bin of the split of every node, null or -1 for none.
    """
    size = (1 << depth) - 1
    code = f"codes[t * {size} + n - 1]"
    return (
        f"transform(sequence(0, {trees - 1}), t -> aggregate(sequence(1, {steps}), 1, (n, d) -> "
        f"case when coalesce({code}, -1) < 0 then n else "
        f"2 * n + cast(_b[shiftright({code}, 6)] > ({code} & 63) as int) end))"
    )


def fit_grouped_forest(
    rows: DataFrame,
    groups: Sequence[str],
    features: Sequence[str],
    outputs: Sequence[str],
    row_id: str,
    trees: int = 10,
    depth: int = 5,
    bins: int = 16,
    feature_share: float = 1 / 3,
    seed: int = 0,
) -> GroupedForest:
    """Fit ``trees`` trees of ``depth`` levels per group on bootstrap weights.

    Each node looks at a random third of the features that vary within the group.
    """
    if bins > 64:
        raise ValueError("a split's code has room for 64 bins")
    groups, features, outputs = tuple(groups), tuple(features), tuple(outputs)
    k = len(outputs)
    packed = rows.select(
        *groups,
        row_id,
        F.array(*[F.col(f).cast("double") for f in features]).alias("_x"),
        *[F.col(o).cast("double").alias(f"y{j}") for j, o in enumerate(outputs)],
    )
    finite = [F.coalesce(F.abs(F.col(f"y{j}")) < float("inf"), F.lit(False)) for j in range(k)]
    # materialised once: the edges are needed by every join below
    known = cut(
        packed.groupBy(*groups).agg(
            F.array(*[F.min(F.col("_x")[i]) for i in range(len(features))]).alias("lo"),
            F.array(*[F.max(F.col("_x")[i]) for i in range(len(features))]).alias("hi"),
            F.count(F.lit(1)).alias("_rows"),
            F.min(reduce(and_, finite)).alias("_finite"),
        )
    )
    whole = F.col("_finite") & (F.col("_rows") * trees <= WHOLE_ROWS) & F.lit(bool(features))
    options = (groups, row_id, len(features), trees, depth, bins, k, feature_share, seed)
    small, large = (known.where(c).drop("_finite") for c in (whole, ~whole))
    parts = [grow(packed, some, *options) for grow, some in ((_grown_whole, small), (_grown_by_level, large)) if not some.isEmpty()]
    model = reduce(DataFrame.unionByName, parts or [_grown_by_level(packed, large, *options)])
    return GroupedForest(
        cut(model),
        groups, features, outputs, row_id, trees, depth, bins,
    )


def _binned(packed: DataFrame, known: DataFrame, groups: tuple[str, ...], row_id: str, bins: int) -> DataFrame:
    """The rows of the known groups with the bins of their features."""
    weights, edges = known.select(*groups, "_rows"), known.drop("_rows")
    return (
        spread_join(packed, edges, groups, [row_id], how="inner", weights=weights)
        .withColumn("_b", F.expr(_bin_sql(bins)))
        .drop("_x", "lo", "hi")
    )


def _copies(row_id: str, tree: Column, seed: int) -> Column:
    """How often a tree's bootstrap sample holds a row."""
    u = F.pmod(F.xxhash64(F.lit(seed), tree, row_id), F.lit(1 << 20)) / float(1 << 20)
    w = F.lit(len(POISSON))
    for n in range(len(POISSON) - 1, -1, -1):
        w = F.when(u < POISSON[n], n).otherwise(w)
    return w.cast("double")


# -- groups that fit a task --------------------------------------------------------


def _grown_whole(
    packed: DataFrame, known: DataFrame, groups: tuple[str, ...], row_id: str, nf: int,
    trees: int, depth: int, bins: int, k: int, feature_share: float, seed: int,
) -> DataFrame:
    """Models of groups of bounded size: one shuffle brings the rows of a group together."""
    size = (1 << depth) - 1
    ys = [f"y{j}" for j in range(k)]
    rows = _binned(packed, known, groups, row_id, bins).select(
        *groups, "_b", F.array(*[_copies(row_id, F.lit(t), seed) for t in range(trees)]).alias("_w"), *ys
    )
    # the features that each node looks at are worked out once per group
    node = ", ".join([
        *[f"`{g}`" for g in groups], f"cast(i div {size * nf} as int)", f"cast(i div {nf} % {size} + 1 as int)", f"cast(i % {nf} as int)",
    ])
    looks = f"transform(sequence(0, {trees * size * nf - 1}), i -> pmod(xxhash64({seed + 1}, {node}), 1000) < {int(1000 * feature_share)})"
    told = known.drop("_rows").withColumn("_looks", F.expr(looks))
    kept = [*groups, "lo", "hi"]
    means = [f"mean{j}" for j in range(k)]
    schema = known.select(*kept).schema.add("codes", ArrayType(IntegerType()))
    for name in means:
        schema = schema.add(name, ArrayType(DoubleType()))

    def flat(table: pa.Table, name: str, *shape: int) -> np.ndarray:
        return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(*shape)

    def grow(held: pa.Table, group: pa.Table) -> pa.Table:
        out = group.select(kept)
        lists = [[]] * (1 + k)
        if held.num_rows and group.num_rows:
            y = np.stack([held[c].to_numpy() for c in ys])
            codes, found = grown_trees(
                flat(held, "_b", -1, nf), flat(held, "_w", -1, trees), y, flat(group, "_looks", trees, size, nf), bins
            )
            lists = [pa.array(x, from_pandas=True) for x in (codes, *found)]
        if not len(lists[0]) or lists[0].null_count == len(lists[0]):
            out, lists = out.slice(0, 0), None
        for i, (name, kind) in enumerate([("codes", pa.int32()), *[(m, pa.float64()) for m in means]]):
            value = pa.array([], pa.list_(kind)) if lists is None else pa.ListArray.from_arrays([0, len(lists[i])], lists[i].cast(kind))
            out = out.append_column(name, value)
        return out

    # growing costs far more than the bytes of a row suggest, so the number of parts is stated
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, told = (df.repartition(parts, *groups) for df in (rows, told))
    return rows.groupBy(*groups).cogroup(told.groupBy(*groups)).applyInArrow(grow, schema)


def grown_trees(
    b: np.ndarray, w: np.ndarray, y: np.ndarray, looks: np.ndarray, bins: int
) -> tuple[np.ndarray, np.ndarray]:
    """Split codes and node means of one group's trees, NaN for none.

    ``b`` has the bins (rows x features), ``w`` the copies (rows x trees), ``y`` the targets (outputs x rows) and ``looks`` the
    features that a node looks at (trees x nodes x features).
    """
    trees, size, _ = looks.shape
    codes, means = np.full((trees, size), np.nan), np.full((len(y), trees, 2 * size + 1), np.nan)
    row, tree = np.nonzero(w > 0)
    varies = np.flatnonzero(b.max(0) >= 0)
    b, weight, node = b[row], w[row, tree], np.zeros(len(row), np.int64)
    values = weight * y[:, row]
    total = np.bincount(tree, weight, trees)
    seen = total > 0
    # every root needs its mean, also where nothing can be split
    codes[seen, 0] = -1
    for j, v in enumerate(values):
        means[j, seen, 0] = np.bincount(tree, v, trees)[seen] / total[seen]
    level, nv = 0, len(varies)
    while (1 << level) <= size and nv:
        first, wide = (1 << level) - 1, 1 << level
        at = np.flatnonzero(node >= first)
        if not len(at):
            break
        place = ((tree[at] * wide + node[at] - first)[:, None] * nv + np.arange(nv)) * bins + b[at][:, varies]
        n, *sums = (
            np.bincount(place.ravel(), np.repeat(v[at], nv), trees * wide * nv * bins).reshape(trees * wide, nv, bins) for v in (weight, *values)
        )
        left = n.cumsum(2)
        all_ = left[..., -1:]
        looked = looks[:, first : first + wide][..., varies].reshape(trees * wide, nv, 1)
        if level == 0:
            looked = looked | (varies == 0)[:, None]
        # most cells are empty or not looked at: gains are worked out for the others alone
        cell = np.nonzero((n > 0) & (all_ > left) & looked)
        whole = (*cell[:2], -1)
        nl, nt = left[cell], left[whole]
        gain, sides = np.full(n.shape, -1.0), []
        found = 0.0
        for s in (s.cumsum(2) for s in sums):
            sl, st = s[cell], s[whole]
            # added in the order of the SQL below, so that equal gains are told apart in the same way
            found = found + sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt
            sides.append(s)
        gain[cell] = found
        gain = gain.reshape(trees * wide, nv * bins)
        best = gain.argmax(1)
        split = np.flatnonzero(gain[np.arange(trees * wide), best] > 1e-9)
        best, of, here = best[split], split // wide, split % wide + first
        v, s = best // bins, best % bins
        codes[of, here] = varies[v] * 64 + s
        nl, nt = left[split, v, s], left[split, v, -1]
        for j, x in enumerate(sides):
            means[j, of, 2 * here + 1] = x[split, v, s] / nl
            means[j, of, 2 * here + 2] = (x[split, v, -1] - x[split, v, s]) / (nt - nl)
        code = codes[tree[at], node[at]]
        go = at[code >= 0]
        code = code[code >= 0].astype(np.int64)
        node[go] = 2 * node[go] + 1 + (b[go, code >> 6] > (code & 63))
        level += 1
    return codes.ravel(), means.reshape(len(y), -1)


# -- groups of any size, level by level --------------------------------------------


def _grown_by_level(
    packed: DataFrame, known: DataFrame, groups: tuple[str, ...], row_id: str, nf: int,
    trees: int, depth: int, bins: int, k: int, feature_share: float, seed: int,
) -> DataFrame:
    """Models of groups of any size: each level sums histograms over all rows."""
    weights, edges = known.select(*groups, "_rows"), known.drop("_rows")
    # read once per level, so it is stored evenly by row, whatever the group sizes
    binned = cut(_binned(packed, known, groups, row_id, bins), row_id)
    splits = None
    for level in range(depth):
        if splits is None:
            walked = binned.withColumn("_node", F.array_repeat(F.lit(1), trees))
        else:
            model = _codes(splits, edges, groups, trees, depth)
            walked = spread_join(
                binned, model, groups, [row_id], "inner", weights, _small_rows(trees, depth, 0)
            ).withColumn("_node", F.expr(_walk_sql(trees, depth, level)))
        found = _best_splits(walked, groups, row_id, level, k, feature_share, seed)
        grown = cut(found if splits is None else splits.unionByName(found))
        splits = grown
    return _codes(splits, edges, groups, trees, depth).join(
        _means(splits, groups, trees, depth, k), list(groups)
    )


def _best_splits(
    walked: DataFrame,
    groups: tuple[str, ...],
    row_id: str,
    level: int,
    k: int,
    feature_share: float,
    seed: int,
) -> DataFrame:
    """Best split per open node of this level, with the means on both sides.

    The histograms are plain sums per (node, feature, bin); running totals over the
    at most ``bins`` bins of a feature give every candidate split.
    """
    ys = [f"y{j}" for j in range(k)]
    node = (*groups, "tree", "node")
    per_tree = walked.select(
        *groups, row_id, "_b", *ys, F.posexplode("_node").alias("tree", "node")
    ).where(F.col("node") >= 1 << level)
    weighted = per_tree.withColumn("_w", _copies(row_id, F.col("tree"), seed)).where("_w > 0")
    pick = F.pmod(F.xxhash64(F.lit(seed + 1), *node, "f"), F.lit(1000))
    chosen = (F.col("bin") >= 0) & (pick < int(1000 * feature_share))
    if level == 0:
        # every root needs its mean, also where nothing can be split
        chosen = chosen | (F.col("f") == 0)
    entries = (
        weighted.select(*node, "_w", *ys, F.posexplode("_b").alias("f", "bin"))
        .where(chosen)
        .selectExpr(*node, "f", "bin", "_w", *[f"_w * {y} as {y}" for y in ys])
    )
    hist = entries.groupBy(*node, "f", "bin").agg(
        F.sum("_w").alias("n"), *[F.sum(y).alias(y) for y in ys]
    )
    one = Window.partitionBy(*node, "f")
    upto = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    running = {"nl": F.sum("n").over(upto), "nt": F.sum("n").over(one)}
    for j, y in enumerate(ys):
        running[f"sl{j}"] = F.sum(y).over(upto)
        running[f"st{j}"] = F.sum(y).over(one)
    gain = " + ".join(
        f"sl{j} * sl{j} / nl + (st{j} - sl{j}) * (st{j} - sl{j}) / (nt - nl) "
        f"- st{j} * st{j} / nt"
        for j in range(k)
    )
    sides = ", ".join(
        f"'m{j}', st{j} / nt, 'l{j}', sl{j} / nl, "
        f"'r{j}', try_divide(st{j} - sl{j}, nt - nl)"
        for j in range(k)
    )
    best = (
        hist.withColumns(running)
        .selectExpr(
            *node,
            "named_struct("
            f"'g', case when nt > nl then {gain} else -1D end, "
            f"'order', -(f * 1000 + bin), 'f', f, 's', bin, {sides}) as z",
        )
        .groupBy(*node)
        .agg(F.max("z").alias("z"))
    )
    # a root without a split still gives its mean
    useful = F.col("z.g") > 1e-9
    out = best.select(
        *node,
        F.when(useful, F.col("z.f")).otherwise(-1).alias("f"),
        F.col("z.s").alias("s"),
        *[
            F.col(f"z.{c}{j}").alias(f"{c}{j}")
            for j in range(k)
            for c in "mlr"
        ],
    )
    return out if level == 0 else out.where("f >= 0")


def _dense(
    entries: DataFrame, groups: tuple[str, ...], length: int, columns: Sequence[str]
) -> DataFrame:
    """Arrays over all positions of a group, from (group, pos, value) rows.

    Positions without an entry hold null.  The length is fixed by trees and depth,
    whatever the number of rows.
    """
    everywhere = (
        entries.select(*groups)
        .distinct()
        .select(*groups, F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("pos"))
    )
    filled = (
        entries.select(*groups, "pos", *columns)
        .unionByName(everywhere, allowMissingColumns=True)
        .groupBy(*groups, "pos")
        .agg(*[F.max(c).alias(c) for c in columns])
    )
    listed = filled.groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("_all")
    )
    return listed.select(*groups, *[F.col(f"_all.{c}").alias(c) for c in columns])


def _codes(
    splits: DataFrame, edges: DataFrame, groups: tuple[str, ...], trees: int, depth: int
) -> DataFrame:
    """One row per group: the bin edges and the split codes of all its trees."""
    size = (1 << depth) - 1
    entries = splits.selectExpr(
        *groups,
        f"tree * {size} + node - 1 as pos",
        "case when f < 0 then -1 else f * 64 + s end as codes",
    )
    return edges.join(_dense(entries, groups, trees * size, ["codes"]), list(groups))


def _means(
    splits: DataFrame, groups: tuple[str, ...], trees: int, depth: int, k: int
) -> DataFrame:
    """One row per group: the mean of every node, written by its parent's split."""
    full = (1 << depth + 1) - 1

    def at(node: str, source: str, rows: DataFrame) -> DataFrame:
        return rows.selectExpr(
            *groups,
            f"tree * {full} + {node} - 1 as pos",
            *[f"{source}{j} as mean{j}" for j in range(k)],
        )

    split = splits.where("f >= 0")
    entries = (
        at("node", "m", splits.where("node = 1"))
        .unionByName(at("2 * node", "l", split))
        .unionByName(at("2 * node + 1", "r", split))
    )
    return _dense(entries, groups, trees * full, [f"mean{j}" for j in range(k)])
