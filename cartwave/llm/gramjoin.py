"""Exact Jaccard join of word shingles over R-trees of count vectors.

A text is the set of its shingles (``SHINGLE`` words, lower-cased A-Z; a shorter text is one shingle).  Two texts are linked if
100 * shared >= ``PERCENT`` * all shingles of both.  Texts with one set are one node, so copies are never paired.

Each shingle is hashed to a group; a node's point is how many of its shingles fall in each.  Larger sets have more groups, two to four
shingles to each, and a point folds to half as many by adding its halves.  Two sets share at most the sum of the smaller of both counts
over the groups, and a set shares at most the sum of the smaller of its count and a box's upper corner with any point in the box.  Both
sizes known, a link needs a certain number, so boxes and points below it are never opened.  The few pairs left are counted exactly.

Blocks.  A pair that is linked shares a shingle among the first n - ceil(n * PERCENT / 100) + 1 of each set, in any one order of all
shingles.  The order is by hash, but hot shingles (of a passage that many documents share) come last, so that only documents of little
else begin with one.  Any choice of hot ones gives the same links: those of ``OFTEN`` or more in every ``SAMPLE``-th document, and any that
still begin more than ``HOT`` sets.  Within the block of a shingle:

1. Every member meets the block's hub, its member with the largest blocks; that is one pair per member, however large the block.
2. Blocks whose members are still in several classes are dealt by size (linked sets differ by a fifth at most) into cells of about ``CHUNK`` by
   ``CHUNK``: members outside the block's main class search an R-tree of the others, by coarse points, then by fine ones, then with their
   sets; what the trees leave of a block goes on as groups of texts that may be linked, which many blocks share.  The last pass
   leaves out pairs that its own links have joined.

So no block is gathered in a task, none is capped, and each pair of different classes in a block is counted, ruled out by its
bound, or joined by other links.  Shingles are compared by 40 bits of a 64-bit hash: a pair of sets of 20,000 has a chance of about one in
3,000 to seem to share one more than it does.  Tables stored on the way are deleted as soon as all that is made of them is stored.

Odd rows: null and empty texts and those without words have 0 shingles and are linked with nothing; repeated rows are in one class; long
texts are taken whole; a null doc_id has no say in the class id, which is null only if all of the class are (or for a null doc_id without
words); an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cartwave.llm.common import small_batches
from cartwave.llm.graph import components
from cartwave.session import cut, fresh_path

SHINGLE = 5
PERCENT = 80
GROUPS = 64, 4096  # fewest and most
HOT = 512
SAMPLE, OFTEN = 16, 3
CHUNK = 256
FANOUT = 8
BROADCAST = 1_000_000  # rows of under 50 bytes
WIDTH = 5  # bytes of a stored shingle
_CACHE = 100_000

_RNG = np.random.default_rng(11)
_POWERS = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SHORT = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers: multiply and fold twice."""
    with np.errstate(over="ignore"):
        for factor in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


class _Hashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, known: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a UTF-8 text."""
    words = np.array([known[w] for w in text.lower().split()], np.uint64)
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if len(words) < SHINGLE:
            return _mixed(np.array([(words * _POWERS[: len(words)]).sum() ^ _SHORT[len(words)]], np.uint64))
        n = len(words) - SHINGLE + 1
        total = sum((words[i : i + n] * _POWERS[i] for i in range(1, SHINGLE)), words[:n] * _POWERS[0])
    return np.unique(_mixed(total))


def stored(hashes: np.ndarray) -> bytes:
    """The upper 40 bits of sorted hashes, in order."""
    short = hashes >> np.uint64(64 - 8 * WIDTH)
    if len(short) > 1:
        short = short[np.concatenate([[True], short[1:] != short[:-1]])]
    return short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def loaded(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :WIDTH] = raw
    return out.view("<i8").ravel()


def beginning(n: int) -> int:
    """How many shingles of a set of n hold one of each set that it is linked with."""
    return n - -(-n * PERCENT // 100) + 1 if n else 0


def groups_of(n: int) -> int:
    """Groups of a set of n: a power of two, a quarter to half of n within bounds."""
    return max(GROUPS[0], min(GROUPS[1], 1 << max(0, n // 4).bit_length()))


def point(shingles: np.ndarray) -> np.ndarray:
    g = groups_of(len(shingles))
    return np.bincount(shingles % g, minlength=g)


def packed(p: np.ndarray) -> bytes:
    """Two bytes a group, or eight if a count is too large for two."""
    return p.astype("<u2" if p.max() < 1 << 16 else "<i8").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    """A packed point of a set of n, folded or not."""
    few = groups_of(n) if len(data) >= 2 * groups_of(n) else GROUPS[0]
    return np.frombuffer(data, "<u2" if len(data) == 2 * few else "<i8").astype(np.int64)


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """A point, or the rows of a matrix of points, in fewer groups."""
    while p.shape[-1] > groups:
        half = p.shape[-1] // 2
        p = p[..., :half] + p[..., half:]
    return p


def least_shared(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Fewest shared shingles with which sets of n and m are linked."""
    return -(-(n + m) * PERCENT // (100 + PERCENT))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


class CountTree:
    """An R-tree over points, packed from the order given: ``FANOUT`` to a box, the boxes likewise, until ``FANOUT`` or fewer are left."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # per level: upper corners, fewest and most shingles of a box; the last level is the points themselves
        self.levels = [(points, sizes, sizes)]
        while len(self.levels[0][0]) > FANOUT:
            high, few, most = self.levels[0]
            at = np.arange(0, len(high), FANOUT)
            self.levels.insert(0, (np.maximum.reduceat(high, at), np.minimum.reduceat(few, at), np.maximum.reduceat(most, at)))

    def search(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the asking point, index in the tree) of all pairs whose bound allows a link."""
        ask = np.repeat(np.arange(len(points)), len(self.levels[0][0]))
        box = np.tile(np.arange(len(self.levels[0][0])), len(points))
        for depth, (high, few, most) in enumerate(self.levels):
            if depth:  # the boxes in those that were not ruled out
                ask, box = np.repeat(ask, FANOUT), (box[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                ask, box = ask[box < len(high)], box[box < len(high)]
            n = sizes[ask]
            fits = (100 * most[box] >= PERCENT * n) & (100 * n >= PERCENT * few[box])
            ask, box, n = ask[fits], box[fits], n[fits]
            good = [
                np.minimum(points[ask[i : i + 4096]], high[box[i : i + 4096]]).sum(1) >= least_shared(n[i : i + 4096], few[box[i : i + 4096]])
                for i in range(0, len(ask), 4096)
            ]
            good = np.concatenate(good) if good else np.zeros(0, bool)
            ask, box = ask[good], box[good]
        return ask, box


def shingled(docs: DataFrame, text: str = "text") -> DataFrame:
    """(uid, doc_id, n, high, low, coarse, fine, shingles) per row, stored.

    High and low name the set, fine is its point, coarse the point in the fewest groups.
    """

    @F.pandas_udf("n long, high long, low long, coarse binary, fine binary, shingles binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            rows = []
            for t in batch:
                hashes = shingle_set(t, known)
                held = stored(hashes)
                high, low = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64).tolist()
                p = point(loaded(held))
                rows.append((len(hashes), high, low, packed(folded(p, GROUPS[0])), packed(p), held))
            yield pd.DataFrame(rows, columns=["n", "high", "low", "coarse", "fine", "shingles"])

    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return cut(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", run(body).alias("s")).select("uid", "doc_id", "s.*"))


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` stored in the shared folder, and where."""
    path = fresh_path(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a stored table; all that was made of it must be stored."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _few(rows: DataFrame) -> DataFrame:
    """Stored rows, to be broadcast if a count says that they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def _every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sets = [loaded(x) for x in b["shingles"]]
        yield pd.DataFrame({"uid": np.repeat(b["uid"].to_numpy(), [len(x) for x in sets]), "key": np.concatenate([np.zeros(0, np.int64), *sets])})


def _first(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(uid, n, key, late): the sets' beginnings if the hot shingles come last, late if the key is one of those."""
    known = None
    if hot.count() <= BROADCAST:
        known = np.sort(hot.toPandas()["key"].to_numpy(np.int64))
        rows = rows.withColumn("hot", F.lit(None).cast("array<long>"))
    else:
        inside = rows.select("uid", "shingles").mapInPandas(_every, "uid long, key long").join(hot, "key")
        rows = rows.join(inside.groupBy("uid").agg(F.sort_array(F.collect_list("key")).alias("hot")), "uid", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, lates = [], []
            for held, hots in zip(b["shingles"], b["hot"], strict=True):
                own = loaded(held)
                n = beginning(len(own))
                late_ones = known if known is not None else np.zeros(0, np.int64) if hots is None else np.asarray(hots, np.int64)
                place = np.searchsorted(late_ones, own)
                late = np.zeros(len(own), bool)
                late[place < len(late_ones)] = late_ones[place[place < len(late_ones)]] == own[place < len(late_ones)]
                order = np.concatenate([np.flatnonzero(~late), np.flatnonzero(late)])[:n]
                keys.append(own[order])
                lates.append(late[order])
            sizes = [len(x) for x in keys]
            yield pd.DataFrame({
                "uid": np.repeat(b["uid"].to_numpy(), sizes), "n": np.repeat(b["n"].to_numpy(), sizes),
                "key": np.concatenate([np.zeros(0, np.int64), *keys]), "late": np.concatenate([np.zeros(0, bool), *lates]),
            })

    return rows.select("uid", "n", "shingles", "hot").mapInPandas(run, "uid long, n long, key long, late boolean")


def blocks(nodes: DataFrame) -> DataFrame:
    """(key, uid, n, size), stored: the sets that begin with a shingle, for shingles of several sets.

    Shingles with the same members make one block: their members agree in number and in two sums of 64-bit hashes.
    """
    rows = nodes.select("uid", "n", "shingles")
    some = rows.where(F.pmod(F.xxhash64("uid"), F.lit(SAMPLE)) == 0).mapInPandas(_every, "uid long, key long")
    hot = cut(some.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= OFTEN).select("key"))
    size, x, y = F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("uid", "n")).alias("x"), F.bit_xor(F.xxhash64("n", "uid")).alias("y")
    while True:
        keys, path = kept(_first(rows, hot))
        # cold keys are dealt once, for their counts and for the join; hot ones are counted before they meet
        cold, late = (keys.where(f"key is not null and {c}").select("key", "uid", "n") for c in ("not late", "late"))
        cold = cold.repartition("key")
        counts = [part.groupBy("key").agg(size, x, y).where("size > 1") for part in (cold, late)]
        single = counts[0].unionByName(counts[1]).groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
        found = cut(cold.join(single, "key").unionByName(late.join(single, "key")))
        more = found.where(F.col("size") > HOT).select("key").distinct().join(hot, "key", "left_anti")
        dropped(nodes.sparkSession, path)
        if more.isEmpty():
            return found
        hot = cut(hot.union(more))


def _met(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with the columns of both; a ``b`` that many meet is copied, each copy for at most about ``CHUNK`` pairs."""
    copies = cut(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("copies")))
    asking = cut(pairs.select(F.col("a").alias("uid")).distinct())
    hubs = rows.join(_few(copies.select(F.col("b").alias("uid"))), "uid", "left_semi")
    spread = (
        hubs.select(F.col("uid").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns]).join(_few(copies), "b")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    )
    mine = rows.join(_few(asking), "uid", "left_semi").select(F.col("uid").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    dealt = pairs.join(_few(copies), "b").withColumn("copy", F.pmod(F.xxhash64("a"), "copies")).drop("copies")
    return dealt.join(mine, "a").join(spread, ["b", "copy"])


@F.pandas_udf(BooleanType())
def _bound(n: pd.Series, a: pd.Series, m: pd.Series, b: pd.Series) -> pd.Series:
    """Whether coarse points allow a link."""
    return pd.Series([
        int(np.minimum(unpacked(x, i), unpacked(y, j)).sum()) >= least_shared(i, j) for i, x, j, y in zip(n, a, m, b, strict=True)
    ], dtype=bool)


@F.pandas_udf(BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([linked(loaded(x), loaded(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


def hub_links(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) of members with the hubs of their blocks."""
    weight = members.groupBy("uid").agg(F.sum("size").alias("weight"))
    hubs = (
        members.join(weight, "uid").groupBy("key").agg(F.max(F.struct("weight", (-F.col("uid")).alias("of"), "n")).alias("top"))
        .select("key", (-F.col("top.of")).alias("b"), F.col("top.n").alias("m"))
    )
    near = (100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")) & (F.col("uid") != F.col("b"))
    pairs = cut(members.join(hubs, "key").where(near).select(F.col("uid").alias("a"), "b").distinct())
    open_ = cut(_met(pairs, rows, ["n", "coarse"]).where(_bound("n_a", "coarse_a", "n_b", "coarse_b")).select("a", "b"))
    return cut(_met(open_, rows, ["shingles"]).where(_linked("shingles_a", "shingles_b")).select("a", "b"))


def _cells(members: DataFrame) -> DataFrame:
    """Members as (key, band, i, j, side, uid, n, label): part i of those outside the main class meets part j of all of like size.

    Blocks of up to ``CHUNK`` members are parted by the number of groups alone, larger ones by steps of a fifth.
    """
    def band(n: Column) -> Column:
        least, most = (F.lit(g) for g in GROUPS)
        groups = F.greatest(least, F.least(most, F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.lit(1), F.floor(n / 4)))) + 1).cast("long")))
        return F.when(F.col("size") <= CHUNK, groups).otherwise(F.floor(F.log(n) / F.log(F.lit(100 / PERCENT))))

    n = F.col("n")
    right = members.withColumns({"band": band(n), "side": F.lit(1)})
    low, high = band(F.ceil(n * PERCENT / 100)), band(F.floor(n * 100 / PERCENT))
    near = F.when(F.col("size") <= CHUNK, F.array_distinct(F.array(low, band(n), high))).otherwise(F.sequence(low, high))
    left = members.where("outside").withColumn("band", F.explode(near)).withColumn("side", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    parts = both.groupBy("key", "band").agg(
        F.ceil(F.sum(F.lit(1) - F.col("side")) / CHUNK).alias("lefts"), F.ceil(F.sum("side") / CHUNK).alias("rights")
    ).where("lefts > 0 and rights > 0")
    both = both.join(parts, ["key", "band"])
    is_left = F.col("side") == 0
    part = F.pmod(F.xxhash64(F.when(is_left, F.col("uid")).otherwise(F.col("label"))), F.when(is_left, F.col("lefts")).otherwise(F.col("rights")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_left, F.col("rights")).otherwise(F.col("lefts")) - 1))
    dealt = both.withColumn("own", part).withColumn("other", other)
    return dealt.withColumns({
        "i": F.when(is_left, F.col("own")).otherwise(F.col("other")), "j": F.when(is_left, F.col("other")).otherwise(F.col("own")),
    }).drop("own", "other", "lefts", "rights", "outside", "size")


def _dealt(members: DataFrame, payload: DataFrame, each: int):
    """Members of the cells with their payload, grouped by tasks of about ``each`` rows that keep cells together."""
    tasks = max(1, -(-2 * members.count() // each))
    cells = _cells(members).withColumn("task", F.pmod(F.xxhash64("key", "band", "i", "j"), F.lit(tasks)))
    wanted = payload.join(_few(cut(members.select("uid").distinct())), "uid", "left_semi")
    return cells.join(wanted, "uid").groupBy("task")


def _searched(part: pd.DataFrame, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per cell of sorted rows the places of pairs of different classes that the tree could not rule out: left, right."""
    where = part[["key", "band", "i", "j"]].to_numpy()
    edges = np.r_[0, np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1, len(part)]
    side, label, n = (part[c].to_numpy() for c in ("side", "label", "n"))
    held = part[column].tolist()
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        middle = a + int(np.searchsorted(side[a:b], 1))
        if middle in (a, b):
            continue
        points = [unpacked(held[i], int(n[i])) for i in range(a, b)]
        g = min(map(len, points))
        here = np.stack([folded(p, g) for p in points])
        ask, found = CountTree(here[middle - a :], n[middle:b]).search(here[: middle - a], n[a:middle])
        apart = label[a + ask] != label[middle + found]
        yield a + ask[apart], middle + found[apart]


def _in_order(part: pd.DataFrame) -> pd.DataFrame:
    """Rows cell by cell, the asking side first; rows of a class and of like size next to each other, for close boxes."""
    return part.sort_values(["key", "band", "i", "j", "side", "label", "n", "uid"], kind="stable").reset_index(drop=True)


def _groups(uid: np.ndarray, ask: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Per row the smallest uid that pairs of rows reach, rows of one uid counting as one."""
    ids, own = np.unique(uid, return_inverse=True)
    group = np.arange(len(ids))
    while True:
        low = group.copy()
        np.minimum.at(low, own[ask], group[own[found]])
        np.minimum.at(low, own[found], group[own[ask]])
        low = low[low]
        if (low == group).all():
            return ids[group][own]
        group = low


def _candidates(column: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """(key, uid): members of a task's cells that, by this column's points, may be linked, in groups named by their smallest uid.

    Blocks that share documents find the same groups, so a document goes on once per group and not once per block.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = _in_order(part)
        uid = part["uid"].to_numpy()
        keys, uids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for ask, found in _searched(part, column):
            if len(ask):
                rows = np.unique(np.concatenate([ask, found]))
                keys.append(_groups(uid[rows], np.searchsorted(rows, ask), np.searchsorted(rows, found)))
                uids.append(uid[rows])
        return pd.DataFrame({"key": np.concatenate(keys), "uid": np.concatenate(uids)}).drop_duplicates()

    return run


def _apart(rows: DataFrame) -> DataFrame:
    """(key, uid, n, label, size, outside), stored: members of blocks of several classes; outside is who is not of the largest class."""
    several = (
        rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("key").agg(F.sum("rows").alias("size"), F.count(F.lit(1)).alias("classes"), F.max(F.struct("rows", "label"))["label"].alias("main"))
        .where("classes > 1").select("key", "size", "main")
    )
    return cut(rows.join(several, "key").select("key", "uid", "n", "label", "size", (F.col("label") != F.col("main")).alias("outside")))


def _cell_links(part: pd.DataFrame) -> pd.DataFrame:
    part, out = _in_order(part), []
    label, uid, held = (part[c].tolist() for c in ("label", "uid", "shingles"))
    sets: dict[int, np.ndarray] = {}
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    def set_of(at: int) -> np.ndarray:
        if uid[at] not in sets:
            if len(sets) > 4 * CHUNK:
                sets.clear()
            sets[uid[at]] = loaded(held[at])
        return sets[uid[at]]

    for ask, found in _searched(part, "fine"):
        for i, j in zip(ask.tolist(), found.tolist(), strict=True):
            if find(label[i]) != find(label[j]) and linked(set_of(i), set_of(j)):
                root[find(label[i])] = find(label[j])
                out.append((uid[i], uid[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def tree_links(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Links between members of a block that are in different classes; ``members`` has key, uid, n, label, size (of the block) and outside.

    Members are dealt three times: with coarse points, those left with fine ones, those left with their sets.
    """
    known = cut(members.select("uid", "n", "label").distinct())
    for column, each in (("coarse", 20_000), ("fine", 4 * CHUNK)):
        found = _dealt(members, rows.select("uid", column), each).applyInPandas(_candidates(column), "key long, uid long")
        members = _apart(cut(found.distinct()).join(_few(known), "uid"))
    return cut(_dealt(members, rows.select("uid", "fine", "shingles"), 2 * CHUNK).applyInPandas(_cell_links, "a long, b long"))


def node_classes(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, label): label is the smallest uid that links reach from node; nodes without a link are left out.

    ``rows`` holds the points and sets by uid, those of copies too.
    """
    members = blocks(nodes)
    links = hub_links(members, rows)
    labels = components(links)
    placed = (
        members.where("size > 2").join(labels.withColumnRenamed("node", "uid"), "uid", "left")
        .select("key", "uid", "n", F.coalesce("label", "uid").alias("label"))
    )
    rest = _apart(placed)
    return components(links.union(tree_links(rest, rows)))


def join(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per document row."""
    with small_batches(docs.sparkSession):
        rows = shingled(docs, text)
        full = rows.where("n > 0")
        sets = full.groupBy("high", "low").agg(F.min("uid").alias("first"), F.min("doc_id").alias("least"))
        placed = cut(full.select("uid", "doc_id", "n", "high", "low").join(sets, ["high", "low"]).drop("high", "low"))
        copies = cut(placed.where("uid != first").select("uid"))
        labels = node_classes(full.join(_few(copies), "uid", "left_anti"), full)
    linked_sets = placed.where("uid = first").select("uid", "least").join(labels.withColumnRenamed("node", "uid"), "uid")
    of_class = linked_sets.groupBy("label").agg(F.min("least").alias("component"))
    named = linked_sets.join(of_class, "label").select(F.col("uid").alias("first"), "component", F.lit(True).alias("named"))
    component = F.when(F.col("named"), F.col("component")).otherwise(F.col("least")).alias("component_id")
    found = placed.join(named, "first", "left").select("doc_id", F.col("n").alias("n_shingles"), component)
    return found.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
