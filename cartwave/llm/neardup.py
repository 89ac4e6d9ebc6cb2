"""MinHash near-dedup with order MinHash and banded alignment.

A text is the sequence of its word shingles (``SHINGLE`` lower-cased white-space words; a shorter text is one shingle).  Shingles
are labelled by occurrence.  Each of ``SKETCHES`` hash functions takes the two smallest labelled shingles and keeps them in text
order, so equal values speak for equal shingles in equal order.  A second sketch is of the first occurrences alone; it is the same
if no shingle is repeated.  ``ROWS`` values of a sketch make a band, and texts that share a band of either sketch are
candidates.  A pair is linked if a banded alignment of the two shingle sequences keeps, in order, at least ``SIMILARITY`` of
all shingles, aligned / (all of both - aligned), or of their first occurrences.  A class is a connected component of links.

Texts with the same words are one node, so copies are never paired.  Within a band's bucket:

1. Every member meets the bucket's hub, its most central member (the one whose buckets are the largest).  That is one pair per
   member, however large the bucket.
2. Buckets whose members are still in several classes are dealt in chunks of ``CHUNK`` members: those outside the hub's class
   meet all.  Sketches are compared first; members with a partner worth aligning meet again with their words, and a task skips
   pairs that its own links have already joined.

So no bucket is gathered in a task, none is capped, and every pair of a bucket is either aligned, ruled out by its sketches
(in both sketches fewer than ``AGREE`` values agree, which at the similarity sought has a chance of about 1e-5) or already in one class.

Odd rows: null and empty texts form one class; texts of under ``SHINGLE`` words are only linked to copies; repeated rows are in one
class; very long texts are aligned within a band that follows from the similarity; a null doc_id has no say in the class id, the
smallest doc_id of the class, which is null only if all are; an empty table gives an empty result.  Other columns are kept by
``deduplicated``, whatever their names, and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cartwave.llm.common import small_batches
from cartwave.llm.graph import components
from cartwave.session import cut

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES, ROWS = 40, 2
AGREE = 12
CHUNK = 256
BROADCAST = 1_000_000
_CACHE = 100_000  # words kept in a task's memory before the cache starts anew

_RNG = np.random.default_rng(20240607)
_MULTIPLIERS = _RNG.integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_POWERS = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_LABEL, _FIRST, _SECOND, _BAND = _RNG.integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xA0761D6478BD642F)
    return x ^ x >> np.uint64(32)


class _Words(dict):
    """Word -> 32-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF
        return code


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shingles of a sequence of word hashes."""
    x = words.astype(np.uint64)
    with np.errstate(over="ignore"):
        if len(x) < SHINGLE:
            return _mix(np.array([np.sum(_mix(x + np.uint64(1)) * _POWERS[: len(x)]) + np.uint64(len(x))], np.uint64))
        n = len(x) - SHINGLE + 1
        mixed, total = _mix(x + np.uint64(1)), np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            total += mixed[i : i + n] * _POWERS[i]
    return _mix(total)


def sketch(items: np.ndarray) -> np.ndarray:
    """Order-MinHash values of a sequence of shingles."""
    order = np.argsort(items, kind="stable")
    ranked = items[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(items)), 0))
    occurrence = np.empty(len(items), np.uint64)
    occurrence[order] = (np.arange(len(items)) - start).astype(np.uint64)
    out = np.empty(SKETCHES, np.uint64)
    with np.errstate(over="ignore"):
        labelled = _mix(items + occurrence * _LABEL)
        if len(items) == 1:
            return _mix(labelled[0] * _FIRST * _MULTIPLIERS)
        step = max(1, (1 << 20) // len(items))
        for at in range(0, SKETCHES, step):
            value = labelled * _MULTIPLIERS[at : at + step, None]
            value ^= value >> np.uint64(31)
            row = np.arange(len(value))
            one = value.argmin(1)
            value[row, one] = np.iinfo(np.uint64).max
            two = value.argmin(1)
            low, high = items[np.minimum(one, two)], items[np.maximum(one, two)]
            out[at : at + step] = _mix(low * _FIRST + high * _SECOND)
    return out


def sketches(items: np.ndarray) -> np.ndarray:
    """The sketches of a sequence of shingles and of its first occurrences."""
    first = np.sort(np.unique(items, return_index=True)[1])
    values = sketch(items)
    return np.stack([values, values if len(first) == len(items) else sketch(items[first])])


def bands(values: np.ndarray) -> np.ndarray:
    """Keys of the bands of a sketch, different from band to band."""
    rows = values.reshape(-1, ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(1, len(rows) + 1, dtype=np.uint64) * _BAND
        for i in range(ROWS):
            key = _mix(key * _FIRST + rows[:, i])
    return key.view(np.int64)


def aligned(a: list[int], b: list[int], slack: int) -> int:
    """Length of the longest common subsequence within a band: places that are matched differ by at most ``slack``.

    Row by row, a bit per place of ``a`` inside the band says that the length grows there (0) or not (1).
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    while tail < len(a) and tail < len(b) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    if tail:
        a, b = a[:-tail], b[:-tail]
    if not a or not b:
        return head + tail
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    dense = {x: sum(1 << i for i in p) if len(p) < 64 else int("".join("1" if y == x else "0" for y in reversed(a)), 2) for x, p in places.items() if len(p) > 4}
    width = 2 * slack + 1
    full = (1 << width) - 1
    grown, low, bits = 0, 0, full
    for j, x in enumerate(b):
        if j > slack:
            # the lowest place leaves the band, a place that nothing has matched enters it
            grown += 1 - (bits & 1)
            bits = bits >> 1 | 1 << (width - 1)
            low += 1
        if x in dense:
            hit = dense[x] >> low & full
        else:
            hit = 0
            for i in places.get(x, ()):
                if 0 <= i - low < width:
                    hit |= 1 << (i - low)
        both = bits & hit
        bits = ((bits + both) | (bits - both)) & full
    rest = min(width, len(a) - low)
    if rest > 0:
        grown += rest - (bits & ((1 << rest) - 1)).bit_count()
    return head + tail + grown


def similar(a: bytes, b: bytes, least: float = SIMILARITY) -> bool:
    """Whether the alignment of two texts, given as word hashes, keeps enough of their shingles.

    Either of all shingles or of each one's first occurrence, so that lines repeated more or less often don't part two texts.
    """
    x, y = shingles(np.frombuffer(a, np.uint32)).tolist(), shingles(np.frombuffer(b, np.uint32)).tolist()
    if _kept(x, y, least):
        return True
    once_x, once_y = list(dict.fromkeys(x)), list(dict.fromkeys(y))
    return (len(once_x) < len(x) or len(once_y) < len(y)) and _kept(once_x, once_y, least)


def _kept(x: list[int], y: list[int], least: float) -> bool:
    n = len(x) + len(y)
    need = int(np.ceil(n * least / (1 + least) - 1e-9))
    # an alignment that keeps enough leaves out so many shingles at most
    return need <= min(len(x), len(y)) and aligned(x, y, n - 2 * need) >= need


def sketched(docs: DataFrame, text: str = "text") -> DataFrame:
    """(uid, doc_id, text_hash, high, low, n, bands, values, words) per row, stored; high and low name the word sequence."""

    @F.pandas_udf("high long, low long, n int, bands array<long>, values binary, words binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            rows = []
            for t in batch:
                words = np.array([known[w] for w in t.lower().split()], np.uint32)
                name = xxhash.xxh3_128_digest(words.tobytes())
                values = sketches(shingles(words))
                keys = bands(values[0]) if (values[0] == values[1]).all() else np.unique(np.r_[bands(values[0]), bands(values[1])])
                high, low = np.frombuffer(name, np.int64).tolist()
                rows.append((high, low, len(words), keys, values.astype(np.uint16).tobytes(), words.tobytes()))
            yield pd.DataFrame(rows, columns=["high", "low", "n", "bands", "values", "words"])

    body = F.coalesce(F.col(text), F.lit(""))
    with small_batches(docs.sparkSession):
        return cut(
            docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64(body).alias("text_hash"), run(body).alias("s"))
            .select("uid", "doc_id", "text_hash", "s.*")
        )


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values of each text of ``a`` equal those of each of ``b``, in the sketches that agree more."""
    out = np.zeros((2, len(a), len(b)), np.uint8)
    for i in range(SKETCHES):
        out[0] += a[:, i, None] == b[None, :, i]
        out[1] += a[:, SKETCHES + i, None] == b[None, :, SKETCHES + i]
    return out.max(0)


@F.pandas_udf(BooleanType())
def _worth(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).reshape(len(x), 2, SKETCHES).sum(2).max(1) >= AGREE)


@F.pandas_udf(BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Those rows whose uid is among the ids, which are broadcast up to a checked number."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, "uid", "left_semi")


def _hub_links(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) of members with the hubs of their buckets."""
    central = members.groupBy("uid").agg(F.sum("size").alias("weight"))
    hubs = (
        members.join(central, "uid").groupBy("key")
        .agg(F.max(F.struct("weight", -F.col("uid"))).alias("top"))
        .select("key", (-F.col("top.col2")).alias("b"))
    )
    pairs = members.join(hubs, "key").where("uid != b").select(F.col("uid").alias("a"), "b").distinct()
    short = nodes.select("uid", "values")
    worth = (
        pairs.join(short.toDF("a", "values_a"), "a").join(short.toDF("b", "values_b"), "b")
        .where(_worth("values_a", "values_b")).select("a", "b")
    )
    return _aligned_links(cut(worth), nodes)


def _aligned_links(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = cut(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct())
    words = _of(nodes.select("uid", "words"), ids)
    with small_batches(nodes.sparkSession):
        return cut(
            pairs.join(words.toDF("a", "words_a"), "a").join(words.toDF("b", "words_b"), "b")
            .where(_linked("words_a", "words_b")).select("a", "b")
        )


def _dealt(members: DataFrame) -> DataFrame:
    """Members of buckets in several classes as (task, key, i, j, outside, ...): row chunk i of those outside meets chunk j of all."""
    size = members.groupBy("key").agg(
        F.ceil(F.count(F.lit(1)) / CHUNK).alias("all_chunks"), F.ceil(F.sum(F.col("outside").cast("int")) / CHUNK).alias("out_chunks")
    ).where("out_chunks > 0")
    rows = members.join(size, "key")
    left = rows.where("outside").withColumns({
        "i": F.pmod(F.xxhash64("uid"), "out_chunks"), "j": F.explode(F.sequence(F.lit(0), F.col("all_chunks") - 1)), "side": F.lit(0),
    })
    right = rows.withColumns({
        "j": F.pmod(F.xxhash64("uid", F.lit(1)), "all_chunks"), "i": F.explode(F.sequence(F.lit(0), F.col("out_chunks") - 1)), "side": F.lit(1),
    })
    return left.unionByName(right).drop("all_chunks", "out_chunks", "outside")


def _by_task(rows: DataFrame, each: int = 20_000) -> DataFrame:
    """Rows with a number ``task`` that keeps (key, i, j) together, about ``each`` rows to a task."""
    tasks = max(1, -(-rows.count() // each))
    return rows.withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks)))


def _meetings(part: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """The two sides of each (key, i, j)."""
    part = part.sort_values(["key", "i", "j", "side", "uid"], kind="stable").reset_index(drop=True)
    keys = part[["key", "i", "j"]].to_numpy()
    edges = np.r_[0, np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1, len(part)]
    side = part["side"].to_numpy()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        middle = a + int((side[a:b] == 0).sum())
        yield part.iloc[a:middle], part.iloc[middle:b]


def _rest_links(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between members of a bucket that are still in different classes; ``members`` has (key, uid, label, outside)."""
    ids = cut(members.select("uid").distinct())
    short = _of(nodes.select("uid", "values"), ids)

    def worth(part: pd.DataFrame) -> pd.DataFrame:
        keys, uids = [], []
        for left, right in _meetings(part):
            x, y = (np.frombuffer(b"".join(s["values"]), np.uint16).reshape(len(s), -1) for s in (left, right))
            good = (_agreeing(x, y) >= AGREE) & (left["label"].to_numpy()[:, None] != right["label"].to_numpy())
            for side, hit in ((left, good.any(1)), (right, good.any(0))):
                uids.append(side["uid"].to_numpy()[hit])
                keys.append(side["key"].to_numpy()[hit])
        return pd.DataFrame({"key": np.concatenate([[], *keys]).astype(np.int64), "uid": np.concatenate([[], *uids]).astype(np.int64)})

    rows = cut(_dealt(members.join(short, "uid")))
    good = cut(_by_task(rows).groupBy("task").applyInPandas(worth, "key long, uid long").distinct())
    chosen = members.join(good, ["key", "uid"])
    words = _of(nodes.select("uid", "values", "words"), cut(good.select("uid").distinct()))

    def link(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for left, right in _meetings(part):
            x, y = (np.frombuffer(b"".join(s["values"]), np.uint16).reshape(len(s), -1) for s in (left, right))
            agree = _agreeing(x, y)
            root = {v: v for v in [*left["label"], *right["label"]]}

            def find(v: int, root: dict = root) -> int:
                while root[v] != v:
                    root[v] = v = root[root[v]]
                return v

            theirs, words_r, uid_r = right["label"].tolist(), right["words"].tolist(), right["uid"].tolist()
            for i, (label, words_l, uid_l) in enumerate(zip(left["label"], left["words"], left["uid"], strict=True)):
                # the likeliest first: once two classes are one, the other pairs between them need no alignment
                for j in np.argsort(-agree[i].astype(int), kind="stable"):
                    if agree[i, j] >= AGREE and find(label) != find(theirs[j]) and similar(words_l, words_r[j]):
                        root[find(label)] = find(theirs[j])
                        out.append((uid_l, uid_r[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    rows = cut(_dealt(chosen.join(words, "uid")))
    return cut(_by_task(rows, 2 * CHUNK).groupBy("task").applyInPandas(link, "a long, b long"))


def classes(rows: DataFrame) -> DataFrame:
    """(high, low, first, class_id) per word sequence of sketched rows: uid and doc_id of its class's first document by doc_id."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("least")
    texts = cut(rows.groupBy("high", "low").agg(F.min("uid").alias("uid"), first))
    nodes = rows.join(texts.select("uid"), "uid", "left_semi")
    keys = nodes.where(F.col("n") > SHINGLE - 1).select("uid", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut(keys.join(shared, "key"))
    links = _hub_links(members, nodes)
    labels = components(links)
    placed = (
        members.where("size > 2").join(labels.withColumnRenamed("node", "uid"), "uid", "left")
        .select("key", "uid", F.coalesce("label", "uid").alias("label"))
    )
    open_keys = (
        placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "label"))["label"].alias("main"))
        .where("classes > 1").select("key", "main")
    )
    rest = cut(placed.join(open_keys, "key").select("key", "uid", "label", (F.col("label") != F.col("main")).alias("outside")))
    more = _rest_links(rest, nodes)
    labels = components(links.union(more))
    linked = texts.join(labels.withColumnRenamed("node", "uid"), "uid")
    least = linked.groupBy("label").agg(F.min("least").alias("of_class"))
    named = linked.join(least, "label").select("uid", "of_class")
    out = texts.join(named, "uid", "left").withColumn("least", F.coalesce("of_class", "least"))
    return out.select("high", "low", F.col("least.uid").alias("first"), F.col("least.doc_id").alias("class_id"))


def near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, class_id) per document row."""
    rows = sketched(docs, text)
    return rows.select("doc_id", "high", "low").join(classes(rows), ["high", "low"]).select("doc_id", "class_id")


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """The document with the smallest doc_id of each class, with its own columns."""
    rows = sketched(docs, text)
    placed = cut(
        rows.select("uid", "doc_id", "text_hash", "high", "low").join(classes(rows), ["high", "low"])
        .groupBy("doc_id", "text_hash").agg(F.max((F.col("uid") == F.col("first")).cast("int")).alias("kept"), F.count(F.lit(1)).alias("rows"))
        .where("kept = 0 or rows > 1")
    )
    own = F.xxhash64(F.coalesce(docs[text], F.lit("")))

    def those(what: str) -> tuple[DataFrame, object]:
        some = placed.where(what).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        some = F.broadcast(some) if some.count() <= BROADCAST else some
        return some, docs["doc_id"].eqNullSafe(F.col("_id")) & (own == F.col("_hash"))

    single, repeated = those("kept = 0 or rows > 1"), those("kept = 1 and rows > 1")
    # of equal rows of the kept document one stays
    once = docs.join(*repeated, "left_semi").dropDuplicates(["doc_id", text])
    return docs.join(*single, "left_anti").unionByName(once)
