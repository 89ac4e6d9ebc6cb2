"""Approximate nearest neighbours by multi-index hashing.

Nearness is the inner product.  Vectors get one more component that brings all to the largest length (queries: 0), so that the
largest inner product is the smallest angle.  Codes of ``BITS`` bits come from rotations learned on a bounded sample: principal
axes, turned so that signs lose least (iterative quantisation), as many times from different starts as the bits need.  A code
is cut into ``SUBSTRINGS`` of 16 bits.  Two codes within a Hamming radius agree, by the pigeonhole principle, within a share of it
in at least one substring.  So each substring has an index of its values; probing the values near a query's retrieves every code
within the radius, and all those are reranked by the inner products of the original vectors in double precision.

The radius is the distance within which the sample's own neighbours lie, but for ``1 - COVER`` of them; the whole table is denser
than the sample, its neighbours nearer.  Queries that have fewer than ``k`` codes within the radius, as those far from dense groups
do, are probed again with a radius half-way to ``BITS``, and then with ``BITS``, at which all rows are candidates.  Every row is
indexed, and nothing is capped.

Queries and rows are dealt in blocks of ``QUERIES`` and ``ROWS``; a task indexes one block of rows and answers one block of
queries, and returns ``k`` rows at most per query.

Odd rows: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids and vectors that
have not the most frequent number of components.  Rows that repeat an id count once, with the smallest of their vectors.  Equal
scores go to the smaller id.  An empty table, or one without queries, gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwave.session import cut

BITS = 128
SUBSTRINGS = BITS // 16
SAMPLE = 8192  # bound of the training sample
COVER = 0.95
ROWS, QUERIES = 8192, 1024
TURNS = 30

_COUNT = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))


@dataclass
class Codes:
    """Projections and thresholds of the bits, the length all rows are brought to, and the search radius."""

    projection: np.ndarray
    middle: np.ndarray
    length: float
    radius: int

    def encode(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """(n, SUBSTRINGS) parts of the codes of original vectors."""
        bits = extended(vectors, self.length, query) @ self.projection > self.middle
        return np.packbits(bits, axis=1).view(np.uint16)


def extended(vectors: np.ndarray, length: float, query: bool) -> np.ndarray:
    """Vectors of length one with one more component; the inner products order as before for a given query."""
    own = (vectors * vectors).sum(1)
    if query:
        return np.hstack([vectors / np.sqrt(own)[:, None], np.zeros((len(vectors), 1))])
    rest = np.sqrt(np.maximum(length * length - own, 0))
    return np.hstack([vectors, rest[:, None]]) / length


def learn(sample: np.ndarray, length: float, k: int, seed: int = 5) -> Codes:
    """Codes from a sample of original vectors."""
    rng = np.random.default_rng(seed)
    x = extended(sample, length, False)
    mean = x.mean(0)
    _, vectors = np.linalg.eigh(np.cov((x - mean).T) if len(x) > 1 else np.eye(x.shape[1]))
    axes = vectors[:, ::-1]
    parts, left = [], BITS
    while left > 0:
        width = min(left, axes.shape[1])
        low = (x - mean) @ axes[:, :width]
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(TURNS):
            u, _, vt = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (u @ vt).T
        parts.append(axes[:, :width] @ turn)
        left -= width
    projection = np.hstack(parts)
    codes = Codes(projection, mean @ projection, length, BITS)
    chosen = rng.permutation(len(sample))[:512]
    asked = sample[chosen]
    score = asked @ sample.T
    score[np.arange(len(chosen)), chosen] = -np.inf
    wide = codes.encode(sample, False).view(np.uint64)
    near = np.argsort(-score, axis=1)[:, :k]
    far = np.bitwise_count(codes.encode(asked, True).view(np.uint64)[:, None] ^ wide[near]).sum(2)
    # a sample no larger than the neighbours asked for tells nothing about distances
    codes.radius = int(np.quantile(far, COVER)) if len(sample) > 2 * k else BITS
    return codes


def probe(asked: np.ndarray, index: np.ndarray, radius: int) -> np.ndarray:
    """Which codes (columns) agree with a query's (rows) in a substring as closely as the radius demands of one."""
    share, more = divmod(radius, SUBSTRINGS)
    found = np.zeros((len(asked), len(index)), bool)
    for k in range(SUBSTRINGS):
        # if the first more + 1 substrings all differ in over share bits and the others in share or more, the sum is too large
        limit = share if k <= more else share - 1
        if limit < 0:
            continue
        values, bucket = np.unique(index[:, k], return_inverse=True)
        near = _COUNT[asked[:, k, None] ^ values] <= limit
        found |= near[:, bucket]
    return found


def within(asked: np.ndarray, index: np.ndarray, radius: int) -> list[np.ndarray]:
    """For each query the codes within the radius."""
    wide_q, wide = (np.ascontiguousarray(c).view(np.uint64) for c in (asked, index))
    out = []
    for q, row in zip(wide_q, probe(asked, index, radius), strict=True):
        ids = np.nonzero(row)[0]
        out.append(ids[np.bitwise_count(wide[ids] ^ q).sum(1) <= radius])
    return out


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, asked: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row whose id satisfies ``asked`` (over column ``id``)."""
    spark = vectors.sparkSession
    out_schema = "query_id long, vec_id long, score double"
    rows = cut(_usable(vectors, key, vector))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == size["d"])
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.agg(F.max(square).alias("square"), F.count(F.lit(1)).alias("n"), F.sum(asked.cast("long")).alias("asked")).first()
    share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_003))
    some = rows.where(share < int(1_000_003 * min(1.0, SAMPLE / facts["n"]))).orderBy("id").select("v").limit(2 * SAMPLE).toPandas()
    if not len(some):  # a handful of rows, all of which may miss the share
        some = rows.orderBy("id").limit(SAMPLE).select("v").toPandas()
    codes = learn(np.stack(some["v"]), float(np.sqrt(facts["square"])), k)
    shared = spark.sparkContext.broadcast(codes)
    row_blocks = -(-facts["n"] // ROWS)

    def encode(batches):
        for batch in batches:
            v = np.stack(batch["v"]).astype(np.float64)
            code = shared.value.encode(v, bool(batch["query"].iloc[0]))
            yield pd.DataFrame({
                "id": batch["id"], "query": batch["query"], "v": [x.tobytes() for x in v], "code": [x.tobytes() for x in code],
            })

    def coded(some_rows: DataFrame, query: bool) -> DataFrame:
        return some_rows.withColumn("query", F.lit(query)).mapInPandas(encode, "id long, query boolean, v binary, code binary")

    def dealt(some_rows: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return some_rows.withColumns({
            own: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1))),
        })

    def answer(part: pd.DataFrame, radius: int) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        asks, index = part[part["query"]], part[~part["query"]]
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if not len(asks) or not len(index):
            return none
        codes_q, codes_r = (np.frombuffer(b"".join(s["code"]), np.uint16).reshape(len(s), -1) for s in (asks, index))
        v, ids, out = _matrix(index["v"]), index["id"].to_numpy(), [none]
        for query, q, near in zip(asks["id"], _matrix(asks["v"]), within(codes_q, codes_r, radius), strict=True):
            near = near[ids[near] != query]
            score = v[near] @ q
            # ids rise, so a stable sort leaves the smaller id first
            best = np.argsort(-score, kind="stable")[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near[best]], "score": score[best]}))
        return pd.concat(out)

    def nearest(left: DataFrame, n: int, radius: int) -> DataFrame:
        blocks = max(1, -(-n // QUERIES))
        index = dealt(coded(rows, False), "b", row_blocks, "c", blocks)
        queries = dealt(coded(left, True), "c", blocks, "b", row_blocks)
        found = index.unionByName(queries).groupBy("b", "c").applyInPandas(lambda part: answer(part, radius), out_schema)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))

    want = min(k, facts["n"] - 1)
    left, n, radius, done = rows.where(asked), facts["asked"] or 0, codes.radius, None
    while True:
        got = nearest(left, n, radius)
        n = 0
        if radius < BITS:
            full = got.where(F.col("rank") == want).select(F.col("query_id").alias("id"))
            few = cut(left.join(full, "id", "left_anti"))
            n = few.count()
        if n:
            got = got.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti")
        done = got if done is None else done.unionByName(got)
        if not n:
            return done.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        left, radius = few, (radius + BITS + 1) // 2 if radius == codes.radius else BITS
