"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

A document is its token ids and a final id 0.  Documents of more than ``CAPACITY`` ids are cut into pieces of that many, the first
being the shorter one.  Full pieces are sequences of their own; the others are dealt by a hash into blocks of about ``BLOCK``
pieces.  A genome is a grouping of a block's pieces into sequences.  Crossover puts whole well-filled sequences of one parent into
the other, removes the sequences that share pieces with them, and best-fits the displaced pieces, longest first.  Mutation
dissolves the least filled sequences.  Every block is bred on ``ISLANDS`` islands, in tasks of their own; between ``EPOCHS``
each island's elite also moves to the next island.  A block is done early when it needs no more sequences than its
pieces' total length demands.  The sequences that stay short of ``FILLED`` are unpacked and packed again across blocks, level by
level, until one block is left or nothing is short, so blocks cost no sequence each.  A level that saves no sequence is the last,
as is the level ``LEVELS``; then what is short stays as it is, in the grouping that needs fewer sequences.

Memory is bounded by a block; a task never holds more, whatever the corpus.  Seeds come from block, island and epoch, and pieces
are read from a stored table, so a repeated task breeds the same again.

Odd rows: null and empty texts are the single id 0; very long texts are cut, all of their ids kept; repeated rows are packed one by
one; control strings in texts are ordinary text; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwave.llm.common import small_batches
from cartwave.session import cut

CAPACITY = 2048
BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 5
GENERATIONS = 12
FILLED = 0.97
LEVELS = 16

# beyond such runs of white space the fast library's pattern may give up
_SPACE = re.compile(r"\s{1000}")


def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> Callable[[str], list[int]]:
    """The ids of a text under a ``tokenizers`` vocabulary, control strings being ordinary text.

    Given the same vocabulary as ranks and its pattern, the same ids come from ``tiktoken``, several times as fast.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    slow.encode_special_tokens = True
    plain = lambda text: slow.encode(text, add_special_tokens=False).ids
    if ranks is None or pattern is None:
        return plain
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return lambda text: plain(text) if _SPACE.search(text) else fast.encode_ordinary(text)


def pieces(docs: DataFrame, coder: tuple, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32) of every piece, stored; ``coder`` holds the arguments of ``encoder``."""

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(*coder)
        for batch in batches:
            out = []
            for t in batch:
                ids = np.array([*encode(t), 0], "<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                out.append([
                    {"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())}
                    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
                ])
            yield pd.Series(out, dtype=object)

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", F.explode(run(body)).alias("p")).select("doc_id", "p.*")
    with small_batches(docs.sparkSession):
        return cut(rows.select(F.monotonically_increasing_id().alias("uid"), "*"))


class Genome:
    """Sequences as lists of pieces, with their fill; best fit by a bit set of the free room that occurs."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def open(self, items: list[int]) -> None:
        self.bins.append(items)
        self.fill.append(sum(self.lengths[i] for i in items))

    def insert(self, items: list[int]) -> Genome:
        """Best-fit the items in the given order."""
        room: dict[int, list[int]] = {}
        mask = 0
        for b, f in enumerate(self.fill):
            free = self.capacity - f
            room.setdefault(free, []).append(b)
            mask |= 1 << free
        for i in items:
            size = self.lengths[i]
            fits = mask >> size
            if fits:
                free = size + (fits & -fits).bit_length() - 1
                b = room[free].pop()
                if not room[free]:
                    mask &= ~(1 << free)
                self.bins[b].append(i)
                self.fill[b] += size
            else:
                free, b = self.capacity, len(self.bins)
                self.bins.append([i])
                self.fill.append(size)
            room.setdefault(free - size, []).append(b)
            mask |= 1 << (free - size)
        return self

    def fitness(self) -> tuple[int, int]:
        """Fewer sequences first, then uneven fills: one nearly empty sequence is easier to save than two half full ones."""
        return -len(self.bins), sum(f * f for f in self.fill)

    def without(self, items: set[int]) -> tuple[Genome, list[int]]:
        """A genome without the sequences that hold any of the items, and their other pieces."""
        out, loose = Genome(self.lengths, self.capacity), []
        for b, f in zip(self.bins, self.fill, strict=True):
            if items.isdisjoint(b):
                out.bins.append(list(b))
                out.fill.append(f)
            else:
                loose.extend(i for i in b if i not in items)
        return out, loose


def crossover(a: Genome, b: Genome, rng: np.random.Generator) -> Genome:
    """``a`` with well-filled sequences of ``b``."""
    order = np.argsort([-f for f in b.fill], kind="stable")
    well = [int(i) for i in order[: max(1, len(order) // 2)]]
    chosen = [well[i] for i in rng.choice(len(well), max(1, len(well) // 4), replace=False)]
    child, loose = a.without({i for c in chosen for i in b.bins[c]})
    for c in chosen:
        child.open(list(b.bins[c]))
    return child.insert(sorted(loose, key=lambda i: -a.lengths[i]))


def mutate(g: Genome, rng: np.random.Generator) -> Genome:
    """``g`` with its least filled sequences, and a few others, dissolved."""
    order = np.argsort(g.fill, kind="stable")
    gone = {int(i) for i in order[: max(1, len(order) // 50)]} | {int(i) for i in rng.choice(len(order), max(1, len(order) // 50), replace=False)}
    out, loose = Genome(g.lengths, g.capacity), []
    for i, (b, f) in enumerate(zip(g.bins, g.fill, strict=True)):
        if i in gone:
            loose.extend(b)
        else:
            out.bins.append(list(b))
            out.fill.append(f)
    return out.insert(sorted(loose, key=lambda i: -g.lengths[i]))


def evolve(lengths: list[int], capacity: int, parents: list[Genome], seed: tuple[int, ...], generations: int = GENERATIONS) -> Genome:
    """The best genome after some generations, or as soon as one needs no more sequences than the total length demands."""
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // capacity)
    sizes = np.array(lengths)
    people = list(parents)
    if not people:
        people.append(Genome(lengths, capacity).insert(np.argsort(-sizes, kind="stable").tolist()))
    while len(people) < POPULATION and len(people[0].bins) > least:
        noisy = sizes * rng.uniform(0.8, 1.2, len(sizes))
        people.append(Genome(lengths, capacity).insert(np.argsort(-noisy, kind="stable").tolist()))
    people.sort(key=Genome.fitness, reverse=True)
    for _ in range(generations):
        if len(people[0].bins) <= least or len(people) < 2:
            break
        # the better of two drawn at random is a parent
        i, j = (min(rng.integers(len(people), size=2)) for _ in range(2))
        child = mutate(crossover(people[i], people[j if j != i else (i + 1) % len(people)], rng), rng)
        people.append(child)
        people.sort(key=Genome.fitness, reverse=True)
        people.pop()
    return people[0]


def _genome(lengths: list[int], bins: np.ndarray, capacity: int) -> Genome:
    g = Genome(lengths, capacity)
    order = np.argsort(bins, kind="stable")
    for part in np.split(order, np.nonzero(np.diff(bins[order]))[0] + 1):
        g.open(part.tolist())
    return g


def _epoch(rows: DataFrame, epoch: int, level: int, capacity: int) -> DataFrame:
    """One epoch on each (block, island): rows (uid, length, block, island, parent, bin), bin -1 before the first."""
    schema = "uid long, length long, block long, island int, parent int, bin int, score long"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        block, island = int(part["block"].iloc[0]), int(part["island"].iloc[0])
        part = part.sort_values(["parent", "uid"], kind="stable")
        one = part[part["parent"] == part["parent"].iloc[0]]
        lengths = one["length"].tolist()
        parents = [_genome(lengths, p["bin"].to_numpy(), capacity) for _, p in part.groupby("parent") if p["bin"].iloc[0] >= 0]
        best = evolve(lengths, capacity, parents, (level, block, island, epoch))
        bins = np.empty(len(one), np.int32)
        for b, items in enumerate(best.bins):
            bins[items] = b
        count, square = best.fitness()
        # one number that orders as the fitness does: squares of fills add up to less than 2 ** 40 in a block
        return one.assign(bin=bins, parent=island, score=(count << 40) + square)[["uid", "length", "block", "island", "parent", "bin", "score"]]

    return cut(rows.groupBy("block", "island").applyInPandas(run, schema))


def _packed(rows: DataFrame, level: int, blocks: int, islands: int, epochs: int, capacity: int) -> DataFrame:
    """(uid, length, block, bin, place, fill): the best island's grouping of each block."""
    state = rows.select(
        "uid", "length", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(0).alias("parent"), F.lit(-1).alias("bin"),
    )
    state = _epoch(state, 0, level, capacity)
    for epoch in range(1, epochs):
        # each island's elite stays and also moves to the next island
        moved = state.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
        state = _epoch(state.union(moved).drop("score"), epoch, level, capacity)
    best = state.groupBy("block").agg(F.max(F.struct("score", -F.col("island"))).alias("top")).select("block", (-F.col("top.col2")).cast("int").alias("island"))
    chosen = state.join(best, ["block", "island"])

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bin", "uid"], kind="stable")
        total = part.groupby("bin")["length"]
        return part.assign(place=total.cumsum() - part["length"], fill=total.transform("sum"))[["uid", "length", "block", "bin", "place", "fill"]]

    return cut(chosen.groupBy("block").applyInPandas(place, "uid long, length long, block long, bin int, place long, fill long"))


def packed(
    found: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, filled: float = FILLED
) -> DataFrame:
    """The stored pieces with sequence_id and offset."""
    full = found.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("uid") * 2, "offset": F.lit(0).cast("long")})
    rest, done = found.where(F.col("length") < capacity).select("uid", "length"), []
    short = F.col("fill") < F.lit(capacity * filled)
    pieces_left = rest.count()
    before, kept = pieces_left, None  # sequences that the level starts from, at first one to a piece, and their grouping
    for level in range(LEVELS):
        blocks = max(1, -(-pieces_left // block))
        now = _packed(rest, level, blocks, islands, epochs, capacity)
        # odd numbers; a block has fewer than 2 ** 20 sequences
        name = ((F.lit(level) * F.lit(1 << 32) + F.col("block")) * F.lit(1 << 20) + F.col("bin")) * 2 + 1
        now = now.select("uid", "length", "fill", name.alias("sequence_id"), F.col("place").alias("offset"))
        # every sequence has one piece at its start
        first = F.col("offset") == 0
        n = now.agg(F.count_if(first).alias("all"), F.count_if(first & short).alias("short"), F.count_if(short).alias("pieces")).first()
        if kept is not None and n["all"] > before:
            done.append(kept)
            break
        if blocks == 1 or n["all"] >= before or not n["short"] or level == LEVELS - 1:
            done.append(now)
            break
        done.append(now.where(~short))
        kept = now.where(short)
        rest, before, pieces_left = kept.select("uid", "length"), n["short"], n["pieces"]
    done = [d.select("uid", "sequence_id", "offset") for d in done]
    placed = done[0]
    for d in done[1:]:
        placed = placed.union(d)
    return full.unionByName(found.join(placed, "uid")).drop("uid")


def pack(docs: DataFrame, coder: tuple, text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    return packed(pieces(docs, coder, text))


def public_coder() -> tuple[str, str, str]:
    """Arguments of ``encoder`` for the byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
