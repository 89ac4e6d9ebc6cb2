"""Which of five document filters removes what, in every order, and what each adds to the others.

Filters (F.A to F.E of ``FILTERS``): few words, few distinct words, many capitals, odd signs, and copy of a document with a smaller id.  A
document's failures are a mask of five bits; documents are counted per (part, mask, labels), and each of the 120 orders is read
off these counts.

Copies are found by compressed tries over whole texts:

1. Texts are dealt by prefix.  A prefix whose texts hold more bytes than ``BUCKET`` (or a quarter of an even share), and are not all one
   text, is made four times as long until it does not, so the key of a text is as long as its neighbourhood is dense.
2. A task puts its rows into a trie, which leaves one entry per text and task: a text that holds a third of all rows crosses the
   network once per task.
3. Entries are range-partitioned by key.  Each key's texts go to a trie whose terminals hold the smallest id; a traversal lists these ids.  All
   other documents are copies, so copies need not be listed.

A trie holds at most one bucket of different texts (tasks in step 2 hand theirs on at ``TRIE`` bytes), whatever the table's size.

Odd rows: a null text is empty; a null part is the empty text; a null id is no copy and nothing is a copy of it; rows of one text with
the same smallest id are no copies of each other; a document is labelled good or toxic if any row of its id in the labels says so; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwave.llm.common import small_batches
from cartwave.session import cut

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
BUCKET = 64 << 20
TRIE = 64 << 20
PREFIX = 16  # characters of the shortest key
_SPACE = r"[\x20\x09-\x0D]+"


class _Node:
    __slots__ = ("label", "children", "least", "parts", "key")

    def __init__(self, label: bytes):
        self.label, self.children = label, {}
        self.least = self.parts = self.key = None


class TextTrie:
    """A radix trie over byte strings; a terminal holds the smallest id put in and the parts of the rows with that id."""

    def __init__(self):
        self.root, self.bytes = _Node(b""), 0  # bytes of all texts held

    def put(self, text: bytes, least: int, parts: Iterable[str], key: str = "") -> None:
        node = self._terminal(text)
        if node.least is None:
            self.bytes += len(text)
            node.key = key
        if node.least is None or least < node.least:
            node.least, node.parts = least, set(parts)
        elif least == node.least:
            node.parts.update(parts)

    def _terminal(self, text: bytes) -> _Node:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = _Node(text[at:])
                return child
            if not text.startswith(child.label, at):
                child = self._split(node, child, _shared(child.label, text[at : at + len(child.label)]))
            at += len(child.label)
            node = child
        return node

    def _split(self, parent: _Node, child: _Node, at: int) -> _Node:
        """A node for the first ``at`` bytes of a child's label, with the child below it."""
        middle = _Node(child.label[:at])
        child.label = child.label[at:]
        middle.children[child.label[0]] = child
        parent.children[middle.label[0]] = middle
        return middle

    def walk(self) -> Iterator[tuple[bytes, _Node]]:
        """Every terminal with its text."""
        open_ = [(self.root, b"")]
        while open_:
            node, before = open_.pop()
            text = before + node.label
            if node.least is not None:
                yield text, node
            open_.extend((c, text) for c in node.children.values())


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")

    def bits(counts: Column) -> Column:
        n, different, capitals = (counts[k] for k in ("n", "different", "capitals"))
        conditions = [
            n < 200,
            F.lit(100) * different < F.lit(50) * n,
            F.lit(100) * capitals > F.lit(2) * F.length(text),
            text.rlike(r"[#$%&*|]"),
        ]
        return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)), F.lit(0))

    counted = F.transform(F.array(words), lambda w: F.struct(
        F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).alias("capitals"),
    ))
    return F.element_at(F.transform(counted, bits), 1)


def keyed(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows with ``key``, the prefix of their text that is long enough to keep their bucket small.

    Prefixes that must grow are known by a hash, so their lists are bounded: at most four per task and one per ``BUCKET`` bytes a round.  A
    clash of hashes makes a key longer than it need be, no more.  A round reads only texts whose shorter prefix must grow, as no
    other's can; the lists stand in the expression of the key, so no round joins the rows.
    """
    size = F.length(F.col("text").cast("binary")).cast("long")
    total = rows.agg(F.sum(size)).first()[0] or 0
    bound = max(1, min(BUCKET, total // (4 * tasks)))
    rounds: list[list[int]] = []  # hashes of the prefixes of PREFIX * 4 ** i characters that must grow
    open_ = rows
    while True:
        prefix = F.substring("text", 1, PREFIX * 4 ** len(rounds))
        heavy = (
            open_.where(F.length(prefix) == PREFIX * 4 ** len(rounds)).groupBy(prefix.alias("key"))
            .agg(F.sum(size).alias("bytes"), F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
            .where((F.col("bytes") > bound) & (F.col("low") != F.col("high")))
            .select(F.xxhash64("key").alias("_heavy")).distinct()
        )
        found = [r[0] for r in heavy.collect()]
        if not found:
            break
        open_ = open_.where(F.xxhash64(prefix).isin(found))
        rounds.append(found)
    key = F.substring("text", 1, PREFIX * 4 ** len(rounds))
    for i in reversed(range(len(rounds))):
        prefix = F.substring("text", 1, PREFIX * 4**i)
        key = F.when(F.xxhash64(prefix).isin(rounds[i]), key).otherwise(prefix)
    return rows.withColumn("key", key)


def first_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, part, name) of the rows that hold the smallest id of their text, once each; ``rows`` has text, doc_id, part and key."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def entries(trie: TextTrie) -> pd.DataFrame:
        found = [(e.key, text, e.least, list(e.parts)) for text, e in trie.walk()]
        return pd.DataFrame(found, columns=["key", "text", "least", "parts"])

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = TextTrie()
        for b in batches:
            for key, text, doc_id, part in zip(b["key"], b["text"], b["doc_id"], b["part"], strict=True):
                trie.put(text, doc_id, (part,), key)
                if trie.bytes > TRIE:
                    yield entries(trie)
                    trie = TextTrie()
        yield entries(trie)

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def firsts(trie: TextTrie) -> pd.DataFrame:
            out = [(e.least, part, e.key) for _, e in trie.walk() for part in e.parts]
            return pd.DataFrame(out, columns=["doc_id", "part", "name"])

        trie, now = TextTrie(), None
        for b in batches:
            for key, text, doc_id, parts, name in zip(b["key"], b["text"], b["least"], b["parts"], b["name"], strict=True):
                if key != now and trie.bytes > TRIE // 8:
                    yield firsts(trie)
                    trie = TextTrie()
                now = key
                trie.put(text, doc_id, parts, name)
        yield firsts(trie)

    shape = "key string, text binary, least long, parts array<string>"
    inside = rows.withColumn("text", F.col("text").cast("binary"))
    dealt = inside.mapInPandas(combine, shape).repartitionByRange(tasks, "key").sortWithinPartitions("key")
    return dealt.withColumn("name", F.xxhash64("text")).mapInPandas(least, "doc_id long, part string, name long")


def masks(docs: DataFrame, labels: DataFrame, part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail, all five, and by their labels.

    A document is told from others of its id and part by a hash of its text.
    """
    slim = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"),
    )
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = first_copies(keyed(slim.where("doc_id is not null"), tasks)).withColumn("first", F.lit(True))
    marked = slim.select("doc_id", "part", failures(F.col("text")).alias("mask"), F.xxhash64(F.col("text").cast("binary")).alias("name"))
    told = marked.join(first, ["doc_id", "part", "name"], "left").join(said, "doc_id", "left").fillna(0, ["good", "toxic"])
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), F.lit(COPY)).otherwise(F.lit(0))
    mask = F.col("mask").bitwiseOR(copy).cast("int").alias("mask")
    return told.groupBy("part", mask, "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from (stored) documents counted by part, mask and labels."""
    rows = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    ).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))
    orders = ",".join("".join(o) for o in permutations(FILTERS))
    bit = "shiftleft(1, instr('{}', substring(filter_order, {}, 1)) - 1)".format
    each = (
        rows.select("*", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
        .withColumn("own", F.expr(bit(FILTERS, "step")))
        .withColumn("before", F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (a, i) -> if(i < step, a | {bit(FILTERS, 'i')}, a))"))
    )

    def total(what: str, condition) -> Column:
        inside = F.filter("held", lambda h: condition(h["mask"]))
        return F.aggregate(inside, F.lit(0).cast("long"), lambda a, h: a + h[what])

    own, before = F.col("own"), F.col("before")
    passed = lambda m: m.bitwiseAND(before) == 0
    fails = lambda m: m.bitwiseAND(own) != 0
    counted = each.select(
        "part", "filter_order", "step", "own",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total("n", lambda m: passed(m) & fails(m)).alias("removed"),
        total("n", lambda m: ~passed(m) & fails(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", lambda m: passed(m) & fails(m)).alias("good_lost"),
        total("toxic", lambda m: passed(m) & fails(m)).alias("toxic_lost"),
    )
    share = counted.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return counted.join(share, ["part", "own"]).drop("own")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The interactions of the five filters over documents, per part."""
    with small_batches(docs.sparkSession):
        counts = cut(masks(docs, labels, part))
    return interactions(counts)
