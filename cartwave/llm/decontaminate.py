"""Benchmark decontamination by templates.

Numbers, the units behind them and names (capitals inside a sentence) become typed placeholders; the other words are lower-cased.
Windows of ``WINDOW`` template words of documents and benchmark items meet in a hash join.  Where they meet, the words behind the
placeholders are compared: along one alignment of a document with an item, a value of the item must always stand for the same
value of the document.  Alignments that fail this are no hits.  A document holds an item if at least ``COVERAGE`` of the item's
windows are hit; it is a ``copy`` if all values are the item's own, else a ``template``.  Windows with under ``WORDS`` words
besides placeholders say little and count only with the item's own values.

All of it is DataFrame operations.  The item windows are counted and broadcast up to ``BROADCAST`` rows; then the documents are
read once and nothing of them is shuffled but hits.  Beyond that, windows are shuffled with their words, and the text stays behind.

Odd rows: null texts are empty; a text shorter than a window is one window of its own, so a short item is only found as a whole
text; empty texts hold nothing and an empty item is held by none; rows that share doc_id and text share a row of the result; null
doc_id and item_id are ids like any other; an empty table on either side gives an empty result.  Other columns are kept by
``without_leaks``, whatever their names, and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwave.session import cut

WINDOW = 5
WORDS = 3
COVERAGE = 0.5
BROADCAST = 1_000_000

# marks before the words that are slots: number, name, unit
_NUMBER, _NAME, _UNIT = "\x01", "\x02", "\x03"
#: units that may follow a number (fixed values)
UNITS = (
    "kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "miles", "mile", "feet", "inches", "l", "ml", "hours", "hour", "minutes",
    "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "cents",
    "euros", "euro", "percent",
)
_FIGURE = "[0-9]+(?:[.,][0-9]+)*"
STEPS = (
    # (there, pattern, replacement) in order; group numbers as in Spark
    ("[0-9]", f"({_FIGURE})( ?)({'|'.join(sorted(UNITS, key=len, reverse=True))})($|[^\\p{{L}}\\p{{N}}])", f"{_NUMBER}$1 {_UNIT}$3$4"),
    ("[0-9]", f"{_NUMBER}?({_FIGURE})", f"{_NUMBER}$1"),
    ("", r"([\p{Ll},;] )(\p{Lu})", f"$1{_NAME}$2"),
)
TOKEN = f"{_NUMBER}{_FIGURE}|[{_NAME}{_UNIT}]?\\p{{L}}+|\\p{{N}}+"


def marked(text: Column) -> Column:
    """The text in lower case with a mark before each slot."""
    out = F.translate(F.coalesce(text, F.lit("")), _NUMBER + _NAME + _UNIT, "   ")
    for there, pattern, new in STEPS:
        done = F.regexp_replace(out, pattern, new)
        out = F.when(text.rlike(there), done).otherwise(out) if there else done
    return F.lower(out)


def template_words(text: Column) -> Column:
    """The words of a marked text with placeholders in place of slots."""
    plain = F.regexp_replace(text, f"({_NUMBER})[0-9.,]*[0-9]|([{_NAME}{_UNIT}])\\p{{L}}+", "$1$2")
    return F.regexp_extract_all(plain, F.lit(f"[{_NUMBER}{_NAME}{_UNIT}]|\\p{{L}}+|\\p{{N}}+"), F.lit(0))


def slot_words(text: Column) -> Column:
    """The words of a marked text, slots with their marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def windows(text: Column) -> Column:
    """Hashes of the template windows of a marked text, one for a text shorter than a window, none for one without words."""
    hashes = F.transform(template_words(text), lambda w: F.xxhash64(w))
    return F.transform(F.array(hashes), lambda h: F.when(
        F.size(h) > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - (WINDOW - 1))),
            lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))),
        ),
    ))[0]


def _literal(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~w.rlike(f"^[{_NUMBER}{_NAME}{_UNIT}]")))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, text_hash, item_id, hits, windows, coverage, kind) of the items that documents hold."""
    items = (
        benchmark.select("item_id", marked(F.col("text")).alias("_text"))
        .distinct()
        .select("item_id", F.xxhash64("_text").alias("item_key"), slot_words(F.col("_text")).alias("_words"), windows(F.col("_text")).alias("_hashes"))
        .select("item_id", "item_key", "_words", F.size("_hashes").cast("long").alias("windows"), F.posexplode("_hashes").alias("item_at", "hash"))
        .select("item_id", "item_key", "windows", "item_at", "hash", F.slice("_words", F.col("item_at") + 1, F.lit(WINDOW)).alias("theirs"))
    )
    found = docs.select(
        "doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), marked(F.col(text)).alias("_text")
    )
    found = found.select("doc_id", "text_hash", "_text", F.posexplode(windows(F.col("_text"))).alias("at", "hash"))
    mine = F.slice(slot_words(F.col("_text")), F.col("at") + 1, F.lit(WINDOW)).alias("mine")
    doc = ["doc_id", "text_hash", "at"]
    item = ["item_id", "item_key", "windows", "item_at", "theirs"]
    if items.count() <= BROADCAST:
        # text and words of a row that meets no window are never copied out of the scan's stage
        hits = found.join(F.broadcast(items), "hash").select(*doc, *item, mine)
    else:
        hits = found.select(*doc, "hash", mine).join(items, "hash").select(*doc, *item, "mine")
    same = F.col("mine") == F.col("theirs")
    hits = hits.where(same | (_literal(F.col("theirs")) >= WORDS)).select(
        "doc_id", "text_hash", "item_id", "item_key", "windows", "item_at",
        (F.col("at") - F.col("item_at")).alias("shift"), same.alias("same"),
        F.filter(
            F.arrays_zip(F.col("theirs").alias("theirs"), F.col("mine").alias("mine")),
            lambda z: z["theirs"].rlike(f"^[{_NUMBER}{_NAME}{_UNIT}]"),
        ).alias("slots"),
    )
    hits = cut(hits)  # used twice, and the documents are to be read once
    pair = ["doc_id", "text_hash", "item_id", "item_key"]
    # along one alignment, a value of the item stands for one value of the document
    values = (
        hits.select(*pair, "shift", F.explode("slots").alias("slot"))
        .groupBy(*pair, "shift", F.col("slot.theirs").alias("theirs"))
        .agg(F.min("slot.mine").alias("low"), F.max("slot.mine").alias("high"))
        .groupBy(*pair, "shift")
        .agg(F.max(F.col("low") != F.col("high")).alias("broken"))
        .where("broken")
    )
    on = [hits[c].eqNullSafe(values[c]) for c in [*pair, "shift"]]
    kept = hits.join(values, on, "left_anti")
    return (
        kept.groupBy(*pair, "windows", "item_at").agg(F.max((~F.col("same")).cast("int")).alias("changed"))
        .groupBy(*pair, "windows").agg(F.count(F.lit(1)).alias("hits"), F.max("changed").alias("changed"))
        .where(F.col("hits") >= F.col("windows") * F.lit(coverage))
        .select(
            "doc_id", "text_hash", "item_id", "hits", "windows",
            (F.col("hits") / F.col("windows")).alias("coverage"),
            F.when(F.col("changed") == 1, "template").otherwise("copy").alias("kind"),
        )
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    held = leaks(docs, benchmark, text).select(F.col("doc_id").alias("_held_id"), F.col("text_hash").alias("_held_text")).distinct()
    own = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(held, docs["doc_id"].eqNullSafe(F.col("_held_id")) & (own == F.col("_held_text")), "left_anti")
