"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

A text is a sparse vector over ``2 ** BITS`` hashed features in two blocks, each scaled to length one:

* words and word pairs, lower-cased,
* pairs and triples of word shapes (``Thh1`` -> ``a0``, ``of%%%`` -> ``a%``), where a word that repeats the one before it
  has a shape of its own.

Training takes a bounded sample of labelled rows (``max_rows``), dealt to ``shards`` tasks by a hash of the id.  Each task runs
FTRL-proximal over its rows, and the shards' weights are averaged.  The model is ``2 ** BITS`` floats whatever the corpus.
A score is the logistic of the sparse dot product, computed for every row in Arrow batches without a shuffle.

Odd rows: a null text is the empty text, which has no feature but the constant and so scores the model's prior; repeated rows
score alike; labels that are null, not 0 or 1, or contradictory for an id are not learnt; without any labelled row every score
is 0.5; an empty table gives an empty result.  Other columns of the documents are kept, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwave.llm.common import small_batches, training_labels
from cartwave.session import cut

BITS = 18
MAX_ROWS = 20_000  # bound of the training sample
SHARDS = 4
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
THRESHOLD = 0.7

_LETTERS, _DIGITS, _RUNS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHIFT = np.uint64(64 - BITS)
# words kept in a task's memory before the cache starts anew
_CACHE = 100_000


class _Words(dict):
    """word -> (hash of the word) + (hash of its shape) * 2**32, computed once per word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        shape = _RUNS.sub(r"\1", _DIGITS.sub("0", _LETTERS.sub("a", word)))[:16]
        code = zlib.crc32(word.encode()) | zlib.crc32(shape.encode()) << 32
        self[word] = code
        return code


def _block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, count = np.unique(ids, return_counts=True)
    value = count.astype(np.float64)
    return found, value / np.sqrt(np.dot(value, value))


def features(text: str, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of the whole text; feature 0 is the constant."""
    codes = np.array([words[w] for w in text.lower().split()], np.uint64)
    parts = [(np.zeros(1, np.int64), np.ones(1))]
    if len(codes):
        word, shape = codes & np.uint64(0xFFFFFFFF), codes >> np.uint64(32)
        shape[1:][word[1:] == word[:-1]] = np.uint64(1)
        with np.errstate(over="ignore"):
            pairs = word[:-1] * _A + word[1:] * _B
            shape2 = shape[:-1] * _B + shape[1:] * _C + np.uint64(1)
            shape3 = shape[:-2] * _A + shape[1:-1] * _B + shape[2:] * _C + np.uint64(2)
            for ids in (np.concatenate([word, pairs]), np.concatenate([shape + np.uint64(3), shape2, shape3])):
                parts.append(_block(((ids * _A ^ ids >> np.uint64(29)) * _C >> _SHIFT).astype(np.int64)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int, seed: int) -> np.ndarray:
    """Weights after ``epochs`` passes of FTRL-proximal with per-feature rates."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            ids, x = rows[i]
            zi, ni = z[ids], n[ids]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[i]) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            # two blocks may share a number: add, don't assign
            np.add.at(z, ids, g - sigma * w)
            np.add.at(n, ids, g * g)
    return weights(z, n).astype(np.float32)


def train(
    docs: DataFrame, labels: DataFrame, column: str = "quality", text: str = "text",
    max_rows: int = MAX_ROWS, shards: int = SHARDS, epochs: int = EPOCHS,
) -> np.ndarray:
    """The model's weights from at most about ``max_rows`` labelled rows outside the held-out fold.

    When there are more, a hash of the id decides which are taken.
    """
    known = training_labels(labels, column)
    n = known.count()
    if n > max_rows:
        share = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_003))
        known = known.where(share < int(1_000_003 * max_rows / n))
    # at most about max_rows rows of two numbers
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.fillna({"text": ""}).sort_values(["doc_id", "text"], kind="stable")
        words = _Words()
        w = ftrl([features(t, words) for t in part["text"]], part["label"].tolist(), epochs, int(part["shard"].iloc[0]))
        return pd.DataFrame({"n": [len(part)], "w": [w.tobytes()]})

    models = rows.groupBy("shard").applyInPandas(fit, "n long, w binary").collect()
    if not models:
        return np.zeros(1 << BITS, np.float32)
    sizes = np.array([m["n"] for m in models], float)
    stack = np.stack([np.frombuffer(m["w"], np.float32) for m in models])
    return (sizes @ stack / sizes.sum()).astype(np.float32)


def score(docs: DataFrame, model: np.ndarray, text: str = "text") -> Column:
    """The probability of label 1 as a column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def dot(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, words = shared.value, _Words()
        for batch in batches:
            out = np.empty(len(batch))
            for i, t in enumerate(batch):
                ids, x = features(t or "", words)
                out[i] = w[ids] @ x
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return dot(F.coalesce(F.col(text), F.lit("")))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored at ``threshold`` or more, stored, with their own columns."""
    found = docs.where(score(docs, train(docs, labels)) >= F.lit(threshold))
    # whole texts go to Python
    with small_batches(docs.sparkSession):
        return cut(found)
