"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two words counts their common subsequences of three letters (word ends count as letters), gaps allowed, each
weighted by ``DECAY`` per letter of gap in either word and divided by the weight of the words' lengths.  An insult with
inserted letters or a gap thus stays close to the plain one.  Letters are lower-cased; digits and signs that stand for letters
inside a word are read as such, other signs inside a word are dropped, and runs of single letters are read as one word.

Training is on labelled sentences, which inherit the label of their document.  A sentence is as toxic as its worst word, its
witness.  The machine alternates between naming the witnesses of the sentences of toxic documents and fitting a
squared-hinge SVM to them against the words of clean sentences, in the space that ``landmarks`` words span (Nyström).  A witness
that few others resemble comes from a document with a wrong label and is left out.  Since the machine is linear in the kernel,
landmarks and weights fold into one table over letter triples: scoring a word costs the same for any number of landmarks.  A
logistic, fitted to documents kept back from the machine, gives the probability of a word, and a text is toxic unless its
``WORST`` worst words are all harmless.

The training sample is bounded by ``max_rows`` documents (a hash of the id decides), so the model is too.  Scoring visits every
word of every text once per task, in Arrow batches without a shuffle.

Odd rows: null and empty texts have no word and get the probability of the lowest decisions, ``FLOOR``; repeated rows score
alike; null, other than 0 / 1, or contradictory labels are not learnt; with no toxic or no clean row every score is the share
of toxic rows (0 without any row); an empty table gives an empty result.  Other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwave.llm.common import training_labels

MAX_ROWS = 12_000  # bound of the training sample
LANDMARKS = 384
ROUNDS = 4
DECAY, SPAN = 0.6, 6  # weight of a letter of gap, and the letters that three may spread over
WORST = 3  # words that a text's probability rests on
ALIKE = 0.45  # kernel value from which two words are of one family
THRESHOLD = 0.3
FLOOR = -3.0

_WIDE, _STEP = 30, 20  # longer words are read in overlapping windows
_CACHE = 600_000
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_SINGLE = re.compile(r"(?<!\S)(?:[^\W\d_][\s.\-_*]+){2,}[^\W\d_](?!\S)")
#: signs that stand for letters inside a word (fixed values)
_LIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]

# letters to 1..61, word ends to 62 and 63
_LETTER = np.zeros(0x250, np.int64)
_LETTER[0x61:0x7B] = np.arange(1, 27)
_LETTER[0xAA:] = 27 + np.arange(0x250 - 0xAA) % 35
_START, _END = 62, 63


def plain(token: str) -> str:
    """The letters of a token."""
    token = token.lower()
    if token.isalpha():
        return token
    inner = token.strip("!$@") or token
    if any(c.isalpha() for c in inner):
        core = inner.strip("0123456789.,;:()[]\"'*&%#|=-+/\\?")
        if sum(c.isalpha() for c in core) * 2 > len(core):
            inner = core.translate(_LIKE)
    return _NOT_LETTER.sub("", inner)


def tokens(text: str) -> Iterable[str]:
    """The distinct white-space tokens of a text, and its runs of single letters as one token each."""
    found = set(text.split())
    if any(len(t) == 1 for t in found):
        found.update(_NOT_LETTER.sub("", m) for m in _SINGLE.findall(text))
    return found


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of the words' windows, one row each and zero behind their ends, and the word of each row."""
    parts, of = [], []
    for i, w in enumerate(words):
        for at in range(0, max(1, len(w) - (_WIDE - _STEP)), _STEP) if len(w) > _WIDE else (0,):
            parts.append(w[at : at + _WIDE])
            of.append(i)
    width = max((len(p) for p in parts), default=0)
    raw = "".join(p.ljust(width, "\0") for p in parts).encode("utf-32-le")
    chars = np.frombuffer(raw, np.uint32).reshape(len(parts), width).astype(np.int64)
    known = np.where(chars < 0x250, _LETTER[np.minimum(chars, 0x24F)], 27 + chars % 35)
    out = np.zeros((len(parts), width + 2), np.int64)
    out[:, 0] = _START
    out[:, 1:-1] = known
    out[np.arange(len(parts)), 1 + np.array([len(p) for p in parts], np.int64)] = _END
    return out, np.array(of, np.int64)


def triples(rows: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Codes of letter triples at each distance, -1 where a row has ended, with the weight of the gap."""
    for a, b in _OFFSETS:
        if rows.shape[1] > b:
            last = rows[:, b:]
            code = rows[:, :-b] << 12 | rows[:, a : rows.shape[1] - b + a] << 6 | last
            yield np.where(last > 0, code, -1), DECAY ** (b - 2)


def norms(rows: np.ndarray) -> np.ndarray:
    """Root of the kernel of a string of this length with itself, its triples all different."""
    n = (rows > 0).sum(1)
    return np.sqrt(sum(np.maximum(n - b, 0) * DECAY ** (2 * (b - 2)) for _, b in _OFFSETS) + 1e-9)


def kernel(rows: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Kernel values of each row with each landmark."""
    seen = np.unique(np.concatenate([c[c >= 0] for c, _ in triples(marks)]))
    place = np.zeros(1 << 18, np.int64)
    place[seen] = np.arange(1, len(seen) + 1)
    table = np.zeros((len(seen) + 1, len(marks)), np.float32)
    for code, weight in triples(marks):
        row, col = np.nonzero(code >= 0)
        np.add.at(table, (place[code[row, col]], row), weight)
    table /= norms(marks).astype(np.float32)
    out = np.zeros((len(rows), len(marks)), np.float32)
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        for code, weight in triples(part):
            hit = np.where(code >= 0, place[code], 0)
            out[at : at + 256] += np.float32(weight) * table[hit].sum(1)
    return out / norms(rows)[:, None].astype(np.float32)


@dataclass
class Model:
    """Weights over letter triples, and the logistic that turns a decision into a word's probability."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def decide(self, words: list[str]) -> np.ndarray:
        """The machine's decision on each word; words of under three letters get ``FLOOR``."""
        out = np.full(len(words), FLOOR)
        # words of like length together, so that rows are not padded much
        size = np.array([len(w) for w in words])
        for low, high in ((3, 8), (9, 14), (15, _WIDE), (_WIDE + 1, 1 << 31)):
            chosen = np.nonzero((size >= low) & (size <= high))[0]
            for at in range(0, len(chosen), 20_000):
                ids = chosen[at : at + 20_000]
                rows, of = letters([words[i] for i in ids])
                total = np.zeros(len(rows))
                for code, weight in triples(rows):
                    total += weight * self.weights[code].sum(1)
                np.maximum.at(out, ids[of], total / norms(rows) + self.bias)
        return out

    def probability(self, worst: np.ndarray) -> np.ndarray:
        """Of texts, from the decisions on their ``WORST`` worst words: that not all of the words are harmless."""
        harmless = 1 / (1 + np.exp(np.clip(self.slope * worst + self.offset, -30, 30)))
        return 1 - harmless.prod(1)


def _even(share: float) -> float:
    """The offset at which ``WORST`` words together have this probability."""
    each = 1 - (1 - min(max(share, 1e-9), 1 - 1e-9)) ** (1 / WORST)
    return float(np.log(each / (1 - each)))


def worst_of(decisions: Iterable[float]) -> list[float]:
    """The ``WORST`` largest decisions, falling, filled up with ``FLOOR``."""
    return [*sorted(decisions, reverse=True)[:WORST], *[FLOOR] * WORST][:WORST]


def _table(marks: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Landmarks and their weights folded into one weight per triple; the last entry, index -1, is zero."""
    out, scale = np.zeros((1 << 18) + 1), beta / norms(marks)
    for code, weight in triples(marks):
        row, col = np.nonzero(code >= 0)
        np.add.at(out, code[row, col], weight * scale[row])
    return out


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, steps: int = 12) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    reg = np.eye(x.shape[1])
    reg[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for k in range(steps):
        inside = y * (x @ w) < 1
        xa, ca = x[inside], c[inside]
        new = np.linalg.solve(reg + (xa * ca[:, None]).T @ xa, xa.T @ (ca * y[inside]))
        done = np.abs(new - w).max() < 1e-5
        # full steps settle which rows are inside; damped ones end a cycle between two sets
        w = new if k < steps // 2 else 0.5 * (w + new)
        if done:
            break
    return w[:-1], float(w[-1])


def _calibrated(model: Model, worst: np.ndarray, y: np.ndarray) -> Model:
    """The model with the slope and middle of a grid under which these texts are likeliest."""
    best = np.inf
    for slope in np.geomspace(1, 20, 25):
        for middle in np.linspace(-1, 1.5, 51):
            model.slope, model.offset = float(slope), float(-slope * middle)
            p = np.clip(model.probability(worst), 1e-4, 1 - 1e-4)  # a wrong label costs no more than that
            loss = -np.where(y == 1, np.log(p), np.log(1 - p)).sum()
            if loss < best:
                best, found = loss, (model.slope, model.offset)
    model.slope, model.offset = found
    return model


def _supported(rows: np.ndarray, count: np.ndarray, toxic: int) -> np.ndarray:
    """Which witnesses have enough others like them; the rest come from documents with a wrong label.  All, if none has."""
    like = np.concatenate([(kernel(rows[at : at + 512], rows) >= ALIKE) @ count for at in range(0, len(rows), 512)])
    enough = like >= max(3, toxic / 200)
    return enough if enough.any() else np.ones(len(rows), bool)


def fit(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """The machine for these documents; every fourth is kept for the probabilities alone."""
    every = np.arange(len(labels)) % 4 != 3
    spare = [(t, v) for t, v, k in zip(texts, labels, every, strict=True) if not k]
    texts = [t for t, k in zip(texts, every, strict=True) if k]
    y = np.array(labels)[every]
    constant = Model(np.zeros((1 << 18) + 1), 0.0, 0.0, _even(y.mean()) if len(y) else -30.0)
    if not 0 < y.sum() < len(y):
        return constant
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    place: dict[str, int] = {}
    sentences, sent_y, of_doc, owner = [], [], [], []
    for i, text in enumerate(texts):
        for part in _SENTENCE.split(text):
            at = place.get(part)
            if at is None:
                ids = {number.setdefault(w, len(number)) for w in {plain(t) for t in tokens(part)} if len(w) > 2}
                at = place[part] = len(sentences) if ids else -1
                if ids:
                    sentences.append(np.fromiter(ids, np.int64))
                    sent_y.append(1)
            if at >= 0:
                # copies of a sentence count once; one that a clean document has too is clean
                sent_y[at] = min(sent_y[at], int(y[i]))
                of_doc.append(at)
                owner.append(i)
    if not sentences:
        return constant
    words, sent_y = list(number), np.array(sent_y)
    flat, starts = np.concatenate(sentences), np.cumsum([0, *map(len, sentences[:-1])])
    in_sentences = [Counter(), Counter()]
    for ids, label in zip(sentences, sent_y, strict=True):
        in_sentences[label].update(ids.tolist())
    clean = np.array([in_sentences[0][i] for i in range(len(words))], float)
    toxic = np.array([in_sentences[1][i] for i in range(len(words))], float)

    # first guess of a word's weight: log ratio of the shares of toxic and clean sentences that have its triples
    share = np.zeros((2, (1 << 18) + 1))
    rows, of = letters(words)
    for code, _ in triples(rows):
        row, col = np.nonzero(code >= 0)
        np.add.at(share[0], code[row, col], clean[of[row]])
        np.add.at(share[1], code[row, col], toxic[of[row]])
    ratio = np.log((share[1] + 0.5) / (share[1].sum() + 1)) - np.log((share[0] + 0.5) / (share[0].sum() + 1))
    ratio[-1] = 0
    model = Model(ratio, 0.0, 1.0, 0.0)
    for _ in range(rounds):
        decision = model.decide(words)
        worst = np.maximum.reduceat(decision[flat], starts)
        high = np.full(len(y), -np.inf)
        np.maximum.at(high, np.array(owner), worst[of_doc])
        limit = np.quantile(high[y == 0], 0.9)
        # witnesses: in each toxic document the worst word of its worst sentence, and of others beyond what clean ones reach
        chosen = {s for s, i in zip(of_doc, owner, strict=True) if sent_y[s] == 1 and (worst[s] >= high[i] or worst[s] > limit)}
        witness = Counter(int(sentences[s][np.argmax(decision[sentences[s]])]) for s in chosen)
        # and words that many toxic sentences have and no clean one, which worse words beside them may hide
        witness.update({int(w): int(toxic[w]) for w in np.nonzero((clean == 0) & (toxic >= max(5, y.sum() / 100)))[0]})
        pos = np.array([w for w in witness if witness[w] > clean[w]], np.int64)
        if not len(pos):
            break
        pos = pos[_supported(letters([words[i][:_WIDE] for i in pos])[0], np.array([witness[w] for w in pos]), y.sum())]
        pool = np.nonzero(clean > 0)[0]
        hard = pool[np.argsort(-decision[pool], kind="stable")[:4000]]
        common = pool[np.argsort(-clean[pool], kind="stable")[:1000]]
        other = rng.choice(pool, min(len(pool), 3000), replace=False)
        neg = np.setdiff1d(np.unique(np.concatenate([hard, common, other])), pos)
        by_use = pos[np.argsort([-witness[w] for w in pos], kind="stable")]
        half = landmarks // 2
        marks = [*by_use[: half // 2], *rng.permutation(by_use[half // 2 :])[: half - half // 2]]
        # near misses that are frequent, others near, and any
        near = hard[np.argsort(-clean[hard[:400]], kind="stable")]
        marks += [*near[: half // 4], *rng.choice(hard, min(len(hard), half // 4), replace=False), *rng.choice(neg, min(len(neg), half // 2), replace=False)]
        mark_rows = letters([words[i][:_WIDE] for i in dict.fromkeys(marks)])[0]
        values, vectors = np.linalg.eigh(kernel(mark_rows, mark_rows).astype(float))
        keep = values > 1e-3 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        train = np.concatenate([pos, neg])
        target = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        # as often as they are seen, up to a limit; both sides weigh the same
        weight = np.r_[np.minimum([witness[w] for w in pos], 10.0), np.minimum(clean[neg], 10.0)]
        weight[: len(pos)] *= min(4.0, weight[len(pos) :].sum() / weight[: len(pos)].sum())
        w, bias = _svm(kernel(letters([words[i][:_WIDE] for i in train])[0], mark_rows) @ root, target, weight)
        model = Model(_table(mark_rows, root @ w), bias, 1.0, 0.0)
    if len({v for _, v in spare}) < 2:  # too few documents to keep some back
        spare = list(zip(texts, y.tolist(), strict=True))
    high = [worst_of(model.decide([plain(t) for t in tokens(text)])) for text, _ in spare]
    return _calibrated(model, np.array(high), np.array([v for _, v in spare]))


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", text: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """The machine from at most about ``max_rows`` labelled rows outside the held-out fold, fitted in one task."""
    known = training_labels(labels, column)
    n = known.count()
    if n > max_rows:
        share = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_003))
        known = known.where(share < int(1_000_003 * max_rows / n))
    # at most about max_rows rows of two numbers
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(known), "doc_id").withColumn("one", F.lit(1))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.fillna({"text": ""}).sort_values(["doc_id", "text"], kind="stable")
        m = fit(part["text"].tolist(), part["label"].tolist())
        return pd.DataFrame({"w": [m.weights.astype(np.float32).tobytes()], "b": [m.bias], "s": [m.slope], "o": [m.offset]})

    found = rows.groupBy("one").applyInPandas(run, "w binary, b double, s double, o double").collect()
    if not found:
        return fit([], [])
    m = found[0]
    return Model(np.frombuffer(m["w"], np.float32).astype(np.float64), m["b"], m["s"], m["o"])


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The probability of being toxic as a column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def worst(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, known = shared.value, {}
        for batch in batches:
            out = np.full((len(batch), WORST), FLOOR)
            for at in range(0, len(batch), 1000):
                some = [tokens(t or "") for t in batch.iloc[at : at + 1000]]
                if len(known) > _CACHE:
                    known = {}
                new = list(set().union(*some).difference(known))
                known.update(zip(new, m.decide([plain(t) for t in new]).tolist(), strict=True))
                for i, found in enumerate(some):
                    out[at + i] = worst_of(map(known.__getitem__, found))
            yield pd.Series(m.probability(out))

    return worst(F.coalesce(F.col(text), F.lit("")))
