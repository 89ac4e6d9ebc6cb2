"""Packing: exact ids, no gaps, near the lower bound, genetic operators, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartwave.llm import packing as p
from cartwave.llm.common import table

CODER = p.public_coder()


def check(rows, texts):
    """Pieces are cut as they should be and lie gapless in sequences of at most the capacity; the number of sequences."""
    slow = Tokenizer.from_file(CODER[0])
    slow.encode_special_tokens = True
    want = []
    for doc, text in texts:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % p.CAPACITY or p.CAPACITY
        cuts = [0, *range(first, len(ids) + 1, p.CAPACITY)]
        want += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= p.CAPACITY
    return len(places)


def test_odd_rows(spark):
    texts = [(None, None), (1, ""), (1, "one two"), (1, "one two"), (2, " " * 30_000 + "<|endoftext|> é\x00"), (3, "word " * 50_000), (4, "x" * 20_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("uid", "length", "block", "bin")})
    check(p.pack(docs, CODER).collect(), texts)
    assert p.pack(docs.limit(0), CODER).count() == 0


@pytest.mark.parametrize("block", [64, p.BLOCK])
def test_few_sequences(spark, sf_dir, block):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = p.packed(p.pieces(docs, CODER), block=block).collect()
    used = check(rows, [tuple(r) for r in docs.collect()])
    assert used <= -(-sum(r["length"] for r in rows) // p.CAPACITY) + 1


def whole(genome, lengths):
    assert sorted(i for b in genome.bins for i in b) == list(range(len(lengths)))
    assert genome.fill == [sum(lengths[i] for i in b) for b in genome.bins] and max(genome.fill) <= genome.capacity


def test_genetic_operators_keep_every_piece_once():
    rng = np.random.default_rng(2)
    for _ in range(40):
        lengths = rng.integers(1, 100, rng.integers(1, 120)).tolist()
        a, b = (p.Genome(lengths, 100).insert(rng.permutation(len(lengths)).tolist()) for _ in range(2))
        whole(a, lengths)
        whole(p.crossover(a, b, rng), lengths)
        whole(p.mutate(a, rng), lengths)
        best = p.evolve(lengths, 100, [a, b], (1, 2))
        whole(best, lengths)
        assert best.fitness() >= max(a.fitness(), b.fitness())


def test_evolution_beats_best_fit():
    """Triples that fill a sequence exactly: best fit alone wastes some."""
    rng = np.random.default_rng(5)
    lengths = []
    for _ in range(40):
        a, b = sorted(rng.integers(200, 800, 2).tolist())
        lengths += [a, b, 2048 - a - b]
    plain = p.Genome(lengths, 2048).insert(sorted(range(len(lengths)), key=lambda i: -lengths[i]))
    best = p.evolve(lengths, 2048, [], (3,), 300)
    whole(best, lengths)
    assert best.fitness() >= plain.fitness() and len(best.bins) <= 41


def test_best_fit_takes_the_tightest():
    g = p.Genome([60, 70, 30, 40, 25], 100).insert([0, 1, 2, 3, 4])
    assert g.bins == [[0, 3], [1, 2], [4]]


@pytest.mark.parametrize(("length", "each"), [(1500, 1), (900, 2)])
def test_pieces_that_fill_no_sequence_end(spark, monkeypatch, length, each):
    """More than a block of pieces that can't be combined to filled sequences."""
    levels, plain = [], p._packed

    def counted(*args):
        levels.append(args[1])
        assert len(levels) <= 4
        return plain(*args)

    monkeypatch.setattr(p, "_packed", counted)
    found = spark.createDataFrame([(i, i, length) for i in range(300)], "uid long, doc_id long, length long")
    rows = p.packed(found, block=64).collect()
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append(r["offset"])
    assert sorted(r["doc_id"] for r in rows) == list(range(300))
    assert all(sorted(x) == [length * i for i in range(len(x))] and len(x) <= each for x in places.values())
    assert len(places) <= 300 // each + 5  # an odd piece to a block at most
