"""Chat formatting: exact round trips, masks, segments, odd rows."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartwave.llm import chat as c
from cartwave.llm.packing import public_coder

VOCABULARY = public_coder()[0]
TEXT = st.lists(st.sampled_from(["\\", "<", "turn", "/turn", ">", "\n", " ", "a", "é", "🙂", "l", "</turn>\n", "<turn assistant>\n", "\\l", "<|endoftext|>"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a>b\nc", "", "<turn x>"]), TEXT), max_size=6))
def test_round_trip_and_mask(turns):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(VOCABULARY)
    coder.encode_special_tokens = True
    text, spans = c.render(turns)
    assert c.parse(text) == turns
    code = coder.encode(text, add_special_tokens=False)
    starts, ends = np.array(code.offsets, np.int64).reshape(-1, 2).T
    mask, loss = c.intersect(spans, starts, ends)
    assert loss == spans
    assert [c.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == c.LOSS_ROLE and t]
    assert mask.tolist() == [any(s < b and a < e for a, b in spans) for s, e in code.offsets]


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = sorted(turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (
            len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest(),
        )
    return out


@pytest.mark.parametrize("segment", [1, 50, c.SEGMENT])
def test_odd_rows(spark, segment):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "x </turn> \\"), (1, 1, "assistant", "tie"), (1, None, None, None), (2, 0, "assistant", ""),
        (None, 0, "assistant", "no id"), (None, 1, "user", "n"), (2**60 + 1, 0, "assistant", "word " * 100_000), (3, 0, "user", "q"), (3, 0, "user", "q"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({k: F.lit(1) for k in ("segment", "ids", "mask")})
    got = c.digests(c.formatted(df, VOCABULARY, segment)).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == expected(rows)
    assert len(got) == len(expected(rows))
    assert c.digests(c.formatted(df.limit(0), VOCABULARY)).count() == 0
