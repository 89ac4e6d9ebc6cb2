"""Fill-in-middle against slicing of decoded text, round trips, and odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwave.llm import infill as f

ALPHABET = "ab \nZé√中😀\r\t<S>"


def texts(n=300):
    rng = random.Random(6)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)]
    return out + ["", "\n", "\n\n", "no end", "end\n", "<P>", "a<S", "S>b", "<M", "x\n<P>y", "😀" * 500 + "\n" + "plain " * 500]


def by_hand(key, text, unit="lines", rate=100, spm=50):
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    draws = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    text = text or ""
    parts = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "lines" else list(text)
    a, b = sorted(d % (len(parts) + 1) for d in draws[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= rate:
        return len(parts), "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if draws[3] % 100 < spm:
        return len(parts), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(parts), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit,rate,spm", [("lines", 100, 50), ("chars", 60, 20), ("chars", 100, 100), ("lines", 0, 50)])
def test_against_slices_of_text(spark, unit, rate, spm):
    rows = list(enumerate(texts()))
    docs = f.transformed(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit, rate=rate, spm=spm)
    got = docs.select("doc_id", "text", "fim.*", f.restored(F.col("fim.output"), F.col("fim.form")).alias("again")).collect()
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_hand(r["doc_id"], r["text"], unit, rate, spm)
        assert r["again"] == r["text"]
    assert {r["form"] for r in got} >= ({"plain"} if rate == 0 else {"plain", "spm"})


def test_index_of_wide_characters():
    for text in texts():
        data = np.frombuffer(text.encode(), np.uint8)
        wide = f.WideCharacters(data)
        assert len(wide.at_char) == sum(ord(c) > 127 for c in text)
        chars = np.arange(len(text) + 1)
        places = np.array([len(text[:i].encode()) for i in chars])
        assert (wide.bytes_of(chars) == places).all() and (wide.chars_of(places) == chars).all()


def test_odd_rows(spark):
    long = "é line\n" * 300_000
    rows = [(1, None), (1, None), (None, "a\nb\nc\n"), (None, None), (2, long), (2, long), (3, "\x00\n\x00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("fim", "n", "form", "output")})
    out = f.transformed(docs)
    assert out.columns == ["doc_id", "text", "fim", "n", "form", "output"]
    got = [(r["doc_id"], r["text"], tuple(r["fim"])) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(((k, t, by_hand(k, t)) for k, t in rows), key=repr)
    assert f.transformed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        f.transformed(docs, unit="words")
