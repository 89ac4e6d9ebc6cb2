"""Fill-in-middle transformation of texts, cut at lines or characters.

A text is cut twice, at units chosen by a hash of its id, into prefix, middle and suffix, and written with marks as
``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm).  A text that is empty or holds a mark, and a share of
the others (``rate``), stays plain.

Texts are cut as UTF-8 bytes.  A sparse index records only the characters of more than one byte: the character position of each and
the running sum of the bytes they take beyond one.  A binary search in it turns a cut in characters into one in bytes and back; between
two such characters, and in all of an ASCII text, places are plain arithmetic.  No text is decoded and no array of all its characters
is made.

Odd rows: a null text is empty, and plain with 0 units; a null id is hashed as the empty text; equal ids are cut by the same numbers,
so repeated rows give repeated results; texts of any length are cut whole; an empty table gives an empty result; other columns are kept,
except that one named like the result (``fim``) is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what marks prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
SALT, RATE, SPM = "7", 100, 50
_RESULT = "n long, form string, prefix_chars long, middle_chars long, output binary"


class WideCharacters:
    """The characters of a UTF-8 text that take more than one byte, in text order."""

    def __init__(self, data: np.ndarray):
        self.at_byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.at_byte]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(more)])
        self.at_char = self.at_byte - self.excess[:-1]

    def bytes_of(self, chars: np.ndarray) -> np.ndarray:
        """Byte places of character places."""
        return chars + self.excess[np.searchsorted(self.at_char, chars)]

    def chars_of(self, places: np.ndarray) -> np.ndarray:
        """Character places of byte places that lie between characters."""
        return places - self.excess[np.searchsorted(self.at_byte, places)]


def line_cuts(data: np.ndarray, wide: WideCharacters) -> np.ndarray:
    """Byte place behind each line, with a 0 before the first."""
    ends = np.flatnonzero(data == 10) + 1
    last = [] if len(data) == (ends[-1] if len(ends) else 0) else [len(data)]
    return np.concatenate([[0], ends, last]).astype(np.int64)


class _Characters:
    """Byte place behind each character, looked up when asked for."""

    def __init__(self, data: np.ndarray, wide: WideCharacters):
        self.wide, self.n = wide, int(wide.chars_of(np.array([len(data)]))[0])

    def __len__(self) -> int:
        return self.n + 1

    def __getitem__(self, units: np.ndarray) -> np.ndarray:
        return self.wide.bytes_of(units)


UNITS: dict[str, Callable] = {"lines": line_cuts, "chars": _Characters}


def infilled(text: bytes, draws: tuple[int, int, int, int], unit: str, rate: int, spm: int) -> tuple:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    data = np.frombuffer(text, np.uint8)
    wide = WideCharacters(data)
    cuts = UNITS[unit](data, wide)
    n = len(cuts) - 1
    if not text or draws[2] % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    places = cuts[np.sort(np.array([draws[0] % (n + 1), draws[1] % (n + 1)]))]
    chars = wide.chars_of(places)
    a, b = places.tolist()
    p, s, m = MARKS
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm:
        form, output = "spm", b"".join((s, suffix, p, prefix, m, middle))
    else:
        form, output = "psm", b"".join((p, prefix, s, suffix, m, middle))
    return n, form, int(chars[0]), int(chars[1] - chars[0]), output


def draws(key: str, salt: str = SALT) -> Column:
    """Four unsigned 32-bit numbers from a hash of the salt and the id."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def transformed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "lines",
    rate: int = RATE, spm: int = SPM, salt: str = SALT,
) -> DataFrame:
    """``docs`` with a struct ``fim``: n, form, prefix_chars, middle_chars, output.

    ``rate`` of 100 texts are cut, ``spm`` of 100 of them have the suffix first.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")

    @F.pandas_udf(_RESULT)
    def run(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        rows = [infilled(t, d, unit, rate, spm) for t, d in zip(texts, numbers, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumn("fim", run(body, draws(key, salt))).withColumn(
        "fim", F.col("fim").withField("output", F.col("fim.output").cast("string"))
    )


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, from what was written and its form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    first, second, third = (F.element_at(parts, i) for i in (2, 3, 4))
    return (
        F.when(form == "psm", F.concat(first, third, second))
        .when(form == "spm", F.concat(second, third, first))
        .otherwise(output)
    )
