"""Secret scans: a worklist of decoded layers, each scanned, spans mapped back to the text.

A text is the first layer.  Every layer is searched for the base kinds (``KINDS``) and for encoded passages: percent escapes,
Unicode escapes (``\\u0041``, ``\\x41``, ``&#65;``), base64 (both alphabets, also wrapped over lines) and hexadecimal, whose
bytes may be gzip, zlib, bzip2, xz or Zstandard data, of any number of members.  Each passage that decodes is a new layer, until
none is left; bytes that are no UTF-8 are read as Latin-1, and what follows compressed data is read with it.  A layer that has already come from the same place ends a cycle.  What a layer holds is reported at the passage of the
original text that it came from, as ``kind@path`` (``access@base64.gzip``).  Compressed data beyond ``MAX_LAYER`` characters
is not unpacked but reported as ``oversize@path``, so nothing is passed over in silence.

Odd rows: null and empty texts have no span; very long texts are scanned whole; repeated rows are alike; an empty table gives an
empty result.  Starts and ends count code points, ends exclusive.  Other columns are kept, whatever their names.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwave.llm.common import small_batches
from cartwave.session import cut

KINDS = ("assign", "access", "hex")
MAX_LAYER = 1 << 24
MASK = "[SECRET]"

# fixed values: the patterns of the base kinds
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

_SIGN = re.compile(r"[:=]")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_TOKEN = re.compile(r"\S+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:(?<=[A-Za-z0-9+/_-]{60})\r?\n[A-Za-z0-9+/_-]+)*={0,2}")
_WORD = re.compile(r"[A-Za-z0-9]{16,}={0,2}")
_PAIRS = re.compile(r"(?:[0-9A-Fa-f]{2}){12,}")
_MAGIC = ((b"\x1f\x8b\x08", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"), (b"\x28\xb5\x2f\xfd", "zstd"))
_TOOLS = {
    "gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor,
    "zstd": lambda: zstandard.ZstdDecompressor().decompressobj(),
}

Span = tuple[str, int, int, str]
#: from a place in a layer to the place in the text
Place = Callable[[int], tuple[int, int]]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, leftmost and not overlapping within a kind."""
    out = []
    done = -1
    # no match of this kind holds a line break, so only lines with a sign are searched
    for sign in _SIGN.finditer(text):
        if sign.start() > done:
            begin = max(done, text.rfind("\n", 0, sign.start())) + 1
            done = text.find("\n", sign.start())
            done = len(text) if done < 0 else done
            out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text, begin, done) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def _text(data: bytes) -> tuple[str, bool]:
    """The text of decoded bytes, and whether all of it is readable."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1"), False
    return text, bool(text) and all(c.isprintable() or c in "\t\r\n" for c in text)


def _compressed(data: bytes) -> str:
    """The name of the compression that the data begins like, if any."""
    name = next((n for magic, n in _MAGIC if data.startswith(magic)), "")
    if not name and len(data) > 6 and data[0] & 15 == 8 and int.from_bytes(data[:2]) % 31 == 0:
        name = "zlib"
    return name


def _member(name: str, data: bytes, at: int, room: int) -> tuple[bytes, int, bool]:
    """Up to ``room`` bytes of the member that begins at a place, the place behind it, and whether it is complete."""
    tool, out = _TOOLS[name](), []
    # small steps bound what one call without a limit can return, and what is copied behind a member
    step = 64 if name == "zstd" else 1 << 14
    while at < len(data) and not tool.eof and room > 0:
        part = data[at : at + step]
        new = tool.decompress(part) if name == "zstd" else tool.decompress(part, room)
        out.append(new)
        room -= len(new)
        at += len(part) - len(tool.unused_data)
    return b"".join(out), at, tool.eof


def _unpack(data: bytes) -> tuple[bytes | None, str]:
    """The data behind one compressed layer and its name; no data if it is too large, no name if it isn't compressed."""
    name = kind = _compressed(data)
    out, size, at = [], 0, 0
    while kind:
        try:
            new, end, whole = _member(kind, data, at, MAX_LAYER + 1 - size)
        except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError, ValueError):
            break
        if not new and not whole:
            break
        out.append(new)
        size += len(new)
        if size > MAX_LAYER:
            return None, name
        # two bytes are weak evidence of zlib data, so what has no end is also read as it is
        at = end if whole or kind != "zlib" else at
        if not whole:
            break
        # members may be padded
        while at < len(data) and not data[at]:
            at += 1
        kind = _compressed(data[at : at + 8])
    return (b"".join([*out, data[at:]]), name) if out else (None, "")


def _from_bytes(data: bytes, path: str) -> tuple[str | None, bool, str]:
    """Text of decoded bytes, through any compressed layers, whether all of it is readable, and the path to it."""
    seen = set()
    while True:
        out, name = _unpack(data)
        if not name:
            return *_text(data), path
        path = f"{path}.{name}"
        if out is None:
            return None, False, f"oversize@{path}"
        mark = hashlib.blake2b(out, digest_size=16).digest()
        if mark in seen:
            return None, False, path
        seen.add(mark)
        data = out


def _base64(passage: str) -> bytes | None:
    body = passage.replace("\r", "").replace("\n", "").rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except ValueError:
        return None


def _escapes(token: str, pattern: re.Pattern, width: Callable[[re.Match], list[tuple[str, int]]]) -> tuple[str, list[int]]:
    """A token without its escapes, and where each of its characters, and the end, stands in the token."""
    out, at, end = [], [], 0
    for m in pattern.finditer(token):
        out.append(token[end : m.start()])
        at.extend(range(end, m.start()))
        place = m.start()
        for char, n in width(m):
            out.append(char)
            at.append(place)
            place += n
        end = m.end()
    out.append(token[end:])
    at.extend(range(end, len(token) + 1))
    return "".join(out), at


def _percent(m: re.Match) -> list[tuple[str, int]]:
    data = bytes.fromhex(m[0].replace("%", ""))
    # a byte that is no UTF-8 stands for itself
    return [(chr(ord(c) - 0xDC00) if 0xDC80 <= ord(c) <= 0xDCFF else c, 3 * len(c.encode("utf-8", "surrogateescape"))) for c in data.decode("utf-8", "surrogateescape")]


def _unicode(m: re.Match) -> list[tuple[str, int]]:
    code = int(m[3]) if m[3] else int(m[1] or m[2] or m[4], 16)
    return [(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�", len(m[0]))]


def _layers(text: str) -> Iterator[tuple[str, str | None, int, int, list[int] | None]]:
    """(path, text, start, end, places) of each encoded passage; without places, all of it stands for the passage."""
    escapes = [("url", _PERCENT, _percent)] * ("%" in text) + [("unicode", _UNICODE, _unicode)] * ("\\" in text or "&#" in text)
    for name, pattern, width in escapes:
        end = -1
        for m in pattern.finditer(text):
            if m.start() >= end:
                # the whole white-space token, so that what stands beside an escape is read with it
                begin = m.start()
                while begin > max(end, 0) and not text[begin - 1].isspace():
                    begin -= 1
                end = _TOKEN.match(text, begin).end()
                new, at = _escapes(text[begin:end], pattern, width)
                yield name, new, begin, end, at
    for m in _BASE64.finditer(text):
        found = False
        parts = [m] if len(m[0].split("\n")) == 1 and _WORD.fullmatch(m[0]) else [m, *_WORD.finditer(text, m.start(), m.end())]
        for part in parts:
            data = None if found else _base64(part[0])
            new, readable, path = _from_bytes(data, "base64") if data else (None, False, "")
            if new is not None or path.startswith("oversize"):
                # a passage that isn't all readable may hold words that are encoded each for itself
                found = part is m and (readable or new is None)
                yield path, new, part.start(), part.end(), None
    for m in _PAIRS.finditer(text):
        new, _, path = _from_bytes(bytes.fromhex(m[0]), "base16")
        if new is not None or path.startswith("oversize"):
            yield path, new, m.start(), m.end(), None


def spans(text: str) -> list[Span]:
    """All spans (kind, start, end, path) by start, kind and end; the path is empty for the text's own.

    A kind found again at the same place in a later layer is not repeated.
    """
    out: dict[tuple[str, int, int], str] = {}
    work: deque[tuple[str, str, Place]] = deque([(text, "", lambda i: (i, i + 1))])
    seen: set[tuple[bytes, int, int]] = set()
    while work:
        layer, path, place = work.popleft()
        for kind, start, end in base_spans(layer):
            out.setdefault((kind, place(start)[0], place(end - 1)[1]), path)
        for name, new, start, end, at in _layers(layer):
            begin, stop = place(start)[0], place(end - 1)[1]
            step = f"{path}.{name}".lstrip(".")
            if new is None:
                out.setdefault(("oversize", begin, stop), step.replace("oversize@", ""))
                continue
            mark = (hashlib.blake2b(new.encode("utf-8", "surrogatepass"), digest_size=16).digest(), begin, stop)
            if mark in seen:
                continue
            seen.add(mark)
            if at is None:
                work.append((new, step, lambda i, span=(begin, stop): span))
            else:
                work.append((new, step, lambda i, at=at, start=start, up=place: (up(start + at[i])[0], up(start + at[i + 1] - 1)[1])))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(((*span, path) for span, path in out.items()), key=lambda s: (s[1], rank.get(s[0], 9), s[2]))


def found(text: str = "text") -> Column:
    """Array of (kind, start, end) structs, decoded ones as ``kind@path``, as a column."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([
                [{"kind": f"{k}@{p}" if p else k, "start": s, "end": e} for k, s, e, p in spans(t or "")] for t in batch
            ], dtype=object)

    return scan(F.coalesce(F.col(text), F.lit("")))


def masked(text: str, where: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by ``MASK``."""
    out, end = [], 0
    runs: list[list[int]] = []
    for _, s, e, _ in where:
        if runs and s < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    for s, e in runs:
        out += [text[end:s], MASK]
        end = e
    return "".join([*out, text[end:]])


def without_secrets(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """The documents, stored, with their secrets masked and ``size`` counted anew where the text changed; null texts stay null."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else masked(t, spans(t)) for t in batch], dtype=object)

    out = docs.withColumn("_clean", clean(F.col(text)))
    changed = ~F.col(text).eqNullSafe(F.col("_clean"))
    out = out.withColumns({
        size: F.when(changed, F.length("_clean").cast("long")).otherwise(F.col(size)), text: F.col("_clean"),
    }).drop("_clean")
    # whole texts go to Python and come back
    with small_batches(docs.sparkSession):
        return cut(out)
