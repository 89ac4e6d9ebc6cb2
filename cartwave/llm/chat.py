"""Chat formatting with loss masks aligned to tokens.

A conversation is rendered as ``<turn ROLE>``, line break, text, ``</turn>``, line break per turn.  Inside roles and texts a
backslash and the start of a control string are escaped, so the rendered text can be read back without doubt.  It is encoded
once with offsets; the sorted spans of the assistant's texts meet the sorted spans of the tokens by binary search.  A token that
touches such a span is in the loss, and the loss intervals are what those tokens cover of the spans, so a token that also holds
a piece of a mark adds none of the mark.

Rows are dealt by conversation and sorted within tasks, then streamed: a task holds one segment of about ``SEGMENT`` characters
at a time.  All but enormous conversations are one segment; those are cut between turns, and each segment is encoded once.

Odd rows: null roles and texts are empty; a null conv_id is a conversation of its own; null turns come first, and rows that share
a turn are ordered by role and text; a conversation without assistant has an empty loss; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 20
LOSS_ROLE = "assistant"

_CONTROL = re.compile(r"\\|<(?=/?turn)")
_IN_ROLE = re.compile(r"\\|<(?=/?turn)|>|\n")
_ESCAPED = re.compile(r"\\([\\lgn])")
_SIGNS = {"\\": "\\", "<": "l", ">": "g", "\n": "n"}
_PLAIN = {v: k for k, v in _SIGNS.items()}
_TURN = re.compile(r"<turn ([^>]*)>\n(.*?)</turn>\n", re.DOTALL)


def escape(text: str, pattern: re.Pattern = _CONTROL) -> str:
    return pattern.sub(lambda m: "\\" + _SIGNS[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered text and the spans of the texts that are learnt."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"<turn {escape(role, _IN_ROLE)}>\n", escape(text), "</turn>\n"
        parts += [head, body, tail]
        at += len(head)
        if role == LOSS_ROLE and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(tail)
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text; an error if anything else stands in it."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def intersect(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens touch a span, and the intervals that they cover of the spans."""
    mask = np.zeros(len(starts), bool)
    out: list[tuple[int, int]] = []
    if not spans:
        return mask, out
    low, high = np.array(spans).T
    first = np.searchsorted(ends, low, "right")
    last = np.searchsorted(starts, high, "left")
    for s, e, i, j in zip(low.tolist(), high.tolist(), first.tolist(), last.tolist(), strict=True):
        mask[i:j] = True
        a, b = np.maximum(starts[i:j], s), np.minimum(ends[i:j], e)
        # tokens that share a character overlap; a gap would begin an interval of its own
        gap = np.nonzero(a[1:] > np.maximum.accumulate(b)[:-1])[0] + 1
        for part in np.split(np.arange(j - i), gap):
            if len(part):
                out.append((int(a[part[0]]), int(b[part].max())))
    return mask, out


def formatted(rows: DataFrame, tokenizer: str, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, text, ids, mask, loss_start, loss_end) per segment, in order within each conversation and task."""
    key = F.col("conv_id").cast("string")  # as text: pandas would turn whole numbers beside nulls into floats
    turns = rows.select(
        key.alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    schema = "conv_id string, segment int, text string, ids array<int>, mask array<boolean>, loss_start array<int>, loss_end array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(tokenizer)
        coder.encode_special_tokens = True

        def segment_row(conv: str | None, number: int, pending: list[tuple[str, str]]) -> dict:
            text, spans = render(pending)
            code = coder.encode(text, add_special_tokens=False)
            starts, ends = np.array(code.offsets, np.int64).reshape(-1, 2).T
            mask, loss = intersect(spans, starts, ends)
            return {
                "conv_id": conv, "segment": number, "text": text, "ids": code.ids, "mask": mask.tolist(),
                "loss_start": [a for a, _ in loss], "loss_end": [b for _, b in loss],
            }

        conv, number, pending, size = None, 0, [], 0
        for batch in batches:
            out, held = [], 0
            for own, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                if pending and (own != conv or size >= segment):
                    out.append(segment_row(conv, number, pending))
                    held += size
                    number = 0 if own != conv else number + 1
                    pending, size = [], 0
                    if held >= segment:
                        yield pd.DataFrame(out)
                        out, held = [], 0
                conv = own
                pending.append((role, text))
                size += len(role) + len(text)
            if out:
                yield pd.DataFrame(out)
        if pending:
            yield pd.DataFrame([segment_row(conv, number, pending)])

    return ordered.mapInPandas(run, schema)


def digests(segments: DataFrame) -> DataFrame:
    """One row per conversation, read back from its segments, which must come in order within tasks."""
    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done() -> dict:
            return {
                "conv_id": conv, "n_turns": turns, "turns_sha256": all_text.hexdigest(),
                "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": length,
            }

        started = False
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if not started or row.segment == 0:
                    if started:
                        out.append(done())
                    started, conv = True, row.conv_id
                    turns = chars = length = 0
                    all_text, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in parse(row.text):
                    all_text.update(f"{role}\n{text}\n".encode())
                    turns += 1
                for a, b in zip(row.loss_start, row.loss_end, strict=True):
                    plain = unescape(row.text[a:b])
                    loss.update(plain.encode())
                    chars += len(plain)
                length += len(row.text)
            if out:
                yield pd.DataFrame(out)
        if started:
            yield pd.DataFrame([done()])

    return segments.mapInPandas(run, schema).withColumn("conv_id", F.col("conv_id").cast("long"))
