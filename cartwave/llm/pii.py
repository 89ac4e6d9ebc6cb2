"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their scores.

All of it is column expressions of one projection over the documents: no shuffle, no Python.  A kind's matches and the texts
between them come from the same pattern (``regexp_extract_all`` and ``split``), so a match's place is a running total of
lengths.  The patterns are possessive or bounded: none backtracks over a long run, and none recurses.

Base kinds (``KINDS``) always stay, whatever their score.  Added kinds: ``iban``, confirmed by mod-97, and ``local``, a telephone
number without country code, which needs a word about telephones nearby.  The score of a span is its kind's, raised by a
word that fits and lowered by one that speaks against it within ``NEAR`` characters on either side, up to the next match of
its kind.

Odd rows: null and empty texts have no span; very long texts are searched whole; repeated rows are alike; an empty table gives an
empty result.  Starts and ends count code points, ends exclusive.  Other columns are kept, whatever their names, but ``spans``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
NEAR = 40
RAISE, LOWER = 0.2, 0.3
_BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """``there`` is a cheap test that a text may hold a match; ``least`` is the score that an added kind needs."""

    name: str
    pattern: str
    there: Callable[[Column], Column]
    valid: Callable[[Column], Column] | None
    score: float
    fits: str
    against: str
    least: float = 0.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))


def luhn(digits: Column) -> Column:
    """Whether a non-empty string of digits passes the Luhn test."""
    doubled = F.transform(_chars(F.reverse(digits)), lambda c, i: c.cast("int") * (i % 2 + 1))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether a string of capitals and digits, its first four moved to the end, is 1 modulo 97."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    # 0-9 count 0-9, A-Z count 10-35
    value = F.transform(_chars(moved), lambda c: F.ascii(c) - F.when(c <= "9", 48).otherwise(55))
    return F.aggregate(value, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column) -> Column:
    return _let(_digits(value), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))


def _iban(value: Column) -> Column:
    return _let(F.replace(value, F.lit(" "), F.lit("")), lambda d: F.when(F.length(d).between(15, 34), mod97(d)).otherwise(False))


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

ALL = (
    Kind(
        "email",
        # from the start of a run of letters or the end of the last match: no start between can do better
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: F.contains(t, F.lit("@")),
        None, 0.9, "mail|contact|write|reply", "example|noreply",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]"),
        lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        0.6, "address|server|host|client|ip", "version|release|section|chapter",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        _card, 0.8, "card|visa|credit|debit|payment", "order|serial|isbn|tracking",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: F.contains(t, F.lit("+")),
        lambda v: F.length(_digits(v)).between(9, 15),
        0.6, "phone|tel|call|mobile|fax|whatsapp", "score|total|offset",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
        _iban, 0.9, "iban|account|bank|konto", "serial|part",
    ),
    Kind(
        "local",
        r"(?<![0-9+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20-])[0-9]{3}[\x20-][0-9]{4}(?![0-9-])",
        lambda t: t.rlike(r"[0-9]{3}[\x20-][0-9]{4}"),
        None, 0.4, "phone|tel|call|mobile|fax|whatsapp", "order|serial|part", 0.5,
    ),
)


def _proposed(text: Column, kind: Kind) -> Column:
    """Array of (kind, start, end, score) of the matches of a kind that its test confirms."""

    def placed(parts: Column) -> Column:
        between, hits = parts["between"], parts["hits"]
        step = F.zip_with(between, hits, lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0)))

        def with_steps(s: Column) -> Column:
            add = lambda a, v: a + v
            blocks = F.transform(
                F.sequence(F.lit(0), F.floor(F.size(s) / _BLOCK).cast("int")),
                lambda b: F.aggregate(F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), add),
            )
            return _let(blocks, lambda whole: F.transform(hits, lambda hit, i: _let(
                F.aggregate(F.slice(whole, F.lit(1), F.floor(i / _BLOCK).cast("int")), F.lit(0), add)
                + F.aggregate(F.slice(s, i - i % _BLOCK + 1, i % _BLOCK), F.lit(0), add)
                + F.length(between[i]),
                lambda start: F.struct(
                    F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"),
                    _let(
                        F.lower(F.concat(F.right(between[i], F.lit(NEAR)), F.lit(" "), F.left(between[i + 1], F.lit(NEAR)))),
                        lambda near: F.lit(kind.score)
                        + F.when(near.rlike(rf"\b(?:{kind.fits})"), RAISE).otherwise(0.0)
                        - F.when(near.rlike(rf"\b(?:{kind.against})"), LOWER).otherwise(0.0),
                    ).alias("score"),
                    (kind.valid(hit) if kind.valid else F.lit(True)).alias("valid"),
                ),
            )))

        return _let(step, with_steps)

    pattern = F.lit(kind.pattern)
    found = _let(
        F.struct(F.split(text, kind.pattern, -1).alias("between"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits")),
        placed,
    )
    kept = F.filter(found, lambda s: s["valid"] & (s["score"] >= kind.least))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double,valid:boolean>>")
    return F.when(kind.there(text), kept).otherwise(none)


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with an array ``spans`` of (kind, start, end, score), by kind and start."""
    body = F.coalesce(F.col(text), F.lit(""))
    spans = F.concat(*[_proposed(body, k) for k in ALL])
    plain = F.transform(spans, lambda s: s.dropFields("valid"))
    return docs.withColumn("spans", plain)
