"""Archives: exact round trips, ranges of any size, odd rows."""

import hashlib
import os

import pyarrow.fs
import pytest

from cartwave.llm import warc

LONG = "<html>" + "ab" * 600 + "</html>"
SCHEMA = "page_id long, url string, html string, refers_to string"
BIG = 2**53 + 1


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expected(pages):
    out = []
    for page_id, _, html, _ in pages:
        body = (html or "").encode()
        same = [p for p, _, h, _ in pages if (h or "").encode() == body and p is not None]
        first = max(same, default=None)
        again = len(body) >= 1000 and first is not None and page_id != first
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


PAGES = [
    (1, "http://a/x\r\nX: y é", LONG, "clash"), (2, None, LONG, None), (BIG, "http://b", LONG, None), (BIG, "http://b", LONG, None),
    (4, "http://c", None, None), (5, "http://c", "", None), (6, "u", "short", None), (7, "u", "short", None),
    (None, "n", LONG, None), (8, "é", "é \x00" * 400_000, None), (9, "w", "\x1fWARC/1.1\r\n\r\n" * 200, None),
]
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    assert rows(warc.round_trip(df).select(COLUMNS)) == expected(PAGES)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("piece", [3, 5, 100, 1 << 20])
def test_ranges_own_each_record_once(tmp_path, monkeypatch, split, piece):
    """Any cut of a file into ranges, and any piece size, gives each record once."""
    import zlib

    path, sizes = str(tmp_path / "a.warc.gz"), []
    with open(path, "wb") as f:
        for i in range(25):
            body = os.urandom(i * 7) + b"\x1f\x8b\x08"
            row = {"page_id": str(i), "url": "u", "payload": body, "payload_digest": hashlib.sha1(body).hexdigest(), "record_type": "response", "refers_to": None}
            pack = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: false magic stays visible
            f.write(b"".join(pack.compress(p) for p in warc.record(row, "2020-01-01T00:00:00Z")) + pack.flush())
            sizes.append(len(body))
    monkeypatch.setattr(warc, "PIECE", piece)
    size, found = os.path.getsize(path), []
    with pyarrow.fs.LocalFileSystem().open_input_file(path) as f:
        for start in range(0, size, split):
            found += warc.records(warc._Window(f, size), start, min(start + split, size), True)
    assert [r["size"] for r in found] == sizes
    assert all(r["sha1"] == hashlib.sha1(r["payload"]).hexdigest() for r in found)


def test_payload_comes_back(spark):
    df = spark.createDataFrame(PAGES[:1] + PAGES[4:8], SCHEMA)
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.round_trip(df, payload=True).collect()}
    assert got == {1: LONG, 4: "", 5: "", 6: "short", 7: "short"}
