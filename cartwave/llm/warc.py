"""WARC archives: written by tasks as gzip members per record, read back in byte ranges.

Writing.  Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the largest page_id is the response,
the others are revisits that refer to it.  Equal payloads are found by one grouping of digests (partial sums first), so a
payload that a third of all pages share is one row per task.  Each task streams its rows into archives of its own under a new
name and returns their names; only names that reach the stored manifest count, so files of lost or repeated attempts are never
read.

Reading.  An archive is cut into ranges of ``SPLIT`` bytes.  A task scans its range for the gzip magic, tries each candidate by
decoding its header (it must say ``WARC/1.``) and then the whole member with its checksum, and goes on behind it.  A range owns
the records that start inside it and reads beyond its end to finish the last one.  Magic bytes inside compressed data fail the
trial and are passed over.

Archives go through ``pyarrow.fs``, so the folder may be any URI that all executors reach.

Odd rows: null html is the empty payload, null url an empty target; a null page_id is written without the field, read back as
null and counts as smaller than any other; rows that repeat the largest page_id of a payload are all responses; very long
payloads are written and read in pieces of ``PIECE`` bytes; an empty table gives no archive and an empty result.  Other columns
are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwave.llm.common import small_batches
from cartwave.session import fresh_path

REVISIT_BYTES = 1000
SPLIT = 8 << 20
ARCHIVE = 256 << 20
PIECE = 1 << 20

_MAGIC = b"\x1f\x8b\x08"
_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:cartwave:warc")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PRINTABLE = "".join(map(chr, range(33, 127)))

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def planned(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Pages as records: (page_id, url, payload, payload_digest, record_type, refers_to)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"),
    ).withColumns({
        "payload_digest": F.sha1("payload"), "check": F.xxhash64("payload"), "size": F.octet_length("payload"),
    })
    kept = (
        rows.where(F.col("size") >= revisit_bytes)
        .groupBy("payload_digest", "check", "size")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(kept, ["payload_digest", "check", "size"], "left").select(
        "page_id", "url", "payload", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def _record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id} {digest}')}>"


def record(row: dict, date: str) -> Iterator[bytes]:
    """Pieces of one WARC record, not yet compressed."""
    digest, body = row["payload_digest"], row["payload"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = len(http) + (len(body) if row["record_type"] == "response" else 0)
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", _record_id(row["page_id"], digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", urllib.parse.quote(row["url"] or "", safe=_PRINTABLE)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", block),
    ]
    if row["page_id"] is not None:
        fields.append(("X-Page-ID", row["page_id"]))
    if row["record_type"] == "revisit":
        fields += [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", _record_id(row["refers_to"], digest)),
            ("X-Refers-To-Page", row["refers_to"]),
        ]
    yield b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http
    if row["record_type"] == "response":
        for at in range(0, len(body), PIECE):
            yield body[at : at + PIECE]
    yield b"\r\n\r\n"


def write(pages: DataFrame, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES, date: str | None = None) -> DataFrame:
    """Write the pages as archives under ``folder`` and return the stored manifest (path, size, records)."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def dump(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, records = None, "", 0
        for batch in batches:
            for row in batch.to_dict("records"):
                if out is None:
                    name, records = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(name, compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                for piece in record(row, date):
                    out.write(pack.compress(piece))
                out.write(pack.flush())
                records += 1
                if out.tell() >= ARCHIVE:
                    size = out.tell()
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [name], "size": [size], "records": [records]})
        if out is not None:
            size = out.tell()
            out.close()
            yield pd.DataFrame({"path": [name], "size": [size], "records": [records]})

    schema = "path string, size long, records long"
    manifest = fresh_path(spark, "warc-manifest")
    # ids as text: pandas would turn whole numbers beside nulls into floats
    rows = planned(pages, revisit_bytes).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    with small_batches(spark):
        rows.mapInPandas(dump, schema).write.parquet(manifest)
    return spark.read.schema(schema).parquet(manifest).withColumn("folder", F.lit(folder))


class _Window:
    """A file read forwards in pieces."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.at, self.data = 0, b""

    def read(self, at: int, least: int = 1) -> bytes:
        """Bytes from ``at`` on, at least so many unless the file ends before."""
        if not self.at <= at <= self.at + len(self.data) - least:
            self.at, self.data = at, (self.file.read_at(min(PIECE, self.size - at), at) if at < self.size else b"")
        return self.data[at - self.at :]


def _member(window: _Window, at: int, keep: bool) -> tuple[dict, int] | None:
    """The record whose gzip member starts at ``at`` and the member's end; None if there is no valid one."""
    pack, head, got = zlib.decompressobj(31), b"", None
    digest, size, block, chunks, inner, left = hashlib.sha1(), 0, 0, [], b"", None
    try:
        while not pack.eof:
            data = pack.unconsumed_tail
            if not data:
                data = window.read(at)
                if not data:
                    return None
                at += len(data)
            out = pack.decompress(data, PIECE)
            if got is None:
                head += out
                if not b"WARC/1.".startswith(head[:7]) and not head.startswith(b"WARC/1."):
                    return None
                if b"\r\n\r\n" not in head:
                    continue
                lines, _, out = head.partition(b"\r\n\r\n")
                fields = (line.partition(": ") for line in lines.decode().split("\r\n")[1:])
                got = {k.lower(): v for k, _, v in fields}
                block = int(got["content-length"])
            out, block = out[:block], block - min(block, len(out))
            if left is None:
                inner += out
                if b"\r\n\r\n" not in inner:
                    continue
                http, _, out = inner.partition(b"\r\n\r\n")
                left = int(http.lower().partition(b"content-length: ")[2].split(b"\r\n")[0] or 0)
            digest.update(out)
            size += len(out)
            if keep:
                chunks.append(out)
    except (zlib.error, UnicodeDecodeError, KeyError, ValueError):
        return None
    if got is None or block:
        return None
    return {"fields": got, "size": size, "length": left, "sha1": digest.hexdigest(), "payload": b"".join(chunks)}, at - len(pack.unused_data)


def records(window: _Window, start: int, end: int, keep: bool) -> Iterator[dict]:
    """Records whose members start in [start, end)."""
    at = start
    while at < end:
        data = window.read(at, len(_MAGIC))
        if len(data) < len(_MAGIC):
            return
        place = data.find(_MAGIC)
        if place < 0:
            # the last two bytes may begin a magic that the next piece ends
            at += len(data) - 2
            continue
        at += place
        if at >= end:
            return
        found = _member(window, at, keep)
        if found is None:
            at += 1
            continue
        row, at = found
        yield row


def read(manifest: DataFrame, payload: bool = False, split: int = SPLIT) -> DataFrame:
    """The records of all archives of a manifest, with their payloads if asked; a revisit has none of its own."""
    schema = RECORD + (", payload binary" if payload else "")
    ranges = manifest.select("folder", "path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {split}L)")).alias("start"))
    total = manifest.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 1

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch.itertuples(index=False):
                store, _ = pyarrow.fs.FileSystem.from_uri(part.folder)
                rows, held = [], 0
                with store.open_input_file(part.path) as file:
                    for r in records(_Window(file, part.size), part.start, min(part.start + split, part.size), payload):
                        f = r["fields"]
                        if f.get("warc-type") not in ("response", "revisit"):
                            continue
                        own = f["warc-type"] == "response"
                        rows.append({
                            "page_id": int(f["x-page-id"]) if "x-page-id" in f else None,
                            "url": urllib.parse.unquote(f.get("warc-target-uri", "")),
                            "payload_bytes": r["size"] if own else r["length"],
                            "payload_digest": r["sha1"] if own else base64.b32decode(f["warc-payload-digest"][5:]).hex(),
                            "record_type": f["warc-type"],
                            "refers_to": int(f["x-refers-to-page"]) if f.get("x-refers-to-page", "None") != "None" else None,
                            **({"payload": r["payload"]} if payload else {}),
                        })
                        held += r["size"] if payload else 0
                        if len(rows) >= 5000 or held > 32 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows)

    return ranges.repartition(int(min(total, 1 << 16))).mapInPandas(scan, schema)


def _frame(rows: list[dict]) -> pd.DataFrame:
    """A frame that keeps whole numbers beside nulls whole."""
    whole = ("page_id", "refers_to")
    return pd.DataFrame({c: pd.array([r[c] for r in rows], dtype="Int64") if c in whole else [r[c] for r in rows] for c in rows[0]})


def round_trip(pages: DataFrame, payload: bool = False) -> DataFrame:
    """Pages written to archives under the shared folder and read back."""
    return read(write(pages), payload)


def archives(spark: SparkSession, folder: str, sizes: dict[str, int]) -> DataFrame:
    """A manifest of archives written elsewhere, from their names and sizes."""
    rows = [(folder, path, size, 0) for path, size in sizes.items()]
    return spark.createDataFrame(rows, "folder string, path string, size long, records long")
