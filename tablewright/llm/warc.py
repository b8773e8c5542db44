"""WARC archives in seekable Zstandard bundles.

Records are grouped into independently compressed frames; a bundle ends in a skippable
frame with a seek table (sizes of all frames), so a reader finds a frame from the end of
the file. The index maps every record to its bundle, frame and offset inside the frame.
"""

from __future__ import annotations

import hashlib
import math
import posixpath
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from tablewright.runtime import cut, new_folder

# Payloads of at least so many bytes are stored once; equal ones refer to the stored record.
SHARED_BYTES = 1000
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
LEVEL = 3
# Compressed frames that one task reads back, about.
READ_BYTES = 8 << 20
# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEK_TABLE = 0x8F92EAB1
INDEX = "page_id long, path string, frame int, frame_at long, frame_bytes long, record_at long, record_bytes long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "2024-01-01T00:00:00Z"


def record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A response record, or a revisit that names the record with the same payload."""
    name = "null" if page_id is None else int(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if isinstance(url, str) and url:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{int(refers_to)}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """(page_id, payload length, payload digest, type, refers_to) of a record; a stored payload is hashed again."""
    head, block = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    page = lambda name: None if name == "null" else int(name)
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    refers = fields.get("WARC-Refers-To")
    return (page(fields["WARC-Record-ID"][10:-1]), length, stated, fields["WARC-Type"], refers and page(refers[10:-1]))


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for (compressed size, plain size) of every frame."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, SEEK_TABLE)


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame, from the end of an open file."""
    size = file.size()
    count, flags, magic = struct.unpack("<IBI", _at(file, size - 9, 9))
    if magic != SEEK_TABLE or flags & 0x7C:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    raw = _at(file, size - 9 - width * count, width * count)
    out, at = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", raw, width * i)
        out.append((at, packed, plain))
        at += packed
    return out


def _at(file, offset: int, size: int) -> bytes:
    file.seek(offset)
    return file.read(size)


class _Bundle:
    """One archive file being written; frames go out as they fill."""

    def __init__(self, folder: str):
        self.path = posixpath.join(folder, f"bundle-{uuid.uuid4().hex}.warc.zst")
        store, place = fs.FileSystem.from_uri(self.path)
        self.file = store.open_output_stream(place, compression=None)
        self.frames: list[tuple[int, int]] = []
        self.size, self.plain, self.waiting, self.rows = 0, 0, [], []

    def add(self, page_id, raw: bytes) -> None:
        self.rows.append((page_id, self.path, len(self.frames), self.size, self.plain, len(raw)))
        self.waiting.append(raw)
        self.plain += len(raw)

    def end_frame(self) -> list[tuple]:
        """Index rows of the frame that is now written."""
        if not self.waiting:
            return []
        packed = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(b"".join(self.waiting))
        self.file.write(packed)
        rows = [(p, path, f, at, len(packed), offset, size) for p, path, f, at, offset, size in self.rows]
        self.frames.append((len(packed), self.plain))
        self.size += len(packed)
        self.plain, self.waiting, self.rows = 0, [], []
        return rows

    def close(self) -> None:
        self.file.write(seek_table(self.frames))
        self.file.close()


def with_owners(pages: DataFrame) -> DataFrame:
    """Pages with payload digest and the page that stores the payload (null: the page itself)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    owners = (rows.where(F.col("size") >= SHARED_BYTES).groupBy("digest", "size")
              .agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    joined = rows.join(owners, ["digest", "size"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("owner") != F.col("page_id"), F.col("owner"))
                         .when(F.col("page_id").isNull(), F.col("owner")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write every page into bundles under ``folder``; returns the written index (``INDEX``).

    A bundle gets a fresh name in each attempt and counts only through the index, which is
    a table of its own: a lost task leaves at most a file that no index row names.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, columns = None, [c.split(" ")[0] for c in INDEX.split(", ")]
        for frame in frames:
            out = []
            for page_id, url, payload, digest, refers_to in frame.itertuples(index=False):
                if bundle is None:
                    bundle = _Bundle(folder)
                page_id, refers_to = (None if pd.isna(v) else int(v) for v in (page_id, refers_to))
                bundle.add(page_id, record(page_id, url, bytes(payload), digest, refers_to))
                if bundle.plain >= frame_bytes:
                    out += bundle.end_frame()
                    if bundle.size >= bundle_bytes:
                        bundle.close()
                        bundle = None
            if out:
                yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64"})
        if bundle is not None:
            out = bundle.end_frame()
            bundle.close()
            if out:
                yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64"})

    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    return cut(with_owners(pages).mapInPandas(run, INDEX), "index")


def read_archives(index: DataFrame) -> DataFrame:
    """Read every indexed record back (``RESULT``), frame by frame, found through the seek tables."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, file, table, at, plain = None, None, [], None, b""
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.path != path:
                    if file is not None:
                        file.close()
                    store, place = fs.FileSystem.from_uri(row.path)
                    path, file, at = row.path, store.open_input_file(place), None
                    table = read_seek_table(file)
                if row.frame != at:
                    offset, packed, size = table[row.frame]
                    if (offset, packed) != (row.frame_at, row.frame_bytes):
                        raise ValueError(f"index and seek table of {path} disagree")
                    at, plain = row.frame, zstandard.ZstdDecompressor().decompress(_at(file, offset, packed), max_output_size=size)
                out.append(parse_record(plain[row.record_at: row.record_at + row.record_bytes]))
            if out:
                yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if file is not None:
            file.close()

    # The index is narrow, but each of its rows makes a task read a frame: tasks follow the bytes of those.
    frames = index.groupBy("path", "frame").agg(F.max("frame_bytes").alias("n"))
    tasks = max(1, math.ceil((frames.agg(F.sum("n")).first()[0] or 0) / READ_BYTES))
    return index.repartition(tasks, "path", "frame").sortWithinPartitions("path", "frame", "record_at").mapInPandas(run, RESULT)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read all records back (``RESULT``).

    Of equal payloads of at least ``SHARED_BYTES`` the one with the largest page_id is
    stored and the others revisit it; smaller ones are all stored. ``folder`` is a URI that
    executors reach through Arrow's file systems; by default it is in the shared folder.

    * Null html is an empty payload; a null url is left out of the record.
    * Rows equal in page_id and payload are one record each, all of the same type.
    * A null page_id counts as smaller than any other; alone it is stored.
    * No pages: no records. Other columns are not read.
    """
    return read_archives(write_archives(pages, folder or new_folder(pages.sparkSession, "warc")))
