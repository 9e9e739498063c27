"""Operator 10: a dictionary-compressed web archive writer.

Each shard is a file: a skippable frame that holds a zstandard dictionary, then one frame for each
record, compressed by itself with that dictionary, so that any record can be read alone from its
offset. The dictionary is built from all records of the shard. Shards are filled in the order of the
input partition up to SHARD_BYTES, so a task holds one shard and nothing is shuffled.

Defined results. A null html is an empty payload, a null url an empty target; a null page_id is carried.
Repeated rows are archived as often as they occur, with record names of their own; there are no ties. A retried task writes the same names. Records larger than
a shard are shards of their own. Where the records are too few or too small for a dictionary, the
frame holds the records' own bytes as a raw content dictionary. Extra columns are ignored; an empty
table gives no file.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.arrays import column

SHARD_BYTES, DICTIONARY, LEVEL = 16 << 20, 1 << 16, 6
MAGIC = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "shard int, file int, seq int, page_id bigint, url string, offset bigint, length int, raw_length int, frame binary"


def record(url: str, body: bytes, name: str, date: str = DATE) -> bytes:
    """A WARC/1.1 resource record. White space and control characters of the url are percent-encoded."""
    digest = hashlib.sha1(body).hexdigest()
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)  # a header ends with its line
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{date}/{digest}/{name}')}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICTIONARY) -> zstandard.ZstdCompressionDict:
    """Trained on all the records; raw content where there is too little to train on."""
    if len(records) >= 8 and sum(map(len, records)) >= 8 * size // 4:
        try:
            return zstandard.train_dictionary(min(size, sum(map(len, records)) // 8), records, k=1024, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(records)[-size:] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def lead(d: zstandard.ZstdCompressionDict) -> bytes:
    """The leading skippable frame."""
    body = d.as_bytes()
    return struct.pack("<II", MAGIC, len(body)) + body


def read_file(data: bytes) -> list[bytes]:
    """The records of one file."""
    magic, n = struct.unpack("<II", data[:8])
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    body = data[8 : 8 + n]
    kind = zstandard.DICT_TYPE_FULLDICT if body[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    z, out, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind)), [], 8 + n
    while at < len(data):
        d = z.decompressobj()
        out.append(d.decompress(data[at:]))
        at = len(data) - len(d.unused_data)
    return out


_NAMES = ["shard", "file", "seq", "page_id", "url", "offset", "length", "raw_length", "frame"]
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _write(limit: int, date: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, held, size, number = TaskContext.get().partitionId(), [], 0, 0

    def flush(file: int) -> Iterator[pa.RecordBatch]:
        raw = [r for _, _, r in held]
        d = dictionary(raw)
        d.precompute_compress(level=LEVEL)
        z, first = zstandard.ZstdCompressor(level=LEVEL, dict_data=d), lead(d)
        rows, at = [(shard, file, 0, None, None, 0, len(first), 0, first)], len(first)
        for i, (page, url, r) in enumerate(held, 1):
            frame = z.compress(r)
            rows.append((shard, file, i, page, url, at, len(frame), len(r), frame))
            at += len(frame)
        for lo in range(0, len(rows), 2000):
            part = rows[lo : lo + 2000]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in part], k) for j, k in enumerate(_KINDS)], _NAMES)

    for batch in batches:
        for page, url, html in zip(*(column(batch, c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            r = record(url or "", (html or "").encode(), f"{shard}/{number}/{len(held)}/{page}/{url}", date)
            if held and size + len(r) > limit:
                yield from flush(number)
                held, size, number = [], 0, number + 1
            held.append((page, url, r))
            size += len(r)
    if held:
        yield from flush(number)


def write_warc(pages: DataFrame, shard_bytes: int = SHARD_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """One row a frame, with its place in its file: (shard, file) names the file, seq 0 is its dictionary frame."""
    slim = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(functools.partial(_write, shard_bytes, date), SCHEMA)


def files(frames: DataFrame) -> DataFrame:
    """(shard, file, bytes): the frames joined into whole files, each of about SHARD_BYTES before compression."""
    joined = frames.groupBy("shard", "file").agg(F.array_sort(F.collect_list(F.struct("seq", "frame"))).alias("f"))
    return joined.mapInArrow(_join, "shard int, file int, bytes binary")


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            whole = b"".join(x["frame"] for x in batch.column("f")[i].as_py())
            yield pa.RecordBatch.from_arrays([batch.column("shard").slice(i, 1), batch.column("file").slice(i, 1), pa.array([whole], pa.binary())], ["shard", "file", "bytes"])
