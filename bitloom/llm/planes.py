"""Operator 9: token ids as bit-plane shuffled, compressed blocks.

The ids of a partition's documents, each closed by an end id, run on in one stream that is cut into
blocks of a fixed number of ids. A block of 16- or 32-bit ids is transposed into bit planes (plane b
holds bit b of every id) or byte planes; each plane is compressed with zstandard by itself, so that
high planes, nearly constant, take next to nothing. A block carries the index of its chunk: the size of
every plane, and which stretch of which document lies where.

Defined results. A null text has no tokens and a null row in no index; an empty one has its end id only.
Documents longer than a block run over into the next ones, whatever their length; there are no ties. Repeated rows are stored as often as they
occur, numbered by their order in the stream; a null doc_id is carried. Extra columns are ignored; an
empty table gives no block.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.arrays import column, pieces
from bitloom.llm.tokens import VOCABULARY, encode, encoder

BLOCK, LEVEL, END_ID = 1 << 16, 3, 50256
SCHEMA = "shard int, block int, n_ids int, width int, plane_sizes array<int>, docs array<struct<doc_id:bigint,seq:bigint,doc_start:bigint,at:int,n:int>>, payload binary"


def shuffle_planes(ids: np.ndarray, bits: bool = True) -> list[bytes]:
    """The planes of an array of unsigned ids, lowest first."""
    raw = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), ids.dtype.itemsize)
    if not bits:
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(raw.shape[1])]
    return [np.packbits((ids >> ids.dtype.type(b)) & ids.dtype.type(1)).tobytes() for b in range(8 * ids.dtype.itemsize)]


def join_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    """The ids of n * width-bit planes: bit planes if there are as many as bits, else byte planes."""
    kind = np.dtype(f"<u{width // 8}")
    if len(planes) == width // 8:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)).view(kind).reshape(-1)[:n]
    out = np.zeros(n, kind)
    for b, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(kind) << kind.type(b)
    return out


def decode_block(payload: bytes, sizes: list[int], n: int, width: int) -> np.ndarray:
    d, at, planes = zstandard.ZstdDecompressor(), 0, []
    for s in sizes:
        planes.append(d.decompress(payload[at : at + s]))
        at += s
    return join_planes(planes, n, width)


_NAMES = ["shard", "block", "n_ids", "width", "plane_sizes", "docs", "payload"]
_DOC = pa.struct([("doc_id", pa.int64()), ("seq", pa.int64()), ("doc_start", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])


def _write(path: str, width: int, bits: bool, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, shard = np.dtype(f"<u{width // 8}"), TaskContext.get().partitionId()
    enc, end = encoder(path), np.array([END_ID], kind).tobytes()
    z = zstandard.ZstdCompressor(level=LEVEL)
    room = size * kind.itemsize
    held, index, block, seq = bytearray(), [], 0, 0

    def flush() -> pa.RecordBatch:
        ids = np.frombuffer(bytes(held), kind)
        planes = [z.compress(p) for p in shuffle_planes(ids, bits)]
        cols = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([width], pa.int32()), pa.array([[len(p) for p in planes]], pa.list_(pa.int32())), pa.array([index], pa.list_(_DOC)), pa.array([b"".join(planes)], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, _NAMES)

    for batch in batches:
        for p in pieces(batch, "text"):
            texts, names = column(p, "text").to_pylist(), column(p, "doc_id").to_pylist()
            for name, parts in zip(names, encode(enc, texts), strict=True):
                if parts is None:
                    continue
                ids = b"".join(np.array(x, kind).tobytes() for x in parts) + end
                at = 0
                while at < len(ids):
                    k = min(len(ids) - at, room - len(held))
                    index.append((name, seq, at // kind.itemsize, len(held) // kind.itemsize, k // kind.itemsize))
                    held += ids[at : at + k]
                    at += k
                    if len(held) == room:
                        yield flush()
                        held, index, block = bytearray(), [], block + 1
                seq += 1
    if held:
        yield flush()


def write_blocks(docs: DataFrame, block: int = BLOCK, width: int = 16, bits: bool = True, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a block: shard, block, n_ids, width, plane_sizes, docs (the chunk index), payload."""
    if width not in (16, 32) or block < 8:
        raise ValueError("ids are 16 or 32 bits wide and a block holds 8 at least")
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(functools.partial(_write, vocabulary, width, bits, block), SCHEMA)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = decode_block(r["payload"], r["plane_sizes"], r["n_ids"], r["width"]).astype(np.int32)
            rows = [(r["shard"], d["seq"], d["doc_id"], d["doc_start"], ids[d["at"] : d["at"] + d["n"]].tolist()) for d in r["docs"]]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], ["shard", "seq", "doc_id", "start", "ids"])


def read_blocks(blocks: DataFrame) -> DataFrame:
    """(shard, seq, doc_id, ids) of every document in the blocks, its end id last."""
    parts = blocks.mapInArrow(_read, "shard int, seq bigint, doc_id bigint, start bigint, ids array<int>")
    whole = parts.groupBy("shard", "seq", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("p"))
    return whole.select("shard", "seq", "doc_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
