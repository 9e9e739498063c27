"""Byte codecs in Arrow functions: a range coder under integer counts, and library baselines."""

from __future__ import annotations

import functools
import lzma
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOP, _LOW, _ALL = 1 << 24, 1 << 16, (1 << 32) - 1
TOTAL = 1 << 14
#: Bytes of text that are coded together.
PIECE = 1 << 24


def quantise(counts: np.ndarray, total: int = TOTAL) -> np.ndarray:
    """Positive integer frequencies that add up to total, for each row of counts with one added."""
    p = counts.astype(float) + 1
    f = np.maximum(1, np.floor(p / p.sum(-1, keepdims=True) * (total - p.shape[-1]))).astype(np.int64)
    np.put_along_axis(f, f.argmax(-1)[..., None], np.take_along_axis(f, f.argmax(-1)[..., None], -1) + (total - f.sum(-1))[..., None], -1)
    return f


def encode(data: bytes, cum: list[list[int]], state: tuple = (0, _ALL, 0, b"")) -> bytes:
    """Range-coded bytes under the cumulative frequencies of each preceding byte; whole 32-bit words.

    state: (low, size, preceding byte, code so far) where data is the rest of a text."""
    low, size, prev, out = *state[:3], bytearray(state[3])
    for x in data:
        c = cum[prev]
        size //= TOTAL
        low += c[x] * size
        size *= c[x + 1] - c[x]
        while (low ^ (low + size)) < _TOP or size < _LOW:
            if (low ^ (low + size)) >= _TOP:
                size = -low & (_LOW - 1)
            out.append((low >> 24) & 255)
            low, size = (low << 8) & _ALL, (size << 8) & _ALL
        prev = x
    for _ in range(4):
        out.append((low >> 24) & 255)
        low = (low << 8) & _ALL
    return bytes(out) + b"\0" * (-len(out) % 4)


def decode(code: bytes, n: int, cum: list[list[int]], state: tuple | None = None) -> bytes:
    """The n bytes of a code, or the next n from state: (low, size, preceding byte, bytes read, the last four of them)."""
    low, size, prev, at, now = state or (0, _ALL, 0, 4, int.from_bytes(code[:4].ljust(4, b"\0"), "big"))
    out = bytearray()
    for _ in range(n):
        c = cum[prev]
        size //= TOTAL
        v = min(TOTAL - 1, ((now - low) & _ALL) // size)
        lo, hi = 0, 256
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if c[mid] <= v else (lo, mid)
        low += c[lo] * size
        size *= c[lo + 1] - c[lo]
        while (low ^ (low + size)) < _TOP or size < _LOW:
            if (low ^ (low + size)) >= _TOP:
                size = -low & (_LOW - 1)
            now = ((now << 8) & _ALL) | (code[at] if at < len(code) else 0)
            at += 1
            low, size = (low << 8) & _ALL, (size << 8) & _ALL
        out.append(lo)
        prev = lo
    return bytes(out)


def tables(base: DataFrame) -> list[list[int]]:
    """Cumulative frequencies of base(prev, cur, c): 65,536 numbers whatever the corpus."""
    counts = np.zeros((256, 256))
    for r in base.select("prev", "cur", "c").collect():
        counts[r[0], r[1]] = r[2]
    return [np.append(0, np.cumsum(f)).tolist() for f in quantise(counts)]


#: Fewer rows than these are coded one by one.
FEW = 24


def _renew(low: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The rows that shift a byte, with those bytes still in low, until none does."""
    go = np.arange(len(low))
    while True:
        l, z = low[go], size[go]
        same = (l ^ (l + z)) < _TOP
        on = np.flatnonzero(same | (z < _LOW))
        if not len(on):
            return
        go, l, z, same = go[on], l[on], z[on], same[on]
        yield go
        low[go], size[go] = (l << 8) & _ALL, (np.where(same, z, -l & (_LOW - 1)) << 8) & _ALL


def round_trip(data: np.ndarray, n: np.ndarray, cum: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of code, ideal bits, whether decoding gives the text) of the texts of n bytes that follow each other in data: encode() and decode() over all rows at once."""
    freq = np.array(cum)
    cut, width = freq[:, :-1].copy(), np.diff(freq)
    order = np.argsort(-n, kind="stable")
    begin, count = (np.cumsum(n) - n)[order], n[order]
    most = int(count[FEW - 1]) if len(n) >= FEW else 0  # beyond it fewer than FEW rows go on
    live = np.searchsorted(-count, -np.arange(most), "left")  # rows of more than t bytes
    room = 4 * count + 16
    base = np.cumsum(room) - room
    code, pos = np.zeros(int(room.sum()), np.uint8), base.copy()
    low, size, prev = np.zeros(len(n), np.int64), np.full(len(n), _ALL), np.zeros(len(n), np.int64)
    for t in range(most):
        a = live[t]
        x = data[begin[:a] + t].astype(np.int64)
        part = size[:a] // TOTAL
        low[:a] += cut[prev[:a], x] * part
        size[:a] = width[prev[:a], x] * part
        for go in _renew(low[:a], size[:a]):
            code[pos[go]] = (low[go] >> 24) & 255
            pos[go] += 1
        prev[:a] = x
    for i in range(len(n)):
        rest = data[begin[i] + min(most, count[i]) : begin[i] + count[i]].tobytes()
        z = encode(rest, cum, (int(low[i]), int(size[i]), int(prev[i]), code[base[i] : pos[i]].tobytes()))
        pos[i] = base[i] + len(z)
        if len(z) > room[i]:
            raise ValueError("a code is longer than its room")
        code[base[i] : pos[i]] = np.frombuffer(z, np.uint8)
    symbol = np.stack([np.repeat(np.arange(256, dtype=np.uint8), w) for w in width])
    low[:], size[:], prev[:] = 0, _ALL, 0
    now = sum(code[base + j].astype(np.int64) << (24 - 8 * j) for j in range(4)) if len(n) else low.copy()
    at, back = base + 4, np.zeros_like(data)
    for t in range(most):
        a = live[t]
        part = size[:a] // TOTAL
        x = symbol[prev[:a], np.minimum(TOTAL - 1, ((now[:a] - low[:a]) & _ALL) // part)].astype(np.int64)
        low[:a] += cut[prev[:a], x] * part
        size[:a] = width[prev[:a], x] * part
        for go in _renew(low[:a], size[:a]):
            now[go] = ((now[go] << 8) & _ALL) | np.where(at[go] < pos[go], code[np.minimum(at[go], len(code) - 1)], 0)
            at[go] += 1
        back[begin[:a] + t] = x
        prev[:a] = x
    for i in np.flatnonzero(count > most):
        z = code[base[i] : pos[i]].tobytes()
        got = decode(z, int(count[i]) - most, cum, (int(low[i]), int(size[i]), int(prev[i]), int(at[i] - base[i]), int(now[i])))
        back[begin[i] + most : begin[i] + count[i]] = np.frombuffer(got, np.uint8)
    of = np.repeat(np.arange(len(n)), n)
    before = np.append(np.uint8(0), data[:-1])[: len(data)]
    before[(np.cumsum(n) - n)[n > 0]] = 0
    ideal = np.bincount(of, weights=-np.log2(width / TOTAL)[before, data], minlength=len(n))
    wrong = np.bincount(of, weights=back != data, minlength=len(n))
    length = np.empty(len(n), np.int64)
    length[order] = pos - base
    return length, ideal, wrong == 0


def _round_trip(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cum = held.value
    for batch in batches:
        at, size = 0, np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")])
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE, "right")))
            raw = [(t or "").encode() for t in batch.column("text").slice(at, to - at).to_pylist()]
            n = np.array([len(x) for x in raw], np.int64)
            z, ideal, ok = round_trip(np.frombuffer(b"".join(raw), np.uint8), n, cum)
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), pa.array(n.astype(np.int32)), pa.array(z.astype(np.int32)), pa.array(ideal), pa.array(ok.astype(np.int32))], ["id", "original_bytes", "compressed_bytes", "ideal_bits", "roundtrip_ok"])
            at = to


def range_round_trip(texts: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Coded, decoded and compared: (id, original_bytes, compressed_bytes, ideal_bits, roundtrip_ok)."""
    held = texts.sparkSession.sparkContext.broadcast(tables(base))
    return texts.select(F.col(key).cast("bigint").alias("id"), "text").mapInArrow(functools.partial(_round_trip, held), "id bigint, original_bytes int, compressed_bytes int, ideal_bits double, roundtrip_ok int")


def _baseline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z, u = zstandard.ZstdCompressor(level=19), zstandard.ZstdDecompressor()
    for batch in batches:
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        a, b, c = [zlib.compress(x, 9) for x in raw], [z.compress(x) for x in raw], [lzma.compress(x, preset=1) for x in raw]
        ok = [int(zlib.decompress(p) == u.decompress(q) == lzma.decompress(r) == x) for p, q, r, x in zip(a, b, c, raw, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array([len(x) for x in y], pa.int32()) for y in (raw, a, b, c)], pa.array(ok, pa.int32())], ["id", "original_bytes", "zlib_bytes", "zstd_bytes", "lzma_bytes", "roundtrip_ok"])


def library_baselines(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(F.col(key).cast("bigint").alias("id"), "text").mapInArrow(_baseline, "id bigint, original_bytes int, zlib_bytes int, zstd_bytes int, lzma_bytes int, roundtrip_ok int")


def bits_to_bytes(bits: str) -> tuple[bytes, int]:
    """(bytes, zeros put on the left)."""
    pad = -len(bits) % 8
    return (int(bits, 2).to_bytes((len(bits) + pad) // 8, "big") if bits else b""), pad


def bytes_to_bits(data: bytes, pad: int = 0) -> str:
    return "".join(f"{x:08b}" for x in data)[pad:]


def patch_tokens(data: bytes, patch: int = 16, ext: str = "") -> list[int]:
    """Extension patch, bytes padded with 256 to whole patches, and a closing patch of 256."""
    head = list(ext.lower().strip(".").encode())[:patch]
    body = list(data) + [256] * (-len(data) % patch)
    return head + [256] * (patch - len(head)) + body + [256] * patch


def strip_pad(tokens: list[int]) -> bytes:
    n = len(tokens)
    while n and tokens[n - 1] == 256:
        n -= 1
    return bytes(tokens[:n])
