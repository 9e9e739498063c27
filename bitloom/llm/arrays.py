"""Text in Arrow batches as numpy arrays: words, shingles and sets without a Python object per row.

Words are maximal runs of letters, digits, underscore and non-ASCII bytes of the lower-cased text.
A null text counts as an empty one everywhere.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U = np.uint64

# Workers live on between stages: freed arrays go back to the system rather than stay in the process.
pa.set_memory_pool(pa.system_memory_pool())
with contextlib.suppress(OSError, AttributeError):
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(-3, CHUNK)  # M_MMAP_THRESHOLD, fixed
    _libc.mallopt(-1, CHUNK)  # M_TRIM_THRESHOLD


def constants() -> dict:
    rng = np.random.Generator(np.random.PCG64(20240229))
    base = U(0x9E3779B97F4A7C15 | 1)
    inv = U(pow(int(base), -1, 1 << 64))
    word = np.zeros(256, bool)
    word[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
    table = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
    return {"word": word, "table": table, "base": base, "inv": inv, "pow": np.ones(0, U), "ipow": np.ones(0, U)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def strings(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null row is empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    if len(arr) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    d = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[o[0] : o[-1]]
    return d, o - o[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = CHUNK, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text and at most ``rows`` rows; a longer text is alone."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, before + limit, "right"))
        to = min(max(to, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def _hash_block(c: dict, d: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    n = len(d)
    if len(c["pow"]) < n:
        for k, v in (("pow", c["base"]), ("ipow", c["inv"])):
            p = np.full(n, v, U)
            p[0] = U(1)
            c[k] = np.multiply.accumulate(p)
    pre = c["table"][d]
    pre *= c["pow"][:n]
    np.cumsum(pre, out=pre)
    h = pre[e - 1]
    h -= np.where(s > 0, pre[np.maximum(s - 1, 0)], U(0))
    h *= c["ipow"][s]
    return mix(h + (e - s).astype(U) * U(0xA0761D6478BD642F))


def words(c: dict, d: np.ndarray, o: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, start, end) of every word, or of its first prefix bytes for words that are longer. Works in blocks, so a very long text needs little memory."""
    m = c["word"][d]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    full = np.flatnonzero(np.diff(o))
    first[o[full]] = m[o[full]]
    last[o[full + 1] - 1] = m[o[full + 1] - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    if prefix:
        long = e - s > prefix
        s = s[long]
        e = s + prefix
    out, at = [np.zeros(0, U)], 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(e, s[at] + CHUNK, "right")))
        lo = s[at]
        out.append(_hash_block(c, d[lo : e[to - 1]], s[at:to] - lo, e[at:to] - lo))
        at = to
    row = np.searchsorted(o, s, "right") - 1
    return row, np.concatenate(out), s, e


def shingles(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of word n-grams; a row of fewer than n words has one shingle of all its words."""
    if not len(h):
        return row, h
    acc = h.copy()
    for j in range(1, n):
        same = np.zeros(len(h), bool)
        same[:-j] = row[j:] == row[:-j]
        nxt = np.zeros_like(h)
        nxt[:-j] = h[j:]
        acc = np.where(same, mix(acc * U(0x2545F4914F6CDD1D) + nxt), acc)
    keep = np.ones(len(h), bool)
    if n > 1:
        keep[:] = False
        keep[: -(n - 1) or None] = row[n - 1 :] == row[: len(row) - n + 1]
        start = np.ones(len(h), bool)
        start[1:] = row[1:] != row[:-1]
        keep |= start
    return row[keep], acc[keep]


def sets(c: dict, arr: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 52-bit token) of the distinct shingles of each row, in the order of row and token."""
    row, h, _, _ = words(c, *strings(pc.utf8_lower(arr)))
    row, h = shingles(row, h, n)
    k = np.sort((row.astype(U) << U(52)) | (h >> U(12)))
    if len(k):
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        k = k[new]
    return (k >> U(52)).astype(np.int64), k & U((1 << 52) - 1)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column has, in any case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name
