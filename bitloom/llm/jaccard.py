"""Operator 1: exact n-gram Jaccard join by universe partition and pigeonhole.

Each document is the set of its distinct word n-grams, as 52-bit hashes. The token universe is hashed into ``m``
segments, ``m`` depending on the set's size band. Two sets with Jaccard at least ``t`` differ in at
most H tokens, so of H + 1 segments one is equal in both, and with allocation 2 a segment may also
differ by one token (one-deletion neighbourhoods, for sets below SHORT). The larger set of a pair probes only the
segments that are cheapest under the corpus' token frequencies, as many as the pigeonhole needs;
the smaller one is indexed under all its segments. A set whose segments can't carry H + 1 (hash accident) is
compared with all sets that share one of its rarest tokens (prefix filter), so the join is exact.

Pairs are never rows before they are likely. A part of the signatures gives its colliding pairs as
adjacency lists over its own numbering; they are routed to blocks of sets (by size and a hash of the least
token, with which a set's key begins, so near duplicates have mostly the same block), where repeats go, and are held against
parity sketches of about 1.5 bits a token: the number of differing bits is at most that of differing
tokens. What is left goes to groups by least neighbour, each set's tokens are sent once to each group that
needs them, and the intersections are counted exactly. A hot signature or a hot block is cut into
chunks that are paired in tasks of their own.

A large group of near copies has as many pairs as the square of its size, each in dozens of signatures. So sets that share
one of CROWD_BINS minimum hashes with CROWD others, and are near the most copied one of these, are a crowd. All
pairs of a crowd are compared by products of token matrices; the signatures give only pairs that aren't in one crowd.
A crowd in whose sample few pairs are near is none. So crowds change the work only, not the result.

Defined results. Null and wordless texts link with nothing; each is a class of its own. A document of fewer than n
words has one shingle. Texts of any length are read whole. Repeated rows count once, and so do rows with a null
doc_id and equal sets. Documents with equal 64-bit set keys are copies, which are links too. Ties don't occur: a
class is named by its least doc_id. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.arrays import U, column, constants, fresh, mix, pieces, sets
from bitloom.session import discard, materialize

N, THRESHOLD = 2, 0.7
#: Sets below this size also use one-deletion neighbourhoods; in larger ones plain segments suffice. The result doesn't depend on it.
SHORT = 160
#: Token frequencies are counted in 2**BITS cells, whatever the input.
BITS = 20
SKETCH = 1 << BITS
DENSITY = 1.17
PROBE, INDEX, DELETED, LINKED = 1, 2, 4, 8
FLUSH, PER_PART = 1 << 20, 1 << 21
#: Signatures of one value beyond these are paired by chunks of so many.
HOT = 1 << 14
#: Colliding pairs of a part beyond which repeats are dropped.
ROOM = 1 << 20
#: Colliding pairs, repeats included, that meet in one block pair.
TOGETHER = 1 << 21
#: Tokens that are compared in one task, and tokens times pairs beyond which a group is split.
WEIGHT, WORK = 1 << 21, 1 << 31
#: Sides of at most so many rows (24 bytes each) are broadcast; larger ones are shuffled. The result doesn't depend on it.
BROADCAST_ROWS = 2_000_000
#: Sets that share a minimum hash from which on they may be a crowd, and the hashes of each set.
CROWD, CROWD_BINS = 128, 8
#: By how much Jaccard with a crowd's centre may be below the threshold; the share of a sample's pairs that has to reach it; the sample.
CROWD_SLACK, CROWD_SHARE, CROWD_SAMPLE = 0.1, 0.125, 64
#: Sets (and tokens) on a side of a task that compares a crowd.
CROWD_SIDE, CROWD_TOKENS = 2048, 1 << 20
#: Blocks that are split further: of more than these, the largest ones.
WIDE_ROWS = 1_000_000


@functools.cache
def bands(t: float) -> list[int]:
    """Lower ends of the size bands: a set of one band has partners in its own and the next lower one only."""
    b = [1, 2]
    while b[-1] < 1 << 31:
        b.append(max(b[-1] + 1, math.ceil(b[-1] / t - 1e-9)))
    return b


def segments(t: float, hi: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.ceil(DENSITY * (1 - t) / t * hi)).astype(np.int64)


def _starts(row: np.ndarray, top: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the non-empty segments of all rows begin, and their numbers; tokens (top: their upper 32 bits) are sorted within their row, so a segment is a run."""
    sid = (top * m.astype(U)[row]) >> U(32)
    new = np.ones(len(top), bool)
    new[1:] = (row[1:] != row[:-1]) | (sid[1:] != sid[:-1])
    at = np.flatnonzero(new)
    return at, sid[at]


def _levels(size: np.ndarray, t: float) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(whether lower, band, its upper end, which sets may have partners there, segments they need) for the sets' own bands and the next lower ones."""
    b = np.array(bands(t), np.int64)
    k = np.searchsorted(b, size, "right") - 1
    for lower in (False, True):
        band = k - lower
        lo, hi = b[np.maximum(band, 0)], b[np.maximum(band, 0) + 1]
        most = np.minimum(size, hi - 1) if lower else size
        live = (size > 0) & (band >= 0) & (np.ceil(t * size - 1e-9) <= most)
        yield lower, band, hi, live, np.where(live, np.floor((1 - t) / (1 + t) * (size + most) + 1e-9).astype(np.int64) + 1, 0)


def shortfall(row: np.ndarray, tok: np.ndarray, n: int, t: float, most_short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """(how many signatures each row has, which rows fall short) as of signatures(), which makes them."""
    size, top = np.bincount(row, minlength=n), tok >> U(20)
    number, lacking = np.zeros(n, np.int64), np.zeros(n, bool)
    for lower, _, hi, live, need in _levels(size, t):
        own = live[row]
        if not own.any():
            continue
        r = row if own.all() else row[own]
        at, _ = _starts(r, top if own.all() else top[own], segments(t, hi))
        of, long = r[at], np.diff(np.append(at, len(r)))
        count = np.bincount(of, minlength=n)
        short = hi <= most_short
        lack = np.maximum(need - count, 0)
        several = (long > 1) & short[of]
        have = np.where(lack > 0, np.bincount(of[several], minlength=n), 0)
        # of rows without any lack the neighbourhoods are indexed only, and not at all in the lower band
        near = np.bincount(of[several], long[several], n).astype(np.int64)
        number += (np.minimum(need, count) + np.where(lack > 0, near, 0)) if lower else count + near
        lacking |= (lack > have) & (need > 0)
    return number, lacking


def _allocate(row: np.ndarray, long: np.ndarray, cost: np.ndarray, need: np.ndarray, short: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cheapest segments first: which are probed, of which also the neighbourhood, and which rows fall short."""
    count = np.bincount(row, minlength=n)
    begin = np.cumsum(count) - count
    key = (row.astype(U) << U(52)) | (cost.astype(U) << U(32)) | np.arange(len(row), dtype=U)
    order = (np.sort(key) & U(0xFFFFFFFF)).astype(np.int64)
    probe = np.zeros(len(order), bool)
    probe[order] = np.arange(len(order)) < np.repeat(begin + need, count)
    lack = np.maximum(need - count, 0)
    two = (long > 1) & (short & (lack > 0))[row]
    have = np.bincount(row, weights=two, minlength=n).astype(np.int64)
    return probe, two, (lack > have) & (need > 0)


def signatures(row: np.ndarray, tok: np.ndarray, n: int, t: float, heat: np.ndarray, most_short: int = SHORT) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """((row, signature, preceding probed signature where LINKED, flags), which rows fall short) of the sets of n rows."""
    size, c = np.bincount(row, minlength=n), []
    lacking = np.zeros(n, bool)
    each = row, tok >> U(20), mix(tok + U(0x632BE59BD9B4E019)), heat[(tok >> U(52 - BITS)).astype(np.int64)]
    for lower, band, hi, live, need in _levels(size, t):
        sel = live[row]
        if not sel.any():
            continue
        r, top, x, surprise = each if sel.all() else (a[sel] for a in each)
        at, sid = _starts(r, top, segments(t, hi))
        of, long, total = r[at], np.diff(np.append(at, len(r))), np.add.reduceat(x, at)
        salt = mix((band[of].astype(U) << U(40)) ^ sid ^ U(0x5851F42D4C957F2D))
        short = hi <= most_short
        probe, two, lack = _allocate(of, long, (1 << 19) - np.minimum(np.add.reduceat(surprise, at), 1 << 19), need, short, n)
        lacking |= lack
        sig = mix(total ^ salt)
        flags = np.where(probe, PROBE, 0) | (0 if lower else INDEX)
        prev, ok = np.zeros_like(sig), np.zeros(len(sig), bool)
        ok[1:] = (of[1:] == of[:-1]) & probe[:-1]
        prev[1:] = sig[:-1]
        flags |= np.where(ok, LINKED, 0)
        c.append((of, sig, prev, flags)) if not lower else c.append(tuple(a[probe] for a in (of, sig, prev, flags)))
        # Neighbourhoods: every short set is indexed under them, and probes them where it needs to.
        del_seg = two if lower else (long > 1) & short[of]
        if del_seg.any():
            pick = np.flatnonzero(np.repeat(del_seg, long))
            o = np.repeat(np.flatnonzero(del_seg), long[del_seg])
            s = mix((total[o] - x[pick]) ^ salt[o])
            c.append((of[o], s, np.zeros_like(s), DELETED | np.where(two[o], PROBE, 0) | (0 if lower else INDEX)))
            # A set that probes neighbourhoods probes all its plain segments too, which _allocate did.
    if not c:
        z = np.zeros(0, np.int64)
        return (z, z.astype(U), z.astype(U), z), lacking
    return tuple(np.concatenate(x) for x in zip(*c, strict=True)), lacking


def set_keys(row: np.ndarray, tok: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for the set of each row; 0 for an empty one. 4 bits for the size's power of two, then 20 of the token of least hash, which near duplicates mostly share."""
    key = np.zeros(n, U)
    if len(row):
        at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        x = mix(tok)
        size = np.diff(np.append(at, len(row)))
        kind = np.minimum(15, np.floor(np.log2(size) + 1e-9)).astype(U)
        least = np.minimum.reduceat(mix(x ^ U(0x71B54A325D192ED0)), at) & U(0xFFFFF)
        key[row[at]] = np.maximum((kind << U(60)) | (least << U(40)) | (mix(np.add.reduceat(x, at) + size.astype(U)) >> U(24)), U(1))
    return key


def _parities(row: np.ndarray, tok: np.ndarray, size: np.ndarray) -> list[bytes]:
    """For each row the parities of its tokens' counts by their last k bits, 2**k being its size or up to twice that, and 64 at least."""
    k = np.maximum(6, np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64))
    cells = np.int64(1) << k
    begin = np.cumsum(cells) - cells
    odd = np.bincount(begin[row] + (tok & (cells[row] - 1).astype(U)).astype(np.int64), minlength=int(cells.sum())) & 1
    bits = np.packbits(odd.astype(np.uint8)).tobytes()
    return [bits[b : b + n] for b, n in zip((begin // 8).tolist(), (cells // 8).tolist(), strict=True)]


def _parities_of(row: np.ndarray, tok: np.ndarray, size: np.ndarray, rows: np.ndarray) -> list[bytes]:
    place = np.full(len(size), -1)
    place[rows] = np.arange(len(rows))
    own = place[row] >= 0
    return _parities(place[row[own]], tok[own], size[rows]) if len(rows) else []


def bin_minima(row: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): for each row the least hash of its tokens in each of CROWD_BINS bins, the empty ones left out. Two sets share one about as often as their Jaccard says."""
    if not len(row):
        return row, np.zeros(0, np.int64)
    kind = tok >> U(52 - CROWD_BINS.bit_length() + 1)
    at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (kind[1:] != kind[:-1])))
    least = np.minimum.reduceat(mix(tok ^ U(0x3C79AC492BA7B653)), at)
    return row[at], ((least & ~U(CROWD_BINS - 1)) | kind[at]).view(np.int64)


def _apart(x: bytes, y: bytes) -> int:
    """How many parities differ, of the shorter one's cells."""
    n, low = min(len(x), len(y)), 0
    for z in (x, y):
        for at in range(0, len(z), n):
            low ^= int.from_bytes(z[at : at + n])
    return low.bit_count()


def _near(t: float, a: int, x: bytes, b: int, y: bytes) -> bool:
    """Whether sets of sizes a and b with parities x and y have about Jaccard t or more."""
    if min(a, b) < t * max(a, b) - 1e-9:
        return False
    cells = 8 * min(len(x), len(y))
    return _apart(x, y) <= cells / 2 * (1 - math.exp(-2 * (1 - t) / (1 + t) * (a + b) / cells))


def _crowd_of(t: float, crowds, at: np.ndarray, value: np.ndarray, size: np.ndarray, parities) -> np.ndarray:
    """The crowd of each row, 0 for none: the first one that it shares a minimum (at: row, value) with and whose centre it is near. parities: of the rows given."""
    values, rank, centres, kept = crowds
    out = np.zeros(len(size), np.uint32)
    if not len(values) or not len(at):
        return out
    i = np.minimum(np.searchsorted(values, value), len(values) - 1)
    met = values[i] == value
    pairs = np.unique((at[met].astype(U) << U(32)) | rank[i[met]].astype(U))
    rows = np.unique((pairs >> U(32)).astype(np.int64))
    bits = dict(zip(rows.tolist(), parities(rows), strict=True))
    for p in pairs.tolist():
        r, c = p >> 32, p & 0xFFFFFFFF
        if not out[r] and _near(t - CROWD_SLACK, int(size[r]), bits[r], *centres[c]):
            out[r] = c + 1
    return out if kept is None else np.where(kept[out], out, np.uint32(0))


SCAN = "rid bigint, id bigint, key bigint, size int, lacking boolean, n_sig bigint, parities binary, mins array<bigint>, slice int, counts binary"


def _scan(n: int, t: float, short: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and this task's token counts, which are summed over the corpus."""
    c, heat = constants(), np.zeros(SKETCH, np.int32)
    names = ["rid", "id", "key", "size", "lacking", "n_sig", "parities", "mins", "slice", "counts"]
    for batch in batches:
        for p in pieces(batch, "text"):
            row, tok = sets(c, column(p, "text"), n)
            heat += np.bincount((tok >> U(52 - BITS)).astype(np.int64), minlength=SKETCH).astype(np.int32)
            k = p.num_rows
            n_sig, lacking = shortfall(row, tok, k, t, short)
            size = np.bincount(row, minlength=k)
            at, value = bin_minima(row, tok)
            mins = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(at, minlength=k))), pa.int32()), pa.array(value, pa.int64()))
            yield pa.RecordBatch.from_arrays([column(p, "rid"), column(p, "id"), pa.array(set_keys(row, tok, k).view(np.int64)), pa.array(size.astype(np.int32)), pa.array(lacking), pa.array(n_sig), pa.array(_parities(row, tok, size), pa.binary()), mins, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
    if heat.any():
        cut = [x.astype(np.min_scalar_type(int(x.max()))) for x in np.split(heat, 16)]
        yield pa.RecordBatch.from_arrays([pa.nulls(16, pa.int64())] * 3 + [pa.nulls(16, pa.int32()), pa.nulls(16, pa.bool_()), pa.nulls(16, pa.int64()), pa.nulls(16, pa.binary()), pa.nulls(16, pa.list_(pa.int64())), pa.array(range(16), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], names)


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH // 16, np.int64)
    for x in table["counts"]:
        total += np.frombuffer(x.as_buffer(), f"u{len(x.as_buffer()) * 16 // SKETCH}")
    return pa.table({"slice": table["slice"][:1], "counts": pa.array([total.astype("u8").tobytes()], pa.binary())})


def size_codes(size: np.ndarray) -> np.ndarray:
    """A byte for a size, in steps of 6 percent; 255 for any beyond."""
    return np.minimum(255, np.floor(np.log(np.maximum(size, 1)) / np.log(1.06) + 1e-9)).astype(np.uint8)


def _emit(n: int, t: float, short: int, parts: int, heat, crowds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures, packed by partition: a key, a size and a count for each document, and 4 or 8 bytes a signature; the crowds of those that are in one. Of copies that are held together one is sent."""
    c, hot = constants(), heat.value
    held, keys, groups, count, docs = [], [], [], 0, 0

    def flush() -> pa.RecordBatch:
        doc, sig, prev, flags, size = (np.concatenate(x) for x in zip(*held, strict=True))
        key, crowd = np.concatenate(keys), np.concatenate(groups)
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        keep = (first[of] == np.arange(len(key)))[doc]
        doc, sig, prev, flags, size = doc[keep], sig[keep], prev[keep], flags[keep], size[keep]
        part = ((sig >> U(32)) * U(parts)) >> U(32)
        order = np.argsort((part << U(32)) | doc.astype(U), kind="stable")
        part, doc, size, flags = part[order], doc[order], size[order], flags[order]
        low = (((sig & U(0xFFFFFFF)) << U(4)).astype(np.uint32))[order] | flags.astype(np.uint32)
        before, linked = (prev & U(0xFFFFFFFF)).astype(np.uint32)[order], flags & LINKED > 0
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        blobs = []
        for s, e in zip(at, np.append(at[1:], len(part)), strict=True):
            run = np.flatnonzero(np.append(True, doc[s + 1 : e] != doc[s : e - 1]))
            own = np.arange(e - s) - np.repeat(run, np.diff(np.append(run, e - s)))
            run = np.flatnonzero(own % 255 == 0)  # a count has a byte
            q = before[s:e][linked[s:e]]
            g = crowd[doc[s:e][run]]
            some = np.flatnonzero(g)
            blobs.append(b"".join((np.array([len(run), e - s, len(q), len(some)], np.uint32).tobytes(), key[doc[s:e][run]].tobytes(), low[s:e].tobytes(), q.tobytes(), size[s:e][run].tobytes(), np.diff(np.append(run, e - s)).astype(np.uint8).tobytes(), some.astype(np.uint32).tobytes(), g[some].tobytes())))
        return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])

    for batch in batches:
        for p in pieces(batch, "text"):
            row, tok = sets(c, column(p, "text"), n)
            (r, sig, prev, flags), lacking = signatures(row, tok, p.num_rows, t, hot, short)
            if docs + p.num_rows > 60_000 or count > FLUSH:
                yield flush()
                held, keys, groups, count, docs = [], [], [], 0, 0
            if len(r):
                n_tok = np.bincount(row, minlength=p.num_rows)
                size = size_codes(n_tok)
                held.append((r + docs, sig, prev, flags, size[r]))
                count += len(r)
                keys.append(set_keys(row, tok, p.num_rows))
                groups.append(np.where(lacking, np.uint32(0), _crowd_of(t, crowds.value, *bin_minima(row, tok), n_tok, functools.partial(_parities_of, row, tok, n_tok))))
                docs += p.num_rows
    if held:
        yield flush()


def _unpack(blobs: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """(key, size code, signature and flags, preceding, crowd) of every signature."""
    keys, sizes, lows, prevs, crowds = [], [], [], [], []
    for x in blobs:
        b = x.as_buffer()
        d, r, q, g = np.frombuffer(b, np.uint32, 4).tolist()
        low = np.frombuffer(b, np.uint32, r, 16 + 8 * d)
        at = 16 + 8 * d + 4 * (r + q)
        times = np.frombuffer(b, np.uint8, d, at + d)
        prev = np.zeros(r, np.uint32)
        prev[low & LINKED > 0] = np.frombuffer(b, np.uint32, q, 16 + 8 * d + 4 * r)
        keys.append(np.repeat(np.frombuffer(b, U, d, 16), times))
        sizes.append(np.repeat(np.frombuffer(b, np.uint8, d, at), times))
        lows.append(low)
        prevs.append(prev)
        crowd = np.zeros(d, np.uint32)
        crowd[np.frombuffer(b, np.uint32, g, at + 2 * d)] = np.frombuffer(b, np.uint32, g, at + 2 * d + 4 * g)
        crowds.append(np.repeat(crowd, times))
    return tuple(np.concatenate(x) for x in (keys, sizes, lows, prevs, crowds))


def pack_pairs(keys: np.ndarray, code: np.ndarray) -> bytes:
    """Adjacency lists: the sorted keys, how many greater partners each has, and these. code is a * len(keys) + b of each pair, sorted."""
    d = U(len(keys))
    a, b = code // d, code % d
    return b"".join((np.array([len(keys), len(code)], np.int64).tobytes(), keys.tobytes(), np.bincount(a.astype(np.int64), minlength=len(keys)).astype(np.uint32).tobytes(), b.astype(np.uint16 if len(keys) <= 65_536 else np.uint32).tobytes()))


def unpack_pairs(blob) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, a, b): the pairs as places in keys."""
    d, p = np.frombuffer(blob, np.int64, 2).tolist()
    keys, times = np.frombuffer(blob, U, d, 16), np.frombuffer(blob, np.uint32, d, 16 + 8 * d)
    return keys, np.repeat(np.arange(d), times), np.frombuffer(blob, np.uint16 if d <= 65_536 else np.uint32, p, 16 + 12 * d).astype(np.int64)


def _row(keys: np.ndarray, code: np.ndarray) -> dict:
    """The distinct pairs as a row, with the blocks in which many of them lie."""
    used, back = np.unique(np.concatenate((code // U(len(keys)), code % U(len(keys)))).astype(np.int64), return_inverse=True)
    a, b = np.split(back.astype(U), 2)
    keys = keys[used]
    place = keys[a.astype(np.int64)] >> U(40)
    place, n = np.unique(place[place == keys[b.astype(np.int64)] >> U(40)], return_counts=True)
    return {"n": len(code), "pairs": pack_pairs(keys, a * U(len(keys)) + b), "place": place[n >= 512].astype(np.int64).tolist(), "times": n[n >= 512].tolist(), "chunks": None}


PAIRS = "n bigint, pairs binary, place array<bigint>, times array<bigint>, chunks binary"
_PAIRS = pa.schema([("n", pa.int64()), ("pairs", pa.binary()), ("place", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("chunks", pa.binary())])


def _far(t: float) -> int:
    """By how much the size codes of sets with Jaccard t may differ."""
    return math.floor(-math.log(t) / math.log(1.06) + 1e-9) + 1


def _partners(t: float, size: np.ndarray, flags: np.ndarray, crowd: np.ndarray, run: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to where the signatures of each one's run may be its partners. In a run without crowds, in the order of sizes, these are none that are too
    large and, as larger sets probe, for one that only probes none that are larger."""
    end = run + length
    plain = np.repeat((crowd[end - 1] == 0) & (size[end - 1] < 255), length)
    place = np.repeat(np.arange(len(run)) << 9, length) + np.where(plain, size, 0)
    to = np.searchsorted(place, place + np.where(flags & INDEX > 0, _far(t), 0), "right")
    return np.where(plain, to, np.repeat(end, length))


def _meet(t: float, key: np.ndarray, size: np.ndarray, flags: np.ndarray, prev: np.ndarray, crowd: np.ndarray, left: np.ndarray, side: np.ndarray | None = None) -> Iterator[dict]:
    """Rows of the pairs among signatures of equal value that follow each other; left: how many are left to the end of each one's run.

    The larger set probes, the smaller one is indexed; a pair whose preceding segments are equal too is met there. Pairs of one crowd are passed over; a run is in the order of crowds. With side only pairs of different sides count."""
    keys, own = np.unique(key, return_inverse=True)
    own, d, k = own.astype(U), 1, U(len(keys))
    both, far = size.astype(np.int16) << 4 | flags.astype(np.int16), _far(t)
    new = np.flatnonzero(np.append(True, (crowd[1:] != crowd[:-1]) | (left[1:] != left[:-1] - 1))) if len(crowd) else np.zeros(0, np.int64)
    length = np.diff(np.append(new, len(crowd)))
    skip = np.where(crowd > 0, np.repeat(new + length, length) - np.arange(len(crowd)) - 1, 0)  # to the crowd's end
    alive, out, held, done = np.flatnonzero(left > 1 + skip), [], 0, False  # done: whether out begins with distinct pairs
    while len(alive):
        for part in np.array_split(alive, max(1, len(alive) >> 18)):
            j = part + skip[part] + d
            f, g = both[part], both[j]
            x, y = f >> 4, g >> 4
            ok = (((f & PROBE > 0) & (g & INDEX > 0) & (x >= y)) | ((g & PROBE > 0) & (f & INDEX > 0) & (y >= x))) & ((f & g & DELETED) == 0)
            ok &= (np.abs(x - y) <= far) | (np.maximum(x, y) == 255)
            if not ok.any():
                continue
            some = np.flatnonzero(ok)
            i, j, linked = part[some], j[some], f[some] & g[some] & LINKED > 0
            a, b = own[i], own[j]
            ok = (a != b) & (~linked | (prev[i] != prev[j]))
            if side is not None:
                ok &= side[i] != side[j]
            a, b = a[ok], b[ok]
            if len(a):
                out.append(np.minimum(a, b) * k + np.maximum(a, b))
                held += len(a)
                # Sorted anew only after as many more as are distinct so far: the sorts take no longer than a few of the last one.
                if held > max(ROOM, len(out[0]) if done else 0):
                    out, held, done = [np.unique(np.concatenate(out))], 0, True
                    if len(out[0]) > 4 * ROOM:
                        yield _row(keys, out[0])
                        out, done = [], False
        d += 1
        alive = alive[left[alive] > d + skip[alive]]
    if out:
        yield _row(keys, np.unique(np.concatenate(out)))


def _pack_chunk(i: np.ndarray, key: np.ndarray, size: np.ndarray, flags: np.ndarray, prev: np.ndarray, crowd: np.ndarray, cut: int) -> bytes:
    return b"".join((np.array([len(i), cut], np.int64).tobytes(), key[i].tobytes(), prev[i].tobytes(), crowd[i].tobytes(), size[i].tobytes(), flags[i].astype(np.uint8).tobytes()))


def _chunks(t: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of chunks of a hot signature."""
    for batch in batches:
        for x in column(batch, "chunks"):
            b = x.as_buffer()
            n, cut = np.frombuffer(b, np.int64, 2).tolist()
            key, prev, crowd, size, flags = (np.frombuffer(b, kind, n, 16 + at * n) for kind, at in ((U, 0), (np.uint32, 8), (np.uint32, 12), (np.uint8, 16), (np.uint8, 17)))
            side = np.arange(n) >= cut if cut else None
            for r in _meet(t, key, size, flags, prev, crowd, np.arange(n, 0, -1), side):
                yield pa.RecordBatch.from_pylist([r], _PAIRS)


def _collide(t: float, hot: int, table: pa.Table) -> pa.Table:
    """The pairs of one partition's signatures, each only where the preceding segments don't already tell; of hot ones the chunks that are to be paired."""
    key, size, low, prev, crowd = _unpack(table["blob"])
    comp = np.sort((low >> np.uint32(4)).astype(U) << U(35) | np.arange(len(low), dtype=U))
    idx, sig = (comp & U((1 << 35) - 1)).astype(np.int64), comp >> U(35)
    dup = np.zeros(len(sig), bool)
    dup[1:] = sig[1:] == sig[:-1]
    dup[:-1] |= dup[1:]
    idx, sig = idx[dup], sig[dup]
    key, flags, prev, size, crowd = key[idx], low[idx] & np.uint32(15), prev[idx], size[idx], crowd[idx]
    order = np.lexsort((flags, key, size, crowd, sig))
    key, flags, prev, size, crowd, sig = key[order], flags[order], prev[order], size[order], crowd[order], sig[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]) | ((flags[1:] ^ flags[:-1]) & DELETED > 0)
    key, flags, prev, size, crowd, sig = key[new], flags[new], prev[new], size[new], crowd[new], sig[new]
    run = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    length = np.diff(np.append(run, len(sig)))
    probing = np.add.reduceat((flags & PROBE) > 0, run) > 0 if len(run) else np.zeros(0, bool)
    left = np.where(np.repeat(probing & (length <= hot), length), _partners(t, size, flags, crowd, run, length), np.repeat(run, length)) - np.arange(len(sig))
    rows = list(_meet(t, key, size, flags, prev, crowd, left))
    for at, n in zip(run[probing & (length > hot)], length[probing & (length > hot)], strict=True):
        cut = np.array_split(np.arange(at, at + n), -(-n // hot))
        for i, x in enumerate(cut):
            for y in cut[i:]:
                if crowd[x[0]] == crowd[y[-1]] > 0:
                    continue
                rows.append({"n": None, "pairs": None, "place": None, "times": None, "chunks": _pack_chunk(x if y is x else np.concatenate((x, y)), key, size, flags, prev, crowd, 0 if y is x else len(x))})
    return pa.Table.from_pylist(rows, _PAIRS)


def _block(keys: np.ndarray, blocks: int, wide: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The block of each set: its size's power of two and one of so many by its least token; of a wide one by the rest as well."""
    place = keys >> U(40)
    sub = np.zeros(len(keys), U)
    if len(wide[0]):
        at = np.minimum(np.searchsorted(wide[0], place), len(wide[0]) - 1)
        sub = np.where(wide[0][at] == place, mix(keys) % wide[1][at], U(0))
    return ((keys >> U(60)) * U(blocks) + mix(place * U(0x9E3779B97F4A7C15) + sub) % U(blocks)).astype(np.int64)


def _route(blocks: int, wide, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs by pairs of blocks, as lists or, where these are longer, as they are."""
    for batch in batches:
        for x in column(batch, "pairs"):
            keys, a, b = unpack_pairs(x.as_buffer())
            of = _block(keys, blocks, wide.value)
            grp = np.minimum(of[a], of[b]) * (16 * blocks) + np.maximum(of[a], of[b])
            order = np.argsort(grp, kind="stable")
            grp, a, b = grp[order], a[order], b[order]
            at = np.flatnonzero(np.append(True, grp[1:] != grp[:-1]))
            blobs = []
            for s, e in zip(at, np.append(at[1:], len(grp)), strict=True):
                used, back = np.unique(np.concatenate((a[s:e], b[s:e])), return_inverse=True)
                p, q = np.split(back.astype(U), 2)
                lists = pack_pairs(keys[used], np.sort(p * U(len(used)) + q)) if 12 * len(used) + 2 * (e - s) < 16 * (e - s) else None
                blobs.append(lists or b"".join((np.array([-1, e - s], np.int64).tobytes(), keys[a[s:e]].tobytes(), keys[b[s:e]].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(grp[at]), pa.array(blobs, pa.binary())], ["grp", "blob"])


def _merge(table: pa.Table) -> pa.Table:
    """The distinct pairs of a pair of blocks."""
    lo, hi = [], []
    for x in table["blob"]:
        b = x.as_buffer()
        if np.frombuffer(b, np.int64, 1)[0] < 0:
            n = int(np.frombuffer(b, np.int64, 1, 8)[0])
            lo.append(np.frombuffer(b, U, n, 16))
            hi.append(np.frombuffer(b, U, n, 16 + 8 * n))
        else:
            keys, p, q = unpack_pairs(b)
            lo.append(keys[p])
            hi.append(keys[q])
    n = sum(map(len, lo))
    keys, back = np.unique(np.concatenate(lo + hi), return_inverse=True)
    code = np.unique(back[:n].astype(U) * U(len(keys)) + back[n:].astype(U))
    return pa.table({"grp": table["grp"][:1], "n": pa.array([len(code)], pa.int64()), "blob": pa.array([pack_pairs(keys, code)], pa.binary())})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, key): the sets that each pair of blocks needs."""
    for batch in batches:
        for g, x in zip(column(batch, "grp").to_pylist(), column(batch, "blob"), strict=True):
            keys = unpack_pairs(x.as_buffer())[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), g)), pa.array(keys.view(np.int64))], ["at", "key"])


def _bound(t: float, pairs: pa.Table, found: pa.Table) -> pa.Table:
    """(a, b, w) of the pairs that sizes and parities don't rule out; w: their tokens."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "w": pa.array([], pa.int64())})
    if not pairs.num_rows or not found.num_rows:
        return none
    key = found["key"].to_numpy().view(U)
    order = np.argsort(key, kind="stable")
    key, size = key[order], found["size"].to_numpy().astype(np.int64)[order]
    raw = [x.as_buffer() for x in found["parities"].take(pa.array(order))]
    words = np.array([len(x) // 8 for x in raw])
    level, place, rows = {}, np.zeros(len(key), np.int64), {}
    for k in np.unique(words).tolist():
        own = np.flatnonzero(words == k)
        place[own] = np.arange(len(own))
        level[k, k] = np.frombuffer(b"".join(raw[i] for i in own), U).reshape(len(own), k)
    del raw
    out = []
    for blob in pairs["blob"]:
        keys, a, b = unpack_pairs(blob.as_buffer())
        at = np.searchsorted(key, keys)
        a, b = at[a], at[b]
        ok = np.minimum(size[a], size[b]) >= t * np.maximum(size[a], size[b]) - 1e-9
        a, b = a[ok], b[ok]
        most = np.floor((1 - t) / (1 + t) * (size[a] + size[b]) + 1e-9)
        kind = words[a] << 32 | words[b]
        for k in np.unique(kind).tolist():
            x, y = k >> 32, k & 0xFFFFFFFF
            to = min(x, y)
            for w in (x, y):
                if (w, to) not in level:  # the parities of twice the cells, folded
                    level[w, to] = np.bitwise_xor.reduce(level[w, w].reshape(-1, w // to, to), 1)
            mine = np.flatnonzero(kind == k)
            for part in np.array_split(mine, max(1, len(mine) * to >> 19)):
                d = np.bitwise_count(level[x, to][place[a[part]]] ^ level[y, to][place[b[part]]]).sum(1, dtype=np.int64)
                p = part[d <= most[part]]
                out.append((a[p], b[p]))
    if not out:
        return none
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"a": key[a].view(np.int64), "b": key[b].view(np.int64), "w": size[a] + size[b]})


def pack_tokens(tok: np.ndarray) -> bytes:
    """Ascending 52-bit tokens: 5 low bytes and the growth of the rest in a byte each, or 8 bytes where a growth is too large."""
    grow = np.diff(tok >> U(40), prepend=U(0))
    if len(tok) and grow.max() < 256:
        return b"\1" + grow.astype(np.uint8).tobytes() + np.ascontiguousarray(tok.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
    return b"\0" + tok.tobytes()


def unpack_tokens(b) -> np.ndarray:
    if bytes(memoryview(b)[:1]) == b"\0":
        return np.frombuffer(bytes(memoryview(b)[1:]), U)
    n = (len(b) - 1) // 6
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8, 5 * n, 1 + n).reshape(n, 5)
    return out.view(U)[:, 0] | (np.cumsum(np.frombuffer(b, np.uint8, n, 1), dtype=U) << U(40))


TOKENS = "at bigint, key bigint, copies bigint, tokens binary"


def _set_rows(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the texts, once for each place in ats; of repeated rows in a task one is sent."""
    c, seen = constants(), set()
    for batch in batches:
        for p in pieces(batch, "text"):
            new = [r not in seen and not seen.add(r) for r in column(p, "rid").to_pylist()]
            p = p.filter(pa.array(new, pa.bool_()))
            row, tok = sets(c, column(p, "text"), n)
            k = p.num_rows
            key, size = set_keys(row, tok, k), np.bincount(row, minlength=k)
            ends = np.cumsum(size)
            ats = column(p, "ats").to_pylist()
            of = np.repeat(np.arange(k), [len(x) for x in ats])
            packed = [pack_tokens(tok[e - s : e]) for s, e in zip(size, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([y for x in ats for y in x], pa.int64()), pa.array(key.view(np.int64)[of]), column(p, "copies").take(pa.array(of)), pa.array([packed[i] for i in of], pa.binary())], ["at", "key", "copies", "tokens"])


FOUND = "a bigint, b bigint, jaccard double, n bigint"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64()), ("n", pa.int64())])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges connect what those before them don't."""
    up, keep = list(range(n)), np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the symmetric matrix near connects."""
    new, a, b = np.ones(len(near), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for root in range(len(near)):
        front = np.array([root] if new[root] else [], np.int64)
        new[front] = False
        while len(front):
            rows = near[front]
            to = np.flatnonzero(rows.any(0) & new)
            a.append(front[rows[:, to].argmax(0)] if len(to) else to)
            b.append(to)
            new[to] = False
            front = to
    return np.concatenate(a), np.concatenate(b)


def _crowd_task(crowd, i, j):
    """A number below 0 for the task that compares two sides of a crowd, in the bits above the lowest, which is for the side."""
    return -((crowd * (1 << 30) + i * (1 << 15) + j) + 1)


def _verify_crowd(t: float, links: bool, found: pa.Table) -> pa.Table:
    """As _verify, of all pairs between two sides of a crowd or within one."""
    key, first = np.unique(found["key"].to_numpy(), return_index=True)
    at = found["at"].to_numpy()[first]
    task = -int(at[0] >> 1) - 1
    within, side = (task >> 15) & 0x7FFF == task & 0x7FFF, at & 1
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if within else 1))
    if not len(x) or not len(y):
        return _FOUND.empty_table()
    tokens = [unpack_tokens(b.as_buffer()) for b in found["tokens"].take(pa.array(first))]
    size, copies = np.array([len(b) for b in tokens]), found["copies"].to_numpy()[first]
    place = np.zeros(len(key), np.int64)
    place[y] = np.arange(len(y))
    place[x] = np.arange(len(x))
    _, code, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    del tokens
    row = np.repeat(np.arange(len(key)), size)
    some = (times > 1)[code]
    order = np.argsort(code[some], kind="stable")
    row, code = row[some][order], code[some][order]
    edge = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(code)))
    left = np.add.reduceat(side[row] == 0, edge, dtype=np.int64) if len(edge) else edge
    meet = left * (left if within else count - left)
    common = np.zeros((len(x), len(y)), np.int32)
    # Tokens of many pairs by products of matrices, which hold so many tokens; the others one by one.
    dense = meet * 256 > common.size
    for i in np.flatnonzero(~dense & (meet > 0)).tolist():
        r = row[edge[i] : edge[i] + count[i]]
        common[np.ix_(place[r[side[r] == 0]], place[r[side[r] == (0 if within else 1)]])] += 1
    number = np.repeat(np.cumsum(dense) - 1, count)
    own = np.repeat(dense, count)
    row, number = row[own], number[own]
    for lo in range(0, int(dense.sum()), 2048):
        s, e = np.searchsorted(number, (lo, lo + 2048))
        has = np.zeros((len(key), 2048), np.float32)
        has[row[s:e], number[s:e] - lo] = 1
        common += (has[x] @ has[y].T).astype(np.int32)
    score = common / (size[x][:, None] + size[y][None] - common)
    near = score >= t - 1e-12
    if within:
        np.fill_diagonal(near, False)
    if not links:
        a, b = np.nonzero(np.triu(near) if within else near)
        return pa.table({"a": np.minimum(key[x[a]], key[y[b]]), "b": np.maximum(key[x[a]], key[y[b]]), "jaccard": score[a, b], "n": pa.nulls(len(a), pa.int64())}, _FOUND)
    n = np.zeros(len(key), np.int64)
    n[x] = near @ copies[y]
    if not within:
        n[y] = near.T @ copies[x]
    a, b = _spanning(near if within else np.block([[np.zeros((len(x), len(x)), bool), near], [near.T, np.zeros((len(y), len(y)), bool)]]))
    ids, some = (key[x] if within else key[np.concatenate((x, y))]), np.flatnonzero(n)
    a, b = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
    got = pa.table({"a": a, "b": b, "jaccard": pa.nulls(len(a), pa.float64()), "n": pa.nulls(len(a), pa.int64())}, _FOUND)
    return pa.concat_tables([got, pa.table({"a": key[some], "b": pa.nulls(len(some), pa.int64()), "jaccard": pa.nulls(len(some), pa.float64()), "n": n[some]}, _FOUND)])


def _verify(t: float, links: bool, pairs: pa.Table, found: pa.Table) -> pa.Table:
    """The pairs whose Jaccard is at least t; with links only those that connect sets, and for each set (a) the documents (n) that its pairs link it with."""
    if found.num_rows and found["at"][0].as_py() < 0:
        return _verify_crowd(t, links, found)
    if not pairs.num_rows or not found.num_rows:
        return _FOUND.empty_table()
    key, first = np.unique(found["key"].to_numpy(), return_index=True)
    tokens = [unpack_tokens(x.as_buffer()) for x in found["tokens"].take(pa.array(first))]
    size = np.array([len(x) for x in tokens])
    begin = np.cumsum(size) - size
    every, code = np.unique(np.concatenate(tokens), return_inverse=True)
    del tokens
    a, b = np.searchsorted(key, pairs["a"].to_numpy()), np.searchsorted(key, pairs["b"].to_numpy())
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    has, common = np.zeros(len(every), bool), np.zeros(len(a), np.int64)
    at = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    for s, e in zip(at.tolist(), np.append(at[1:], len(a)).tolist(), strict=True):
        own = code[begin[a[s]] : begin[a[s]] + size[a[s]]]
        has[own] = True
        for part in np.array_split(np.arange(s, e), max(1, int(size[b[s:e]].sum()) >> 21)):
            k = size[b[part]]
            off = np.cumsum(k) - k
            where = np.arange(int(k.sum())) + np.repeat(begin[b[part]] - off, k)
            common[part] = np.add.reduceat(has[code[where]], off, dtype=np.int64)
        has[own] = False
    score = common / (size[a] + size[b] - common)
    ok = score >= t - 1e-12
    a, b, score = a[ok], b[ok], score[ok]
    keep = _forest(a, b, len(key)) if links else np.ones(len(a), bool)
    got = pa.table({"a": key[a[keep]], "b": key[b[keep]], "jaccard": score[keep], "n": pa.nulls(int(keep.sum()), pa.int64())}, _FOUND)
    if not links:
        return got
    copies = found["copies"].to_numpy()[first]
    n = np.bincount(a, copies[b], len(key)) + np.bincount(b, copies[a], len(key))
    some = np.flatnonzero(n)
    return pa.concat_tables([got, pa.table({"a": key[some], "b": pa.nulls(len(some), pa.int64()), "jaccard": pa.nulls(len(some), pa.float64()), "n": n[some].astype(np.int64)}, _FOUND)])


def _against(n: int, t: float, few, heat, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every set against those of few that it shares one of their rarest tokens with: of s tokens two sets with Jaccard t share one of any s - ceil(t s) + 1."""
    c, hot = constants(), heat.value
    hard = [(k, unpack_tokens(v)) for k, v in few.value]
    rare, of = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for i, (_, tok) in enumerate(hard):
        cost = hot[(tok >> U(52 - BITS)).astype(np.int64)]
        rare.append(tok[np.argsort(-cost, kind="stable")[: len(tok) - math.ceil(t * len(tok) - 1e-9) + 1]])
        of.append(np.full(len(rare[-1]), i))
    rare, of = np.concatenate(rare), np.concatenate(of)
    order = np.argsort(rare, kind="stable")
    rare, of = rare[order], of[order]
    for batch in batches:
        for p in pieces(batch, "text"):
            row, tok = sets(c, column(p, "text"), n)
            size = np.bincount(row, minlength=p.num_rows)
            key, ends, out = set_keys(row, tok, p.num_rows).view(np.int64), np.cumsum(size), []
            lo, hi = np.searchsorted(rare, tok, "left"), np.searchsorted(rare, tok, "right")
            met = np.flatnonzero(hi > lo)
            pairs = {(int(row[i]), int(j)) for i in met for j in of[lo[i] : hi[i]]}
            for i, j in sorted(pairs):
                (k, q), x = hard[j], tok[ends[i] - size[i] : ends[i]]
                if k != key[i] and min(len(x), len(q)) >= t * max(len(x), len(q)) - 1e-9:
                    common = len(np.intersect1d(x, q, assume_unique=True))
                    score = common / (len(x) + len(q) - common)
                    if score >= t - 1e-12:
                        out.append((min(k, int(key[i])), max(k, int(key[i])), score, None))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_FOUND)], _FOUND.names)


def _small(df: DataFrame) -> DataFrame:
    """df, a table of ids, broadcast while it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _parts(docs: DataFrame, rep: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """The tokens of the sets that are needed, each at its places (at, key)."""
    wanted = materialize(places.groupBy("key").agg(F.collect_list("at").alias("ats")).join(rep.select("key", "rid", "copies"), "key").select("rid", "ats", "copies"), "wanted")
    return docs.select("rid", "text").join(_small(wanted), "rid").mapInArrow(functools.partial(_set_rows, n), TOKENS)


def _label(t: float, crowds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, crowd, size, parities) of the sets in a crowd."""
    for batch in batches:
        mins, bits = column(batch, "mins"), column(batch, "parities")
        size = column(batch, "size").to_numpy()
        crowd = _crowd_of(t, crowds.value, mins.value_parent_indices().to_numpy(), mins.flatten().to_numpy(), size, lambda rows, bits=bits: bits.take(pa.array(rows)).to_pylist())
        some = pa.array(np.flatnonzero(crowd))
        yield pa.RecordBatch.from_arrays([column(batch, "key").take(some), pa.array(crowd.astype(np.int64)).take(some), column(batch, "size").take(some), bits.take(some)], ["key", "crowd", "size", "parities"])


def _share(t: float, table: pa.Table) -> pa.Table:
    """The share of a sample's pairs that seem to have Jaccard t or more."""
    own = list(zip(table["size"].to_pylist(), table["parities"].to_pylist(), strict=True))[: 2 * CROWD_SAMPLE]
    near = sum(_near(t, *a, *b) for i, a in enumerate(own) for b in own[:i])
    return pa.table({"crowd": table["crowd"][:1], "share": pa.array([near / max(1, len(own) * (len(own) - 1) // 2)])})


def _crowds(rep: DataFrame, t: float, side: int) -> tuple[object, DataFrame | None]:
    """What _crowd_of needs, broadcast, and (at, key): the places of the sets of each crowd, None without crowds."""
    spark = rep.sparkSession
    often = rep.filter("NOT lacking").select(F.explode("mins").alias("value"), F.struct("copies", "key").alias("w")).groupBy("value").agg(F.count("*").alias("n"), F.max("w").alias("w")).filter(F.col("n") >= CROWD)
    often = materialize(often.select("value", "w.*"), "often")  # a sixteenth of the sets at most
    held = often.toArrow().sort_by("value")
    if not held.num_rows:
        return spark.sparkContext.broadcast((np.zeros(0, np.int64), None, None, None)), None
    centre = often.select("key").distinct().join(rep.select("key", "copies", "size", "parities"), "key").toArrow().sort_by([("copies", "descending"), ("key", "descending")])
    number = {k: i for i, k in enumerate(centre["key"].to_pylist())}
    rank = np.array([number[k] for k in held["key"].to_pylist()], np.uint32)
    values, centres = held["value"].to_numpy(), list(zip(centre["size"].to_pylist(), centre["parities"].to_pylist(), strict=True))
    label = materialize(rep.filter("NOT lacking").select("key", "size", "parities", "mins").mapInArrow(functools.partial(_label, t, spark.sparkContext.broadcast((values, rank, centres, None))), "key bigint, crowd bigint, size int, parities binary"), "crowds")
    total = label.groupBy("crowd").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")).filter(F.col("n") >= CROWD // 4)
    total = materialize(total, "totals")
    every = F.ceil(F.col("n") / CROWD_SAMPLE)
    sample = label.join(_small(total), "crowd").filter(F.pmod(F.xxhash64("key"), every) == 0).select("crowd", "size", "parities")
    dense = sample.groupBy("crowd").applyInArrow(lambda table: _share(t, table), "crowd bigint, share double").filter(F.col("share") >= CROWD_SHARE).select("crowd")
    dense = materialize(dense.join(total, "crowd"), "dense")
    kept = np.zeros(len(centres) + 1, bool)
    kept[dense.select("crowd").toArrow()["crowd"].to_numpy()] = True
    if not kept.any():
        return spark.sparkContext.broadcast((np.zeros(0, np.int64), None, None, None)), None
    sides = F.least(F.lit(1 << 15), F.greatest(F.ceil(F.col("n") / side), F.ceil(F.col("tokens") / CROWD_TOKENS)))
    own = label.select("key", "crowd").join(_small(dense.select("crowd", sides.alias("k"))), "crowd").withColumn("i", F.pmod(F.xxhash64("key"), F.col("k")))
    own = own.select("key", "crowd", "i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("j"))
    at = 2 * _crowd_task(F.col("crowd"), F.least("i", "j"), F.greatest("i", "j")) + (F.col("i") > F.col("j")).cast("bigint")
    return spark.sparkContext.broadcast((values, rank, centres, kept)), own.select(at.alias("at"), "key")


def _candidates(docs: DataFrame, n: int, t: float, parts: int, hot, crowds, rep: DataFrame) -> DataFrame:
    """(a, b, w) of the pairs of sets that collide and that sizes and parities don't rule out."""
    spark, most = docs.sparkSession, HOT
    packed = docs.select("text").mapInArrow(functools.partial(_emit, n, t, SHORT, parts, hot, crowds), "part int, blob binary")
    met = materialize(packed.groupBy("part").applyInArrow(lambda table: _collide(t, most, table), PAIRS), "met")
    tables, chunks = [met], met.filter("chunks IS NOT NULL").select("chunks")
    if not chunks.isEmpty():
        tables.append(materialize(chunks.repartition(max(8, parts)).mapInArrow(functools.partial(_chunks, t), PAIRS), "met"))
    every = functools.reduce(DataFrame.union, tables).filter("pairs IS NOT NULL")
    total = every.agg(F.sum("n")).first()[0] or 0
    # Blocks in which too many pairs lie are cut into sides; without that the largest only take longer.
    wide = every.select(F.explode(F.arrays_zip("place", "times")).alias("x")).groupBy("x.place").agg(F.sum("x.times").alias("n")).filter(F.col("n") > TOGETHER)
    wide = sorted(wide.orderBy(F.desc("n"), "place").limit(WIDE_ROWS).collect())
    held = spark.sparkContext.broadcast((np.array([x for x, _ in wide], U), np.array([math.ceil(math.sqrt(k / TOGETHER)) for _, k in wide], U)))
    blocks = math.ceil(math.sqrt(total / TOGETHER / 8)) or 1
    routed = every.select("pairs").mapInArrow(functools.partial(_route, blocks, held), "grp bigint, blob binary")
    pairs = materialize(routed.groupBy("grp").applyInArrow(_merge, "grp bigint, n bigint, blob binary"), "distinct")
    discard(*tables)
    sent = pairs.mapInArrow(_ends, "at bigint, key bigint").join(rep.select("key", "size", "parities"), "key")
    likely = materialize(pairs.groupBy("grp").cogroup(sent.groupBy("at")).applyInArrow(functools.partial(_bound, t), "a bigint, b bigint, w bigint"), "likely")
    discard(pairs)
    return likely


def _place(likely: DataFrame) -> DataFrame:
    """(a, b, grp): the pairs in groups by least neighbour, of which each set is in few; large ones are cut into sides."""
    near = likely.select(F.col("a").alias("x"), F.col("b").alias("y")).union(likely.select("b", "a")).groupBy("x").agg(F.least("x", F.min("y")).alias("g"))
    near = materialize(near, "near")
    of = _small(near)
    placed = likely.join(of.withColumnRenamed("x", "a"), "a").join(of.select(F.col("x").alias("b"), F.col("g").alias("h")), "b").select("a", "b", "w", F.least("g", "h").alias("g"))
    size = materialize(placed.groupBy("g").agg(F.sum("w").alias("n")), "sizes")
    groups = max(8, math.ceil(size.agg(F.sum(F.least("n", F.lit(WEIGHT)))).first()[0] or 0) // WEIGHT)
    wide = size.filter(F.col("n") > WORK).select("g", F.ceil(F.sqrt(F.col("n") / WORK)).alias("side"))
    one = F.coalesce("side", F.lit(1))
    grp = F.pmod(F.xxhash64("g", F.pmod(F.xxhash64("a"), one), F.pmod(F.xxhash64("b"), one)), F.lit(groups))
    placed = materialize(placed.join(_small(wide), "g", "left").select("a", "b", grp.alias("grp")), "placed")
    discard(near, size)
    return placed


def set_join(docs: DataFrame, n: int = N, t: float = THRESHOLD, links: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, sets, found) of docs(rid, id, text), tables in the shared folder.

    classes: rid, id, key, size of every document; equal sets share a key. sets: a row for each key, with
    the number of its documents (copies). found: a < b and their Jaccard, for all keys of distinct sets with
    Jaccard >= t; with links only pairs that connect all these sets, and rows (a, n) whose sums are the
    documents with other sets that a's are linked with."""
    if not 0.5 <= t < 1:
        raise ValueError("0.5 <= t < 1 is required")
    spark = docs.sparkSession
    scan = materialize(docs.mapInArrow(functools.partial(_scan, n, t, SHORT), SCAN), "scan")
    classes = scan.filter("slice IS NULL").drop("slice", "counts")
    add = scan.filter("slice IS NOT NULL").select("slice", "counts").groupBy("slice").applyInArrow(_add, "slice int, counts binary")
    heat = np.zeros(SKETCH, np.int64)
    for s, x in materialize(add, "counts").collect():  # 16 slices, 8 MB whatever the input
        heat[s * (SKETCH // 16) : (s + 1) * (SKETCH // 16)] = np.frombuffer(x, np.int64)
    # A segment's cost falls with the surprise of its tokens, in 1/256 bits: the chance that a document has them all.
    total, n_docs, lacking = classes.agg(F.sum("n_sig"), F.sum((F.col("size") > 0).cast("long")), F.sum(F.col("lacking").cast("long"))).first()
    heat = np.rint(-256 * np.log2(np.clip(heat / max(n_docs or 0, 1), 1e-9, 1))).astype(np.int32)
    hot = spark.sparkContext.broadcast(heat)
    copies = classes.filter("size > 0").select("key", "id").distinct().groupBy("key").agg(F.count("*").alias("copies"))
    rep = classes.filter("size > 0").groupBy("key").agg(F.min(F.struct("rid", "size", "lacking", "parities", "mins")).alias("r")).select("key", "r.*")
    rep = materialize(rep.join(copies, "key"), "sets")
    crowds, members = _crowds(rep, t, CROWD_SIDE if links else CROWD_SIDE // 2)
    likely = _candidates(docs, n, t, max(1, math.ceil((total or 0) / PER_PART)), hot, crowds, rep)
    if lacking:  # their pairs are found below, all of them
        few = rep.filter("lacking").select(F.col("key").alias("k"))
        likely = likely.join(few, F.col("a") == F.col("k"), "left_anti").join(few, F.col("b") == F.col("k"), "left_anti")
    placed = _place(likely)
    places = placed.select(F.col("grp").alias("at"), F.col("a").alias("key")).union(placed.select("grp", "b")).distinct()
    sent = _parts(docs, rep, places if members is None else places.union(members), n).withColumn("grp", F.when(F.col("at") < 0, F.shiftright("at", 1)).otherwise(F.col("at")))
    found = materialize(placed.groupBy("grp").cogroup(sent.groupBy("grp")).applyInArrow(functools.partial(_verify, t, links), FOUND), "found")
    discard(placed)
    if lacking:
        hard = materialize(_parts(docs, rep, rep.filter("lacking").select(F.lit(0).cast("bigint").alias("at"), "key"), n).dropDuplicates(["key"]), "lacking")
        # Only sets of about their sizes are read again; of all others, if these are many, none is spared.
        sizes = sorted(r.size for r in rep.filter("lacking").select("size").distinct().collect())
        like = materialize(rep.filter(functools.reduce(lambda x, y: x | y, [F.col("size").between(math.ceil(t * s - 1e-9), math.floor(s / t + 1e-9)) for s in sizes])).select("rid"), "like")
        near = docs.join(F.broadcast(like), "rid", "left_semi") if like.count() <= BROADCAST_ROWS else docs
        more, held, size = [], [], 0

        def add_block() -> None:
            block = spark.sparkContext.broadcast(list(held))
            more.append(near.select("text").mapInArrow(functools.partial(_against, n, t, block, hot), FOUND))
            held.clear()

        for r in hard.toLocalIterator():  # such sets are a few in a million; they are sent in blocks of 32 MB
            held.append((r.key, bytes(r.tokens)))
            size += len(r.tokens)
            if size > 1 << 25:
                add_block()
                size = 0
        if held:
            add_block()
        extra = materialize(functools.reduce(DataFrame.union, more).dropDuplicates(["a", "b"]), "extra")
        found = found.union(extra)
        if links:
            of = rep.select(F.col("key").alias("k"), "copies")
            for x, y in (("a", "b"), ("b", "a")):
                found = found.union(extra.join(of, F.col(y) == F.col("k")).select(F.col(x).alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("double").alias("jaccard"), F.col("copies").alias("n")))
        found = materialize(found, "found")
    return classes, rep, found


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return own.select(F.xxhash64("id", "text").alias("rid"), "id", "text")


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) of every document: the least doc_id that links lead to, and how many other documents have Jaccard >= t with it.

    All links are counted; see the module's text for the edge cases."""
    classes, rep, found = set_join(_own(docs, id_col, text_col), n, t, links=True)
    comp = components(found.filter("n IS NULL"))
    least = classes.filter("size > 0").groupBy("key").agg(F.min("id").alias("least"))
    of = rep.select("key", "copies").join(comp, "key", "left").join(least, "key").withColumn("comp", F.coalesce("comp", "key"))
    head = of.groupBy("comp").agg(F.min("least").alias("class_id"))
    linked = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    of = of.join(head, "comp").join(linked, "key", "left").select("key", "class_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    named = classes.filter("size > 0").select("key", "id").distinct().join(of, "key").select(F.col("id").alias("doc_id"), "class_id", "n_links")
    alone = classes.filter("size = 0").select("id").distinct()
    return named.union(alone.select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard) for class heads: of documents with equal sets the least doc_id is paired with each other one
    (Jaccard 1) and stands for all in the pairs of different sets. Rows with a null doc_id are in no pair."""
    classes, _, pairs = set_join(_own(docs, id_col, text_col), n, t)
    named = classes.filter("size > 0 AND id IS NOT NULL").select("key", "id").distinct()
    head = named.groupBy("key").agg(F.min("id").alias("head"))
    stars = named.join(head, "key").filter("id > head").select(F.col("head").alias("doc_a"), F.col("id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    across = pairs.join(head.select(F.col("key").alias("a"), F.col("head").alias("x")), "a").join(head.select(F.col("key").alias("b"), F.col("head").alias("y")), "b")
    return stars.union(across.select(F.least("x", "y"), F.greatest("x", "y"), F.round("jaccard", 6)))


def every_pair(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard) with doc_a < doc_b for all pairs of documents, not of class heads: the square of a class' size in rows.

    A doc_id with several texts is in a pair with the greatest Jaccard of them."""
    classes, _, pairs = set_join(_own(docs, id_col, text_col), n, t)
    named = materialize(classes.filter("size > 0 AND id IS NOT NULL").select("key", "id").distinct(), "named")
    x, y = named.select(F.col("key").alias("a"), F.col("id").alias("x")), named.select(F.col("key").alias("b"), F.col("id").alias("y"))
    same = x.join(y, F.col("a") == F.col("b")).filter("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    across = pairs.join(x, "a").join(y, "b").filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.round("jaccard", 6).alias("jaccard"))
    return same.union(across).groupBy(F.col("x").alias("doc_a"), F.col("y").alias("doc_b")).agg(F.max("jaccard").alias("jaccard"))


def components(pairs: DataFrame) -> DataFrame:
    """(key, comp): the least key of each connected component of pairs(a, b), by large-star and small-star steps."""
    edges = materialize(pairs.select("a", "b"), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct()
        after = materialize(small, "edges")
        discard(edges)
        # done when every node has one parent and no parent has one itself
        several = after.groupBy("a").count().filter("count > 1").select("a")
        if several.union(after.select("b").join(after.select(F.col("a").alias("b")), "b", "left_semi")).isEmpty():
            return after.select(F.col("a").alias("key"), F.col("b").alias("comp"))
        edges = after


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, t: float = THRESHOLD) -> DataFrame:
    """The documents without near duplicates: of each connected group of linked documents the least doc_id stays.

    A null doc_id comes last. Wordless documents all stay. Of repeated rows (equal doc_id and text) the one whose
    other columns come first as JSON stays. The columns are those of docs. Ids decide; texts are not shuffled unless
    more than BROADCAST_ROWS documents go or are repeated."""
    rid = fresh("rid", docs.columns)
    marked = docs.withColumn(rid, F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col)))
    classes, _, found = set_join(_own(docs, id_col, text_col), n, t, links=True)
    comp = components(found.filter("n IS NULL"))
    full = classes.filter("size > 0").groupBy("rid").agg(F.first("id").alias("id"), F.first("key").alias("key"), F.count("*").alias("rows"))
    full = full.join(comp, "key", "left").select("rid", "rows", F.coalesce("comp", "key").alias("grp"), F.struct(F.col("id").isNull().alias("none"), "id", "rid").alias("w"))
    full = materialize(full, "grouped")
    best = full.groupBy("grp").agg(F.min("w").alias("best")).select(F.col("best.rid").alias("rid"))
    lost = materialize(full.select("rid").join(best, "rid", "left_anti").select(F.col("rid").alias(rid)), "lost")
    kept = marked.join(_small(lost), rid, "left_anti")
    own = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.struct(*own)
    again = materialize(full.filter("rows > 1").join(best, "rid", "left_semi").select(F.col("rid").alias(rid)), "repeated")
    if again.isEmpty():
        return kept.select(*own)
    again = _small(again)
    one = kept.join(again, rid, "left_semi").groupBy(rid).agg(F.min_by(whole, F.to_json(whole)).alias("w")).select("w.*")
    return kept.join(again, rid, "left_anti").select(*own).union(one)
