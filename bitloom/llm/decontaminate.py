"""Operator 7: benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of lower-cased words. A CGK random walk reads a window of W words: at every step
it outputs the word under its pointer and moves on by a random bit of that word and step, so windows
at small edit distance give walks at small Hamming distance. A repetition samples a few steps; equal
samples make a candidate. Items are grouped by length in powers of two up to 2**LONGEST, with W half
the class' least length: document windows start at every s-th word and item windows at every word,
which makes any copy contain aligned windows, and longer items the more of them. Repetitions are added
until, for each of the class' lengths, simulated edits at the tolerated rate are found with the target
probability; where MOST_REPEATS don't reach it, building is an error. Each candidate's alignment is verified by
semi-global edit distance over words: an item leaks where some part of the document is within
floor(tolerance * words) edits of the whole item.

Items of fewer than MIN_WORDS words, of which the tolerance allows no edit, are looked for word by word.

Defined results. Null, empty and wordless texts and items leak nothing. Texts and items of any length are read whole.
Of several places with equal edits the first counts. Each row of documents is judged by itself: repeated
rows give repeated results, and so do repeated items. Without documents or items there is no row. A null item_id or doc_id is carried as null. Extra columns are ignored or,
in the filter, passed through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.arrays import U, column, constants, mix, pieces, strings, words

TOLERANCE, RECALL, SAMPLES = 0.15, 0.97, 4
MIN_WORDS, MOST_REPEATS = 5, 256
#: Items of 2**LONGEST words and more are one class: a walk over more words meets too many edits.
LONGEST = 5
#: Edited copies of each length that measure the recall of the repetitions.
COPIES = 256
#: Items are indexed in blocks of so many words, each block broadcast; more items mean more passes.
BLOCK_WORDS = 2_000_000


def steps_of(rep: int, w: int, n: int = SAMPLES) -> np.ndarray:
    """The sampled steps of a repetition, one in each of n equal stretches of the walk, so that few read the same word."""
    rng = np.random.Generator(np.random.PCG64([rep, w, 77]))
    size = max(2 * w - 1, 2 * n) / n
    return np.floor((np.arange(n) + rng.uniform(0, 0.999, n)) * size).astype(np.int64)


def cgk(h: np.ndarray, start: np.ndarray, end: np.ndarray, rep: int, steps: np.ndarray, known: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(key of the sampled steps, index of its walk, the keys after each sampled step) of the walks that stay before end.

    With known, a table for each sampled step of the leading bits of the keys there, walks that match none end early."""
    pos, on, part = start.astype(np.int32), np.arange(len(start), dtype=np.int32), []
    hs = (h >> U(32)).astype(np.uint32)
    key, times = np.zeros(len(pos), U), np.bincount(steps)
    rng = np.random.Generator(np.random.PCG64([rep, 4096]))
    flip, odd = rng.integers(0, 1 << 32, (2, len(times)), dtype=np.uint32)
    for j in range(len(times)):
        if times[j]:
            live = pos < end[on]
            key = mix(key * U(0x2545F4914F6CDD1D) + h.take(pos, mode="clip") + U(j))
            if known is not None:
                live &= known[len(part)][(key >> U(46)).astype(np.int32)]
            live = np.flatnonzero(live)
            pos, on, key = pos[live], on[live], key[live]
            part.append(key)
        pos += (((hs.take(pos, mode="clip") ^ flip[j]) * (odd[j] | np.uint32(1))) >> np.uint32(31)).astype(np.int32)
    return key, on, part


def _class_of(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(n, 1)) + 1e-9).astype(np.int64), LONGEST)


def geometry(k: int) -> tuple[int, int]:
    """(window, stride) in words of the class of items with 2**k words at least."""
    return max(2, 2**k // 2), max(1, 2**k // 4)


def _copies(n: int, stride: int, tolerance: float, rng: np.random.Generator) -> dict:
    """COPIES edited copies of texts of n different words: the walks' words, with starts and ends of all windows of both sides."""
    k, own, other = int(tolerance * n), [], []
    for _ in range(COPIES):
        a = rng.integers(1, 1 << 62, n).astype(U)
        b = a.tolist()
        for _ in range(k):
            at, kind = int(rng.integers(0, len(b))), rng.integers(0, 3)
            if kind == 0:
                b[at] = int(rng.integers(1, 1 << 62))
            elif kind == 1:
                b.insert(at, int(rng.integers(1, 1 << 62)))
            elif len(b) > 2:
                del b[at]
        own.append(a)
        other.append(np.array(b, U))
    size = np.array([len(x) for x in (*own, *other)])
    end = np.cumsum(size)
    begin, row = np.repeat(end - size, size), np.repeat(np.arange(2 * COPIES), size)
    local = np.arange(end[-1]) - begin
    off = rng.integers(0, stride, 2 * COPIES)[row]
    at = np.flatnonzero((row < COPIES) | (local % stride == off % stride))
    return {"h": np.concatenate((*own, *other)), "start": at, "end": end[row[at]], "row": row[at]}


def _simulate(c: dict, w: int, rep: int) -> np.ndarray:
    """Which of the edited copies repetition rep finds."""
    key, on, _ = cgk(c["h"], c["start"], c["end"], rep, steps_of(rep, w))
    row = c["row"][on]
    key = (key & U((1 << 56) - 1)) | ((row % COPIES).astype(U) << U(56))
    a, b = row < COPIES, row >= COPIES
    found = np.zeros(COPIES, bool)
    found[row[b][np.isin(key[b], key[a])] - COPIES] = True
    return found


def lengths_of(count: np.ndarray) -> list[int]:
    """The lengths to simulate: every one below 4 * 2**LONGEST words; of the longer, which hold ever more windows, the least."""
    every, most = np.unique(count), 4 * 2**LONGEST
    return [*every[every < most].tolist(), *every[every >= most][:1].tolist()]


def _spans(h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """A key of the m words from each place."""
    key = np.zeros(len(at), U)
    for j in range(m):
        key = mix(key * U(0x2545F4914F6CDD1D) + h[at + j])
    return key


def build(items: list[tuple], tolerance: float = TOLERANCE, recall: float = RECALL) -> list[dict]:
    """The index: for each length class its repetitions, each a sorted array of keys with item and offset."""
    c = constants()
    arr = pa.array([t for _, t in items], pa.string())
    row, h, _, _ = words(c, *strings(pc.utf8_lower(arr)))
    count = np.bincount(row, minlength=len(items))
    begin = np.cumsum(count) - count
    out = []
    kinds = _class_of(count)
    for m in sorted(set(count[(count > 0) & (count < MIN_WORDS)].tolist())):
        mine = np.flatnonzero(count == m)
        key = _spans(h, begin[mine], m)
        order = np.argsort(key, kind="stable")
        out.append({"exact": m, "key": key[order], "item": mine[order]})
    for k in sorted(set(kinds[count >= MIN_WORDS].tolist())):
        mine = np.flatnonzero((kinds == k) & (count >= MIN_WORDS))
        w, stride = geometry(k)
        lengths, reps = lengths_of(count[mine]), []
        copies = [_copies(n, stride, tolerance, np.random.Generator(np.random.PCG64([n, 9]))) for n in lengths]
        missed = np.ones((len(lengths), COPIES), bool)
        start = np.concatenate([np.arange(begin[i], begin[i] + count[i]) for i in mine])
        end = np.repeat(begin[mine] + count[mine], count[mine])
        owner = np.repeat(mine, count[mine])
        for rep in range(MOST_REPEATS):
            steps = steps_of(rep, w)
            key, on, part = cgk(h, start, end, rep, steps)
            order = np.argsort(key, kind="stable")
            on = on[order]
            reps.append({"rep": rep, "steps": steps, "key": key[order], "item": owner[on], "offset": (start - begin[owner])[on], "known": [np.bincount((x >> U(46)).astype(np.int64), minlength=1 << 18) > 0 for x in part]})
            for i in np.flatnonzero(missed.mean(1) > 1 - recall):
                missed[i] &= ~_simulate(copies[i], w, rep)
            worst = int(missed.mean(1).argmax())
            if missed[worst].mean() <= 1 - recall:
                break
        else:
            raise ValueError(f"{MOST_REPEATS} repetitions find {1 - missed[worst].mean():.2f} of the copies of {lengths[worst]} words at tolerance {tolerance}, not {recall}")
        out.append({"k": k, "w": w, "stride": stride, "reps": reps})
    return [{"classes": out, "h": h, "begin": begin, "count": count, "ids": [i for i, _ in items], "tolerance": tolerance}]


def edits(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of pattern to any part of text, where that part ends)."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, x in enumerate(pattern):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, at = full, 0, m, m, 0
    for j, x in enumerate(text):  # Myers' bit-parallel columns; the first row is 0, so a match may start anywhere
        eq = masks.get(x, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
        score += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vp, vn = hn | (full & ~(d0 | hp)), hp & d0
        if score < best:
            best, at = score, j + 1
    return best, at


def _find(c: dict, index: dict, text: pa.Array) -> list[tuple[int, int, int, int]]:
    """(row, item, edits, word at which the copy ends) of every leak in the texts."""
    row, h, _, _ = words(c, *strings(pc.utf8_lower(text)))
    n = np.bincount(row, minlength=len(text))
    begin = np.cumsum(n) - n
    end = begin + n
    pairs, out = [], {}
    for cl in index["classes"]:
        if "exact" in cl:
            m = cl["exact"]
            at = np.flatnonzero(np.arange(len(h)) + m <= end[row])
            key = _spans(h, at, m)
            lo = np.searchsorted(cl["key"], key, "left")
            k = np.searchsorted(cl["key"], key, "right") - lo
            for i in np.flatnonzero(k):
                r = int(row[at[i]])
                for item in cl["item"][lo[i] : lo[i] + k[i]].tolist():
                    out.setdefault((r, item), (0, int(at[i] - begin[r] + m)))
            continue
        local = np.arange(len(h)) - begin[row]
        start = np.flatnonzero(local % cl["stride"] == 0)
        own, stop = row[start], end[row[start]]
        for r in cl["reps"]:
            key, some, _ = cgk(h, start, stop, r["rep"], r["steps"], r["known"])
            if not len(some):
                continue
            lo = np.searchsorted(r["key"], key, "left")
            k = np.searchsorted(r["key"], key, "right") - lo
            of = np.repeat(np.arange(len(some)), k)
            at = lo[of] + np.arange(len(of)) - (np.cumsum(k) - k)[of]
            item = r["item"][at]
            # the copy begins about offset words before the window
            pairs.append(np.stack([own[some[of]], item, local[start[some[of]]] - r["offset"][at]], 1))
    if not pairs:
        return [(i, item, d, e) for (i, item), (d, e) in out.items()]
    got = np.unique(np.concatenate(pairs), axis=0)
    of, item, at = got[:, 0], got[:, 1], got[:, 2]
    m = index["count"][item]
    most = (index["tolerance"] * m).astype(np.int64)
    lo, hi = np.maximum(0, at - 2 * most - 1), np.minimum(n[of], at + m + 2 * most + 1)
    # a copy within the tolerance shares at least m - most of the item's words, counted with their repeats
    likely = np.zeros(len(of), bool)
    span = np.maximum(hi - lo, 0)
    for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(np.cumsum(span) >> 20)) + 1):
        size = span[part]
        cand = np.repeat(np.arange(len(part)), size)
        word = h[begin[of[part]][cand] + lo[part][cand] + np.arange(len(cand)) - (np.cumsum(size) - size)[cand]]
        own = mix(word + item[part][cand].astype(U) * U(0x9E3779B97F4A7C15))
        where = np.minimum(np.searchsorted(index["bag"], own), len(index["bag"]) - 1)
        likely[part] = np.bincount(cand, weights=index["bag"][where] == own, minlength=len(part)) >= m[part] - most[part]
    seen = {}
    for i, item, lo, hi in zip(*(x[likely].tolist() for x in (of, item, lo, hi)), strict=True):
        done = seen.setdefault((i, item), [])
        if done and lo <= done[-1][1]:  # they come by lo; the windows of a long copy overlap, and one pass serves them all
            done[-1][1] = max(done[-1][1], hi)
        else:
            done.append([lo, hi])
    for (i, item), done in seen.items():
        for lo, hi in done:
            d, e = edits(index["words"][item], h[begin[i] + lo : begin[i] + hi].tolist())
            if d <= int(index["tolerance"] * int(index["count"][item])) and ((i, item) not in out or (d, lo + e) < out[i, item]):
                out[i, item] = (d, lo + e)
    return [(i, item, d, e) for (i, item), (d, e) in out.items()]


def _ready(index: dict) -> dict:
    if "words" not in index:
        index["bag"] = np.unique(mix(index["h"] + np.repeat(np.arange(len(index["count"])), index["count"]).astype(U) * U(0x9E3779B97F4A7C15)))
        index["words"] = [index["h"][b : b + m].tolist() for b, m in zip(index["begin"].tolist(), index["count"].tolist(), strict=True)]
    return index


def _leaks(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c, index = constants(), _ready(held.value)
    for batch in batches:
        for p in pieces(batch, "text"):
            got = _find(c, index, column(p, "text"))
            ids = column(p, "doc_id")
            i = pa.array([x[0] for x in got], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(i), pa.array([index["ids"][x[1]] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int32()), pa.array([int(index["count"][x[1]]) for x in got], pa.int32()), pa.array([x[3] for x in got], pa.int32())], ["doc_id", "item_id", "edits", "item_words", "end_word"])


def _clean(held, text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c, index = constants(), _ready(held.value)
    for batch in batches:
        for p in pieces(batch, text):
            bad = np.zeros(p.num_rows, bool)
            bad[[x[0] for x in _find(c, index, column(p, text))]] = True
            yield p.filter(pa.array(~bad)) if bad.any() else p


def blocks(docs: DataFrame, items: DataFrame, tolerance: float, recall: float) -> Iterator:
    """Broadcast indexes over blocks of items of at most BLOCK_WORDS words each."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("bigint"), "text").filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        held.append((r[0], r[1]))
        size += r[1].count(" ") + 1
        if size > BLOCK_WORDS:
            yield docs.sparkSession.sparkContext.broadcast(build(held, tolerance, recall)[0])
            held, size = [], 0
    if held:
        yield docs.sparkSession.sparkContext.broadcast(build(held, tolerance, recall)[0])


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, edits, item_words, end_word) for each document and each item that it holds."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, item_id bigint, edits int, item_words int, end_word int"
    found = [slim.mapInArrow(functools.partial(_leaks, b), schema) for b in blocks(docs, items, tolerance, recall)]
    return functools.reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", tolerance: float = TOLERANCE, recall: float = RECALL) -> DataFrame:
    """The documents in which no item leaks."""
    for b in blocks(docs, items, tolerance, recall):
        docs = docs.mapInArrow(functools.partial(_clean, b, text_col), docs.schema)
    return docs
