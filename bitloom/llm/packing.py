"""Operator 3: sequence packing by minimum bin slack.

A document's length is its tokens and one end token. Lengths are cut at the window's capacity: full
parts fill a window alone, and the remainders share windows. The plan needs only how many parts have
each length, so it is made from a table of at most ``capacity`` rows whatever the input: the longest
length left opens a window, a bitset subset-sum over the remaining multiset (binary-split counts)
finds the fill closest to capacity, the counts used are backtracked from the bitsets, and the window
is repeated for as long as all its lengths last. Documents then take their places by their rank among
the parts of their length; ranks come from two-level counts, so no sort holds all of one length.

Defined results. Null and empty texts take no room and are in no window; a text of any length is cut into whole parts.
Parts of equal length are told apart by doc_id and part; which of equal rows comes first makes no difference. Repeated rows are packed as
often as they occur; a null doc_id is carried. Extra columns are ignored. An empty table gives no window.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.arrays import column
from bitloom.llm.tokens import VOCABULARY, token_counts
from bitloom.session import materialize

CAPACITY = 2048
END_TOKENS = 1
#: Parts of one length are ranked in so many buckets at least, each sorted by itself; more documents have more buckets.
BUCKETS, PER_BUCKET = 256, 1 << 20
SCHEMA = "window_id bigint, position int, doc_id bigint, part int, start bigint, n_tokens int"


def fill(left: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, times) whose sum is closest to room from below; order holds the lengths, longest first."""
    reach, full, steps = 1, 1 << room, []
    mask = (full << 1) - 1
    for n in order:
        c = min(left[n], room // n)
        k = 1
        while c > 0:
            k = min(k, c)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            if reach & full:
                break
            c -= k
            k *= 2
        if reach & full:
            break
    s, used = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not (before >> s) & 1:
            used[n] = used.get(n, 0) + k
            s -= n * k
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[(lengths with their times, windows alike)] that use up all counts."""
    left = {n: c for n, c in counts.items() if c > 0}
    order, out = sorted(left, reverse=True), []
    while order:
        top = order[0]
        left[top] -= 1
        got = dict(fill(left, order, capacity - top))
        left[top] += 1
        got[top] = got.get(top, 0) + 1
        reps = min(left[n] // k for n, k in got.items())
        for n, k in got.items():
            left[n] -= k * reps
        if any(left[n] == 0 for n in got):
            order = [n for n in order if left[n]]
        out.append((sorted(got.items(), reverse=True), reps))
    return out


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """For each length the ranges of ranks: key (length, first rank), first window, times a window, position of the first."""
    rows, taken, window = [], {}, 0
    for pattern, reps in patterns:
        at = 0
        for n, k in pattern:
            rows.append((n << 40 | taken.get(n, 0), window, k, at))
            taken[n] = taken.get(n, 0) + k * reps
            at += n * k
        window += reps
    t = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": t[:, 0], "window": t[:, 1], "times": t[:, 2], "at": t[:, 3]}


def _assign(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = held.value
    for batch in batches:
        n, rank = column(batch, "n_tokens").to_numpy().astype(np.int64), column(batch, "rank").to_numpy()
        i = np.searchsorted(t["key"], n << 40 | rank, "right") - 1
        j = rank - (t["key"][i] & ((1 << 40) - 1))
        window, at = t["window"][i] + j // t["times"][i], t["at"][i] + j % t["times"][i] * n
        yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(at.astype(np.int32)), column(batch, "doc_id"), column(batch, "part"), column(batch, "start"), column(batch, "n_tokens")], ["window_id", "position", "doc_id", "part", "start", "n_tokens"])


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY, end_tokens: int = END_TOKENS) -> DataFrame:
    """(window_id, position, doc_id, part, start, n_tokens) of lengths(doc_id, n_tokens), a table read three times.

    Where a window's parts are laid one after another, each begins at its position; start is where the
    part begins in its document."""
    spark, cap = lengths.sparkSession, F.lit(capacity).cast("bigint")
    buckets = max(BUCKETS, lengths.count() // PER_BUCKET)
    whole = lengths.filter("n_tokens > 0").select("doc_id", (F.col("n_tokens") + end_tokens).alias("whole"))
    parts = whole.select("doc_id", "whole", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(whole - 1) div {capacity}"))).alias("p"))
    parts = parts.select("doc_id", F.col("p").cast("int").alias("part"), (F.col("p") * cap).alias("start"), F.least(cap, F.col("whole") - F.col("p") * cap).cast("int").alias("n_tokens"))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), F.lit(buckets)).cast("int"))
    sizes = materialize(parts.groupBy("n_tokens", "bucket").agg(F.count("*").alias("c")), "lengths")  # at most capacity * buckets rows
    counts = {r[0]: r[1] for r in sizes.groupBy("n_tokens").agg(F.sum("c")).collect()}
    if not counts:
        return spark.createDataFrame([], SCHEMA)
    before = sizes.select("n_tokens", "bucket", (F.sum("c").over(Window.partitionBy("n_tokens").orderBy("bucket")) - F.col("c")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "part")) - 1
    ranked = parts.withColumn("r", rank).join(before, ["n_tokens", "bucket"]).select("doc_id", "part", "start", "n_tokens", (F.col("r") + F.col("before")).alias("rank"))
    held = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    return ranked.mapInArrow(functools.partial(_assign, held), SCHEMA)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """pack_lengths() of the documents' token counts."""
    counts = token_counts(docs, id_col, text_col, vocabulary).select("doc_id", "n_tokens")
    return pack_lengths(materialize(counts, "counts"), capacity)
