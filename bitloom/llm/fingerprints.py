"""Operator 6: bottom-k sketches of shingle hashes as document fingerprints.

A sketch holds the k least hashes of a document's distinct word shingles, ascending. Sketches of parts
merge exactly: the k least of all parts' values are the sketch of the whole. From two sketches follow
estimates of the distinct shingle count, the resemblance (Jaccard) and the containment of one in the other.

Defined results. Null, empty and wordless texts have an empty sketch and count 0; their resemblance and
containment are null. A text of fewer than SHINGLE words is one shingle. Counts are exact below k. Each row
is sketched by itself, repeated rows alike and texts of any length whole; equal hashes are one, so there are no ties.
A null doc_id is carried, and null groups are a group. An empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.arrays import column, constants, fresh, pieces, sets
from bitloom.session import materialize

K, SHINGLE = 64, 5
#: Hashes are uniform below this.
SPACE = 1 << 52


def _sketch(k: int, n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = constants()
    for batch in batches:
        for p in pieces(batch, "text"):
            row, tok = sets(c, column(p, "text"), n)
            size = np.bincount(row, minlength=p.num_rows)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            off = np.append(0, np.cumsum(np.minimum(size, k))).astype(np.int32)
            sketch = pa.ListArray.from_arrays(pa.array(off), pa.array(tok[rank < k].view(np.int64)))
            names = [x for x in p.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(column(p, x) for x in names), sketch], [*names, "sketch"])


def sketches(docs: DataFrame, k: int = K, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sketch) of every row, without a shuffle."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(functools.partial(_sketch, k, n), "doc_id bigint, sketch array<bigint>")


def union(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge(parts: DataFrame, keys: list[str], k: int = K, sketch: str = "sketch") -> DataFrame:
    """One sketch a group of parts: the k least of its distinct hashes, of which every task keeps k a group before they are shuffled to it."""
    h, r = fresh("hash", keys), fresh("rank", keys)
    each = parts.select(*keys, F.explode_outer(sketch).alias(h)).distinct()
    least = each.withColumn(r, F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(h)))).filter(F.col(r) <= k)
    return least.groupBy(*keys).agg(F.array_sort(F.collect_list(h)).alias(sketch))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Exact below k, else (k - 1) over the k-th hash's share of the space."""
    size = F.size(sketch)
    return F.when(size < k, size.cast("double")).otherwise((F.lit(k) - 1) * float(SPACE) / (F.element_at(sketch, -1) + 1))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The share of the union's sketch that both hold."""
    u = union(a, b, k)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's hashes that b holds, among those below both sketches' ends; null where a has none there."""
    end = F.least(F.when(F.size(a) < k, F.lit(SPACE)).otherwise(F.element_at(a, -1)), F.when(F.size(b) < k, F.lit(SPACE)).otherwise(F.element_at(b, -1)))
    own = F.filter(a, lambda x: x <= end)
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (F.size(own) > 0), F.size(F.array_intersect(own, b)) / F.size(own))


#: Groups of at most so many (half a kB each) are broadcast.
BROADCAST_GROUPS = 10_000


def fingerprints(docs: DataFrame, k: int = K, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", group_col: str = "source") -> DataFrame:
    """(doc_id, n_shingles, sketch, resemblance, containment) of every row: the estimated distinct shingle count, the sketch, and
    the estimated Jaccard with, and share within, all shingles of the row's group."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), (F.col(group_col).cast("string") if group_col in docs.columns else F.lit(None).cast("string")).alias("grp"))
    got = materialize(slim.mapInArrow(functools.partial(_sketch, k, n), "doc_id bigint, grp string, sketch array<bigint>"), "sketches")
    whole = materialize(merge(got, ["grp"], k), "groups").select(F.col("grp").alias("g"), F.col("sketch").alias("whole"))
    whole = F.broadcast(whole) if whole.count() <= BROADCAST_GROUPS else whole
    joined = got.join(whole, F.col("grp").eqNullSafe(F.col("g")))
    a, b = F.col("sketch"), F.col("whole")
    return joined.select("doc_id", F.round(distinct_count(a, k), 3).alias("n_shingles"), "sketch", F.round(resemblance(a, b, k), 6).alias("resemblance"), F.round(containment(a, b, k), 6).alias("containment"))
