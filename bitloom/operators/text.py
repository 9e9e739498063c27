"""Text as columns: cleaning, tokens, windows of tokens, lengths, budgets and names of files."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.session import materialize

BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]"
TOKEN = r"c\+\+|c#|\.net|[a-z0-9]++(?:[._+#-][a-z0-9]++)*+"
#: Windows are cut from so many tokens at once.
WINDOW_TOKENS = 1_000_000
LANGUAGES = {"C": (".c", ".h"), "C++": (".cpp", ".cc", ".C", ".hpp"), "Java": (".java",), "Python": (".py",)}


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stripped texts; blank and null ones go."""
    return docs.withColumn(text, strip(F.col(text))).filter(F.col(text) != "")


#: Letters whose case folding has ASCII letters that lower() doesn't give.
FOLDS = {chr(i): chr(i).lower().casefold() for i in range(128, 0x10000) if not 0xD800 <= i < 0xE000 and chr(i).lower() == chr(i) and any(x.isascii() and x.isalnum() for x in chr(i).casefold())}


def fold(text: Column) -> Column:
    """The text case-folded, as far as ASCII letters come of it."""
    low = F.lower(text)
    full = low
    for a, b in FOLDS.items():
        full = F.replace(full, F.lit(a), F.lit(b))
    return F.when(F.octet_length(low) > F.length(low), full).otherwise(low)


def tokens(text: Column) -> Column:
    """Search tokens of the case-folded text."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def _cut(size: int, step: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is tokens, as their windows; WINDOW_TOKENS tokens at a time, one row at least."""
    for batch in batches:
        toks = batch.column(batch.num_columns - 1)
        if not len(toks):
            continue
        n, none = pc.fill_null(pc.list_value_length(toks), 0).to_numpy().astype(np.int64), pc.is_null(toks).to_numpy(zero_copy_only=False)
        first, many = toks.offsets.to_numpy()[:-1].astype(np.int64), np.maximum(1, -(-n // step))
        weight, at = np.append(0, np.cumsum(np.maximum(n, 1))), 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(weight, weight[at] + WINDOW_TOKENS, "right")) - 1)
            row, ends = np.repeat(np.arange(at, to), many[at:to]), np.cumsum(many[at:to])
            idx = np.arange(len(row)) - (ends - many[at:to])[row - at]
            start = idx * step
            length = np.minimum(size, n[row] - start)
            offsets = np.append(0, np.cumsum(length))
            place = np.arange(offsets[-1]) + np.repeat(first[row] + start - offsets[:-1], length)
            chunk = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), toks.values.take(pa.array(place)), mask=pa.array(none[row]))
            kept = [batch.column(i).take(pa.array(row)) for i in range(batch.num_columns - 1)]
            made = [pa.array(many[row].astype(np.int32)), pa.array(idx.astype(np.int32)), chunk, pa.array(start.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*batch.schema.names[:-1], "total_chunks", "chunk_idx", "chunk", "start"])
            at = to


def windows(docs: DataFrame, toks: str, size: int, overlap: int = 0) -> DataFrame:
    """chunk_idx, total_chunks, start and chunk: windows of size tokens, step size - overlap; an empty text has one empty window."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size is required")
    # cut over Arrow, as slice() copies the whole text for each window and Catalyst makes the tokens of a Generate twice
    rest = [c for c in docs.columns if c != toks]
    kind = T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(c, T.IntegerType()) for c in ("total_chunks", "chunk_idx")), T.StructField("chunk", docs.schema[toks].dataType), T.StructField("start", T.IntegerType())])
    return docs.select(*rest, toks).mapInArrow(functools.partial(_cut, size, size - overlap), kind)


def length_stats(lengths: DataFrame, n: str = "n") -> DataFrame:
    """Count, mean, truncated percentiles, maximum and tail ratio."""
    p = lambda q: F.percentile(n, q).cast("int")
    got = lengths.agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), *[p(q / 100).alias(f"p{q}") for q in (50, 90, 95, 99)], F.max(n).alias("max"))
    return got.withColumn("tail_ratio", F.bround(F.col("p99") / F.greatest("p50", F.lit(1)), 2))


def budget_take(rows: DataFrame, group: str, size: Column, order: list[str], budget: int) -> DataFrame:
    """The rows of each group up to the one that reaches the budget, which is kept; before is the sum of those that precede.

    Sums run within ranges and over the ranges' sums, so that no task holds a group."""
    ranged, pid = by_range(rows, [group, *order])
    sums = ranged.groupBy(group, pid).agg(F.sum(size).alias("sum_"))
    lead = sums.select(F.col(group).alias("group_"), F.col(pid).alias("range_"), F.coalesce(F.sum("sum_").over(Window.partitionBy(group).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lead_"))
    within = F.coalesce(F.sum(size).over(Window.partitionBy(group, pid).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = ranged.withColumn("before", within)
    joined = own.join(F.broadcast(lead), own[group].eqNullSafe(F.col("group_")) & (own[pid] == F.col("range_")))  # a row a group and range
    return joined.select(*[own[c] for c in rows.columns], (F.col("before") + F.col("lead_")).alias("before")).filter(F.col("before") < budget)


def by_range(rows: DataFrame, order: list[str]) -> tuple[DataFrame, str]:
    """(rows in a table, the column that numbers the ranges of order in which they lie)."""
    pid = "range"
    while pid in rows.columns:
        pid += "_"
    return materialize(rows.repartitionByRange(*order).withColumn(pid, F.spark_partition_id()), "ranges"), pid


def lang_from_name(name: Column) -> Column:
    """The language of the first extension, in the order of the table, that the name ends with."""
    got = F.lit(None).cast("string")
    for lang, ends in reversed(LANGUAGES.items()):
        for e in reversed(ends):
            got = F.when(F.endswith(name, F.lit(e)), lang).otherwise(got)
    return got


def label_from_path(path: Column) -> Column:
    """<label>_<anything>.<ext> gives label.ext."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.concat(F.element_at(F.split(base, "_"), 1), F.lit("."), F.element_at(F.split(base, r"\."), -1))


def join_keys(record: DataFrame, keys: list[str]) -> Column:
    """All keys' texts in one; a missing value is an error."""
    return F.concat(*[F.when(F.col(k).isNull(), F.raise_error(F.lit(f"{k} is missing"))).otherwise(F.col(k)) for k in keys])
