"""Measures: code lengths under byte counts, roll-ups, tri-state checks, losses and rank quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of text at once, one text at least.
PIECE = 1 << 20


def _pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first text, place in the piece, prev * 256 + cur) of every byte of some texts at a time; 0 stands before the first byte."""
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    ends, at = np.append(0, np.cumsum(n)), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
        d = np.frombuffer(b"".join(x.as_buffer() for x in texts[at:to] if x.is_valid), np.uint8).astype(np.int64)
        prev = np.append(0, d[:-1])[: len(d)]
        prev[(ends[at:to] - ends[at])[n[at:to] > 0]] = 0
        yield at, np.repeat(np.arange(to - at), n[at:to]), prev * 256 + d
        at = to


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, row, key in _pieces(batch.column("text")):
            both, n = np.unique(row * 65536 + key, return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(both // 65536 + at)), pa.array((both // 256 % 256).astype(np.int32)), pa.array((both % 256).astype(np.int32)), pa.array(n.astype(np.int64))], ["id", "prev", "cur", "n"])


def byte_bigrams(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id, prev, cur, n): how often each byte follows each in a text; 0 stands before the first."""
    return docs.select(F.col(key).cast("bigint").alias("id"), "text").mapInArrow(_bigrams, "id bigint, prev int, cur int, n bigint")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(65536, np.int64)
    for batch in batches:
        for _, _, key in _pieces(batch.column("text")):
            n += np.bincount(key, minlength=65536)
    key = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array((key // 256).astype(np.int32)), pa.array((key % 256).astype(np.int32)), pa.array(n[key])], ["prev", "cur", "n"])


def total_bigrams(docs: DataFrame) -> DataFrame:
    """(prev, cur, n): byte_bigrams over all texts of a task; sums over tasks are left to base_counts."""
    return docs.select("text").mapInArrow(_totals, "prev int, cur int, n bigint")


def base_counts(bigrams: DataFrame) -> DataFrame:
    """(prev, cur, c, tot): at most 65,536 rows."""
    c = bigrams.groupBy("prev", "cur").agg(F.sum("n").alias("c"))
    return c.withColumn("tot", F.sum("c").over(Window.partitionBy("prev")))


def cost_bits(c: Column, tot: Column) -> Column:
    """Bits of a symbol under counts with one added to each of the 256."""
    return -F.log2((F.coalesce(c, F.lit(0)) + 1) / (F.coalesce(tot, F.lit(0)) + 256.0))


def code_length(bigrams: DataFrame, base: DataFrame) -> DataFrame:
    """(id, n_bytes, bits) of each text under the base counts."""
    rows = base.groupBy("prev").agg(F.first("tot").alias("all"))
    j = bigrams.join(F.broadcast(base.select("prev", "cur", "c")), ["prev", "cur"], "left").join(F.broadcast(rows), "prev", "left")
    return j.groupBy("id").agg(F.sum("n").alias("n_bytes"), F.sum(F.col("n") * cost_bits(F.col("c"), F.col("all"))).alias("bits"))


def rates(orig: Column, comp: Column) -> list[Column]:
    return [F.round(comp * 8 / F.greatest(orig, F.lit(1)), 6).alias("bpb"), F.round(orig / F.greatest(comp, F.lit(1)), 6).alias("ratio")]


def tri_state(ok: Column) -> Column:
    """1 if all are 1 or there are none, -1 if all are -1, else 0."""
    low, high = F.min(ok), F.max(ok)
    return F.when(F.coalesce(low, F.lit(1)) == 1, 1).when(high == -1, -1).otherwise(0)


def rollup(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks to documents: bytes and seconds summed (negative seconds don't count; -1 if none is left), the check as a tri-state."""
    t = F.sum(F.when(F.col("seconds") >= 0, F.col("seconds")))
    got = chunks.groupBy(key).agg(F.sum("original_bytes").alias("original_bytes"), F.sum("compressed_bytes").alias("compressed_bytes"), F.round(F.coalesce(t, F.lit(-1.0)), 6).alias("seconds"), tri_state(F.col("roundtrip_ok")).alias("roundtrip_ok"), F.sum(F.when(F.col("total_chunks") > 1, 1).otherwise(0)).alias("split_chunks"))
    return got.select("*", *rates(F.col("original_bytes"), F.col("compressed_bytes")))


def method_table(results: DataFrame) -> DataFrame:
    """method, n, bytes, ratios of sums, and the change against none in percent."""
    t = results.groupBy("method").agg(F.count("*").alias("n"), F.sum("original_bytes").alias("original_bytes"), F.sum("compressed_bytes").alias("compressed_bytes"))
    none = t.filter("method = 'none'").select(F.col("compressed_bytes").alias("none_"))
    t = t.crossJoin(F.broadcast(none)).withColumn("vs_none_pct", F.round(100 * (F.col("compressed_bytes") / F.col("none_") - 1), 6)).drop("none_")
    return t.select("*", *rates(F.col("original_bytes"), F.col("compressed_bytes")))


def softmin(ce: DataFrame, tau: float = 0.4) -> DataFrame:
    """Per query the sum of w L with w = softmax(-L / tau), of ce(qid, l)."""
    w = F.exp((F.min("l").over(Window.partitionBy("qid")) - F.col("l")) / tau)
    return ce.withColumn("w", w).groupBy("qid").agg(F.round(F.sum(F.col("w") * F.col("l")) / F.sum("w"), 6).alias("loss"))


def z_scores(ce: DataFrame) -> DataFrame:
    """delta = l0 - l and z, standardised within the query by the sample deviation; queries of one candidate go."""
    q = Window.partitionBy("qid")
    d = ce.withColumn("delta", F.col("l0") - F.col("l")).withColumn("k", F.count("*").over(q)).filter("k > 1")
    return d.select("qid", "cid", F.round("delta", 6).alias("delta"), F.round((F.col("delta") - F.avg("delta").over(q)) / F.greatest(F.stddev_samp("delta").over(q), F.lit(1e-6)), 5).alias("z"))


def rank_metrics(pred: DataFrame) -> DataFrame:
    """top1_acc, regret and ordinal-rank Spearman, as means over queries, of pred(qid, cid, score, gain)."""
    by = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "cid"))
    r = pred.withColumn("rs", by("score")).withColumn("rg", by("gain")).withColumn("k", F.count("*").over(Window.partitionBy("qid")))
    d2 = F.sum((F.col("rs") - F.col("rg")) ** 2)
    k = F.max("k")
    rho = F.when(k < 2, 0.0).otherwise(1 - 6 * d2 / F.greatest(k * (k * k - 1), F.lit(1)))  # ranks without ties
    q = r.groupBy("qid").agg(F.max(F.when((F.col("rs") == 1) & (F.col("rg") == 1), 1).otherwise(0)).alias("hit"), (F.max("gain") - F.max(F.when(F.col("rs") == 1, F.col("gain")))).alias("regret"), rho.alias("rho"))
    return q.agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 6).alias("top1_acc"), F.round(F.avg("regret"), 5).alias("regret"), F.round(F.avg("rho"), 6).alias("spearman"))


def mean_pool(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, value): the mean of each dimension."""
    return vectors.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


def mask_shift(masks: DataFrame, key: str, pos: str, mask: str) -> DataFrame:
    """The active positions but the last, by a sum of the mask from the end."""
    tail = F.sum(mask).over(Window.partitionBy(key).orderBy(F.desc(pos)))
    return masks.withColumn("tail", tail).filter((F.col(mask) == 1) & (F.col("tail") > 1)).drop("tail")


def logged_gains(ce: DataFrame) -> DataFrame:
    """(best_ce, base_ce, gain): means over queries of the least l, of l0 and of the greatest l0 - l."""
    q = ce.groupBy("qid").agg(F.min("l").alias("best"), F.max("l0").alias("l0"), F.max(F.col("l0") - F.col("l")).alias("gain"))
    return q.agg(F.round(F.avg("best"), 5).alias("best_ce"), F.round(F.avg("l0"), 5).alias("base_ce"), F.round(F.avg("gain"), 5).alias("gain"))


def top_gains(ce: DataFrame, n: int) -> DataFrame:
    """The n pairs of greatest gain."""
    return ce.select("qid", "cid", F.round(F.col("l0") - F.col("l"), 4).alias("gain")).orderBy(F.desc("gain"), "qid", "cid").limit(n)


def ce_map(ce: DataFrame) -> DataFrame:
    """(qid, l0, chunks): a map from candidate to l."""
    return ce.groupBy("qid").agg(F.max("l0").alias("l0"), F.map_from_entries(F.collect_list(F.struct("cid", "l"))).alias("chunks"))


def epoch_means(losses: DataFrame, epoch: str, value: str) -> DataFrame:
    """(epoch, mean, best): the mean of each epoch and the least so far."""
    means = losses.groupBy(epoch).agg(F.avg(value).alias("mean"))
    return means.select(epoch, F.round("mean", 6).alias("mean"), F.round(F.min("mean").over(Window.orderBy(epoch)), 6).alias("best"))  # a row an epoch


def moving_mean(rows: DataFrame, group: str, order: list[str], value: str, n: int) -> DataFrame:
    """mean: of the last n values of the group."""
    return rows.withColumn("mean", F.avg(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(1 - n, 0)))
