"""Deterministic splits: an order by digest of seed and id stands for a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.operators.text import by_range


def shuffle_key(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _ranked(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Zero-based place of every row in digest order, by range partitions: no sort holds all rows in one task."""
    code, lead, own, before = _fresh(rows, "code", "lead", "own", "before")
    coded = rows.withColumn(code, shuffle_key(seed, F.col(key))).withColumn(lead, F.substring(code, 1, 3))
    sizes = coded.groupBy(lead).agg(F.count("*").alias(own))  # at most 4096 rows
    sums = sizes.select(lead, (F.sum(own).over(Window.orderBy(lead)) - F.col(own)).alias(before))
    place = F.row_number().over(Window.partitionBy(lead).orderBy(code, key)) - 1
    return coded.withColumn(own, place).join(F.broadcast(sums), lead).withColumn("place", F.col(own) + F.col(before)).drop(code, lead, own, before)


def _fresh(rows: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column has them."""
    taken, out = {c.lower() for c in rows.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def three_way(rows: DataFrame, key: str, base: float = 0.5, train: float = 0.9, seed: int = 42) -> DataFrame:
    """split = base, train or test; base takes the half-even rounded share, train the truncated share of the rest."""
    total = rows.agg(F.count("*").alias("n")).select("n", F.bround(F.col("n") * base).cast("bigint").alias("nb"))
    total = total.select("nb", (F.col("nb") + F.floor((F.col("n") - F.col("nb")) * train)).alias("nt"))
    name = F.when(F.col("place") < F.col("nb"), "base").when(F.col("place") < F.col("nt"), "train").otherwise("test")
    return _ranked(rows, key, seed).crossJoin(F.broadcast(total)).withColumn("split", name).drop("nb", "nt")


def hold_out(rows: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """is_val for the first int(n * share) rows in digest order."""
    total = rows.agg(F.floor(F.count("*") * share).alias("nv"))
    return _ranked(rows, key, seed).crossJoin(F.broadcast(total)).withColumn("is_val", F.col("place") < F.col("nv")).drop("nv")


def dense_ids(rows: DataFrame, split: str, order: list[str]) -> DataFrame:
    """id: zero-based within its split, by ranges: no task sorts a split."""
    ranged, pid = by_range(rows, [split, *order])
    sizes = ranged.groupBy(split, pid).agg(F.count("*").alias("n_"))
    lead = sizes.select(F.col(split).alias("split_"), F.col(pid).alias("range_"), (F.sum("n_").over(Window.partitionBy(split).orderBy(pid)) - F.col("n_")).alias("lead_"))
    own = ranged.withColumn("id", F.row_number().over(Window.partitionBy(split, pid).orderBy(*order)) - 1)
    joined = own.join(F.broadcast(lead), own[split].eqNullSafe(F.col("split_")) & (own[pid] == F.col("range_")))  # a row a split and range
    return joined.select(*[own[c] for c in rows.columns], (own["id"] + F.col("lead_")).alias("id"))


def carve_out(rows: DataFrame, key: str, share: float, batch: int, seed: int = 42) -> DataFrame:
    """is_eval for the first int(n * share) rows in digest order; of either side the rows beyond a multiple of batch go."""
    total = rows.agg(F.count("*").alias("n_"), F.floor(F.count("*") * share).alias("nv_"))
    r = _ranked(rows, key, seed).crossJoin(F.broadcast(total))
    ev = F.col("place") < F.col("nv_")
    whole = F.when(ev, F.col("place") < F.col("nv_") - F.col("nv_") % batch).otherwise(F.col("place") - F.col("nv_") < F.col("n_") - F.col("nv_") - (F.col("n_") - F.col("nv_")) % batch)
    return r.withColumn("is_eval", ev).filter(whole).drop("n_", "nv_")


def shard(rows: DataFrame, place: str, n: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.col(place), F.lit(n)))
