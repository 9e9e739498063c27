"""Records around a model: ids, padding, cropping, contexts, joins that must not lose a row, labels and totals."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_id(kind: str, number: Column, part: Column | None = None) -> Column:
    """doc000012, or image000012_p0003."""
    whole = F.format_string(f"{kind}%06d", number)
    return whole if part is None else F.concat(whole, F.format_string("_p%04d", part))


def is_eligible(n_tokens: Column, n_hits: Column | None = None, least_hits: int = 1) -> Column:
    """Two tokens at least and, where contexts are needed, as many hits."""
    ok = n_tokens >= 2
    return ok if n_hits is None else ok & (n_hits >= least_hits)


def pad_ids(rows: DataFrame, ids: str, batch: str, pad: int) -> DataFrame:
    """ids padded to the longest of its batch, and mask: 1 for an id, 0 for padding."""
    gap = F.max(F.size(ids)).over(Window.partitionBy(batch)) - F.size(ids)
    of = rows.withColumn("gap_", gap).withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("gap_"))))
    return of.withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), F.col("gap_")))).drop("gap_")


def crop_start(n: Column, most: int, key: Column, seed: int = 42) -> Column:
    """Where a window of most begins in n: at the head, the tail or anywhere, by a digest of the key; 0 if all fits."""
    k = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 7), 16, 10).cast("bigint")
    return F.when((k % 3 == 0) | (n <= most), 0).when(k % 3 == 1, n - most).otherwise(F.floor(k / 3) % (n - most + 1))


def join_contexts(rows: DataFrame, group: str, order: list[str], tokens: str, most: int) -> DataFrame:
    """(group, tokens): the tokens of a group's rows in order, the first most of them."""
    got = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, tokens))).alias("x"))
    return got.select(group, F.slice(F.flatten(F.transform("x", lambda x: x[tokens])), 1, most).alias(tokens))


def prefix_length(context: Column) -> Column:
    """Symbols that stand before the coded ones: those of the context, or one that opens a text."""
    return F.when(context.isNull(), 1).otherwise(F.size(context))


def with_cache(queries: DataFrame, hits: DataFrame, key: str = "query_id") -> DataFrame:
    """queries with base_ids, the hits' ids by rank; [] where there is none."""
    lists = hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "base_id"))), lambda x: x["base_id"]).alias("base_ids"))
    return queries.join(lists, key, "left").withColumn("base_ids", F.coalesce("base_ids", F.array().cast("array<bigint>")))


def check_cache(hits: DataFrame, split: DataFrame, n_base: int, key: str = "query_id") -> None:
    """An error where hits have a query that isn't in the split, or a base id of n_base or more."""
    lost = hits.select(key).distinct().join(split.select(key), key, "left_anti").count()
    most = hits.agg(F.max("base_id")).first()[0]
    if lost or (most is not None and most >= n_base):
        raise ValueError(f"a stale cache: {lost} queries aren't in the split, the greatest base id is {most} of {n_base}")


def pair_files(files: DataFrame, source: str, target: str, both_ways: bool = False) -> DataFrame:
    """(stem, input, target) of paths that differ in the extension only."""
    f = files.select("path", F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), F.regexp_extract("path", r"\.([^./]*)$", 1).alias("ext"))
    one = lambda a, b: f.filter(F.col("ext") == a).select("stem", F.col("path").alias("input")).join(f.filter(F.col("ext") == b).select("stem", F.col("path").alias("target")), "stem")
    return one(source, target).union(one(target, source)) if both_ways else one(source, target)


def join_artefacts(sources: DataFrame, artefacts: DataFrame, key: str) -> DataFrame:
    """Each source with its artefact; one without is an error."""
    found = artefacts.withColumn("found_", F.lit(True))
    lost = F.when(F.col("found_").isNull(), F.raise_error(F.concat(F.lit("no artefact of "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return sources.join(found, key, "left").filter(lost).drop("found_")


def codec_totals(rows: DataFrame, codecs: dict[str, str]) -> DataFrame:
    """(codec, files, original_bytes, compressed_bytes, ratio); the ratio is 0 where nothing was compressed."""
    each = [rows.agg(F.lit(k).alias("codec"), F.count("*").alias("files"), F.coalesce(F.sum("original_bytes"), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum(c), F.lit(0)).alias("compressed_bytes")) for k, c in codecs.items()]
    ratio = F.when(F.col("compressed_bytes") > 0, F.round(F.col("original_bytes") / F.col("compressed_bytes"), 6)).otherwise(0.0)
    return functools.reduce(DataFrame.unionByName, each).withColumn("ratio", ratio)


def label_ids(rows: DataFrame, train: DataFrame, label: str, order: str) -> DataFrame:
    """id: the place of the row's label by first appearance in train; -1 for a label that isn't there."""
    first = train.groupBy(label).agg(F.min(order).alias("first_"))
    ids = first.select(label, (F.row_number().over(Window.orderBy("first_", label)) - 1).cast("bigint").alias("id"))  # a row a label
    return rows.join(ids, label, "left").withColumn("id", F.coalesce("id", F.lit(-1).cast("bigint")))


def accuracy(rows: DataFrame, predicted: str, label: str, probability: str) -> DataFrame:
    """(n, accuracy, loss): the share of hits and the mean of -ln of the label's probability."""
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col(predicted) == F.col(label)).cast("double")), 6).alias("accuracy"), F.round(F.avg(-F.log(probability)), 6).alias("loss"))
