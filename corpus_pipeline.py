"""The corpus pipeline: documents in, packed training windows out.

STAGES are applied in order, each to all that its predecessor kept, with a Parquet table in the shared
folder between them. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm.decontaminate import drop_leaks
from bitloom.llm.jaccard import keep_one
from bitloom.llm.packing import pack_documents
from bitloom.llm.pii import pseudonyms
from bitloom.llm.quality import filter_quality
from bitloom.session import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, poor or toxic, go.

    Null, empty and very long texts are judged like others, repeated rows alike; posteriors of one half reject. Without labels, or
    without documents, nothing goes. Every column passes through, whatever its name; so in all stages but the last."""
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, the one of least doc_id; null ids come last.

    Null and wordless texts all stay; of repeated rows one stays; very long texts are compared whole; an empty table stays empty."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and wordless texts stay; repeated rows go or stay together; very long texts are searched whole; without items nothing goes."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the texts.

    Every row stays, null and empty texts as they are; repeated rows stay equal; very long texts are read whole."""
    return pseudonyms(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows and what lies in them.

    Null and empty texts are in no window; repeated rows are packed as often as they occur; texts longer than a window are
    cut into parts; a null doc_id is carried; an empty table gives no window; which of equal lengths goes first is settled by doc_id."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pseudonymize", pseudonymize),
    ("pack", pack),
]

#: Word hashes, models and networks of keyed rounds are beyond SQL; a test holds run() against brute force, stage by stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
