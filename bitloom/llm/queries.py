"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from bitloom.llm.decontaminate import find_leaks
from bitloom.llm.fingerprints import fingerprints
from bitloom.llm.jaccard import link_classes
from bitloom.llm.langid import identify
from bitloom.llm.packing import pack_documents
from bitloom.llm.pii import redact_pii
from bitloom.llm.planes import write_blocks
from bitloom.llm.quality import classify
from bitloom.llm.tokens import token_counts
from bitloom.llm.warc import write_warc
from bitloom.session import table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(table(spark, sf_dir, "documents"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_pii(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_blocks(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_warc(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_\x{80}-\x{10FFFF}]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s
  FROM words WHERE len(w) > 0),
heads AS (SELECT s, min(doc_id) AS least, len(s) AS n, count(*) AS copies, row_number() OVER (ORDER BY min(doc_id), s) AS k FROM sets GROUP BY s),
grams AS (SELECT k, n, unnest(s) AS g FROM heads),
common AS (
  SELECT a.k AS x, b.k AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS hit
  FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k AND a.n >= 0.7 * b.n - 1e-9 AND b.n >= 0.7 * a.n - 1e-9
  GROUP BY 1, 2),
links AS (SELECT x, y FROM common WHERE hit / (nx + ny - hit) >= 0.7 - 1e-12),
reach AS (SELECT k AS x, k AS y FROM heads UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
class AS (SELECT x, min(least) AS class_id FROM reach JOIN heads ON k = y GROUP BY 1),
linked AS (SELECT x, sum(copies) AS n FROM links JOIN heads ON k = y GROUP BY 1)
SELECT doc_id, class_id, CAST(copies - 1 + coalesce(linked.n, 0) AS BIGINT) AS n_links
FROM sets JOIN heads USING (s) JOIN class ON class.x = k LEFT JOIN linked ON linked.x = k
UNION ALL
SELECT DISTINCT doc_id, doc_id, 0 FROM words WHERE coalesce(len(w), 0) = 0
"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_jaccard_join, op2_pii_pseudonyms, op3_packing, op4_token_counts, op5_quality, op6_fingerprints, op7_decontamination, op8_language_id, op9_token_blocks, op10_warc, pipeline)
}
_ORACLE: dict[str, str] = {"op1_jaccard_join": OP1_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
