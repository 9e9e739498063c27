"""The queries over the driver's tables, each with SQL for another engine where SQL can say it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.functions import bytemachine, codec
from bitloom.operators import metrics, records, retrieval, splits, text
from bitloom.plans.catalog import register
from bitloom.session import materialize, table
from bitloom.sources import readers

_B = text.BLANK
_FOLD = functools.reduce(lambda x, f: f"replace({x}, '{f[0]}', '{f[1]}')", text.FOLDS.items(), "lower(text)")
_TOK = f"regexp_extract_all({_FOLD}, 'c\\+\\+|c#|\\.net|[a-z0-9]+(?:[._+#-][a-z0-9]+)*')"
#: A ranking gives so many of its best to a fusion of 16: five times as many, 50 at least.
POOL = 80


@register("text_clean", f"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(text, '^{_B}+|{_B}+$', '', 'g') AS t FROM documents) WHERE t <> ''")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return text.clean(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@register("bm25_tokens", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOK} AS t FROM documents)")
def bm25_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@register("doc_bytes", "SELECT doc_id, strlen(text) AS n_bytes FROM documents")
def doc_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))


def _windows_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""SELECT doc_id, CAST((s // {step}) AS INTEGER) AS chunk_idx, CAST(s AS INTEGER) AS start, CAST(greatest(1, ceil(len(t) / {step}.0)) AS INTEGER) AS total_chunks, CAST(least({size}, len(t) - s) AS INTEGER) AS n_tokens, md5(array_to_string(t[s + 1 : s + {size}], ' ')) AS digest
FROM (SELECT doc_id, t, unnest(range(0, greatest(len(t), 1), {step})) AS s FROM (SELECT doc_id, {_TOK} AS t FROM documents))"""


def _windows(spark: SparkSession, d: str, size: int, overlap: int) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return text.windows(docs, "t", size, overlap).select("doc_id", "chunk_idx", "start", "total_chunks", F.size("chunk").alias("n_tokens"), F.md5(F.array_join("chunk", " ")).alias("digest"))


@register("chunk_windows", _windows_sql(64, 0))
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d, 64, 0)


@register("chunk_windows_overlap", _windows_sql(64, 16))
def chunk_windows_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d, 64, 16)


@register("length_stats", f"""SELECT *, round_even(p99 / greatest(p50, 1), 2) AS tail_ratio FROM (SELECT count(*) AS n, round(avg(k), 6) AS mean, {", ".join(f"CAST(trunc(quantile_cont(k, {q / 100})) AS INTEGER) AS p{q}" for q in (50, 90, 95, 99))}, CAST(max(k) AS INTEGER) AS max FROM (SELECT len({_TOK}) AS k FROM documents))""")
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    return text.length_stats(table(spark, d, "documents").select(F.size(text.tokens(F.col("text"))).alias("n")))


_SPLIT = """SELECT doc_id, place, CASE WHEN place < nb THEN 'base' WHEN place < nb + floor((n - nb) * 0.9) THEN 'train' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place FROM documents), (SELECT count(*) AS n, CAST(round_even(count(*) * 0.5, 0) AS BIGINT) AS nb FROM documents)"""


def _split(spark: SparkSession, d: str) -> DataFrame:
    return splits.three_way(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "place", "split")


@register("split_assign", _SPLIT)
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)


@register("split_dense_ids", f"SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS id FROM ({_SPLIT})")
def split_dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return splits.dense_ids(_split(spark, d).select("doc_id", "split"), "split", ["doc_id"])


@register("split_holdout", "SELECT doc_id, place < floor(n * 0.1) AS is_val, CAST(place % 4 AS BIGINT) AS shard FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)")
def split_holdout(spark: SparkSession, d: str) -> DataFrame:
    return splits.shard(splits.hold_out(table(spark, d, "documents").select("doc_id"), "doc_id"), "place", 4).select("doc_id", "is_val", F.col("shard").cast("bigint").alias("shard"))


def _bm25(spark: SparkSession, d: str, k: int) -> DataFrame:
    return retrieval.bm25(table(spark, d, "documents").select(F.col("doc_id").alias("base_id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), k)


def _bm25_sql(k: int) -> str:
    return f"""SELECT * FROM (SELECT query_id, base_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id) AS rank FROM (
  WITH dt AS (SELECT doc_id, len(t) AS dl, t FROM (SELECT doc_id, {_TOK} AS t FROM documents)),
  st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dt),
  q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY 1, 2),
  p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM dt) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
  df AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
  SELECT item_id AS query_id, doc_id AS base_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 5) AS score
  FROM q JOIN df USING (term) JOIN p USING (term), st GROUP BY 1, 2)) WHERE rank <= {k}"""


@register("bm25_topk", _bm25_sql(10))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, 10)


def _dense(spark: SparkSession, d: str, k: int, skip_self: bool, half: bool = False) -> DataFrame:
    v = F.slice("embedding", 1, 32) if half else F.col("embedding")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), v.alias("v"))
    return retrieval.dense(e.withColumnRenamed("id", "base_id"), e.withColumnRenamed("id", "query_id"), k, skip_self)


def _dense_sql(k: int, skip_self: bool, half: bool = False) -> str:
    v = "embedding[1:32]" if half else "embedding"
    return f"""SELECT * FROM (SELECT query_id, base_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS base_id, round(list_inner_product(CAST(a.{v} AS DOUBLE[]), CAST(b.{v} AS DOUBLE[])), 5) AS score FROM embeddings a JOIN embeddings b ON {"a.vec_id <> b.vec_id" if skip_self else "true"})) WHERE rank <= {k}"""


@register("dense_topk", _dense_sql(10, False))
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, 10, False)


def _rrf_sql(weights: tuple[float, ...], skip_self: bool, k: int, pool: int = POOL) -> str:
    parts = " UNION ALL ".join(f"SELECT query_id, base_id, {i} AS s, rank, {w} / (rank + 60) AS w FROM ({_dense_sql(pool, skip_self, bool(i))})" for i, w in enumerate(weights))
    return f"""SELECT query_id, base_id, score, rank FROM (SELECT query_id, base_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f, base_id) AS rank FROM (
  SELECT query_id, base_id, round(sum(w), 9) AS score, min(s * 100000 + rank) AS f FROM ({parts}) GROUP BY 1, 2)) WHERE rank <= {k}"""


@register("rrf_fuse", _rrf_sql((1.0, 1.0), False, 16))
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse([_dense(spark, d, POOL, False), _dense(spark, d, POOL, False, True)], 16)


@register("rrf_fuse_weighted", _rrf_sql((0.7,), False, 16))
def rrf_fuse_weighted(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse([_dense(spark, d, POOL, False), _dense(spark, d, POOL, False, True)], 16, [0.7])


_EXCLUDING = f"SELECT query_id, base_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ({_rrf_sql((1.0, 1.0), False, 17, POOL + 1)}) WHERE query_id <> base_id"


@register("retrieve_excluding", f"SELECT * FROM ({_EXCLUDING}) WHERE rank <= 16")
def retrieve_excluding(spark: SparkSession, d: str) -> DataFrame:
    fused = retrieval.fuse([_dense(spark, d, POOL + 1, False), _dense(spark, d, POOL + 1, False, True)], 17)
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("base_id"))
    return retrieval.exclude(fused, own, 16)


@register("context_select_pad", f"SELECT query_id, array_to_string(list_concat(h, [h[-1] FOR i IN range(4 - len(h))]), ',') AS ctx_ids FROM (SELECT query_id, list(base_id ORDER BY rank) AS h FROM ({_bm25_sql(3)}) GROUP BY 1)")
def context_select_pad(spark: SparkSession, d: str) -> DataFrame:
    hits = _bm25(spark, d, 3).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "base_id"))), lambda x: x["base_id"]).alias("h"))
    return hits.select("query_id", F.array_join(retrieval.select_contexts(F.col("h"), 4), ",").alias("ctx_ids"))


@register("ctx_overhead", "SELECT doc_id, CAST(4 * greatest(1, ceil(log2(greatest(n_chars, 2)) / 8)) AS INTEGER) AS side_bytes FROM documents")
def ctx_overhead(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", retrieval.overhead_bytes(F.col("n_chars"), 4).cast("int").alias("side_bytes"))


def _pairs_sql(name: str, key: str) -> str:
    return f"SELECT id, prev, cur, count(*) AS n FROM (SELECT {key} AS id, coalesce(lag(b) OVER (PARTITION BY {key} ORDER BY i), 0) AS prev, b AS cur FROM (SELECT {key}, i, CAST(('0x' || h[i]) AS INTEGER) AS b FROM (SELECT {key}, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT {key}, regexp_extract_all(hex(encode(text)), '..') AS h FROM {name})))) GROUP BY 1, 2, 3"


_BASE_SQL = f"base AS (SELECT *, sum(c) OVER (PARTITION BY prev) AS tot FROM (SELECT prev, cur, sum(n) AS c FROM ({_pairs_sql('documents', 'doc_id')}) GROUP BY 1, 2)), tots AS (SELECT prev, max(tot) AS tot FROM base GROUP BY 1)"


@register("ngram_code_length", f"""WITH sp AS ({_SPLIT}), bi AS ({_pairs_sql('documents', 'doc_id')}), base AS (SELECT prev, cur, sum(n) AS c FROM bi JOIN sp ON id = doc_id WHERE split = 'base' GROUP BY 1, 2), tots AS (SELECT prev, sum(c) AS tot FROM base GROUP BY 1)
SELECT id AS doc_id, CAST(sum(n) AS BIGINT) AS n_bytes, round(sum(n * -log2((coalesce(c, 0) + 1) / (coalesce(tot, 0) + 256.0))) / sum(n), 6) AS bpb FROM bi JOIN sp ON id = doc_id LEFT JOIN base USING (prev, cur) LEFT JOIN tots USING (prev) WHERE split = 'test' GROUP BY 1""")
def ngram_code_length(spark: SparkSession, d: str) -> DataFrame:
    sp = materialize(_split(spark, d).select(F.col("doc_id").alias("id"), "split"), "split")
    bi = metrics.byte_bigrams(table(spark, d, "documents"))
    base = materialize(metrics.base_counts(bi.join(sp.filter("split = 'base'"), "id", "left_semi")), "base")
    got = metrics.code_length(bi.join(sp.filter("split = 'test'"), "id", "left_semi"), base)
    return got.select(F.col("id").alias("doc_id"), "n_bytes", F.round(F.col("bits") / F.col("n_bytes"), 6).alias("bpb"))


MIX = 0.7


def candidate_bits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ce(qid, cid, rank, l0, l, nbytes), item bigrams, base counts): bits of each benchmark text alone and with each of its 16 hits mixed in."""
    docs = table(spark, d, "documents")
    base = materialize(metrics.base_counts(metrics.total_bigrams(docs)), "base")
    items = metrics.byte_bigrams(table(spark, d, "benchmark"), "item_id").withColumnRenamed("id", "qid")
    hits = materialize(_bm25(spark, d, 16), "hits")
    ctx = metrics.byte_bigrams(docs.join(hits.select(F.col("base_id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    ctx = materialize(ctx.withColumn("row_n", F.sum("n").over(Window.partitionBy("id", "prev"))), "contexts")
    pairs = hits.select(F.col("query_id").alias("qid"), F.col("base_id").alias("cid"), "rank").join(items, "qid")
    full = _base_join(pairs, base).join(ctx.select(F.col("id").alias("cid"), "prev", "cur", F.col("n").alias("cn")), ["cid", "prev", "cur"], "left").join(ctx.select(F.col("id").alias("cid"), "prev", "row_n").distinct(), ["cid", "prev"], "left")
    pj = (F.coalesce("cn", F.lit(0)) + 1) / (F.coalesce("row_n", F.lit(0)) + 256.0)
    full = materialize(full.select("qid", "cid", "rank", "prev", "cur", "n", "p0", "c", "tot", "cn", "row_n", pj.alias("pj")), "full")
    ce = full.groupBy("qid", "cid", "rank").agg(F.round(F.sum(-F.col("n") * F.log2("p0")), 4).alias("l0"), F.round(F.sum(-F.col("n") * F.log2(MIX * F.col("p0") + (1 - MIX) * F.col("pj"))), 4).alias("l"), F.sum("n").alias("nbytes"))
    return materialize(ce, "ce"), items, full


def _base_join(rows: DataFrame, base: DataFrame) -> DataFrame:
    tots = base.groupBy("prev").agg(F.first("tot").alias("tot"))
    j = rows.join(F.broadcast(base.select("prev", "cur", "c")), ["prev", "cur"], "left").join(F.broadcast(tots), "prev", "left")  # 65,536 and 256 rows at most
    return j.withColumn("p0", (F.coalesce("c", F.lit(0)) + 1) / (F.coalesce("tot", F.lit(0)) + 256.0))


_CE_SQL = f"""WITH {_BASE_SQL}, it AS ({_pairs_sql('benchmark', 'item_id')}), hits AS ({_bm25_sql(16)}), cx AS (SELECT *, sum(n) OVER (PARTITION BY id, prev) AS row_n FROM ({_pairs_sql('documents', 'doc_id')}) WHERE id IN (SELECT base_id FROM hits)),
rows_ AS (SELECT prev, id, max(row_n) AS row_n FROM cx GROUP BY 1, 2),
f AS (SELECT h.query_id AS qid, h.base_id AS cid, h.rank, it.prev, it.cur, it.n, (coalesce(c, 0) + 1) / (coalesce(tots.tot, 0) + 256.0) AS p0, c, tots.tot AS tot, cx.n AS cn, r.row_n AS row_n, (coalesce(cx.n, 0) + 1) / (coalesce(r.row_n, 0) + 256.0) AS pj
  FROM hits h JOIN it ON it.id = h.query_id LEFT JOIN base ON base.prev = it.prev AND base.cur = it.cur LEFT JOIN tots ON tots.prev = it.prev LEFT JOIN cx ON cx.id = h.base_id AND cx.prev = it.prev AND cx.cur = it.cur LEFT JOIN rows_ r ON r.id = h.base_id AND r.prev = it.prev),
ce AS (SELECT qid, cid, rank, round(sum(-n * log2(p0)), 4) AS l0, round(sum(-n * log2({MIX} * p0 + {1 - MIX} * pj)), 4) AS l, CAST(sum(n) AS BIGINT) AS nbytes FROM f GROUP BY 1, 2, 3)
"""


@register("ce_cache", _CE_SQL + "SELECT qid, cid, rank, l0, l, nbytes FROM ce")
def ce_cache(spark: SparkSession, d: str) -> DataFrame:
    return candidate_bits(spark, d)[0].select("qid", "cid", "rank", "l0", "l", "nbytes")


@register("softmin_loss", _CE_SQL + "SELECT qid, round(sum(exp((m - v) / 0.4) * v) / sum(exp((m - v) / 0.4)), 6) AS loss FROM (SELECT qid, l / nbytes AS v, min(l / nbytes) OVER (PARTITION BY qid) AS m FROM ce) GROUP BY 1")
def softmin_loss(spark: SparkSession, d: str) -> DataFrame:
    return metrics.softmin(candidate_bits(spark, d)[0].select("qid", (F.col("l") / F.col("nbytes")).alias("l")))


@register("delta_zscore", _CE_SQL + "SELECT qid, cid, round(l0 - l, 6) AS delta, round((l0 - l - avg(l0 - l) OVER w) / greatest(stddev_samp(l0 - l) OVER w, 1e-6), 5) AS z FROM ce WINDOW w AS (PARTITION BY qid) QUALIFY count(*) OVER w > 1")
def delta_zscore(spark: SparkSession, d: str) -> DataFrame:
    return metrics.z_scores(candidate_bits(spark, d)[0])


@register("rank_metrics", _CE_SQL + """, r AS (SELECT qid, l0 - l AS gain, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rs, row_number() OVER (PARTITION BY qid ORDER BY l0 - l DESC, cid) AS rg, count(*) OVER (PARTITION BY qid) AS k FROM ce),
q AS (SELECT qid, max(CASE WHEN rs = 1 AND rg = 1 THEN 1 ELSE 0 END) AS hit, max(gain) - max(CASE WHEN rs = 1 THEN gain END) AS regret, CASE WHEN max(k) < 2 THEN 0 ELSE 1 - 6 * sum((rs - rg) * (rs - rg)) / greatest(max(k) * (max(k) * max(k) - 1), 1) END AS rho FROM r GROUP BY 1)
SELECT count(*) AS queries, round(avg(hit), 6) AS top1_acc, round(avg(regret), 5) AS regret, round(avg(rho), 6) AS spearman FROM q""")
def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    ce = candidate_bits(spark, d)[0]
    return metrics.rank_metrics(ce.select("qid", "cid", (-F.col("rank")).alias("score"), (F.col("l0") - F.col("l")).alias("gain")))


def _method_sql() -> str:
    side = "CAST((SELECT 4 * greatest(1, ceil(log2(greatest(count(*), 2)) / 8)) FROM documents) AS BIGINT)"
    sel = "(SELECT qid, cid FROM ce QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {o}, cid) <= 4)"
    rac = f"SELECT '{{m}}' AS method, qid, max(n) AS original_bytes, CAST(ceil(round(sum(b), 3) / 8) AS BIGINT) + {side} AS compressed_bytes FROM (SELECT qid, prev, cur, any_value(n) AS k, -any_value(n) * log2({MIX} * any_value(p0) + {1 - MIX} * avg(pj)) AS b, 0 AS z FROM f JOIN {{s}} USING (qid, cid) GROUP BY 1, 2, 3) JOIN (SELECT id AS qid, sum(n) AS n FROM it GROUP BY 1) USING (qid) GROUP BY 2"
    return _CE_SQL + f""", res AS (SELECT 'none' AS method, qid, max(nbytes) AS original_bytes, CAST(ceil(round(max(l0), 3) / 8) AS BIGINT) AS compressed_bytes FROM ce GROUP BY 2
UNION ALL {rac.format(m='rac', s=sel.format(o='rank'))}
UNION ALL {rac.format(m='rac_oracle', s=sel.format(o='l'))}
UNION ALL SELECT 'token_rag', qid, max(n), CAST(ceil(round(sum(b), 3) / 8) AS BIGINT) + {side} FROM (SELECT qid, prev, cur, -any_value(n) * log2((coalesce(any_value(c), 0) + sum(coalesce(cn, 0)) + 1) / (coalesce(any_value(tot), 0) + sum(coalesce(row_n, 0)) + 256.0)) AS b FROM f JOIN {sel.format(o='rank')} USING (qid, cid) GROUP BY 1, 2, 3) JOIN (SELECT id AS qid, sum(n) AS n FROM it GROUP BY 1) USING (qid) GROUP BY 2)
SELECT *, round(compressed_bytes * 8 / greatest(original_bytes, 1), 6) AS bpb, round(original_bytes / greatest(compressed_bytes, 1), 6) AS ratio FROM (
SELECT method, count(*) AS n, CAST(sum(original_bytes) AS BIGINT) AS original_bytes, CAST(sum(compressed_bytes) AS BIGINT) AS compressed_bytes, round(100 * (sum(compressed_bytes) / (SELECT sum(compressed_bytes) FROM res WHERE method = 'none') - 1), 6) AS vs_none_pct FROM res GROUP BY 1)"""


@register("method_table", _method_sql())
def method_table(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts under the documents' counts: alone, with the hits' raw counts, mixed with the hits' mean, and mixed with the hits that turn out best."""
    ce, items, full = candidate_bits(spark, d)
    n = table(spark, d, "documents").agg(F.count("*").alias("nd")).select(retrieval.overhead_bytes(F.col("nd"), 4).cast("bigint").alias("side"))
    size = items.groupBy("qid").agg(F.sum("n").alias("original_bytes"))

    def coded(method: str, order: str, bits) -> DataFrame:
        w = Window.partitionBy("qid").orderBy(order, "cid")
        four = ce.withColumn("p_", F.row_number().over(w)).filter("p_ <= 4").select("qid", "cid")
        b = full.join(four, ["qid", "cid"]).groupBy("qid", "prev", "cur").agg(bits.alias("b")).groupBy("qid").agg(F.ceil(F.round(F.sum("b"), 3) / 8).alias("z"))
        return b.join(size, "qid").crossJoin(F.broadcast(n)).select(F.lit(method).alias("method"), "qid", "original_bytes", (F.col("z") + F.col("side")).alias("compressed_bytes"))

    mixed = -F.first("n") * F.log2(MIX * F.first("p0") + (1 - MIX) * F.avg("pj"))
    raw = -F.first("n") * F.log2((F.coalesce(F.first("c"), F.lit(0)) + F.sum(F.coalesce("cn", F.lit(0))) + 1) / (F.coalesce(F.first("tot"), F.lit(0)) + F.sum(F.coalesce("row_n", F.lit(0))) + 256.0))
    none = ce.groupBy("qid").agg(F.max("nbytes").alias("original_bytes"), F.ceil(F.round(F.max("l0"), 3) / 8).alias("compressed_bytes")).select(F.lit("none").alias("method"), "qid", "original_bytes", "compressed_bytes")
    every = none.unionByName(coded("rac", "rank", mixed)).unionByName(coded("rac_oracle", "l", mixed)).unionByName(coded("token_rag", "rank", raw))
    return metrics.method_table(every)


@register("doc_rollup", f"""SELECT doc_id, CAST(sum(o) AS BIGINT) AS original_bytes, CAST(sum(c) AS BIGINT) AS compressed_bytes, round(coalesce(sum(CASE WHEN s >= 0 THEN s END), -1.0), 6) AS seconds, CASE WHEN min(ok) = 1 THEN 1 WHEN max(ok) = -1 THEN -1 ELSE 0 END AS roundtrip_ok, CAST(sum(CASE WHEN total > 1 THEN 1 ELSE 0 END) AS BIGINT) AS split_chunks, round(sum(c) * 8 / greatest(sum(o), 1), 6) AS bpb, round(sum(o) / greatest(sum(c), 1), 6) AS ratio
FROM (SELECT doc_id, n_tokens * 4 AS o, n_tokens * 2 + 1 AS c, total_chunks AS total, CASE WHEN chunk_idx % 5 = 4 THEN -1.0 ELSE n_tokens / 64.0 END AS s, CAST(CASE WHEN chunk_idx % 7 = 6 THEN 0 WHEN doc_id % 11 = 3 THEN -1 ELSE 1 END AS INTEGER) AS ok FROM ({_windows_sql(64, 0)})) GROUP BY 1""")
def doc_rollup(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d, 64, 0)
    n, i = F.col("n_tokens"), F.col("chunk_idx")
    chunks = w.select("doc_id", "total_chunks", (n * 4).alias("original_bytes"), (n * 2 + 1).alias("compressed_bytes"), F.when(i % 5 == 4, -1.0).otherwise(n / 64.0).alias("seconds"), F.when(i % 7 == 6, 0).when(F.col("doc_id") % 11 == 3, -1).otherwise(1).alias("roundtrip_ok"))
    return metrics.rollup(chunks, "doc_id")


@register("mean_pool", "SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS value FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_pool(table(spark, d, "embeddings"), "label", "embedding")


@register("budget_take", "SELECT doc_id, source, CAST(before AS BIGINT) AS before FROM (SELECT doc_id, source, coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 50000")
def budget_take(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.octet_length("text").alias("n"))
    return text.budget_take(docs, "source", F.col("n"), ["doc_id"], 50_000).select("doc_id", "source", "before")


@register("path_names", """SELECT page_id, split_part(u, '_', 1) || '.' || string_split(u, '.')[-1] AS label, CASE WHEN ends_with(p, '.c') OR ends_with(p, '.h') THEN 'C' WHEN ends_with(p, '.cpp') OR ends_with(p, '.cc') OR ends_with(p, '.C') OR ends_with(p, '.hpp') THEN 'C++' WHEN ends_with(p, '.java') THEN 'Java' WHEN ends_with(p, '.py') THEN 'Python' END AS language
FROM (SELECT page_id, string_split(url, '/')[-1] AS u, url || CASE page_id % 4 WHEN 0 THEN '.c' WHEN 1 THEN '.C' WHEN 2 THEN '.py' ELSE '' END AS p FROM pages)""")
def path_names(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id") % 4
    name = F.concat("url", F.when(i == 0, ".c").when(i == 1, ".C").when(i == 2, ".py").otherwise(""))
    return table(spark, d, "pages").select("page_id", text.label_from_path(F.col("url")).alias("label"), text.lang_from_name(name).alias("language"))


@register("mask_shift", f"SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx FROM (SELECT doc_id, chunk_idx, m, sum(m) OVER (PARTITION BY doc_id ORDER BY chunk_idx DESC) AS tail FROM (SELECT doc_id, chunk_idx, CASE WHEN chunk_idx = 0 THEN 0 ELSE 1 END AS m FROM ({_windows_sql(64, 16)}))) WHERE m = 1 AND tail > 1")
def mask_shift(spark: SparkSession, d: str) -> DataFrame:
    m = _windows(spark, d, 64, 16).select("doc_id", "chunk_idx", F.when(F.col("chunk_idx") == 0, 0).otherwise(1).alias("m"))
    return metrics.mask_shift(m, "doc_id", "chunk_idx", "m").select("doc_id", "chunk_idx")


@register("byte_pad", "SELECT doc_id, strlen(text) + ((16 - strlen(text) % 16) % 16) AS n_tokens, CAST((16 - strlen(text) % 16) % 16 AS BIGINT) AS n_pad, CAST(ceil(strlen(text) / 16.0) AS BIGINT) + 2 AS n_patches FROM documents")
def byte_pad(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length("text").cast("bigint")
    pad = F.pmod(F.lit(16) - n % 16, F.lit(16))
    return table(spark, d, "documents").select("doc_id", (n + pad).alias("n_tokens"), pad.alias("n_pad"), (F.ceil(n / 16) + 2).alias("n_patches"))


@register("range_roundtrip")
def range_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    base = materialize(metrics.base_counts(metrics.total_bigrams(table(spark, d, "documents"))), "base")
    return codec.range_round_trip(table(spark, d, "documents"), base, "doc_id")


@register("library_baselines")
def library_baselines(spark: SparkSession, d: str) -> DataFrame:
    return codec.library_baselines(table(spark, d, "documents"), "doc_id")


@register("bytemachine_run")
def bytemachine_run(spark: SparkSession, d: str) -> DataFrame:
    return bytemachine.generate(spark, 1000)


@register("bytemachine_eval")
def bytemachine_eval(spark: SparkSession, d: str) -> DataFrame:
    """A prediction that lacks its last byte: all but one byte match."""
    true = materialize(bytemachine.generate(spark, 21_000), "states")
    cut = true.select("name", F.expr("substring(states, 1, octet_length(states) - 1)").alias("states"))
    return bytemachine.accuracy(true, cut).select("name", "matched", "total", F.round(F.col("matched") / F.col("total"), 6).alias("accuracy"))


_HASHED = """SELECT id, list(coalesce(c, 0) / z ORDER BY d) AS v FROM (SELECT id, d, z FROM (SELECT id, sqrt(sum(c * c)) AS z FROM {t} GROUP BY 1), (SELECT unnest(range(64)) AS d)) LEFT JOIN {t} USING (id, d) GROUP BY 1"""


def _cells_sql(name: str, key: str) -> str:
    return f"SELECT id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64 AS d, CAST(count(*) AS DOUBLE) AS c FROM (SELECT {key} AS id, unnest({_TOK}) AS t FROM {name}) GROUP BY 1, 2"


@register("retrieve_hybrid", f"""WITH bc AS ({_cells_sql('documents', 'doc_id')}), qc AS ({_cells_sql('benchmark', 'item_id')}), bv AS ({_HASHED.format(t='bc')}), qv AS ({_HASHED.format(t='qc')}),
dense AS (SELECT * FROM (SELECT query_id, base_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id) AS rank FROM (SELECT qv.id AS query_id, bv.id AS base_id, round(list_inner_product(CAST(CAST(qv.v AS FLOAT[]) AS DOUBLE[]), CAST(CAST(bv.v AS FLOAT[]) AS DOUBLE[])), 5) AS score FROM qv, bv)) WHERE rank <= {POOL}),
words AS ({_bm25_sql(POOL)}),
every AS (SELECT query_id, base_id, 0 AS s, rank FROM words UNION ALL SELECT query_id, base_id, 1, rank FROM dense)
SELECT query_id, base_id, score, rank FROM (SELECT query_id, base_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f, base_id) AS rank FROM (
  SELECT query_id, base_id, round(sum(1.0 / (rank + 60)), 9) AS score, min(s * 100000 + rank) AS f FROM every GROUP BY 1, 2)) WHERE rank <= 16""")
def retrieve_hybrid(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "documents").select(F.col("doc_id").alias("base_id"), "text")
    return retrieval.hybrid(base, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 16)


@register("retrieval_cache", f"SELECT item_id AS query_id, coalesce(ids, '') AS base_ids FROM benchmark LEFT JOIN (SELECT query_id AS item_id, array_to_string(list(base_id ORDER BY rank), ',') AS ids FROM ({_bm25_sql(16)}) GROUP BY 1) USING (item_id)")
def retrieval_cache(spark: SparkSession, d: str) -> DataFrame:
    """Every query with its hits, best first; one without hits has none."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return records.with_cache(items, _bm25(spark, d, 16)).select("query_id", F.array_join("base_ids", ",").alias("base_ids"))


@register("sample_ids", "SELECT doc_id, format('doc{:06d}', doc_id) AS sample_id FROM documents")
def sample_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", records.sample_id("doc", F.col("doc_id")).alias("sample_id"))


@register("eligible", f"SELECT doc_id FROM (SELECT doc_id, {_TOK} AS t FROM documents) WHERE len(t) >= 2")
def eligible(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n"))
    return docs.filter(records.is_eligible(F.col("n"))).select("doc_id")


@register("pad_ids", f"""SELECT item_id, CAST(w AS INTEGER) AS width, array_to_string(list_concat(ids, [-1 FOR i IN range(w - len(ids))]), ',') AS ids, CAST(len(ids) AS INTEGER) AS active
FROM (SELECT item_id, ids, max(len(ids)) OVER (PARTITION BY item_id // 8) AS w FROM (SELECT item_id, list_transform({_TOK}, lambda x: length(x)) AS ids FROM benchmark))""")
def pad_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "benchmark").select("item_id", F.transform(text.tokens(F.col("text")), F.length).alias("ids"), F.floor(F.col("item_id") / 8).alias("batch"))
    got = records.pad_ids(ids, "ids", "batch", -1)
    return got.select("item_id", F.size("ids").alias("width"), F.array_join("ids", ",").alias("ids"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("active"))


@register("context_tokens", f"SELECT conv_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT conv_id, flatten(list(t ORDER BY turn, text))[1:64] AS t FROM (SELECT conv_id, turn, text, {_TOK} AS t FROM conversations) GROUP BY 1)")
def context_tokens(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text", text.tokens(F.col("text")).alias("t"))
    got = records.join_contexts(turns, "conv_id", ["turn", "text"], "t", 64)
    return got.select("conv_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@register("crop_windows", """SELECT doc_id, CAST(s AS INTEGER) AS start, md5(substr(text, s + 1, 200)) AS digest FROM (SELECT doc_id, text, CASE WHEN k % 3 = 0 OR n <= 200 THEN 0 WHEN k % 3 = 1 THEN n - 200 ELSE (k // 3) % (n - 199) END AS s
FROM (SELECT doc_id, text, length(text) AS n, CAST(('0x' || substr(md5('42:' || doc_id), 1, 7)) AS BIGINT) AS k FROM documents))""")
def crop_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    start = records.crop_start(F.length("text"), 200, F.col("doc_id"))
    return docs.withColumn("start", start.cast("int")).select("doc_id", "start", F.md5(F.substr("text", F.col("start") + 1, F.lit(200))).alias("digest"))


@register("carve_out", "SELECT doc_id, place < nv AS is_eval FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place, count(*) OVER () AS n, CAST(floor(count(*) OVER () * 0.1) AS BIGINT) AS nv FROM documents) WHERE CASE WHEN place < nv THEN place < nv - nv % 16 ELSE place - nv < n - nv - (n - nv) % 16 END")
def carve_out(spark: SparkSession, d: str) -> DataFrame:
    return splits.carve_out(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1, 16).select("doc_id", "is_eval")


@register("label_ids", f"SELECT doc_id, coalesce(id, -1) AS id FROM documents LEFT JOIN (SELECT source, row_number() OVER (ORDER BY min(doc_id), source) - 1 AS id FROM documents JOIN ({_SPLIT}) USING (doc_id) WHERE split = 'train' GROUP BY 1) USING (source)")
def label_ids(spark: SparkSession, d: str) -> DataFrame:
    """Labels by first appearance in the train split; -1 for others."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    train = docs.join(_split(spark, d).filter("split = 'train'").select("doc_id"), "doc_id", "left_semi")
    return records.label_ids(docs, train, "source", "doc_id").select("doc_id", "id")


@register("logged_gains", _CE_SQL + "SELECT round(avg(best), 5) AS best_ce, round(avg(l0), 5) AS base_ce, round(avg(gain), 5) AS gain FROM (SELECT qid, min(l) AS best, max(l0) AS l0, max(l0 - l) AS gain FROM ce GROUP BY 1)")
def logged_gains(spark: SparkSession, d: str) -> DataFrame:
    return metrics.logged_gains(candidate_bits(spark, d)[0])


@register("top_gains", _CE_SQL + "SELECT qid, cid, round(l0 - l, 4) AS gain FROM ce ORDER BY round(l0 - l, 4) DESC, qid, cid LIMIT 20")
def top_gains(spark: SparkSession, d: str) -> DataFrame:
    """The 20 pairs of greatest gain, a report."""
    return metrics.top_gains(candidate_bits(spark, d)[0], 20)


@register("ce_map", _CE_SQL + "SELECT qid, max(l0) AS l0, count(*) AS n, string_agg(cid, ',' ORDER BY cid) AS cids, round(sum(l), 3) AS total FROM ce GROUP BY 1")
def ce_map(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.ce_map(candidate_bits(spark, d)[0])
    return m.select("qid", "l0", F.size("chunks").cast("bigint").alias("n"), F.array_join(F.array_sort(F.map_keys("chunks")), ",").alias("cids"), F.round(F.aggregate(F.map_values("chunks"), F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@register("epoch_means", "SELECT epoch, round(mean, 6) AS mean, round(min(mean) OVER (ORDER BY epoch), 6) AS best FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS epoch, avg(value) AS mean FROM events GROUP BY 1)")
def epoch_means(spark: SparkSession, d: str) -> DataFrame:
    """Events by day, as losses by epoch: the mean and the least so far."""
    return metrics.epoch_means(table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("epoch"), "value"), "epoch", "value")


@register("moving_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def moving_mean(spark: SparkSession, d: str) -> DataFrame:
    return metrics.moving_mean(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 10).select("event_id", F.round("mean", 6).alias("mean"))


@register("source_counters", "SELECT source AS language, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS code_bytes, round(sum(strlen(text)) / 1048576, 4) AS mib FROM documents GROUP BY 1")
def source_counters(spark: SparkSession, d: str) -> DataFrame:
    return readers.language_summary(table(spark, d, "documents").select(F.col("source").alias("language"), F.octet_length("text").cast("bigint").alias("code_bytes")))


@register("codec_totals")
def codec_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and overall ratio of each library codec over all documents."""
    got = materialize(library_baselines(spark, d), "baselines")
    return records.codec_totals(got, {c: f"{c}_bytes" for c in ("zlib", "zstd", "lzma")})
