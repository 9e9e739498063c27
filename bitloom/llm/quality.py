"""Operator 5: quality classifier with hierarchical empirical Bayes over sites.

Two logistic heads (poor, toxic) read a document: shape features and the words whose presence tells
the classes apart. Their evidence is combined with the site's prior: grouped aggregation over every
document gives host and path rates, and each level shrinks toward the level above (path to host,
host to the whole corpus) with a strength estimated from how much its sites differ, so that a sparse
site takes the global prior. A document is rejected where either posterior reaches one half.

Defined results. Texts of any length are read whole. A document of several texts trains by the least of them.
Words are features whole and by their first 6 bytes. Posteriors of exactly one half reject. An empty table gives no row. A null text is an empty one. A null host or path is a site of its own. Labels may be
missing, null or repeated (the largest counts); without labels of both classes a head gives no
evidence and its documents stay. Repeated rows are scored alike and all count in the rates; extra
columns pass through unchanged.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.llm.arrays import U, column, constants, fresh, mix, pieces, strings, words
from bitloom.session import materialize

#: The classifier is fitted on at most so many labelled documents, those of least hash.
TRAIN_ROWS = 8000
WORDS, RIDGE, REJECT = 256, 3.0, 0.5
HEADS = ("poor", "toxic")
SITE_MAX = 1e6
#: Log odds of a head that can't be fitted.
NEVER = -30.0
#: Besides words, their beginnings of so many bytes tell, where they occur so often.
PREFIX, OFTEN = 6, (1, 2, 4)


def _classes() -> np.ndarray:
    k = np.full(256, 6, np.uint8)  # other symbols
    for i, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r", b".,;:'\"-()?", b"!|")):
        k[list(chars)] = i
    k[128:] = 7
    return k


def shape(kinds: np.ndarray, d: np.ndarray, o: np.ndarray, row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Per row: shares of byte kinds, repetition, word and line lengths, and the logarithm of the length."""
    n, size = len(o) - 1, np.diff(o)
    at = np.repeat(np.arange(n, dtype=np.int32) * 8, size)
    c = np.bincount(at + kinds[d], minlength=8 * n).reshape(n, 8).astype(np.float64)
    lines = np.bincount(at[d == 10] // 8, minlength=n) if len(d) else np.zeros(n)
    w = np.bincount(row, minlength=n)
    k = np.sort((row.astype(U) << U(50)) | (h >> U(14)))
    kinds_of = np.bincount((k[np.append(True, k[1:] != k[:-1])] >> U(50)).astype(np.int64), minlength=n) if len(k) else np.zeros(n)
    total, one = np.maximum(size, 1), np.maximum(w, 1)
    letters = np.maximum(c[:, 0] + c[:, 1] + c[:, 7], 1)
    x = np.stack([c[:, 1] / letters, c[:, 2] / total, c[:, 3] / total, c[:, 4] / one, np.minimum(c[:, 5] / one, 3), np.minimum(c[:, 6] / one, 3), kinds_of / one, np.minimum((c[:, 0] + c[:, 1] + c[:, 7]) / one, 30), np.minimum(lines / one, 1), np.log1p(w), (w == 0) * 1.0], 1)
    return np.concatenate((x, x**2, np.sqrt(x)), 1)


def _often(row: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of word beginnings: one feature for each least count that is reached."""
    if not len(base):
        return row, base
    order = np.lexsort((base, row))
    row, base = row[order], base[order]
    at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (base[1:] != base[:-1])))
    n = np.diff(np.append(at, len(row)))
    row, base = row[at], base[at]
    return np.concatenate([row[n >= k] for k in OFTEN]), np.concatenate([mix(base[n >= k] + U(k)) for k in OFTEN])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c, kinds = constants(), _classes()
    for batch in batches:
        for p in pieces(batch, "text"):
            text = column(p, "text")
            low, n = strings(pc.utf8_lower(text)), p.num_rows
            row, h, _, _ = words(c, *low)
            x = shape(kinds, *strings(text), row, h)
            begins, base, _, _ = words(c, *low, PREFIX)
            per = np.split(base, np.searchsorted(begins, np.arange(1, n)))
            own, f = _often(begins, base)
            own, f = np.concatenate((row, own)), np.concatenate((h, f))
            order = np.argsort(own, kind="stable")
            cut = np.split(f[order], np.searchsorted(own[order], np.arange(1, n)))
            yield pa.RecordBatch.from_arrays([column(p, "poor"), column(p, "toxic"), pa.array([v.tobytes() for v in x], pa.binary()), *[pa.array([np.unique(v).tobytes() for v in y], pa.binary()) for y in (cut, per)]], ["poor", "toxic", "x", "w", "b"])


def _newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression; the last column, the constant, is not shrunk."""
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    r = np.full(len(w), RIDGE)
    r[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - r * w
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(r), g)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, train_rows: int) -> dict:
    """The model, fitted on at most train_rows labelled documents."""
    y = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 0).cast("double").alias("poor"), (F.col("toxic") == 1).cast("double").alias("toxic")).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("poor").alias("poor"), F.max("toxic").alias("toxic"))
    few = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    ids = {r[0]: (r[1], r[2]) for r in few.collect()}
    none = {"center": np.zeros(33), "scale": np.ones(33), "hash": np.zeros(0, U), "base": np.zeros(0, U), "coef": np.zeros((2, 0)), "shape": np.zeros((2, 33)), "bias": np.full(2, NEVER), "prior": np.full(2, NEVER)}
    if not ids:
        return none
    spark = docs.sparkSession
    small = spark.createDataFrame(pa.table({"id": list(ids), "poor": pa.array([v[0] for v in ids.values()], pa.float64()), "toxic": pa.array([v[1] for v in ids.values()], pa.float64())}))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(small), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("poor").alias("poor"), F.first("toxic").alias("toxic")).select("poor", "toxic", "text").mapInArrow(_features, "poor double, toxic double, x binary, w binary, b binary")
    got = rows.toArrow()  # train_rows rows of a few kB
    if not got.num_rows:
        return none
    x = np.stack([np.frombuffer(v.as_buffer()) for v in got["x"]])
    held = [np.frombuffer(v.as_buffer(), U) for v in got["w"]]
    order = np.lexsort((*x.T[:4], [len(v) for v in held]))  # the same model whatever the order of arrival
    x, held = x[order], [held[i] for i in order]
    doc = np.repeat(np.arange(len(held)), [len(v) for v in held])
    every, inv, df = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    model = {"center": x.mean(0), "scale": x.std(0) + 1e-9, "shape": np.zeros((2, x.shape[1])), "bias": np.full(2, NEVER), "prior": np.full(2, NEVER)}
    z = (x - model["center"]) / model["scale"]
    chosen, coef = np.zeros(0, np.int64), [{}, {}]
    for k, head in enumerate(HEADS):
        v = got[head].to_numpy()[order]
        known = ~np.isnan(v)
        if len(np.unique(v[known])) < 2:
            continue
        yk = v == 1
        hit = np.bincount(inv, weights=(yk & known)[doc], minlength=len(every))
        n, pos, m = known.sum(), (yk & known).sum(), np.bincount(inv, weights=known[doc], minlength=len(every))
        expect = m * pos / n
        chi = (hit - expect) ** 2 / (expect * (1 - pos / n) * np.maximum(1 - m / n, 1e-9) + 1e-9)
        best = np.flatnonzero((m >= 5) & (chi > 20))
        best = best[np.lexsort((every[best], -chi[best]))][:WORDS]
        slot = np.full(len(every), -1)
        slot[best] = np.arange(len(best))
        has = np.zeros((len(held), len(best)))
        at = slot[inv]
        has[doc[at >= 0], at[at >= 0]] = 1
        w = _newton(np.concatenate((z, has, np.ones((len(z), 1))), 1)[known], yk[known].astype(float))
        model["shape"][k], model["bias"][k], model["prior"][k] = w[: z.shape[1]], w[-1], np.log(pos / (n - pos))
        coef[k] = dict(zip(best.tolist(), w[z.shape[1] : -1].tolist(), strict=True))
        chosen = np.union1d(chosen, best)
    model["hash"] = every[chosen]
    base = np.unique(np.concatenate([np.frombuffer(v.as_buffer(), U) for v in got["b"]]))
    model["base"] = base[np.any([np.isin(mix(base + U(k)), model["hash"]) for k in OFTEN], 0)]
    model["coef"] = np.array([[coef[k].get(int(i), 0.0) for i in chosen] for k in range(2)]).reshape(2, len(chosen))
    return model


def logits(c: dict, kinds: np.ndarray, model: dict, text: pa.Array) -> np.ndarray:
    """Evidence (log likelihood ratio) of each row for each head."""
    low = strings(pc.utf8_lower(text))
    row, h, _, _ = words(c, *low)
    z = (shape(kinds, *strings(text), row, h) - model["center"]) / model["scale"]
    out = z @ model["shape"].T + model["bias"] - model["prior"]
    if len(model["base"]):
        begins, base, _, _ = words(c, *low, PREFIX)
        lut = np.zeros(1 << 16, bool)
        lut[(model["base"] >> U(48)).astype(np.int64)] = True
        some = np.flatnonzero(lut[(base >> U(48)).astype(np.int64)])
        some = some[np.isin(base[some], model["base"])]
        own, f = _often(begins[some], base[some])
        row, h = np.concatenate((row, own)), np.concatenate((h, f))
    if len(model["hash"]) and len(h):
        lut = np.zeros(1 << 16, bool)
        lut[(model["hash"] >> U(48)).astype(np.int64)] = True
        some = np.flatnonzero(lut[(h >> U(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(model["hash"], h[some]), len(model["hash"]) - 1)
        ok = model["hash"][at] == h[some]
        key = np.unique(row[some][ok] * len(model["hash"]) + at[ok])  # presence, not count
        r, j = key // len(model["hash"]), key % len(model["hash"])
        for k in range(2):
            out[:, k] += np.bincount(r, weights=model["coef"][k][j], minlength=len(text))
    return out


def _score(held, text: str, keep: list[str], names: tuple[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c, kinds, model = constants(), _classes(), held.value
    for batch in batches:
        for p in pieces(batch, text):
            x = logits(c, kinds, model, column(p, text))
            yield pa.RecordBatch.from_arrays([*(column(p, k) for k in keep), pa.array(x[:, 0]), pa.array(x[:, 1])], [*keep, *names])


def evidence(docs: DataFrame, held, text_col: str, names: tuple[str, str], keep: list[str]) -> DataFrame:
    """The columns keep of docs and both heads' evidence."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(x, T.DoubleType()) for x in names])
    return docs.mapInArrow(functools.partial(_score, held, text_col, keep, names), schema)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sites(scored: DataFrame, model: dict) -> DataFrame:
    """(host, path, prior_poor, prior_toxic): shrunken log odds of every path.

    scored has host, path, and for each head its evidence and label. The strength of a level's prior is the
    method-of-moments beta concentration of its rates, weighted by their size.
    """
    for k, h in enumerate(HEADS):
        z = F.col(h) + F.lit(float(model["prior"][k]))
        scored = scored.withColumn(f"p_{h}", F.coalesce(f"y_{h}", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(f"p_{h}").alias(f"s_{h}") for h in HEADS])
    paths = materialize(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("m"), *[F.sum(f"s_{h}").alias(f"t_{h}") for h in HEADS])
    total = hosts.agg(F.sum("m").alias("all"), *[F.sum(f"t_{h}").alias(f"all_{h}") for h in HEADS]).first()
    if not total["all"]:
        return paths.select("host", "path", *[F.lit(0.0).alias(f"prior_{h}") for h in HEADS])

    def strength(rate: Column, mean: Column, n: Column) -> Column:
        between = F.sum(n * (rate - mean) ** 2) - F.sum(mean * (1 - mean))
        size = F.greatest(F.sum(n) - F.sum(n * n) / F.sum(n), F.lit(1e-9))
        var = F.greatest(between / size, F.lit(1e-12))
        return F.least(F.lit(SITE_MAX), F.greatest(F.lit(1.0), F.avg(mean * (1 - mean)) / var - 1))

    rate = {h: (total[f"all_{h}"] + 0.5) / (total["all"] + 1) for h in HEADS}
    kappa = hosts.agg(*[strength(F.col(f"t_{h}") / F.col("m"), F.lit(rate[h]), F.col("m")).alias(h) for h in HEADS]).first()
    hosts = hosts.select(F.col("host").alias("host_"), *[((F.col(f"t_{h}") + kappa[h] * rate[h]) / (F.col("m") + kappa[h])).alias(f"h_{h}") for h in HEADS])
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("host_"))).drop("host_")
    inner = both.agg(*[strength(F.col(f"s_{h}") / F.col("n"), F.col(f"h_{h}"), F.col("n")).alias(h) for h in HEADS]).first()
    return both.select("host", "path", *[_logit((F.col(f"s_{h}") + inner[h] * F.col(f"h_{h}")) / (F.col("n") + inner[h])).alias(f"prior_{h}") for h in HEADS])


def site_columns(docs: DataFrame) -> tuple[Column, Column]:
    """Host and path: of a url column if there is one, else source, and language within it."""
    if "url" in docs.columns:
        return F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1), F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]*)", 1)
    null = F.lit(None).cast("string")
    return F.col("source").cast("string") if "source" in docs.columns else null, F.col("lang").cast("string") if "lang" in docs.columns else null


def _prepare(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, train_rows: int) -> tuple:
    host, path = site_columns(docs)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), host.alias("host"), path.alias("path"), F.col(text_col).alias("text"))
    model = fit(docs, labels, id_col, text_col, train_rows)
    held = docs.sparkSession.sparkContext.broadcast(model)
    scored = materialize(evidence(slim, held, "text", HEADS, ["doc_id", "host", "path"]), "scored")
    y = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 0).cast("double").alias("y_poor"), (F.col("toxic") == 1).cast("double").alias("y_toxic")).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("y_poor").alias("y_poor"), F.max("y_toxic").alias("y_toxic"))
    prior = materialize(sites(scored.join(y, "doc_id", "left"), model), "sites")
    return held, scored, prior


def _posterior(h: str) -> Column:
    z = F.col(h) + F.col(f"prior_{h}")
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, poor, toxic, keep) of every row of docs: posterior probabilities and the decision."""
    _, scored, prior = _prepare(docs, labels, id_col, text_col, train_rows)
    joined = scored.alias("d").join(prior.alias("s"), F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path")))
    p = joined.select("doc_id", *[_posterior(h).alias(h) for h in HEADS])
    return p.select("doc_id", *HEADS, (F.greatest(*HEADS) < REJECT).alias("keep"))


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that classify() keeps, with the columns of docs. Texts are scored again rather than shuffled."""
    held, _, prior = _prepare(docs, labels, id_col, text_col, train_rows)
    names = [fresh(x, docs.columns) for x in ("evidence_poor", "evidence_toxic", "site_host", "site_path")]
    host, path = site_columns(docs)
    placed = docs.withColumn(names[2], host).withColumn(names[3], path)
    scored = evidence(placed, held, text_col, (names[0], names[1]), placed.columns)
    p = prior.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), *[F.col(f"prior_{h}").alias(fresh(f"prior_{h}", docs.columns)) for h in HEADS])
    joined = scored.join(p, F.col(names[2]).eqNullSafe(p["s_host"]) & F.col(names[3]).eqNullSafe(p["s_path"]))
    bad = [1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(e) + p[fresh(f"prior_{h}", docs.columns)])))) >= REJECT for e, h in zip(names, HEADS, strict=False)]
    return joined.filter(~(bad[0] | bad[1])).select(*[scored[c] for c in docs.columns])
