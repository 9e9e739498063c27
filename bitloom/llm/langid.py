"""Operator 8: language identification by interpolated Kneser-Ney character models.

Every labelled document is counted: the top order by occurrences, lower orders by the number of
distinct characters before them. Each order discounts by D = n1 / (n1 + 2 n2) and interpolates with the
next lower one. Every gram that was seen is in the model, which grows with the corpus: sorted arrays of
gram hashes for each order, with a column of log probabilities for each language, in parts by the two
characters before the last. A part is built at a time, into a file that executors fetch once and map,
so that neither the driver nor a worker holds the model in memory. A text is given the language of lowest cross-entropy in bits a
character. Rejection is calibrated: in a second aggregation over all documents each language's own
spread of cross-entropies sets a limit, wider for short texts; a text beyond it is "und".

Characters are lower-cased letters; all else is one space. Twelve bits a character: letters beyond
U+0FFF share by hash the codes below it that no letter has, so none is taken for a space or for another script's below.
A character that a language never showed gets an equal share, of all 4096 codes, of what the discounts leave.

Defined results. Texts of any length are read whole. An empty table gives no row. Null, empty and letterless texts are "und" with null bits. Documents with a null label
train nothing but are judged. Without any label all are "und". Equal scores go to the first language by
name. Repeated rows are judged alike and all count; a null doc_id is carried; extra columns are ignored.
"""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.arrays import U, column, mix, pieces, strings
from bitloom.session import materialize

ORDER, BITS, SPACE = 5, 12, 32
#: A part of the model is built from about so many grams.
PART_ROWS = 1_000_000
#: A text is rejected beyond the median by so many spreads, and more by SHORT / sqrt(characters).
SPREADS, LEAST_SPREAD, SHORT = 8.0, 0.05, 20.0
UNKNOWN = "und"


def letters() -> np.ndarray:
    """The code of each character below U+33480: 12 bits for letters and marks, else that of a space. Beyond there are no letters."""
    n = 0x33480
    cp = np.arange(n, dtype=np.uint64)
    is_letter = np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(n)), bool, n)
    free = np.flatnonzero(~is_letter[: 1 << BITS])
    free = free[free != SPACE].astype(np.uint16)
    code = np.where(cp < 1 << BITS, cp, free[(mix(cp) % U(len(free))).astype(np.int64)]).astype(np.uint16)
    return np.where(is_letter, code, SPACE).astype(np.uint16)


def grams(lut: np.ndarray, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of every character with the ORDER - 1 before it; before the text there are spaces."""
    n = len(arr)
    d, o = strings(pc.utf8_lower(arr))
    cp = np.frombuffer(d.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.append(0, np.cumsum((d & 0xC0) != 0x80))[o]
    code = lut[np.minimum(cp, len(lut) - 1)]
    gap = code == SPACE
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # the first space of a run
    first = lead[:-1][np.diff(lead) > 0]
    keep[first] = ~gap[first]
    at = np.append(0, np.cumsum(keep))[lead]
    code = code[keep].astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(at))
    place = np.arange(len(code)) - at[:-1][row]
    key = code.copy()
    for j in range(1, ORDER):
        before = np.full(len(code), SPACE, np.int64)
        before[j:] = code[:-j]
        before[place < j] = SPACE
        key |= before << (BITS * j)
    return row, key


def _squeeze(held: list) -> list:
    key, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return [(key[at], np.add.reduceat(n, at))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's gram counts of each language."""
    lut, held, size = letters(), {}, {}

    def out(lang: str) -> pa.RecordBatch:
        key, n = _squeeze(held.pop(lang))[0]
        size.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(key), np.int32))), pa.array(key), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        for lang in pc.unique(column(batch, "lang")).to_pylist():
            own = batch.filter(pc.equal(column(batch, "lang"), lang))
            for p in pieces(own, "text", 1 << 22):
                key, n = np.unique(grams(lut, column(p, "text"))[1], return_counts=True)
                if len(key):
                    held.setdefault(lang, []).append((key, n))
                    size[lang] = size.get(lang, 0) + len(key)
                    if size[lang] > 1 << 20:
                        held[lang] = _squeeze(held[lang])
                        size[lang] = len(held[lang][0][0])
                        if size[lang] > 1 << 20:
                            yield out(lang)
    for lang in list(held):
        yield out(lang)


def count_tables(docs: DataFrame) -> DataFrame:
    """(lang, level, gram, n, total) of all grams, and a row with level 0 - order for each discount.

    docs has lang and text. total is the sum over all grams with the same context."""
    raw = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(_count, "lang string, gram bigint, n bigint")
    level = materialize(raw.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    parts = []
    for k in range(ORDER, 0, -1):
        d = level.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2"))
        of = level.withColumn("total", F.sum("n").over(Window.partitionBy("lang", F.shiftright("gram", BITS))))
        parts.append(of.select("lang", F.lit(k).alias("level"), "gram", "n", "total"))
        parts.append(d.select("lang", F.lit(-k).alias("level"), F.lit(0).cast("bigint").alias("gram"), F.col("n1").alias("n"), F.col("n2").alias("total")))
        if k > 1:
            level = materialize(level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1)).alias("gram")).agg(F.count("*").alias("n")), "grams")
    return materialize(functools.reduce(DataFrame.union, parts), "counts")


def _part(key, parts: int):
    """The part that holds a gram of three characters or more, its context and its lower orders, as a Column or an array."""
    pair = F.shiftright(key, BITS).bitwiseAND(F.lit((1 << (2 * BITS)) - 1)) if isinstance(key, Column) else (key >> BITS) & ((1 << (2 * BITS)) - 1)
    mixed = pair * 2654435761
    return F.pmod(F.shiftright(mixed, 16), F.lit(parts)) if isinstance(key, Column) else (mixed >> 16) % parts


def _sorted(key: np.ndarray, values: np.ndarray) -> dict:
    """A hash array: hashes ascending with the values' rows in their order, and where each leading bit pattern begins."""
    h = mix(key.astype(U) + U(0x9E3779B97F4A7C15))
    order = np.argsort(h)
    bits = max(1, min(22, int(np.ceil(np.log2(max(len(h), 1)))) + 1))
    start = np.searchsorted(h[order] >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U)).astype(np.int32)
    return {"hash": h[order], "values": values[order], "start": start, "shift": U(64 - bits), "most": int(np.diff(start).max(initial=0))}


def _look(t: dict, key: np.ndarray) -> np.ndarray:
    """The row of each gram, -1 where it is absent."""
    if not len(t["hash"]):
        return np.full(len(key), -1)
    h = mix(key.astype(U) + U(0x9E3779B97F4A7C15))
    b = (h >> t["shift"]).astype(np.int64)
    pos, end = t["start"][b], t["start"][b + 1]
    for _ in range(t["most"]):
        on = (pos < end) & (t["hash"].take(pos, mode="clip") < h)
        if not on.any():
            break
        pos = pos + on
    return np.where((pos < end) & (t["hash"].take(pos, mode="clip") == h), pos, -1)


def log_prob(model: dict, k: int, key: np.ndarray) -> np.ndarray:
    """Log2 probability of each gram's last character after the others, a column for each language."""
    if "parts" in model:
        if len(model["parts"]) == 1 or k < 3:  # every part has the lower orders whole
            return log_prob(model["parts"][0], k, key)
        part = _part(key, len(model["parts"]))
        out = np.empty((len(key), len(model["langs"])), np.float32)
        for i in np.unique(part):
            own = np.flatnonzero(part == i)
            out[own] = log_prob(model["parts"][i], k, key[own])
        return out
    if k == 0:
        return np.broadcast_to(model["floor"], (len(key), len(model["langs"])))
    t = model["grams"][k]
    at = _look(t, key)
    out = t["values"].take(at, axis=0, mode="clip") if len(t["hash"]) else np.zeros((len(key), len(model["langs"])), np.float32)
    miss = np.flatnonzero(at < 0)
    if len(miss):
        c = model["contexts"][k]
        own = key[miss]
        ctx = _look(c, own >> BITS)
        back = np.where((ctx >= 0)[:, None], c["values"].take(ctx, axis=0, mode="clip") if len(c["hash"]) else np.float32(0), np.float32(0))
        out[miss] = back + log_prob(model, k - 1, own & ((1 << (BITS * (k - 1))) - 1))
    return out


def build(table: pa.Table, langs: list[str]) -> dict:
    """One part of the model, of rows of count_tables()."""
    level, gram, n, total = (table[c].to_numpy() for c in ("level", "gram", "n", "total"))
    which = pc.index_in(table["lang"], pa.array(langs, pa.string())).to_numpy().astype(np.int64)
    size = len(langs)
    model = {"langs": langs, "grams": {}, "contexts": {}, "floor": np.zeros(size, np.float32)}
    model["floor"] = np.full(size, -BITS, np.float32)
    for k in range(1, ORDER + 1):
        d = np.full(size, 0.5)
        for i in np.flatnonzero(level == -k):
            d[which[i]] = min(0.95, max(0.05, n[i] / max(n[i] + 2 * total[i], 1)))
        m = level == k
        g, w, c, tot = gram[m], which[m], n[m].astype(float), total[m].astype(float)
        ctx, cu = np.unique(g >> BITS, return_inverse=True)
        mass = np.maximum(c - d[w], 0) / tot
        back = 1 - np.bincount(cu * size + w, weights=mass, minlength=len(ctx) * size).reshape(len(ctx), size)
        back = np.maximum(back, 1e-9)
        model["contexts"][k] = _sorted(ctx, np.log2(back).astype(np.float32))
        keys, ku = np.unique(g, return_inverse=True)
        own = np.bincount(ku * size + w, weights=mass, minlength=len(keys) * size).reshape(len(keys), size)
        lower = 2.0 ** log_prob(model, k - 1, keys & ((1 << (BITS * (k - 1))) - 1)).astype(float)
        p = own + back[np.searchsorted(ctx, keys >> BITS)] * lower
        model["grams"][k] = _sorted(keys, np.log2(np.maximum(p, 1e-30)).astype(np.float32))
    return model


def entropies(model: dict, lut: np.ndarray, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bits a character of each row under each language, characters)."""
    row, key = grams(lut, arr)
    n = np.bincount(row, minlength=len(arr))
    bits = np.zeros((len(arr), len(model["langs"])))
    if len(key) and model["langs"]:
        full = np.flatnonzero(n)
        bits[full] = -np.add.reduceat(log_prob(model, ORDER, key), (np.cumsum(n) - n)[full], axis=0, dtype=float)
    return bits / np.maximum(n, 1)[:, None], n


def _save(part: dict, f) -> dict:
    """part with (offset, type, shape) in f for each array."""
    out = dict(part)
    for kind in ("grams", "contexts"):
        out[kind] = {}
        for k, t in part[kind].items():
            out[kind][k] = t = dict(t)
            for name in ("hash", "values", "start"):
                x = np.ascontiguousarray(t[name])
                f.write(b"\0" * (-f.tell() % 64))
                t[name] = (f.tell(), x.dtype.str, x.shape)
                f.write(x.tobytes())
    return out


def _mapped(model: dict, path: str) -> dict:
    """The model with the arrays of the file, mapped rather than read."""

    def array(at: tuple) -> np.ndarray:
        offset, kind, shape = at
        return np.memmap(path, kind, "r", offset, shape).view(np.ndarray) if all(shape) else np.zeros(shape, kind)

    def opened(part: dict) -> dict:
        return part | {kind: {k: t | {x: array(t[x]) for x in ("hash", "values", "start")} for k, t in part[kind].items()} for kind in ("grams", "contexts")}

    return model | {"parts": [opened(x) for x in model["saved"]]}


def _score(saved: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model, lut = _mapped(saved, SparkFiles.get(os.path.basename(saved["path"]))), letters()
    for batch in batches:
        for p in pieces(batch, "text", 1 << 19):
            bits, n = entropies(model, lut, column(p, "text"))
            none = n == 0
            best = bits.argmin(1)
            two = np.sort(bits, 1)[:, :2]
            cols = [pa.array(np.take(model["langs"], best), pa.string(), mask=none), pa.array(two[:, 0], mask=none), pa.array(two[:, -1] - two[:, 0], mask=none), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([column(p, "doc_id"), column(p, "label"), *cols], ["doc_id", "label", "best", "bits", "margin", "letters"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model of all labelled documents; its file stays until the driver ends."""
    counts = count_tables(docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")))
    base = counts.filter("level < 3").toArrow()  # a row a language and order, or a pair of characters
    langs = sorted(pc.unique(base["lang"]).to_pylist())
    if not langs:
        return {"langs": langs}
    many = counts.filter("level >= 3")
    parts = max(1, -(-many.count() // PART_ROWS))
    folder = tempfile.mkdtemp(prefix="bitloom-")
    atexit.register(shutil.rmtree, folder, True)
    path, saved = os.path.join(folder, f"langid-{uuid.uuid4().hex}"), []
    with open(path, "wb") as f:
        for i in range(parts):
            own = many.filter(_part(F.col("gram"), parts) == i).toArrow()
            saved.append(_save(build(pa.concat_tables([base, own.cast(base.schema)]), langs), f))
    return _mapped({"langs": langs, "path": path, "saved": saved}, path)


def identify(docs: DataFrame, model: dict | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, bits, margin): the language or "und", its cross-entropy and the next one's excess."""
    model = train(docs, text_col, lang_col) if model is None else model
    spark = docs.sparkSession
    if not model["langs"]:
        null = F.lit(None).cast("double")
        return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.lit(UNKNOWN).alias("lang"), null.alias("bits"), null.alias("margin"))
    spark.sparkContext.addFile(model["path"])
    saved = {k: model[k] for k in ("langs", "path", "saved")}
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    scored = slim.mapInArrow(functools.partial(_score, saved), "doc_id bigint, label string, best string, bits double, margin double, letters bigint")
    scored = materialize(scored, "scored")
    spread = scored.filter("best = label").groupBy(F.col("best").alias("of")).agg(F.percentile_approx("bits", F.array(F.lit(0.5), F.lit(0.84)), F.lit(1000)).alias("q"))
    limit = {r[0]: (r[1][0], max(r[1][1] - r[1][0], LEAST_SPREAD)) for r in spread.collect()}  # a row a language
    if not limit:
        return scored.select("doc_id", F.coalesce("best", F.lit(UNKNOWN)).alias("lang"), F.round("bits", 4).alias("bits"), F.round("margin", 4).alias("margin"))
    mid = F.create_map(*[F.lit(x) for k, v in limit.items() for x in (k, v[0])])[F.col("best")]
    wide = F.create_map(*[F.lit(x) for k, v in limit.items() for x in (k, v[1])])[F.col("best")]
    beyond = F.col("bits") > mid + SPREADS * wide * (1 + SHORT / F.sqrt("letters"))
    lang = F.when(F.col("best").isNull() | F.coalesce(beyond, F.lit(False)), UNKNOWN).otherwise(F.col("best"))
    return scored.select("doc_id", lang.alias("lang"), F.round("bits", 4).alias("bits"), F.round("margin", 4).alias("margin"))
