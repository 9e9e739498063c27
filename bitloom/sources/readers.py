"""Sources by name: the first registered name that is part of the normalised path reads it."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.functions.media import chunk_wav, patches
from bitloom.operators.text import BLANK, budget_take, clean, join_keys, lang_from_name
from bitloom.session import materialize

_READERS: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        _READERS[name] = f
        return f

    return add


def load(spark: SparkSession, path: str, n: int | None = None, skip: int = 0) -> DataFrame:
    low = path.lower().replace("-", "_")
    for name, f in _READERS.items():
        if name in low:
            return f(spark, path, n, skip)
    raise ValueError(f"no source for {path}; there are {', '.join(_READERS)}")


def _numbered(df: DataFrame) -> DataFrame:
    """record: the number of every row by file and place in it. Rows are counted within blocks of files and over the blocks, so that no task holds all.

    Within a block, rows come in their order, which monotonically_increasing_id() numbers; blocks are ordered by file and start."""
    at = df.select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("start_"), F.monotonically_increasing_id().alias("line_"))
    at = materialize(at, "records")
    blocks = at.groupBy("file_", "start_").agg(F.min("line_").alias("first_"), F.count("*").alias("n_"))  # a row a block
    lead = blocks.select("file_", "start_", "first_", (F.sum("n_").over(Window.orderBy("file_", "start_")) - F.col("n_")).alias("lead_"))
    w = Window.partitionBy("file_", "start_").orderBy("line_")
    return at.withColumn("own_", F.row_number().over(w) - 1).join(F.broadcast(lead), ["file_", "start_"]).select(*df.columns, (F.col("own_") + F.col("lead_")).alias("record"))


def table_texts(spark: SparkSession, path: str, keys: list[str], n: int | None = None, skip: int = 0) -> DataFrame:
    """(record, text): rows skip to skip + n by file and place, counted before blank texts go; a missing key is an error."""
    df = _numbered(spark.read.parquet(path).select(*keys)).filter(F.col("record") >= skip)
    df = df if n is None else df.filter(F.col("record") < skip + n)
    return clean(df.select("record", join_keys(df, keys).alias("text")))


def json_lines(spark: SparkSession, path: str, keys: list[str], n: int | None = None, skip: int = 0) -> DataFrame:
    """(record, text). Blank lines don't count; skip counts lines before they are parsed; n counts texts kept; bad lines go, and so do those without a key."""
    lines = _numbered(spark.read.text(path).filter(F.regexp_replace("value", BLANK, "") != "")).filter(F.col("record") >= skip)
    kept = clean(lines.select("record", F.concat(*[F.get_json_object("value", f"$.{k}") for k in keys]).alias("text")))
    return kept if n is None else kept.orderBy("record").limit(n)


register_source("enwiki")(lambda s, p, n, k: table_texts(s, p, ["text"], n, k))
register_source("cosmopedia")(lambda s, p, n, k: table_texts(s, p, ["text"], n, k))
register_source("code")(lambda s, p, n, k: json_lines(s, p, ["code"], n, k))


def files(spark: SparkSession, path: str, extensions: list[str], n: int | None = None) -> DataFrame:
    """(path, length, content) of the files with one of the extensions in either case, in the order of their paths."""
    ends = "".join(f"{e.lower()},{e.upper()}," for e in extensions).strip(",")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{ends}}}").load(path).select("path", "length", "content")
    if df.isEmpty():
        raise FileNotFoundError(f"no {ends} file in {path}")
    return df if n is None else df.orderBy("path").limit(n)


def _audio(chunk_ms: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(p, i, c) for p, x in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True) for i, c in enumerate(chunk_wav(x.as_py(), chunk_ms))]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.string(), pa.int32(), pa.binary()))], ["path", "chunk_idx", "data"])


def audio_chunks(audio: DataFrame, chunk_ms: int = 1000) -> DataFrame:
    return audio.select("path", "content").mapInArrow(functools.partial(_audio, chunk_ms), "path string, chunk_idx int, data binary")


_PATCH = "path string, index int, x int, y int, width int, height int, data binary"


def _image(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p, x in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            yield pa.RecordBatch.from_pylist([{"path": p, **r} for r in patches(x.as_py(), size)], pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ("index", "x", "y", "width", "height")), ("data", pa.binary())]))


def image_patches(images: DataFrame, size: int = 32) -> DataFrame:
    return images.select("path", "content").mapInArrow(functools.partial(_image, size), _PATCH)


def code_budget(rows: DataFrame, budget: int) -> DataFrame:
    """Raw source rows with language and code_bytes, up to each language's budget."""
    r = rows.withColumn("language", lang_from_name(F.col("path"))).filter("language IS NOT NULL").withColumn("code_bytes", F.octet_length("content"))
    return budget_take(r, "language", F.col("code_bytes"), ["repo_name", "path"], budget)


def write_code(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("language").json(path)


def language_summary(rows: DataFrame) -> DataFrame:
    """(language, files, code_bytes, mib) of code_budget()'s rows."""
    return rows.groupBy("language").agg(F.count("*").alias("files"), F.sum("code_bytes").alias("code_bytes"), F.round(F.sum("code_bytes") / (1 << 20), 4).alias("mib"))


def parquet_audio(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(path, content) of a table with a column audio of bytes and path."""
    df = spark.read.parquet(path).select(F.col("audio.path").alias("path"), F.col("audio.bytes").alias("content"))
    return df if n is None else df.limit(n)


def write_results(results: DataFrame, path: str) -> None:
    results.write.option("header", True).csv(path)
