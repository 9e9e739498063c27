"""Session helpers: shared folder, materialised tables, table reading."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local master gets a folder of its own; a cluster gets an error, since a
    machine-local folder would not be seen by the other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="bitloom-")
        atexit.register(shutil.rmtree, base[7:], True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _remove(path: str) -> None:
    with contextlib.suppress(OSError):
        shutil.rmtree(path.removeprefix("file://"))


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, on whatever file system they are. Nothing may read them any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends in a table
    that survives executor loss. The write's own shuffle files are released when it has ended; the table
    stays until discard(), or until the driver ends if it is local."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bitloom-{name}-{uuid.uuid4().hex}"
    if path.startswith("file://"):
        atexit.register(_remove, path)
    before = spark.conf.get(_CLEAN_SHUFFLES, None)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_SHUFFLES)
        else:
            spark.conf.set(_CLEAN_SHUFFLES, before)
    read = spark.read.schema(df.schema).parquet(path)
    read.written_to = path
    return read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
