"""Tables and files that all executors share: everything goes below spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local run (as in tests) gets a folder of its
    own; elsewhere no folder is shared for certain, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="isochron-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/isochron-{uuid.uuid4().hex}"


#: Bytes and rows in the batches that workers get, and fewer where the session says so: the JVM and the worker each
#: hold a whole batch, and texts are long.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches. What an operator returns runs later, so the bounds stay."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = re.fullmatch(r"([1-9]\d*)b?", spark.conf.get(name).strip().lower())
        if not now or int(now[1]) > most:
            spark.conf.set(name, str(most))


def _stored(df: DataFrame, compression: str | None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    folder = shared_folder(spark)
    small_batches(spark)
    (df.write.option("compression", compression) if compression else df.write).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: computed once, and safe when an executor is lost."""
    return _stored(df, compression)[0]


@contextmanager
def scratch(df: DataFrame, compression: str | None = None) -> Iterator[DataFrame]:
    """`written` for the length of a block; then its files go. What is made of it must be written within the block."""
    table, folder = _stored(df, compression)
    yield table
    fs, path = open_fs(folder)
    fs.delete_dir(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a folder that Spark names by path or URI."""
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    if m := re.match(r"file:/+", uri):
        return pafs.LocalFileSystem(), "/" + uri[m.end() :]
    return pafs.FileSystem.from_uri(uri)
