"""The folder that driver and executors share, and tables kept in it.

A cluster names that folder in ``spark.checkpoint.dir``.  Where it is unset and the session is local (tests on one machine) a
temporary folder is made and set.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder of this session; an error on a cluster that names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cellmesh-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_HELD: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders made in here go at the end: for intermediate tables of a result that is stored with ``keep``."""
    held: list[str] = []
    _HELD.append(held)
    try:
        yield
    finally:
        _HELD.remove(held)
        for uri in held:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, what: str, keep: bool = False) -> str:
    """URI of a new empty folder in the shared one; it goes with the :func:`scratch` around it, or when the session's JVM ends."""
    uri = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    if _HELD and not keep:
        _HELD[-1].append(uri)
    return path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While jobs run in here, Arrow batches have at most so many rows: for rows of several kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stash(df: DataFrame, what: str, rows: int = 2000, keep: bool = False) -> DataFrame:
    """``df`` written to a table in the shared folder and read again.

    Cuts lineage: a lost executor costs a re-read, not a recomputation.  ``rows``: of an Arrow batch, if it runs Python.
    """
    uri = f"{new_folder(df.sparkSession, what, keep)}/t"
    with batch_rows(df.sparkSession, rows):
        df.write.option("compression", "zstd").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def local_path(uri: str) -> str | None:
    """The path of ``uri`` where the shared folder is mounted; None in other stores."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def filesystem(uri: str):
    """``(pyarrow file system, path)`` for a URI, for use in Python workers."""
    from pyarrow import fs

    if (path := local_path(uri)) is not None:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, payload) -> None:
    """Write bytes under a private name, then move: a retried task replaces the file whole."""
    fs, path = filesystem(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(payload)
    fs.move(part, path)


def map_file(uri: str):
    """A memory map of a file: in place where the folder is mounted, else of a copy that has no name any more."""
    import mmap

    path, handle = local_path(uri), None
    if path is None:
        fs, remote = filesystem(uri)
        handle = tempfile.TemporaryFile()
        with fs.open_input_stream(remote) as src:
            while piece := src.read(8 << 20):
                handle.write(piece)
        handle.flush()
    else:
        handle = open(path, "rb")
    with handle:
        size = os.fstat(handle.fileno()).st_size
        return mmap.mmap(handle.fileno(), size, access=mmap.ACCESS_READ) if size else b""
