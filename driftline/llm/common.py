"""Shared storage and small helpers for the corpus operators."""

from __future__ import annotations

import atexit
import functools
import hashlib
import io
import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in this one process (tests) is a temporary folder made and set;
    on a cluster executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="driftline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; it is deleted when the driver's Python ends."""
    path = f"{shared_root(spark)}/driftline-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, path)
    return path


def _filesystem(path: str):
    """(filesystem, path in it); ``None`` stands for the local one."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return None, url.path or path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def remove(path: str) -> None:
    """Delete a folder made by :func:`scratch`; it may be gone already."""
    import shutil

    fs, p = _filesystem(path)
    if fs is None:
        shutil.rmtree(p, ignore_errors=True)
        return
    try:
        fs.delete_dir(p)
    except OSError:
        pass


def put(path: str, data) -> None:
    """Write a whole file so that readers see all of it or nothing.

    Retried and speculative tasks write the same bytes, so the last rename may win.
    """
    fs, p = _filesystem(path)
    if fs is None:
        os.makedirs(os.path.dirname(p), exist_ok=True)
        part = f"{p}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, p)
        return
    fs.create_dir(os.path.dirname(p), recursive=True)
    part = f"{p}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, p)


def exists(path: str) -> bool:
    fs, p = _filesystem(path)
    if fs is None:
        return os.path.exists(p)
    return fs.get_file_info(p).type.name != "NotFound"


def local_path(path: str) -> str:
    """A path that can be memory-mapped: the file itself, or this machine's copy of a remote one.

    Workers of a machine share a copy: it is made under a name that follows from the path and shows up
    whole.  The worker that made it deletes it at its end; others keep what they have mapped, or copy again.
    """
    fs, p = _filesystem(path)
    if fs is None:
        return p
    copy = os.path.join(tempfile.gettempdir(), "driftline-" + hashlib.sha256(path.encode()).hexdigest())
    if not os.path.exists(copy):
        part = f"{copy}.{uuid.uuid4().hex}"
        with fs.open_input_stream(p) as src, open(part, "wb") as dst:
            while block := src.read(1 << 24):
                dst.write(block)
        os.replace(part, copy)
        atexit.register(lambda: os.path.exists(copy) and os.unlink(copy))
    return copy


def put_array(path: str, array) -> None:
    import numpy as np

    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    put(path, out.getbuffer())


def map_array(path: str):
    """A read-only, memory-mapped array written by :func:`put_array`."""
    import numpy as np

    p = local_path(path)
    try:
        return np.load(p, mmap_mode="r", allow_pickle=False)
    except ValueError:  # an empty array can't be mapped
        return np.load(p, allow_pickle=False)


def release() -> None:
    """Hand freed memory back to the system, as far as the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """A task's function that releases memory at its end: workers are reused, and so would be all they once took."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def spool(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """A number of shuffle partitions that grows with the rows and is never below the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str = "text"):
    """The text column; a null text counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))
