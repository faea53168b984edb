"""Index and target files, member caches, model folders, weight tables and file metadata."""

from __future__ import annotations

import atexit
import base64
import gc
import io
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table that is read more than once, written to the shared folder (``spark.checkpoint.dir``) and read again.

    Spark is asked to collect its garbage, and may then drop the shuffles it took; measured at size they stayed
    (README).  The table is deleted when the driver's Python ends.  Where the folder is unset (one process, no cluster) it's a temporary one.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="driftline-")
    path = f"{root.rstrip('/')}/driftline-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # a shuffle's files go some time after nothing refers to it
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    except Exception:  # the session may have ended, and a local folder goes without it
        shutil.rmtree(urlparse(path).path, ignore_errors=True)


def load_index(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(id, tau_index) of ``{root}/y_{split}_index.parquet``; no break (-1 or null) is null."""
    df = spark.read.parquet(f"{root}/y_{split}_index.parquet")
    tau = F.col("tau_index").cast("long")
    return df.select(F.col("id").cast("long").alias("id"), F.when(tau >= 0, tau).alias("tau_index"))


def load_targets(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(id, t, target) of ``{root}/y_{split}.parquet``, whose rows are (id, time, target); t counts a series' rows from 0."""
    df = spark.read.parquet(f"{root}/y_{split}.parquet")
    first = F.min("time").over(_series())
    return df.select(F.col("id").cast("long").alias("id"), (F.col("time") - first).cast("long").alias("t"), F.col("target").cast("int").alias("target"))


def _series():
    from pyspark.sql import Window

    return Window.partitionBy("id")


def from_datasets(spark: SparkSession, datasets: Iterable[tuple]) -> DataFrame:
    """The series table of an iterable of (id, x_hist, x_online) or (id, x_hist, x_online, tau); a feed of the caller's, so its size is the caller's memory."""
    rows = []
    for i, hist, online, *_ in datasets:
        h = len(hist)
        rows += [(int(i), k + 1, float(x), 1, None) for k, x in enumerate(hist)] + [(int(i), h + k + 1, float(x), 2, k) for k, x in enumerate(online)]
    return spark.createDataFrame(rows, "id long, time long, x double, period int, t long")


def append_logits(scores: DataFrame, path: str, member: str) -> None:
    """Add a member's (id, t, logit) to a cache, one folder a member; written again it replaces the member's."""
    scores.select("id", "t", "logit").write.mode("overwrite").parquet(f"{path}/member={member}")


def read_logits(spark: SparkSession, path: str, members: list[str]) -> DataFrame:
    """(id, t, one column a member) from a cache; rows that a member lacks are null there."""
    rows = spark.read.parquet(path).filter(F.col("member").isin(members))
    return rows.groupBy("id", "t").pivot("member", members).agg(F.first("logit"))


def save_model(model, path: str, meta: dict) -> None:
    """A fitted MLlib model in ``{path}/model`` with its metadata as one JSON row beside it."""
    from pyspark.sql import SparkSession as Session

    model.write().overwrite().save(f"{path}/model")
    spark = Session.getActiveSession()
    spark.createDataFrame([(json.dumps(meta | {"class": f"{type(model).__module__}.{type(model).__name__}"}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[object, dict]:
    from importlib import import_module

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    module, name = meta["class"].rsplit(".", 1)
    return getattr(import_module(module), name).load(f"{path}/model"), meta


def pack_weights(weights: dict[str, np.ndarray]) -> str:
    """Named arrays as one base64 string, to be embedded or kept in a table."""
    out = io.BytesIO()
    np.savez(out, **weights)
    return base64.b64encode(out.getvalue()).decode("ascii")


def unpack_weights(text: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(base64.b64decode(text)), allow_pickle=False) as data:
        return {k: data[k] for k in data.files}


def write_weights(spark: SparkSession, path: str, name: str, weights: dict[str, np.ndarray]) -> None:
    spark.createDataFrame([(pack_weights(weights),)], "weights string").coalesce(1).write.mode("overwrite").parquet(f"{path}/name={name}")


def read_weights(spark: SparkSession, path: str, name: str) -> dict[str, np.ndarray]:
    """One network's weights; they go to the workers with the function that uses them."""
    return unpack_weights(spark.read.parquet(path).filter(F.col("name") == name).first()["weights"])


def row_groups(path: str) -> dict[str, int]:
    """Rows, columns and row groups from a local Parquet file's footer alone."""
    from pyarrow import parquet

    meta = parquet.ParquetFile(path).metadata
    return {"rows": meta.num_rows, "columns": meta.num_columns, "row_groups": meta.num_row_groups}
