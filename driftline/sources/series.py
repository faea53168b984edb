"""Series tables: ``(id, time, x, period, t)`` with a calibration and an online segment.

``period`` is 1 in the break-free history and 2 online; ``t`` counts online rows from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUANTITY_HISTORY = 360
EVENT_HISTORY = 32
QUANTITY_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


def scan(spark: SparkSession, sf_dir: str, table: str, columns: list[str] | None = None, ids: tuple[str, list] | None = None) -> DataFrame:
    """A Parquet scan; columns and an id subset ``(column, values)`` reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if ids:
        df = df.filter(F.col(ids[0]).isin(ids[1]))
    return df.select(*columns) if columns else df


def split(df: DataFrame, history: int) -> DataFrame:
    """Cut series ``(id, time, x)`` after ``history`` rows."""
    online = F.col("time") > history
    return df.withColumns({"period": F.when(online, 2).otherwise(1), "t": F.when(online, F.col("time") - F.lit(history + 1).cast("bigint"))})


def numbered(df: DataFrame, id_: str, order: tuple[str, ...], x: Column) -> DataFrame:
    """Rows in order by series; the id has its name before the window, else Spark takes what is grouped by it later for another partitioning."""
    w = Window.partitionBy("id").orderBy(*order)
    return df.withColumn("id", F.col(id_)).select("id", F.row_number().over(w).cast("bigint").alias("time"), x.alias("x"))


def series_q(spark: SparkSession, sf_dir: str, history: int = QUANTITY_HISTORY) -> DataFrame:
    """Quantities by supplier: long series of whole numbers."""
    rows = scan(spark, sf_dir, "lineitem", ["l_suppkey", *QUANTITY_ORDER])
    return split(numbered(rows, "l_suppkey", QUANTITY_ORDER, F.col("l_quantity").cast("double")), history)


def series_e(spark: SparkSession, sf_dir: str, history: int = EVENT_HISTORY) -> DataFrame:
    """Event values in hundredths by user: short streams."""
    rows = scan(spark, sf_dir, "events", ["user_id", "event_id", "value"])
    return split(numbered(rows, "user_id", ("event_id",), F.round(F.col("value") * 100).cast("bigint").cast("double")), history)


def history(series: DataFrame) -> DataFrame:
    """Calibration rows as ``(id, t, x)``, t from 0."""
    return series.filter("period = 1").select("id", (F.col("time") - 1).alias("t"), "x")


def online(series: DataFrame) -> DataFrame:
    return series.filter("period = 2").select("id", "t", "x")


def breaks(series: DataFrame) -> DataFrame:
    """Where each series breaks, ``(id, tau_index)``; null: nowhere.  A rule stands in for an index file."""
    tau = F.when(F.col("id") % 2 == 0, F.lit(60) + F.pmod(F.col("id") * 37, F.lit(120)))
    return series.select("id").distinct().select("id", tau.cast("bigint").alias("tau_index"))


def labelled(series: DataFrame) -> DataFrame:
    """Online rows ``(id, t, x, tau_index, target)``; target is 1 from the break on."""
    return with_labels(online(series))


def with_labels(rows: DataFrame) -> DataFrame:
    """Rows ``(id, t, ...)`` with their tau_index and target, which follow from id and t: nothing is joined."""
    tau = F.when(F.col("id") % 2 == 0, F.lit(60) + F.pmod(F.col("id") * 37, F.lit(120))).cast("bigint")
    return rows.withColumn("tau_index", tau).withColumn("target", F.coalesce(F.col("t") >= F.col("tau_index"), F.lit(False)).cast("int"))


def scores_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and targets ``(id, t, score, y)`` of the event stream."""
    rows = scan(spark, sf_dir, "events", ["user_id", "event_id", "value", "event_type"])
    w = Window.partitionBy("user_id").orderBy("event_id")
    return rows.select(
        F.col("user_id").alias("id"), (F.row_number().over(w) - 1).cast("bigint").alias("t"), F.round(F.col("value") * 100).cast("bigint").cast("double").alias("score"), (F.col("event_type") == "error").cast("int").alias("y")
    )


def nested(series: DataFrame) -> DataFrame:
    """One row a series, ``(id, x_hist, x_online)``, for operators that need it whole.  Bounded by a series' length."""
    sorted_ = F.array_sort(F.collect_list(F.struct("time", "x", "period")))
    rows = series.groupBy("id").agg(sorted_.alias("r"))
    pick = lambda p: F.transform(F.filter("r", lambda e: e["period"] == p), lambda e: e["x"])
    return rows.select("id", pick(1).alias("x_hist"), pick(2).alias("x_online"))


def write_matrix(df: DataFrame, path: str, shards: int) -> None:
    """Write a feature matrix partitioned by ``pmod(id, shards)``: no merging or sorting afterwards."""
    df.withColumn("shard", F.pmod("id", F.lit(shards))).repartition(shards, "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("shard")


def write_report(df: DataFrame, path: str) -> None:
    """A small report as CSV with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def describe_file(df: DataFrame) -> DataFrame:
    """Rows and columns of a table, from Parquet's metadata where that suffices."""
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"))


def describe_columns(df: DataFrame) -> DataFrame:
    """(position, name, type) of a table's columns, from its metadata."""
    rows = [(k, f.name, f.dataType.simpleString()) for k, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")
