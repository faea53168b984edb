"""The whole feature bank of online rows, in one plan."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators import blocks
from driftline.operators.features import WINDOWS


def feature_bank(series: DataFrame, widths=WINDOWS) -> DataFrame:
    """(id, t, features...) for every online row.

    As column expressions the 200 features were one plan that took minutes to compile; ``blocks`` makes them in NumPy,
    many series at once. The window by id puts a series' rows together and in order, history first, on the partitioning
    the series were numbered on, so nothing is shuffled for it; its number is what keeps it in the plan.
    """
    at = F.when(F.col("period") == 1, F.col("time") - 1).otherwise(F.col("t")).cast("long")
    rows = series.filter("period in (1, 2)").select(F.col("id").cast("long").alias("id"), F.col("period").cast("int").alias("period"), at.alias("t"), F.col("x").cast("double").alias("x"))
    ordered = rows.withColumn("number", F.row_number().over(Window.partitionBy("id").orderBy("period", "t")))
    names = blocks.columns(widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return blocks.bank(batches, widths, names)

    return ordered.mapInArrow(run, "id long, t long, " + ", ".join(f"{c} double" for c in names))
