"""Cross-sectional recalibration of scores or features by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import expit, normal_quantile


def step():
    return Window.partitionBy("t")


def null_stats(labels: DataFrame, value: str) -> DataFrame:
    """(t, mu0, sd0): mean and population standard deviation of unbroken rows by step."""
    return labels.filter("target = 0").groupBy("t").agg(F.avg(value).alias("mu0"), F.stddev_pop(value).alias("sd0"))


def smoothed(stats: DataFrame, width: int = 25) -> DataFrame:
    """Centred rolling means over steps, edge values repeated outside; sd below 1e-6 becomes 1.

    A step's window is joined by the offsets, clipped to the table's first and last step: the table has
    a row per step, so this is small whatever the number of series.
    """
    half = width // 2
    ends = stats.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    grid = stats.select("t").join(F.broadcast(ends)).select("t", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("k"), "lo", "hi")  # one row is broadcast
    grid = grid.select("t", F.least(F.greatest(F.col("t") + F.col("k"), F.col("lo")), F.col("hi")).alias("s"))
    near = grid.join(stats.withColumnRenamed("t", "s"), "s", "left")
    out = near.groupBy("t").agg(F.avg("mu0").alias("mu0"), F.avg("sd0").alias("sd0"))
    return out.select("t", "mu0", F.when(F.col("sd0") < 1e-6, 1.0).otherwise(F.col("sd0")).alias("sd0"))


def normalised(rows: DataFrame, stats: DataFrame, value: str, bound: float = 12.0) -> DataFrame:
    """The value in units of its step's null, clipped, as {value}__sn."""
    out = rows.join(stats, "t", "left")
    v = F.coalesce((F.col(value) - F.col("mu0")) / F.col("sd0"), F.lit(0.0))
    return out.withColumn(f"{value}__sn", F.greatest(F.lit(-bound), F.least(F.lit(bound), v))).drop("mu0", "sd0")


def average_rank(window_by, score: str = "score"):
    order, tie = Window.partitionBy(*window_by).orderBy(score), Window.partitionBy(*window_by, score)
    return F.rank().over(order) + (F.count("*").over(tie) - 1) / F.lit(2.0)


def by_rank(scores: DataFrame) -> DataFrame:
    """Average rank over n + 1 within the step."""
    return scores.withColumn("rank_norm", average_rank(["t"]) / (F.count("*").over(step()) + 1))


def by_range(scores: DataFrame) -> DataFrame:
    low, high = F.min("score").over(step()), F.max("score").over(step())
    return scores.withColumn("minmax", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.5))


def by_zscore(scores: DataFrame) -> DataFrame:
    return scores.withColumn("zscore", (F.col("score") - F.avg("score").over(step())) / F.greatest(F.stddev_pop("score").over(step()), F.lit(1e-9)))


def by_normal_quantile(scores: DataFrame) -> DataFrame:
    return by_rank(scores).withColumn("gauss", normal_quantile(F.col("rank_norm")))


def by_sigmoid(scores: DataFrame) -> DataFrame:
    stats = scores.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    return scores.join(F.broadcast(stats)).withColumn("sigmoid", expit((F.col("score") - F.col("m")) / F.greatest("s", F.lit(1e-9)))).drop("m", "s")  # one row
