"""Synthetic series with known breaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tail_degrees(kurtosis: float) -> float:
    """Student degrees of freedom with a given excess kurtosis."""
    return float(np.clip(4 + 6 / max(kurtosis, 1e-3), 4.5, 40))


def generate(spark: SparkSession, n: int, seed: int = 0, n_hist: int = 200, n_online: int = 100) -> DataFrame:
    """(id, time, x, period, tau_index) of ``n`` AR(1) series with Student noise; half of them break in mean, variance or autocorrelation.

    Each series has a generator of its own, seeded by (seed, id), so any partitioning gives the same rows.
    """

    def run(batches):
        for ids in batches:
            for i in ids.id:
                rng = np.random.default_rng([seed, int(i)])
                rho, df = rng.uniform(-0.2, 0.6), tail_degrees(rng.exponential(1.5))
                tau = int(rng.integers(0, n_online)) if i % 2 == 0 else None
                noise = rng.standard_t(df, n_hist + n_online) * np.sqrt((df - 2) / df)
                kind, x, out = int(i // 2) % 3, 0.0, np.empty(n_hist + n_online)
                for t, e in enumerate(noise):
                    broken = tau is not None and t >= n_hist + tau
                    r = min(rho + 0.3, 0.95) if broken and kind == 2 else rho
                    x = r * x + np.sqrt(1 - r * r) * e
                    out[t] = x * (1.8 if broken and kind == 1 else 1.0) + (0.8 if broken and kind == 0 else 0.0)
                h = out[:n_hist]
                out = (out - h.mean()) / max(h.std(), 1e-9)
                yield pd.DataFrame({"id": i, "time": np.arange(1, len(out) + 1), "x": out, "period": np.where(np.arange(len(out)) < n_hist, 1, 2), "tau_index": pd.array([tau] * len(out), dtype="Int64")})

    return spark.range(n).mapInPandas(run, "id long, time long, x double, period int, tau_index long")


def weighted_draw(spark: SparkSession, pool: DataFrame, n: int, weight: str, seed: int = 0) -> DataFrame:
    """``n`` rows of ``pool(id, ...)`` drawn with replacement in proportion to a weight.

    Draws and rows meet in a join on a coarse cell of the cumulative weight, then on the exact range.
    """
    from pyspark.sql import Window

    cells = 1024
    total = pool.agg(F.sum(weight).alias("total"))
    upto = F.sum(weight).over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # one row a series: the pool is small
    ranges = pool.withColumn("hi", upto).join(F.broadcast(total)).withColumns({"hi": F.col("hi") / F.col("total")})
    ranges = ranges.withColumn("lo", F.col("hi") - F.col(weight) / F.col("total")).drop("total")
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.least("hi", F.lit(1 - 1e-12)) * cells))))
    draws = spark.range(n).select(F.col("id").alias("draw"), ((F.xxhash64("id", F.lit(seed)).bitwiseAND((1 << 52) - 1)) / float(1 << 52)).alias("u"))
    draws = draws.withColumn("cell", F.floor(F.col("u") * cells))
    return draws.join(ranges, "cell").filter("u >= lo and u < hi").drop("cell", "lo", "hi", "u")


def realism(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the gap of means in real standard deviations and the ratio of standard deviations."""
    flat = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).groupBy("e.column").agg(F.avg("e.v").alias("m"), F.stddev_pop("e.v").alias("s"))
    r, s = flat(real), flat(synthetic).withColumnsRenamed({"m": "m2", "s": "s2"})
    return r.join(s, "column").select("column", (F.abs(F.col("m") - F.col("m2")) / F.greatest("s", F.lit(1e-9))).alias("gap"), (F.col("s2") / F.greatest("s", F.lit(1e-9))).alias("sd_ratio"))
