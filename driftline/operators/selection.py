"""Rows, columns and pairs picked out of tables: projections, samples, lookups, window pulls, per-owner statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---- columns


def projected(df: DataFrame, drop: tuple[str, ...] = (), keep: str | None = None, always: tuple[str, ...] = ("id", "t")) -> DataFrame:
    """The columns outside ``drop`` whose whole name matches ``keep``, and the keys."""
    chosen = [c for c in df.columns if c not in always and c not in drop and (keep is None or re.fullmatch(keep, c))]
    return df.select(*always, *chosen)


def of_version(df: DataFrame, versions: dict[str, list[str]], version: str, always: tuple[str, ...] = ("id", "t")) -> DataFrame:
    """The columns that a named version of a feature list holds; its blocks may repeat a name, the first one counts."""
    return df.select(*always, *dict.fromkeys(versions[version]))


# ---- rows


def long_enough(series: DataFrame, history: int, online: int) -> DataFrame:
    """Series with at least so many rows before and in the online segment."""
    whole = Window.partitionBy("id")
    counted = series.withColumns({"_h": F.count_if(F.col("period") == 1).over(whole), "_o": F.count_if(F.col("period") == 2).over(whole)})
    return counted.filter((F.col("_h") >= history) & (F.col("_o") >= online)).drop("_h", "_o")


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null, NaN or infinite."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return df


def globally_numbered(df: DataFrame, name: str = "position") -> DataFrame:
    """Row numbers from 0 in order of (id, t), on two levels: numbers in a series plus the rows of smaller ids.

    Only the table of one row a series is put in one order.
    """
    sizes = df.groupBy("id").agg(F.count("*").alias("_n"))
    before = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("id").orderBy("t")) - 1
    return df.withColumn("_own", own).join(starts, "id").withColumn(name, F.col("_first") + F.col("_own")).drop("_own", "_first")


def strided(df: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row in order of (id, t)."""
    return globally_numbered(df, "_p").filter(F.col("_p") % step == 0).drop("_p")


def scattered() -> Column:
    """A number from 0 to 1,000,002 that scatters (id, t); SQL can say it as well."""
    return F.pmod(F.col("id") * 7919 + F.col("t") * 104729, F.lit(1_000_003))


def balanced(df: DataFrame, label: str, each: int) -> DataFrame:
    """``each`` rows of every class, the first by :func:`scattered`; tasks keep no more than that before the shuffle."""
    order = Window.partitionBy(label).orderBy(scattered(), "id", "t")
    return df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= each).drop("_k")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): counts of equal bins; values outside count with the nearest."""
    at = F.floor((F.col(column) - low) / ((high - low) / bins))
    return df.groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, columns: list[str], at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(statistic, n, p5, ...): interpolated percentiles of each column's finite values."""
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).select("e.*")
    q = finite(flat, "v").groupBy("statistic").agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, at))).alias("q"))
    return q.select("statistic", "n", *[F.col("q")[k].alias(f"p{round(100 * p)}") for k, p in enumerate(at)])


# ---- lookups and joins


def unmatched(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """(rows, matched, missing): how many keys the table has; a full match has none missing."""
    found = keys.select(*on).join(table.select(*on).distinct().withColumn("_there", F.lit(1)), on, "left")
    return found.agg(F.count("*").alias("rows"), F.count("_there").alias("matched"), F.count_if(F.col("_there").isNull()).alias("missing"))


def lookup(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """The table's rows of the given keys; a key without one is an error that names some."""
    lost = keys.join(table.select(*on), on, "left_anti").limit(3).collect()  # three keys for the message
    if lost:
        raise KeyError(f"no row for {[tuple(r) for r in lost]}")
    return keys.join(table, on)


def trailing_pull(rows: DataFrame, steps: list[int], width: int) -> DataFrame:
    """(id, step, t, x): the values of ``rows(id, t, x)`` at t from step - width to step - 1, for each step of a small grid.

    A row goes to the grid steps that need it and to no others, so nothing is joined.
    """
    grid = F.array(*[F.lit(s).cast("long") for s in steps])
    return rows.select("id", F.explode(F.filter(grid, lambda s: (F.col("t") < s) & (F.col("t") >= s - width))).alias("step"), "t", "x")


def owner_z(windows: DataFrame, null: DataFrame, value: str) -> DataFrame:
    """``windows(owner, value, ...)`` with value_z, in units of its owner's null windows.

    Two or more null windows give mean and standard deviation, one gives the mean; none leaves the value as it is.
    """
    stats = null.groupBy("owner").agg(F.count("*").alias("_n"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    joined = windows.join(stats, "owner", "left")
    centre = F.coalesce("_m", F.lit(0.0))
    spread = F.when(F.col("_n") >= 2, F.col("_s") + 1e-9).otherwise(1.0)
    return joined.withColumn(f"{value}_z", (F.col(value) - centre) / spread).drop("_n", "_m", "_s")


# ---- embeddings by kind


def by_kind(vectors: DataFrame, kinds: list[str]) -> DataFrame:
    """One row a sid with a column of vectors per kind, from ``vectors(sid, kind, v)``; sids that lack a kind go."""
    wide = vectors.groupBy("sid").agg(*[F.max(F.when(F.col("kind") == k, F.col("v"))).alias(k) for k in kinds])
    return wide.dropna(subset=kinds)


def difference_vector(*pairs: tuple[str, str]) -> Column:
    """The differences of vector pairs, one after the other."""
    return F.concat(*[F.zip_with(a, b, lambda x, y: x - y) for a, b in pairs])


def pooled_max(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, i, v): element-wise maximum of vectors."""
    return vectors.select(by, F.posexplode(vector).alias("i", "v")).groupBy(by, "i").agg(F.max(F.col("v").cast("double")).alias("v"))


# ---- correlations


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of every pair of columns, all from one aggregate."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}/{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}/{b}`").alias("r")) for a, b in pairs])).alias("e")).select("e.*")
