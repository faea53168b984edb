"""The per-step cross-sectional AUC and its relatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.ranks import with_cell


def step_auc(scores: DataFrame, *by: str) -> DataFrame:
    """Per step t (and ``by``): n_pos, n_neg, auc, weight of ``scores(t, score, y)``.

    The Mann-Whitney statistic from average ranks, so pairs are never formed.  A step is ranked in cells of its
    scores, each by itself; a positive is above all rows of the lower cells, so the cells' sums add up and no task
    holds a whole step.  Steps with one class have no row.
    """
    keys = [*by, "t"]
    cells = with_cell(scores, "score")
    order, tie = Window.partitionBy(*keys, "_cell").orderBy("score"), Window.partitionBy(*keys, "_cell", "score")
    rank = F.rank().over(order) + (F.count("*").over(tie) - 1) / F.lit(2.0)
    pos = F.col("y") == 1
    sums = cells.withColumn("r", rank).groupBy(*keys, "_cell").agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"), F.coalesce(F.sum(F.when(pos, F.col("r"))), F.lit(0.0)).alias("r"))
    lower = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("r", F.col("r") + F.col("p") * F.coalesce(F.sum(F.col("p") + F.col("n")).over(lower), F.lit(0)))
    sums = sums.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum("r").alias("r")).filter("n_pos > 0 and n_neg > 0")
    auc = (F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / F.lit(2.0)) / (F.col("n_pos") * F.col("n_neg"))
    return sums.select(*keys, "n_pos", "n_neg", auc.alias("auc"), (F.col("n_pos") * F.col("n_neg")).alias("weight"))


def ts_auc(scores: DataFrame, *by: str) -> DataFrame:
    """The steps' AUC weighted by their numbers of pairs; 0.5 if no step has both classes."""
    steps = step_auc(scores, *by)
    value = F.coalesce(F.sum(F.col("weight") * F.col("auc")) / F.sum("weight"), F.lit(0.5)).alias("ts_auc")
    return steps.groupBy(*by).agg(value, F.coalesce(F.sum("weight"), F.lit(0)).alias("pairs"))


def snapshot_auc(scores: DataFrame, steps: list[int]) -> DataFrame:
    """Unweighted AUC at a grid of steps."""
    return step_auc(scores.filter(F.col("t").isin(steps))).select("t", "auc")


def untied_auc(scores: DataFrame, steps: list[int]) -> DataFrame:
    """AUC in which positives stand first among equal scores, and equal ones in order of id."""
    w = Window.partitionBy("t").orderBy("score", F.desc("y"), "id")
    rows = scores.filter(F.col("t").isin(steps)).withColumn("r", F.row_number().over(w))
    sums = rows.groupBy("t").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n"), F.sum(F.when(F.col("y") == 1, F.col("r"))).alias("r"))
    return sums.filter("p > 0 and n > 0").select("t", ((F.col("r") - F.col("p") * (F.col("p") + 1) / F.lit(2.0)) / (F.col("p") * F.col("n"))).alias("auc"))


def step_balance(labels: DataFrame) -> DataFrame:
    """Per step: series alive, positives, negatives and their product."""
    out = labels.groupBy("t").agg(F.count("*").alias("alive"), F.sum("target").alias("n_pos"))
    return out.select("t", "alive", "n_pos", (F.col("alive") - F.col("n_pos")).alias("n_neg"), (F.col("n_pos") * (F.col("alive") - F.col("n_pos"))).alias("weight"))


def ramp_weight(labels: DataFrame, ramp: int = 50, floor: float = 0.2, keep: tuple[str, ...] = ()) -> DataFrame:
    """Training weights: positives rise from ``floor`` to 1 within ``ramp`` steps after the break; columns named in ``keep`` stay."""
    rise = F.least(F.lit(1.0), F.greatest(F.lit(floor), (F.col("t") - F.col("tau_index")) / F.lit(float(ramp))))
    return labels.select("id", "t", *keep, "target", F.when(F.col("target") == 1, rise).otherwise(1.0).alias("weight"))


def metric_weight(labels: DataFrame) -> DataFrame:
    """Training weights by the step's number of pairs, their mean scaled to 1."""
    pairs = labels.groupBy("t").agg((F.sum("target") * (F.count("*") - F.sum("target"))).cast("double").alias("pairs"), F.count("*").alias("rows"))
    mean = pairs.agg((F.sum(F.col("pairs") * F.col("rows")) / F.sum("rows")).alias("mean"))
    scaled = pairs.join(F.broadcast(mean)).select("t", F.coalesce(F.try_divide("pairs", "mean"), F.lit(0.0)).alias("weight"))  # one row
    return labels.select("id", "t", "target").join(scaled, "t").select("id", "t", "target", "weight")


def first_positive(labels: DataFrame) -> DataFrame:
    """The break step repeated on every row of its series."""
    w = Window.partitionBy("id")
    return labels.select("id", "t", F.min(F.when(F.col("target") == 1, F.col("t"))).over(w).alias("tau"))


def fold(df: DataFrame, k: int = 5) -> DataFrame:
    """Folds by series."""
    return df.withColumn("fold", F.pmod("id", F.lit(k)))


def hold_out(df: DataFrame, share: int = 5, seed: int = 42) -> DataFrame:
    """A share of the series, chosen by a hash."""
    return df.withColumn("held_out", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(share)) == 0)
