"""Blending and evaluating members' scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import metric
from driftline.operators.ranks import with_ranks


def z_match(scores: DataFrame, member: str, reference: str) -> DataFrame:
    """The member rescaled to the reference's mean and population standard deviation."""
    stats = scores.agg(*[f(c).alias(f"_{n}_{k}") for c, k in ((member, "m"), (reference, "r")) for f, n in ((F.avg, "mu"), (F.stddev_pop, "sd"))])
    value = (F.col(member) - F.col("_mu_m")) / F.greatest("_sd_m", F.lit(1e-9)) * F.col("_sd_r") + F.col("_mu_r")
    return scores.join(F.broadcast(stats)).withColumn(f"{member}_matched", value).drop("_mu_m", "_sd_m", "_mu_r", "_sd_r")  # one row


def frozen(scores: DataFrame, member: str, mean: float, sd: float) -> DataFrame:
    """Standardise by constants measured elsewhere."""
    return scores.withColumn(f"{member}_z", (F.col(member) - mean) / max(sd, 1e-9))


def spearman(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks over the whole table, and of the values themselves."""
    rows = with_ranks(scores, {"_ra": a, "_rb": b})
    return rows.agg(F.corr("_ra", "_rb").alias("spearman"), F.corr(a, b).alias("pearson"))


def fill_missing(scores: DataFrame, member: DataFrame, column: str) -> DataFrame:
    """Left join of a member's scores; missing ones become the member's median."""
    middle = member.agg(F.median(column).alias("_m"))
    return scores.join(member, ["id", "t"], "left").join(F.broadcast(middle)).withColumn(column, F.coalesce(column, "_m")).drop("_m")  # one row


def blend_grid(scores: DataFrame, a: str, b: str, weights: list[float]) -> DataFrame:
    """TS-AUC of (1 - w) a + w b for each weight, over all rows and both halves of the series, and whether it beats w = 0 on all three.

    The grid multiplies rows by its size, a constant, and all weights are evaluated in one plan.
    """
    grid = F.explode(F.array(*[F.lit(float(w)) for w in weights]))
    rows = scores.withColumn("w", grid).withColumn("score", (1 - F.col("w")) * F.col(a) + F.col("w") * F.col(b))
    rows = rows.withColumn("part", F.explode(F.array(F.lit("all"), F.when(F.pmod("id", F.lit(2)) == 0, "even").otherwise("odd"))))
    auc = metric.ts_auc(rows, "w", "part")
    wide = auc.groupBy("w").agg(*[F.max(F.when(F.col("part") == p, F.col("ts_auc"))).alias(f"auc_{p}") for p in ("all", "even", "odd")])
    base = wide.filter(F.col("w") == 0).select(*[F.col(f"auc_{p}").alias(f"base_{p}") for p in ("all", "even", "odd")])
    lifted = (F.col("auc_all") > F.col("base_all")) & (F.col("auc_even") > F.col("base_even")) & (F.col("auc_odd") > F.col("base_odd"))
    return wide.join(F.broadcast(base)).select("w", "auc_all", "auc_even", "auc_odd", lifted.cast("int").alias("robust"))  # one row


def greedy(scores: DataFrame, members: list[str], base: str, weights=(0.05, 0.1, 0.2, 0.3)) -> list[tuple[str, float]]:
    """Members added one at a time with the weight that lifts all three parts most; a driver loop over blend_grid."""
    chosen, left, now = [], list(members), scores.withColumn("_now", F.col(base))
    while left:
        best = None
        for m in left:
            rows = [r for r in blend_grid(now, "_now", m, [0.0, *weights]).collect() if r["robust"]]
            top = max(rows, key=lambda r: r["auc_all"], default=None)
            if top and (best is None or top["auc_all"] > best[2]):
                best = (m, top["w"], top["auc_all"])
        if best is None:
            break
        m, w, _ = best
        chosen.append((m, w))
        left.remove(m)
        now = now.withColumn("_now", (1 - w) * F.col("_now") + w * F.col(m))
    return chosen


def gram(scores: DataFrame, members: list[str], target: str) -> DataFrame:
    """Sums of products for closed-form ridge regression on a +-1 target, with an intercept."""
    cols = [F.lit(1.0), *map(F.col, members)]
    y = 2.0 * F.col(target) - 1.0
    sums = [F.sum(a * b).alias(f"g{i}{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    return scores.agg(*sums, *[F.sum(a * y).alias(f"y{i}") for i, a in enumerate(cols)])


def ridge(scores: DataFrame, members: list[str], target: str, l2: float = 1.0) -> np.ndarray:
    row, k = gram(scores, members, target).first(), len(members) + 1
    g = np.array([[row[f"g{min(i, j)}{max(i, j)}"] for j in range(k)] for i in range(k)])
    penalty = l2 * np.eye(k)
    penalty[0, 0] = 0
    return np.linalg.solve(g + penalty, np.array([row[f"y{i}"] for i in range(k)]))


def rank_mean(scores: DataFrame, members: list[str]) -> DataFrame:
    """Mean of the members' average ranks over the whole table."""
    ranked = with_ranks(scores, {f"_r_{m}": m for m in members})
    return ranked.withColumn("rank_mean", sum((F.col(f"_r_{m}") for m in members[1:]), F.col(f"_r_{members[0]}")) / len(members)).drop(*(f"_r_{m}" for m in members))


def by_age(labels: DataFrame, scores: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """TS-AUC of the negatives with the positives of each range of steps since the break."""
    rows = labels.select("id", "t", "target", "tau_index").join(scores, ["id", "t"])
    age = F.when(F.col("target") == 1, F.col("t") - F.col("tau_index"))
    buckets = F.array(*[F.when((age >= a) & (age < b) | (F.col("target") == 0), F.lit(f"{a}-{b}")) for a, b in cuts])
    rows = rows.select("t", "score", F.col("target").alias("y"), F.explode(buckets).alias("bucket")).filter("bucket is not null")
    return metric.ts_auc(rows, "bucket")


def by_step(labels: DataFrame, scores: DataFrame, width: int = 60) -> DataFrame:
    rows = labels.select("id", "t", F.col("target").alias("y")).join(scores, ["id", "t"])
    return metric.ts_auc(rows.withColumn("bucket", F.floor(F.col("t") / width).cast("bigint")), "bucket")


def false_alarms(labels: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """The unbroken series with the highest scores."""
    rows = labels.filter("tau_index is null").select("id", "t").join(scores, ["id", "t"])
    return rows.groupBy("id").agg(F.max("score").alias("top")).orderBy(F.desc("top"), "id").limit(k)
