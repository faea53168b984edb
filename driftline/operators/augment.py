"""Generated series held against real ones: how far they differ, whether a classifier tells them apart, whether they help a member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import calibration, gates
from driftline.operators.metric import step_auc
from driftline.operators.models import assembled, logistic
from driftline.operators.synthesis import realism
from driftline.sources.series import history
from driftline.sources.store import stored

#: What series are compared by, all free of location and scale.
SHAPE = ["skew", "kurt", "acf1_h", "acf2_h", "acf3_h"]


def shapes(series: DataFrame) -> DataFrame:
    """(id, skew, kurt, acf1_h, acf2_h, acf3_h) of each history."""
    hist = history(series)
    return calibration.moments(hist).select("id", "skew", "kurt").join(calibration.autocorrelation(hist, 3), "id")


def gaps(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(column, gap, sd_ratio) of the histories' shapes."""
    return realism(shapes(real), shapes(synthetic), SHAPE)


def discriminator(real: DataFrame, synthetic: DataFrame, rounds: int = 10, seed: int = 0) -> DataFrame:
    """(rows, auc): how well trees tell generated series from real ones, on the half of the series that they were not fitted on.

    0.5 is not at all; a half without one of the two kinds gives no row.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    both = shapes(real).withColumn("y", F.lit(0)).unionByName(shapes(synthetic).withColumn("y", F.lit(1)))
    rows = assembled(both.withColumn("held", gates.half() == "b"), SHAPE)
    model = GBTClassifier(labelCol="y", maxIter=rounds, maxDepth=3, seed=seed).fit(rows.filter("not held"))
    scored = model.transform(rows.filter("held")).select("y", F.lit(0).alias("t"), vector_to_array("probability")[1].alias("score"))
    return step_auc(scored).select((F.col("n_pos") + F.col("n_neg")).alias("rows"), "auc")


def sampled_series(rows: DataFrame, share: float) -> DataFrame:
    """A share of the series, whole, scattered by id."""
    return rows.filter(F.pmod(F.col("id") * 7919 + 7, F.lit(1000)) < int(1000 * share))


def augmentation(real: DataFrame, synthetic: DataFrame, columns: list[str], shares: tuple[float, ...] = (0.0, 1.0)) -> DataFrame:
    """(share, pairs, ts_auc): a logistic member fitted on half a of ``real(id, t, target, weight, columns...)`` with more and more generated series, judged on half b."""
    keep = ["id", "t", "target", "weight", *columns]
    real, synthetic = stored(real.select(*keep), "real"), stored(synthetic.select(*keep), "synthetic")
    rows = real.withColumn("part", gates.half())
    train, held = rows.filter("part = 'a'").drop("part"), rows.filter("part = 'b'").withColumn("y", F.col("target"))
    out = None
    for share in shares:
        more = train.unionByName(sampled_series(synthetic, share))
        scored = logistic(more, held, columns, keep=("y",))
        one = gates.evaluated(scored, {str(share): F.col("p")}, "share")
        out = one if out is None else out.unionByName(one)
    return out
