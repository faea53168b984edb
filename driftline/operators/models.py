"""Tree, linear and pairwise-ranking members on Spark's ML library."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.sources.store import stored


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    clean = rows.withColumns({c: F.when(F.isnan(c) | F.col(c).isNull() | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)) for c in columns})
    return VectorAssembler(inputCols=columns, outputCol="features").transform(clean)


def _scored(model, rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    p = vector_to_array("probability")[1]
    return model.transform(rows).select("id", "t", *keep, p.alias("p"))


def boosted(train: DataFrame, rows: DataFrame, columns: list[str], rounds: int = 10, depth: int = 4, seed: int = 42) -> DataFrame:
    """(id, t, p) of gradient-boosted trees fitted on ``train(target, weight, columns...)``.  Trees grow by depth, not by leaf."""
    gbt = GBTClassifier(labelCol="target", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    return _scored(gbt.fit(assembled(train, columns)), assembled(rows, columns))


def boosted_until(train: DataFrame, valid: DataFrame, rows: DataFrame, columns: list[str], rounds: int = 12, patience: int = 4, depth: int = 3, seed: int = 42) -> tuple[DataFrame, dict[int, float]]:
    """(id, t, p) by the number of rounds with the best TS-AUC on ``valid``, and the TS-AUC by rounds.

    All rounds are fitted once; every prefix of the trees is evaluated in one plan.  The search ends ``patience``
    rounds after the last gain, so a late and lucky prefix isn't taken.
    """
    from driftline.operators import gates

    gbt = GBTClassifier(labelCol="target", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    model = gbt.fit(assembled(train, columns))

    def prefixes(df: DataFrame) -> DataFrame:
        out, total = assembled(df, columns), F.lit(0.0)
        for k, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
            out = tree.setPredictionCol(f"_tree{k}").transform(out)
        for k, weight in enumerate(model.treeWeights):
            total = total + weight * F.col(f"_tree{k}")
            out = out.withColumn(f"_sum{k + 1}", total)
        return out

    auc = gates.evaluated(prefixes(valid).withColumn("y", F.col("target")), {str(k): F.col(f"_sum{k}") for k in range(1, rounds + 1)}, "rounds").collect()  # a row a round
    by = {int(r["rounds"]): round(r["ts_auc"], 9) for r in auc}
    best = 1
    for k in range(2, rounds + 1):
        if by.get(k, 0.5) > by.get(best, 0.5):
            best = k
        elif k - best >= patience:
            break
    return prefixes(rows).select("id", "t", (1 / (1 + F.exp(-2 * F.col(f"_sum{best}")))).alias("p")), by


def regularised(train: DataFrame, rows: DataFrame, columns: list[str], rounds: int = 5, seed: int = 42) -> DataFrame:
    """(id, t, p) of trees for wide banks: large leaves, a share of rows and of columns a tree."""
    gbt = GBTClassifier(labelCol="target", weightCol="weight", maxIter=rounds, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.6", minInstancesPerNode=50, seed=seed)
    return _scored(gbt.fit(assembled(train, columns)), assembled(rows, columns))


def forest(train: DataFrame, rows: DataFrame, columns: list[str], trees: int = 20, seed: int = 42) -> DataFrame:
    rf = RandomForestClassifier(labelCol="target", weightCol="weight", numTrees=trees, maxDepth=6, seed=seed)
    return _scored(rf.fit(assembled(train, columns)), assembled(rows, columns))


def logistic(train: DataFrame, rows: DataFrame, columns: list[str], l2: float = 1e-3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Logistic regression on z-scored columns; columns of ``rows`` named in ``keep`` stay beside the scores."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(assembled(train, columns))
    model = LogisticRegression(featuresCol="scaled", labelCol="target", weightCol="weight", regParam=l2).fit(scaler.transform(assembled(train, columns)))
    return _scored(model, scaler.transform(assembled(rows, columns)), keep)


def out_of_fold(fit, rows: DataFrame, columns: list[str], folds: int = 5) -> DataFrame:
    """(id, t, p) of all rows, each series scored by the model that is fitted on the other folds.

    Every fit reads the rows several times, so they are stored once instead of being made anew from their series.
    """
    rows = stored(rows.select("id", "t", *columns, *[c for c in ("target", "weight") if c in rows.columns]), "rows")
    fold = F.pmod("id", F.lit(folds))
    parts = [fit(rows.filter(fold != k), rows.filter(fold == k), columns) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def pairs_of(train: DataFrame, columns: list[str], buckets: int = 8) -> DataFrame:
    """Differences of broken and unbroken rows of one step.

    Rows of a step pair up by a hashed slot and the class's row number in it; the larger class takes the
    smaller one's rows in turn, so pairs grow with the rows and not with their square.  Where a slot holds
    one class only, the step is one slot.
    """
    from pyspark.sql import Window

    hashed = train.withColumn("slot", F.pmod(F.xxhash64("id", "t"), F.lit(buckets)))
    slots = Window.partitionBy("t", "slot")
    one = hashed.withColumn("_one", F.min("target").over(slots) == F.max("target").over(slots))
    slot = one.withColumn("slot", F.when(F.max("_one").over(Window.partitionBy("t")), F.lit(-1)).otherwise(F.col("slot")))
    slot = slot.withColumn("k", F.row_number().over(Window.partitionBy("t", "slot", "target").orderBy("id")) - 1)
    slot = slot.withColumns({f"n{c}": F.count_if(F.col("target") == c).over(slots) for c in (0, 1)}).filter("n0 > 0 and n1 > 0")
    slot = slot.withColumn("least", F.least("n0", "n1")).withColumn("m", F.col("k") % F.col("least"))
    pos, neg = slot.filter("target = 1"), slot.filter("target = 0")
    # one side of each pair is a row of the smaller class, whose k and m are the same
    pairs = pos.alias("p").join(neg.alias("n"), ["t", "slot", "m"])
    return pairs.select(*[(F.col(f"p.{c}") - F.col(f"n.{c}")).alias(c) for c in columns])


def pairwise(train: DataFrame, rows: DataFrame, columns: list[str], buckets: int = 8) -> DataFrame:
    """A ranking member: logistic regression on differences of broken and unbroken rows of one step."""
    pairs = pairs_of(train, columns, buckets)
    both = pairs.withColumn("target", F.lit(1)).unionByName(pairs.select(*[(-F.col(c)).alias(c) for c in columns]).withColumn("target", F.lit(0)))
    model = LogisticRegression(labelCol="target", regParam=1e-3, fitIntercept=False).fit(assembled(both, columns))
    return _scored(model, assembled(rows, columns))


def top_columns(model, columns: list[str], k: int) -> list[str]:
    """The k columns of greatest importance."""
    gains = model.featureImportances.toArray()
    return [c for _, c in sorted(zip(-gains, columns))[:k]]
