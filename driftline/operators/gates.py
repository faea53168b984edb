"""Pools of members, their blends, and gates that decide whether a new member earns a place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import expit, logit
from driftline.operators import metric
from driftline.operators.ranks import with_ranks

PARTS = ("all", "a", "b")


def half() -> Column:
    """Honest halves: each series lies in one, scattered by its id."""
    return F.when(F.pmod(F.col("id") * 7919 + 1, F.lit(1000)) < 500, "a").otherwise("b")


def held_out(share: int = 5) -> Column:
    """A share of the series, scattered by their ids."""
    return F.pmod(F.col("id") * 7919 + 42, F.lit(1000)) < 1000 // share


def mean_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) / float(len(columns))


def mean_logit(members: list[str]) -> Column:
    """Mean of the members' logits, probabilities clipped to [1e-7, 1 - 1e-7]."""
    return mean_of([logit(F.col(m)) for m in members])


def rescale_constants(scores: DataFrame, rank: str, trees: list[str]) -> DataFrame:
    """One row: mean and population deviation of the rank member and of the tree members' mean logit."""
    tree = mean_logit(trees)
    return scores.agg(F.avg(rank).alias("rk_mu"), (F.stddev_pop(rank) + 1e-12).alias("rk_sd"), F.avg(tree).alias("gbt_mu"), (F.stddev_pop(tree) + 1e-12).alias("gbt_sd"))


def full_blend(scores: DataFrame, constants: DataFrame, trees: list[str], rank: str, linear: str, neural: list[str], w_rank: float = 0.1, w_lin: float = 0.1, w_neural: float = 0.45) -> DataFrame:
    """final_logit and score of the whole blend: trees, rank member on their scale, linear member, neural members.

    ``linear`` and ``neural`` are logits, ``trees`` probabilities; ``constants`` is one row, measured elsewhere.
    """
    as_tree = (F.col(rank) - F.col("rk_mu")) / F.col("rk_sd") * F.col("gbt_sd") + F.col("gbt_mu")
    base = (1 - w_lin) * ((1 - w_rank) * mean_logit(trees) + w_rank * as_tree) + w_lin * F.col(linear)
    final = (1 - w_neural) * base + w_neural * mean_of([F.col(n) for n in neural]) if neural else base
    out = scores.join(F.broadcast(constants)).withColumn("final_logit", final)  # one row
    return out.withColumn("score", F.least(F.greatest(expit(F.col("final_logit")), F.lit(0.0)), F.lit(1.0))).drop("rk_mu", "rk_sd", "gbt_mu", "gbt_sd")


def served(scores: DataFrame) -> DataFrame:
    """(id, seq, score): what serving yields per series: first a record without score that says it is ready, then one score within [0, 1] a point."""
    ready = scores.select("id").distinct().select("id", F.lit(0).cast("long").alias("seq"), F.lit(None).cast("double").alias("score"))
    points = scores.select("id", (F.col("t") + 1).cast("long").alias("seq"), F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
    return ready.unionByName(points)


def pool(scores: DataFrame, members: list[str]) -> DataFrame:
    """(blend, pairs, ts_auc) of every member, every pair's mean logit and the three pools of all: mean logit, mean probability and mean of global ranks."""
    scores = with_ranks(scores, {f"_r_{m}": m for m in members})
    clipped = [F.least(F.greatest(F.col(m), F.lit(1e-7)), F.lit(1 - 1e-7)) for m in members]
    blends = {m: mean_logit([m]) for m in members} | {f"{a}+{b}": mean_logit([a, b]) for k, a in enumerate(members) for b in members[k + 1 :]}
    blends |= {"mean_logit": mean_logit(members), "mean_prob": mean_of(clipped), "mean_rank": mean_of([F.col(f"_r_{m}") for m in members])}
    return evaluated(scores, blends, "blend")


def evaluated(scores: DataFrame, blends: dict[str, Column], name: str, *by: str) -> DataFrame:
    """TS-AUC of several scores in one plan; equal up to nine digits counts as a tie."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias(name), F.round(c.cast("double"), 9).alias("score")) for k, c in blends.items()]))
    rows = scores.select("id", "t", "y", *by, each.alias("e")).select("id", "t", "y", *by, "e.*")
    return metric.ts_auc(rows, *by, name)


def in_parts(scores: DataFrame) -> DataFrame:
    """Every row twice: among all, and in its half."""
    return scores.withColumn("part", F.explode(F.array(F.lit("all"), half())))


def wide_parts(auc: DataFrame, *by: str) -> DataFrame:
    """One row with the AUC of all rows and of both halves."""
    return auc.groupBy(*by).agg(*[F.round(F.max(F.when(F.col("part") == p, F.col("ts_auc"))), 9).alias(f"auc_{p}") for p in PARTS])


def standardised(column: str, *by: str) -> Column:
    w = Window.partitionBy(*by)
    return (F.col(column) - F.avg(column).over(w)) / (F.stddev_pop(column).over(w) + 1e-12)


def with_z(scores: DataFrame, columns: list[str]) -> DataFrame:
    """z_{column} over the whole table, from one broadcast row."""
    stats = scores.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = scores.join(F.broadcast(stats)).withColumns({f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-12) for c in columns})
    return out.drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def additive_gate(scores: DataFrame, base: str, candidate: str, weights: list[float], least: float = 5e-4) -> DataFrame:
    """(w, lift_all, lift_a, lift_b, robust, verdict) of z(base) + w z(candidate).

    A candidate that alone ranks below chance is turned round.  ``robust`` is the smallest of the three lifts;
    the verdict is that of the best weight.
    """
    z = with_z(scores, [base, candidate])
    alone = evaluated(z, {"alone": F.col(candidate)}, "blend").select(F.when(F.round("ts_auc", 9) < 0.5, -1.0).otherwise(1.0).alias("_sign"))
    signed = z.join(F.broadcast(alone))  # one row
    blends = {str(w): F.col(f"z_{base}") + w * F.col("_sign") * F.col(f"z_{candidate}") for w in [0.0, *weights]}
    wide = wide_parts(evaluated(in_parts(signed), blends, "w", "part"), "w").withColumn("w", F.col("w").cast("double"))
    start = wide.filter("w = 0").select(*[F.col(f"auc_{p}").alias(f"_{p}") for p in PARTS])
    lifts = {f"lift_{p}": F.round(F.col(f"auc_{p}") - F.col(f"_{p}"), 9) for p in PARTS}
    out = wide.filter("w > 0").join(F.broadcast(start)).select("w", *[c.alias(k) for k, c in lifts.items()])  # one row
    out = out.withColumn("robust", F.least(*lifts))
    best = out.agg(F.max("robust").alias("_best"))
    return out.join(F.broadcast(best)).withColumn("verdict", F.when(F.col("_best") > least, "promising").otherwise("redundant")).drop("_best")  # one row


def bucket_weights(scores: DataFrame, base: str, member: str, starts: list[int], weights: list[float], flat: float) -> DataFrame:
    """(part, flat_auc, fitted_auc): weights fitted per bucket of steps on one half and judged on the other.

    ``starts`` are the buckets' first steps.  Of equal AUCs the smaller weight wins.
    """
    bucket = reduce(lambda c, s: F.when(F.col("t") >= s[1], s[0]).otherwise(c), list(enumerate(starts))[1:], F.lit(0))
    rows = scores.withColumns({"bucket": bucket, "part": half()})
    mixed = lambda w: (1 - w) * F.col(base) + w * F.col(member)
    grid = evaluated(rows, {str(w): mixed(F.lit(w)) for w in weights}, "w", "part", "bucket")
    best = grid.groupBy("part", "bucket").agg(F.max(F.struct(F.round("ts_auc", 9).alias("a"), (-F.col("w").cast("double")).alias("minus"))).alias("b"))
    fitted = best.select(F.when(F.col("part") == "a", "b").otherwise("a").alias("part"), "bucket", (-F.col("b.minus")).alias("_w"))
    judged = rows.join(F.broadcast(fitted), ["part", "bucket"], "left").withColumn("_w", F.coalesce("_w", F.lit(flat)))  # a row a half and bucket
    auc = evaluated(judged, {"flat": mixed(F.lit(flat)), "fitted": mixed(F.col("_w"))}, "kind", "part")
    return auc.groupBy("part").agg(*[F.max(F.when(F.col("kind") == k, F.col("ts_auc"))).alias(f"{k}_auc") for k in ("flat", "fitted")])


def snapshot_gate(scores: DataFrame, base: str, detectors: list[str], steps: list[int], grid: list[float]) -> DataFrame:
    """(detector, base_auc, blend_auc, lift, best_weight): what detectors add at a few steps, weighted by the steps' pairs.

    Within a step the blend is base + weight * z(detector) * sd(base), and each step takes its best weight;
    ``best_weight`` is the commonest.  A detector has seen the rows before the step, the base also the step's own.
    """
    order = Window.partitionBy("id").orderBy("t")
    seen = scores.withColumns({d: F.lag(d).over(order) for d in detectors}).filter(F.col("t").isin(steps)).dropna(subset=detectors)
    step = Window.partitionBy("t")
    rows = seen.withColumns({"_sd": F.stddev_pop(base).over(step)} | {f"_z_{d}": F.when(F.stddev_pop(d).over(step) > 1e-12, (F.col(d) - F.avg(d).over(step)) / F.stddev_pop(d).over(step)).otherwise(0.0) for d in detectors})
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("detector"), F.lit(w).alias("w"), F.round(F.col(base) + w * F.col(f"_z_{d}") * F.col("_sd"), 9).alias("score")) for d in detectors for w in [0.0, *grid]]))
    auc = metric.step_auc(rows.select("id", "t", "y", each.alias("e")).select("id", "t", "y", "e.*"), "detector", "w")
    best = auc.groupBy("detector", "t").agg(F.first("weight").alias("weight"), F.max(F.when(F.col("w") == 0, F.round("auc", 9))).alias("base"), F.max(F.struct(F.round("auc", 9).alias("a"), (-F.col("w")).alias("minus"))).alias("b"))
    weighted = lambda c: F.sum(c * F.col("weight")) / F.sum("weight")
    total = best.groupBy("detector").agg(weighted(F.col("base")).alias("base_auc"), weighted(F.col("b.a")).alias("blend_auc"))
    common = best.groupBy("detector", (-F.col("b.minus")).alias("w")).agg(F.count("*").alias("n")).groupBy("detector").agg((-F.max(F.struct("n", (-F.col("w")).alias("minus")))["minus"]).alias("best_weight"))
    return total.join(common, "detector").select("detector", "base_auc", "blend_auc", (F.col("blend_auc") - F.col("base_auc")).alias("lift"), "best_weight")


def slot_swap(scores: DataFrame, members: list[str], slot: int, control: str, treatment: str, base: str, weight: float = 0.45) -> DataFrame:
    """(arm, auc_all, auc_a, auc_b): the blend with one member of the averaged group replaced, by a control and by a treatment."""
    arms = {}
    for arm, new in (("control", control), ("treatment", treatment)):
        group = [new if k == slot else m for k, m in enumerate(members)]
        arms[arm] = (1 - weight) * F.col(base) + weight * mean_of([F.col(m) for m in group])
    return wide_parts(evaluated(in_parts(scores), arms, "arm", "part"), "arm")


def by_type(scores: DataFrame, kinds: DataFrame, members: list[str]) -> DataFrame:
    """(kind, member, pairs, ts_auc): the negatives with the positives of one kind of break at a time, for ``kinds(id, kind)``."""
    typed = scores.join(kinds, "id", "left")
    every = kinds.select("kind").distinct().agg(F.array_sort(F.collect_set("kind")).alias("_kinds"))  # a handful of kinds
    rows = typed.join(F.broadcast(every)).withColumn("kind", F.explode(F.when(F.col("y") == 1, F.array("kind")).otherwise(F.col("_kinds")))).filter("kind is not null")
    return evaluated(rows, {m: F.col(m) for m in members}, "member", "kind")


def oracle_routing(scores: DataFrame, kinds: DataFrame, members: list[str], default: str) -> DataFrame:
    """(blend, auc_all, auc_a, auc_b): positives scored by their kind's best member, all others by the default; and the default alone.

    It knows the kinds, so it bounds what routing could bring.  Members are standardised; of equal AUCs the first name wins.
    """
    z = with_z(scores, members)
    auc = by_type(scores, kinds, members).withColumn("a", F.round("ts_auc", 9))
    best = auc.groupBy("kind").agg(F.min(F.struct((-F.col("a")).alias("minus"), "member")).alias("b")).select("kind", F.col("b.member").alias("member"))
    routed = z.join(kinds, "id", "left").join(F.broadcast(best), "kind", "left")  # a row a kind
    chosen = reduce(lambda c, m: F.when((F.col("y") == 1) & (F.col("member") == m), F.col(f"z_{m}")).otherwise(c), members, F.col(f"z_{default}"))
    return wide_parts(evaluated(in_parts(routed), {"default": F.col(f"z_{default}"), "routed": chosen}, "blend", "part"), "blend")


def stack_two_fold(scores: DataFrame, members: list[str], trees: bool = False) -> DataFrame:
    """(id, t, y, part, stacked): a stack of the members' logits fitted on one half of the series and applied to the other."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.functions import vector_to_array

    from driftline.operators.models import assembled

    rows = assembled(scores.withColumns({f"_l_{m}": logit(F.col(m)) for m in members}).withColumn("part", half()), [f"_l_{m}" for m in members])
    learner = GBTClassifier(labelCol="y", maxIter=5, maxDepth=3, seed=1) if trees else LogisticRegression(labelCol="y", regParam=1e-4)
    parts = []
    for own, other in (("a", "b"), ("b", "a")):
        model = learner.fit(rows.filter(F.col("part") == own))
        parts.append(model.transform(rows.filter(F.col("part") == other)).select("id", "t", "y", "part", vector_to_array("probability")[1].alias("stacked")))
    return parts[0].unionByName(parts[1])


def ablation(scores: DataFrame, groups: dict[str, list[str]], target: str = "y") -> DataFrame:
    """(dropped, pairs, ts_auc) of a ridge stack without one group of members at a time, fitted on half a and judged on half b.

    A driver loop over closed-form fits: each needs one row of sums.
    """
    from driftline.operators.blend import ridge

    rows = scores.withColumn("part", half())
    out = {}
    for name in ["", *groups]:
        left = [m for g, ms in groups.items() if g != name for m in ms]
        w = ridge(rows.filter("part = 'a'"), left, target)
        out[name or "nothing"] = reduce(lambda a, b: a + b, [float(x) * F.col(m) for x, m in zip(w[1:], left)], F.lit(float(w[0])))
    return evaluated(rows.filter("part = 'b'").withColumnRenamed(target, "y"), out, "dropped")
