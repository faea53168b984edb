"""How a series' online rows differ from its history: one row a series, or one a series and step.

Both segments are described by the same aggregate, so that history and online rows share one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.twosample import gaps, kolmogorov


def segments(series: DataFrame) -> DataFrame:
    """``(id, part, t, x)``: the series' rows numbered from 0 within their segment."""
    return series.select("id", F.col("period").alias("part"), F.when(F.col("period") == 1, F.col("time") - 1).otherwise(F.col("t")).alias("t"), "x")


def within() -> Window:
    return Window.partitionBy("id", "part").orderBy("t")


def whole() -> Window:
    return Window.partitionBy("id", "part")


def contrast(stats: DataFrame, columns: list[str], first: int = 1, second: int = 2) -> DataFrame:
    """{column}_change: the size of the difference between the two parts' values of ``stats(id, part, ...)``, for series that have both."""
    pick = lambda c, p: F.max(F.when(F.col("part") == p, F.col(c)))
    both = stats.groupBy("id").agg(*[pick(c, p).alias(f"{c}_{p}") for c in columns for p in (first, second)], F.count_distinct("part").alias("_n")).filter("_n = 2")
    return both.select("id", *[F.abs(F.col(f"{c}_{second}") - F.col(f"{c}_{first}")).alias(f"{c}_change") for c in columns])


def lagged_share(d: str, order: Window) -> Column:
    return F.col(d) * F.lag(d).over(order)


def autocorrelation(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(id, part, name): lag-1 autocorrelation of a value, 0 where it does not vary."""
    d = rows.withColumn("_v", value).withColumn("_d", F.col("_v") - F.avg("_v").over(whole()))
    d = d.withColumn("_p", lagged_share("_d", within()))
    sums = d.groupBy("id", "part").agg(F.sum("_p").alias("p"), F.sum(F.col("_d") ** 2).alias("ss"))
    return sums.select("id", "part", F.when(F.col("ss") > 1e-12, F.col("p") / F.col("ss")).otherwise(0.0).alias(name))


def deviation_acf(rows: DataFrame) -> DataFrame:
    """(id, part, abs_acf, sq_acf): lag-1 autocorrelation of absolute and of squared deviations from the part's mean."""
    d = rows.withColumn("_c", F.col("x") - F.avg("x").over(whole()))
    return autocorrelation(d, F.abs("_c"), "abs_acf").join(autocorrelation(d, F.col("_c") ** 2, "sq_acf"), ["id", "part"])


def turning_points(rows: DataFrame) -> DataFrame:
    """(id, part, turning): share of neighbouring differences of opposite sign; 0 for fewer than three rows."""
    d = rows.withColumn("_d", F.col("x") - F.lag("x").over(within()))
    d = d.withColumn("_turn", (lagged_share("_d", within()) < 0).cast("double"))
    return d.groupBy("id", "part").agg(F.coalesce(F.avg("_turn"), F.lit(0.0)).alias("turning"))


def scaling(rows: DataFrame, lags: tuple[int, ...] = (2, 4, 8, 16, 32)) -> DataFrame:
    """(id, part, hurst): slope of the log root mean square of lagged differences over the log lag.

    One half for fewer than 32 rows or fewer than three lags that are shorter than the part.
    """
    d = rows.withColumns({f"_d{k}": F.col("x") - F.lag("x", k).over(within()) for k in lags})
    sums = d.groupBy("id", "part").agg(F.count("*").alias("n"), *[F.avg(F.col(f"_d{k}") ** 2).alias(f"_m{k}") for k in lags])
    points = F.filter(F.array(*[F.struct(F.lit(math.log(k)).alias("lx"), F.log(F.sqrt(F.col(f"_m{k}")) + 1e-12).alias("ly")) for k in lags]), lambda p: p["ly"].isNotNull())
    slopes = sums.withColumn("points", points).filter((F.col("n") >= 32) & (F.size("points") >= 3)).select("id", "part", F.explode("points").alias("p")).groupBy("id", "part").agg(F.regr_slope("p.ly", "p.lx").alias("s"))
    return sums.select("id", "part").join(slopes, ["id", "part"], "left").select("id", "part", F.coalesce("s", F.lit(0.5)).alias("hurst"))


def order_entropy(rows: DataFrame) -> DataFrame:
    """(id, part, order_entropy): entropy of the order patterns of three neighbours over log 6, equal values by position; 0 for fewer than five rows."""
    p = rows.withColumns({"_a": F.lag("x", 2).over(within()), "_b": F.lag("x").over(within()), "_n": F.count("*").over(whole())})
    code = (F.col("_a") <= F.col("_b")).cast("int") * 4 + (F.col("_b") <= F.col("x")).cast("int") * 2 + (F.col("_a") <= F.col("x")).cast("int")
    counts = p.filter("_a is not null and _n >= 5").groupBy("id", "part", code.alias("code")).agg(F.count("*").alias("k"))
    share = F.col("k") / F.sum("k").over(whole())
    entropy = counts.withColumn("s", share).groupBy("id", "part").agg((-F.sum(F.col("s") * F.log("s")) / math.log(6)).alias("e"))
    return rows.select("id", "part").distinct().join(entropy, ["id", "part"], "left").select("id", "part", F.coalesce("e", F.lit(0.0)).alias("order_entropy"))


def one_sided_kolmogorov(series: DataFrame) -> DataFrame:
    """(id, ks): the largest gap at the online values only, the history's share strictly below against the online rank.

    Among equal online values the gap is largest at the first or the last.
    """
    g = gaps(series).filter("b > 0")
    below = (F.col("ca") - F.col("a")) / F.col("na")
    ends = [F.abs(below - (F.col("cb") - F.col("b") + 1) / F.col("nb")), F.abs(below - F.col("cb") / F.col("nb"))]
    return g.groupBy("id").agg(F.max(F.greatest(*ends)).alias("ks"))


def around_break(labels: DataFrame) -> DataFrame:
    """Per broken series with two online rows or more on each side of the break: moments, lag-1 autocorrelation and KS of the rows before against those after.

    Returns id, n_pre, n_post, pre_mean, post_mean, pre_std, post_std, pre_acf1, post_acf1, mean_shift, std_ratio, ks_stat.
    """
    rows = labels.filter("tau_index is not null").select("id", (F.col("target") + 1).alias("part"), "t", "x")
    stats = rows.groupBy("id", "part").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    stats = stats.join(autocorrelation(rows, F.col("x"), "acf1"), ["id", "part"])
    pick = lambda c, p: F.max(F.when(F.col("part") == p, F.col(c)))
    wide = stats.groupBy("id").agg(*[pick(c, p).alias(f"{n}_{c}" if c != "n" else f"n_{n}") for c in ("n", "mean", "std", "acf1") for p, n in ((1, "pre"), (2, "post"))]).filter("n_pre >= 2 and n_post >= 2")
    ks = kolmogorov(rows.select("id", F.col("part").alias("period"), "x")).withColumnRenamed("ks", "ks_stat")
    ratio = F.when(F.col("pre_std") > 1e-9, F.col("post_std") / F.col("pre_std"))
    return wide.withColumns({"mean_shift": F.col("post_mean") - F.col("pre_mean"), "std_ratio": ratio}).join(ks, "id")


def label_suspects(series: DataFrame, labels: DataFrame, shortest: int = 50) -> DataFrame:
    """(id, n_online, ks, logvar, mean_z, suspect): unbroken series, marked if their online rows differ grossly from the history."""
    sound = labels.filter("tau_index is null").select("id").distinct()
    own = series.join(sound, "id")
    p = lambda k: F.when(F.col("period") == k, F.col("x"))
    stats = own.groupBy("id").agg(F.count(p(2)).alias("n_online"), F.avg(p(1)).alias("mu"), F.stddev_pop(p(1)).alias("s"), F.avg(p(2)).alias("m"), F.var_pop(p(2)).alias("v")).filter(F.col("n_online") >= shortest)
    sd = F.greatest("s", F.lit(1e-9))
    out = stats.join(one_sided_kolmogorov(own), "id").select("id", "n_online", "ks", F.abs(F.log(F.col("v") / (sd * sd) + 1e-12)).alias("logvar"), (F.abs((F.col("m") - F.col("mu")) / sd) * F.sqrt("n_online")).alias("mean_z"))
    return out.withColumn("suspect", ((F.col("ks") > 0.35) | (F.col("logvar") > 1.2) | (F.col("mean_z") > 6)).cast("int"))


def null_spread(series: DataFrame, width: int = 50, every: int = 25) -> DataFrame:
    """(id, sd_mean_z, sd_logvar): how window statistics spread over the later half of each history, windows starting every few rows."""
    hist = series.filter("period = 1").select("id", (F.col("time") - 1).alias("t"), "x")
    rows = hist.withColumns({"n": F.count("*").over(Window.partitionBy("id")), "mu": F.avg("x").over(Window.partitionBy("id")), "sd": F.greatest(F.stddev_pop("x").over(Window.partitionBy("id")), F.lit(1e-9))})
    window = Window.partitionBy("id").orderBy("t").rowsBetween(0, width - 1)
    rows = rows.withColumns({"m": F.avg("x").over(window), "v": F.var_pop("x").over(window)})
    first = F.floor(F.col("n") / 2)
    rows = rows.filter((F.col("t") >= first) & (F.col("t") < F.col("n") - width) & ((F.col("t") - first) % every == 0))
    z = (F.col("m") - F.col("mu")) / (F.col("sd") / math.sqrt(width))
    return rows.groupBy("id").agg(F.stddev_pop(z).alias("sd_mean_z"), F.stddev_pop(F.log(F.col("v") / (F.col("sd") ** 2) + 1e-12)).alias("sd_logvar"))


def process(series: DataFrame, labels: DataFrame, history: int = 50, online: int = 30, margin: int = 5) -> DataFrame:
    """What a generator needs of each series: lengths, AR(1) coefficient, excess kurtosis, innovations' AR(1), and the break's size.

    Returns id, n_hist, n_online, rho_h, std_h, kurt_h, rho_innov and, for breaks away from both ends, brk_dmean,
    brk_lvr, brk_dacf, brk_ks and brk_taufrac (null otherwise).
    """
    p = lambda k: F.when(F.col("period") == k, F.col("x"))
    sizes = series.groupBy("id").agg(F.count(p(1)).alias("n_hist"), F.count(p(2)).alias("n_online"), F.stddev_pop(p(1)).alias("std_h")).filter((F.col("n_hist") >= history) & (F.col("n_online") >= online))
    hist = segments(series.filter("period = 1"))
    rho = autocorrelation(hist, F.col("x"), "rho_h").drop("part")
    c = hist.join(rho, "id").withColumn("c", F.col("x") - F.avg("x").over(whole()))
    innovations = c.withColumn("x", F.col("c") - F.col("rho_h") * F.lag("c").over(within())).filter("x is not null")
    shape = c.groupBy("id").agg((F.avg(F.col("c") ** 4) / F.avg(F.col("c") ** 2) ** 2 - 3).alias("kurt_h"))
    taus = labels.filter("tau_index is not null").groupBy("id").agg(F.max("tau_index").alias("tau"))
    out = sizes.join(rho, "id").join(shape, "id").join(autocorrelation(innovations, F.col("x"), "rho_innov").drop("part"), "id").join(taus, "id", "left")
    b = around_break(labels)
    clear = (F.col("tau") > margin) & (F.col("tau") < F.col("n_online") - margin)
    pre, post = (F.col(f"{s}_std") ** 2 * (F.col(f"n_{s}") - 1) / F.col(f"n_{s}") for s in ("pre", "post"))
    out = out.join(b, "id", "left")
    return out.select(
        "id", "n_hist", "n_online", "rho_h", "std_h", "kurt_h", "rho_innov", F.when(clear, F.col("mean_shift") / (F.col("std_h") + 1e-9)).alias("brk_dmean"), F.when(clear, F.log((post + 1e-9) / (pre + 1e-9))).alias("brk_lvr"),
        F.when(clear, F.col("post_acf1") - F.col("pre_acf1")).alias("brk_dacf"), F.when(clear, F.col("ks_stat")).alias("brk_ks"), F.when(clear, F.col("tau") / F.col("n_online")).alias("brk_taufrac"),
    )


def forecast_residual(df: DataFrame, quantiles: DataFrame) -> DataFrame:
    """resid: distance from a forecast's middle in units of its 10 to 90 % spread; resid_max: the largest so far.

    ``quantiles(id, lo, mid, hi)`` is any forecast of a series; a history's own quantiles are the plainest.
    """
    spread = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    rows = df.join(quantiles, "id").withColumn("resid", F.abs(F.col("x") - F.col("mid")) / spread)
    return rows.withColumn("resid_max", F.max("resid").over(Window.partitionBy("id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def envelopes(z: DataFrame, steps: list[int], lengths: tuple[int, ...] = (20, 40, 80, 160), block: int = 8) -> DataFrame:
    """(id, step, length, edge, var_env, acf_env, transient, ramp) of the last rows of ``z(id, t, z)`` before each step.

    edge, var_env and acf_env compare the window's halves (means, log variances, lag-1 autocorrelations); transient is the
    largest block mean, ramp the product with a line from -1 to 1.  Windows are cut at the series' start.  A row goes
    to the windows that hold it and to no others.
    """
    grid = F.array(*[F.struct(F.lit(s).cast("long").alias("step"), F.lit(w).cast("long").alias("length")) for s in steps for w in lengths])
    last = z.withColumn("_last", F.max("t").over(Window.partitionBy("id")))
    held = F.filter(grid, lambda g: (F.col("t") < g["step"]) & (F.col("t") >= g["step"] - g["length"]) & (g["step"] <= F.col("_last") + 1))
    rows = last.select("id", "t", "z", F.explode(held).alias("g")).select("id", "t", "z", "g.*")
    n = F.least("step", "length")
    rows = rows.withColumns({"n": n, "i": F.col("t") - (F.col("step") - n)}).withColumns({"late": (F.col("i") >= F.floor(F.col("n") / 2)).cast("int"), "blk": F.floor(F.col("i") / block)})
    key, side = ["id", "step", "length"], Window.partitionBy("id", "step", "length", "late")
    rows = rows.withColumn("d", F.col("z") - F.avg("z").over(side)).withColumn("p", F.col("d") * F.lag("d").over(side.orderBy("t")))
    blocks = Window.partitionBy("id", "step", "length", "blk")
    rows = rows.withColumn("b", F.when(F.col("blk") < F.floor(F.col("n") / block), F.abs(F.avg("z").over(blocks))))
    line = F.when(F.col("n") > 1, -1 + 2 * F.col("i") / (F.col("n") - 1)).otherwise(0.0)
    late, early = (lambda c: F.when(F.col("late") == 1, c)), (lambda c: F.when(F.col("late") == 0, c))
    acf = lambda s: F.when(F.sum(s(F.col("d") ** 2)) > 1e-12, F.sum(s(F.col("p"))) / F.sum(s(F.col("d") ** 2))).otherwise(0.0)
    out = rows.groupBy(*key).agg(
        F.max("n").alias("n"), F.abs(F.avg(late(F.col("z"))) - F.avg(early(F.col("z")))).alias("edge"), F.abs(F.log((F.var_pop(late(F.col("z"))) + 1e-6) / (F.var_pop(early(F.col("z"))) + 1e-6))).alias("var_env"),
        F.abs(acf(late) - acf(early)).alias("acf_env"), F.max("b").alias("transient"), (F.abs(F.sum(F.col("z") * line)) / F.max("n")).alias("ramp"),
    )
    ready = lambda c, least: F.when(F.col("n") >= least, F.col(c)).otherwise(0.0).alias(c)
    return out.select(*key, ready("edge", 8), ready("var_env", 8), ready("acf_env", 12), ready("transient", 2 * block), ready("ramp", 8))
