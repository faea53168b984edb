"""Per-series calibration from the history, one row a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.windows import at_least, clip, previous

EDGES = [k / 20 for k in range(1, 20)]
GRID = (8, 16, 32, 64, 128, 256, 512)


def moments(hist: DataFrame) -> DataFrame:
    """n_hist, mu, sd (sample, at least 1e-9), med, skew = mean z^3 and kurt = mean z^4 - 3."""
    base = hist.groupBy("id").agg(F.count("*").alias("n_hist"), F.avg("x").alias("mu"), at_least(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), 1e-9).alias("sd"), F.median("x").alias("med"))
    z = (F.col("x") - F.col("mu")) / F.col("sd")
    shape = hist.join(base, "id").groupBy("id").agg(F.avg(z**3).alias("s"), F.avg(z**4).alias("k"))
    shape = shape.join(base, "id")
    return shape.select("id", "n_hist", "mu", "sd", "med", F.when(F.col("n_hist") > 2, F.col("s")).otherwise(0.0).alias("skew"), F.when(F.col("n_hist") > 3, F.col("k") - 3).otherwise(0.0).alias("kurt"))


def centred(hist: DataFrame, cal: DataFrame) -> DataFrame:
    """History with z-scores, in one exchange with the calibration."""
    return hist.join(cal, "id").withColumn("z", (F.col("x") - F.col("mu")) / F.col("sd"))


def autocorrelation(hist: DataFrame, lags: int = 2) -> DataFrame:
    """acf1_h .. acf{lags}_h: lagged products of deviations over the sum of squares; 0 for short or constant histories."""
    mean = F.avg("x").over(Window.partitionBy("id"))
    d = hist.withColumn("d", F.col("x") - mean)
    d = d.withColumns({f"p{k}": F.col("d") * previous("d", k) for k in range(1, lags + 1)})
    sums = d.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("d") ** 2).alias("ss"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(1, lags + 1)])
    ratio = lambda k: F.when((F.col("ss") > 1e-12) & (F.col("n") > k + 1), F.col(f"p{k}") / F.col("ss")).otherwise(0.0)
    return sums.select("id", *[ratio(k).alias(f"acf{k}_h") for k in range(1, lags + 1)])


def quantile_edges(hist: DataFrame) -> DataFrame:
    """edges: the 19 twentieths, made strictly rising."""
    q = hist.groupBy("id").agg(F.percentile("x", F.array(*map(F.lit, EDGES))).alias("q"))
    return q.select("id", _rising("q").alias("edges"))


def _rising(edges: str) -> Column:
    """Sorted edges with a step of 1e-12 each, so that none equals the next."""
    return F.transform(edges, lambda e, j: e + j * F.lit(1e-12))


def difference_stats(hist: DataFrame) -> DataFrame:
    """dvar_h (population variance) and dabs_h (mean size) of first differences, at least 1e-9."""
    d = hist.withColumn("d", F.col("x") - previous("x"))
    return d.groupBy("id").agg(at_least(F.coalesce(F.var_pop("d"), F.lit(1.0)), 1e-9).alias("dvar_h"), at_least(F.coalesce(F.avg(F.abs("d")), F.lit(1.0)), 1e-9).alias("dabs_h"))


def crossing_rate(hist: DataFrame, cal: DataFrame) -> DataFrame:
    """cross_rate_h: share of steps across the median; acf1_h_abs: lag-1 autocorrelation of abs z."""
    rows = centred(hist, cal).withColumns({"side": (F.col("x") < F.col("med")).cast("int"), "a": F.abs("z")})
    rows = rows.withColumns({"crossed": (F.col("side") != previous("side")).cast("double"), "d": F.col("a") - F.avg("a").over(Window.partitionBy("id"))})
    rows = rows.withColumn("p", F.col("d") * previous("d"))
    out = rows.groupBy("id").agg(F.avg("crossed").alias("c"), F.sum("p").alias("p"), F.sum(F.col("d") ** 2).alias("ss"))
    return out.select("id", F.coalesce("c", F.lit(0.5)).alias("cross_rate_h"), F.when(F.col("ss") > 1e-12, F.col("p") / F.col("ss")).otherwise(0.0).alias("acf1_h_abs"))


def turning_rate(hist: DataFrame) -> DataFrame:
    """zcr_h: share of sign changes among nonzero first differences; 0.5 without any."""
    d = hist.withColumn("s", F.signum(F.col("x") - previous("x"))).filter("s != 0").withColumn("turn", (F.col("s") != previous("s")).cast("double"))
    rates = d.groupBy("id").agg(F.avg("turn").alias("r"))
    return hist.select("id").distinct().join(rates, "id", "left").select("id", F.coalesce("r", F.lit(0.5)).alias("zcr_h"))


def long_run_variance(hist: DataFrame, cal: DataFrame, lags: int = 64) -> DataFrame:
    """lrv: 1 + 2 sum of (1 - k/(K+1)) acf_k up to K = min(lags, n - 1), at least 0.05; 1 for fewer than 8 rows.

    The lagged products of a whole series are sums over its array, so no row is copied for each lag.
    """
    z = centred(hist, cal).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t", "z"))).alias("r")).select("id", F.transform("r", lambda e: e["z"]).alias("z"))
    add = lambda a, b: a + b
    mean = F.aggregate("z", F.lit(0.0), add) / F.size("z")
    d = z.withColumn("m", mean).select("id", F.transform("z", lambda v: v - F.col("m")).alias("d"))
    n = F.size("d")
    ss = F.aggregate(F.transform("d", lambda v: v * v), F.lit(0.0), add)
    top = F.least(F.lit(lags), n - 1)
    product = lambda k: F.aggregate(F.zip_with(F.slice(F.col("d"), F.lit(1), n - k), F.slice(F.col("d"), k + 1, n - k), lambda a, b: a * b), F.lit(0.0), add)
    rest = F.aggregate(F.sequence(F.lit(1), top), F.lit(0.0), lambda s, k: s + (1 - k / (top + 1)) * product(k) / F.col("ss"))
    full = d.withColumn("ss", ss)
    return full.select("id", F.when((n < 8) | (F.col("ss") <= 1e-12), 1.0).otherwise(at_least(1 + 2 * rest, 0.05)).alias("lrv"))


def knots(hist: DataFrame, count: int = 256) -> DataFrame:
    """knots: the sorted history thinned to at most ``count`` evenly spaced values."""
    s = hist.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("s"))
    n = F.size("s")
    thin = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.get("s", F.floor(k * (n - 1) / F.lit(float(count - 1))).cast("int")))
    return s.select("id", F.when(n > count, thin).otherwise(F.col("s")).alias("knots"))


def last_value(hist: DataFrame) -> DataFrame:
    return hist.groupBy("id").agg(F.max_by("x", "t").alias("x_last"))


def full(hist: DataFrame) -> DataFrame:
    """The scalar calibration columns of a series in one row, from one exchange.

    Means and deviations are window aggregates on the partitioning that the group-by needs too, so
    nothing is joined or shuffled again.
    """
    whole = Window.partitionBy("id")
    rows = hist.withColumns({"mu": F.avg("x").over(whole), "sd": at_least(F.coalesce(F.stddev_samp("x").over(whole), F.lit(0.0)), 1e-9), "_1": previous("x"), "_2": previous("x", 2)})
    rows = rows.withColumns({"_d": F.col("x") - F.col("mu"), "_z": (F.col("x") - F.col("mu")) / F.col("sd"), "_f": F.col("x") - F.col("_1")})
    rows = rows.withColumns({"_p1": F.col("_d") * (F.col("_1") - F.col("mu")), "_p2": F.col("_d") * (F.col("_2") - F.col("mu"))})
    sums = rows.groupBy("id").agg(
        F.count("*").alias("n_hist"), F.max("mu").alias("mu"), F.max("sd").alias("sd"), F.median("x").alias("med"), F.avg(F.col("_z") ** 3).alias("_s"), F.avg(F.col("_z") ** 4).alias("_k"),
        F.sum(F.col("_d") ** 2).alias("_ss"), F.sum("_p1").alias("_p1"), F.sum("_p2").alias("_p2"), F.var_pop("_f").alias("_v"), F.avg(F.abs("_f")).alias("_a"),
        F.percentile("x", F.array(*map(F.lit, EDGES))).alias("_q"), F.max_by("x", "t").alias("x_last"),
    )
    n = F.col("n_hist")
    acf = lambda k: F.when((F.col("_ss") > 1e-12) & (n > k + 1), F.col(f"_p{k}") / F.col("_ss")).otherwise(0.0)
    out = sums.select(
        "id", "n_hist", "mu", "sd", "med", F.when(n > 2, F.col("_s")).otherwise(0.0).alias("skew"), F.when(n > 3, F.col("_k") - 3).otherwise(0.0).alias("kurt"),
        acf(1).alias("acf1_h"), acf(2).alias("acf2_h"), at_least(F.coalesce("_v", F.lit(1.0)), 1e-9).alias("dvar_h"), at_least(F.coalesce("_a", F.lit(1.0)), 1e-9).alias("dabs_h"), _rising("_q").alias("edges"), "x_last",
    )
    return out.withColumn("phi", clip("acf1_h", -0.95, 0.95))
