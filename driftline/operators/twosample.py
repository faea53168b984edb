"""Two-sample statistics of each series' history against its online rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.windows import previous, trailing, with_running


def gaps(series: DataFrame) -> DataFrame:
    """Per distinct value of a series: both distribution functions and the step to the next value.

    One window by value ranks both samples at once; RANGE frames let equal values share.
    """
    counted = series.groupBy("id", "x").agg(F.count_if(F.col("period") == 1).alias("a"), F.count_if(F.col("period") == 2).alias("b"))
    order, whole = Window.partitionBy("id").orderBy("x"), Window.partitionBy("id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counted.withColumns({"ca": F.sum("a").over(so_far), "cb": F.sum("b").over(so_far), "na": F.sum("a").over(whole), "nb": F.sum("b").over(whole), "dx": F.lead("x").over(order) - F.col("x")})
    return rows.filter("na > 0 and nb > 0").withColumns({"fa": F.col("ca") / F.col("na"), "fb": F.col("cb") / F.col("nb")})


def kolmogorov(series: DataFrame) -> DataFrame:
    return gaps(series).groupBy("id").agg(F.max(F.abs(F.col("fa") - F.col("fb"))).alias("ks"))


def cramer(series: DataFrame) -> DataFrame:
    """Integral of the squared gap of the distribution functions."""
    return gaps(series).groupBy("id").agg(F.coalesce(F.sum((F.col("fa") - F.col("fb")) ** 2 * F.col("dx")), F.lit(0.0)).alias("energy"))


def anderson_darling(series: DataFrame) -> DataFrame:
    """Mean over the pooled rows but the last value's of the squared gap over H(1 - H)."""
    rows = gaps(series).withColumn("h", (F.col("ca") + F.col("cb")) / (F.col("na") + F.col("nb")))
    term = (F.col("fa") - F.col("fb")) ** 2 / F.greatest(F.col("h") * (1 - F.col("h")), F.lit(1e-6))
    w = F.col("a") + F.col("b")
    return rows.filter("dx is not null").groupBy("id").agg((F.sum(term * w) / F.sum(w)).alias("ad"))


def _quantiles(series: DataFrame, at: list[float]) -> DataFrame:
    q = F.array(*map(F.lit, at))
    return series.groupBy("id").agg(F.percentile(F.when(F.col("period") == 1, F.col("x")), q).alias("qa"), F.percentile(F.when(F.col("period") == 2, F.col("x")), q).alias("qb"), F.stddev_samp(F.when(F.col("period") == 1, F.col("x"))).alias("sd")).filter("qa is not null and qb is not null")


def wasserstein(series: DataFrame, points: int = 64) -> DataFrame:
    """Mean distance of equal quantiles over the history's standard deviation."""
    q = _quantiles(series, [(k + 0.5) / points for k in range(points)])
    total = F.aggregate(F.zip_with("qa", "qb", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    return q.select("id", (total / points / F.greatest("sd", F.lit(1e-9))).alias("w1"))


def iqr_log_ratio(series: DataFrame) -> DataFrame:
    q = _quantiles(series, [0.25, 0.75])
    spread = lambda c: F.greatest(F.col(c)[1] - F.col(c)[0], F.lit(1e-9))
    return q.select("id", F.log(spread("qb") / spread("qa")).alias("iqr_log_ratio"))


def hurst(rows: DataFrame, lags=(2, 4, 8, 16, 32)) -> DataFrame:
    """Slope of log standard deviation of lagged differences over log lag, of ``rows(id, t, x)``."""
    d = rows.withColumns({f"d{k}": F.col("x") - previous("x", k) for k in lags})
    sds = d.groupBy("id").agg(*[F.stddev_pop(f"d{k}").alias(f"s{k}") for k in lags])
    points = F.array(*[F.struct(F.log(F.lit(float(k))).alias("lx"), F.log(F.greatest(F.col(f"s{k}"), F.lit(1e-12))).alias("ly")) for k in lags])
    flat = sds.select("id", F.explode(points).alias("p")).filter("p.ly is not null")
    return flat.groupBy("id").agg(F.regr_slope("p.ly", "p.lx").alias("hurst"))


def permutation_entropy(rows: DataFrame) -> DataFrame:
    """Entropy of the order patterns of three consecutive values, ties by position, over log 6."""
    p = rows.withColumns({"a": previous("x", 2), "b": previous("x")}).filter("a is not null")
    code = (F.col("a") <= F.col("b")).cast("int") * 4 + (F.col("b") <= F.col("x")).cast("int") * 2 + (F.col("a") <= F.col("x")).cast("int")
    counts = p.groupBy("id", code.alias("code")).count()
    share = F.col("count") / F.sum("count").over(Window.partitionBy("id"))
    return counts.withColumn("s", share).groupBy("id").agg((-F.sum(F.col("s") * F.log("s")) / float(np.log(6))).alias("perm_entropy"))


def matched_filters(df: DataFrame, lengths=(20, 40, 80, 160)) -> DataFrame:
    """Per length L at each online row: edge (later half's mean less the earlier's, scaled), var_env (log variance ratio of the halves), block (window sum over sqrt L) and ramp (correlation with a rising line); 0 until L rows are there."""
    df = with_running(df, c0=F.col("z"), c2=F.col("z") ** 2, ct=F.col("z") * F.col("t"))
    for length in lengths:
        half = length // 2
        s, late = trailing("c0", length), trailing("c0", half)
        q, q_late = trailing("c2", length), trailing("c2", half)
        var = lambda q, s: F.greatest(q / half - (s / half) ** 2, F.lit(1e-12))  # noqa: B023, E731
        middle = F.col("t") - (length - 1) / 2
        norm = float(np.sqrt((length**3 - length) / 12))
        ready = lambda c: F.when(F.col("n") >= length, c).otherwise(0.0)  # noqa: B023, E731
        df = df.withColumns({"_s": s, "_l": late, "_q": q, "_ql": q_late, "_t": trailing("ct", length)})
        df = df.withColumns({
            f"edge{length}": ready((2 * F.col("_l") - F.col("_s")) / float(np.sqrt(length))),
            f"var_env{length}": ready(F.log(var(F.col("_ql"), F.col("_l")) / var(F.col("_q") - F.col("_ql"), F.col("_s") - F.col("_l")))),
            f"block{length}": ready(F.col("_s") / float(np.sqrt(length))),
            f"ramp{length}": ready((F.col("_t") - middle * F.col("_s")) / norm),
        })
    return df.drop("_s", "_l", "_q", "_ql", "_t", "c0", "c2", "ct")


def spectrum(z: np.ndarray) -> dict[str, float]:
    """Entropy, centroid, low-band share, dominant bin and power of a Hann-windowed segment."""
    z = z[-128:]
    p = np.abs(np.fft.rfft((z - z.mean()) * np.hanning(len(z)))) ** 2
    total = p.sum()
    if len(p) < 3 or total <= 1e-12:
        return dict.fromkeys(("entropy", "centroid", "low_band", "dominant", "power"), 0.0)
    s = p / total
    k = np.arange(len(p))
    live = s[s > 0]
    return {"entropy": float(-(live * np.log(live)).sum() / np.log(len(p))), "centroid": float((k * s).sum() / len(p)), "low_band": float(s[: max(1, len(p) // 4)].sum()), "dominant": float(np.argmax(p) / len(p)), "power": float(np.log(total))}


def spectral_contrasts(series: DataFrame) -> DataFrame:
    """Differences of the spectra's statistics between the online rows and the history, one row a series.  An FFT per series needs NumPy."""
    names = ("entropy", "centroid", "low_band", "dominant", "power")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("time")
        h, o = (g.x.values[g.period.values == p] for p in (1, 2))
        if len(h) < 16 or len(o) < 16:
            return pd.DataFrame(columns=["id", *names])
        sd = max(h.std(), 1e-9)
        a, b = spectrum((h - h.mean()) / sd), spectrum((o - h.mean()) / sd)
        return pd.DataFrame([{"id": g.id.values[0]} | {k: b[k] - a[k] for k in names}])

    return series.select("id", "time", "x", "period").groupBy("id").applyInPandas(one, "id long, " + ", ".join(f"{k} double" for k in names))


def embedding_distances(vectors: DataFrame) -> DataFrame:
    """Cosine and L2 distance of ``(key, a, b)`` vector pairs."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    l2 = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda p, q: (p.cast("double") - q.cast("double")) ** 2), F.lit(0.0), lambda s, v: s + v))
    cosine = 1 - dot("a", "b") / F.greatest(F.sqrt(dot("a", "a") * dot("b", "b")), F.lit(1e-12))
    return vectors.select("key", cosine.alias("cosine"), l2.alias("l2"))


def pooled_mean(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """Element-wise mean of vectors by a key, as an array."""
    flat = vectors.select(by, F.posexplode(vector).alias("i", "v")).groupBy(by, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return flat.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("mean"))


def summary(series: DataFrame) -> DataFrame:
    """Per series: lengths, moments of both segments, mean shift, standard-deviation ratio, KS."""
    p = lambda k: F.when(F.col("period") == k, F.col("x"))
    base = series.groupBy("id").agg(F.count(p(1)).alias("n_hist"), F.count(p(2)).alias("n_online"), F.avg(p(1)).alias("mean_hist"), F.avg(p(2)).alias("mean_online"), F.stddev_samp(p(1)).alias("sd_hist"), F.stddev_samp(p(2)).alias("sd_online"), F.skewness(p(1)).alias("skew_hist"), F.kurtosis(p(1)).alias("kurt_hist"))
    out = base.join(kolmogorov(series), "id", "left")
    return out.withColumns({"mean_shift": (F.col("mean_online") - F.col("mean_hist")) / F.greatest("sd_hist", F.lit(1e-9)), "std_ratio": F.col("sd_online") / F.greatest("sd_hist", F.lit(1e-9))})


def break_stats(series: DataFrame, labels: DataFrame) -> DataFrame:
    """Per broken series: the change of mean (in history's standard deviations), log variance, lag-1 autocorrelation and KS after the break."""
    after = labels.filter("target = 1").select("id", "t", "x")
    hist = series.filter("period = 1").select("id", "time", "x")
    h = hist.groupBy("id").agg(F.avg("x").alias("mu"), F.greatest(F.stddev_samp("x"), F.lit(1e-9)).alias("sd"))
    a = after.groupBy("id").agg(F.count("*").alias("n_post"), F.avg("x").alias("m"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("s"))

    def acf(df, name):
        w = Window.partitionBy("id")
        d = df.withColumn("d", F.col("x") - F.avg("x").over(w))
        d = d.withColumn("p", F.col("d") * F.lag("d").over(w.orderBy(df.columns[1])))
        return d.groupBy("id").agg(F.coalesce(F.try_divide(F.sum("p"), F.sum(F.col("d") ** 2)), F.lit(0.0)).alias(name))

    ks = kolmogorov(hist.select("id", "x", F.lit(1).alias("period")).unionByName(after.select("id", "x", F.lit(2).alias("period"))))
    out = a.join(h, "id").join(acf(hist, "ah"), "id").join(acf(after, "aa"), "id").join(ks, "id")
    return out.select("id", "n_post", ((F.col("m") - F.col("mu")) / F.col("sd")).alias("dmean"), F.log(F.greatest(F.col("s") ** 2, F.lit(1e-12)) / F.col("sd") ** 2).alias("dlogvar"), (F.col("aa") - F.col("ah")).alias("dacf"), "ks")


def type_flags(stats: DataFrame) -> DataFrame:
    """Overlapping flags by thresholds."""
    mean, var, acf = F.abs("dmean") > 0.5, F.abs(F.col("dlogvar") / 2) > float(np.log(1.5)), F.abs("dacf") > 0.2
    return stats.select("id", mean.cast("int").alias("is_mean"), var.cast("int").alias("is_var"), acf.cast("int").alias("is_acf"), (~(mean | var | acf)).cast("int").alias("is_subtle"))


def type_dominant(stats: DataFrame) -> DataFrame:
    """The deviation that is largest in units of its threshold."""
    m, v, a = F.abs("dmean") / 0.25, F.abs("dlogvar") / 0.30, F.abs("dacf") / 0.12
    top = F.greatest(m, v, a)
    kind = F.when(F.col("n_post") < 20, "short_post").when(top < 1, "subtle").when(m == top, "mean").when(v == top, "var").otherwise("acf")
    return stats.select("id", kind.alias("kind"))


def type_ks(stats: DataFrame) -> DataFrame:
    """By KS first, then mean and variance."""
    mean, var = F.abs("dmean") > 0.25, F.abs("dlogvar") > 0.30
    kind = F.when(F.col("ks") < 0.15, "subtle").when(mean & var, "both").when(mean, "mean").when(var, "var").otherwise("other")
    return stats.select("id", kind.alias("kind"))


def shares(df: DataFrame, *flags: str) -> DataFrame:
    return df.agg(*[F.avg(F.col(f).cast("double")).alias(f"share_{f}") for f in flags])
