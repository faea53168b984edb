"""Sequential detectors over online rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalars import lgamma
from driftline.functions.windows import at_least, clip, previous, running, trailing, with_running

#: Fixed alternatives (mean shift, standard deviation) of the Shiryaev-Roberts mixture: 6 means, 4 variances, 4 joint.
ALTERNATIVES = ((-2.0, 1.0), (-1.0, 1.0), (-0.5, 1.0), (0.5, 1.0), (1.0, 1.0), (2.0, 1.0), (0.0, 0.5), (0.0, 1.5), (0.0, 2.5), (0.0, 4.0), (1.0, 2.0), (-1.0, 2.0), (1.5, 0.5), (-1.5, 0.5))
HAZARDS = (0.003, 0.01, 0.03)


def log_ratio(z: Column, delta: float, rho: float) -> Column:
    """Log likelihood ratio of N(delta, rho^2) against N(0, 1) at a point."""
    return -math.log(rho) - (z - delta) ** 2 / (2 * rho * rho) + z * z / 2


def residuals(df: DataFrame) -> DataFrame:
    """AR(1) residuals; the first one is z itself."""
    e = F.coalesce((F.col("z") - F.col("phi") * previous("z")) / F.sqrt(at_least(1 - F.col("phi") ** 2, 1e-4)), F.col("z"))
    return df.withColumn("e", e)


def shiryaev_roberts(df: DataFrame, c: str = "z", alternatives=ALTERNATIVES, start: float = -50.0) -> DataFrame:
    """(id, t, log_sr): log of the mean over alternatives of R, where R = (1 + R) * ratio and log R starts at ``start``.

    Written out, log R at a step is the sum C of the log ratios so far plus the log of exp(start) + the sum of exp(-C)
    over all steps before, which NumPy accumulates in log space for a whole series and all alternatives at once.
    """
    delta, rho = (np.array(x) for x in zip(*alternatives))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        z = g[c].values[:, None]
        log_r = _absorbing(-np.log(rho) - (z - delta) ** 2 / (2 * rho * rho) + z * z / 2, start)
        return pd.DataFrame({"id": g.id.values, "t": g.t.values, "log_sr": np.logaddexp.reduce(log_r, axis=1) - math.log(len(delta))})

    return df.select("id", "t", c).groupBy("id").applyInPandas(one, "id long, t long, log_sr double")


def _absorbing(steps: np.ndarray, start: float = -math.inf) -> np.ndarray:
    """Log of R by rows, where R = (1 + R) * exp(step) and log R is ``start`` before the first row."""
    total = np.cumsum(steps, axis=0)
    before = np.vstack([np.zeros((1, total.shape[1])), total[:-1]])
    return total + np.logaddexp(start, np.logaddexp.accumulate(-before, axis=0))


def cumulative_ratio(df: DataFrame, delta: float = 1.0, rho: float = 1.0) -> DataFrame:
    """llr: running log likelihood ratio of one alternative."""
    return with_running(df, llr=log_ratio(F.col("z"), delta, rho))


def atoms(count: int = 48) -> list[tuple[float, float]]:
    """A fixed grid of (mean change, log variance) that stands for the breaks seen."""
    k = np.arange(count)
    return [(float(d), float(v)) for d, v in zip(np.round(-1.5 + 3 * ((k * 7) % count) / (count - 1), 6), np.round(-1.2 + 2.4 * k / (count - 1), 6))]


def mixture_ratio(z: Column, mixture) -> Column:
    """Likelihood ratio of a mixture of atoms at a point."""
    terms = [F.exp(log_ratio(z, d, math.exp(v / 2))) for d, v in mixture]
    return sum(terms[1:], terms[0]) / float(len(mixture))


def hmm_posterior(df: DataFrame, hazards=HAZARDS, mixture=None) -> DataFrame:
    """Posterior of the absorbing state, averaged over hazards: odds o = ratio * (o + h) / (1 - h), all in log space.

    With R = o / h these are the odds of :func:`_absorbing`, accumulated for a whole series and all hazards at once.
    """
    log_lr = F.log(at_least(mixture_ratio(F.col("z"), mixture or atoms(16)), 1e-300))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        return pd.DataFrame({"id": g.id.values, "t": g.t.values, "posterior": _posteriors(g.l.values, hazards).mean(axis=1)})

    return df.select("id", "t", log_lr.alias("l")).groupBy("id").applyInPandas(one, "id long, t long, posterior double")


def _posteriors(log_lr: np.ndarray, hazards) -> np.ndarray:
    """Posterior of the absorbing state by row and hazard."""
    h = np.array(hazards)
    return 1 / (1 + np.exp(-np.clip(_absorbing(log_lr[:, None] - np.log1p(-h)) + np.log(h), -700, 700)))


def innovation_posterior(series: DataFrame, mixture: list[tuple[float, float]], hazards=HAZARDS) -> DataFrame:
    """(id, t, post_{hazard}, cum_llr): the two-state filter on AR(1) innovations with Student densities.

    The history gives the mean, the AR(1) coefficient, the innovations' scale and, by their kurtosis, the degrees of
    freedom.  A break of the ``mixture`` (mean change in historical standard deviations, log variance ratio) moves the
    innovations' mean by sqrt((1 - rho) / (1 + rho)) of it and stretches them.  cum_llr is the sum of the log ratios.
    """
    dmean, lvr = (np.array(x) for x in zip(*mixture))
    names = [f"post_{str(h)[2:]}" for h in hazards]

    def log_density(u, df):
        return math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(u * u / df)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("time")
        past = g.period.values == 1
        h, o = g.x.values[past], g.x.values[~past]
        if not len(h) or not len(o):
            return pd.DataFrame(columns=["id", "t", *names, "cum_llr"])
        d = h - h.mean()
        ss = float(d @ d)
        rho = float(np.clip(d[:-1] @ d[1:] / ss, -0.95, 0.95)) if ss >= 1e-12 else 0.0
        e = d[1:] - rho * d[:-1]
        scale = float(e.std() if len(e) else 0.0) + 1e-9
        kurt = float(((e / scale) ** 4).mean() - 3) if len(e) > 8 else 0.0
        df = min(max(4 + 6 / kurt, 4.5), 40.0) if kurt > 0.2 else 40.0
        x = np.concatenate([h[-1:], o]) - h.mean()
        u = ((x[1:] - rho * x[:-1]) / scale)[:, None]
        wide = np.exp(lvr / 2)
        broken = log_density((u - dmean * math.sqrt((1 - rho) / (1 + rho))) / wide, df) - np.log(wide)
        log_lr = np.logaddexp.reduce(broken, axis=1) - math.log(len(dmean)) - log_density(u[:, 0], df)
        out = dict(zip(names, _posteriors(np.clip(log_lr, -50, 50), hazards).T))
        return pd.DataFrame({"id": g.id.values[0], "t": np.arange(len(o))} | out | {"cum_llr": np.cumsum(log_lr)})

    return series.select("id", "time", "x", "period").groupBy("id").applyInPandas(one, f"id long, t long, {', '.join(f'{n} double' for n in names)}, cum_llr double")


def student_log_density(df: DataFrame) -> DataFrame:
    """log_t: log density of z under Student's t scaled to unit variance; degrees of freedom 4 + 6 / kurtosis within [4.5, 40]."""
    df = df.withColumn("df", clip(4 + 6 / at_least("kurt", 1e-3), 4.5, 40.0))
    s = F.sqrt((F.col("df") - 2) / F.col("df"))
    const = lgamma((F.col("df") + 1) / 2) - lgamma(F.col("df") / 2) - 0.5 * F.log(F.col("df") * math.pi) - F.log(s)
    return df.withColumn("log_t", const - (F.col("df") + 1) / 2 * F.log1p((F.col("z") / s) ** 2 / F.col("df")))


def kernel_density(df: DataFrame, hist: DataFrame, bound: float = 8.0, most: int = 512, trail: int = 128) -> DataFrame:
    """kde_logp: Gaussian-kernel log density of z under its history, its running mean and trailing mean.

    The history is thinned to at most ``most`` evenly spaced values, kept as an array beside each row,
    so nothing is joined pair by pair.
    """
    z = hist.join(df.select("id", "mu", "sd").distinct(), "id").select("id", clip((F.col("x") - F.col("mu")) / F.col("sd"), -bound, bound).alias("z"))
    s = z.groupBy("id").agg(F.array_sort(F.collect_list("z")).alias("s"), F.stddev_pop("z").alias("spread"))
    n = F.size("s")
    thin = F.when(n > most, F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.get("s", F.floor(k * (n - 1) / F.lit(float(most - 1))).cast("int")))).otherwise(F.col("s"))
    kernel = s.select("id", thin.alias("atoms"), at_least(1.06 * F.col("spread") * F.pow(n.cast("double"), F.lit(-0.2)), 0.05).alias("bw"))
    rows = df.join(kernel, "id").withColumn("zc", clip("z", -bound, bound))
    logs = F.transform("atoms", lambda a: -0.5 * ((F.col("zc") - a) / F.col("bw")) ** 2)
    rows = rows.withColumn("_l", logs).withColumn("_m", F.array_max("_l"))
    total = F.aggregate("_l", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("_m")))
    rows = rows.withColumn("kde_logp", F.col("_m") + F.log(total) - F.log(F.size("atoms") * F.col("bw") * math.sqrt(2 * math.pi)))
    rows = with_running(rows, _c=F.col("kde_logp"))
    return rows.withColumns({"kde_cum": F.col("_c") / F.col("n"), "kde_trail": trailing("_c", trail) / F.least(F.col("n"), F.lit(trail))}).drop("_l", "_m", "_c", "atoms")


def bound_to(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def kernel_excess(df: DataFrame, hist: DataFrame, bound: float = 8.0, most: int = 512, trail: int = 128) -> DataFrame:
    """kde_excess_cum and kde_excess_trail: how far the online log density lies below the history's own.

    The bandwidth is 0.9 min(sd, IQR / 1.34) n^-0.2 and at least 0.05; a history of more than ``most`` values is thinned
    evenly.  Each series' kernel and its own mean log density travel as one array beside its rows.
    """
    z = hist.join(df.select("id", "mu", "sd").distinct(), "id").select("id", clip((F.col("x") - F.col("mu")) / F.col("sd"), -bound, bound).alias("z"))
    s = z.groupBy("id").agg(F.array_sort(F.collect_list("z")).alias("s"))
    n = F.size("s")
    thin = F.when(n > most, F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.get("s", F.floor(k * (n - 1) / F.lit(float(most - 1))).cast("int")))).otherwise(F.col("s"))
    flat = s.select("id", thin.alias("atoms")).select("id", "atoms", F.explode("atoms").alias("a"))
    spread = flat.groupBy("id").agg(F.first("atoms").alias("atoms"), F.count("*").alias("m"), F.stddev_pop("a").alias("dev"), F.percentile("a", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    width = 0.9 * F.least(F.col("dev") + 1e-9, (F.col("q")[1] - F.col("q")[0]) / 1.34 + 1e-9) * F.pow(F.col("m").cast("double"), F.lit(-0.2))
    kernel = spread.select("id", "atoms", at_least(width, 0.05).alias("bw"))

    def log_density(v: Column) -> Column:
        parts = F.transform("atoms", lambda a: -0.5 * ((v - a) / F.col("bw")) ** 2)
        total = bound_to(parts, lambda p: bound_to(F.array_max(p), lambda top: top + F.log(F.aggregate(p, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))))
        return total - F.log(F.size("atoms") * F.col("bw") * math.sqrt(2 * math.pi))

    own = kernel.withColumn("base", F.aggregate(F.transform("atoms", log_density), F.lit(0.0), lambda acc, x: acc + x) / F.size("atoms"))
    rows = df.join(own, "id").withColumn("_l", log_density(clip("z", -bound, bound)))
    rows = with_running(rows, _c=F.col("_l"))
    return rows.withColumns({"kde_excess_cum": F.col("base") - F.col("_c") / F.col("n"), "kde_excess_trail": F.col("base") - trailing("_c", trail) / F.least(F.col("n"), F.lit(trail))}).drop("_l", "_c", "atoms", "bw", "base")


def hazard_probability(df: DataFrame, hazard: str = "h") -> DataFrame:
    """p_break: 1 - product of (1 - h), which never falls."""
    return df.withColumn("p_break", 1 - F.exp(running(F.log1p(-clip(hazard, 0.0, 1 - 1e-9)))))


def postprocess(scores: DataFrame, alpha: float = 0.3) -> DataFrame:
    """run_max, ewma and half_max of a score per series."""
    from driftline.functions.windows import running_max, smoothed

    rows = scores.withColumns({"run_max": running_max("score"), "ewma": smoothed(F.col("score"), alpha)})
    return rows.withColumn("half_max", 0.5 * F.col("score") + 0.5 * F.col("run_max"))


def wavelet_bands(series: DataFrame, levels: int = 6, widths=(120, 480), skip: int = 8) -> DataFrame:
    """Band energies of a cascade of averages s_j = (s_j + s_(j-1)) / 2, details s_(j-1) - s_j.

    wv{W}_band{j} and wvc_band{j}: log of a trailing or running mean of squared details over the
    history's; wv{W}_coarse_z: trailing mean of the last average against the history's.  Each average is a
    convolution with halving weights, a series at a time in Arrow batches.
    """
    names = [f"wv{w}_band{j}" for w in widths for j in range(1, levels + 1)] + [f"wv{w}_coarse_z" for w in widths] + [f"wvc_band{j}" for j in range(1, levels + 1)]

    halves = 0.5 ** np.arange(1, 65)  # weights beyond fall below a double's last digit

    def cascade(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        details, base = np.empty((levels, len(z))), z
        for j in range(levels):
            # the first value stands for all before it
            s = np.convolve(base, halves)[: len(z)] + base[0] * 0.5 ** np.minimum(np.arange(1.0, len(z) + 1), 1000.0)
            details[j], base = base - s, s
        return details, base

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("time")
        h, o = g.x.values[g.period.values == 1], g.x.values[g.period.values == 2]
        if not len(o):
            return pd.DataFrame(columns=["id", "t", *names])
        if len(h) < 32:
            return pd.DataFrame(np.zeros((len(o), len(names))), columns=names).assign(id=g.id.values[0], t=np.arange(len(o)))
        mu, sd = h.mean(), max(h.std(), 1e-9)
        dh, ch = cascade((h - mu) / sd)
        eh = np.maximum((dh[:, skip:] ** 2).mean(axis=1), 1e-12)
        d, c = cascade((o - mu) / sd)
        n = np.arange(1, len(o) + 1)
        total, coarse = np.cumsum(d**2, axis=1), np.cumsum(c)
        cols = {}
        for w in widths:
            f = np.minimum(n, w)
            cut = lambda a: a - np.concatenate([np.zeros(min(w, len(a))), a[:-w]])  # noqa: B023, E731
            for j in range(levels):
                cols[f"wv{w}_band{j + 1}"] = np.log(np.maximum(cut(total[j]) / f, 1e-12) / eh[j])
            cols[f"wv{w}_coarse_z"] = cut(coarse) / f - ch[skip:].mean()
        for j in range(levels):
            cols[f"wvc_band{j + 1}"] = np.log(np.maximum(total[j] / n, 1e-12) / eh[j])
        return pd.DataFrame(cols)[names].assign(id=g.id.values[0], t=n - 1)

    schema = "id long, t long, " + ", ".join(f"{c} double" for c in names)
    return series.select("id", "time", "x", "period").groupBy("id").applyInPandas(lambda g: one(g)[["id", "t", *names]], schema)
