"""Feature blocks of online rows: cumulative, trailing, scanned, prewhitened and derived statistics.

Every block takes ``prepared`` rows ``(id, t, n, x, z, calibration...)`` and adds columns.  ``n`` is the
number of online rows so far and ``min(n, W)`` a trailing window's fill.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.windows import at_least, clip, previous, reflected, running, running_max, running_min, safe_log, smoothed, so_far, trailing, with_running
from driftline.operators import calibration
from driftline.operators.calibration import EDGES, GRID
from driftline.sources.series import history, online

WINDOWS = (25, 50, 100, 200, 400)
LAGS = (1, 2, 3, 4, 5)


def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def default_values() -> dict[str, float | list[float]]:
    """What a series without any history is calibrated with; null tables are those of independent normal values."""
    out = {"n_hist": 0, "edges": [-1 + 2 * k / 18 for k in range(19)], "knots": [-3 + 6 * k / 255 for k in range(256)], "zcr_h": 0.5, "cross_rate_h": 0.5, "acf1_h_abs": 0.0}
    out |= {c: 0.0 for c in ("mu", "skew", "kurt", "med", "x_last", "phi", *(f"acf{k}_h" for k in LAGS))} | {c: 1.0 for c in ("sd", "dvar_h", "dabs_h", "lrv")}
    flat = {"mz": (0, 1, 0), "lv": (-1, 2**0.5, 1), "acf": (0, 1, 1), "ks": (0.86, 0.35, 1), "l1": (0.4, 0.2, 1), "skew": (0, 6**0.5, 1), "kurt": (0, 24**0.5, 1)}
    for name, (loc, scale, shrinks) in (flat | {f"{s}_{c}": (0, 1, 1) for s in ("a", "d", "xs") for c in ("mean", "acf")}).items():
        out[f"null_{name}_loc"] = [loc / (g if name == "lv" else g**0.5) for g in GRID]
        out[f"null_{name}_scale"] = [scale / g**0.5 if shrinks else float(scale) for g in GRID]
    return out


def defaults() -> dict[str, Column]:
    """The default values as columns."""
    return {c: _array(v) if isinstance(v, list) else F.lit(v).cast("long") if c == "n_hist" else F.lit(v) for c, v in default_values().items()}


def _beside(df: DataFrame, per_series: DataFrame) -> DataFrame:
    """Rows beside their series' table; a series that has no row there gets the defaults."""
    known = defaults()
    return df.join(per_series, "id", "left").withColumns({c: F.coalesce(c, known[c]) for c in per_series.columns if c in known})


def prepared(series: DataFrame, cal: DataFrame | None = None) -> DataFrame:
    """Online rows with their series' calibration and z-scores; a series without history is measured against a standard normal one."""
    cal = calibration.full(history(series)) if cal is None else cal
    return _beside(online(series), cal).withColumns({"n": F.col("t") + 1, "z": (F.col("x") - F.col("mu")) / F.col("sd")})


def _central(n: Column, s1: Column, s2: Column, s3: Column, s4: Column) -> tuple[Column, Column, Column, Column]:
    """Mean, population variance, skewness and excess kurtosis from power sums."""
    m = s1 / n
    v = at_least(s2 / n - m * m, 0.0)
    live = (n > 2) & (v > 1e-12)
    m3 = s3 / n - 3 * m * s2 / n + 2 * m**3
    m4 = s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * m**4
    v_ = at_least(v, 1e-12)
    return m, v, F.when(live, m3 / v_**1.5).otherwise(0.0), F.when(live, m4 / v_**2 - 3).otherwise(0.0)


def with_powers(df: DataFrame, c: str = "z", prefix: str = "s") -> DataFrame:
    return with_running(df, **{f"{prefix}{k}": F.col(c) ** k for k in (1, 2, 3, 4)})


def cumulative_moments(df: DataFrame) -> DataFrame:
    """cum_mean_dev, cum_mean_z, cum_logvar_ratio, cum_skew, cum_kurt and the last two against the history."""
    df = with_powers(df)
    m, v, skew, kurt = _central(F.col("n"), *(F.col(f"s{k}") for k in (1, 2, 3, 4)))
    return df.withColumns({"cum_mean_dev": m, "cum_mean_z": m * F.sqrt("n"), "cum_logvar_ratio": safe_log(v * F.col("sd") ** 2) - safe_log(F.col("sd") ** 2), "cum_skew": skew, "cum_kurt": kurt, "cum_skew_diff": skew - F.col("skew"), "cum_kurt_diff": kurt - F.col("kurt")})


def time_features(df: DataFrame) -> DataFrame:
    some = F.col("n_hist") > 0
    return df.withColumns({"log_t": F.log("n"), "log_n_hist": F.when(some, F.log("n_hist")).otherwise(0.0), "t_over_nhist": F.when(some, F.col("n") / F.greatest("n_hist", F.lit(1))).otherwise(0.0)})


def ewma(df: DataFrame, alpha: float, name: str, c: str = "z") -> DataFrame:
    """EWMA z-score, seeded with the first value."""
    q = 1 - alpha
    value = smoothed(F.col(c), alpha)
    effective = (1 - F.pow(F.lit(q), F.col("n"))) / alpha
    return df.withColumn(name, value * F.sqrt(at_least(effective, 1.0)))


def cusum(df: DataFrame, k: float, name: str, c: str = "z") -> DataFrame:
    """Running maximum of the two-sided CUSUM with allowance k, raw and over sqrt(n); reflected walks, no recursion."""
    df = with_running(df, _up=F.col(c) - k, _down=-F.col(c) - k)
    df = df.withColumn("_c", F.greatest(reflected("_up"), reflected("_down")))
    return df.withColumn(name, running_max("_c")).withColumn(f"{name}_n", F.col(name) / F.sqrt("n")).drop("_up", "_down", "_c")


def cusum_bank(df: DataFrame) -> DataFrame:
    for k, tag in ((0.25, "k025"), (0.5, "k05"), (1.0, "k10")):
        df = cusum(df, k, f"cusum_absmax_{tag}")
    return df


def cusum_variance(df: DataFrame) -> DataFrame:
    return cusum(df.withColumn("_v", F.col("z") ** 2 - 1), 0.5, "cusum_var_absmax", "_v").drop("_v")


def page_hinkley(df: DataFrame) -> DataFrame:
    df = with_running(df, _p=F.col("z"))
    up, down = F.col("_p") - F.least(F.lit(0.0), running_min("_p")), F.greatest(F.lit(0.0), running_max("_p")) - F.col("_p")
    return df.withColumn("_h", F.greatest(up, down)).withColumn("ph_mean", F.col("_h")).withColumn("ph_mean_n", F.col("_h") / F.sqrt("n")).drop("_p", "_h")


def tail_excess(df: DataFrame) -> DataFrame:
    """Shares beyond 2 and 3 standard deviations and below the median, less what a normal history has."""
    share = lambda cond: running(F.when(cond, 1.0).otherwise(0.0)) / F.col("n")
    return df.withColumns({"tail2_excess": share(F.abs("z") > 2) - 0.0455, "tail3_excess": share(F.abs("z") > 3) - 0.0027, "below_hist_med_excess": share(F.col("x") < F.col("med")) - 0.5})


def cumulative_acf(df: DataFrame) -> DataFrame:
    """online_acf1, online_acf2 and their differences from the history; 0 until there are two pairs."""
    df = with_running(df, s1=F.col("z"), s2=F.col("z") ** 2)
    df = df.withColumns({f"_l{k}": F.coalesce(F.col("z") * previous("z", k), F.lit(0.0)) for k in (1, 2)})
    df = with_running(df, _q1=F.col("_l1"), _q2=F.col("_l2"))
    m = F.col("s1") / F.col("n")
    v = at_least(F.col("s2") / F.col("n") - m * m, 1e-12)
    value = lambda k: F.when(F.col("n") - k > 1, clip((F.col(f"_q{k}") / (F.col("n") - k) - m * m) / v, -1.0, 1.0)).otherwise(0.0)
    out = df.withColumns({"online_acf1": value(1), "online_acf2": value(2)})
    return out.withColumns({f"acf{k}_diff": F.col(f"online_acf{k}") - F.col(f"acf{k}_h") for k in (1, 2)}).drop("_l1", "_l2", "_q1", "_q2", "s1", "s2")


def difference_features(df: DataFrame, width: int = 50) -> DataFrame:
    """dvar_ratio_cum, dvar_ratio_win and dabs_ratio_cum of first differences."""
    df = df.withColumn("_d", F.col("x") - previous("x"))
    df = with_running(df, _d1=F.coalesce("_d", F.lit(0.0)), _d2=F.coalesce(F.col("_d") ** 2, F.lit(0.0)), _da=F.coalesce(F.abs("_d"), F.lit(0.0)), _dn=F.when(F.col("_d").isNull(), 0.0).otherwise(1.0))
    df = df.withColumns({f"{c}w": trailing(c, width) for c in ("_d1", "_d2", "_dn")})
    var = lambda a, b, n: at_least(F.try_divide(b, n) - F.try_divide(a, n) ** 2, 0.0)
    log_ratio = lambda v: safe_log(v) - F.log("dvar_h")
    some = F.col("_dn") > 1
    out = df.withColumns({
        "dvar_ratio_cum": F.when(some, log_ratio(var(F.col("_d1"), F.col("_d2"), F.col("_dn")))).otherwise(0.0),
        "dvar_ratio_win": F.when(some, log_ratio(var(F.col("_d1w"), F.col("_d2w"), F.col("_dnw")))).otherwise(0.0),
        "dabs_ratio_cum": F.when(some, F.col("_da") / F.col("_dn") / F.col("dabs_h")).otherwise(1.0),
    })
    return out.drop("_d", "_d1", "_d2", "_da", "_dn", "_d1w", "_d2w", "_dnw")


def with_bins(df: DataFrame, c: str = "x") -> DataFrame:
    """bin 0..19: how many of the history's edges are at most the value; b{j} counts the rows so far with bin <= j."""
    df = df.withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col(c))))
    return with_running(df, **{f"b{j}": F.when(F.col("bin") <= j, 1.0).otherwise(0.0) for j in range(19)})


def _shape(below: list[Column], n: Column) -> tuple[Column, Column, Column]:
    """KS, the sum of absolute gaps and chi-square per row, from the counts below each of the 19 edges."""
    gaps = [F.abs(c / n - q) for c, q in zip(below, EDGES)]
    expected = n / 20.0
    counts = [b - a for a, b in zip([F.lit(0.0), *below], [*below, n])]
    chi2 = reduce(lambda a, b: a + b, [(c - expected) ** 2 / expected for c in counts]) / n
    return F.greatest(*gaps), reduce(lambda a, b: a + b, gaps), chi2


def cumulative_shape(df: DataFrame) -> DataFrame:
    """ks_stat, ecdf_l1 (a sum over edges) and chi2_cum (over n) of the online values against the history's quantiles."""
    df = with_bins(df)
    ks, l1, chi2 = _shape([F.col(f"b{j}") for j in range(19)], F.col("n").cast("double"))
    return df.withColumns({"ks_stat": ks, "ecdf_l1": l1, "chi2_cum": chi2}).drop(*(f"b{j}" for j in range(19)), "bin")


def _with(df: DataFrame, per_series: DataFrame | None) -> DataFrame:
    """Rows beside their series' table; without one they carry its columns already."""
    return df if per_series is None else _beside(df, per_series)


def fill(width: int) -> Column:
    return F.least(F.col("n"), F.lit(width))


def window_moments(df: DataFrame, widths=WINDOWS, names=("mean_z", "logvar", "skew", "kurt")) -> DataFrame:
    """w{W}_mean_z, _logvar, _skew and _kurt of z over the last W rows; the mean is scaled by sqrt of the fill."""
    df = with_powers(df)
    for w in widths:
        df = df.withColumns({f"_t{k}": trailing(f"s{k}", w) for k in (1, 2, 3, 4)})
        m, v, skew, kurt = _central(fill(w), *(F.col(f"_t{k}") for k in (1, 2, 3, 4)))
        values = {"mean_z": m * F.sqrt(fill(w)), "logvar": safe_log(v), "skew": skew, "kurt": kurt}
        df = df.withColumns({f"w{w}_{k}": values[k] for k in names})
    return df.drop("_t1", "_t2", "_t3", "_t4", "s1", "s2", "s3", "s4")


def window_acf(df: DataFrame, widths=WINDOWS, lags=(1,), c: str = "z", name="w{w}_acf{k}") -> DataFrame:
    """Lagged autocorrelation inside the last W rows: pairs with both ends inside, the window's mean and variance."""
    df = with_running(df, _a1=F.col(c), _a2=F.col(c) ** 2)
    df = df.withColumns({f"_l{k}": F.coalesce(F.col(c) * previous(c, k), F.lit(0.0)) for k in lags})
    df = with_running(df, **{f"_q{k}": F.col(f"_l{k}") for k in lags})
    for w in widths:
        df = df.withColumns({"_m": trailing("_a1", w) / fill(w), "_s": trailing("_a2", w) / fill(w)} | {f"_w{k}": trailing(f"_q{k}", w - k) for k in lags})
        v = at_least(F.col("_s") - F.col("_m") ** 2, 1e-12)
        pairs = lambda k: fill(w) - k  # noqa: B023, E731
        df = df.withColumns({name.format(w=w, k=k): F.when(pairs(k) > 1, clip((F.col(f"_w{k}") / F.greatest(pairs(k), F.lit(1)) - F.col("_m") ** 2) / v, -1.0, 1.0)).otherwise(0.0) for k in lags})
    return df.drop("_a1", "_a2", "_m", "_s", *(f"{p}{k}" for p in ("_l", "_q", "_w") for k in lags))


def window_shape(df: DataFrame, widths=WINDOWS) -> DataFrame:
    """w{W}_ks, w{W}_l1 (a mean over edges) and w{W}_chi2 of the last W values against the history's quantiles."""
    df = with_bins(df)
    for w in widths:
        df = df.withColumns({f"_b{j}": trailing(f"b{j}", w) for j in range(19)})
        ks, l1, chi2 = _shape([F.col(f"_b{j}") for j in range(19)], fill(w).cast("double"))
        df = df.withColumns({f"w{w}_ks": ks, f"w{w}_l1": l1 / 19.0, f"w{w}_chi2": chi2})
    return df.drop("bin", *(f"{p}{j}" for p in ("b", "_b") for j in range(19)))


# null tables: what the same statistics do on the break-free history.  A series' history is one array and each scale a
# few operations on its running sums, so the tables are made in NumPy, for all series of one length at once: as column
# expressions seven scales of windows outgrow what the JVM compiles.


class History:
    """Histories of one length in order, a row each: values, z-scores, and their calibration."""

    def __init__(self, x: np.ndarray, cal: dict):
        self.x, self.n, self.cal = x, x.shape[1], cal
        self.z = (x - cal["mu"][:, None]) / cal["sd"][:, None]

    def table(self, values: dict[int, tuple[np.ndarray, np.ndarray]], loc, scale, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Location and scale by series over the grid: measured where the history holds two windows, else the last measured one; the defaults for fewer than 64 rows."""
        out, last = np.empty((2, len(self.x), len(GRID))), None
        for k, g in enumerate(GRID):
            if self.n >= 64 and g in values:
                last = values[g][0], np.maximum(values[g][1], floor)
            out[0, :, k], out[1, :, k] = last if self.n >= 64 and last else (loc(g), scale(g))
        return out[0], out[1]

    def scales(self, parts: int):
        """(scale, last rows of its windows): windows start at multiples of a fraction of the scale."""
        for g in GRID:
            if self.n >= 64 and self.n >= 2 * g:
                yield g, np.arange(g - 1, self.n, max(1, g // parts))


def _sums(v: np.ndarray) -> np.ndarray:
    """Running sums with a zero before them."""
    return np.concatenate([np.zeros((*v.shape[:-1], 1)), np.cumsum(v, axis=-1)], axis=-1)


def _over(sums: np.ndarray, ends: np.ndarray, g: int) -> np.ndarray:
    """Sums of the ``g`` rows up to each end."""
    return sums[..., ends + 1] - sums[..., ends + 1 - g]


def _mean_sd(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = np.ascontiguousarray(v)
    return v.mean(axis=1), v.std(axis=1)


def _lag_products(v: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((len(v), 1)), v[:, 1:] * v[:, :-1]], axis=1)


def _moment_nulls(h: History) -> dict:
    c1, c2, cl = _sums(h.z), _sums(h.z**2), _sums(_lag_products(h.z))
    mz, lv, acf = {}, {}, {}
    for g, e in h.scales(8):
        m = _over(c1, e, g) / g
        v = _over(c2, e, g) / g - m * m
        mz[g], lv[g] = _mean_sd(m * g**0.5), _mean_sd(np.log(np.maximum(v, 1e-12)))
        acf[g] = _mean_sd(np.clip((_over(cl, e, g - 1) / (g - 1) - m * m) / np.maximum(v, 1e-12), -1, 1) - h.cal["acf1_h"][:, None])
    return {"mz": h.table(mz, lambda g: 0.0, lambda g: 1.0, 0.05), "lv": h.table(lv, lambda g: -1.0 / g, lambda g: (2.0 / g) ** 0.5, 0.01), "acf": h.table(acf, lambda g: 0.0, lambda g: g**-0.5, 0.01)}


def _shape_nulls(h: History) -> dict:
    below = _sums((h.x[:, None] < h.cal["edges"][:, :, None]).astype(float))
    ks, l1 = {}, {}
    for g, e in h.scales(4):
        gaps = np.abs(_over(below, e, g) / g - np.array(EDGES)[:, None])
        for out, v in ((ks, gaps.max(axis=1)), (l1, gaps.sum(axis=1) / 19.0)):
            middle, high = np.percentile(v, [50, 90], axis=1)
            out[g] = middle, high - middle
    return {"ks": h.table(ks, lambda g: 0.86 / g**0.5, lambda g: 0.35 / g**0.5, 0.005), "l1": h.table(l1, lambda g: 0.4 / g**0.5, lambda g: 0.2 / g**0.5, 0.003)}


def _stream_nulls(h: History, stream: str) -> dict:
    if stream == "a":
        v = np.abs(h.z)
    elif stream == "d":
        v = np.diff(h.z, axis=1, prepend=h.z[:, :1])
    else:
        side = h.x < h.cal["med"][:, None]
        v = np.concatenate([np.zeros((len(side), 1)), (side[:, 1:] != side[:, :-1]).astype(float)], axis=1)
    c1, c2, cl = _sums(v), _sums(v**2), _sums(_lag_products(v))
    mean, acf = {}, {}
    for g, e in h.scales(8):
        m = _over(c1, e, g) / g
        mean[g] = _mean_sd(m)
        acf[g] = _mean_sd(np.clip((_over(cl, e, g - 1) / (g - 1) - m * m) / np.maximum(_over(c2, e, g) / g - m * m, 1e-12), -1, 1))
    return {f"{stream}_mean": h.table(mean, lambda g: 0.0, lambda g: g**-0.5, 1e-4), f"{stream}_acf": h.table(acf, lambda g: 0.0, lambda g: g**-0.5, 1e-3)}


def _shape_moment_nulls(h: History) -> dict:
    z2 = h.z * h.z
    sums = [_sums(v) for v in (h.z, z2, z2 * h.z, z2 * z2)]
    skew, kurt = {}, {}
    for g, e in h.scales(8):
        s1, s2, s3, s4 = (_over(s, e, g) / g for s in sums)
        v = np.maximum(s2 - s1 * s1, 0.0)
        live, v_ = v > 1e-12, np.maximum(v, 1e-12)
        skew[g] = _mean_sd(np.where(live, (s3 - 3 * s1 * s2 + 2 * s1**3) / v_**1.5, 0.0))
        kurt[g] = _mean_sd(np.where(live, (s4 - 4 * s1 * s3 + 6 * s1 * s1 * s2 - 3 * s1**4) / v_**2 - 3, 0.0))
    return {"skew": h.table(skew, lambda g: 0.0, lambda g: (6.0 / g) ** 0.5, 1e-3), "kurt": h.table(kurt, lambda g: 0.0, lambda g: (24.0 / g) ** 0.5, 1e-3)}


_NULLS = {"moments": (_moment_nulls, ("mz", "lv", "acf")), "shape": (_shape_nulls, ("ks", "l1")), "shape_moments": (_shape_moment_nulls, ("skew", "kurt"))}
_NULLS |= {s: (partial(_stream_nulls, stream=s), (f"{s}_mean", f"{s}_acf")) for s in ("a", "d", "xs")}


def null_arrays(h: History, kinds) -> dict[str, np.ndarray]:
    """null_{name}_loc and null_{name}_scale of the kinds, (series, scale)."""
    found = {}
    for k in kinds:
        found |= _NULLS[k][0](h)
    return {f"null_{n}_{part}": v for n, table in found.items() for part, v in zip(("loc", "scale"), table)}


def null_tables(hist: DataFrame, cal: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row a series with null_{name}_loc and null_{name}_scale, arrays over the scale grid, for each statistic of the kinds; one exchange for all."""
    names = [f"null_{n}_{part}" for k in kinds for n in _NULLS[k][1] for part in ("loc", "scale")]
    needs = [c for c in ("mu", "sd", "med", "acf1_h", "edges") if c in cal.columns]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        found = null_arrays(History(g.x.values.astype(float)[None], {c: np.array([g[c].values[0]]) for c in needs}), kinds)
        return pd.DataFrame({"id": g.id.values[:1]} | {n: [found[n][0].tolist()] for n in names})

    return hist.join(cal.select("id", *needs), "id").groupBy("id").applyInPandas(one, "id long, " + ", ".join(f"{n} array<double>" for n in names))


def null_moments(hist: DataFrame, cal: DataFrame) -> DataFrame:
    """Arrays over the scale grid: null_mz_{loc,scale}, null_lv_{loc,scale}, null_acf_{loc,scale}."""
    return null_tables(hist, cal, ("moments",))


def null_shape(hist: DataFrame, cal: DataFrame) -> DataFrame:
    """Arrays over the scale grid: null_ks_{loc,scale} and null_l1_{loc,scale}, the median and the spread up to the 0.9 quantile."""
    return null_tables(hist, cal, ("shape",))


def null_stream(hist: DataFrame, cal: DataFrame, stream: str) -> DataFrame:
    """Arrays over the scale grid for a derived stream: null_{stream}_mean_{loc,scale} and null_{stream}_acf_{loc,scale}."""
    return null_tables(hist, cal, (stream,))


def null_shape_moments(hist: DataFrame, cal: DataFrame) -> DataFrame:
    """Arrays over the scale grid: null_skew_{loc,scale} and null_kurt_{loc,scale}."""
    return null_tables(hist, cal, ("shape_moments",))


def interpolated(table: str, width: int) -> Column:
    """A null table at the window's fill, linear in log2 between scales and constant beyond them."""
    at = clip(F.log2(fill(width).cast("double")) - 3, 0.0, float(len(GRID) - 1))
    low = F.least(F.floor(at), F.lit(len(GRID) - 2)).cast("int")
    f = at - low
    return F.get(table, low) * (1 - f) + F.get(table, low + 1) * f


def calibrated_windows(df: DataFrame, nulls: DataFrame | None, widths=WINDOWS) -> DataFrame:
    """w{W}_nmz, _nlv, _nacf, _nks, _nl1: window statistics in units of their null; nmz is scaled only.  0 below a fill of 5."""
    df = window_moments(_with(df, nulls), widths, ("mean_z", "logvar"))
    df = window_shape(window_acf(df, widths), widths)
    for w in widths:
        ready = fill(w) >= 5
        unit = lambda c, s, centre=True: F.when(ready, (c - (interpolated(f"null_{s}_loc", w) if centre else F.lit(0.0))) / interpolated(f"null_{s}_scale", w)).otherwise(0.0)  # noqa: B023, E731
        df = df.withColumns({
            f"w{w}_nmz": unit(F.col(f"w{w}_mean_z"), "mz", False), f"w{w}_nlv": unit(F.col(f"w{w}_logvar"), "lv"),
            f"w{w}_nacf": unit(F.col(f"w{w}_acf1") - F.col("acf1_h"), "acf"), f"w{w}_nks": unit(F.col(f"w{w}_ks"), "ks"), f"w{w}_nl1": unit(F.col(f"w{w}_l1"), "l1"),
        })
    return df


def scans(df: DataFrame, widths=WINDOWS) -> DataFrame:
    """scan_*: the largest calibrated window statistic (absolute for mean, variance and acf), and rm_scan_*: its running maximum."""
    pick = {s: F.greatest(F.lit(0.0), *[F.abs(f"w{w}_{s}") if s in ("nmz", "nlv", "nacf") else F.col(f"w{w}_{s}") for w in widths]) for s in ("nmz", "nlv", "nacf", "nks", "nl1")}
    df = df.withColumns({f"scan_{s}": c for s, c in pick.items()})
    return df.withColumns({f"rm_scan_{s}": running_max(f"scan_{s}") for s in pick})


def prewhitened(df: DataFrame) -> DataFrame:
    """pw_*: the CUSUM, variance, EWMA, mean and acf statistics of AR(1) residuals; the first follows the history's last value."""
    before = F.coalesce(previous("z"), (F.col("x_last") - F.col("mu")) / F.col("sd"))
    df = df.withColumn("e", (F.col("z") - F.col("phi") * before) / F.sqrt(at_least(1 - F.col("phi") ** 2, 1e-4)))
    df = cusum(df, 0.25, "pw_cusum_absmax_k025", "e")
    df = cusum(df, 0.5, "pw_cusum_absmax_k05", "e")
    df = cusum(df.withColumn("_v", F.col("e") ** 2 - 1), 0.5, "pw_cusum_var_absmax", "_v")
    df = ewma(df, 0.1, "pw_ewma_z", "e")
    df = df.withColumn("_p", F.coalesce(F.col("e") * previous("e"), F.lit(0.0)))
    df = with_running(df, _e1=F.col("e"), _e2=F.col("e") ** 2, _q=F.col("_p"))
    n = F.col("n")
    m = F.col("_e1") / n
    v = at_least(F.col("_e2") / n - m * m, 1e-12)
    acf = F.when(n > 2, clip((F.col("_q") / F.greatest(n - 1, F.lit(1)) - m * m) / v, -1.0, 1.0)).otherwise(0.0)
    return df.withColumns({"pw_cum_mean_z": F.col("_e1") / F.sqrt(n), "pw_cum_logvar": safe_log(F.col("_e2") / n), "pw_acf1": acf}).drop("_v", "_p", "_q", "_e1", "_e2")


def derived_streams(df: DataFrame) -> DataFrame:
    """a = abs z, d = z minus the z before (the history's last one first), side changes against the median."""
    before = F.coalesce(previous("x"), F.col("x_last"))
    return df.withColumns({"a": F.abs("z"), "d": (F.col("x") - before) / F.col("sd"), "xs": ((F.col("x") < F.col("med")) != (before < F.col("med"))).cast("double")})


def derived_windows(df: DataFrame, nulls: DataFrame | None, stream: str, widths=(50, 200)) -> DataFrame:
    """{stream}_nmz_w{W}, {stream}_nacf_w{W}, their scans and running maxima."""
    df = derived_streams(_with(df, nulls))
    df = window_acf(df, widths, (1,), stream, "_acf_w{w}")
    df = with_running(df, _sum=F.col(stream))
    for w in widths:
        unit = lambda c, s: F.when(fill(w) >= 5, (c - interpolated(f"null_{stream}_{s}_loc", w)) / interpolated(f"null_{stream}_{s}_scale", w)).otherwise(0.0)  # noqa: B023, E731
        df = df.withColumns({f"{stream}_nmz_w{w}": unit(trailing("_sum", w) / fill(w), "mean"), f"{stream}_nacf_w{w}": unit(F.col(f"_acf_w{w}"), "acf")})
    df = df.withColumns({f"{stream}_scan_{s}": F.greatest(*[F.abs(f"{stream}_{c}_w{w}") for w in widths]) for s, c in (("mz", "nmz"), ("acf", "nacf"))})
    return df.withColumns({f"rm_{stream}_scan_{s}": running_max(f"{stream}_scan_{s}") for s in ("mz", "acf")}).drop("_sum", *(f"_acf_w{w}" for w in widths))


def shape_moment_windows(df: DataFrame, nulls: DataFrame | None, widths=(100, 200, 400, 800)) -> DataFrame:
    """hm{W}_nskew and hm{W}_nkurt in units of their null (0 below a fill of 8), scans and running maxima."""
    df = window_moments(_with(df, nulls), widths, ("skew", "kurt"))
    for w in widths:
        unit = lambda s: F.when(fill(w) >= 8, (F.col(f"w{w}_{s}") - interpolated(f"null_{s}_loc", w)) / interpolated(f"null_{s}_scale", w)).otherwise(0.0)  # noqa: B023, E731
        df = df.withColumns({f"hm{w}_nskew": unit("skew"), f"hm{w}_nkurt": unit("kurt")})
    df = df.withColumns({f"hm_scan_{s}": F.greatest(*[F.abs(f"hm{w}_n{s}") for w in widths]) for s in ("skew", "kurt")})
    return df.withColumns({f"rm_hm_scan_{s}": running_max(f"hm_scan_{s}") for s in ("skew", "kurt")})


def lrv_scaled(df: DataFrame, lrv: DataFrame) -> DataFrame:
    """cum_mean_z, ph_mean and the CUSUM maxima over the square root of the long-run variance, and its log."""
    df = cusum_bank(page_hinkley(cumulative_moments(_beside(df, lrv))))
    named = {f"{c}_lrv": F.col(c) / F.sqrt("lrv") for c in ("cum_mean_z", "ph_mean", "cusum_absmax_k025", "cusum_absmax_k05", "cusum_absmax_k10")}
    return df.withColumns(named | {"log_lrv": F.log("lrv")})


def with_pit(df: DataFrame, knots: DataFrame) -> DataFrame:
    """p: the value's place among the history's knots, (number at most x + 0.5) / (number + 1)."""
    df = _beside(df, knots)
    return df.withColumn("p", (F.size(F.filter("knots", lambda k: k <= F.col("x"))) + 0.5) / (F.size("knots") + 1.0))


def pit_windows(df: DataFrame, widths=(120, 480)) -> DataFrame:
    """xw{W}_pit_*: mean z, log variance against 1/12, skew, both tails and the share below a half over the last W; and the same so far (xc_)."""
    df = df.withColumns({"u": F.col("p") - 0.5, "lo": (F.col("p") < 0.25).cast("double"), "hi": (F.col("p") > 0.75).cast("double"), "bl": (F.col("p") < 0.5).cast("double")})
    df = with_running(df, _u1=F.col("u"), _u2=F.col("u") ** 2, _u3=F.col("u") ** 3, _lo=F.col("lo"), _hi=F.col("hi"), _bl=F.col("bl"))

    def stats(n, u1, u2, u3):
        m = u1 / n
        v = at_least(u2 / n - m * m, 1e-12)
        return m * F.sqrt(12.0 * n), F.log(v * 12.0), F.when(v > 1e-12, (u3 / n - 3 * m * u2 / n + 2 * m**3) / v**1.5).otherwise(0.0)

    for w in widths:
        ready = lambda c: F.when(fill(w) >= 8, c).otherwise(0.0)  # noqa: B023, E731
        df = df.withColumns({f"_w{c}": trailing(f"_{c}", w) for c in ("u1", "u2", "u3", "lo", "hi", "bl")})
        mean, logvar, skew = stats(fill(w), F.col("_wu1"), F.col("_wu2"), F.col("_wu3"))
        share = lambda c, e: F.col(f"_w{c}") / fill(w) - e  # noqa: B023, E731
        df = df.withColumns({f"xw{w}_pit_{k}": ready(v) for k, v in {"mean_z": mean, "logvar": logvar, "skew": skew, "tail_lo": share("lo", 0.25), "tail_hi": share("hi", 0.25), "below": share("bl", 0.5)}.items()})
    mean, logvar, skew = stats(F.col("n"), F.col("_u1"), F.col("_u2"), F.col("_u3"))
    return df.withColumns({"xc_pit_mean_z": mean, "xc_pit_logvar": logvar, "xc_pit_skew": skew, "xc_pit_below": F.col("_bl") / F.col("n") - 0.5})


def robust_windows(df: DataFrame, widths=(120, 480), lags=LAGS) -> DataFrame:
    """On rz, the distance from the median in halves of the knots' middle 68 %: xw{W}_acf{k} less the history's, and xw{W}_cumslope, the window's mean.

    Zero below a fill of 8; a lag needs more than two pairs.  Takes rows with ``knots`` and acf1_h to acf5_h.
    """
    m = F.size("knots")
    low, high = F.get("knots", F.floor(0.159 * m).cast("int")), F.get("knots", F.least(m - 1, F.floor(0.841 * m).cast("int")))
    df = df.withColumn("rz", (F.col("x") - F.col("med")) / at_least((high - low) / 2.0, 1e-9))
    df = with_running(df, _a1=F.col("rz"), _a2=F.col("rz") ** 2)
    df = df.withColumns({f"_l{k}": F.coalesce(F.col("rz") * previous("rz", k), F.lit(0.0)) for k in lags})
    df = with_running(df, **{f"_q{k}": F.col(f"_l{k}") for k in lags})
    for w in widths:
        df = df.withColumns({"_m": trailing("_a1", w) / fill(w), "_s": trailing("_a2", w) / fill(w)} | {f"_w{k}": trailing(f"_q{k}", w - k) for k in lags})
        v = at_least(F.col("_s") - F.col("_m") ** 2, 1e-12)
        pairs = lambda k: fill(w) - k  # noqa: B023, E731
        acf = lambda k: F.when(pairs(k) > 2, clip((F.col(f"_w{k}") / F.greatest(pairs(k), F.lit(1)) - F.col("_m") ** 2) / v, -1.0, 1.0)).otherwise(0.0)  # noqa: B023, E731
        ready = lambda c: F.when(fill(w) >= 8, c).otherwise(0.0)  # noqa: B023, E731
        df = df.withColumns({f"xw{w}_acf{k}": ready(acf(k) - F.col(f"acf{k}_h")) for k in lags} | {f"xw{w}_cumslope": ready(F.col("_m"))})
    return df.drop("_a1", "_a2", "_m", "_s", *(f"{p}{k}" for p in ("_l", "_q", "_w") for k in lags))


def constants(df: DataFrame) -> DataFrame:
    """What stays the same for a series: null_smz64, null_slv64, null_sacf64, null_mem_slope, null_skurt128 (of the null tables) and kurt_h."""
    at = lambda c, g: F.get(c, F.lit(GRID.index(g)))
    slope = F.log(at_least(at("null_mz_scale", 256), 1e-6) / at_least(at("null_mz_scale", 16), 1e-6))
    return df.withColumns({"null_smz64": at("null_mz_scale", 64), "null_slv64": at("null_lv_scale", 64), "null_sacf64": at("null_acf_scale", 64), "null_mem_slope": slope, "null_skurt128": at("null_kurt_scale", 128), "kurt_h": F.col("kurt")})


def squashed_ewma(df: DataFrame, alpha: float = 0.05, kappa: float = 3.0) -> DataFrame:
    """baseline: tanh of the size of the EWMA z-score over kappa, the plainest score there is."""
    return ewma(df, alpha, "_e").withColumn("baseline", F.tanh(F.abs("_e") / kappa)).drop("_e")


def turning_difference(df: DataFrame, rates: DataFrame | None) -> DataFrame:
    """zcr_d: the running share of sign changes among nonzero differences, less the history's.  It never forgets."""
    df = _with(df, rates).withColumn("_s", F.signum(F.col("x") - previous("x"))).withColumn("_s", F.when(F.col("_s") != 0, F.col("_s")))
    df = df.withColumn("_b", F.last("_s", ignorenulls=True).over(so_far())).withColumn("_b", previous("_b"))
    pair = F.col("_s").isNotNull() & F.col("_b").isNotNull()
    df = with_running(df, _n=F.when(pair, 1.0).otherwise(0.0), _k=F.when(pair & (F.col("_s") != F.col("_b")), 1.0).otherwise(0.0))
    return df.withColumn("zcr_d", F.when(F.col("_n") > 0, F.col("_k") / F.greatest("_n", F.lit(1.0)) - F.col("zcr_h")).otherwise(0.0)).drop("_s", "_b", "_n", "_k")


def raw_stream(df: DataFrame, bound: float = 8.0) -> DataFrame:
    """z clipped, its square and its size."""
    z = clip("z", -bound, bound)
    return df.withColumns({"zc": z, "z2": z * z, "absz": F.abs(z)})


def midrank_stream(series: DataFrame) -> DataFrame:
    """(id, t, pit, pit_c, surprise): online values' mid-ranks in their history.

    History and online rows are ranked in one window by value, so no row meets its whole history.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("id").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("id", "x")
    past = F.when(F.col("period") == 1, 1).otherwise(0)
    rows = series.withColumns({"le": F.sum(past).over(order), "eq": F.sum(past).over(same), "n_hist": F.sum(past).over(Window.partitionBy("id"))}).filter("period = 2 and n_hist > 0")
    n = F.col("n_hist").cast("double")
    p = clip((F.col("le") - F.col("eq") / F.lit(2.0)) / n, 0.0, 1.0)
    p = F.least(F.greatest(p, 0.5 / n), 1 - 0.5 / n)
    rows = rows.withColumn("pit", p)
    return rows.select("id", "t", "pit", (2 * F.col("pit") - 1).alias("pit_c"), (-F.log(2 * F.least("pit", 1 - F.col("pit")) + 1 / n)).alias("surprise"))
