"""The feature bank in NumPy: calibration and features of many series at once.

A block holds series whose histories have one length, a row each, so that a step of the bank is one operation on
``(series, step)``; shorter online segments are padded at their end, which changes nothing before it.  A long
segment is a block of its own and comes in slices: ``Walk`` carries what the next slice needs.  The definitions are those of
``features`` and ``calibration``, whose blocks the tests hold against these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from driftline.operators import features
from driftline.operators.calibration import EDGES, GRID
from driftline.operators.features import LAGS, WINDOWS

#: Online rows of a block or of a slice of a long segment, of what waits to be dealt into blocks, and of a piece of an EWMA.
BLOCK, WAITING, STEPS = 8192, 131072, 1024
#: The rows before a slice that it looks back on at most, in windows.
REACH = 800


# ---- calibration


def _percentile(s: np.ndarray, p: float) -> np.ndarray:
    """A percentile of sorted rows by the formula that Spark's exact one uses, so that edges meet values alike."""
    at = (s.shape[1] - 1) * p
    low, high = int(np.floor(at)), int(np.ceil(at))
    a, b = s[:, low], s[:, high]
    return np.where(a == b, a, (high - at) * a + (at - low) * b) if high > low else a


def _total(v: np.ndarray) -> np.ndarray:
    """Sums of rows in order, as Spark adds."""
    return np.cumsum(v, axis=1)[:, -1]


def _correlation(d: np.ndarray, ss: np.ndarray, k: int) -> np.ndarray:
    if d.shape[1] <= k + 1:
        return np.zeros(len(d))
    return np.where(ss > 1e-12, _total(d[:, k:] * d[:, :-k]) / ss, 0.0)


def _deviation(x: np.ndarray) -> np.ndarray:
    """Sample standard deviation by Spark's updates, at least 1e-9."""
    mean, m2 = np.zeros(len(x)), np.zeros(len(x))
    for k, v in enumerate(np.ascontiguousarray(x.T), 1):
        delta = v - mean
        step = delta / k
        mean += step
        m2 += delta * (delta - step)
    return np.maximum(np.sqrt(m2 / (x.shape[1] - 1)) if x.shape[1] > 1 else np.zeros(len(x)), 1e-9)


def _turns(x: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By column of x but the first: is there a nonzero difference and one before it, have they other signs; and each row's last nonzero sign."""
    s = np.nan_to_num(np.sign(x[:, 1:] - x[:, :-1]))
    s = np.concatenate([np.zeros((len(x), 1)) if before is None else before[:, None], s], axis=1)
    at = np.maximum.accumulate(np.where(s != 0, np.arange(s.shape[1]), 0), axis=1)
    last = np.take_along_axis(s, at, axis=1)
    pair = (s[:, 1:] != 0) & (last[:, :-1] != 0)
    return pair, pair & (s[:, 1:] != last[:, :-1]), last[:, -1]


def calibration(x: np.ndarray, kinds=("moments", "shape", "shape_moments", "a", "d", "xs")) -> dict[str, np.ndarray]:
    """What ``calibration``'s tables and the null tables hold of each history, a row of x; histories of no rows get the defaults."""
    size, n = x.shape
    if not n:
        return _flat(size)
    cal = {"n_hist": np.full(size, n), "mu": _total(x) / n, "sd": _deviation(x), "x_last": x[:, -1]}
    mu, sd = cal["mu"][:, None], cal["sd"][:, None]
    s = np.sort(x, axis=1)
    cal["med"] = _percentile(s, 0.5)
    cal["edges"] = np.stack([_percentile(s, q) + j * 1e-12 for j, q in enumerate(EDGES)], axis=1)
    cal["knots"] = s[:, np.floor(np.arange(256) * (n - 1) / 255.0).astype(int)] if n > 256 else s
    d, z = x - mu, (x - mu) / sd
    ss = _total(d * d)
    cal["skew"] = _total(z * z * z) / n if n > 2 else np.zeros(size)
    cal["kurt"] = _total((z * z) ** 2) / n - 3 if n > 3 else np.zeros(size)
    cal |= {f"acf{k}_h": _correlation(d, ss, k) for k in LAGS}
    cal["phi"] = np.clip(cal["acf1_h"], -0.95, 0.95)
    f = np.diff(x, axis=1)
    cal["dvar_h"] = np.maximum(f.var(axis=1), 1e-9) if n > 1 else np.ones(size)
    cal["dabs_h"] = np.maximum(_total(np.abs(f)) / (n - 1), 1e-9) if n > 1 else np.ones(size)
    side = x < cal["med"][:, None]
    cal["cross_rate_h"] = (side[:, 1:] != side[:, :-1]).sum(axis=1) / (n - 1) if n > 1 else np.full(size, 0.5)
    a = np.abs(z)
    a = a - (_total(a) / n)[:, None]
    a_ss = _total(a * a)
    cal["acf1_h_abs"] = np.where(a_ss > 1e-12, _total(a[:, 1:] * a[:, :-1]) / a_ss, 0.0) if n > 1 else np.zeros(size)
    pair, turned, _ = _turns(x)
    pairs = pair.sum(axis=1)
    cal["zcr_h"] = np.where(pairs > 0, turned.sum(axis=1) / np.maximum(pairs, 1), 0.5)
    cal["lrv"] = _long_run_variance(z)
    return cal | features.null_arrays(features.History(x, cal), kinds)


def _long_run_variance(z: np.ndarray, lags: int = 64) -> np.ndarray:
    n = z.shape[1]
    d = z - (_total(z) / n)[:, None]
    ss, top = _total(d * d), min(lags, n - 1)
    rest = sum(((1 - k / (top + 1)) * np.einsum("st,st->s", d[:, k:], d[:, : n - k]) / ss for k in range(1, top + 1)), np.zeros(len(z)))
    return np.where((n < 8) | (ss <= 1e-12), 1.0, np.maximum(1 + 2 * rest, 0.05))


def _flat(size: int) -> dict[str, np.ndarray]:
    """The defaults of a series without history."""
    return {c: np.repeat(np.asarray(v)[None], size, axis=0) for c, v in features.default_values().items()}


# ---- walks over rows


class Sum:
    """Running sums of a slice, and those of the rows before it."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        self.now, self.before = now, before

    def trailing(self, width: int) -> np.ndarray:
        """Sums over the last ``width`` rows."""
        rows = self.now.shape[1]
        if self.before is None:
            out = self.now.copy()
            if rows > width:
                out[:, width:] -= self.now[:, :-width]
            return out
        past = np.concatenate([self.before[:, REACH - width :], self.now[:, : max(rows - width, 0)]], axis=1)
        return self.now - past[:, :rows]


class Walk:
    """Running statistics of series in step; what a later slice of the same series needs is kept under the statistic's name.

    Missing values (NaN) add nothing to sums, as in SQL; ``holes`` says whether a series has had one.
    """

    def __init__(self):
        self.kept, self.start, self.holes = {}, 0, False

    def known(self, v: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(v), 0.0, v) if self.holes else v

    def running(self, name: str, v: np.ndarray, windows: bool = False) -> Sum:
        """Running sum; with windows, rows up to REACH back are kept for trailing ones."""
        before, v = self.kept.get(name), self.known(v)
        if before is None:
            total = np.cumsum(v, axis=1)
        else:
            total = np.cumsum(np.concatenate([before[:, -1:], v], axis=1), axis=1)[:, 1:]
        if windows:
            past = np.zeros((len(v), REACH)) if before is None else before
            self.kept[name] = np.concatenate([past, total[:, -REACH:]], axis=1)[:, -REACH:]
        else:
            self.kept[name] = total[:, -1:].copy()
        return Sum(total, before if windows else None)

    def most(self, name: str, v: np.ndarray) -> np.ndarray:
        """Running maximum."""
        out = np.maximum.accumulate(v, axis=1)
        if name in self.kept:
            out = np.maximum(out, self.kept[name])
        self.kept[name] = out[:, -1:].copy()
        return out

    def least(self, name: str, v: np.ndarray) -> np.ndarray:
        """Running minimum."""
        return -self.most(name, -v)

    def after(self, name: str, v: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The row before, with ``first`` before the first row and for a missing one."""
        before = np.concatenate([self.kept.get(name, first[:, None]), v[:, :-1]], axis=1)
        self.kept[name] = v[:, -1:].copy()
        return np.where(np.isnan(before), first[:, None], before) if self.holes else before

    def products(self, name: str, v: np.ndarray, lags) -> dict[int, np.ndarray]:
        """Products with the row ``k`` before; 0 where there is none."""
        reach = max(lags)
        past = self.kept.get(name, np.zeros((len(v), reach)))
        full = np.concatenate([past, v], axis=1)
        self.kept[name] = full[:, -reach:].copy()
        return {k: v * full[:, reach - k : full.shape[1] - k] for k in lags}

    def ewma(self, name: str, v: np.ndarray, alpha: float) -> np.ndarray:
        """EWMA seeded with the first value, z-scored; in pieces of STEPS rows, whose weights do not overflow."""
        q, out = 1 - alpha, np.empty(v.shape)
        for a in range(0, v.shape[1], STEPS):
            piece = self.known(v[:, a : a + STEPS])
            at = np.arange(piece.shape[1])
            part = alpha * piece * (1 / q) ** at
            if name in self.kept:
                own = np.cumsum(part, axis=1) + self.kept[name] * q
            else:
                part[:, 0] = piece[:, 0]
                own = np.cumsum(part, axis=1)
            out[:, a : a + STEPS] = q**at * own
            self.kept[name] = out[:, a : a + STEPS][:, -1:].copy()
        n = self.start + np.arange(v.shape[1]) + 1
        return out * np.sqrt(np.maximum((1 - q**n) / alpha, 1.0))

    def cusum(self, name: str, v: np.ndarray, k: float) -> np.ndarray:
        """Running maximum of the two-sided CUSUM with allowance k."""
        up, down = self.running(f"{name}+", v - k).now, self.running(f"{name}-", -v - k).now
        up = up - np.minimum(self.least(f"{name}+m", up), 0.0)
        down = down - np.minimum(self.least(f"{name}-m", down), 0.0)
        return self.most(f"{name}^", np.maximum(up, down))


# ---- features


def _log(v):
    return np.log(np.maximum(v, 1e-12))


def _clip(v, low: float, high: float):
    return np.minimum(np.maximum(v, low), high)


def _central(n, s1, s2, s3=None, s4=None):
    """Mean, population variance and, from four power sums, skewness and excess kurtosis."""
    m = s1 / n
    v = np.maximum(s2 / n - m * m, 0.0)
    if s3 is None:
        return m, v
    live, v_ = (n > 2) & (v > 1e-12), np.maximum(v, 1e-12)
    m3 = s3 / n - 3 * m * s2 / n + 2 * (m * m * m)
    m4 = s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * (m * m) ** 2
    return m, v, np.where(live, m3 / (v_ * np.sqrt(v_)), 0.0), np.where(live, m4 / (v_ * v_) - 3, 0.0)


def _shape(below: list[np.ndarray], n):
    """KS, the sum of absolute gaps and chi-square per row, from the counts below each of the 19 edges."""
    expected = n / 20.0
    ks = l1 = last = 0.0
    chi2 = None
    for b, q in zip(below, EDGES):
        gap = np.abs(b / n - q)
        ks, l1 = np.maximum(ks, gap), l1 + gap
        miss = b - last - expected
        miss *= miss
        miss /= expected
        chi2, last = miss if chi2 is None else chi2 + miss, b
    return ks, l1, (chi2 + (n - last - expected) ** 2 / expected) / n


def _acf(n, pairs, products, m, s, most: int = 1):
    """Lagged autocorrelation from the sum of products, mean and mean square; 0 up to ``most`` pairs."""
    v = np.maximum(s - m * m, 1e-12)
    return np.where(pairs > most, _clip((products / np.maximum(pairs, 1) - m * m) / v, -1.0, 1.0), 0.0)


def rows(x: np.ndarray, cal: dict[str, np.ndarray], walk: Walk, widths=WINDOWS) -> dict[str, np.ndarray]:
    """The bank's columns by name, each spread over (series, step), for the next rows x of every series."""
    length = x.shape[1]
    walk.holes |= bool(np.isnan(x).any())
    by = {c: v[:, None] for c, v in cal.items() if v.ndim == 1}
    steps = walk.start + 1 + np.arange(length)
    n = steps.astype(float)
    root = np.sqrt(n)
    fill = {w: np.minimum(n, w) for w in {*widths, 50, 100, 200, 400, 800, 120, 480}}
    out = {c: by[c] for c in (*(f"acf{k}_h" for k in LAGS), "cross_rate_h", "acf1_h_abs", "zcr_h")}

    def unit(c, table: str, w: int, least: int = 5, centre: bool = True):
        """In units of a null table at the window's fill; 0 below a least fill."""
        at = np.clip(np.log2(fill[w]) - 3, 0.0, float(len(GRID) - 1))
        low = np.minimum(np.floor(at).astype(int), len(GRID) - 2)
        f = at - low
        loc, scale = (cal[f"null_{table}_{p}"][:, low] * (1 - f) + cal[f"null_{table}_{p}"][:, low + 1] * f for p in ("loc", "scale"))
        return np.where(fill[w] >= least, (c - loc if centre else c) / scale, 0.0)

    z = (x - by["mu"]) / by["sd"]
    z2 = z * z
    power = [walk.running(f"z{k}", v, True) for k, v in enumerate((z, z2, z2 * z, z2 * z2), 1)]
    some = by["n_hist"] > 0
    out |= {"log_t": np.log(n), "log_n_hist": np.where(some, np.log(np.maximum(by["n_hist"], 1)), 0.0), "t_over_nhist": np.where(some, n / np.maximum(by["n_hist"], 1), 0.0)}
    m, v, skew, kurt = _central(n, *(p.now for p in power))
    out |= {"cum_mean_dev": m, "cum_mean_z": m * root, "cum_logvar_ratio": _log(v * by["sd"] ** 2) - _log(by["sd"] ** 2), "cum_skew": skew, "cum_kurt": kurt, "cum_skew_diff": skew - by["skew"], "cum_kurt_diff": kurt - by["kurt"]}
    out |= {"ewma_z_fast": walk.ewma("fast", z, 0.05), "ewma_z_slow": walk.ewma("slow", z, 0.2)}
    absolute = np.abs(z)
    share = lambda name, cond: walk.running(name, cond.astype(float)).now / n
    out |= {"tail2_excess": share("tail2", absolute > 2) - 0.0455, "tail3_excess": share("tail3", absolute > 3) - 0.0027, "below_hist_med_excess": share("below", x < by["med"]) - 0.5}

    lagged = {k: walk.running(f"l{k}", p, k == 1) for k, p in walk.products("l", z, (1, 2)).items()}
    out |= {f"online_acf{k}": _acf(n, n - k, lagged[k].now, power[0].now / n, power[1].now / n) for k in (1, 2)}
    out |= {f"acf{k}_diff": out[f"online_acf{k}"] - by[f"acf{k}_h"] for k in (1, 2)}

    last = walk.kept.get("x", x[:, :1])
    before = walk.after("x", x, cal["x_last"])
    every = np.concatenate([last, x], axis=1)
    f = np.diff(every, axis=1)
    seen = ~np.isnan(f)
    seen[:, 0] &= walk.start > 0
    d1, d2, da, dn = walk.running("diff1", f, True), walk.running("diff2", f * f, True), walk.running("diffa", np.abs(f)).now, walk.running("diffn", seen.astype(float), True)
    dn, dw = dn.now, dn.trailing(50)
    spread = lambda a, b, k: np.maximum(b / np.maximum(k, 1) - (a / np.maximum(k, 1)) ** 2, 0.0)
    ratio = lambda a, b, k: np.where(dn > 1, _log(spread(a, b, k)) - np.log(by["dvar_h"]), 0.0)
    out |= {"dvar_ratio_cum": ratio(d1.now, d2.now, dn), "dvar_ratio_win": ratio(d1.trailing(50), d2.trailing(50), dw), "dabs_ratio_cum": np.where(dn > 1, da / np.maximum(dn, 1) / by["dabs_h"], 1.0)}

    placed_at = np.where(np.isnan(x), -np.inf, x) if walk.holes else x
    below = [walk.running(f"b{j}", (placed_at < cal["edges"][:, j : j + 1]).astype(float), True) for j in range(19)]
    out |= dict(zip(("ks_stat", "ecdf_l1", "chi2_cum"), _shape([b.now for b in below], n)))

    for k, tag in ((0.25, "k025"), (0.5, "k05"), (1.0, "k10")):
        out[f"cusum_absmax_{tag}"] = c = walk.cusum(tag, z, k)
        out[f"cusum_absmax_{tag}_n"] = c / root
    out["cusum_var_absmax"] = c = walk.cusum("var", z2 - 1, 0.5)
    out["cusum_var_absmax_n"] = c / root
    p = power[0].now
    out["ph_mean"] = h = np.maximum(p - np.minimum(walk.least("ph-", p), 0.0), np.maximum(walk.most("ph+", p), 0.0) - p)
    out["ph_mean_n"] = h / root

    moments = {w: [s.trailing(w) for s in power[: 4 if w in (100, 200, 400, 800) else 2]] for w in {*widths, 100, 200, 400, 800}}
    for w in widths:
        m, v = _central(fill[w], *moments[w][:2])
        out |= {f"w{w}_mean_z": m * np.sqrt(fill[w]), f"w{w}_logvar": _log(v)}
    for w in widths:
        out[f"w{w}_acf1"] = _acf(fill[w], fill[w] - 1, lagged[1].trailing(w - 1), moments[w][0] / fill[w], moments[w][1] / fill[w])
    for w in widths:
        ks, l1, chi2 = _shape([b.trailing(w) for b in below], fill[w])
        out |= {f"w{w}_ks": ks, f"w{w}_l1": l1 / 19.0, f"w{w}_chi2": chi2}
    for w in widths:
        out |= {
            f"w{w}_nmz": unit(out[f"w{w}_mean_z"], "mz", w, centre=False), f"w{w}_nlv": unit(out[f"w{w}_logvar"], "lv", w),
            f"w{w}_nacf": unit(out[f"w{w}_acf1"] - by["acf1_h"], "acf", w), f"w{w}_nks": unit(out[f"w{w}_ks"], "ks", w), f"w{w}_nl1": unit(out[f"w{w}_l1"], "l1", w),
        }
    scanned = ("nmz", "nlv", "nacf", "nks", "nl1")
    for s in scanned:
        top = np.zeros(x.shape)
        for w in widths:
            np.maximum(top, np.abs(out[f"w{w}_{s}"]) if s in ("nmz", "nlv", "nacf") else out[f"w{w}_{s}"], out=top)
        out[f"scan_{s}"] = top
    out |= {f"rm_scan_{s}": walk.most(f"scan_{s}", out[f"scan_{s}"]) for s in scanned}

    previous = walk.after("z", z, (cal["x_last"] - cal["mu"]) / cal["sd"])
    e = (z - by["phi"] * previous) / np.sqrt(np.maximum(1 - by["phi"] ** 2, 1e-4))
    e2 = e * e
    for name, v, k in (("pw_cusum_absmax_k025", e, 0.25), ("pw_cusum_absmax_k05", e, 0.5), ("pw_cusum_var_absmax", e2 - 1, 0.5)):
        out[name] = c = walk.cusum(name, v, k)
        out[f"{name}_n"] = c / root
    out["pw_ewma_z"] = walk.ewma("pw", e, 0.1)
    e1, es, eq = walk.running("e1", e).now, walk.running("e2", e2).now, walk.running("eq", walk.products("e", e, (1,))[1]).now
    out |= {"pw_cum_mean_z": e1 / root, "pw_cum_logvar": _log(es / n), "pw_acf1": _acf(n, n - 1, eq, e1 / n, es / n)}

    crossed = ((x < by["med"]) != (before < by["med"])).astype(float)
    streams = {"a": absolute, "d": (x - before) / by["sd"], "xs": np.where(np.isnan(x), np.nan, crossed) if walk.holes else crossed}
    for stream, v in streams.items():
        s1, s2, sq = walk.running(f"{stream}1", v, True), walk.running(f"{stream}2", v * v, True), walk.running(f"{stream}q", walk.products(stream, v, (1,))[1], True)
        for w in (50, 200):
            m = s1.trailing(w) / fill[w]
            acf = _acf(fill[w], fill[w] - 1, sq.trailing(w - 1), m, s2.trailing(w) / fill[w])
            out |= {f"{stream}_nmz_w{w}": unit(m, f"{stream}_mean", w), f"{stream}_nacf_w{w}": unit(acf, f"{stream}_acf", w)}
        both = (("mz", "nmz"), ("acf", "nacf"))
        out |= {f"{stream}_scan_{s}": np.maximum(np.abs(out[f"{stream}_{c}_w50"]), np.abs(out[f"{stream}_{c}_w200"])) for s, c in both}
        out |= {f"rm_{stream}_scan_{s}": walk.most(f"{stream}_scan_{s}", out[f"{stream}_scan_{s}"]) for s, _ in both}

    wide = (100, 200, 400, 800)
    for w in wide:
        _, _, out[f"w{w}_skew"], out[f"w{w}_kurt"] = _central(fill[w], *moments[w])
    for w in wide:
        out |= {f"hm{w}_n{s}": unit(out[f"w{w}_{s}"], s, w, 8) for s in ("skew", "kurt")}
    out |= {f"hm_scan_{s}": np.maximum.reduce([np.abs(out[f"hm{w}_n{s}"]) for w in wide]) for s in ("skew", "kurt")}
    out |= {f"rm_hm_scan_{s}": walk.most(f"hm_scan_{s}", out[f"hm_scan_{s}"]) for s in ("skew", "kurt")}
    out |= {f"{c}_lrv": out[c] / np.sqrt(by["lrv"]) for c in ("cum_mean_z", "ph_mean", "cusum_absmax_k025", "cusum_absmax_k05", "cusum_absmax_k10")} | {"log_lrv": np.log(by["lrv"])}

    knots = cal["knots"]
    p = (np.stack([k.searchsorted(v, "right") for k, v in zip(knots, placed_at)]) + 0.5) / (knots.shape[1] + 1.0)
    u = p - 0.5
    pit = {k: walk.running(f"pit_{k}", v, True) for k, v in {"u1": u, "u2": u * u, "u3": u * u * u, "lo": (p < 0.25).astype(float), "hi": (p > 0.75).astype(float), "bl": (p < 0.5).astype(float)}.items()}

    def placed(n, u1, u2, u3):
        m = u1 / n
        v = np.maximum(u2 / n - m * m, 1e-12)
        return m * np.sqrt(12.0 * n), np.log(v * 12.0), np.where(v > 1e-12, (u3 / n - 3 * m * u2 / n + 2 * (m * m * m)) / (v * np.sqrt(v)), 0.0)

    for w in (120, 480):
        mean, logvar, skew = placed(fill[w], *(pit[k].trailing(w) for k in ("u1", "u2", "u3")))
        of = lambda c, e: pit[c].trailing(w) / fill[w] - e  # noqa: B023, E731
        values = {"mean_z": mean, "logvar": logvar, "skew": skew, "tail_lo": of("lo", 0.25), "tail_hi": of("hi", 0.25), "below": of("bl", 0.5)}
        out |= {f"xw{w}_pit_{k}": np.where(fill[w] >= 8, v, 0.0) for k, v in values.items()}
    out |= dict(zip(("xc_pit_mean_z", "xc_pit_logvar", "xc_pit_skew"), placed(n, *(pit[k].now for k in ("u1", "u2", "u3")))))
    out["xc_pit_below"] = pit["bl"].now / n - 0.5

    count = knots.shape[1]
    low, high = knots[:, int(np.floor(0.159 * count))], knots[:, min(count - 1, int(np.floor(0.841 * count)))]
    rz = (x - by["med"]) / np.maximum((high - low) / 2.0, 1e-9)[:, None]
    r1, r2 = walk.running("r1", rz, True), walk.running("r2", rz * rz, True)
    rq = {k: walk.running(f"rq{k}", v, True) for k, v in walk.products("r", rz, LAGS).items()}
    for w in (120, 480):
        m, s = r1.trailing(w) / fill[w], r2.trailing(w) / fill[w]
        out |= {f"xw{w}_acf{k}": np.where(fill[w] >= 8, _acf(fill[w], fill[w] - k, rq[k].trailing(w - k), m, s, 2) - by[f"acf{k}_h"], 0.0) for k in LAGS}
        out[f"xw{w}_cumslope"] = np.where(fill[w] >= 8, m, 0.0)

    pair, turned, walk.kept["sign"] = _turns(every, walk.kept.get("sign"))
    pairs, turns = walk.running("pairs", pair.astype(float)).now, walk.running("turns", turned.astype(float)).now
    out["zcr_d"] = np.where(pairs > 0, turns / np.maximum(pairs, 1.0) - by["zcr_h"], 0.0)
    out["baseline"] = np.tanh(np.abs(out["ewma_z_fast"]) / 3.0)
    at = lambda c, g: cal[f"null_{c}_scale"][:, GRID.index(g), None]
    out |= {"null_smz64": at("mz", 64), "null_slv64": at("lv", 64), "null_sacf64": at("acf", 64), "null_mem_slope": np.log(np.maximum(at("mz", 256), 1e-6) / np.maximum(at("mz", 16), 1e-6)), "null_skurt128": at("kurt", 128), "kurt_h": by["kurt"]}
    walk.start += length
    return out


def columns(widths=WINDOWS) -> list[str]:
    """The names of the bank's features in order."""
    with np.errstate(all="ignore"):
        return list(rows(np.zeros((1, 1)), calibration(np.zeros((1, 0))), Walk(), widths))


# ---- series from batches of rows


class Bank:
    """Takes pieces of series in order and gives out blocks of their features."""

    def __init__(self, widths, names: list[str]):
        self.widths = widths
        self.schema = pa.schema([("id", pa.int64()), ("t", pa.int64()), *((c, pa.float64()) for c in names)])
        self.waiting, self.held = {}, 0
        self.open(None)

    def open(self, id_) -> None:
        self.id, self.past, self.t, self.x, self.rows, self.long = id_, [], [], [], 0, None

    def take(self, period: np.ndarray, t: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """More rows of the open series; a long online segment leaves in slices."""
        cut = int(np.searchsorted(period, 2))
        if cut:
            self.past.append(x[:cut])
        if cut < len(x):
            self.t.append(t[cut:])
            self.x.append(x[cut:])
            self.rows += len(x) - cut
        if self.rows > BLOCK:
            t, x = np.concatenate(self.t), np.concatenate(self.x)
            left = (self.rows - 1) // BLOCK * BLOCK
            for k in range(0, left, BLOCK):
                yield self.slice(t[k : k + BLOCK], x[k : k + BLOCK])
            self.t, self.x, self.rows = [t[left:]], [x[left:]], self.rows - left

    def slice(self, t: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        if self.long is None:
            self.long = calibration(self.history()[None]), Walk()
        return self.batch([self.id], [t], rows(x[None], *self.long, self.widths))

    def history(self) -> np.ndarray:
        return np.concatenate(self.past) if self.past else np.empty(0)

    def close(self) -> Iterator[pa.RecordBatch]:
        """The open series is whole: the rest of a long one leaves, another waits for a block."""
        if self.long:
            yield self.slice(np.concatenate(self.t), np.concatenate(self.x))
        elif self.rows:
            past = self.history()
            self.waiting.setdefault(len(past), []).append((self.id, past, np.concatenate(self.t), np.concatenate(self.x)))
            self.held += len(past) + self.rows
            if self.held > WAITING:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        for series in self.waiting.values():
            series.sort(key=lambda s: len(s[3]))
            while series:
                size = max(1, min(len(series), BLOCK // len(series[-1][3])))
                yield self.block(series[-size:])
                del series[-size:]
        self.waiting, self.held = {}, 0

    def block(self, series: list[tuple]) -> pa.RecordBatch:
        ids, past, t, x = zip(*series)
        padded = np.zeros((len(x), max(map(len, x))))
        for to, v in zip(padded, x):
            to[: len(v)] = v
        return self.batch(ids, t, rows(padded, calibration(np.stack(past)), Walk(), self.widths))

    def batch(self, ids, t: list[np.ndarray], found: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Columns as rows, without the padding."""
        lengths = np.array([len(v) for v in t])
        shape = len(t), int(lengths.max())
        real = np.flatnonzero(np.arange(shape[1]) < lengths[:, None])
        flat = lambda v: pa.array(np.broadcast_to(v, shape).reshape(-1)[real])
        id_ = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), lengths)))
        return pa.RecordBatch.from_arrays([id_, pa.array(np.concatenate(t)), *(flat(found[f.name]) for f in list(self.schema)[2:])], schema=self.schema)


def bank(batches: Iterator[pa.RecordBatch], widths, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Features of rows (id, period, t, x) that come by series, in order."""
    todo, none = Bank(widths, names), object()
    last = none
    with np.errstate(all="ignore"):
        for batch in batches:
            if not batch.num_rows:
                continue
            known = np.asarray(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(0).to_numpy()
            period, t, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            starts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (known[1:] != known[:-1])) + 1).tolist()]
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                id_ = int(ids[a]) if known[a] else None
                if last is none or id_ != last:
                    yield from todo.close()
                    todo.open(id_)
                    last = id_
                yield from todo.take(period[a:b], t[a:b], x[a:b])
        yield from todo.close()
        yield from todo.flush()
