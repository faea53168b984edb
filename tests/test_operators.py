"""Operators against sequential NumPy statements on tiny series."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import blend, calibration, detectors, features, metric, nets, normalise, synthesis, twosample
from driftline.sources import series as src


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    rows = []
    for i, (h, o) in enumerate([(80, 40), (300, 60), (3, 5), (70, 1)]):
        x = np.round(rng.normal(10, 3, h + o), 2)
        if i == 1:
            x[h + 20 :] += 4
        rows += [(i, k + 1, float(v), 1 if k < h else 2, k - h if k >= h else None) for k, v in enumerate(x)]
    return pd.DataFrame(rows, columns=["id", "time", "x", "period", "t"])


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in data.itertuples(index=False, name=None)]
    rows = [(r[0], r[1], r[2], r[3], None if r[4] is None else int(r[4])) for r in rows]
    return spark.createDataFrame(rows, "id long, time long, x double, period int, t long")


def parts(data, i):
    d = data[data.id == i].sort_values("time")
    return d.x[d.period == 1].values, d.x[d.period == 2].values


def zscores(data, i):
    h, o = parts(data, i)
    return (o - h.mean()) / h.std(ddof=1)


def column(df, i, name):
    return df[df.id == i].sort_values("t")[name].values


def test_calibration_in_one_exchange_equals_the_parts(spark, table, data):
    h = src.history(table)
    full = calibration.full(h).toPandas().set_index("id")
    base = calibration.moments(h).toPandas().set_index("id")
    acf = calibration.autocorrelation(h).toPandas().set_index("id")
    for c in ("mu", "sd", "med", "skew", "kurt"):
        assert np.allclose(full[c].sort_index(), base[c].sort_index())
    for c in ("acf1_h", "acf2_h"):
        assert np.allclose(full[c].sort_index(), acf[c].sort_index())
    x, _ = parts(data, 1)
    d = x - x.mean()
    assert math.isclose(acf.acf1_h[1], (d[1:] * d[:-1]).sum() / (d * d).sum())
    assert np.allclose(full.edges[1], np.quantile(x, np.arange(1, 20) / 20), atol=1e-9)


def test_cusum_closed_form_is_the_recursion(table, data):
    out = features.cusum_bank(features.prepared(table)).toPandas()
    for i in (0, 1, 2):
        up = down = top = 0.0
        want = []
        for z in zscores(data, i):
            up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
            top = max(top, up, down)
            want.append(top)
        assert np.allclose(column(out, i, "cusum_absmax_k05"), want)


def test_page_hinkley_and_ewma(table, data):
    df = features.ewma(features.page_hinkley(features.prepared(table)), 0.2, "w").toPandas()
    for i in (0, 1):
        z, p, lo, hi, e, n = zscores(data, i), 0.0, 0.0, 0.0, None, 0.0
        ph, ew = [], []
        for v in z:
            p += v
            lo, hi = min(lo, p), max(hi, p)
            ph.append(max(p - lo, hi - p))
            e = v if e is None else 0.8 * e + 0.2 * v
            n = 0.8 * n + 1
            ew.append(e * math.sqrt(max(n, 1)))
        assert np.allclose(column(df, i, "ph_mean"), ph) and np.allclose(column(df, i, "w"), ew)


@pytest.mark.parametrize("width", [5, 25])
def test_trailing_windows_are_sliding_windows(table, data, width):
    df = features.window_acf(features.window_moments(features.prepared(table), (width,)), (width,), (1, 3)).toPandas()
    for i in (0, 1):
        z = zscores(data, i)
        for t in range(len(z)):
            w = z[max(0, t - width + 1) : t + 1]
            assert math.isclose(df[(df.id == i) & (df.t == t)][f"w{width}_mean_z"].item(), w.mean() * math.sqrt(len(w)), abs_tol=1e-9)
            got = df[(df.id == i) & (df.t == t)][f"w{width}_acf3"].item()
            want = 0.0
            if len(w) > 4:
                want = float(np.clip(((w[3:] * w[:-3]).sum() / (len(w) - 3) - w.mean() ** 2) / max(w.var(), 1e-12), -1, 1))
            assert math.isclose(got, want, abs_tol=1e-7)


def test_histogram_statistics(table, data):
    df = features.cumulative_shape(features.prepared(table)).toPandas()
    h, o = parts(data, 1)
    edges = np.quantile(h, np.arange(1, 20) / 20) + np.arange(19) * 1e-12
    for t in (0, 7, 59):
        below = np.array([(o[: t + 1] < e).mean() for e in edges])
        gaps = np.abs(below - np.arange(1, 20) / 20)
        assert math.isclose(column(df, 1, "ks_stat")[t], gaps.max()) and math.isclose(column(df, 1, "ecdf_l1")[t], gaps.sum())


def test_short_histories_use_the_default_nulls(table):
    h = src.history(table)
    out = features.null_moments(h, calibration.full(h)).toPandas().set_index("id")
    assert list(out.null_mz_scale[2]) == [1.0] * 7
    measured = out.null_mz_scale[0]  # 80 rows measure scales up to 40, the rest repeat
    assert measured[2] == measured[3] == measured[6] != 1.0


def test_prewhitened_first_residual_follows_the_history(table, data):
    df = features.prewhitened(features.prepared(table)).toPandas()
    h, o = parts(data, 0)
    d = h - h.mean()
    phi = float(np.clip((d[1:] * d[:-1]).sum() / (d * d).sum(), -0.95, 0.95))
    z = (np.concatenate([h[-1:], o]) - h.mean()) / h.std(ddof=1)
    e = (z[1:] - phi * z[:-1]) / math.sqrt(max(1 - phi * phi, 1e-4))
    assert np.allclose(column(df, 0, "e"), e)


def test_midrank_stream(table, data):
    df = features.midrank_stream(table).toPandas()
    h, o = parts(data, 1)
    p = np.clip(((h[None] <= o[:, None]).sum(1) + (h[None] < o[:, None]).sum(1)) / 2 / len(h), 0.5 / len(h), 1 - 0.5 / len(h))
    assert np.allclose(column(df, 1, "pit"), p)


def test_turning_difference_never_forgets(table, data):
    df = features.turning_difference(features.prepared(table), calibration.turning_rate(src.history(table))).toPandas()
    h, o = parts(data, 1)
    rate = lambda x: (lambda s: (s[1:] != s[:-1]).mean() if len(s) > 1 else None)(np.array([v for v in np.sign(np.diff(x)) if v]))
    assert math.isclose(column(df, 1, "zcr_d")[-1], rate(o) - rate(h))


def test_shiryaev_roberts_and_hmm(table, data):
    df = features.prepared(table)
    sr = detectors.shiryaev_roberts(df).toPandas()
    hmm = detectors.hmm_posterior(df).toPandas()
    z = zscores(data, 1)
    r, want = [-50.0] * len(detectors.ALTERNATIVES), []
    for v in z:
        r = [np.logaddexp(a, 0) - math.log(s) - (v - d) ** 2 / (2 * s * s) + v * v / 2 for a, (d, s) in zip(r, detectors.ALTERNATIVES)]
        want.append(np.logaddexp.reduce(r) - math.log(len(r)))
    assert np.allclose(column(sr, 1, "log_sr"), want)
    mix, post = detectors.atoms(16), []
    odds = [0.0] * 3
    for v in z:
        lr = np.mean([math.exp(-a_v / 2 - (v - d) ** 2 / (2 * math.exp(a_v)) + v * v / 2) for d, a_v in mix])
        odds = [lr * (o + h) / (1 - h) for o, h in zip(odds, detectors.HAZARDS)]
        post.append(np.mean([o / (1 + o) for o in odds]))
    assert np.allclose(column(hmm, 1, "posterior"), post, atol=1e-6)


def test_kernel_density(table, data):
    df = detectors.kernel_density(features.prepared(table), src.history(table), most=64).toPandas()
    h, o = parts(data, 0)
    z = np.sort(np.clip((h - h.mean()) / h.std(ddof=1), -8, 8))
    bw = max(0.05, 1.06 * z.std() * len(z) ** -0.2)
    a = z[np.floor(np.arange(64) * (len(z) - 1) / 63.0).astype(int)]
    v = (o[0] - h.mean()) / h.std(ddof=1)
    want = math.log(np.exp(-0.5 * ((v - a) / bw) ** 2).sum() / (len(a) * bw * math.sqrt(2 * math.pi)))
    assert math.isclose(column(df, 0, "kde_logp")[0], want, abs_tol=1e-9)


def test_student_density(table, data):
    df = detectors.student_log_density(features.prepared(table)).toPandas()
    nu, z = df.df.iloc[0], df.z.iloc[0]
    s = math.sqrt((nu - 2) / nu)
    want = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(s) - (nu + 1) / 2 * math.log1p((z / s) ** 2 / nu)
    assert math.isclose(df.log_t.iloc[0], want, abs_tol=1e-9)


def test_wavelet_bands_end_of_series(table, data):
    df = detectors.wavelet_bands(table).toPandas()
    h, o = parts(data, 1)
    zs = [(x - h.mean()) / h.std() for x in (h, o)]
    energy = []
    for z in zs:
        s = [z[0]]
        for v in z[1:]:
            s.append(0.5 * s[-1] + 0.5 * v)
        energy.append((z - np.array(s)) ** 2)
    want = math.log(energy[1].mean() / energy[0][8:].mean())
    assert math.isclose(column(df, 1, "wvc_band1")[-1], want, abs_tol=1e-9)
    assert (df[df.id == 2].drop(columns=["id", "t"]) == 0).all().all()  # history too short


def test_auc_with_ties_and_single_classes(spark):
    rows = [(0, 1.0, 1), (0, 1.0, 0), (0, 0.0, 0), (1, 3.0, 1), (1, 3.0, 1), (2, 5.0, 1), (2, 4.0, 0)]
    df = spark.createDataFrame(rows, "t long, score double, y int")
    r = metric.ts_auc(df).first()
    assert r.pairs == 3 and math.isclose(r.ts_auc, (2 * 0.75 + 1 * 1.0) / 3)
    assert metric.ts_auc(df.filter("t = 1")).first().ts_auc == 0.5
    assert metric.ts_auc(spark.createDataFrame([(0, 2.0, 0), (0, 2.0, 1)], df.schema)).first().ts_auc == 0.5


def test_monotone_transforms_leave_the_metric_alone(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(t), float(rng.integers(0, 9)), int(rng.integers(0, 2))) for i in range(20) for t in range(6)]
    df = spark.createDataFrame(rows, "id long, t long, score double, y int")
    base = metric.ts_auc(df).first().ts_auc
    for c in (normalise.by_rank(df).withColumn("score", F.col("rank_norm")), normalise.by_normal_quantile(df).withColumn("score", F.col("gauss")), df.withColumn("score", F.exp("score")), normalise.by_sigmoid(df).withColumn("score", F.col("sigmoid"))):
        assert math.isclose(metric.ts_auc(c).first().ts_auc, base)


def test_blend_grid_and_greedy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        for t in range(5):
            y = int(i % 3 == 0)
            rows.append((i, t, float(rng.normal()), float(rng.normal() + 2 * y), y))
    df = spark.createDataFrame(rows, "id long, t long, a double, b double, y int")
    out = {r.w: r for r in blend.blend_grid(df, "a", "b", [0.0, 0.5]).collect()}
    assert out[0.5].auc_all > out[0.0].auc_all and out[0.5].robust == 1 and out[0.0].robust == 0
    assert blend.greedy(df, ["b"], "a", (0.5,)) == [("b", 0.5)]
    w = blend.ridge(df, ["a", "b"], "y")
    assert w[2] > abs(w[1])


def test_two_sample_statistics(table, data):
    ks = twosample.kolmogorov(table).toPandas().set_index("id").ks
    ad = twosample.anderson_darling(table).toPandas().set_index("id").ad
    h, o = parts(data, 1)
    grid = np.unique(np.concatenate([h, o]))
    fa, fb = ((x[None] <= grid[:, None]).mean(1) for x in (h, o))
    assert math.isclose(ks[1], np.abs(fa - fb).max())
    pooled = np.sort(np.concatenate([h, o]))
    at = np.searchsorted(grid, pooled)
    hh = np.array([(pooled <= g).mean() for g in grid])
    term = (fa - fb) ** 2 / np.maximum(hh * (1 - hh), 1e-6)
    assert math.isclose(ad[1], term[at[pooled < grid[-1]]].mean())


def test_smoothing_repeats_the_edges(spark):
    df = spark.createDataFrame([(t, float(t * t), 1.0) for t in range(6)], "t long, mu0 double, sd0 double")
    got = normalise.smoothed(df, 5).orderBy("t").toPandas().mu0.values
    x = np.pad(np.arange(6.0) ** 2, 2, mode="edge")
    assert np.allclose(got, np.convolve(x, np.ones(5) / 5, "valid"))


def test_recurrent_nets_by_hand():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 7)) * 2
    for kind in ("gru", "lstm"):
        w = nets.random_weights(kind, 7, 5, seed=1)
        out = nets.KINDS[kind](x, w)
        sig = lambda v: 1 / (1 + math.exp(-v))
        h, c = [0.0] * 5, [0.0] * 5
        for t in range(3):
            xi = np.clip(x[t], -8, 8)
            gi = [sum(w["Wih"][j][k] * xi[k] for k in range(7)) + w["bih"][j] for j in range(len(w["bih"]))]
            gh = [sum(w["Whh"][j][k] * h[k] for k in range(5)) + w["bhh"][j] for j in range(len(w["bhh"]))]
            if kind == "gru":
                h = [(1 - sig(gi[5 + j] + gh[5 + j])) * math.tanh(gi[10 + j] + sig(gi[j] + gh[j]) * gh[10 + j]) + sig(gi[5 + j] + gh[5 + j]) * h[j] for j in range(5)]
            else:
                c = [sig(gi[5 + j] + gh[5 + j]) * c[j] + sig(gi[j] + gh[j]) * math.tanh(gi[10 + j] + gh[10 + j]) for j in range(5)]
                h = [sig(gi[15 + j] + gh[15 + j]) * math.tanh(c[j]) for j in range(5)]
            assert math.isclose(out[t], sum(a * b for a, b in zip(w["Wo"], h)) + w["bo"], abs_tol=1e-10)


@pytest.mark.parametrize("kind", ["cnn", "attention"])
def test_causal_nets_do_not_look_ahead(kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 4))
    w = nets.random_weights(kind, 4)
    y = x.copy()
    y[12:] = 9
    assert np.allclose(nets.KINDS[kind](x, w)[:12], nets.KINDS[kind](y, w)[:12])


def test_generator_does_not_depend_on_partitions(spark):
    a = synthesis.generate(spark, 6, seed=3).orderBy("id", "time").toPandas()
    b = synthesis.generate(spark, 6, seed=3).repartition(3).orderBy("id", "time").toPandas()
    pd.testing.assert_frame_equal(a, b)
    h = a[(a.id == 1) & (a.period == 1)].x
    assert abs(h.mean()) < 1e-9 and abs(h.std(ddof=0) - 1) < 1e-9


def test_weighted_draw(spark):
    pool = spark.createDataFrame([(k, float(k)) for k in range(1, 5)], "id long, w double")
    got = synthesis.weighted_draw(spark, pool, 4000, "w").groupBy("id").count().toPandas().set_index("id")["count"]
    assert got.sum() == 4000 and all(abs(got[k] / 4000 - k / 10) < 0.03 for k in range(1, 5))


def test_matrix_round_trip(spark, table, tmp_path):
    rows = src.online(table)
    src.write_matrix(rows, str(tmp_path / "m"), 3)
    assert sorted(map(tuple, src.read_matrix(spark, str(tmp_path / "m")).select("id", "t", "x").collect())) == sorted(map(tuple, rows.collect()))


def test_nested_series(table, data):
    got = {r.id: r for r in src.nested(table).collect()}
    h, o = parts(data, 0)
    assert got[0].x_hist == list(h) and got[0].x_online == list(o)


def test_bank_holds_the_blocks(table):
    from driftline.plans.bank import feature_bank

    bank = feature_bank(table).toPandas().sort_values(["id", "t"], ignore_index=True)
    assert len(bank.columns) > 180 and len(bank) == 106 and np.isfinite(bank.drop(columns=["id", "t"]).to_numpy(dtype=float)).all()
    h = src.history(table)
    cal = calibration.full(h)
    rows = features.prepared(table, cal)
    windows = features.calibrated_windows(rows, features.null_moments(h, cal).join(features.null_shape(h, cal), "id"), (25,))
    for block, names in ((features.cusum_bank(rows), ["cusum_absmax_k10"]), (features.prewhitened(rows), ["pw_ewma_z", "pw_acf1"]), (windows, ["w25_nmz", "w25_nks"]), (features.cumulative_acf(rows), ["online_acf2"])):
        own = block.toPandas().sort_values(["id", "t"], ignore_index=True)
        for c in names:
            assert np.allclose(bank[c], own[c])


def test_ewma_of_long_series_does_not_overflow(spark):
    x = np.random.default_rng(5).normal(size=16000)
    df = spark.createDataFrame(pd.DataFrame({"id": 1, "t": np.arange(len(x)), "n": np.arange(len(x)) + 1, "z": x, "score": x}))
    for alpha in (0.05, 0.1, 0.2, 0.3):
        want = pd.Series(x).ewm(alpha=alpha, adjust=False).mean().values
        got = detectors.postprocess(df, alpha).orderBy("t").toPandas()
        assert np.allclose(got.ewma, want, rtol=0, atol=1e-12)
        scale = np.sqrt(np.maximum((1 - (1 - alpha) ** (np.arange(len(x)) + 1)) / alpha, 1))
        assert np.allclose(features.ewma(df, alpha, "w").orderBy("t").toPandas().w, want * scale, rtol=0, atol=1e-11)


def test_the_posterior_query_takes_all_48_atoms(spark):
    from driftline.plans import catalog

    d = "/root/testdata/sf0.001"
    rows = features.prepared(src.series_q(spark, d)).filter("id = 1").orderBy("t").select("z").toPandas().z
    got = catalog.QUERIES["hmm_posterior"](spark, d).filter("id = 1").orderBy("t").toPandas().posterior
    mix = detectors.atoms()
    odds, post = [0.0] * 3, []
    for v in rows:
        lr = np.mean([math.exp(-a_v / 2 - (v - m) ** 2 / (2 * math.exp(a_v)) + v * v / 2) for m, a_v in mix])
        odds = [lr * (o + h) / (1 - h) for o, h in zip(odds, detectors.HAZARDS)]
        post.append(np.mean([o / (1 + o) for o in odds]))
    assert len(mix) == 48 and len(post) > 100 and np.allclose(got, post, atol=1e-5)


def test_the_kernel_density_query_takes_the_whole_history(spark):
    from driftline.plans import catalog

    d = "/root/testdata/sf0.001"
    rows = src.series_q(spark, d).filter("id = 1").orderBy("time").toPandas()
    h, o = rows.x[rows.period == 1].values.astype(float), rows.x[rows.period == 2].values.astype(float)
    z, v = np.clip((h - h.mean()) / h.std(ddof=1), -8, 8), np.clip((o - h.mean()) / h.std(ddof=1), -8, 8)
    bw = max(0.05, 1.06 * z.std() * len(z) ** -0.2)
    want = np.log(np.exp(-0.5 * ((v[:, None] - z[None]) / bw) ** 2).sum(axis=1) / (len(z) * bw * math.sqrt(2 * math.pi)))
    got = catalog.QUERIES["kde_logp"](spark, d).filter("id = 1").orderBy("t").toPandas().kde_logp
    assert 64 < len(h) <= 512 and np.allclose(got, want, atol=2e-6)


def test_every_series_is_scored_out_of_fold(spark):
    from driftline.operators import models

    rows = spark.createDataFrame([(i, 0, float(i), i % 2) for i in range(20)], "id long, t long, a double, target int")
    seen = []

    def fit(train, held, columns):
        seen.append(({r.id for r in train.collect()}, {r.id for r in held.collect()}))
        return held.select("id", "t", F.lit(0.5).alias("p"))

    assert sorted(r.id for r in models.out_of_fold(fit, rows, ["a"]).collect()) == list(range(20))
    assert len(seen) == 5 and all(not a & b and len(a | b) == 20 for a, b in seen)


def test_every_row_of_a_step_with_both_classes_is_paired(spark):
    from driftline.operators import models

    rows = [(i, t, float(2**i), int(i < n)) for t, n in ((0, 2), (1, 9), (2, 0), (3, 5)) for i in range(11)]
    df = spark.createDataFrame(rows, "id long, t long, a double, target int")
    for t, n in ((0, 2), (1, 9), (2, 0), (3, 5)):
        for buckets in (1, 8):
            got = models.pairs_of(df.filter(F.col("t") == t), ["a"], buckets).collect()
            diffs = {2.0**p - 2.0**q: (p, q) for p in range(n) for q in range(n, 11)}
            used = {i for r in got for i in diffs[r.a]}
            assert len(got) == (max(n, 11 - n) if n else 0) and used == (set(range(11)) if n else set())
