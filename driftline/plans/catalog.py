"""Registered queries over the driver's tables, each with its DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import blend, calibration, detectors, features, metric, models, nets, normalise, synthesis, twosample
from driftline.operators.features import WINDOWS
from driftline.plans import sql
from driftline.plans.bank import feature_bank
from driftline.plans.sql import CAL, CUM, LAGGED, SCORES, SERIES, W, rounded, win
from driftline.sources import series as src
from driftline.sources.store import stored
from driftline.streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounding(df: DataFrame, keys: list[str], cols: list[str], digits: int = 6) -> DataFrame:
    # adding 0.0 turns a negative zero into zero
    return df.select(*keys, *[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) for c in cols])


def add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def series_query(name: str, build: Callable[[DataFrame], DataFrame], keys: list[str], cols: list[str], oracle: str | None = None, digits: int = 6) -> None:
    """A query whose input is the quantity series."""
    add(name, lambda spark, d: rounding(build(src.series_q(spark, d)), keys, cols, digits), oracle)


def online_query(name: str, build: Callable[[DataFrame], DataFrame], cols: list[str], oracle_select: str | None, ctes: str = CAL, digits: int = 6) -> None:
    """A query whose input is the prepared online rows."""
    series_query(name, lambda s: build(features.prepared(s)), ["id", "t"], cols, rounded(oracle_select, "id, t", cols, ctes, digits) if oracle_select else None, digits)


# ---- metric, labels, splits

add("ts_auc_events", lambda spark, d: rounding(metric.ts_auc(src.scores_e(spark, d)), ["pairs"], ["ts_auc"], 9), f"WITH {SCORES} " + sql.auc("sc"))
add(
    "ts_auc_per_step",
    lambda spark, d: rounding(metric.step_auc(src.scores_e(spark, d)), ["t", "n_pos", "n_neg"], ["auc"], 9),
    f"""WITH {SCORES}, r AS (SELECT t, y, rank() OVER (PARTITION BY t ORDER BY score) + (count(*) OVER (PARTITION BY t, score) - 1) / CAST(2 AS DOUBLE) AS rk FROM sc),
g AS (SELECT t, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y <> 1) AS n_neg, sum(rk) FILTER (y = 1) AS s FROM r GROUP BY t)
SELECT t, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / CAST(2 AS DOUBLE)) / (n_pos * n_neg), 9) AS auc FROM g WHERE n_pos > 0 AND n_neg > 0""",
)
STEPS = [5, 10, 20, 40]
add(
    "snapshot_auc",
    lambda spark, d: rounding(metric.snapshot_auc(src.scores_e(spark, d), STEPS), ["t"], ["auc"], 9),
    f"WITH {SCORES}, f AS (SELECT * FROM sc WHERE t IN (5, 10, 20, 40)), p AS (SELECT a.t, avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc FROM f a JOIN f b ON a.t = b.t WHERE a.y = 1 AND b.y <> 1 GROUP BY a.t) SELECT t, round(auc, 9) AS auc FROM p",
)
add(
    "snapshot_auc_untied",
    lambda spark, d: rounding(metric.untied_auc(src.scores_e(spark, d), STEPS), ["t"], ["auc"], 9),
    f"WITH {SCORES}, f AS (SELECT * FROM sc WHERE t IN (5, 10, 20, 40)), p AS (SELECT a.t, avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE ELSE 0 END) AS auc FROM f a JOIN f b ON a.t = b.t WHERE a.y = 1 AND b.y <> 1 GROUP BY a.t) SELECT t, round(auc, 9) AS auc FROM p",
)
labelled = lambda spark, d: src.labelled(src.series_q(spark, d))
add("step_balance", lambda spark, d: metric.step_balance(labelled(spark, d)), f"WITH {SERIES} SELECT t, count(*) AS alive, CAST(sum(target) AS BIGINT) AS n_pos, CAST(count(*) - sum(target) AS BIGINT) AS n_neg, CAST(sum(target) * (count(*) - sum(target)) AS BIGINT) AS weight FROM lab GROUP BY t")
add("series_split", lambda spark, d: src.series_q(spark, d).groupBy("id").agg(F.count_if(F.col("period") == 1).alias("n_hist"), F.count_if(F.col("period") == 2).alias("n_online")), f"WITH {SERIES} SELECT id, count(*) FILTER (period = 1) AS n_hist, count(*) FILTER (period = 2) AS n_online FROM s GROUP BY id")


def tau_join(spark: SparkSession, d: str) -> DataFrame:
    s = src.series_q(spark, d)
    n = s.filter("period = 1").groupBy("id").agg(F.count("*").alias("n_hist"))
    return n.join(src.breaks(s), "id", "left").select("id", "n_hist", F.col("tau_index").cast("double").alias("tau_index"), (F.col("n_hist") + F.col("tau_index")).cast("double").alias("tau"))


add("tau_join", tau_join, f"WITH {SERIES} SELECT id, count(*) AS n_hist, CAST(any_value(CASE WHEN id % 2 = 0 THEN 60 + (id * 37) % 120 END) AS DOUBLE) AS tau_index, CAST(count(*) + any_value(CASE WHEN id % 2 = 0 THEN 60 + (id * 37) % 120 END) AS DOUBLE) AS tau FROM hist GROUP BY id")
add("step_labels", lambda spark, d: labelled(spark, d).select("id", "t", "target"), f"WITH {SERIES} SELECT id, t, target FROM lab")
add("elapsed_ramp_weight", lambda spark, d: rounding(metric.ramp_weight(labelled(spark, d)), ["id", "t", "target"], ["weight"]), f"WITH {SERIES} SELECT id, t, target, round(CASE WHEN target = 1 THEN least(1, greatest(0.2, (t - tau_index) / 50.0::DOUBLE)) ELSE 1 END::DOUBLE, 6) AS weight FROM lab")
add("step_metric_weight", lambda spark, d: rounding(metric.metric_weight(labelled(spark, d)), ["id", "t", "target"], ["weight"]), f"WITH {SERIES}, p AS (SELECT *, CAST(sum(target) OVER (PARTITION BY t) * (count(*) OVER (PARTITION BY t) - sum(target) OVER (PARTITION BY t)) AS DOUBLE) AS w FROM lab) SELECT id, t, target, round(w / avg(w) OVER (), 6) AS weight FROM p")
add("kfold_by_series", lambda spark, d: metric.fold(src.series_q(spark, d)).groupBy("fold").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("series")), f"WITH {SERIES} SELECT id % 5 AS fold, count(*) AS rows, count(DISTINCT id) AS series FROM s GROUP BY 1")
add("first_positive_step", lambda spark, d: metric.first_positive(labelled(spark, d)).withColumn("tau", F.col("tau").cast("double")), f"WITH {SERIES} SELECT id, t, CAST(min(CASE WHEN target = 1 THEN t END) OVER (PARTITION BY id) AS DOUBLE) AS tau FROM lab")
add("shard_counts", lambda spark, d: src.series_q(spark, d).groupBy(F.pmod("id", F.lit(4)).alias("shard")).agg(F.count("*").alias("rows")), f"WITH {SERIES} SELECT id % 4 AS shard, count(*) AS rows FROM s GROUP BY 1")
add("id_subset_scan", lambda spark, d: src.scan(spark, d, "lineitem", ["l_suppkey", "l_quantity"], ("l_suppkey", [1, 3, 5])).groupBy("l_suppkey").agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("total")), "SELECT l_suppkey, count(*) AS rows, sum(l_quantity) AS total FROM lineitem WHERE l_suppkey IN (1, 3, 5) GROUP BY 1")
add("table_shape", lambda spark, d: src.describe_file(src.scan(spark, d, "lineitem")), "SELECT count(*) AS rows, CAST((SELECT count(*) FROM (DESCRIBE lineitem)) AS INTEGER) AS columns FROM lineitem")
# ---- calibration

series_query("calib_moments", lambda s: calibration.moments(src.history(s)), ["id", "n_hist"], ["mu", "sd", "med", "skew", "kurt"], rounded("SELECT * FROM c0 JOIN c1 USING (id)", "id, n_hist", ["mu", "sd", "med", "skew", "kurt"], CAL))
series_query(
    "calib_acf", lambda s: calibration.autocorrelation(src.history(s), 5), ["id"], [f"acf{k}_h" for k in range(1, 6)],
    rounded("SELECT id, " + ", ".join(f"sum(p{k}) / sum(d * d) AS acf{k}_h" for k in range(1, 6)) + " FROM (SELECT id, d, " + ", ".join(f"d * lag(d, {k}) OVER ({W}) AS p{k}" for k in range(1, 6)) + " FROM cz) GROUP BY id", "id", [f"acf{k}_h" for k in range(1, 6)], CAL),
)
add("calib_quantile_edges", lambda spark, d: calibration.quantile_edges(src.history(src.series_q(spark, d))).select("id", F.posexplode("edges").alias("j", "edge")).select("id", "j", F.round("edge", 6).alias("edge")), f"WITH {CAL} SELECT id, CAST(j AS INTEGER) AS j, round(edges[j + 1], 6) AS edge FROM c4, (SELECT unnest(range(0, 19)) AS j)")
series_query("calib_diff_stats", lambda s: calibration.difference_stats(src.history(s)), ["id"], ["dvar_h", "dabs_h"], rounded("SELECT * FROM c3", "id", ["dvar_h", "dabs_h"], CAL))
CROSS = """cr AS (SELECT id, avg(CAST(side <> pside AS DOUBLE)) AS cross_rate_h, sum(d * pd) / sum(d * d) AS acf1_h_abs FROM (
  SELECT id, side, lag(side) OVER (PARTITION BY id ORDER BY t) AS pside, d, lag(d) OVER (PARTITION BY id ORDER BY t) AS pd FROM (
    SELECT id, t, x < med AS side, abs(z) - avg(abs(z)) OVER (PARTITION BY id) AS d FROM cz)) GROUP BY id)"""
series_query("calib_crossing_rate", lambda s: calibration.crossing_rate(src.history(s), calibration.moments(src.history(s))), ["id"], ["cross_rate_h", "acf1_h_abs"], rounded("SELECT * FROM cr", "id", ["cross_rate_h", "acf1_h_abs"], f"{CAL}, {CROSS}"))
TURN = """tr AS (SELECT id, coalesce(avg(CAST(s <> ps AS DOUBLE)), 0.5) AS zcr_h FROM (
  SELECT id, s, lag(s) OVER (PARTITION BY id ORDER BY t) AS ps FROM (SELECT id, t, sign(x - lag(x) OVER (PARTITION BY id ORDER BY t)) AS s FROM hist) WHERE s <> 0) GROUP BY id)"""
series_query("calib_turning_rate", lambda s: calibration.turning_rate(src.history(s)), ["id"], ["zcr_h"], rounded("SELECT * FROM tr", "id", ["zcr_h"], f"{CAL}, {TURN}"))
LRV = """lr AS (SELECT id, greatest(0.05, 1 + 2 * sum((1 - k / 65.0::DOUBLE) * acf)) AS lrv FROM (
  SELECT a.id, b.t - a.t AS k, sum(a.d * b.d) / any_value(ss) AS acf FROM cz a JOIN cz b ON a.id = b.id AND b.t > a.t AND b.t <= a.t + 64
  JOIN (SELECT id, sum(d * d) AS ss FROM cz GROUP BY id) e ON e.id = a.id GROUP BY a.id, k) GROUP BY id)"""
series_query("calib_lrv", lambda s: calibration.long_run_variance(src.history(s), calibration.moments(src.history(s))), ["id"], ["lrv"], rounded("SELECT * FROM lr", "id", ["lrv"], f"{CAL}, {LRV}"))

# ---- cumulative features

_m = sql.moment_columns(sql.Z, "n", CUM)
CUM_COLS = {"cum_mean_dev": _m["m"], "cum_mean_z": f"{_m['m']} * sqrt(n)", "cum_logvar_ratio": f"ln(greatest({_m['v']} * sd ** 2, 1e-12)) - ln(sd ** 2)", "cum_skew": _m["skew"], "cum_kurt": _m["kurt"], "cum_skew_diff": f"({_m['skew']}) - skew", "cum_kurt_diff": f"({_m['kurt']}) - kurt"}
online_query("cum_moments", features.cumulative_moments, list(CUM_COLS), "SELECT id, t, " + ", ".join(f"{e} AS {c}" for c, e in CUM_COLS.items()) + " FROM z")
online_query("time_features", features.time_features, ["log_t", "log_n_hist", "t_over_nhist"], "SELECT id, t, ln(n) AS log_t, ln(n_hist) AS log_n_hist, n / n_hist::DOUBLE AS t_over_nhist FROM z")
_share = lambda cond: f"avg(CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0 END) OVER {CUM}"
online_query("cum_tail_excess", features.tail_excess, ["tail2_excess", "tail3_excess"], f"SELECT id, t, {_share('abs(z) > 2')} - 0.0455 AS tail2_excess, {_share('abs(z) > 3')} - 0.0027 AS tail3_excess FROM z")
online_query("below_median_excess", features.tail_excess, ["below_hist_med_excess"], f"SELECT id, t, {_share('x < med')} - 0.5 AS below_hist_med_excess FROM z")
online_query("cum_acf", features.cumulative_acf, ["online_acf1", "online_acf2", "acf1_diff", "acf2_diff"], f"SELECT *, online_acf1 - acf1_h AS acf1_diff, online_acf2 - acf2_h AS acf2_diff FROM (SELECT *, {sql.acf_expr('z', None, 1)} AS online_acf1, {sql.acf_expr('z', None, 2)} AS online_acf2 FROM {LAGGED})")
_dwin = win(50)
online_query(
    "cum_diff_stats", features.difference_features, ["dvar_ratio_cum", "dvar_ratio_win", "dabs_ratio_cum"],
    f"""SELECT id, t, CASE WHEN n > 2 THEN ln(greatest(var_pop(d) OVER {CUM}, 1e-12)) - ln(dvar_h) ELSE 0 END AS dvar_ratio_cum,
    CASE WHEN n > 2 THEN ln(greatest(var_pop(d) OVER {_dwin}, 1e-12)) - ln(dvar_h) ELSE 0 END AS dvar_ratio_win,
    CASE WHEN n > 2 THEN avg(abs(d)) OVER {CUM} / dabs_h ELSE 1 END AS dabs_ratio_cum FROM (SELECT *, x - lag(x) OVER ({W}) AS d FROM z)""",
)
_ks, _l1, _chi = sql.shape_columns(CUM, "n")
online_query("cum_histogram_ks_l1_chi2", features.cumulative_shape, ["ks_stat", "ecdf_l1", "chi2_cum"], f"SELECT id, t, {_ks} AS ks_stat, {_l1} AS ecdf_l1, {_chi} AS chi2_cum FROM b", f"{CAL}, {sql.BINS}", 10)
_bank = ", ".join(sql.cusum_ctes("z", k, f"k{k_}", "z") for k, k_ in ((0.25, "025"), (0.5, "05"), (1.0, "10")))
online_query(
    "cusum_bank", features.cusum_bank, [f"cusum_absmax_{k}{s}" for k in ("k025", "k05", "k10") for s in ("", "_n")],
    "SELECT id, t, " + ", ".join(f"{k}.m AS cusum_absmax_{k}, {k}.m / sqrt(k05.n) AS cusum_absmax_{k}_n" for k in ("k025", "k05", "k10")) + " FROM k025 JOIN k05 USING (id, t) JOIN k10 USING (id, t)", f"{CAL}, {_bank}",
)
online_query("cusum_var", features.cusum_variance, ["cusum_var_absmax", "cusum_var_absmax_n"], "SELECT id, t, m AS cusum_var_absmax, m / sqrt(n) AS cusum_var_absmax_n FROM v", f"{CAL}, " + sql.cusum_ctes("z * z - 1", 0.5, "v", "z"))
online_query("page_hinkley", features.page_hinkley, ["ph_mean", "ph_mean_n"], f"SELECT id, t, h AS ph_mean, h / sqrt(n) AS ph_mean_n FROM (SELECT *, greatest(p - least(0, min(p) OVER {CUM}), greatest(0, max(p) OVER {CUM}) - p) AS h FROM (SELECT *, sum(z) OVER {CUM} AS p FROM z))")


def ewma_sql(c: str, alpha: float, source: str) -> str:
    """The recursion itself, by a list reduction over a series."""
    q = 1 - alpha
    return f"""SELECT id, t, e[t + 1] * sqrt(greatest(1, (1 - {q} ** (t + 1)) / {alpha})) AS v FROM (
      SELECT id, unnest(range(0, len(zs))) AS t, list_transform(range(1, len(zs) + 1), lambda k: list_reduce(zs[1:k], lambda a, b: {q} * a + {alpha} * b)) AS e FROM (
        SELECT id, list({c} ORDER BY t) AS zs FROM {source} GROUP BY id))"""


online_query("ewma_z", lambda df: features.ewma(features.ewma(df, 0.05, "ewma_z_fast"), 0.2, "ewma_z_slow"), ["ewma_z_fast", "ewma_z_slow"], "SELECT a.id, a.t, a.v AS ewma_z_fast, b.v AS ewma_z_slow FROM a JOIN b USING (id, t)", f"{CAL}, a AS ({ewma_sql('z', 0.05, 'z')}), b AS ({ewma_sql('z', 0.2, 'z')})")

# ---- trailing windows and their nulls

for _w in WINDOWS:
    online_query(f"win_moments_{_w}", partial(features.window_moments, widths=(_w,)), [f"w{_w}_{c}" for c in ("mean_z", "logvar", "skew", "kurt")], None)
    ORACLES[f"win_moments_{_w}"] = sql.window_moments(_w)
online_query("win_acf", features.window_acf, [f"w{w}_acf1" for w in WINDOWS], "SELECT id, t, " + ", ".join(f"{sql.acf_expr('z', w)} AS w{w}_acf1" for w in WINDOWS) + f" FROM {LAGGED}")
for _w in WINDOWS:
    online_query(f"win_hist_ks_l1_{_w}", partial(features.window_shape, widths=(_w,)), [f"w{_w}_ks", f"w{_w}_l1", f"w{_w}_chi2"], None, digits=10)
    ORACLES[f"win_hist_ks_l1_{_w}"] = f"WITH {CAL}, {sql.BINS} " + sql.window_shape(_w).split(f"{CAL}, {sql.BINS}")[1]


def null_query(name: str, build, arrays: list[str], oracle: str, digits: int = 6) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = build(src.history(src.series_q(spark, d)))
        each = rows.select("id", F.posexplode(F.arrays_zip(*arrays)).alias("k", "v"))
        return each.select("id", (F.col("k") + 1).alias("k"), *[(F.round(f"v.{a}", digits) + F.lit(0.0)).alias(a) for a in arrays])

    add(name, query, oracle)


_names = lambda *s: [f"null_{x}_{y}" for x in s for y in ("loc", "scale")]
for _n, _s in (("mean", "mz"), ("lv", "lv"), ("acf", "acf")):
    null_query(f"null_{_n}_table", lambda h: features.null_moments(h, calibration.full(h)), _names(_s), f"WITH {CAL}, {sql.HZ}, nm AS ({sql.NULL_MOMENTS}) " + sql.unrolled("nm", _names(_s)))
null_query("null_ks_table", lambda h: features.null_shape(h, calibration.full(h)), _names("ks", "l1"), f"WITH {CAL}, {sql.HB}, ns AS ({sql.NULL_SHAPE}) " + sql.unrolled("ns", _names("ks", "l1"), 10), 10)


def nulls_of(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    h = src.history(s)
    cal = calibration.full(h)
    return features.prepared(s, cal), features.null_tables(h, cal, ("moments", "shape"))


series_query(
    "null_interp", lambda s: (lambda df, n: df.join(n, "id").withColumns({f"mz_scale_{w}": features.interpolated("null_mz_scale", w) for w in WINDOWS}))(*nulls_of(s)), ["id", "t"], [f"mz_scale_{w}" for w in WINDOWS],
    rounded("SELECT id, t, " + ", ".join(f"{sql.interp('null_mz_scale', w)} AS mz_scale_{w}" for w in WINDOWS) + " FROM z JOIN nm USING (id)", "id, t", [f"mz_scale_{w}" for w in WINDOWS], f"{CAL}, {sql.HZ}, nm AS ({sql.NULL_MOMENTS})"),
)
_cw, _cn = sql.calibrated()
series_query("calibrated_windows", lambda s: features.calibrated_windows(*nulls_of(s)), ["id", "t"], _cn, rounded("SELECT * FROM cw", "id, t", _cn, _cw))
_picks = {s: "greatest(0, " + ", ".join((f"abs(w{w}_{s})" if s in ("nmz", "nlv", "nacf") else f"w{w}_{s}") for w in WINDOWS) + ")" for s in ("nmz", "nlv", "nacf", "nks", "nl1")}
_scans = lambda s: features.scans(features.calibrated_windows(*nulls_of(s)))
series_query("scan_max", _scans, ["id", "t"], [f"scan_{s}" for s in _picks], rounded("SELECT id, t, " + ", ".join(f"{e} AS scan_{s}" for s, e in _picks.items()) + " FROM cw", "id, t", [f"scan_{s}" for s in _picks], _cw))
series_query("scan_running_max", _scans, ["id", "t"], [f"rm_scan_{s}" for s in _picks], rounded("SELECT id, t, " + ", ".join(f"max({e}) OVER {CUM} AS rm_scan_{s}" for s, e in _picks.items()) + " FROM cw", "id, t", [f"rm_scan_{s}" for s in _picks], _cw))

# ---- prewhitened, derived, shape-moment, long-run-variance, distribution-free blocks

PW = f"e AS (SELECT *, (z - phi * coalesce(lag(z) OVER ({W}), (x_last - mu) / sd)) / sqrt(greatest(1 - phi ** 2, 1e-4)) AS e FROM z)"
_pw = ["pw_cusum_absmax_k025", "pw_cusum_absmax_k05", "pw_cusum_var_absmax", "pw_ewma_z", "pw_cum_mean_z", "pw_cum_logvar", "pw_acf1"]
online_query(
    "prewhitened_bank", features.prewhitened, _pw,
    f"""SELECT f.id, f.t, p1.m AS pw_cusum_absmax_k025, p2.m AS pw_cusum_absmax_k05, p3.m AS pw_cusum_var_absmax, w.v AS pw_ewma_z, pw_cum_mean_z, pw_cum_logvar, pw_acf1
    FROM (SELECT id, t, sum(e) OVER {CUM} / sqrt(n) AS pw_cum_mean_z, ln(greatest(avg(e * e) OVER {CUM}, 1e-12)) AS pw_cum_logvar, {sql.acf_expr('e', None)} AS pw_acf1 FROM (SELECT *, e * lag(e) OVER ({W}) AS l1 FROM e)) f
    JOIN p1 USING (id, t) JOIN p2 USING (id, t) JOIN p3 USING (id, t) JOIN w USING (id, t)""",
    f"{CAL}, {PW}, " + ", ".join(sql.cusum_ctes(c, k, n, "e") for c, k, n in (("e", 0.25, "p1"), ("e", 0.5, "p2"), ("e * e - 1", 0.5, "p3"))) + f", w AS ({ewma_sql('e', 0.1, 'e')})",
)
_streams = {"a": ("abs(z)", "abs(z)"), "d": (f"(x - coalesce(lag(x) OVER ({W}), x_last)) / sd", f"coalesce(z - lag(z) OVER ({W}), 0)"), "xs": (f"CAST((x < med) <> (coalesce(lag(x) OVER ({W}), x_last) < med) AS DOUBLE)", f"coalesce(CAST((x < med) <> (lag(x) OVER ({W}) < med) AS DOUBLE), 0)")}
for _name, _st in (("derived_abs_z", "a"), ("derived_dz", "d"), ("derived_crossing", "xs")):
    _on, _hi = _streams[_st]
    _null = sql.nulls("hv", {f"{_st}_mean": (lambda g: f"avg(v) OVER {win(g)}", 8, sql._avg, sql._std, 1e-4, lambda g: 0.0, lambda g: g**-0.5), f"{_st}_acf": (sql._hist_acf("v", "lv", "0"), 8, sql._avg, sql._std, 1e-3, lambda g: 0.0, lambda g: g**-0.5)})
    _cols = {}
    for _w in (50, 200):
        _unit = lambda e, s, w=_w, st=_st: f"CASE WHEN least(n, {w}) >= 5 THEN (({e}) - {sql.interp(f'null_{st}_{s}_loc', w)}) / {sql.interp(f'null_{st}_{s}_scale', w)} ELSE 0 END"
        _cols |= {f"{_st}_nmz_w{_w}": _unit(f"avg(v) OVER {win(_w)}", "mean"), f"{_st}_nacf_w{_w}": _unit(sql.acf_expr("v", _w), "acf")}
    _more = {f"{_st}_scan_mz": f"greatest(abs({_st}_nmz_w50), abs({_st}_nmz_w200))", f"{_st}_scan_acf": f"greatest(abs({_st}_nacf_w50), abs({_st}_nacf_w200))"}
    _rm = {f"rm_{k}": f"max({e}) OVER {CUM}" for k, e in _more.items()}
    series_query(
        _name, lambda s, st=_st: (lambda h: (lambda cal: features.derived_windows(features.prepared(s, cal), features.null_stream(h, cal, st), st))(calibration.full(h)))(src.history(s)), ["id", "t"], [*_cols, *_more, *_rm],
        rounded("SELECT id, t, " + ", ".join([*_cols, *(f"{e} AS {c}" for c, e in (_more | _rm).items())]) + " FROM (SELECT id, t, " + ", ".join(f"{e} AS {c}" for c, e in _cols.items()) + " FROM dv)", "id, t", [*_cols, *_more, *_rm],
                f"{CAL}, hv AS (SELECT *, v * lag(v) OVER ({W}) AS lv FROM (SELECT id, t, n_hist, {_hi} AS v FROM cz)), nv AS ({_null}), dv AS (SELECT *, v * lag(v) OVER ({W}) AS l1 FROM (SELECT z.*, nv.* EXCLUDE (id), {_on} AS v FROM z JOIN nv USING (id)))"),
    )

_hm = (100, 200, 400, 800)
HNULL = sql.nulls("cz", {"skew": (lambda g: sql.moment_columns(sql.Z, str(g), win(g))["skew"], 8, sql._avg, sql._std, 1e-3, lambda g: 0.0, lambda g: (6 / g) ** 0.5), "kurt": (lambda g: sql.moment_columns(sql.Z, str(g), win(g))["kurt"], 8, sql._avg, sql._std, 1e-3, lambda g: 0.0, lambda g: (24 / g) ** 0.5)})
_hcols = {}
for _w in _hm:
    _mm = sql.moment_columns(sql.Z, f"least(n, {_w})", win(_w))
    _hcols |= {f"hm{_w}_n{k}": f"CASE WHEN least(n, {_w}) >= 8 THEN (({_mm[k]}) - {sql.interp(f'null_{k}_loc', _w)}) / {sql.interp(f'null_{k}_scale', _w)} ELSE 0 END" for k in ("skew", "kurt")}
_hscan = {f"hm_scan_{k}": "greatest(" + ", ".join(f"abs(hm{w}_n{k})" for w in _hm) + ")" for k in ("skew", "kurt")}
series_query(
    "hm_skew_kurt", lambda s: (lambda h: (lambda cal: features.shape_moment_windows(features.prepared(s, cal), features.null_shape_moments(h, cal), _hm))(calibration.full(h)))(src.history(s)), ["id", "t"], [*_hcols, *_hscan],
    rounded("SELECT id, t, " + ", ".join([*_hcols, *(f"{e} AS {c}" for c, e in _hscan.items())]) + " FROM (SELECT id, t, " + ", ".join(f"{e} AS {c}" for c, e in _hcols.items()) + " FROM (SELECT z.* EXCLUDE (skew, kurt), nh.* EXCLUDE (id) FROM z JOIN nh USING (id)))", "id, t", [*_hcols, *_hscan], f"{CAL}, nh AS ({HNULL})", 5), 5,
)
_lrv = ["cum_mean_z_lrv", "ph_mean_lrv", "log_lrv", "cusum_absmax_k05_lrv"]
series_query(
    "lrv_scaled", lambda s: (lambda h: (lambda cal: features.lrv_scaled(features.prepared(s, cal), calibration.long_run_variance(h, cal)))(calibration.full(h)))(src.history(s)), ["id", "t"], _lrv,
    rounded(f"SELECT f.id, f.t, sz / sqrt(n * lrv) AS cum_mean_z_lrv, h / sqrt(lrv) AS ph_mean_lrv, ln(lrv) AS log_lrv, k05.m / sqrt(lrv) AS cusum_absmax_k05_lrv FROM (SELECT id, t, n, p AS sz, greatest(p - least(0, min(p) OVER {CUM}), greatest(0, max(p) OVER {CUM}) - p) AS h FROM (SELECT id, t, n, sum(z) OVER {CUM} AS p FROM z)) f JOIN (SELECT id, t, m FROM k05) k05 USING (id, t) JOIN lr USING (id)", "id, t", _lrv, f"{CAL}, {LRV}, " + sql.cusum_ctes("z", 0.5, "k05", "z")),
)
KNOTS = "kn AS (SELECT id, CASE WHEN len(xs) > 256 THEN list_transform(range(0, 256), lambda k: xs[1 + CAST(floor(k * (len(xs) - 1) / 255.0::DOUBLE) AS BIGINT)]) ELSE xs END AS knots FROM (SELECT id, list(x ORDER BY x) AS xs FROM hist GROUP BY id))"
PIT = "pt AS (SELECT z.*, (len(list_filter(knots, lambda k: k <= x)) + 0.5::DOUBLE) / (len(knots) + 1) - 0.5::DOUBLE AS u FROM z JOIN kn USING (id))"
_pcols = {}
for _w, _p in ((120, "xw120_pit"), (480, "xw480_pit"), (None, "xc_pit")):
    _o, _f = (win(_w), f"least(n, {_w})") if _w else (CUM, "n")
    _a1, _v = f"avg(u) OVER {_o}", f"greatest(avg(u * u) OVER {_o} - (avg(u) OVER {_o}) ** 2, 1e-12)"
    _ready = (lambda e: f"CASE WHEN n >= 8 THEN {e} ELSE 0 END") if _w else (lambda e: e)
    _pcols |= {f"{_p}_mean_z": _ready(f"{_a1} * sqrt(12.0::DOUBLE * {_f})"), f"{_p}_logvar": _ready(f"ln({_v} * 12)"), f"{_p}_skew": _ready(f"CASE WHEN {_v} > 1e-12 THEN (avg(u ** 3) OVER {_o} - 3 * {_a1} * (avg(u * u) OVER {_o}) + 2 * ({_a1}) ** 3) / ({_v}) ** 1.5 ELSE 0 END"), f"{_p}_below": _ready(f"avg(CASE WHEN u < 0 THEN 1.0::DOUBLE ELSE 0 END) OVER {_o} - 0.5")}
    if _w:
        _pcols |= {f"{_p}_tail_lo": _ready(f"avg(CASE WHEN u < -0.25 THEN 1.0::DOUBLE ELSE 0 END) OVER {_o} - 0.25"), f"{_p}_tail_hi": _ready(f"avg(CASE WHEN u > 0.25 THEN 1.0::DOUBLE ELSE 0 END) OVER {_o} - 0.25")}
series_query("pit_knots_windows", lambda s: features.pit_windows(features.with_pit(features.prepared(s), calibration.knots(src.history(s)))), ["id", "t"], list(_pcols), rounded("SELECT id, t, " + ", ".join(f"{e} AS {c}" for c, e in _pcols.items()) + " FROM pt", "id, t", list(_pcols), f"{CAL}, {KNOTS}, {PIT}", 5), 5)
series_query(
    "pit_midrank_stream", features.midrank_stream, ["id", "t"], ["pit", "pit_c", "surprise"],
    rounded("SELECT id, t, p AS pit, 2 * p - 1 AS pit_c, -ln(2 * least(p, 1 - p) + 1 / nh) AS surprise FROM (SELECT id, t, nh, least(greatest((le + lt) / 2.0::DOUBLE / nh, 0.5 / nh), 1 - 0.5 / nh) AS p FROM (SELECT o.id, o.t, count(*)::DOUBLE AS nh, count(*) FILTER (h.x <= o.x) AS le, count(*) FILTER (h.x < o.x) AS lt FROM onl o JOIN hist h USING (id) GROUP BY o.id, o.t))", "id, t", ["pit", "pit_c", "surprise"], SERIES),
)
online_query("multilag_acf", lambda df: features.window_acf(df, (120, 480), (1, 2, 3, 4, 5)), [f"w{w}_acf{k}" for w in (120, 480) for k in range(1, 6)], "SELECT id, t, " + ", ".join(f"{sql.acf_expr('z', w, k)} AS w{w}_acf{k}" for w in (120, 480) for k in range(1, 6)) + f" FROM {LAGGED}")
TURNS = f"""SELECT id, t, CASE WHEN sum(pair) OVER {CUM} > 0 THEN sum(pair * turn) OVER {CUM} / (sum(pair) OVER {CUM}) - zcr_h ELSE 0 END AS zcr_d FROM (
  SELECT id, t, CASE WHEN s <> 0 AND b IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS pair, CASE WHEN s <> b THEN 1 ELSE 0 END AS turn FROM (
    SELECT id, t, s, last_value(nullif(s, 0) IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT id, t, sign(x - lag(x) OVER ({W})) AS s FROM z))) JOIN tr USING (id)"""
series_query("turning_difference", lambda s: features.turning_difference(features.prepared(s), calibration.turning_rate(src.history(s))), ["id", "t"], ["zcr_d"], rounded(TURNS, "id, t", ["zcr_d"], f"{CAL}, {TURN}"))
online_query("raw_stream", features.raw_stream, ["zc", "z2", "absz"], "SELECT id, t, c AS zc, c * c AS z2, abs(c) AS absz FROM (SELECT id, t, greatest(-8, least(8, z)) AS c FROM z)")

# ---- step normalisation

STEPNULL = "sn AS (SELECT t, avg(x) AS mu0, stddev_pop(x) AS sd0 FROM lab WHERE target = 0 GROUP BY t)"
add("step_null_stats", lambda spark, d: rounding(normalise.null_stats(labelled(spark, d), "x"), ["t"], ["mu0", "sd0"]), rounded("SELECT * FROM sn", "t", ["mu0", "sd0"], f"{SERIES}, {STEPNULL}"))
add(
    "step_normalize", lambda spark, d: (lambda lab: rounding(normalise.normalised(lab, normalise.smoothed(normalise.null_stats(lab, "x")), "x"), ["id", "t"], ["x__sn"]))(labelled(spark, d)),
    f"""WITH {SERIES}, {STEPNULL}, e AS (SELECT min(t) AS lo, max(t) AS hi FROM sn), g AS (SELECT sn.t, avg(m.mu0) AS mu0, avg(m.sd0) AS sd0 FROM sn, e, (SELECT unnest(range(-12, 13)) AS k) JOIN sn m ON m.t = least(greatest(sn.t + k, lo), hi) GROUP BY sn.t)
    SELECT id, t, round(greatest(-12, least(12, coalesce((x - mu0) / CASE WHEN sd0 < 1e-6 THEN 1 ELSE sd0 END, 0))), 6) AS x__sn FROM lab LEFT JOIN g USING (t)""",
)
add("rank_normalize_per_step", lambda spark, d: rounding(normalise.by_rank(src.scores_e(spark, d)), ["id", "t"], ["rank_norm"]), f"WITH {SCORES} SELECT id, t, round((rank() OVER (PARTITION BY t ORDER BY score) + (count(*) OVER (PARTITION BY t, score) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY t) + 1), 6) AS rank_norm FROM sc")
add("minmax_per_step", lambda spark, d: rounding(normalise.by_range(src.scores_e(spark, d)), ["id", "t"], ["minmax"]), f"WITH {SCORES} SELECT id, t, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END::DOUBLE, 6) AS minmax FROM (SELECT *, min(score) OVER (PARTITION BY t) AS lo, max(score) OVER (PARTITION BY t) AS hi FROM sc)")
add("zscore_per_step", lambda spark, d: rounding(normalise.by_zscore(src.scores_e(spark, d)), ["id", "t"], ["zscore"]), f"WITH {SCORES} SELECT id, t, round((score - avg(score) OVER (PARTITION BY t)) / greatest(stddev_pop(score) OVER (PARTITION BY t), 1e-9), 6) AS zscore FROM sc")
add("gauss_rank_per_step", lambda spark, d: rounding(normalise.by_normal_quantile(src.scores_e(spark, d)), ["id", "t"], ["gauss"]))
add("sigmoid_scores", lambda spark, d: rounding(normalise.by_sigmoid(src.scores_e(spark, d)), ["id", "t"], ["sigmoid"]), f"WITH {SCORES} SELECT id, t, round(1 / (1 + exp(-(score - m) / greatest(s, 1e-9))), 6) AS sigmoid FROM sc, (SELECT avg(score) AS m, stddev_pop(score) AS s FROM sc)")

# ---- two-sample statistics

TWO = "va AS (SELECT id, x, count(*) FILTER (period = 1) AS a, count(*) FILTER (period = 2) AS b FROM s GROUP BY id, x), vc AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY id) AS na, sum(b) OVER (PARTITION BY id) AS nb, lead(x) OVER (PARTITION BY id ORDER BY x) - x AS dx FROM va WINDOW w AS (PARTITION BY id ORDER BY x ROWS UNBOUNDED PRECEDING)), vf AS (SELECT *, ca / na::DOUBLE AS fa, cb / nb::DOUBLE AS fb FROM vc WHERE na > 0 AND nb > 0)"
series_query("ks_two_sample", twosample.kolmogorov, ["id"], ["ks"], rounded("SELECT id, max(abs(fa - fb)) AS ks FROM vf GROUP BY id", "id", ["ks"], f"{SERIES}, {TWO}"))
series_query("cramer_energy", twosample.cramer, ["id"], ["energy"], rounded("SELECT id, coalesce(sum((fa - fb) ** 2 * dx), 0) AS energy FROM vf GROUP BY id", "id", ["energy"], f"{SERIES}, {TWO}"))
series_query("anderson_darling", twosample.anderson_darling, ["id"], ["ad"], rounded("SELECT id, sum((a + b) * (fa - fb) ** 2 / greatest((ca + cb) / (na + nb)::DOUBLE * (1 - (ca + cb) / (na + nb)::DOUBLE), 1e-6)) / sum(a + b) AS ad FROM vf WHERE dx IS NOT NULL GROUP BY id", "id", ["ad"], f"{SERIES}, {TWO}"))
_q64 = str([(k + 0.5) / 64 for k in range(64)])
series_query("wasserstein64", twosample.wasserstein, ["id"], ["w1"], rounded(f"SELECT id, list_avg(list_transform(list_zip(qa, qb), lambda p: abs(p[1] - p[2]))) / greatest(sd, 1e-9) AS w1 FROM (SELECT id, quantile_cont(x, {_q64}) FILTER (period = 1) AS qa, quantile_cont(x, {_q64}) FILTER (period = 2) AS qb, stddev_samp(x) FILTER (period = 1) AS sd FROM s GROUP BY id) WHERE qa IS NOT NULL AND qb IS NOT NULL", "id", ["w1"], SERIES))
_iqr = lambda p: f"greatest(quantile_cont(x, 0.75) FILTER (period = {p}) - quantile_cont(x, 0.25) FILTER (period = {p}), 1e-9)"
series_query("iqr_log_ratio", twosample.iqr_log_ratio, ["id"], ["iqr_log_ratio"], rounded(f"SELECT id, ln({_iqr(2)} / {_iqr(1)}) AS iqr_log_ratio FROM s GROUP BY id", "id", ["iqr_log_ratio"], SERIES))
series_query("hurst_slope", lambda s: twosample.hurst(src.history(s)), ["id"], ["hurst"], rounded("SELECT id, regr_slope(ly, lx) AS hurst FROM (" + " UNION ALL ".join(f"SELECT id, ln({k}) AS lx, ln(greatest(stddev_pop(d), 1e-12)) AS ly FROM (SELECT id, x - lag(x, {k}) OVER ({W}) AS d FROM hist) GROUP BY id" for k in (2, 4, 8, 16, 32)) + ") GROUP BY id", "id", ["hurst"], SERIES))
series_query("perm_entropy", lambda s: twosample.permutation_entropy(src.history(s)), ["id"], ["perm_entropy"], rounded(f"SELECT id, -sum(p * ln(p)) / {sql.LOG6!r} AS perm_entropy FROM (SELECT id, count(*) / sum(count(*)) OVER (PARTITION BY id) AS p FROM (SELECT id, lag(x, 2) OVER ({W}) AS a, lag(x) OVER ({W}) AS b, x FROM hist) WHERE a IS NOT NULL GROUP BY id, a <= b, b <= x, a <= x) GROUP BY id", "id", ["perm_entropy"], SERIES))
_mf = {}
for _L in (20, 40, 80, 160):
    _h = _L // 2
    _early = f"({W} ROWS BETWEEN {_L - 1} PRECEDING AND {_h} PRECEDING)"
    _rdy = lambda e, L=_L: f"CASE WHEN n >= {L} THEN {e} ELSE 0 END"
    _norm = ((_L**3 - _L) / 12) ** 0.5
    _mf |= {f"edge{_L}": _rdy(f"(sum(z) OVER {win(_h)} - sum(z) OVER {_early}) / sqrt({_L})"), f"var_env{_L}": _rdy(f"ln(greatest(var_pop(z) OVER {win(_h)}, 1e-12) / greatest(var_pop(z) OVER {_early}, 1e-12))"), f"block{_L}": _rdy(f"sum(z) OVER {win(_L)} / sqrt({_L})"), f"ramp{_L}": _rdy(f"(sum(z * t) OVER {win(_L)} - (t - {(_L - 1) / 2}) * sum(z) OVER {win(_L)}) / {_norm!r}")}
online_query("matched_filters", twosample.matched_filters, list(_mf), "SELECT id, t, " + ", ".join(f"{e} AS {c}" for c, e in _mf.items()) + " FROM z")
add("spectral_contrasts", lambda spark, d: rounding(twosample.spectral_contrasts(src.series_q(spark, d)), ["id"], ["entropy", "centroid", "low_band", "dominant", "power"]))
add(
    "series_summary", lambda spark, d: rounding(twosample.summary(src.series_q(spark, d)), ["id", "n_hist", "n_online"], ["mean_hist", "sd_hist", "skew_hist", "kurt_hist", "mean_shift", "std_ratio", "ks"]),
    rounded("SELECT h.*, ks FROM (SELECT id, count(*) FILTER (period = 1) AS n_hist, count(*) FILTER (period = 2) AS n_online, avg(x) FILTER (period = 1) AS mean_hist, stddev_samp(x) FILTER (period = 1) AS sd_hist, (avg(x) FILTER (period = 2) - avg(x) FILTER (period = 1)) / greatest(stddev_samp(x) FILTER (period = 1), 1e-9) AS mean_shift, stddev_samp(x) FILTER (period = 2) / greatest(stddev_samp(x) FILTER (period = 1), 1e-9) AS std_ratio FROM s GROUP BY id) h JOIN (SELECT id, max(abs(fa - fb)) AS ks FROM vf GROUP BY id) USING (id)".replace("h.*, ks", "h.*, ks, skew_hist, kurt_hist") + " JOIN (SELECT id, avg(d ** 3) / avg(d * d) ** 1.5 AS skew_hist, avg(d ** 4) / avg(d * d) ** 2 - 3 AS kurt_hist FROM (SELECT id, x - avg(x) OVER (PARTITION BY id) AS d FROM hist) GROUP BY id) USING (id)", "id, n_hist, n_online", ["mean_hist", "sd_hist", "skew_hist", "kurt_hist", "mean_shift", "std_ratio", "ks"], f"{SERIES}, {TWO}"),
)
EMB = "e1 AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings)"


def embedding_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector beside the next one (by vec_id) of its label."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    e = src.scan(spark, d, "embeddings")
    pairs = e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("a"), F.lead("embedding").over(w).alias("b")).filter("b is not null")
    return rounding(twosample.embedding_distances(pairs), ["key"], ["cosine", "l2"], 5)


add("embedding_cosine_l2", embedding_pairs, f"WITH {EMB}, p AS (SELECT vec_id AS key, v AS a, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM e1) SELECT key, round(1 - list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 1e-12), 5) AS cosine, round(sqrt(list_dot_product(a, a) + list_dot_product(b, b) - 2 * list_dot_product(a, b)), 5) AS l2 FROM p WHERE b IS NOT NULL")
add("embedding_mean_pool", lambda spark, d: twosample.pooled_mean(src.scan(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("mean").alias("i", "v")).select("label", "i", F.round("v", 6).alias("v")), "SELECT label, CAST(i AS INTEGER) AS i, round(avg(embedding[i + 1]::DOUBLE), 6) AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS i) GROUP BY label, i")

# ---- sequential detectors

online_query("cum_llr", detectors.cumulative_ratio, ["llr"], f"SELECT id, t, sum(-((z - 1) ** 2) / 2 + z * z / 2) OVER {CUM} AS llr FROM z")
add("hazard_cumprob", lambda spark, d: rounding(detectors.hazard_probability(features.prepared(src.series_q(spark, d)).withColumn("h", F.lit(0.02) / (1 + F.exp(-F.abs("z"))))), ["id", "t"], ["p_break"]), rounded(f"SELECT id, t, 1 - exp(sum(ln(1 - 0.02 / (1 + exp(-abs(z))))) OVER {CUM}) AS p_break FROM z", "id, t", ["p_break"], CAL))
KDE = """hk AS (SELECT id, greatest(-8, least(8, z)) AS z FROM cz), ka AS (SELECT id, zs, len(zs) AS m, greatest(0.05, 1.06 * sp * len(zs) ** -0.2) AS bw FROM (SELECT id, list(z ORDER BY z) AS zs, stddev_pop(z) AS sp FROM hk GROUP BY id)
), kt AS (SELECT id, bw, unnest(CASE WHEN m > 512 THEN list_transform(range(0, 512), lambda k: zs[1 + CAST(floor(k * (m - 1) / 511.0::DOUBLE) AS BIGINT)]) ELSE zs END) AS a FROM ka)"""
series_query("kde_logp", lambda s: detectors.kernel_density(features.prepared(s), src.history(s)), ["id", "t"], ["kde_logp", "kde_cum", "kde_trail"], rounded(f"SELECT id, t, l AS kde_logp, avg(l) OVER {CUM} AS kde_cum, avg(l) OVER {win(128)} AS kde_trail FROM (SELECT z.id, z.t, mx + ln(sum(exp(g - mx))) - ln(count(*) * any_value(bw) * sqrt(2 * pi())) AS l FROM (SELECT *, max(g) OVER (PARTITION BY id, t) AS mx FROM (SELECT z.id, z.t, -0.5 * ((greatest(-8, least(8, z)) - a) / bw) ** 2 AS g, bw FROM z JOIN kt USING (id))) z GROUP BY id, t, mx)", "id, t", ["kde_logp", "kde_cum", "kde_trail"], f"{CAL}, {KDE}"))
_alts = ", ".join(f"({k}, {a}::DOUBLE, {r}::DOUBLE)" for k, (a, r) in enumerate(detectors.ALTERNATIVES))
SR = f"""WITH RECURSIVE {CAL}, al(k, dl, rh) AS (VALUES {_alts}), lr AS MATERIALIZED (SELECT id, t, k, -ln(rh) - (z - dl) ** 2 / (2 * rh * rh) + z * z / 2 AS l FROM z, al),
r AS (SELECT id, CAST(-1 AS BIGINT) AS t, k, -50.0::DOUBLE AS o FROM (SELECT DISTINCT id, k FROM lr)
  UNION ALL SELECT lr.id, lr.t, lr.k, greatest(r.o, 0) + ln(1 + exp(-abs(r.o))) + lr.l FROM r JOIN lr ON lr.id = r.id AND lr.k = r.k AND lr.t = r.t + 1)
SELECT id, t, round(max(o) + ln(sum(exp(o - mx))) - ln(14), 6) AS log_sr FROM (SELECT *, max(o) OVER (PARTITION BY id, t) AS mx FROM r WHERE t >= 0) GROUP BY id, t"""
add("shiryaev_roberts", lambda spark, d: rounding(detectors.shiryaev_roberts(features.prepared(src.series_q(spark, d))), ["id", "t"], ["log_sr"]), SR)
add("hmm_posterior", lambda spark, d: rounding(detectors.hmm_posterior(features.prepared(src.series_q(spark, d)), mixture=detectors.atoms()), ["id", "t"], ["posterior"]))
add("wavelet_bands", lambda spark, d: (lambda w: rounding(w, ["id", "t"], [c for c in w.columns if c not in ("id", "t")]))(detectors.wavelet_bands(src.series_q(spark, d))))
add("student_log_density", lambda spark, d: rounding(detectors.student_log_density(features.prepared(src.series_q(spark, d))), ["id", "t"], ["log_t"]))
add(
    "score_ewma_postproc", lambda spark, d: rounding(detectors.postprocess(src.scores_e(spark, d).withColumn("score", F.col("score") / 7)), ["id", "t"], ["run_max", "ewma", "half_max"], 5),
    f"WITH {SCORES}, sv AS (SELECT id, t, score / 7 AS score FROM sc), p AS (SELECT *, max(score) OVER {CUM} AS run_max FROM sv), l AS (SELECT id, unnest(range(0, len(zs))) AS t, list_transform(range(1, len(zs) + 1), lambda k: list_reduce(zs[1:k], lambda a, b: 0.7 * a + 0.3 * b)) AS e FROM (SELECT id, list(score ORDER BY t) AS zs FROM sv GROUP BY id)) SELECT p.id, p.t, round(run_max, 5) AS run_max, round(e[p.t + 1], 5) AS ewma, round(0.5 * score + 0.5 * run_max, 5) AS half_max FROM p JOIN l USING (id, t)",
)

# ---- cohorts

stats = lambda spark, d: (lambda s: twosample.break_stats(s, src.labelled(s)))(src.series_q(spark, d))
BS = """ba AS (SELECT id, t, x FROM lab WHERE target = 1), bh AS (SELECT id, avg(x) AS mu, greatest(stddev_samp(x), 1e-9) AS sd FROM hist GROUP BY id), bm AS (SELECT id, count(*) AS n_post, avg(x) AS m, coalesce(stddev_samp(x), 0) AS s FROM ba GROUP BY id
), bf AS (SELECT id, coalesce(sum(d * pd) / nullif(sum(d * d), 0), 0) AS ac, part FROM (SELECT *, lag(d) OVER (PARTITION BY part, id ORDER BY t) AS pd FROM (SELECT id, t, part, x - avg(x) OVER (PARTITION BY part, id) AS d FROM (SELECT id, t, x, 1 AS part FROM hist UNION ALL SELECT id, t, x, 2 FROM ba))) GROUP BY id, part
), bv AS (SELECT id, x, count(*) FILTER (p = 1) AS a, count(*) FILTER (p = 2) AS b FROM (SELECT id, x, 1 AS p FROM hist UNION ALL SELECT id, x, 2 FROM ba) GROUP BY id, x), bk AS (SELECT id, max(abs(ca / na::DOUBLE - cb / nb::DOUBLE)) AS ks FROM (SELECT id, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY id) AS na, sum(b) OVER (PARTITION BY id) AS nb FROM bv WINDOW w AS (PARTITION BY id ORDER BY x ROWS UNBOUNDED PRECEDING)) WHERE na > 0 AND nb > 0 GROUP BY id
), bs AS (SELECT bm.id, n_post, (m - mu) / sd AS dmean, ln(greatest(s ** 2, 1e-12) / sd ** 2) AS dlogvar, f2.ac - f1.ac AS dacf, ks FROM bm JOIN bh USING (id) JOIN bf f1 ON f1.id = bm.id AND f1.part = 1 JOIN bf f2 ON f2.id = bm.id AND f2.part = 2 JOIN bk ON bk.id = bm.id)"""
add("break_stats", lambda spark, d: rounding(stats(spark, d), ["id", "n_post"], ["dmean", "dlogvar", "dacf", "ks"]), rounded("SELECT * FROM bs", "id, n_post", ["dmean", "dlogvar", "dacf", "ks"], f"{SERIES}, {BS}"))
add("break_type_flags", lambda spark, d: twosample.type_flags(stats(spark, d)), f"WITH {SERIES}, {BS} SELECT id, CAST(m AS INTEGER) AS is_mean, CAST(v AS INTEGER) AS is_var, CAST(a AS INTEGER) AS is_acf, CAST(NOT (m OR v OR a) AS INTEGER) AS is_subtle FROM (SELECT id, abs(dmean) > 0.5 AS m, abs(dlogvar / 2) > ln(1.5) AS v, abs(dacf) > 0.2 AS a FROM bs)")
add("break_type_dominant", lambda spark, d: twosample.type_dominant(stats(spark, d)), f"WITH {SERIES}, {BS} SELECT id, CASE WHEN n_post < 20 THEN 'short_post' WHEN greatest(m, v, a) < 1 THEN 'subtle' WHEN m >= v AND m >= a THEN 'mean' WHEN v >= a THEN 'var' ELSE 'acf' END AS kind FROM (SELECT id, n_post, abs(dmean) / 0.25 AS m, abs(dlogvar) / 0.30 AS v, abs(dacf) / 0.12 AS a FROM bs)")
add("break_type_ks", lambda spark, d: twosample.type_ks(stats(spark, d)), f"WITH {SERIES}, {BS} SELECT id, CASE WHEN ks < 0.15 THEN 'subtle' WHEN abs(dmean) > 0.25 AND abs(dlogvar) > 0.30 THEN 'both' WHEN abs(dmean) > 0.25 THEN 'mean' WHEN abs(dlogvar) > 0.30 THEN 'var' ELSE 'other' END AS kind FROM bs")
add("break_type_shares", lambda spark, d: rounding(twosample.shares(twosample.type_flags(stats(spark, d)), "is_mean", "is_var", "is_acf", "is_subtle"), [], [f"share_is_{k}" for k in ("mean", "var", "acf", "subtle")]), f"WITH {SERIES}, {BS}, f AS (SELECT abs(dmean) > 0.5 AS m, abs(dlogvar / 2) > ln(1.5) AS v, abs(dacf) > 0.2 AS a FROM bs) SELECT round(avg(m::INT), 6) AS share_is_mean, round(avg(v::INT), 6) AS share_is_var, round(avg(a::INT), 6) AS share_is_acf, round(avg((NOT (m OR v OR a))::INT), 6) AS share_is_subtle FROM f")
AGES = [(0, 25), (25, 50), (50, 100), (100, 1000)]
detector_scores = lambda spark, d: features.cusum(features.prepared(src.series_q(spark, d), calibration.moments(src.history(src.series_q(spark, d)))), 0.5, "c").select("id", "t", F.round("c_n", 6).alias("score"))
DET = f"{sql.cusum_ctes('z', 0.5, 'k05', 'z')}, ds AS (SELECT id, t, round(m / sqrt(n), 6) AS score FROM k05), dl AS (SELECT lab.id, lab.t, target, tau_index, score FROM lab JOIN ds USING (id, t))"
add("cohort_auc_by_age", lambda spark, d: rounding(blend.by_age(labelled(spark, d), detector_scores(spark, d), AGES), ["bucket", "pairs"], ["ts_auc"], 9), f"WITH {CAL}, {DET}, bk(a, b) AS (VALUES (0, 25), (25, 50), (50, 100), (100, 1000)), r AS (SELECT a || '-' || b AS bucket, t, score, target AS y FROM dl, bk WHERE target = 0 OR (t - tau_index >= a AND t - tau_index < b)) " + sql.auc("r", "bucket"))
add("cohort_auc_by_step", lambda spark, d: rounding(blend.by_step(labelled(spark, d), detector_scores(spark, d)), ["bucket", "pairs"], ["ts_auc"], 9), f"WITH {CAL}, {DET}, r AS (SELECT CAST(t // 60 AS BIGINT) AS bucket, t, score, target AS y FROM dl) " + sql.auc("r", "bucket"))
add("topk_false_alarms", lambda spark, d: blend.false_alarms(labelled(spark, d), detector_scores(spark, d)), f"WITH {CAL}, {DET} SELECT id, max(score) AS top FROM dl WHERE tau_index IS NULL GROUP BY id ORDER BY top DESC, id LIMIT 10")

# ---- members and blends over events

MEMBERS = f"{SCORES}, mb AS (SELECT *, score AS a, CAST((id * 31 + t * 17) % 101 AS DOUBLE) AS b FROM sc)"


def members(spark: SparkSession, d: str) -> DataFrame:
    return src.scores_e(spark, d).withColumns({"a": F.col("score"), "b": F.pmod(F.col("id") * 31 + F.col("t") * 17, F.lit(101)).cast("double")})


add("spearman_members", lambda spark, d: rounding(blend.spearman(members(spark, d), "a", "b"), [], ["spearman", "pearson"]), f"WITH {MEMBERS}, r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM mb) SELECT round(corr(ra, rb), 6) AS spearman, round(corr(a, b), 6) AS pearson FROM r")
add("zmatch_blend", lambda spark, d: rounding(blend.z_match(members(spark, d), "b", "a").withColumn("blend", 0.8 * F.col("a") + 0.2 * F.col("b_matched")), ["id", "t"], ["b_matched", "blend"], 4), f"WITH {MEMBERS}, m AS (SELECT id, t, a, (b - avg(b) OVER ()) / greatest(stddev_pop(b) OVER (), 1e-9) * stddev_pop(a) OVER () + avg(a) OVER () AS k FROM mb) SELECT id, t, round(k, 4) AS b_matched, round(0.8 * a + 0.2 * k, 4) AS blend FROM m")
_grid = [0.0, 0.25, 0.5, 0.75, 1.0]
add(
    "blend_grid", lambda spark, d: rounding(blend.blend_grid(members(spark, d), "a", "b", _grid), ["w", "robust"], ["auc_all", "auc_even", "auc_odd"], 9),
    f"WITH {MEMBERS}, g AS (SELECT w, part, t, y, (1 - w) * a + w * b AS score FROM mb, (SELECT unnest({_grid})::DOUBLE AS w), (VALUES ('all'), ('even'), ('odd')) v(part) WHERE part = 'all' OR (part = 'even') = (id % 2 = 0)), u AS ("
    + sql.auc("(SELECT w || '/' || part AS wp, t, y, score FROM g)", "wp")
    + "), x AS (SELECT CAST(split_part(wp, '/', 1) AS DOUBLE) AS w, max(ts_auc) FILTER (split_part(wp, '/', 2) = 'all') AS auc_all, max(ts_auc) FILTER (split_part(wp, '/', 2) = 'even') AS auc_even, max(ts_auc) FILTER (split_part(wp, '/', 2) = 'odd') AS auc_odd FROM u GROUP BY 1) SELECT x.w, CAST(x.auc_all > o.auc_all AND x.auc_even > o.auc_even AND x.auc_odd > o.auc_odd AS INTEGER) AS robust, x.auc_all, x.auc_even, x.auc_odd FROM x, (SELECT * FROM x WHERE w = 0) o",
)
_gr = [("1", "1"), ("1", "a"), ("1", "b"), ("a", "a"), ("a", "b"), ("b", "b")]
_gn = ["g00", "g01", "g02", "g11", "g12", "g22", "y0", "y1", "y2"]
add("ridge_gram", lambda spark, d: rounding(blend.gram(members(spark, d), ["a", "b"], "y"), [], _gn, 2), f"WITH {MEMBERS} SELECT " + ", ".join(f"round(sum({p} * {q})::DOUBLE, 2) AS {n}" for (p, q), n in zip(_gr, _gn)) + ", " + ", ".join(f"round(sum({p} * (2 * y - 1))::DOUBLE, 2) AS {n}" for p, n in (("1", "y0"), ("a", "y1"), ("b", "y2"))) + " FROM mb")
add("missing_fill_median", lambda spark, d: (lambda m: blend.fill_missing(m.select("id", "t", "a"), m.filter("t % 3 != 0").select("id", "t", "b"), "b"))(members(spark, d)), f"WITH {MEMBERS}, k AS (SELECT id, t, b FROM mb WHERE t % 3 <> 0) SELECT mb.id, mb.t, a, coalesce(k.b, (SELECT median(b) FROM k)) AS b FROM mb LEFT JOIN k USING (id, t)")
add("rank_mean_blend", lambda spark, d: rounding(blend.rank_mean(members(spark, d), ["a", "b"]), ["id", "t"], ["rank_mean"]), f"WITH {MEMBERS} SELECT id, t, round((rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE + rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE) / 2, 6) AS rank_mean FROM mb")

# ---- models and nets: rows only, held against NumPy and by their quality in tests

FEATURES = ["cum_mean_z", "cum_logvar_ratio", "c", "c_n"]


def training_rows(spark: SparkSession, d: str, store: bool = False) -> DataFrame:
    """Rows of four features, target and weight.  With ``store`` the numbered series are written first, as history and online rows would each shuffle the whole table."""
    s = src.series_q(spark, d)
    s = stored(s, "series") if store else s
    rows = features.cusum(features.cumulative_moments(features.prepared(s)), 0.5, "c").filter("id is not null")
    return metric.ramp_weight(src.with_labels(rows), keep=tuple(FEATURES))


for _k in ("gru", "lstm", "cnn", "attention"):
    add(f"{_k}_forward", lambda spark, d, k=_k: rounding(nets.forward(training_rows(spark, d), k, FEATURES, nets.random_weights(k, len(FEATURES))), ["id", "t"], ["logit"]))
for _k, _f in (("gbt_member", models.boosted), ("logistic_member", models.logistic), ("forest_member", models.forest), ("pairwise_member", models.pairwise)):
    add(_k, lambda spark, d, f=_f: models.out_of_fold(f, training_rows(spark, d, store=True), FEATURES))
add("synthetic_series", lambda spark, d: synthesis.generate(spark, 50))


add("feature_bank", lambda spark, d: feature_bank(src.series_q(spark, d)))


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The event file as a stream of (id, seq, x)."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a pattern: a stream's plain path has to be a folder
    return rows.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.round(F.col("value") * 100).cast("bigint").cast("double").alias("x"))


def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """The online detector as a streaming query over the event file."""
    return rounding(online.run_available(online.detect(event_stream(spark, d), src.EVENT_HISTORY)), ["id", "t"], ["score"])


EVENTS = """ev AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS time, CAST(round(value * 100) AS DOUBLE) AS x FROM events
), eh AS (SELECT id, avg(x) AS mu, greatest(stddev_samp(x), 1e-9) AS sd FROM ev WHERE time <= 32 GROUP BY id), ez AS (SELECT id, time - 33 AS t, time - 32 AS n, (x - mu) / sd AS z FROM ev JOIN eh USING (id) WHERE time > 32)"""
_stream = f"WITH {EVENTS}, {sql.cusum_ctes('z', 0.5, 'k05', 'ez')} SELECT id, t, round(1 - exp(-m / sqrt(n)), 6) + 0.0::DOUBLE AS score FROM k05"
add("stream_cusum_scores", stream_scores, _stream)
add("batch_cusum_scores", lambda spark, d: rounding(online.detect_batch(src.series_e(spark, d)), ["id", "t"], ["score"]), _stream)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Calibrate, score by a two-sided CUSUM and evaluate by TS-AUC."""
    scores = detector_scores(spark, d).join(labelled(spark, d).select("id", "t", F.col("target").alias("y")), ["id", "t"])
    return rounding(metric.ts_auc(scores), ["pairs"], ["ts_auc"], 9)


add("cusum_ts_auc", flagship, f"WITH {CAL}, {DET}, r AS (SELECT t, score, target AS y FROM dl) " + sql.auc("r"))
