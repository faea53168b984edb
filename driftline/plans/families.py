"""More registered queries: selections, changes between segments, pools of members and gates, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.scalars import WICHURA
from driftline.operators import augment, calibration, change, detectors, features, gates, metric, models, selection, synthesis, twosample
from driftline.operators.ranks import with_rank, with_ranks
from driftline.plans import sql
from driftline.plans.catalog import BS, CUM_COLS, DET, EMB, EVENTS, FEATURES, HNULL, KNOTS, ORACLES, add, detector_scores, event_stream, ewma_sql, labelled, online_query, rounding, series_query, stats, training_rows
from driftline.plans.sql import CAL, CUM, SCORES, SERIES, W, rounded
from driftline.sources import series as src
from driftline.streaming import online

# ---- selections

add("min_length_series", lambda spark, d: selection.long_enough(src.series_e(spark, d), 32, 30).groupBy("id").agg(F.count("*").alias("rows")), f"WITH {EVENTS} SELECT id, count(*) AS rows FROM ev GROUP BY id HAVING count(*) FILTER (time <= 32) >= 32 AND count(*) FILTER (time > 32) >= 30")
_cumulative = lambda spark, d: features.cumulative_moments(features.prepared(src.series_q(spark, d))).select("id", "t", *CUM_COLS)
_cum_sql = lambda cols: rounded("SELECT id, t, " + ", ".join(f"{CUM_COLS[c]} AS {c}" for c in cols) + " FROM z", "id, t", cols, CAL)
VERSIONS = {"v1": ["cum_mean_z", "cum_logvar_ratio"], "v2": ["cum_mean_z", "cum_logvar_ratio", "cum_skew", "cum_mean_z", "cum_kurt"]}


def projection(name: str, pick, cols: list[str]) -> None:
    add(name, lambda spark, d: (lambda df: rounding(df, ["id", "t"], df.columns[2:]))(pick(_cumulative(spark, d))), _cum_sql(cols))


projection("projection_without", lambda df: selection.projected(df, ("cum_mean_dev", "cum_skew")), [c for c in CUM_COLS if c not in ("cum_mean_dev", "cum_skew")])
projection("projection_matching", lambda df: selection.projected(df, keep=r"cum_(mean|logvar).*"), ["cum_mean_dev", "cum_mean_z", "cum_logvar_ratio"])
projection("projection_version", lambda df: selection.of_version(df, VERSIONS, "v2"), ["cum_mean_z", "cum_logvar_ratio", "cum_skew", "cum_kurt"])
add("table_schema", lambda spark, d: src.describe_columns(src.scan(spark, d, "lineitem")), "SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS type FROM (DESCRIBE lineitem)")
add("stride_sample", lambda spark, d: selection.strided(src.scores_e(spark, d), 5).select("id", "t", "score"), f"WITH {SCORES} SELECT id, t, score FROM (SELECT *, row_number() OVER (ORDER BY id, t) - 1 AS p FROM sc) WHERE p % 5 = 0")
add("balanced_sample", lambda spark, d: selection.balanced(src.scores_e(spark, d), "y", 60).select("id", "t", "y"), f"WITH {SCORES} SELECT id, t, y FROM sc QUALIFY row_number() OVER (PARTITION BY y ORDER BY (id * 7919 + t * 104729) % 1000003, id, t) <= 60")


def finite_rows(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    value = F.when(s % 7 == 0, F.lit(float("nan"))).when(s % 11 == 0, F.lit(float("inf"))).when(s % 13 == 0, F.lit(None)).otherwise(s / 4)
    return selection.finite(src.scores_e(spark, d).withColumn("v", value), "v").groupBy("y").agg(F.count("*").alias("rows"), F.sum("v").alias("total"))


add("finite_rows", finite_rows, f"WITH {SCORES} SELECT y, count(*) AS rows, sum(score / 4) AS total FROM sc WHERE score % 7 <> 0 AND score % 11 <> 0 AND score % 13 <> 0 GROUP BY y")
add("histogram_data", lambda spark, d: selection.histogram(src.scores_e(spark, d), "score", 0.0, 50000.0, 50), f"WITH {SCORES} SELECT CAST(least(greatest(floor(score / 1000), 0), 49) AS INTEGER) AS bin, count(*) AS n FROM sc GROUP BY 1")
add("composite_key_match", lambda spark, d: (lambda s: selection.unmatched(s, s.filter("t % 3 != 0"), ["id", "t"]))(src.scores_e(spark, d)), f"WITH {SCORES} SELECT count(*) AS rows, count(*) FILTER (t % 3 <> 0) AS matched, count(*) FILTER (t % 3 = 0) AS missing FROM sc")
add("row_lookup", lambda spark, d: (lambda s: selection.lookup(s.filter("t % 7 = 0").select("id", "t"), s, ["id", "t"]))(src.scores_e(spark, d)), f"WITH {SCORES} SELECT id, t, score, y FROM sc WHERE t % 7 = 0")
PULL = [5, 10, 20, 40]
add(
    "trailing_window_pull", lambda spark, d: rounding(selection.trailing_pull(src.scores_e(spark, d).withColumnRenamed("score", "x"), PULL, 16).groupBy("id", "step").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most")), ["id", "step", "n"], ["mean", "least", "most"]),
    f"WITH {SCORES}, g AS (SELECT unnest({PULL})::BIGINT AS step) SELECT id, step, count(*) AS n, round(avg(score), 6) AS mean, min(score) AS least, max(score) AS most FROM sc JOIN g ON t >= step - 16 AND t < step GROUP BY id, step",
)


def owner_windows(spark: SparkSession, d: str) -> DataFrame:
    """Online blocks of 40 rows, their means in units of the series' historical blocks."""
    s = src.series_q(spark, d)
    blocks = lambda rows: rows.groupBy(F.col("id").alias("owner"), F.floor(F.col("t") / 40).alias("block")).agg(F.avg("x").alias("v"))
    return rounding(selection.owner_z(blocks(src.online(s)), blocks(src.history(s)), "v"), ["owner", "block"], ["v", "v_z"])


add("owner_null_z", owner_windows, f"WITH {SERIES}, hb AS (SELECT id, t // 40 AS block, avg(x) AS v FROM hist GROUP BY ALL), hs AS (SELECT id, count(*) AS k, avg(v) AS m, stddev_pop(v) AS s FROM hb GROUP BY id), ob AS (SELECT id AS owner, CAST(t // 40 AS BIGINT) AS block, avg(x) AS v FROM onl GROUP BY ALL) SELECT owner, block, round(v, 6) AS v, round((v - coalesce(m, 0)) / CASE WHEN k >= 2 THEN s + 1e-9 ELSE 1 END, 6) AS v_z FROM ob LEFT JOIN hs ON hs.id = owner")
KINDS = ["hist", "early", "cum", "trail"]
KIND_SQL = EMB + ", k AS (SELECT vec_id // 4 AS sid, vec_id % 4 AS kind, v FROM e1), w AS (SELECT sid, " + ", ".join(f"any_value(v) FILTER (kind = {i}) AS {k}" for i, k in enumerate(KINDS)) + " FROM k GROUP BY sid HAVING count(DISTINCT kind) = 4)"


def kinds_of(spark: SparkSession, d: str) -> DataFrame:
    """Four neighbouring vectors stand for a series' embeddings of four windows."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("vec_id") % 4 + 1).cast("int"))
    vectors = src.scan(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("sid"), kind.alias("kind"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return selection.by_kind(vectors, KINDS)


def kind_distances(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, a, b in (("hist_cum", "hist", "cum"), ("hist_trail", "hist", "trail"), ("early_trail", "early", "trail")):
        one = twosample.embedding_distances(kinds_of(spark, d).select(F.col("sid").alias("key"), F.col(a).alias("a"), F.col(b).alias("b"))).select(F.col("key").alias("sid"), F.col("cosine").alias(f"cos_{name}"), F.col("l2").alias(f"l2_{name}"))
        out = one if out is None else out.join(one, "sid")
    return rounding(out, ["sid"], [f"{m}_{n}" for n in ("hist_cum", "hist_trail", "early_trail") for m in ("cos", "l2")], 5)


_cos = lambda a, b: f"round(1 - list_dot_product({a}, {b}) / greatest(sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})), 1e-12), 5) + 0.0::DOUBLE"
_l2 = lambda a, b: f"round(sqrt(list_dot_product({a}, {a}) + list_dot_product({b}, {b}) - 2 * list_dot_product({a}, {b})), 5)"
add("embedding_kind_distances", kind_distances, f"WITH {KIND_SQL} SELECT sid, " + ", ".join(f"{f(a, b)} AS {m}_{a}_{b}" for a, b in (("hist", "cum"), ("hist", "trail"), ("early", "trail")) for m, f in (("cos", _cos), ("l2", _l2))) + " FROM w")
DIFF = (("cum", "hist"), ("trail", "hist"), ("trail", "early"))
add(
    "embedding_difference_vector", lambda spark, d: rounding(kinds_of(spark, d).select("sid", F.posexplode(selection.difference_vector(*DIFF)).alias("i", "v")), ["sid", "i"], ["v"]),
    f"WITH {KIND_SQL} SELECT sid, CAST(unnest(range(0, len(v))) AS INTEGER) AS i, round(unnest(v), 6) + 0.0::DOUBLE AS v FROM (SELECT sid, list_concat(list_concat(" + ", ".join(f"list_transform(list_zip({a}, {b}), lambda p: p[1] - p[2])" for a, b in DIFF[:2]) + "), " + "list_transform(list_zip(trail, early), lambda p: p[1] - p[2])) AS v FROM w)",
)
add("embedding_max_pool", lambda spark, d: rounding(selection.pooled_max(src.scan(spark, d, "embeddings"), "label", "embedding"), ["label", "i"], ["v"]), "SELECT label, CAST(i AS INTEGER) AS i, round(max(embedding[i + 1]::DOUBLE), 6) + 0.0::DOUBLE AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS i) GROUP BY label, i")


def id_sets(spark: SparkSession, d: str) -> DataFrame:
    """Customers with and without orders, as sets of ids."""
    left, right = src.scan(spark, d, "customer", ["c_custkey"]).withColumnRenamed("c_custkey", "id"), src.scan(spark, d, "orders", ["o_custkey"]).withColumnRenamed("o_custkey", "id").distinct()
    both = left.join(right, "id", "left_semi").select(F.lit("both").alias("side"), "id")
    return both.unionByName(left.join(right, "id", "left_anti").select(F.lit("left only").alias("side"), "id")).unionByName(right.join(left, "id", "left_anti").select(F.lit("right only").alias("side"), "id"))


add("id_set_difference", id_sets, "SELECT CASE WHEN c_custkey IS NULL THEN 'right only' WHEN o_custkey IS NULL THEN 'left only' ELSE 'both' END AS side, coalesce(c_custkey, o_custkey) AS id FROM (SELECT DISTINCT c_custkey FROM customer) FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey")
add("ordered_rows", lambda spark, d: selection.globally_numbered(src.scores_e(spark, d)).select("position", "id", "t", "score").orderBy("id", "t"), f"WITH {SCORES} SELECT row_number() OVER (ORDER BY id, t) - 1 AS position, id, t, score FROM sc")
add("global_rank", lambda spark, d: with_rank(src.scores_e(spark, d), "score", "rank").select("id", "t", "rank"), f"WITH {SCORES} SELECT id, t, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rank FROM sc")
add("ordinal_rank", lambda spark, d: with_rank(src.scores_e(spark, d), "score", "rank", "ordinal", ("id", "t")).select("id", "t", F.col("rank").cast("long").alias("rank")), f"WITH {SCORES} SELECT id, t, row_number() OVER (ORDER BY score, id, t) AS rank FROM sc")
add("holdout_by_series", lambda spark, d: src.series_e(spark, d).groupBy("id").agg(F.count("*").alias("rows")).select("id", "rows", gates.held_out().cast("int").alias("held_out"), gates.half().alias("half")), f"WITH {EVENTS} SELECT id, count(*) AS rows, CAST((id * 7919 + 42) % 1000 < 200 AS INTEGER) AS held_out, CASE WHEN (id * 7919 + 1) % 1000 < 500 THEN 'a' ELSE 'b' END AS half FROM ev GROUP BY id")
add("value_counts", lambda spark, d: twosample.type_dominant(stats(spark, d)).groupBy("kind").agg(F.count("*").alias("n")), f"WITH {SERIES}, {BS} SELECT CASE WHEN n_post < 20 THEN 'short_post' WHEN greatest(m, v, a) < 1 THEN 'subtle' WHEN m >= v AND m >= a THEN 'mean' WHEN v >= a THEN 'var' ELSE 'acf' END AS kind, count(*) AS n FROM (SELECT id, n_post, abs(dmean) / 0.25 AS m, abs(dlogvar) / 0.30 AS v, abs(dacf) / 0.12 AS a FROM bs) GROUP BY 1")

# ---- changes between the history and the online rows

SEG = f"{SERIES}, seg AS (SELECT id, 1 AS part, t, x FROM hist UNION ALL SELECT id, 2, t, x FROM onl)"
P = "PARTITION BY id, part"


def acf_sql(source: str, value: str) -> str:
    return f"SELECT id, part, CASE WHEN sum(d * d) > 1e-12 THEN sum(d * pd) / sum(d * d) ELSE 0 END AS acf FROM (SELECT *, lag(d) OVER ({P} ORDER BY t) AS pd FROM (SELECT *, v - avg(v) OVER ({P}) AS d FROM (SELECT *, {value} AS v FROM {source}))) GROUP BY id, part"


def contrast_query(name: str, build, columns: list[str], tables: list[str], ctes: str = SEG) -> None:
    """Two parts' statistics held against each other; ``tables`` give (id, part, c) per column."""
    joined = " JOIN ".join(f"(SELECT id, abs(max(c) FILTER (part = 2) - max(c) FILTER (part = 1)) AS {c}_change FROM ({t}) GROUP BY id HAVING count(*) = 2) {'' if k == 0 else 'USING (id)'}" for k, (c, t) in enumerate(zip(columns, tables)))
    names = [f"{c}_change" for c in columns]
    series_query(name, lambda s: change.contrast(build(change.segments(s)), columns), ["id"], names, rounded(f"SELECT * FROM {joined}", "id", names, ctes))


_dev = f"(SELECT *, x - avg(x) OVER ({P}) AS c FROM seg)"
contrast_query("deviation_acf_change", change.deviation_acf, ["abs_acf", "sq_acf"], [acf_sql(_dev, v).replace("AS acf", "AS c") for v in ("abs(c)", "c * c")])
contrast_query("turning_point_change", change.turning_points, ["turning"], [f"SELECT id, part, coalesce(avg(CASE WHEN d * pd < 0 THEN 1.0::DOUBLE WHEN d * pd >= 0 THEN 0 END), 0) AS c FROM (SELECT *, lag(d) OVER ({P} ORDER BY t) AS pd FROM (SELECT *, x - lag(x) OVER ({P} ORDER BY t) AS d FROM seg)) GROUP BY id, part"])
_lag_rows = " UNION ALL ".join(f"SELECT id, part, ln({k}::DOUBLE) AS lx, ln(sqrt(avg(d * d)) + 1e-12) AS ly FROM (SELECT id, part, x - lag(x, {k}) OVER ({P} ORDER BY t) AS d FROM seg) GROUP BY id, part" for k in (2, 4, 8, 16, 32))
contrast_query("hurst_change", change.scaling, ["hurst"], [f"SELECT id, part, CASE WHEN n >= 32 AND k >= 3 THEN s ELSE 0.5 END AS c FROM (SELECT id, part, regr_slope(ly, lx) AS s, count(ly) AS k FROM ({_lag_rows}) GROUP BY id, part) JOIN (SELECT id, part, count(*) AS n FROM seg GROUP BY id, part) USING (id, part)"])
contrast_query("order_entropy_change", change.order_entropy, ["order_entropy"], [f"SELECT id, part, coalesce(e, 0) AS c FROM (SELECT DISTINCT id, part FROM seg) LEFT JOIN (SELECT id, part, -sum(p * ln(p)) / {sql.LOG6!r} AS e FROM (SELECT id, part, count(*) / sum(count(*)) OVER ({P}) AS p FROM (SELECT id, part, x, lag(x, 2) OVER ({P} ORDER BY t) AS a, lag(x) OVER ({P} ORDER BY t) AS b, count(*) OVER ({P}) AS n FROM seg) WHERE a IS NOT NULL AND n >= 5 GROUP BY id, part, a <= b, b <= x, a <= x) GROUP BY id, part) USING (id, part)"])
ONE_SIDED = """os AS (SELECT id, max(greatest(abs(lt / na - first / nb), abs(lt / na - last / nb))) AS ks FROM (
  SELECT o.id, o.x, count(*) FILTER (h.x < o.x) AS lt, count(*)::DOUBLE AS na, any_value(o.first) AS first, any_value(o.last) AS last, any_value(o.nb)::DOUBLE AS nb FROM (
    SELECT id, x, min(r) AS first, max(r) AS last, any_value(nb) AS nb FROM (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY x) AS r, count(*) OVER (PARTITION BY id) AS nb FROM onl) GROUP BY id, x) o
  JOIN hist h ON h.id = o.id GROUP BY o.id, o.x) GROUP BY id)"""
series_query("ks_one_sided", change.one_sided_kolmogorov, ["id"], ["ks"], rounded("SELECT * FROM os", "id", ["ks"], f"{SERIES}, {ONE_SIDED}"))
BREAK = f"""br AS (SELECT id, target + 1 AS part, t, x FROM lab WHERE tau_index IS NOT NULL), bc AS ({acf_sql('br', 'x')}), bp AS (SELECT id, part, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM br GROUP BY id, part
), bd AS (SELECT id, max(abs(ca / na::DOUBLE - cb / nb::DOUBLE)) AS ks FROM (SELECT id, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY id) AS na, sum(b) OVER (PARTITION BY id) AS nb FROM (SELECT id, x, count(*) FILTER (part = 1) AS a, count(*) FILTER (part = 2) AS b FROM br GROUP BY id, x) WINDOW w AS (PARTITION BY id ORDER BY x ROWS UNBOUNDED PRECEDING)) WHERE na > 0 AND nb > 0 GROUP BY id
), ab AS (SELECT u.id, u.n AS n_pre, v.n AS n_post, u.m AS pre_mean, v.m AS post_mean, u.s AS pre_std, v.s AS post_std, c.acf AS pre_acf1, e.acf AS post_acf1, v.m - u.m AS mean_shift, CASE WHEN u.s > 1e-9 THEN v.s / u.s END AS std_ratio, ks AS ks_stat
  FROM bp u JOIN bp v ON u.id = v.id AND u.part = 1 AND v.part = 2 JOIN bc c ON c.id = u.id AND c.part = 1 JOIN bc e ON e.id = u.id AND e.part = 2 JOIN bd ON bd.id = u.id WHERE u.n >= 2 AND v.n >= 2)"""
_around = ["pre_mean", "post_mean", "pre_std", "post_std", "pre_acf1", "post_acf1", "mean_shift", "std_ratio", "ks_stat"]
add("break_summary", lambda spark, d: rounding(change.around_break(labelled(spark, d)), ["id", "n_pre", "n_post"], _around), rounded("SELECT * FROM ab", "id, n_pre, n_post", _around, f"{SERIES}, {BREAK}"))
add("history_summary", lambda spark, d: (lambda s: rounding(calibration.moments(src.history(s)).join(calibration.autocorrelation(src.history(s), 1), "id").withColumnRenamed("acf1_h", "hist_acf1"), ["id", "n_hist"], ["mu", "sd", "hist_acf1"]))(src.series_q(spark, d)), rounded("SELECT id, n_hist, mu, sd, acf1_h AS hist_acf1 FROM c0 JOIN c2 USING (id)", "id, n_hist", ["mu", "sd", "hist_acf1"], CAL))
add(
    "label_suspects", lambda spark, d: rounding(change.label_suspects(src.series_q(spark, d), labelled(spark, d)), ["id", "n_online", "suspect"], ["ks", "logvar", "mean_z"]),
    rounded("SELECT *, CAST(ks > 0.35 OR logvar > 1.2 OR mean_z > 6 AS INTEGER) AS suspect FROM (SELECT o.id, n_online, ks, abs(ln(v / (sd * sd) + 1e-12)) AS logvar, abs((m - mu) / sd) * sqrt(n_online) AS mean_z FROM (SELECT id, count(*) AS n_online, avg(x) AS m, var_pop(x) AS v FROM lab WHERE tau_index IS NULL GROUP BY id HAVING count(*) >= 50) o JOIN (SELECT id, avg(x) AS mu, greatest(stddev_pop(x), 1e-9) AS sd FROM hist GROUP BY id) h USING (id) JOIN os USING (id))", "id, n_online, suspect", ["ks", "logvar", "mean_z"], f"{SERIES}, {ONE_SIDED}"),
)
_spread = "SELECT id, stddev_pop((m - mu) / (sd / sqrt(50.0::DOUBLE))) AS sd_mean_z, stddev_pop(ln(v / (sd * sd) + 1e-12)) AS sd_logvar FROM (SELECT id, t, count(*) OVER (PARTITION BY id) AS n, avg(x) OVER (PARTITION BY id) AS mu, greatest(stddev_pop(x) OVER (PARTITION BY id), 1e-9) AS sd, avg(x) OVER w AS m, var_pop(x) OVER w AS v FROM hist WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) WHERE t >= n // 2 AND t < n - 50 AND (t - n // 2) % 25 = 0 GROUP BY id"
series_query("null_spread", change.null_spread, ["id"], ["sd_mean_z", "sd_logvar"], rounded(_spread, "id", ["sd_mean_z", "sd_logvar"], SERIES))
_pcols = ["p10", "p50", "p90"]
add("null_spread_percentiles", lambda spark, d: rounding(selection.percentiles(change.null_spread(src.series_q(spark, d)), ["sd_mean_z", "sd_logvar"], (0.1, 0.5, 0.9)), ["statistic", "n"], _pcols), f"WITH {SERIES}, sp AS ({_spread}), fl AS (SELECT 'sd_mean_z' AS statistic, sd_mean_z AS v FROM sp UNION ALL SELECT 'sd_logvar', sd_logvar FROM sp) SELECT statistic, count(*) AS n, " + ", ".join(f"round(quantile_cont(v, {p}), 6) AS p{round(100 * p)}" for p in (0.1, 0.5, 0.9)) + " FROM fl GROUP BY statistic")
DGP = f"""{SERIES}, {BREAK}, hq AS (SELECT id, 1 AS part, t, x FROM hist), hr AS ({acf_sql('hq', 'x')}), hc AS (SELECT id, part, t, x - avg(x) OVER (PARTITION BY id) AS c FROM hq), hi AS (SELECT id, part, t, c - acf * lag(c) OVER (PARTITION BY id ORDER BY t) AS x FROM hc JOIN hr USING (id, part)
), hj AS ({acf_sql('(SELECT * FROM hi WHERE x IS NOT NULL)', 'x')}), dg AS (SELECT s0.*, hr.acf AS rho_h, k.kurt_h, hj.acf AS rho_innov, CASE WHEN ok THEN mean_shift / (std_h + 1e-9) END AS brk_dmean, CASE WHEN ok THEN ln((post_std ** 2 * (n_post - 1) / n_post + 1e-9) / (pre_std ** 2 * (n_pre - 1) / n_pre + 1e-9)) END AS brk_lvr,
  CASE WHEN ok THEN post_acf1 - pre_acf1 END AS brk_dacf, CASE WHEN ok THEN ks_stat END AS brk_ks, CASE WHEN ok THEN tau / n_online::DOUBLE END AS brk_taufrac FROM (
    SELECT *, tau > 5 AND tau < n_online - 5 AS ok FROM (SELECT id, count(*) FILTER (period = 1) AS n_hist, count(*) FILTER (period = 2) AS n_online, stddev_pop(x) FILTER (period = 1) AS std_h, any_value(CASE WHEN id % 2 = 0 THEN 60 + (id * 37) % 120 END) AS tau FROM s GROUP BY id) WHERE n_hist >= 50 AND n_online >= 30) s0
  JOIN hr USING (id) JOIN (SELECT id, avg(c ** 4) / avg(c * c) ** 2 - 3 AS kurt_h FROM hc GROUP BY id) k USING (id) JOIN hj USING (id) LEFT JOIN ab USING (id))"""
_dgp = ["rho_h", "std_h", "kurt_h", "rho_innov", "brk_dmean", "brk_lvr", "brk_dacf", "brk_ks", "brk_taufrac"]
_process = lambda spark, d: change.process(src.series_q(spark, d), labelled(spark, d))
add("dgp_measurement", lambda spark, d: rounding(_process(spark, d), ["id", "n_hist", "n_online"], _dgp), rounded("SELECT * FROM dg", "id, n_hist, n_online", _dgp, DGP))
_at = (0.05, 0.25, 0.5, 0.75, 0.95)
add("percentile_report", lambda spark, d: rounding(selection.percentiles(_process(spark, d), _dgp, _at), ["statistic", "n"], [f"p{round(100 * p)}" for p in _at]), f"WITH {DGP}, fl AS (" + " UNION ALL ".join(f"SELECT '{c}' AS statistic, {c} AS v FROM dg" for c in _dgp) + ") SELECT statistic, count(*) AS n, " + ", ".join(f"round(quantile_cont(v, {p}), 6) + 0.0::DOUBLE AS p{round(100 * p)}" for p in _at) + " FROM fl WHERE v IS NOT NULL GROUP BY statistic")


def forecast_residuals(spark: SparkSession, d: str) -> DataFrame:
    """The history's own quantiles stand for a forecast."""
    s = src.series_q(spark, d)
    q = src.history(s).groupBy("id").agg(F.percentile("x", F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("q")).select("id", F.col("q")[0].alias("lo"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("hi"))
    return rounding(change.forecast_residual(src.online(s), q), ["id", "t"], ["resid", "resid_max"])


add("forecast_residual", forecast_residuals, rounded(f"SELECT id, t, r AS resid, max(r) OVER {CUM} AS resid_max FROM (SELECT id, t, abs(x - mid) / greatest(hi - lo, 1e-6) AS r FROM onl JOIN (SELECT id, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.5) AS mid, quantile_cont(x, 0.9) AS hi FROM hist GROUP BY id) USING (id))", "id, t", ["resid", "resid_max"], SERIES))
ENV_STEPS, ENV_LENGTHS = [100, 150, 200, 250, 300, 400], [20, 40, 80, 160]
ENV = f"""g AS (SELECT unnest({ENV_STEPS})::BIGINT AS step), l AS (SELECT unnest({ENV_LENGTHS})::BIGINT AS length), ls AS (SELECT id, max(t) AS last FROM z GROUP BY id
), ew AS (SELECT z.id, step, length, least(step, length) AS n, z.t - (step - least(step, length)) AS i, z.z FROM z JOIN ls USING (id), g, l WHERE z.t < step AND z.t >= step - length AND step <= last + 1
), eh AS (SELECT *, CASE WHEN i >= n // 2 THEN 1 ELSE 0 END AS late FROM ew), ed AS (SELECT *, z - avg(z) OVER (PARTITION BY id, step, length, late) AS d, avg(z) OVER (PARTITION BY id, step, length, i // 8) AS bm FROM eh
), ep AS (SELECT *, lag(d) OVER (PARTITION BY id, step, length, late ORDER BY i) AS pd FROM ed), ea AS (SELECT id, step, length, late, any_value(n) AS n, avg(z) AS m, var_pop(z) AS v, CASE WHEN sum(d * d) > 1e-12 THEN sum(d * pd) / sum(d * d) ELSE 0 END AS a FROM ep GROUP BY ALL
), eb AS (SELECT id, step, length, max(abs(bm)) FILTER (i // 8 < n // 8) AS transient, abs(sum(z * (-1 + 2 * i / (n - 1)::DOUBLE))) / any_value(n) AS ramp FROM ed GROUP BY ALL)"""
_envelope = ["edge", "var_env", "acf_env", "transient", "ramp"]
add(
    "window_envelopes", lambda spark, d: rounding(change.envelopes(features.prepared(src.series_q(spark, d)).select("id", "t", "z"), ENV_STEPS, tuple(ENV_LENGTHS)), ["id", "step", "length"], _envelope),
    rounded("SELECT o.id, o.step, o.length, abs(o.m - e.m) AS edge, abs(ln((o.v + 1e-6) / (e.v + 1e-6))) AS var_env, abs(o.a - e.a) AS acf_env, transient, ramp FROM ea o JOIN ea e ON o.id = e.id AND o.step = e.step AND o.length = e.length AND o.late = 1 AND e.late = 0 JOIN eb ON eb.id = o.id AND eb.step = o.step AND eb.length = o.length", "id, step, length", _envelope, f"{CAL}, {ENV}"),
)

# ---- robust windows, constants, the plainest score

ROBUST = f"{CAL}, {KNOTS}, rb AS (SELECT z.*, (x - med) / greatest((knots[1 + least(len(knots) - 1, CAST(floor(0.841 * len(knots)) AS BIGINT))] - knots[1 + CAST(floor(0.159 * len(knots)) AS BIGINT)]) / 2.0::DOUBLE, 1e-9) AS rz FROM z JOIN kn USING (id)), rl AS (SELECT *, " + ", ".join(f"rz * lag(rz, {k}) OVER ({W}) AS l{k}" for k in features.LAGS) + " FROM rb), ha AS (SELECT id, " + ", ".join(f"sum(p{k}) / sum(d * d) AS h{k}" for k in features.LAGS) + " FROM (SELECT id, d, " + ", ".join(f"d * lag(d, {k}) OVER ({W}) AS p{k}" for k in features.LAGS) + " FROM cz) GROUP BY id)"
_with5 = lambda s: features._beside(features.prepared(s), calibration.knots(src.history(s)).join(calibration.autocorrelation(src.history(s), 5).select("id", "acf3_h", "acf4_h", "acf5_h"), "id"))
_xw = [f"xw{w}_{c}" for w in (120, 480) for c in (*(f"acf{k}" for k in features.LAGS), "cumslope")]
_rz_acf = lambda w, k: sql.acf_expr("rz", w, k).replace(f"- {k} > 1 THEN", f"- {k} > 2 THEN")
# a mean over a power of two may lie half way between two roundings; a shift below the last digit settles it alike everywhere
SHIFT = 3.7e-8
series_query(
    "robust_windows", lambda s: features.robust_windows(_with5(s)).withColumns({f"xw{w}_cumslope": F.col(f"xw{w}_cumslope") + SHIFT for w in (120, 480)}), ["id", "t"], [*_xw, "rz"],
    rounded("SELECT id, t, rz, " + ", ".join(f"CASE WHEN least(n, {w}) >= 8 THEN ({_rz_acf(w, k)}) - h{k} ELSE 0 END AS xw{w}_acf{k}" for w in (120, 480) for k in features.LAGS) + ", " + ", ".join(f"{SHIFT}::DOUBLE + CASE WHEN least(n, {w}) >= 8 THEN avg(rz) OVER {sql.win(w)} ELSE 0 END AS xw{w}_cumslope" for w in (120, 480)) + " FROM rl JOIN ha USING (id)", "id, t", [*_xw, "rz"], ROBUST),
)
_const = ["null_smz64", "null_slv64", "null_sacf64", "null_mem_slope", "null_skurt128", "kurt_h"]


def series_constants(s: DataFrame) -> DataFrame:
    hist = src.history(s)
    cal = calibration.full(hist)
    return features.constants(cal.join(features.null_tables(hist, cal, ("moments", "shape_moments")), "id"))


series_query("series_constants", series_constants, ["id"], _const, rounded("SELECT id, null_mz_scale[4] AS null_smz64, null_lv_scale[4] AS null_slv64, null_acf_scale[4] AS null_sacf64, ln(greatest(null_mz_scale[6], 1e-6) / greatest(null_mz_scale[2], 1e-6)) AS null_mem_slope, null_kurt_scale[5] AS null_skurt128, kurt AS kurt_h FROM cal JOIN nm USING (id) JOIN nh USING (id)", "id", _const, f"{CAL}, {sql.HZ}, nm AS ({sql.NULL_MOMENTS}), nh AS ({HNULL})"))
online_query("squashed_ewma", features.squashed_ewma, ["baseline"], "SELECT id, t, tanh(abs(v) / 3.0::DOUBLE) AS baseline FROM ew", f"{CAL}, ew AS ({ewma_sql('z', 0.05, 'z')})")
add("baseline_ts_auc", lambda spark, d: rounding(metric.ts_auc(features.squashed_ewma(features.prepared(src.series_q(spark, d))).select("id", "t", F.round("baseline", 6).alias("score")).join(labelled(spark, d).select("id", "t", F.col("target").alias("y")), ["id", "t"])), ["pairs"], ["ts_auc"], 9), f"WITH {CAL}, ew AS ({ewma_sql('z', 0.05, 'z')}), r AS (SELECT lab.t, target AS y, round(tanh(abs(v) / 3.0::DOUBLE), 6) AS score FROM ew JOIN lab USING (id, t)) " + sql.auc("r"))

# ---- detectors, as published: kernel excess, the two-state filter on innovations

KEX = f"""{CAL}, ka AS (SELECT id, list(z ORDER BY z) AS zs FROM (SELECT id, greatest(-8, least(8, z)) AS z FROM cz) GROUP BY id), kb AS (SELECT id, CASE WHEN len(zs) > 512 THEN list_transform(range(0, 512), lambda k: zs[1 + CAST(floor(k * (len(zs) - 1) / 511.0::DOUBLE) AS BIGINT)]) ELSE zs END AS atoms FROM ka
), kt AS (SELECT id, unnest(atoms) AS a FROM kb), kw AS (SELECT id, count(*) AS m, greatest(0.05, 0.9 * least(stddev_pop(a) + 1e-9, (quantile_cont(a, 0.75) - quantile_cont(a, 0.25)) / 1.34 + 1e-9) * count(*) ** -0.2) AS bw FROM kt GROUP BY id
), kx AS (SELECT id, t, n, greatest(-8, least(8, z)) AS v FROM z UNION ALL SELECT id, -row_number() OVER (PARTITION BY id ORDER BY a), 0, a FROM kt
), kl AS (SELECT id, t, n, mx + ln(sum(exp(g - mx))) - ln(any_value(m) * any_value(bw) * sqrt(2 * pi())) AS l FROM (SELECT *, max(g) OVER (PARTITION BY id, t) AS mx FROM (SELECT kx.id, kx.t, kx.n, -0.5 * ((v - a) / bw) ** 2 AS g, bw, m FROM kx JOIN kt USING (id) JOIN kw USING (id))) GROUP BY id, t, n, mx
), ko AS (SELECT id, avg(l) AS base FROM kl WHERE t < 0 GROUP BY id)"""
_kex = ["kde_excess_cum", "kde_excess_trail"]
series_query("kde_excess", lambda s: detectors.kernel_excess(features.prepared(s), src.history(s)), ["id", "t"], _kex, rounded(f"SELECT id, t, base - avg(l) OVER {CUM} AS kde_excess_cum, base - avg(l) OVER {sql.win(128)} AS kde_excess_trail FROM (SELECT * FROM kl WHERE t >= 0) JOIN ko USING (id)", "id, t", _kex, KEX))
_scatter = "(id * 7919) % 1000003, id"


def measured_atoms(spark: SparkSession, d: str, count: int = 48) -> list[tuple[float, float]]:
    """Breaks measured on the labelled series, ``count`` of them, scattered by id."""
    breaks = _process(spark, d).filter("brk_dmean is not null and brk_lvr is not null")
    rows = breaks.orderBy(F.pmod(F.col("id") * 7919, F.lit(1_000_003)), "id").limit(count).select("brk_dmean", "brk_lvr").collect()  # the mixture's atoms
    return [tuple(r) for r in rows] or [(0.0, 0.0)]


_posts = ["post_003", "post_01", "post_03", "cum_llr"]
FILTER = f"""WITH RECURSIVE {DGP}, atm AS (SELECT brk_dmean AS dm, brk_lvr AS lv FROM dg WHERE brk_dmean IS NOT NULL AND brk_lvr IS NOT NULL QUALIFY row_number() OVER (ORDER BY {_scatter}) <= 48
), ir AS (SELECT id, least(0.95, greatest(-0.95, acf)) AS rho FROM hr), ie AS (SELECT id, c - rho * lag(c) OVER (PARTITION BY id ORDER BY t) AS e FROM hc JOIN ir USING (id)), iscale AS (SELECT id, stddev_pop(e) + 1e-9 AS sc, avg(e) AS me FROM ie WHERE e IS NOT NULL GROUP BY id
), ik AS (SELECT id, any_value(sc) AS sc, avg((e / sc) ** 4) - 3 AS k FROM ie JOIN iscale USING (id) WHERE e IS NOT NULL GROUP BY id), ip AS (SELECT ik.id, sc, rho, CASE WHEN k <= 0.2 THEN 40 ELSE least(40, greatest(4.5, 4 + 6 / k)) END AS df, h.mu, h.last FROM ik JOIN ir USING (id) JOIN (SELECT id, avg(x) AS mu, max_by(x, t) AS last FROM hist GROUP BY id) h USING (id)
), iu AS (SELECT o.id, o.t, ((x - mu) - rho * (coalesce(lag(x) OVER (PARTITION BY o.id ORDER BY o.t), last) - mu)) / sc AS u, rho, df FROM onl o JOIN ip USING (id)
), il AS (SELECT id, t, u, df, lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi()) AS k0, (u - dm * sqrt((1 - rho) / (1 + rho))) / exp(lv / 2) AS uj, lv FROM iu, atm
), ij AS (SELECT id, t, k0 - (df + 1) / 2 * ln(1 + u * u / df) AS f0, k0 - (df + 1) / 2 * ln(1 + uj * uj / df) - lv / 2 AS f1 FROM il
), ig AS MATERIALIZED (SELECT id, t, mx + ln(avg(exp(f1 - mx)) + 1e-300) - any_value(f0) AS l FROM (SELECT *, max(f1) OVER (PARTITION BY id, t) AS mx FROM ij) GROUP BY id, t, mx
), rp AS (SELECT id, CAST(-1 AS BIGINT) AS t, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM (SELECT DISTINCT id FROM ig)
  UNION ALL SELECT ig.id, ig.t, """ + ", ".join(f"(({p} + (1 - {p}) * {h}) * exp(least(50, greatest(-50, l)))) / (({p} + (1 - {p}) * {h}) * exp(least(50, greatest(-50, l))) + (1 - {p}) * (1 - {h}))" for p, h in (("a", 0.003), ("b", 0.01), ("c", 0.03))) + f""" FROM rp JOIN ig ON ig.id = rp.id AND ig.t = rp.t + 1)
SELECT rp.id, rp.t, round(a, 6) AS post_003, round(b, 6) AS post_01, round(c, 6) AS post_03, round(ll, 6) + 0.0::DOUBLE AS cum_llr FROM rp JOIN (SELECT id, t, sum(l) OVER {CUM} AS ll FROM ig) x ON x.id = rp.id AND x.t = rp.t"""
add("innovation_posterior", lambda spark, d: rounding(detectors.innovation_posterior(src.series_q(spark, d), measured_atoms(spark, d)), ["id", "t"], _posts), FILTER)


def _poly(cs: tuple[float, ...], r: str) -> str:
    out = f"{cs[-1]!r}::DOUBLE"
    for c in cs[-2::-1]:
        out = f"({out} * {r} + {c!r}::DOUBLE)"
    return out


_ppf = lambda k, r: f"({_poly(WICHURA[k][0], r)} / {_poly(WICHURA[k][1], r)})"
ORACLES["gauss_rank_per_step"] = f"""WITH {SCORES}, g AS (SELECT id, t, least(greatest((rank() OVER (PARTITION BY t ORDER BY score) + (count(*) OVER (PARTITION BY t, score) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY t) + 1), 1e-12), 1 - 1e-12) AS p FROM sc),
h AS (SELECT *, p - 0.5 AS q, sqrt(-ln(least(p, 1 - p))) AS r FROM g) SELECT id, t, round(CASE WHEN abs(q) <= 0.425 THEN q * {_ppf(0, '(0.180625 - q * q)')} ELSE sign(q) * CASE WHEN r <= 5 THEN {_ppf(1, '(r - 1.6)')} ELSE {_ppf(2, '(r - 5)')} END END, 6) + 0.0::DOUBLE AS gauss FROM h"""
_atoms = ", ".join(f"({d!r}::DOUBLE, {v!r}::DOUBLE)" for d, v in detectors.atoms())
_next = lambda p, h: f"(({p} + (1 - {p}) * {h}) * exp(l)) / (({p} + (1 - {p}) * {h}) * exp(l) + (1 - {p}) * (1 - {h}))"
ORACLES["hmm_posterior"] = f"""WITH RECURSIVE {CAL}, am(dm, lv) AS (VALUES {_atoms}), lr AS MATERIALIZED (SELECT id, t, ln(greatest(avg(exp(-lv / 2 - (z - dm) ** 2 / (2 * exp(lv)) + z * z / 2)), 1e-300)) AS l FROM z, am GROUP BY id, t),
r AS (SELECT id, CAST(-1 AS BIGINT) AS t, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM (SELECT DISTINCT id FROM lr) UNION ALL SELECT lr.id, lr.t, {", ".join(_next(p, h) for p, h in zip("abc", detectors.HAZARDS))} FROM r JOIN lr ON lr.id = r.id AND lr.t = r.t + 1)
SELECT id, t, round((a + b + c) / 3.0::DOUBLE, 6) AS posterior FROM r WHERE t >= 0"""
ORACLES["student_log_density"] = rounded("SELECT id, t, lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * ln(nu * pi()) - ln(s) - (nu + 1) / 2 * ln(1 + (z / s) ** 2 / nu) AS log_t FROM (SELECT *, sqrt((nu - 2) / nu) AS s FROM (SELECT *, least(40, greatest(4.5, 4 + 6 / greatest(kurt, 1e-3))) AS nu FROM z))", "id, t", ["log_t"], CAL)


def _cascade() -> str:
    """The averages' recursion, all six at a step."""
    terms = ["n.z"]
    for j in range(1, 7):
        terms.append(f"(0.5 * r.s{j} + 0.5 * {terms[-1]})")
    return ", ".join(terms[1:])


_bands = [f"wv{w}_band{j}" for w in (120, 480) for j in range(1, 7)] + [f"wv{w}_coarse_z" for w in (120, 480)] + [f"wvc_band{j}" for j in range(1, 7)]
_energy = lambda j, over: f"ln(greatest(avg(d{j} * d{j}) OVER {over}, 1e-12) / e{j})"
ORACLES["wavelet_bands"] = f"""WITH RECURSIVE {SERIES}, wm AS (SELECT id, avg(x) AS mu, greatest(stddev_pop(x), 1e-9) AS sd FROM hist GROUP BY id), wz AS MATERIALIZED (SELECT id, 1 AS part, t, (x - mu) / sd AS z FROM hist JOIN wm USING (id) UNION ALL SELECT id, 2, t, (x - mu) / sd FROM onl JOIN wm USING (id)
), wr AS (SELECT id, part, t, z, {", ".join(f"z AS s{j}" for j in range(1, 7))} FROM wz WHERE t = 0 UNION ALL SELECT n.id, n.part, n.t, n.z, {_cascade()} FROM wr r JOIN wz n ON n.id = r.id AND n.part = r.part AND n.t = r.t + 1
), wd AS (SELECT id, part, t, s6, z - s1 AS d1, {", ".join(f"s{j - 1} - s{j} AS d{j}" for j in range(2, 7))} FROM wr), we AS (SELECT id, avg(s6) AS coarse, {", ".join(f"greatest(avg(d{j} * d{j}), 1e-12) AS e{j}" for j in range(1, 7))} FROM wd WHERE part = 1 AND t >= 8 GROUP BY id)
SELECT id, t, {", ".join(f"round({e}, 6) + 0.0::DOUBLE AS {c}" for c, e in zip(_bands, [_energy(j, sql.win(w)) for w in (120, 480) for j in range(1, 7)] + [f"avg(s6) OVER {sql.win(w)} - coarse" for w in (120, 480)] + [_energy(j, CUM) for j in range(1, 7)]))} FROM (SELECT wd.*, we.* EXCLUDE (id) FROM wd JOIN we USING (id) WHERE part = 2)"""

# ---- pools, blends, gates

POOL = f"{SCORES}, mm AS (SELECT *, " + "0.05::DOUBLE + 0.9::DOUBLE * (s % 1009) / 1009.0::DOUBLE AS a, 0.05::DOUBLE + 0.9::DOUBLE * ((s * 7 + t) % 997) / 997.0::DOUBLE AS b, 0.05::DOUBLE + 0.9::DOUBLE * ((id * 31 + t * 17) % 101) / 101.0::DOUBLE AS c, 0.05::DOUBLE + 0.9::DOUBLE * ((s + id * 3) % 503) / 503.0::DOUBLE AS d, ((s * 3 + id) % 503) / 10.0::DOUBLE AS rk, ((s % 211) / 211.0::DOUBLE - 0.5::DOUBLE) * 4 AS lin, ((s * 5 + t) % 313) / 313.0::DOUBLE - 0.5::DOUBLE AS n1, ((s + t * 11) % 401) / 401.0::DOUBLE - 0.5::DOUBLE AS n2, CASE WHEN (id * 7919 + 1) % 1000 < 500 THEN 'a' ELSE 'b' END AS half FROM (SELECT *, CAST(score AS BIGINT) AS s FROM sc))"
TREES = ["a", "b", "c", "d"]


def pooled(spark: SparkSession, d: str) -> DataFrame:
    """Members made of the events' numbers by fixed rules: four probabilities, a rank score, a linear and two neural logits."""
    s, t, i = F.col("score").cast("long"), F.col("t"), F.col("id")
    p = lambda v, m: F.lit(0.05) + F.lit(0.9) * F.pmod(v, F.lit(m)) / F.lit(float(m))
    return src.scores_e(spark, d).withColumns({
        "a": p(s, 1009), "b": p(s * 7 + t, 997), "c": p(i * 31 + t * 17, 101), "d": p(s + i * 3, 503), "rk": F.pmod(s * 3 + i, F.lit(503)) / F.lit(10.0),
        "lin": (F.pmod(s, F.lit(211)) / F.lit(211.0) - 0.5) * 4, "n1": F.pmod(s * 5 + t, F.lit(313)) / F.lit(313.0) - 0.5, "n2": F.pmod(s + t * 11, F.lit(401)) / F.lit(401.0) - 0.5,
    })


def _logit(m: str) -> str:
    return f"ln({m} / (1 - {m}))"


def _mean(parts: list[str]) -> str:
    return f"(({' + '.join(parts)}) / {float(len(parts))}::DOUBLE)"


def auc_of(source: str, blends: dict[str, str], *by: str) -> str:
    """(k, ts_auc, pairs) of several scores; k joins the values of ``by`` and the blend's name with bars."""
    keys = "".join(f"{b} || '|' || " for b in by)
    return sql.auc("(" + " UNION ALL ".join(f"SELECT {keys}'{n}' AS k, t, y, round({e}, 9) AS score FROM {source}" for n, e in blends.items()) + ")", "k")


def parted(source: str) -> str:
    return f"(SELECT *, 'all' AS part FROM {source} UNION ALL SELECT *, half AS part FROM {source})"


def wide(name: str, auc: str) -> str:
    """(name, auc_all, auc_a, auc_b) of AUCs keyed by part and name."""
    return f"SELECT split_part(k, '|', 2) AS {name}, " + ", ".join(f"max(ts_auc) FILTER (split_part(k, '|', 1) = '{p}') AS auc_{p}" for p in gates.PARTS) + f" FROM ({auc}) GROUP BY 1"


_tree = _mean([_logit(m) for m in TREES])
add("mean_logit_blend", lambda spark, d: rounding(pooled(spark, d).withColumn("blend", 0.8 * gates.mean_logit(TREES) + 0.2 * F.col("lin")), ["id", "t"], ["blend"]), f"WITH {POOL} SELECT id, t, round(0.8 * {_tree} + 0.2 * lin, 6) + 0.0::DOUBLE AS blend FROM mm")


def whole_blend(spark: SparkSession, d: str) -> DataFrame:
    """The constants are measured on every fifth row and applied to all."""
    rows = pooled(spark, d)
    return gates.full_blend(rows, gates.rescale_constants(selection.strided(rows, 5), "rk", TREES), TREES, "rk", "lin", ["n1", "n2"])


FULL = f"{POOL}, rc AS (SELECT avg(rk) AS rk_mu, stddev_pop(rk) + 1e-12 AS rk_sd, avg(l) AS gbt_mu, stddev_pop(l) + 1e-12 AS gbt_sd FROM (SELECT rk, {_tree} AS l, row_number() OVER (ORDER BY id, t) - 1 AS p FROM mm) WHERE p % 5 = 0), fb AS (SELECT mm.*, 0.55 * (0.9 * (0.9 * {_tree} + 0.1 * ((rk - rk_mu) / rk_sd * gbt_sd + gbt_mu)) + 0.1 * lin) + 0.45 * ((n1 + n2) / 2) AS final_logit FROM mm, rc)"
add("full_blend", lambda spark, d: rounding(whole_blend(spark, d), ["id", "t"], ["final_logit", "score"]), f"WITH {FULL} SELECT id, t, round(final_logit, 6) + 0.0::DOUBLE AS final_logit, round(1 / (1 + exp(-final_logit)), 6) AS score FROM fb".replace("mm.*", "id, t"))
add("serving_yield", lambda spark, d: (lambda s: s.select("id", "seq", F.round("score", 6).alias("score")))(gates.served(whole_blend(spark, d))), f"WITH {FULL} SELECT DISTINCT id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS DOUBLE) AS score FROM fb UNION ALL SELECT id, t + 1, round(1 / (1 + exp(-final_logit)), 6) FROM fb".replace("mm.*", "id, t"))
add("held_out_evaluation", lambda spark, d: rounding(gates.evaluated(whole_blend(spark, d).drop("score").filter(gates.held_out()), {"full": F.col("final_logit"), "trees": gates.mean_logit(TREES)}, "blend"), ["blend", "pairs"], ["ts_auc"], 9), f"WITH {FULL.replace('mm.*', 'mm.*')}, ho AS (SELECT * FROM fb WHERE (id * 7919 + 42) % 1000 < 200) SELECT k AS blend, ts_auc, pairs FROM ({auc_of('ho', {'full': 'final_logit', 'trees': _tree})})")
_global = lambda m: f"(rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0::DOUBLE)"
_pools = {m: _logit(m) for m in TREES} | {f"{a}+{b}": _mean([_logit(a), _logit(b)]) for k, a in enumerate(TREES) for b in TREES[k + 1 :]} | {"mean_logit": _tree, "mean_prob": _mean(TREES), "mean_rank": _mean([f"r_{m}" for m in TREES])}
add("pool_evaluation", lambda spark, d: rounding(gates.pool(pooled(spark, d), TREES), ["blend", "pairs"], ["ts_auc"], 9), f"WITH {POOL}, pr AS (SELECT *, " + ", ".join(f"{_global(m)} AS r_{m}" for m in TREES) + f" FROM mm) SELECT k AS blend, ts_auc, pairs FROM ({auc_of('pr', _pools)})")
add("correlation_matrix", lambda spark, d: rounding(selection.correlations(pooled(spark, d), [*TREES, "rk"]), ["a", "b"], ["r"]), f"WITH {POOL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0::DOUBLE AS r FROM mm" for k, a in enumerate([*TREES, "rk"]) for b in [*TREES, "rk"][k:]))


def ordinal_correlation(spark: SparkSession, d: str) -> DataFrame:
    rows = with_ranks(pooled(spark, d), {"ra": "a", "rb": "rk"}, "ordinal", ("id", "t"))
    return rounding(rows.agg(F.corr("ra", "rb").alias("spearman")), [], ["spearman"])


add("spearman_ordinal", ordinal_correlation, f"WITH {POOL} SELECT round(corr(ra, rb), 6) + 0.0::DOUBLE AS spearman FROM (SELECT row_number() OVER (ORDER BY a, id, t) AS ra, row_number() OVER (ORDER BY rk, id, t) AS rb FROM mm)")
GATE = [0.05, 0.1, 0.2, 0.5]
_lifts = ["lift_all", "lift_a", "lift_b", "robust"]
_za = "(final_logit - avg(final_logit) OVER ()) / (stddev_pop(final_logit) OVER () + 1e-12)"
_zc = "(cand - avg(cand) OVER ()) / (stddev_pop(cand) OVER () + 1e-12)"
add(
    "additive_gate", lambda spark, d: gates.additive_gate(whole_blend(spark, d).drop("score").withColumn("cand", F.pmod(F.col("rk") * 10, F.lit(97)) / F.lit(97.0)), "final_logit", "cand", GATE),
    f"WITH {FULL}, gc AS (SELECT *, ((s * 3 + id) % 503 % 97) / 97.0::DOUBLE AS cand FROM fb), gs AS (SELECT CASE WHEN ts_auc < 0.5 THEN -1.0::DOUBLE ELSE 1 END AS sign FROM ({auc_of('gc', {'alone': 'cand'})})), gz AS (SELECT *, {_za} AS zb, sign * {_zc} AS zc FROM gc, gs), gw AS ({wide('w', auc_of(parted('gz'), {str(w): f'zb + {w} * zc' for w in [0.0, *GATE]}, 'part'))}), gl AS (SELECT CAST(x.w AS DOUBLE) AS w, "
    + ", ".join(f"round(x.auc_{p} - o.auc_{p}, 9) AS lift_{p}" for p in gates.PARTS)
    + " FROM gw x, (SELECT * FROM gw WHERE w = '0.0') o WHERE x.w <> '0.0'), gr AS (SELECT *, least(lift_all, lift_a, lift_b) AS robust FROM gl) SELECT *, CASE WHEN (SELECT max(robust) FROM gr) > 0.0005 THEN 'promising' ELSE 'redundant' END AS verdict FROM gr",
)
BUCKETS, BW = [0, 15, 30, 60], [0.0, 0.2, 0.4, 0.6]
_bucket = "CASE WHEN t >= 60 THEN 3 WHEN t >= 30 THEN 2 WHEN t >= 15 THEN 1 ELSE 0 END"
add(
    "bucket_weights", lambda spark, d: rounding(gates.bucket_weights(pooled(spark, d), "a", "n1", BUCKETS, BW, 0.45), ["part"], ["flat_auc", "fitted_auc"], 9),
    f"WITH {POOL}, bu AS (SELECT *, half AS part, {_bucket} AS bucket FROM mm), bg AS ({auc_of('bu', {str(w): f'(1 - {w}) * a + {w} * n1' for w in BW}, 'part', 'bucket')}), bb AS (SELECT CASE split_part(k, '|', 1) WHEN 'a' THEN 'b' ELSE 'a' END AS part, CAST(split_part(k, '|', 2) AS INTEGER) AS bucket, CAST(split_part(k, '|', 3) AS DOUBLE) AS w FROM bg QUALIFY row_number() OVER (PARTITION BY split_part(k, '|', 1), split_part(k, '|', 2) ORDER BY ts_auc DESC, CAST(split_part(k, '|', 3) AS DOUBLE)) = 1), bj AS (SELECT bu.*, coalesce(w, 0.45) AS w FROM bu LEFT JOIN bb USING (part, bucket)), bx AS ({auc_of('bj', {'flat': '(1 - 0.45) * a + 0.45 * n1', 'fitted': '(1 - w) * a + w * n1'}, 'part')}) SELECT split_part(k, '|', 1) AS part, max(ts_auc) FILTER (split_part(k, '|', 2) = 'flat') AS flat_auc, max(ts_auc) FILTER (split_part(k, '|', 2) = 'fitted') AS fitted_auc FROM bx GROUP BY 1",
)
SNAP, LAMBDAS = [10, 20, 40], [0.05, 0.2, 0.5, 1.0]
_snap = ["base_auc", "blend_auc", "lift", "best_weight"]
_dz = lambda c: f"CASE WHEN stddev_pop({c}) OVER (PARTITION BY t) > 1e-12 THEN ({c} - avg({c}) OVER (PARTITION BY t)) / stddev_pop({c}) OVER (PARTITION BY t) ELSE 0 END"
add(
    "snapshot_gate", lambda spark, d: rounding(gates.snapshot_gate(pooled(spark, d), "a", ["b", "c"], SNAP, LAMBDAS), ["detector"], _snap, 8),
    f"WITH {POOL}, sl AS (SELECT id, t, y, a, lag(b) OVER ({W}) AS b, lag(c) OVER ({W}) AS c FROM mm), sz AS (SELECT t, y, a, stddev_pop(a) OVER (PARTITION BY t) AS sa, {_dz('b')} AS zb, {_dz('c')} AS zc FROM sl WHERE t IN (10, 20, 40) AND b IS NOT NULL AND c IS NOT NULL), sg AS (SELECT detector, w, t, y, round(a + w * zd * sa, 9) AS score FROM (SELECT 'b' AS detector, *, zb AS zd FROM sz UNION ALL SELECT 'c', *, zc FROM sz), (SELECT unnest({[0.0, *LAMBDAS]})::DOUBLE AS w)"
    "), sa AS (SELECT detector, w, t, p * m AS weight, (r - p * (p + 1) / 2.0::DOUBLE) / (p * m) AS auc FROM (SELECT detector, w, t, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS m, sum(rk) FILTER (y = 1) AS r FROM (SELECT *, rank() OVER (PARTITION BY detector, w, t ORDER BY score) + (count(*) OVER (PARTITION BY detector, w, t, score) - 1) / 2.0::DOUBLE AS rk FROM sg) GROUP BY ALL) WHERE p > 0 AND m > 0"
    "), st AS (SELECT detector, t, any_value(weight) AS weight, max(round(auc, 9)) FILTER (w = 0) AS base, max(round(auc, 9)) AS top, arg_min(w, -round(auc, 9) * 1e6 + w * 1e-9) AS best FROM sa GROUP BY ALL), sc2 AS (SELECT detector, best, count(*) AS n FROM st GROUP BY ALL), sm AS (SELECT detector, best FROM sc2 QUALIFY row_number() OVER (PARTITION BY detector ORDER BY n DESC, best) = 1) "
    "SELECT detector, round(sum(base * weight) / sum(weight), 8) AS base_auc, round(sum(top * weight) / sum(weight), 8) AS blend_auc, round(sum(top * weight) / sum(weight) - sum(base * weight) / sum(weight), 8) + 0.0::DOUBLE AS lift, round(any_value(sm.best), 8) AS best_weight FROM st JOIN sm USING (detector) GROUP BY detector",
)
_swap = lambda m: f"0.55 * final_logit + 0.45 * {_mean(['n1', m])}"
add("slot_swap", lambda spark, d: gates.slot_swap(whole_blend(spark, d).drop("score"), ["n1", "n2"], 1, "lin", "rk", "final_logit"), f"WITH {FULL} {wide('arm', auc_of(parted('fb'), {'control': _swap('lin'), 'treatment': _swap('rk')}, 'part'))}")

# ---- kinds of breaks

TYPED = f"{CAL}, {DET}, {BS}, tm AS (SELECT dl.id, dl.t, target AS y, score AS m1, round(abs(cum_mean_z), 6) AS m2, round(abs(cum_logvar_ratio), 6) AS m3, CASE WHEN (dl.id * 7919 + 1) % 1000 < 500 THEN 'a' ELSE 'b' END AS half FROM dl JOIN (SELECT id, t, {CUM_COLS['cum_mean_z']} AS cum_mean_z, {CUM_COLS['cum_logvar_ratio']} AS cum_logvar_ratio FROM z) USING (id, t)), tk AS (SELECT id, CASE WHEN n_post < 20 THEN 'short_post' WHEN greatest(m, v, a) < 1 THEN 'subtle' WHEN m >= v AND m >= a THEN 'mean' WHEN v >= a THEN 'var' ELSE 'acf' END AS kind FROM (SELECT id, n_post, abs(dmean) / 0.25 AS m, abs(dlogvar) / 0.30 AS v, abs(dacf) / 0.12 AS a FROM bs)), ty AS (SELECT tm.*, k.kind FROM tm, (SELECT DISTINCT kind FROM tk) k LEFT JOIN tk ON tk.id = tm.id WHERE y = 0 OR k.kind = tk.kind)"
TYPE_MEMBERS = ["m1", "m2", "m3"]


def typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = features.cumulative_moments(features.prepared(src.series_q(spark, d))).select("id", "t", F.round(F.abs("cum_mean_z"), 6).alias("m2"), F.round(F.abs("cum_logvar_ratio"), 6).alias("m3"))
    scores = detector_scores(spark, d).withColumnRenamed("score", "m1").join(labelled(spark, d).select("id", "t", F.col("target").alias("y")), ["id", "t"]).join(rows, ["id", "t"])
    return scores, twosample.type_dominant(stats(spark, d))


add("cohort_auc_by_type", lambda spark, d: rounding(gates.by_type(*typed(spark, d), TYPE_MEMBERS), ["kind", "member", "pairs"], ["ts_auc"], 9), f"WITH {TYPED} SELECT split_part(k, '|', 1) AS kind, split_part(k, '|', 2) AS member, ts_auc, pairs FROM ({auc_of('ty', {m: m for m in TYPE_MEMBERS}, 'kind')})")
_zt = ", ".join(f"({m} - avg({m}) OVER ()) / (stddev_pop({m}) OVER () + 1e-12) AS z{m}" for m in TYPE_MEMBERS)
add("oracle_routing", lambda spark, d: gates.oracle_routing(*typed(spark, d), TYPE_MEMBERS, "m1"), f"WITH {TYPED}, tb AS (SELECT split_part(k, '|', 1) AS kind, split_part(k, '|', 2) AS member FROM ({auc_of('ty', {m: m for m in TYPE_MEMBERS}, 'kind')}) QUALIFY row_number() OVER (PARTITION BY split_part(k, '|', 1) ORDER BY ts_auc DESC, split_part(k, '|', 2)) = 1), tz AS (SELECT tm.*, {_zt} FROM tm), tr AS (SELECT tz.*, member FROM tz LEFT JOIN tk USING (id) LEFT JOIN tb USING (kind)) " + wide("blend", auc_of(parted("tr"), {"default": "zm1", "routed": "CASE WHEN y = 1 AND member = 'm2' THEN zm2 WHEN y = 1 AND member = 'm3' THEN zm3 ELSE zm1 END"}, "part")))

# ---- streams

_scored = f"SELECT id, t, round(1 - exp(-m / sqrt(n)), 6) + 0.0::DOUBLE AS score FROM k05"
add("stream_with_readiness", lambda spark, d: rounding(online.run_available(online.detect(event_stream(spark, d), src.EVENT_HISTORY, announce=True)), ["id", "t"], ["score"]), f"WITH {EVENTS}, {sql.cusum_ctes('z', 0.5, 'k05', 'ez')} {_scored} UNION ALL SELECT id, -1, NULL FROM ev GROUP BY id HAVING count(*) >= 32")
add("stream_trailing_means", lambda spark, d: rounding(online.run_available(online.trailing_means(event_stream(spark, d), 10)), ["id", "t"], ["mean"]), f"WITH {EVENTS} SELECT id, time - 1 AS t, round(avg(x) OVER (PARTITION BY id ORDER BY time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM ev")
add("tumbling_windows", lambda spark, d: online.tumbling(src.scan(spark, d, "events")).select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total")), "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")

# ---- fitted stacks and generated data: rows only, held against their quality in tests

add("stack_logistic", lambda spark, d: gates.stack_two_fold(pooled(spark, d), TREES))
add("stack_trees", lambda spark, d: gates.stack_two_fold(pooled(spark, d), TREES, trees=True))
add("group_ablation", lambda spark, d: gates.ablation(pooled(spark, d), {"trees": TREES, "rank": ["rk"], "neural": ["n1", "n2"]}))


def early_stopped(spark: SparkSession, d: str) -> DataFrame:
    """Half b of the series, by trees that were fitted on three quarters of half a and stopped on the rest."""
    rows = training_rows(spark, d).withColumn("part", gates.half())
    valid = F.pmod(F.col("id"), F.lit(4)) == 0
    own = rows.filter("part = 'a'")
    return models.boosted_until(own.filter(~valid), own.filter(valid), rows.filter("part = 'b'"), FEATURES)[0]


def bank_member(spark: SparkSession, d: str) -> DataFrame:
    """Half b of the series, by trees fitted on half a, over the bank's blocks that need no null table (some sixty columns)."""
    s = src.series_q(spark, d)
    df = features.time_features(features.cumulative_moments(features.prepared(s)))
    for block in (features.tail_excess, features.cusum_bank, features.page_hinkley, features.window_moments, features.prewhitened):
        df = block(df)
    df = features.pit_windows(features.with_pit(df, calibration.knots(src.history(s))))
    columns = [c for c in df.columns if c.startswith(("cum_", "cusum_", "ph_", "w", "pw_", "xw", "xc_", "tail", "below", "log_")) and c != "e"]
    rows = df.select("id", "t", *columns).join(metric.ramp_weight(src.labelled(s)), ["id", "t"]).withColumn("part", gates.half())
    return models.regularised(rows.filter("part = 'a'"), rows.filter("part = 'b'"), columns)


def synthetic_rows(spark: SparkSession, n: int = 40) -> DataFrame:
    s = synthesis.generate(spark, n)
    taus = s.groupBy("id").agg(F.max("tau_index").alias("tau_index"))
    s = s.drop("tau_index").withColumn("t", F.when(F.col("period") == 2, F.col("time") - 201))
    labels = src.online(s).join(taus, "id").withColumn("target", F.coalesce(F.col("t") >= F.col("tau_index"), F.lit(False)).cast("int"))
    rows = features.cusum(features.cumulative_moments(features.prepared(s)), 0.5, "c").select("id", "t", *FEATURES)
    return rows.join(metric.ramp_weight(labels), ["id", "t"])


_synthetic = lambda spark: synthesis.generate(spark, 60).withColumn("t", F.when(F.col("period") == 2, F.col("time") - 201))
add("gbt_early_stopping", early_stopped)
add("bank_member", bank_member)
add("realism_gaps", lambda spark, d: augment.gaps(src.series_q(spark, d), _synthetic(spark)))
add("realism_discriminator", lambda spark, d: augment.discriminator(src.series_q(spark, d), _synthetic(spark)))
add("augmentation", lambda spark, d: augment.augmentation(training_rows(spark, d, store=True), synthetic_rows(spark), FEATURES))
