"""Files, caches, models and streams that no registered query covers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import features, gates, metric, models, ranks, selection
from driftline.sources import series as src
from driftline.sources import store
from driftline.streaming import online

D = "/root/testdata/sf0.001"


def test_index_and_targets(spark, tmp_path):
    pd.DataFrame({"id": [1, 2, 3], "tau_index": [5, -1, 0]}).to_parquet(tmp_path / "y_train_index.parquet")
    pd.DataFrame({"id": [1, 1, 2], "time": [100, 101, 50], "target": [0, 1, 0]}).to_parquet(tmp_path / "y_train.parquet")
    assert {(r.id, r.tau_index) for r in store.load_index(spark, str(tmp_path), "train").collect()} == {(1, 5), (2, None), (3, 0)}
    assert {tuple(r) for r in store.load_targets(spark, str(tmp_path), "train").collect()} == {(1, 0, 0), (1, 1, 1), (2, 0, 0)}


def test_series_of_an_iterable(spark):
    rows = store.from_datasets(spark, [(7, [1.0, 2.0], [3.0], -1), (8, [], [4.0, 5.0])]).collect()
    assert {tuple(r) for r in rows} == {(7, 1, 1.0, 1, None), (7, 2, 2.0, 1, None), (7, 3, 3.0, 2, 0), (8, 1, 4.0, 2, 0), (8, 2, 5.0, 2, 1)}


def test_logit_cache(spark, tmp_path):
    a = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.25)], "id long, t long, logit double")
    store.append_logits(a, str(tmp_path), "gbt")
    store.append_logits(a.limit(1), str(tmp_path), "gru")
    store.append_logits(a.withColumn("logit", F.col("logit") * 2), str(tmp_path), "gbt")
    got = {(r.t, r.gbt, r.gru) for r in store.read_logits(spark, str(tmp_path), ["gbt", "gru"]).collect()}
    assert got == {(0, 1.0, 0.5), (1, 0.5, None)}


def test_report_and_model_and_weights(spark, tmp_path):
    src.write_report(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).collect()[0].asDict() == {"a": "1", "b": "x"}
    rows = spark.createDataFrame([(i, 0, float(i % 7), float(i % 3), int(i % 7 > 3), 1.0) for i in range(200)], "id long, t long, a double, b double, target int, weight double")
    from pyspark.ml.classification import RandomForestClassifier

    model = RandomForestClassifier(labelCol="target", numTrees=3, seed=1).fit(models.assembled(rows, ["a", "b"]))
    assert models.top_columns(model, ["a", "b"], 1) == ["a"]
    store.save_model(model, str(tmp_path / "m"), {"columns": ["a", "b"]})
    again, meta = store.load_model(spark, str(tmp_path / "m"))
    assert meta["columns"] == ["a", "b"] and again.toDebugString == model.toDebugString
    w = {"Wih": np.arange(6.0).reshape(2, 3), "b": np.array([1, 2])}
    store.write_weights(spark, str(tmp_path / "w"), "gru", w)
    got = store.read_weights(spark, str(tmp_path / "w"), "gru")
    assert all((got[k] == w[k]).all() for k in w) and store.row_groups(f"{D}/lineitem.parquet")["columns"] == 11


def test_lookup_of_a_missing_row_is_an_error(spark):
    table = spark.createDataFrame([(1, 0, 2.0)], "id long, t long, x double")
    keys = spark.createDataFrame([(1, 0), (1, 9)], "id long, t long")
    with pytest.raises(KeyError, match="9"):
        selection.lookup(keys, table, ["id", "t"])
    assert selection.lookup(keys.filter("t = 0"), table, ["id", "t"]).collect()[0].x == 2.0


def test_series_without_history_are_scored(spark):
    rows = [(1, k + 1, float(k % 5), 1 if k < 40 else 2, k - 40 if k >= 40 else None) for k in range(60)] + [(2, k + 1, float(k), 2, k) for k in range(3)]
    series = spark.createDataFrame(rows, "id long, time long, x double, period int, t long")
    out = features.cusum_bank(features.cumulative_moments(features.time_features(features.prepared(series)))).filter("id = 2").orderBy("t").toPandas()
    assert out.z.tolist() == [0.0, 1.0, 2.0] and out.cum_mean_dev.tolist() == [0.0, 0.5, 1.0] and out.t_over_nhist.tolist() == [0.0] * 3 and out.log_n_hist.tolist() == [0.0] * 3
    hist = src.history(series)
    from driftline.operators import calibration

    cal = calibration.full(hist)
    calm = features.calibrated_windows(features.prepared(series, cal), features.null_moments(hist, cal).join(features.null_shape(hist, cal), "id"))
    assert calm.filter("id = 2").count() == 3 and calm.filter("id = 2 and w25_nmz is null").count() == 0
    assert features.pit_windows(features.with_pit(features.prepared(series, cal), calibration.knots(hist))).filter("id = 2 and p is not null").count() == 3


def test_two_level_ranks(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SAMPLE", 1)
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=600), 1)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(600) % 40, "t": np.arange(600) // 40, "score": x}))
    got = ranks.with_rank(df, "score", "r").toPandas()
    assert (got.r.values == got.score.rank().values).all()
    got = ranks.with_rank(df, "score", "r", "ordinal", ("id", "t")).toPandas().sort_values("r")
    assert got.r.tolist() == list(range(1, 601)) and got.equals(got.sort_values(["score", "id", "t"]))


@pytest.mark.parametrize("sample", [1, 64])
def test_step_auc_by_cells_equals_pairs(spark, monkeypatch, sample):
    monkeypatch.setattr(ranks, "SAMPLE", sample)
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"id": np.arange(900) % 90, "t": np.arange(900) // 90, "score": np.round(rng.normal(size=900), 1), "y": rng.integers(0, 2, 900)})
    got = metric.step_auc(spark.createDataFrame(rows)).toPandas().set_index("t")
    for t, g in rows.groupby("t"):
        p, n = g.score[g.y == 1].values[:, None], g.score[g.y == 0].values[None]
        assert np.isclose(got.auc[t], ((p > n) + 0.5 * (p == n)).mean(), atol=1e-12) and got.n_pos[t] == len(p)


def test_steps_are_ranked_in_cells(spark):
    plan = metric.step_auc(src.scores_e(spark, D))._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(t" in plan and all("_cell" in part.split("]")[0] for part in plan.split("rank(score")[1:2])


def test_stacks_keep_halves_apart(spark):
    rng = np.random.default_rng(6)
    n = 800
    y = rng.integers(0, 2, n)
    rows = pd.DataFrame({"id": np.arange(n) % 100, "t": np.arange(n) // 100, "y": y, "a": np.clip(0.5 + 0.2 * (y - 0.5) + 0.2 * rng.normal(size=n), 0.01, 0.99), "b": rng.uniform(0.1, 0.9, n)})
    df = spark.createDataFrame(rows)
    for trees in (False, True):
        out = gates.stack_two_fold(df, ["a", "b"], trees).toPandas()
        assert len(out) == n and out.groupby("id").part.nunique().max() == 1
        pos, neg = out.stacked[out.y == 1].values[:, None], out.stacked[out.y == 0].values[None]
        assert (pos > neg).mean() > 0.6
    auc = {r.dropped: r.ts_auc for r in gates.ablation(df, {"good": ["a"], "noise": ["b"]}).collect()}
    assert auc["good"] < 0.58 < 0.62 < auc["noise"]


def test_replayed_stream_gives_the_same_scores(spark):
    from driftline.plans.catalog import event_stream

    runs = [online.run_available(online.detect(event_stream(spark, D))).toPandas().sort_values(["id", "t"]).reset_index(drop=True) for _ in range(2)]
    assert runs[0].equals(runs[1])
    batch = online.detect_batch(src.series_e(spark, D)).toPandas().sort_values(["id", "t"]).reset_index(drop=True)
    assert np.abs(batch.score - runs[0].score).max() < 1e-8


def test_scalars_against_the_standard_library(spark):
    import math
    from statistics import NormalDist

    from driftline.functions import scalars

    x = [0.5, 0.75, 1.0, 2.25, 3.5, 20.5, 171.0, 1000.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", scalars.lgamma("x").alias("g")).collect()
    assert all(math.isclose(r.g, math.lgamma(r.x), rel_tol=1e-12, abs_tol=1e-12) for r in got)
    p = [1e-15, 1e-12, 1e-9, 1e-4, 0.02, 0.074, 0.076, 0.3, 0.5, 0.6, 0.95, 0.9999, 1 - 1e-9, 1.0]
    got = spark.createDataFrame([(v,) for v in p], "p double").select("p", scalars.normal_quantile(F.col("p")).alias("q")).collect()
    assert all(math.isclose(r.q, NormalDist().inv_cdf(min(max(r.p, 1e-12), 1 - 1e-12)), rel_tol=1e-12, abs_tol=1e-12) for r in got)
    v = [-3.0, -0.5, 0.0, 0.1, 2.0]
    got = spark.createDataFrame([(a,) for a in v], "v double").select("v", scalars.gelu(F.col("v")).alias("g"), scalars.softplus(F.col("v")).alias("s")).collect()
    assert all(math.isclose(r.g, r.v * 0.5 * (1 + math.erf(r.v / math.sqrt(2))), abs_tol=1e-12) and math.isclose(r.s, math.log1p(math.exp(r.v)), abs_tol=1e-12) for r in got)
