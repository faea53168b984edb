"""The bank in NumPy: one exchange, any slices and blocks, missing values as in SQL."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from driftline.operators import blocks, calibration, features
from driftline.plans.bank import feature_bank
from driftline.sources import series as src


def rows(specs, seed=3, missing=0.0):
    """Series (history, online) of whole numbers, as rows in order."""
    rng = np.random.default_rng(seed)
    out = []
    for i, (h, o) in enumerate(specs):
        x = rng.integers(1, 51, h + o).astype(float)
        x[h + 3 :][rng.random(max(o - 3, 0)) < missing] = np.nan
        time = np.arange(h + o) + 1
        out.append(pd.DataFrame({"id": i, "time": time, "x": x, "period": np.where(time > h, 2, 1), "t": np.where(time > h, time - h - 1, time - 1)}))
    return pd.concat(out, ignore_index=True)


def bank(df, size=100):
    table = pa.table({c: pa.array(df[c].to_numpy()) for c in ("id", "period", "t", "x")})
    found = pa.Table.from_batches(list(blocks.bank(iter(table.to_batches(max_chunksize=size)), blocks.WINDOWS, blocks.columns())))
    return found.to_pandas().set_index(["id", "t"]).sort_index()


def test_the_bank_is_one_exchange_and_no_generated_code(spark):
    """As column expressions the bank had dozens of windows and exchanges, and took about a minute to compile over any table."""
    import __spark_entry__ as entry

    plan = entry.queries()["feature_bank"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1 and plan.count("Window [") <= 2


@pytest.mark.parametrize("missing", [0.0, 0.1])
def test_slices_of_a_long_series_are_the_whole(monkeypatch, missing):
    df = rows([(100, 2600), (100, 40), (0, 900), (70, 1100)], missing=missing)
    whole = bank(df)
    for name, size in (("BLOCK", 256), ("STEPS", 100), ("BLOCK", 801)):
        monkeypatch.setattr(blocks, name, size)
        cut = bank(df, 33)
        assert cut.index.equals(whole.index) and np.allclose(cut, whole, rtol=1e-9, atol=1e-9)


def test_a_series_does_not_depend_on_its_block():
    df = rows([(64, 30), (64, 200), (64, 1), (9, 50), (64, 0), (0, 20), (9, 7)])
    together = bank(df)
    alone = pd.concat([bank(df[df.id == i]) for i in df.id.unique() if (df[df.id == i].period == 2).any()])
    assert len(together) == (df.period == 2).sum() and together.index.equals(alone.index)
    assert np.allclose(together, alone, rtol=1e-12, atol=1e-12)


def test_waiting_series_leave_in_time(monkeypatch):
    df = rows([(h, 20) for h in range(60)])
    whole = bank(df)
    monkeypatch.setattr(blocks, "WAITING", 90)
    assert bank(df, 17).equals(whole)


def test_calibration_is_that_of_the_column_expressions(spark):
    df = rows([(n, 1) for n in (1, 2, 3, 7, 8, 63, 64, 300)])
    hist = spark.createDataFrame(df[df.period == 1][["id", "t", "x"]])
    cal = calibration.full(hist)
    kinds = ("moments", "shape", "shape_moments", "a", "d", "xs")
    want = cal.drop("acf1_h", "acf2_h").join(calibration.autocorrelation(hist, 5), "id").join(calibration.crossing_rate(hist, cal), "id").join(calibration.turning_rate(hist), "id").join(calibration.long_run_variance(hist, cal), "id").join(calibration.knots(hist), "id").join(features.null_tables(hist, cal, kinds), "id")
    for row in want.collect():
        got = blocks.calibration(df[(df.id == row["id"]) & (df.period == 1)].x.to_numpy()[None])
        for c in set(want.columns) - {"id"}:
            assert np.allclose(got[c][0], row[c], rtol=1e-9, atol=1e-9), (row["id"], c)


def test_missing_values_add_nothing(spark):
    """As in SQL, whose sums skip nulls."""
    df = rows([(90, 300), (40, 120)], missing=0.1)
    table = spark.createDataFrame(df.assign(x=df.x.astype(object).where(df.x.notna(), None)), "id long, time long, x double, period int, t long")
    want = features.cusum_bank(features.cumulative_acf(features.cumulative_moments(features.prepared(table))))
    want = want.toPandas().set_index(["id", "t"]).sort_index()
    got = feature_bank(table).toPandas().set_index(["id", "t"]).sort_index()
    for c in ("cum_mean_z", "cum_kurt", "online_acf2", "cusum_absmax_k05", "cusum_absmax_k10_n"):
        assert np.allclose(got[c], want[c], rtol=1e-9, atol=1e-9), c


def test_numbered_series_keep_their_partitioning(spark):
    """A grouping by id after the numbering is no second exchange."""
    series = src.series_q(spark, "/root/testdata/sf0.001")
    plan = series.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
