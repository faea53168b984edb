"""Members read rows that were made once: no fit and no fold goes back to the series."""

import pytest

from driftline.operators import augment, models
from driftline.plans import catalog, families  # noqa: F401  families adds to the catalogue

D = "/root/testdata/sf0.001"


def sources(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["gbt_member", "logistic_member", "forest_member", "pairwise_member"])
def test_members_fit_on_stored_rows(spark, monkeypatch, name):
    plans = []

    def seen(fit):
        def run(train, rows, columns):
            plans.extend((sources(train), sources(rows)))
            return rows.selectExpr("id", "t", "0.5D AS p")

        return run

    real = models.out_of_fold
    monkeypatch.setattr(models, "out_of_fold", lambda fit, rows, columns: real(seen(fit), rows, columns))
    got = catalog.QUERIES[name](spark, D)
    assert len(plans) == 10 and not any("lineitem" in p or "Exchange" in p or "Window" in p for p in plans)
    want = catalog.training_rows(spark, D)
    assert got.count() == want.count() and got.select("id", "t").exceptAll(want.select("id", "t")).isEmpty()


def test_augmentation_reads_stored_rows(spark, monkeypatch):
    plans, real = [], augment.logistic

    def seen(train, rows, *more, **named):
        plans.extend((sources(train), sources(rows)))
        return real(train, rows, *more, **named)

    monkeypatch.setattr(augment, "logistic", seen)
    got = {r["share"]: r["pairs"] for r in catalog.QUERIES["augmentation"](spark, D).collect()}
    assert len(got) == 2 and len(plans) == 4 and not any("lineitem" in p or "Exchange" in p or "Window" in p for p in plans)


def test_training_rows_join_nothing_for_their_labels(spark):
    """Targets and weights are those of the labels' own query, though they aren't joined."""
    from driftline.operators import metric
    from driftline.sources import series as src

    labels = metric.ramp_weight(src.labelled(src.series_q(spark, D))).orderBy("id", "t").collect()
    rows = catalog.training_rows(spark, D)
    assert rows.select("id", "t", "target", "weight").orderBy("id", "t").collect() == labels
    assert sources(rows).count("Join") <= 1
