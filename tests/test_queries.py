"""Every query with a DuckDB text gives DuckDB's rows."""

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(repr, df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", OWN)
def test_oracle(spark, duck, name):
    assert rows(entry.queries()[name](spark, D).toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"))
def test_runs(spark, name):
    assert entry.queries()[name](spark, D).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_only_one_exchange_between_scan_and_windows(spark):
    """Calibration and windows share the series' partitioning: no more shuffles than scans and one join side each."""
    plan = entry.queries()["cusum_bank"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4


def test_scans_take_the_maximum_over_every_window(spark):
    from driftline.operators.features import WINDOWS

    get = lambda n: entry.queries()[n](spark, D).toPandas().set_index(["id", "t"]).sort_index()
    windows, scans = get("calibrated_windows"), get("scan_max")
    for s in ("nmz", "nlv", "nacf", "nks", "nl1"):
        each = windows[[f"w{w}_{s}" for w in WINDOWS]]
        most = (each if s in ("nks", "nl1") else each.abs()).max(axis=1).clip(lower=0)
        narrow = (each if s in ("nks", "nl1") else each.abs())[[f"w25_{s}", f"w100_{s}"]].max(axis=1).clip(lower=0)
        assert (most - scans[f"scan_{s}"]).abs().max() < 1e-5 and (scans[f"scan_{s}"] > narrow + 1e-5).any()


@pytest.mark.parametrize("name, widths", [("calibrated_windows", (25, 50, 100, 200, 400)), ("hm_skew_kurt", (100, 200, 400, 800)), ("pit_knots_windows", (120, 480)), ("multilag_acf", (120, 480)), ("matched_filters", (20, 40, 80, 160))])
def test_window_queries_have_every_window(spark, name, widths):
    columns = entry.queries()[name](spark, D).columns
    assert all(any(f"{w}_" in c + "_" for c in columns) for w in widths)


def test_the_bank_holds_the_blocks_columns(spark):
    """The bank's columns are those of the queries that DuckDB checks, block by block."""
    get = lambda n: entry.queries()[n](spark, D).toPandas().set_index(["id", "t"]).sort_index()
    bank = get("feature_bank")
    assert len(bank.columns) > 180 and not bank.isna().any().any()
    for name, digits in (("cum_moments", 5), ("cusum_bank", 5), ("calibrated_windows", 5), ("scan_running_max", 5), ("prewhitened_bank", 5), ("hm_skew_kurt", 4), ("derived_dz", 5), ("robust_windows", 5), ("turning_difference", 5), ("squashed_ewma", 5), ("pit_knots_windows", 4)):
        block = get(name)
        own = [c for c in block.columns if c in bank.columns]
        assert own and (bank[own] - block[own]).abs().max().max() < 10.0**-digits, name
