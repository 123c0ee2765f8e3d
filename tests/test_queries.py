"""Registered queries against their SQL at the smallest scale, and plans that must stay distributed."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import check

QUICK = (
    "hourly_load", "allocated_readings", "first_reading_per_code", "filled_series", "calendar_features", "clean_observations",
    "html_cells", "day_rollover", "climate_join", "window_arrays", "gathered_windows", "autocorr_lags", "autocorr_minutes", "top_lags",
    "forecast_errors", "train_errors", "forecast_ar", "batch_errors", "evaluated_batches", "window_marks", "pca_profiles", "forecast_meters",
)


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_matches_sql(spark, sf, duck, name):
    left, right = entry.queries()[name](spark, sf).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(left.columns) == sorted(right.columns)
    assert check.rows_of(left) == check.rows_of(right)


def test_entry_gives_the_error_row(spark):
    assert entry.entry(spark).columns == ["mape", "rmse", "nmae", "nrmse"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["hourly_load", "filled_series", "day_rollover", "window_arrays", "allocated_readings", "day_lags", "trend_seasonal"])
def test_plans_stay_in_the_engine(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    for unwanted in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval"):
        assert unwanted not in plan
    assert "ReadSchema" in plan and "props" not in plan


def test_totals_add_up_before_the_shuffle(spark, sf):
    plan = plan_of(entry.queries()["hourly_load"](spark, sf))
    assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning")
