"""Small helpers: spreadsheet serial dates (C21), required columns (S4), tokens (C17)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skupulse.operators import candidates as cd


def test_excel_serial_dates_all_numeric(spark):
    df = spark.createDataFrame([("43160",), ("43161",)], "date string")
    got = sorted(r.date for r in cd.excel_serial_dates(df, "date").collect())
    assert got == [dt.date(2018, 3, 1), dt.date(2018, 3, 2)]


def test_excel_serial_dates_mixed_values_parse_as_dates(spark):
    df = spark.createDataFrame([("2018-03-01",), ("43161",)], "date string")
    got = [r.date for r in cd.excel_serial_dates(df, "date").orderBy("date").collect()]
    assert dt.date(2018, 3, 1) in got and None in got


def test_require_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert cd.require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match="missing required columns"):
        cd.require_columns(df, ["a", "b"], "orders")


def test_token(spark):
    df = spark.createDataFrame([("Lag-1 Baseline Model",)], "s string")
    assert df.select(cd.token(F.col("s")).alias("t")).collect()[0].t == "lag_1_baseline_model"
