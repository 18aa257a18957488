"""Ingestion helpers: projected CSV load with time parsing, table-or-file
fallback, catalog table picking."""

import os
import tempfile

import pytest

from skupulse.sources import loaders


def _csv(rows):
    d = tempfile.mkdtemp(prefix="skupulse-csv-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("\n".join(rows) + "\n")
    return p


def test_load_table_projects_and_parses_time(spark):
    p = _csv([" user_ID ,request_time,extra", "u1,2018-03-01 10:00:00,x", "u2,not a time,y"])
    df = loaders.load_table(spark, p, ["user_ID", "request_time"], ["request_time"], view="clicks_csv")
    rows = {r.user_ID: r for r in df.collect()}
    assert set(df.columns) == {"user_ID", "request_time", "request_time_raw"}
    assert rows["u2"].request_time is None and rows["u2"].request_time_raw == "not a time"
    assert spark.table("clicks_csv").count() == 2


def test_load_orders_falls_back_to_file(spark):
    p = _csv(["sku_ID,order_date", "a,2018-03-01"])
    spark.createDataFrame([("a",)], "sku_ID string").createOrReplaceTempView("orders_partial")
    df, src = loaders.load_orders(spark, "orders_partial", p, ["sku_ID", "order_date"])
    assert src.startswith("file:") and df.count() == 1
    with pytest.raises(ValueError):
        loaders.load_orders(spark, "no_such_table", p, ["sku_ID", "quantity"])


def test_pick_table_scores_name_and_column(spark):
    spark.createDataFrame([(1, "r")], "user_ID int, province string").createOrReplaceTempView("user_profile")
    t, col = loaders.pick_table(spark, ["user"], loaders.REGION_COLUMN_CANDIDATES)
    assert (t, col) == ("user_profile", "province")


def test_load_logical_coerces_and_rejects(spark):
    p = _csv([" user_ID ,sku_ID,request_time,channel,extra", "u1,7,2018-03-01 10:00:00,app,x", "u2,x,2018-03-01 11:00:00,,y",
              "u3,7,not a time,app,", "u4,7,,app,", "u5,8"])
    rows, report = loaders.load_logical(spark, p, "clicks")
    assert rows.columns == ["user_ID", "sku_ID", "request_time", "channel"]
    assert {r.user_ID: r.sku_ID for r in rows.collect()} == {"u1": 7, "u2": None}
    assert tuple(report.first()) == ("clicks", 5, 3, 1)


def test_wrong_span_and_mismatch_raise(spark):
    import datetime as dt

    from skupulse.operators import candidates as cd
    d = dt.date(2018, 3, 1)
    df = spark.createDataFrame([(d,), (d + dt.timedelta(days=2),)], "day date")
    assert cd.require_spans({"t": (df, "day", d, d + dt.timedelta(days=2))}).count() == 1
    with pytest.raises(ValueError, match="span"):
        cd.require_spans({"t": (df, "day", d, d + dt.timedelta(days=3))})
    with pytest.raises(ValueError, match="missing required"):
        cd.require_columns(df, ["day", "hour"])
    actual = spark.createDataFrame([(d, 1, 0, 5.0), (d, 2, 0, 1.0)], "date date, warehouse int, sku_cluster_ID int, demand double")
    file = "date double, cluster_id int, warehouse_id int, actual_demand double, predicted_demand double"
    good = spark.createDataFrame([(43160.0, 0, 1, 5.0, -2.0), (43160.0, 0, 1, 5.0, 3.0)], file)   # day numbers, repeated key
    rows, found = cd.align_with_diagnostics(good, actual, "a-b c")
    assert sorted((r.warehouse, r.predicted_demand) for r in rows.collect()) == [(1, 0.0), (2, 0.0)]
    assert (found["source_rows"], found["aligned_rows"], found["filled_rows"]) == (2, 2, 1)
    with pytest.raises(ValueError, match="differs"):
        cd.align_candidate(spark.createDataFrame([(43160.0, 0, 1, 4.0, 2.0)], file), actual, "x")
