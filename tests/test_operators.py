"""Per-operator tests on small hand frames (nulls, ties, one-row groups)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skupulse.functions.exprs import clean_orders, round_stable
from skupulse.operators import clicks as ck
from skupulse.operators import forecast as fc
from skupulse.operators import panel
from skupulse.operators.grid import densify, dim_product
from skupulse.operators.ordered import ecdf, histogram

D = dt.date


def test_densify_counts_and_sums(spark):
    facts = spark.createDataFrame(
        [(D(2018, 3, 1), 1, 0, 2.0), (D(2018, 3, 1), 1, 0, 3.0), (D(2018, 3, 3), 2, 1, 4.0)],
        "order_date date, dc_des int, sku_cluster_ID int, demand double")
    keys = dim_product([facts.select("dc_des").distinct(), facts.select("sku_cluster_ID").distinct()])
    g = densify(facts, keys, "order_date", D(2018, 3, 1), D(2018, 3, 3), ["demand"], ["dc_des", "sku_cluster_ID"])
    rows = g.collect()
    assert len(rows) == 3 * 2 * 2  # days x warehouses x clusters
    assert sum(r.demand for r in rows) == 9.0
    cell = [r for r in rows if r.order_date == D(2018, 3, 1) and r.dc_des == 1 and r.sku_cluster_ID == 0]
    assert cell[0].demand == 5.0


def test_series_metrics_flat_series_zero_filled(spark):
    grid = spark.createDataFrame([(0, 1, 0.0), (0, 1, 0.0), (1, 1, 5.0)],
                                 "sku_cluster_ID int, dc_des int, demand double")
    m = {(r.sku_cluster_ID): r for r in panel.series_metrics(grid).collect()}
    assert m[0].std_demand == 0.0 and m[0].cv == 0.0 and m[0].high_sparsity == 1 and m[0].low_variance == 1
    # one-row series: sample std is null -> 0 in the warehouse variant
    assert m[1].std_demand == 0.0 and m[1].zero_rate == 0.0
    r = {(r.sku_cluster_ID): r for r in panel.series_metrics(grid, zero_fill=False).collect()}
    assert r[1].std_demand is None and r[0].cv is None  # region variant keeps null (T6)


def test_clean_orders_gift_and_promo_flags(spark):
    df = spark.createDataFrame(
        [("2018-03-01", "1", "0", 0.0, "0"), ("2018-03-01", "2", "x", 0.0, None), ("bad", "3", "1", 1.0, "")],
        "order_date string, sku_ID string, quantity string, direct_discount_per_unit double, gift_item string")
    df = df.withColumns({c: F.lit(0.0) for c in ["final_unit_price", "original_unit_price",
                                                 "quantity_discount_per_unit", "bundle_discount_per_unit",
                                                 "coupon_discount_per_unit"]})
    out = {r.sku_ID: r for r in clean_orders(df).collect()}
    assert set(out) == {"1", "2"}  # invalid date dropped (C1)
    assert out["1"].promo_line_flag == 1  # text '0' counts as a gift in C6 (T7)
    assert out["2"].quantity == 0.0 and out["2"].gift_item == "" and out["2"].promo_line_flag == 0


def test_top1_tie_breaks_on_smaller_value(spark):
    base = spark.createDataFrame([("u", "b"), ("u", "a"), ("u", "b"), ("u", "a"), ("v", "z")], "user_id string, v string")
    out = {r.user_id: (r.top, r.top_cnt) for r in ck.top1(base, "user_id", "v", "top").collect()}
    assert out == {"u": ("a", 2), "v": ("z", 1)}


def test_click_to_order_strict_before(spark):
    t0 = dt.datetime(2024, 1, 2, 12)
    orders = spark.createDataFrame([("1", 5, t0)], "user_ID string, sku_ID long, order_time timestamp_ntz")
    clicks = spark.createDataFrame([("1", 5, t0 - dt.timedelta(days=1)), ("1", 5, t0), ("1", 5, t0 + dt.timedelta(hours=1))],
                                   "user_ID string, sku_ID long, request_time timestamp_ntz")
    r = ck.click_to_order(ck.first_orders(orders), clicks).collect()[0]
    assert r.clicks_before_order == 1  # equal time is not before (T15)
    assert abs(r.days_between - 1.0) < 1e-12


def test_ecdf_matches_brute_force(spark):
    vals = [3.0, 1.0, 2.0, 2.0, 5.0, 5.0, 5.0, -1.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r.x: r.ecdf for r in ecdf(df, "x", buckets=3).collect()}
    for v in set(vals):
        assert got[v] == pytest.approx(sum(1 for w in vals if w <= v) / len(vals))


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (10.0,)], "x double")
    rows = sorted(histogram(df, "x", 5).collect())
    assert len(rows) == 5 and sum(r["count"] for r in rows) == 4
    assert rows[-1]["count"] == 1 and rows[0]["count"] == 2


def test_split_requires_enough_dates(spark):
    df = spark.createDataFrame([(D(2018, 3, d),) for d in range(1, 10)], "order_date date")
    with pytest.raises(ValueError):
        panel.split_by_distinct_dates(df, 24, 7)
    split, train, test = panel.split_by_distinct_dates(df, 5, 3)
    s = {r.order_date.day: r.split for r in split.collect()}
    assert [s[d] for d in range(1, 10)] == ["train"] * 5 + ["unused"] + ["test"] * 3


def test_rule_forecast_fallback_chain(spark):
    df = spark.createDataFrame([(D(2018, 3, 25), 1, None, None, None), (D(2018, 3, 26), 1, 4.0, None, None),
                                (D(2018, 3, 27), 1, 4.0, 2.0, None)],
                               "date date, k int, lag_1 double, rolling_mean_3 double, rolling_mean_7 double")
    out = fc.rule_forecasts(df, ["k"], D(2018, 3, 25), D(2018, 3, 27))
    got = {(r.date.day, r.model_name): r.predicted_demand for r in out.collect()}
    assert got[(25, "moving_average_7")] == 0.0
    assert got[(26, "moving_average_3")] == 4.0
    assert got[(27, "moving_average_7")] == 2.0
    assert got[(27, "blend_50_50")] == 0.5 * 4.0 + 0.5 * 2.0


def test_allocation_shares_normalise(spark):
    train = spark.createDataFrame(
        [(D(2018, 3, 5), 1, 0, 3.0), (D(2018, 3, 5), 2, 0, 1.0), (D(2018, 3, 6), 1, 0, 0.0), (D(2018, 3, 6), 2, 0, 0.0)],
        "date date, warehouse int, sku_cluster_ID int, demand double")
    shares = fc.allocation_shares(train)
    cpred = spark.createDataFrame([(D(2018, 3, 12), 0, "m", 8.0), (D(2018, 3, 13), 0, "m", 8.0)],
                                  "date date, sku_cluster_ID int, model_name string, predicted_demand double")
    wh = train.select("warehouse").distinct()
    cl = train.select("sku_cluster_ID").distinct()
    out = fc.allocate(cpred, shares, wh, cl).collect()
    mon = {r.warehouse: r.predicted_demand for r in out if r.date.day == 12}  # Monday: observed shares
    assert mon == {1: 6.0, 2: 2.0}
    tue = {r.warehouse: r.predicted_demand for r in out if r.date.day == 13}  # no positive Tuesday -> equal
    assert tue == {1: 4.0, 2: 4.0}


def test_lag1_equals_previous_row(spark):
    tr = spark.createDataFrame([(D(1998, 3, d), 1, 0, float(d)) for d in range(1, 25)],
                               "date date, warehouse int, sku_cluster_ID int, demand double")
    te = spark.createDataFrame([(D(1998, 3, d), 1, 0, float(d)) for d in range(25, 32)],
                               "date date, warehouse int, sku_cluster_ID int, demand double")
    out = {r.date.day: r.predicted_demand for r in fc.lag1_baseline(tr, te).collect()}
    assert out == {d: float(d - 1) for d in range(25, 32)}


def test_round_stable_removes_float_noise(spark):
    df = spark.createDataFrame([(12.8921875 - 1e-13,), (12.8921875 + 1e-13,)], "x double")
    vals = {r.y for r in df.select(round_stable(F.col("x")).alias("y")).collect()}
    assert vals == {12.892188}


def test_hot_pair_is_spread(spark):
    """One (user, sku) pair with most clicks: same answer, several salts."""
    from pyspark.sql import functions as F

    from skupulse.operators import clicks as ck

    base = F.lit("1998-03-01 00:00:00").cast("timestamp_ntz")
    c = spark.range(300).select(F.lit("u").alias("user_ID"), F.lit(1).alias("sku_ID"),
                                F.timestamp_add("MINUTE", F.col("id").cast("int"), base).alias("request_time"))
    o = spark.range(1).select(F.lit("u").alias("user_ID"), F.lit(1).alias("sku_ID"),
                              F.timestamp_add("MINUTE", F.lit(100), base).alias("first_order_time"))
    row = ck.click_to_order(o, c).collect()
    assert [(r.clicks_before_order, round(r.days_between * 1440)) for r in row] == [(100, 100)]
    salts = c.select(F.pmod(F.xxhash64("request_time"), F.lit(ck.SALTS)).alias("s")).distinct().count()
    assert salts > ck.SALTS // 2


def test_time_difference_ignores_the_session_zone(spark):
    from pyspark.sql import functions as F

    from skupulse.functions.exprs import hours_between

    a, b = (F.lit(f"1998-04-0{d} 00:30:00").cast("timestamp_ntz") for d in (5, 6))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):   # the clocks there change on that day
            spark.conf.set("spark.sql.session.timeZone", z)
            r = spark.range(1).select(hours_between(a, b).alias("up"), hours_between(b, a).alias("down")).first()
            assert (r.up, r.down) == (24.0, -24.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_split_counts_of_skus(spark):
    lines = spark.createDataFrame(
        [(D(2018, 3, 1), 1), (D(2018, 3, 1), 2), (D(2018, 3, 2), 2), (D(2018, 3, 3), 9), (D(2018, 3, 4), 2),
         (D(2018, 3, 4), 3), (D(2018, 3, 4), 3), (D(2018, 3, 4), None)], "order_date date, sku_ID long")
    split = spark.createDataFrame([(D(2018, 3, 1), "train"), (D(2018, 3, 2), "train"), (D(2018, 3, 3), "unused"),
                                   (D(2018, 3, 4), "test")], "order_date date, split string")
    assert tuple(panel.sku_split_counts(lines, split).first()) == (2, 2, 1)
    assert tuple(panel.sku_split_counts(lines.limit(0), split).first()) == (0, 0, 0)


def test_panel_alignment_names_missing_clusters(spark):
    facts = spark.createDataFrame(
        [(D(2018, 3, 1), 1, 7, 1.0), (D(2018, 3, 2), 1, 5, 2.0), (D(2018, 3, 3), 1, 5, 2.0), (D(2018, 3, 3), None, 7, 4.0)],
        "date date, warehouse int, sku_cluster_ID int, demand double")
    mapping = spark.createDataFrame([(1, 5), (2, 7)], "sku_ID long, sku_cluster_ID int")
    week = (D(2018, 3, 2), D(2018, 3, 3))
    test = fc.facts_panels(facts, mapping, (D(2018, 3, 1), D(2018, 3, 1)), week)[1]
    got = {tuple(r) for r in fc.panel_alignment(facts, test, week).collect()}
    assert got == {(5, 2, 0, 0), (7, 0, 2, 1)}
