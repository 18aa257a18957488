"""Forecast inputs and rule forecasts.

Panels here use the columns (date, warehouse, sku_cluster_ID, demand).
Series windows are partitioned by (warehouse, cluster) or cluster; the
global context is one row per calendar day, so its date-ordered window is
bounded by the number of days, not by data volume.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skupulse import config
from skupulse.functions.exprs import finite_or_zero
from skupulse.operators.grid import attach_one_row, date_spine, densify, dim_product, union_all
from skupulse.session import share
from skupulse.sources.fixtures import shift_click_date

# Autoregressive lags and rolling windows of the model features.
AR_LAGS = [1, 2, 3, 7]
ROLL_WINDOWS = [3, 7]

# Rule forecast names.
RULE_MODELS = ["lag_1", "moving_average_3", "moving_average_7", "blend_50_50"]

KEYS = ["warehouse", "sku_cluster_ID"]


# --------------------------------------------------------------- panels (D3)

def _mapped(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select("sku_ID", "sku_cluster_ID").filter(F.col("sku_cluster_ID").isNotNull())
    return lines.join(m, "sku_ID", "inner")


def panel_facts(lines: DataFrame, mapping: DataFrame, start=config.TRAIN_START, end=config.TEST_END) -> DataFrame:
    """Demand by (date, warehouse, cluster) of the mapped lines, written once:
    panels, dimension sets and the warehouse universe are read off it."""
    m = _mapped(lines, mapping).filter(F.col("order_date").between(F.lit(start), F.lit(end)))
    return share(m.groupBy(F.col("order_date").alias("date"), F.col("dc_des").alias("warehouse"), "sku_cluster_ID")
                 .agg(F.sum("quantity").alias("demand")))


def facts_warehouses(facts: DataFrame, start=config.TRAIN_START, end=config.TEST_END) -> DataFrame:
    """Warehouses with mapped lines in [start, end]."""
    return (facts.filter(F.col("date").between(F.lit(start), F.lit(end)) & F.col("warehouse").isNotNull())
            .select("warehouse").distinct())


def facts_panels(facts: DataFrame, mapping: DataFrame, train=(config.TRAIN_START, config.TRAIN_END),
                 test=(config.TEST_START, config.TEST_END)):
    """D2 + D3: train panel over train-observed warehouses x mapped clusters;
    test panel aligned to the train clusters over train- or test-observed
    warehouses.  Returns (train, test, full) with (date, warehouse,
    sku_cluster_ID, demand)."""
    clusters = mapping.select("sku_cluster_ID").filter(F.col("sku_cluster_ID").isNotNull()).distinct()

    def build(wh, span):
        own = facts.filter(F.col("date").between(F.lit(span[0]), F.lit(span[1])))
        return densify(own, dim_product([wh, clusters]), "date", span[0], span[1], ["demand"], KEYS)

    train_p = build(facts_warehouses(facts, *train), train)
    test_p = build(facts_warehouses(facts, train[0], test[1]), test)
    return train_p, test_p, train_p.unionByName(test_p)


def panel_alignment(facts: DataFrame, test_panel: DataFrame, test=(config.TEST_START, config.TEST_END)) -> DataFrame:
    """D3: per train cluster the observed and the zero-filled cells of the
    aligned test panel, and whether the test week lacks the cluster altogether."""
    own = facts.filter(F.col("date").between(F.lit(test[0]), F.lit(test[1])) & F.col("warehouse").isNotNull())
    observed = own.groupBy("sku_cluster_ID").agg(F.count(F.lit(1)).alias("observed_cells"))
    cells = test_panel.groupBy("sku_cluster_ID").agg(F.count(F.lit(1)).alias("_cells"))
    seen = F.coalesce("observed_cells", F.lit(0))
    return cells.join(observed, "sku_cluster_ID", "left").select(
        "sku_cluster_ID", seen.alias("observed_cells"), (F.col("_cells") - seen).alias("filled_cells"),
        (seen == 0).cast("int").alias("missing_in_test"))


def opt_panels(lines: DataFrame, mapping: DataFrame, train=(config.TRAIN_START, config.TRAIN_END),
               test=(config.TEST_START, config.TEST_END)):
    """The panels of order lines (see ``facts_panels``)."""
    return facts_panels(panel_facts(lines, mapping, train[0], test[1]), mapping, train, test)


def warehouse_universe(lines: DataFrame, mapping: DataFrame, start=config.TRAIN_START,
                       end=config.TEST_END) -> DataFrame:
    m = _mapped(lines, mapping).filter(F.col("order_date").between(F.lit(start), F.lit(end)))
    return m.select(F.col("dc_des").alias("warehouse")).filter(F.col("warehouse").isNotNull()).distinct()


# --------------------------------------------------------------- context

def order_context_cols(orders: DataFrame) -> DataFrame:
    """Discount rate (0 when price is 0 / non-finite) and numeric gift flag
    (text '0' is not a gift here, unlike C6 - trap T7)."""
    orig = F.col("original_unit_price").cast("double")
    fin = F.col("final_unit_price").cast("double")
    rate = finite_or_zero(F.try_divide(orig - fin, F.nullif(orig, F.lit(0.0))))
    gift = (F.coalesce(F.col("gift_item").try_cast("double"), F.lit(0.0)) > 0).cast("double")
    return orders.withColumns({"discount_rate": rate, "gift_flag": gift})


def history_cols(keys: list[str], value: str, prefix: str, lags=AR_LAGS, windows=ROLL_WINDOWS,
                 lag_fmt="{p}_lag_{n}", roll_fmt="{p}_roll_{n}") -> dict:
    """Lags and shifted rolling means (full window) per group by date."""
    w = Window.partitionBy(*keys).orderBy("date") if keys else Window.orderBy("date")
    cols = {lag_fmt.format(p=prefix, n=n): F.lag(value, n).over(w) for n in lags}
    for n in windows:
        fw = w.rowsBetween(-n, -1)
        cols[roll_fmt.format(p=prefix, n=n)] = F.when(F.count(value).over(fw) == n, F.avg(value).over(fw))
    return cols


def add_history(df: DataFrame, keys: list[str], values: list[str] | str, prefix: str | None = None,
                **kw) -> DataFrame:
    """Add history columns for one or many value columns in one projection
    (all windows share the same partitioning, so one sort serves them)."""
    values = [values] if isinstance(values, str) else values
    cols = {}
    for v in values:
        cols.update(history_cols(keys, v, v if prefix is None else prefix, **kw))
    return df.withColumns(cols)


def global_context(orders: DataFrame, clicks: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Daily discount, units, distinct orders, gift rate, clicks and
    distinct non-anonymous click users over every day of [start, end]
    (missing -> 0), each with lags 1,2,3,7 and rolling means 3,7."""
    o = order_context_cols(orders).filter(F.col("order_date").between(F.lit(start), F.lit(end)))
    go = o.groupBy(F.col("order_date").alias("date")).agg(
        F.avg("discount_rate").alias("global_discount"),
        F.sum("quantity").alias("global_units"),
        F.countDistinct("order_ID").alias("global_order_count"),
        F.avg("gift_flag").alias("global_gift_rate"))
    c = clicks.withColumn("date", shift_click_date(F.col("request_time")))
    gc = c.filter(F.col("date").between(F.lit(start), F.lit(end))).groupBy("date").agg(
        F.count(F.lit(1)).alias("global_clicks"),
        F.countDistinct(F.when(F.col("user_ID") != "-", F.col("user_ID"))).alias("global_click_users"))
    days = orders.sparkSession.range(1).select(date_spine(start, end).alias("date"))
    ctx = days.join(go, "date", "left").join(gc, "date", "left")
    base = ["global_discount", "global_units", "global_order_count", "global_gift_rate",
            "global_clicks", "global_click_users"]
    return add_history(ctx.fillna(0, subset=base), [], base)


def warehouse_context(orders: DataFrame, warehouses: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Per (date, warehouse) discount, units, distinct orders, gift
    rate on the dense warehouse x day grid, with lags / rolling means."""
    o = order_context_cols(orders).filter(F.col("order_date").between(F.lit(start), F.lit(end)))
    wf = o.groupBy(F.col("order_date").alias("date"), F.col("dc_des").alias("warehouse")).agg(
        F.avg("discount_rate").alias("wh_discount"), F.sum("quantity").alias("wh_units"),
        F.countDistinct("order_ID").alias("wh_order_count"), F.avg("gift_flag").alias("wh_gift_rate"))
    grid = warehouses.select("warehouse", date_spine(start, end).alias("date"))
    ctx = grid.join(wf, ["date", "warehouse"], "left")
    base = ["wh_discount", "wh_units", "wh_order_count", "wh_gift_rate"]
    return add_history(ctx.fillna(0, subset=base), ["warehouse"], base)


def cluster_level_panel(panel: DataFrame) -> DataFrame:
    return panel.groupBy("date", "sku_cluster_ID").agg(F.sum("demand").alias("demand"))


def training_matrix(panel: DataFrame, keys: list[str], context: DataFrame, context_keys: list[str]) -> DataFrame:
    """Target lags 1,2,3,7 + rolling means 3,7, context join, day name
    and weekend flag (C11)."""
    f = add_history(panel, keys, "demand", "", lag_fmt="lag_{n}", roll_fmt="rolling_mean_{n}")
    f = f.join(context, context_keys, "left")
    return f.withColumns({"dow": F.date_format("date", "EEEE"),
                          "is_weekend": (F.weekday("date") >= 5).cast("int")})


# --------------------------------------------------------------- rule forecasts

def rule_prediction(name: str) -> Column:
    lag1 = F.coalesce(F.col("lag_1"), F.lit(0.0))
    ma3 = F.coalesce(F.col("rolling_mean_3"), F.col("lag_1"), F.lit(0.0))
    if name == "lag_1":
        return lag1
    if name == "moving_average_3":
        return ma3
    if name == "moving_average_7":
        return F.coalesce(F.col("rolling_mean_7"), F.col("rolling_mean_3"), F.col("lag_1"), F.lit(0.0))
    if name == "blend_50_50":
        return 0.5 * lag1 + 0.5 * ma3
    raise ValueError(f"Unknown baseline model: {name}")


def rule_forecasts(frame: DataFrame, keys: list[str], start: dt.date, end: dt.date,
                   models=RULE_MODELS) -> DataFrame:
    """Long table (keys..., date, model_name, predicted_demand) for rows in
    [start, end]; one projection per model, unioned (no row explosion)."""
    rows = frame.filter(F.col("date").between(F.lit(start), F.lit(end)))
    return union_all([rows.select("date", *keys, F.lit(m).alias("model_name"),
                                  rule_prediction(m).cast("double").alias("predicted_demand"))
                      for m in models])


def recursive_forecast(history: DataFrame, future: DataFrame, keys: list[str], days: list[dt.date], predict,
                       context: DataFrame | None = None, context_keys: list[str] | None = None) -> DataFrame:
    """Forecast day by day; a day's predictions are the next day's history.

    ``history`` and ``future`` have (date, keys); history also demand.  Each day,
    lags and rolling means are taken from the days just before it - as many as the
    longest lag or window reaches, so the work of a day does not grow - the context
    is joined, and ``predict`` adds predicted_demand to the day's rows.  It is
    clipped at 0 and written once."""
    reach = max(*AR_LAGS, *ROLL_WINDOWS)
    known = share(history.select("date", *keys, "demand")
                  .filter(F.col("date").between(F.date_sub(F.lit(days[0]), reach), F.date_sub(F.lit(days[0]), 1))))
    out = []
    for day in days:
        rows = future.filter(F.col("date") == F.lit(day)).select("date", *keys, F.lit(None).cast("double").alias("demand"))
        recent = known.filter(F.col("date") >= F.date_sub(F.lit(day), reach)).unionByName(rows)
        frame = training_matrix(recent, keys, context, context_keys) if context is not None else add_history(
            recent, keys, "demand", "", lag_fmt="lag_{n}", roll_fmt="rolling_mean_{n}")
        done = predict(frame.filter(F.col("date") == F.lit(day)))
        done = share(done.select("date", *keys, F.greatest(F.col("predicted_demand"), F.lit(0.0)).alias("predicted_demand")))
        known = known.unionByName(done.withColumnRenamed("predicted_demand", "demand"))
        out.append(done)
    return union_all(out)


def tag(df: DataFrame, approach: str, level: str, family: str = "baseline") -> DataFrame:
    return df.withColumns({
        "model_id": F.concat(F.lit(approach + "__"), F.col("model_name")),
        "approach": F.lit(approach), "prediction_level": F.lit(level), "family": F.lit(family)})


# --------------------------------------------------------------- allocation

def allocation_shares(train_panel: DataFrame) -> DataFrame:
    """Mean share of the cluster's daily total by (cluster, warehouse,
    weekday name) and overall, over days with a positive cluster total."""
    tot = train_panel.groupBy("date", "sku_cluster_ID").agg(F.sum("demand").alias("cluster_total"))
    a = (train_panel.join(tot, ["date", "sku_cluster_ID"]).filter(F.col("cluster_total") > 0)
         .withColumns({"dow": F.date_format("date", "EEEE"),
                       "share": F.col("demand") / F.col("cluster_total")}))
    dow = a.groupBy("sku_cluster_ID", "warehouse", "dow").agg(F.avg("share").alias("share_dow"))
    overall = a.groupBy("sku_cluster_ID", "warehouse").agg(F.avg("share").alias("share_overall"))
    return dow.join(overall, ["sku_cluster_ID", "warehouse"], "full")


def allocate(cluster_pred: DataFrame, shares: DataFrame, warehouses: DataFrame, clusters: DataFrame) -> DataFrame:
    """M16 + J13 + W9: spread cluster predictions over warehouses.

    Share = weekday share of the (cluster, warehouse), else the overall share
    carried on that same weekday row, else 0 (the reference's literal
    behaviour: its separate overall fallback column is never read);
    normalised within (date, cluster); equal split 1/|warehouses| when all
    shares are 0.  ``cluster_pred`` has (date, sku_cluster_ID, model cols...,
    predicted_demand); the grid is its dates x warehouses x clusters.
    """
    dates = cluster_pred.select("date").distinct()
    n_wh = warehouses.agg(F.count(F.lit(1)).alias("_n_wh"))
    base = attach_one_row(dim_product([warehouses, clusters, dates]), n_wh) \
        .withColumn("dow", F.date_format("date", "EEEE"))
    al = base.join(shares, ["sku_cluster_ID", "warehouse", "dow"], "left")
    al = al.withColumn("share", F.coalesce("share_dow", "share_overall", F.lit(0.0)))
    w = Window.partitionBy("date", "sku_cluster_ID")
    al = al.withColumn("share", F.when(F.sum("share").over(w) > 0, F.col("share") / F.sum("share").over(w))
                       .otherwise(F.lit(1.0) / F.col("_n_wh")))
    preds = cluster_pred.withColumnRenamed("predicted_demand", "predicted_cluster_demand")
    model_cols = [c for c in preds.columns if c not in ("date", "sku_cluster_ID", "predicted_cluster_demand")]
    # one row per model and grid cell: the grid is joined to every model's
    # cluster predictions on (date, cluster)
    out = al.join(preds, ["date", "sku_cluster_ID"], "inner")
    return out.select("date", "warehouse", "sku_cluster_ID", *model_cols,
                      (F.coalesce("predicted_cluster_demand", F.lit(0.0)) * F.col("share")).alias("predicted_demand"))


# --------------------------------------------------------------- lag-1 baseline

def lag1_baseline(train_panel: DataFrame, test_panel: DataFrame, start=config.TRAIN_START,
                  test_start=config.TEST_START, test_end=config.TEST_END) -> DataFrame:
    """Previous day's actual demand per (warehouse, cluster) on the test
    universe over the whole calendar; null -> 0; test dates kept."""
    wh = test_panel.select("warehouse").distinct()
    cl = test_panel.select("sku_cluster_ID").distinct()
    facts = train_panel.unionByName(test_panel)
    full = densify(facts, dim_product([wh, cl]), "date", start, test_end, ["demand"], KEYS)
    w = Window.partitionBy(*KEYS).orderBy("date")
    out = full.withColumn("predicted_demand", F.coalesce(F.lag("demand", 1).over(w), F.lit(0.0)))
    out = out.filter(F.col("date").between(F.lit(test_start), F.lit(test_end)))
    return out.select("date", "warehouse", "sku_cluster_ID", "demand", "predicted_demand",
                      F.lit("baseline__lag_1_actual_demand").alias("model_id"),
                      F.lit("lag_1_baseline").alias("approach"),
                      F.lit("direct warehouse-cluster").alias("prediction_level"),
                      F.lit("lag_1_actual_demand").alias("model_name"),
                      F.lit("naive_baseline").alias("family"))
