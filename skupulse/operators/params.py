"""Network parameters (A27-A37, P1): prices, capacity, eligibility,
inventory shares, initial inventory, demand means and routes.

Parameters are keyed DataFrames (warehouse, cluster, route) kept long;
``pivot`` is only for display.  Every parameter is a grouped aggregation
or a join of grouped aggregations.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skupulse import config
from skupulse.operators.grid import attach_one_row, dim_product
from skupulse.operators.order_stats import exact_percentiles
from skupulse.session import share


# ----------------------------------------------------------------- prices

def _priced_train_lines(orders: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return (orders.filter(F.col("order_date").between(F.lit(start), F.lit(end)))
            .filter(F.col("sku_ID").isNotNull() & F.col("original_unit_price").isNotNull()
                    & F.col("quantity").isNotNull())
            .filter((F.col("quantity") > 0) & (F.col("original_unit_price") > 0)))


def sku_prices(orders: DataFrame, start=config.TRAIN_START, end=config.TRAIN_END) -> DataFrame:
    """Mean original unit price per SKU over positive train lines."""
    return _priced_train_lines(orders, start, end).groupBy("sku_ID").agg(
        F.avg("original_unit_price").alias("sku_price"))


def cluster_prices(orders: DataFrame, mapping: DataFrame, clusters: DataFrame,
                   start=config.TRAIN_START, end=config.TRAIN_END) -> DataFrame:
    """p_s = mean SKU price over the cluster's mapped SKUs; clusters of
    the universe without a priced SKU get the global mean SKU price."""
    sp = sku_prices(orders, start, end)
    m = mapping.select("sku_ID", "sku_cluster_ID").dropna().distinct()
    cp = m.join(sp, "sku_ID", "left").groupBy("sku_cluster_ID").agg(F.avg("sku_price").alias("_p"))
    g = sp.agg(F.coalesce(F.avg("sku_price"), F.lit(0.0)).alias("_g"))
    out = attach_one_row(clusters.select("sku_cluster_ID").distinct().join(cp, "sku_cluster_ID", "left"), g)
    return out.select("sku_cluster_ID", F.coalesce("_p", "_g").alias("p_s"),
                      F.col("_p").isNull().cast("int").alias("filled_with_global_mean"))


def price_coverage(orders: DataFrame, mapping: DataFrame, clusters: DataFrame,
                   start=config.TRAIN_START, end=config.TRAIN_END) -> DataFrame:
    """(metric, value) rows describing mapping and price coverage."""
    tl = _priced_train_lines(orders, start, end)
    m = mapping.select("sku_ID", "sku_cluster_ID").dropna().distinct()
    msku = m.select("sku_ID").distinct()
    sp = sku_prices(orders, start, end)
    cp = cluster_prices(orders, mapping, clusters, start, end)
    covered = tl.join(msku, "sku_ID", "left_semi")
    one = m.agg(F.count(F.lit(1)).cast("double").alias("cluster_mapping_rows"),
                F.countDistinct("sku_ID").cast("double").alias("unique_mapped_skus"))
    one = attach_one_row(one, sp.agg(F.count(F.lit(1)).cast("double").alias("priced_skus"),
                                     F.coalesce(F.avg("sku_price"), F.lit(0.0)).alias("global_mean_sku_price")))
    one = attach_one_row(one, cp.agg(F.sum("filled_with_global_mean").cast("double")
                                     .alias("missing_clusters_filled_with_global_mean")))
    one = attach_one_row(one, covered.select("sku_ID").distinct().agg(
        F.count(F.lit(1)).cast("double").alias("_mapped_order_skus")))
    one = attach_one_row(one, tl.agg(F.sum("quantity").alias("_units")))
    one = attach_one_row(one, covered.agg(F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("_cov_units")))
    one = one.withColumns({
        "order_sku_mapping_coverage": F.when(F.col("priced_skus") > 0,
                                             F.col("_mapped_order_skus") / F.col("priced_skus")).otherwise(0.0),
        "order_unit_mapping_coverage": F.when(F.col("_units") > 0,
                                              F.col("_cov_units") / F.col("_units")).otherwise(0.0),
    })
    names = ["cluster_mapping_rows", "unique_mapped_skus", "priced_skus", "global_mean_sku_price",
             "missing_clusters_filled_with_global_mean", "order_sku_mapping_coverage", "order_unit_mapping_coverage"]
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    return one.selectExpr(f"stack({len(names)}, {stack}) as (metric, value)")


# ----------------------------------------------------------------- warehouses, capacity, eligibility

def warehouse_universe(demand_warehouses: DataFrame, capacity_legacy: DataFrame, summary: DataFrame) -> DataFrame:
    """Union of warehouses of the demand panels, the capacity table and
    the daily summary (U2)."""
    a = demand_warehouses.select(F.col("warehouse").cast("int"))
    b = capacity_legacy.select(F.col("dc_des").cast("int").alias("warehouse"))
    c = summary.select(F.col("dc_des").cast("int").alias("warehouse"))
    return a.union(b).union(c).filter(F.col("warehouse").isNotNull()).distinct()


def capacity(universe: DataFrame, capacity_legacy: DataFrame, summary: DataFrame) -> DataFrame:
    """A29 + J14: corrected capacity = max over days of the warehouse's daily
    inventory total (<= 0 treated as missing), else legacy capacity, else 0;
    with the source label."""
    daily = summary.groupBy("dc_des", "order_day").agg(
        F.sum(F.coalesce(F.col("inventory").cast("double"), F.lit(0.0))).alias("daily_inventory_total"))
    corr = daily.groupBy(F.col("dc_des").alias("warehouse")).agg(
        F.max("daily_inventory_total").alias("_c")).select(
        "warehouse", F.when(F.col("_c") > 0, F.col("_c")).alias("corrected_capacity"))
    leg = capacity_legacy.select(F.col("dc_des").alias("warehouse"), F.col("capacity").alias("legacy_capacity"))
    out = universe.join(leg, "warehouse", "left").join(corr, "warehouse", "left")
    return out.withColumns({
        "capacity_source": F.when(F.col("corrected_capacity").isNotNull(), "daily_sku_dc_summary")
                            .otherwise("legacy_capacity_fallback"),
        "C_j": F.coalesce("corrected_capacity", "legacy_capacity", F.lit(0.0)),
    })


def procurement(network: DataFrame, universe: DataFrame) -> DataFrame:
    """W_j = 1 when the DC is its region's central warehouse (dc = region);
    warehouses missing from the network get 0."""
    w = network.groupBy(F.col("dc_ID").alias("warehouse")).agg(
        F.max((F.col("dc_ID") == F.col("region_ID")).cast("int")).alias("W_j"))
    return universe.join(w, "warehouse", "left").withColumn("W_j", F.coalesce("W_j", F.lit(0)))


# ----------------------------------------------------------------- inventory and demand parameters

def inventory_share(train_panel: DataFrame, universe: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster share of the warehouse's train demand (0 when the
    warehouse total is 0 or the pair is absent), over universe x clusters."""
    s = train_panel.groupBy("warehouse", "sku_cluster_ID").agg(F.sum("demand").alias("demand"))
    tot = s.groupBy("warehouse").agg(F.sum("demand").alias("warehouse_total"))
    s = s.join(tot, "warehouse").withColumn(
        "inventory_share_proxy", F.when(F.col("warehouse_total") > 0, F.col("demand") / F.col("warehouse_total"))
        .otherwise(F.lit(0.0)))
    grid = dim_product([universe, clusters])
    return grid.join(s.select("warehouse", "sku_cluster_ID", "inventory_share_proxy"),
                     ["warehouse", "sku_cluster_ID"], "left").fillna(0.0, subset=["inventory_share_proxy"])


def warehouse_daily_inventory(inventory: DataFrame, summary: DataFrame, universe: DataFrame,
                              start: dt.date, end: dt.date) -> DataFrame:
    """Per (date, warehouse) inventory units: summary inventory, else the
    raw inventory row count, else 0."""
    raw = (inventory.filter(F.col("date").between(F.lit(start), F.lit(end)))
           .groupBy("date", F.col("dc_ID").alias("warehouse")).agg(F.count("sku_ID").alias("raw_inventory_units")))
    summ = (summary.filter(F.col("order_day").between(F.lit(start), F.lit(end)))
            .groupBy(F.col("order_day").alias("date"), F.col("dc_des").alias("warehouse"))
            .agg(F.sum(F.coalesce(F.col("inventory").cast("double"), F.lit(0.0))).alias("summary_inventory_units")))
    from skupulse.operators.grid import date_spine
    grid = universe.select("warehouse", date_spine(start, end).alias("date"))
    out = grid.join(summ, ["date", "warehouse"], "left").join(raw, ["date", "warehouse"], "left")
    return out.withColumn("warehouse_inventory_units", F.coalesce(
        "summary_inventory_units", F.col("raw_inventory_units").cast("double"), F.lit(0.0)))


def inventory_parameters(wh_daily: DataFrame, share: DataFrame, train_end: dt.date = config.TRAIN_END,
                         test_start: dt.date = config.TEST_START) -> DataFrame:
    """Cluster inventory proxy = warehouse inventory x share; per
    (cluster, warehouse): train mean, first-test-day sum, test mean - one
    pass with conditional aggregates."""
    c = wh_daily.join(share, "warehouse", "left").withColumn(
        "cluster_inventory_proxy", F.col("warehouse_inventory_units") * F.col("inventory_share_proxy"))
    d = F.col("date")
    return c.filter(F.col("sku_cluster_ID").isNotNull()).groupBy("sku_cluster_ID", "warehouse").agg(
        F.avg(F.when(d <= F.lit(train_end), F.col("cluster_inventory_proxy"))).alias("I0_sj_train_proxy"),
        F.sum(F.when(d == F.lit(test_start), F.col("cluster_inventory_proxy"))).alias("I0_sj_test_initial"),
        F.avg(F.when(d >= F.lit(test_start), F.col("cluster_inventory_proxy"))).alias("I0_sj_test_proxy"))


def demand_parameters(train_panel: DataFrame, test_panel: DataFrame) -> DataFrame:
    """Mean demand per (cluster, warehouse) on the train and test panels."""
    a = train_panel.groupBy("sku_cluster_ID", "warehouse").agg(F.avg("demand").alias("D_sj_train"))
    b = test_panel.groupBy("sku_cluster_ID", "warehouse").agg(F.avg("demand").alias("D_sj_test_actual"))
    return a.join(b, ["sku_cluster_ID", "warehouse"], "full")


# ----------------------------------------------------------------- routes

def routes(mart: DataFrame, universe: DataFrame, start=config.TRAIN_START, end=config.TRAIN_END) -> DataFrame:
    """t_nm = mean lead hours, r_nm = 1 per observed (ori, des) route in
    the train window; all pairs of (route warehouses U universe), absent ->
    t null, r 0.  Long form; pivot only for display."""
    tr = (mart.filter(F.col("order_date").between(F.lit(start), F.lit(end)))
          .filter(F.col("dc_ori").isNotNull() & F.col("dc_des").isNotNull() & F.col("lead_time_hours").isNotNull())
          .filter(F.col("lead_time_hours") > 0))
    obs = tr.groupBy("dc_ori", "dc_des").agg(F.avg("lead_time_hours").alias("t_nm"))
    wh = (tr.select(F.col("dc_ori").alias("w")).union(tr.select(F.col("dc_des").alias("w")))
          .union(universe.select(F.col("warehouse").alias("w"))).distinct())
    pairs = dim_product([wh.select(F.col("w").alias("dc_ori")), wh.select(F.col("w").alias("dc_des"))])
    out = pairs.join(obs, ["dc_ori", "dc_des"], "left")
    return out.withColumn("r_nm", F.col("t_nm").isNotNull().cast("int"))


def route_inputs(route_tbl: DataFrame, universe: DataFrame) -> DataFrame:
    """Ordered pairs n != m of the warehouse universe with feasibility
    and lead time; unknown time -> median of known times over the universe
    block (24 h if none)."""
    u1 = universe.select(F.col("warehouse").alias("dc_ori"))
    u2 = universe.select(F.col("warehouse").alias("dc_des"))
    block = share(dim_product([u1, u2]).join(route_tbl, ["dc_ori", "dc_des"], "left"))
    med = exact_percentiles(block, ["t_nm"], [0.5]).select(
        F.coalesce(F.col("t_nm")[0], F.lit(config.DEFAULT_ROUTE_HOURS)).alias("_med"))
    out = attach_one_row(block.filter(F.col("dc_ori") != F.col("dc_des")), med)
    return out.select(F.col("dc_ori").alias("source_warehouse"), F.col("dc_des").alias("destination_warehouse"),
                      F.coalesce("r_nm", F.lit(0)).alias("route_feasible"),
                      F.coalesce("t_nm", "_med").alias("lead_time_hours"))
