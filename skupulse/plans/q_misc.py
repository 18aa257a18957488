"""Registered queries: candidate files, run checks, coverage and load reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skupulse import config
from skupulse.operators import candidates as cd
from skupulse.operators import evaluate as ev
from skupulse.operators import forecast as fc
from skupulse.operators.grid import union_all
from skupulse.plans import q_forecast  # noqa: F401  (registers CTEs)
from skupulse.plans.oracle import cte, sql
from skupulse.plans.q_forecast import Inputs
from skupulse.plans.registry import query
from skupulse.session import checkpoint_dir, share
from skupulse.sources import loaders
from skupulse.sources.fixtures import _sku_from_props, bind, table

# Metrics of the previous pipeline version (test week), as published.
PREVIOUS_METRICS = {
    "mae": 6.218490682438978,
    "rmse": 22.33402735210863,
    "wape": 0.3364731911466794,
    "bias": -0.0795858374268849,
    "underprediction_units": 35524.78409572521,
    "overprediction_units": 21934.069810010933,
    "price_weighted_abs_error": 8058356.20219698,
    "purchase_cost_proxy": 352764.6235029767,
    "holding_cost_proxy": 1660.3738693992368,
}

cte("lag1b", """
with full_ as (
  select g.date, g.warehouse, g.sku_cluster_ID, coalesce(a.demand, 0.0) as demand
  from (select cast(ds.d as date) as date, w.warehouse, k.sku_cluster_ID
        from generate_series(timestamp '1998-03-01', timestamp '1998-03-31', interval 1 day) ds(d)
        cross join (select distinct warehouse from opt_test) w
        cross join (select distinct sku_cluster_ID from opt_test) k) g
  left join (select date, warehouse, sku_cluster_ID, sum(demand) as demand from opt_full group by all) a
    on g.date = a.date and g.warehouse = a.warehouse and g.sku_cluster_ID = a.sku_cluster_ID)
select * from (select date, warehouse, sku_cluster_ID, demand,
  coalesce(lag(demand) over (partition by warehouse, sku_cluster_ID order by date), 0.0) as predicted_demand
  from full_) where date between date '1998-03-25' and date '1998-03-31'""", "opt_test", "opt_full")

cte("cand_raw", """
select date, sku_cluster_ID as cluster_id, warehouse as warehouse_id, demand as actual_demand, predicted_demand,
  'lag_1_actual_demand' as model_name, 'lag_1' as feature_set, 'lag1_baseline' as role from lag1b
union all
select p.date, p.sku_cluster_ID, p.warehouse, t.demand, p.predicted_demand, p.model_name,
  case p.model_name when 'moving_average_3' then 'rolling_mean_3' else 'rolling_mean_7' end, p.model_name
from preds_test p join opt_test t on p.date = t.date and p.warehouse = t.warehouse and p.sku_cluster_ID = t.sku_cluster_ID
where p.approach = 'direct_warehouse' and p.model_name in ('moving_average_3', 'moving_average_7')""",
    "lag1b", "preds_test", "opt_test")

cte("cand_aligned", """
with f as (select *, row_number() over (partition by role, date, warehouse_id, cluster_id
                                        order by predicted_demand, actual_demand, model_name, feature_set) as rn
           from cand_raw),
m as (select role, (select model_name from cand_raw c2 where c2.role = r.role group by model_name
                    order by count(*) desc, model_name limit 1) as mn,
             (select feature_set from cand_raw c3 where c3.role = r.role group by feature_set
              order by count(*) desc, feature_set limit 1) as fs
      from (select distinct role from cand_raw) r)
select a.date, a.warehouse, a.sku_cluster_ID, a.demand as actual_demand, coalesce(f.predicted_demand, 0.0) as predicted_demand,
  replace(replace(lower(m.role), ' ', '_'), '-', '_') || '__' || replace(replace(lower(m.mn), ' ', '_'), '-', '_')
    || '__feature_' || replace(replace(lower(m.fs), ' ', '_'), '-', '_') as model_id,
  'candidate_file' as approach, 'direct warehouse-cluster' as prediction_level, m.mn as model_name,
  'candidate_file' as family, m.fs as feature_set, m.role as source_file
from m cross join opt_test a
left join f on f.role = m.role and f.rn = 1 and f.date = a.date and f.warehouse_id = a.warehouse
  and f.cluster_id = a.sku_cluster_ID""", "cand_raw", "opt_test")


def _candidate_files(spark, sf_dir):
    """Inputs, and (role, aligned rows, diagnostics) of three prediction files, one of
    them with repeated keys."""
    i = Inputs(spark, sf_dir)
    lag1 = fc.lag1_baseline(i.train, i.test).select(
        "date", F.col("sku_cluster_ID").alias("cluster_id"), F.col("warehouse").alias("warehouse_id"), F.col("demand").alias("actual_demand"), "predicted_demand",
        F.lit("lag_1_actual_demand").alias("model_name"), F.lit("lag_1").alias("feature_set"))
    files = {"lag1_baseline": lag1}
    preds = i.predictions(config.TEST_START, config.TEST_END, config.TRAIN_END).filter(
        F.col("approach") == "direct_warehouse")
    for name, fs in (("moving_average_3", "rolling_mean_3"), ("moving_average_7", "rolling_mean_7")):
        files[name] = preds.filter(F.col("model_name") == name).join(i.test, ["date", "warehouse", "sku_cluster_ID"]).select(
            "date", F.col("sku_cluster_ID").alias("cluster_id"), F.col("warehouse").alias("warehouse_id"),
            F.col("demand").alias("actual_demand"), "predicted_demand", "model_name", F.lit(fs).alias("feature_set"))
    again = files["moving_average_3"].withColumn("predicted_demand", F.col("predicted_demand") + 1)
    files["moving_average_3"] = files["moving_average_3"].unionByName(again)
    return i, [(role, *cd.align_with_diagnostics(share(f), i.test, role)) for role, f in files.items()]


def _candidates(spark, sf_dir):
    i, files = _candidate_files(spark, sf_dir)
    return i, union_all([aligned for _, aligned, _ in files])


@query("candidate_alignment", sql("""
select date, warehouse, sku_cluster_ID, actual_demand, round(predicted_demand, 6) as predicted_demand, model_id,
  approach, prediction_level, model_name, family, feature_set, source_file from cand_aligned""", "cand_aligned"))
def q_candidate_alignment(spark, sf_dir):
    """E9+C17+C21+W13: candidate prediction files aligned to the test panel."""
    return _candidates(spark, sf_dir)[1]


@query("candidate_diagnostics", sql("""
with f as (select role, count(*) * case when role = 'moving_average_3' then 2 else 1 end as source_rows from cand_raw group by role),
a as (select source_file, count(*) as aligned_rows, min(date) as min_date, max(date) as max_date, any_value(model_name) as model_name,
        any_value(feature_set) as feature_set from cand_aligned group by 1),
m as (select r.role, count_if(c.role is null) as filled_rows, coalesce(sum(abs(t.demand - c.actual_demand)), 0.0) as mismatch
      from (select distinct role from cand_raw) r cross join opt_test t
      left join (select distinct role, date, warehouse_id, cluster_id, actual_demand from cand_raw) c
        on c.role = r.role and c.date = t.date and c.warehouse_id = t.warehouse and c.cluster_id = t.sku_cluster_ID group by 1)
select a.source_file, f.source_rows, a.aligned_rows, m.filled_rows, round(m.mismatch, 6) as actual_demand_mismatch, a.model_name,
  a.feature_set, a.min_date, a.max_date
from a join f on f.role = a.source_file join m on m.role = a.source_file""", "cand_raw", "cand_aligned", "opt_test"))
def q_candidate_diagnostics(spark, sf_dir):
    """Rows read, aligned, filled and the mismatch of each prediction file."""
    rows = [tuple(d.values()) for _, _, d in _candidate_files(spark, sf_dir)[1]]   # one per file
    return spark.createDataFrame(rows, cd.DIAGNOSTICS)


_MCOLS = ["actual_units", "predicted_units", "mae", "rmse", "wape", "bias", "underprediction_units",
          "overprediction_units", "price_weighted_abs_error", "purchase_cost_proxy", "holding_cost_proxy"]
cte("cand_sum", f"""
with p as (select date, warehouse, sku_cluster_ID, model_id, approach, prediction_level, model_name, family,
             predicted_demand from cand_aligned)
select model_id, approach, prediction_level, model_name, family,
  sum(demand) as actual_units, sum(predicted_demand) as predicted_units, avg(abs_error) as mae,
  sqrt(avg(prediction_error * prediction_error)) as rmse,
  case when sum(demand) <> 0 then sum(abs_error) / sum(demand) end as wape,
  case when sum(demand) <> 0 then sum(prediction_error) / sum(demand) end as bias,
  sum(underprediction) as underprediction_units, sum(overprediction) as overprediction_units,
  sum(abs_error * p_s) as price_weighted_abs_error, sum(underprediction * p_s * {config.SHORTAGE_COST_U}) as purchase_cost_proxy,
  sum(overprediction * p_s * {config.HOLDING_COST_H}) as holding_cost_proxy
from (select a.demand, p.*, coalesce(c.p_s, 0.0) as p_s, p.predicted_demand - a.demand as prediction_error,
        abs(p.predicted_demand - a.demand) as abs_error, -least(p.predicted_demand - a.demand, 0.0) as underprediction,
        greatest(p.predicted_demand - a.demand, 0.0) as overprediction
      from opt_test a join p on a.date = p.date and a.warehouse = p.warehouse and a.sku_cluster_ID = p.sku_cluster_ID
      left join cprice c on a.sku_cluster_ID = c.sku_cluster_ID)
group by all""", "cand_aligned", "opt_test", "cprice")

cte("cand_rank", """
select s.*, case when l.source_file = 'lag1_baseline' then 'Lag-1 Baseline'
                 else trim(l.model_name || ' ' || l.feature_set) end as candidate_label, l.source_file,
  s.purchase_cost_proxy + s.holding_cost_proxy as total_proxy_cost,
  row_number() over (order by s.wape nulls last, s.model_id) as forecast_wape_rank,
  dense_rank() over (order by s.purchase_cost_proxy + s.holding_cost_proxy) as forecast_proxy_cost_rank
from cand_sum s left join (select distinct model_id, model_name, feature_set, source_file from cand_aligned) l
  on s.model_id = l.model_id""", "cand_sum", "cand_aligned")


@query("candidate_ranking", sql(f"""
select model_id, approach, prediction_level, model_name, family, candidate_label, source_file, forecast_wape_rank,
  forecast_proxy_cost_rank, {", ".join(f"round({c}, 6) as {c}" for c in _MCOLS + ['total_proxy_cost'])}
from cand_rank""", "cand_rank"))
def q_candidate_ranking(spark, sf_dir):
    """E10+W10: candidate forecasts ranked by WAPE and (dense) proxy cost."""
    i, aligned = _candidates(spark, sf_dir)
    summary = ev.model_summary(ev.join_actual(i.test, aligned, i.cprice()))
    return cd.candidate_ranking(summary, aligned)


@query("candidate_best", sql("""
select arg_min(candidate_label, forecast_wape_rank) as best_by_wape,
  arg_min(candidate_label, (total_proxy_cost, model_id)) as best_by_proxy_cost,
  round(min(wape), 6) as best_wape, round(min(total_proxy_cost), 6) as best_total_proxy_cost, count(*) as models_tested,
  cast(arg_min(candidate_label, forecast_wape_rank) = arg_min(candidate_label, (total_proxy_cost, model_id)) as integer)
    as best_wape_matches_best_cost
from cand_rank""", "cand_rank"))
def q_candidate_best(spark, sf_dir):
    """E11+K3: best candidate by WAPE and by proxy cost; do they agree."""
    i, aligned = _candidates(spark, sf_dir)
    summary = ev.model_summary(ev.join_actual(i.test, aligned, i.cprice()))
    return cd.best_by(cd.candidate_ranking(summary, aligned))


_ORDER = ("purchase_cost_proxy + holding_cost_proxy nulls last, purchase_cost_proxy nulls last, wape nulls last, "
          "rmse nulls last, mae nulls last, model_id")
cte("selected_id", f"""
with s as (select *, coalesce(wape <= 0.45 and bias >= -0.15 and bias <= 0.15, false) as el from vsum),
p as (select * from s where el or (select count_if(el) from s) = 0)
select model_id from p order by {_ORDER} limit 1""", "vsum")

_PREV_VALUES = ", ".join(f"('{k}', cast({v!r} as double))" for k, v in PREVIOUS_METRICS.items())


@query("metric_delta", sql(f"""
with cur as (select * from tsum where model_id in (select model_id from selected_id)),
c as (unpivot cur on {", ".join(PREVIOUS_METRICS)} into name metric value current_value),
prev as (select * from (values {_PREV_VALUES}) v(metric, previous_value))
select prev.metric, round(prev.previous_value, 6) as previous_value, round(c.current_value, 6) as current_value,
  round(c.current_value - prev.previous_value, 6) as delta
from prev left join c on prev.metric = c.metric""", "tsum", "selected_id"))
def q_metric_delta(spark, sf_dir):
    """Published previous-version metrics vs the selected model's test
    metrics, long form with deltas."""
    i = Inputs(spark, sf_dir)
    sel = ev.model_selection(ev.model_summary(i.merged_valid())).filter("is_selected = 1").select("model_id")
    cur = ev.model_summary(i.merged_test()).join(sel, "model_id", "left_semi")
    return ev.metric_delta(PREVIOUS_METRICS, cur)


@query("consistency_check", sql("""
with raw as (select order_date as date, dc_des as warehouse, sum(quantity) as raw_total from win_lines group by all),
pan as (select date, warehouse, sum(demand) as panel_total from opt_full group by all),
j as (select coalesce(raw.date, pan.date) as date, coalesce(raw_total, 0.0) as raw_total, coalesce(panel_total, 0.0) as panel_total
      from raw full join pan on raw.date = pan.date and raw.warehouse = pan.warehouse)
select round(max(abs(raw_total - panel_total)), 6) as max_abs_diff, count(*) as compared_rows,
  count(distinct case when raw_total <> 0 then date end) as raw_dates, count(distinct date) as panel_dates from j""",
                                  "win_lines", "opt_full"))
def q_consistency_check(spark, sf_dir):
    """Raw order totals vs dense panel totals per (date, dc)."""
    i = Inputs(spark, sf_dir)
    return cd.consistency_check(i.lines, i.full)


@query("lag1_diagnostics", sql("""
with f as (select * from lag1b where date = date '1998-03-25'),
p as (select warehouse, sku_cluster_ID from opt_full where date = date '1998-03-24')
select metric, value from (
  select 'aligned_rows' as metric, cast(count(*) as double) as value, 1 as o from lag1b union all
  select 'rows_with_zero_lag', cast(count_if(predicted_demand = 0) as double), 2 from lag1b union all
  select 'first_day_rows_with_missing_prior_actual', cast(count_if(p.warehouse is null) as double), 3
  from f left join p on f.warehouse = p.warehouse and f.sku_cluster_ID = p.sku_cluster_ID)""", "lag1b", "opt_full"))
def q_lag1_diagnostics(spark, sf_dir):
    """E14+W8: lag-1 baseline diagnostics as (metric, value) rows."""
    i = Inputs(spark, sf_dir)
    return cd.lag1_diagnostics(fc.lag1_baseline(i.train, i.test), i.full, config.TEST_START)


@query("date_coverage", sql("""
select 'orders' as "table", min(cast(order_date as date)) as min_date, max(cast(order_date as date)) as max_date,
  count(*) as rows from order_lines
union all select 'clicks', min(cast(request_time as date)), max(cast(request_time as date)), count(*) from clicks
union all select 'funnel_orders', min(cast(order_time as date)), max(cast(order_time as date)), count(*) from funnel_orders
union all select 'delivery', min(cast(ship_out_time as date)), max(cast(ship_out_time as date)), count(*) from delivery
union all select 'inventory', min(cast(date as date)), max(cast(date as date)), count(*) from inventory""",
                              "order_lines", "clicks", "funnel_orders", "delivery", "inventory"))
def q_date_coverage(spark, sf_dir):
    """Date span and row count of every bound table."""
    t = bind(spark, sf_dir)
    return cd.date_coverage({"orders": (t.orders(), "order_date"), "clicks": (t.clicks(), "request_time"),
                             "funnel_orders": (t.funnel_orders(), "order_time"),
                             "delivery": (t.delivery(), "ship_out_time"), "inventory": (t.inventory(), "date")})


# Required columns per logical table (load validation).
REQUIRED = {
    "orders": ["sku_ID", "order_date", "quantity", "final_unit_price", "original_unit_price",
               "direct_discount_per_unit", "quantity_discount_per_unit", "bundle_discount_per_unit",
               "coupon_discount_per_unit", "gift_item", "dc_des"],
    "clicks": ["user_ID", "sku_ID", "request_time", "channel"],
    "users": ["user_ID"],
    "skus": ["sku_ID", "type"],
    "network": ["dc_ID", "region_ID"],
    "inventory": ["dc_ID", "sku_ID", "date"],
    "delivery": ["order_ID", "ship_out_time", "arr_station_time", "arr_time"],
}


@query("load_report", sql("""
select 'orders' as "table", count(*) as rows, '' as missing_columns from order_lines
union all select 'clicks', count(*), '' from clicks union all select 'users', count(*), '' from users
union all select 'skus', count(*), '' from sku union all select 'network', count(*), '' from network
union all select 'inventory', count(*), '' from inventory union all select 'delivery', count(*), '' from delivery""",
                            "order_lines", "clicks", "users", "sku", "network", "inventory", "delivery"))
def q_load_report(spark, sf_dir):
    """S4+S5: row counts and missing required columns per bound table."""
    t = bind(spark, sf_dir)
    frames = {"orders": t.orders(), "clicks": t.clicks(), "users": t.users(), "skus": t.sku(),
              "network": t.network(), "inventory": t.inventory(), "delivery": t.delivery()}
    return cd.load_report({k: (v, REQUIRED[k]) for k, v in frames.items()})


# ----------------------------------------------------------------- notebook parameters and cluster comparison

from skupulse.functions.exprs import clean_orders  # noqa: E402
from skupulse.operators import panel  # noqa: E402
from skupulse.operators.grid import densify, dim_product  # noqa: E402
from skupulse.plans import q_demand  # noqa: E402,F401  (registers region CTEs)


def _month_mean(facts, key: str, value: str, out: str):
    """Sum by (date, key, cluster), dense over the whole month x observed
    keys x observed clusters, mean per (cluster, key)."""
    keys = dim_product([facts.select(key).filter(F.col(key).isNotNull()).distinct(),
                        facts.select("sku_cluster_ID").filter(F.col("sku_cluster_ID").isNotNull()).distinct()])
    g = densify(facts, keys, "date", config.WINDOW_START, config.WINDOW_END, [value], [key, "sku_cluster_ID"])
    return g.groupBy("sku_cluster_ID", key).agg(F.avg(value).alias(out))


@query("demand_param_month", sql("""
with d as (select order_date as date, dc_des as warehouse, sku_cluster_ID, sum(demand) as demand
           from (select * from wh_grid_train union all select * from wh_grid_test) group by all),
g as (select cast(ds.d as date) as date, w.warehouse, k.sku_cluster_ID
      from generate_series(timestamp '1998-03-01', timestamp '1998-03-31', interval 1 day) ds(d)
      cross join (select distinct warehouse from d where warehouse is not null) w
      cross join (select distinct sku_cluster_ID from d where sku_cluster_ID is not null) k)
select g.sku_cluster_ID, g.warehouse, round(avg(coalesce(d.demand, 0.0)), 6) as D_sj
from g left join d on g.date = d.date and g.warehouse = d.warehouse and g.sku_cluster_ID = d.sku_cluster_ID
group by all""", "wh_grid_train", "wh_grid_test"))
def q_demand_param_month(spark, sf_dir):
    """D_sj = mean daily demand over the month's dense panel."""
    from skupulse.plans.q_panel import test_grid, train_grid, window_facts
    shared = window_facts(spark, sf_dir)
    facts = train_grid(spark, sf_dir, shared).unionByName(test_grid(spark, sf_dir, shared)).select(
        F.col("order_date").alias("date"), F.col("dc_des").alias("warehouse"), "sku_cluster_ID", "demand")
    return _month_mean(facts, "warehouse", "demand", "D_sj")


@query("inventory_param_month", sql("""
with d as (select i.date, i.dc_ID as warehouse, c.sku_cluster_ID, cast(count(*) as double) as units
           from inventory i join clusters c on i.sku_ID = c.sku_ID
           where i.date between date '1998-03-01' and date '1998-03-31' group by all),
g as (select cast(ds.d as date) as date, w.warehouse, k.sku_cluster_ID
      from generate_series(timestamp '1998-03-01', timestamp '1998-03-31', interval 1 day) ds(d)
      cross join (select distinct warehouse from d) w cross join (select distinct sku_cluster_ID from d) k)
select g.sku_cluster_ID, g.warehouse, round(avg(coalesce(d.units, 0.0)), 6) as I0_sj
from g left join d on g.date = d.date and g.warehouse = d.warehouse and g.sku_cluster_ID = d.sku_cluster_ID
group by all""", "inventory", "clusters"))
def q_inventory_param_month(spark, sf_dir):
    """I0_sj = mean daily in-stock rows (one unit each) per (cluster, dc)."""
    t = bind(spark, sf_dir)
    inv = t.inventory().filter(F.col("date").between(F.lit(config.WINDOW_START), F.lit(config.WINDOW_END)))
    facts = share(inv.join(t.clusters(), "sku_ID").groupBy("date", F.col("dc_ID").alias("warehouse"), "sku_cluster_ID")
                  .agg(F.count(F.lit(1)).cast("double").alias("units")))
    return _month_mean(facts, "warehouse", "units", "I0_sj")


@query("sku_metrics_by_cluster", sql("""
select c.sku_cluster_ID, o.sku_ID, round(sum(o.quantity), 6) as total_demand, round(avg(o.final_unit_price), 6) as mean_price
from order_lines o join clusters c on o.sku_ID = c.sku_ID group by all""", "order_lines", "clusters"))
def q_sku_metrics_by_cluster(spark, sf_dir):
    """Total demand and mean price per (cluster, SKU)."""
    t = bind(spark, sf_dir)
    return (panel.attach_cluster(t.orders(columns=["sku_ID", "quantity", "final_unit_price"]), t.clusters()).groupBy("sku_cluster_ID", "sku_ID")
            .agg(F.sum("quantity").alias("total_demand"), F.avg("final_unit_price").alias("mean_price")))


@query("region_date_demand", sql("""
select order_date, region_ID, round(sum(demand), 6) as demand from region_grid_a group by all""", "region_grid_a"))
def q_region_date_demand(spark, sf_dir):
    """Region x date demand (long form of the heat-map pivot)."""
    t = bind(spark, sf_dir)
    g = panel.region_grid(t.orders(columns=["sku_ID", "dc_des", "order_date", "quantity"]), t.clusters(), t.network())
    return g.groupBy("order_date", "region_ID").agg(F.sum("demand").alias("demand"))


@query("cluster_region_matrix", sql("""
select sku_cluster_ID, region_ID, round(count_if(demand = 0) / count(*), 6) as zero_rate,
  round(stddev_samp(demand) / nullif(avg(demand), 0), 6) as cv
from region_grid_a group by all""", "region_grid_a"))
def q_cluster_region_matrix(spark, sf_dir):
    """Cluster x region zero rate and cv (long form of the pivots)."""
    t = bind(spark, sf_dir)
    m = panel.series_metrics(panel.region_grid(t.orders(columns=["sku_ID", "dc_des", "order_date", "quantity"]), t.clusters(), t.network()), "region_ID", zero_fill=False)
    return m.select("sku_cluster_ID", "region_ID", "zero_rate", "cv")


# ----------------------------------------------------------------- loading text tables

@query("load_rejects", sql("""
select 'clicks' as "table", count(*) as rows, count_if(user_id % 97 = 0 and event_type in ('click', 'view')) as rejected,
  count_if(user_id % 89 = 0 and user_id % 97 <> 0) as coerced from events where event_type in ('click', 'view')
union all
select 'users', count(*), 0, count_if(c_custkey % 50 = 0) from customer""", ))
def q_load_rejects(spark, sf_dir):
    """S7+S3: clicks and users written as text, with some bad cells, and loaded by
    their declared columns: rows, rejected rows (a strict column does not parse)
    and coerced cells (a lenient one becomes null)."""
    t = bind(spark, sf_dir)
    number = F.regexp_replace("user", "[^0-9]", "").cast("long")
    raw = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view")).select(
        F.col("user_id").cast("string").alias("user"), F.col("ts").cast("string").alias("request_time"), _sku_from_props().cast("string").alias("sku_ID"),
        F.col("event_type").alias("channel"))
    texts = {
        "clicks": raw.select(F.col("user").alias(" user_ID"), F.when(number % 89 == 0, "none").otherwise(F.col("sku_ID")).alias("sku_ID "),
                             F.when(number % 97 == 0, "not a time").otherwise(F.col("request_time")).alias("request_time"), "channel",
                             F.lit("unused").alias("extra")),
        "users": t.users().select("user_ID", F.when(F.col("user_ID").cast("long") % 50 == 0, "x").otherwise("3").alias("level"), "region")}
    out = []
    for name, df in texts.items():
        path = f"{checkpoint_dir(spark)}/text-{uuid.uuid4().hex}"
        loaders.write_result(df, path, csv=True)
        out.append(loaders.load_logical(spark, path, name)[1])
    return union_all(out)
