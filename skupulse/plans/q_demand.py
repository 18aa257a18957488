"""Registered queries: demand exploration, SKU features, region panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from skupulse import config
from skupulse.functions.exprs import clean_orders
from skupulse.operators import panel, stats
from skupulse.operators.ordered import histogram
from skupulse.plans.oracle import cte, sql
from skupulse.plans.registry import query
from skupulse.session import share
from skupulse.sources.fixtures import DEMAND_COLUMNS, bind, clicks_daily_shifted, clusters_alt

cte("daily_region", """
select o.sku_ID, o.order_date as date, n.region_ID as region_id, sum(o.quantity) as demand
from order_lines o left join network n on o.dc_des = n.dc_ID group by all""", "order_lines", "network")
cte("daily_dc", """
select sku_ID, order_date as date, dc_des, sum(quantity) as demand from order_lines group by all""", "order_lines")
cte("clicks_daily_shift", """
select sku_ID, date '1998-03-01' + cast(cast(request_time as date) - date '2024-01-01' as integer) as order_date,
  count(*) as daily_clicks from clicks group by all""", "clicks")
cte("clusters_b", "select p_partkey as sku_ID, p_size % 5 as sku_cluster_ID from part where p_partkey % 50 <> 0")

_PCTS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def _daily(spark, sf_dir, key):
    t = bind(spark, sf_dir)
    return panel.daily_demand(t.orders(columns=["sku_ID", "order_date", "dc_des", "quantity"]), t.network(), key)


def _sparsity_sql(tbl, key):
    return sql(f"""
select count(distinct sku_ID) + max(cast(sku_ID is null as integer)) as n_sku_ID,
  count(distinct date) + max(cast(date is null as integer)) as n_date,
  count(distinct {key}) + max(cast({key} is null as integer)) as n_{key},
  count(*) as nonzero_rows,
  cast((count(distinct sku_ID) + max(cast(sku_ID is null as integer))) * (count(distinct date) + max(cast(date is null as integer)))
    * (count(distinct {key}) + max(cast({key} is null as integer))) as bigint) as total_possible,
  round(count(*) / ((count(distinct sku_ID) + max(cast(sku_ID is null as integer))) * (count(distinct date) + max(cast(date is null as integer)))
    * (count(distinct {key}) + max(cast({key} is null as integer)))), 6) as density,
  round(1 - count(*) / ((count(distinct sku_ID) + max(cast(sku_ID is null as integer))) * (count(distinct date) + max(cast(date is null as integer)))
    * (count(distinct {key}) + max(cast({key} is null as integer)))), 6) as sparsity
from {tbl}""", tbl)


def _variance_sql(tbl, key):
    return f"""
select sku_ID, {key}, count(demand) as count, avg(demand) as mean, stddev_samp(demand) as std,
  min(demand) as min, max(demand) as max, stddev_samp(demand) / nullif(avg(demand), 0) as cv
from {tbl} where sku_ID is not null and {key} is not null group by sku_ID, {key}"""


def _variance_out(tbl, key):
    return sql(f"""
select sku_ID, {key}, count, round(mean, 6) as mean, round(std, 6) as std, round(min, 6) as min,
  round(max, 6) as max, round(cv, 6) as cv from ({_variance_sql(tbl, key)})""", tbl)


def _variance_summary_sql(tbl, key):
    return sql(f"""
select round(avg(cv), 6) as cv_mean, round(quantile_cont(cv, 0.5), 6) as cv_median,
  round(avg(cast(coalesce(cv < 0.1, false) as double)), 6) as share_cv_lt_0_1,
  round(avg(cast(coalesce(cv < 0.2, false) as double)), 6) as share_cv_lt_0_2,
  round(avg(mean), 6) as mean_of_means, round(quantile_cont(mean, 0.5), 6) as median_of_means,
  round(max(max), 6) as max_demand, count(*) as groups
from ({_variance_sql(tbl, key)})""", tbl)


def _describe_sql(tbl):
    ps = ", ".join(f"round(quantile_cont(demand, {p}), 6) as {stats.pct_name(p)}" for p in _PCTS)
    return sql(f"""
select count(demand) as count, round(avg(demand), 6) as mean, round(stddev_samp(demand), 6) as std,
  round(min(demand), 6) as min, {ps}, round(max(demand), 6) as max from {tbl}""", tbl)


@query("demand_sku_day_region", sql("select sku_ID, date, region_id, round(demand, 6) as demand from daily_region",
                                    "daily_region"))
def q_demand_sku_day_region(spark, sf_dir):
    """A8+J3: daily demand by SKU and destination region (null keys kept)."""
    return _daily(spark, sf_dir, "region_id")


@query("demand_sku_day_dc", sql("select sku_ID, date, dc_des, round(demand, 6) as demand from daily_dc", "daily_dc"))
def q_demand_sku_day_dc(spark, sf_dir):
    """Daily demand by SKU and destination DC."""
    return _daily(spark, sf_dir, "dc_des")


@query("sparsity_region", _sparsity_sql("daily_region", "region_id"))
def q_sparsity_region(spark, sf_dir):
    """Sparsity of the sku x date x region demand table."""
    return stats.sparsity_metrics(_daily(spark, sf_dir, "region_id"), ["sku_ID", "date", "region_id"])


@query("sparsity_dc", _sparsity_sql("daily_dc", "dc_des"))
def q_sparsity_dc(spark, sf_dir):
    """Sparsity of the sku x date x dc demand table."""
    return stats.sparsity_metrics(_daily(spark, sf_dir, "dc_des"), ["sku_ID", "date", "dc_des"])


@query("variance_dc", _variance_out("daily_dc", "dc_des"))
def q_variance_dc(spark, sf_dir):
    """A10: per (sku, dc) demand count/mean/std/min/max/cv."""
    return stats.variance_metrics(_daily(spark, sf_dir, "dc_des"), ["sku_ID", "dc_des"])


@query("variance_region", _variance_out("daily_region", "region_id"))
def q_variance_region(spark, sf_dir):
    """A10: per (sku, region) demand count/mean/std/min/max/cv."""
    return stats.variance_metrics(_daily(spark, sf_dir, "region_id"), ["sku_ID", "region_id"])


@query("variance_summary", _variance_summary_sql("daily_dc", "dc_des"))
def q_variance_summary(spark, sf_dir):
    """Cv summary over (sku, dc) series."""
    return stats.variance_summary(stats.variance_metrics(_daily(spark, sf_dir, "dc_des"), ["sku_ID", "dc_des"]))


@query("variance_summary_region", _variance_summary_sql("daily_region", "region_id"))
def q_variance_summary_region(spark, sf_dir):
    """Cv summary over (sku, region) series."""
    return stats.variance_summary(
        stats.variance_metrics(_daily(spark, sf_dir, "region_id"), ["sku_ID", "region_id"]))


@query("describe_demand", _describe_sql("daily_dc"))
def q_describe_demand(spark, sf_dir):
    """describe() of daily sku x dc demand with 9 percentiles."""
    return stats.describe(_daily(spark, sf_dir, "dc_des"), "demand", _PCTS)


@query("describe_demand_region", _describe_sql("daily_region"))
def q_describe_demand_region(spark, sf_dir):
    """describe() of daily sku x region demand with 9 percentiles."""
    return stats.describe(_daily(spark, sf_dir, "region_id"), "demand", _PCTS)


@query("active_skus", sql("select date, count(distinct sku_ID) as active_skus from daily_dc group by date",
                          "daily_dc"))
def q_active_skus(spark, sf_dir):
    """Active SKUs per day."""
    return panel.active_skus(_daily(spark, sf_dir, "dc_des"))


@query("histogram", sql("""
with x as (select ln(1 + demand) as x from daily_dc where demand is not null),
r as (select case when min(x) = max(x) then min(x) - 0.5 else min(x) end as lo,
             case when min(x) = max(x) then max(x) + 0.5 else max(x) end as hi from x),
c as (select least(cast(floor((x - lo) / ((hi - lo) / 50)) as integer), 49) as bin, count(*) as cnt from x, r group by 1)
select b.bin, round(lo + b.bin * ((hi - lo) / 50), 6) as bin_start, round(lo + (b.bin + 1) * ((hi - lo) / 50), 6) as bin_end,
  coalesce(c.cnt, 0) as count
from (select cast(range as integer) as bin from range(50)) b cross join r left join c on b.bin = c.bin""", "daily_dc"))
def q_histogram(spark, sf_dir):
    """A54+C15: 50-bin histogram of log1p(daily sku x dc demand)."""
    d = _daily(spark, sf_dir, "dc_des").select(F.log1p("demand").alias("x"))
    return histogram(d, "x", 50)


cte("daily_sku_all", """
select sku_ID, order_date, sum(quantity) as daily_demand, avg(final_unit_price) as avg_final_price,
  avg(original_unit_price) as avg_original_price, avg(total_discount_per_unit) as avg_discount,
  max(promo_line_flag) as promo_flag
from clean_lines group by sku_ID, order_date""", "clean_lines")


@query("daily_sku", sql("""
select sku_ID, order_date, round(daily_demand, 6) as daily_demand, round(avg_final_price, 6) as avg_final_price,
  round(avg_original_price, 6) as avg_original_price, round(avg_discount, 6) as avg_discount, promo_flag
from daily_sku_all""", "daily_sku_all"))
def q_daily_sku(spark, sf_dir):
    """Daily SKU aggregate over all order lines."""
    return panel.daily_sku(clean_orders(bind(spark, sf_dir).orders(columns=DEMAND_COLUMNS)))


@query("sku_features_price", sql("""
with f as (select sku_ID, avg(avg_final_price) as mean_price, coalesce(stddev_samp(avg_final_price), 0.0) as std_price,
             avg(avg_discount) as mean_discount, avg(promo_flag) as promo_rate from daily_sku_all group by sku_ID),
s as (select min(order_date) as d0, max(order_date) as d1 from daily_sku_all),
c as (select k.sku_ID, sum(k.daily_clicks) as clicks from clicks_daily_shift k, s
      where k.order_date between s.d0 and s.d1 group by k.sku_ID)
select f.sku_ID, round(mean_price, 6) as mean_price, round(std_price, 6) as std_price,
  round(mean_discount, 6) as mean_discount, round(promo_rate, 6) as promo_rate,
  round(coalesce(c.clicks, 0) / (s.d1 - s.d0 + 1), 6) as mean_daily_clicks
from f cross join s left join c on f.sku_ID = c.sku_ID""", "daily_sku_all", "clicks_daily_shift"))
def q_sku_features_price(spark, sf_dir):
    """SKU price/promo features (+ mean daily clicks on the dense grid)."""
    t = bind(spark, sf_dir)
    daily = share(panel.daily_sku(clean_orders(t.orders(columns=DEMAND_COLUMNS))))
    return panel.sku_price_features(daily, clicks_daily_shifted(t.clicks()))


cte("skufeat", """
with g as (select s.sku_ID, cast(d.d as date) as order_date
           from (select distinct sku_ID from train_lines) s
           cross join generate_series(timestamp '1998-03-01', timestamp '1998-03-24', interval 1 day) d(d)),
dd as (select sku_ID, order_date, sum(quantity) as daily_demand, count(distinct dc_des) as daily_warehouses
       from train_lines group by all),
p as (select g.sku_ID, coalesce(dd.daily_demand, 0.0) as daily_demand, coalesce(dd.daily_warehouses, 0) as daily_warehouses,
        coalesce(k.daily_clicks, 0) as daily_clicks
      from g left join dd on g.sku_ID = dd.sku_ID and g.order_date = dd.order_date
      left join clicks_daily_shift k on g.sku_ID = k.sku_ID and g.order_date = k.order_date),
dm as (select sku_ID, avg(daily_demand) as mean_daily_demand, coalesce(stddev_samp(daily_demand), 0.0) as std_daily_demand,
         avg(cast(daily_demand = 0 as double)) as zero_rate, avg(daily_warehouses) as mean_daily_warehouses,
         avg(daily_clicks) as mean_daily_clicks, avg(cast(daily_clicks = 0 as double)) as zero_click_rate
       from p group by sku_ID),
a as (select sku_ID, avg(final_unit_price) as mean_price, coalesce(stddev_samp(final_unit_price), 0.0) as std_price,
        avg(total_discount_per_unit) as mean_discount, avg(promo_line_flag) as promo_rate_active,
        count(distinct dc_des) as warehouse_count from train_lines group by sku_ID)
select dm.sku_ID, mean_daily_demand, std_daily_demand, zero_rate, mean_daily_warehouses,
  coalesce(std_daily_demand / nullif(mean_daily_demand, 0), 0.0) as cv_daily_demand,
  mean_price, std_price, mean_discount, promo_rate_active, cast(warehouse_count as double) as warehouse_count,
  mean_daily_clicks, zero_click_rate
from dm left join a on dm.sku_ID = a.sku_ID""", "train_lines", "clicks_daily_shift")

SKUFEAT_COLS = ["mean_daily_demand", "std_daily_demand", "zero_rate", "mean_daily_warehouses", "cv_daily_demand",
                 "mean_price", "std_price", "mean_discount", "promo_rate_active", "warehouse_count",
                 "mean_daily_clicks", "zero_click_rate"]


@query("sku_features_demand", sql("select sku_ID, " + ", ".join(f"round({c}, 6) as {c}" for c in SKUFEAT_COLS)
                                        + " from skufeat", "skufeat"))
def q_sku_features_demand(spark, sf_dir):
    """SKU demand-shape + price + click features on the train window."""
    t = bind(spark, sf_dir)
    lines = share(panel.in_range(clean_orders(t.window_orders(DEMAND_COLUMNS), clip_quantity=True),
                                 config.TRAIN_START, config.TRAIN_END).select(
        "sku_ID", "order_date", "dc_des", "quantity", "final_unit_price", "total_discount_per_unit", "promo_line_flag"))
    return panel.sku_demand_features(lines, config.TRAIN_START, config.TRAIN_END, clicks_daily_shifted(t.clicks()))


def _region_grid_cte(name, mapping):
    cte(name, f"""
with m as (select o.order_date, n.region_ID, c.sku_cluster_ID, o.quantity from order_lines o
           join {mapping} c on o.sku_ID = c.sku_ID join network n on o.dc_des = n.dc_ID
           where o.order_date is not null),
s as (select min(order_date) as d0, max(order_date) as d1 from m)
select g.order_date, g.region_ID, g.sku_cluster_ID, coalesce(d.demand, 0.0) as demand
from (select cast(unnest(generate_series(cast(s.d0 as timestamp), cast(s.d1 as timestamp), interval 1 day)) as date) as order_date,
        r.region_ID, k.sku_cluster_ID
      from s, (select distinct region_ID from m) r, (select distinct sku_cluster_ID from m) k) g
left join (select order_date, region_ID, sku_cluster_ID, sum(quantity) as demand from m group by all) d
  on g.order_date = d.order_date and g.region_ID = d.region_ID and g.sku_cluster_ID = d.sku_cluster_ID""",
        "order_lines", mapping, "network")
    cte(name + "_sum", f"""
with mt as (select sku_cluster_ID, region_ID, count(*) as total_days, count_if(demand = 0) as zero_days,
              avg(demand) as mean_demand, stddev_samp(demand) as std_demand from {name} group by all),
m2 as (select *, zero_days / total_days as zero_rate, std_demand / nullif(mean_demand, 0) as cv from mt),
m3 as (select *, cast(zero_rate >= 0.7 as integer) as high_sparsity,
         cast(coalesce(std_demand, 0) = 0 or coalesce(cv, 0) < 0.1 as integer) as low_variance from m2)
select sku_cluster_ID, count(distinct region_ID) as regions, count(*) as series,
  cast(sum(high_sparsity) as bigint) as high_sparsity_series, cast(sum(low_variance) as bigint) as low_variance_series,
  avg(zero_rate) as avg_zero_rate, avg(cv) as avg_cv,
  sum(high_sparsity) / count(*) as high_sparsity_share, sum(low_variance) / count(*) as low_variance_share
from m3 group by sku_cluster_ID""", name)
    cte(name + "_overall", f"""
select (select avg(cast(c.sku_cluster_ID is null as double)) from order_lines o left join {mapping} c on o.sku_ID = c.sku_ID)
    as missing_cluster_rate,
  (select avg(cast(n.region_ID is null as double)) from order_lines o left join network n on o.dc_des = n.dc_ID)
    as missing_region_rate,
  (select min(order_date) from {name}) as date_start, (select max(order_date) from {name}) as date_end,
  (select cast(max(order_date) - min(order_date) + 1 as integer) from {name}) as days,
  count(distinct sku_cluster_ID) as clusters, avg(high_sparsity_share) as avg_high_sparsity_share,
  avg(low_variance_share) as avg_low_variance_share,
  count_if(high_sparsity_share >= 0.5) as clusters_high_sparsity_majority,
  count_if(low_variance_share >= 0.5) as clusters_low_variance_majority,
  avg(high_sparsity_share) + avg(low_variance_share) as score
from {name}_sum""", name + "_sum", "order_lines", mapping, "network")


_region_grid_cte("region_grid_a", "clusters")
_region_grid_cte("region_grid_b", "clusters_b")


def _orders_all(spark, sf_dir):
    return bind(spark, sf_dir).orders(columns=["sku_ID", "dc_des", "order_date", "quantity"])


@query("region_grid", sql("select order_date, region_ID, sku_cluster_ID, round(demand, 6) as demand from region_grid_a",
                          "region_grid_a"))
def q_region_grid(spark, sf_dir):
    """Dense (date, region, cluster) demand over the full order span."""
    t = bind(spark, sf_dir)
    return panel.region_grid(_orders_all(spark, sf_dir), t.clusters(), t.network())


@query("region_summary", sql("""
select sku_cluster_ID, regions, series, high_sparsity_series, low_variance_series, round(avg_zero_rate, 6) as avg_zero_rate,
  round(avg_cv, 6) as avg_cv, round(high_sparsity_share, 6) as high_sparsity_share,
  round(low_variance_share, 6) as low_variance_share from region_grid_a_sum""", "region_grid_a_sum"))
def q_region_summary(spark, sf_dir):
    """Per-cluster summary over (cluster, region) series; null cv kept."""
    t = bind(spark, sf_dir)
    return panel.region_summary(panel.region_grid(_orders_all(spark, sf_dir), t.clusters(), t.network()))


@query("region_overall", sql("""
select round(missing_cluster_rate, 6) as missing_cluster_rate, round(missing_region_rate, 6) as missing_region_rate,
  date_start, date_end, days, clusters, round(avg_high_sparsity_share, 6) as avg_high_sparsity_share,
  round(avg_low_variance_share, 6) as avg_low_variance_share, clusters_high_sparsity_majority,
  clusters_low_variance_majority, round(score, 6) as score from region_grid_a_overall""", "region_grid_a_overall"))
def q_region_overall(spark, sf_dir):
    """Overall region-panel statistics for scheme A."""
    t = bind(spark, sf_dir)
    return panel.region_overall(_orders_all(spark, sf_dir), t.clusters(), t.network())


@query("scheme_recommendation", sql("""
select round(a.score, 6) as score_a, round(b.score, 6) as score_b,
  case when a.score < b.score then 'A' when b.score < a.score then 'B' else 'tie' end as winner
from region_grid_a_overall a, region_grid_b_overall b""", "region_grid_a_overall", "region_grid_b_overall"))
def q_scheme_recommendation(spark, sf_dir):
    """Compare two cluster schemes on the region panel."""
    t = bind(spark, sf_dir)
    schemes = {"A": t.clusters(), "B": clusters_alt(spark, sf_dir)}
    return panel.scheme_recommendation(panel.region_overalls(
        panel.region_facts(_orders_all(spark, sf_dir), schemes, t.network())))
