"""Registered queries: demand panels and stability metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skupulse import config
from skupulse.functions.exprs import clean_orders
from skupulse.operators import panel
from skupulse.plans.oracle import sql
from skupulse.plans.registry import query
from skupulse.session import share
from skupulse.sources.fixtures import DEMAND_COLUMNS, bind


def window_lines(spark, sf_dir):
    return clean_orders(bind(spark, sf_dir).window_orders(DEMAND_COLUMNS))


def window_facts(spark, sf_dir):
    """The month's demand by (date, warehouse, cluster): one scan for both splits."""
    return panel.demand_facts(window_lines(spark, sf_dir), bind(spark, sf_dir).clusters(),
                              config.WINDOW_START, config.WINDOW_END)


def train_grid(spark, sf_dir, facts=None):
    facts = window_facts(spark, sf_dir) if facts is None else facts
    return panel.facts_grid(facts, bind(spark, sf_dir).clusters(), config.TRAIN_START, config.TRAIN_END)


def test_grid(spark, sf_dir, facts=None):
    facts = window_facts(spark, sf_dir) if facts is None else facts
    return panel.facts_grid(facts, bind(spark, sf_dir).clusters(), config.TEST_START, config.TEST_END)


@query("demand_grid_wh", sql(
    "select order_date, dc_des, sku_cluster_ID, round(demand, 6) as demand from wh_grid_train",
    "wh_grid_train"))
def q_demand_grid_wh(spark, sf_dir):
    """A16+D2: dense train-window demand by (date, warehouse, cluster)."""
    return train_grid(spark, sf_dir)


@query("demand_grid_wh_test", sql(
    "select order_date, dc_des, sku_cluster_ID, round(demand, 6) as demand from wh_grid_test",
    "wh_grid_test"))
def q_demand_grid_wh_test(spark, sf_dir):
    """A16+D2 on the 7-day test window."""
    return test_grid(spark, sf_dir)


@query("series_metrics", sql("""
select sku_cluster_ID, dc_des, total_days, zero_days, round(mean_demand, 6) as mean_demand,
  round(std_demand, 6) as std_demand, round(zero_rate, 6) as zero_rate, round(cv, 6) as cv,
  high_sparsity, low_variance from series_flags""", "series_flags"))
def q_series_metrics(spark, sf_dir):
    """Per (cluster, warehouse) series metrics and flags."""
    return panel.series_metrics(train_grid(spark, sf_dir))


@query("cluster_summary", sql("""
select sku_cluster_ID, warehouses, series, high_sparsity_series, low_variance_series,
  round(avg_zero_rate, 6) as avg_zero_rate, round(avg_cv, 6) as avg_cv,
  round(high_sparsity_share, 6) as high_sparsity_share, round(low_variance_share, 6) as low_variance_share
from cluster_sum""", "cluster_sum"))
def q_cluster_summary(spark, sf_dir):
    """Per-cluster summary of series flags."""
    return panel.cluster_summary(panel.series_metrics(train_grid(spark, sf_dir)))


@query("cluster_score", sql("""
select count(distinct sku_cluster_ID) as clusters, round(avg(avg_zero_rate), 6) as avg_zero_rate,
  round(avg(avg_cv), 6) as avg_cv, round(avg(high_sparsity_share), 6) as avg_high_sparsity_share,
  round(avg(low_variance_share), 6) as avg_low_variance_share,
  count_if(high_sparsity_share >= 0.5) as clusters_high_sparsity_majority,
  count_if(low_variance_share >= 0.5) as clusters_low_variance_majority,
  round(avg(high_sparsity_share) + avg(low_variance_share), 6) as objective
from cluster_sum""", "cluster_sum"))
def q_cluster_score(spark, sf_dir):
    """Overall clustering score (one row)."""
    return panel.cluster_score(panel.cluster_summary(panel.series_metrics(train_grid(spark, sf_dir))))


@query("cluster_features", sql("""
select o.sku_cluster_ID, o.sku_count, o.warehouse_count, o.order_lines, round(o.total_quantity, 6) as total_quantity,
  round(o.avg_price, 6) as avg_price, round(o.std_price, 6) as std_price,
  round(o.avg_original_price, 6) as avg_original_price, round(o.avg_discount, 6) as avg_discount,
  round(o.promotion_rate, 6) as promotion_rate, round(o.gift_rate, 6) as gift_rate,
  round(s.avg_cluster_warehouse_demand, 6) as avg_cluster_warehouse_demand,
  round(s.avg_cluster_warehouse_std, 6) as avg_cluster_warehouse_std,
  round(s.avg_zero_rate, 6) as avg_zero_rate, round(s.avg_cv, 6) as avg_cv,
  round(s.high_sparsity_share, 6) as high_sparsity_share, round(s.low_variance_share, 6) as low_variance_share
from (select c.sku_cluster_ID, count(distinct t.sku_ID) as sku_count, count(distinct t.dc_des) as warehouse_count,
        count(*) as order_lines, sum(t.quantity) as total_quantity, avg(t.final_unit_price) as avg_price,
        coalesce(stddev_samp(t.final_unit_price), 0.0) as std_price,
        avg(t.original_unit_price) as avg_original_price, avg(t.total_discount_per_unit) as avg_discount,
        avg(t.promo_line_flag) as promotion_rate, avg(t.gift_rate_flag) as gift_rate
      from train_lines t join clusters c on t.sku_ID = c.sku_ID group by c.sku_cluster_ID) o
left join (select sku_cluster_ID, avg(mean_demand) as avg_cluster_warehouse_demand,
             avg(std_demand) as avg_cluster_warehouse_std, avg(zero_rate) as avg_zero_rate, avg(cv) as avg_cv,
             avg(high_sparsity) as high_sparsity_share, avg(low_variance) as low_variance_share
           from series_flags group by sku_cluster_ID) s on o.sku_cluster_ID = s.sku_cluster_ID
""", "train_lines", "clusters", "series_flags"))
def q_cluster_features(spark, sf_dir):
    """Per-cluster order features joined to demand shape."""
    train = share(panel.in_range(window_lines(spark, sf_dir), config.TRAIN_START, config.TRAIN_END).select(
        "order_date", "sku_ID", "dc_des", "quantity", "final_unit_price", "original_unit_price", "total_discount_per_unit",
        "promo_line_flag", "gift_rate_flag"))
    clusters = bind(spark, sf_dir).clusters()
    grid = panel.demand_grid(train, clusters, config.TRAIN_START, config.TRAIN_END)
    return panel.cluster_features(train, clusters, grid)


@query("split_meta", sql("""
with d as (select distinct order_date from win_lines),
r as (select order_date, row_number() over (order by order_date) as ra,
        row_number() over (order by order_date desc) as rd from d),
s as (select order_date, case when ra <= 24 then 'train' when rd <= 7 then 'test' else 'unused' end as split from r),
n as (select order_date, count(*) as c from win_lines group by order_date)
select min(case when split='train' then s.order_date end) as train_start,
  max(case when split='train' then s.order_date end) as train_end,
  count_if(split='train') as train_days,
  min(case when split='test' then s.order_date end) as test_start,
  max(case when split='test' then s.order_date end) as test_end,
  count_if(split='test') as test_days, count_if(split='unused') as unused_days,
  cast(coalesce(sum(case when split='train' then c end), 0) as bigint) as train_rows,
  cast(coalesce(sum(case when split='test' then c end), 0) as bigint) as test_rows
from s left join n on s.order_date = n.order_date
""", "win_lines"))
def q_split_meta(spark, sf_dir):
    """D4+A56: distinct-date 24/7 split of the window and its metadata."""
    lines = share(window_lines(spark, sf_dir).groupBy("order_date").agg(F.count(F.lit(1)).alias("lines")))   # one row per day
    split, _, _ = panel.split_by_distinct_dates(lines)
    return panel.split_meta(lines, split)


_SCORES = ("objective", "avg_zero_rate", "avg_cv", "avg_high_sparsity_share", "avg_low_variance_share")


def _score_sql(role: str) -> str:
    """The score of one split in SQL, from its dense grid."""
    return f"""
{role}_series as (select sku_cluster_ID, dc_des, count_if(demand = 0) / count(*) as zero_rate, avg(demand) as m,
    coalesce(stddev_samp(demand), 0.0) as sd from wh_grid_{role} group by 1, 2),
{role}_flags as (select sku_cluster_ID, zero_rate, coalesce(sd / nullif(m, 0), 0.0) as cv, sd from {role}_series),
{role}_cluster as (select sku_cluster_ID, avg(zero_rate) as zero_rate, avg(cv) as cv,
    avg(cast(zero_rate >= 0.7 as integer)) as sparse, avg(cast(sd = 0.0 or cv < 0.1 as integer)) as flat
    from {role}_flags group by 1),
{role}_score as (select avg(sparse) + avg(flat) as objective, avg(zero_rate) as avg_zero_rate, avg(cv) as avg_cv,
    avg(sparse) as avg_high_sparsity_share, avg(flat) as avg_low_variance_share from {role}_cluster)"""


@query("model_summary", sql(f"""
with skus as (select sku_ID, max(cast(order_date <= date '1998-03-24' as integer)) as tr,
    max(cast(order_date >= date '1998-03-25' as integer)) as te from win_lines where sku_ID is not null group by 1),
counts as (select count_if(tr = 1) as train_skus, count_if(te = 1) as test_skus,
    count_if(te = 1 and tr = 0) as new_test_skus from skus),
days as (select distinct order_date from win_lines),
meta as (select min(order_date) as train_start, max(order_date) filter (order_date <= date '1998-03-24') as train_end,
    min(order_date) filter (order_date >= date '1998-03-25') as test_start, max(order_date) as test_end,
    count(*) - 31 as unused_days from days),
{_score_sql("train")},
{_score_sql("test")}
select meta.*, counts.*, {", ".join(f"round({r}_score.{c}, 6) as {r}_{c}" for r in ("train", "test") for c in _SCORES)}
from meta, counts, train_score, test_score""", "win_lines", "wh_grid_train", "wh_grid_test"))
def q_model_summary(spark, sf_dir):
    """A57 over the given mapping: split, SKU counts, train and test scores."""
    lines = share(window_lines(spark, sf_dir).groupBy("order_date", "sku_ID", "dc_des").agg(
        F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("lines")))
    split, _, _ = panel.split_by_distinct_dates(lines)
    facts = panel.demand_facts(lines, bind(spark, sf_dir).clusters(), config.WINDOW_START, config.WINDOW_END)
    scores = [panel.cluster_score(panel.cluster_summary(panel.series_metrics(grid(spark, sf_dir, facts))))
              for grid in (train_grid, test_grid)]
    return panel.model_summary(panel.split_meta(lines, split), panel.sku_split_counts(lines, split), *scores)
