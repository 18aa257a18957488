"""Registered queries: history features for the warehouse demand models."""

from __future__ import annotations

from skupulse import config
from skupulse.operators import clicks as ck
from skupulse.operators import features as fe
from skupulse.plans.oracle import cte, sql
from skupulse.plans.q_panel import test_grid, train_grid, window_facts
from skupulse.plans.registry import query
from skupulse.session import share
from skupulse.sources.fixtures import bind

SHIFT = "date '1998-03-01' + cast(cast({c} as date) - date '2024-01-01' as integer)"

cte("panel", """
select order_date as date, sku_cluster_ID as cluster_id, dc_des as warehouse_id, demand, 'train' as dataset_split
from wh_grid_train
union all
select order_date as date, sku_cluster_ID as cluster_id, dc_des as warehouse_id, demand, 'test' as dataset_split
from wh_grid_test""", "wh_grid_train", "wh_grid_test")

cte("hist", """
select *, lag(demand, 1) over w as lag_1_demand, lag(demand, 2) over w as lag_2_demand,
  lag(demand, 3) over w as lag_3_demand,
  case when count(demand) over w3 = 3 then avg(demand) over w3 end as rolling_mean_3_demand,
  case when count(demand) over w3 = 3 then stddev_samp(demand) over w3 end as rolling_std_3_demand
from panel
window w as (partition by cluster_id, warehouse_id order by date),
  w3 as (partition by cluster_id, warehouse_id order by date rows between 3 preceding and 1 preceding)""", "panel")

cte("hist2", "select *, (lag_1_demand - lag_2_demand) / (lag_2_demand + 1.0) as demand_growth from hist", "hist")


def _trend_cte(name, key, total, lag, roll):
    cte(name, f"""
select {key}, date, {total}, lag({total}, 1) over w as {lag},
  case when count({total}) over w3 = 3 then avg({total}) over w3 end as {roll}
from (select {key}, date, sum(demand) as {total} from panel group by all)
window w as (partition by {key} order by date),
  w3 as (partition by {key} order by date rows between 3 preceding and 1 preceding)""", "panel")


_trend_cte("cpop", "cluster_id", "cluster_total_demand_day", "cluster_total_demand_lag1",
           "cluster_total_demand_rolling3")
_trend_cte("whtrend", "warehouse_id", "warehouse_total_demand_day", "warehouse_demand_lag1",
           "warehouse_demand_rolling3")

cte("cclicks_funnel", f"""
select c.sku_cluster_ID as cluster_id, {SHIFT.format(c='f.first_click_time')} as date,
  sum(coalesce(cast(f.clicks_before_order as double), 0.0)) as click_count,
  count(distinct f.user_id) as unique_click_users
from c2o f join clusters c on f.sku = c.sku_ID where f.first_click_time is not null group by all""",
    "c2o", "clusters")

cte("cclicks_table", f"""
with ps as (select sku_ID, {SHIFT.format(c='request_time')} as date, count(*) as click_count,
              count(distinct user_ID) as unique_click_users from clicks group by all)
select c.sku_cluster_ID as cluster_id, ps.date, cast(sum(ps.click_count) as double) as click_count,
  cast(sum(ps.unique_click_users) as double) as unique_click_users
from ps join clusters c on ps.sku_ID = c.sku_ID
where ps.date between date '1998-03-01' and date '1998-03-31' group by all""", "clicks", "clusters")


def _velocity_cte(name, src):
    cte(name, f"""
select *, click_count / greatest(unique_click_users, 1.0) as click_per_user,
  lag(click_count, 1) over w as lag_1_clicks, lag(click_count, 2) over w as lag_2_clicks,
  lag(click_count, 1) over w - lag(click_count, 2) over w as click_velocity
from {src} window w as (partition by cluster_id order by date)""", src)


_velocity_cte("cvel_funnel", "cclicks_funnel")
_velocity_cte("cvel_table", "cclicks_table")


def _panel(spark, sf_dir):
    facts = window_facts(spark, sf_dir)
    return fe.panel_dataset(train_grid(spark, sf_dir, facts), test_grid(spark, sf_dir, facts))


def _c2o(spark, sf_dir):
    t = bind(spark, sf_dir)
    return ck.click_to_order(ck.first_orders(t.funnel_orders()), t.clicks())


def _r(cols):
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


HIST_COLS = ["lag_1_demand", "lag_2_demand", "lag_3_demand", "rolling_mean_3_demand", "rolling_std_3_demand",
             "demand_growth"]


@query("panel_dataset", sql("select date, cluster_id, warehouse_id, round(demand, 6) as demand, dataset_split from panel",
                            "panel"))
def q_panel_dataset(spark, sf_dir):
    """S10+U1: train and test panels unioned with a split tag."""
    return _panel(spark, sf_dir)


@query("lag_features", sql(f"""
select date, cluster_id, warehouse_id, round(demand, 6) as demand, dataset_split,
  {_r(['lag_1_demand', 'lag_2_demand', 'lag_3_demand', 'demand_growth'])} from hist2""", "hist2"))
def q_lag_features(spark, sf_dir):
    """W2+C14: positional lags 1-3 per series and demand growth."""
    return fe.demand_history(_panel(spark, sf_dir)).select(
        "date", "cluster_id", "warehouse_id", "demand", "dataset_split",
        "lag_1_demand", "lag_2_demand", "lag_3_demand", "demand_growth")


@query("rolling_features", sql(f"""
select date, cluster_id, warehouse_id, {_r(['rolling_mean_3_demand', 'rolling_std_3_demand'])} from hist2""",
                               "hist2"))
def q_rolling_features(spark, sf_dir):
    """W4+W5: shifted rolling mean / sample std over 3 days (full window only)."""
    return fe.demand_history(_panel(spark, sf_dir)).select(
        "date", "cluster_id", "warehouse_id", "rolling_mean_3_demand", "rolling_std_3_demand")


@query("cluster_popularity", sql(f"""
select cluster_id, date, {_r(['cluster_total_demand_day', 'cluster_total_demand_lag1', 'cluster_total_demand_rolling3'])}
from cpop""", "cpop"))
def q_cluster_popularity(spark, sf_dir):
    """A22+W6: cluster daily totals with lag-1 and rolling-3."""
    return fe.cluster_popularity(_panel(spark, sf_dir))


@query("warehouse_trend", sql(f"""
select warehouse_id, date, {_r(['warehouse_total_demand_day', 'warehouse_demand_lag1', 'warehouse_demand_rolling3'])}
from whtrend""", "whtrend"))
def q_warehouse_trend(spark, sf_dir):
    """A22+W6: warehouse daily totals with lag-1 and rolling-3."""
    return fe.warehouse_trend(_panel(spark, sf_dir))


@query("cluster_clicks_funnel", sql("select cluster_id, date, round(click_count, 6) as click_count, unique_click_users "
                                    "from cclicks_funnel", "cclicks_funnel"))
def q_cluster_clicks_funnel(spark, sf_dir):
    """Cluster daily clicks from the click-to-order table."""
    return fe.cluster_clicks_funnel(_c2o(spark, sf_dir), bind(spark, sf_dir).clusters())


@query("cluster_clicks_daily", sql("select cluster_id, date, round(click_count, 6) as click_count, "
                                   "round(unique_click_users, 6) as unique_click_users from cclicks_table",
                                   "cclicks_table"))
def q_cluster_clicks_daily(spark, sf_dir):
    """A7+A24: cluster daily clicks from the click table (users summed, T12)."""
    t = bind(spark, sf_dir)
    return fe.cluster_clicks_table(t.clicks(), t.clusters(), config.WINDOW_START, config.WINDOW_END)


@query("click_velocity", sql(f"""
select cluster_id, date, {_r(['click_count', 'unique_click_users', 'click_per_user', 'lag_1_clicks', 'lag_2_clicks',
                             'click_velocity'])} from cvel_table""", "cvel_table"))
def q_click_velocity(spark, sf_dir):
    """Click per user, click lags over observed days, velocity."""
    t = bind(spark, sf_dir)
    return fe.click_velocity(fe.cluster_clicks_table(t.clicks(), t.clusters(), config.WINDOW_START,
                                                     config.WINDOW_END))


FRAME_DOUBLES = (["demand"] + HIST_COLS + ["cluster_total_demand_day", "cluster_total_demand_lag1",
                                           "cluster_total_demand_rolling3", "warehouse_total_demand_day",
                                           "warehouse_demand_lag1", "warehouse_demand_rolling3", "click_count",
                                           "click_per_user", "lag_1_clicks", "lag_2_clicks", "click_velocity",
                                           "conversion_rate"])


@query("feature_frame", sql(f"""
select h.date, h.cluster_id, h.warehouse_id, h.dataset_split, h.unique_click_users,
  cast(isodow(h.date) - 1 as integer) as day_of_week, cast(isodow(h.date) - 1 >= 5 as integer) as is_weekend,
  cast(day(h.date) as integer) as day_of_month,
  {_r(FRAME_DOUBLES)}
from (select h.*, p.cluster_total_demand_day, p.cluster_total_demand_lag1, p.cluster_total_demand_rolling3,
        w.warehouse_total_demand_day, w.warehouse_demand_lag1, w.warehouse_demand_rolling3,
        v.click_count, v.unique_click_users, v.click_per_user, v.lag_1_clicks, v.lag_2_clicks, v.click_velocity,
        p.cluster_total_demand_lag1 / greatest(v.lag_1_clicks, 1.0) as conversion_rate
      from hist2 h left join cpop p on h.cluster_id = p.cluster_id and h.date = p.date
      left join whtrend w on h.warehouse_id = w.warehouse_id and h.date = w.date
      left join cvel_funnel v on h.cluster_id = v.cluster_id and h.date = v.date
      where h.lag_1_demand is not null and h.lag_2_demand is not null and h.lag_3_demand is not null) h""", "hist2", "cpop", "whtrend", "cvel_funnel"))
def q_feature_frame(spark, sf_dir):
    """The warehouse model frame (history, trends, clicks, calendar)."""
    t = bind(spark, sf_dir)
    clicks_daily = fe.cluster_clicks_funnel(_c2o(spark, sf_dir), t.clusters())
    return fe.feature_frame(share(_panel(spark, sf_dir)), share(clicks_daily))
