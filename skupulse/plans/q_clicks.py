"""Registered queries: click funnel and user behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from skupulse.operators import clicks as ck
from skupulse.operators import stats
from skupulse.operators.ordered import ecdf, histogram
from skupulse.plans.oracle import cte, sql
from skupulse.plans.registry import query
from skupulse.sources.fixtures import bind

# ------------------------------------------------------------- shared CTEs

cte("first_ord", """
select user_ID, sku_ID, min(order_time) as first_order_time from funnel_orders group by user_ID, sku_ID
""", "funnel_orders")

cte("c2o", """
select o.user_ID as user_id, o.sku_ID as sku, min(c.request_time) as first_click_time, o.first_order_time,
  count_if(c.request_time < o.first_order_time) as clicks_before_order,
  (epoch_us(o.first_order_time) - epoch_us(min(c.request_time))) / 86400e6 as days_between
from first_ord o join clicks c on c.user_ID = o.user_ID and c.sku_ID = o.sku_ID
group by o.user_ID, o.sku_ID, o.first_order_time
""", "first_ord", "clicks")

cte("click_base", """
select user_ID as user_id, sku_ID as sku_id, channel, request_time as ts, cast(request_time as date) as click_date,
  cast(hour(request_time) as integer) as hour, cast(isodow(request_time) - 1 as integer) as dow
from clicks where user_ID is not null and user_ID <> '-'
""", "clicks")

cte("user_tot", """
select user_id, count(*) as total_clicks, count(distinct click_date) as active_days,
  min(ts) as first_click_time, max(ts) as last_click_time, min(click_date) as first_click_date,
  max(click_date) as last_click_date, count(distinct sku_id) as unique_skus, count(distinct channel) as unique_channels
from click_base group by user_id
""", "click_base")


def _rank_cte(name, col):
    cte(name, f"""
select user_id, {col} as v, count(*) as cnt,
  row_number() over (partition by user_id order by count(*) desc, {col}) as rn
from click_base group by user_id, {col}""", "click_base")


_rank_cte("sku_rank", "sku_id")
_rank_cte("channel_rank", "channel")
_rank_cte("hour_rank", "hour")
_rank_cte("dow_rank", "dow")

cte("user_beh", """
select t.user_id, t.total_clicks, t.active_days,
  round(t.total_clicks / nullif(t.active_days, 0), 4) as avg_clicks_per_day,
  t.first_click_time, t.last_click_time,
  cast(t.last_click_date - t.first_click_date + 1 as double) as active_span_days,
  t.unique_skus, s.v as top_sku, s.cnt as top_sku_clicks, round(s.cnt / nullif(t.total_clicks, 0), 4) as top_sku_share,
  t.unique_channels, c.v as top_channel, c.cnt as top_channel_clicks,
  round(c.cnt / nullif(t.total_clicks, 0), 4) as top_channel_share,
  h.v as peak_hour, h.cnt as peak_hour_clicks, round(h.cnt / nullif(t.total_clicks, 0), 4) as peak_hour_share,
  case d.v when 0 then 'Mon' when 1 then 'Tue' when 2 then 'Wed' when 3 then 'Thu' when 4 then 'Fri'
    when 5 then 'Sat' when 6 then 'Sun' else null end as peak_dow,
  d.cnt as peak_dow_clicks, round(d.cnt / nullif(t.total_clicks, 0), 4) as peak_dow_share
from user_tot t
left join sku_rank s on s.user_id = t.user_id and s.rn = 1
left join channel_rank c on c.user_id = t.user_id and c.rn = 1
left join hour_rank h on h.user_id = t.user_id and h.rn = 1
left join dow_rank d on d.user_id = t.user_id and d.rn = 1
""", "user_tot", "sku_rank", "channel_rank", "hour_rank", "dow_rank")


def _c2o(spark, sf_dir):
    t = bind(spark, sf_dir)
    return ck.click_to_order(ck.first_orders(t.funnel_orders()), t.clicks())


def _behavior(spark, sf_dir):
    return ck.user_behavior(bind(spark, sf_dir).clicks())


# ------------------------------------------------------------- queries

@query("first_orders", sql("select * from first_ord", "first_ord"))
def q_first_orders(spark, sf_dir):
    """A1: first order time per (user, sku)."""
    return ck.first_orders(bind(spark, sf_dir).funnel_orders())


@query("click_to_order", sql("""
select user_id, sku, first_click_time, first_order_time, clicks_before_order,
  round(days_between, 6) as days_between from c2o""", "c2o"))
def q_click_to_order(spark, sf_dir):
    """A2+J2: clicks before first order and days from first click."""
    return _c2o(spark, sf_dir)


@query("user_totals", sql("select * from user_tot", "user_tot"))
def q_user_totals(spark, sf_dir):
    """A3: per-user click totals (anonymous users excluded)."""
    return ck.user_totals(ck.click_base(bind(spark, sf_dir).clicks()))


@query("user_behavior", sql("select * from user_beh", "user_beh"))
def q_user_behavior(spark, sf_dir):
    """A4+W1: per-user behaviour profile."""
    return _behavior(spark, sf_dir)


@query("clicks_day_region_sku", sql("""
select cast(c.request_time as date) as day, coalesce(u.region, 'UNKNOWN') as region, c.sku_ID,
  count(distinct case when c.user_ID is not null and c.user_ID <> '-' then c.user_ID end) as unique_users,
  count(*) as total_clicks
from clicks c left join users u on c.user_ID = u.user_ID
group by all""", "clicks", "users"))
def q_clicks_day_region_sku(spark, sf_dir):
    """A5+J1: clicks by day, user region and SKU."""
    t = bind(spark, sf_dir)
    return ck.clicks_day_region_sku(t.clicks(), t.users())


@query("clicks_daily_sku", sql("""
select sku_ID, cast(request_time as date) as order_date, count(*) as daily_clicks from clicks group by all
""", "clicks"))
def q_clicks_daily_sku(spark, sf_dir):
    """Clicks per SKU and day."""
    return ck.clicks_daily_sku(bind(spark, sf_dir).clicks())


@query("clicks_by_hour", sql("""
select h.hour, coalesce(c.clicks, 0) as clicks, (h.hour + 18) % 24 as display_order
from (select cast(range as integer) as hour from range(24)) h
left join (select cast(hour(request_time) as integer) as hour, count(*) as clicks from clicks group by 1) c
  on h.hour = c.hour""", "clicks"))
def q_clicks_by_hour(spark, sf_dir):
    """Clicks per hour of day, missing hours 0, display from 6h."""
    return ck.clicks_by_hour(bind(spark, sf_dir).clicks())


@query("clicks_by_weekday", sql("""
select cast(isodow(request_time) - 1 as integer) as dow, count(*) as clicks,
  case cast(isodow(request_time) - 1 as integer) when 0 then 'Mon' when 1 then 'Tue' when 2 then 'Wed'
    when 3 then 'Thu' when 4 then 'Fri' when 5 then 'Sat' when 6 then 'Sun' end as dow_label
from clicks group by all""", "clicks"))
def q_clicks_by_weekday(spark, sf_dir):
    """Clicks per weekday."""
    return ck.clicks_by_weekday(bind(spark, sf_dir).clicks())


@query("channel_share", sql("""
select channel, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from clicks group by channel
""", "clicks"))
def q_channel_share(spark, sf_dir):
    """Normalised value counts of the click channel."""
    return ck.value_shares(bind(spark, sf_dir).clicks(), "channel")


@query("top_channel_users", sql("""
select top_channel, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2) as pct_users
from user_beh group by top_channel""", "user_beh"))
def q_top_channel_users(spark, sf_dir):
    """Share of users (in %) by their top channel."""
    s = ck.value_shares(_behavior(spark, sf_dir), "top_channel", "share")
    return s.select("top_channel", "n", F.round(F.col("share") * 100, 2).alias("pct_users"))


@query("funnel_summary", sql("""
select count(*) as rows, count(distinct user_id) as unique_users, count(distinct sku) as unique_skus,
  round(avg(cast(coalesce(days_between <= 0, false) as double)), 6) as frac_nonpositive_days,
  round(avg(cast(coalesce(clicks_before_order = 0, false) as double)), 6) as frac_zero_clicks
from c2o""", "c2o"))
def q_funnel_summary(spark, sf_dir):
    """Click-to-order summary."""
    return ck.funnel_summary(_c2o(spark, sf_dir))


@query("top_funnel_skus", sql("""
select sku, count(*) as pairs from c2o group by sku order by pairs desc, sku limit 15""", "c2o"))
def q_top_funnel_skus(spark, sf_dir):
    """K2: top 15 SKUs by matched (user, sku) pairs (ties by SKU id)."""
    return (_c2o(spark, sf_dir).groupBy("sku").agg(F.count(F.lit(1)).alias("pairs"))
            .orderBy(F.col("pairs").desc(), F.col("sku")).limit(15))


@query("ecdf_days", sql("""
with v as (select least(greatest(days_between, -30.0), 365.0) as days_clipped, count(*) as n
           from c2o where days_between is not null group by 1)
select round(days_clipped, 6) as days_clipped, n,
  round(sum(n) over (order by days_clipped rows between unbounded preceding and current row) / sum(n) over (), 6)
    as ecdf
from v""", "c2o"))
def q_ecdf_days(spark, sf_dir):
    """ECDF of days first click -> first order, clipped to [-30, 365]."""
    c = _c2o(spark, sf_dir).select(
        F.least(F.greatest(F.col("days_between"), F.lit(-30.0)), F.lit(365.0)).alias("days_clipped"))
    return ecdf(c, "days_clipped")


@query("histogram_clicks_before", sql("""
with x as (select cast(least(clicks_before_order, 50) as double) as x from c2o),
r as (select case when min(x) = max(x) then min(x) - 0.5 else min(x) end as lo,
             case when min(x) = max(x) then max(x) + 0.5 else max(x) end as hi from x),
c as (select least(cast(floor((x - lo) / ((hi - lo) / 50)) as integer), 49) as bin, count(*) as cnt from x, r group by 1)
select b.bin, round(lo + b.bin * ((hi - lo) / 50), 6) as bin_start, round(lo + (b.bin + 1) * ((hi - lo) / 50), 6) as bin_end,
  coalesce(c.cnt, 0) as count
from (select cast(range as integer) as bin from range(50)) b cross join r left join c on b.bin = c.bin""", "c2o"))
def q_histogram_clicks_before(spark, sf_dir):
    """50-bin histogram of clicks before order, capped at 50."""
    c = _c2o(spark, sf_dir).select(F.least("clicks_before_order", F.lit(50)).alias("x"))
    return histogram(c, "x", 50)


@query("missing_rates", sql("""
unpivot (select avg(cast(user_ID is null or user_ID = '-' as double)) as user_ID,
                avg(cast(sku_ID is null as double)) as sku_ID,
                avg(cast(request_time is null as double)) as request_time,
                avg(cast(channel is null as double)) as channel from clicks)
on user_ID, sku_ID, request_time, channel into name column_name value missing_rate""", "clicks"))
def q_missing_rates(spark, sf_dir):
    """Missing share per click column ('-' user counts as missing)."""
    return ck.missing_rates(bind(spark, sf_dir).clicks(), {"user_ID": "-"})


@query("user_day_clicks", sql("""
select user_ID, cast(request_time as date) as date, count(*) as clicks from clicks
where user_ID is not null and user_ID <> '-' group by all""", "clicks"))
def q_user_day_clicks(spark, sf_dir):
    """Clicks per (user, day)."""
    return ck.user_day_clicks(bind(spark, sf_dir).clicks())


@query("user_day_clicks_describe", sql("""
select count(clicks) as count, round(avg(clicks), 6) as mean, round(stddev_samp(clicks), 6) as std,
  cast(min(clicks) as double) as min, round(quantile_cont(clicks, 0.25), 6) as p25,
  round(quantile_cont(clicks, 0.5), 6) as p50, round(quantile_cont(clicks, 0.75), 6) as p75,
  cast(max(clicks) as double) as max
from (select user_ID, cast(request_time as date) as d, count(*) as clicks from clicks
      where user_ID is not null and user_ID <> '-' group by all)""", "clicks"))
def q_user_day_clicks_describe(spark, sf_dir):
    """A51+A12: describe() of clicks per user-day."""
    return stats.describe(ck.user_day_clicks(bind(spark, sf_dir).clicks()), "clicks", [0.25, 0.5, 0.75])


@query("behavior_summary", sql("""
select round(quantile_cont(total_clicks, 0.5), 6) as median_total_clicks,
  round(quantile_cont(active_days, 0.5), 6) as median_active_days,
  round(quantile_cont(active_span_days, 0.5), 6) as median_active_span_days,
  round(quantile_cont(unique_skus, 0.5), 6) as median_unique_skus,
  round(quantile_cont(top_sku_share, 0.5), 6) as median_top_sku_share,
  round(100 * avg(cast(coalesce(unique_channels = 1, false) as double)), 6) as pct_single_channel,
  round(100 * avg(cast(coalesce(top_sku_share = 1, false) as double)), 6) as pct_top_sku_share_one,
  count(*) as users
from user_beh""", "user_beh"))
def q_behavior_summary(spark, sf_dir):
    """Medians and single-channel / single-SKU shares of users."""
    return stats.behavior_summary(_behavior(spark, sf_dir))


@query("users_by_peak_dow", sql("""
select l.dow_order, l.peak_dow, coalesce(c.users, 0) as users
from (select cast(range as integer) as dow_order,
        ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][range + 1] as peak_dow from range(7)) l
left join (select peak_dow, count(*) as users from user_beh group by 1) c on l.peak_dow = c.peak_dow""", "user_beh"))
def q_users_by_peak_dow(spark, sf_dir):
    """Users per peak weekday in fixed Mon..Sun order (0 if none)."""
    return stats.users_by_label(_behavior(spark, sf_dir), "peak_dow", ck.DOW_LABELS)


@query("users_by_peak_hour", sql("""
select peak_hour, count(*) as users from user_beh group by 1""", "user_beh"))
def q_users_by_peak_hour(spark, sf_dir):
    """Users per peak hour."""
    return _behavior(spark, sf_dir).groupBy("peak_hour").agg(F.count(F.lit(1)).alias("users"))
