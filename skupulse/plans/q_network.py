"""Registered queries: order mart, fulfilment, network parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from skupulse import config
from skupulse.operators import forecast as fc
from skupulse.operators import network as nw
from skupulse.operators import params
from skupulse.plans.oracle import cte, sql
from skupulse.plans import q_forecast  # noqa: F401  (registers the panel CTEs used below)
from skupulse.plans.registry import query
from skupulse.session import share
from skupulse.sources.fixtures import bind

cte("mart", """
select o.order_ID, o.user_ID, o.sku_ID, o.order_date, o.order_time as order_time_dt, o.quantity, o.dc_ori, o.dc_des,
  cast(o.dc_ori <> o.dc_des as integer) as cross_fulfill, d.ship_out_dt, d.arr_station_dt, d.arr_dt,
  (epoch_us(d.arr_dt) - epoch_us(o.order_time)) / 3600e6 as lead_time_hours,
  (epoch_us(d.arr_station_dt) - epoch_us(d.ship_out_dt)) / 3600e6 as cross_filling_hours,
  try_cast(o.promise as double) as promise_days, try_cast(o.promise as double) * 24.0 as promise_hours,
  case when d.arr_dt is not null and try_cast(o.promise as double) is not null
       then cast((epoch_us(d.arr_dt) - epoch_us(o.order_time)) / 3600e6 > try_cast(o.promise as double) * 24.0 as integer)
  end as late_delivery,
  coalesce(i.f, 0) as inv_available_at_dc_des, s.attribute1, s.attribute2, s.brand_ID
from order_lines o
left join (select order_ID, min(ship_out_time) as ship_out_dt, min(arr_station_time) as arr_station_dt,
             max(arr_time) as arr_dt from delivery group by order_ID) d on o.order_ID = d.order_ID
left join (select distinct dc_ID, sku_ID, date, 1 as f from inventory) i
  on i.dc_ID = o.dc_des and i.sku_ID = o.sku_ID and i.date = o.order_date
left join sku s on s.sku_ID = o.sku_ID""", "order_lines", "delivery", "inventory", "sku")

cte("dsd", """
select *, cast(round_even(n_orders * (1 - cross_rate), 0) as bigint) as inventory
from (select sku_ID, dc_des, cast(order_time_dt as date) as order_day, count(*) as n_orders,
        avg(cross_fulfill) as cross_rate, avg(lead_time_hours) as avg_lead_time_hours,
        avg(late_delivery) as late_delivery_rate, avg(inv_available_at_dc_des) as inv_available_at_dc_des
      from mart group by all)""", "mart")

cte("caplegacy", """
select dc_des, cast(max(total_orders) as double) as capacity
from (select dc_des, order_day, sum(n_orders) as total_orders from dsd group by all) group by dc_des""", "dsd")

cte("wuniv", """
select distinct warehouse from (select cast(warehouse as integer) as warehouse from opt_wh
  union all select cast(dc_des as integer) from caplegacy union all select cast(dc_des as integer) from dsd)
where warehouse is not null""", "opt_wh", "caplegacy", "dsd")

cte("capacity_t", """
with corr as (select dc_des as warehouse, case when max(t) > 0 then max(t) end as corrected_capacity
              from (select dc_des, order_day, sum(coalesce(cast(inventory as double), 0.0)) as t from dsd group by all)
              group by dc_des)
select u.warehouse, l.capacity as legacy_capacity, c.corrected_capacity,
  case when c.corrected_capacity is not null then 'daily_sku_dc_summary' else 'legacy_capacity_fallback' end
    as capacity_source,
  coalesce(c.corrected_capacity, l.capacity, 0.0) as C_j
from wuniv u left join caplegacy l on u.warehouse = l.dc_des left join corr c on u.warehouse = c.warehouse""",
    "wuniv", "caplegacy", "dsd")

cte("invshare", """
with s as (select warehouse, sku_cluster_ID, sum(demand) as demand from opt_train group by all),
t as (select warehouse, sum(demand) as warehouse_total from s group by 1)
select u.warehouse, k.sku_cluster_ID,
  coalesce(case when t.warehouse_total > 0 then s.demand / t.warehouse_total else 0.0 end, 0.0) as inventory_share_proxy
from wuniv u cross join (select distinct sku_cluster_ID from opt_train) k
left join s on s.warehouse = u.warehouse and s.sku_cluster_ID = k.sku_cluster_ID
left join t on t.warehouse = s.warehouse""", "opt_train", "wuniv")

cte("whinv", """
with raw as (select date, dc_ID as warehouse, count(sku_ID) as raw_inventory_units from inventory
             where date between date '1998-03-01' and date '1998-03-31' group by all),
summ as (select order_day as date, dc_des as warehouse, sum(coalesce(cast(inventory as double), 0.0)) as summary_inventory_units
         from dsd where order_day between date '1998-03-01' and date '1998-03-31' group by all)
select cast(ds.d as date) as date, u.warehouse, s.summary_inventory_units, r.raw_inventory_units,
  coalesce(s.summary_inventory_units, cast(r.raw_inventory_units as double), 0.0) as warehouse_inventory_units
from generate_series(timestamp '1998-03-01', timestamp '1998-03-31', interval 1 day) ds(d) cross join wuniv u
left join summ s on s.date = cast(ds.d as date) and s.warehouse = u.warehouse
left join raw r on r.date = cast(ds.d as date) and r.warehouse = u.warehouse""", "inventory", "dsd", "wuniv")

cte("invparam", """
select s.sku_cluster_ID, w.warehouse,
  avg(case when w.date <= date '1998-03-24' then w.warehouse_inventory_units * s.inventory_share_proxy end) as I0_sj_train_proxy,
  sum(case when w.date = date '1998-03-25' then w.warehouse_inventory_units * s.inventory_share_proxy end) as I0_sj_test_initial,
  avg(case when w.date >= date '1998-03-25' then w.warehouse_inventory_units * s.inventory_share_proxy end) as I0_sj_test_proxy
from whinv w join invshare s on w.warehouse = s.warehouse group by all""", "whinv", "invshare")

cte("routes_t", """
with tr as (select * from mart where order_date between date '1998-03-01' and date '1998-03-24'
              and dc_ori is not null and dc_des is not null and lead_time_hours is not null and lead_time_hours > 0),
obs as (select dc_ori, dc_des, avg(lead_time_hours) as t_nm from tr group by all),
w as (select distinct x from (select dc_ori as x from tr union all select dc_des from tr
                              union all select warehouse from wuniv))
select a.x as dc_ori, b.x as dc_des, o.t_nm, cast(o.t_nm is not null as integer) as r_nm
from w a cross join w b left join obs o on o.dc_ori = a.x and o.dc_des = b.x""", "mart", "wuniv")


class NetInputs:
    """Shared inputs of one network query, each made when first asked for.

    The full-table order mart is lineitem-sized, so it is never written out:
    capacity and inventory only need its per (dc, day) totals, which are bounded
    by warehouses x days and are written once.  The mart keeps every order line,
    so its warehouses are those of the lines, and the warehouse universe needs no
    mart.  Routes read the train window's lead times alone."""

    def __init__(self, spark, sf_dir):
        self.t = bind(spark, sf_dir)
        self._cache = {}

    def _memo(self, key, fn):
        if key not in self._cache:
            self._cache[key] = fn()
        return self._cache[key]

    @property
    def mart(self):
        return nw.order_mart(self.t.orders(), self.t.delivery(), self.t.inventory(), self.t.sku())

    @property
    def summary(self):
        return nw.daily_sku_dc(nw.order_mart(self.t.orders(), self.t.delivery(), self.t.inventory()))

    @property
    def dc_day(self):
        return self._memo("dc_day", lambda: share(self.summary.groupBy("dc_des", "order_day").agg(
            F.sum("n_orders").alias("n_orders"), F.sum("inventory").alias("inventory"))))

    @property
    def legacy(self):
        return nw.capacity_legacy(self.dc_day)

    @property
    def facts(self):
        """Demand by (date, warehouse, cluster) of the study window."""
        return self._memo("facts", lambda: fc.panel_facts(
            self.t.window_orders(["sku_ID", "order_date", "dc_des", "quantity"]), self.t.clusters()))

    @property
    def train(self):
        return self._memo("train", lambda: fc.facts_panels(self.facts, self.t.clusters())[0])

    @property
    def universe(self):
        """Warehouses of the panels, the capacity table and the daily summary;
        the latter two are the warehouses of all order lines, the panels' among them."""
        def build():
            lines = self.dc_day if "dc_day" in self._cache else self.t.orders(columns=["dc_des"])
            lines = lines.select(F.col("dc_des").cast("int").alias("warehouse"))
            return share(lines.where("warehouse is not null").distinct())
        return self._memo("universe", build)

    @property
    def lead_times(self):
        """Route and lead time of each order line of the study window."""
        w0, w1 = config.WINDOW_START, config.WINDOW_END
        return self._memo("leads", lambda: share(nw.line_lead_times(
            self.t.orders(w0, w1, ["order_ID", "order_date", "order_time", "dc_ori", "dc_des"]), self.t.delivery(w0, w1))))


def _r(cols):
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


@query("order_mart", sql(f"""
select order_ID, user_ID, sku_ID, order_date, order_time_dt, quantity, dc_ori, dc_des, cross_fulfill, ship_out_dt,
  arr_station_dt, arr_dt, late_delivery, inv_available_at_dc_des, attribute1, attribute2, brand_ID,
  {_r(['lead_time_hours', 'cross_filling_hours', 'promise_days', 'promise_hours'])} from mart""", "mart"))
def q_order_mart(spark, sf_dir):
    """A38+J11+J12+J17: order-level mart with delivery times and flags."""
    t = bind(spark, sf_dir)
    return nw.order_mart(t.orders(), t.delivery(), t.inventory(), t.sku())


@query("delivery_rollup", sql("""
select order_ID, min(ship_out_time) as ship_out_dt, min(arr_station_time) as arr_station_dt, max(arr_time) as arr_dt
from delivery group by order_ID""", "delivery"))
def q_delivery_rollup(spark, sf_dir):
    """Package-level delivery rolled up per order."""
    return nw.delivery_rollup(bind(spark, sf_dir).delivery())


@query("fulfillment_summary", sql("""
select round(avg(cross_fulfill), 6) as cross_fulfillment_rate, round(avg(lead_time_hours), 6) as lead_time_mean_hours,
  round(quantile_cont(lead_time_hours, 0.5), 6) as lead_time_median_hours,
  round(avg(case when cross_fulfill = 1 then lead_time_hours end) - avg(case when cross_fulfill = 0 then lead_time_hours end), 6)
    as delay_penalty_mean_hours,
  round(quantile_cont(case when cross_fulfill = 1 then lead_time_hours end, 0.5)
        - quantile_cont(case when cross_fulfill = 0 then lead_time_hours end, 0.5), 6) as delay_penalty_median_hours
from mart""", "mart"))
def q_fulfillment_summary(spark, sf_dir):
    """Cross-fulfilment rate, lead time, delay penalty."""
    return nw.fulfillment_summary(NetInputs(spark, sf_dir).mart)


@query("lead_time_by_fulfillment", sql("""
select case when cross_fulfill = 1 then 'cross' else 'local' end as fulfillment, count(*) as count,
  round(avg(lead_time_hours), 6) as mean, round(quantile_cont(lead_time_hours, 0.5), 6) as median,
  round(stddev_samp(lead_time_hours), 6) as std, count(late_delivery) as late_count,
  round(avg(late_delivery), 6) as late_rate
from mart where lead_time_hours is not null group by 1""", "mart"))
def q_lead_time_by_fulfillment(spark, sf_dir):
    """Lead-time stats and late rate, local vs cross."""
    return nw.lead_time_by_fulfillment(NetInputs(spark, sf_dir).mart)


@query("cross_rate_by_inventory", sql("""
select case when inv_available_at_dc_des = 1 then 'inv_record' else 'no_inv_record' end as inventory_flag,
  count(*) as count, round(avg(cross_fulfill), 6) as cross_rate from mart group by 1""", "mart"))
def q_cross_rate_by_inventory(spark, sf_dir):
    """Cross rate by inventory record at the destination DC."""
    return nw.cross_rate_by_inventory(NetInputs(spark, sf_dir).mart)


@query("cross_fill_hours", sql("""
select dc_ori, dc_des, round(avg(cross_filling_hours), 6) as cross_filling_hours, count(*) as n_orders
from mart where cross_filling_hours is not null group by all""", "mart"))
def q_cross_fill_hours(spark, sf_dir):
    """Mean cross-filling hours per (origin, destination)."""
    return nw.cross_fill_hours(NetInputs(spark, sf_dir).mart)


@query("daily_sku_dc", sql(f"""
select sku_ID, dc_des, order_day, n_orders, inventory,
  {_r(['cross_rate', 'avg_lead_time_hours', 'late_delivery_rate', 'inv_available_at_dc_des'])} from dsd""", "dsd"))
def q_daily_sku_dc(spark, sf_dir):
    """Daily SKU x DC fulfilment summary with inventory proxy."""
    return NetInputs(spark, sf_dir).summary


@query("capacity_legacy", sql("select dc_des, capacity from caplegacy", "caplegacy"))
def q_capacity_legacy(spark, sf_dir):
    """Legacy capacity = max daily orders per DC."""
    return NetInputs(spark, sf_dir).legacy


@query("warehouse_universe", sql("select warehouse from wuniv", "wuniv"))
def q_warehouse_universe(spark, sf_dir):
    """A32+U2: warehouses of demand panels, capacity table and summary."""
    return NetInputs(spark, sf_dir).universe


@query("capacity", sql("select warehouse, legacy_capacity, corrected_capacity, capacity_source, C_j from capacity_t",
                       "capacity_t"))
def q_capacity(spark, sf_dir):
    """A29+J14: corrected capacity with legacy fallback."""
    i = NetInputs(spark, sf_dir)
    day = i.dc_day   # written first: the universe is read off it
    return params.capacity(i.universe, i.legacy, day)


@query("procurement", sql("""
select u.warehouse, coalesce(w.W_j, 0) as W_j from wuniv u
left join (select dc_ID as warehouse, max(cast(dc_ID = region_ID as integer)) as W_j from network group by 1) w
  on u.warehouse = w.warehouse""", "wuniv", "network"))
def q_procurement(spark, sf_dir):
    """Procurement eligibility W_j."""
    i = NetInputs(spark, sf_dir)
    return params.procurement(i.t.network(), i.universe)


@query("inventory_share", sql("select warehouse, sku_cluster_ID, round(inventory_share_proxy, 6) as inventory_share_proxy "
                              "from invshare", "invshare"))
def q_inventory_share(spark, sf_dir):
    """Cluster share of warehouse train demand."""
    i = NetInputs(spark, sf_dir)
    train = share(i.train)
    return params.inventory_share(train, i.universe, train.select("sku_cluster_ID").distinct())


def _invparam(spark, sf_dir):
    i = NetInputs(spark, sf_dir)
    i.dc_day   # written first: the universe is read off it
    train = share(i.train)
    shares = params.inventory_share(train, i.universe, train.select("sku_cluster_ID").distinct())
    wh = params.warehouse_daily_inventory(i.t.inventory(), i.dc_day, i.universe, config.WINDOW_START,
                                          config.WINDOW_END)
    return params.inventory_parameters(wh, shares)


@query("inventory_param", sql(f"select sku_cluster_ID, warehouse, "
                              f"{_r(['I0_sj_train_proxy', 'I0_sj_test_initial', 'I0_sj_test_proxy'])} from invparam",
                              "invparam"))
def q_inventory_param(spark, sf_dir):
    """Cluster inventory proxies (train mean, test first day, test mean)."""
    return _invparam(spark, sf_dir)


@query("initial_inventory", sql("select sku_cluster_ID, warehouse, round(I0_sj_test_initial, 6) as I0_sj_test_initial "
                                "from invparam", "invparam"))
def q_initial_inventory(spark, sf_dir):
    """Opening inventory of the test week per (cluster, warehouse)."""
    return _invparam(spark, sf_dir).select("sku_cluster_ID", "warehouse", "I0_sj_test_initial")


@query("demand_param", sql("""
select coalesce(a.sku_cluster_ID, b.sku_cluster_ID) as sku_cluster_ID, coalesce(a.warehouse, b.warehouse) as warehouse,
  round(a.D_sj_train, 6) as D_sj_train, round(b.D_sj_test_actual, 6) as D_sj_test_actual
from (select sku_cluster_ID, warehouse, avg(demand) as D_sj_train from opt_train group by all) a
full join (select sku_cluster_ID, warehouse, avg(demand) as D_sj_test_actual from opt_test group by all) b
  on a.sku_cluster_ID = b.sku_cluster_ID and a.warehouse = b.warehouse""", "opt_train", "opt_test"))
def q_demand_param(spark, sf_dir):
    """Mean demand per (cluster, warehouse), train and test."""
    t = bind(spark, sf_dir)
    tr, te, _ = fc.opt_panels(t.window_orders(["sku_ID", "order_date", "dc_des", "quantity"]), t.clusters())
    return params.demand_parameters(tr, te)


@query("routes", sql("select dc_ori, dc_des, round(t_nm, 6) as t_nm, r_nm from routes_t", "routes_t"))
def q_routes(spark, sf_dir):
    """Route lead time t_nm and existence r_nm (train window)."""
    i = NetInputs(spark, sf_dir)
    return params.routes(i.lead_times, i.universe)


@query("route_inputs", sql("""
with b as (select a.warehouse as dc_ori, c.warehouse as dc_des, r.t_nm, r.r_nm
           from wuniv a cross join wuniv c left join routes_t r on r.dc_ori = a.warehouse and r.dc_des = c.warehouse),
m as (select coalesce(quantile_cont(t_nm, 0.5), 24.0) as med from b)
select dc_ori as source_warehouse, dc_des as destination_warehouse, coalesce(r_nm, 0) as route_feasible,
  round(coalesce(t_nm, m.med), 6) as lead_time_hours
from b cross join m where dc_ori <> dc_des""", "wuniv", "routes_t"))
def q_route_inputs(spark, sf_dir):
    """Feasible routes and lead times with median fallback."""
    i = NetInputs(spark, sf_dir)
    return params.route_inputs(params.routes(i.lead_times, i.universe), i.universe)


@query("order_composition", sql("""
with items as (select distinct order_ID, sku_ID, coalesce(cast(type as varchar), 'MISSING') as sku_type from order_lines),
per as (select order_ID, count(distinct sku_ID) as total_items, sum(cast(sku_type = '1' as bigint)) as n_1p,
          sum(cast(sku_type = 'MISSING' as bigint)) as n_missing from items group by order_ID)
select composition, count(*) as orders, round_even(count(*) / sum(count(*)) over (), 4) as pct
from (select *, case when n_missing > 0 then 'contains_missing_sku_info' when n_1p / total_items = 1.0 then 'all_1p'
                     when n_1p / total_items = 0.0 then 'all_3p' else 'mixed' end as composition from per)
group by composition""", "order_lines"))
def q_order_composition(spark, sf_dir):
    """Orders by 1P/3P composition with shares."""
    return nw.composition_counts(nw.order_composition(bind(spark, sf_dir).orders(columns=["order_ID", "sku_ID", "type"])))


@query("composition_by_size", sql("""
with items as (select distinct order_ID, sku_ID, coalesce(cast(type as varchar), 'MISSING') as sku_type from order_lines),
per as (select order_ID, count(distinct sku_ID) as total_items, sum(cast(sku_type = '1' as bigint)) as n_1p,
          sum(cast(sku_type = 'MISSING' as bigint)) as n_missing from items group by order_ID)
select total_items, composition, count(*) as orders
from (select *, case when n_missing > 0 then 'contains_missing_sku_info' when n_1p / total_items = 1.0 then 'all_1p'
                     when n_1p / total_items = 0.0 then 'all_3p' else 'mixed' end as composition from per)
group by all""", "order_lines"))
def q_composition_by_size(spark, sf_dir):
    """Composition counts by order size (distinct SKUs)."""
    return nw.composition_by_size(nw.order_composition(bind(spark, sf_dir).orders(columns=["order_ID", "sku_ID", "type"])))


@query("type_shares", sql("""
select coalesce(cast(type as varchar), 'MISSING') as sku_type, count(*) as order_rows, round(sum(quantity), 6) as quantity,
  round_even(count(*) / sum(count(*)) over (), 3) as pct_rows from order_lines group by 1""", "order_lines"))
def q_type_shares(spark, sf_dir):
    """Order rows and quantity by SKU type."""
    return nw.type_shares(bind(spark, sf_dir).orders(columns=["type", "quantity"]))


@query("sku_attribute_profile", sql("""
with p as (select * from sku where sku_ID in (select sku_ID from order_lines where sku_ID is not null))
select attribute, total, nulls, round(pct_null, 6) as pct_null, n_unique, n_numeric, is_numeric,
  round(numeric_mean, 6) as numeric_mean, round(numeric_min, 6) as numeric_min, round(numeric_max, 6) as numeric_max
from (
  select a.attribute, a.total, a.nulls, case when a.total > 0 then a.nulls / a.total else 0.0 end as pct_null,
    a.n_unique, a.n_numeric,
    cast(a.n_numeric > 0 and a.n_numeric / (a.total - a.nulls + 1e-9) > 0.1 as integer) as is_numeric,
    case when a.n_numeric > 0 and a.n_numeric / (a.total - a.nulls + 1e-9) > 0.1 then a.m end as numeric_mean,
    case when a.n_numeric > 0 and a.n_numeric / (a.total - a.nulls + 1e-9) > 0.1 then a.lo end as numeric_min,
    case when a.n_numeric > 0 and a.n_numeric / (a.total - a.nulls + 1e-9) > 0.1 then a.hi end as numeric_max
  from (select 'attribute1' as attribute, count(*) as total, sum(cast(nullif(attribute1, '-') is null as bigint)) as nulls,
          count(distinct nullif(attribute1, '-')) as n_unique, count(try_cast(nullif(attribute1, '-') as double)) as n_numeric,
          avg(try_cast(nullif(attribute1, '-') as double)) as m, min(try_cast(nullif(attribute1, '-') as double)) as lo,
          max(try_cast(nullif(attribute1, '-') as double)) as hi from p
        union all
        select 'attribute2', count(*), sum(cast(nullif(attribute2, '-') is null as bigint)),
          count(distinct nullif(attribute2, '-')), count(try_cast(nullif(attribute2, '-') as double)),
          avg(try_cast(nullif(attribute2, '-') as double)), min(try_cast(nullif(attribute2, '-') as double)),
          max(try_cast(nullif(attribute2, '-') as double)) from p) a)""", "sku", "order_lines"))
def q_sku_attribute_profile(spark, sf_dir):
    """A45+J6: attribute profile of purchased SKUs."""
    t = bind(spark, sf_dir)
    return nw.attribute_profile(nw.purchased_skus(t.sku(), t.orders(columns=["sku_ID"])))


@query("top_brands", sql("""
select coalesce(cast(brand_ID as varchar), 'MISSING') as brand_ID, count(*) as count
from sku where sku_ID in (select sku_ID from order_lines where sku_ID is not null)
group by 1 order by count desc, brand_ID limit 20""", "sku", "order_lines"))
def q_top_brands(spark, sf_dir):
    """K2+A45: top 20 brands among purchased SKUs."""
    t = bind(spark, sf_dir)
    return nw.top_values(nw.purchased_skus(t.sku(), t.orders(columns=["sku_ID"])), "brand_ID", 20)
