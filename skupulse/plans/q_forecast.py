"""Registered queries: forecast inputs, rule forecasts, evaluation, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from skupulse import config
from skupulse.operators import evaluate as ev
from skupulse.operators import forecast as fc
from skupulse.operators import params
from skupulse.plans.oracle import cte, sql
from skupulse.plans.registry import query
from skupulse.session import share
from skupulse.sources.fixtures import DEMAND_COLUMNS, bind

SHIFT = "date '1998-03-01' + cast(cast({c} as date) - date '2024-01-01' as integer)"
LAGS, ROLLS = fc.AR_LAGS, fc.ROLL_WINDOWS


def _hist_sql(value, prefix, part, lag_fmt="{p}_lag_{n}", roll_fmt="{p}_roll_{n}"):
    pb = f"partition by {part} " if part else ""
    cols = [f"lag({value}, {n}) over ({pb}order by date) as {lag_fmt.format(p=prefix, n=n)}" for n in LAGS]
    for n in ROLLS:
        fr = f"({pb}order by date rows between {n} preceding and 1 preceding)"
        cols.append(f"case when count({value}) over {fr} = {n} then avg({value}) over {fr} end "
                    f"as {roll_fmt.format(p=prefix, n=n)}")
    return ", ".join(cols)


# --------------------------------------------------------------- panels

cte("opt_train", "select order_date as date, dc_des as warehouse, sku_cluster_ID, demand from wh_grid_train",
    "wh_grid_train")
cte("opt_wh", """
select distinct t.dc_des as warehouse from win_lines t join clusters c on t.sku_ID = c.sku_ID
where t.dc_des is not null""", "win_lines", "clusters")
cte("opt_test", """
with m as (select t.order_date, t.dc_des, c.sku_cluster_ID, t.quantity from test_lines t join clusters c on t.sku_ID = c.sku_ID),
d as (select order_date, dc_des, sku_cluster_ID, sum(quantity) as demand from m group by all)
select cast(ds.d as date) as date, w.warehouse, k.sku_cluster_ID, coalesce(d.demand, 0.0) as demand
from generate_series(timestamp '1998-03-25', timestamp '1998-03-31', interval 1 day) ds(d)
cross join opt_wh w cross join (select distinct sku_cluster_ID from clusters where sku_cluster_ID is not null) k
left join d on d.order_date = cast(ds.d as date) and d.dc_des = w.warehouse and d.sku_cluster_ID = k.sku_cluster_ID""",
    "test_lines", "clusters", "opt_wh")
cte("opt_full", "select * from opt_train union all select * from opt_test", "opt_train", "opt_test")

cte("ctx_lines", """
select *, coalesce((original_unit_price - final_unit_price) / nullif(original_unit_price, 0.0), 0.0) as discount_rate,
  cast(coalesce(try_cast(gift_item as double), 0.0) > 0 as double) as gift_flag
from order_lines where order_date between date '1998-03-01' and date '1998-03-31'""", "order_lines")

_G = ["global_discount", "global_units", "global_order_count", "global_gift_rate", "global_clicks",
      "global_click_users"]
cte("gctx", f"""
with b as (
  select cast(ds.d as date) as date, coalesce(o.global_discount, 0) as global_discount,
    coalesce(o.global_units, 0) as global_units, coalesce(o.global_order_count, 0) as global_order_count,
    coalesce(o.global_gift_rate, 0) as global_gift_rate, coalesce(c.global_clicks, 0) as global_clicks,
    coalesce(c.global_click_users, 0) as global_click_users
  from generate_series(timestamp '1998-03-01', timestamp '1998-03-31', interval 1 day) ds(d)
  left join (select order_date as date, avg(discount_rate) as global_discount, sum(quantity) as global_units,
               count(distinct order_ID) as global_order_count, avg(gift_flag) as global_gift_rate
             from ctx_lines group by 1) o on o.date = cast(ds.d as date)
  left join (select {SHIFT.format(c='request_time')} as date, count(*) as global_clicks,
               count(distinct case when user_ID <> '-' then user_ID end) as global_click_users
             from clicks group by 1) c on c.date = cast(ds.d as date))
select *, {", ".join(_hist_sql(g, g, None) for g in _G)} from b""", "ctx_lines", "clicks")

_W = ["wh_discount", "wh_units", "wh_order_count", "wh_gift_rate"]
cte("whctx", f"""
with b as (
  select cast(ds.d as date) as date, w.warehouse, coalesce(o.wh_discount, 0) as wh_discount,
    coalesce(o.wh_units, 0) as wh_units, coalesce(o.wh_order_count, 0) as wh_order_count,
    coalesce(o.wh_gift_rate, 0) as wh_gift_rate
  from generate_series(timestamp '1998-03-01', timestamp '1998-03-31', interval 1 day) ds(d) cross join opt_wh w
  left join (select order_date as date, dc_des as warehouse, avg(discount_rate) as wh_discount,
               sum(quantity) as wh_units, count(distinct order_ID) as wh_order_count, avg(gift_flag) as wh_gift_rate
             from ctx_lines group by all) o on o.date = cast(ds.d as date) and o.warehouse = w.warehouse)
select *, {", ".join(_hist_sql(g, g, "warehouse") for g in _W)} from b""", "ctx_lines", "opt_wh")

_TARGET_HIST = lambda part: _hist_sql("demand", "", part, "lag_{n}", "rolling_mean_{n}")

cte("dmat", f"""
with h as (select *, {_TARGET_HIST('warehouse, sku_cluster_ID')} from opt_full)
select h.*, w.* exclude (date, warehouse), g.* exclude (date), dayname(h.date) as dow,
  cast(isodow(h.date) >= 6 as integer) as is_weekend
from h left join whctx w on h.date = w.date and h.warehouse = w.warehouse left join gctx g on h.date = g.date""",
    "opt_full", "whctx", "gctx")

cte("cmat", f"""
with c as (select date, sku_cluster_ID, sum(demand) as demand from opt_full group by all),
h as (select *, {_TARGET_HIST('sku_cluster_ID')} from c)
select h.*, g.* exclude (date), dayname(h.date) as dow, cast(isodow(h.date) >= 6 as integer) as is_weekend
from h left join gctx g on h.date = g.date""", "opt_full", "gctx")

_RULES = {
    "lag_1": "coalesce(lag_1, 0.0)",
    "moving_average_3": "coalesce(rolling_mean_3, lag_1, 0.0)",
    "moving_average_7": "coalesce(rolling_mean_7, rolling_mean_3, lag_1, 0.0)",
    "blend_50_50": "0.5 * coalesce(lag_1, 0.0) + 0.5 * coalesce(rolling_mean_3, lag_1, 0.0)",
}


def _rules_sql(src, keys, start, end):
    parts = [f"select date, {keys}, '{m}' as model_name, cast({e} as double) as predicted_demand from {src} "
             f"where date between date '{start}' and date '{end}'" for m, e in _RULES.items()]
    return "\nunion all\n".join(parts)


def _shares_sql(last):
    return f"""
with a as (select p.*, t.cluster_total, dayname(p.date) as dow, p.demand / t.cluster_total as share
           from opt_train p join (select date, sku_cluster_ID, sum(demand) as cluster_total from opt_train
                                  where date <= date '{last}' group by all) t
             on p.date = t.date and p.sku_cluster_ID = t.sku_cluster_ID
           where t.cluster_total > 0 and p.date <= date '{last}'),
d as (select sku_cluster_ID, warehouse, dow, avg(share) as share_dow from a group by all),
o as (select sku_cluster_ID, warehouse, avg(share) as share_overall from a group by all)
select coalesce(d.sku_cluster_ID, o.sku_cluster_ID) as sku_cluster_ID, coalesce(d.warehouse, o.warehouse) as warehouse,
  d.dow, d.share_dow, o.share_overall
from d full join o on d.sku_cluster_ID = o.sku_cluster_ID and d.warehouse = o.warehouse"""


cte("shares_valid", _shares_sql("1998-03-17"), "opt_train")
cte("shares_test", _shares_sql("1998-03-24"), "opt_train")


def _alloc_sql(cpred, shares):
    return f"""
with base as (select w.warehouse, k.sku_cluster_ID, d.date, dayname(d.date) as dow
              from opt_wh w cross join (select distinct sku_cluster_ID from clusters where sku_cluster_ID is not null) k
              cross join (select distinct date from {cpred}) d),
al as (select b.*, coalesce(s.share_dow, s.share_overall, 0.0) as share0 from base b
       left join {shares} s on b.sku_cluster_ID = s.sku_cluster_ID and b.warehouse = s.warehouse and b.dow = s.dow),
al2 as (select *, case when sum(share0) over (partition by date, sku_cluster_ID) > 0
                   then share0 / sum(share0) over (partition by date, sku_cluster_ID)
                   else 1.0 / (select count(*) from opt_wh) end as share from al)
select al2.date, al2.warehouse, al2.sku_cluster_ID, p.model_name,
  coalesce(p.predicted_demand, 0.0) * al2.share as predicted_demand
from al2 join {cpred} p on al2.date = p.date and al2.sku_cluster_ID = p.sku_cluster_ID"""


cte("cpred_valid", _rules_sql("cmat", "sku_cluster_ID", "1998-03-18", "1998-03-24"), "cmat")
cte("cpred_test", _rules_sql("cmat", "sku_cluster_ID", "1998-03-25", "1998-03-31"), "cmat")


def _tagged(src, approach, level):
    return (f"select *, '{approach}__' || model_name as model_id, '{approach}' as approach, "
            f"'{level}' as prediction_level, 'baseline' as family from ({src})")


cte("preds_valid", "\nunion all\n".join([
    _tagged(_rules_sql("dmat", "warehouse, sku_cluster_ID", "1998-03-18", "1998-03-24"), "direct_warehouse",
            "direct warehouse-cluster"),
    _tagged(_alloc_sql("cpred_valid", "shares_valid"), "cluster_to_warehouse",
            "cluster total then warehouse allocation")]), "dmat", "cpred_valid", "shares_valid", "opt_wh", "clusters")
cte("preds_test", "\nunion all\n".join([
    _tagged(_rules_sql("dmat", "warehouse, sku_cluster_ID", "1998-03-25", "1998-03-31"), "direct_warehouse",
            "direct warehouse-cluster"),
    _tagged(_alloc_sql("cpred_test", "shares_test"), "cluster_to_warehouse",
            "cluster total then warehouse allocation")]), "dmat", "cpred_test", "shares_test", "opt_wh", "clusters")

cte("sku_price", """
select sku_ID, avg(original_unit_price) as sku_price from order_lines
where order_date between date '1998-03-01' and date '1998-03-24' and sku_ID is not null
  and original_unit_price is not null and quantity is not null and quantity > 0 and original_unit_price > 0
group by sku_ID""", "order_lines")
cte("cprice", """
with m as (select distinct sku_ID, sku_cluster_ID from clusters where sku_ID is not null and sku_cluster_ID is not null),
cp as (select m.sku_cluster_ID, avg(s.sku_price) as p from m left join sku_price s on m.sku_ID = s.sku_ID group by 1),
g as (select coalesce(avg(sku_price), 0.0) as g from sku_price)
select k.sku_cluster_ID, coalesce(cp.p, g.g) as p_s, cast(cp.p is null as integer) as filled_with_global_mean
from (select distinct sku_cluster_ID from opt_train) k left join cp on k.sku_cluster_ID = cp.sku_cluster_ID cross join g""",
    "clusters", "sku_price", "opt_train")

_META = "model_id, approach, prediction_level, model_name, family"


def _merged_sql(actual, preds):
    return f"""
select m.*, m.abs_error * m.p_s as price_weighted_abs_error,
  m.underprediction * m.p_s * {config.SHORTAGE_COST_U} as purchase_cost_proxy,
  m.overprediction * m.p_s * {config.HOLDING_COST_H} as holding_cost_proxy
from (select a.date, a.warehouse, a.sku_cluster_ID, a.demand,
        coalesce(p.model_id, 'unknown') as model_id, coalesce(p.approach, 'unknown') as approach,
        coalesce(p.prediction_level, 'unknown') as prediction_level, coalesce(p.model_name, 'unknown') as model_name,
        coalesce(p.family, 'unknown') as family, coalesce(p.predicted_demand, 0.0) as predicted_demand,
        coalesce(c.p_s, 0.0) as p_s,
        coalesce(p.predicted_demand, 0.0) - a.demand as prediction_error,
        abs(coalesce(p.predicted_demand, 0.0) - a.demand) as abs_error,
        -least(coalesce(p.predicted_demand, 0.0) - a.demand, 0.0) as underprediction,
        greatest(coalesce(p.predicted_demand, 0.0) - a.demand, 0.0) as overprediction
      from {actual} a left join {preds} p
        on a.date = p.date and a.warehouse = p.warehouse and a.sku_cluster_ID = p.sku_cluster_ID
      left join cprice c on a.sku_cluster_ID = c.sku_cluster_ID) m"""


cte("merged_test", _merged_sql("opt_test", "preds_test"), "opt_test", "preds_test", "cprice")
cte("merged_valid", _merged_sql("(select * from opt_train where date >= date '1998-03-18')", "preds_valid"),
    "opt_train", "preds_valid", "cprice")

_METRICS = """sum(demand) as actual_units, sum(predicted_demand) as predicted_units, avg(abs_error) as mae,
  sqrt(avg(prediction_error * prediction_error)) as rmse,
  case when sum(demand) <> 0 then sum(abs_error) / sum(demand) end as wape,
  case when sum(demand) <> 0 then sum(prediction_error) / sum(demand) end as bias,
  sum(underprediction) as underprediction_units, sum(overprediction) as overprediction_units,
  sum(price_weighted_abs_error) as price_weighted_abs_error, sum(purchase_cost_proxy) as purchase_cost_proxy,
  sum(holding_cost_proxy) as holding_cost_proxy"""
_MCOLS = ["actual_units", "predicted_units", "mae", "rmse", "wape", "bias", "underprediction_units",
          "overprediction_units", "price_weighted_abs_error", "purchase_cost_proxy", "holding_cost_proxy"]

cte("tsum", f"select {_META}, {_METRICS} from merged_test group by all", "merged_test")
cte("vsum", f"select {_META}, {_METRICS} from merged_valid group by all", "merged_valid")


def _r(cols, pre=""):
    return ", ".join(f"round({pre}{c}, 6) as {c}" for c in cols)


# --------------------------------------------------------------- Spark side

class Inputs:
    """Shared sub-plans of one forecast query, each built once so the plan
    is a DAG (Spark reuses identical exchanges) and no input is re-derived
    per branch."""

    def __init__(self, spark, sf_dir):
        self.t = bind(spark, sf_dir)
        self.mapping = self.t.clusters()
        self._cache = {}

    @property
    def lines(self):
        """The month's order lines with the columns that panels, contexts and
        prices read; written once, columnar, when first asked for."""
        return self._memo("lines", lambda: share(self.t.window_orders(DEMAND_COLUMNS)))

    @property
    def facts(self):
        return self._memo("facts", lambda: fc.panel_facts(self.lines, self.mapping))

    @property
    def full(self):
        """The dense panel, hand-off between the data stage and the model stage;
        written once, split by date afterwards."""
        return self._memo("full", lambda: share(fc.facts_panels(self.facts, self.mapping)[2]))

    @property
    def train(self):
        return self.full.filter(F.col("date") <= F.lit(config.TRAIN_END))

    @property
    def test(self):
        return self.full.filter(F.col("date") >= F.lit(config.TEST_START))

    @property
    def wh(self):
        return fc.facts_warehouses(self.facts)

    @property
    def clusters(self):
        return self.mapping.select("sku_cluster_ID").dropna().distinct()

    def _memo(self, key, fn):
        if key not in self._cache:
            self._cache[key] = fn()
        return self._cache[key]

    def gctx(self):
        return self._memo("gctx", lambda: fc.global_context(self.lines, self.t.clicks(), config.WINDOW_START,
                                                            config.WINDOW_END))

    def whctx(self):
        return self._memo("whctx", lambda: fc.warehouse_context(self.lines, self.wh, config.WINDOW_START,
                                                                config.WINDOW_END))

    def dmat(self):
        return self._memo("dmat", lambda: share(fc.training_matrix(
            self.full, fc.KEYS, self.whctx().join(self.gctx(), "date", "left"), ["date", "warehouse"])))

    def cmat(self):
        return self._memo("cmat", lambda: share(fc.training_matrix(
            fc.cluster_level_panel(self.full), ["sku_cluster_ID"], self.gctx(), ["date"])))

    def cprice(self):
        return self._memo("cprice", lambda: params.cluster_prices(self.lines, self.mapping, self.train))

    def predictions(self, start, end, shares_last):
        def build():
            direct = fc.tag(fc.rule_forecasts(self.dmat(), fc.KEYS, start, end), "direct_warehouse",
                            "direct warehouse-cluster")
            cpred = fc.rule_forecasts(self.cmat(), ["sku_cluster_ID"], start, end)
            shares = fc.allocation_shares(self.train.filter(F.col("date") <= F.lit(shares_last)))
            alloc = fc.tag(fc.allocate(cpred, shares, self.wh, self.clusters), "cluster_to_warehouse",
                           "cluster total then warehouse allocation")
            return share(direct.unionByName(alloc))
        return self._memo(("pred", start, end, shares_last), build)

    def merged_test(self):
        return self._memo("mt", lambda: ev.join_actual(
            self.test, self.predictions(config.TEST_START, config.TEST_END, config.TRAIN_END), self.cprice()))

    def merged_valid(self):
        actual = self.train.filter(F.col("date") >= F.lit(config.VALID_START))
        return self._memo("mv", lambda: ev.join_actual(
            actual, self.predictions(config.VALID_START, config.VALID_END, config.INNER_TRAIN_END), self.cprice()))


def _panels(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return i.train, i.test, i.full


def _lines(spark, sf_dir):
    return bind(spark, sf_dir).window_orders(DEMAND_COLUMNS)


# --------------------------------------------------------------- queries

@query("opt_test_panel", sql("select date, warehouse, sku_cluster_ID, round(demand, 6) as demand from opt_test",
                             "opt_test"))
def q_opt_test_panel(spark, sf_dir):
    """D3: test panel aligned to train clusters over all observed warehouses."""
    return _panels(spark, sf_dir)[1]


@query("test_panel_alignment", sql("""
with seen as (select distinct t.order_date, t.dc_des, c.sku_cluster_ID from test_lines t
  join clusters c on t.sku_ID = c.sku_ID where t.dc_des is not null),
n as (select sku_cluster_ID, count(*) as k from seen group by 1)
select p.sku_cluster_ID, coalesce(max(n.k), 0) as observed_cells, count(*) - coalesce(max(n.k), 0) as filled_cells,
  cast(coalesce(max(n.k), 0) = 0 as integer) as missing_in_test
from opt_test p left join n on p.sku_cluster_ID = n.sku_cluster_ID group by p.sku_cluster_ID""",
                                   "opt_test", "test_lines", "clusters"))
def q_test_panel_alignment(spark, sf_dir):
    """D3: what the alignment of the test panel filled, per train cluster."""
    i = Inputs(spark, sf_dir)
    return fc.panel_alignment(i.facts, i.test)


@query("global_context", sql(f"select date, global_order_count, global_clicks, global_click_users, "
                             f"global_order_count_lag_1, global_clicks_lag_1, global_click_users_lag_1, "
                             f"{_r(['global_discount', 'global_units', 'global_gift_rate', 'global_discount_roll_7', 'global_units_roll_3', 'global_units_roll_7', 'global_clicks_roll_7', 'global_click_users_roll_7', 'global_gift_rate_lag_7'])} "
                             f"from gctx", "gctx"))
def q_global_context(spark, sf_dir):
    """A25+W3: daily global order/click context with lags and rolling means."""
    return Inputs(spark, sf_dir).gctx().select(
        "date", "global_order_count", "global_clicks", "global_click_users", "global_order_count_lag_1",
        "global_clicks_lag_1", "global_click_users_lag_1", "global_discount", "global_units", "global_gift_rate",
        "global_discount_roll_7", "global_units_roll_3", "global_units_roll_7", "global_clicks_roll_7",
        "global_click_users_roll_7", "global_gift_rate_lag_7")


@query("warehouse_context", sql(f"select date, warehouse, wh_order_count, wh_order_count_lag_1, "
                                f"{_r(['wh_discount', 'wh_units', 'wh_gift_rate', 'wh_discount_lag_1', 'wh_discount_roll_3', 'wh_units_roll_7', 'wh_order_count_roll_7', 'wh_gift_rate_roll_7'])} "
                                f"from whctx", "whctx"))
def q_warehouse_context(spark, sf_dir):
    """A26+W3: per-warehouse daily context on the dense grid."""
    return Inputs(spark, sf_dir).whctx().select(
        "date", "warehouse", "wh_order_count", "wh_order_count_lag_1", "wh_discount", "wh_units", "wh_gift_rate",
        "wh_discount_lag_1", "wh_discount_roll_3", "wh_units_roll_7", "wh_order_count_roll_7",
        "wh_gift_rate_roll_7")


_CTX_OUT = ["lag_1", "lag_2", "lag_3", "lag_7", "rolling_mean_3", "rolling_mean_7", "wh_units_lag_1",
            "wh_discount_roll_7", "global_units_lag_1", "global_clicks_roll_7"]


@query("context_lags", sql(f"select date, warehouse, sku_cluster_ID, dow, is_weekend, {_r(['demand'] + _CTX_OUT)} "
                           f"from dmat", "dmat"))
def q_context_lags(spark, sf_dir):
    """Direct training matrix (target lags/rolling + contexts + day)."""
    return Inputs(spark, sf_dir).dmat().select("date", "warehouse", "sku_cluster_ID", "dow", "is_weekend", "demand",
                                       *_CTX_OUT)


@query("cluster_matrix", sql(f"select date, sku_cluster_ID, dow, is_weekend, "
                             f"{_r(['demand', 'lag_1', 'lag_7', 'rolling_mean_3', 'rolling_mean_7', 'global_units_lag_1'])} "
                             f"from cmat", "cmat"))
def q_cluster_matrix(spark, sf_dir):
    """Cluster-level training matrix with the global context."""
    return Inputs(spark, sf_dir).cmat().select("date", "sku_cluster_ID", "dow", "is_weekend", "demand", "lag_1", "lag_7",
                                       "rolling_mean_3", "rolling_mean_7", "global_units_lag_1")


@query("naive_forecasts", sql(f"select date, warehouse, sku_cluster_ID, {_META}, "
                              f"round(predicted_demand, 6) as predicted_demand from preds_test", "preds_test"))
def q_naive_forecasts(spark, sf_dir):
    """M12+M16: rule forecasts (lag-1, MA3, MA7, blend) for the test week,
    direct per warehouse and cluster-then-allocated."""
    return Inputs(spark, sf_dir).predictions(config.TEST_START, config.TEST_END, config.TRAIN_END).select(
        "date", "warehouse", "sku_cluster_ID", *ev.META, "predicted_demand")


@query("allocation_shares", sql("select sku_cluster_ID, warehouse, dow, round(share_dow, 6) as share_dow, "
                                "round(share_overall, 6) as share_overall from shares_test", "shares_test"))
def q_allocation_shares(spark, sf_dir):
    """Empirical weekday and overall warehouse shares of cluster demand."""
    return fc.allocation_shares(_panels(spark, sf_dir)[0])


@query("allocate_forecast", sql(f"""
select date, warehouse, sku_cluster_ID, model_name, round(predicted_demand, 6) as predicted_demand
from ({_alloc_sql('cpred_test', 'shares_test')})""", "cpred_test", "shares_test", "opt_wh", "clusters"))
def q_allocate_forecast(spark, sf_dir):
    """M16+J13+W9: cluster rule forecasts allocated to warehouses."""
    i = Inputs(spark, sf_dir)
    cpred = fc.rule_forecasts(i.cmat(), ["sku_cluster_ID"], config.TEST_START, config.TEST_END)
    return fc.allocate(cpred, fc.allocation_shares(i.train), i.wh, i.clusters)


@query("lag1_baseline", sql("""
with full_ as (
  select g.date, g.warehouse, g.sku_cluster_ID, coalesce(a.demand, 0.0) as demand
  from (select cast(ds.d as date) as date, w.warehouse, k.sku_cluster_ID
        from generate_series(timestamp '1998-03-01', timestamp '1998-03-31', interval 1 day) ds(d)
        cross join (select distinct warehouse from opt_test) w
        cross join (select distinct sku_cluster_ID from opt_test) k) g
  left join (select date, warehouse, sku_cluster_ID, sum(demand) as demand from opt_full group by all) a
    on g.date = a.date and g.warehouse = a.warehouse and g.sku_cluster_ID = a.sku_cluster_ID)
select * from (
  select date, warehouse, sku_cluster_ID, round(demand, 6) as demand,
    round(coalesce(lag(demand) over (partition by warehouse, sku_cluster_ID order by date), 0.0), 6) as predicted_demand,
    'baseline__lag_1_actual_demand' as model_id, 'lag_1_baseline' as approach,
    'direct warehouse-cluster' as prediction_level, 'lag_1_actual_demand' as model_name, 'naive_baseline' as family
  from full_) where date between date '1998-03-25' and date '1998-03-31'""", "opt_test", "opt_full"))
def q_lag1_baseline(spark, sf_dir):
    """Previous-day actual demand as the forecast for the test week."""
    tr, te, _ = _panels(spark, sf_dir)
    return fc.lag1_baseline(tr, te)


@query("sku_prices", sql("select sku_ID, round(sku_price, 6) as sku_price from sku_price", "sku_price"))
def q_sku_prices(spark, sf_dir):
    """Mean original unit price per SKU over positive train lines."""
    return params.sku_prices(_lines(spark, sf_dir))


@query("cluster_prices", sql("select sku_cluster_ID, round(p_s, 6) as p_s, filled_with_global_mean from cprice",
                             "cprice"))
def q_cluster_prices(spark, sf_dir):
    """Cluster price p_s with global-mean fill."""
    return Inputs(spark, sf_dir).cprice()


@query("price_coverage", sql("""
with tl as (select * from order_lines where order_date between date '1998-03-01' and date '1998-03-24'
              and sku_ID is not null and original_unit_price is not null and quantity is not null
              and quantity > 0 and original_unit_price > 0),
m as (select distinct sku_ID, sku_cluster_ID from clusters where sku_ID is not null and sku_cluster_ID is not null),
cov as (select * from tl where sku_ID in (select sku_ID from m)),
v as (select (select cast(count(*) as double) from m) as cluster_mapping_rows,
        (select cast(count(distinct sku_ID) as double) from m) as unique_mapped_skus,
        (select cast(count(*) as double) from sku_price) as priced_skus,
        (select coalesce(avg(sku_price), 0.0) from sku_price) as global_mean_sku_price,
        (select cast(sum(filled_with_global_mean) as double) from cprice) as missing_clusters_filled_with_global_mean,
        (select cast(count(distinct sku_ID) as double) from cov) as mo,
        (select sum(quantity) from tl) as units, (select coalesce(sum(quantity), 0.0) from cov) as cu)
select metric, round(value, 6) as value from (
  select 'cluster_mapping_rows' as metric, cluster_mapping_rows as value from v union all
  select 'unique_mapped_skus', unique_mapped_skus from v union all
  select 'priced_skus', priced_skus from v union all
  select 'global_mean_sku_price', global_mean_sku_price from v union all
  select 'missing_clusters_filled_with_global_mean', missing_clusters_filled_with_global_mean from v union all
  select 'order_sku_mapping_coverage', case when priced_skus > 0 then mo / priced_skus else 0.0 end from v union all
  select 'order_unit_mapping_coverage', case when units > 0 then cu / units else 0.0 end from v)""",
                             "order_lines", "clusters", "sku_price", "cprice"))
def q_price_coverage(spark, sf_dir):
    """Price and mapping coverage as (metric, value) rows."""
    i = Inputs(spark, sf_dir)
    return params.price_coverage(i.lines, i.mapping, i.train)


@query("metrics_overall", sql(f"select {_META}, {_r(_MCOLS)} from tsum", "tsum"))
def q_metrics_overall(spark, sf_dir):
    """E2+E3+E4: test-week metrics and cost proxies per model."""
    return ev.model_summary(Inputs(spark, sf_dir).merged_test())


@query("metrics_validation", sql(f"select {_META}, {_r(_MCOLS)} from vsum", "vsum"))
def q_metrics_validation(spark, sf_dir):
    """E2+E4: inner-validation metrics per model."""
    return ev.model_summary(Inputs(spark, sf_dir).merged_valid())


@query("metrics_by_cluster", sql(f"select {_META}, sku_cluster_ID, {_r(_MCOLS)} from "
                                 f"(select {_META}, sku_cluster_ID, {_METRICS} from merged_test group by all)",
                                 "merged_test"))
def q_metrics_by_cluster(spark, sf_dir):
    """Test metrics per model and cluster."""
    return ev.cluster_metrics(Inputs(spark, sf_dir).merged_test())


@query("metrics_by_warehouse", sql(f"select {_META}, warehouse, {_r(_MCOLS)} from "
                                   f"(select {_META}, warehouse, {_METRICS} from merged_test group by all)",
                                   "merged_test"))
def q_metrics_by_warehouse(spark, sf_dir):
    """Test metrics per model and warehouse."""
    return ev.warehouse_metrics(Inputs(spark, sf_dir).merged_test())


@query("daily_totals", sql(f"""
select {_META}, date, {_r(['actual_total_demand', 'predicted_total_demand', 'purchase_cost_proxy',
  'holding_cost_proxy', 'underprediction', 'overprediction'])},
  round(predicted_total_demand - actual_total_demand, 6) as error,
  round(abs(predicted_total_demand - actual_total_demand), 6) as abs_error
from (select {_META}, date, sum(demand) as actual_total_demand, sum(predicted_demand) as predicted_total_demand,
        sum(purchase_cost_proxy) as purchase_cost_proxy, sum(holding_cost_proxy) as holding_cost_proxy,
        sum(underprediction) as underprediction, sum(overprediction) as overprediction
      from merged_test group by all)""", "merged_test"))
def q_daily_totals(spark, sf_dir):
    """E5: daily totals by model with error of the totals."""
    return ev.daily_totals(Inputs(spark, sf_dir).merged_test())


_ORDER = ("validation_total_proxy_cost nulls last, purchase_cost_proxy nulls last, wape nulls last, "
          "rmse nulls last, mae nulls last, model_id")


@query("model_selection", sql(f"""
with s as (select *, purchase_cost_proxy + holding_cost_proxy as validation_total_proxy_cost,
             case when coalesce(wape <= 0.45 and bias >= -0.15 and bias <= 0.15, false) then 'eligible'
                  else 'screened_out' end as selection_status from vsum),
s2 as (select *, case when selection_status = 'eligible'
                        or max(case when selection_status = 'eligible' then 1 else 0 end) over () = 0
                      then 1 else 0 end as pool from s)
select {_META}, {_r(_MCOLS + ['validation_total_proxy_cost'])}, selection_status,
  row_number() over (order by {_ORDER}) as selection_order,
  case when pool = 1 and row_number() over (partition by pool order by {_ORDER}) = 1 then 1 else 0 end as is_selected
from s2""", "vsum"))
def q_model_selection(spark, sf_dir):
    """Validation screening (WAPE <= 0.45, |bias| <= 0.15) and selection."""
    return ev.model_selection(ev.model_summary(Inputs(spark, sf_dir).merged_valid()))


@query("model_comparison", sql(f"""
with c as (select v.model_id, v.approach, v.prediction_level, v.model_name, v.family,
             {", ".join(f"v.{m} as validation_{m}" for m in ev.METRIC_COLS)},
             {", ".join(f"t.{m} as test_{m}" for m in ev.METRIC_COLS)}
           from vsum v left join tsum t on v.model_id = t.model_id and v.approach = t.approach
             and v.prediction_level = t.prediction_level and v.model_name = t.model_name and v.family = t.family),
c2 as (select *, validation_purchase_cost_proxy + validation_holding_cost_proxy as validation_total_proxy_cost,
         test_purchase_cost_proxy + test_holding_cost_proxy as test_total_proxy_cost,
         case when coalesce(validation_wape <= 0.45 and validation_bias >= -0.15 and validation_bias <= 0.15, false)
              then 'eligible' else 'screened_out' end as validation_selection_status from c)
select {_META}, validation_selection_status,
  cast(validation_selection_status <> 'eligible' as integer) as validation_selection_rank,
  row_number() over (order by cast(validation_selection_status <> 'eligible' as integer),
    validation_total_proxy_cost nulls last, validation_purchase_cost_proxy nulls last, validation_wape nulls last,
    validation_rmse nulls last, model_id) as selection_rank,
  {_r([f'validation_{m}' for m in ev.METRIC_COLS] + [f'test_{m}' for m in ev.METRIC_COLS]
      + ['validation_total_proxy_cost', 'test_total_proxy_cost'])}
from c2""", "vsum", "tsum"))
def q_model_comparison(spark, sf_dir):
    """Validation vs test comparison table with selection rank."""
    i = Inputs(spark, sf_dir)
    return ev.model_comparison(ev.model_summary(i.merged_valid()), ev.model_summary(i.merged_test()))
