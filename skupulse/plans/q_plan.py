"""Registered queries: replenishment plans under several planning bases.

Scenarios: 'predicted' (the validation-selected forecast), 'lag1' (lag-1
baseline) and 'oracle' (actual demand); the benchmark queries plan with every
candidate.  Opening stock is the test-week initial inventory proxy.  In SQL the
order-dependent transfer rule is a recursive CTE: one step per (deficit, offer).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from skupulse import config
from skupulse.operators import candidates as cd
from skupulse.operators import evaluate as ev
from skupulse.operators import forecast as fc
from skupulse.operators import params
from skupulse.operators import plan as pl
from skupulse.plans import q_misc, q_models, q_network  # noqa: F401  (registers CTEs used below)
from skupulse.plans.oracle import cte, sql
from skupulse.plans.q_forecast import Inputs
from skupulse.plans.q_network import NetInputs
from skupulse.plans.registry import query
from skupulse.session import share


class PlanBase:
    """What every plan of a query reads: opening stock, prices, capacity,
    eligibility, routes and actual demand, each written once."""

    def __init__(self, spark, sf_dir, forecasts: Inputs | None = None):
        self.f = f = forecasts or Inputs(spark, sf_dir)
        self.n = n = NetInputs(spark, sf_dir)
        n.dc_day   # written first: the universe is read off it
        self.prices = share(f.cprice())
        shares = params.inventory_share(f.train, n.universe, f.clusters)
        wh = params.warehouse_daily_inventory(n.t.inventory(), n.dc_day, n.universe, config.WINDOW_START,
                                              config.WINDOW_END)
        self.opening = share(params.inventory_parameters(wh, shares).select(
            "sku_cluster_ID", "warehouse", F.col("I0_sj_test_initial").alias("inventory")))
        self.actual = f.test
        self.capacity = share(params.capacity(n.universe, n.legacy, n.dc_day))
        self.eligibility = params.procurement(n.t.network(), n.universe)
        self.routes = share(params.route_inputs(params.routes(n.lead_times, n.universe), n.universe))

    @property
    def scenarios(self):
        """Planning demand of the three bases."""
        f = self.f
        sel = ev.model_selection(ev.model_summary(f.merged_valid())).filter("is_selected = 1").select("model_id")
        pred = (f.predictions(config.TEST_START, config.TEST_END, config.TRAIN_END)
                .join(sel, "model_id", "left_semi")
                .select(F.lit("predicted").alias("scenario"), "date", "sku_cluster_ID", "warehouse",
                        F.col("predicted_demand").alias("demand")))
        lag1 = fc.lag1_baseline(f.train, f.test).select(
            F.lit("lag1").alias("scenario"), "date", "sku_cluster_ID", "warehouse",
            F.col("predicted_demand").alias("demand"))
        oracle = f.test.select(F.lit("oracle").alias("scenario"), "date", "sku_cluster_ID", "warehouse", "demand")
        return pred.unionByName(lag1).unionByName(oracle)


class Plan:
    """Plans of all scenarios of a planning table, and how they turn out."""

    def __init__(self, base: PlanBase, planning, transfers: bool = True, cells=None):
        self.base, self._with = base, transfers
        self.cells = share(pl.plan_inputs(planning, base.opening, base.n.universe, base.f.clusters)) if cells is None else cells

    def without_transfers(self) -> "Plan":
        return Plan(self.base, None, False, self.cells)

    @cached_property
    def transfers(self):
        return share(pl.rule_transfers(self.cells, self.base.routes)) if self._with else None

    @cached_property
    def position(self):
        return share(pl.plan_position(self.cells, self.transfers, self.base.eligibility, self.base.prices))

    @cached_property
    def realized(self):
        return pl.realize(self.position, self.base.actual)

    @cached_property
    def trimmed(self):
        return pl.capacity_trim(self.realized, self.base.capacity)

    @property
    def planned_day(self):
        return pl.planned_metrics(self.position, self.transfers, self.base.prices)

    @property
    def realized_day(self):
        return pl.realized_metrics(self.trimmed, self.transfers, self.base.prices)

    @property
    def weekly(self):
        return pl.policy_weekly(self.planned_day, self.realized_day)


def PlanInputs(spark, sf_dir) -> Plan:
    base = PlanBase(spark, sf_dir)
    return Plan(base, base.scenarios)


# ----------------------------------------------------------------- SQL

cte("route_in", """
with b as (select a.warehouse as dc_ori, c.warehouse as dc_des, r.t_nm, r.r_nm
           from wuniv a cross join wuniv c left join routes_t r on r.dc_ori = a.warehouse and r.dc_des = c.warehouse),
m as (select coalesce(quantile_cont(t_nm, 0.5), 24.0) as med from b)
select dc_ori as source_warehouse, dc_des as destination_warehouse, coalesce(r_nm, 0) as route_feasible,
  coalesce(t_nm, m.med) as lead_time_hours from b cross join m where dc_ori <> dc_des""", "wuniv", "routes_t")
cte("eligible", """
select u.warehouse, coalesce(w.W_j, 0) as W_j from wuniv u
left join (select dc_ID as warehouse, max(cast(dc_ID = region_ID as integer)) as W_j from network group by 1) w
  on u.warehouse = w.warehouse""", "wuniv", "network")
cte("scenario_demand", """
select 'predicted' as scenario, date, sku_cluster_ID, warehouse, predicted_demand as demand from preds_test
where model_id in (select model_id from selected_id)
union all select 'lag1', date, sku_cluster_ID, warehouse, predicted_demand from lag1b
union all select 'oracle', date, sku_cluster_ID, warehouse, demand from opt_test""",
    "preds_test", "selected_id", "lag1b", "opt_test")
cte("candidate_demand", """
select model_id as scenario, date, sku_cluster_ID, warehouse, predicted_demand as demand from cand_aligned""", "cand_aligned")

_G = "scenario, date, sku_cluster_ID"
_K, _H, _U = config.TRANSFER_COST_K, config.HOLDING_COST_H, config.SHORTAGE_COST_U


def _cells_sql(planning: str) -> str:
    return f"""
select d.scenario, d.date, k.sku_cluster_ID, w.warehouse, coalesce(p.demand, 0.0) as demand,
  coalesce(i.I0_sj_test_initial, 0.0) as inventory
from (select distinct scenario, date from {planning}) d cross join (select distinct sku_cluster_ID from clusters) k
cross join wuniv w
left join (select {_G}, warehouse, sum(demand) as demand from {planning} group by all) p
  on p.scenario = d.scenario and p.date = d.date and p.sku_cluster_ID = k.sku_cluster_ID and p.warehouse = w.warehouse
left join invparam i on i.sku_cluster_ID = k.sku_cluster_ID and i.warehouse = w.warehouse"""


def _transfers_sql(cells: str) -> str:
    """The rule, step by step: offers of a group in order (largest deficit, then
    shortest route), the state being what each warehouse lacks and spares."""
    return f"""
with recursive gap as materialized (select {_G}, warehouse, demand - inventory as gap from {cells}),
route as materialized (select * from route_in where route_feasible = 1),
offer as materialized (
  select a.scenario, a.date, a.sku_cluster_ID, s.warehouse as src, a.warehouse as dst, r.lead_time_hours as hours,
    row_number() over (partition by a.scenario, a.date, a.sku_cluster_ID
                       order by a.gap desc, a.warehouse, r.lead_time_hours, s.warehouse) as step
  from gap a join route r on r.destination_warehouse = a.warehouse
  join gap s on s.scenario = a.scenario and s.date = a.date and s.sku_cluster_ID = a.sku_cluster_ID
    and s.warehouse = r.source_warehouse
  where a.gap > 1e-8 and s.gap < -1e-8),
opening as materialized (
  select {_G}, map_from_entries(list((warehouse, greatest(gap, 0.0)))) as need,
    map_from_entries(list((warehouse, greatest(-gap, 0.0)))) as spare
  from gap group by all),
draw as (
  select {_G}, cast(0 as bigint) as step, cast(null as integer) as src, cast(null as integer) as dst,
    cast(null as double) as hours, cast(0 as double) as units, need, spare from opening
  union all
  select scenario, date, sku_cluster_ID, step, src, dst, hours, u,
    map_from_entries(list_transform(map_entries(need), lambda e: (e.key, case when e.key = dst then e.value - u else e.value end))),
    map_from_entries(list_transform(map_entries(spare), lambda e: (e.key, case when e.key = src then e.value - u else e.value end)))
  from (select o.scenario, o.date, o.sku_cluster_ID, o.step, o.src, o.dst, o.hours, d.need, d.spare,
          case when d.need[o.dst] > 1e-8 and d.spare[o.src] > 1e-8 then least(d.need[o.dst], d.spare[o.src]) else 0.0 end as u
        from draw d join offer o on o.scenario = d.scenario and o.date = d.date
          and o.sku_cluster_ID = d.sku_cluster_ID and o.step = d.step + 1))
select {_G}, src as source_warehouse, dst as destination_warehouse, units as transfer_units, 1 as route_feasible,
  hours as lead_time_hours from draw where units > 1e-8"""


def _position_sql(cells: str, transfers: str | None) -> str:
    flows = f"""
left join (select {_G}, destination_warehouse as warehouse, sum(transfer_units) as u from {transfers} group by all) a
  on a.scenario = c.scenario and a.date = c.date and a.sku_cluster_ID = c.sku_cluster_ID and a.warehouse = c.warehouse
left join (select {_G}, source_warehouse as warehouse, sum(transfer_units) as u from {transfers} group by all) b
  on b.scenario = c.scenario and b.date = c.date and b.sku_cluster_ID = c.sku_cluster_ID and b.warehouse = c.warehouse
""" if transfers else ""
    inc, out = ("coalesce(a.u, 0.0)", "coalesce(b.u, 0.0)") if transfers else ("0.0::double", "0.0::double")
    return f"""
with x as (select c.*, {inc} as incoming, {out} as outgoing, coalesce(e.W_j, 0) as W_j, coalesce(p.p_s, 0.0) as p_s
           from {cells} c {flows} left join eligible e on e.warehouse = c.warehouse
           left join cprice p on p.sku_cluster_ID = c.sku_cluster_ID),
y as (select *, inventory + incoming - outgoing as before,
        case when W_j >= 1 then greatest(demand - (inventory + incoming - outgoing), 0.0) else 0.0 end as procurement_units from x),
z as (select *, greatest(demand - (before + procurement_units), 0.0) as planned_shortage_units,
        greatest(before + procurement_units - demand, 0.0) as planned_ending_inventory from y)
select *, planned_shortage_units * p_s * {_U} as planned_shortage_cost,
  planned_ending_inventory * p_s * {_H} as planned_holding_cost from z"""


def _realized_sql(position: str) -> str:
    return f"""
with x as (select p.*, coalesce(t.demand, 0.0) as actual_demand,
             p.inventory + p.procurement_units + p.incoming - p.outgoing as avail
           from {position} p left join opt_test t
             on t.date = p.date and t.sku_cluster_ID = p.sku_cluster_ID and t.warehouse = p.warehouse)
select *, greatest(actual_demand - avail, 0.0) as realized_shortage_units,
  greatest(avail - actual_demand, 0.0) as realized_ending_inventory,
  greatest(actual_demand - avail, 0.0) * p_s * {_U} as realized_shortage_cost,
  greatest(avail - actual_demand, 0.0) * p_s * {_H} as realized_holding_cost from x"""


def _trimmed_sql(realized: str) -> str:
    return f"""
with x as (select r.*, coalesce(c.C_j, 0.0) as C_j from {realized} r left join capacity_t c on c.warehouse = r.warehouse),
y as (select *, greatest(sum(realized_ending_inventory) over (partition by scenario, date, warehouse) - C_j, 0.0) as overflow,
        coalesce(sum(realized_ending_inventory) over (partition by scenario, date, warehouse order by p_s, sku_cluster_ID
                 rows between unbounded preceding and 1 preceding), 0.0) as lower_priced from x),
z as (select *, case when overflow > 1e-8 then least(realized_ending_inventory, greatest(overflow - lower_priced, 0.0))
                else 0.0 end as realized_capacity_overflow from y)
select * replace (greatest(realized_ending_inventory - realized_capacity_overflow, 0.0) as realized_ending_inventory),
  realized_capacity_overflow * p_s * {_H} as realized_overflow_cost from z"""


def _transfer_day_sql(transfers: str | None, kind: str) -> str:
    if not transfers:
        return (f"(select null::varchar as scenario, null::date as date, 0.0::double as {kind}_transfer_units, "
                f"0.0::double as {kind}_transfer_cost where false)")
    return f"""(select t.scenario, t.date, sum(t.transfer_units) as {kind}_transfer_units,
      sum({_K} * coalesce(p.p_s, 0.0) * t.lead_time_hours * t.transfer_units) as {kind}_transfer_cost
    from {transfers} t left join cprice p on p.sku_cluster_ID = t.sku_cluster_ID group by all)"""


def _planned_day_sql(position: str, transfers: str | None) -> str:
    return f"""
with m as (select scenario, date, sum(demand) as planned_demand_units, sum(planned_shortage_units) as planned_shortage_units,
             sum(planned_ending_inventory) as planned_ending_inventory_units,
             sum(procurement_units) as planned_procurement_units, sum(planned_shortage_cost) as planned_shortage_cost,
             sum(planned_holding_cost) as planned_holding_cost from {position} group by all)
select m.*, coalesce(planned_transfer_units, 0.0) as planned_transfer_units,
  coalesce(planned_transfer_cost, 0.0) as planned_transfer_cost,
  case when planned_demand_units <> 0 then (planned_demand_units - planned_shortage_units) / planned_demand_units else 1.0 end
    as planned_service_level,
  planned_shortage_cost + planned_holding_cost + coalesce(planned_transfer_cost, 0.0) as planned_total_cost
from m left join {_transfer_day_sql(transfers, 'planned')} t on t.scenario = m.scenario and t.date = m.date"""


def _realized_day_sql(trimmed: str, transfers: str | None) -> str:
    return f"""
with m as (select scenario, date, sum(actual_demand) as actual_demand_units,
             sum(realized_shortage_units) as realized_shortage_units,
             sum(realized_ending_inventory) as realized_ending_inventory_units,
             sum(realized_capacity_overflow) as realized_overflow_units,
             sum(procurement_units) as realized_procurement_units, sum(realized_shortage_cost) as realized_shortage_cost,
             sum(realized_holding_cost) as realized_holding_cost, sum(realized_overflow_cost) as realized_overflow_cost
           from {trimmed} group by all)
select m.*, coalesce(realized_transfer_units, 0.0) as realized_transfer_units,
  coalesce(realized_transfer_cost, 0.0) as realized_transfer_cost,
  case when actual_demand_units <> 0 then (actual_demand_units - realized_shortage_units) / actual_demand_units else 1.0 end
    as realized_service_level,
  realized_shortage_cost + realized_holding_cost + realized_overflow_cost + coalesce(realized_transfer_cost, 0.0)
    as realized_total_cost
from m left join {_transfer_day_sql(transfers, 'realized')} t on t.scenario = m.scenario and t.date = m.date"""


def _weekly_sql(planned: str, realized: str) -> str:
    return f"""
with d as (select coalesce(p.scenario, r.scenario) as scenario, p.* exclude (scenario, date), r.* exclude (scenario, date)
           from {planned} p full join {realized} r on p.scenario = r.scenario and p.date = r.date),
w as (select scenario, {", ".join(f"sum({c}) as {c}" for c in pl.WEEKLY_SUMS)} from d group by 1)
select *, case when actual_demand_units <> 0 then 1.0 - realized_shortage_units / actual_demand_units else 1.0 end
  as realized_service_level from w"""


def _plan_ctes(name: str, planning: str) -> None:
    """The plans of a planning table, with (name_) and without (name0_) transfers."""
    cte(f"{name}_cells", _cells_sql(planning), planning, "clusters", "wuniv", "invparam")
    cte(f"{name}_tr", _transfers_sql(f"{name}_cells"), f"{name}_cells", "route_in")
    for pre, tr in ((name, f"{name}_tr"), (f"{name}0", None)):
        deps = (tr,) if tr else ()
        cte(f"{pre}_pos", _position_sql(f"{name}_cells", tr), f"{name}_cells", "eligible", "cprice", *deps)
        cte(f"{pre}_real", _realized_sql(f"{pre}_pos"), f"{pre}_pos", "opt_test")
        cte(f"{pre}_trim", _trimmed_sql(f"{pre}_real"), f"{pre}_real", "capacity_t")
        cte(f"{pre}_pday", _planned_day_sql(f"{pre}_pos", tr), f"{pre}_pos", "cprice", *deps)
        cte(f"{pre}_rday", _realized_day_sql(f"{pre}_trim", tr), f"{pre}_trim", "cprice", *deps)
        cte(f"{pre}_week", _weekly_sql(f"{pre}_pday", f"{pre}_rday"), f"{pre}_pday", f"{pre}_rday")


_plan_ctes("plan", "scenario_demand")
_plan_ctes("cand", "candidate_demand")


def _r(cols):
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


# ----------------------------------------------------------------- queries

@query("rule_transfer_plan", sql(f"""
select {_G}, source_warehouse, destination_warehouse, route_feasible, {_r(['transfer_units', 'lead_time_hours'])}
from plan_tr""", "plan_tr"))
def q_rule_transfer_plan(spark, sf_dir):
    """Greedy rule transfers per (scenario, day, cluster)."""
    return PlanInputs(spark, sf_dir).transfers


_POSITION = ["demand", "inventory", "incoming", "outgoing", "procurement_units", "planned_shortage_units",
             "planned_ending_inventory", "planned_shortage_cost", "planned_holding_cost"]


@query("plan_position", sql(f"select {_G}, warehouse, {_r(_POSITION)} from plan_pos", "plan_pos"))
def q_plan_position(spark, sf_dir):
    """Procurement, planned shortage and ending stock per cell."""
    return PlanInputs(spark, sf_dir).position.select(
        *pl.CELL, *_POSITION)


_PDAY = ["planned_demand_units", "planned_shortage_units", "planned_ending_inventory_units", "planned_procurement_units",
         "planned_shortage_cost", "planned_holding_cost", "planned_transfer_units", "planned_transfer_cost",
         "planned_service_level", "planned_total_cost"]
_RDAY = ["actual_demand_units", "realized_shortage_units", "realized_ending_inventory_units", "realized_overflow_units",
         "realized_procurement_units", "realized_shortage_cost", "realized_holding_cost", "realized_overflow_cost",
         "realized_transfer_units", "realized_transfer_cost", "realized_service_level", "realized_total_cost"]


@query("planned_metrics", sql(f"select scenario, date, {_r(_PDAY)} from plan_pday", "plan_pday"))
def q_planned_metrics(spark, sf_dir):
    """Planned daily totals, service level and costs per scenario."""
    return PlanInputs(spark, sf_dir).planned_day


_REALIZED = ["actual_demand", "realized_shortage_units", "realized_ending_inventory", "realized_shortage_cost",
             "realized_holding_cost"]


@query("realize_day", sql(f"select {_G}, warehouse, {_r(_REALIZED)} from plan_real", "plan_real"))
def q_realize_day(spark, sf_dir):
    """P5: realised shortage / ending stock against actual demand."""
    return PlanInputs(spark, sf_dir).realized.select(
        *pl.CELL, *_REALIZED)


@query("capacity_trim", sql(f"""
select {_G}, warehouse, {_r(['realized_ending_inventory', 'realized_capacity_overflow', 'realized_overflow_cost'])}
from plan_trim""", "plan_trim"))
def q_capacity_trim(spark, sf_dir):
    """P6+W12: overflow above capacity trimmed from the cheapest clusters."""
    return PlanInputs(spark, sf_dir).trimmed.select(
        *pl.CELL, "realized_ending_inventory", "realized_capacity_overflow", "realized_overflow_cost")


@query("replay_plan", sql(f"""
with x as (select *, inventory + sum(procurement_units + incoming - outgoing - actual_demand) over w as s from plan_real
           window w as (partition by scenario, sku_cluster_ID, warehouse order by date rows between unbounded preceding and current row)),
y as (select *, s - least(0.0, min(s) over w) as replayed_inventory from x
      window w as (partition by scenario, sku_cluster_ID, warehouse order by date rows between unbounded preceding and current row))
select {_G}, warehouse, {_r(['actual_demand', 'procurement_units', 'incoming', 'outgoing', 'replayed_inventory'])}
from y""", "plan_real"))
def q_replay_plan(spark, sf_dir):
    """Fixed plan replayed over the week (closed-form carried stock)."""
    i = PlanInputs(spark, sf_dir)
    return pl.replay_plan(i.position, i.base.actual)


@query("realized_metrics", sql(f"select scenario, date, {_r(_RDAY)} from plan_rday", "plan_rday"))
def q_realized_metrics(spark, sf_dir):
    """Realised daily totals, service level and costs per scenario."""
    return PlanInputs(spark, sf_dir).realized_day


@query("policy_weekly", sql(f"select scenario, {_r([*pl.WEEKLY_SUMS, 'realized_service_level'])} from plan_week", "plan_week"))
def q_policy_weekly(spark, sf_dir):
    """Weekly policy summary per scenario."""
    return PlanInputs(spark, sf_dir).weekly


@query("plan_audit", sql(f"""
with c as (select p.*, coalesce(k.C_j, 0.0) as C_j,
             p.inventory + p.incoming - p.outgoing + p.procurement_units - p.demand + p.planned_shortage_units
               - p.planned_ending_inventory as resid
           from plan_pos p left join capacity_t k on k.warehouse = p.warehouse),
cell as (select scenario, count(*) as cells, max(abs(resid)) as max_balance_residual,
           count_if(abs(resid) > 1e-6) as balance_violations,
           count_if(procurement_units < -1e-8 or planned_shortage_units < -1e-8 or planned_ending_inventory < -1e-8)
             as negativity_violations,
           count_if(planned_shortage_units > demand + 1e-6) as shortage_violations,
           count_if(planned_ending_inventory > C_j + 1e-6) as cell_capacity_violations,
           count_if(procurement_units > (C_j + demand) * W_j + 1e-6) as procurement_violations,
           sum(planned_holding_cost + planned_shortage_cost) as stock_cost from c group by 1),
wh as (select scenario, count_if(inv > C_j + 1e-6) as warehouse_capacity_violations
       from (select scenario, date, warehouse, sum(planned_ending_inventory) as inv, min(C_j) as C_j from c group by all) group by 1),
tv as (select t.scenario, count_if(t.transfer_units > (coalesce(n.C_j, 0.0) + coalesce(m.C_j, 0.0) + coalesce(d.demand, 0.0))
                                   * t.route_feasible + 1e-6) as transfer_violations,
         count_if(t.transfer_units < -1e-8) as transfer_negativity_violations,
         sum({_K} * coalesce(p.p_s, 0.0) * t.lead_time_hours * t.transfer_units) as transfer_cost
       from plan_tr t left join capacity_t n on n.warehouse = t.source_warehouse
       left join capacity_t m on m.warehouse = t.destination_warehouse
       left join plan_pos d on d.scenario = t.scenario and d.date = t.date and d.sku_cluster_ID = t.sku_cluster_ID
         and d.warehouse = t.source_warehouse
       left join cprice p on p.sku_cluster_ID = t.sku_cluster_ID group by 1)
select cell.scenario, cells, round(max_balance_residual, 6) as max_balance_residual, balance_violations, negativity_violations,
  shortage_violations, cell_capacity_violations, procurement_violations, warehouse_capacity_violations,
  coalesce(transfer_violations, 0) as transfer_violations,
  coalesce(transfer_negativity_violations, 0) as transfer_negativity_violations,
  round(stock_cost + coalesce(transfer_cost, 0.0), 6) as objective
from cell left join wh on wh.scenario = cell.scenario left join tv on tv.scenario = cell.scenario""",
                         "plan_pos", "plan_tr", "capacity_t", "cprice"))
def q_plan_audit(spark, sf_dir):
    """P10: constraint-violation counts and objective of the rule plan."""
    i = PlanInputs(spark, sf_dir)
    return pl.plan_audit(i.position, i.base.capacity, i.transfers, i.base.prices)


_GAP = ["realized_total_cost", "realized_service_level", "planned_total_cost"]
cte("plan_gap", f"""
select {", ".join(f"p.{c} as {c}_predicted_policy, o.{c} as {c}_oracle_policy" for c in _GAP)},
  p.realized_total_cost - o.realized_total_cost as realized_cost_gap_vs_oracle,
  p.realized_service_level - o.realized_service_level as service_level_gap_vs_oracle
from plan_week p cross join plan_week o where p.scenario = 'predicted' and o.scenario = 'oracle'""", "plan_week")


@query("policy_gap", sql("select " + _r([f"{c}_{s}_policy" for c in _GAP for s in ("predicted", "oracle")]
                                        + ["realized_cost_gap_vs_oracle", "service_level_gap_vs_oracle"]) + " from plan_gap", "plan_gap"))
def q_policy_gap(spark, sf_dir):
    """Predicted-basis vs oracle-basis weekly cost / service gap."""
    return pl.policy_gap(PlanInputs(spark, sf_dir).weekly)


_DAY_GAP = ["realized_total_cost", "realized_shortage_units", "realized_overflow_units", "realized_service_level"]


@query("policy_gap_daily", sql(f"""
select p.date, {", ".join(f"round(p.{c}, 6) as predicted_policy_{c}, round(o.{c}, 6) as oracle_{c}" for c in _DAY_GAP)},
  round(p.realized_total_cost - o.realized_total_cost, 6) as cost_gap_vs_oracle
from plan_rday p left join plan_rday o on o.date = p.date and o.scenario = 'oracle' where p.scenario = 'predicted'""", "plan_rday"))
def q_policy_gap_daily(spark, sf_dir):
    """Predicted-basis against oracle-basis realised days."""
    return pl.policy_gap_daily(PlanInputs(spark, sf_dir).realized_day, _DAY_GAP)


@query("scenario_summary", sql("""
select r.scenario_row, round(r.total_cost, 6) as total_cost, round(r.service_level, 6) as service_level
from (select 'planned_predicted_policy' as scenario_row, planned_total_cost_predicted_policy as total_cost, null::double as service_level from plan_gap
  union all select 'realized_predicted_policy', realized_total_cost_predicted_policy, realized_service_level_predicted_policy from plan_gap
  union all select 'realized_oracle_policy', realized_total_cost_oracle_policy, realized_service_level_oracle_policy from plan_gap
  union all select 'gap_vs_oracle', realized_cost_gap_vs_oracle, service_level_gap_vs_oracle from plan_gap) r""", "plan_gap"))
def q_scenario_summary(spark, sf_dir):
    """Planned / realised / oracle / gap rows."""
    return pl.scenario_summary(PlanInputs(spark, sf_dir).weekly)


PREDS = ("Best Prediction", "Lag-1 Baseline")
POLICIES = ("Baseline Policy", "Procurement Only")


FAMILIES = ("rule_transfer", "procurement_only")


def _combo_rows(week: str, k: int) -> str:
    return f"""
select case scenario when 'predicted' then '{PREDS[0]}' else '{PREDS[1]}' end as prediction_input, '{POLICIES[k]}' as policy_model,
  '{FAMILIES[k]}' as policy_family, {", ".join(pl.COMBO_METRICS)} from {week} where scenario in ('predicted', 'lag1')"""


cte("combos", f"""
with c as ({_combo_rows('plan_week', 0)} union all {_combo_rows('plan0_week', 1)}),
l as (select *, replace(lower(prediction_input), ' ', '_') || '__' || replace(lower(policy_family), ' ', '_') as combination_id,
        prediction_input || ' + ' || policy_model as combination_label from c)
select *, cast(row_number() over (order by realized_total_cost, realized_shortage_units, realized_service_level desc, combination_id)
    as integer) as cost_order,
  cast(dense_rank() over (order by realized_total_cost) as integer) as cost_dense_rank,
  cast(dense_rank() over (order by realized_service_level desc) as integer) as service_dense_rank from l""",
    "plan_week", "plan0_week")


def _combos(spark, sf_dir):
    """Both policies over the same cells: the inputs are made once."""
    frames = []
    plan = PlanInputs(spark, sf_dir)
    for run, policy, family in [(plan, POLICIES[0], FAMILIES[0]), (plan.without_transfers(), POLICIES[1], FAMILIES[1])]:
        w = run.weekly.filter(F.col("scenario").isin("predicted", "lag1"))
        frames.append(w.select(
            F.when(F.col("scenario") == "predicted", PREDS[0]).otherwise(PREDS[1]).alias("prediction_input"),
            F.lit(policy).alias("policy_model"), F.lit(family).alias("policy_family"), *pl.COMBO_METRICS))
    return pl.combinations(share(frames[0].unionByName(frames[1])))


@query("policy_combinations", sql(f"""
select prediction_input, policy_model, policy_family, combination_id, combination_label, cost_order, cost_dense_rank,
  service_dense_rank, {_r(pl.COMBO_METRICS)} from combos""", "combos"))
def q_policy_combinations(spark, sf_dir):
    """Prediction x policy 2x2 rows with ids, labels and ranks."""
    return _combos(spark, sf_dir)


_PREFIXES = [(POLICIES[0], "baseline_policy"), (POLICIES[1], "procurement_only")]


@query("policy_matrix", sql("select prediction_input, " + ", ".join(
    f"round(max(case when policy_model = '{label}' then {m} end), 6) as {pre}_{m.replace('realized_', '').replace('total_cost', 'cost')}"
    for label, pre in _PREFIXES for m in pl.COMBO_METRICS) + " from combos group by 1", "combos"))
def q_policy_matrix(spark, sf_dir):
    """2x2 matrix view (policy-prefixed metric columns)."""
    return pl.policy_matrix(_combos(spark, sf_dir), _PREFIXES)


def _gain_sql(name: str, better: tuple[str, str], worse: tuple[str, str]) -> str:
    """Cost saved, service gained and shortage avoided by ``better`` over ``worse``."""
    pick = lambda c, m: (f"max(case when prediction_input = '{c[0]}' and policy_model = '{c[1]}' then {m} end)")
    delta = lambda a, b, m: f"round({pick(a, m)} - {pick(b, m)}, 6)"
    return (f"select '{name}' as gain, {delta(worse, better, 'realized_total_cost')} as cost_delta, "
            f"{delta(better, worse, 'realized_service_level')} as service_level_delta, "
            f"{delta(better, worse, 'realized_shortage_units')} as shortage_delta, "
            f"arg_min(combination_label, cost_order) as min_cost_combination from combos")


@query("policy_gains", sql(" union all ".join(
    [_gain_sql(f"policy_gain::{p}", (p, POLICIES[0]), (p, POLICIES[1])) for p in PREDS]
    + [_gain_sql(f"prediction_gain::{q}", (PREDS[0], q), (PREDS[1], q)) for q in POLICIES]), "combos"))
def q_policy_gains(spark, sf_dir):
    """Policy and prediction gains, min-cost combination."""
    return pl.policy_gains(_combos(spark, sf_dir), PREDS, POLICIES)


_CONSTANTS = ", ".join(f"('{n}', {k}::double, {h}::double, {u}::double)" for n, k, h, u in pl.SENSITIVITY)


@query("cost_sensitivity", sql(f"""
with b as (select scenario, sum(realized_shortage_units * p_s) as short_p,
             sum((realized_ending_inventory + 2 * realized_capacity_overflow) * p_s) as hold_p from plan_trim group by 1),
t as (select t.scenario, sum(coalesce(p.p_s, 0.0) * t.lead_time_hours * t.transfer_units) as tx_p
      from plan_tr t left join cprice p on p.sku_cluster_ID = t.sku_cluster_ID group by 1),
v as (select * from (values {_CONSTANTS}) v(constant_set, k, h, u))
select b.scenario, constant_set, round(k, 6) as k, round(h, 6) as h, round(u, 6) as u, round(u * short_p, 6) as shortage_cost,
  round(h * hold_p, 6) as holding_cost, round(k * coalesce(tx_p, 0.0), 6) as transfer_cost,
  round(u * short_p + h * hold_p + k * coalesce(tx_p, 0.0), 6) as total_cost
from b cross join v left join t on t.scenario = b.scenario""", "plan_trim", "plan_tr", "cprice"))
def q_cost_sensitivity(spark, sf_dir):
    """Realised cost under alternative k / h / u values."""
    i = PlanInputs(spark, sf_dir)
    return pl.cost_sensitivity(i.trimmed, i.transfers, i.base.prices)


# ----------------------------------------------------------------- candidates by the cost of their plans

_BENCH = ["realized_total_cost", "realized_service_level", "realized_shortage_units", "realized_overflow_units",
          "realized_transfer_units", "realized_procurement_units", "realized_ending_inventory_units"]
cte("cand_plan", f"""
select r.model_id, r.candidate_label, r.source_file, r.wape, r.total_proxy_cost, r.forecast_wape_rank, r.forecast_proxy_cost_rank,
  {", ".join(f"w.{c}" for c in _BENCH)},
  row_number() over (order by w.realized_total_cost, w.realized_shortage_units, w.realized_service_level desc, r.model_id)
    as plan_cost_rank,
  dense_rank() over (order by w.realized_service_level desc) as service_rank
from cand_rank r join cand_week w on w.scenario = r.model_id""", "cand_rank", "cand_week")


def _benchmark(spark, sf_dir, rules_only: bool = True):
    """Every candidate's plan in one pass: the candidate is the scenario."""
    i, aligned = q_misc._candidates(spark, sf_dir) if rules_only else q_models.all_candidates(spark, sf_dir)
    summary = share(ev.model_summary(ev.join_actual(i.test, aligned, i.cprice())))
    planning = aligned.select(F.col("model_id").alias("scenario"), "date", "sku_cluster_ID", "warehouse",
                              F.col("predicted_demand").alias("demand"))
    return cd.plan_benchmark(cd.candidate_ranking(summary, aligned), Plan(PlanBase(spark, sf_dir, i), planning).weekly)


@query("candidate_benchmark", sql(f"""
select model_id, candidate_label, source_file, forecast_wape_rank, forecast_proxy_cost_rank, plan_cost_rank, service_rank,
  plan_cost_rank + service_rank as balance_score, {_r(['wape', 'total_proxy_cost', *_BENCH])} from cand_plan""", "cand_plan"))
def q_candidate_benchmark(spark, sf_dir):
    """Candidates ranked by WAPE, by the realised cost of their plans, by
    service, and by the sum of the latter two."""
    return _benchmark(spark, sf_dir)


@query("candidate_winners", sql("""
select arg_min(candidate_label, forecast_wape_rank) as best_by_wape, arg_min(candidate_label, plan_cost_rank) as best_by_plan_cost,
  arg_min(candidate_label, (plan_cost_rank + service_rank, plan_cost_rank, forecast_wape_rank)) as best_by_balance,
  round(min(wape), 6) as best_wape, round(min(realized_total_cost), 6) as best_plan_cost, count(*) as models_tested,
  cast(arg_min(candidate_label, forecast_wape_rank) = arg_min(candidate_label, plan_cost_rank) as integer)
    as best_wape_matches_best_plan from cand_plan""", "cand_plan"))
def q_candidate_winners(spark, sf_dir):
    """Best candidate by WAPE, plan cost and balance; does WAPE agree."""
    return cd.plan_winners(_benchmark(spark, sf_dir))


@query("candidate_benchmark_all")
def q_candidate_benchmark_all(spark, sf_dir):
    """E10 over all 18 candidate ids, the fitted models among them."""
    return _benchmark(spark, sf_dir, rules_only=False)
