"""Replenishment plan operators.

A plan is a set of keyed tables per scenario (planning basis) and day:
planning demand, opening inventory, transfers, procurement.  Only the rule
transfer step (P2) is order dependent - a greedy matching of deficits to
donors inside one (scenario, day, cluster) - so it folds over arrays of one
cluster's warehouses (bounded by the warehouse count, never by data volume).
Everything else is joins, windows and grouped aggregates.

Not built (see README): the LP solver and the day-to-day state loop; P7
replays a fixed plan over many days with a closed-form window instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skupulse import config
from skupulse.operators.grid import attach_one_row, dim_product

EPS = 1e-8
CELL = ["scenario", "date", "sku_cluster_ID", "warehouse"]

def plan_inputs(planning: DataFrame, opening: DataFrame, universe: DataFrame, clusters: DataFrame) -> DataFrame:
    """Dense (scenario, date, cluster, warehouse) cells with planning demand
    (missing -> 0) and opening inventory (missing -> 0)."""
    days = planning.select("scenario", "date").distinct()
    cells = dim_product([days, clusters.select("sku_cluster_ID").distinct(), universe.select("warehouse").distinct()])
    d = planning.groupBy(*CELL).agg(F.sum("demand").alias("demand"))
    out = cells.join(d, CELL, "left").join(
        opening.select("sku_cluster_ID", "warehouse", F.col("inventory").cast("double")),
        ["sku_cluster_ID", "warehouse"], "left")
    return out.fillna(0.0, subset=["demand", "inventory"])


def rule_transfers(cells: DataFrame, route_inputs: DataFrame) -> DataFrame:
    """Rule-based transfers per (scenario, date, cluster).

    Every deficit gets its offers (surplus warehouses on feasible routes, in
    order of route time) by joins; the order-dependent part is one ``aggregate``
    per group over its deficits, largest first.  Arrays are as long as a group
    has warehouses, and the route table stays a distributed table."""
    group = ["scenario", "date", "sku_cluster_ID"]
    gap = cells.select(*group, "warehouse", (F.col("demand") - F.col("inventory")).alias("gap"))
    spare = gap.where(F.col("gap") < -EPS).select(*group, F.col("warehouse").alias("src"), (-F.col("gap")).alias("spare"))
    asks = gap.where(F.col("gap") > EPS).select(*group, F.col("warehouse").alias("dst"), F.col("gap").alias("need"))
    routes = (route_inputs.where("route_feasible = 1 and source_warehouse <> destination_warehouse")
              .select(F.col("source_warehouse").alias("src"), F.col("destination_warehouse").alias("dst"),
                      F.col("lead_time_hours").cast("double").alias("hours")))
    offers = (asks.join(routes, "dst").join(spare.select(*group, "src"), [*group, "src"])
              .groupBy(*group, "dst", "need").agg(F.array_sort(F.collect_list(F.struct("hours", "src"))).alias("offers")))
    queue = offers.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("need")).alias("rank"), "dst", "need", "offers"))).alias("queue"))
    stock = spare.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("src", "spare"))).alias("stock"))
    return (queue.join(stock, group)
            .select(*group, F.explode(F.aggregate("queue", _opening_state(), _serve, lambda state: state["moves"])).alias("m"))
            .select(*group, F.col("m.src").alias("source_warehouse"), F.col("m.dst").alias("destination_warehouse"),
                    F.col("m.units").alias("transfer_units"), F.lit(1).alias("route_feasible"),
                    F.col("m.hours").alias("lead_time_hours")))


_MOVES = "array<struct<src:int,dst:int,units:double,hours:double>>"


def _opening_state():
    return F.struct(F.col("stock"), F.array().cast(_MOVES).alias("moves"))


def _serve(state, ask):
    """One deficit: draw on its offers in order until it is covered."""
    def draw(s, offer):
        held = F.element_at(state["stock"], offer["src"])
        units = F.when((s["need"] > EPS) & (held > EPS), F.least(s["need"], held)).otherwise(F.lit(0.0))
        move = F.struct(offer["src"].cast("int").alias("src"), ask["dst"].cast("int").alias("dst"), units.alias("units"),
                        offer["hours"].alias("hours"))
        return F.struct((s["need"] - units).alias("need"), F.concat(s["moves"], F.array(move)).alias("moves"))

    drawn = F.aggregate(ask["offers"], F.struct(ask["need"].alias("need"), F.array().cast(_MOVES).alias("moves")), draw,
                        lambda s: F.filter(s["moves"], lambda m: m["units"] > EPS))
    used = F.map_from_entries(F.transform(drawn, lambda m: F.struct(m["src"], m["units"])))
    stock = F.transform_values(state["stock"], lambda src, v: v - F.coalesce(F.try_element_at(used, src), F.lit(0.0)))
    return F.struct(stock.alias("stock"), F.concat(state["moves"], drawn).alias("moves"))


def transfer_flows(transfers: DataFrame) -> DataFrame:
    """Incoming and outgoing units per cell (two grouped sums, full join)."""
    inc = transfers.groupBy("scenario", "date", "sku_cluster_ID", F.col("destination_warehouse").alias("warehouse")) \
        .agg(F.sum("transfer_units").alias("incoming"))
    out = transfers.groupBy("scenario", "date", "sku_cluster_ID", F.col("source_warehouse").alias("warehouse")) \
        .agg(F.sum("transfer_units").alias("outgoing"))
    return inc.join(out, CELL, "full")


def plan_position(cells: DataFrame, transfers: DataFrame | None, eligibility: DataFrame,
                  prices: DataFrame, h: float = config.HOLDING_COST_H, u: float = config.SHORTAGE_COST_U) -> DataFrame:
    """Eligible warehouses buy the remaining deficit after transfers;
    planned shortage, planned ending inventory and their costs."""
    c = cells
    if transfers is not None:
        c = c.join(transfer_flows(transfers), CELL, "left")
    else:
        c = c.withColumns({"incoming": F.lit(0.0), "outgoing": F.lit(0.0)})
    c = c.fillna(0.0, subset=["incoming", "outgoing"])
    c = c.join(eligibility.select("warehouse", "W_j"), "warehouse", "left") \
        .join(prices.select("sku_cluster_ID", "p_s"), "sku_cluster_ID", "left") \
        .fillna(0.0, subset=["p_s"]).fillna(0, subset=["W_j"])
    before = F.col("inventory") + F.col("incoming") - F.col("outgoing")
    c = c.withColumn("available_before_procurement", before)
    c = c.withColumn("procurement_units", F.when(F.col("W_j") >= 1, F.greatest(
        F.col("demand") - F.col("available_before_procurement"), F.lit(0.0))).otherwise(F.lit(0.0)))
    avail = F.col("available_before_procurement") + F.col("procurement_units")
    c = c.withColumns({
        "planned_shortage_units": F.greatest(F.col("demand") - avail, F.lit(0.0)),
        "planned_ending_inventory": F.greatest(avail - F.col("demand"), F.lit(0.0)),
    })
    return c.withColumns({
        "planned_shortage_cost": F.col("planned_shortage_units") * F.col("p_s") * u,
        "planned_holding_cost": F.col("planned_ending_inventory") * F.col("p_s") * h,
    })


def transfer_costs(transfers: DataFrame, prices: DataFrame, k: float = config.TRANSFER_COST_K) -> DataFrame:
    return transfers.join(prices.select("sku_cluster_ID", "p_s"), "sku_cluster_ID", "left").withColumn(
        "transfer_cost", k * F.coalesce("p_s", F.lit(0.0)) * F.col("lead_time_hours") * F.col("transfer_units"))


def _transfer_day(transfers: DataFrame | None, prices: DataFrame, k: float) -> DataFrame | None:
    if transfers is None:
        return None
    return transfer_costs(transfers, prices, k).groupBy("scenario", "date").agg(
        F.sum("transfer_units").alias("transfer_units"), F.sum("transfer_cost").alias("transfer_cost"))


def planned_metrics(position: DataFrame, transfers: DataFrame | None, prices: DataFrame,
                    k: float = config.TRANSFER_COST_K) -> DataFrame:
    """Per (scenario, date) planned totals, service level, costs."""
    m = position.groupBy("scenario", "date").agg(
        F.sum("demand").alias("planned_demand_units"),
        F.sum("planned_shortage_units").alias("planned_shortage_units"),
        F.sum("planned_ending_inventory").alias("planned_ending_inventory_units"),
        F.sum("procurement_units").alias("planned_procurement_units"),
        F.sum("planned_shortage_cost").alias("planned_shortage_cost"),
        F.sum("planned_holding_cost").alias("planned_holding_cost"))
    t = _transfer_day(transfers, prices, k)
    if t is not None:
        m = m.join(t.withColumnsRenamed({"transfer_units": "planned_transfer_units",
                                         "transfer_cost": "planned_transfer_cost"}), ["scenario", "date"], "left")
    else:
        m = m.withColumns({"planned_transfer_units": F.lit(0.0), "planned_transfer_cost": F.lit(0.0)})
    m = m.fillna(0.0, subset=["planned_transfer_units", "planned_transfer_cost"])
    return m.withColumns({
        "planned_service_level": F.when(F.col("planned_demand_units") != 0,
                                        (F.col("planned_demand_units") - F.col("planned_shortage_units"))
                                        / F.col("planned_demand_units")).otherwise(F.lit(1.0)),
        "planned_total_cost": F.col("planned_shortage_cost") + F.col("planned_holding_cost")
                              + F.col("planned_transfer_cost"),
    })


def realize(position: DataFrame, actual: DataFrame, h: float = config.HOLDING_COST_H,
            u: float = config.SHORTAGE_COST_U) -> DataFrame:
    """P5: the planned procurement and transfers meet ACTUAL demand:
    available = inventory + procurement + in - out; shortage, ending stock."""
    a = actual.select("date", "sku_cluster_ID", "warehouse", F.col("demand").alias("actual_demand"))
    r = position.join(a, ["date", "sku_cluster_ID", "warehouse"], "left").fillna(0.0, subset=["actual_demand"])
    avail = F.col("inventory") + F.col("procurement_units") + F.col("incoming") - F.col("outgoing")
    r = r.withColumns({
        "realized_shortage_units": F.greatest(F.col("actual_demand") - avail, F.lit(0.0)),
        "realized_ending_inventory": F.greatest(avail - F.col("actual_demand"), F.lit(0.0)),
    })
    return r.withColumns({
        "realized_shortage_cost": F.col("realized_shortage_units") * F.col("p_s") * u,
        "realized_holding_cost": F.col("realized_ending_inventory") * F.col("p_s") * h,
    })


def capacity_trim(realized: DataFrame, capacity: DataFrame, h: float = config.HOLDING_COST_H) -> DataFrame:
    """P6 + W12: a warehouse's ending stock above C_j is removed from its
    cheapest clusters first (running sum over price, cluster); removed units
    cost p * h.  Partitioned by (scenario, date, warehouse): one partition is
    one warehouse's clusters."""
    w = Window.partitionBy("scenario", "date", "warehouse")
    ordered = w.orderBy("p_s", "sku_cluster_ID").rowsBetween(Window.unboundedPreceding, -1)
    r = realized.join(capacity.select("warehouse", "C_j"), "warehouse", "left").fillna(0.0, subset=["C_j"])
    r = r.withColumn("_overflow", F.greatest(F.sum("realized_ending_inventory").over(w) - F.col("C_j"), F.lit(0.0)))
    r = r.withColumn("_before", F.coalesce(F.sum("realized_ending_inventory").over(ordered), F.lit(0.0)))
    rem = F.least(F.col("realized_ending_inventory"), F.greatest(F.col("_overflow") - F.col("_before"), F.lit(0.0)))
    r = r.withColumn("realized_capacity_overflow", F.when(F.col("_overflow") > EPS, rem).otherwise(F.lit(0.0)))
    r = r.withColumn("realized_ending_inventory",
                     F.greatest(F.col("realized_ending_inventory") - F.col("realized_capacity_overflow"), F.lit(0.0)))
    return r.withColumn("realized_overflow_cost", F.col("realized_capacity_overflow") * F.col("p_s") * h) \
        .drop("_overflow", "_before")


def realized_metrics(trimmed: DataFrame, transfers: DataFrame | None, prices: DataFrame,
                     k: float = config.TRANSFER_COST_K) -> DataFrame:
    """Per (scenario, date) realised totals, service level (1 when no
    demand) and costs incl. overflow and transfer cost."""
    m = trimmed.groupBy("scenario", "date").agg(
        F.sum("actual_demand").alias("actual_demand_units"),
        F.sum("realized_shortage_units").alias("realized_shortage_units"),
        F.sum("realized_ending_inventory").alias("realized_ending_inventory_units"),
        F.sum("realized_capacity_overflow").alias("realized_overflow_units"),
        F.sum("procurement_units").alias("realized_procurement_units"),
        F.sum("realized_shortage_cost").alias("realized_shortage_cost"),
        F.sum("realized_holding_cost").alias("realized_holding_cost"),
        F.sum("realized_overflow_cost").alias("realized_overflow_cost"))
    t = _transfer_day(transfers, prices, k)
    if t is not None:
        m = m.join(t.withColumnsRenamed({"transfer_units": "realized_transfer_units",
                                         "transfer_cost": "realized_transfer_cost"}), ["scenario", "date"], "left")
    else:
        m = m.withColumns({"realized_transfer_units": F.lit(0.0), "realized_transfer_cost": F.lit(0.0)})
    m = m.fillna(0.0, subset=["realized_transfer_units", "realized_transfer_cost"])
    return m.withColumns({
        "realized_service_level": F.when(F.col("actual_demand_units") != 0,
                                         (F.col("actual_demand_units") - F.col("realized_shortage_units"))
                                         / F.col("actual_demand_units")).otherwise(F.lit(1.0)),
        "realized_total_cost": F.col("realized_shortage_cost") + F.col("realized_holding_cost")
                               + F.col("realized_overflow_cost") + F.col("realized_transfer_cost"),
    })


WEEKLY_SUMS = ["planned_total_cost", "realized_total_cost", "planned_shortage_cost", "realized_shortage_cost",
               "planned_holding_cost", "realized_holding_cost", "realized_overflow_cost", "planned_transfer_cost",
               "realized_transfer_cost", "actual_demand_units", "realized_shortage_units",
               "realized_ending_inventory_units", "realized_overflow_units", "realized_transfer_units",
               "realized_procurement_units"]


def policy_weekly(planned: DataFrame, realized: DataFrame) -> DataFrame:
    """Weekly sums per scenario; service = 1 - sum short / sum demand."""
    d = planned.join(realized, ["scenario", "date"], "full")
    w = d.groupBy("scenario").agg(*[F.sum(c).alias(c) for c in WEEKLY_SUMS])
    return w.withColumn("realized_service_level", F.when(
        F.col("actual_demand_units") != 0, 1.0 - F.col("realized_shortage_units") / F.col("actual_demand_units"))
        .otherwise(F.lit(1.0)))


def replay_plan(position: DataFrame, actual: DataFrame) -> DataFrame:
    """Carry inventory day to day under a fixed plan without trimming:
    I_t = max(I_{t-1} + net_t, 0) with I_0 = opening inventory and
    net_t = procurement + in - out - actual demand.  Closed form per cell:
    S_t = I_0 + sum_{u<=t} net_u, I_t = S_t - min(0, min_{u<=t} S_u)."""
    a = actual.select("date", "sku_cluster_ID", "warehouse", F.col("demand").alias("actual_demand"))
    p = position.join(a, ["date", "sku_cluster_ID", "warehouse"], "left").fillna(0.0, subset=["actual_demand"])
    net = F.col("procurement_units") + F.col("incoming") - F.col("outgoing") - F.col("actual_demand")
    w = Window.partitionBy("scenario", "sku_cluster_ID", "warehouse").orderBy("date") \
        .rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("_s", F.col("inventory") + F.sum(net).over(w))
    p = p.withColumn("replayed_inventory", F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(w)))
    return p.select("scenario", "date", "sku_cluster_ID", "warehouse", "actual_demand", "procurement_units",
                    "incoming", "outgoing", "replayed_inventory")


def plan_audit(position: DataFrame, capacity: DataFrame, transfers: DataFrame | None = None,
               prices: DataFrame | None = None, k: float = config.TRANSFER_COST_K) -> DataFrame:
    """P10: constraint checks of any plan as violation counts per scenario:
    balance residual, non-negativity, shortage <= demand, inventory <= C_j per
    cell and per warehouse-day, procurement <= (C_j + D) * W_j, transfers
    within (C_n + C_m + D_n) on feasible routes; and the plan's objective, which
    is h * price * stock + u * price * shortage + k * price * hours * transfers."""
    c = position.join(capacity.select("warehouse", "C_j"), "warehouse", "left").fillna(0.0, subset=["C_j"])
    resid = (F.col("inventory") + F.col("incoming") - F.col("outgoing") + F.col("procurement_units")
             - F.col("demand") + F.col("planned_shortage_units") - F.col("planned_ending_inventory"))

    def viol(cond):
        return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))

    cell = c.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("cells"),
        F.max(F.abs(resid)).alias("max_balance_residual"),
        viol(F.abs(resid) > 1e-6).alias("balance_violations"),
        viol((F.col("procurement_units") < -EPS) | (F.col("planned_shortage_units") < -EPS)
             | (F.col("planned_ending_inventory") < -EPS)).alias("negativity_violations"),
        viol(F.col("planned_shortage_units") > F.col("demand") + 1e-6).alias("shortage_violations"),
        viol(F.col("planned_ending_inventory") > F.col("C_j") + 1e-6).alias("cell_capacity_violations"),
        viol(F.col("procurement_units") > (F.col("C_j") + F.col("demand")) * F.col("W_j") + 1e-6)
        .alias("procurement_violations"),
        F.sum(F.col("planned_holding_cost") + F.col("planned_shortage_cost")).alias("_stock_cost"))
    wh = c.groupBy("scenario", "date", "warehouse").agg(F.sum("planned_ending_inventory").alias("_inv"),
                                                        F.first("C_j").alias("C_j"))
    whv = wh.groupBy("scenario").agg(viol(F.col("_inv") > F.col("C_j") + 1e-6).alias("warehouse_capacity_violations"))
    out = cell.join(whv, "scenario", "left")
    if transfers is not None:
        dem = c.select("scenario", "date", "sku_cluster_ID", F.col("warehouse").alias("source_warehouse"),
                       F.col("demand").alias("_dn"))
        cap_n = capacity.select(F.col("warehouse").alias("source_warehouse"), F.col("C_j").alias("_cn"))
        cap_m = capacity.select(F.col("warehouse").alias("destination_warehouse"), F.col("C_j").alias("_cm"))
        t = (transfers.join(dem, ["scenario", "date", "sku_cluster_ID", "source_warehouse"], "left")
             .join(cap_n, "source_warehouse", "left").join(cap_m, "destination_warehouse", "left")
             .fillna(0.0, subset=["_dn", "_cn", "_cm"]))
        t = (transfer_costs(t, prices, k) if prices is not None else t.withColumn("transfer_cost", F.lit(0.0)))
        tv = t.groupBy("scenario").agg(
            viol(F.col("transfer_units") > (F.col("_cn") + F.col("_cm") + F.col("_dn")) * F.col("route_feasible")
                 + 1e-6).alias("transfer_violations"),
            viol(F.col("transfer_units") < -EPS).alias("transfer_negativity_violations"),
            F.sum("transfer_cost").alias("_transfer_cost"))
        out = out.join(tv, "scenario", "left").fillna(0, subset=["transfer_violations", "transfer_negativity_violations"])
    else:
        out = out.withColumns({"transfer_violations": F.lit(0).cast("long"), "_transfer_cost": F.lit(0.0),
                               "transfer_negativity_violations": F.lit(0).cast("long")})
    return out.withColumn("objective", F.col("_stock_cost") + F.coalesce("_transfer_cost", F.lit(0.0))).drop(
        "_stock_cost", "_transfer_cost")


def policy_gap(weekly: DataFrame, planned_basis: str = "predicted", oracle_basis: str = "oracle") -> DataFrame:
    """Predicted-basis weekly row x oracle-basis weekly row (one row
    each), cost gap and service-level gap."""
    p = weekly.filter(F.col("scenario") == planned_basis).select(
        *[F.col(c).alias(f"{c}_predicted_policy") for c in ["realized_total_cost", "realized_service_level",
                                                             "planned_total_cost"]])
    o = weekly.filter(F.col("scenario") == oracle_basis).select(
        *[F.col(c).alias(f"{c}_oracle_policy") for c in ["realized_total_cost", "realized_service_level",
                                                          "planned_total_cost"]])
    return attach_one_row(p, o).withColumns({
        "realized_cost_gap_vs_oracle": F.col("realized_total_cost_predicted_policy")
        - F.col("realized_total_cost_oracle_policy"),
        "service_level_gap_vs_oracle": F.col("realized_service_level_predicted_policy")
        - F.col("realized_service_level_oracle_policy"),
    })


def policy_gap_daily(realized: DataFrame, measures: list[str], planned_basis: str = "predicted",
                     oracle_basis: str = "oracle") -> DataFrame:
    """Realised days of the predicted basis beside those of the oracle basis."""
    p = realized.filter(F.col("scenario") == planned_basis).select(
        "date", *[F.col(m).alias(f"predicted_policy_{m}") for m in measures])
    o = realized.filter(F.col("scenario") == oracle_basis).select("date", *[F.col(m).alias(f"oracle_{m}") for m in measures])
    return p.join(o, "date", "left").withColumn(
        "cost_gap_vs_oracle", F.col("predicted_policy_realized_total_cost") - F.col("oracle_realized_total_cost"))


def scenario_summary(weekly: DataFrame, planned_basis: str = "predicted", oracle_basis: str = "oracle") -> DataFrame:
    """Four rows - planned, realised, oracle, gap (cost and service)."""
    g = policy_gap(weekly, planned_basis, oracle_basis)
    return g.selectExpr(
        "stack(4, 'planned_predicted_policy', planned_total_cost_predicted_policy, cast(null as double), "
        "'realized_predicted_policy', realized_total_cost_predicted_policy, realized_service_level_predicted_policy, "
        "'realized_oracle_policy', realized_total_cost_oracle_policy, realized_service_level_oracle_policy, "
        "'gap_vs_oracle', realized_cost_gap_vs_oracle, service_level_gap_vs_oracle) "
        "as (scenario_row, total_cost, service_level)")


COMBO_METRICS = ["realized_total_cost", "realized_service_level", "realized_shortage_units",
                 "realized_overflow_units", "realized_transfer_units", "realized_procurement_units",
                 "realized_ending_inventory_units"]


def combinations(weekly_by_policy: DataFrame) -> DataFrame:
    """Label rows (prediction input x policy), ids, cost order and
    dense ranks.  Input: weekly rows with prediction_input / policy_model."""
    c = weekly_by_policy.withColumns({
        "combination_id": F.concat(F.regexp_replace(F.lower("prediction_input"), " ", "_"), F.lit("__"),
                                   F.regexp_replace(F.lower("policy_family"), " ", "_")),
        "combination_label": F.concat_ws(" + ", "prediction_input", "policy_model"),
    })
    order = Window.orderBy(F.col("realized_total_cost"), F.col("realized_shortage_units"),
                           F.col("realized_service_level").desc(), F.col("combination_id"))
    return c.withColumns({
        "cost_order": F.row_number().over(order),
        "cost_dense_rank": F.dense_rank().over(Window.orderBy("realized_total_cost")),
        "service_dense_rank": F.dense_rank().over(Window.orderBy(F.col("realized_service_level").desc())),
    })


def policy_matrix(combos: DataFrame, policies: list[tuple[str, str]]) -> DataFrame:
    """One row per prediction input, prefixed metric columns per policy
    (pivot on a fixed, given policy list)."""
    aggs = []
    for label, prefix in policies:
        for m in COMBO_METRICS:
            name = m.replace("realized_", "").replace("total_cost", "cost")
            aggs.append(F.max(F.when(F.col("policy_model") == label, F.col(m))).alias(f"{prefix}_{name}"))
    return combos.groupBy("prediction_input").agg(*aggs)


def policy_gains(combos: DataFrame, preds: tuple[str, str], pols: tuple[str, str]) -> DataFrame:
    """Policy gain per prediction input and prediction gain per policy
    (cost, service, shortage deltas) plus the min-cost combination."""
    def pick(p, q, m):
        return F.max(F.when((F.col("prediction_input") == p) & (F.col("policy_model") == q), F.col(m)))

    (pa, pb), (qa, qb) = preds, pols
    rows = []
    for p in preds:
        rows.append(F.struct(F.lit(f"policy_gain::{p}").alias("gain"),
                             (pick(p, qb, "realized_total_cost") - pick(p, qa, "realized_total_cost")).alias("cost_delta"),
                             (pick(p, qa, "realized_service_level") - pick(p, qb, "realized_service_level"))
                             .alias("service_level_delta"),
                             (pick(p, qa, "realized_shortage_units") - pick(p, qb, "realized_shortage_units"))
                             .alias("shortage_delta")))
    for q in pols:
        rows.append(F.struct(F.lit(f"prediction_gain::{q}").alias("gain"),
                             (pick(pb, q, "realized_total_cost") - pick(pa, q, "realized_total_cost")).alias("cost_delta"),
                             (pick(pa, q, "realized_service_level") - pick(pb, q, "realized_service_level"))
                             .alias("service_level_delta"),
                             (pick(pa, q, "realized_shortage_units") - pick(pb, q, "realized_shortage_units"))
                             .alias("shortage_delta")))
    g = combos.agg(F.array(*rows).alias("_g"),
                   F.min_by("combination_label", F.struct("cost_order")).alias("min_cost_combination"))
    return g.select(F.explode("_g").alias("g"), "min_cost_combination").select("g.*", "min_cost_combination")


# Alternative cost constants proposed for sensitivity (one at a time).
SENSITIVITY = [("base", config.TRANSFER_COST_K, config.HOLDING_COST_H, config.SHORTAGE_COST_U),
               ("k_low", 0.0004, config.HOLDING_COST_H, config.SHORTAGE_COST_U),
               ("k_high", 0.00125, config.HOLDING_COST_H, config.SHORTAGE_COST_U),
               ("h_low", config.TRANSFER_COST_K, 0.0004, config.SHORTAGE_COST_U),
               ("h_high", config.TRANSFER_COST_K, 0.0008, config.SHORTAGE_COST_U),
               ("u_low", config.TRANSFER_COST_K, config.HOLDING_COST_H, 0.03),
               ("u_high", config.TRANSFER_COST_K, config.HOLDING_COST_H, 0.10)]


def cost_sensitivity(trimmed: DataFrame, transfers: DataFrame | None, prices: DataFrame) -> DataFrame:
    """Realised cost per scenario under each constant set.  Costs are
    linear in k, h, u, so three price-weighted unit sums per scenario are
    computed once and scaled by the (7-row) constants grid."""
    # holding is charged on the pre-trim ending stock and the trimmed units
    # are charged again as overflow, both at rate h
    base = trimmed.groupBy("scenario").agg(
        F.sum(F.col("realized_shortage_units") * F.col("p_s")).alias("_short_p"),
        F.sum((F.col("realized_ending_inventory") + 2 * F.col("realized_capacity_overflow")) * F.col("p_s"))
        .alias("_hold_p"))
    if transfers is not None:
        t = transfer_costs(transfers, prices, 1.0).groupBy("scenario").agg(F.sum("transfer_cost").alias("_tx_p"))
        base = base.join(t, "scenario", "left")
    else:
        base = base.withColumn("_tx_p", F.lit(0.0))
    base = base.fillna(0.0, subset=["_tx_p"])
    consts = trimmed.sparkSession.createDataFrame(SENSITIVITY, "constant_set string, k double, h double, u double")
    out = base.crossJoin(F.broadcast(consts))
    return out.select("scenario", "constant_set", "k", "h", "u",
                      (F.col("u") * F.col("_short_p")).alias("shortage_cost"),
                      (F.col("h") * F.col("_hold_p")).alias("holding_cost"),
                      (F.col("k") * F.col("_tx_p")).alias("transfer_cost"),
                      (F.col("u") * F.col("_short_p") + F.col("h") * F.col("_hold_p") + F.col("k") * F.col("_tx_p"))
                      .alias("total_cost"))
