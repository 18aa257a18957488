"""Order mart and fulfilment analytics.

The mart is one plan: order lines joined to the per-order delivery roll-up
(grouped first, so the join is one row per order on the right side), to the
distinct inventory keys (dc, sku, day) and to the SKU attributes.  Every
summary is a grouped aggregation of the mart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skupulse.functions.exprs import hours_between, nullif
from skupulse.operators.grid import attach_one_row
from skupulse.operators.order_stats import with_percentiles
from skupulse.session import share


def delivery_rollup(delivery: DataFrame) -> DataFrame:
    """First ship-out, first station arrival, last arrival per order."""
    return delivery.groupBy("order_ID").agg(
        F.min("ship_out_time").alias("ship_out_dt"),
        F.min("arr_station_time").alias("arr_station_dt"),
        F.max("arr_time").alias("arr_dt"))


def order_mart(orders: DataFrame, delivery: DataFrame, inventory: DataFrame, skus: DataFrame | None = None) -> DataFrame:
    """Cross-fulfilment flag (C20), delivery roll-up (J12), lead and
    cross-filling hours (C13), promise and late flag (C19, 3-valued),
    inventory availability at the destination (J11), SKU attributes (J17)."""
    o = orders.select("order_ID", "user_ID", "sku_ID", "order_date", F.col("order_time").alias("order_time_dt"),
                      "quantity", "promise", "dc_ori", "dc_des")
    o = o.withColumn("cross_fulfill", (F.col("dc_ori") != F.col("dc_des")).cast("int"))
    m = o.join(delivery_rollup(delivery), "order_ID", "left")
    m = m.withColumns({
        "lead_time_hours": hours_between("order_time_dt", "arr_dt"),
        "cross_filling_hours": hours_between("ship_out_dt", "arr_station_dt"),
        "promise_days": F.col("promise").try_cast("double"),
    })
    m = m.withColumn("promise_hours", F.col("promise_days") * 24.0)
    m = m.withColumn("late_delivery", F.when(F.col("lead_time_hours").isNotNull() & F.col("promise_hours").isNotNull(),
                                             (F.col("lead_time_hours") > F.col("promise_hours")).cast("int")))
    inv = inventory.select(F.col("dc_ID").alias("dc_des"), "sku_ID", F.col("date").alias("order_date")).distinct() \
        .withColumn("_inv", F.lit(1))
    m = m.join(inv, ["dc_des", "sku_ID", "order_date"], "left").withColumn(
        "inv_available_at_dc_des", F.coalesce("_inv", F.lit(0))).drop("_inv")
    if skus is not None:
        cols = [c for c in ["type", "attribute1", "attribute2", "brand_ID"] if c in skus.columns]
        m = m.join(skus.select("sku_ID", *cols).withColumnRenamed("type", "sku_type"), "sku_ID", "left")
    return m.drop("promise", "sku_type")


def line_lead_times(orders: DataFrame, delivery: DataFrame) -> DataFrame:
    """order_date, dc_ori, dc_des and lead_time_hours of each order line."""
    m = orders.join(delivery_rollup(delivery), "order_ID", "left")
    return m.select("order_date", "dc_ori", "dc_des", hours_between("order_time", "arr_dt").alias("lead_time_hours"))


def _by_fulfillment() -> dict:
    """Lead times of cross and local order lines, as columns."""
    lt = F.col("lead_time_hours")
    return {"cross": F.when(F.col("cross_fulfill") == 1, lt), "local": F.when(F.col("cross_fulfill") == 0, lt)}


def fulfillment_summary(mart: DataFrame) -> DataFrame:
    """A40 scalars: cross rate, lead time mean / median, delay penalty
    (cross - local) of mean and median lead time."""
    x = share(mart.select("cross_fulfill", "lead_time_hours"))
    by = _by_fulfillment()
    a = x.agg(F.avg("cross_fulfill").alias("cross_fulfillment_rate"),
              F.avg("lead_time_hours").alias("lead_time_mean_hours"),
              (F.avg(by["cross"]) - F.avg(by["local"])).alias("delay_penalty_mean_hours"))
    q = with_percentiles(a, x, by | {"all": F.col("lead_time_hours")}, [0.5])
    return q.select("cross_fulfillment_rate", "lead_time_mean_hours", F.col("_q_all")[0].alias("lead_time_median_hours"),
                    "delay_penalty_mean_hours",
                    (F.col("_q_cross")[0] - F.col("_q_local")[0]).alias("delay_penalty_median_hours"))


def lead_time_by_fulfillment(mart: DataFrame) -> DataFrame:
    """Lead-time count / mean / median / std and late rate, local vs cross
    (unknown counts as local)."""
    m = mart.filter(F.col("lead_time_hours").isNotNull())
    x = share(m.select(F.when(F.col("cross_fulfill") == 1, "cross").otherwise("local").alias("fulfillment"),
                       "lead_time_hours", "late_delivery"))
    a = x.groupBy("fulfillment").agg(
        F.count(F.lit(1)).alias("count"), F.avg("lead_time_hours").alias("mean"), F.stddev_samp("lead_time_hours").alias("std"),
        F.count("late_delivery").alias("late_count"), F.avg("late_delivery").alias("late_rate"))
    by = {k: F.when(F.col("fulfillment") == k, F.col("lead_time_hours")) for k in ("cross", "local")}
    q = with_percentiles(a, x, by, [0.5])   # two rows
    return q.select("fulfillment", "count", "mean",
                    F.when(F.col("fulfillment") == "cross", F.col("_q_cross")[0]).otherwise(F.col("_q_local")[0]).alias("median"),
                    "std", "late_count", "late_rate")


def cross_rate_by_inventory(mart: DataFrame) -> DataFrame:
    """Cross-fulfilment rate by inventory record at destination."""
    return mart.groupBy(F.when(F.col("inv_available_at_dc_des") == 1, "inv_record").otherwise("no_inv_record")
                        .alias("inventory_flag")).agg(F.count(F.lit(1)).alias("count"),
                                                      F.avg("cross_fulfill").alias("cross_rate"))


def cross_fill_hours(mart: DataFrame) -> DataFrame:
    """Mean cross-filling hours and order count per route."""
    return (mart.filter(F.col("cross_filling_hours").isNotNull()).groupBy("dc_ori", "dc_des")
            .agg(F.avg("cross_filling_hours").alias("cross_filling_hours"), F.count(F.lit(1)).alias("n_orders")))


def daily_sku_dc(mart: DataFrame) -> DataFrame:
    """Per (sku, dc, day): lines, cross rate, lead time, late rate,
    inventory availability; inventory = half-even round of n * (1 - cross)."""
    d = mart.groupBy("sku_ID", "dc_des", F.to_date("order_time_dt").alias("order_day")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("cross_fulfill").alias("cross_rate"),
        F.avg("lead_time_hours").alias("avg_lead_time_hours"), F.avg("late_delivery").alias("late_delivery_rate"),
        F.avg("inv_available_at_dc_des").alias("inv_available_at_dc_des"))
    return d.withColumn("inventory", F.bround(F.col("n_orders") * (1 - F.col("cross_rate")), 0).cast("long"))


def capacity_legacy(summary: DataFrame) -> DataFrame:
    """Max over days of the daily order total per destination DC."""
    day = summary.groupBy("dc_des", "order_day").agg(F.sum("n_orders").alias("total_orders"))
    return day.groupBy("dc_des").agg(F.max("total_orders").cast("double").alias("capacity"))


# ----------------------------------------------------------------- SKU / order composition

COMPOSITION_ROWS = 250_000   # order lines of a task, about


def order_composition(orders: DataFrame) -> DataFrame:
    """Per order distinct SKUs, 1P count ('1' as text, T21), missing
    count, 1P fraction and composition label."""
    t = F.coalesce(F.col("type").cast("string"), F.lit("MISSING"))
    lines = orders.select("order_ID", "sku_ID", (t == "1").cast("long").alias("one"), (t == "MISSING").cast("long").alias("missing"))
    # nearly every line is a pair of its own: orders meet before anything is grouped
    parts = max(lines.sparkSession.sparkContext.defaultParallelism, -(-orders.count() // COMPOSITION_ROWS))
    # a SKU's types count once each
    items = lines.repartition(parts, "order_ID").groupBy("order_ID", "sku_ID").agg(
        F.max("one").alias("one"), F.max("missing").alias("missing"))
    per = items.groupBy("order_ID").agg(F.count("sku_ID").alias("total_items"), F.sum("one").alias("n_1p"),
                                        F.sum("missing").alias("n_missing"))
    per = per.withColumn("frac_1p", F.col("n_1p") / F.col("total_items"))
    return per.withColumn("composition", F.when(F.col("n_missing") > 0, "contains_missing_sku_info")
                          .when(F.col("frac_1p") == 1.0, "all_1p").when(F.col("frac_1p") == 0.0, "all_3p")
                          .otherwise("mixed"))


def composition_counts(per_order: DataFrame) -> DataFrame:
    """Orders per composition label with share rounded to 4 (half-even)."""
    c = per_order.groupBy("composition").agg(F.count(F.lit(1)).alias("orders"))
    tot = c.agg(F.sum("orders").alias("_t"))
    return attach_one_row(c, tot).select("composition", "orders",
                                         F.bround(F.col("orders") / F.col("_t"), 4).alias("pct"))


def composition_by_size(per_order: DataFrame) -> DataFrame:
    """Orders by (distinct SKU count, composition) - long form of the
    reference's unstacked table (pivot only for display)."""
    return per_order.groupBy("total_items", "composition").agg(F.count(F.lit(1)).alias("orders"))


def type_shares(orders: DataFrame) -> DataFrame:
    """Order rows and quantity by SKU type, share of rows (3 decimals)."""
    t = F.coalesce(F.col("type").cast("string"), F.lit("MISSING")).alias("sku_type")
    c = orders.groupBy(t).agg(F.count(F.lit(1)).alias("order_rows"), F.sum("quantity").alias("quantity"))
    tot = c.agg(F.sum("order_rows").alias("_t"))
    return attach_one_row(c, tot).select("sku_type", "order_rows", "quantity",
                                         F.bround(F.col("order_rows") / F.col("_t"), 3).alias("pct_rows"))


def purchased_skus(skus: DataFrame, orders: DataFrame) -> DataFrame:
    """SKU master rows whose id appears in the orders (semi join)."""
    return skus.join(orders.select("sku_ID").filter(F.col("sku_ID").isNotNull()), "sku_ID", "left_semi")


def attribute_profile(sku_rows: DataFrame, attrs=("attribute1", "attribute2")) -> DataFrame:
    """Per attribute: SKUs, nulls ('-' = missing, C8), null share,
    distinct values, numeric share and numeric mean/min/max when more than
    10 % of the non-null values are numeric.  All attributes in one pass."""
    aggs = []
    for a in attrs:
        v = nullif(a, "-")
        num = v.try_cast("double")
        aggs.append(F.struct(
            F.lit(a).alias("attribute"), F.count(F.lit(1)).alias("total"), F.sum(v.isNull().cast("long")).alias("nulls"),
            F.countDistinct(v).alias("n_unique"), F.count(num).alias("n_numeric"),
            F.avg(num).alias("_mean"), F.min(num).alias("_min"), F.max(num).alias("_max")))
    agg = sku_rows.agg(F.array(*aggs).alias("_a")).select(F.inline("_a"))
    is_num = (F.col("n_numeric") > 0) & (F.col("n_numeric") / (F.col("total") - F.col("nulls") + 1e-9) > 0.1)
    return agg.select(
        "attribute", "total", "nulls",
        F.when(F.col("total") > 0, F.col("nulls") / F.col("total")).otherwise(0.0).alias("pct_null"),
        "n_unique", "n_numeric", is_num.cast("int").alias("is_numeric"),
        F.when(is_num, F.col("_mean")).alias("numeric_mean"), F.when(is_num, F.col("_min")).alias("numeric_min"),
        F.when(is_num, F.col("_max")).alias("numeric_max"))


def top_values(df: DataFrame, col: str, n: int, missing_label: str = "MISSING") -> DataFrame:
    """K2: top-n value counts (nulls as 'MISSING'), ties by value."""
    v = F.coalesce(F.col(col).cast("string"), F.lit(missing_label)).alias(col)
    return df.groupBy(v).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), F.col(col)).limit(n)
