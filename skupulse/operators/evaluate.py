"""Forecast evaluation and comparison.

All metrics are one-pass conditional aggregates; the per-model /
per-cluster / per-warehouse tables are grouped aggregations of the same
joined frame.  Ranking windows run on the model summary (one row per
model id), never on row-level data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skupulse import config

META = ["model_id", "approach", "prediction_level", "model_name", "family"]
KEYS = ["date", "warehouse", "sku_cluster_ID"]


def join_actual(actual: DataFrame, preds: DataFrame, cluster_prices: DataFrame,
                holding: float = config.HOLDING_COST_H, purchasing: float = config.SHORTAGE_COST_U) -> DataFrame:
    """J15 + E3: actual panel left-join predictions (metadata -> 'unknown',
    prediction -> 0), cluster price (missing -> 0), row-level errors and
    cost proxies."""
    p = preds.select(*KEYS, *META, "predicted_demand")
    m = actual.select(*KEYS, "demand").join(p, KEYS, "left")
    m = m.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in META})
    m = m.withColumn("predicted_demand", F.coalesce("predicted_demand", F.lit(0.0)))
    m = m.join(cluster_prices.select("sku_cluster_ID", "p_s"), "sku_cluster_ID", "left") \
        .withColumn("p_s", F.coalesce("p_s", F.lit(0.0)))
    err = F.col("predicted_demand") - F.col("demand")
    m = m.withColumn("prediction_error", err)
    m = m.withColumns({
        "abs_error": F.abs("prediction_error"),
        "underprediction": -F.least(F.col("prediction_error"), F.lit(0.0)),
        "overprediction": F.greatest(F.col("prediction_error"), F.lit(0.0)),
    })
    return m.withColumns({
        "price_weighted_abs_error": F.col("abs_error") * F.col("p_s"),
        "purchase_cost_proxy": F.col("underprediction") * F.col("p_s") * purchasing,
        "holding_cost_proxy": F.col("overprediction") * F.col("p_s") * holding,
    })


def _ratio_if_nonzero(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def metric_aggs(with_costs: bool = True) -> list[Column]:
    """E2 (+ cost sums): one aggregate list reused by every grouping."""
    err = F.col("prediction_error")
    aggs = [
        F.sum("demand").alias("actual_units"),
        F.sum("predicted_demand").alias("predicted_units"),
        F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        _ratio_if_nonzero(F.sum("abs_error"), F.sum("demand")).alias("wape"),
        _ratio_if_nonzero(F.sum(err), F.sum("demand")).alias("bias"),
        F.sum("underprediction").alias("underprediction_units"),
        F.sum("overprediction").alias("overprediction_units"),
    ]
    if with_costs:
        aggs += [F.sum("price_weighted_abs_error").alias("price_weighted_abs_error"),
                 F.sum("purchase_cost_proxy").alias("purchase_cost_proxy"),
                 F.sum("holding_cost_proxy").alias("holding_cost_proxy")]
    return aggs


def model_summary(merged: DataFrame) -> DataFrame:
    """Metrics by model."""
    return merged.groupBy(*META).agg(*metric_aggs())


def cluster_metrics(merged: DataFrame) -> DataFrame:
    return merged.groupBy(*META, "sku_cluster_ID").agg(*metric_aggs())


def warehouse_metrics(merged: DataFrame) -> DataFrame:
    return merged.groupBy(*META, "warehouse").agg(*metric_aggs())


def daily_totals(merged: DataFrame) -> DataFrame:
    """E5: daily sums by model and signed / absolute error of the totals."""
    d = merged.groupBy(*META, "date").agg(
        F.sum("demand").alias("actual_total_demand"), F.sum("predicted_demand").alias("predicted_total_demand"),
        F.sum("purchase_cost_proxy").alias("purchase_cost_proxy"),
        F.sum("holding_cost_proxy").alias("holding_cost_proxy"),
        F.sum("underprediction").alias("underprediction"), F.sum("overprediction").alias("overprediction"))
    d = d.withColumn("error", F.col("predicted_total_demand") - F.col("actual_total_demand"))
    return d.withColumn("abs_error", F.abs("error"))


def eligible(wape: Column, bias: Column) -> Column:
    return F.coalesce((wape <= config.MAX_SELECT_WAPE) & (bias >= -config.MAX_SELECT_ABS_BIAS)
                      & (bias <= config.MAX_SELECT_ABS_BIAS), F.lit(False))


def model_selection(valid_summary: DataFrame) -> DataFrame:
    """Status per model and the selected one (eligible pool if any is
    eligible, else all), ordered by total proxy cost, purchase cost, WAPE,
    RMSE, MAE, then model id."""
    s = valid_summary.withColumns({
        "validation_total_proxy_cost": F.col("purchase_cost_proxy") + F.col("holding_cost_proxy"),
        "selection_status": F.when(eligible(F.col("wape"), F.col("bias")), "eligible").otherwise("screened_out"),
    })
    any_eligible = F.max((F.col("selection_status") == "eligible").cast("int")).over(Window.partitionBy())
    in_pool = (F.col("selection_status") == "eligible") | (any_eligible == 0)
    order = [F.col("validation_total_proxy_cost").asc_nulls_last(), F.col("purchase_cost_proxy").asc_nulls_last(),
             F.col("wape").asc_nulls_last(), F.col("rmse").asc_nulls_last(), F.col("mae").asc_nulls_last(),
             F.col("model_id")]
    s = s.withColumn("_pool", in_pool.cast("int"))
    s = s.withColumn("selection_order", F.row_number().over(Window.orderBy(*order)))
    s = s.withColumn("pool_order", F.row_number().over(Window.partitionBy("_pool").orderBy(*order)))
    return s.withColumn("is_selected", ((F.col("_pool") == 1) & (F.col("pool_order") == 1)).cast("int")) \
        .drop("_pool", "pool_order")


METRIC_COLS = ["mae", "rmse", "wape", "bias", "underprediction_units", "overprediction_units", "actual_units",
               "predicted_units", "purchase_cost_proxy", "holding_cost_proxy", "price_weighted_abs_error"]


def model_comparison(valid_summary: DataFrame, test_summary: DataFrame) -> DataFrame:
    """Validation vs test metrics side by side, status and selection rank."""
    v = valid_summary.select(*META, *[F.col(c).alias(f"validation_{c}") for c in METRIC_COLS])
    t = test_summary.select(*META, *[F.col(c).alias(f"test_{c}") for c in METRIC_COLS])
    c = v.join(t, META, "left")
    c = c.withColumns({
        "validation_total_proxy_cost": F.col("validation_purchase_cost_proxy") + F.col("validation_holding_cost_proxy"),
        "test_total_proxy_cost": F.col("test_purchase_cost_proxy") + F.col("test_holding_cost_proxy"),
        "validation_selection_status": F.when(eligible(F.col("validation_wape"), F.col("validation_bias")),
                                              "eligible").otherwise("screened_out"),
    })
    c = c.withColumn("validation_selection_rank", (F.col("validation_selection_status") != "eligible").cast("int"))
    order = [F.col("validation_selection_rank"), F.col("validation_total_proxy_cost").asc_nulls_last(),
             F.col("validation_purchase_cost_proxy").asc_nulls_last(), F.col("validation_wape").asc_nulls_last(),
             F.col("validation_rmse").asc_nulls_last(), F.col("model_id")]
    return c.withColumn("selection_rank", F.row_number().over(Window.orderBy(*order)))


def best_learned(test_summary: DataFrame, fallback_id: Column | None = None) -> DataFrame:
    """Best non-baseline model by WAPE then RMSE (K3: ordered limit 1)."""
    return (test_summary.filter(F.col("family") != "baseline")
            .orderBy(F.col("wape").asc_nulls_last(), F.col("rmse").asc_nulls_last(), "model_id").limit(1))


def forecast_metrics(df: DataFrame, y: str = "demand", p: str = "predicted_demand",
                     group: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, WAPE (null if sum y <= 0) and MAPE over y > 0."""
    e = F.col(p) - F.col(y)
    aggs = [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            F.when(F.sum(y) > 0, F.sum(F.abs(e)) / F.sum(y)).alias("wape"),
            F.avg(F.when(F.col(y) > 0, F.abs(e / F.col(y)))).alias("mape"),
            F.count(F.lit(1)).alias("rows")]
    return df.groupBy(*(group or [])).agg(*aggs)


def dense_rank(col: str, ascending: bool = True) -> Column:
    """Dense rank over a small (per-model) table."""
    o = F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_last()
    return F.dense_rank().over(Window.orderBy(o))


def metric_delta(previous: dict[str, float], current: DataFrame) -> DataFrame:
    """Previous vs current metrics in long form (metric, previous,
    current, delta); ``current`` is a one-row frame of the same metrics."""
    spark = current.sparkSession
    names = list(previous)
    stack = ", ".join(f"'{n}', cast(`{n}` as double)" for n in names)
    cur = current.selectExpr(f"stack({len(names)}, {stack}) as (metric, current_value)")
    prev = spark.createDataFrame([(n, float(v)) for n, v in previous.items()], "metric string, previous_value double")
    out = F.broadcast(prev).join(cur, "metric", "left")
    return out.withColumn("delta", F.col("current_value") - F.col("previous_value"))
