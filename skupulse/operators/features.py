"""History features for demand forecasting.

Every window is partitioned by a series key (cluster x warehouse, cluster,
warehouse) and ordered by date; series are daily aggregates, so a partition
holds at most one row per day regardless of how many order lines fed it.
Lags are positional (by row, T10) and rolling statistics require the full
window (``min_periods = window``, T11).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skupulse.functions.exprs import safe_div0
from skupulse.sources.fixtures import shift_click_date

DATE = "date"
CLUSTER = "cluster_id"
WAREHOUSE = "warehouse_id"
TARGET = "demand"
SPLIT = "dataset_split"


def series_window(keys: list[str], date_col: str = DATE):
    return Window.partitionBy(*keys).orderBy(date_col)


def shifted_rolling(c: str, keys: list[str], window: int, fn=F.avg, date_col: str = DATE) -> Column:
    """fn over the previous ``window`` rows (shift(1).rolling(window)); null
    until the frame is full."""
    w = series_window(keys, date_col).rowsBetween(-window, -1)
    return F.when(F.count(c).over(w) == window, fn(c).over(w))


def panel_dataset(train_grid: DataFrame, test_grid: DataFrame, key_col: str = "dc_des") -> DataFrame:
    """Train and test panels unioned, renamed and tagged by split."""
    def prep(df, split):
        return df.select(F.col("order_date").alias(DATE), F.col("sku_cluster_ID").alias(CLUSTER),
                         F.col(key_col).alias(WAREHOUSE), F.coalesce(F.col("demand").cast("double"), F.lit(0.0))
                         .alias(TARGET), F.lit(split).alias(SPLIT))
    return prep(train_grid, "train").unionByName(prep(test_grid, "test"))


def demand_history(df: DataFrame, keys: list[str] | None = None, target: str = TARGET) -> DataFrame:
    """W2 + W4 + W5 + C14: lags 1-3, shifted rolling mean/std over 3, growth."""
    keys = keys or [CLUSTER, WAREHOUSE]
    w = series_window(keys)
    out = df.withColumns({
        f"lag_{i}_{target}": F.lag(target, i).over(w) for i in (1, 2, 3)
    })
    out = out.withColumns({
        f"rolling_mean_3_{target}": shifted_rolling(target, keys, 3, F.avg),
        f"rolling_std_3_{target}": shifted_rolling(target, keys, 3, F.stddev_samp),
    })
    return out.withColumn(f"{target}_growth",
                          (F.col(f"lag_1_{target}") - F.col(f"lag_2_{target}")) / (F.col(f"lag_2_{target}") + 1.0))


def group_trend(df: DataFrame, key: str, total_name: str, lag_name: str, roll_name: str,
                target: str = TARGET) -> DataFrame:
    """A22 + W6: daily totals per key with lag-1 and shifted rolling-3 mean."""
    daily = df.groupBy(key, DATE).agg(F.sum(target).alias(total_name))
    w = series_window([key])
    return daily.withColumns({
        lag_name: F.lag(total_name, 1).over(w),
        roll_name: shifted_rolling(total_name, [key], 3, F.avg),
    })


def cluster_popularity(df: DataFrame) -> DataFrame:
    return group_trend(df, CLUSTER, "cluster_total_demand_day", "cluster_total_demand_lag1",
                       "cluster_total_demand_rolling3")


def warehouse_trend(df: DataFrame) -> DataFrame:
    return group_trend(df, WAREHOUSE, "warehouse_total_demand_day", "warehouse_demand_lag1",
                       "warehouse_demand_rolling3")


def cluster_clicks_funnel(c2o: DataFrame, mapping: DataFrame) -> DataFrame:
    """From click-to-order rows: clicks before order summed and distinct
    users per (cluster, first-click day on the order calendar)."""
    m = mapping.select("sku_ID", F.col("sku_cluster_ID").alias(CLUSTER))
    x = (c2o.filter(F.col("first_click_time").isNotNull())
         .select("user_id", F.col("sku").alias("sku_ID"), shift_click_date(F.col("first_click_time")).alias(DATE),
                 F.coalesce(F.col("clicks_before_order").cast("double"), F.lit(0.0)).alias("cbo"))
         .join(m, "sku_ID", "inner"))
    return x.groupBy(CLUSTER, DATE).agg(F.sum("cbo").alias("click_count"),
                                        F.countDistinct("user_id").alias("unique_click_users"))


def cluster_clicks_table(clicks: DataFrame, mapping: DataFrame, start, end) -> DataFrame:
    """A7 + A24: clicks per (sku, day) in [start, end] with distinct users
    (anonymous '-' included, as in the reference), summed per cluster - the
    distinct users are SUMMED over SKUs and so double count (T12)."""
    d = shift_click_date(F.col("request_time"))
    per_sku = (clicks.withColumn(DATE, d)
               .filter(F.col(DATE).between(F.lit(start), F.lit(end)))
               .groupBy("sku_ID", DATE).agg(F.count(F.lit(1)).alias("click_count"),
                                            F.countDistinct("user_ID").alias("unique_click_users")))
    m = mapping.select("sku_ID", F.col("sku_cluster_ID").alias(CLUSTER))
    return (per_sku.join(m, "sku_ID", "inner").groupBy(CLUSTER, DATE)
            .agg(F.sum("click_count").cast("double").alias("click_count"),
                 F.sum("unique_click_users").cast("double").alias("unique_click_users")))


def click_velocity(click_daily: DataFrame) -> DataFrame:
    """W7 + C14: clicks per user, lags over OBSERVED click days, velocity."""
    w = series_window([CLUSTER])
    out = click_daily.withColumns({
        "click_per_user": F.col("click_count") / F.greatest(F.col("unique_click_users"), F.lit(1.0)),
        "lag_1_clicks": F.lag("click_count", 1).over(w),
        "lag_2_clicks": F.lag("click_count", 2).over(w),
    })
    return out.withColumn("click_velocity", F.col("lag_1_clicks") - F.col("lag_2_clicks"))


def calendar(df: DataFrame, date_col: str = DATE) -> DataFrame:
    """day_of_week (Mon = 0), is_weekend, day_of_month."""
    return df.withColumns({
        "day_of_week": F.weekday(date_col),
        "is_weekend": (F.weekday(date_col) >= 5).cast("int"),
        "day_of_month": F.dayofmonth(date_col),
    })


def feature_frame(panel: DataFrame, click_daily: DataFrame | None = None, drop_no_history: bool = True) -> DataFrame:
    """M17 (warehouse model frame): history + cluster / warehouse trends +
    calendar (+ cluster click features, conversion rate), rows without three
    lags dropped (D6)."""
    out = demand_history(panel)
    out = out.join(cluster_popularity(panel), [CLUSTER, DATE], "left")
    out = out.join(warehouse_trend(panel), [WAREHOUSE, DATE], "left")
    if click_daily is not None:
        out = out.join(click_velocity(click_daily), [CLUSTER, DATE], "left")
        out = out.withColumn("conversion_rate", F.col("cluster_total_demand_lag1")
                             / F.greatest(F.col("lag_1_clicks"), F.lit(1.0)))
    out = calendar(out)
    if drop_no_history:
        out = out.dropna(subset=["lag_1_demand", "lag_2_demand", "lag_3_demand"])
    return out


# Feature sets of the model grid (M8).
BASE_IDS = [CLUSTER, WAREHOUSE]
FEATURE_SETS = {
    "A": BASE_IDS + ["lag_1_demand"],
    "B": BASE_IDS + ["lag_1_demand", "lag_2_demand", "lag_3_demand"],
    "C": BASE_IDS + ["lag_1_demand", "lag_2_demand", "lag_3_demand", "rolling_mean_3_demand",
                     "rolling_std_3_demand", "demand_growth"],
    "D": BASE_IDS + ["lag_1_demand", "lag_2_demand", "lag_3_demand", "rolling_mean_3_demand",
                     "rolling_std_3_demand", "demand_growth", "day_of_week", "is_weekend", "day_of_month"],
    "E": BASE_IDS + ["lag_1_demand", "lag_2_demand", "lag_3_demand", "rolling_mean_3_demand",
                     "rolling_std_3_demand", "demand_growth", "day_of_week", "is_weekend", "day_of_month",
                     "cluster_total_demand_lag1", "cluster_total_demand_rolling3", "warehouse_demand_lag1",
                     "warehouse_demand_rolling3"],
}
CLICK_FEATURES = ["click_count", "unique_click_users", "click_per_user", "lag_1_clicks", "lag_2_clicks",
                  "click_velocity", "conversion_rate"]


def feature_sets(click_available: bool) -> dict[str, list[str]]:
    sets = {k: list(v) for k, v in FEATURE_SETS.items()}
    if click_available:
        sets["F"] = sets["E"] + CLICK_FEATURES
    return sets


def naive_forecasts(df: DataFrame) -> DataFrame:
    """M21 baselines on rows with full history: lag-1 and mean of last 7."""
    keys = [CLUSTER, WAREHOUSE]
    out = df.withColumns({
        "lag1_forecast": F.lag(TARGET, 1).over(series_window(keys)),
        "mean7_forecast": shifted_rolling(TARGET, keys, 7, F.avg),
    })
    return out


def share_of_total(value: str, keys: list[str], fallback_n: str | None = None) -> Column:
    """Value / partition total; all-zero partition -> equal share if
    ``fallback_n`` (row count column) is given, else 0."""
    tot = F.sum(value).over(Window.partitionBy(*keys))
    eq = (F.lit(1.0) / F.col(fallback_n)) if fallback_n else F.lit(0.0)
    return F.when(tot > 0, safe_div0(F.col(value), tot)).otherwise(eq)
