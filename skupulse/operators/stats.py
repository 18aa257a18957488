"""Descriptive statistics.

Percentiles are exact and distributed (``order_stats``); the value columns are
written once and read by the sketch, the counts and the other aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skupulse.functions.exprs import bool_rate
from skupulse.operators.order_stats import with_percentiles
from skupulse.session import share


def pct_name(p: float) -> str:
    v = p * 100
    return f"p{int(v)}" if abs(v - round(v)) < 1e-9 else f"p{str(v).replace('.', '_')}"


def describe(df: DataFrame, c: str, ps: list[float]) -> DataFrame:
    """count/mean/std/min/percentiles/max of one column (one row)."""
    x = share(df.select(c))
    a = x.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
              F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
    return with_percentiles(a, x, [c], ps).select(
        "count", "mean", "std", "min", *[F.col(f"_q_{c}")[i].alias(pct_name(p)) for i, p in enumerate(ps)], "max")


ACTIVITY = ["total_clicks", "active_days", "active_span_days", "unique_skus", "top_sku_share"]


def behavior_summary(beh: DataFrame) -> DataFrame:
    """Medians of activity columns, % single channel, % top share = 1."""
    x = share(beh.select(*ACTIVITY, "unique_channels"))
    a = x.agg(
        (100 * bool_rate(F.col("unique_channels") == 1)).alias("pct_single_channel"),
        (100 * bool_rate(F.col("top_sku_share") == 1)).alias("pct_top_sku_share_one"),
        F.count(F.lit(1)).alias("users"))
    return with_percentiles(a, x, ACTIVITY, [0.5]).select(
        *[F.col(f"_q_{c}")[0].alias(f"median_{c}") for c in ACTIVITY], *a.columns)


def users_by_label(df: DataFrame, label_col: str, labels: list[str]) -> DataFrame:
    """Counts per label in a fixed label order; missing labels get 0."""
    spark = df.sparkSession
    arr = F.array(*[F.lit(x) for x in labels])
    spine = spark.range(len(labels)).select(
        F.col("id").cast("int").alias("dow_order"), F.element_at(arr, F.col("id").cast("int") + 1).alias(label_col))
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("users"))
    return (F.broadcast(spine).join(counts, label_col, "left")
            .select("dow_order", label_col, F.coalesce("users", F.lit(0)).alias("users")))


def sparsity_metrics(df: DataFrame, dims: list[str]) -> DataFrame:
    """Distinct count per dimension (null counted as a value), product,
    non-zero rows, density and sparsity (one row)."""
    aggs = []
    for d in dims:
        # count_distinct ignores null; add one if any null exists
        aggs.append((F.countDistinct(d) + F.max(F.col(d).isNull().cast("int"))).alias(f"n_{d}"))
    a = df.agg(*aggs, F.count(F.lit(1)).alias("nonzero_rows"))
    prod = F.lit(1).cast("long")
    for d in dims:
        prod = prod * F.col(f"n_{d}")
    a = a.withColumn("total_possible", prod)
    dens = F.when(F.col("total_possible") > 0, F.col("nonzero_rows") / F.col("total_possible")).otherwise(F.lit(0.0))
    return a.withColumn("density", dens).withColumn("sparsity", 1 - F.col("density"))


def variance_metrics(df: DataFrame, keys: list[str], value: str = "demand") -> DataFrame:
    """A10: count, mean, sample std and cv per group; null keys dropped."""
    f = df
    for k in keys:
        f = f.filter(F.col(k).isNotNull())
    s = f.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"),
                            F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
                            F.max(value).alias("max"))
    return s.withColumn("cv", F.try_divide(F.col("std"), F.nullif(F.col("mean"), F.lit(0))))


def variance_summary(stats: DataFrame) -> DataFrame:
    """Cv mean / median, share cv < 0.1 and < 0.2 (null = false, T4),
    mean / median of means, largest group maximum."""
    x = share(stats.select("cv", "mean", "max"))
    a = x.agg(
        F.avg("cv").alias("cv_mean"),
        bool_rate(F.col("cv") < 0.1).alias("share_cv_lt_0_1"),
        bool_rate(F.col("cv") < 0.2).alias("share_cv_lt_0_2"),
        F.avg("mean").alias("mean_of_means"),
        F.max("max").alias("max_demand"), F.count(F.lit(1)).alias("groups"))
    return with_percentiles(a, x, ["cv", "mean"], [0.5]).select(
        "cv_mean", F.col("_q_cv")[0].alias("cv_median"), "share_cv_lt_0_1", "share_cv_lt_0_2", "mean_of_means",
        F.col("_q_mean")[0].alias("median_of_means"), "max_demand", "groups")
