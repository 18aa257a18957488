"""Order statistics without a single-partition window.

``ecdf`` and ``running_total`` need a cumulative sum over a global order.
A window without ``partitionBy`` would move every row into one task, so
instead:

1. collapse to one row per distinct value (partial aggregation; a value
   holding a third of all rows becomes one row);
2. cut the value range into ``buckets`` ranges at approximate quantiles of
   the distinct values (``approxQuantile`` returns ``buckets - 1`` numbers to
   the driver - bounded by the parameter, not by the data);
3. per-bucket totals (``buckets`` rows) give each bucket's offset;
4. the running sum inside a bucket is a window partitioned by bucket.

The result is exact; the quantiles only balance the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skupulse.operators.grid import attach_one_row


def _bucket_col(df: DataFrame, value_col: str, buckets: int):
    if buckets <= 1:
        return F.lit(0)
    probs = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(b for b in df.approxQuantile(value_col, probs, 0.01) if b is not None))
    if not bounds:
        return F.lit(0)
    arr = F.array(*[F.lit(float(b)) for b in bounds])
    return F.size(F.filter(arr, lambda b: b < F.col(value_col).cast("double")))


def running_total(df: DataFrame, value_col: str, weight_col: str | None = None,
                  buckets: int = 64) -> DataFrame:
    """One row per distinct non-null value: (value, n, cum_n, total_n)."""
    w = F.col(weight_col) if weight_col else F.lit(1)
    counts = (df.filter(F.col(value_col).isNotNull())
              .groupBy(value_col).agg(F.sum(w).cast("long").alias("n")))
    counts = counts.withColumn("_bucket", _bucket_col(counts, value_col, buckets))
    btot = counts.groupBy("_bucket").agg(F.sum("n").alias("_bn"))
    # buckets-row frame: offsets by a small ordered window
    bw = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = btot.select("_bucket", F.coalesce(F.sum("_bn").over(bw), F.lit(0)).alias("_off"))
    total = btot.agg(F.sum("_bn").alias("total_n"))
    inner = Window.partitionBy("_bucket").orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    out = (counts.join(F.broadcast(offsets), "_bucket")
           .withColumn("cum_n", F.col("_off") + F.sum("n").over(inner)))
    return attach_one_row(out, total).select(value_col, "n", "cum_n", "total_n")


def ecdf(df: DataFrame, value_col: str, buckets: int = 64) -> DataFrame:
    """Empirical CDF at every distinct value: P(X <= v)."""
    rt = running_total(df, value_col, buckets=buckets)
    return rt.select(value_col, "n", (F.col("cum_n") / F.col("total_n")).alias("ecdf"))


def histogram(df: DataFrame, value_col: str, bins: int) -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed; all bins
    are returned (empty ones with 0).  Equal min and max use the range
    [min - 0.5, max + 0.5] like numpy."""
    spark = df.sparkSession
    x = df.select(F.col(value_col).cast("double").alias("x")).filter(F.col("x").isNotNull())
    rng = x.agg(F.min("x").alias("_lo0"), F.max("x").alias("_hi0")).select(
        F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
        F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col("x") - F.col("_lo")) / width).cast("int"), F.lit(bins - 1))
    counts = attach_one_row(x, rng).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = attach_one_row(spark.range(bins).select(F.col("id").cast("int").alias("bin")), rng)
    return (spine.join(counts, "bin", "left")
            .select("bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
                    (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
                    F.coalesce("count", F.lit(0)).alias("count")))
