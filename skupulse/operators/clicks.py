"""Click funnel and per-user behaviour.

Scale notes
-----------
* Everything is a group-by with map-side partial aggregation; distinct
  counts shuffle on (group, value) first, so a hot user/SKU is spread over
  many tasks before its final count.
* Top-1 per user (W1) is ``min(struct(-count, value))`` over the per-(user,
  value) counts: two partial aggregations, no per-user window sort.
* The first-order/click join (J2) meets on (user, sku, salt): a pair that
  holds a third of all clicks is spread over ``SALTS`` tasks and merged after
  its partial aggregation.
* Anonymous clicks can match no user; a spread join key keeps them from
  meeting in one task (J1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skupulse.functions.exprs import bool_rate, count_if, days_between, nullif
from skupulse.operators.grid import attach_one_row

SALTS = 16           # parts of a (user, sku) pair's clicks
ANONYMOUS_PARTS = 1_000  # join keys over which anonymous clicks are spread

# Weekday labels, Monday first (weekday index 0..6).
DOW_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def dow_label(idx: Column) -> Column:
    """Weekday index -> label (null outside 0..6)."""
    out = F.lit(None).cast("string")
    for i, lab in reversed(list(enumerate(DOW_LABELS))):
        out = F.when(idx == i, F.lit(lab)).otherwise(out)
    return out


def known_user(c: str = "user_ID") -> Column:
    """Users null or '-' (anonymous) are excluded from per-user stats."""
    return F.col(c).isNotNull() & (F.col(c) != "-")


# ------------------------------------------------------------------ funnel

def first_orders(orders: DataFrame, user: str = "user_ID", sku: str = "sku_ID",
                 time_col: str = "order_time") -> DataFrame:
    """A1: first order time per (user, sku)."""
    return orders.groupBy(user, sku).agg(F.min(time_col).alias("first_order_time"))


def click_to_order(first: DataFrame, clicks: DataFrame, user: str = "user_ID", sku: str = "sku_ID",
                   click_time: str = "request_time") -> DataFrame:
    """A2: per ordered (user, sku) with clicks: first click, first order,
    clicks strictly before the first order, fractional days between.

    Clicks of a pair are dealt over ``SALTS`` parts by their time, the one
    order row of the pair is repeated per part, and the parts' results merge."""
    c = clicks.select(user, sku, click_time, F.pmod(F.xxhash64(click_time), F.lit(SALTS)).alias("_salt"))
    o = first.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    part = o.join(c, [user, sku, "_salt"], "inner").groupBy(user, sku, "_salt", "first_order_time").agg(
        F.min(click_time).alias("first_click_time"),
        count_if(F.col(click_time) < F.col("first_order_time")).alias("clicks_before_order"),
    )
    agg = part.groupBy(user, sku, "first_order_time").agg(
        F.min("first_click_time").alias("first_click_time"), F.sum("clicks_before_order").alias("clicks_before_order"))
    return agg.select(
        F.col(user).alias("user_id"), F.col(sku).alias("sku"), "first_click_time", "first_order_time",
        "clicks_before_order",
        days_between("first_click_time", "first_order_time").alias("days_between"),
    )


# ------------------------------------------------------------------ users

def click_base(clicks: DataFrame) -> DataFrame:
    """Known-user clicks with date, hour and Monday=0 weekday."""
    return clicks.filter(known_user()).select(
        F.col("user_ID").alias("user_id"), F.col("sku_ID").alias("sku_id"), "channel",
        F.col("request_time").alias("ts"), F.to_date("request_time").alias("click_date"),
        F.hour("request_time").alias("hour"), F.weekday("request_time").alias("dow"))


def user_totals(base: DataFrame) -> DataFrame:
    """A3: per-user totals."""
    return base.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_clicks"),
        F.countDistinct("click_date").alias("active_days"),
        F.min("ts").alias("first_click_time"),
        F.max("ts").alias("last_click_time"),
        F.min("click_date").alias("first_click_date"),
        F.max("click_date").alias("last_click_date"),
        F.countDistinct("sku_id").alias("unique_skus"),
        F.countDistinct("channel").alias("unique_channels"),
    )


def top1(base: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Most frequent value per key, ties -> smallest value.

    Returns (key, <name>, <name>_cnt)."""
    counts = base.groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("_c")).alias("n"), F.col(value).alias("v"))).alias("_b"))
    return best.select(key, F.col("_b.v").alias(name), (-F.col("_b.n")).alias(f"{name}_cnt"))


def user_behavior(clicks: DataFrame) -> DataFrame:
    """A4: per-user behaviour profile (totals + top SKU/channel/hour/weekday).

    One scan: clicks are stacked by kind of value and counted per (user, kind,
    value), which combines map side; totals, distinct counts and all four tops
    are read off those counts."""
    base = click_base(clicks)
    nothing = F.lit(None)
    kinds = {"date": (F.unix_date("click_date"), nothing), "sku": (F.col("sku_id"), nothing),
             "channel": (nothing, F.col("channel")), "hour": (F.col("hour"), nothing), "dow": (F.col("dow"), nothing)}
    stacked = base.select("user_id", "ts", F.explode(F.array(*(
        F.struct(F.lit(kind).alias("kind"), number.cast("long").alias("number"), text.cast("string").alias("text"))
        for kind, (number, text) in kinds.items()))).alias("v"))
    counts = stacked.groupBy("user_id", F.col("v.kind").alias("kind"), F.col("v.number").alias("number"),
                             F.col("v.text").alias("text")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))

    def of(kind, c):
        return F.when(F.col("kind") == kind, c)

    def top(kind, value):
        return F.min(of(kind, F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))).alias(f"_{kind}")

    j = counts.groupBy("user_id").agg(
        F.sum(of("date", F.col("n"))).alias("total_clicks"), F.count(of("date", F.col("number"))).alias("active_days"),
        F.min("first_ts").alias("first_click_time"), F.max("last_ts").alias("last_click_time"),
        F.count(of("sku", F.col("number"))).alias("unique_skus"), F.count(of("channel", F.col("text"))).alias("unique_channels"),
        top("sku", "number"), top("channel", "text"), top("hour", "number"), top("dow", "number"))
    names = {"sku": "top_sku", "channel": "top_channel", "hour": "peak_hour", "dow": "peak_dow_idx"}
    types = {"sku": base.schema["sku_id"].dataType, "channel": base.schema["channel"].dataType,
             "hour": base.schema["hour"].dataType, "dow": base.schema["dow"].dataType}
    j = j.withColumns({"first_click_date": F.to_date("first_click_time"), "last_click_date": F.to_date("last_click_time")}
                      | {name: F.col(f"_{kind}.v").cast(types[kind]) for kind, name in names.items()}
                      | {f"{name}_cnt": -F.col(f"_{kind}.n") for kind, name in names.items()})

    def share(cnt):
        return F.round(F.try_divide(F.col(cnt).cast("double"), F.nullif(F.col("total_clicks"), F.lit(0))), 4)

    return j.select(
        "user_id", "total_clicks", "active_days",
        F.round(F.try_divide(F.col("total_clicks").cast("double"), F.nullif(F.col("active_days"), F.lit(0))), 4)
         .alias("avg_clicks_per_day"),
        "first_click_time", "last_click_time",
        (F.datediff("last_click_date", "first_click_date") + 1).cast("double").alias("active_span_days"),
        "unique_skus",
        "top_sku", F.col("top_sku_cnt").alias("top_sku_clicks"), share("top_sku_cnt").alias("top_sku_share"),
        "unique_channels",
        "top_channel", F.col("top_channel_cnt").alias("top_channel_clicks"),
        share("top_channel_cnt").alias("top_channel_share"),
        "peak_hour", F.col("peak_hour_cnt").alias("peak_hour_clicks"),
        share("peak_hour_cnt").alias("peak_hour_share"),
        dow_label(F.col("peak_dow_idx")).alias("peak_dow"), F.col("peak_dow_idx_cnt").alias("peak_dow_clicks"),
        share("peak_dow_idx_cnt").alias("peak_dow_share"),
    )


# ------------------------------------------------------------------ daily

def clicks_day_region_sku(clicks: DataFrame, users: DataFrame, region_col: str = "region",
                          include_unknown_user: bool = False) -> DataFrame:
    """A5 + J1: clicks by (day, region, sku); region of unknown users 'UNKNOWN'."""
    # users have part 0; anonymous clicks have another, match nothing and spread
    u = users.select("user_ID", F.col(region_col).alias("_region"), F.lit(0).cast("long").alias("_part"))
    spread = 1 + F.pmod(F.xxhash64("request_time", "sku_ID"), F.lit(ANONYMOUS_PARTS))
    c = clicks.withColumn("_part", F.when(known_user(), F.lit(0)).otherwise(spread))
    j = c.join(u, ["user_ID", "_part"], "left")
    if include_unknown_user:
        uniq = F.countDistinct("user_ID")
    else:
        uniq = F.countDistinct(F.when(known_user(), F.col("user_ID")))
    return j.groupBy(F.to_date("request_time").alias("day"),
                     F.coalesce(F.col("_region"), F.lit("UNKNOWN")).alias("region"),
                     F.col("sku_ID")).agg(uniq.alias("unique_users"), F.count(F.lit(1)).alias("total_clicks"))


def clicks_daily_sku(clicks: DataFrame) -> DataFrame:
    """Clicks per (sku, date)."""
    return clicks.groupBy("sku_ID", F.to_date("request_time").alias("order_date")).agg(
        F.count(F.lit(1)).alias("daily_clicks"))


def clicks_by_hour(clicks: DataFrame) -> DataFrame:
    """Clicks per hour, all 24 hours (0 if none), display order from 6h."""
    spark = clicks.sparkSession
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = clicks.groupBy(F.hour("request_time").alias("hour")).agg(F.count(F.lit(1)).alias("clicks"))
    return (F.broadcast(hours).join(counts, "hour", "left")
            .select("hour", F.coalesce("clicks", F.lit(0)).alias("clicks"),
                    ((F.col("hour") + 18) % 24).alias("display_order")))


def clicks_by_weekday(clicks: DataFrame) -> DataFrame:
    """Clicks per weekday (Monday = 0)."""
    return clicks.groupBy(F.weekday("request_time").alias("dow")).agg(F.count(F.lit(1)).alias("clicks")) \
        .withColumn("dow_label", dow_label(F.col("dow")))


def value_shares(df: DataFrame, col: str, name: str = "share") -> DataFrame:
    """value_counts(normalize=True) — count / total (total is the sum of
    the counts, so the input runs once)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_tot"))
    return attach_one_row(counts, total).select(col, "n", (F.col("n") / F.col("_tot")).alias(name))


def funnel_summary(c2o: DataFrame) -> DataFrame:
    """Rows, distinct users/SKUs, share of days <= 0, share zero clicks."""
    return c2o.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct("sku").alias("unique_skus"),
        bool_rate(F.col("days_between") <= 0).alias("frac_nonpositive_days"),
        bool_rate(F.col("clicks_before_order") == 0).alias("frac_zero_clicks"),
    )


def user_day_clicks(clicks: DataFrame) -> DataFrame:
    """Clicks per (user, date), anonymous users excluded."""
    return clicks.filter(known_user()).groupBy("user_ID", F.to_date("request_time").alias("date")).agg(
        F.count(F.lit(1)).alias("clicks"))


def missing_rates(df: DataFrame, sentinel_cols: dict[str, str] | None = None) -> DataFrame:
    """Null share of every column in one pass, as (column, missing_rate)."""
    sentinel_cols = sentinel_cols or {}
    cols = []
    for c in df.columns:
        v = nullif(c, sentinel_cols[c]) if c in sentinel_cols else F.col(c)
        cols.append(F.avg(v.isNull().cast("double")).alias(c))
    wide = df.agg(*cols)
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return wide.selectExpr(f"stack({len(df.columns)}, {stack}) as (column_name, missing_rate)")
