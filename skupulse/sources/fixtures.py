"""Bind the driver's parquet tables to the logical retail tables.

Every binder reads only the columns it needs (Catalyst prunes the parquet
scan) and takes optional date bounds that are applied on the raw order
timestamp, so the predicate reaches the ``orders`` scan as a pushed filter
instead of sitting above a cast.

Joins are left to Catalyst/AQE: the dimension tables (customer, supplier,
part) grow with the scale factor, so none is force-broadcast; AQE turns a
join into a broadcast at run time only when the measured side is under
``spark.sql.autoBroadcastJoinThreshold``.  ``nation`` is fixed at 25 rows by
the TPC-H spec and is the only hard broadcast.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skupulse import config


# Declared schemas of the source tables: reading with a schema skips the
# footer-scan job Spark otherwise runs to infer it (one per read, and over
# every file of a large table).
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _ts_bounds(col: Column, start: dt.date | None, end: dt.date | None) -> Column | None:
    # string literals cast to timestamp_ntz are wall-clock values, independent
    # of the session and Python time zones
    cond = None
    if start is not None:
        cond = col >= F.lit(f"{start.isoformat()} 00:00:00").cast("timestamp_ntz")
    if end is not None:
        hi = col < F.lit(f"{(end + dt.timedelta(days=1)).isoformat()} 00:00:00").cast("timestamp_ntz")
        cond = hi if cond is None else cond & hi
    return cond


# Columns of an order line that only a dimension table gives.  Every line has its
# customer, supplier and part (foreign keys of the source), so a join whose
# columns nobody asks for would change nothing and is left out.
LINE_DIMENSIONS = {"dc_des": "customer", "dc_ori": "supplier", "type": "part"}
LINE_COLUMNS = ["order_ID", "user_ID", "sku_ID", "order_time", "order_date", "quantity", "original_unit_price",
                "final_unit_price", "direct_discount_per_unit", "quantity_discount_per_unit", "bundle_discount_per_unit",
                "coupon_discount_per_unit", "gift_item", "promise", "type", "dc_ori", "dc_des"]
# What demand panels and their features read.
DEMAND_COLUMNS = [c for c in LINE_COLUMNS if c not in ("promise", "type", "dc_ori")]


def order_lines(spark: SparkSession, sf_dir: str, start: dt.date | None = None,
                end: dt.date | None = None, columns: list[str] | None = None) -> DataFrame:
    """Order lines: lineitem x orders, and of customer, supplier and part those
    that the wanted ``columns`` need."""
    columns = columns or LINE_COLUMNS
    needed = {LINE_DIMENSIONS[c] for c in columns if c in LINE_DIMENSIONS}
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cond = _ts_bounds(F.col("o_orderdate"), start, end)
    if cond is not None:
        od = od.filter(cond)
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    for name, key, own, value in (("customer", "c_custkey", "o_custkey", "c_nationkey"),
                                  ("supplier", "s_suppkey", "l_suppkey", "s_nationkey"),
                                  ("part", "p_partkey", "l_partkey", "p_type")):
        if name in needed:
            j = j.join(table(spark, sf_dir, name).select(key, value), F.col(own) == F.col(key))
        else:
            j = j.withColumn(value, F.lit(None))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return j.select(
        F.col("l_orderkey").alias("order_ID"),
        F.col("o_custkey").alias("user_ID"),
        F.col("l_partkey").alias("sku_ID"),
        F.col("o_orderdate").alias("order_time"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("l_quantity").alias("quantity"),
        unit.alias("original_unit_price"),
        (unit * (1 - F.col("l_discount"))).alias("final_unit_price"),
        (unit * F.col("l_discount")).alias("direct_discount_per_unit"),
        F.lit(0.0).alias("quantity_discount_per_unit"),
        F.lit(0.0).alias("bundle_discount_per_unit"),
        F.lit(0.0).alias("coupon_discount_per_unit"),
        F.when(F.col("l_returnflag") == "R", "1").when(F.col("l_returnflag") == "A", "0")
         .otherwise("").alias("gift_item"),
        F.when(F.col("l_linenumber") == 7, F.lit("-"))
         .otherwise((1 + F.col("l_partkey") % 3).cast("string")).alias("promise"),
        F.when(F.col("p_type") == "PROMO", 2).otherwise(1).alias("type"),
        F.col("s_nationkey").alias("dc_ori"),
        F.col("c_nationkey").alias("dc_des"),
    ).select(*columns)


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dc -> region; 25 rows by construction (TPC-H nation)."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("dc_ID"), F.col("n_regionkey").alias("region_ID"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SKU -> cluster mapping (one row per SKU)."""
    return (table(spark, sf_dir, "part").select("p_partkey", "p_size")
            .filter(F.col("p_partkey") % 50 != 0)
            .select(F.col("p_partkey").alias("sku_ID"),
                    (F.col("p_size") % 8).alias("sku_cluster_ID")))


def _sku_from_props() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "props")
    return (ev.filter(F.col("event_type").isin("click", "view"))
            .select(F.when(F.col("user_id") % 50 == 0, F.lit("-"))
                     .otherwise(F.col("user_id").cast("string")).alias("user_ID"),
                    _sku_from_props().alias("sku_ID"),
                    F.col("ts").alias("request_time"),
                    F.col("event_type").alias("channel")))


def funnel_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "props")
    return (ev.filter(F.col("event_type") == "purchase")
            .select(F.col("user_id").cast("string").alias("user_ID"),
                    _sku_from_props().alias("sku_ID"),
                    F.col("ts").alias("order_time")))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dc, sku, date) rows; a row means the SKU is in stock at end of day."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (li.join(su, li.l_suppkey == su.s_suppkey)
            .select(F.col("s_nationkey").alias("dc_ID"), F.col("l_partkey").alias("sku_ID"),
                    F.col("l_shipdate").cast("date").alias("date"))
            .distinct())


def sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    return pa.select(
        F.col("p_partkey").alias("sku_ID"),
        F.when(F.col("p_type") == "PROMO", 2).otherwise(1).alias("type"),
        F.col("p_brand").alias("brand_ID"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit("-"))
         .otherwise(F.col("p_size").cast("string")).alias("attribute1"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit("-")).otherwise(F.col("p_type")).alias("attribute2"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User master; every tenth user has no region."""
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return cu.select(F.col("c_custkey").cast("string").alias("user_ID"),
                     F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("region"))


def delivery(spark: SparkSession, sf_dir: str, start: dt.date | None = None,
             end: dt.date | None = None) -> DataFrame:
    """One package per order line with ship-out / station / arrival times."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    cond = _ts_bounds(F.col("o_orderdate"), start, end)
    if cond is not None:
        od = od.filter(cond)
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    h1 = F.col("l_linenumber").cast("int")
    h2 = (F.col("l_linenumber") + F.col("l_suppkey") % 24).cast("int")
    h3 = (F.col("l_linenumber") + F.col("l_suppkey") % 24 + F.col("l_partkey") % 60).cast("int")
    return j.select(
        F.col("l_orderkey").alias("order_ID"),
        F.col("l_linenumber").alias("package_ID"),
        F.timestamp_add("HOUR", h1, F.col("o_orderdate")).alias("ship_out_time"),
        F.timestamp_add("HOUR", h2, F.col("o_orderdate")).alias("arr_station_time"),
        F.timestamp_add("HOUR", h3, F.col("o_orderdate")).alias("arr_time"),
    )


def shift_click_date(ts: Column) -> Column:
    """Map a click timestamp onto the order calendar (whole-day shift)."""
    return F.date_add(F.lit(config.WINDOW_START),
                      F.datediff(ts.cast("date"), F.lit(config.CLICK_EPOCH)))


@dataclass
class Tables:
    """Lazy handles on every bound table of one scale-factor folder."""

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    def orders(self, start=None, end=None, columns=None) -> DataFrame:
        return order_lines(self.spark, self.sf_dir, start, end, columns)

    def window_orders(self, columns=None) -> DataFrame:
        return order_lines(self.spark, self.sf_dir, config.WINDOW_START, config.WINDOW_END, columns)

    def network(self) -> DataFrame:
        return network(self.spark, self.sf_dir)

    def clusters(self) -> DataFrame:
        return clusters(self.spark, self.sf_dir)

    def clicks(self) -> DataFrame:
        return clicks(self.spark, self.sf_dir)

    def funnel_orders(self) -> DataFrame:
        return funnel_orders(self.spark, self.sf_dir)

    def inventory(self) -> DataFrame:
        return inventory(self.spark, self.sf_dir)

    def sku(self) -> DataFrame:
        return sku(self.spark, self.sf_dir)

    def users(self) -> DataFrame:
        return users(self.spark, self.sf_dir)

    def delivery(self, start=None, end=None) -> DataFrame:
        return delivery(self.spark, self.sf_dir, start, end)


def bind(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def clusters_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second cluster scheme (B) for scheme comparison: size mod 5."""
    return (table(spark, sf_dir, "part").select("p_partkey", "p_size")
            .filter(F.col("p_partkey") % 50 != 0)
            .select(F.col("p_partkey").alias("sku_ID"),
                    (F.col("p_size") % 5).alias("sku_cluster_ID")))


def clicks_daily_shifted(clicks_df: DataFrame) -> DataFrame:
    """A6 on the order calendar: clicks per (sku, shifted day)."""
    return clicks_df.groupBy("sku_ID", shift_click_date(F.col("request_time")).alias("order_date")).agg(
        F.count(F.lit(1)).alias("daily_clicks"))
