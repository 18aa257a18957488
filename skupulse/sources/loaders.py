"""Ingestion helpers.

Raw CSV only at the edge: columns are projected at the scan, time columns
parsed with ``try_to_timestamp`` (unparseable text stays as text in a side
column rather than failing the load), names stripped, and the result is
registered as a view or written as parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skupulse.operators.candidates import require_columns

# Name hints used to pick click / user tables and region columns.
CLICK_TABLE_HINTS = ["click"]
USER_TABLE_HINTS = ["user"]
TIME_COLUMN_HINTS = ["request_time", "time", "ts", "timestamp"]
REGION_COLUMN_CANDIDATES = ["region", "province", "city", "city_level", "area", "district"]


def strip_names(df: DataFrame) -> DataFrame:
    """Strip whitespace from column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def load_table(spark: SparkSession, path: str, cols: list[str] | None = None, time_cols: list[str] = (),
               view: str | None = None, fmt: str = "csv") -> DataFrame:
    """Column-projected scan; time columns parsed (invalid -> null in
    the parsed column, the raw text kept as ``<col>_raw``); optionally
    registered (replacing) as a temp view."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = strip_names(reader.format(fmt).load(path))
    if cols:
        require_columns(df, cols, path)
        df = df.select(*cols)
    for c in time_cols:
        df = df.withColumn(f"{c}_raw", F.col(c).cast("string")).withColumn(
            c, F.try_to_timestamp(F.col(c).cast("string")))
    if view:
        df.createOrReplaceTempView(view)
    return df


# Columns of the logical tables that come as text, with their type;
# "!" marks a strict column, whose bad cells reject the row, in others they are null.
LOGICAL = {
    "clicks": {"user_ID": "string", "sku_ID": "bigint", "request_time": "timestamp_ntz!", "channel": "string"},
    "users": {"user_ID": "string!", "level": "int", "region": "string"},
    "orders": {"order_ID": "string!", "user_ID": "string", "sku_ID": "string", "order_date": "date!", "order_time": "timestamp_ntz",
               "quantity": "double", "original_unit_price": "double", "final_unit_price": "double", "dc_ori": "int", "dc_des": "int"},
    "inventory": {"dc_ID": "int", "sku_ID": "string", "date": "date!"},
    "delivery": {"order_ID": "string!", "package_ID": "string", "ship_out_time": "timestamp_ntz!", "arr_station_time": "timestamp_ntz!",
                 "arr_time": "timestamp_ntz!"},
    "network": {"dc_ID": "int!", "region_ID": "int!"},
    "skus": {"sku_ID": "string!", "type": "int", "brand_ID": "string", "attribute1": "string", "attribute2": "string"},
}


def load_logical(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """A logical table from header CSV: names stripped, the declared columns
    alone, cells parsed by type.  Returns the kept rows, and one row (table, rows,
    rejected, coerced): rejected rows have a bad or empty cell in a strict column,
    coerced cells are text that a lenient column could not parse."""
    kinds = LOGICAL[table]
    raw = strip_names(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path))
    require_columns(raw, list(kinds), path)
    cell = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in kinds}
    parsed = {c: cell[c].try_cast(k.rstrip("!")) for c, k in kinds.items()}
    bad = F.lit(False)
    for c, k in kinds.items():
        if k.endswith("!"):
            bad = bad | parsed[c].isNull()
    lost = F.lit(0)
    for c, k in kinds.items():
        if not k.endswith("!"):
            lost = lost + (cell[c].isNotNull() & parsed[c].isNull()).cast("int")
    df = raw.select(*[parsed[c].alias(c) for c in kinds], bad.alias("_bad"), lost.alias("_lost"))
    report = df.agg(F.lit(table).alias("table"), F.count(F.lit(1)).alias("rows"),
                    F.coalesce(F.sum(F.col("_bad").cast("long")), F.lit(0)).alias("rejected"),
                    F.coalesce(F.sum(F.when(~F.col("_bad"), F.col("_lost"))), F.lit(0)).cast("long").alias("coerced"))
    return df.where(~F.col("_bad")).drop("_bad", "_lost"), report


def load_orders(spark: SparkSession, table: str, path: str, required: list[str], fmt: str = "csv"):
    """S3: prefer the catalog table when it exists AND has every required
    column, else the file; returns (frame, source)."""
    if spark.catalog.tableExists(table):
        df = spark.table(table)
        if set(required) <= set(df.columns):
            return df, f"table:{table}"
    return load_table(spark, path, list(required), fmt=fmt), f"file:{path}"


def pick_table(spark: SparkSession, name_hints: list[str], column_hints: list[str]):
    """Score catalog tables (+2 name hint, +2 has a hinted column) and
    return (table, first hinted column present) of the best one (first best
    in name order); error when none scores."""
    best, best_score, best_col = None, 0, None
    for t in sorted(spark.catalog.listTables(), key=lambda x: x.name):
        cols = [c.name for c in spark.catalog.listColumns(t.name)]
        score = 2 * any(h in t.name.lower() for h in name_hints)
        hit = next((c for h in column_hints for c in cols if c.lower() == h), None)
        score += 2 * (hit is not None)
        if score > best_score:
            best, best_score, best_col = t.name, score, hit
    if best is None:
        raise ValueError(f"no table matches {name_hints} / {column_hints}")
    return best, best_col


def write_result(df: DataFrame, path: str, partition_by: list[str] | None = None, csv: bool = False) -> None:
    """Result table sink (parquet, optionally header CSV at the edge)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    (w.option("header", True).csv(path) if csv else w.parquet(path))
