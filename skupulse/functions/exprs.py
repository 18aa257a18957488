"""Column expressions (all JVM-side, codegen friendly).

ANSI mode is on in Spark 4: every cast that may fail is a ``try_cast`` and
every ratio that may divide by zero is guarded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_ORDER_COLS = [
    "quantity",
    "final_unit_price",
    "original_unit_price",
    "direct_discount_per_unit",
    "quantity_discount_per_unit",
    "bundle_discount_per_unit",
    "coupon_discount_per_unit",
]

DISCOUNT_COLS = [
    "direct_discount_per_unit",
    "quantity_discount_per_unit",
    "bundle_discount_per_unit",
    "coupon_discount_per_unit",
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double0(c) -> Column:
    """Numeric coercion, non-numeric or null -> 0.0."""
    return F.coalesce(col_(c).try_cast("double"), F.lit(0.0))


def clip_lower(c, lower: float = 0.0) -> Column:
    """clip(lower=...) with null kept."""
    c = col_(c)
    return F.when(c.isNull(), c).otherwise(F.greatest(c, F.lit(float(lower))))


def gift_text(c) -> Column:
    """C4: gift text as string; null / 'nan' / 'None' / 'NaN' -> ''."""
    s = col_(c).cast("string")
    return F.when(s.isNull() | s.isin("nan", "None", "NaN"), F.lit("")).otherwise(s)


def nonblank(c) -> Column:
    return F.trim(col_(c)) != ""


def nullif(c, sentinel) -> Column:
    """Sentinel (e.g. '-') -> null."""
    c = col_(c)
    return F.when(c == F.lit(sentinel), F.lit(None)).otherwise(c)


def finite_or_zero(c) -> Column:
    """+-inf / NaN / null -> 0."""
    c = col_(c)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def safe_div(num, den) -> Column:
    """x / y with y == 0 -> null (pandas ``replace(0, nan)``; SQL NULLIF)."""
    return F.try_divide(col_(num), F.nullif(col_(den), F.lit(0)))


def safe_div0(num, den) -> Column:
    """x / y with y == 0 or null -> 0.0."""
    return F.coalesce(safe_div(num, den), F.lit(0.0))


def day_of_week(d) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col_(d))


def is_weekend(d) -> Column:
    return (F.weekday(col_(d)) >= 5).cast("int")


def micros_between(a, b) -> Column:
    """Microseconds from a to b.  The difference is an interval, so on
    timestamp_ntz this is wall-clock arithmetic whatever the session zone."""
    gap = col_(b) - col_(a)
    day, hour, minute, second = (F.extract(F.lit(f), gap) for f in ("DAY", "HOUR", "MINUTE", "SECOND"))
    minutes = (day.cast("long") * 24 + hour) * 60 + minute
    return minutes * 60_000_000 + (second * 1_000_000).cast("long")


def days_between(a, b) -> Column:
    """Fractional days from a to b (may be negative)."""
    return micros_between(a, b) / 86_400e6


def hours_between(a, b) -> Column:
    """Fractional hours from a to b."""
    return micros_between(a, b) / 3_600e6


def bool_rate(cond: Column) -> Column:
    """Mean of a boolean where null counts as False (T4)."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def count_if(cond: Column) -> Column:
    return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))


def round_binary(c, scale: int = 6) -> Column:
    """round(x * 10^s) / 10^s on the binary double (half away from zero).

    ``F.round`` rounds the shortest decimal string of the double, so a value
    printed as ...5 at the cut rounds up even when the stored binary value is
    just below the half; this form rounds the stored value, matching SQL
    engines that scale, round and divide."""
    m = float(10 ** scale)
    return F.round(col_(c) * m, 0) / m


def round_stable(c, scale: int = 6) -> Column:
    """Round to ``scale`` decimals after snapping to ``scale + 3``.

    Sums and averages of the same values in a different order differ in the
    last bits; for values with a dyadic tail (n / 128 ends in ...5 at the 7th
    decimal) that noise decides which way the 6-decimal rounding goes.
    Snapping to 9 decimals first removes the noise and keeps true values."""
    return round_binary(round_binary(c, scale + 3), scale)


def round_doubles(df: DataFrame, scale: int = 6) -> DataFrame:
    """Round every double column (used on query outputs for stable hashes)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            cols.append(round_stable(F.col(f.name), scale).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def clean_orders(orders: DataFrame, clip_quantity: bool = False) -> DataFrame:
    """Date normalised (invalid dropped), numerics coerced to 0.0,
    gift text normalised, total discount, promo and gift flags.

    ``dc_des`` keeps its type and null stays null (trap T3 documented: the
    reference's string cast made a missing warehouse a real 'nan' group).
    """
    df = orders.withColumn("order_date", F.col("order_date").try_cast("date"))
    df = df.filter(F.col("order_date").isNotNull())
    df = df.withColumns({c: to_double0(c) for c in NUMERIC_ORDER_COLS})
    if clip_quantity:
        df = df.withColumn("quantity", F.greatest(F.col("quantity"), F.lit(0.0)))
    df = df.withColumn("gift_item", gift_text("gift_item"))
    total = F.col(DISCOUNT_COLS[0])
    for c in DISCOUNT_COLS[1:]:
        total = total + F.col(c)
    df = df.withColumn("total_discount_per_unit", total)
    return df.withColumns({
        "promo_line_flag": ((F.col("total_discount_per_unit") > 0) | nonblank("gift_item")).cast("int"),
        "gift_rate_flag": nonblank("gift_item").cast("int"),
    })
