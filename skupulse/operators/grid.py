"""Dense panels (D1, D2, D3): every key combination x every day, zero filled.

Design for scale
----------------
* Dimension sets (warehouses, clusters) are small by nature; whether the
  product is broadcast is decided by AQE from the measured size of each
  distinct set (Spark's broadcast threshold), never by a blind hint.
* Dates are never joined: ``explode(sequence(start, end))`` generates them
  per grid row (no shuffle, no driver round trip).
* Zero filling is ``union`` of the zero grid with the (pre-projected) facts
  followed by ONE ``groupBy().sum()``.  Partial aggregation runs map side, so
  the single shuffle carries at most one row per key and partition, and a
  hot key (a third of all rows) is summed before it leaves its task.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def dim_product(dims: list[DataFrame]) -> DataFrame:
    """Cartesian product of small dimension sets (each distinct).

    This is the only use of crossJoin in the library: the product IS the
    dense panel's key set, its size is the output size by definition.  No
    broadcast hint is forced: the dimension sets come out of a distinct
    (a shuffle), so AQE measures them at run time and plans a broadcast
    nested-loop join only when a side is under
    ``spark.sql.autoBroadcastJoinThreshold`` - the size check is Spark's own,
    and there is no eager counting job at plan-build time.
    """
    out = dims[0]
    for d in dims[1:]:
        out = out.crossJoin(d)
    return out


def date_spine(start, end) -> Column:
    """Generator column: every day in [start, end]."""
    s = F.lit(start) if isinstance(start, dt.date) else start
    e = F.lit(end) if isinstance(end, dt.date) else end
    return F.explode(F.sequence(s, e, F.expr("INTERVAL 1 DAY")))


def densify(facts: DataFrame, keys: DataFrame, date_col: str, start, end,
            value_cols: list[str], key_cols: list[str] | None = None) -> DataFrame:
    """Sum ``value_cols`` of ``facts`` by (date, keys) over the full grid.

    ``keys`` holds the distinct non-date key combinations; the grid is keys x
    [start, end].  Cells with no fact get 0.0.  ``facts`` rows outside the
    grid are dropped (semi-join semantics of a left join onto the grid).
    """
    key_cols = key_cols or keys.columns
    grid = keys.select(*key_cols, date_spine(start, end).alias(date_col))
    zeros = grid.select(date_col, *key_cols, *[F.lit(0.0).alias(v) for v in value_cols],
                        F.lit(1).alias("_in_grid"))
    f = facts.select(date_col, *key_cols, *[F.col(v).cast("double").alias(v) for v in value_cols],
                     F.lit(0).alias("_in_grid"))
    both = zeros.unionByName(f)
    agg = both.groupBy(date_col, *key_cols).agg(
        *[F.sum(v).alias(v) for v in value_cols], F.max("_in_grid").alias("_in_grid"))
    return agg.filter(F.col("_in_grid") == 1).drop("_in_grid")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a global aggregate (exactly one row) to every row.

    The right side is the output of an ungrouped ``agg`` - one row by
    construction - so broadcasting it is size-safe; this replaces a window
    without ``partitionBy`` (which would pull all rows into one task).
    """
    return df.crossJoin(F.broadcast(one_row))
