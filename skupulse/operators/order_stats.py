"""Exact percentiles of large columns, without a task that sees them all.

Spark's ``percentile`` merges one value -> count map of the whole column in a
single task.  Here a column's wanted ranks are bracketed first and only what
lies inside a bracket is counted by value:

1. a mergeable sketch (``percentile_approx``, error at most 1/accuracy of the
   rows) gives for each percentile two bounds that its ranks cannot leave;
   columns of at most ``accuracy`` rows need no bounds;
2. the bounds cut the value range; one aggregation counts rows per range, and
   inside the brackets per value, with partial sums before the shuffle;
3. ranges (two per percentile, and one) get their offsets, values their running
   count inside their range, and the values at the two ranks next to the wanted
   position are interpolated linearly.

Nulls are left out; NaN sorts last; a column without values gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skupulse.operators.grid import attach_one_row

ACCURACY = 10_000


def _long(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(name, x): one row per non-null value of each column."""
    pairs = [F.struct(F.lit(name).alias("name"), c.cast("double").alias("x")) for name, c in columns.items()]
    return df.select(F.inline(F.array(*pairs))).where(F.col("x").isNotNull())


def _brackets(long: DataFrame, ps: list[float], accuracy: int) -> DataFrame:
    """Per name: rows, brackets (one per percentile; null bound = open) and
    their bounds in order."""
    # 1/accuracy for the sketch on either side, the rest for rounding of ranks
    reach = 3.0 / accuracy
    asked = [min(max(q, 0.0), 1.0) for p in ps for q in (p - reach, p + reach)]
    sketch = long.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("x", asked, accuracy).alias("b"))
    few = F.col("rows") <= accuracy

    def bound(i: int) -> Column:
        return F.when(~few & F.lit(0.0 < asked[i] < 1.0), F.col("b")[i])

    brackets = F.array(*[F.struct(bound(2 * i).alias("lo"), bound(2 * i + 1).alias("hi")) for i in range(len(ps))])
    edges = F.array_sort(F.array_distinct(F.array_compact(F.array(*[bound(i) for i in range(len(asked))]))))
    return sketch.select("name", "rows", brackets.alias("brackets"), edges.alias("edges"))


def bracket_counts(df: DataFrame, columns: dict[str, Column], ps: list[float], accuracy: int = ACCURACY) -> tuple[DataFrame, DataFrame]:
    """(name, range, v, n) - v is null for what lies outside the brackets - and
    the brackets themselves."""
    long = _long(df, columns)
    sketch = _brackets(long, ps, accuracy)
    # one row per column name
    tagged = long.join(F.broadcast(sketch), "name")
    inside = F.exists("brackets", lambda b: (b["lo"].isNull() | (F.col("x") >= b["lo"])) & (b["hi"].isNull() | (F.col("x") <= b["hi"])))
    counts = tagged.groupBy("name", F.size(F.filter("edges", lambda e: e < F.col("x"))).alias("range"),
                            F.when(inside, F.col("x")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts, sketch.select("name", "rows")


def exact_percentiles(df: DataFrame, columns: dict[str, Column] | list[str], ps: list[float],
                      accuracy: int = ACCURACY) -> DataFrame:
    """One row; per column an array of its percentiles ``ps``.  ``df`` is read
    twice: hand in a written table where it is costly."""
    if not isinstance(columns, dict):
        columns = {c: F.col(c) for c in columns}
    counts, rows = bracket_counts(df, columns, ps, accuracy)
    before = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("name", "range").agg(F.sum("n").alias("n"))   # at most 2 * len(ps) + 1 per name
    offsets = ranges.select("name", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    upto = (Window.partitionBy("name", "range").orderBy(F.col("v").asc_nulls_first())
            .rowsBetween(Window.unboundedPreceding, 0))
    placed = (counts.withColumn("upto", F.sum("n").over(upto)).join(F.broadcast(offsets), ["name", "range"])
              .join(F.broadcast(rows), "name")
              .select("name", "v", "rows", (F.col("offset") + F.col("upto")).alias("last"),
                      (F.col("offset") + F.col("upto") - F.col("n")).alias("first")))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("last")), F.col("v")))

    found, names = [], list(columns)
    for p in ps:
        place = F.lit(p) * (F.col("rows") - 1)
        found += [at(F.floor(place)), at(F.ceil(place))]
    per_name = placed.groupBy("name", "rows").agg(F.array(*found).alias("at"))

    def interpolated(i: int, p: float) -> Column:
        place, low, high = F.lit(p) * (F.col("rows") - 1), F.col("at")[2 * i], F.col("at")[2 * i + 1]
        return (F.when(low.isNull() | high.isNull(), F.raise_error(F.lit("a wanted rank lies outside its bracket")).cast("double"))
                .when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high))

    per_name = per_name.select("name", F.array(*[interpolated(i, p) for i, p in enumerate(ps)]).alias("q"))
    return per_name.agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in names])


def with_percentiles(one_row: DataFrame, df: DataFrame, columns: dict[str, Column] | list[str], ps: list[float],
                     accuracy: int = ACCURACY) -> DataFrame:
    """A global aggregate's row with the percentile arrays as ``_q_<name>``."""
    q = exact_percentiles(df, columns, ps, accuracy)
    return attach_one_row(one_row, q.select(*[F.col(c).alias(f"_q_{c}") for c in q.columns]))
