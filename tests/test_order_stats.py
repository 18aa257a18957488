"""Exact percentiles against numpy, with and without brackets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skupulse.operators import order_stats as os_

PS = [0.0, 0.01, 0.25, 0.5, 0.5, 0.9, 0.999, 1.0]


def frame(spark, columns):
    n = max(map(len, columns.values()))
    rows = [tuple(None if i >= len(c) or c[i] is None else float(c[i]) for c in columns.values()) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{k} double" for k in columns)).repartition(5)


@pytest.mark.parametrize("accuracy", [50, 200, 10_000])
def test_percentiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    columns = {
        "distinct": rng.permutation(6_000) * 1.5 - 700,                       # all values differ
        "hot": np.where(rng.random(5_000) < 0.4, 3.0, rng.normal(size=5_000)),  # one value holds a third
        "few": rng.integers(0, 4, 4_000).astype(float),
        "skewed": np.exp(rng.normal(size=3_001) * 4),
        "constant": np.full(700, 2.5),
    }
    got = os_.exact_percentiles(frame(spark, columns), list(columns), PS, accuracy).first()
    for name, values in columns.items():
        assert np.allclose(got[name], np.percentile(values, [100 * p for p in PS]), rtol=1e-12, atol=1e-12), name


def test_small_columns(spark):
    for n in (0, 1, 2, 5):
        for accuracy in (2, 100):
            values = [(i * 7) % 11 for i in range(n)] + [None, None]
            got = os_.exact_percentiles(frame(spark, {"x": values}), ["x"], PS, accuracy).first().x
            if n == 0:
                assert got is None
            else:
                assert np.allclose(got, np.percentile(values[:n], [100 * p for p in PS]))


def test_only_brackets_are_counted_by_value(spark):
    """40,000 distinct values: what is sorted for two percentiles stays small."""
    df = spark.range(40_000).select(((F.col("id") * 7919) % 40_009).cast("double").alias("x"))
    counts, _ = os_.bracket_counts(df, {"x": F.col("x")}, [0.5, 0.99], 1_000)
    per_range = counts.where("v is not null").groupBy("range").count().collect()
    assert 0 < sum(r["count"] for r in per_range) < 40_000 * 2 * 8 / 1_000
    assert counts.agg(F.sum("n")).first()[0] == 40_000


def test_no_single_task_percentile(spark):
    import __spark_entry__ as entry
    for name in ("describe_demand", "variance_summary", "behavior_summary", "fulfillment_summary", "lead_time_by_fulfillment"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "percentile_approx(" in plan, name
