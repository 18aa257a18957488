"""Order composition: distinct SKUs and types per order, without a task that holds
more than its share of the orders."""

import re

from skupulse.operators import network as nw


def test_composition_counts_types_once_and_groups_by_order_alone(spark):
    rows = [("a", "s1", 1), ("a", "s1", 1), ("a", "s1", 2), ("a", "s2", None), ("b", "s1", 1), ("b", "s2", 1),
            ("c", "s3", 2), ("c", None, 2), ("d", "s1", 1), ("d", "s4", 2), (None, "s1", 1)]
    found = nw.order_composition(spark.createDataFrame(rows, "order_ID string, sku_ID string, type int"))
    got = {r.order_ID: (r.total_items, r.n_1p, r.n_missing, r.composition) for r in found.collect()}
    assert got == {"a": (2, 1, 1, "contains_missing_sku_info"), "b": (2, 2, 0, "all_1p"), "c": (1, 0, 0, "all_3p"),
                   "d": (2, 1, 0, "mixed"), None: (1, 1, 0, "all_1p")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)
    assert exchanges and all(re.fullmatch(r"order_ID#\d+L?", x) for x in exchanges)


def test_parts_follow_the_lines(spark, monkeypatch):
    monkeypatch.setattr(nw, "COMPOSITION_ROWS", 10)
    lines = spark.range(1000).selectExpr("id div 4 as order_ID", "id as sku_ID", "1 as type")
    assert nw.order_composition(lines).rdd.getNumPartitions() == 100
