"""Physical-plan checks: filters reach the scan, columns are pruned, no
cartesian product outside the dense-panel dimension grids."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + "\n" + \
        df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def written_plans(monkeypatch):
    """Initial plans of every table that a query writes for itself."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def recording(self, path, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", recording)
    return plans


def test_flagship_pushes_window_filter_and_prunes_lineitem(spark, written_plans):
    entry.queries()["cluster_summary"](spark, SF)
    text = "\n".join(written_plans)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", text)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", text)
    li = re.findall(r"ReadSchema: struct<(l_[^>]*)>", text)
    assert li and all("l_tax" not in s and "l_shipdate" not in s for s in li)


def test_no_cartesian_product_in_row_level_queries(spark):
    for name in ["user_behavior", "click_to_order", "clicks_day_region_sku", "order_mart", "variance_dc"]:
        text = _plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text, name


def test_no_python_udf_outside_transfer_rule(spark):
    for name in ["cluster_summary", "user_behavior", "feature_frame", "order_mart", "ecdf_days"]:
        text = _plan(entry.queries()[name](spark, SF))
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name


def test_one_scan_of_the_order_lines(spark, written_plans):
    """Everything that a query writes for itself and its final plan together read
    the order lines once (initial plans, before AQE reuses anything)."""
    for name in ("region_summary", "region_overall", "scheme_recommendation", "demand_grid_wh", "cluster_score", "cluster_features",
                 "feature_frame", "demand_param", "demand_param_month", "metrics_overall", "model_selection", "describe_demand",
                 "sku_features_price", "sku_features_demand", "zscore", "split_meta", "price_coverage", "procurement"):
        written_plans.clear()
        try:
            df = entry.queries()[name](spark, SF)
        except ValueError as e:
            assert "to train and" in str(e)
            continue
        plans = [*written_plans, df._jdf.queryExecution().executedPlan().toString()]
        scans = sum(p.count("lineitem.parquet") for p in plans)
        assert scans == 1, (name, scans)
