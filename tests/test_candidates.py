"""All candidates of the reference take part in selection and comparison."""

import pytest

from skupulse.operators import evaluate as ev
from skupulse.plans import q_models as qm
from skupulse.plans.q_forecast import Inputs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("valid", [True, False])
def test_all_candidates_compete(spark, valid):
    i = Inputs(spark, SF)
    rows = qm._candidate_summary(i, valid)
    got = {r.model_id: r for r in rows.collect()}
    rules = ["lag_1", "moving_average_3", "moving_average_7", "blend_50_50"]
    assert set(got) == {f"{a}__{m}" for a in ("direct_warehouse", "cluster_to_warehouse") for m in [*rules, *qm.CANDIDATES]}
    # each predicts the same cells, and the rules as before
    assert len({round(r.actual_units, 6) for r in got.values()}) == 1
    before = ev.model_summary(i.merged_valid() if valid else i.merged_test()).collect()
    assert {r.model_id: round(r.mae, 9) for r in before} == {m: round(r.mae, 9) for m, r in got.items() if r.family == "baseline"}
    assert ev.best_learned(rows).collect()[0].family in ("linear", "tree")
    assert sum(r.is_selected for r in ev.model_selection(rows).collect()) == 1
