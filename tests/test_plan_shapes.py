"""Physical plans keep the shape they were designed for."""

import os

import pytest

from riskframe.catalog import all_queries
from riskframe.catalog.base import table
from riskframe.operators.sampling import kfold_views, stratified_kfold

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")

ROW_BY_ROW = ["batch_score", "score_with_truth", "vote_soft", "linear_attribution", "attribution_waterfall", "stratified_kfold"]
GROUPED = ["roc_auc", "confusion_matrix", "drift_report", "running_best", "method_votes", "param_importance", "vote_intersection"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_BY_ROW)
def test_no_shuffle_and_no_python(spark, name):
    plan = _plan(all_queries()[name](spark, SMALL))
    assert "Exchange" not in plan and "EvalPython" not in plan


@pytest.mark.parametrize("name", GROUPED)
def test_no_product_joins(spark, name):
    plan = _plan(all_queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "EvalPython" not in plan


def test_only_needed_columns_are_read(spark):
    plan = _plan(all_queries()["accuracy"](spark, SMALL))
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "props" not in schema and "ts:" not in schema


def test_fold_filter_stays_a_filter_on_the_scan(spark):
    events = table(spark, SMALL, "events").selectExpr("event_id", "cast(event_type = 'view' AS int) AS y", "value")
    train, _ = kfold_views(stratified_kfold(events, "event_id", "y", 5), 0)
    plan = _plan(train)
    assert "Filter" in plan and "Exchange" not in plan
