"""Physical-plan checks for scale: no cross joins anywhere, aggregations
combine map-side, scans read only the needed columns."""

import pytest

import __spark_entry__ as ent
from conftest import SF_SMALL

JOINING = ["cell_lattice", "heat_weights", "histogram_equal_width", "kde_1d", "year_spine_join",
           "membership_semi_join", "describe", "year_magnitude_stats", "interpolate_linear",
           "sort_by_time", "dedupe_keep_first", "filter_options", "explore_filter_defaults",
           "forecast_chart_table", "history_summary", "anomaly_report", "score_records",
           "cluster_stats", "attach_latents", "silhouette_by_year", "silhouette_by_year_fast",
           "model_broadcast_join", "train_test_split", "hotspots_forecast"]


def _plan(df):
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString() + qe.optimizedPlan().toString()


@pytest.mark.parametrize("key", JOINING)
def test_no_cross_join(spark, key):
    plan = _plan(ent.queries()[key](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{key}: {bad}"


def test_cell_aggregate_partial_aggregation_and_pruning(spark):
    df = ent.queries()["cell_aggregate"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_avg" in plan
    assert "props" not in plan.split("ReadSchema")[-1].split("\n")[0]   # JSON column never read


def test_top_k_is_take_ordered(spark):
    df = ent.queries()["hotspots_frequency"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_global_order_is_one_exchange(spark):
    from sismo.operators import ordering as od
    from sismo.plans.q_core import cat_ym
    df = od.sorted_by_range(cat_ym(spark, SF_SMALL), od.time_order())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan and "Window" not in plan
    done = od.sort_by_time(cat_ym(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in done
