"""Plan-shape checks: pruned scans, one keyed exchange for the frames, no
single-partition exchange over data rows."""

import re

import pytest

from riskwave.queries import QUERIES
from tests.conftest import SF_SMALL


def plan(spark, name):
    return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["kpis", "hourly_fraud", "monthly_volume_long", "split_summary",
                                  "top_fraud_categories", "dataset_summary", "latest_transactions"])
def test_queries_without_joined_columns_have_no_join(spark, name):
    p = plan(spark, name)
    assert "Join" not in p and "nation" not in p


def test_velocity_reads_the_ranged_rows(spark):
    """No range frame and no hash partition per user: the running sums are
    windows inside stored range partitions."""
    p = plan(spark, "velocity_features")
    assert "RangeFrame" not in p
    assert re.search(r"Exchange hashpartitioning\(_pid#\d+, _k#\d+L", p)
    # events with the 4 columns the frames need, no joined table
    assert "nation" not in p


@pytest.mark.parametrize("name", ["asof_state_lookup", "user_profiles", "latest_user_state",
                                  "risk_signals", "idle_reset_counter", "latency_summary"])
def test_no_single_partition_over_rows(spark, name):
    assert "SinglePartition" not in plan(spark, name)


@pytest.mark.parametrize("name", ["running_totals", "progress_checkpoints", "roc_auc"])
def test_single_partition_steps_run_on_partition_totals(spark, name):
    p = plan(spark, name)
    # the only single-partition steps are the offsets window over the
    # per-partition totals (one row per range partition) and final sums
    for m in re.finditer(r"Exchange SinglePartition", p):
        tail = p[m.end():m.end() + 4000]
        assert "_pid" in tail
