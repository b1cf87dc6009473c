"""Distributed running counts / sums / lags equal the single-window form,
with partition boundaries cutting through keys."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskwave.oracle_check import compare
from riskwave.oracles import ORACLES
from riskwave.plans.prefix import keyed_prefix
from riskwave.queries import QUERIES
from riskwave.sources import transactions_ties
from tests.conftest import SF_SMALL


@pytest.fixture(params=[("true", "true"), ("false", "true"), ("false", "false")], ids=["default", "no-reuse", "no-aqe"])
def planner(spark, request):
    """Exchange reuse and adaptive execution must not change any result."""
    names = ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")
    old = [spark.conf.get(k) for k in names]
    for k, v in zip(names, request.param):
        spark.conf.set(k, v)
    yield
    for k, v in zip(names, old):
        spark.conf.set(k, v)


@pytest.mark.parametrize("planner", [("false", "true"), ("false", "false")], indirect=True,
                         ids=["no-reuse", "no-aqe"])
@pytest.mark.parametrize("name", ["running_totals", "idle_reset_counter", "user_sessions", "split_instant",
                                  "latency_summary", "inflight", "roc_auc", "counter_rate"])
def test_queries_do_not_depend_on_exchange_reuse(spark, duck_small, planner, name):
    r = compare(spark, SF_SMALL, name, QUERIES[name], ORACLES[name], duck_small)
    assert r.get("match"), r


@pytest.mark.parametrize("keys,parts", [(["user_id"], 3), (["user_id"], 37), ([], 5),
                                        (["user_id", "channel"], 11)])
def test_keyed_prefix_matches_window(spark, planner, keys, parts):
    t = transactions_ties(spark, SF_SMALL).withColumn(
        "cents", (F.col("amount").cast("decimal(18,2)") * 100).cast("long"))
    order = ["transaction_time", "transaction_id"]
    a = keyed_prefix(t, keys, order, ["cents"], n_parts=parts, lags=["amount"])
    w = Window.partitionBy(*keys).orderBy(*order)
    b = t.select("transaction_id", F.row_number().over(w).cast("long").alias("rn"),
                 F.sum("cents").over(w).alias("running_cents"),
                 F.lag("amount").over(w).alias("prev_amount"))
    pa = a.select(*b.columns).toPandas().sort_values("transaction_id").reset_index(drop=True)
    pb = b.toPandas().sort_values("transaction_id").reset_index(drop=True)
    assert pa.equals(pb)


@pytest.mark.parametrize("keys,parts", [(["user_id"], 3), (["user_id"], 23), ([], 7)])
def test_segmented_counts(spark, planner, keys, parts):
    """``seg_<flag>``: rows since the latest flagged row, across partitions."""
    t = transactions_ties(spark, SF_SMALL).withColumn(
        "flag", ((F.col("transaction_id") % 13 == 0) | (F.col("amount") > 30)).cast("long"))
    order = ["transaction_time", "transaction_id"]
    a = keyed_prefix(t, keys, order, ["flag"], n_parts=parts, resets=["flag"])
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = t.select("transaction_id", *keys, *order,
                    F.sum("flag").over(w).alias("run"))
    w2 = Window.partitionBy(*keys, "run").orderBy(*order)
    b = runs.select("transaction_id", F.row_number().over(w2).cast("long").alias("seg_flag"),
                    F.col("run").alias("running_flag"))
    pa = a.select(*b.columns).toPandas().sort_values("transaction_id").reset_index(drop=True)
    pb = b.toPandas().sort_values("transaction_id").reset_index(drop=True)
    assert pa.equals(pb)


def test_a_second_pass_goes_on_with_the_stored_partitions(spark):
    """One range-partitioned table serves both passes: the second one adds no
    exchange of the rows, and its results are those of a new partitioning."""
    from riskwave.operators import windows as win
    from riskwave.sources import transactions_core
    t = transactions_core(spark, SF_SMALL)
    flags = win.idle_flags(t)
    first = keyed_prefix(flags, ["user_id"], win.SEQ, ["new_run"], resets=["new_run"])
    again = keyed_prefix(flags.drop("_pid"), ["user_id"], win.SEQ, ["new_run"], resets=["new_run"], n_parts=3)
    assert first.columns == again.columns
    assert first.exceptAll(again).count() == 0 and again.exceptAll(first).count() == 0
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
