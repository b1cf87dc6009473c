"""Exact order statistics against a sort."""
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from riskwave.plans.selection import order_statistics


def brute(rows, ranks):
    out = {}
    for g, target, rank in ranks:
        own = sorted(v for h, v in rows if h == g and v is not None and abs(v) < float("inf"))
        if 1 <= rank <= len(own):
            out[g, target] = own[rank - 1]
    return out


def chosen(spark, rows, ranks, kind, **kw):
    df = spark.createDataFrame(rows, f"g string, v {kind}")
    r = spark.createDataFrame(ranks, "g string, target string, rank long")
    return {(x.g, x.target): x.v for x in order_statistics(df, "v", r, ["g"], **kw).collect()}


def test_ranks_of_groups_with_a_hot_value_and_few_bins(spark):
    rng = random.Random(1)
    rows = [("a", 1000)] * 400 + [("a", rng.randrange(-10 ** 15, 10 ** 15)) for _ in range(300)]
    rows += [(None, rng.randrange(5)) for _ in range(100)] + [("one", 7), ("nulls", None)]
    ranks = [(g, f"r{r}", r) for g in ("a", None, "one", "nulls", "absent") for r in (0, 1, 2, 50, 350, 351, 700, 701)]
    for bins in (2, 16, 4096):
        assert chosen(spark, rows, ranks, "long", bins=bins) == brute(rows, ranks)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False, width=32), min_size=1, max_size=30))
def test_doubles(spark, values):
    rows = [("a", v) for v in values]
    ranks = [("a", str(r), r) for r in range(1, len(values) + 1)]
    assert chosen(spark, rows, ranks, "double") == brute(rows, ranks)


def test_no_range_exchange_in_the_queries(spark):
    from riskwave.queries import QUERIES
    from tests.conftest import SF_SMALL
    for name in ("split_instant", "latency_summary"):
        if name in QUERIES:
            plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
            assert "rangepartitioning" not in plan


def test_split_instant_of_equal_times(spark):
    from riskwave.operators.aggregates import split_value
    df = spark.range(100).select(F.col("id").alias("transaction_id"),
                                 F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("transaction_time"))
    assert str(split_value(df)) == "2024-01-01 00:00:00" and split_value(df.limit(0)) is None
