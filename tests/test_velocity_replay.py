"""Serial replay check: a plain Python keyed function (per-user buffer of
the newest ``cap`` events, frames closed at both ends, state updated
before it is read) against the Spark frames, in exact decimals."""

from collections import defaultdict, deque
from datetime import timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest

from riskwave.operators.velocity import velocity_features
from riskwave.sources import transactions, transactions_ties
from tests.conftest import SF_SMALL, SF_MID


def replay(rows, cap):
    buf = defaultdict(lambda: deque(maxlen=cap))
    out = {}
    for r in sorted(rows, key=lambda r: (r["transaction_time"], r["transaction_id"])):
        t = r["transaction_time"]
        b = buf[r["user_id"]]
        b.append((t, Decimal(str(r["amount"])).quantize(Decimal("0.01"))))
        d24 = [a for ts, a in b if ts >= t - timedelta(hours=24)]
        d1 = [a for ts, a in b if ts >= t - timedelta(hours=1)]
        s1, s24 = sum(d1, Decimal(0)), sum(d24, Decimal(0))
        score = (len(d1) * Decimal("0.4") + s1 * Decimal("0.003") + len(d24) * Decimal("0.3"))
        out[r["transaction_id"]] = (
            len(d1), len(d24), s1.quantize(Decimal("0.01")),
            (s24 / len(d24)).quantize(Decimal("0.01"), ROUND_HALF_UP),
            score.quantize(Decimal("0.0001"), ROUND_HALF_UP))
    return out


@pytest.mark.parametrize("fixture,cap", [(transactions, 500), (transactions_ties, 500),
                                         (transactions_ties, 5), (transactions, 3)])
def test_replay_equals_frames(spark, fixture, cap):
    t = fixture(spark, SF_SMALL)
    rows = [r.asDict() for r in t.select("user_id", "transaction_id", "transaction_time",
                                         "amount").collect()]
    want = replay(rows, cap)
    got = {r.transaction_id: (r.txn_count_1h, r.txn_count_24h, r.amount_sum_1h,
                              r.avg_amount_24h, r.velocity_score)
           for r in velocity_features(t, cap=cap).collect()}
    assert got == want


def test_work_grows_linearly_on_one_hot_day(spark):
    """All events of one user within one day: rows and running sums are
    spread over range partitions, and the plan has no range frame."""
    from pyspark.sql import functions as F
    n = 20_000
    t = spark.range(n).select(
        F.col("id").alias("transaction_id"), F.lit(1).cast("long").alias("user_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 4)).cast("timestamp_ntz")
        .alias("transaction_time"), F.lit(1.25).alias("amount"))
    v = velocity_features(t)
    assert "RangeFrame" not in v._jdf.queryExecution().optimizedPlan().toString()
    got = v.agg(F.sum("txn_count_1h"), F.sum("txn_count_24h"), F.max("txn_count_1h"), F.max("amount_sum_1h")).first()
    assert tuple(got[:3]) == (sum(min(i + 1, 901) for i in range(n)), sum(min(i + 1, 21601) for i in range(n)), 901)
    assert got[3] == Decimal("1126.25")
