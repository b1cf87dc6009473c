"""Property test: random per-user streams with ties, exact 1 h / 24 h
boundary gaps and empty stretches; frames must equal the serial replay."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riskwave.operators.velocity import velocity_features
from tests.test_velocity_replay import replay

BASE = dt.datetime(2024, 1, 1)
GAPS = [0, 1, 59, 3600, 3601, 86399, 86400, 86401, 200000]   # seconds; 0 = tie

streams = st.lists(
    st.tuples(st.integers(0, 3), st.sampled_from(GAPS), st.integers(0, 99999)),
    min_size=1, max_size=60)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(streams, st.sampled_from([2, 5, 500]))
def test_random_streams(spark, events, cap):
    clock = {u: BASE for u in range(4)}
    rows = []
    for i, (u, gap, cents) in enumerate(events):
        clock[u] = clock[u] + dt.timedelta(seconds=gap)
        rows.append((i, u, clock[u], cents / 100.0))
    df = spark.createDataFrame(rows, "transaction_id long, user_id long, "
                                     "transaction_time timestamp_ntz, amount double")
    want = replay([dict(zip(["transaction_id", "user_id", "transaction_time", "amount"], r))
                   for r in rows], cap)
    got = {r.transaction_id: (r.txn_count_1h, r.txn_count_24h, r.amount_sum_1h,
                              r.avg_amount_24h, r.velocity_score)
           for r in velocity_features(df, cap=cap).collect()}
    assert got == want
