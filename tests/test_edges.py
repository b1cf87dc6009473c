"""Null and edge rows: missing countries (either or both sides), a mean of
-1 in the amount ratio, unseen categories, n = 0 log reads."""

import datetime as dt

from pyspark.sql import functions as F

from riskwave.functions import encoding as enc
from riskwave.functions import features as fx
from riskwave.operators import state as st
from riskwave.operators.velocity import velocity_features
from riskwave.sources import transactions
from tests.conftest import SF_SMALL

T0 = dt.datetime(2024, 1, 6, 23, 30)      # a Saturday, night


def _rows(spark):
    return spark.createDataFrame(
        [(1, 10.0, -1.0, "DE", "DE"), (2, 10.0, 4.0, None, "DE"), (3, 10.0, 4.0, "FR", None),
         (4, 10.0, 4.0, None, None), (5, 10.0, 4.0, "FR", "DE")],
        "transaction_id long, amount double, avg_amount_user double, country string, "
        "bin_country string").withColumn("transaction_time", F.lit(T0).cast("timestamp_ntz"))


def test_geo_mismatch_and_ratio_edges(spark):
    out = {r.transaction_id: r for r in fx.engineer_features(_rows(spark)).collect()}
    assert [out[i].geo_mismatch for i in range(1, 6)] == [0, 1, 1, 1, 1]
    assert out[1].amount_vs_avg is None            # division by zero -> null, then filled
    assert out[2].amount_vs_avg == 10.0 / 5.0
    r = out[5]
    assert (r.txn_hour, r.txn_dayofweek, r.is_weekend, r.is_night) == (23, 5, 1, 1)
    filled = {r.transaction_id: r for r in fx.fill_missing(fx.engineer_features(_rows(spark))).collect()}
    assert filled[1].amount_vs_avg == 0.0 and filled[4].country == "Missing"


def test_unseen_category_encodes_to_minus_one(spark):
    train = spark.createDataFrame([("a",), ("c",), ("b",)], "channel string")
    vocab = enc.fit_vocabulary(train, ["channel"])
    test = spark.createDataFrame([(1, "b"), (2, "z"), (3, "a")], "id long, channel string")
    got = {r.id: r.channel for r in enc.ordinal_encode(test, vocab, ["channel"]).collect()}
    assert got == {1: 1, 2: -1, 3: 0}


def test_log_read_of_zero_rows(spark):
    v = velocity_features(transactions(spark, SF_SMALL))
    assert st.stream_log_latest(st.stream_log(v), 0).count() == 0
    assert st.stream_log_latest(st.stream_log(v), 5).count() == 5


def test_an_event_delivered_twice_is_two_events(spark):
    import datetime as dt

    from riskwave.operators.velocity import velocity_features
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, 7, at(1), 1.0), (2, 7, at(5), 2.0), (2, 7, at(5), 2.0), (3, 7, at(6), 4.0), (3, 8, at(6), 4.0)]
    df = spark.createDataFrame(rows, "transaction_id long, user_id long, transaction_time timestamp_ntz, amount double")
    for cap in (None, 2):
        got = sorted((r.user_id, r.transaction_id, r.txn_count_1h, r.txn_count_24h, float(r.amount_sum_1h))
                     for r in velocity_features(df, cap=cap).collect())
        assert got == [(7, 1, 1, 1, 1.0), (7, 2, 1, 2, 2.0), (7, 2, 2, 3 if cap is None else 2, 4.0),
                       (7, 3, 3 if cap is None else 2, 4 if cap is None else 2, 8.0 if cap is None else 6.0), (8, 3, 1, 1, 4.0)]

