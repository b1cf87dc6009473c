"""Driver contract: entry() runs on sf0.001, every oracle key is a query,
and the entry schema is stable."""

import __spark_entry__ as E


def test_contract(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70
    df = E.entry(spark)
    assert df.columns == ["user_id", "transaction_id", "event_time", "txn_count_1h",
                          "txn_count_24h", "amount_sum_1h", "avg_amount_24h", "velocity_score"]
    assert df.count() == 1000
