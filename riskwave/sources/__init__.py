from riskwave.sources.tables import read_table
from riskwave.sources.fixtures import (
    transactions, transactions_core, transactions_countries, transactions_ties, transactions_orders, transactions_nulls,
    transactions_delayed, arrival_slice, requests, scored, LATE_DELAY, TXN_SCHEMA,
)

__all__ = ["read_table", "transactions", "transactions_core", "transactions_countries", "transactions_ties", "transactions_orders",
           "transactions_nulls", "transactions_delayed", "arrival_slice", "requests", "scored", "LATE_DELAY", "TXN_SCHEMA"]
