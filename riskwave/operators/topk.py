"""Ordered top-k and deterministic sampling (TakeOrderedAndProject:
partial top-k per task, then a final merge of k rows per task)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATEST_ROWS = 1000
SAMPLE_ROWS = 500
COLS = ["transaction_id", "user_id", "transaction_time", "amount", "is_fraud"]


def latest_transactions(txn: DataFrame, n: int = LATEST_ROWS) -> DataFrame:
    return (txn.select(*COLS)
               .orderBy(F.col("transaction_time").desc(), F.col("transaction_id").desc())
               .limit(n))


def sample_transactions(txn: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """``n`` rows without replacement, chosen by a hash of the id (the
    same in every engine, so reproducible), then in time order."""
    key = F.md5(F.col("transaction_id").cast("string"))
    picked = txn.select(*COLS, key.alias("_h")).orderBy("_h", "transaction_id").limit(n)
    return picked.select(*COLS).orderBy("transaction_time", "transaction_id")


def sample_fraction(txn: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample of a fraction (the sampling operator)."""
    return txn.sample(withReplacement=False, fraction=fraction, seed=seed)
