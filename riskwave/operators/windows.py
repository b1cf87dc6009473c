"""Running and sequence operators: per-user running counters, global
running totals, idle-expiry runs (sessions), month positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskwave.operators.aggregates import MONEY, TOTAL, pct, year_month
from riskwave.operators.state import fraud_user_transactions
from riskwave.plans.prefix import keyed_prefix

VELOCITY_STEP = 1.5          # fixed value: running count x 1.5
IDLE_GAP_H = 1               # fixed value: counter expires after an idle hour
PROGRESS_EVERY = 50          # fixed value: progress published every 50 events
SEQ = ["transaction_time", "transaction_id"]


def running_velocity(txn: DataFrame) -> DataFrame:
    """Per fraud user: running transaction count x 1.5 in time order."""
    f = fraud_user_transactions(txn).select("user_id", *SEQ)
    r = keyed_prefix(f, ["user_id"], SEQ)
    return r.select("user_id", *SEQ, F.col("rn").alias("running_count"),
                    (F.col("rn").cast("double") * VELOCITY_STEP).alias("velocity"))


def running_totals(scores: DataFrame) -> DataFrame:
    """Global running processed / caught / blocked value / fraud rate, in
    event order, via range-partitioned prefix sums."""
    s = scores.select(*SEQ, "prediction",
                      F.col("prediction").cast("long").alias("caught"),
                      F.when(F.col("prediction") == 1, F.col("amount").cast(MONEY) * 100)
                       .otherwise(0).cast("long").alias("blocked_cents"))
    r = keyed_prefix(s, [], SEQ, ["caught", "blocked_cents"])
    return r.select(*SEQ, F.col("rn").alias("processed"), F.col("running_caught").alias("fraud_caught"),
                    (F.col("running_blocked_cents").cast("decimal(38,0)") / 100).cast(TOTAL)
                    .alias("value_blocked"),
                    pct(F.col("running_caught"), F.col("rn")).alias("fraud_rate_pct"))


def progress_checkpoints(txn: DataFrame, every: int = PROGRESS_EVERY) -> DataFrame:
    """Processed-count publications: the count at every multiple of
    ``every`` (none at the end, as the job publishes only there)."""
    r = keyed_prefix(txn.select(*SEQ), [], SEQ)
    return (r.where(F.col("rn") % every == 0)
             .select(F.col("rn").alias("processed"), *SEQ))


def idle_flags(txn: DataFrame, gap_h: int = IDLE_GAP_H) -> DataFrame:
    """``new_run`` = 1 when the user's previous event is more than
    ``gap_h`` older or absent; the previous event is a distributed lag, so
    a hot user spreads over range partitions, whose numbers (``_pid``) let the
    next pass go on without a shuffle."""
    gap_us = gap_h * 3_600_000_000
    us = F.unix_micros(F.col("transaction_time").cast("timestamp"))
    base = txn.select("user_id", *SEQ, "amount", us.alias("_us"))
    r = keyed_prefix(base, ["user_id"], SEQ, lags=["_us"], rn_col="_rn", keep_pid=True)
    new = F.col("prev__us").isNull() | (F.col("_us") - F.col("prev__us") > gap_us)
    return r.select("user_id", *SEQ, "amount", new.cast("long").alias("new_run"), "_pid")


def run_ids(txn: DataFrame, gap_h: int = IDLE_GAP_H) -> DataFrame:
    """Run number per user: running sum of the new-run flags (distributed
    prefix, so a hot user is not one task)."""
    runs = keyed_prefix(idle_flags(txn, gap_h), ["user_id"], SEQ, ["new_run"], rn_col="_rn")
    return runs.select("user_id", *SEQ, "amount", F.col("running_new_run").alias("run_id"))


def idle_runs(txn: DataFrame, gap_h: int = IDLE_GAP_H) -> DataFrame:
    """Per user: ``run_id`` numbers the runs (running sum of the flags) and
    ``counter`` counts events within the run (rows since the latest run
    start) -- the counter that expires after an idle hour.  One
    distributed prefix pass gives both."""
    r = keyed_prefix(idle_flags(txn, gap_h), ["user_id"], SEQ, ["new_run"],
                     resets=["new_run"], rn_col="_rn")
    return r.select("user_id", *SEQ, "amount", F.col("running_new_run").alias("run_id"),
                    F.col("seg_new_run").alias("counter"))


def idle_reset_counter(txn: DataFrame) -> DataFrame:
    return idle_runs(txn).select("user_id", *SEQ, "run_id", "counter")


def user_sessions(txn: DataFrame, gap_h: int = IDLE_GAP_H) -> DataFrame:
    """Sessions with a ``gap_h`` gap; end = last event + gap, as
    ``session_window`` reports it."""
    r = run_ids(txn, gap_h)
    return (r.groupBy("user_id", "run_id")
             .agg(F.min("transaction_time").alias("session_start"),
                  F.max("transaction_time").alias("_last"),
                  F.count(F.lit(1)).alias("events"),
                  F.sum(F.col("amount").cast(MONEY)).cast(TOTAL).alias("amount_sum"))
             .select("user_id", "session_start",
                     (F.col("_last") + F.expr(f"INTERVAL {gap_h} HOURS")).alias("session_end"),
                     "events", "amount_sum"))


def split_month_position(txn: DataFrame, split) -> DataFrame:
    """Position of the split month in the ordered month list.  The month
    list is small (one row per calendar month), so the global window
    runs on the aggregated months only."""
    months = txn.select(year_month(F.col("transaction_time")).alias("month")).distinct()
    pos = months.select("month", (F.row_number().over(Window.orderBy("month")) - 1).alias("position"))
    split_month = split.strftime("%Y-%m")
    return pos.where(F.col("month") == split_month)
