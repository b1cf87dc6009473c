"""Event-time window aggregates on a transaction stream, with a watermark.

Tumbling windows run in update mode into the upsert change log, so every
window ends with its final value without keeping all windows in state
(complete mode would).  Sliding windows are made of tumbling panes as wide as
the slide: the stream's state, its shuffle and the log hold one pane per user
and hour, and a pane is combined into its windows when they are read.
Sessions are in ``sessions.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskwave.operators.velocity import MONEY

TOTAL = "decimal(38,2)"


def _aggs():
    return [F.count(F.lit(1)).alias("txn_count"),
            F.sum(F.col("amount").cast(MONEY)).cast(TOTAL).alias("amount_sum")]


def tumbling(stream: DataFrame, width: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    w = F.window("transaction_time", width)
    return (stream.withWatermark("transaction_time", delay)
                  .groupBy(w.alias("w"), "user_id").agg(*_aggs())
                  .select("user_id", F.col("w.start").alias("window_start"),
                          F.col("w.end").alias("window_end"), "txn_count", "amount_sum"))


def combine_panes(panes: DataFrame, panes_per_window: int = 24, pane_hours: int = 1) -> DataFrame:
    """Sliding windows from the panes of ``tumbling``: a pane counts in the
    windows that start with it or up to ``panes_per_window - 1`` panes before.
    Panes are dealt by user, one row per user and hour; the windows of a user
    are then formed without another exchange."""
    own = panes.repartition("user_id")
    slide = F.make_dt_interval(hours=F.lit(pane_hours))
    starts = F.transform(F.sequence(F.lit(0), F.lit(panes_per_window - 1)),
                         lambda k: F.col("window_start") - F.make_dt_interval(hours=k * pane_hours))
    return (own.withColumn("start", F.explode(starts)).groupBy("user_id", "start")
            .agg(F.sum("txn_count").alias("txn_count"), F.sum("amount_sum").cast(TOTAL).alias("amount_sum"))
            .select("user_id", F.col("start").alias("window_start"),
                    (F.col("start") + slide * panes_per_window).alias("window_end"), "txn_count", "amount_sum"))


def to_ntz(df: DataFrame, *cols: str) -> DataFrame:
    """Stream times are TIMESTAMP (UTC session); outputs compare as NTZ."""
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df
