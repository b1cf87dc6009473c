"""Exact keyed sliding-window velocity features (batch form of the keyed
state function).

Per event, over the events of the same user up to and including it in
``(time, id)`` order: count and amount sum over the closed 1 h and 24 h
frames, the 24 h mean and a weighted velocity score.  With a ``cap`` only
the ``cap`` newest events of the user count.

Plan shape (scale): every event and one probe per frame start go through
one distributed running sum (``plans.prefix``) per user in time order, so
the value of a frame is the running value at the event minus the running
value just before the frame.  The work is linear in the events, whatever
the length of a frame, and a user's events spread over range partitions
at any instant, so neither a hot user nor a hot user-day is one task.
The three rows of an event meet again by ``(user, time, id)``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskwave.plans.prefix import keyed_prefix

MONEY = T.DecimalType(18, 2)
SCORE = T.DecimalType(18, 4)
HOUR_US = 3_600_000_000
# Fixed values of the score: weights of the 1 h count, the 1 h amount in
# hundreds, and the 24 h count; the buffer cap; the frame lengths.
W_COUNT_1H, W_AMOUNT_1H_PER_100, W_COUNT_24H = Decimal("0.4"), Decimal("0.3"), Decimal("0.3")
DEFAULT_CAP = 500
SHORT_FRAME_H, LONG_FRAME_H = 1, 24


def velocity_score(n1: Column, s1: Column, n24: Column) -> Column:
    """Exact decimal arithmetic, rounded half-up to 4 digits."""
    amt_w = W_AMOUNT_1H_PER_100 / 100           # 0.003 per currency unit
    raw = (n1.cast("decimal(18,0)") * F.lit(W_COUNT_1H)
           + s1 * F.lit(amt_w)
           + n24.cast("decimal(18,0)") * F.lit(W_COUNT_24H))
    return F.round(raw, 4).cast(SCORE)


def velocity_features(df: DataFrame, key: str = "user_id", ts: str = "transaction_time",
                      tid: str = "transaction_id", amount: str = "amount",
                      cap: int | None = None, short_h: int = SHORT_FRAME_H,
                      long_h: int = LONG_FRAME_H) -> DataFrame:
    """One row per input event: user_id, transaction_id, event_time,
    txn_count_1h, txn_count_24h, amount_sum_1h, avg_amount_24h,
    velocity_score.  An event that is delivered twice is two events, one
    after the other in the frames."""
    base = df.select(F.monotonically_increasing_id().alias("_u"), F.col(key).alias("_k"), F.col(tid).alias("_id"), F.col(ts).alias("_ts"),
                     (F.col(amount).cast(MONEY) * 100).cast("long").alias("_cents"))
    base = base.withColumn("_us", F.unix_micros(F.col("_ts").cast("timestamp")))
    # side 0 / 1: probes at the start of the short / long frame; side 2: the
    # event.  At one instant probes come first: a frame includes its start.
    rows = base.select("_k", "_id", "_ts", "_u", F.inline(F.array(*[
        F.struct(F.lit(side).alias("_side"), at.alias("_at"), n.cast("long").alias("_one"), c.alias("_c"))
        for side, at, n, c in (
            (0, F.col("_us") - short_h * HOUR_US, F.lit(0), F.lit(0).cast("long")),
            (1, F.col("_us") - long_h * HOUR_US, F.lit(0), F.lit(0).cast("long")),
            (2, F.col("_us"), F.lit(1), F.col("_cents")))])))
    rows = rows.withColumn("_probe", (F.col("_side") == 2).cast("int"))
    run = keyed_prefix(rows, ["_k"], ["_at", "_probe", "_id", "_u", "_side"], ["_one", "_c"], rn_col="_rn")
    at = lambda side, c: F.max(F.when(F.col("_side") == side, F.col("running_" + c)))
    w = run.groupBy("_k", "_ts", "_id", "_u").agg(
        at(2, "_one").alias("_n"), at(2, "_c").alias("_s"),
        at(0, "_one").alias("_n0"), at(0, "_c").alias("_s0"),
        at(1, "_one").alias("_n1"), at(1, "_c").alias("_s1"))
    n_short, n_long = F.col("_n") - F.col("_n0"), F.col("_n") - F.col("_n1")
    s_short, s_long = F.col("_s") - F.col("_s0"), F.col("_s") - F.col("_s1")
    if cap:
        # Running sum ``cap`` events earlier, by position within the user.
        back = run.where(F.col("_side") == 2).select(
            F.col("_k").alias("_bk"), F.col("running__one").alias("_bn"), F.col("running__c").alias("_bs"))
        w = w.join(back, F.col("_k").eqNullSafe(F.col("_bk")) & (F.col("_n") - cap == F.col("_bn")), "left")
        newest = F.col("_s") - F.coalesce(F.col("_bs"), F.lit(0))
        s_short = F.when(n_short <= cap, s_short).otherwise(newest)
        s_long = F.when(n_long <= cap, s_long).otherwise(newest)
        n_short, n_long = F.least(n_short, F.lit(cap)), F.least(n_long, F.lit(cap))
    money = lambda cents: (cents.cast("decimal(20,0)") / 100).cast(MONEY)
    w = w.select(F.col("_k").alias(key), F.col("_id").alias(tid), F.col("_ts").alias("event_time"),
                 n_short.cast("long").alias("txn_count_1h"), n_long.cast("long").alias("txn_count_24h"),
                 money(s_short).alias("amount_sum_1h"), money(s_long).alias("_s24"))
    return w.select(
        key, tid, "event_time", "txn_count_1h", "txn_count_24h", "amount_sum_1h",
        F.round(F.col("_s24") / F.col("txn_count_24h"), 2).cast(MONEY).alias("avg_amount_24h"),
        velocity_score(F.col("txn_count_1h"), F.col("amount_sum_1h"),
                       F.col("txn_count_24h")).alias("velocity_score"),
    )


def velocity_features_capped(df: DataFrame, cap: int = DEFAULT_CAP, **columns) -> DataFrame:
    """Velocity features over the ``cap`` newest events of a user."""
    return velocity_features(df, cap=cap, **columns)


def hour_bucket_running_count(df: DataFrame, key: str = "user_id",
                              ts: str = "transaction_time",
                              tid: str = "transaction_id") -> DataFrame:
    """Tumbling-hour count so far: events of the user in the current clock
    hour up to and including this one, by the distributed running count
    (a hot user-hour spreads over range partitions)."""
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")
    rows = df.select(key, tid, F.col(ts).alias("event_time"), hour.alias("hour_start"))
    return (keyed_prefix(rows, [key, "hour_start"], ["event_time", tid], rn_col="txn_count_hour")
            .select(key, tid, "event_time", "hour_start", "txn_count_hour"))
