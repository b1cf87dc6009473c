"""Case investigation for all users at once (no per-user driver loop)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskwave.functions.features import decision_label, risk_level
from riskwave.operators.aggregates import MONEY, exact_mean

MAX_SIGNALS = 3
NEW_ACCOUNT_DAYS = 30
HIGH_AMOUNT_FACTOR = 2
# The signal names, in the order they are checked.
SIGNALS = ["New Account", "AVS Mismatch", "No 3DS", "High Amount"]
LIVE_FEED_ROWS = 8


def risk_signals(txn: DataFrame, max_signals: int = MAX_SIGNALS) -> DataFrame:
    """Signals read off each fraud user's first fraud row, at most
    ``max_signals`` in check order; one output row per signal."""
    n = F.count(F.lit(1))
    per_user = txn.groupBy("user_id").agg(
        exact_mean("amount", n).alias("user_mean"),
        F.min_by(F.struct("transaction_id", "account_age_days", "avs_match", "three_ds_flag",
                          "amount"),
                 F.when(F.col("is_fraud") == 1, F.struct("transaction_time", "transaction_id")))
         .alias("f"),
        F.count_if(F.col("is_fraud") == 1).alias("_fraud"))
    fraud = per_user.where(F.col("_fraud") > 0)
    checks = F.array(
        F.when(F.col("f.account_age_days") < NEW_ACCOUNT_DAYS, F.lit(SIGNALS[0])),
        F.when(F.col("f.avs_match") == 0, F.lit(SIGNALS[1])),
        F.when(F.col("f.three_ds_flag") == 0, F.lit(SIGNALS[2])),
        F.when(F.col("f.amount") > F.col("user_mean") * HIGH_AMOUNT_FACTOR, F.lit(SIGNALS[3])))
    kept = F.slice(F.array_compact(checks), 1, max_signals)
    return fraud.select("user_id", F.col("f.transaction_id").alias("transaction_id"),
                        F.posexplode(kept).alias("pos", "signal")).select(
        "user_id", "transaction_id", (F.col("pos") + 1).alias("signal_rank"), "signal")


def user_transactions(txn: DataFrame) -> DataFrame:
    """Timeline points of every user, labelled."""
    return txn.select("user_id", "transaction_id", "transaction_time", "amount",
                      F.when(F.col("is_fraud") == 1, "Fraud").otherwise("Legit").alias("label"))


def decision_accuracy(scores: DataFrame) -> DataFrame:
    right = (F.col("prediction") == 1) == (F.col("is_fraud") == 1)
    return (scores.groupBy("user_id")
                  .agg(F.count_if(right).alias("correct"), F.count(F.lit(1)).alias("total"))
                  .select("*", (F.col("correct").cast("double") / F.col("total").cast("double"))
                          .alias("accuracy")))


def live_feed(scores: DataFrame, txn: DataFrame | None = None, n: int = LIVE_FEED_ROWS) -> DataFrame:
    """Newest ``n`` scored rows, newest first (distributed top-k)."""
    top = scores.orderBy(F.col("transaction_time").desc(), F.col("transaction_id").desc()).limit(n)
    return top.select(
        "transaction_id", "user_id",
        F.date_format("transaction_time", "yyyy-MM-dd HH:mm").alias("time_text"),
        F.col("amount").cast(MONEY).alias("amount"),
        F.floor(F.col("probability") * 100.0).cast("int").alias("prob_pct"),
        risk_level(F.col("probability")).alias("risk"),
        decision_label(F.col("prediction")).alias("decision"))


def display_rows(txn: DataFrame) -> DataFrame:
    """Display projection: time text cut to seconds, renamed columns."""
    return txn.select(
        "transaction_id",
        F.date_format("transaction_time", "yyyy-MM-dd HH:mm:ss").alias("time_text"),
        F.col("merchant_category").alias("merchant"),
        F.col("amount").cast(MONEY).alias("amount_usd"),
        F.col("channel"),
        F.when(F.col("is_fraud") == 1, "Fraud").otherwise("Legit").alias("ground_truth"))


def serving_payload(txn: DataFrame) -> DataFrame:
    """The 15-field request record, cast to the request types."""
    return txn.select(
        F.col("user_id").cast("long"), F.col("amount").cast("double"),
        F.col("total_transactions_user").cast("long"), F.col("avg_amount_user").cast("double"),
        F.col("account_age_days").cast("long"), F.col("shipping_distance_km").cast("double"),
        F.col("country").cast("string"), F.col("bin_country").cast("string"),
        F.col("channel").cast("string"), F.col("merchant_category").cast("string"),
        F.col("promo_used").cast("int"), F.col("avs_match").cast("int"),
        F.col("cvv_result").cast("int"), F.col("three_ds_flag").cast("int"),
        F.date_format("transaction_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("transaction_time"))
