"""Row-level feature expressions.  Everything is a Catalyst expression,
so it fuses into the scan's whole-stage-codegen span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results:
# categorical columns, the columns dropped from the feature matrix, and the
# thresholds of the bands.
CAT_COLS = ["country", "bin_country", "channel", "merchant_category"]
DROP_COLS = ["transaction_id", "user_id", "transaction_time", "is_fraud"]
ENGINEERED = ["txn_hour", "txn_day", "txn_month", "txn_dayofweek", "is_weekend",
              "is_night", "amount_vs_avg", "geo_mismatch"]
INPUT_FEATURES = ["amount", "total_transactions_user", "avg_amount_user",
                  "account_age_days", "shipping_distance_km", "country", "bin_country",
                  "channel", "merchant_category", "promo_used", "avs_match",
                  "cvv_result", "three_ds_flag"]
FEATURE_COLS = INPUT_FEATURES + ENGINEERED
NUM_COLS = [c for c in FEATURE_COLS if c not in CAT_COLS]
MISSING_CATEGORY = "Missing"
VELOCITY_HIGH, VELOCITY_MEDIUM = 5.0, 2.0        # dashboard risk band
MONITOR_YELLOW, MONITOR_RED = 5.0, 15.0          # monitoring panel thresholds
RISK_HIGH, RISK_MEDIUM = 0.7, 0.4                # probability bands


def _int(c: Column) -> Column:
    return c.cast("int")


def geo_mismatch(country: Column, bin_country: Column) -> Column:
    """1 when the countries differ.  A missing side counts as a mismatch,
    also when both are missing (pandas ``!=`` semantics), hence coalesce
    to true rather than null-safe equality."""
    return _int(F.coalesce(country != bin_country, F.lit(True)))


def engineer_features(df: DataFrame, ts: str = "transaction_time") -> DataFrame:
    t = F.col(ts)
    hour = F.hour(t)
    dow = F.weekday(t)                       # Monday = 0 ... Sunday = 6
    return df.select(
        "*",
        hour.alias("txn_hour"),
        F.dayofmonth(t).alias("txn_day"),
        F.month(t).alias("txn_month"),
        dow.alias("txn_dayofweek"),
        _int(dow >= 5).alias("is_weekend"),
        _int((hour < 6) | (hour >= 22)).alias("is_night"),
        F.try_divide(F.col("amount"), F.col("avg_amount_user") + 1).alias("amount_vs_avg"),
        geo_mismatch(F.col("country"), F.col("bin_country")).alias("geo_mismatch"),
    )


def fill_missing(df: DataFrame, num_cols=None, cat_cols=None) -> DataFrame:
    """Numeric null/NaN -> 0, categorical null -> "Missing"."""
    num_cols = [c for c in (num_cols or NUM_COLS) if c in df.columns]
    cat_cols = [c for c in (cat_cols or CAT_COLS) if c in df.columns]
    dtypes = dict(df.dtypes)
    out = []
    for c in df.columns:
        if c in cat_cols:
            out.append(F.coalesce(F.col(c), F.lit(MISSING_CATEGORY)).alias(c))
        elif c in num_cols:
            v = F.col(c)
            if dtypes[c] in ("double", "float"):
                v = F.nanvl(v, F.lit(0.0))
            out.append(F.coalesce(v, F.lit(0).cast(dtypes[c])).alias(c))
        else:
            out.append(F.col(c))
    return df.select(out)


def velocity_band(score: Column, high: float = VELOCITY_HIGH,
                  medium: float = VELOCITY_MEDIUM) -> Column:
    return (F.when(score > high, "HIGH").when(score > medium, "MEDIUM")
             .otherwise("LOW"))


def monitor_band(value: Column, yellow: float = MONITOR_YELLOW,
                 red: float = MONITOR_RED) -> Column:
    return (F.when(value >= red, "red").when(value >= yellow, "yellow")
             .otherwise("green"))


def risk_level(prob: Column, high: float = RISK_HIGH, medium: float = RISK_MEDIUM) -> Column:
    """Risk of a probability, on the unrounded value."""
    return F.when(prob > high, "HIGH").when(prob > medium, "MEDIUM").otherwise("LOW")


def decision_label(pred: Column) -> Column:
    return F.when(pred == 1, "BLOCKED").otherwise("CLEARED")
