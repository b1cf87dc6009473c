"""Dashboard and dataset aggregates.  All are grouped aggregates with
partial (map-side) combination; money is summed as DECIMAL(18,2) so the
result does not depend on the order of additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskwave.operators.scores import exact_ratio
from riskwave.plans.selection import order_statistics

MONEY = T.DecimalType(18, 2)
TOTAL = T.DecimalType(38, 2)
TOP_CATEGORIES = 5
FIRST_FRAUD_USERS = 100
SPLIT_QUANTILE = 0.8


def money_sum(c: str) -> Column:
    return F.sum(F.col(c).cast(MONEY)).cast(TOTAL)


def exact_mean(c: str, n: Column) -> Column:
    return F.sum(F.col(c).cast(MONEY)).cast("double") / n


def pct(part: Column, whole: Column) -> Column:
    return part.cast("double") * 100.0 / whole.cast("double")


def kpis(txn: DataFrame) -> DataFrame:
    return txn.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col("is_fraud") == 1).alias("fraud_count"),
        money_sum("amount").alias("total_volume"),
    ).select("*", pct(F.col("fraud_count"), F.col("total_transactions")).alias("fraud_rate_pct"))


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def monthly_volume(txn: DataFrame, split_month: str | None = None) -> DataFrame:
    """Legit/fraud counts per calendar month (the pivot, as conditional
    counts in one pass), with the train/test side of the month."""
    m = (txn.groupBy(year_month(F.col("transaction_time")).alias("month"))
            .agg(F.count_if(F.col("is_fraud") == 0).alias("legit"),
                 F.count_if(F.col("is_fraud") == 1).alias("fraud")))
    if split_month is not None:
        m = m.withColumn("side", F.when(F.col("month") >= F.lit(split_month), "test")
                                  .otherwise("train"))
    return m


def monthly_volume_long(monthly: DataFrame) -> DataFrame:
    return (monthly.select("month", F.col("legit").alias("Legit"), F.col("fraud").alias("Fraud"))
                   .unpivot("month", ["Legit", "Fraud"], "type", "count"))


def hourly_fraud(txn: DataFrame) -> DataFrame:
    return (txn.where(F.col("is_fraud") == 1)
               .groupBy(F.hour("transaction_time").alias("hour"))
               .agg(F.count(F.lit(1)).alias("count")))


def top_fraud_categories(txn: DataFrame, k: int = TOP_CATEGORIES) -> DataFrame:
    return (txn.where((F.col("is_fraud") == 1) & F.col("merchant_category").isNotNull())
               .groupBy(F.col("merchant_category").alias("category"))
               .agg(F.count(F.lit(1)).alias("count"))
               .orderBy(F.col("count").desc(), F.col("category"))
               .limit(k))


def user_profiles(txn: DataFrame) -> DataFrame:
    """Case-file header for every user at once."""
    n = F.count(F.lit(1))
    first = F.min_by(F.struct("account_age_days", "country"),
                     F.struct("transaction_time", "transaction_id"))
    return (txn.groupBy("user_id")
               .agg(n.alias("transactions"),
                    F.count_if(F.col("is_fraud") == 1).alias("fraud_events"),
                    money_sum("amount").alias("total_spend"),
                    exact_mean("amount", n).alias("avg_transaction"),
                    first.alias("_first"))
               .select("user_id", "transactions", "fraud_events", "total_spend",
                       "avg_transaction",
                       F.col("_first.account_age_days").alias("first_account_age_days"),
                       F.col("_first.country").alias("first_country"),
                       F.when(F.col("fraud_events") > 0, "HIGH RISK").otherwise("CLEAN")
                        .alias("risk_label")))


def fraud_users_first_seen(txn: DataFrame, n: int = FIRST_FRAUD_USERS) -> DataFrame:
    """Distinct fraud users in order of their first fraud, first ``n``."""
    first = F.min(F.struct("transaction_time", "transaction_id"))
    return (txn.where(F.col("is_fraud") == 1).groupBy("user_id").agg(first.alias("f"))
               .select("user_id", F.col("f.transaction_time").alias("first_fraud_time"),
                       F.col("f.transaction_id").alias("first_fraud_id"))
               .orderBy("first_fraud_time", "first_fraud_id").limit(n))


def dataset_summary(txn: DataFrame) -> DataFrame:
    return txn.agg(F.min("transaction_time").alias("min_time"),
                   F.max("transaction_time").alias("max_time"),
                   F.count(F.lit(1)).alias("rows"),
                   F.count_if(F.col("is_fraud") == 1).alias("_f")).select(
        "min_time", "max_time", "rows", pct(F.col("_f"), F.col("rows")).alias("fraud_rate_pct"))


def split_instant(txn: DataFrame, q: float = SPLIT_QUANTILE,
                  ts: str = "transaction_time", tid: str = "transaction_id") -> DataFrame:
    """Exact ``q`` quantile of the event time with linear interpolation,
    from the two neighbouring order statistics; counted, not sorted."""
    us = txn.select(F.lit(0).alias("_g"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")).where("_us is not null")
    n = us.count()
    if n == 0:
        return txn.sparkSession.createDataFrame([], "split_instant timestamp_ntz")
    pos = (n - 1) * q
    lo, hi = int(pos // 1), int(-(-pos // 1))
    ranks = txn.sparkSession.createDataFrame([(0, "lo", lo + 1), (0, "hi", hi + 1)], "_g int, target string, rank long")
    picked = order_statistics(us, "_us", ranks, ["_g"]).agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    frac = pos - lo
    value = F.col("_lo").cast("double") + (F.col("_hi") - F.col("_lo")).cast("double") * F.lit(frac)
    return picked.select(F.timestamp_micros(F.floor(value)).cast("timestamp_ntz").alias("split_instant"))


def split_value(txn: DataFrame, q: float = SPLIT_QUANTILE):
    """The split instant as one scalar (a single value through the driver)."""
    row = split_instant(txn, q).first()
    return None if row is None else row[0]


def split_summary(txn: DataFrame, split) -> DataFrame:
    side = F.when(F.col("transaction_time") < F.lit(split), "train").otherwise("test")
    return (txn.groupBy(side.alias("side"))
               .agg(F.count(F.lit(1)).alias("rows"),
                    F.count_if(F.col("is_fraud") == 1).alias("fraud_count"),
                    F.min("transaction_time").alias("min_time"),
                    F.max("transaction_time").alias("max_time"))
               .select("*", pct(F.col("fraud_count"), F.col("rows")).alias("fraud_rate_pct")))


def class_weight(txn: DataFrame, split) -> DataFrame:
    train = txn.where(F.col("transaction_time") < F.lit(split))
    return train.agg(F.count_if(F.col("is_fraud") == 0).alias("negatives"),
                     F.count_if(F.col("is_fraud") == 1).alias("positives")).select(
        "negatives", "positives",
        exact_ratio(F.col("negatives"), F.col("positives"), 2).alias("scale_pos_weight"))


def latency_summary(req: DataFrame, value: str = "latency_ms", group: str = "handler") -> DataFrame:
    """mean/min/max, median (mean of the two middle values) and index
    percentiles ``sorted[floor(n*q)]`` per group, by exact selection: counts
    per bin instead of a sort, so a hot group or value is spread over tasks."""
    v = req.select(group, value, "status")
    counts = v.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.sum(F.col(value).cast(MONEY)).alias("_sum"),
        F.count_if(F.col("status").rlike("^5..$")).alias("errors"))
    n = F.col("n")
    places = {"_m1": F.floor((n - 1) / 2), "_m2": F.floor(n / 2), "p95": F.floor(n * 95 / 100), "p99": F.floor(n * 99 / 100)}
    ranks = counts.select(group, F.inline(F.array(*[
        F.struct(F.lit(name).alias("target"), (place + 1).cast("long").alias("rank")) for name, place in places.items()])))
    picks = order_statistics(v, value, ranks, [group]).groupBy(group).agg(
        *[F.max(F.when(F.col("target") == name, F.col(value))).alias(name) for name in places])
    return counts.join(picks, group).select(
        group, "n", (F.col("_sum").cast("double") / F.col("n")).alias("mean"), "min",
        F.when(F.col("n") % 2 == 1, F.col("_m2"))
         .otherwise((F.col("_m1") + F.col("_m2")) / 2.0).alias("p50"),
        "p95", "p99", "max", "errors")


def latency_profile(summary: DataFrame, target_ms: float = 50.0, group: str = "handler") -> DataFrame:
    stats = ["min", "p50", "p95", "p99", "max"]
    return (summary.select(group, *stats).unpivot(group, stats, "stat", "value")
                   .withColumn("breach", (F.col("value") > target_ms).cast("int")))


def throughput(req: DataFrame) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return req.agg(F.count_if(F.col("status") == "200").alias("ok"),
                   ((F.max(us) - F.min(us)).cast("double") / 1000000.0).alias("elapsed_s")).select(
        "ok", "elapsed_s", F.try_divide(F.col("ok").cast("double"), F.col("elapsed_s"))
        .alias("rows_per_sec"))


def score_histogram(scores: DataFrame, bins: int = 20, threshold: float = 0.5,
                    prob: str = "probability") -> DataFrame:
    b = F.least(F.floor(F.col(prob) * float(bins)), F.lit(bins - 1)).cast("int")
    return (scores.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
                  .select("bin", (F.col("bin").cast("double") / float(bins)).alias("bin_start"),
                          "count")
                  .withColumn("at_or_above_threshold",
                              (F.col("bin_start") >= threshold).cast("int")))


def verdict_totals(scores: DataFrame) -> DataFrame:
    verdict = F.when(F.col("prediction") == 1, "fraud").otherwise("legit")
    return scores.groupBy(verdict.alias("verdict")).agg(
        F.count(F.lit(1)).alias("predictions"), money_sum("amount").alias("amount"))
