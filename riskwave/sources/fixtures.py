"""Derived fixture tables (see FIXTURES.md): the transaction fact table,
its edge-case variants, the request table behind the service metrics and
a deterministic score table.  All are lazy plans over the raw parquet
tables, so every downstream query scales with the input."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskwave.plans.broadcast import bounded_broadcast
from riskwave.sources.tables import read_table

TXN_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("transaction_time", T.TimestampNTZType()),
    T.StructField("total_transactions_user", T.LongType()),
    T.StructField("avg_amount_user", T.DoubleType()),
    T.StructField("account_age_days", T.LongType()),
    T.StructField("shipping_distance_km", T.DoubleType()),
    T.StructField("country", T.StringType()),
    T.StructField("bin_country", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("promo_used", T.IntegerType()),
    T.StructField("avs_match", T.IntegerType()),
    T.StructField("cvv_result", T.IntegerType()),
    T.StructField("three_ds_flag", T.IntegerType()),
    T.StructField("is_fraud", T.IntegerType()),
])
TXN_COLUMNS = [f.name for f in TXN_SCHEMA.fields]

# CSV files carry the time as text.
TXN_SCHEMA_CSV = T.StructType([
    T.StructField(f.name, T.StringType() if f.name == "transaction_time" else f.dataType)
    for f in TXN_SCHEMA.fields
])

MONEY = T.DecimalType(18, 2)
NATION_ROWS_BOUND = 1_000   # nation is a dimension; proven small before broadcast


def _flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("int")


def user_totals(df: DataFrame, key: str = "user_id", amount: str = "amount") -> DataFrame:
    """Per-user count and mean amount.  A grouped aggregate (partial +
    final, one row per user) joined back, instead of a window over the
    user partition: a user holding a third of the rows is combined
    map-side here, whereas a window would put all its rows in one task."""
    return (df.groupBy(key)
              .agg(F.count(F.lit(1)).alias("total_transactions_user"),
                   F.sum(F.col(amount).cast(MONEY)).alias("_sum_amt"))
              .select(key, "total_transactions_user",
                      (F.col("_sum_amt").cast("double") /
                       F.col("total_transactions_user")).alias("avg_amount_user")))


def _base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value")


def _core() -> list[Column]:
    """Columns that come from the event row alone."""
    eid = F.col("event_id")
    return [
        eid.alias("transaction_id"),
        F.col("user_id"),
        F.col("value").alias("amount"),
        F.col("ts").alias("transaction_time"),
        (F.lit(1) + (F.col("user_id") * 37) % 720).cast("long").alias("account_age_days"),
        (((eid * 7919) % 200000).cast("double") / 100.0).alias("shipping_distance_km"),
        F.when(eid % 2 == 0, "web").otherwise("app").alias("channel"),
        F.col("event_type").alias("merchant_category"),
        _flag(eid % 5 == 0).alias("promo_used"),
        _flag(eid % 7 != 0).alias("avs_match"),
        _flag(eid % 13 != 0).alias("cvv_result"),
        _flag(eid % 3 != 0).alias("three_ds_flag"),
        _flag(((F.col("value") > 100) & ((eid % 7 == 0) | (eid % 13 == 0)))
              | (eid % 97 == 0)).alias("is_fraud"),
    ]


def transactions_core_of(ev: DataFrame) -> DataFrame:
    return ev.select(*_core())


def join_static(spark: SparkSession, sf_dir: str, ev: DataFrame) -> DataFrame:
    """The fact table over ``ev``, which may be a stream: nation names and
    the users' totals are static sides."""
    totals = user_totals(_base_events(spark, sf_dir).select("user_id", F.col("value").alias("amount")))
    return _build(spark, sf_dir, ev, totals)


def _build(spark: SparkSession, sf_dir: str, ev: DataFrame, totals: DataFrame | None) -> DataFrame:
    """``ev`` has event_id, ts, user_id, event_type, value; ``totals`` has a
    row per user, or is None for a table without the user columns."""
    nation = bounded_broadcast(
        read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
        NATION_ROWS_BOUND)
    n1 = nation.select(F.col("n_nationkey").alias("_k1"), F.col("n_name").alias("country"))
    n2 = nation.select(F.col("n_nationkey").alias("_k2"), F.col("n_name").alias("bin_country"))
    eid = F.col("event_id")
    ev = (ev.withColumn("_k1", (F.col("user_id") % 25).cast("int"))
            .withColumn("_k2", F.when(eid % 11 == 0, (F.col("user_id") + 1) % 25)
                                .otherwise(F.col("user_id") % 25).cast("int")))
    joined = ev.join(n1, "_k1").join(n2, "_k2")
    cols = _core() + [F.col("country"), F.col("bin_country")]
    if totals is not None:
        joined = joined.join(totals, "user_id")
        cols += [F.col("total_transactions_user"), F.col("avg_amount_user")]
    out = joined.select(*cols)
    return out.select(*[c for c in TXN_COLUMNS if c in out.columns])


def transactions_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table without its joined columns (countries, user totals):
    a pruned scan, for every query that needs neither."""
    return transactions_core_of(_base_events(spark, sf_dir))


def transactions_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table with countries but without user totals."""
    return _build(spark, sf_dir, _base_events(spark, sf_dir), None)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main fact table (17 columns, FIXTURES.md section 1)."""
    return _with_totals(spark, sf_dir, _base_events(spark, sf_dir))


def _with_totals(spark: SparkSession, sf_dir: str, ev: DataFrame) -> DataFrame:
    return _build(spark, sf_dir, ev, user_totals(ev.select("user_id", F.col("value").alias("amount"))))


def transactions_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant with 7 users and hour-truncated times: many equal instants."""
    ev = (_base_events(spark, sf_dir)
          .withColumn("user_id", F.col("user_id") % 7)
          .withColumn("ts", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")))
    return _with_totals(spark, sf_dir, ev)


def transactions_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant on orders: whole days, so exact 24 h frame boundaries."""
    o = read_table(spark, sf_dir, "orders")
    ev = o.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("ts"),
                  F.col("o_custkey").alias("user_id"),
                  F.col("o_orderpriority").alias("event_type"),
                  F.col("o_totalprice").alias("value"))
    return _with_totals(spark, sf_dir, ev)


LATE_DELAY = dt.timedelta(hours=2)
ARRIVAL_SLICE_S = 3 * 86_400


def arrival_slice(time, tid):
    """Number of the three-day slice in which a row arrives: up to six hours
    after its time."""
    arrival = F.unix_seconds(time.cast("timestamp")) + (tid * 7919) % 21_600
    return F.floor(arrival / ARRIVAL_SLICE_S)


def transactions_delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core transactions as they arrive, collected in slices (``arrival_slice``)."""
    t = transactions_core(spark, sf_dir)
    return t.withColumn("arrival_slice", arrival_slice(F.col("transaction_time"), F.col("transaction_id")))


def transactions_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant with missing category / country / bin country."""
    t = transactions(spark, sf_dir)
    tid = F.col("transaction_id")
    return (t.withColumn("merchant_category",
                         F.when(tid % 17 == 0, F.lit(None).cast("string"))
                          .otherwise(F.col("merchant_category")))
             .withColumn("country", F.when(tid % 19 == 0, F.lit(None).cast("string"))
                                     .otherwise(F.col("country")))
             .withColumn("bin_country", F.when(tid % 23 == 0, F.lit(None).cast("string"))
                                         .otherwise(F.col("bin_country"))))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic score table (no model): a permille hash of the id,
    raised by 450 permille (capped at 999) on fraud rows."""
    t = transactions_core(spark, sf_dir).select(
        "transaction_id", "user_id", "transaction_time", "amount", "is_fraud")
    base = (F.col("transaction_id") * 31) % 1000
    permille = F.when(F.col("is_fraud") == 1, F.least(base + 450, F.lit(999))).otherwise(base)
    return (t.withColumn("probability", permille.cast("double") / 1000.0)
             .withColumn("prediction", _flag(F.col("probability") > 0.5)))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request table behind the service metrics (FIXTURES.md section 4)."""
    ev = _base_events(spark, sf_dir)
    eid = F.col("event_id")
    fraud = (((F.col("value") > 100) & ((eid % 7 == 0) | (eid % 13 == 0))) | (eid % 97 == 0))
    return ev.select(
        eid.alias("request_id"),
        F.col("ts"),
        F.when(eid % 10 == 0, "/health").otherwise("/predict").alias("handler"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
        F.col("value").alias("latency_ms"),
        (F.col("value") / 10.0).alias("lookup_ms"),
        F.when(fraud, "fraud").otherwise("legit").alias("verdict"),
        F.col("value").alias("amount"),
    )
