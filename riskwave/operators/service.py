"""Service-metric queries over a request table (ts, handler, status,
latency_ms, lookup_ms, verdict, amount): rates, cumulative bucket
histograms, bucket quantiles, ratios, counter rates with resets, last
values and in-flight counts.  Window width is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskwave.plans.prefix import keyed_prefix

# Histogram bucket upper bounds (ms) of the two latency metrics.
PREDICTION_BOUNDS = [1, 2, 5, 10, 20, 50, 100, 200, 500]
LOOKUP_BOUNDS = [0.5, 1, 2, 5, 10, 25, 50]
QUANTILES = [0.5, 0.95, 0.99]
ERROR_STATUS = "^5..$"
INF = float("inf")


def _wstart(ts: str, width: str) -> Column:
    return F.window(F.col(ts), width).start.cast("timestamp_ntz")


def _seconds(width: str) -> float:
    n, unit = width.split()
    return float(n) * {"second": 1, "seconds": 1, "minute": 60, "minutes": 60,
                       "hour": 3600, "hours": 3600, "day": 86400, "days": 86400}[unit]


def request_rate(req: DataFrame, width: str = "1 hour") -> DataFrame:
    """Requests per second per window, per handler and in total (the
    total re-aggregates the small per-handler result; one scan)."""
    per = (req.groupBy(_wstart("ts", width).alias("window_start"), "handler")
              .agg(F.count(F.lit(1)).alias("requests")))
    total = (per.groupBy("window_start").agg(F.sum("requests").alias("requests"))
                .select("window_start", F.lit("ALL").alias("handler"), "requests"))
    sec = _seconds(width)
    return (per.unionByName(total)
               .withColumn("rate_per_sec", F.col("requests").cast("double") / sec))


def _bucket_counts(df: DataFrame, value: str, bounds, metric: str) -> DataFrame:
    aggs = [F.count_if(F.col(value) <= float(b)).alias(f"b{i}") for i, b in enumerate(bounds)]
    aggs.append(F.count(F.lit(1)).alias(f"b{len(bounds)}"))
    wide = df.agg(*aggs)
    les = [float(b) for b in bounds] + [INF]
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.lit(i).alias("idx"),
                 F.lit(le).alias("le"), F.col(f"b{i}").alias("cumulative_count"))
        for i, le in enumerate(les)])).alias("b")).select("b.*")


def latency_buckets(req: DataFrame) -> DataFrame:
    """Cumulative ``le`` counts for prediction latency (/predict requests)
    and lookup latency, +Inf included.  One pass per metric with
    conditional counts, no join with the bounds."""
    pred = _bucket_counts(req.where(F.col("handler") == "/predict"), "latency_ms",
                          PREDICTION_BOUNDS, "prediction")
    look = _bucket_counts(req, "lookup_ms", LOOKUP_BOUNDS, "lookup")
    return pred.unionByName(look)


def bucket_quantiles(buckets: DataFrame, quantiles=QUANTILES) -> DataFrame:
    """Quantiles from cumulative buckets, linear inside the bucket; a
    rank in the +Inf bucket returns the last finite bound.  Runs on the
    aggregated buckets (a handful of rows per metric)."""
    w = Window.partitionBy("metric").orderBy("idx")
    b = buckets.select("*", F.lag("le").over(w).alias("lo"),
                       F.lag("cumulative_count").over(w).alias("cprev"),
                       F.max("cumulative_count").over(Window.partitionBy("metric")).alias("total"),
                       F.max(F.when(F.col("le") != INF, F.col("le")))
                        .over(Window.partitionBy("metric")).alias("last_finite"))
    qs = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile")
    b = b.select("*", qs).withColumn("rank", F.col("quantile") * F.col("total").cast("double"))
    hit = b.where(F.col("cumulative_count").cast("double") >= F.col("rank"))
    first = hit.groupBy("metric", "quantile").agg(F.min("idx").alias("idx"))
    h = hit.join(first, ["metric", "quantile", "idx"])
    lo = F.coalesce(F.col("lo"), F.lit(0.0))
    cprev = F.coalesce(F.col("cprev"), F.lit(0)).cast("double")
    c = F.col("cumulative_count").cast("double")
    value = (F.when(F.col("le") == INF, F.col("last_finite"))
              .when(c == cprev, F.col("le"))
              .otherwise(lo + (F.col("le") - lo) * ((F.col("rank") - cprev) / (c - cprev))))
    return h.select("metric", "quantile", value.alias("value"))


def fraud_share(req: DataFrame, width: str = "1 hour") -> DataFrame:
    return (req.groupBy(_wstart("ts", width).alias("window_start"))
               .agg(F.count_if(F.col("verdict") == "fraud").alias("fraud"),
                    F.count(F.lit(1)).alias("total"))
               .select("*", (F.col("fraud").cast("double") / F.col("total").cast("double"))
                       .alias("share")))


def error_rate(req: DataFrame, width: str = "1 hour") -> DataFrame:
    sec = _seconds(width)
    return (req.groupBy(_wstart("ts", width).alias("window_start"))
               .agg(F.count_if(F.col("status").rlike(ERROR_STATUS)).alias("errors"))
               .withColumn("errors_per_sec", F.col("errors").cast("double") / sec))


def counter_samples(req: DataFrame) -> DataFrame:
    """A request counter per handler sampled at each request; the
    counting process restarts every UTC day (counter reset)."""
    day = F.to_date(F.col("ts")).alias("day")
    base = req.select("handler", "ts", "request_id", day)
    c = keyed_prefix(base, ["handler", "day"], ["ts", "request_id"], rn_col="counter")
    return c.select("handler", "ts", "request_id", "counter")


def counter_rate(samples: DataFrame, width: str = "1 hour") -> DataFrame:
    """Reset-aware increase of a sampled counter per window / seconds.
    The previous sample per series is a distributed lag."""
    s = keyed_prefix(samples, ["handler"], ["ts", "request_id"], lags=["counter"], rn_col="_rn")
    prev = F.col("prev_counter")
    inc = (F.when(prev.isNull(), F.col("counter"))
            .when(F.col("counter") >= prev, F.col("counter") - prev)
            .otherwise(F.col("counter")))
    sec = _seconds(width)
    return (s.groupBy(_wstart("ts", width).alias("window_start"), "handler")
             .agg(F.sum(inc).alias("increase"))
             .withColumn("rate_per_sec", F.col("increase").cast("double") / sec))


def last_value(req: DataFrame, value: str = "latency_ms", series: str = "handler") -> DataFrame:
    """Last non-null value of each series (partial ``max_by``)."""
    return (req.where(F.col(value).isNotNull()).groupBy(series)
               .agg(F.max_by(F.struct(F.col("ts").alias("last_ts"), F.col(value).alias("last_value")),
                             F.struct("ts", "request_id")).alias("l"))
               .select(series, "l.last_ts", "l.last_value"))


def inflight(req: DataFrame) -> DataFrame:
    """In-flight requests after each start/end event: +1 at the start,
    -1 at start + latency; ends sort before starts at the same instant.
    Global running sum by the range-partitioned prefix helper."""
    start_us = F.unix_micros(F.col("ts").cast("timestamp"))
    dur_us = (F.col("latency_ms").cast("decimal(18,2)") * 1000).cast("long")
    starts = req.select("request_id", start_us.alias("at_us"), F.lit(1).cast("long").alias("delta"))
    ends = req.select("request_id", (start_us + dur_us).alias("at_us"),
                      F.lit(-1).cast("long").alias("delta"))
    ev = starts.unionByName(ends)
    r = keyed_prefix(ev, [], ["at_us", "delta", "request_id"], ["delta"], rn_col="_rn")
    return r.select(F.timestamp_micros("at_us").cast("timestamp_ntz").alias("at"), "request_id",
                    "delta", F.col("running_delta").alias("inflight"))
