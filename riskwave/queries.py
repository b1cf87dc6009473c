"""Query registry: key -> callable(spark, sf_dir) -> DataFrame.

Every query reads the given tables (through the fixture views), so its
work grows with them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskwave import sources as src
from riskwave.functions import features as fx
from riskwave.operators import velocity as vel
from riskwave.plans.lineage import shared_path
from riskwave.sources.tables import read_csv_transactions, write_csv_transactions

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


@query("scan_transactions")
def q_scan(spark, d):
    return src.transactions(spark, d)


@query("scan_transactions_csv")
def q_scan_csv(spark, d):
    """The transactions as a CSV file, read with the declared schema."""
    path = shared_path(spark, f"csv/{uuid.uuid4().hex}")
    write_csv_transactions(src.transactions(spark, d), path)
    return read_csv_transactions(spark, path)


@query("engineer_features")
def q_engineer(spark, d):
    return fx.engineer_features(src.transactions(spark, d))


@query("velocity_features")
def q_velocity(spark, d):
    return vel.velocity_features(src.transactions_core(spark, d))


@query("velocity_features_capped")
def q_velocity_capped(spark, d):
    return vel.velocity_features_capped(src.transactions_core(spark, d))


@query("velocity_features_ties")
def q_velocity_ties(spark, d):
    return vel.velocity_features(src.transactions_ties(spark, d))


@query("velocity_features_orders")
def q_velocity_orders(spark, d):
    return vel.velocity_features(src.transactions_orders(spark, d))


@query("hour_bucket_running_count")
def q_hour_bucket(spark, d):
    return vel.hour_bucket_running_count(src.transactions_core(spark, d))

# ---------------------------------------------------------------- state / joins
from riskwave.functions import encoding as enc               # noqa: E402
from riskwave.operators import aggregates as agg             # noqa: E402
from riskwave.operators import cases                         # noqa: E402
from riskwave.operators import scores as sc                  # noqa: E402
from riskwave.operators import service as svc                # noqa: E402
from riskwave.operators import state as st                   # noqa: E402
from riskwave.operators import topk                          # noqa: E402
from riskwave.operators import windows as win                # noqa: E402
from riskwave.plans.lineage import cut_lineage               # noqa: E402
from pyspark.sql import functions as F                       # noqa: E402


def _velocity(spark, d, txn=None):
    return vel.velocity_features(txn if txn is not None else src.transactions_core(spark, d))


@query("latest_user_state")
def q_latest_state(spark, d):
    t = src.transactions_core(spark, d)
    return st.latest_user_state(_velocity(spark, d, t), now=st.newest_time(t))


@query("state_lookup")
def q_state_lookup(spark, d):
    t = src.transactions(spark, d)
    return st.state_lookup(t, st.latest_user_state(_velocity(spark, d, t), now=st.newest_time(t)))


@query("state_table_lookup")
def q_state_table_lookup(spark, d):
    """The same lookup against a kept table, to which the states came in
    arrival slices; the lookup itself computes no velocity."""
    t = src.transactions_core(spark, d)
    arrival = src.arrival_slice(F.col("event_time"), F.col("transaction_id"))
    kept = sjobs.keep_state(_velocity(spark, d, t).withColumn("arrival_slice", arrival), "arrival_slice")
    return st.state_lookup(src.transactions(spark, d), kept.read())


@query("asof_state_lookup")
def q_asof(spark, d):
    t = src.transactions_core(spark, d)
    return st.asof_state_lookup(t, _velocity(spark, d, t))


@query("asof_state_lookup_ties")
def q_asof_ties(spark, d):
    t = src.transactions_ties(spark, d)
    return st.asof_state_lookup(t, _velocity(spark, d, t))


@query("fraud_user_transactions")
def q_fraud_users_tx(spark, d):
    return st.fraud_user_transactions(src.transactions(spark, d))


@query("clean_users")
def q_clean_users(spark, d):
    return st.clean_users(src.transactions_core(spark, d))


@query("stream_log")
def q_stream_log(spark, d):
    return st.stream_log(_velocity(spark, d))


@query("stream_log_latest")
def q_stream_log_latest(spark, d):
    return st.stream_log_latest(st.stream_log(_velocity(spark, d)), 20)


@query("progress_checkpoints")
def q_progress(spark, d):
    return win.progress_checkpoints(src.transactions_core(spark, d))


# ---------------------------------------------------------------- projections
@query("fill_missing")
def q_fill(spark, d):
    t = fx.engineer_features(src.transactions_nulls(spark, d))
    return fx.fill_missing(t).select("transaction_id", *fx.FEATURE_COLS)


def _ordinal(spark, d, fit_on):
    from riskwave.ml.model import fit_encoder
    t = src.transactions_nulls(spark, d)
    encoder = fit_encoder(t, agg.split_value(src.transactions_core(spark, d)), fit_on)
    return enc.ordinal_encode(fx.fill_missing(t), encoder.vocab).select("transaction_id", *fx.CAT_COLS)


@query("ordinal_encode")
def q_ordinal(spark, d):
    return _ordinal(spark, d, "train")


@query("ordinal_encode_all")
def q_ordinal_all(spark, d):
    """The vocabulary of all rows: no value is unknown."""
    return _ordinal(spark, d, "all")


@query("serving_features")
def q_serving(spark, d):
    return _serving_features(spark, d, src.transactions(spark, d))


@query("serving_features_ties")
def q_serving_ties(spark, d):
    return _serving_features(spark, d, src.transactions_ties(spark, d))


def _serving_features(spark, d, t):
    j = st.asof_state_lookup(t, _velocity(spark, d, t), carry=["total_transactions_user"])
    return j.select("transaction_id", "user_id",
                    F.col("total_transactions_user").alias("given_total_transactions"),
                    F.when(F.col("velocity_score") > 0, F.col("txn_count_24h"))
                     .otherwise(F.col("total_transactions_user")).alias("total_transactions_user"),
                    "velocity_score", "txn_count_24h")


@query("velocity_bands")
def q_bands(spark, d):
    v = _velocity(spark, d)
    return v.select("user_id", "transaction_id", "velocity_score",
                    fx.velocity_band(F.col("velocity_score")).alias("risk_band"),
                    fx.monitor_band(F.col("velocity_score")).alias("monitor_band"))


@query("risk_levels")
def q_risk_levels(spark, d):
    s = src.scored(spark, d)
    return s.select("transaction_id", "probability",
                    fx.risk_level(F.col("probability")).alias("risk_level"),
                    fx.decision_label(F.col("prediction")).alias("decision"))


@query("serving_payload")
def q_payload(spark, d):
    return cases.serving_payload(src.transactions(spark, d))


@query("user_transactions")
def q_user_tx(spark, d):
    return cases.user_transactions(src.transactions_core(spark, d))


@query("display_rows")
def q_display(spark, d):
    return cases.display_rows(src.transactions(spark, d))


# ---------------------------------------------------------------- windows
@query("running_velocity")
def q_running_velocity(spark, d):
    return win.running_velocity(src.transactions_core(spark, d))


@query("running_totals")
def q_running_totals(spark, d):
    return win.running_totals(src.scored(spark, d))


@query("idle_reset_counter")
def q_idle(spark, d):
    return win.idle_reset_counter(src.transactions_core(spark, d))


@query("user_sessions")
def q_sessions(spark, d):
    return win.user_sessions(src.transactions_core(spark, d))


@query("split_month_position")
def q_split_month(spark, d):
    t = src.transactions_core(spark, d)
    return win.split_month_position(t, agg.split_value(t))


# ---------------------------------------------------------------- aggregates
@query("kpis")
def q_kpis(spark, d):
    return agg.kpis(src.transactions_core(spark, d))


@query("monthly_volume")
def q_monthly(spark, d):
    t = src.transactions_core(spark, d)
    return agg.monthly_volume(t, agg.split_value(t).strftime("%Y-%m"))


@query("monthly_volume_long")
def q_monthly_long(spark, d):
    return agg.monthly_volume_long(agg.monthly_volume(src.transactions_core(spark, d)))


@query("hourly_fraud")
def q_hourly(spark, d):
    return agg.hourly_fraud(src.transactions_core(spark, d))


@query("top_fraud_categories")
def q_top_cats(spark, d):
    return agg.top_fraud_categories(src.transactions_core(spark, d))


@query("user_profiles")
def q_profiles(spark, d):
    return agg.user_profiles(src.transactions_countries(spark, d))


@query("fraud_users_first_seen")
def q_first_seen(spark, d):
    return agg.fraud_users_first_seen(src.transactions_core(spark, d))


@query("dataset_summary")
def q_summary(spark, d):
    return agg.dataset_summary(src.transactions_core(spark, d))


@query("split_instant")
def q_split_instant(spark, d):
    return agg.split_instant(src.transactions_core(spark, d))


@query("split_summary")
def q_split_summary(spark, d):
    t = src.transactions_core(spark, d)
    return agg.split_summary(t, agg.split_value(t))


@query("class_weight")
def q_class_weight(spark, d):
    t = src.transactions_core(spark, d)
    return agg.class_weight(t, agg.split_value(t))


@query("latency_summary")
def q_latency_summary(spark, d):
    return agg.latency_summary(src.requests(spark, d))


@query("latency_profile")
def q_latency_profile(spark, d):
    return agg.latency_profile(agg.latency_summary(src.requests(spark, d)))


@query("throughput")
def q_throughput(spark, d):
    return agg.throughput(src.requests(spark, d))


@query("score_histogram")
def q_histogram(spark, d):
    return agg.score_histogram(src.scored(spark, d))


@query("verdict_totals")
def q_verdicts(spark, d):
    return agg.verdict_totals(src.scored(spark, d))


# ---------------------------------------------------------------- cases
@query("risk_signals")
def q_signals(spark, d):
    return cases.risk_signals(src.transactions_core(spark, d))


@query("decision_accuracy")
def q_accuracy(spark, d):
    return cases.decision_accuracy(src.scored(spark, d))


@query("live_feed")
def q_live_feed(spark, d):
    return cases.live_feed(src.scored(spark, d))


# ---------------------------------------------------------------- top-k
@query("latest_transactions")
def q_latest_tx(spark, d):
    return topk.latest_transactions(src.transactions_core(spark, d))


@query("sample_transactions")
def q_sample(spark, d):
    return topk.sample_transactions(src.transactions_core(spark, d))


# ---------------------------------------------------------------- score metrics
@query("confusion_matrix")
def q_confusion(spark, d):
    return sc.fraud_class_metrics(sc.confusion_matrix(src.scored(spark, d)))


@query("metrics_document")
def q_metrics_document(spark, d):
    """The metrics written as a JSON document and read back."""
    from riskwave.ml.model import write_metrics
    metrics = q_confusion(spark, d)
    path = shared_path(spark, f"metrics/{uuid.uuid4().hex}")
    write_metrics(metrics, path)
    return spark.read.schema(metrics.schema).json(path)


@query("classification_report")
def q_report(spark, d):
    return sc.classification_report(src.scored(spark, d))


@query("roc_auc")
def q_auc(spark, d):
    return sc.roc_auc(src.scored(spark, d))


# ---------------------------------------------------------------- service metrics
@query("request_rate")
def q_request_rate(spark, d):
    return svc.request_rate(src.requests(spark, d))


@query("latency_buckets")
def q_buckets(spark, d):
    return svc.latency_buckets(src.requests(spark, d))


@query("bucket_quantiles")
def q_bucket_quantiles(spark, d):
    return svc.bucket_quantiles(svc.latency_buckets(src.requests(spark, d)))


@query("fraud_share")
def q_fraud_share(spark, d):
    return svc.fraud_share(src.requests(spark, d))


@query("error_rate")
def q_error_rate(spark, d):
    return svc.error_rate(src.requests(spark, d))


@query("counter_rate")
def q_counter_rate(spark, d):
    return svc.counter_rate(svc.counter_samples(src.requests(spark, d)))


@query("last_value")
def q_last_value(spark, d):
    return svc.last_value(src.requests(spark, d))


@query("inflight")
def q_inflight(spark, d):
    return svc.inflight(src.requests(spark, d))


# ---------------------------------------------------------------- streaming
from riskwave.streaming import jobs as sjobs                  # noqa: E402
from riskwave.streaming import sources as ssrc                # noqa: E402
from riskwave.streaming import velocity                        # noqa: E402
from riskwave.streaming.run import run_available               # noqa: E402


@query("stream_velocity")
def q_stream_velocity(spark, d):
    return sjobs.stream_velocity_job(ssrc.transactions_core_stream(spark, d))


@query("stream_latest_user_state")
def q_stream_latest(spark, d):
    return sjobs.stream_latest_state_job(ssrc.transactions_core_stream(spark, d))


@query("tumbling_1h")
def q_tumbling(spark, d):
    return sjobs.tumbling_job(ssrc.transactions_core_stream(spark, d, ssrc.WINDOW_BATCH_BYTES))


@query("sliding_24h")
def q_sliding(spark, d):
    return sjobs.sliding_job(ssrc.transactions_core_stream(spark, d, ssrc.WINDOW_BATCH_BYTES))


@query("stream_sessions")
def q_stream_sessions(spark, d):
    return sjobs.sessions_job(ssrc.transactions_core_stream(spark, d))


# ---------------------------------------------------------------- model
from riskwave.ml import explain as mlx                        # noqa: E402
from riskwave.ml import model as mlm                          # noqa: E402


def _bundle(spark, d):
    return mlm.bundle_for(spark, d, src.transactions(spark, d))


def _contrib(spark, d, scored_df):
    b = _bundle(spark, d)
    trees = mlx.tree_tables(spark, b.path, b.gbt)
    bc = spark.sparkContext.broadcast(trees)
    return mlx.contributions(scored_df, bc, len(fx.FEATURE_COLS))


@query("score_transactions")
def q_score(spark, d):
    t = src.transactions(spark, d)
    return mlm.score(_bundle(spark, d), t).select(*mlm.KEY_COLS, "probability", "prediction")


def _parity(left, right, names, key="user_id"):
    """Per ``key``: rows of either side, and rows equal in all columns."""
    a, b = (rows.groupBy(*rows.columns).count() for rows in (left, right))
    same = F.lit(True)
    for c in a.columns:
        same = same & F.col("a." + c).eqNullSafe(F.col("b." + c))
    both = a.alias("a").join(b.alias("b"), same, "full")
    return both.groupBy(F.coalesce("a." + key, "b." + key).alias(key)).agg(
        F.coalesce(F.sum("a.count"), F.lit(0)).alias(names[0]),
        F.coalesce(F.sum("b.count"), F.lit(0)).alias(names[1]),
        F.sum(F.when(F.col("a.count").isNotNull() & F.col("b.count").isNotNull(), F.col("a.count"))
              .otherwise(0)).alias("equal_rows"))


@query("bundle_parity")
def q_bundle_parity(spark, d):
    """Per user: rows scored from their features, rows that the loaded
    pipeline scores from raw columns, and rows equal in both."""
    t, b = src.transactions(spark, d), _bundle(spark, d)
    cols = ["transaction_id", "user_id", "probability", "prediction"]
    return _parity(mlm.score(b, t).select(*cols), mlm.score_raw(b, t).select(*cols), ("feature_rows", "raw_rows"))


@query("model_evaluation")
def q_model_eval(spark, d):
    t = src.transactions(spark, d)
    b = _bundle(spark, d)
    test = mlm.score(b, t).where(F.col("transaction_time") >= F.lit(b.meta["split"]).cast("timestamp_ntz"))
    # one scoring pass: counts per distinct probability carry all metrics
    per = cut_lineage(sc.score_counts(test, mlm.THRESHOLD))
    cm = sc.fraud_class_metrics(sc.confusion_of_counts(per))
    auc = sc.auc_of_counts(per).first()["auc"]     # one scalar
    return cm.withColumn("auc", F.lit(auc).cast("double"))


@query("serve_transactions")
def q_serve(spark, d):
    t = src.transactions(spark, d)
    return mlm.serve(_bundle(spark, d), mlm.serving_rows(t, _velocity(spark, d, t)))


@query("explain_transactions")
def q_explain(spark, d):
    t = src.transactions(spark, d)
    b = _bundle(spark, d)
    return mlx.top_contributions(_contrib(spark, d, mlm.score(b, t)))


@query("feature_importance")
def q_importance(spark, d):
    t = src.transactions(spark, d)
    b = _bundle(spark, d)
    test = mlm.score(b, t).where(F.col("transaction_time") >= F.lit(b.meta["split"]).cast("timestamp_ntz"))
    return mlx.feature_importance(_contrib(spark, d, test))


@query("importance_bars")
def q_bars(spark, d):
    return mlx.importance_bars(q_importance(spark, d))


@query("forensic_table")
def q_forensic(spark, d):
    t = src.transactions(spark, d)
    b = _bundle(spark, d)
    scored_df = mlm.score(b, t, extra=["merchant_category", "channel"])
    shown = ["user_id", "transaction_time", "merchant_category", "channel", "amount",
             "probability", "prediction", "is_fraud"]
    trees = mlx.tree_tables(spark, b.path, b.gbt)
    contrib = mlx.contributions(scored_df, spark.sparkContext.broadcast(trees),
                                len(fx.FEATURE_COLS), carry=shown)
    # stored, as a global sort reads its rows twice (bounds, then rows)
    rows = cut_lineage(mlx.top_contributions(contrib, k=1, carry=shown))
    return rows.select(
        "user_id", "transaction_id",
        F.date_format("transaction_time", "yyyy-MM-dd HH:mm:ss").alias("time_text"),
        F.col("merchant_category").alias("merchant"),
        F.col("amount").cast("decimal(18,2)").alias("amount_usd"), "channel",
        F.round(F.col("probability") * 100, 1).alias("fraud_prob_pct"),
        fx.risk_level(F.col("probability")).alias("risk"),
        fx.decision_label(F.col("prediction")).alias("decision"),
        F.when(F.col("is_fraud") == 1, "Fraud").otherwise("Legit").alias("ground_truth"),
        F.col("top")[0]["feature"].alias("top_contribution")) \
        .orderBy(F.col("time_text").desc(), F.col("transaction_id").desc())


@query("stream_scores")
def q_stream_scores(spark, d):
    return sjobs.stream_scores_job(ssrc.transactions_stream(spark, d), _bundle(spark, d))


@query("stream_serving_parity")
def q_stream_serving_parity(spark, d):
    """Per user: requests served in batch, and those whose row the stream
    gave exactly so (state, override, probability and verdict)."""
    return _parity(q_serve(spark, d), q_stream_scores(spark, d), ("batch_rows", "stream_rows"))


@query("stream_serving_state")
def q_stream_serving_state(spark, d):
    """The state that the stream shows to each request, before the model."""
    rows = velocity.stream_serving(ssrc.transactions_stream(spark, d)).select(
        "transaction_id", "user_id", F.col("total_transactions_user").alias("given_total_transactions"),
        "total_transactions_user", "velocity_score", "txn_count_24h")
    out = run_available(mlm.override(rows), ssrc.scratch(spark, "serving-state"))
    return spark.read.parquet(out)


@query("late_data")
def q_late_data(spark, d):
    out = sjobs.late_data_job(src.transactions_delayed(spark, d), src.LATE_DELAY)
    return out.select("transaction_id", "user_id", F.col("transaction_time").alias("event_time"), "amount",
                      "arrival_batch", "watermark", "late")


@query("stream_state_ttl")
def q_stream_state_ttl(spark, d):
    return sjobs.stream_state_ttl_job(ssrc.transactions_core_stream(spark, d))
