"""DuckDB oracle SQL, one text per query key.

The raw tables are views in the oracle session; the derived fixtures are
CTEs written out from FIXTURES.md, so each oracle is self-contained."""

from __future__ import annotations

EVENTS_PLAIN = "SELECT event_id, ts, user_id, event_type, value FROM events"
EVENTS_TIES = ("SELECT event_id, date_trunc('hour', ts) AS ts, user_id % 7 AS user_id, "
               "event_type, value FROM events")
EVENTS_ORDERS = ("SELECT o_orderkey AS event_id, o_orderdate AS ts, o_custkey AS user_id, "
                 "o_orderpriority AS event_type, o_totalprice AS value FROM orders")


def tx_cte(name: str = "transactions", ev: str = EVENTS_PLAIN) -> str:
    return f"""{name} AS (
SELECT e.event_id AS transaction_id, e.user_id, e.value AS amount,
  e.ts AS transaction_time,
  COUNT(*) OVER (PARTITION BY e.user_id) AS total_transactions_user,
  CAST(SUM(CAST(e.value AS DECIMAL(18,2))) OVER (PARTITION BY e.user_id) AS DOUBLE)
    / COUNT(*) OVER (PARTITION BY e.user_id) AS avg_amount_user,
  1 + (e.user_id*37) % 720 AS account_age_days,
  CAST(((e.event_id*7919) % 200000) / 100.0 AS DOUBLE) AS shipping_distance_km,
  n1.n_name AS country, n2.n_name AS bin_country,
  CASE WHEN e.event_id % 2 = 0 THEN 'web' ELSE 'app' END AS channel,
  e.event_type AS merchant_category,
  CASE WHEN e.event_id % 5 = 0 THEN 1 ELSE 0 END AS promo_used,
  CASE WHEN e.event_id % 7 = 0 THEN 0 ELSE 1 END AS avs_match,
  CASE WHEN e.event_id % 13 = 0 THEN 0 ELSE 1 END AS cvv_result,
  CASE WHEN e.event_id % 3 = 0 THEN 0 ELSE 1 END AS three_ds_flag,
  CASE WHEN (e.value > 100 AND (e.event_id % 7 = 0 OR e.event_id % 13 = 0))
         OR e.event_id % 97 = 0 THEN 1 ELSE 0 END AS is_fraud
FROM ({ev}) e
JOIN nation n1 ON n1.n_nationkey = e.user_id % 25
JOIN nation n2 ON n2.n_nationkey =
  CASE WHEN e.event_id % 11 = 0 THEN (e.user_id+1) % 25 ELSE e.user_id % 25 END)"""


TX = tx_cte()
TX_TIES = tx_cte("transactions", EVENTS_TIES)
TX_ORDERS = tx_cte("transactions", EVENTS_ORDERS)
TX_NULLS = TX + """,
transactions_nulls AS (
SELECT * REPLACE (
  CASE WHEN transaction_id % 17 = 0 THEN NULL ELSE merchant_category END AS merchant_category,
  CASE WHEN transaction_id % 19 = 0 THEN NULL ELSE country END AS country,
  CASE WHEN transaction_id % 23 = 0 THEN NULL ELSE bin_country END AS bin_country)
FROM transactions)"""

SCORED = TX + """,
scored AS (
SELECT transaction_id, user_id, transaction_time, amount, is_fraud, probability,
  CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS prediction
FROM (SELECT *, CAST(CASE WHEN is_fraud = 1
                 THEN LEAST((transaction_id*31) % 1000 + 450, 999)
                 ELSE (transaction_id*31) % 1000 END AS DOUBLE) / 1000.0 AS probability
      FROM transactions))"""

REQUESTS = """requests AS (
SELECT event_id AS request_id, ts,
  CASE WHEN event_id % 10 = 0 THEN '/health' ELSE '/predict' END AS handler,
  CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
  value AS latency_ms, value / 10.0 AS lookup_ms,
  CASE WHEN (value > 100 AND (event_id % 7 = 0 OR event_id % 13 = 0)) OR event_id % 97 = 0
       THEN 'fraud' ELSE 'legit' END AS verdict,
  value AS amount
FROM events)"""

FEATURES_SELECT = """*,
  CAST(hour(transaction_time) AS INTEGER) AS txn_hour,
  CAST(day(transaction_time) AS INTEGER) AS txn_day,
  CAST(month(transaction_time) AS INTEGER) AS txn_month,
  CAST(isodow(transaction_time) - 1 AS INTEGER) AS txn_dayofweek,
  CASE WHEN isodow(transaction_time) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour(transaction_time) < 6 OR hour(transaction_time) >= 22 THEN 1 ELSE 0 END AS is_night,
  CASE WHEN avg_amount_user + 1 = 0 THEN NULL ELSE amount / (avg_amount_user + 1) END AS amount_vs_avg,
  CASE WHEN coalesce(country <> bin_country, true) THEN 1 ELSE 0 END AS geo_mismatch"""


def velocity_sql(src: str = "transactions", cap: int | None = None) -> str:
    """Exact velocity frames: RANGE frames minus later ties, with the cap."""
    if cap:
        n1 = f"LEAST(n1r - nl, {cap})"
        n24 = f"LEAST(n24r - nl, {cap})"
        s1 = f"CASE WHEN n1r - nl <= {cap} THEN s1r - sl ELSE scap END"
        s24 = f"CASE WHEN n24r - nl <= {cap} THEN s24r - sl ELSE scap END"
        scap = (f", SUM(amt) OVER (PARTITION BY user_id ORDER BY transaction_time, transaction_id "
                f"ROWS BETWEEN {cap - 1} PRECEDING AND CURRENT ROW) AS scap")
    else:
        n1, n24, s1, s24, scap = "n1r - nl", "n24r - nl", "s1r - sl", "s24r - sl", ""
    return f"""
frames AS (
  SELECT user_id, transaction_id, transaction_time, amt,
    COUNT(*) OVER r1 AS n1r, SUM(amt) OVER r1 AS s1r,
    COUNT(*) OVER r24 AS n24r, SUM(amt) OVER r24 AS s24r,
    COUNT(*) OVER lt AS nl, COALESCE(SUM(amt) OVER lt, 0) AS sl {scap}
  FROM (SELECT user_id, transaction_id, transaction_time,
               CAST(amount AS DECIMAL(18,2)) AS amt FROM {src})
  WINDOW r1 AS (PARTITION BY user_id ORDER BY transaction_time
                RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW),
         r24 AS (PARTITION BY user_id ORDER BY transaction_time
                RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW),
         lt AS (PARTITION BY user_id, transaction_time ORDER BY transaction_id
                ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
capped AS (
  SELECT user_id, transaction_id, transaction_time AS event_time,
    CAST({n1} AS BIGINT) AS txn_count_1h, CAST({n24} AS BIGINT) AS txn_count_24h,
    CAST({s1} AS DECIMAL(18,2)) AS amount_sum_1h, CAST({s24} AS DECIMAL(18,2)) AS s24c
  FROM frames),
velocity AS (
  SELECT user_id, transaction_id, event_time, txn_count_1h, txn_count_24h, amount_sum_1h,
    CAST(CAST((2 * CAST(s24c * 100 AS BIGINT) + txn_count_24h) // (2 * txn_count_24h)
              AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) AS avg_amount_24h,
    CAST(ROUND(CAST(txn_count_1h AS DECIMAL(18,0)) * 0.4 + amount_sum_1h * 0.003
               + CAST(txn_count_24h AS DECIMAL(18,0)) * 0.3, 4) AS DECIMAL(18,4)) AS velocity_score
  FROM capped)"""


VELOCITY_COLS = ("user_id, transaction_id, event_time, txn_count_1h, txn_count_24h, "
                 "amount_sum_1h, avg_amount_24h, velocity_score")


def _q(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


ORACLES: dict[str, str] = {}


def _count_if_as_bigint(sql: str) -> str:
    """DuckDB's COUNT_IF is HUGEINT; rewrite it as the BIGINT
    ``COUNT(*) FILTER (WHERE ...)`` to match Spark's count type."""
    out, i, tok = [], 0, "COUNT_IF("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(tok)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j])
        out.append(f"COUNT(*) FILTER (WHERE {_count_if_as_bigint(sql[j + len(tok):k - 1])})")
        i = k


def register(name: str, sql: str) -> None:
    ORACLES[name] = _count_if_as_bigint(sql)


register("scan_transactions", _q(TX, body="SELECT * FROM transactions"))
register("engineer_features", _q(TX, body=f"SELECT {FEATURES_SELECT} FROM transactions"))
register("velocity_features", _q(TX, velocity_sql(), body=f"SELECT {VELOCITY_COLS} FROM velocity"))
register("velocity_features_capped",
         _q(TX, velocity_sql(cap=500), body=f"SELECT {VELOCITY_COLS} FROM velocity"))
register("velocity_features_ties",
         _q(TX_TIES, velocity_sql(), body=f"SELECT {VELOCITY_COLS} FROM velocity"))
register("velocity_features_orders",
         _q(TX_ORDERS, velocity_sql(), body=f"SELECT {VELOCITY_COLS} FROM velocity"))
register("hour_bucket_running_count", _q(TX, body="""
SELECT user_id, transaction_id, transaction_time AS event_time,
  date_trunc('hour', transaction_time) AS hour_start,
  COUNT(*) OVER (PARTITION BY user_id, date_trunc('hour', transaction_time)
                 ORDER BY transaction_time, transaction_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS txn_count_hour
FROM transactions"""))


# ------------------------------------------------------------------ helpers
SPLIT = """split AS (
  SELECT make_timestamp(CAST(floor(quantile_cont(epoch_us(transaction_time), 0.8)) AS BIGINT)) AS s
  FROM transactions)"""
STATE_COLS = ["velocity_score", "txn_count_1h", "txn_count_24h", "amount_sum_1h", "avg_amount_24h"]
STATE_TYPES = {"velocity_score": "DECIMAL(18,4)", "txn_count_1h": "BIGINT",
               "txn_count_24h": "BIGINT", "amount_sum_1h": "DECIMAL(18,2)",
               "avg_amount_24h": "DECIMAL(18,2)"}
LATEST_STATE = """latest AS (
  SELECT * FROM (SELECT * FROM velocity
    QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_time DESC, transaction_id DESC) = 1)
  WHERE event_time >= (SELECT MAX(transaction_time) FROM transactions) - INTERVAL 24 HOUR)"""


def dec_ratio(num: str, den: str, digits: int) -> str:
    """exact half-up num/den as DECIMAL(18, digits) via integer arithmetic."""
    k = 10 ** digits
    q = f"((2 * {k} * CAST({num} AS HUGEINT) + CAST({den} AS HUGEINT)) // (2 * CAST({den} AS HUGEINT)))"
    return (f"(CASE WHEN ({den}) = 0 THEN CAST(0 AS DECIMAL(18,{digits})) ELSE "
            f"CAST(CAST({q} AS VARCHAR)::DECIMAL(38,0) / {k} AS DECIMAL(18,{digits})) END)")


def pct(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) * 100.0 / CAST({whole} AS DOUBLE)"


def zero(c: str, src: str) -> str:
    return f"CAST(COALESCE({src}, 0) AS {STATE_TYPES[c]}) AS {c}"


VEL = velocity_sql()
SEQ_ORDER = "transaction_time, transaction_id"

# ------------------------------------------------------------------ state / joins
register("latest_user_state", _q(TX, VEL, LATEST_STATE, body=f"""
SELECT user_id, transaction_id, event_time, {', '.join(STATE_COLS)} FROM latest"""))
register("state_lookup", _q(TX, VEL, LATEST_STATE, body=f"""
SELECT t.*, l.event_time AS state_time, {', '.join(zero(c, 'l.' + c) for c in STATE_COLS)}
FROM transactions t LEFT JOIN latest l USING (user_id)"""))
register("state_table_lookup", ORACLES["state_lookup"])
_fresh = ("s.event_time IS NOT NULL AND epoch_us(t.transaction_time) - epoch_us(s.event_time) "
          "<= 86400000000")
register("asof_state_lookup", _q(TX, VEL, body=f"""
SELECT t.transaction_id, t.user_id, t.transaction_time,
  CASE WHEN {_fresh} THEN s.event_time END AS state_time,
  {', '.join(zero(c, f'CASE WHEN {_fresh} THEN s.{c} END') for c in STATE_COLS)}
FROM transactions t ASOF LEFT JOIN velocity s
  ON t.user_id = s.user_id AND t.transaction_time > s.event_time"""))
# Equal times: the state before (time, id) is the user's previous row.
_PREV = """prev AS (
  SELECT *, LAG(event_time) OVER w AS p_time, """ + ", ".join(
    f"LAG({c}) OVER w AS p_{c}" for c in STATE_COLS) + """
  FROM velocity WINDOW w AS (PARTITION BY user_id ORDER BY event_time, transaction_id))"""
_pfresh = "p_time IS NOT NULL AND epoch_us(event_time) - epoch_us(p_time) <= 86400000000"
register("asof_state_lookup_ties", _q(TX_TIES, VEL, _PREV, body=f"""
SELECT transaction_id, user_id, event_time AS transaction_time,
  CASE WHEN {_pfresh} THEN p_time END AS state_time,
  {', '.join(zero(c, f'CASE WHEN {_pfresh} THEN p_{c} END') for c in STATE_COLS)}
FROM prev"""))
register("serving_features_ties", _q(TX_TIES, VEL, _PREV, body=f"""
SELECT t.transaction_id, t.user_id, t.total_transactions_user AS given_total_transactions,
  CASE WHEN COALESCE(CASE WHEN {_pfresh} THEN p_velocity_score END, 0) > 0
       THEN CAST(p_txn_count_24h AS BIGINT) ELSE t.total_transactions_user END AS total_transactions_user,
  {zero('velocity_score', f'CASE WHEN {_pfresh} THEN p_velocity_score END')},
  {zero('txn_count_24h', f'CASE WHEN {_pfresh} THEN p_txn_count_24h END')}
FROM transactions t JOIN prev ON t.transaction_id = prev.transaction_id"""))
register("fraud_user_transactions", _q(TX, body="""
SELECT * FROM transactions WHERE user_id IN (SELECT user_id FROM transactions WHERE is_fraud = 1)"""))
register("clean_users", _q(TX, body="""
SELECT user_id, COUNT(*) AS transactions, 'CLEAN' AS risk_label FROM transactions
WHERE user_id NOT IN (SELECT user_id FROM transactions WHERE is_fraud = 1)
GROUP BY user_id"""))
_LOG_ENTRY = """'{"user_id":' || user_id || ',"event_time":"' || strftime(event_time, '%Y-%m-%d %H:%M:%S.%f')
  || '","velocity_score":' || CAST(velocity_score AS VARCHAR) || ',"txn_count_1h":' || txn_count_1h
  || ',"txn_count_24h":' || txn_count_24h || ',"amount_sum_1h":' || CAST(amount_sum_1h AS VARCHAR)
  || ',"avg_amount_24h":' || CAST(avg_amount_24h AS VARCHAR) || '}'"""
register("stream_log", _q(TX, VEL, body=f"""
SELECT transaction_id, event_time, {_LOG_ENTRY} AS entry
FROM velocity ORDER BY event_time DESC, transaction_id DESC LIMIT 200"""))
register("stream_log_latest", _q(TX, VEL, body=f"""
SELECT user_id, event_time, {', '.join(STATE_COLS)}
FROM velocity ORDER BY event_time DESC, transaction_id DESC LIMIT 20"""))
register("progress_checkpoints", _q(TX, body=f"""
SELECT processed, transaction_time, transaction_id FROM (
  SELECT transaction_time, transaction_id, ROW_NUMBER() OVER (ORDER BY {SEQ_ORDER}) AS processed
  FROM transactions) WHERE processed % 50 = 0"""))

# ------------------------------------------------------------------ projections
_NUM_FILL = ["amount", "total_transactions_user", "avg_amount_user", "account_age_days",
             "shipping_distance_km", "promo_used", "avs_match", "cvv_result", "three_ds_flag",
             "txn_hour", "txn_day", "txn_month", "txn_dayofweek", "is_weekend", "is_night",
             "amount_vs_avg", "geo_mismatch"]
_CAT = ["country", "bin_country", "channel", "merchant_category"]
_FEATURE_ORDER = ["amount", "total_transactions_user", "avg_amount_user", "account_age_days",
                  "shipping_distance_km", "country", "bin_country", "channel",
                  "merchant_category", "promo_used", "avs_match", "cvv_result",
                  "three_ds_flag", "txn_hour", "txn_day", "txn_month", "txn_dayofweek",
                  "is_weekend", "is_night", "amount_vs_avg", "geo_mismatch"]


def _fill(c: str) -> str:
    if c in _CAT:
        return f"COALESCE({c}, 'Missing') AS {c}"
    if c in ("amount", "avg_amount_user", "shipping_distance_km", "amount_vs_avg"):
        return f"COALESCE(CASE WHEN isnan({c}) THEN 0.0 ELSE {c} END, 0.0) AS {c}"
    return f"COALESCE({c}, 0) AS {c}"


register("fill_missing", _q(TX_NULLS, body=f"""
SELECT transaction_id, {', '.join(_fill(c) for c in _FEATURE_ORDER)}
FROM (SELECT {FEATURES_SELECT.replace('*,', '*,', 1)} FROM transactions_nulls)"""))
def _vocabulary(rows: str) -> str:
    return "vocab AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS col, v, CAST(DENSE_RANK() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
        f"FROM (SELECT DISTINCT COALESCE({c}, 'Missing') AS v FROM {rows})" for c in _CAT) + ")"


_encoded = f"""
SELECT t.transaction_id, {', '.join(f"COALESCE((SELECT code FROM vocab WHERE col = '{c}' AND v = COALESCE(t.{c}, 'Missing')), -1) AS {c}" for c in _CAT)}
FROM transactions_nulls t"""
register("ordinal_encode", _q(TX_NULLS, SPLIT, _vocabulary("transactions_nulls, split WHERE transaction_time < split.s"),
                              body=_encoded))
register("ordinal_encode_all", _q(TX_NULLS, _vocabulary("transactions_nulls"), body=_encoded))
register("serving_features", _q(TX, VEL, body=f"""
SELECT t.transaction_id, t.user_id, t.total_transactions_user AS given_total_transactions,
  CASE WHEN COALESCE(CASE WHEN {_fresh} THEN s.velocity_score END, 0) > 0
       THEN CAST(s.txn_count_24h AS BIGINT) ELSE t.total_transactions_user END AS total_transactions_user,
  {zero('velocity_score', f'CASE WHEN {_fresh} THEN s.velocity_score END')},
  {zero('txn_count_24h', f'CASE WHEN {_fresh} THEN s.txn_count_24h END')}
FROM transactions t ASOF LEFT JOIN velocity s
  ON t.user_id = s.user_id AND t.transaction_time > s.event_time"""))
register("velocity_bands", _q(TX, VEL, body="""
SELECT user_id, transaction_id, velocity_score,
  CASE WHEN velocity_score > 5.0 THEN 'HIGH' WHEN velocity_score > 2.0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band,
  CASE WHEN velocity_score >= 15.0 THEN 'red' WHEN velocity_score >= 5.0 THEN 'yellow' ELSE 'green' END AS monitor_band
FROM velocity"""))
register("risk_levels", _q(SCORED, body="""
SELECT transaction_id, probability,
  CASE WHEN probability > 0.7 THEN 'HIGH' WHEN probability > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN prediction = 1 THEN 'BLOCKED' ELSE 'CLEARED' END AS decision
FROM scored"""))
register("serving_payload", _q(TX, body="""
SELECT user_id, amount, total_transactions_user, avg_amount_user, account_age_days,
  shipping_distance_km, country, bin_country, channel, merchant_category, promo_used,
  avs_match, cvv_result, three_ds_flag,
  strftime(transaction_time, '%Y-%m-%d %H:%M:%S.%f') AS transaction_time
FROM transactions"""))
register("user_transactions", _q(TX, body="""
SELECT user_id, transaction_id, transaction_time, amount,
  CASE WHEN is_fraud = 1 THEN 'Fraud' ELSE 'Legit' END AS label FROM transactions"""))
register("display_rows", _q(TX, body="""
SELECT transaction_id, strftime(transaction_time, '%Y-%m-%d %H:%M:%S') AS time_text,
  merchant_category AS merchant, CAST(amount AS DECIMAL(18,2)) AS amount_usd, channel,
  CASE WHEN is_fraud = 1 THEN 'Fraud' ELSE 'Legit' END AS ground_truth FROM transactions"""))

# ------------------------------------------------------------------ windows
register("running_velocity", _q(TX, body=f"""
SELECT user_id, transaction_time, transaction_id, rn AS running_count, CAST(rn AS DOUBLE) * 1.5 AS velocity
FROM (SELECT user_id, transaction_time, transaction_id,
        ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY {SEQ_ORDER}) AS rn
      FROM transactions WHERE user_id IN (SELECT user_id FROM transactions WHERE is_fraud = 1))"""))
register("running_totals", _q(SCORED, body=f"""
SELECT transaction_time, transaction_id, processed, fraud_caught,
  CAST(CAST(blocked AS DECIMAL(38,0)) / 100 AS DECIMAL(38,2)) AS value_blocked,
  {pct('fraud_caught', 'processed')} AS fraud_rate_pct
FROM (SELECT transaction_time, transaction_id,
        ROW_NUMBER() OVER w AS processed,
        CAST(SUM(CAST(prediction AS BIGINT)) OVER w AS BIGINT) AS fraud_caught,
        SUM(CASE WHEN prediction = 1 THEN CAST(CAST(amount AS DECIMAL(18,2)) * 100 AS BIGINT) ELSE 0 END) OVER w AS blocked
      FROM scored WINDOW w AS (ORDER BY {SEQ_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""))
_RUNS = f"""runs AS (
  SELECT *, SUM(new_run) OVER (PARTITION BY user_id ORDER BY {SEQ_ORDER}
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_id
  FROM (SELECT user_id, transaction_time, transaction_id, amount,
          CASE WHEN LAG(transaction_time) OVER (PARTITION BY user_id ORDER BY {SEQ_ORDER}) IS NULL
                 OR epoch_us(transaction_time) - epoch_us(LAG(transaction_time) OVER (PARTITION BY user_id ORDER BY {SEQ_ORDER})) > 3600000000
               THEN 1 ELSE 0 END AS new_run
        FROM transactions))"""
register("idle_reset_counter", _q(TX, _RUNS, body=f"""
SELECT user_id, transaction_time, transaction_id, CAST(run_id AS BIGINT) AS run_id,
  ROW_NUMBER() OVER (PARTITION BY user_id, run_id ORDER BY {SEQ_ORDER}) AS counter
FROM runs"""))
register("user_sessions", _q(TX, _RUNS, body="""
SELECT user_id, MIN(transaction_time) AS session_start,
  MAX(transaction_time) + INTERVAL 1 HOUR AS session_end, COUNT(*) AS events,
  CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount_sum
FROM runs GROUP BY user_id, run_id"""))
register("split_month_position", _q(TX, SPLIT, body="""
SELECT month, position FROM (
  SELECT month, CAST(ROW_NUMBER() OVER (ORDER BY month) - 1 AS INTEGER) AS position
  FROM (SELECT DISTINCT strftime(transaction_time, '%Y-%m') AS month FROM transactions))
WHERE month = (SELECT strftime(s, '%Y-%m') FROM split)"""))
register("hour_bucket_running_count", ORACLES["hour_bucket_running_count"])

# ------------------------------------------------------------------ aggregates
register("kpis", _q(TX, body=f"""
SELECT COUNT(*) AS total_transactions, COUNT_IF(is_fraud = 1) AS fraud_count,
  CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_volume,
  {pct('COUNT_IF(is_fraud = 1)', 'COUNT(*)')} AS fraud_rate_pct
FROM transactions"""))
register("monthly_volume", _q(TX, SPLIT, body="""
SELECT strftime(transaction_time, '%Y-%m') AS month, COUNT_IF(is_fraud = 0) AS legit,
  COUNT_IF(is_fraud = 1) AS fraud,
  CASE WHEN strftime(transaction_time, '%Y-%m') >= (SELECT strftime(s, '%Y-%m') FROM split)
       THEN 'test' ELSE 'train' END AS side
FROM transactions GROUP BY 1, 4"""))
register("monthly_volume_long", _q(TX, body="""
SELECT month, type, count FROM (
  SELECT strftime(transaction_time, '%Y-%m') AS month, COUNT_IF(is_fraud = 0) AS Legit,
         COUNT_IF(is_fraud = 1) AS Fraud FROM transactions GROUP BY 1)
UNPIVOT (count FOR type IN (Legit, Fraud))"""))
register("hourly_fraud", _q(TX, body="""
SELECT CAST(hour(transaction_time) AS INTEGER) AS hour, COUNT(*) AS count
FROM transactions WHERE is_fraud = 1 GROUP BY 1"""))
register("top_fraud_categories", _q(TX, body="""
SELECT merchant_category AS category, COUNT(*) AS count FROM transactions
WHERE is_fraud = 1 AND merchant_category IS NOT NULL
GROUP BY 1 ORDER BY count DESC, category LIMIT 5"""))
register("user_profiles", _q(TX, body=f"""
SELECT user_id, COUNT(*) AS transactions, COUNT_IF(is_fraud = 1) AS fraud_events,
  CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_spend,
  CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS avg_transaction,
  arg_min(account_age_days, ({SEQ_ORDER})) AS first_account_age_days,
  arg_min(country, ({SEQ_ORDER})) AS first_country,
  CASE WHEN COUNT_IF(is_fraud = 1) > 0 THEN 'HIGH RISK' ELSE 'CLEAN' END AS risk_label
FROM transactions GROUP BY user_id"""))
register("fraud_users_first_seen", _q(TX, body=f"""
SELECT user_id, MIN(transaction_time) AS first_fraud_time,
  arg_min(transaction_id, ({SEQ_ORDER})) AS first_fraud_id
FROM transactions WHERE is_fraud = 1 GROUP BY user_id
ORDER BY first_fraud_time, first_fraud_id LIMIT 100"""))
register("dataset_summary", _q(TX, body=f"""
SELECT MIN(transaction_time) AS min_time, MAX(transaction_time) AS max_time, COUNT(*) AS rows,
  {pct('COUNT_IF(is_fraud = 1)', 'COUNT(*)')} AS fraud_rate_pct FROM transactions"""))
register("split_instant", _q(TX, SPLIT, body="SELECT s AS split_instant FROM split"))
register("split_summary", _q(TX, SPLIT, body=f"""
SELECT CASE WHEN transaction_time < (SELECT s FROM split) THEN 'train' ELSE 'test' END AS side,
  COUNT(*) AS rows, COUNT_IF(is_fraud = 1) AS fraud_count,
  MIN(transaction_time) AS min_time, MAX(transaction_time) AS max_time,
  {pct('COUNT_IF(is_fraud = 1)', 'COUNT(*)')} AS fraud_rate_pct
FROM transactions GROUP BY 1"""))
register("class_weight", _q(TX, SPLIT, body=f"""
SELECT negatives, positives, {dec_ratio('negatives', 'positives', 2)} AS scale_pos_weight
FROM (SELECT COUNT_IF(is_fraud = 0) AS negatives, COUNT_IF(is_fraud = 1) AS positives
      FROM transactions WHERE transaction_time < (SELECT s FROM split))"""))
_LAT = """lat AS (
  SELECT a.handler, a.n, a.mean, a.min, a.max, a.errors,
    CASE WHEN a.n % 2 = 1 THEN p.m2 ELSE (p.m1 + p.m2) / 2.0 END AS p50, p.p95, p.p99
  FROM (SELECT handler, COUNT(*) AS n,
          CAST(SUM(CAST(latency_ms AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS mean,
          MIN(latency_ms) AS min, MAX(latency_ms) AS max,
          COUNT_IF(regexp_matches(status, '^5..$')) AS errors
        FROM requests GROUP BY handler) a
  JOIN (SELECT handler,
          MAX(CASE WHEN pos = (n - 1) // 2 THEN latency_ms END) AS m1,
          MAX(CASE WHEN pos = n // 2 THEN latency_ms END) AS m2,
          MAX(CASE WHEN pos = (n * 95) // 100 THEN latency_ms END) AS p95,
          MAX(CASE WHEN pos = (n * 99) // 100 THEN latency_ms END) AS p99
        FROM (SELECT handler, latency_ms,
                ROW_NUMBER() OVER (PARTITION BY handler ORDER BY latency_ms, request_id) - 1 AS pos,
                COUNT(*) OVER (PARTITION BY handler) AS n FROM requests)
        GROUP BY handler) p USING (handler))"""
register("latency_summary", _q(REQUESTS, _LAT, body="""
SELECT handler, n, mean, min, p50, p95, p99, max, errors FROM lat"""))
register("latency_profile", _q(REQUESTS, _LAT, body="""
SELECT handler, stat, value, CASE WHEN value > 50.0 THEN 1 ELSE 0 END AS breach
FROM (SELECT handler, min, p50, p95, p99, max FROM lat)
UNPIVOT (value FOR stat IN (min, p50, p95, p99, max))"""))
register("throughput", _q(REQUESTS, body="""
SELECT ok, elapsed_s, CASE WHEN elapsed_s = 0 THEN NULL ELSE CAST(ok AS DOUBLE) / elapsed_s END AS rows_per_sec
FROM (SELECT COUNT_IF(status = '200') AS ok,
        CAST(MAX(epoch_us(ts)) - MIN(epoch_us(ts)) AS DOUBLE) / 1000000.0 AS elapsed_s
      FROM requests)"""))
register("score_histogram", _q(SCORED, body="""
SELECT bin, CAST(bin AS DOUBLE) / 20.0 AS bin_start, COUNT(*) AS count,
  CASE WHEN CAST(bin AS DOUBLE) / 20.0 >= 0.5 THEN 1 ELSE 0 END AS at_or_above_threshold
FROM (SELECT CAST(LEAST(floor(probability * 20.0), 19) AS INTEGER) AS bin FROM scored)
GROUP BY bin"""))
register("verdict_totals", _q(SCORED, body="""
SELECT CASE WHEN prediction = 1 THEN 'fraud' ELSE 'legit' END AS verdict, COUNT(*) AS predictions,
  CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount
FROM scored GROUP BY 1"""))

# ------------------------------------------------------------------ cases
register("risk_signals", _q(TX, f"""f AS (
  SELECT user_id,
    CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS user_mean,
    arg_min(transaction_id, ({SEQ_ORDER})) FILTER (WHERE is_fraud = 1) AS tid
  FROM transactions GROUP BY user_id HAVING COUNT_IF(is_fraud = 1) > 0)""", """s AS (
  SELECT f.user_id, f.tid AS transaction_id, sig.k, sig.signal
  FROM f JOIN transactions t ON t.transaction_id = f.tid,
  LATERAL (VALUES (1, CASE WHEN t.account_age_days < 30 THEN 'New Account' END),
                  (2, CASE WHEN t.avs_match = 0 THEN 'AVS Mismatch' END),
                  (3, CASE WHEN t.three_ds_flag = 0 THEN 'No 3DS' END),
                  (4, CASE WHEN t.amount > f.user_mean * 2 THEN 'High Amount' END)) sig(k, signal)
  WHERE sig.signal IS NOT NULL)""", body="""
SELECT user_id, transaction_id, CAST(signal_rank AS INTEGER) AS signal_rank, signal FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY k) AS signal_rank FROM s)
WHERE signal_rank <= 3"""))
register("decision_accuracy", _q(SCORED, body="""
SELECT user_id, COUNT_IF((prediction = 1) = (is_fraud = 1)) AS correct, COUNT(*) AS total,
  CAST(COUNT_IF((prediction = 1) = (is_fraud = 1)) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS accuracy
FROM scored GROUP BY user_id"""))
register("live_feed", _q(SCORED, body="""
SELECT transaction_id, user_id, strftime(transaction_time, '%Y-%m-%d %H:%M') AS time_text,
  CAST(amount AS DECIMAL(18,2)) AS amount, CAST(floor(probability * 100.0) AS INTEGER) AS prob_pct,
  CASE WHEN probability > 0.7 THEN 'HIGH' WHEN probability > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
  CASE WHEN prediction = 1 THEN 'BLOCKED' ELSE 'CLEARED' END AS decision
FROM scored ORDER BY transaction_time DESC, transaction_id DESC LIMIT 8"""))

# ------------------------------------------------------------------ top-k
register("latest_transactions", _q(TX, body="""
SELECT transaction_id, user_id, transaction_time, amount, is_fraud FROM transactions
ORDER BY transaction_time DESC, transaction_id DESC LIMIT 1000"""))
register("sample_transactions", _q(TX, body="""
SELECT transaction_id, user_id, transaction_time, amount, is_fraud FROM transactions
ORDER BY md5(CAST(transaction_id AS VARCHAR)), transaction_id LIMIT 500"""))

# ------------------------------------------------------------------ score metrics
register("confusion_matrix", _q(SCORED, body=f"""
SELECT tn, fp, fn, tp, {dec_ratio('tp', 'tp + fp', 4)} AS precision_fraud,
  {dec_ratio('tp', 'tp + fn', 4)} AS recall_fraud,
  {dec_ratio('2 * tp', '2 * tp + fp + fn', 4)} AS f1_fraud
FROM (SELECT COUNT_IF(is_fraud = 0 AND prediction = 0) AS tn,
        COUNT_IF(is_fraud = 0 AND prediction = 1) AS fp,
        COUNT_IF(is_fraud = 1 AND prediction = 0) AS fn,
        COUNT_IF(is_fraud = 1 AND prediction = 1) AS tp FROM scored)"""))
register("classification_report", _q(SCORED, body=f"""
SELECT class, {dec_ratio('hit', 'hit + wrong_pred', 4)} AS precision,
  {dec_ratio('hit', 'hit + missed', 4)} AS recall,
  {dec_ratio('2 * hit', '2 * hit + wrong_pred + missed', 4)} AS f1, hit + missed AS support
FROM (SELECT 0 AS class, COUNT_IF(is_fraud = 0 AND prediction = 0) AS hit,
        COUNT_IF(is_fraud = 1 AND prediction = 0) AS wrong_pred,
        COUNT_IF(is_fraud = 0 AND prediction = 1) AS missed FROM scored
      UNION ALL
      SELECT 1, COUNT_IF(is_fraud = 1 AND prediction = 1), COUNT_IF(is_fraud = 0 AND prediction = 1),
        COUNT_IF(is_fraud = 1 AND prediction = 0) FROM scored)"""))
register("roc_auc", _q(SCORED, body="""
SELECT CAST(SUM(pos) AS BIGINT) AS positives, CAST(SUM(neg) AS BIGINT) AS negatives,
  CAST(SUM(2 * CAST(pos AS HUGEINT) * below + CAST(pos AS HUGEINT) * neg) AS DOUBLE)
    / CAST(2 * CAST(SUM(pos) AS HUGEINT) * SUM(neg) AS DOUBLE) AS auc
FROM (SELECT pos, neg, SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
      FROM (SELECT probability AS score, COUNT_IF(is_fraud = 1) AS pos, COUNT_IF(is_fraud = 0) AS neg
            FROM scored GROUP BY 1))"""))

# ------------------------------------------------------------------ service metrics
register("request_rate", _q(REQUESTS, """per AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, handler, COUNT(*) AS requests
  FROM requests GROUP BY 1, 2)""", body="""
SELECT window_start, handler, requests, CAST(requests AS DOUBLE) / 3600.0 AS rate_per_sec FROM per
UNION ALL
SELECT window_start, 'ALL', CAST(SUM(requests) AS BIGINT), CAST(SUM(requests) AS DOUBLE) / 3600.0
FROM per GROUP BY window_start"""))
_BUCKETS = """buckets AS (
  SELECT 'prediction' AS metric, b.idx, b.le, COUNT_IF(r.latency_ms <= b.le) AS cumulative_count
  FROM (SELECT * FROM requests WHERE handler = '/predict') r,
       (VALUES (0, 1.0::DOUBLE), (1, 2.0), (2, 5.0), (3, 10.0), (4, 20.0), (5, 50.0), (6, 100.0),
               (7, 200.0), (8, 500.0), (9, 'inf'::DOUBLE)) b(idx, le)
  GROUP BY b.idx, b.le
  UNION ALL
  SELECT 'lookup', b.idx, b.le, COUNT_IF(r.lookup_ms <= b.le)
  FROM requests r,
       (VALUES (0, 0.5::DOUBLE), (1, 1.0), (2, 2.0), (3, 5.0), (4, 10.0), (5, 25.0), (6, 50.0),
               (7, 'inf'::DOUBLE)) b(idx, le)
  GROUP BY b.idx, b.le)"""
register("latency_buckets", _q(REQUESTS, _BUCKETS, body="""
SELECT metric, CAST(idx AS INTEGER) AS idx, le, cumulative_count FROM buckets"""))
register("bucket_quantiles", _q(REQUESTS, _BUCKETS, """x AS (
  SELECT *, LAG(le) OVER w AS lo, LAG(cumulative_count) OVER w AS cprev,
    MAX(cumulative_count) OVER (PARTITION BY metric) AS total,
    MAX(CASE WHEN le <> 'inf'::DOUBLE THEN le END) OVER (PARTITION BY metric) AS last_finite
  FROM buckets WINDOW w AS (PARTITION BY metric ORDER BY idx))""", """h AS (
  SELECT x.*, q.quantile, q.quantile * CAST(total AS DOUBLE) AS rank
  FROM x, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) q(quantile)
  WHERE CAST(cumulative_count AS DOUBLE) >= q.quantile * CAST(total AS DOUBLE)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY metric, q.quantile ORDER BY idx) = 1)""", body="""
SELECT metric, quantile,
  CASE WHEN le = 'inf'::DOUBLE THEN last_finite
       WHEN CAST(cumulative_count AS DOUBLE) = CAST(COALESCE(cprev, 0) AS DOUBLE) THEN le
       ELSE COALESCE(lo, 0.0) + (le - COALESCE(lo, 0.0)) * ((rank - CAST(COALESCE(cprev, 0) AS DOUBLE))
            / (CAST(cumulative_count AS DOUBLE) - CAST(COALESCE(cprev, 0) AS DOUBLE))) END AS value
FROM h"""))
register("fraud_share", _q(REQUESTS, body="""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, COUNT_IF(verdict = 'fraud') AS fraud,
  COUNT(*) AS total, CAST(COUNT_IF(verdict = 'fraud') AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS share
FROM requests GROUP BY 1"""))
register("error_rate", _q(REQUESTS, body="""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, COUNT_IF(regexp_matches(status, '^5..$')) AS errors,
  CAST(COUNT_IF(regexp_matches(status, '^5..$')) AS DOUBLE) / 3600.0 AS errors_per_sec
FROM requests GROUP BY 1"""))
register("counter_rate", _q(REQUESTS, """samples AS (
  SELECT handler, ts, request_id,
    ROW_NUMBER() OVER (PARTITION BY handler, CAST(ts AS DATE) ORDER BY ts, request_id) AS counter
  FROM requests)""", """inc AS (
  SELECT handler, ts, counter, LAG(counter) OVER (PARTITION BY handler ORDER BY ts, request_id) AS prev
  FROM samples)""", body="""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, handler,
  CAST(SUM(CASE WHEN prev IS NULL THEN counter WHEN counter >= prev THEN counter - prev ELSE counter END) AS BIGINT) AS increase,
  CAST(SUM(CASE WHEN prev IS NULL THEN counter WHEN counter >= prev THEN counter - prev ELSE counter END) AS DOUBLE) / 3600.0 AS rate_per_sec
FROM inc GROUP BY 1, 2"""))
register("last_value", _q(REQUESTS, body="""
SELECT handler, arg_max(ts, (ts, request_id)) AS last_ts, arg_max(latency_ms, (ts, request_id)) AS last_value
FROM requests WHERE latency_ms IS NOT NULL GROUP BY handler"""))
register("inflight", _q(REQUESTS, """ev AS (
  SELECT request_id, epoch_us(ts) AS at_us, CAST(1 AS BIGINT) AS delta FROM requests
  UNION ALL
  SELECT request_id, epoch_us(ts) + CAST(CAST(latency_ms AS DECIMAL(18,2)) * 1000 AS BIGINT), CAST(-1 AS BIGINT)
  FROM requests)""", body="""
SELECT make_timestamp(at_us) AS at, request_id, delta,
  CAST(SUM(delta) OVER (ORDER BY at_us, delta, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS inflight
FROM ev"""))

# ------------------------------------------------------------------ streaming
register("stream_velocity", ORACLES["velocity_features"])
register("stream_latest_user_state", ORACLES["latest_user_state"])
register("tumbling_1h", _q(TX, body="""
SELECT user_id, time_bucket(INTERVAL 1 HOUR, transaction_time) AS window_start,
  time_bucket(INTERVAL 1 HOUR, transaction_time) + INTERVAL 1 HOUR AS window_end,
  COUNT(*) AS txn_count, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount_sum
FROM transactions GROUP BY 1, 2, 3"""))
register("sliding_24h", _q(TX, body="""
SELECT user_id, window_start, window_start + INTERVAL 24 HOUR AS window_end,
  COUNT(*) AS txn_count, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount_sum
FROM (SELECT user_id, amount,
        time_bucket(INTERVAL 1 HOUR, transaction_time) - INTERVAL (k) HOUR AS window_start
      FROM transactions, range(0, 24) r(k))
GROUP BY 1, 2, 3"""))
register("stream_sessions", _q(TX, _RUNS, body="""
  SELECT user_id, MIN(transaction_time) AS session_start,
    MAX(transaction_time) + INTERVAL 1 HOUR AS session_end, COUNT(*) AS events,
    CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount_sum
  FROM runs GROUP BY user_id, run_id"""))
register("stream_state_ttl", _q(TX, body="""
SELECT user_id, arg_max(transaction_time, (transaction_time, transaction_id)) AS last_event_time,
  arg_max(transaction_id, (transaction_time, transaction_id)) AS last_transaction_id
FROM transactions GROUP BY user_id
HAVING epoch_us(MAX(transaction_time)) + 86400000000
       >= (SELECT epoch_ms(MAX(transaction_time)) * 1000 FROM transactions)"""))
register("stream_serving_state", ORACLES["serving_features"])
# The stream's rows are the batch serving rows, so all of them are equal.
register("stream_serving_parity", _q(TX, body="""
SELECT user_id, COUNT(*) AS batch_rows, COUNT(*) AS stream_rows, COUNT(*) AS equal_rows
FROM transactions GROUP BY user_id"""))
register("metrics_document", ORACLES["confusion_matrix"])
register("scan_transactions_csv", ORACLES["scan_transactions"])
# The loaded pipeline scores raw rows as their features are scored.
register("bundle_parity", _q(TX, body="""
SELECT user_id, COUNT(*) AS feature_rows, COUNT(*) AS raw_rows, COUNT(*) AS equal_rows
FROM transactions GROUP BY user_id"""))
register("late_data", _q(TX, body="""
SELECT transaction_id, user_id, transaction_time AS event_time, amount, arrival_batch, watermark,
  coalesce(transaction_time < watermark, false) AS late
FROM (SELECT *, dense_rank() OVER (ORDER BY
          (CAST(floor(epoch(transaction_time)) AS BIGINT) + (transaction_id * 7919) % 21600) // 259200) - 1 AS arrival_batch
      FROM transactions)
JOIN (SELECT arrival_batch, MAX(MAX(transaction_time)) OVER (
          ORDER BY arrival_batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 HOUR AS watermark
      FROM (SELECT transaction_time, dense_rank() OVER (ORDER BY
          (CAST(floor(epoch(transaction_time)) AS BIGINT) + (transaction_id * 7919) % 21600) // 259200) - 1 AS arrival_batch
        FROM transactions)
      GROUP BY arrival_batch) USING (arrival_batch)"""))
