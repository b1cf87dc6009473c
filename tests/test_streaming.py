"""Batch = stream for the keyed velocity processor and the window jobs."""

from pyspark.sql import functions as F

from riskwave.operators.velocity import velocity_features
from riskwave.sources import transactions, transactions_orders
from riskwave.streaming import run, sources, velocity
from riskwave.streaming.jobs import stream_velocity_job
from tests.conftest import SF_MID, SF_SMALL
from tests.replay import replayed


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_equals_batch_across_day_gaps(spark):
    # customers order on whole days with long silences: state expiry timers
    # fire and later events start from an empty state
    t = transactions_orders(spark, SF_SMALL)
    assert _same(stream_velocity_job(replayed(t, n_files=5)), velocity_features(t))


def test_disorder_within_watermark_delay(spark):
    """Rows of the last 30 minutes of each slice are moved to the next file
    (late relative to the previous batch, within a 2 h delay).  Every
    emitted row equals the batch row; rows not yet final stay pending."""
    t = transactions(spark, SF_MID)
    us = F.unix_micros(F.col("transaction_time").cast("timestamp"))
    lo, hi = t.agg(F.min(us), F.max(us)).first()
    width = (hi - lo) // 3 + 1
    slice_ = ((us - lo) / width).cast("int")
    late = (us - lo) - slice_ * width > width - 30 * 60 * 1_000_000
    landed = t.withColumn("_f", F.when(late & (slice_ < 2), slice_ + 1).otherwise(slice_))
    path = sources.scratch(spark, "disorder") + "/source"
    for i in range(3):
        part = (landed.where(F.col("_f") == i).drop("_f")
                .withColumn("transaction_time", F.col("transaction_time").cast("timestamp")))
        part.orderBy(F.rand(i)).coalesce(1).write.mode("append").parquet(path)
    base = path.rsplit("/", 1)[0]
    out = run.run_available(velocity.stream_velocity(sources.read_stream(spark, path),
                                                     delay="2 hours"), base)
    got = velocity.finish_velocity(spark.read.parquet(out))
    want = velocity_features(t)
    assert got.exceptAll(want).count() == 0
    cutoff = F.expr("max_t - INTERVAL 2 HOURS")
    final = want.crossJoin(want.agg(F.max("event_time").alias("max_t"))) \
        .where(F.col("event_time") < cutoff).drop("max_t")
    assert final.exceptAll(got).count() == 0


def test_progress_counters_and_csv_scan(spark, tmp_path):
    from riskwave.sources.tables import read_csv_transactions
    t = transactions(spark, SF_SMALL)
    base = sources.scratch(spark, "progress")
    s = run.observe_progress(replayed(t, n_files=4))
    out, q = run.run_available(s.select("transaction_id"), base, return_query=True)
    counts = run.processed_counts(q)
    assert counts[-1] == t.count() and counts == sorted(counts) and len(counts) == 4
    # CSV form of the scan: declared schema, time text parsed back
    csv = str(tmp_path / "csv")
    t.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(csv)
    back = read_csv_transactions(spark, csv)
    assert back.exceptAll(t).count() == 0 and t.exceptAll(back).count() == 0


def test_rows_behind_the_watermark_are_dropped(spark):
    """Two micro-batches; the second holds one row behind the first one's
    newest time (late, delay 0) and one ahead of it."""
    base = sources.scratch(spark, "late")
    schema = "transaction_id long, user_id long, transaction_time timestamp, amount double"
    at = lambda h: f"2024-01-01 {h:02d}:00:00"

    def land(rows):
        df = spark.createDataFrame(rows, "transaction_id long, user_id long, t string, amount double")
        df.selectExpr("transaction_id", "user_id", "cast(t as timestamp) as transaction_time", "amount") \
            .coalesce(1).write.mode("append").parquet(base + "/source")
    land([(1, 7, at(1), 1.0), (2, 7, at(5), 2.0), (3, 8, at(6), 3.0)])
    land([(4, 7, at(3), 4.0), (5, 7, at(7), 5.0)])
    from pyspark.sql.types import StructType
    stream = sources.read_stream(spark, base + "/source", StructType.fromDDL(schema))
    got = stream_velocity_job(stream)
    assert {r.transaction_id: r.txn_count_24h for r in got.collect()} == {1: 1, 2: 2, 3: 1, 5: 3}


def test_sessions_over_several_batches_are_complete(spark):
    from riskwave.operators.windows import user_sessions
    from riskwave.sources import transactions_ties
    from riskwave.streaming.jobs import sessions_job
    t = transactions(spark, SF_SMALL)
    assert _same(sessions_job(replayed(t, n_files=3)), user_sessions(t))
    hot = transactions_ties(spark, SF_SMALL)          # 7 users, many equal instants
    assert _same(sessions_job(replayed(hot, n_files=4)), user_sessions(hot))


def _landed(spark, base, batches):
    """A stream of one micro-batch per list of (id, user, "hh:mm", amount)."""
    from pyspark.sql.types import StructType
    for rows in batches:
        df = spark.createDataFrame([(i, u, f"2024-01-01 {t}:00", a) for i, u, t, a in rows],
                                   "transaction_id long, user_id long, t string, amount double")
        df.selectExpr("transaction_id", "user_id", "cast(t as timestamp) as transaction_time", "amount") \
            .coalesce(1).write.mode("append").parquet(base + "/source")
    schema = "transaction_id long, user_id long, transaction_time timestamp, amount double"
    return sources.read_stream(spark, base + "/source", StructType.fromDDL(schema))


def test_only_changed_sessions_are_emitted(spark):
    """Batches with a delay of 12 h: new, grown, untouched and joined sessions."""
    from riskwave.streaming.run import run_available_batches
    from riskwave.streaming.sessions import session_changes
    base = sources.scratch(spark, "session-changes")
    stream = _landed(spark, base, [
        [(1, 7, "01:00", 1.0), (2, 7, "03:00", 2.0), (3, 8, "01:00", 1.0)],
        [(4, 7, "03:30", 4.0), (5, 9, "05:00", 1.0)],
        [(6, 7, "02:00", 8.0)],                       # exactly an hour from both: joins them
        [(7, 7, "00:30", 16.0)]])
    seen = {}

    def write(batch, batch_id):
        rows = [(r.user_id, r.session_start.strftime("%H:%M"), r.session_end.strftime("%H:%M"), r.events, int(r.amount_sum))
                for r in batch.collect()]
        if rows:
            seen[batch_id] = sorted(rows)
    run_available_batches(session_changes(stream, delay="12 hours"), base, write)
    assert list(seen.values()) == [
        [(7, "01:00", "02:00", 1, 1), (7, "03:00", "04:00", 1, 2), (8, "01:00", "02:00", 1, 1)],
        [(7, "03:00", "04:30", 2, 6), (9, "05:00", "06:00", 1, 1)],
        [(7, "01:00", "04:30", 4, 15), (7, "03:00", "04:30", 0, 0)],
        [(7, "00:30", "04:30", 5, 31), (7, "01:00", "04:30", 0, 0)]]


def test_session_state_ends_behind_the_watermark(spark):
    from riskwave.streaming.jobs import sessions_job
    base = sources.scratch(spark, "session-late")
    got = sessions_job(_landed(spark, base, [
        [(1, 7, "01:00", 1.0), (2, 8, "05:00", 2.0)],
        [(3, 7, "01:30", 4.0), (4, 7, "05:30", 8.0), (5, 7, "05:30", 8.0)]]))      # 3 is late: dropped
    assert sorted((r.user_id, r.session_start.hour, r.events, int(r.amount_sum)) for r in got.collect()) == [
        (7, 1, 1, 1), (7, 5, 2, 16), (8, 5, 1, 2)]


def test_sliding_windows_are_made_of_panes(spark):
    """Over several batches: equal to a window of every row; the log holds
    panes and the windows take no exchange beside the one by user."""
    from riskwave.streaming.jobs import sliding_job
    from riskwave.streaming.windows import combine_panes
    t = transactions(spark, SF_SMALL)
    w = F.window(F.col("transaction_time").cast("timestamp"), "24 hours", "1 hour")
    want = t.groupBy("user_id", w["start"].cast("timestamp_ntz").alias("window_start"),
                     w["end"].cast("timestamp_ntz").alias("window_end")) \
        .agg(F.count("*").alias("txn_count"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("decimal(38,2)").alias("amount_sum"))
    assert _same(sliding_job(replayed(t, n_files=3)), want)
    panes = spark.createDataFrame([], "user_id long, window_start timestamp_ntz, window_end timestamp_ntz, "
                                      "txn_count long, amount_sum decimal(38,2)")
    plan = combine_panes(panes.repartition(3))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") <= 2


def test_late_rows_go_to_the_side_output(spark):
    import datetime as dt

    from riskwave.streaming.jobs import late_data_job
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, at(1), 0), (2, at(9), 0), (3, at(6), 1), (4, at(7), 1), (5, at(8), 1), (6, at(8), 1),
            (7, at(20), 2), (8, at(7), 2), (9, None, 2), (10, at(12), 3), (11, at(18), 3)]
    df = spark.createDataFrame(rows, "transaction_id long, transaction_time timestamp_ntz, arrival_slice long").repartition(3)
    got = {r.transaction_id: (r.arrival_batch, r.watermark, r.late) for r in late_data_job(df, dt.timedelta(hours=2)).collect()}
    mark, want = None, {}
    for b in range(4):
        own = [r for r in rows if r[2] == b]
        want |= {i: (b, mark, t is not None and mark is not None and t < mark) for i, t, _ in own}
        mark = max([t - dt.timedelta(hours=2) for _, t, _ in own if t] + ([mark] if mark else []))
    assert got == want and sum(x[2] for x in got.values()) == 2


def test_a_repeated_batch_writes_the_same_outputs(spark):
    import datetime as dt

    from riskwave.streaming import late
    base = sources.scratch(spark, "late-again")
    write = late.splitter(base, dt.timedelta(hours=1))
    batch = [spark.createDataFrame([(i, dt.datetime(2024, 1, 1, h)) for i, h in rows], "id long, transaction_time timestamp_ntz")
             for rows in ([(1, 5)], [(2, 3), (3, 8)], [(4, 6)])]
    for k in (0, 1, 0, 1, 2, 1, 2):
        write(batch[k], k)
    assert sorted((r.id, r.late) for r in late.outputs(spark, base).collect()) == [(1, False), (2, True), (3, False), (4, True)]


def test_stream_state_before_each_request_equals_the_lookup(spark):
    """Several micro-batches, ties, day gaps (state older than its life)."""
    from riskwave.operators.state import asof_state_lookup
    from riskwave.sources import transactions_ties
    for t in (transactions_orders(spark, SF_SMALL), transactions_ties(spark, SF_SMALL)):
        base = sources.scratch(spark, "serving")
        got = spark.read.parquet(run.run_available(velocity.stream_serving(replayed(t, n_files=4)), base))
        want = asof_state_lookup(t, velocity_features(t), carry=t.columns)
        assert got.where("state_time is not null").count() > 0 and _same(got.select(*want.columns), want)


def test_stream_hot_keys_with_ties(spark):
    # 7 users, hour-truncated times: large per-key micro-batches, many ties
    from riskwave.sources import transactions_ties
    t = transactions_ties(spark, SF_MID)
    assert _same(stream_velocity_job(replayed(t, n_files=4)), velocity_features(t))


def test_shuffled_files_in_several_batches_lose_no_row(spark, tmp_path, monkeypatch):
    """Every file spans the whole time range and each file is a micro-batch
    of its own, as with a table of several times the batch size."""
    from riskwave.queries import QUERIES
    from riskwave.sources import transactions_core
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(4, "event_id") \
        .write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(sources, "MICRO_BATCH_BYTES", 1)
    monkeypatch.setattr(sources, "ORDERED_FILE_BYTES", 10_000, raising=False)
    t = transactions_core(spark, str(tmp_path))
    assert _same(QUERIES["stream_velocity"](spark, str(tmp_path)), velocity_features(t))
    hour = F.window(F.col("transaction_time").cast("timestamp"), "1 hour")
    want = t.groupBy("user_id", hour["start"].cast("timestamp_ntz").alias("window_start")) \
        .agg(F.count("*").alias("txn_count"))
    got = QUERIES["tumbling_1h"](spark, str(tmp_path))
    assert got.count() > 0 and _same(got.select(*want.columns), want)


class _Calls:
    """State handle that counts its calls; all variables are lists of rows."""

    def __init__(self):
        self.rows, self.timers, self.calls = {}, set(), []

    def getListState(self, name, schema):
        return _Variable(self, name)

    getValueState = getListState

    def listTimers(self):
        self.calls.append("listTimers")
        return iter(sorted(self.timers))

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)


class _Variable:
    def __init__(self, handle, name):
        self.h, self.name = handle, name

    def get(self):
        self.h.calls.append(self.name + ".get")
        rows = self.h.rows.get(self.name)
        return (rows if self.name == "last" else iter(rows or []))

    def put(self, rows):
        self.h.calls.append(self.name + ".put")
        self.h.rows[self.name] = rows

    update = put

    def clear(self):
        self.h.calls.append(self.name + ".clear")
        self.h.rows.pop(self.name, None)


def test_a_visit_makes_only_the_state_calls_it_needs():
    from types import SimpleNamespace

    import pandas as pd

    from riskwave.streaming.velocity import VelocityProcessor
    hour = 3_600_000_000
    at = lambda us: SimpleNamespace(getCurrentWatermarkInMs=lambda: us // 1000)     # noqa: E731
    p, h = VelocityProcessor(), _Calls()
    p.init(h)
    rows = pd.DataFrame({"transaction_id": [2, 1, 2], "event_us": [2 * hour, hour, 2 * hour], "cents": [20, 10, 20]})
    assert list(p.handleInputRows((5,), iter([rows]), at(0))) == []
    assert h.calls == ["pending.get", "last.get", "pending.put"] and h.timers == {hour // 1000}
    h.calls.clear()
    out, = p.handleExpiredTimer((5,), at(2 * hour), None)
    assert out["transaction_id"].tolist() == [1, 2] and out["n24"].tolist() == [1, 2]
    assert h.rows == {"seen": [(hour, 1, 10), (2 * hour, 2, 20)], "last": (2 * hour, 2)}
    assert h.timers == {26 * hour // 1000 + 1}
    assert list(p.handleExpiredTimer((5,), at(27 * hour), None)) == [] and not h.rows and not h.timers


def test_window_jobs_hold_a_bounded_batch(spark, monkeypatch):
    """Window jobs take smaller micro-batches than the keyed ones, and the files of both are small."""
    from pathlib import Path

    from riskwave.queries import QUERIES
    assert sources.ORDERED_FILE_BYTES <= 16 << 20
    want = QUERIES["tumbling_1h"](spark, SF_SMALL)
    bases = []
    scratch = sources.scratch
    monkeypatch.setattr(sources, "scratch", lambda s, tag: bases.append(scratch(s, tag)) or bases[-1])
    monkeypatch.setattr(sources, "WINDOW_BATCH_BYTES", 1)
    monkeypatch.setattr(sources, "ORDERED_FILE_BYTES", 10_000)
    assert _same(QUERIES["tumbling_1h"](spark, SF_SMALL), want)
    base = next(b for b in bases if "/tumbling-" in b).removeprefix("file:")
    assert len([f for f in Path(base, "checkpoint/offsets").iterdir() if f.name.isdigit()]) > 1
