"""The kept state table: equal to a full resolve of all batches, few runs,
replays and second writers, one bucket for one key, no exchange of the state
in a join."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from riskwave.operators import state as st
from riskwave.plans import files
from riskwave.streaming.sources import scratch
from riskwave.streaming.state_table import StateTable

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, event_time timestamp_ntz, id long, v long, deleted boolean"
TTL = dt.timedelta(hours=24)


def table(spark, path=None, **kw):
    return StateTable(spark, path or scratch(spark, "state-table-test"), "user_id", ["event_time", "id"], TTL,
                      **{"buckets": 4, "fanout": 3, **kw})


def row(user, hours, i, v=0, deleted=False):
    return (user, T0 + dt.timedelta(hours=hours), i, v, deleted)


def resolved(batches):
    """Newest row per key over all batches, live ones only."""
    best = {}
    for seq, rows in enumerate(batches):
        for r in rows:
            rank = (r[1], r[2], seq, r[4])
            if r[0] not in best or rank >= best[r[0]][0]:
                best[r[0]] = (rank, r)
    newest = max((r[1] for rows in batches for r in rows), default=T0)
    return {r[:4] for _, r in best.values() if not r[4] and r[1] >= newest - TTL}


def rows_of(df):
    return {(r.user_id, r.event_time, r.id, r.v) for r in df.collect()}


def test_equals_a_full_resolve_after_every_batch(spark):
    rng = random.Random(7)
    t, batches, seen = table(spark), [], set()
    for b in range(11):
        batches.append([row(rng.choice([None, *range(12)]), b * 5 + rng.randint(-30, 5), b * 100 + i, rng.randint(0, 9),
                            rng.random() < 0.2) for i in range(rng.choice([0, 1, 8, 15]))])
        assert t.apply(spark.createDataFrame(batches[-1], SCHEMA), b)
        assert rows_of(t.read()) == resolved(batches[:b + 1])
        levels = [r["level"] for r in t.manifest()["runs"]]
        assert all(levels.count(x) < 3 for x in levels)
        seen |= set(levels)
        # superseded runs and versions are gone, up to those a reader may hold
        kept = [n for n in files.names(spark, t.path + "/manifest") if n.endswith(".json")]
        named = {r["run"] for n in kept
                 for r in json.loads(files.read_text(spark, f"{t.path}/manifest/{n}"))["runs"]}
        stored = {n[5:] for n in files.names(spark, t.path + "/rows") if n.startswith("_run=")}
        assert len(kept) <= 2 and stored <= named
    assert max(seen) >= 1


def test_replay_second_writer_and_new_session(spark):
    t = table(spark)
    first = spark.createDataFrame([row(1, 0, 1, 5), row(1, 0, 1, 6), row(2, 1, 2, 7)], SCHEMA)
    assert t.apply(first, 0)
    assert not t.apply(spark.createDataFrame([row(1, 9, 9, 9)], SCHEMA), 0)
    before = rows_of(t.read())
    stale = t.manifest()
    assert t.apply(spark.createDataFrame([row(3, 2, 3, 8)], SCHEMA), 1)
    with pytest.raises(FileExistsError):
        t._publish(stale)
    spark.sql(f"DROP TABLE {t.name}")                                   # a session that has never seen the table
    again = table(spark, t.path)
    assert rows_of(again.read()) == before | {row(3, 2, 3, 8)[:4]}
    assert again.apply(spark.createDataFrame([row(2, 3, 4, 0, True)], SCHEMA), 2)
    assert {r[0] for r in rows_of(again.read())} == {1, 3}
    with pytest.raises(ValueError):
        table(spark).read()


def test_a_run_without_manifest_is_not_read(spark):
    t = table(spark)
    t.apply(spark.createDataFrame([row(1, 0, 1, 5)], SCHEMA), 0)
    t._write(spark.createDataFrame([row(1, 9, 9, 9)], SCHEMA).withColumn("_seq", F.lit(9).cast("long"))
             .select("user_id", "event_time", "id", "v", "deleted", "_seq"), 0)
    assert rows_of(t.read()) == {row(1, 0, 1, 5)[:4]}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    t = table(spark, buckets=16)
    for b in range(2):
        t.apply(spark.range(200).selectExpr("id as user_id", f"timestamp_ntz'2024-01-01 00:00:00' + interval {b} hour as event_time",
                                            "id", "id as v"), b)
    one = t.read(key=77)
    assert [r.v for r in one.collect()] == [77]
    assert "SelectedBucketsCount: 1 out of 16" in plan(one)
    assert "Exchange" not in plan(t.read())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.range(1000).select((F.col("id") % 250).alias("user_id"), "id")
        j = asked.join(t.read().select("user_id", "v"), "user_id", "left")
        assert j.where("v is not null").count() == 800
        assert len(re.findall(r"Exchange hashpartitioning", plan(j))) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_of_the_kept_table_computes_no_velocity(spark):
    from riskwave.queries import QUERIES
    from tests.conftest import SF_SMALL
    q = QUERIES["state_table_lookup"](spark, SF_SMALL)
    assert "Window" not in plan(q) and "prefix" not in plan(q)
    want = QUERIES["state_lookup"](spark, SF_SMALL).select(*q.columns)
    assert q.exceptAll(want).count() == 0 and want.exceptAll(q).count() == 0
    assert st.STATE_FEATURES[0] in q.columns
