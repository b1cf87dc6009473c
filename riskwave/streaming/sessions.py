"""Sessions of a transaction stream, kept as merge state.

Per user the state is the list of sessions that can still grow:
``(first, last, events, cents)``.  A micro-batch's rows of a user are reduced
to runs chunk by chunk and merged into that list; two sessions that a new
row joins become one.  Only sessions that changed are emitted, so what is
written follows the batch and not the table: the new form of a session under
``(user, session start)``, and a row with 0 events for a start that a merge
has swallowed.  The upsert log resolves them.

Rows behind the watermark are dropped.  A session whose gap lies behind the
watermark cannot grow and leaves the state; a timer does it for users that
stay silent.  Runs whose gap is exactly the session gap belong together, as
in the batch operator.  Equal times and repeated rows count one by one.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from riskwave.operators.velocity import HOUR_US, MONEY
from riskwave.streaming.velocity import ensure_rocksdb

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGES = T.StructType([T.StructField(c, T.LongType()) for c in ("user_id", "first", "last", "events", "cents")])


def runs(us: np.ndarray, cents: np.ndarray, gap: int) -> list[tuple[int, int, int, int]]:
    """(first, last, events, cents) of each run without a longer gap."""
    order = np.argsort(us, kind="stable")
    us, cents = us[order], cents[order]
    begin = np.concatenate(([0], np.flatnonzero(np.diff(us) > gap) + 1))
    end = np.concatenate((begin[1:], [len(us)]))
    return list(zip(us[begin].tolist(), us[end - 1].tolist(), (end - begin).tolist(),
                    np.add.reduceat(cents, begin).tolist()))


def merge(sessions: list[tuple[int, int, int, int]], gap: int) -> list[tuple[int, int, int, int]]:
    """Sessions joined wherever they overlap or lie at most ``gap`` apart."""
    out: list[tuple[int, int, int, int]] = []
    for first, last, events, cents in sorted(sessions):
        if out and first <= out[-1][1] + gap:
            f, l, e, c = out[-1]
            out[-1] = (f, max(l, last), e + events, c + cents)
        else:
            out.append((first, last, events, cents))
    return out


class SessionProcessor(StatefulProcessor):
    def __init__(self, gap_us: int = HOUR_US):
        self.gap = gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, events long, cents long")

    def _kept(self, watermark_ms: int) -> list[tuple[int, int, int, int]]:
        return [tuple(map(int, s)) for s in self.open.get() if (int(s[1]) + self.gap) // 1000 >= watermark_ms]

    def _store(self, sessions) -> None:
        if sessions:
            self.open.put(sessions)
            self.handle.registerTimer((max(s[1] for s in sessions) + self.gap) // 1000 + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        before = self._kept(mark)
        now = before
        for chunk in rows:
            us, cents = (chunk[c].to_numpy(dtype=np.int64) for c in ("event_us", "cents"))
            timely = us // 1000 >= mark
            if timely.any():
                now = merge(now + runs(us[timely], cents[timely], self.gap), self.gap)
        if now == before:
            return
        self._store(now)
        starts = {s[0] for s in now}
        changed = sorted(set(now) - set(before)) + [(s[0], s[1], 0, 0) for s in before if s[0] not in starts]
        frame = pd.DataFrame(changed, columns=CHANGES.names[1:])
        frame.insert(0, "user_id", int(key[0]))
        yield frame.astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        kept = self._kept(timerValues.getCurrentWatermarkInMs())
        if kept:
            self.open.put(kept)
        else:
            self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def session_changes(stream: DataFrame, gap_us: int = HOUR_US, delay: str = "0 seconds") -> DataFrame:
    """Changed sessions of each micro-batch: user_id, session_start,
    session_end, events (0: this start is no session any more), amount_sum."""
    ensure_rocksdb(stream.sparkSession)
    src = (stream.withWatermark("transaction_time", delay)
           .select("user_id", "transaction_time", F.unix_micros("transaction_time").alias("event_us"),
                   (F.col("amount").cast(MONEY) * 100).cast("long").alias("cents")))
    raw = src.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=SessionProcessor(gap_us), outputStructType=CHANGES, outputMode="Update",
        timeMode="EventTime")
    return raw.select("user_id", F.timestamp_micros("first").alias("session_start"),
                      F.timestamp_micros(F.col("last") + gap_us).alias("session_end"), "events",
                      (F.col("cents").cast("decimal(36,0)") / 100).cast("decimal(38,2)").alias("amount_sum"))
