"""A kept table of keyed state: one row per key, written by micro-batches,
bucketed by key, merged by levels and published by a manifest.

* A batch is reduced to its newest row per key and written as one run of
  level 0.  ``fanout`` runs of a level are merged into one run of the next, so
  a read meets fewer than ``fanout`` runs a level and the levels grow with the
  logarithm of the batches.
* All runs are partitions of one table bucketed by key: the newest row per
  key needs no exchange, a read of one key opens one bucket of each run, and a
  join with the table moves only the other side.
* "Newest" is the largest ``order`` value, whatever the order of arrival (a
  later batch wins among equal ones).  A row with ``deleted`` is a tombstone.
  State lives ``ttl`` after its time, seen from the newest row of the table.
  Rows beyond it are never shown, and a merge leaves them out, tombstones
  among them: whatever such a row could hide is older still.
* A manifest names the runs of a version.  It is written aside and renamed to
  its number, which fails if that number is taken, so a reader sees a whole
  version or the one before it, and a second writer is refused.  The rename
  must be atomic in the store, as for stream checkpoints.  Runs not
  named by the last ``KEEP`` versions are deleted after each commit.

A batch number up to the last one applied is a replay and is skipped.  An empty
batch publishes its number only.  A null key is a key like any other."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskwave.plans import files

BUCKETS = 16          # of a new table; choose for the expected number of keys
FANOUT = 4
KEEP = 2              # versions whose runs stay for readers
_OWN = ("_run", "_seq", "deleted")


class StateTable:
    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], ttl: dt.timedelta,
                 buckets: int = BUCKETS, fanout: int = FANOUT):
        """``order``: the time column first, then columns that break its ties."""
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, list(order)
        self.ttl_us = ttl // dt.timedelta(microseconds=1)
        self.buckets, self.fanout = buckets, fanout
        self.name = "riskwave_state_" + hashlib.sha256(self.path.encode()).hexdigest()[:20]

    # ---- versions -------------------------------------------------------------

    def manifest(self) -> dict:
        names = files.names(self.spark, self.path + "/manifest")
        done = sorted(n for n in names if n.endswith(".json"))
        if not done:
            return {"version": 0, "applied": -1, "newest_us": None, "schema": None, "runs": []}
        return json.loads(files.read_text(self.spark, f"{self.path}/manifest/{done[-1]}"))

    def _publish(self, m: dict) -> None:
        m = m | {"version": m["version"] + 1}
        files.publish_text(self.spark, f"{self.path}/manifest/{m['version']:012d}.json", json.dumps(m))
        self._forget(m["version"])

    def _forget(self, version: int) -> None:
        """Delete versions before the kept ones, and every run that no kept
        version names: absorbed ones and those of attempts that failed."""
        folder = self.path + "/manifest"
        kept = set()
        for name in files.names(self.spark, folder):
            if not name.endswith(".json"):
                continue
            if int(name[:12]) > version - KEEP:
                kept |= {r["run"] for r in json.loads(files.read_text(self.spark, f"{folder}/{name}"))["runs"]}
            else:
                files.delete(self.spark, f"{folder}/{name}")
        for name in files.names(self.spark, self.path + "/rows"):
            run = name.removeprefix("_run=")
            if run != name and run not in kept:
                self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (_run = '{run}')")
                files.delete(self.spark, f"{self.path}/rows/{name}")

    # ---- rows -----------------------------------------------------------------

    def _time_us(self):
        return F.unix_micros(F.col(self.order[0]).cast("timestamp"))

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The newest row per key, tombstones included (a partial aggregate)."""
        rest = [c for c in rows.columns if c not in (self.key, "_run")]
        best = F.max_by(F.struct(*rest), F.struct(*self.order, "_seq", "deleted"))
        return rows.groupBy(self.key).agg(best.alias("_r")).select(self.key, "_r.*")

    def _register(self, m: dict) -> None:
        """Make the runs of a version known to this session's catalog."""
        if not self.spark.catalog.tableExists(self.name):
            fields = T.StructType.fromJson(json.loads(m["schema"])).fields
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, _run STRING) USING parquet "
                           f"PARTITIONED BY (_run) CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS "
                           f"LOCATION '{self.path}/rows'")
        if m["runs"]:
            parts = " ".join(f"PARTITION (_run = '{r['run']}')" for r in m["runs"])
            self.spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS {parts}")

    def _runs(self, m: dict, runs: list[dict]) -> DataFrame:
        self._register(m)
        return self.spark.table(self.name).where(F.col("_run").isin([r["run"] for r in runs]))

    def _write(self, rows: DataFrame, level: int) -> dict:
        run = f"{level}-{uuid.uuid4().hex[:16]}"
        (rows.withColumn("_run", F.lit(run)).repartition(self.buckets, self.key)
             .write.mode("append").format("parquet").partitionBy("_run").bucketBy(self.buckets, self.key)
             .option("path", self.path + "/rows").saveAsTable(self.name))
        return {"run": run, "level": level}

    # ---- writing --------------------------------------------------------------

    def apply(self, batch: DataFrame, batch_id: int) -> bool:
        """Upsert a batch (and delete the keys of rows with ``deleted``); false
        if it was applied before."""
        m = self.manifest()
        if batch_id <= m["applied"]:
            return False
        if m["schema"]:
            self._register(m)
        if "deleted" not in batch.columns:
            batch = batch.withColumn("deleted", F.lit(False))
        rows = self._newest(batch.withColumn("_seq", F.lit(batch_id).cast("long")))
        schema = m["schema"] or rows.schema.json()
        rows = rows.select(*T.StructType.fromJson(json.loads(schema)).names)
        run = self._write(rows, 0)
        m = m | {"schema": schema, "applied": batch_id}
        n, newest = self._runs(m | {"runs": [run]}, [run]).agg(F.count(F.lit(1)), F.max(self._time_us())).first()
        if n:
            times = [t for t in (m["newest_us"], newest) if t is not None]
            m = self._merged(m | {"runs": m["runs"] + [run], "newest_us": max(times, default=None)})
        self._publish(m)
        return True

    def _merged(self, m: dict) -> dict:
        """Merge every full level into the next one."""
        level = 0
        while any(r["level"] >= level for r in m["runs"]):
            full = [r for r in m["runs"] if r["level"] == level]
            if len(full) >= self.fanout:
                rows = self._alive(self._newest(self._runs(m, full)), m)
                rest = [r for r in m["runs"] if r["level"] != level]
                m = m | {"runs": rest + [self._write(rows, level + 1)]}
            level += 1
        return m

    def _alive(self, rows: DataFrame, m: dict) -> DataFrame:
        if m["newest_us"] is None:
            return rows
        return rows.where(self._time_us() >= m["newest_us"] - self.ttl_us)

    # ---- reading --------------------------------------------------------------

    def read(self, key=None) -> DataFrame:
        """The live state: one row per key, of the newest version.  With
        ``key`` only that key's row, from its bucket."""
        m = self.manifest()
        if not m["schema"]:
            raise ValueError("no batch has been applied to " + self.path)
        rows = self._runs(m, m["runs"])
        if key is not None:
            rows = rows.where(F.col(self.key) == F.lit(key))
        live = self._alive(self._newest(rows), m).where(~F.col("deleted"))
        return live.drop(*_OWN)


def writer(table: StateTable, prepare=lambda batch: batch):
    """``foreachBatch`` function that keeps ``table``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        table.apply(prepare(batch), batch_id)
    return write
