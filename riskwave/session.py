"""SparkSession construction with the settings every plan here assumes."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators rely on for correctness (UTC wall clock, ANSI
# arithmetic) and for scale (AQE coalescing, skew-join splitting,
# runtime broadcast conversion only under the size threshold).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Sizing for a large cluster (~100 TB input, ~1000 executors).  Shuffle
# partitions start high and AQE coalesces them to ~256 MB; skewed shuffle
# partitions over 5x the median are split; scans read 512 MB splits.
# Applied by ``cluster_settings`` only where the submitter left them unset.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "16000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def cluster_settings(spark: SparkSession) -> None:
    for k, v in CLUSTER_CONF.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "riskwave", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session.  ``master`` is only set for local runs;
    on a cluster the submitter decides."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.master.startswith("local"):
        cluster_settings(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/DBFS)
    folder and we only read it.  Only when it is unset -- local tests --
    do we point it at a fresh scratch folder of our own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="riskwave-ckpt-", dir=os.environ.get("RISKWAVE_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``riskwave`` importable in Python workers (the code behind
    ``mapInPandas`` / stateful processors), as ``--py-files`` would."""
    import shutil
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="riskwave-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "riskwave"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="riskwave")
    sc.addPyFile(archive)
    _SHIPPED.add(id(sc))
