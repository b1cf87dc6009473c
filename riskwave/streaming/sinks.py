"""Keyed upsert sink for ``foreachBatch``: every micro-batch appends its
updated rows, tagged with the batch id, to a change log in the shared
checkpoint area; the current table resolves the newest row per key
(``max_by`` -- a partial aggregate).  A replayed batch re-appends equal
rows, so resolution stays idempotent; Parquet job commits are atomic, so
a failed attempt leaves nothing behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert_log_writer(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("append").parquet(path)
    return write


def resolve(spark: SparkSession, path: str, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Current table: per key the row of the newest batch (then the
    largest ``order`` value inside a batch)."""
    log = spark.read.parquet(path)
    cols = [c for c in log.columns if c not in keys and c != "_batch"]
    rank = F.struct(F.col("_batch"), *[F.col(c) for c in (order or [])])
    return (log.groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("_r"))
               .select(*keys, *[F.col("_r." + c).alias(c) for c in cols]))
