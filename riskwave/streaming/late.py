"""Late rows as a side output, with an explicit watermark.

Rows arrive in batches.  The watermark of a batch is the running maximum,
over all batches before it, of their newest event time, less the allowed
delay.  A batch's rows behind its watermark go to the side output, all others
to the main output; then the batch moves the watermark.  Both outputs and the
watermark are written per batch, the watermark last, and read from earlier
batches only, so a batch that runs again writes the same files again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "batch long, watermark timestamp_ntz"


def _marks(spark: SparkSession, base: str) -> DataFrame:
    try:
        return spark.read.schema(MARK).parquet(f"{base}/watermarks/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MARK)


def splitter(base: str, delay: dt.timedelta, time_col: str = "transaction_time"):
    """A ``foreachBatch`` function that writes ``base``/main, /late and
    /watermarks."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = _marks(spark, base).where(F.col("batch") < batch_id).agg(F.max("watermark")).first()[0]
        newest = batch.agg(F.max(F.col(time_col).cast("timestamp_ntz"))).first()[0]      # one scalar
        watermark = F.lit(mark).cast("timestamp_ntz")
        late = F.coalesce(F.col(time_col).cast("timestamp_ntz") < watermark, F.lit(False))
        rows = batch.withColumn("arrival_batch", F.lit(batch_id).cast("long")).withColumn("watermark", watermark)
        rows.where(~late).write.mode("overwrite").parquet(f"{base}/main/{batch_id}")
        rows.where(late).write.mode("overwrite").parquet(f"{base}/late/{batch_id}")
        moved = max((t for t in (mark, newest - delay if newest is not None else None) if t is not None), default=None)
        spark.createDataFrame([(batch_id, moved)], MARK).coalesce(1) \
            .write.mode("overwrite").parquet(f"{base}/watermarks/{batch_id}")
    return write


def outputs(spark: SparkSession, base: str) -> DataFrame:
    """Both outputs as one table with a ``late`` flag."""
    main, side = (spark.read.parquet(f"{base}/{kind}/*").withColumn("late", F.lit(kind == "late"))
                  for kind in ("main", "late"))
    return main.unionByName(side)
