"""Lineage cuts that survive executor loss.

Never ``localCheckpoint`` (lost with the executor that held it); a
reliable ``checkpoint()`` writes to the shared folder the cluster names
in ``spark.checkpoint.dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskwave.session import ensure_checkpoint_dir


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint.  The input is persisted around the write so the
    checkpoint does not compute it a second time; a lost cached block is
    simply recomputed from lineage before the files are written."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = kept.checkpoint(eager=eager)
    if eager:
        kept.unpersist()
    return out


def shared_path(spark, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}"
