"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskwave.plans.lineage import shared_path
from riskwave.session import ship_package

# Characters of text handled by one vectorised step; bounds the scratch
# arrays of a task whatever the size of its partition.
CHUNK_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and
    read it back: cuts the lineage with files that outlive any executor."""
    path = shared_path(df.sparkSession, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers."""
    ship_package(spark)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two columns that identify a row up to rows that are equal in both id
    and text; such repeated rows always get the same result."""
    return [F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th")]


def same_key(left: DataFrame, right: DataFrame) -> Column:
    return left["_id"].eqNullSafe(right["_id"]) & (left["_th"] == right["_th"])


def text_runs(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Split a batch into runs (offset, texts) of at most ``limit``
    characters; a longer text forms a run of its own."""
    run, size, start = [], 0, 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > limit:
            yield start, run
            run, size, start = [], 0, i
        run.append(t)
        size += len(t)
    if run:
        yield start, run


def emit(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type)
         for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


def give_back() -> None:
    """Return this worker's freed memory to the system.  Python workers are
    used again by later tasks, and what the allocators keep counts beside
    those tasks' own arrays and the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc alone has it
    if trim is not None:
        trim(0)


def rows_estimate(df: DataFrame, per_part: int, least: int = 1) -> int:
    """Number of groups of about ``per_part`` rows (one counting job)."""
    return max(least, -(-df.count() // per_part))


def quiet_tokenizers() -> None:
    """One thread per task: Spark's tasks already use every core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
