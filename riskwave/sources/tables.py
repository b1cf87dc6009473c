"""Readers for the raw parquet tables.  Column selection is left to
Catalyst: every reader returns the lazily scanned table so that the
projection and filters of the consuming plan reach the parquet scan
(``ReadSchema`` / ``PushedFilters`` in ``explain``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def write_csv_transactions(txn: DataFrame, path: str) -> None:
    """The CSV form that ``read_csv_transactions`` reads, times in full."""
    txn.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)


def read_csv_transactions(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV form of the transactions scan: declared schema, no inference,
    ``NA`` read as a real value rather than null (empty field = null),
    time parsed as a UTC timestamp."""
    from riskwave.sources.fixtures import TXN_SCHEMA_CSV
    from pyspark.sql import functions as F
    df = (spark.read.schema(schema or TXN_SCHEMA_CSV)
          .option("header", True).option("nullValue", "")
          .option("mode", "FAILFAST").csv(path))
    return df.withColumn("transaction_time",
                         F.to_timestamp_ntz(F.col("transaction_time")))
