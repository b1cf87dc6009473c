"""Bounded labelled samples for the classifiers trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """Fifth of the ids that no training sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _clean(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    return (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
            .groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("label")))


def class_totals(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> dict[int, int]:
    """Number of training ids of each class: the shares that calibration restores."""
    return {r.label: r["count"] for r in _clean(labels, label_col, id_col).groupBy("label").count().collect()}


def labelled_sample(labels: DataFrame, label_col: str, rows_per_class: int,
                    id_col: str = "doc_id") -> DataFrame:
    """At most ``rows_per_class`` training ids of each class (0 and 1), the
    ones with the smallest hash: (doc_id, label).  Rows without id or with
    another label are ignored; an id with both labels counts as 0."""
    clean = _clean(labels, label_col, id_col)
    parts = [clean.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
             for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def with_text(sample: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of the sample, one row an id (the smallest text
    of repeated ids).  The sample is bounded by its own limit, so it is the
    broadcast side of the scan over the documents."""
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
            .join(F.broadcast(sample), "doc_id")
            .groupBy("doc_id", "label").agg(F.min("text").alias("text")))
