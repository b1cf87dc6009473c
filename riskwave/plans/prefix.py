"""Running counts and sums in a global or per-key order, without a
single-partition window and without one task per hot key.

Plan: range-partition on ``(keys..., order...)`` (sampled bounds, so a
key holding a third of the rows spans many partitions) and write the rows
with the number of their partition to the shared checkpoint folder.  Both
branches below read that table, so a row's partition is a stored value
and not a property of a plan that could differ between two evaluations.
Running values inside a ``(partition, key)`` group are built-in windows;
the exclusive prefix of the key's earlier partitions is then added.  Only
the first key of a range partition can continue from an earlier one, so
the offsets table has at most one row per partition and is broadcast (a
bound by construction).

Sum inputs must be integral (counts, cents): the result is then exact
and independent of the order of additions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskwave.plans.lineage import shared_path


def _ranged(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """``df`` with ``_pid``, the stored number of its range partition."""
    path = shared_path(df.sparkSession, f"prefix/{uuid.uuid4().hex}")
    df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def keyed_prefix(df: DataFrame, keys: list[str], order: list[str], sums: list[str] = (),
                 rn_col: str = "rn", n_parts: int | None = None,
                 lags: list[str] = (), resets: list[str] = (), keep_pid: bool = False) -> DataFrame:
    """Add ``rn_col`` (1-based position within the key in ``order``),
    ``running_<c>`` for each integral column ``c`` in ``sums``,
    ``prev_<c>`` (the value on the previous row of the key, null on the
    first) for each column in ``lags`` and ``seg_<c>`` (rows since the
    latest row of the key with flag ``c`` = 1, itself included, or since
    the key's start) for each column in ``resets``.
    ``order`` must be a total order within a key (end it with an id).  With
    ``keep_pid`` the result holds the stored partition number ``_pid``; a later
    pass over the same keys and order that finds it goes on with that
    partitioning, without another range shuffle or written table."""
    keys, order = list(keys), list(order)
    n = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df if "_pid" in df.columns else _ranged(df, keys, order, n)
    inside = Window.partitionBy("_pid", *keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        "*", F.row_number().over(inside).cast("long").alias("_rn"),
        *[F.sum(F.col(c).cast("long")).over(upto).alias("_sum_" + c) for c in sums],
        *[F.lag(c).over(inside).alias("_lag_" + c) for c in lags])
    if resets:
        local = local.select("*", *[F.max(F.when(F.col(c) == 1, F.col("_rn"))).over(upto).alias("_at_" + c)
                                    for c in resets])
    totals = local.groupBy("_pid", *keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.col(c).cast("long")).alias("_t_" + c) for c in sums],
        *[F.max_by(F.struct(c), "_rn").alias("_z_" + c) for c in lags],
        *[F.max("_at_" + c).alias("_f_" + c) for c in resets])
    by_part = Window.partitionBy(*keys).orderBy("_pid")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_o_n", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = totals.select(
        F.col("_pid").alias("_o_pid"), *[F.col(k).alias("_k_" + k) for k in keys], "_o_n",
        *[F.coalesce(F.sum("_t_" + c).over(before), F.lit(0)).alias("_o_" + c) for c in sums],
        *[F.lag("_z_" + c).over(by_part).getField(c).alias("_q_" + c) for c in lags],
        # position (within the key) of the latest flagged row of earlier partitions
        *[F.coalesce(F.max(F.col("_o_n") + F.col("_f_" + c)).over(before), F.lit(1)).alias("_g_" + c)
          for c in resets])
    offsets = F.broadcast(offsets.where(F.col("_o_n") > 0))
    same = F.col("_pid") == F.col("_o_pid")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_k_" + k))
    j = local.join(offsets, same, "left")
    shift = F.coalesce(F.col("_o_n"), F.lit(0))
    rn = F.col("_rn") + shift
    out = [F.col(c) for c in df.columns if c != "_pid"] + [rn.alias(rn_col)]
    out += [F.col("_pid")] if keep_pid else []
    out += [(F.col("_sum_" + c) + F.coalesce(F.col("_o_" + c), F.lit(0))).alias("running_" + c) for c in sums]
    out += [F.when(F.col("_rn") == 1, F.col("_q_" + c)).otherwise(F.col("_lag_" + c)).alias("prev_" + c)
            for c in lags]
    out += [(rn - F.coalesce(F.col("_at_" + c) + shift, F.col("_g_" + c), F.lit(1)) + 1).alias("seg_" + c)
            for c in resets]
    return j.select(*out)
