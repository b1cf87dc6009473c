"""Exact order statistics without a sort.

A wanted rank of a group starts with the span of all the group's values.
Every pass counts the values of each open span in equal bins (a partial
aggregate: at most ``bins`` rows per span and task are shuffled, with each
bin's count, least and greatest value) and the rank moves on to the least and
greatest value of the bin it falls in, until the two are equal.  A value that
many rows share is one value of its bin, however many there are.  The ends of
a span lie in different bins, so every pass narrows; each divides the width by
the number of bins, so some passes over the table replace its range exchange.

Nulls and values that are not finite take no part.  Ranks outside a group's
number of values give no row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskwave.plans.broadcast import bounded_broadcast
from riskwave.plans.lineage import cut_lineage

BINS = 4096


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)], F.lit(True))


def order_statistics(rows: DataFrame, value: str, ranks: DataFrame, groups: list[str], bins: int = BINS) -> DataFrame:
    """``ranks`` (groups..., target, rank; 1 is the least value) -> groups...,
    target and ``value``, the value of that rank in its group."""
    v = F.col(value)
    finite = v.isNotNull() & (v.cast("double") > float("-inf")) & (v.cast("double") < float("inf"))
    values = rows.where(finite).select(*groups, v.alias("_v"))
    mine = ["_g_" + g for g in groups]
    ends = values.groupBy(*[F.col(g).alias(m) for g, m in zip(groups, mine)]).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    spans = (ranks.join(ends, _same(groups, mine)).where(F.col("rank").between(1, F.col("_n")))
             .select(*mine, "target", F.col("rank").cast("long").alias("_rank"), "_lo", "_hi"))
    spans = cut_lineage(spans)
    while not spans.where("_lo < _hi").isEmpty():
        open_spans = spans.where("_lo < _hi").select(*mine, "_lo", "_hi").distinct()
        inside = values.join(bounded_broadcast(open_spans), _same(groups, mine) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        share = (F.col("_v") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo")).cast("double")
        of_bin = F.least(F.floor(share * bins), F.lit(bins - 1))
        counts = inside.groupBy(*mine, "_lo", "_hi", of_bin.alias("_bin")).agg(
            F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = F.sum("_in").over(Window.partitionBy(*mine, "_lo", "_hi").orderBy("_bin"))
        counts = counts.select(*[F.col(m).alias("_b" + m) for m in mine], F.col("_lo").alias("_blo"),
                               F.col("_hi").alias("_bhi"), "_in", "_least", "_most", (upto - F.col("_in")).alias("_before"))
        hit = (_same(mine, ["_b" + m for m in mine]) & (F.col("_lo") == F.col("_blo")) & (F.col("_hi") == F.col("_bhi"))
               & (F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_in")))
        moved = spans.where("_lo < _hi").join(counts, hit).select(
            *mine, "target", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_least").alias("_lo"),
            F.col("_most").alias("_hi"))
        spans = cut_lineage(spans.where("_lo = _hi").unionByName(moved))
    return spans.select(*[F.col(m).alias(g) for g, m in zip(groups, mine)], "target", F.col("_lo").alias(value))
