"""Mixing sources to target weights by Pfair scheduling.

Target weights are given, or are row counts to the power ``TEMPER``.  The
mixture goes on until every source of positive weight has been read once: if
the last one to end has ``rows`` rows and weight w, a source of weight v gives
v * rows / w rows, and at least all of its own.  A source that ends earlier
starts again (``epoch`` counts its passes); the row counts follow the unrounded
weights.  A source of weight zero has no place in the mixture.

A source's rows, pass after pass, are cut into blocks; only the very last
block of a source can be short.  With weight w (a part of 1), its block j is
released at slot floor(j/w) and due by slot ceil((j+1)/w), in exact whole
numbers: a float is a fraction, so no weight is rounded.  One block runs per
slot, earliest deadline first among the released blocks (ties to the lower
stream number).  After any number of slots in which no source has ended, each
source is less than one block from its target weight.  Counted in rows, the
rows that short blocks lack are to be added.  ``share`` is the weight rounded
to a ``period``, for reading only; the schedule does not use it.

Every source is a stream of its own.  The driver makes the schedule from the
sources' row counts alone.  A block has ``block_rows`` rows, and twice as many,
four times as many and so on as soon as the mixture would have more than
``max_blocks`` blocks (33 million rows by default): the schedule's size does
not grow with the rows any further, only with the number of sources.  Blocks
get their slots by a join.  The table of streams is broadcast if it has at most
``max_streams`` rows, else it is joined by shuffle.

Rows are only moved by DataFrame expressions.  A document's place within its
source comes from a hash order: rows are dealt to (stream, bucket) groups of
about ``BUCKET_ROWS`` rows, ranked inside a group, and shifted by the row
counts of the groups before; no task holds a whole source.

Null sources form a source; a null id is an id like any other; repeated
rows are placed once each; ties in the hash order are broken by id and
text, and rows equal in all of these are interchangeable.  An empty table
gives an empty result.  The input's columns are returned as they are.
"""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskwave.llm.common import materialise
from riskwave.plans.broadcast import bounded_broadcast

PERIOD = 1024
BLOCK_ROWS = 32
MAX_BLOCKS = 1 << 20
PASSES = 1024
MAX_STREAMS = 64
BUCKET_ROWS = 4096
TEMPER = 0.9

MAX_BROADCAST_BLOCKS = 2_000_000    # block numbers with their slots sent to every task at most
FAR = 1 << 62                       # a release or deadline beyond any slot


def _streams(docs: DataFrame, source: str, weights: dict | None, temper: float) -> list:
    """(stream, source, rows, weight) of every source, the largest first."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("rows")) \
        .withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(temper))) \
        .orderBy(F.desc("rows"), F.asc_nulls_first("source")).collect()
    if weights is not None and (unnamed := [r.source for r in counts if r.source not in weights]):
        raise ValueError(f"{len(unnamed)} sources have no weight, such as {unnamed[0]!r}")
    return [Row(stream=k, source=r.source, rows=r.rows,
                weight=r.weight if weights is None else float(weights[r.source])) for k, r in enumerate(counts, 1)]


def _shares(weights: list[float], period: int) -> list[int]:
    """Integers that sum to ``period``, at least 1 for a positive weight."""
    exact = [w * period for w in weights]
    share = [max(int(x), int(x > 0)) for x in exact]
    left = period - sum(share)
    order = sorted(range(len(exact)), key=lambda i: (share[i] - exact[i], i), reverse=left < 0)
    able = [i for i in order if share[i] > 1 or left > 0 and exact[i] > 0]
    for k in range(abs(left)):
        share[able[k % len(able)]] += 1 if left > 0 else -1
    return share


def _edf(shares: list[int], period: int, blocks: list[int] | None = None) -> tuple[array, array]:
    """Slots in use and their streams (numbers in ``shares``): earliest
    deadline first over the first ``blocks`` of each stream, by default over
    one period.  Whole numbers of any length."""
    many = blocks or shares
    coming = [(0, s) for s, n in enumerate(many) if n]        # (release, stream)
    ready: list[tuple[int, int]] = []                         # (deadline, stream)
    done = [0] * len(shares)
    slots, ran, slot = array("q"), array("i"), 0
    while coming or ready:
        while coming and coming[0][0] <= slot:
            s = heapq.heappop(coming)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * period // shares[s]), s))
        if not ready:
            slot = coming[0][0]
            continue
        s = heapq.heappop(ready)[1]
        slots.append(slot)
        ran.append(s)
        done[s] += 1
        if done[s] < many[s]:
            heapq.heappush(coming, (done[s] * period // shares[s], s))
        slot += 1
    return slots, ran


def _whole(weights: list[float]) -> list[int]:
    """Whole numbers in the exact proportions of the weights; below zero counts as zero."""
    exact = [Fraction(w) for w in weights]
    unit = lcm(*[x.denominator for x in exact])
    return [max(0, int(x * unit)) for x in exact]


class Plan:
    """Streams with their weights as whole numbers (``parts`` of ``whole``),
    rows, rows in the mixture (``total``), shares and block length."""

    def __init__(self, streams: list, period: int, block_rows: int, max_blocks: int = MAX_BLOCKS):
        self.parts = _whole([r.weight for r in streams])
        if not any(self.parts):
            self.parts = [1] * len(streams)
        self.whole = sum(self.parts)
        # The last source to end: rows / part is the largest.
        last = max((Fraction(r.rows, p) for r, p in zip(streams, self.parts) if p), default=Fraction(0))
        self.numbers = [r.stream for r in streams]
        self.sources, self.rows = [r.source for r in streams], [r.rows for r in streams]
        self.totals = [max(r.rows, round(p * last)) if p else 0 for r, p in zip(streams, self.parts)]
        self.block_rows = block_rows
        while self.block_rows < max(self.totals, default=0) and sum(self._blocks()) > max_blocks:
            self.block_rows *= 2
        self.blocks = self._blocks()
        self.period = period
        self.shares = _shares([p / self.whole for p in self.parts], period) if streams else []

    def _blocks(self) -> list[int]:
        return [-(-n // self.block_rows) for n in self.totals]

    def schedule(self, spark: SparkSession) -> DataFrame:
        """(stream, block, release, deadline, slot) of every block."""
        slots, ran = _edf(self.parts, self.whole, self.blocks) if self.numbers else ([], [])
        ran, slots = np.array(ran, np.int32), np.array(slots, np.int64)
        order = np.argsort(ran, kind="stable")
        release, deadline = array("q"), array("q")
        for p, n in zip(self.parts, self.blocks):
            release.extend(min(j * self.whole // p, FAR) for j in range(n))
            deadline.extend(min(-(-(j + 1) * self.whole // p), FAR) for j in range(n))
        first = np.concatenate(([0], np.cumsum(self.blocks)[:-1])) if self.numbers else np.zeros(0, np.int64)
        numbers = np.array(self.numbers, np.int32)
        table = pa.table({"stream": pa.array(numbers[ran[order]], pa.int32()),
                          "block": pa.array(np.arange(len(ran)) - first[ran[order]], pa.int64()),
                          "release": pa.array(np.array(release, np.int64)),
                          "deadline": pa.array(np.array(deadline, np.int64)),
                          "slot": pa.array(slots[order], pa.int64())})
        return spark.createDataFrame(table, "stream int, block long, release long, deadline long, slot long")

    def streams(self, spark: SparkSession, kind: T.DataType, *more) -> DataFrame:
        fields = [("stream", T.IntegerType()), ("source", kind), ("rows", T.LongType()), ("share", T.LongType()),
                  ("total", T.LongType()), ("period", T.LongType()), *[(name, t) for name, t, _ in more]]
        values = zip(self.numbers, self.sources, self.rows, self.shares, self.totals,
                     [self.period] * len(self.numbers), *[v for _, _, v in more])
        return spark.createDataFrame(list(values), T.StructType([T.StructField(n, t) for n, t in fields]))


def plan_streams(docs: DataFrame, source: str, weights: dict | None = None, period: int = PERIOD,
                 block_rows: int = BLOCK_ROWS, max_streams: int = MAX_STREAMS, temper: float = TEMPER) -> DataFrame:
    """One row per stream: stream, source, rows, share, total, period and
    ``slots``, those of its blocks in one period of endless sources."""
    plan = Plan(_streams(docs, source, weights, temper), period, block_rows)
    slots = [[] for _ in plan.numbers]
    for t, s in zip(*_edf(plan.shares, plan.period)):
        slots[s].append(t)
    return plan.streams(docs.sparkSession, docs.schema[source].dataType, ("slots", T.ArrayType(T.LongType()), slots))


def mix_sources(docs: DataFrame, weights: dict | None = None, source: str = "source", id_col: str = "doc_id",
                text_col: str = "text", period: int = PERIOD, block_rows: int = BLOCK_ROWS,
                max_streams: int = MAX_STREAMS, temper: float = TEMPER, carry: list[str] | None = None,
                max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``row`` (struct of the ``carry`` columns, all by default) with stream,
    share, epoch, block (counted over all epochs), release, deadline, slot
    and place (in the block)."""
    spark = docs.sparkSession
    plan = Plan(_streams(docs, source, weights, temper), period, block_rows, max_blocks)
    streams = bounded_broadcast(materialise(plan.streams(spark, docs.schema[source].dataType), "streams"), max_streams)
    slots = bounded_broadcast(materialise(plan.schedule(spark), "slots"), MAX_BROADCAST_BLOCKS)
    buckets = max(1, -(-sum(plan.rows) // BUCKET_ROWS))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"),
                       F.col(source).alias("_source"), F.col(id_col).alias("_id"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h"))
    dealt = (rows.join(streams, F.col("_source").eqNullSafe(F.col("source"))).where("total > 0")
             .withColumn("bucket", F.pmod("_h", F.lit(buckets))).drop("source", "_source"))
    sizes = dealt.groupBy("stream", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("stream", "bucket", (F.sum("n").over(
        Window.partitionBy("stream").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("stream", "bucket").orderBy("_h", "_id")
    ranked = (dealt.withColumn("in_bucket", F.row_number().over(inside))
              .join(before, ["stream", "bucket"])
              .withColumn("rank", F.col("before") + F.col("in_bucket") - 1))
    placed = (_passes(ranked, plan)
              .withColumn("at", F.col("rank") + F.col("epoch") * F.col("rows"))
              .withColumn("block", F.expr(f"at div {plan.block_rows}"))
              .join(slots, ["stream", "block"]))
    return placed.select("row", "stream", "share", "epoch", "block", "release", "deadline", "slot",
                         (F.col("at") % plan.block_rows).alias("place"))


def _passes(ranked: DataFrame, plan: Plan) -> DataFrame:
    """A row for every pass (``epoch``) in which the mixture reads a row."""
    last = "(total - 1 - rank) div rows"
    often = [k for k, n, t in zip(plan.numbers, plan.rows, plan.totals) if t > n * PASSES]
    if not often:
        return ranked.withColumn("epoch", F.explode(F.expr(f"sequence(0L, {last})")))
    many = ranked.withColumn("often", F.expr(f"(total - 1) div rows >= {PASSES}"))
    few = many.where("not often").withColumn("epoch", F.explode(F.expr(f"sequence(0L, {last})")))
    turns = (many.where("often").withColumn("turn", F.explode(F.expr(f"sequence(0L, ({last}) div {PASSES})")))
             .repartition("stream", "rank", "turn")
             .withColumn("epoch", F.explode(F.expr(
                 f"sequence(turn * {PASSES}, least(turn * {PASSES} + {PASSES - 1}, {last}))"))))
    return few.drop("often").unionByName(turns.drop("often", "turn"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture, files and rows in the order of the
    schedule, with the columns of ``docs``."""
    placed = mix_sources(docs, **options)
    return placed.repartitionByRange("slot").sortWithinPartitions("slot", "place").select("row.*")
