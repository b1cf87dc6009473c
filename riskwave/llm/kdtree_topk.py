"""Exact top-k by inner product with a KD-tree per shard.

Candidates are dealt to shards of about ``SHARD_ROWS`` rows by a hash.  A
shard's tree splits at the median of its widest dimension and keeps tight
bounding boxes; the largest inner product of a query with a box,
``max(q, 0) . high + min(q, 0) . low``, bounds every score in it.  Boxes are
visited best first until the bound falls below the query's k-th score.

Queries meet a shard as rows that stream past its tree, in two rounds: one
home shard each, which gives a k-th score, and then all other shards with
that score carried along, so that whole shards are pruned at their root.
A task holds one shard and one batch of queries; per query at most k rows
leave a shard.  There is no cross join and no broadcast.

Scores are integers: components are scaled by ``SCALE`` and floored, and
products are summed in 64-bit arithmetic (floating point only where every
sum is exact).  Vectors that are null or hold a null or non-finite
component take no part, nor do rows without an id; only vectors of equal
length meet.  A query's own row is every row with its id.  Repeated
candidate rows count as often as they occur; of repeated query ids the
smallest vector asks.  Ties go to the smaller vec_id.  Extra columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskwave.llm.common import emit, materialise

SCALE = 1024
SHARD_ROWS = 4096
LEAF_ROWS = 48
EXACT = float(1 << 52)


class KdTree:
    """Median splits on the widest dimension; nodes are row ranges of the
    reordered points with tight boxes."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(ids))
        nodes: list[tuple[int, int]] = []
        children: list[tuple[int, int] | None] = []
        low, high = [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me = len(nodes)
            if parent >= 0:
                pair = list(children[parent])
                pair[side] = me
                children[parent] = tuple(pair)
            own = points[order[a:b]]
            low.append(own.min(0))
            high.append(own.max(0))
            nodes.append((a, b))
            if b - a <= leaf_rows or (low[-1] == high[-1]).all():
                children.append(None)
                continue
            children.append((-1, -1))
            widest = int(np.argmax(high[-1].astype(float) - low[-1]))
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, widest], half)]
            todo += [(a, a + half, me, 0), (a + half, b, me, 1)]
        self.nodes, self.children = nodes, children
        self.ids, self.copies, self.points = ids[order], copies[order], points[order]
        self.low, self.high = np.array(low), np.array(high)
        self.reach = float(max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0)))

    def _exact_in_floats(self, q: np.ndarray) -> bool:
        return self.reach * float(np.abs(q).max(initial=0)) * q.shape[-1] < EXACT

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Bound of every node (rows) for every query (columns)."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        if self._exact_in_floats(queries):
            return (self.high.astype(float) @ up.T.astype(float) + self.low.astype(float) @ down.T.astype(float)) \
                .astype(np.int64)
        return self.high @ up.T + self.low @ down.T

    def search(self, query_id: int, q: np.ndarray, bound: np.ndarray, k: int, kth: int | None):
        """The k best (score, id) of this tree that reach ``kth``; ``bound``
        holds the query's column of ``bounds``."""
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floats = self._exact_in_floats(q)
        heap = [(-int(bound[0]), 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if kth is not None and -top < kth:
                break
            if self.children[node] is not None:
                for c in self.children[node]:
                    if kth is None or bound[c] >= kth:
                        heapq.heappush(heap, (-int(bound[c]), c))
                continue
            a, b = self.nodes[node]
            own = self.points[a:b]
            score = (own.astype(float) @ q.astype(float)).astype(np.int64) if floats else own @ q
            keep = self.ids[a:b] != query_id
            if kth is not None:
                keep &= score >= kth
            times = np.minimum(self.copies[a:b][keep], k)
            best_s = np.concatenate((best_s, np.repeat(score[keep], times)))
            best_i = np.concatenate((best_i, np.repeat(self.ids[a:b][keep], times)))
            if len(best_s) >= k:
                first = np.lexsort((best_i, -best_s))[:k]
                best_s, best_i = best_s[first], best_i[first]
                if kth is None or best_s[-1] > kth:
                    kth = int(best_s[-1])
        return best_s, best_i


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _search(k: int):
    """Rows sorted by (shard, side): a shard's candidates (side 0) build its
    tree, then its queries (side 1) are searched in it."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        shard, rows, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("shard").to_numpy()
            side = batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                part = batch.slice(a, b - a)
                if at[a] != shard:
                    shard, rows, tree = at[a], [], None
                if side[a] == 0:
                    rows.append(part)
                    continue
                if tree is None:
                    if not rows:
                        continue
                    t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
                    tree = KdTree(t.column("vec_id").to_numpy(), t.column("n").to_numpy(), _matrix(t.column("v")))
                    rows = []
                queries = _matrix(part.column("v"))
                bound = tree.bounds(queries)
                out = {"query_id": [], "vec_id": [], "score": []}
                for i, (qid, kth) in enumerate(zip(part.column("vec_id").to_pylist(), part.column("kth").to_pylist())):
                    s, ids = tree.search(qid, queries[i], bound[:, i], k, kth)
                    out["query_id"] += [qid] * len(s)
                    out["vec_id"] += ids.tolist()
                    out["score"] += s.tolist()
                yield emit(schema, out)
    return run


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part."""
    x = F.col("x")
    whole = F.transform(x, lambda c: F.floor(c * scale))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
            .where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
            .select("vec_id", whole.alias("v")))


def _found(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    cols = ["shard", F.lit(0).alias("side"), "vec_id", "v", "n", F.lit(None).cast("long").alias("kth")]
    asked = ["shard", F.lit(1).alias("side"), "vec_id", "v", F.lit(1).cast("long").alias("n"), "kth"]
    both = candidates.select(*cols).unionAll(queries.select(*asked))
    return (both.repartition("shard").sortWithinPartitions("shard", "side")
            .mapInArrow(_search(k), "query_id long, vec_id long, score long"))


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
                       vector_col: str = "embedding", shard_rows: int = SHARD_ROWS,
                       scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where ``is_query`` (an
    expression on ``vec_id``) holds, against all rows."""
    points = (scaled(vectors, id_col, vector_col, scale).groupBy("vec_id", "v").agg(F.count("*").alias("n")))
    points = materialise(points, "points")
    shards = max(1, -(-points.count() // shard_rows))
    dims = F.size("v").cast("long")
    number = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards))
    place = lambda s: (dims * F.lit(1 << 32) + s).alias("shard")  # noqa: E731  one length per tree
    candidates = points.select(place(number), "vec_id", "v", "n")
    queries = points.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    first = materialise(_best(_found(candidates, queries.select(place(home), "vec_id", "v",
                                                                F.lit(None).cast("long").alias("kth")), k), k),
                        "home-shard")
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    others = (queries.join(kth, "vec_id", "left").withColumn("home", home)
              .withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
              .where("s <> home").select(place(F.col("s")), "vec_id", "v", "kth"))
    found = first.select("query_id", "vec_id", "score").unionAll(_found(candidates, others, k))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


# DuckDB SQL for the query's rows (distinct ids, vectors of one length).
ORACLE = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
