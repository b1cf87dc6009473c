"""Neighbours of seed documents from a sharded BM25 inverted index.

Rows are (uid, bag): a unique row number and the compressed terms and counts
(or packed token ids, of which they are made).  Each shard holds an inverted index of its documents
and seeds stream past it.  A shard scores every document by all terms of
the seed: terms that stand in more than ``DENSE`` of its documents are columns
of a matrix that a block of seeds multiplies, the others are postings.  A shard
first returns its share of the neighbours twice over; where the last of these
is better than the last of all shards' best, the shard is asked again for those
better than that, up to as many as are kept of all, so no neighbour is lost of the shards that are asked.

Shards are made by a hash and every seed is searched in every shard, which grows
with the square of the documents.  Only a caller that gives leaves of similar
documents (``bm25_leaves``) has its seeds asked in as many of their parts as it
says; that may miss neighbours, and no query does it.

Scores are rounded to 17 bits, so that those of copies are equal.  Equal ones
are put in an order of their own for each seed, so that the seeds of a group of
copies do not all list the same documents.  Documents that share no term with
a seed are not listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskwave.llm import bm25_leaves
from riskwave.llm.common import emit, give_back, materialise

INDEX_TOKENS = 1 << 23
DENSE = 0.1               # a term of more of a shard's documents is in the matrix
BLOCK = 1 << 19           # scores (seeds x documents) held at a time
NEIGHBOURS = 64           # kept of all shards
LEAST = 10                # asked of every shard at least
K1, B = 1.2, 0.75
FEW = 0.02                # assignment stops when a turn takes less than this part of the first


def unpack(packed: bytes, dtype: np.dtype) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype)


def bag(ids: np.ndarray, squeeze) -> bytes:
    """Distinct terms (ascending, as steps) and their counts, compressed."""
    t, c = np.unique(ids, return_counts=True)
    return squeeze.compress(np.diff(t, prepend=t.dtype.type(0)).tobytes() + c.astype("<u4").tobytes())


def open_bag(blob: bytes, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(terms, counts)"""
    raw = unpack(blob, np.dtype("u1"))
    many = len(raw) // (dtype.itemsize + 4)
    steps = raw[:many * dtype.itemsize].view(dtype)
    return np.cumsum(steps, dtype=np.int64), np.frombuffer(raw[many * dtype.itemsize:].tobytes(), "<u4")


def weigh(blob: bytes, dtype: np.dtype, idf: np.ndarray, mean_length: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a bag and their BM25 weights."""
    t, c = open_bag(blob, dtype)
    norm = K1 * (1 - B + B * c.sum() / max(mean_length, 1e-9))
    return t, (idf[t] * c * (K1 + 1) / (c + norm)).astype(np.float32)


def close_terms(terms: np.ndarray, dtype: np.dtype, squeeze) -> bytes:
    """Ascending terms as compressed steps."""
    return squeeze.compress(np.diff(terms, prepend=0).astype(dtype).tobytes())


def open_terms(blob: bytes, dtype: np.dtype) -> np.ndarray:
    return np.cumsum(unpack(blob, dtype), dtype=np.int64)


def _rounded(scores: np.ndarray) -> np.ndarray:
    part, power = np.frexp(scores)
    return np.ldexp(np.rint(part * (1 << 17)) / (1 << 17), power).astype(np.float32)


class Index:
    """Weights of a shard's documents: a matrix of its frequent terms,
    postings of the others."""

    def __init__(self, uids: np.ndarray, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=1)
        self._build(uids, [weigh(bag(d, squeeze), d.dtype, idf, mean_length) for d in docs], idf)

    @classmethod
    def of_bags(cls, uids: np.ndarray, bags: list[bytes], dtype: np.dtype, idf: np.ndarray, mean_length: float):
        index = cls.__new__(cls)
        index._build(uids, [weigh(b, dtype, idf, mean_length) for b in bags], idf)
        return index

    def _build(self, uids: np.ndarray, weighed: list, idf: np.ndarray):
        self.uids = uids
        terms, weights = zip(*weighed)
        doc = np.repeat(np.arange(len(uids), dtype=np.int32), [len(t) for t in terms])
        term, weight = np.concatenate(terms).astype(np.int32), np.concatenate(weights)
        common = np.flatnonzero(np.bincount(term, minlength=len(idf)) > DENSE * len(uids))
        self.column = np.full(len(idf), -1)
        self.column[common] = np.arange(len(common))
        column = self.column[term]
        self.matrix = np.zeros((len(common), len(uids)), np.float32)
        self.matrix[column[column >= 0], doc[column >= 0]] = weight[column >= 0]
        rare = np.flatnonzero(column < 0)
        order = rare[np.argsort(term[rare], kind="stable")]
        self.by_term, self.by_weight = doc[order].astype(np.intp), weight[order].astype(np.float64)
        self.starts = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.place = {u: i for i, u in enumerate(uids.tolist())}
        mixed = 1 + 1e-5 * np.random.default_rng(len(uids)).random(len(uids), np.float32)
        self.turns = np.concatenate((mixed, mixed))       # a seed's order of equal scores: more than rounding

    def search(self, uid: int, terms: np.ndarray, keep: int, strong: int | None = None,
               candidates: int | None = None):
        """(documents, scores) of the ``keep`` best by all terms, of the
        ``strong`` first ones if given."""
        return self.search_all([uid], [terms[:strong]], keep)[0]

    def search_all(self, uids: list[int], questions: list[np.ndarray], keep: int):
        """``search`` of every (uid, terms)."""
        out, n = [], max(1, BLOCK // len(self.uids))
        for at in range(0, len(uids), n):
            out += self._best(uids[at:at + n], questions[at:at + n], keep)
        return out

    def _best(self, uids: list[int], questions: list[np.ndarray], keep: int):
        n = len(self.uids)
        questions = [q.astype(np.int64) for q in questions]
        column = [self.column[q] for q in questions]
        wanted = np.zeros((len(uids), len(self.matrix)), np.float32)
        for w, c in zip(wanted, column):
            w[c[c >= 0]] = 1
        score = wanted @ self.matrix
        for s, q, c in zip(score, questions, column):     # one seed's sums stay in the cache
            rare = q[c < 0]
            lists = [slice(a, b) for a, b in zip(self.starts[rare].tolist(), self.starts[rare + 1].tolist()) if a < b]
            if lists:
                s += np.bincount(np.concatenate([self.by_term[x] for x in lists]),
                                 np.concatenate([self.by_weight[x] for x in lists]), n)
        turns = [self.turns[n - u % n:2 * n - u % n] for u in uids]
        for s, u, t in zip(score, uids, turns):
            if u in self.place:
                s[self.place[u]] = 0
            s *= t
        c = np.argpartition(score, n - keep, 1)[:, n - keep:] if n > keep else np.tile(np.arange(n), (len(uids), 1))
        c = np.take_along_axis(c, np.argsort(-np.take_along_axis(score, c, 1), 1, kind="stable"), 1)
        found = [(d[s[d] > 0], s, t) for d, s, t in zip(c, score, turns)]
        return [(d, _rounded(s[d] / t[d])) for d, s, t in found]


def _questions(dtype: np.dtype, kept: list[str]):
    def run(batches):
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            terms = pa.array([close_terms(open_bag(b, dtype)[0], dtype, squeeze)
                              for b in batch.column("bag").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [terms], [*kept, "terms"])
    return run


def _asked(dtype: np.dtype, shared, many: int):
    """(uid, terms, shard) for every part that a seed asks."""
    schema = pa.schema([("uid", pa.int64()), ("terms", pa.binary()), ("shard", pa.int64())])

    def run(batches):
        for batch in batches:
            terms = batch.column("terms").to_pylist()
            order = shared.value.order(batch.column("uid").to_numpy(), [open_terms(t, dtype) for t in terms],
                                       batch.column("leaf").to_numpy(), many)
            row = pa.array(np.repeat(np.arange(len(terms)), [len(o) for o in order]))
            yield emit(schema, {"uid": batch.column("uid").take(row), "terms": batch.column("terms").take(row),
                                "shard": np.concatenate([*order, np.zeros(0, np.int64)])})
    return run


def _parts(shared):
    schema = pa.schema([("shard", pa.int64()), ("uid", pa.int64()), ("blob", pa.binary())])

    def run(batches):
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            yield emit(schema, {"shard": shared.value.part(uids, batch.column("leaf").to_numpy()), "uid": uids,
                                "blob": batch.column("bag")})
    return run


def _search(dtype: np.dtype, stats, keep: int):
    """Rows sorted by (shard, side): documents (side 0) build the shard's
    index, then its seeds (side 1) are searched in it."""
    schema = pa.schema([("shard", pa.int64()), ("seed", pa.int64()), ("uid", pa.int64()), ("score", pa.float32())])

    def run(batches):
        idf, mean_length = stats.value
        shard, uids, docs, index = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, side = batch.column("shard").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                if at[a] != shard:
                    shard, uids, docs, index = at[a], [], [], None
                part = batch.slice(a, b - a)
                numbers, blobs = part.column("uid").to_numpy(), part.column("blob").to_pylist()
                if side[a] == 0:
                    uids.append(numbers)
                    docs += blobs
                    continue
                if index is None:
                    if not docs:
                        continue
                    index = Index.of_bags(np.concatenate(uids), docs, dtype, idf, mean_length)
                    docs = []
                found = index.search_all(numbers.tolist(), [open_terms(q, dtype) for q in blobs], keep)
                found = [(c[s >= x], s[s >= x]) for (c, s), x in zip(found, part.column("least").to_numpy())]
                seeds = np.repeat(numbers, [len(c) for c, _ in found])
                yield emit(schema, {"shard": np.full(len(seeds), shard), "seed": seeds,
                                    "uid": np.concatenate([index.uids[c] for c, _ in found]),
                                    "score": np.concatenate([s for _, s in found]).astype(np.float32)})
        index = None
        give_back()
    return run


def _bags(dtype: np.dtype):
    schema = pa.schema([("uid", pa.int64()), ("bag", pa.binary())])

    def run(batches):
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield emit(schema, {"uid": batch.column("uid"), "bag": [bag(unpack(p, dtype), squeeze)
                                                                    for p in batch.column("packed").to_pylist()]})
    return run


def questions(docs: DataFrame, is_seed: Column, dtype: np.dtype) -> DataFrame:
    """(uid, terms) of the seeds, with their leaf if ``docs`` have one."""
    kept = ["uid", "leaf"] if "leaf" in docs.columns else ["uid"]
    return materialise(docs.where(is_seed).select(*kept, "bag").mapInArrow(
        _questions(dtype, kept), "uid long, " + "leaf int, " * (len(kept) - 1) + "terms binary"), "seeds")


def neighbours(docs: DataFrame, is_seed: Column, dtype: np.dtype, stats, n_tokens: int,
               index_tokens: int = INDEX_TOKENS, most: int = NEIGHBOURS, leaves=None,
               seeds: DataFrame | None = None) -> DataFrame:
    """(seed, uid, score, rank): the best neighbours of every seed among ``docs``;
    with ``leaves`` (broadcast leaves, parts asked), of the parts of ``docs.leaf``.
    ``seeds``: their ``questions``, if made before."""
    if "bag" not in docs.columns:
        docs = docs.select("uid", "packed").mapInArrow(_bags(dtype), "uid long, bag binary")
    seeds = questions(docs, is_seed, dtype) if seeds is None else seeds
    if leaves is None:
        shards = many = max(1, -(-n_tokens // index_tokens))
        asked = seeds.select("uid", "terms", F.explode(
            F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
        dealt = docs.select(F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"), "uid", F.col("bag").alias("blob"))
    else:
        shared, many = leaves
        asked = seeds.mapInArrow(_asked(dtype, shared, many), "uid long, terms binary, shard long")
        dealt = docs.select("uid", "leaf", "bag").mapInArrow(_parts(shared), "shard long, uid long, blob binary")
    keep = most if many == 1 else min(most, max(LEAST, -(-2 * most // many)))

    def search(asked: DataFrame, keep: int) -> DataFrame:
        rows = (dealt.select("shard", F.lit(0).alias("side"), "uid", "blob", F.lit(0.0).cast("float").alias("least"))
                .unionAll(asked.select("shard", F.lit(1), "uid", "terms", "least")))
        return (rows.repartition("shard").sortWithinPartitions("shard", "side")
                .mapInArrow(_search(dtype, stats, keep), "shard long, seed long, uid long, score float"))
    best = Window.partitionBy("seed").orderBy(F.desc("score"), F.xxhash64("seed", "uid"))
    found = search(asked.withColumn("least", F.lit(0.0).cast("float")), keep)
    if keep < most:
        found = materialise(found, "found")
        of_seed, of_shard = Window.partitionBy("seed"), Window.partitionBy("seed", "shard")
        again = materialise(
            found.repartition("seed").withColumn("rank", F.row_number().over(best))
            .withColumn("last", F.max(F.when(F.col("rank") == most, F.col("score"))).over(of_seed))
            .withColumn("many", F.count("*").over(of_shard)).withColumn("worst", F.min("score").over(of_shard))
            .where((F.col("many") == keep) & (F.col("last").isNull() | (F.col("worst") > F.col("last"))))
            .groupBy("seed", "shard").agg(F.coalesce(F.max("last"), F.lit(0.0).cast("float")).alias("least")), "again")
        if not again.isEmpty():
            more = again.join(seeds.select(F.col("uid").alias("seed"), "terms"), "seed").withColumnRenamed("seed", "uid")
            found = (found.unionAll(search(more, most)).repartition("seed")
                     .groupBy("seed", "uid").agg(F.max("score").alias("score")))
    return (found.select("seed", "uid", "score").withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= most))


def assign(edges: DataFrame, sizes: DataFrame, room: DataFrame) -> DataFrame:
    """(uid, seed, score) of the documents that seeds take: each document goes
    to the open seed that scores it highest, a seed takes the highest scores
    until its ``room`` is full (the last one may overflow it).  ``edges``:
    seed, uid, score; ``sizes``: uid, n; ``room``: seed, room."""
    edges = materialise(edges.join(sizes, "uid").select("seed", "uid", "score", "n"), "edges")
    taken, most = None, 0
    while True:
        offers = edges.groupBy("uid").agg(
            F.max(F.struct("score", F.xxhash64("seed", "uid").alias("h"), "seed", "n")).alias("o"))
        order = Window.partitionBy("seed").orderBy(F.desc("score"), "uid").rowsBetween(Window.unboundedPreceding, -1)
        new = materialise(
            offers.select("uid", "o.seed", "o.score", "o.n").join(room, "seed")
            .withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
            .where("before < room").select("uid", "seed", "score", "n"), "taken")
        count = new.count()
        if count:
            taken = new if taken is None else taken.unionAll(new)
        most = max(most, count)
        if count <= FEW * most:
            return None if taken is None else taken.select("uid", "seed", "score")
        room = materialise(room.join(new.groupBy("seed").agg(F.sum("n").alias("gone")), "seed", "left")
                           .select("seed", (F.col("room") - F.coalesce("gone", F.lit(0))).alias("room"))
                           .where("room > 0"), "room")
        edges = materialise(edges.join(new.select("uid"), "uid", "left_anti").join(room.select("seed"), "seed",
                                                                                   "left_semi"), "edges")
