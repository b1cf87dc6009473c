"""Leaves of similar documents, so that a seed is searched near its like only.

``fit`` learns from a bounded sample (``SAMPLE`` documents by a hash) a
projection of BM25 weights to ``DIMENSIONS`` numbers and the centres of about
one leaf for ``LEAF_TOKENS`` tokens, ``MOST_LEAVES`` at most.  Every document
lies in the leaf of its nearest centre; a leaf that holds much more than its
share is dealt to parts by a hash of the row number.  A seed asks the parts in
an order of its own: those of its own leaf, then by the inner product of its
terms and the centres.

How many parts are asked is measured, not fixed: ``probes`` scores a bounded
sample of seeds against all documents and takes the least number that finds
``RECALL`` of their ten best.  The exact search of every seed in every shard is
``bm25_retrieval.neighbours`` without leaves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskwave.llm.common import emit, give_back, materialise

LEAF_TOKENS = 1 << 21
MOST_LEAVES = 4096
PART_LEAVES = 4           # a part holds about this many times a leaf's share at most
SAMPLE = 8192             # documents the leaves are learned from
ASKED = 64                # seeds whose neighbours are looked for in all documents
BEST = 10
RECALL = 0.94
DIMENSIONS = 64
TURNS = 6                 # of the power iteration, and of moving the centres
CHUNK = 1 << 17           # terms projected at a time


class Leaves:
    def __init__(self, projection: np.ndarray, centres: np.ndarray):
        self.projection, self.centres = projection, centres
        self.half = (centres ** 2).sum(1) / 2
        self.parts = np.ones(len(centres), np.int64)

    def deal(self, tokens: dict[int, int], part_tokens: int) -> None:
        """Set the number of parts of each leaf from its tokens."""
        for leaf, n in tokens.items():
            self.parts[leaf] = max(1, -(-n // part_tokens))

    @property
    def first(self) -> np.ndarray:
        """Number of the first part of each leaf, and of all parts."""
        return np.concatenate(([0], np.cumsum(self.parts)))

    def project(self, terms: list[np.ndarray], weights: list[np.ndarray] | None = None) -> np.ndarray:
        return _rows(terms, weights, self.projection)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centres.T - self.half, 1)

    def part(self, uids: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """The part in which a document of a leaf lies."""
        return self.first[leaf] + _mix(uids) % self.parts[leaf]

    def order(self, uids: np.ndarray, terms: list[np.ndarray], own: np.ndarray, most: int) -> list[np.ndarray]:
        """The first ``most`` parts that each seed asks."""
        own = own.astype(np.int64)
        score = self.project(terms) @ self.centres.T
        score[np.arange(len(own)), own] = np.inf
        first, out = self.first, []
        for uid, leaves in zip(_mix(uids).tolist(), np.argsort(-score, 1, kind="stable")[:, :most]):
            parts = [first[k] + (uid + np.arange(self.parts[k])) % self.parts[k] for k in leaves]
            out.append(np.concatenate(parts)[:most])
        return out


def _mix(uids: np.ndarray) -> np.ndarray:
    """Row numbers mixed to 31 bits."""
    return ((uids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _rows(terms, weights, matrix: np.ndarray) -> np.ndarray:
    """Sparse rows (weight 1 if none are given) times a matrix."""
    out, at = np.zeros((len(terms), matrix.shape[1]), np.float32), 0
    sizes = np.array([len(t) for t in terms])
    while at < len(terms):
        end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK, "right")))
        some = np.flatnonzero(sizes[at:end]) + at
        if len(some):
            x = matrix[np.concatenate([terms[i] for i in some]).astype(np.int64)]
            if weights is not None:
                x *= np.concatenate([weights[i] for i in some])[:, None]
            out[some] = np.add.reduceat(x, np.concatenate(([0], np.cumsum(sizes[some])[:-1])))
        at = end
    return out


def _columns(terms, weights, matrix: np.ndarray, n_terms: int) -> np.ndarray:
    """The transposed sparse rows times a matrix."""
    term, doc = np.concatenate(terms).astype(np.int64), np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    weight, order = np.concatenate(weights), np.argsort(term, kind="stable")
    out = np.zeros((n_terms, matrix.shape[1]), np.float32)
    for at in range(0, len(order), CHUNK):
        o = order[at:at + CHUNK]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(term[o])) + 1))
        out[term[o][starts]] += np.add.reduceat(weight[o][:, None] * matrix[doc[o]], starts)
    return out


def learn(terms, weights, n_terms: int, leaves: int) -> Leaves:
    """Leaves from the terms and weights of sample documents."""
    rng = np.random.default_rng(len(terms))
    y = rng.standard_normal((n_terms, DIMENSIONS)).astype(np.float32)
    for _ in range(TURNS):
        y = np.linalg.qr(_columns(terms, weights, _rows(terms, weights, y), n_terms))[0]
    x = _rows(terms, weights, y)
    out = Leaves(y, x[rng.choice(len(x), min(leaves, len(x)), replace=False)])
    for _ in range(TURNS):
        near = out.nearest(x)
        total = np.zeros_like(out.centres)
        np.add.at(total, near, x)
        many = np.bincount(near, minlength=len(total))
        out = Leaves(y, np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], out.centres))
    return out


def _weights(dtype: np.dtype, stats):
    """(uid, terms, weights) of documents, as bytes."""
    from riskwave.llm.bm25_retrieval import weigh
    schema = pa.schema([("uid", pa.int64()), ("terms", pa.binary()), ("weights", pa.binary())])

    def run(batches):
        for batch in batches:
            found = [weigh(b, dtype, *stats.value) for b in batch.column("bag").to_pylist()]
            yield emit(schema, {"uid": batch.column("uid"), "terms": [t.astype(np.int32).tobytes() for t, _ in found],
                                "weights": [w.tobytes() for _, w in found]})
    return run


def _leaf(dtype: np.dtype, stats, shared):
    from riskwave.llm.bm25_retrieval import weigh
    schema = pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("leaf", pa.int32())])

    def run(batches):
        for batch in batches:
            found = [weigh(b, dtype, *stats.value) for b in batch.column("bag").to_pylist()]
            x = shared.value.project([t for t, _ in found], [w for _, w in found])
            yield emit(schema, {"uid": batch.column("uid"), "n": batch.column("n"),
                                "leaf": shared.value.nearest(x).astype(np.int32)})
        give_back()
    return run


def fit(tokens: DataFrame, n_docs: int, n_tokens: int, dtype: np.dtype, stats, leaf_tokens: int = LEAF_TOKENS):
    """(broadcast ``Leaves``, (uid, n, leaf) of all documents)."""
    spark = tokens.sparkSession
    rate = int(min(1.0, 1.1 * SAMPLE / n_docs) * (1 << 30))
    sample = (tokens.where(F.pmod(F.xxhash64("uid", F.lit(-1)), F.lit(1 << 30)) < rate).limit(SAMPLE)
              .select("uid", "bag").mapInArrow(_weights(dtype, stats), "uid long, terms binary, weights binary")
              .orderBy("uid").collect())
    leaves = learn([np.frombuffer(r.terms, np.int32) for r in sample],
                   [np.frombuffer(r.weights, np.float32) for r in sample], len(stats.value[0]),
                   min(MOST_LEAVES, -(-n_tokens // leaf_tokens)))
    shared = spark.sparkContext.broadcast(leaves)
    placed = materialise(tokens.select("uid", "n", "bag")
                         .mapInArrow(_leaf(dtype, stats, shared), "uid long, n long, leaf int"), "leaves")
    shared.unpersist()
    share = max(leaf_tokens, -(-n_tokens // len(leaves.centres)))
    leaves.deal({r.leaf: r.n for r in placed.groupBy("leaf").agg(F.sum("n").alias("n")).collect()},
                PART_LEAVES * share)
    return spark.sparkContext.broadcast(leaves), placed


def _brute(dtype: np.dtype, stats, shared, asked: dict[int, np.ndarray]):
    """Of each task the best documents of the asked seeds, with their parts;
    of equal ones ``BEST`` a part."""
    from riskwave.llm.bm25_retrieval import weigh
    schema = pa.schema([("seed", pa.int64()), ("part", pa.int64()), ("score", pa.float32())])

    def run(batches):
        idf, mean_length = stats.value
        seeds = np.array(list(asked))
        wanted = np.zeros((len(idf), len(seeds)), np.float32)
        for k, t in enumerate(asked.values()):
            wanted[t.astype(np.int64), k] = 1
        best: list[list[tuple[float, int]]] = [[] for _ in seeds]
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [weigh(b, dtype, idf, mean_length) for b in batch.column("bag").to_pylist()]
            score = _rows([t for t, _ in found], [w for _, w in found], wanted)
            uids = batch.column("uid").to_numpy()
            part = shared.value.part(uids, batch.column("leaf").to_numpy().astype(np.int64))
            for k, seed in enumerate(seeds):
                s = np.where(uids == seed, 0, score[:, k])
                least = min(np.partition(s, -BEST)[-BEST] if len(s) > BEST else 0, s.max())
                if len(best[k]) >= BEST:
                    least = max(least, best[k][BEST - 1][0])
                c = np.flatnonzero((s >= least * (1 - 1e-5)) & (s > 0))
                if len(c):
                    best[k] = _ten_a_part(best[k] + list(zip(s[c].tolist(), part[c].tolist())))
        rows = [(seed, p, s) for seed, b in zip(seeds.tolist(), best) for s, p in b]
        yield emit(schema, {f.name: [r[i] for r in rows] for i, f in enumerate(schema)})
    return run


def _ten_a_part(rows: list[tuple[float, int]]) -> list[tuple[float, int]]:
    """Rows as good as the tenth, best first, at most ten of a part."""
    rows.sort(reverse=True)
    least, many, out = rows[min(BEST, len(rows)) - 1][0] * (1 - 1e-5), {}, []
    for score, part in rows:
        many[part] = many.get(part, 0) + 1
        if score >= least and many[part] <= BEST:
            out.append((score, part))
    return out


def probes(docs: DataFrame, seeds: DataFrame, dtype: np.dtype, stats, shared, recall: float = RECALL) -> int:
    """The least number of parts that a seed has to ask, so that ``ASKED`` of
    the seeds find ``recall`` of the ten best of all documents.  ``docs``:
    uid, bag, leaf; ``seeds``: uid, terms, leaf."""
    from riskwave.llm.bm25_retrieval import open_terms
    rows = seeds.orderBy(F.xxhash64("uid")).limit(ASKED).collect()
    asked = {r.uid: open_terms(r.terms, dtype) for r in rows}
    every = int(shared.value.parts.sum())
    order = shared.value.order(np.array(list(asked)), list(asked.values()), np.array([r.leaf for r in rows]), every)
    turn = {u: {p: i for i, p in enumerate(o.tolist())} for u, o in zip(asked, order)}
    found = docs.select("uid", "bag", "leaf").mapInArrow(
        _brute(dtype, stats, shared, asked), "seed long, part long, score float")
    best = Window.partitionBy("seed").orderBy(F.desc("score"))
    tenth = Window.partitionBy("seed")
    found = (found.withColumn("rank", F.row_number().over(best))
             .withColumn("least", F.min(F.when(F.col("rank") <= BEST, F.col("score"))).over(tenth))
             .withColumn("many", F.count("*").over(tenth))
             .where(F.col("score") >= F.col("least") * F.lit(1 - 1e-5))
             .groupBy("seed", "part").agg(F.count("*").alias("hits"), F.first("many").alias("many")).collect())
    hits, all_ = np.zeros((len(asked), every)), dict.fromkeys(asked, 0)
    row = {u: i for i, u in enumerate(asked)}
    for r in found:
        hits[row[r.seed], turn[r.seed][r.part]] += r.hits
        all_[r.seed] = min(BEST, r.many)
    goal = np.array(list(all_.values()))
    reached = np.minimum(np.cumsum(hits, 1), goal[:, None]).sum(0)
    return 1 + int(np.argmax(reached >= recall * goal.sum()))
