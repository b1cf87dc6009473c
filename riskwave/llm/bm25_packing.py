"""Lexical retrieval packing of documents into fixed token windows.

Seed documents are searched in a sharded BM25 inverted index of all unused
documents; the best neighbours returned fill the seed's window greedily.
Documents are cut freely: the neighbour that overflows a window opens the next.

* Tokens are made once and written with a unique row number; document
  frequencies, the document count and the average length come from all
  documents (terms are token ids, so these figures are bounded by the
  vocabulary and are broadcast).
* Rounds of search (``bm25_retrieval``): about one unused document a window is
  a seed, by a hash of its row number; in each further round twice as large a
  share of those left, at most half.  Every seed is searched in every shard,
  whatever the size of the table, so the work grows with the product of seeds
  and documents.
* A document goes to the seed with the highest score that lists it, and a seed
  takes such documents until its window is full; those turned away go to
  their next best open seed, until hardly any is taken.
* Rounds go on until half of the documents left were seeds and those that no
  seed took fit one packing shard of about ``SHARD_TOKENS`` tokens, which is
  packed by search among all of them.
* Groups of a seed and its neighbours are laid end to end inside packing
  shards; the rest of a shard's last window is cut into sequences whose
  lengths are powers of two, so no sequence needs padding.

Very long texts are held whole as token ids, with one shard at a time.
Null text packs as an empty document: its end id only.  Repeated rows are
packed once each.  Ties in score go to the smaller row number.  An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskwave.llm.bm25_leaves import LEAF_TOKENS, fit, probes
from riskwave.llm.bm25_retrieval import INDEX_TOKENS, assign, bag, neighbours, open_bag, questions
from riskwave.llm.bm25_retrieval import unpack as _unpack
from riskwave.llm.common import emit, materialise
from riskwave.llm.pretokens import loaded

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 1 << 19
K1, B = 1.2, 0.75         # BM25

PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long")
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                     ("offset", pa.int64())])


def _tokenise(path: str, end_id: int):
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("packed", pa.binary()),
                        ("bag", pa.binary())])

    def run(batches):
        import zstandard
        tok, squeeze = loaded(path), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], tok.dtype).tobytes()
        for batch in batches:
            blobs = [(tok.encode(t) if t else b"") + end for t in batch.column("text").to_pylist()]
            yield emit(schema, {"uid": batch.column("uid"), "doc_id": batch.column("doc_id"),
                                "n": [len(b) // tok.dtype.itemsize for b in blobs],
                                "packed": [squeeze.compress(b) for b in blobs],
                                "bag": [bag(np.frombuffer(b, tok.dtype), squeeze) for b in blobs]})
    return run


def _doc_frequencies(path: str):
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def run(batches):
        loaded(path).forget()              # the tokens are made
        dtype = loaded(path).dtype
        df = np.zeros(loaded(path).tokenizer.get_vocab_size(), np.int64)
        for batch in batches:
            for blob in batch.column("bag").to_pylist():
                df[open_bag(blob, dtype)[0]] += 1
        terms = np.flatnonzero(df)
        yield emit(schema, {"term": terms, "df": df[terms]})
    return run


class ShardIndex:
    """BM25 inverted index of one shard: postings of a term are the slice
    ``starts[t]:starts[t + 1]`` of (document, weight)."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        terms, counts = zip(*(np.unique(d, return_counts=True) for d in docs))
        sizes = np.array([len(t) for t in terms])
        self.terms = terms
        length = np.array([len(d) for d in docs])
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        term, tf = np.concatenate(terms).astype(np.int64), np.concatenate(counts)
        norm = K1 * (1 - B + B * length / max(mean_length, 1e-9))
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the seed's terms."""
        t = self.terms[seed].astype(np.int64)
        first, many = self.starts[t], self.starts[t + 1] - self.starts[t]
        at = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        return np.bincount(self.doc[at], self.weight[at], len(self.terms))


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_length: float,
               window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) covering all ids."""
    index = ShardIndex(docs, idf, mean_length)
    unused = np.ones(len(docs), bool)
    pieces, sequence, fill = [], 0, 0

    def place(d: int) -> bool:
        """Put a document where the last one ended; true if a window was
        filled and part of the document opens the next."""
        nonlocal sequence, fill
        unused[d] = False
        at, left, crossed = 0, len(docs[d]), False
        while left:
            crossed = fill == 0 and at > 0
            n = min(window - fill, left)
            pieces.append((d, at, n, sequence, fill))
            at, left, fill = at + n, left - n, fill + n
            if fill == window:
                sequence, fill = sequence + 1, 0
        return crossed and fill > 0

    order = iter(range(len(docs)))
    seed = next(order, None)
    placed = False
    while seed is not None:
        if not placed:
            place(seed)
        placed, following = False, None
        if fill:
            rank = np.where(unused, index.scores(seed), -1.0)
            for d in np.argsort(-rank, kind="stable"):
                if rank[d] < 0:
                    break
                if place(int(d)):
                    following, placed = int(d), True
                    break
                if not fill:
                    break
        if following is None:
            following = next((d for d in order if unused[d]), None)
        seed = following
    if fill:
        pieces = _cut_last(pieces, sequence, powers_of_two(fill))
    return pieces


def _cut_last(pieces, sequence: int, sizes: list[int]):
    """Cut the unfilled last sequence into sequences of the given sizes."""
    out = [p for p in pieces if p[3] != sequence]
    last, fill = [p for p in pieces if p[3] == sequence], 0
    for d, start, n, _, _ in last:
        while n:
            take = min(n, sizes[0] - fill)
            out.append((d, start, take, sequence, fill))
            start, n, fill = start + take, n - take, fill + take
            if fill == sizes[0]:
                sizes, sequence, fill = sizes[1:], sequence + 1, 0
    return out


def lay(docs: list[np.ndarray], window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces of the documents laid end to end in windows."""
    pieces, sequence, fill = [], 0, 0
    for d, ids in enumerate(docs):
        at = 0
        while at < len(ids):
            n = min(window - fill, len(ids) - at)
            pieces.append((d, at, n, sequence, fill))
            at, fill = at + n, fill + n
            if fill == window:
                sequence, fill = sequence + 1, 0
    return _cut_last(pieces, sequence, powers_of_two(fill)) if fill else pieces


def _rows(pieces, docs: list[np.ndarray], ids: list, number: int) -> pa.Table:
    cols = {
        "doc_id": [ids[d] for d, *_ in pieces], "start": [p[1] for p in pieces],
        "length": [p[2] for p in pieces],
        "ids": [docs[d][s:s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces],
        "doc_tokens": [len(docs[p[0]]) for p in pieces],
        "sequence_id": [number << 32 | p[3] for p in pieces], "offset": [p[4] for p in pieces]}
    return pa.Table.from_arrays([pa.array(cols[f.name], f.type) for f in _PIECES], schema=_PIECES)


def _pieces(dtype: np.dtype, window: int, stats, grouped: int):
    """Lay the groups of a shard end to end; shards from ``grouped`` on hold
    documents without a group, packed by search."""
    def run(shard: pa.Table) -> pa.Table:
        number = shard.column("shard")[0].as_py()
        shard = shard.sort_by([("round", "ascending"), ("seed", "ascending"), ("score", "descending"),
                               ("uid", "ascending")])
        docs = [_unpack(p, dtype) for p in shard.column("packed").to_pylist()]
        pieces = lay(docs, window) if number < grouped else pack_shard(docs, *stats.value, window)
        return _rows(pieces, docs, shard.column("doc_id").to_pylist(), number)
    return run


def groups(tokens: DataFrame, n_docs: int, n_tokens: int, dtype: np.dtype, stats, window: int = WINDOW,
           shard_tokens: int = SHARD_TOKENS, index_tokens: int = INDEX_TOKENS, exact_pairs: int | None = None,
           leaf_tokens: int = LEAF_TOKENS):
    """(uid, seed, score, round) of the documents in groups (a seed stands in
    its own, with an infinite score), and (uid, n) of the documents that no
    seed took, with their tokens; None for no groups.  With ``exact_pairs``,
    rounds of more pairs of a seed and a document ask leaves of similar
    documents only, which may miss neighbours (``bm25_leaves``)."""
    left, placed, round_, rate, leaves = tokens.select("uid", "n"), None, 0, 0.0, None
    bags = tokens.select("uid", "n", "bag")
    while n_docs and (rate < 0.5 or n_tokens > shard_tokens):
        rate = min(0.5, 2 ** round_ * n_tokens / window / n_docs)
        is_seed = F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(1 << 30)) < int(rate * (1 << 30))
        if left.where(is_seed).isEmpty():               # few documents
            round_ += 1
            continue
        if exact_pairs is None or rate * n_docs * n_docs <= exact_pairs:
            unused = bags if placed is None else bags.join(left.select("uid"), "uid", "left_semi")
            edges = neighbours(unused, is_seed, dtype, stats, n_tokens, index_tokens)
        else:
            if leaves is None:
                shared, of_docs = fit(bags, n_docs, n_tokens, dtype, stats, leaf_tokens)
                left = of_docs if placed is None else of_docs.join(left.select("uid"), "uid", "left_semi")
            unused = bags.drop("n").join(left.select("uid", "leaf"), "uid")
            asked = questions(unused, is_seed, dtype)
            leaves = leaves or (shared, probes(unused, asked, dtype, stats, shared))
            edges = neighbours(unused, is_seed, dtype, stats, n_tokens, leaves=leaves, seeds=asked)
        seeds = left.where(is_seed)
        free = materialise(edges.join(seeds.select("uid"), "uid", "left_anti"), "neighbours")
        room = seeds.select(F.col("uid").alias("seed"), F.pmod(-F.col("n"), F.lit(window)).alias("room"))
        own = seeds.select("uid", F.col("uid").alias("seed"), F.lit(float("inf")).cast("float").alias("score"))
        taken = assign(free.select("seed", "uid", "score"), left, room.where("room > 0"))
        new = materialise((own if taken is None else own.unionAll(taken)).withColumn("round", F.lit(round_)), "groups")
        placed = new if placed is None else placed.unionAll(new)
        left = materialise(left.join(new.select("uid"), "uid", "left_anti"), "left")
        n_docs, n_tokens = left.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        round_ += 1
    return placed, left, n_tokens


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text",
                   shard_tokens: int = SHARD_TOKENS, index_tokens: int = INDEX_TOKENS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tok = loaded(tokenizer_path)
    tokens, n_docs, n_tokens = tokenised(docs, tokenizer_path, end_id, id_col, text_col)
    if not n_docs:
        return spark.createDataFrame([], PIECES)
    stats = statistics(tokens, tokenizer_path, n_docs, n_tokens)
    placed, left, rest = groups(tokens, n_docs, n_tokens, tok.dtype, stats, window, shard_tokens, index_tokens)
    shards, last = max(1, -(-(n_tokens - rest) // shard_tokens)), max(1, -(-rest // shard_tokens))
    alone = left.select("uid", F.lit(None).cast("long").alias("seed"), F.lit(None).cast("float").alias("score"),
                        F.lit(None).cast("int").alias("round"),
                        (F.pmod(F.xxhash64("uid"), F.lit(last)) + F.lit(shards)).alias("shard"))
    if placed is not None:
        alone = alone.unionAll(placed.withColumn("shard", F.pmod(F.xxhash64("seed"), F.lit(shards)))
                               .select("uid", "seed", "score", "round", "shard"))
    return (tokens.drop("bag", "n").join(alone, "uid").groupBy("shard")
            .applyInArrow(_pieces(tok.dtype, window, stats, shards), PIECES))


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id",
              text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(uid, doc_id, n, packed, bag) of all documents, their number and tokens."""
    tokens = materialise(
        docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"),
                    F.col(text_col).alias("text"))
        .mapInArrow(_tokenise(tokenizer_path, end_id), "uid long, doc_id long, n long, packed binary, bag binary"),
        "tokens")
    return tokens, *tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()


def statistics(tokens: DataFrame, tokenizer_path: str, n_docs: int, n_tokens: int):
    """Broadcast (inverse document frequencies, mean length) of all documents."""
    df = np.zeros(loaded(tokenizer_path).tokenizer.get_vocab_size())          # one figure per vocabulary entry
    for r in (tokens.select("bag").mapInArrow(_doc_frequencies(tokenizer_path), "term long, df long")
              .groupBy("term").agg(F.sum("df").alias("df")).collect()):
        df[r.term] = r.df
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    return tokens.sparkSession.sparkContext.broadcast((idf, n_tokens / n_docs))
