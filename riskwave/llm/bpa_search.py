"""Ranked lexical search with the Best Position Algorithm.

Items are ranked against documents by integer impacts.  Terms are the
maximal runs of letters and digits of ASCII and of all other characters,
A-Z lower-cased.  With N documents that hold a term, L terms in all, n terms
in a document, and df documents that hold a term, a term weighs
``floor(1000 * ln((2N + 2) / (2df + 1)))``, a document's m is
``100 - 50 + (50 * n * N) div L``, and a term that occurs tf times gives
``w * ((10^9 * tf) div (1000 * tf + 20 * m))``.

1. One pass over the documents keeps the occurrences of the items' terms
   (whole texts are read; n counts all terms), written with a row number.
   N, L and every df come from all documents.
2. Documents are dealt to shards by a hash of the row number, a shard holding
   about ``SHARD_POSTINGS`` occurrences.  A shard sorts one impact list per
   term and searches every item in it: rows are read from all of the item's
   lists in parallel; a document met for the first time is looked up in all
   other lists, and its positions there count as seen too.  A list's best
   position is the end of its unbroken run of seen positions.  No unseen
   document can score more than the sum of the impacts that follow the best
   positions, and reading stops when that sum is strictly below the kth score,
   so ties are never lost.
3. Shards go in waves, each ``WAVE`` times as many as all before.  The kth
   scores after a wave bound the next one, so a wave passes on about ``WAVE``
   times k rows per item whatever the number of shards, in place of k rows per
   item and shard.

Items are taken in blocks of about ``ITEM_BYTES`` of text; only a block's
terms, weights and kth scores are broadcast.

Null and empty texts hold no term: such documents are not counted, such items
have no result.  Very long texts are read whole by their task and leave at
most one occurrence count per term of the block.  Equal scores go to the
smaller doc_id (null first), then to the earlier row; repeated rows, of
documents or items, count once each.  Empty tables give an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskwave.llm.common import emit, materialise

K = 50
SHARD_POSTINGS = 1 << 19
FIRST_WAVE, WAVE = 4, 16        # shards of the first wave, growth of the next ones
ITEM_BYTES = 4 << 20            # text of the items that are searched at once
FIRST_READ = 32                 # rows read from each list at first; then twice as many

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
              for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The text's terms in order, as UTF-8."""
    return text.encode().translate(_KEEP).split() if text else []


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ---- one shard ----------------------------------------------------------------

class ImpactLists:
    """The impact lists of a shard's terms, and each document's entries in
    them.  ``sizes`` holds the number of entries of each document."""

    def __init__(self, terms: np.ndarray, impact: np.ndarray, sizes: np.ndarray, n_terms: int):
        self.term, self.impact = terms, impact
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((doc, -impact, terms))
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.position = np.empty(len(terms), np.int64)
        self.position[order] = np.arange(len(terms)) - self.starts[terms[order]]
        self.known = np.zeros(len(sizes), bool)
        self.slot = np.full(n_terms, -1)

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All entries of ``docs`` and the document (by its place) of each."""
        many = self.first[docs + 1] - self.first[docs]
        ends = np.cumsum(many)
        at = np.arange(ends[-1]) + np.repeat(self.first[docs] - ends + many, many)
        return at, np.repeat(np.arange(len(docs)), many)

    def search(self, item: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the k best for the terms ``item`` with
        their scores, all that reach ``max(1, least, kth score)`` among them;
        and the number of documents looked up."""
        lists = item[self.starts[item + 1] > self.starts[item]]
        start, length = self.starts[lists], self.starts[lists + 1] - self.starts[lists]
        begin = np.concatenate(([0], np.cumsum(length)))[:-1]    # of each list in ``unseen``
        unseen = np.ones(int(length.sum()), bool)
        best = np.zeros(len(lists), np.int64)
        self.slot[lists] = np.arange(len(lists))
        found, scores, depth, step, looked = [], [], 0, FIRST_READ, 0
        top = np.zeros(0)
        while len(lists):
            rows = [self.list_doc[s + depth:s + min(depth + step, n)] for s, n in zip(start, length) if n > depth]
            if not rows:
                break
            met = np.unique(np.concatenate(rows))
            new = met[~self.known[met]]
            depth, step = depth + step, step * 2
            if len(new):
                self.known[new] = True
                looked += len(new)
                at, owner = self.entries(new)
                slot = self.slot[self.term[at]]
                at, owner, slot = at[slot >= 0], owner[slot >= 0], slot[slot >= 0]
                score = np.bincount(owner, self.impact[at], len(new))
                unseen[begin[slot] + self.position[at]] = False
                found.append(new)
                scores.append(score)
                top = np.concatenate((top, score))
                if len(top) > k:
                    top = np.partition(top, len(top) - k)[len(top) - k:]
            # Best positions, and what can follow them.
            follow = 0
            for i, n in enumerate(length):
                if best[i] < n:
                    rest = unseen[begin[i] + best[i]:begin[i] + n]
                    j = int(rest.argmax())
                    best[i] = best[i] + j if rest[j] else n
                    if best[i] < n:
                        follow += int(self.list_impact[start[i] + best[i]])
            if follow < least or follow == 0 or (len(top) == k and follow < top.min()):
                break
        self.slot[lists] = -1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        docs, score = np.concatenate(found), np.concatenate(scores).astype(np.int64)
        self.known[docs] = False
        keep = score >= max(1, least, int(top.min()) if len(top) == k else 0)
        return docs[keep], score[keep], looked


# ---- on Spark -----------------------------------------------------------------

@dataclass
class _Block:
    """A block of items: their ids, term numbers, and the kth scores so far."""
    item_ids: list
    terms: list[np.ndarray]
    weight: np.ndarray
    n_docs: int
    n_terms: int
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _occurrences(vocabulary):
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("size", pa.int64()),
                        ("terms", pa.binary()), ("tf", pa.binary())])

    def run(batches):
        number = vocabulary.value.get
        for batch in batches:
            rows = {name: [] for name in ("n", "size", "terms", "tf")}
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                count = Counter(map(number, words))
                count.pop(None, None)
                own = np.array(sorted(count), np.int32)
                rows["n"].append(len(words))
                rows["size"].append(len(own))
                rows["terms"].append(own.tobytes())
                rows["tf"].append(np.array([count[t] for t in own.tolist()], np.int32).tobytes())
            yield emit(schema, {"uid": batch.column("uid"), "doc_id": batch.column("doc_id"), **rows})
    return run


def _doc_frequencies(n_terms: int):
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=n_terms)
        own = np.flatnonzero(df)
        yield emit(schema, {"term": own, "df": df[own]})
    return run


HITS = "item long, item_id long, doc_id long, uid long, score long"
_HITS = pa.schema([(name, pa.int64()) for name in ("item", "item_id", "doc_id", "uid", "score")])


def _search_shard(block, k: int):
    def run(shard: pa.Table) -> pa.Table:
        b = block.value
        shard = shard.sort_by("uid")
        n, sizes = (shard.column(c).to_numpy() for c in ("n", "size"))
        term, tf = (np.frombuffer(b"".join(shard.column(c).to_pylist()), np.int32).astype(np.int64)
                    for c in ("terms", "tf"))
        m = np.repeat(50 + 50 * n * b.n_docs // b.n_terms, sizes)
        impact = b.weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
        lists = ImpactLists(term, impact, sizes, len(b.weight))
        ids, uid = shard.column("doc_id").to_pylist(), shard.column("uid").to_numpy()
        out = {f.name: [] for f in _HITS}
        for i, item in enumerate(b.terms):
            docs, score, _ = lists.search(item, k, int(b.least[i]))
            best = sorted(zip((-score).tolist(), [(ids[d] is not None, ids[d]) for d in docs], uid[docs].tolist()))[:k]
            out["item"] += [i] * len(best)
            out["item_id"] += [b.item_ids[i]] * len(best)
            out["doc_id"] += [x[1][1] for x in best]
            out["uid"] += [x[2] for x in best]
            out["score"] += [-x[0] for x in best]
        return pa.Table.from_batches([emit(_HITS, out)])
    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "uid")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: list, k: int, shard_postings: int) -> DataFrame | None:
    """Ranked documents of a block of (item_id, text)."""
    spark = docs.sparkSession
    words = [sorted(set(terms_of(text))) for _, text in items]
    number = {w: i for i, w in enumerate(sorted(set().union(*words)))}
    if not number:
        return None
    found = materialise(docs.mapInArrow(_occurrences(spark.sparkContext.broadcast(number)),
                                        "uid long, doc_id long, n long, size long, terms binary, tf binary"),
                        "occurrences")
    n_docs, n_terms, postings = found.where("n > 0").agg(F.count("*"), F.sum("n"), F.sum("size")).first()
    if not postings:
        return None
    df = {r["term"]: r["df"] for r in found.select("terms").mapInArrow(_doc_frequencies(len(number)), "term long, df long")
          .groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = np.array([term_weight(n_docs, df[t]) if t in df else 0 for t in range(len(number))], np.int64)
    numbered = [np.array([number[w] for w in own if weight[number[w]] > 0], np.int64) for own in words]
    block = _Block([i for i, _ in items], numbered, weight, n_docs, n_terms, np.zeros(len(items), np.int64))
    shards = -(-postings // shard_postings)
    dealt = found.where("size > 0").withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    best, done, until = None, 0, FIRST_WAVE
    while done < shards:
        wave = dealt.where((F.col("shard") >= done) & (F.col("shard") < until))
        hits = wave.groupBy("shard").applyInArrow(_search_shard(spark.sparkContext.broadcast(block), k), HITS)
        best = materialise(_ranked(hits if best is None else hits.unionByName(best.drop("rank")), k), "hits")
        for r in best.where(F.col("rank") == k).select("item", "score").collect():
            block.least[r["item"]] = r["score"]
        done, until = until, until * WAVE
    return best


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES,
           shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").alias("text"))
    asked = materialise(items.select(F.monotonically_increasing_id().alias("uid"),
                                     F.col(f"`{item_col}`").cast("long").alias("item_id"),
                                     F.col(f"`{item_text_col}`").alias("text")), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // item_bytes))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).where("text is not null").orderBy("uid")
        best = _search_block(rows, [(r["item_id"], r["text"]) for r in block.collect()], k, shard_postings)
        if best is not None:
            out = out.unionByName(best.select("item_id", "rank", "doc_id", "score"))
    return out


# DuckDB SQL for the query's rows (items with distinct ids).
def _sql_terms(column: str) -> str:
    lower = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


ORACLE = f"""
WITH texts AS (
  SELECT row_number() OVER () AS uid, doc_id, {_sql_terms("text")} AS terms FROM documents
), docs AS (
  SELECT uid, doc_id, CAST(len(terms) AS BIGINT) AS n FROM texts WHERE len(terms) > 0
), stats AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs
), occurrences AS (
  SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(terms) AS term FROM texts) GROUP BY uid, term
), asked AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_sql_terms("text")}) AS term FROM benchmark)
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM occurrences, stats GROUP BY term
), scored AS (
  SELECT item_id, uid, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN occurrences USING (term) JOIN weights USING (term) JOIN docs USING (uid), stats
  GROUP BY item_id, uid, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER)
    AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
