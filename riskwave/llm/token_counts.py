"""Token counts without materialising token ids.

Pieces are counted once per distinct pre-token of the corpus; a document's
count is the join of its pre-token frequencies with those piece counts,
summed.

1. Distinct pre-tokens of the corpus with their frequencies (partial counts
   per task, then one aggregation); each is tokenized once.
2. The ``head`` most frequent short pre-tokens are broadcast with their piece
   counts: at most ``head * (HEAD_BYTES + 8)`` bytes of payload, whatever the
   corpus.  One pass over the documents gives a row per document with its
   bytes and the sum over its head pre-tokens, and a row for each of its other
   pre-tokens with its frequency in the document.
3. Those rows are joined with the piece counts by pre-token and summed per
   document, partly before the second shuffle.  Document rows carry a join
   key of their own, so they spread over all partitions.  The same three steps
   run at every size and for every document.

Null or empty texts have 0 bytes and 0 tokens.  Every input row is counted by
itself, repeated rows too; a null id is an id like any other.  A very long
text is cut into pre-tokens whole; its rows are passed on in runs.  Other
columns of the input are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskwave.llm.common import emit, materialise
from riskwave.llm.pretokens import loaded

HEAD = 150_000            # pre-tokens broadcast to every task
HEAD_BYTES = 64           # longest pre-token in the broadcast
FLUSH = 200_000           # pre-tokens a task holds before passing them on


def _frequencies(path: str):
    schema = pa.schema([("pretoken", pa.string()), ("freq", pa.int64())])

    def run(batches):
        tok, held = loaded(path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.update(tok.pretokens(text))
                    if len(held) > FLUSH:
                        yield emit(schema, {"pretoken": list(held), "freq": list(held.values())})
                        held = Counter()
        yield emit(schema, {"pretoken": list(held), "freq": list(held.values())})
    return run


def _count_pieces(path: str):
    schema = pa.schema([("pretoken", pa.string()), ("freq", pa.int64()), ("pieces", pa.int64())])

    def run(batches):
        tok = loaded(path)
        for batch in batches:
            col = batch.column("pretoken")
            yield emit(schema, {"pretoken": col, "freq": batch.column("freq"),
                                "pieces": [len(tok.ids_of(p)) for p in col.to_pylist()]})
    return run


def pretoken_pieces(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """(pretoken, freq, pieces) of every distinct pre-token of the corpus."""
    return (docs.select(F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(_frequencies(tokenizer_path), "pretoken string, freq long")
            .groupBy("pretoken").agg(F.sum("freq").alias("freq"))
            .mapInArrow(_count_pieces(tokenizer_path), "pretoken string, freq long, pieces long"))


_ROWS = pa.schema([("uid", pa.int64()), ("key", pa.string()), ("freq", pa.int64()), ("doc_id", pa.int64()),
                   ("n_bytes", pa.int64())])


def _document_rows(path: str, head):
    """Per document: (uid, key of its own, head pieces, doc_id, n_bytes), and
    (uid, pretoken, frequency, null, null) for every other pre-token."""
    def run(batches):
        tok, known = loaded(path), dict(zip(*(c.to_pylist() for c in head.value.columns)))
        get = known.get
        for batch in batches:
            rows = {f.name: [] for f in _ROWS}
            for uid, doc_id, n_bytes, text in zip(*(c.to_pylist() for c in batch.columns)):
                pieces, tail = 0, []
                for p, n in Counter(tok.pretokens(text) if text else ()).items():
                    many = get(p)
                    if many is None:
                        tail.append((p, n))
                    else:
                        pieces += many * n
                # No pre-token holds a blank, so this key meets none of them.
                for name, value in zip(rows, (uid, f" {uid}", pieces, doc_id, n_bytes)):
                    rows[name].append(value)
                if tail:
                    words, freqs = zip(*tail)
                    rows["uid"] += [uid] * len(tail)
                    rows["key"] += words
                    rows["freq"] += freqs
                    rows["doc_id"] += [None] * len(tail)
                    rows["n_bytes"] += [None] * len(tail)
                if len(rows["uid"]) > FLUSH:
                    yield emit(_ROWS, rows)
                    rows = {f.name: [] for f in _ROWS}
            yield emit(_ROWS, rows)
    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_tokens, over_limit."""
    spark = docs.sparkSession
    pieces = materialise(pretoken_pieces(docs, tokenizer_path, text_col), "pretokens")
    top = (pieces.where(F.octet_length("pretoken") <= HEAD_BYTES)
           .orderBy(F.desc("freq"), "pretoken").limit(head).select("pretoken", "pieces")).toArrow()
    text = F.col(f"`{text_col}`")
    rows = (docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
            .mapInArrow(_document_rows(tokenizer_path, spark.sparkContext.broadcast(top)),
                        "uid long, key string, freq long, doc_id long, n_bytes long"))
    counts = pieces.select(F.col("pretoken").alias("key"), "pieces")
    n = F.sum("n").alias("n_tokens")
    return (rows.join(counts, "key", "left")
            .withColumn("n", F.col("freq") * F.coalesce("pieces", F.lit(1)))
            .groupBy("uid").agg(F.max("doc_id").alias(id_col), F.max("n_bytes").alias("n_bytes"), n)
            .select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit")))
