import zlib
from collections import defaultdict

import numpy as np
import pytest
public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from riskwave.llm import bm25_packing as m  # noqa: E402
from riskwave.llm.queries import QUERIES  # noqa: E402

from edge_rows import edge_docs, empty_docs  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def want_ids(text):
    return (TOK.encode(text, add_special_tokens=False).ids if text else []) + [2]


def check_sequences(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == m.WINDOW or at & (at - 1) == 0
        assert at <= m.WINDOW


def test_query_holds_every_id_once(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op3_bm25_packing"](spark, sf).collect()
    check_sequences(rows)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(by) == len(docs)
    for d in docs:
        ids = np.array(want_ids(d.text), "<u4")
        at = 0
        for r in sorted(by[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_edges(spark):
    assert m.pack_documents(empty_docs(spark), PATH).count() == 0
    docs = edge_docs(spark)
    rows = m.pack_documents(docs, PATH, shard_tokens=1 << 12).collect()
    check_sequences(rows)
    assert sum(r.length for r in rows) == sum(len(want_ids(d.text)) for d in docs.collect())


def test_neighbours_by_brute_force_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50, rng.integers(1, 40)).astype("<u2") for _ in range(60)]
    df = np.zeros(50)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log1p((60 - df + .5) / (df + .5)).astype(np.float32)
    mean = np.mean([len(d) for d in docs])
    index = m.ShardIndex(docs, idf, mean)
    for seed in (0, 7, 59):
        want = [sum(idf[t] * (d == t).sum() * (m.K1 + 1) /
                    ((d == t).sum() + m.K1 * (1 - m.B + m.B * len(d) / mean))
                    for t in set(docs[seed].tolist()) if (d == t).any()) for d in docs]
        assert np.allclose(index.scores(seed), want, rtol=1e-4)
    pieces = m.pack_shard(docs, idf, mean, 64)
    # the second document of the first window is the seed's best neighbour
    scores = index.scores(0)
    scores[0] = -1
    assert pieces[0][0] == 0 and pieces[1][0] == int(np.argmax(scores))
    assert sum(p[2] for p in pieces) == sum(map(len, docs))


def global_top(tokens, seeds, k):
    """Brute-force BM25 over all documents by all terms: {seed: best uids}."""
    dtype = m.loaded(PATH).dtype
    docs = {r.uid: r_unpack(r.packed, dtype) for r in tokens.select("uid", "packed").collect()}
    uids = np.array(list(docs))
    sets = [np.unique(d, return_counts=True) for d in docs.values()]
    df = np.zeros(m.loaded(PATH).tokenizer.get_vocab_size())
    for t, _ in sets:
        df[t] += 1
    idf = np.log1p((len(docs) - df + .5) / (df + .5))
    lengths = np.array([len(d) for d in docs.values()])
    norm = m.K1 * (1 - m.B + m.B * lengths / lengths.mean())
    weights = [idf[t] * c * (m.K1 + 1) / (c + b) for (t, c), b in zip(sets, norm)]
    out = {}
    for s in seeds:
        asked = np.zeros(len(df))
        asked[docs[s]] = 1
        score = np.array([(w * asked[t]).sum() for (t, _), w in zip(sets, weights)])
        score[uids == s] = -1
        out[s] = dict(zip(uids[(top := np.argsort(-score, kind="stable")[:k])].tolist(), score[top]))
    return out


def r_unpack(packed, dtype):
    from riskwave.llm.bm25_retrieval import unpack
    return unpack(packed, dtype)


@pytest.mark.parametrize("sf, index_tokens", [("0.01", 1 << 18), ("0.1", 1 << 23)])
def test_recall_of_the_sharded_index_against_bm25_over_all_documents(spark, sf, index_tokens):
    """At least nine of ten true neighbours, over several shards."""
    from pyspark.sql import functions as F

    from riskwave.llm import bm25_retrieval as r
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    tokens, n_docs, n_tokens = m.tokenised(docs, PATH)
    assert n_tokens > index_tokens
    stats = m.statistics(tokens, PATH, n_docs, n_tokens)
    seeds = [row.uid for row in tokens.orderBy(F.xxhash64("uid")).limit(100).collect()]
    found = r.neighbours(tokens, F.col("uid").isin(seeds), m.loaded(PATH).dtype, stats, n_tokens, index_tokens).collect()
    got = defaultdict(dict)
    for row in found:
        if row["rank"] <= 10:
            got[row.seed][row.uid] = row.score
    want = global_top(tokens, seeds, 10)
    # a neighbour with the score of the tenth is as good as the tenth
    hit = sum(sum(x >= min(best.values()) * (1 - 1e-5) for x in got[s].values()) for s, best in want.items())
    recall = hit / sum(map(len, want.values()))
    print("recall at 10:", recall)
    assert recall >= 0.9


def test_groups_hold_every_document_once_and_windows_hold_neighbours(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(docs.where("doc_id % 3 = 0"))          # copies
    tokens, n_docs, n_tokens = m.tokenised(docs, PATH)
    stats = m.statistics(tokens, PATH, n_docs, n_tokens)
    placed, left, rest = m.groups(tokens, n_docs, n_tokens, m.loaded(PATH).dtype, stats, shard_tokens=1 << 14,
                                  index_tokens=1 << 19)
    rows, alone = placed.collect(), left.collect()
    assert sorted([r.uid for r in rows] + [r.uid for r in alone]) == sorted(r.uid for r in tokens.collect())
    assert rest == sum(r.n for r in alone)
    size = {r.uid: r.n for r in tokens.collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.seed].append(r)
    for seed, group in by.items():
        group.sort(key=lambda r: (-r.score, r.uid))
        assert group[0].uid == seed
        # only one of those taken may go beyond the window
        room, taken = -size[seed] % m.WINDOW, [size[r.uid] for r in group[1:]]
        assert not taken or sum(taken) - max(taken) < room
    pieces = m.pack_documents(docs, PATH, shard_tokens=1 << 14, index_tokens=1 << 19).collect()
    check_sequences(pieces)
    assert sum(p.length for p in pieces) == n_tokens and sum(p.start == 0 for p in pieces) == n_docs


def test_index_by_brute_force():
    from riskwave.llm import bm25_retrieval as r
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 50, rng.integers(1, 40)).astype("<u2") for _ in range(60)]
    idf = rng.random(50).astype(np.float32) + .1
    mean = np.mean([len(d) for d in docs])
    index = r.Index(np.arange(100, 160), docs, idf, mean)
    for seed in (0, 7, 59):
        terms = np.unique(docs[seed])
        want = np.array([sum(idf[t] * (d == t).sum() * (r.K1 + 1) /
                             ((d == t).sum() + r.K1 * (1 - r.B + r.B * len(d) / mean))
                             for t in terms.tolist() if (d == t).any()) for d in docs])
        want[seed] = 0
        c, score = index.search(100 + seed, terms, 8, strong=50, candidates=100)
        assert np.allclose(score, np.sort(want)[::-1][:8], rtol=1e-4) and np.allclose(score, want[c], rtol=1e-4)


def test_neighbours_that_share_only_frequent_terms_are_found():
    """A copy without the seed's rarest terms is still its best neighbour by all terms."""
    from riskwave.llm import bm25_retrieval as r
    seed, rare = np.arange(100, 400), np.arange(40)
    docs = [np.concatenate([rare, seed])] + [np.concatenate([rare[i % 40:i % 40 + 1], [400 + i]]) for i in range(600)]
    docs = [d.astype("<u2") for d in docs + [seed]]
    idf = np.concatenate([np.full(40, 3.), np.full(360, 1.), np.full(700, 1.)]).astype(np.float32)
    index = r.Index(np.arange(len(docs)), docs, idf, np.mean([len(d) for d in docs]))
    c, _ = index.search(0, docs[0], 8)
    assert c[0] == len(docs) - 1


def test_a_shard_that_holds_most_neighbours_is_asked_again(spark):
    """All neighbours of a seed in one of many shards are kept."""
    import zstandard
    from pyspark.sql import functions as F

    from riskwave.llm import bm25_retrieval as r
    squeeze = zstandard.ZstdCompressor().compress
    shards = 16
    ids = spark.range(4000).select("id", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("s")).collect()
    near = [x.id for x in ids if x.s == 3][:60]
    docs = {x.id: np.array([5000 + x.id % 40000], "<u2") for x in ids}
    docs |= {u: np.array([7, 8, *range(10, 10 + n)], "<u2") for n, u in enumerate(near)}
    rows = [(u, len(d), bytearray(squeeze(d.tobytes()))) for u, d in docs.items()]
    tokens = spark.createDataFrame(rows, "uid long, n long, packed binary")
    stats = spark.sparkContext.broadcast((np.ones(50000, np.float32), 1.0))
    found = r.neighbours(tokens, F.col("uid") == near[0], np.dtype("<u2"), stats, shards * 10, 10).collect()
    assert {row.uid for row in found} == set(near[1:])


def test_small_tables_are_grouped_like_large_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    tokens, n_docs, n_tokens = m.tokenised(docs, PATH)
    assert n_tokens < m.SHARD_TOKENS
    stats = m.statistics(tokens, PATH, n_docs, n_tokens)
    placed, left, _ = m.groups(tokens, n_docs, n_tokens, m.loaded(PATH).dtype, stats)
    assert placed is not None and placed.count() + left.count() == n_docs


def test_workers_keep_no_words_once_the_tokens_are_made():
    import pyarrow as pa
    tok = m.loaded(PATH)
    text = pa.RecordBatch.from_pydict({"uid": [0], "doc_id": [0], "text": ["some words that are kept"]})
    (tokens,) = m._tokenise(PATH, 2)([text])
    assert len(tok._ids) and len(tok._ids.pieces)
    (df,) = m._doc_frequencies(PATH)([tokens])
    assert df.num_rows == len(set(want_ids("some words that are kept")))
    assert not len(tok._ids) and not len(tok._ids.pieces)
    (again,) = m._tokenise(PATH, 2)([text])
    assert again.equals(tokens)


def test_leaves_find_nine_of_ten_neighbours_and_ask_few_of_the_pairs(spark):
    """The search by leaves, which larger tables get, against BM25 over all documents."""
    from pyspark.sql import functions as F

    from riskwave.llm import bm25_leaves as b
    from riskwave.llm import bm25_retrieval as r
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    tokens, n_docs, n_tokens = m.tokenised(docs, PATH)
    dtype, stats = m.loaded(PATH).dtype, m.statistics(tokens, PATH, n_docs, n_tokens)
    shared, of_docs = b.fit(tokens, n_docs, n_tokens, dtype, stats, leaf_tokens=1 << 18)
    tokens = tokens.join(of_docs.select("uid", "leaf"), "uid")
    assert tokens.count() == n_docs and len(shared.value.centres) > 30
    seeds = [row.uid for row in tokens.orderBy(F.xxhash64("uid")).limit(100).collect()]
    many = b.probes(tokens, r.questions(tokens, F.pmod("uid", F.lit(7)) == 0, dtype), dtype, stats, shared)
    assert many < shared.value.parts.sum() / 2
    found = r.neighbours(tokens, F.col("uid").isin(seeds), dtype, stats, n_tokens, leaves=(shared, many)).collect()
    got = defaultdict(dict)
    for row in found:
        if row["rank"] <= 10:
            got[row.seed][row.uid] = row.score
    want = global_top(tokens, seeds, 10)
    hit = sum(sum(x >= min(best.values()) * (1 - 1e-5) for x in got[s].values()) for s, best in want.items())
    recall = hit / sum(map(len, want.values()))
    print("recall at 10 by leaves:", recall, "parts asked:", many, "of", shared.value.parts.sum())
    assert recall >= 0.9


def test_groups_by_leaves_hold_every_document_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(docs.where("doc_id % 3 = 0")).unionAll(docs.limit(1).crossJoin(spark.range(300)).drop("id"))
    tokens, n_docs, n_tokens = m.tokenised(docs, PATH)
    stats = m.statistics(tokens, PATH, n_docs, n_tokens)
    placed, left, rest = m.groups(tokens, n_docs, n_tokens, m.loaded(PATH).dtype, stats, exact_pairs=0,
                                  leaf_tokens=1 << 16)
    rows, alone = placed.collect(), left.collect()
    assert sorted([r.uid for r in rows] + [r.uid for r in alone]) == sorted(r.uid for r in tokens.collect())
    assert rest == sum(r.n for r in alone) < n_tokens / 4


def test_a_large_group_of_copies_is_dealt_to_parts():
    from riskwave.llm import bm25_leaves as b
    rng = np.random.default_rng(2)
    docs = [np.unique(rng.integers(0, 200, 30)) for _ in range(50)] + [np.arange(40)] * 500
    leaves = b.learn(docs, [np.ones(len(d), np.float32) for d in docs], 200, 8)
    leaf = leaves.nearest(leaves.project(docs, [np.ones(len(d), np.float32) for d in docs]))
    assert len(set(leaf[50:].tolist())) == 1
    leaves.deal(dict(enumerate(np.bincount(leaf, minlength=8) * 40)), 2000)
    uids = np.arange(550)
    part = leaves.part(uids, leaf)
    assert np.bincount(part).max() < 120                     # not all 500 in one
    order = leaves.order(uids, docs, leaf, 3)
    assert all(len(o) == len(set(o.tolist())) == 3 for o in order)
    assert all(leaves.first[k] <= o[0] < leaves.first[k + 1] for o, k in zip(order, leaf))
    assert all(len(o) == leaves.parts.sum() for o in leaves.order(uids, docs, leaf, 10 ** 6))


def test_large_tables_are_searched_whole_and_few_documents_are_left(spark, monkeypatch):
    """Every seed in every shard, whatever the number of pairs; what no seed took fits one packing shard."""
    def never(*_):
        raise AssertionError("asked in leaves only")
    monkeypatch.setattr(m, "fit", never)
    docs = spark.range(24_000).selectExpr("id AS doc_id", "concat('word', id % 4000, ' red blue') AS text")
    tokens, n_docs, n_tokens = m.tokenised(docs, PATH)
    stats = m.statistics(tokens, PATH, n_docs, n_tokens)
    placed, left, rest = m.groups(tokens, n_docs, n_tokens, m.loaded(PATH).dtype, stats, window=8, shard_tokens=1 << 12)
    assert min(0.5, n_tokens / 8 / n_docs) * n_docs ** 2 > 1 << 28
    assert placed.count() + left.count() == n_docs and rest <= 1 << 12
