"""Best Position Algorithm against scoring every document."""
import random
import re
from collections import Counter

import numpy as np
from edge_rows import edge_docs, empty_docs

from riskwave.llm import bpa_search as bs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def brute(docs, items, k=50):
    """docs: (doc_id, text), items: (item_id, text) -> sorted (item_id, rank, doc_id, score)."""
    own = [(i, Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs)]
    own = [x for x in own if x[2]]
    n_docs, n_terms = len(own), sum(x[2] for x in own)
    df = Counter(t for x in own for t in x[1])
    out = []
    for item, text in items:
        scored = []
        for i, tf, n in own:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(bs.term_weight(n_docs, df[t]) * (10 ** 9 * tf[t] // (1000 * tf[t] + 20 * m))
                        for t in set(terms(text)) if tf[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df, items, **kw):
    return sorted((tuple(r) for r in bs.search(df, items, **kw).select("item_id", "rank", "doc_id", "score").collect()),
                  key=repr)


def test_terms_equal_the_pattern():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("aZz09 _-\n\x00\x7f\x85\xa0é漢🙂İſ@[`{/:") for _ in range(rng.randrange(30)))
        assert [t.decode() for t in bs.terms_of(text)] == terms(text)


def test_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(3)
    n_terms, n_docs = 40, 3000
    sizes = rng.integers(1, 20, n_docs)
    term = np.concatenate([np.sort(rng.choice(n_terms, s, replace=False)) for s in sizes])
    impact = (rng.pareto(1.2, len(term)) * 100).astype(np.int64) // 50 * 50          # many ties
    lists = bs.ImpactLists(term, impact, sizes, n_terms)
    doc = np.repeat(np.arange(n_docs), sizes)
    looked = []
    for _ in range(50):
        item = np.sort(rng.choice(n_terms, rng.integers(1, 6), replace=False))
        own = np.isin(term, item)
        score = np.bincount(doc[own], impact[own], n_docs).astype(np.int64)
        kth = np.sort(score)[-10]
        docs, got, n = lists.search(item, 10, 0)
        assert (score[docs] == got).all()
        assert set(np.flatnonzero(score >= max(1, kth))) <= set(docs.tolist())        # ties with the kth too
        docs, _, fewer = lists.search(item, 10, int(kth))                             # a kth score known before
        assert set(np.flatnonzero(score >= max(1, kth))) == set(docs.tolist()) and fewer <= n
        looked.append(n)
        assert not lists.known.any() and (lists.slot == -1).all()
    assert np.mean(looked) < n_docs / 4


def test_shards_waves_and_item_blocks(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    docs = [(i // 2, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(900)]
    docs += [(5000 + i, docs[3][1]) for i in range(300)]                              # a large group of copies
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(30)] + [(40, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert found(df, asked) == expected
    assert found(df, asked, shard_postings=100) == expected                           # about 200 shards, 3 waves
    assert found(df, asked, item_bytes=200, shard_postings=5000) == expected


def test_edges(spark):
    df = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    items = [(1, "the CAT sat on a mat"), (2, None), (3, ""), (4, "- !"), (5, "word1 word2 Ünïcode 漢字"), (None, "one row")]
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, score string")
    assert found(df, asked) == brute(rows, items)
    assert found(empty_docs(spark), asked) == [] and found(df, asked.limit(0)) == []
    assert found(df, asked.where("item_id in (2, 3, 4)")) == []
    double = spark.createDataFrame([(1, "cat"), (1, "cat")], "item_id long, text string")
    assert found(df, double) == sorted(brute(rows, [(1, "cat")]) * 2, key=repr)


def test_query(spark):
    from riskwave.llm.queries import op11_bpa_search
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in op11_bpa_search(spark, d).collect()), key=repr)
    assert got == brute(docs, items)
