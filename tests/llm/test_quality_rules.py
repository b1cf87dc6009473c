import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from riskwave.llm import quality_rules as m
from riskwave.llm.labelled import held_out
from riskwave.llm.queries import QUERIES

from edge_rows import edge_docs, empty_docs

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
    lines, dup = text.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text("ab \n#>\x85é", max_size=60))
def test_base_counts(text):
    assert m.base_counts(text) == brute(text)


def test_hashed_means_do_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    model = m.QualityModel(rng.normal(size=(4, m.BUCKETS)).astype(np.float32), 0.1, 1.0, 0.0)
    texts = ["the cat sat", "", "a", "x " * 500, "naïve 漢字 word", " lead and trail "]
    together = model.probabilities(texts)
    assert np.allclose(together, [model.probabilities([t])[0] for t in texts])


@pytest.fixture(scope="module")
def rows(spark):
    return QUERIES["op1_quality_rules"](spark, SF).toPandas()


def test_query_on_the_whole_table(spark, rows):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(rows.doc_id) == sorted(docs)
    for r in rows.itertuples():
        if len(docs[r.doc_id]) < 4000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(docs[r.doc_id])
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.quality_prob >= m.MIN_QUALITY)


def test_held_out_accuracy(spark, rows):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(held_out()).toPandas()
    both = rows.merge(labels, on="doc_id")
    good, bad = both[both.quality == 1].quality_prob, both[both.quality == 0].quality_prob
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None]).mean() > 0.85
    assert (good >= m.MIN_QUALITY).mean() > 0.95


def test_edges(spark):
    assert m.judge(empty_docs(spark), None, ["doc_id"]).count() == 0
    docs = edge_docs(spark)
    no_labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert m.train(docs, no_labels) is None
    out = m.judge(docs, None, ["doc_id", "text", "kept"]).collect()
    assert len(out) == docs.count()
    for r in out:
        t = r["text"] or ""
        if len(t) < 2000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t)
        assert r.quality_prob is None


def test_the_fit_holds_little_beside_its_sample():
    """Scratch arrays of the fit are small whatever the sample's rows and batches."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(7)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(20_000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 10_000 + 10_000 * (k % 2), 1500)) for k in range(150)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "label": [k % 2 for k in range(150)],
                                        "fold": [k % 5 for k in range(150)]})
    entries = sum(len(at) for at, _ in m._features(texts))
    tracemalloc.start()
    (out,) = m._train_rows({0: 75, 1: 75}, m.SAMPLE_ENTRIES)([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 1 and entries > 1_500_000
    assert peak < 8 * entries + 40e6, (peak, entries)
