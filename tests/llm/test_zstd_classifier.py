import zlib

from riskwave.llm import zstd_classifier as m
from riskwave.llm.queries import QUERIES

from edge_rows import edge_docs, empty_docs

SF = "/root/testdata/sf0.01"


def test_query_and_held_out_accuracy(spark):
    rows = QUERIES["op6_zstd_classifier"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(rows.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    both = rows[rows.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    good, bad = both[both.quality == 1].score, both[both.quality == 0].score
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None]).mean() > 0.85


def test_edges(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, 7)], "doc_id long, quality int")
    docs = edge_docs(spark)
    assert m.train(docs, labels) is None           # nothing left to calibrate on
    out = m.score(docs, None).collect()
    assert len(out) == docs.count() and {r.score for r in out} == {0.5}
    assert m.score(empty_docs(spark), None).count() == 0
    model = m.Dictionaries(b"good words here " * 40, b"BAD!! BAD!! " * 40, 3.0, 0.5)
    out = m.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    empty = {r.score for r in out if r.doc_id in (0, 1)}
    assert len(empty) == 1                          # null and empty texts agree
