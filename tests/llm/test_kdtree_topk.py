import numpy as np
import pytest
from pyspark.sql import functions as F

from riskwave.llm import kdtree_topk as m
from riskwave.llm.queries import ORACLES, QUERIES
from riskwave.oracle_check import duck

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, is_query, k):
    ok = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asks = {}
    for i, v in ok:
        if is_query(i):
            asks[i] = min(asks.get(i, v), v)
    out = []
    for i, q in asks.items():
        s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out += [(i, n + 1, j, -t) for n, (t, j) in enumerate(s)]
    return sorted(out)


def test_query_against_oracle(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, QUERIES["op7_kdtree_topk"](spark, sf).collect()))
    assert got == sorted(duck(sf).sql(ORACLES["op7_kdtree_topk"]).fetchall())


@pytest.mark.parametrize("shard_rows", [7, 40, 4096])
def test_ties_repeats_and_bad_rows(spark, shard_rows):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 4]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(150, 200)]                      # one common vector
    rows += [rows[10], rows[10], (11, rows[5][1]), (None, rows[0][1]), (300, None), (301, [1.0, None, 0.0, 0.0, 0.0]),
             (302, [float("nan")] * 5), (303, [float("inf")] * 5), (304, [1.0, 2.0]), (310, [2.0, 1.0]), (305, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = m.top_inner_products(df, F.col("vec_id") % 10 == 0, k=4, shard_rows=shard_rows)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0, 4)


def test_large_components_stay_exact():
    rng = np.random.default_rng(0)
    pts = rng.integers(-2**28, 2**28, (300, 8))
    tree = m.KdTree(np.arange(300), np.ones(300, np.int64), pts, leaf_rows=10)
    q = rng.integers(-2**28, 2**28, (1, 8))
    s, ids = tree.search(-1, q[0], tree.bounds(q)[:, 0], 5, None)
    want = sorted(((-sum(int(a) * int(b) for a, b in zip(p, q[0])), i) for i, p in enumerate(pts)))[:5]
    assert list(zip((-s).tolist(), ids.tolist())) == want


def test_empty(spark):
    assert m.top_inner_products(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
