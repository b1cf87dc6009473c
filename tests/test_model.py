"""Model invariants with a small ensemble: probabilities in [0,1],
confusion cells sum to n, save/load gives equal scores, contributions
add up to the margin and equal brute-force Shapley values."""

import itertools
import math
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskwave.functions import features as fx
from riskwave.ml import explain as mlx
from riskwave.ml import model as mlm
from riskwave.operators import scores as sc
from riskwave.operators.velocity import velocity_features
from riskwave.sources import transactions
from tests.conftest import SF_SMALL

SMALL = {"maxIter": 3, "maxDepth": 3}


@pytest.fixture(scope="module")
def trained(spark):
    t = transactions(spark, SF_SMALL)
    b, feats = mlm.train(t, SMALL)
    path = tempfile.mkdtemp(prefix="riskwave-model-test-")
    mlm.save(b, path)
    return t, mlm.load(spark, path), feats


def test_scores_and_confusion(trained):
    t, b, feats = trained
    s = mlm.score(b, t, feats)
    lo, hi, n = s.agg(F.min("probability"), F.max("probability"), F.count("*")).first()
    assert 0.0 <= lo <= hi <= 1.0
    cm = sc.confusion_matrix(s).first()
    assert cm.tn + cm.fp + cm.fn + cm.tp == n


def test_save_load_round_trip(spark, trained):
    t, b, feats = trained
    b2 = mlm.load(spark, b.path)
    a = mlm.score(b, t, feats).select("transaction_id", "probability")
    c = mlm.score(b2, t, feats).select("transaction_id", "probability")
    assert a.exceptAll(c).count() == 0


def test_one_pipeline_scores_raw_rows_in_a_new_session(spark, trained):
    t, b, feats = trained
    other = spark.newSession()
    raw = transactions(other, SF_SMALL)
    got = mlm.score_raw(mlm.load(other, b.path.rsplit("/", 1)[0]), raw)
    assert got.columns == [*raw.columns, "probability", "prediction"]
    want = {r.transaction_id: (r.probability, r.prediction) for r in mlm.score(b, t, feats).collect()}
    assert {r.transaction_id: (r.probability, r.prediction) for r in got.collect()} == want
    # values no vocabulary has, and nulls, are scored too
    odd = raw.limit(5).withColumn("channel", F.lit("pigeon")).withColumn("country", F.lit(None).cast("string"))
    codes = b.model.stages[0].transform(odd).select("f_channel").distinct().collect()
    assert [r[0] for r in codes] == [-1.0] and mlm.score_raw(b, odd).count() == 5


def test_a_half_written_bundle_is_never_read(spark, trained, tmp_path, monkeypatch):
    t, b, feats = trained
    path = str(tmp_path / "bundles")
    with pytest.raises(FileNotFoundError):
        mlm.load(spark, path)
    mlm.save(b, path)
    first = mlm.load(spark, path).path

    def dies(spark, name, text):
        if "/published/" in name:
            raise OSError("writer lost")
        real_publish(spark, name, text)
    real_publish = mlm.files.publish_text
    with monkeypatch.context() as m:
        m.setattr(mlm.files, "publish_text", dies)
        with pytest.raises(OSError):
            mlm.save(b, path)
    assert mlm.load(spark, path).path == first
    # a second writer that takes the same number does not hide the other's bundle
    seen = mlm._published(spark, path)
    mlm.save(b, path)
    second = mlm.load(spark, path).path
    stale = iter([seen])
    with monkeypatch.context() as m:
        real = mlm._published
        m.setattr(mlm, "_published", lambda s, p: next(stale, None) or real(s, p))
        mlm.save(b, path)
    assert len({first, second, mlm.load(spark, path).path}) == 3


def _value(tree, x, S, j=0):
    if tree["left"][j] < 0:
        return tree["value"][j]
    d = tree["feat"][j]
    l, r = tree["left"][j], tree["right"][j]
    if d in S:
        return _value(tree, x, S, l if x[d] <= tree["thr"][j] else r)
    c = tree["cover"][j]
    return (tree["cover"][l] * _value(tree, x, S, l) + tree["cover"][r] * _value(tree, x, S, r)) / c


def _brute(tree, x, m):
    used = sorted({int(f) for f in tree["feat"] if f >= 0})
    phi = np.zeros(m)
    n = len(used)
    for i in used:
        others = [f for f in used if f != i]
        for k in range(n):
            for S in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                phi[i] += w * (_value(tree, x, set(S) | {i}) - _value(tree, x, set(S)))
    return phi


def test_contributions_match_brute_force_and_margin(spark, trained):
    t, b, feats = trained
    trees = mlx.tree_tables(spark, b.path, b.gbt)
    scored = mlm.score(b, t, feats)
    contrib = mlx.contributions(scored, spark.sparkContext.broadcast(trees), len(fx.FEATURE_COLS))
    rows = contrib.join(scored, "transaction_id").orderBy("transaction_id").limit(25).collect()
    m = len(fx.FEATURE_COLS)
    for r in rows:
        x = np.array([r["f_" + c] for c in fx.FEATURE_COLS], dtype=float)
        want = sum(2.0 * tr["weight"] * _brute(tr, x, m) for tr in trees)
        assert np.allclose(np.array(r.contributions), want, atol=1e-9)
        p = 1.0 / (1.0 + math.exp(-(r.base_value + sum(r.contributions))))
        assert abs(p - r.probability) < 1e-9


def test_stream_scoring_equals_batch(spark, trained, tmp_path):
    from riskwave.streaming.jobs import stream_scores_job
    from riskwave.streaming.sources import transactions_stream
    t, b, feats = trained
    got = stream_scores_job(transactions_stream(spark, SF_SMALL), b)
    want = mlm.serve(b, mlm.serving_rows(t, velocity_features(t)))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # state and override matter: some requests had a live state
    assert want.where("velocity_score > 0").count() > 0
    mlm.write_metrics(sc.fraud_class_metrics(sc.confusion_matrix(mlm.score(b, t, feats))),
                      str(tmp_path / "metrics"))
    doc = spark.read.json(str(tmp_path / "metrics")).first()
    assert doc.tn + doc.fp + doc.fn + doc.tp == t.count()


def test_batches_share_the_tables_of_a_tree(trained, spark, monkeypatch):
    t, b, feats = trained
    trees = mlx.tree_tables(spark, b.path, b.gbt)
    X = feats.select(*["f_" + c for c in fx.FEATURE_COLS]).toPandas().to_numpy(float)
    whole, chunked = np.zeros(X.shape), np.zeros(X.shape)
    mlx.tree_shap(trees[0], X, whole)
    monkeypatch.setattr(mlx, "CHUNK", 7)
    mlx.tree_shap(trees[0], X, chunked)
    assert np.array_equal(whole, chunked)
    batches = [pd.DataFrame({"a": range(n)}) for n in (3, 0, 2, 4, 1)]
    assert [len(p) for p in mlx._held(iter(batches), 5)] == [5, 5]


def test_boosting_rows_are_spread_over_the_cores(spark):
    """Half a million training rows are not two tasks."""
    assert -(-480_000 // mlm.ROWS_PER_TASK) >= 12


def test_leaves_share_tables():
    """A deep tree: every leaf in one group, far fewer tables than leaves, the contributions of its leaves."""
    from riskwave.ml import boost
    rng = np.random.default_rng(5)
    sizes = [20] * 4 + [2] * 4
    bins = np.stack([rng.integers(0, s, 3000).astype(np.uint8) for s in sizes], 1)
    rows = boost.Rows(np.arange(3000), bins, (bins[:, :4].sum(1) + bins[:, 5] * 9) % 7 == 0, sizes, 3.0, 2.0 ** 25)
    p = dict(seed=1, subsamplingRate=0.8, featureSubsetStrategy="0.8", maxDepth=8, stepSize=0.1)
    nodes = boost._nodes(0, boost.grow(rows, 0, p), [np.arange(s - 1.) for s in sizes])
    cols = {n: np.array([np.nan if r[i] is None else r[i] for r in nodes]) for n, i in
            (("left", 9), ("right", 10), ("feat", 11), ("thr", 12), ("value", 2), ("cover", 4))}
    t = cols | {n: cols[n].astype(np.int64) for n in ("left", "right", "feat")}
    paths = mlx.leaf_paths(t)
    groups = mlx.leaf_groups(t, paths)
    assert sorted(leaf for _, _, leaves in groups for leaf in leaves) == list(range(len(paths)))
    assert len(groups) < len(paths) / 2
    X, got = bins[:200].astype(float), np.zeros((200, len(sizes)))
    mlx.tree_shap(t, X, got, paths)
    want = np.zeros_like(got)
    for (_, feats, _, conds), table in zip(paths, mlx.leaf_tables(t)):
        for i, x in enumerate(X):
            code = sum(all((x[t["feat"][n]] <= t["thr"][n]) == left for n, left in cl) << k for k, cl in enumerate(conds))
            want[i, feats] += table[:, code]
    assert np.allclose(got, want, atol=1e-12)
    assert np.allclose(got[:2], [_brute(t, x, len(sizes)) for x in X[:2]], atol=1e-9)


def test_the_forensic_sort_does_not_explain_rows_twice(spark, trained, monkeypatch):
    """The rows that the global sort reads (for bounds, then to sort) are stored ones."""
    from riskwave import queries as q
    t, b, _ = trained
    monkeypatch.setattr(q, "_bundle", lambda *_: b)
    out = q.QUERIES["forensic_table"](spark, SF_SMALL)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" in plan and "InPandas" not in plan
    rows = out.collect()
    assert len(rows) == t.count() and all(r.top_contribution in fx.FEATURE_COLS for r in rows)
    order = [(r.time_text, r.transaction_id) for r in rows]
    assert order == sorted(order, reverse=True)
