from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from riskwave.llm import pfair_mixing as m
from riskwave.llm.queries import QUERIES

from edge_rows import edge_docs, empty_docs


def brute_schedule(shares, period):
    """Earliest deadline first among released blocks, slot by slot."""
    nxt, out = dict.fromkeys(shares, 0), []
    for t in range(period):
        ready = [(-(-(j + 1) * period // shares[s]), s) for s, j in nxt.items() if j * period // shares[s] <= t]
        _, s = min(ready)
        nxt[s] += 1
        out.append(s)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return QUERIES["op5_pfair_mixing"](spark, "/root/testdata/sf0.01").collect()


def test_every_document_is_there_and_blocks_are_whole(spark, rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").collect()
    first = [r for r in rows if r.epoch == 0]
    assert sorted((r.doc_id, r.source) for r in first) == sorted((d.doc_id, d.source) for d in docs)
    per_block = Counter((r.slot, r.place) for r in rows)
    assert max(per_block.values()) == 1
    assert all(r.release <= r.slot < r.deadline for r in rows)
    slots = defaultdict(set)
    for r in rows:
        slots[r.slot].add((r.source, r.block))
    assert all(len(s) == 1 for s in slots.values())
    assert sorted(slots) == list(range(len(slots)))


def test_schedule_equals_brute_force_and_deviates_less_than_a_block(rows):
    share = {r.source: r.share for r in rows}
    assert sum(share.values()) == m.PERIOD
    at = {r.slot: r.source for r in rows}
    done = Counter()
    for t in range(len(at)):
        done[at[t]] += 1
        assert all(abs(done[s] - (t + 1) * a / m.PERIOD) < 1 for s, a in share.items())


def test_pattern_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, "t", s) for i, s in enumerate("a" * 50 + "b" * 20 + "c" * 7 + "d")],
                                 "doc_id long, text string, source string")
    plan = m.plan_streams(docs, "source", {"a": .5, "b": .3, "c": .15, "d": .05}, period=64, block_rows=2,
                          max_streams=4).collect()
    shares = {r.stream: r.share for r in plan}
    slots = {t: r.stream for r in plan for t in r.slots}
    assert [slots[t] for t in range(64)] == brute_schedule(shares, 64)


def test_small_sources_are_pooled_and_edges(spark):
    assert m.mix_sources(empty_docs(spark)).count() == 0
    docs = edge_docs(spark)
    for top in (1, 2, 64):
        out = m.mix_sources(docs, max_streams=top, block_rows=2)
        assert out.where("epoch = 0").count() == docs.count()
    mixed = m.mixed_documents(docs, block_rows=2)
    assert mixed.columns == docs.columns and mixed.count() >= docs.count()
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_row_counts_follow_unrounded_weights_with_a_tiny_source(spark):
    """A hot source, 19 even ones, and one of 10 rows that is due for less
    than a thousandth of the rows."""
    sizes = {"hot": 26_000, **{f"s{i:02d}": 2_700 for i in range(19)}, "tiny": 10}
    docs = spark.createDataFrame([(i, "t", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))],
                                 "doc_id long, text string, source string")
    rows = m.mix_sources(docs, carry=["doc_id", "source"]).select(
        "row.*", "slot", "place", "epoch", "release", "deadline").toPandas()
    weights = {s: n ** m.TEMPER for s, n in sizes.items()}
    mass, total = sum(weights.values()), len(rows)
    emitted = rows.groupby("source").size()
    assert weights["tiny"] / mass < 1 / m.PERIOD
    for s, w in weights.items():
        assert abs(emitted[s] - total * w / mass) <= 2
    assert set(rows[rows.epoch == 0].doc_id) == set(range(docs.count()))
    assert ((rows.release <= rows.slot) & (rows.slot < rows.deadline)).all()
    # only a source's last block is short
    blocks = rows.groupby(["source", "slot"]).size()
    assert all((g.iloc[:-1] == m.BLOCK_ROWS).all() for _, g in blocks.groupby(level=0))
    # prefixes: within one block of rows, and the rows that short blocks lack
    rows = rows.sort_values(["slot", "place"])
    for s, w in weights.items():
        gone = (rows.source == s).cumsum().to_numpy()
        ideal = [k * w / mass for k in range(1, total + 1)]
        assert max(abs(gone - ideal)) < 2 * m.BLOCK_ROWS


def test_weight_of_zero_has_no_place(spark):
    docs = spark.createDataFrame([(i, "t", s) for i, s in enumerate("a" * 50 + "b" * 20)],
                                 "doc_id long, text string, source string")
    out = m.mix_sources(docs, {"a": 0.0, "b": 1.0})
    assert {r.source for r in out.select("row.source").collect()} == {"b"} and out.count() == 20


def test_every_source_has_its_own_weight(spark):
    """200 sources, far more than are broadcast as streams."""
    docs = spark.createDataFrame([(i, "t", None if i % 200 == 0 else f"s{i % 200}") for i in range(200 * 40)],
                                 "doc_id long, text string, source string")
    weights = {None if k == 0 else f"s{k}": 1.0 + (k == 199) for k in range(200)}
    rows = m.mix_sources(docs, weights, block_rows=8).select("row.*", "stream", "epoch").toPandas()
    assert rows.stream.nunique() == 200 and (rows.groupby("stream")["source"].nunique(dropna=False) == 1).all()
    assert set(rows[rows.epoch == 0].doc_id) == set(range(8000))
    got = rows.groupby("source", dropna=False).size()
    assert got["s199"] == 80 and (got.drop("s199") == 40).all()
    with pytest.raises(ValueError):
        m.mix_sources(docs, {"s1": 1.0})


def random_streams(rng):
    from pyspark.sql import Row
    sizes = [int(10 ** rng.uniform(0, 4)) for _ in range(rng.integers(1, 12))]
    return [Row(stream=k, source=f"s{k}", rows=n, weight=float(n ** m.TEMPER if rng.random() < .5 else rng.random() + .01))
            for k, n in enumerate(sizes, 1)]


def test_random_plans_stay_within_a_block_of_the_target_weights():
    """300 plans, against the unrounded weights, in exact fractions: every
    source is less than a block off until the first source has ended."""
    rng = np.random.default_rng(11)
    for _ in range(300):
        streams = random_streams(rng)
        plan = m.Plan(streams, m.PERIOD, 8, max_blocks=4000)
        assert sum(plan.blocks) <= 4000
        mass = sum(Fraction(r.weight) for r in streams)
        weights = [Fraction(r.weight) / mass for r in streams]
        slots, ran = m._edf(plan.parts, plan.whole, plan.blocks)
        assert list(slots) == list(range(sum(plan.blocks)))
        done = [0] * len(streams)
        for t, s in enumerate(ran, 1):
            if any(d == n for d, n in zip(done, plan.blocks)):
                break
            done[s] += 1
            assert max(abs(d - w * t) for d, w in zip(done, weights)) < 1
        # rows of the mixture: the unrounded weights, to a row
        scale = max(Fraction(r.rows) / w for r, w in zip(streams, weights))
        assert all(abs(n - w * scale) < 1 or n == r.rows for n, w, r in zip(plan.totals, weights, streams))


def test_blocks_grow_when_the_mixture_does_and_the_schedule_does_not(spark):
    from pyspark.sql import Row
    for scale in (1, 10 ** 3, 10 ** 9):
        plan = m.Plan([Row(stream=k, source=f"s{k}", rows=n * scale, weight=float(n))
                       for k, n in enumerate((70, 20, 9, 1), 1)], m.PERIOD, m.BLOCK_ROWS, max_blocks=2000)
        assert sum(plan.blocks) <= 2000 and plan.totals == [n * scale for n in (70, 20, 9, 1)]
    docs = spark.createDataFrame([(i, "t", s) for i, s in enumerate("a" * 500 + "b" * 200 + "c" * 70)],
                                 "doc_id long, text string, source string")
    rows = m.mix_sources(docs, block_rows=2, max_blocks=40, carry=["doc_id", "source"]).collect()
    assert {r.row.doc_id for r in rows if r.epoch == 0} == set(range(770))
    assert len({r.slot for r in rows}) <= 40 and max(Counter((r.slot, r.place) for r in rows).values()) == 1
    assert all(r.release <= r.slot < r.deadline for r in rows)


def test_a_source_read_thousands_of_times(spark):
    docs = spark.createDataFrame([(i, "t", s) for i, s in enumerate("a" * 900 + "bb")],
                                 "doc_id long, text string, source string")
    rows = m.mix_sources(docs, {"a": 1.0, "b": 5.0}, carry=["doc_id"]).select("row.doc_id", "epoch")
    counts = dict(rows.groupBy("doc_id").count().collect())
    assert all(counts[i] == 1 for i in range(900)) and counts[900] == counts[901] == 2250
    assert rows.where("doc_id = 901").distinct().count() == 2250
