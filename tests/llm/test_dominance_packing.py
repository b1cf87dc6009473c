"""Reduction against all packings of small instances, packing against rules."""
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
from edge_rows import EDGE_TEXTS, edge_docs, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from riskwave.llm import dominance_packing as dp
from riskwave.llm.byte_chunks import loaded

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(items, window):
    """Bins of a best packing, by trying all."""
    @lru_cache(None)
    def left(rest):
        if not rest:
            return 0
        first, others = rest[0], rest[1:]
        best = len(rest)

        def fill(room, i, kept):
            nonlocal best
            best = min(best, 1 + left(tuple(kept) + others[i:]))
            for k in range(i, len(others)):
                if others[k] <= room:
                    fill(room - others[k], k + 1, kept + list(others[i:k]))
        fill(window - first, 0, [])
        return best
    return left(tuple(sorted(items, reverse=True)))


def items_of(kinds):
    out = Counter()
    for inside, bins in kinds:
        for size, each in inside:
            out[size] += each * bins
    return out


def best_fit_one_by_one(items, window):
    room = []
    for s in sorted(items, reverse=True):
        able = [r for r in room if r >= s]
        if able:
            room.remove(min(able))
            room.append(min(able) - s)
        else:
            room.append(window - s)
    return sorted(room)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 19), min_size=1, max_size=8))
def test_reduction_keeps_the_optimum(items):
    fixed, rest = dp.reduce(Counter(items), 20)
    assert items_of(fixed) + Counter(rest) == Counter(items)
    assert all(sum(s * n for s, n in inside) <= 20 and sum(n for _, n in inside) <= 3 for inside, _ in fixed)
    left = [s for s, n in rest.items() for _ in range(n)]
    assert fewest(items, 20) == sum(b for _, b in fixed) + fewest(left, 20)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120))
def test_best_fit_on_counts_equals_one_by_one(items):
    kinds = dp.best_fit(Counter(items), 61)
    rooms = sorted(61 - sum(s * n for s, n in inside) for inside, bins in kinds for _ in range(bins))
    assert rooms == best_fit_one_by_one(items, 61) and items_of(kinds) == Counter(items)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 30), max_size=12))
def test_places_fill_bins_without_gaps(counts):
    kinds = dp.pack_counts(counts, 64)
    places, bins = dp.Places(kinds, 64), defaultdict(list)
    for size, n in counts.items():
        for rank in range(n):
            sequence, offset = places.find(size, rank)
            bins[sequence].append((offset, size))
    assert set(bins) == set(range(places.sequences))
    for held in bins.values():
        end = 0
        for offset, size in sorted(held):
            assert offset == end
            end += size
        assert end <= 64


def test_reduction_fixes_pairs_and_triples():
    assert dp.reduce({15: 2, 5: 3}, 20)[0][0] == (((15, 1), (5, 1)), 2)          # exact complement
    assert dp.reduce({19: 4, 18: 1, 3: 2}, 20) == ([(((19, 1),), 4), (((18, 1),), 1), (((3, 2),), 1)], {})
    assert dp.dominating(10, dp._Sizes({6: 1, 3: 1, 9: 0}), 20) == [10, 6, 3]    # two fit, no better pair
    assert dp.dominating(10, dp._Sizes({8: 1, 5: 2, 2: 1}), 20) is None          # 5 + 5 is another choice
    many = dp.reduce({s: 10 ** 12 for s in range(1, 2048)}, 2048)                # counts never unrolled
    assert sum(b for _, b in many[0]) == 1023 * 10 ** 12 + 10 ** 12 // 2 and not many[1]


def library_ids(text):
    return loaded(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" \t\n\r\x0b\x1c\x1f\x85\xa0\u3000\u2009\u200b'sltTé漢🙂1²<|>.-", "<|endoftext|>", "  ", "'ll"]))
       .map("".join))
def test_chunks_give_the_library_ids(text):
    tok = loaded(PATH)
    assert np.frombuffer(tok.encode(text), tok.dtype).tolist() == library_ids(text)[:-1]


def check_pieces(rows, texts, window):
    """texts: Counter of (doc_id, text)."""
    expected, places = Counter(), defaultdict(list)
    for (i, text), times in texts.items():
        ids = np.array(library_ids(text), "<u4")
        first = len(ids) % window
        cuts = [0] * (first > 0) + list(range(first, len(ids), window)) + [len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += times
    got = Counter()
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == expected
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= window
    return len(places)


def pieces(df, **kw):
    from pyspark.sql import functions as F
    return [r.asDict() for r in dp.pack_documents(df, PATH, **kw).withColumn("ids_crc32", F.crc32("ids")).collect()]


def test_edges(spark):
    df = edge_docs(spark)
    texts = Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    check_pieces(pieces(df), texts, 2048)
    check_pieces(pieces(df, window=16), texts, 16)
    assert dp.pack_documents(empty_docs(spark), PATH).count() == 0


def test_offsets_by_shuffle(spark, monkeypatch):
    """The way without a broadcast, with one size holding most rows."""
    monkeypatch.setattr(dp, "MAX_OFFSETS", 0)
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"word {'more ' * (i % 40)}") for i in range(3000)],
                               "doc_id long, text string").repartition(7)
    texts = Counter((r.doc_id, r.text) for r in df.collect())
    check_pieces(pieces(df, window=64), texts, 64)


def test_query(spark):
    from riskwave.llm.queries import op12_dominance_packing
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [r.asDict() for r in op12_dominance_packing(spark, "/root/testdata/sf0.001").collect()]
    n = check_pieces(rows, Counter((r.doc_id, r.text) for r in docs), 2048)
    items = [r["length"] for r in rows]
    assert -(-sum(items) // 2048) <= n <= len(best_fit_one_by_one(items, 2048))


def test_very_long_texts_and_blank_runs():
    tok = loaded(PATH)
    for text in (" " * 2_000_000 + "x", "\n" * 1_500_000, "　" * 1_200_000, "a" * 300_000, "-" * 300_000):
        assert len(tok.encode(text)) > 0
    assert EDGE_TEXTS[0] is None
