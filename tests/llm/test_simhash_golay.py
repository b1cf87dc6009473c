import numpy as np
import pytest
from xxhash import xxh64_intdigest

from riskwave.llm import simhash_golay as m
from riskwave.llm.components import connected_components
from riskwave.llm.queries import QUERIES

from edge_rows import edge_docs, empty_docs


def brute_fp(text):
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [words[i:i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
    hs = [xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps):
    """fps: {fp: smallest id} -> {fp: component id}, comparing all pairs."""
    keys = list(fps)
    arr = np.array(keys, np.uint64)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4):
            a, b = find(k), find(keys[j])
            if a != b:
                root[a] = b
    best = {}
    for k in keys:
        r = find(k)
        best[r] = min(best.get(r, fps[k]), fps[k])
    return {k: best[find(k)] for k in keys}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: brute_fp(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    first = {}
    for d, fp in docs.items():
        first[fp] = min(first.get(fp, d), d)
    comp = brute_components(first)
    rows = QUERIES["op2_simhash_golay"](spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == \
        sorted((d, f"{fp:016x}", comp[fp]) for d, fp in docs.items())


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    y[:500] = x[:500]
    for i in range(500):          # one bit in every segment
        for s in range(4):
            y[i] ^= np.uint64(1) << np.uint64(16 * s + rng.integers(16))
    pk, pr = m.fuzzy_keys(x, False)
    bk, br = m.fuzzy_keys(y, True)
    probe, build = [set() for _ in x], [set() for _ in x]
    for k, r in zip(pk.tolist(), pr.tolist()):
        probe[r].add(k)
    for k, r in zip(bk.tolist(), br.tolist()):
        build[r].add(k)
    assert all(a & b for a, b in zip(probe, build))


@pytest.mark.parametrize("tile", [7, 4096])
def test_hot_group_of_near_fingerprints(spark, tile):
    rng = np.random.default_rng(2)
    base, fps = int(rng.integers(2**63)), {}
    for i in range(300):
        fp = base
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            fp ^= 1 << int(b)
        fps.setdefault(fp, i)
    for i in range(300, 400):
        fps.setdefault(int(rng.integers(2**63)), i)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    links = m.fingerprint_links(df, tile=tile)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    got = {}
    for (s,) in signed:
        got.setdefault(roots.get(s, s), set()).add(s & (2**64 - 1))
    want = {}
    for f, c in brute_components(fps).items():
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_path(spark):
    n = 200
    perm = np.random.default_rng(1).permutation(n).tolist()
    edges = spark.createDataFrame([(perm[i], perm[i + 1]) for i in range(n - 1)], "u long, v long")
    out = {r.node: r.root for r in connected_components(edges).collect()}
    assert out == {i: 0 for i in range(1, n)}


def test_edges(spark):
    assert m.near_duplicates(empty_docs(spark)).count() == 0
    docs = edge_docs(spark)
    rows = docs.collect()
    out = m.near_duplicates(docs).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in rows)
    first = {}
    for r in rows:
        fp = brute_fp(r["text"]) if len(r["text"] or "") < 5000 else int(m.fingerprints([r["text"]])[0])
        if r.doc_id is not None:
            first[fp] = min(first.get(fp, r.doc_id), r.doc_id)
        else:
            first.setdefault(fp, 10**9)
    comp = brute_components(first)
    kept = m.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp.values()))
    for r in out:
        want = comp[r.fp & (2**64 - 1)]
        assert r.component_id == (None if want == 10**9 else want)
