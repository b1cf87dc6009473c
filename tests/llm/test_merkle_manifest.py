"""Merkle manifest against a whole tree built in one process."""
import hashlib
import zlib

import pytest
from edge_rows import edge_docs, empty_docs
from pyspark.sql import functions as F

from riskwave.llm.merkle_manifest import FIELDS, fold, manifest, steps, tampered_fields


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in FIELDS)))


def tampered(row):
    if row["doc_id"] is None or row["text"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 3:
        return row
    return {**row, "text": "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])}


def tree(leaves):
    """Levels of a tree and, per leaf, its siblings level by level with its place among them."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h("".join(low[i:i + 8])) for i in range(0, len(low), 8)])
    proofs = []
    for i in range(len(leaves)):
        proof = []
        for level in levels[:-1]:
            run = range(i // 8 * 8, min(len(level), i // 8 * 8 + 8))
            proof.append(([level[j] for j in run if j < i], [level[j] for j in run if j > i]))
            i //= 8
        proofs.append(proof)
    return levels[-1][0], proofs


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), leaf_of(tampered(r))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(groups[g]) for g in names}
    trees = {g: tree([x[2] for x in own[g]]) for g in names}
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (known, i, leaf, claim), proof in zip(own[g], trees[g][1]):
            proof = proof + top
            node = claim
            for left, right in proof:
                node = h("".join(left) + node + "".join(right))
            out.append((i if known else None, leaf, trees[g][0], root, h("".join("".join(a + b) for a, b in proof)),
                        node, node == root))
    return sorted(out, key=repr)


def spark_rows(df):
    out = manifest(df, claimed=tampered_fields()).select(
        "id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256), "folded_root",
        F.col("folded_root") == F.col("root"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("n, groups", [(1, 1), (8, 1), (9, 2), (700, 1), (4100, 3), (600, 90)])
def test_trees_of_many_shapes(spark, n, groups):
    rows = [{"doc_id": i * 7 % 5003, "source": "s", "lang": f"g{i * i % groups}", "n_chars": i, "text": f"Text No {i}"}
            for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert spark_rows(df) == brute(rows)


def test_last_subtree_answers_for_missing_places(spark):
    """20 blocks of one group: runs of 8, 8 and 4 blocks."""
    rows = [{"doc_id": i, "source": None, "lang": None, "n_chars": None, "text": None} for i in range(20 * 512 - 5)]
    df = spark.range(20 * 512 - 5).select(F.col("id").alias("doc_id"), *[
        F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("n_chars", "long"),
                                                  ("text", "string"))])
    assert spark_rows(df) == brute(rows)


def test_edges_and_repeats(spark):
    df = edge_docs(spark)
    assert spark_rows(df) == brute([r.asDict() for r in df.select(*FIELDS).collect()])
    assert manifest(empty_docs(spark)).count() == 0


def test_proof_can_be_folded_alone(spark):
    df = spark.createDataFrame([(i, "en" if i % 3 else "de", f"t{i}") for i in range(1500)], "doc_id long, lang string, text string")
    for r in manifest(df, fields=("doc_id", "text")).collect():
        path = steps(r.leaf_index, r.n_leaves) + steps(r.group_index, r.n_groups)
        assert fold(r.leaf, r.proof, path) == r.root == r.folded_root
        assert fold(h("x"), r.proof, path) != r.root


def test_query_equals_brute_force(spark):
    from riskwave.llm.queries import op13_merkle_manifest
    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*FIELDS).collect()]
    got = sorted((tuple(r) for r in op13_merkle_manifest(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == brute(rows) and 0 < sum(not r[-1] for r in got) < len(got)
