"""Merkle manifest of a dataset, built by a butterfly exchange.

Every row is a leaf: the digest of its fields.  Leaves of a group ascend by
id; every ``FANOUT`` consecutive nodes of a level become their digest (a last
run may hold fewer, even one) until one node, the group's subroot, remains.
The subroots, ordered by group (null first, UTF-8 bytewise), give the root in
the same way.

* A leaf's place in its group comes from stored range partitions
  (``keyed_prefix``), so a group may hold any share of the rows.
* A *block* is an aligned run of ``FANOUT ** BLOCK_LEVELS`` leaves; one task
  call builds its lower tree and keeps ids and leaves as one row.
* ``butterfly`` joins the blocks: in round r the block roots of up to
  ``FANOUT`` neighbouring subtrees, each of ``FANOUT ** r`` blocks, swap.  A
  block meets the blocks that have its place in the other subtrees of the
  run; all of them hash the parent, each appends the siblings to its own
  proof.  After the last round every block holds all upper siblings and the
  subroot, and no pass leads down again.  A last subtree with fewer blocks
  answers for the missing places in turn.  Every round is one exchange of
  rows of one digest and one proof, written to the shared folder.
* The same exchange over the subroots gives the root.

A proof is the siblings from the leaf's level up, left to right, as one
string of hex digests; with the leaf's place and the numbers of leaves and
groups it can be folded (``fold``).  ``claimed`` fields are folded in place
of the row's own, with the siblings of the true ones.

Null fields count as ``-``; empty and very long texts are fields like any
other (digests are made inside the JVM, row by row).  Rows with equal ids are
ordered by leaf; repeated rows are leaves each.  A null id is the smallest.
A group of one leaf has that leaf as its subroot, a table of one group has
its subroot as its root.  An empty table gives an empty result.  Columns
beside the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskwave.llm.common import materialise
from riskwave.plans.prefix import keyed_prefix

FANOUT = 8
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64                    # characters of a digest

_BLOCK = "id array<long>, leaf binary, claimed binary, rows long, alone string, top string"


def leaf_digest(fields: list[Column]) -> Column:
    """Hex sha256 of the fields, each ``-`` if null, else its UTF-8 byte
    count, ``:`` and its value."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*map(part, fields)).cast("binary"), 256)


# ---- trees ------------------------------------------------------------------

def _digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _level_up(nodes: list[str]) -> list[str]:
    return [_digest(nodes[i:i + FANOUT]) for i in range(0, len(nodes), FANOUT)]


def steps(index: int, n: int) -> list[tuple[int, int]]:
    """(place in the run, nodes of the run) at each level above a leaf."""
    out = []
    while n > 1:
        out.append((index % FANOUT, min(FANOUT, n - index // FANOUT * FANOUT)))
        index, n = index // FANOUT, -(-n // FANOUT)
    return out


def fold(node: str, proof: str, path: list[tuple[int, int]]) -> str:
    """The root that a leaf, its siblings and its path lead to."""
    at = 0
    for place, size in path:
        left, right = at + place * HEX, at + (size - 1) * HEX
        node = hashlib.sha256((proof[at:left] + node + proof[left:right]).encode()).hexdigest()
        at = right
    return node


def _pack(column: pa.ChunkedArray) -> bytes:
    return bytes.fromhex("".join(column.to_pylist()))


def _unpack(packed: bytes) -> list[str]:
    text = packed.hex()
    return [text[i:i + HEX] for i in range(0, len(text), HEX)]


def _block(leaves: pa.Table) -> pa.Table:
    """One row for an aligned run of leaves: its ids and leaves, its root as
    one of several blocks (``top``) and as a whole tree (``alone``)."""
    leaves = leaves.sort_by("rn")
    nodes, alone = leaves.column("leaf").to_pylist(), None
    for _ in range(BLOCK_LEVELS):
        alone = alone or (nodes[0] if len(nodes) == 1 else None)
        nodes = _level_up(nodes)
    return pa.table({"grp": leaves.column("grp")[:1], "block": leaves.column("block")[:1],
                     "id": pa.array([leaves.column("id").to_pylist()], pa.list_(pa.int64())),
                     "leaf": pa.array([_pack(leaves.column("leaf"))], pa.binary()),
                     "claimed": pa.array([_pack(leaves.column("claimed"))], pa.binary()),
                     "rows": pa.array([leaves.num_rows], pa.int64()),
                     "alone": [alone or nodes[0]], "top": nodes})


# ---- the exchange -----------------------------------------------------------

def _round(state: DataFrame, width: int) -> DataFrame:
    """One swap between the subtrees of ``width`` positions of a run."""
    here, place = F.expr(f"pos div {width}"), F.col("pos") % width
    nodes = F.expr(f"(n + {width - 1}) div {width}")
    in_last = F.col("n") - (nodes - 1) * width          # positions of the last subtree
    answers = F.when((F.col("n") > width) & (here == nodes - 1) & ((nodes - 1) % FANOUT != 0),
                     F.sequence(place, F.lit(width - 1).cast("long"), in_last)).otherwise(F.array(place))
    sent = (state.withColumn("here", here).withColumn("place", place)
            .withColumn("slot", F.explode(answers)).withColumn("run", F.expr(f"here div {FANOUT}")))
    met = Window.partitionBy("tree", "run", "slot")     # at most FANOUT rows
    sent = sent.withColumn("met", F.array_sort(F.collect_list(F.struct("here", "hash")).over(met)))
    others = F.filter("met", lambda x: x["here"] != F.col("here"))
    rises = F.col("n") > width
    return sent.where("slot = place").select(
        "tree", "pos", "n",
        F.when(rises, F.sha2(F.array_join(F.col("met.hash"), "").cast("binary"), 256))
        .otherwise(F.col("hash")).alias("hash"),
        F.when(rises, F.concat("proof", F.array_join(F.transform(others, lambda x: x["hash"]), "")))
        .otherwise(F.col("proof")).alias("proof"))


def butterfly(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` (tree, pos, n, hash): the n nodes of each tree at positions
    from 0.  The same rows with the tree's root as ``hash`` and the siblings
    on the way there as ``proof``."""
    state = nodes.select("tree", "pos", "n", "hash", F.lit("").alias("proof"))
    most, width = nodes.agg(F.max("n")).first()[0] or 0, 1
    while width < most:
        state = materialise(_round(state, width), name)
        width *= FANOUT
    return state


# ---- manifest ---------------------------------------------------------------

_OUT = pa.schema([("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                  ("leaf_index", pa.int64()), ("n_leaves", pa.int64()), ("group_index", pa.int64()),
                  ("n_groups", pa.int64()), ("proof", pa.string()), ("folded_root", pa.string())])


def _prove(batches):
    """A row per leaf from a block's row with its upper proof."""
    size = FANOUT ** BLOCK_LEVELS
    for batch in batches:
        for b in batch.to_pylist():
            leaves, claimed, path = _unpack(b["leaf"]), _unpack(b["claimed"]), steps(b["group_index"], b["n_groups"])
            levels, nodes = [], leaves
            while len(nodes) > 1 or (b["n_leaves"] > size and len(levels) < BLOCK_LEVELS):
                levels.append(nodes)
                nodes = _level_up(nodes)
            proofs, folded = [], []
            for i, own in enumerate(claimed):
                proof, at = "", i
                for level in levels:
                    run = at - at % FANOUT
                    proof += "".join(level[run:at] + level[at + 1:run + FANOUT])
                    at //= FANOUT
                proofs.append(proof + b["upper"])
                folded.append(fold(own, proofs[-1], steps(b["block"] * size + i, b["n_leaves"]) + path))
            k = len(leaves)
            columns = [b["id"], leaves, [b["subroot"]] * k, [b["root"]] * k,
                       [b["block"] * size + i for i in range(k)], [b["n_leaves"]] * k, [b["group_index"]] * k,
                       [b["n_groups"]] * k, proofs, folded]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
             claimed: list[Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, leaf_index,
    n_leaves, group_index, n_groups, proof and folded_root, the fold of the
    ``claimed`` fields (by default the row's own)."""
    own = leaf_digest([F.col(f"`{c}`") for c in fields])
    leaves = materialise(docs.select(
        F.col(f"`{group_col}`").cast("string").alias("grp"), F.col(f"`{id_col}`").cast("long").alias("id"),
        own.alias("leaf"), (leaf_digest(claimed) if claimed else own).alias("claimed"),
        F.monotonically_increasing_id().alias("uid")), "leaves")
    placed = keyed_prefix(leaves, ["grp"], ["id", "leaf", "uid"], rn_col="rn")
    blocks = materialise(
        placed.withColumn("block", F.expr(f"(rn - 1) div {FANOUT ** BLOCK_LEVELS}"))
        .groupBy("grp", "block").applyInArrow(_block, "grp string, block long, " + _BLOCK), "blocks")
    sizes = blocks.groupBy(F.col("grp").alias("tree")).agg(F.count("*").alias("n"), F.sum("rows").alias("n_leaves"))
    nodes = (blocks.join(sizes, F.col("grp").eqNullSafe(F.col("tree")))
             .select("tree", F.col("block").alias("pos"), "n", F.when(F.col("n") == 1, F.col("alone"))
                     .otherwise(F.col("top")).alias("hash")))
    upper = butterfly(nodes, "subtrees")
    # The subroots, one row a group, in the order of their groups.
    subroots = materialise(upper.where("pos = 0").select("tree", "hash"), "subroots")
    ranked = keyed_prefix(subroots, [], ["tree"], rn_col="rn")
    groups = materialise(ranked.select(F.col("tree").alias("grp_of"), (F.col("rn") - 1).alias("pos"),
                                       F.col("hash").alias("subroot")), "groups")
    n_groups = groups.count()
    roots = butterfly(groups.select(F.lit(0).alias("tree"), "pos", F.lit(n_groups).cast("long").alias("n"),
                                    F.col("subroot").alias("hash")), "roots")
    tops = (groups.join(roots.select("pos", F.col("hash").alias("root"), F.col("proof").alias("last")), "pos")
            .join(sizes.select(F.col("tree").alias("_t"), "n_leaves"), F.col("grp_of").eqNullSafe(F.col("_t")))
            .select("grp_of", F.col("pos").alias("group_index"), "subroot", "root", "last", "n_leaves"))
    known = (upper.select("tree", "pos", "proof")
             .join(tops, F.col("tree").eqNullSafe(F.col("grp_of")))
             .select("tree", "pos", F.concat("proof", "last").alias("upper"), "group_index", "subroot", "root",
                     "n_leaves", F.lit(n_groups).cast("long").alias("n_groups")))
    whole = (blocks.select("grp", "block", "id", "leaf", "claimed")
             .join(known, F.col("grp").eqNullSafe(F.col("tree")) & (F.col("block") == F.col("pos"))))
    return whole.drop("tree", "pos", "grp").mapInArrow(
        _prove, "id long, leaf string, subroot string, root string, leaf_index long, n_leaves long, "
                "group_index long, n_groups long, proof string, folded_root string")


def tampered_fields(fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", text_col: str = "text",
                    every: int = 3) -> list[Column]:
    """The fields after a tampering of rows whose id's unsigned crc32 is
    divisible by ``every``: A-Z of the text become a-z."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    lower = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [F.when(hit, lower).otherwise(F.col(c)) if c == text_col else F.col(f"`{c}`") for c in fields]


# DuckDB SQL for the query's rows.  crc32 is spelled out bit by bit.
def _sql_leaf(text: str) -> str:
    def part(c: str) -> str:
        v = f"CAST({c} AS VARCHAR)"
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode({v})) AS VARCHAR) || ':' || {v} END"
    return "sha256(" + " || ".join(part(text if c == "text" else c) for c in FIELDS) + ")"


_BITS = "list_reduce([{0}] || generate_series(1, 8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))"
_CRC = ("xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
        "lambda s: CAST(ascii(s) AS BIGINT)), lambda crc, b: " + _BITS.format("xor(crc, b)") + "))")

ORACLE = f"""
WITH RECURSIVE marked AS (
  SELECT *, coalesce({_CRC} % 3 = 0, false) AS hit FROM documents
), leaves AS (
  SELECT doc_id, lang, {_sql_leaf("text")} AS leaf, {_sql_leaf('''(CASE WHEN hit THEN
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END)''')} AS claimed
  FROM marked
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes AS (
  SELECT lang, 0 AS lev, idx, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, lev + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY lang, lev, idx // 8, n
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lev, idx, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lev + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx))
  FROM tops WHERE n > 1 GROUP BY lev, idx // 8, n
), folds AS (
  SELECT p.doc_id, p.lang, p.leaf, p.idx AS start, 0 AS lev, p.idx, p.n, p.claimed AS h, '' AS proof FROM placed p
  UNION ALL
  SELECT f.doc_id, f.lang, f.leaf, f.start, f.lev + 1, f.idx // 8, (f.n + 7) // 8,
    sha256(string_agg(CASE WHEN t.idx = f.idx THEN f.h ELSE t.h END, '' ORDER BY t.idx)),
    f.proof || string_agg(CASE WHEN t.idx = f.idx THEN '' ELSE t.h END, '' ORDER BY t.idx)
  FROM folds f JOIN nodes t ON t.lang IS NOT DISTINCT FROM f.lang AND t.lev = f.lev AND t.idx // 8 = f.idx // 8
  WHERE f.n > 1 GROUP BY f.doc_id, f.lang, f.leaf, f.start, f.lev, f.idx, f.n, f.h, f.proof
), climbs AS (
  SELECT f.doc_id, f.lang, f.leaf, f.start, s.subroot, 0 AS lev, s.idx, s.n, f.h, f.proof
  FROM folds f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
  UNION ALL
  SELECT f.doc_id, f.lang, f.leaf, f.start, f.subroot, f.lev + 1, f.idx // 8, (f.n + 7) // 8,
    sha256(string_agg(CASE WHEN t.idx = f.idx THEN f.h ELSE t.h END, '' ORDER BY t.idx)),
    f.proof || string_agg(CASE WHEN t.idx = f.idx THEN '' ELSE t.h END, '' ORDER BY t.idx)
  FROM climbs f JOIN tops t ON t.lev = f.lev AND t.idx // 8 = f.idx // 8
  WHERE f.n > 1 GROUP BY f.doc_id, f.lang, f.leaf, f.start, f.subroot, f.lev, f.idx, f.n, f.h, f.proof
)
SELECT c.doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
FROM climbs c, (SELECT h FROM tops WHERE n = 1) t WHERE c.n = 1
"""
