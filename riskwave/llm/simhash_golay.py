"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four segments of 16 bits, each read as a
word of 23 bits of the binary Golay code, a perfect code whose words lie
within distance 3 of exactly one of 4096 codewords.  A segment's probe key
is the index of that codeword; its build keys are the indices of all
codewords within distance 4 (one, or six if the nearest is at distance 3).
If two segments differ in at most one bit, the probe key of either is
among the build keys of the other.

Pigeonhole for at most 4 differing bits over four segments: either some
segment is equal and another one differs in at most one bit (twelve
joins on 16 exact bits and one Golay key), or every segment differs in
exactly one bit (one join on the Golay keys of the first two).  So no
link is missed.  Candidates are verified on all 64 bits.

Only distinct fingerprints are compared.  Within a key, probes are split
into tiles of ``TILE`` and builds stream past them, so a task holds a
bounded number of fingerprints; a task passes on a spanning forest of the
links it found, never all pairs.  Components are joined by star
operations.

Words are runs of bytes other than U+0020 and U+0009 to U+000D of the text
with A-Z lower-cased.  Fewer than 4 words form one shingle, no words give
fingerprint zero, which is linked like any other.  Null text counts as no
words.  A component's id is its smallest non-null doc_id (null if it has
none); every input row returns one row.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskwave.llm.common import emit, materialise, text_runs
from riskwave.llm.components import connected_components
from riskwave.plans.broadcast import bounded_broadcast

SHINGLE = 4
MAX_BITS = 4
SEED = 42
TILE = 4096               # probes of one key that a task compares at a time
PAIRS = 1 << 20           # comparisons of one vectorised step
SEGMENTS, SEGMENT_BITS = 4, 16
GENERATOR = 0xC75         # fixed value: generator polynomial of the Golay code


# ---- fingerprints -----------------------------------------------------------

def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    from xxhash import xxh64_intdigest
    words = text.encode().lower().split()
    if not words:
        return []
    if len(words) < size:
        return [xxh64_intdigest(b" ".join(words), seed)]
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:len(words) - size + 1].tolist()
    return [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())]


def fingerprints(texts: list[str], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text."""
    out = np.zeros(len(texts), np.uint64)
    for off, run in text_runs(texts):
        hashes = [shingle_hashes(t, size, seed) for t in run]
        n = np.array([len(h) for h in hashes])
        full = np.flatnonzero(n)
        if not len(full):
            continue
        flat = np.array([h for some in hashes for h in some], np.uint64)
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate(([0], np.cumsum(n[full])[:-1]))
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        major = (2 * counts > n[full][:, None]).astype(np.uint8)
        out[off + full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_rows(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            fps = fingerprints([t or "" for t in batch.column("text").to_pylist()], size)
            yield emit(schema, {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
                                "fp": fps.view(np.int64)})
    return run


# ---- Golay keys -------------------------------------------------------------

def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    for bit in range(22, 10, -1):
        v = np.where(v >> bit & 1, v ^ (GENERATOR << (bit - 11)), v)
    return v


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every 16-bit segment: index of the nearest codeword, and the
    indices of all codewords within distance 4 (padded with -1)."""
    from itertools import combinations
    errors: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)])
        for s, e in zip(_syndrome(patterns).tolist(), patterns.tolist()):
            errors[s].append(e)          # by weight: the nearest codeword comes first
    width = max(map(len, errors))
    error = np.array([e + [-1] * (width - len(e)) for e in errors])
    v = np.arange(1 << SEGMENT_BITS)
    own = error[_syndrome(v)]
    keys = np.where(own < 0, -1, (v[:, None] ^ own) >> 11)
    return keys[:, 0].copy(), keys


_EXACT = [(i, j) for i in range(SEGMENTS) for j in range(SEGMENTS) if i != j]
_TABLES: list = []


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> np.uint64(SEGMENT_BITS * s)) & np.uint64(0xFFFF)).astype(np.int64) for s in range(SEGMENTS)]


def fuzzy_keys(fp: np.ndarray, build: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, index into fp) of all keys of the given kind."""
    if not _TABLES:
        _TABLES.append(golay_tables())
    nearest, near = _TABLES[0]
    seg = _segments(fp)
    codes = [near[s] if build else nearest[s][:, None] for s in seg]
    keys, rows = [], []

    def add(number, high, low):
        keep = (high >= 0) & (low >= 0)
        keys.append((number << 28 | high << 12 | low)[keep])
        rows.append(np.nonzero(keep)[0])

    for number, (i, j) in enumerate(_EXACT):
        add(number, np.broadcast_to(seg[i][:, None], codes[j].shape), codes[j])
    for a in range(codes[0].shape[1]):
        add(len(_EXACT), np.broadcast_to(codes[0][:, a:a + 1], codes[1].shape), codes[1])
    return np.concatenate(keys), np.concatenate(rows)


def _key_rows(build: bool):
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 2000):
                own = fp[at:at + 2000]
                keys, rows = fuzzy_keys(own.view(np.uint64), build)
                yield emit(schema, {"key": keys, "fp": own[rows]})
    return run


# ---- links ------------------------------------------------------------------

def star_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the edges (u, v), as edges to each
    component's smallest node: at most one per node."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _link(max_bits: int):
    """Rows sorted by (key, tile, side) -> forest of verified links.  Side 0
    are probes: at most about TILE of them come first and are held while
    the builds (side 1) of their key pass."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def pairs(order, fp):
        """Verified links of complete or partial groups in a sorted run."""
        group, build = order >> 1, (order & 1).astype(bool)
        first = np.concatenate(([True], group[1:] != group[:-1]))
        start = np.flatnonzero(first)
        number = np.cumsum(first) - 1
        probes = np.bincount(number, ~build).astype(np.int64)
        rows = np.flatnonzero(build & (probes[number] > 0))
        many = probes[number[rows]]
        upto = np.cumsum(many)
        at = 0
        while at < len(rows):
            done = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
            n = many[at:end]
            x = np.repeat(start[number[rows[at:end]]] - (upto[at:end] - n - done), n) + np.arange(n.sum())
            y = np.repeat(rows[at:end], n)
            p, q = fp[x], fp[y]
            near = (p < q) & (np.bitwise_count((p ^ q).view(np.uint64)) <= max_bits)
            yield p[near], q[near]
            at = end

    def run(batches):
        held_u, held_v = [], []
        held = 0
        carry_order, carry_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            order = np.concatenate((carry_order, batch.column("order").to_numpy()))
            fp = np.concatenate((carry_fp, batch.column("fp").to_numpy()))
            for u, v in pairs(order, fp):
                held_u.append(u)
                held_v.append(v)
                held += len(u)
                if held > PAIRS:
                    u, v = star_forest(np.concatenate(held_u), np.concatenate(held_v))
                    if len(u) > PAIRS // 2:
                        yield emit(schema, {"u": u, "v": v})
                        u, v = u[:0], v[:0]
                    held_u, held_v, held = [u], [v], len(u)
            if len(order):      # the last group may go on: keep its probes
                last = (order >> 1 == order[-1] >> 1) & (order & 1 == 0)
                carry_order, carry_fp = order[last], fp[last]
        if held:
            u, v = star_forest(np.concatenate(held_u), np.concatenate(held_v))
            yield emit(schema, {"u": u, "v": v})
    return run


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """``fps``: distinct (fp).  Forest edges (u, v) of all links."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the segment scheme is exact up to {MAX_BITS} bits")
    probes = fps.select("fp").mapInArrow(_key_rows(False), "key long, fp long")
    builds = fps.select("fp").mapInArrow(_key_rows(True), "key long, fp long")
    hot = (probes.groupBy("key").count().where(F.col("count") > tile)
           .select("key", F.ceil(F.col("count") / tile).alias("tiles")))
    hot = bounded_broadcast(materialise(hot, "hot-keys"), 200_000)
    tiles = F.coalesce("tiles", F.lit(1)).cast("long")
    place = lambda tile_no, side: (F.shiftleft("key", 21) + tile_no * 2 + side).alias("order")
    both = (probes.join(hot, "key", "left").select(place(F.pmod(F.xxhash64("fp"), tiles), 0), "fp")
            .unionAll(builds.join(hot, "key", "left")
                      .withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
                      .select(place(F.col("tile"), 1), "fp")))
    return (both.repartition(F.shiftright("order", 1)).sortWithinPartitions("order")
            .mapInArrow(_link(max_bits), "u long, v long"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, text_hash, fp (signed 64-bit),
    component_id and root (the component's smallest fingerprint)."""
    marked = materialise(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                    F.col(text_col).alias("text"))
        .mapInArrow(_fingerprint_rows(size), "doc_id long, text_hash long, fp long"), "fingerprints")
    fps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fps")
    roots = connected_components(fingerprint_links(fps, max_bits, tile))
    grouped = _grouped(fps, roots)
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = grouped.join(smallest, "root").select("fp", "component_id", "root")
    return marked.join(classes, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def _grouped(fps: DataFrame, roots: DataFrame) -> DataFrame:
    return (fps.join(roots, fps.fp == roots.node, "left")
               .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of ``docs`` (all their columns) with one row left of each
    component: the one of the smallest (doc_id, text hash), null ids last."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    rank = F.struct(F.col("doc_id").isNull().alias("nil"), F.coalesce("doc_id", F.lit(0)).alias("id"),
                    F.col("text_hash").alias("th"))
    stay = found.groupBy("root").agg(F.min(rank).alias("k")).select("k.nil", "k.id", "k.th")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      F.col(id_col).isNull().alias("nil"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
                      F.xxhash64(text_col).alias("th"))
    return own.join(stay, ["nil", "id", "th"]).dropDuplicates(["nil", "id", "th"]).select("row.*")
