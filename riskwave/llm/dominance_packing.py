"""Best-fit packing of whole documents after Martello-Toth reduction.

A document's tokens are its ids and an end id.  Longer ones than the window
are cut into whole windows, the first piece holding what is over; such whole
windows are sequences of their own.  What is left is bin packing of items of
1 to ``window - 1`` tokens, and an instance is no more than its histogram:
how many items there are of each size.

1. *Reduction* (``reduce``).  For the largest item j, with room R left beside
   it, a set of at most three items is fixed for good if it dominates every
   other feasible set with j (each alternative can be split into parts that
   the set's items are at least as large as), so that some best packing has
   it: j alone, if nothing fits; j with the item of size R; j with the largest
   item that fits, if no two items fit or no pair is larger than it; j with
   the largest item that fits and the largest beside that, if no three items
   fit and no pair that fits has a larger smaller half.  Fixed sets shrink the
   instance, so passes over the sizes go on until one fixes nothing.
2. *Best fit decreasing* (``best_fit``) packs the rest.

Both work on counts: equal sets are fixed, and equal bins filled, all at once,
so the time depends on the number of sizes, never on the number of documents.
The result is a list of bin kinds (contents, how many); an item's bin follows
from its size and its rank among the items of its size.

On Spark: texts are tokenised once; each row is written with its partition
number and its rank among the rows of its size in that partition.  Counts per
(partition, size) give the ranks' offsets and the histogram (at most
``window`` rows, the only thing the driver gets).  Offsets are broadcast up to
``MAX_OFFSETS`` rows, else joined by a shuffled hash join that streams the
documents; a common size is spread over the partitions.

Null and empty texts are one token, the end id.  A very long text is encoded
whole by its task; pieces are passed on in runs of ``RUN_TOKENS``.  Repeated
rows are packed once each; which of several rows of one size gets which place
depends on their order in the table only.  A null id is an id like any other.
Other columns are ignored, whatever their names.  An empty table gives an
empty result.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskwave.llm.byte_chunks import loaded
from riskwave.llm.common import emit, materialise

WINDOW = 2048
END_ID = 0
MAX_OFFSETS = 500_000       # (partition, size) offsets sent to every task at most, 24 bytes each
RUN_TOKENS = 1 << 22        # tokens of the pieces that a task passes on at once

Kind = tuple[tuple[tuple[int, int], ...], int]      # ((size, how many in a bin), ...), number of bins


# ---- packing of a histogram ---------------------------------------------------

class _Sizes:
    """A multiset of sizes by count, with its sizes in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n}
        self.order = sorted(self.count)

    def add(self, size: int, n: int) -> None:
        left = self.count.get(size, 0) + n
        if left:
            if size not in self.count:
                bisect.insort(self.order, size)
            self.count[size] = left
        elif size in self.count:
            del self.count[size]
            del self.order[bisect.bisect_left(self.order, size)]

    def at_most(self, room: int) -> int:
        """The largest size of at most ``room``; 0 if there is none."""
        i = bisect.bisect_right(self.order, room)
        return self.order[i - 1] if i else 0

    def least(self, k: int) -> list[int]:
        """The k smallest items."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(self.count[s], k - len(out))
            if len(out) == k:
                break
        return out

    def best_pair(self, room: int) -> int:
        """The largest sum of two items that is at most ``room``; 0 if none is."""
        best, lo, hi = 0, 0, bisect.bisect_right(self.order, room) - 1
        while lo <= hi:
            a, b = self.order[lo], self.order[hi]
            if a + b > room:
                hi -= 1
            else:
                if lo < hi or self.count[a] > 1:
                    best = max(best, a + b)
                lo += 1
        return best

    def best_half(self, room: int) -> int:
        """The largest smaller half of a pair that is at most ``room``."""
        for i in range(bisect.bisect_right(self.order, room // 2) - 1, -1, -1):
            s = self.order[i]
            other = s if self.count[s] > 1 else self.order[i + 1] if i + 1 < len(self.order) else room
            if s + other <= room:
                return s
        return 0


def dominating(j: int, others: _Sizes, window: int) -> list[int] | None:
    """At most three items, j among them, that dominate every feasible set
    of j and ``others``; None where that cannot be told."""
    room = window - j
    top = others.at_most(room)
    if not top:
        return [j]
    if top == room:
        return [j, top]
    few = others.least(3)
    if len(few) < 2 or sum(few[:2]) > room:             # one item fits beside j
        return [j, top]
    if len(few) == 3 and sum(few) <= room:              # three do
        return None
    if top >= others.best_pair(room):
        return [j, top]
    others.add(top, -1)
    second = others.at_most(room - top)
    others.add(top, 1)
    return [j, top, second] if second and second >= others.best_half(room) else None


def reduce(counts: dict[int, int], window: int) -> tuple[list[Kind], dict[int, int]]:
    """Fixed bins, and the counts of the items that are left."""
    sizes, fixed, found = _Sizes(counts), [], True
    while found:
        found = False
        for j in sorted(sizes.count, reverse=True):
            while j in sizes.count:
                sizes.add(j, -1)
                chosen = dominating(j, sizes, window)
                sizes.add(j, 1)
                if chosen is None:
                    break
                # It stays dominating while its sizes last: the alternatives only get fewer.
                inside = tuple((s, chosen.count(s)) for s in sorted(set(chosen), reverse=True))
                bins = min(sizes.count[s] // n for s, n in inside)
                for s, n in inside:
                    sizes.add(s, -n * bins)
                fixed.append((inside, bins))
                found = True
    return fixed, sizes.count


def best_fit(counts: dict[int, int], window: int) -> list[Kind]:
    """Best fit decreasing.  ``room[r]`` holds the kinds of open bins with r
    tokens left; all bins of a kind are filled at once.  The bin filled last
    has the least room that fits, so it gets items until none fits."""
    room: dict[int, list[Kind]] = {}
    rooms: list[int] = []

    def put(left: int, inside, bins: int) -> None:
        if bins:
            if left not in room:
                bisect.insort(rooms, left)
            room.setdefault(left, []).append((inside, bins))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                left, inside, bins = window, (), n
            else:
                left = rooms[at]
                inside, bins = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            each = left // size
            whole = min(bins, n // each)
            put(left - each * size, inside + ((size, each),), whole)
            n, bins = n - whole * each, bins - whole
            if bins and n and n < each:                  # the last items open or fill one bin in part
                put(left - n * size, inside + ((size, n),), 1)
                n, bins = 0, bins - 1
            if inside:
                put(left, inside, bins)                  # bins that were not needed
    return [kind for r in rooms for kind in room[r]]


def pack_counts(counts: dict[int, int], window: int) -> list[Kind]:
    """Bin kinds that hold every item once."""
    fixed, rest = reduce(counts, window)
    return fixed + best_fit(rest, window)


class Places:
    """Where the item of a size and a rank lies: each kind of bin takes the
    next ranks of its sizes."""

    def __init__(self, kinds: list[Kind], window: int):
        rows, taken, first = [], {}, 0
        for inside, bins in kinds:
            offset = 0
            for size, each in inside:
                rows.append((size, taken.get(size, 0), each, first, offset))
                taken[size] = taken.get(size, 0) + each * bins
                offset += size * each
            first += bins
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.size, self.start, self.each, self.first, self.offset = table.T.copy()
        self.sequences = first
        # Kinds of a size lie together: start[lo:hi] are their first ranks.
        self.lo = np.searchsorted(self.size, np.arange(window + 1))
        self.hi = np.searchsorted(self.size, np.arange(window + 1), side="right")

    def find(self, size: int, rank: int) -> tuple[int, int]:
        """(sequence, offset in it)."""
        lo, hi = self.lo[size], self.hi[size]
        k = lo + int(np.searchsorted(self.start[lo:hi], rank, side="right")) - 1
        each, within = int(self.each[k]), rank - int(self.start[k])
        return int(self.first[k]) + within // each, int(self.offset[k]) + within % each * size


# ---- on Spark -----------------------------------------------------------------

def _tokenise(path: str, end_id: int, window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("size", pa.int32()),
                        ("local", pa.int64()), ("whole", pa.int64()), ("packed", pa.binary())])

    def run(batches):
        import zstandard
        tok, squeeze = loaded(path), zstandard.ZstdCompressor(level=1)
        end, width = np.array([end_id], tok.dtype).tobytes(), tok.dtype.itemsize
        seen, whole = np.zeros(window, np.int64), 0      # items of each size, whole windows so far
        for batch in batches:
            rows = {name: [] for name in ("n", "size", "local", "whole", "packed")}
            for text in batch.column("text").to_pylist():
                blob = (tok.encode(text) if text else b"") + end
                n = len(blob) // width
                size = n % window
                for name, value in (("n", n), ("size", size), ("local", int(seen[size])), ("whole", whole),
                                    ("packed", squeeze.compress(blob))):
                    rows[name].append(value)
                seen[size] += 1
                whole += n // window
            yield emit(schema, {"doc_id": batch.column("doc_id"), "part": batch.column("part"), **rows})
    return run


PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _cut(dtype: np.dtype, window: int, places):
    def run(batches):
        import zstandard
        unsqueeze, where = zstandard.ZstdDecompressor(), places.value
        rows, held = {f.name: [] for f in _PIECES}, 0

        def piece(*values) -> None:
            for name, value in zip(rows, values):
                rows[name].append(value)

        for batch in batches:
            for b in batch.to_pylist():
                ids = np.frombuffer(unsqueeze.decompress(b["packed"]), dtype).astype("<u4")
                start = k = 0
                if b["size"]:
                    sequence, offset = where.find(b["size"], b["before"] + b["local"])
                    piece(b["doc_id"], 0, 0, b["size"], ids[:b["size"]].tobytes(), sequence, offset)
                    start, k = b["size"], 1
                # Whole windows have numbers of their own, below zero.
                for w in range(len(ids) // window):
                    piece(b["doc_id"], k + w, start, window, ids[start:start + window].tobytes(),
                          -1 - (b["part"] << 40 | b["whole"] + w), 0)
                    start += window
                held += len(ids)
                if held > RUN_TOKENS:
                    yield emit(_PIECES, rows)
                    rows, held = {f.name: [] for f in _PIECES}, 0
        yield emit(_PIECES, rows)
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids
    (little-endian unsigned 32-bit), sequence_id, offset."""
    spark = docs.sparkSession
    tokens = materialise(
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.spark_partition_id().alias("part"),
                    F.col(f"`{text_col}`").alias("text"))
        .mapInArrow(_tokenise(tokenizer_path, end_id, window),
                    "doc_id long, part int, n long, size int, local long, whole long, packed binary"), "tokens")
    counts = materialise(tokens.where("size > 0").groupBy("part", "size").agg(F.count("*").alias("rows")), "sizes")
    histogram = {r["size"]: r["rows"] for r in counts.groupBy("size").agg(F.sum("rows").alias("rows")).collect()}
    places = spark.sparkContext.broadcast(Places(pack_counts(histogram, window), window))
    by_part = Window.partitionBy("size").orderBy("part")
    offsets = counts.select("part", "size", (F.sum("rows").over(by_part) - F.col("rows")).alias("before"))
    side = F.broadcast(offsets) if counts.count() <= MAX_OFFSETS else offsets.hint("shuffle_hash")
    return tokens.join(side, ["part", "size"], "left").mapInArrow(_cut(loaded(tokenizer_path).dtype, window, places), PIECES)
