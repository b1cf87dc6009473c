"""Personal data by base patterns and a semi-Markov conditional random field.

Base spans are the leftmost non-overlapping matches of one pattern per kind
that pass the kind's check; they always stay.  The random field adds spans
where the patterns fail as a whole, for instance a telephone number run
together with a card number: it labels a text's *islands* (stretches of
words that hold a digit or ``@``) with segments.  Every segment has a type
(a kind, or outside), is scored by features of the whole span and its two
neighbouring characters plus a weight for the pair of adjacent types, and
dynamic programming over segments of bounded length picks boundaries and
types together.  Text outside islands holds no candidate, so islands are
independent of each other.

Training maximises the conditional likelihood on a bounded sample of
islands labelled by the base spans.  Islands in which a pattern matched
but its check failed are ambiguous and are left out of training.  Without
any base span in the sample nothing is added.

Null and empty texts have no spans.  Equal rows get equal results; a null
id is an id like any other; extra columns are ignored; an empty table gives
an empty result.  Offsets are code points, ends exclusive.  A very long text,
or one island of any length, is read candidate by candidate: only the last
positions of the dynamic programming are kept, with ten bytes of back pointers
for each atom of a stretch in which candidates touch one another.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskwave.llm.common import emit

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000      # documents whose islands may train the model
SAMPLE_ISLANDS = 4000     # islands the model is trained on
ISLAND_CHARS = 400        # longest island taken for training
EPOCHS, RATE, DECAY = 15, 0.5, 1e-3
MAX_ATOMS = {"email": 25, "ip": 7, "card": 37, "phone": 33}     # bounded segment lengths

# ---- base spans ---------------------------------------------------------------
# Linear-time forms of the patterns: a digit run is entered at its start
# only, and never given back.

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARKS = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end, True
        at = text.find("@", at + 1)


def base_matches(text: str):
    """(kind, start, end, passed) of every pattern match, by kind and start."""
    if "@" in text:
        for a, b, ok in _emails(text):
            yield "email", a, b, ok
    if not _MARKS.search(text):
        return
    for m in _IP.finditer(text):
        yield "ip", m.start(), m.end(), all(map(_octet, m.group().split(".")))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            yield "card", m.start(), m.end(), 13 <= len(d) <= 19 and luhn(d)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15


# ---- islands and candidate segments ---------------------------------------------

_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")


_BETWEEN = " ().-"        # what may stand between the digits of one number


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches of words that hold a digit or ``@``, one white-space character
    apart, or as many characters of a number's punctuation as a candidate may
    hold (``+49 30 - 1234567``)."""
    out: list[list[int]] = []
    pos = 0
    while (m := _MARKS.search(text, pos)):
        a = m.start()
        while a > pos and not text[a - 1].isspace():
            a -= 1
        b = m.end()
        while b < len(text) and not text[b].isspace():
            b += 1
        gap = a - out[-1][1] if out else 0
        if out and (gap <= 1 or gap < MAX_ATOMS["phone"] and not text[out[-1][1]:a].strip(_BETWEEN)):
            out[-1][1] = b
        else:
            out.append([a, b])
        pos = b
    return [(a, b) for a, b in out]


class Atoms:
    """The atoms of text[a:b]: runs of letters or of digits, else characters."""

    def __init__(self, text: str, a: int, b: int):
        self.text = text
        self.bounds = array("q", (m.start() for m in _ATOM.finditer(text, a, b)))
        self.bounds.append(b)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def __getitem__(self, i: int) -> str:
        return self.text[self.bounds[i]:self.bounds[i + 1]]


@dataclass
class Segment:
    first: int            # atoms [first, last)
    last: int
    kind: str
    features: tuple[str, ...]


def _class(c: str) -> str:
    if not c:
        return "edge"
    if c in "0123456789":
        return "digit"
    if c.isalpha():
        return "letter"
    return "space" if c.isspace() else c if c in "+-.,()@_%" else "other"


def _groups(span: str) -> str:
    return "-".join(str(min(len(g), 9)) for g in re.findall("[0-9]+", span))


def span_features(kind: str, span: str, before: str, after: str) -> tuple[str, ...]:
    """Features of a whole candidate span, each tied to its kind."""
    digits = _digits(span)
    f = ["bias", f"before={_class(before)}", f"after={_class(after)}"]
    if kind == "email":
        local, _, domain = span.partition("@")
        labels = domain.split(".")
        f += [f"labels={min(len(labels), 4)}", f"tld={labels[-1].isalpha()}", f"first={_class(local[:1])}",
              f"last={_class(domain[-1:])}", f"empty={'' in labels}"]
    elif kind == "ip":
        parts = span.split(".")
        f += [f"zeros={any(len(p) > 1 and p[0] == '0' for p in parts)}"]
    else:
        f += [f"digits={len(digits)}", f"groups={_groups(span)}", f"seps={''.join(sorted(set(span) - set(digits)))}"]
        if kind == "phone":
            f += [f"plus={span[0] == '+'}", f"parens={span.count('(') == span.count(')')}"]
    return tuple(f"{kind}:{x}" for x in f)


EMAIL_REACH = MAX_ATOMS["email"] // 2     # atoms of an address on either side of its @


def candidate_groups(words: Atoms) -> Iterator[tuple[int, list[Segment]]]:
    """(atom, candidates that this atom gives rise to), by ascending atom: it
    is the first atom of a number, the ``@`` of an address."""
    text, bounds = words.text, words.bounds
    out: list[Segment] = []

    def add(kind, i, j):
        s, e = bounds[i], bounds[j]
        if kind == "card" and not luhn(_digits(text[s:e])) or \
                kind == "ip" and not all(map(_octet, text[s:e].split("."))):
            return            # a segment must pass its kind's check
        out.append(Segment(i, j, kind, span_features(kind, text[s:e], text[s - 1:s], text[e:e + 1])))

    for i in range(len(words)):
        c = text[bounds[i]]
        if c == "@":
            lows = []
            k = i - 1
            while k >= 0 and i - k <= EMAIL_REACH and ((w := words[k]).isascii() and w.isalnum() or w in "._%+-"):
                lows.append(k)
                k -= 1
            j, dots = i + 1, 0
            while j < len(words) and j - i <= EMAIL_REACH and ((w := words[j]).isascii() and w.isalnum() or w in ".-"):
                dots += w == "."
                j += 1
                if dots and w != ".":
                    for k in lows:
                        add("email", k, j)
        elif c in "0123456789":
            if i + 7 <= len(words) and all(words[i + k] == "." if k % 2 else words[i + k][0] in "0123456789"
                                           for k in range(7)):
                add("ip", i, i + 7)
            _numbers("card", words, i, " -", 13, 19, add)
        if c in "+(0123456789":
            _numbers("phone", words, i, _BETWEEN, 9, 15, add)
        if out:
            yield i, out
            out = []


def candidates(text: str, a: int, b: int) -> tuple[list[int], list[Segment]]:
    """Atom boundaries of the island text[a:b], and its candidate segments."""
    words = Atoms(text, a, b)
    return words.bounds.tolist(), [s for _, group in candidate_groups(words) for s in group]


def _numbers(kind, words, i, between, least, most, add):
    """Candidates from atom i on with ``least`` to ``most`` digits."""
    n, j = 0, i + 1 if words[i][0] in "+(" else i
    while j < len(words) and j - i < MAX_ATOMS[kind]:
        if words[j][0] in "0123456789":
            n += len(words[j])
            if n > most:
                return
            if n >= least:
                add(kind, i, j + 1)
        elif words[j] not in between:
            return
        j += 1


# ---- the random field -------------------------------------------------------------

def _logsum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


OUTSIDE = "outside"


@dataclass
class SemiCrf:
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, s: Segment) -> float:
        return sum(self.weights.get(f, 0.0) for f in s.features)

    def pair(self, left: str, right: str) -> float:
        return self.weights.get(f"pair:{left}>{right}", 0.0) if OUTSIDE not in (left, right) else 0.0

    def segmentation(self, groups: Iterable[tuple[int, list[Segment]]]) -> Iterator[tuple[int, int, str]]:
        """The segments (first, last, kind) of the highest-scoring
        segmentation.  Outside atoms score 0 and have no pair weights, so
        stretches of candidates that do not touch are independent."""
        open_ = None
        for atom, segments in groups:
            if open_ is not None and atom - EMAIL_REACH > open_.end:
                yield from open_.trace()
                open_ = None
            open_ = open_ or _Stretch(self, atom - EMAIL_REACH)
            open_.add(atom, segments)
        if open_ is not None:
            yield from open_.trace()

    def best(self, n: int, segments: list[Segment]) -> list[Segment]:
        """Highest-scoring segmentation of n atoms, as candidates."""
        of: dict[tuple, Segment] = {}
        for s in segments:
            key = (s.first, s.last, s.kind)
            if key not in of or self.score(s) > self.score(of[key]):
                of[key] = s
        ordered = sorted(segments, key=lambda s: s.first)
        return [of[key] for key in self.segmentation((s.first, [s]) for s in ordered)]

    def gradient(self, n: int, segments: list[Segment], gold: set[tuple]) -> Counter:
        """Gold minus expected feature counts of one island."""
        ends, begins = {}, {}
        for k, s in enumerate(segments):
            ends.setdefault(s.last, []).append(k)
            begins.setdefault(s.first, []).append(k)
        own = [self.score(s) for s in segments]
        alpha: list[dict[str, float]] = [{OUTSIDE: 0.0}]
        for j in range(1, n + 1):
            cells: dict[str, list[float]] = {OUTSIDE: list(alpha[j - 1].values())}
            for k in ends.get(j, ()):
                s = segments[k]
                cells.setdefault(s.kind, []).extend(v + self.pair(p, s.kind) + own[k]
                                                    for p, v in alpha[s.first].items())
            alpha.append({p: _logsum(v) for p, v in cells.items()})
        beta: list[dict[str, float]] = [{} for _ in range(n + 1)]
        beta[n] = dict.fromkeys(alpha[n], 0.0)
        for i in range(n - 1, -1, -1):
            for p in alpha[i]:
                xs = [beta[i + 1][OUTSIDE]]
                for k in begins.get(i, ()):
                    s = segments[k]
                    xs.append(self.pair(p, s.kind) + own[k] + beta[s.last][s.kind])
                beta[i][p] = _logsum(xs)
        z = _logsum(list(alpha[n].values()))
        out: Counter = Counter()
        for k, s in enumerate(segments):
            for p, v in alpha[s.first].items():
                prob = math.exp(v + self.pair(p, s.kind) + own[k] + beta[s.last][s.kind] - z)
                if p != OUTSIDE:
                    out[f"pair:{p}>{s.kind}"] -= prob
                for f in s.features:
                    out[f] -= prob
        chosen = sorted((s for s in segments if (s.first, s.last, s.kind) in gold), key=lambda s: s.first)
        for left, s in zip([None, *chosen], chosen):
            for f in s.features:
                out[f] += 1
            if left is not None and left.last == s.first:
                out[f"pair:{left.kind}>{s.kind}"] += 1
        return out

    def fit(self, islands_: list[tuple[int, list[Segment], set]], counts: list[int]) -> "SemiCrf":
        """Adaptive gradient steps on the penalised conditional likelihood."""
        squares: Counter = Counter()
        for _ in range(EPOCHS):
            for (n, segments, gold), many in zip(islands_, counts):
                for f, g in self.gradient(n, segments, gold).items():
                    g = g * min(many, 20) - DECAY * self.weights.get(f, 0.0)
                    squares[f] += g * g
                    if squares[f] > 0:
                        self.weights[f] = self.weights.get(f, 0.0) + RATE * g / math.sqrt(squares[f])
        return self


_TYPES = (OUTSIDE, *KINDS)


class _Stretch:
    """Dynamic programming over one stretch of touching candidates.  ``recent``
    holds the last positions' best values by the type that ends there,
    ``pending`` those of segments that end further on; a position that is done
    leaves the length of its best segment and the type before it."""

    def __init__(self, crf: SemiCrf, origin: int):
        self.crf, self.origin, self.at, self.end = crf, origin, origin, origin
        self.recent: dict[int, dict[str, float]] = {origin: {OUTSIDE: 0.0}}
        self.pending: dict[int, dict[str, tuple[float, int, str]]] = {}
        self.lengths, self.before = bytearray(len(_TYPES)), bytearray(len(_TYPES))

    def _advance(self, to: int) -> None:
        while self.at < to:
            left = max(self.recent[self.at].items(), key=lambda kv: kv[1])
            self.at += 1
            here = {OUTSIDE: left[1]}
            lengths, before = bytearray(len(_TYPES)), bytearray(len(_TYPES))
            lengths[0], before[0] = 1, _TYPES.index(left[0])
            for kind, (value, length, prev) in self.pending.pop(self.at, {}).items():
                k = _TYPES.index(kind)
                here[kind], lengths[k], before[k] = value, length, _TYPES.index(prev)
            self.lengths += lengths
            self.before += before
            self.recent[self.at] = here
            self.recent.pop(self.at - EMAIL_REACH - 1, None)

    def add(self, atom: int, segments: list[Segment]) -> None:
        self._advance(atom)
        for s in segments:
            value, prev = max((v + self.crf.pair(k, s.kind), k) for k, v in self.recent[s.first].items())
            value += self.crf.score(s)
            ends = self.pending.setdefault(s.last, {})
            if s.kind not in ends or value > ends[s.kind][0]:
                ends[s.kind] = (value, s.last - s.first, prev)
            self.end = max(self.end, s.last)

    def trace(self) -> list[tuple[int, int, str]]:
        self._advance(self.end)
        last = self.recent[self.at]
        out, j, k = [], self.at, _TYPES.index(max(last, key=last.get))
        while j > self.origin:
            cell = (j - self.origin) * len(_TYPES) + k
            if k:
                out.append((j - self.lengths[cell], j, _TYPES[k]))
            j, k = j - self.lengths[cell], self.before[cell]
        return out[::-1]


def _silver(text: str, a: int, b: int, matches) -> list[tuple[str, int, int]] | None:
    """Base spans inside the island as labels, longest first where they
    overlap; None if it is ambiguous: a match reaches out of it, or holds
    more digits than its kind has and so may be several spans run together."""
    inside = [m for m in matches if m[1] < b and m[2] > a]
    for kind, s, e, ok in inside:
        if s < a or e > b or not ok and len(_digits(text[s:e])) > {"card": 19, "phone": 15}.get(kind, e - s):
            return None
    out: list[tuple[str, int, int]] = []
    for kind, s, e, ok in sorted(inside, key=lambda m: m[1] - m[2]):
        if ok and all(e <= x or s >= y for _, x, y in out):
            out.append((kind, s, e))
    return out


def _sample_islands(batches):
    schema = pa.schema([("left", pa.string()), ("island", pa.string()), ("right", pa.string()),
                        ("labels", pa.string())])
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            if not text or not _MARKS.search(text):
                continue
            matches = list(base_matches(text))
            for a, b in islands(text):
                labels = _silver(text, a, b, matches) if b - a <= ISLAND_CHARS else None
                if labels is not None:
                    rows.append((text[a - 1:a] if a else "", text[a:b], text[b:b + 1],
                                 ",".join(f"{k}:{s - a}:{e - a}" for k, s, e in labels)))
        yield emit(schema, dict(zip(schema.names, zip(*rows))) if rows else dict.fromkeys(schema.names, []))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
          sample_islands: int = SAMPLE_ISLANDS) -> SemiCrf | None:
    ids = (docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct())
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")
    found = sample.select("text").mapInArrow(_sample_islands, "left string, island string, right string, labels string")
    labelled = found.where("labels <> ''").orderBy(F.xxhash64("island"), "island", "left", "right")
    plain = found.where("labels = ''").orderBy(F.xxhash64("island"), "island", "left", "right")
    rows = [r for part in (labelled, plain) for r in part.limit(sample_islands // 2).collect()]
    if not any(r.labels for r in rows):
        return None
    shapes: dict[tuple, list] = {}
    for r in rows:
        text = r.left + r.island + r.right
        bounds, segments = candidates(text, len(r.left), len(r.left) + len(r.island))
        at = {p - len(r.left): k for k, p in enumerate(bounds)}
        gold = set()
        for k, s, e in (x.split(":") for x in r.labels.split(",") if x):
            if int(s) in at and int(e) in at:
                gold.add((at[int(s)], at[int(e)], k))
        if not gold <= {(s.first, s.last, s.kind) for s in segments}:
            continue            # cut inside an atom: cannot be spelt in segments
        key = (tuple((s.first, s.last, s.kind, s.features) for s in segments), tuple(sorted(gold)))
        shapes.setdefault(key, [(len(bounds) - 1, segments, gold), 0])[1] += 1
    items = [v for k, v in sorted(shapes.items(), key=lambda kv: repr(kv[0])) if v[0][1]]
    return SemiCrf().fit([v[0] for v in items], [v[1] for v in items])


def find_spans(text: str, model: SemiCrf | None) -> tuple[list[tuple], list[tuple]]:
    """(base spans, all spans) as (kind, start, end), by kind and start."""
    if not text or not _MARKS.search(text):
        return [], []
    base = [(k, a, b) for k, a, b, ok in base_matches(text) if ok]
    taken: list[list[int]] = []             # what base spans cover, as disjoint stretches
    for _, a, b in sorted(base, key=lambda m: m[1]):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    extra = []
    for a, b in islands(text) if model is not None else ():
        words = Atoms(text, a, b)
        for first, last, kind in model.segmentation(candidate_groups(words)):
            x, y = words.bounds[first], words.bounds[last]
            k = bisect_right(starts, y - 1)           # the last stretch that starts before y
            if not k or taken[k - 1][1] <= x:
                extra.append((kind, x, y))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + extra, key=lambda s: (order[s[0]], s[1]))


def _tag(model):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(span)), ("spans", pa.list_(span))])

    def rows(spans):
        return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches):
        crf = model.value if model is not None else None
        for batch in batches:
            both = [find_spans(t, crf) for t in batch.column("text").to_pylist()]
            yield emit(schema, {"doc_id": batch.column("doc_id"), "base": [rows(b) for b, _ in both],
                                "spans": [rows(s) for _, s in both]})
    return run


def tag_documents(docs: DataFrame, model: SemiCrf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model) if model is not None else None
    span = "array<struct<kind:string,start:long,end:long>>"
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(_tag(shared), f"doc_id long, base {span}, spans {span}"))


def digest(tagged: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return tagged.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"),
                         joined("spans").alias("spans"))
