"""Quality rules: base counts of a text, and a hashed n-gram classifier.

The classifier is a logistic regression on hashed word 1- and 2-grams and
character 3- and 5-grams (bytes of the text), trained on a bounded sample
of labelled rows and calibrated (Platt) on labelled rows that the fit did
not see.  Documents are scored in Arrow batches: every n-gram of a text is
hashed by vectorised arithmetic, and its margin is the mean weight of its
n-grams per family plus a bias, so a text's length does not matter.

A document is kept if it passes the base rules and its calibrated
probability of being good is at least ``MIN_QUALITY``.  Without labelled
rows of both classes there is no model: the probability is null and the
base rules decide alone.  The fit is limited-memory BFGS over the sample's
sparse rows in one task; the sample is bounded by rows and by n-gram entries
(rows in hash order that no longer fit are left out, so one very long text
cannot fill it).

Words are runs of characters other than U+0020 and U+0009 to U+000D.
Null and empty texts have no words, hence fail the base rules.  Equal rows
get equal results; a null id is an id like any other; extra columns are
ignored; an empty table gives an empty result.  A very long text is hashed
in one step of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskwave.llm.common import emit, give_back, text_runs
from riskwave.llm.labelled import class_totals, labelled_sample, with_text

BUCKETS = 1 << 15          # hash buckets per n-gram family
CHAR_GRAMS = (3, 5)
SAMPLE_PER_CLASS = 3000    # labelled rows of each class the model is fitted on
SAMPLE_ENTRIES = 40_000_000    # n-gram entries (8 bytes each) of the sample at most; rows beyond are left out
BLOCK_ENTRIES = 1 << 18    # entries that a step of the fit handles at once
SAMPLE_CHARS = 1 << 17     # characters of sample texts that are hashed at once, or one text
PENALTY = 2e-3             # on the squared weights
MIN_QUALITY = 0.2          # fixed threshold on the calibrated probability
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

_WORD = re.compile(r"[^ \t-\r]+")
_SYMBOLS = "[#*$%&|<>]"
_FAMILIES = 2 + len(CHAR_GRAMS)
_M = np.uint64(0x9E3779B97F4A7C15)   # odd multiplier of the n-gram hashes


# ---- base counts ------------------------------------------------------------

def repeat_words(words: list[str], window: int = 5) -> int:
    """Words lying in windows of ``window`` words that occur twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    # Exact window identities by doubling: pairs of identities are renumbered.
    groups, size = ids, 1
    for step in _doubling(window):
        groups = np.unique(groups[:len(groups) - step] * np.int64(n + 1) + groups[step:],
                           return_inverse=True)[1].astype(np.int64)
        size += step
    counts = np.bincount(groups)
    if counts.max() < 2:
        return 0
    edge = np.zeros(n + 1, np.int64)
    start = np.flatnonzero(counts[groups] > 1)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def _doubling(window: int) -> list[int]:
    """Steps that grow a run of words from 1 to ``window``."""
    steps, size = [], 1
    while size < window:
        steps.append(min(size, window - size))
        size += steps[-1]
    return steps


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = _WORD.findall(text)
    symbols = sum(map(text.count, _SYMBOLS[1:-1]))
    seen: set[str] = set()
    dups = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dups += 1
            elif _WORD.search(line):
                seen.add(line)
    return len(words), sum(map(len, words)), symbols, dups, repeat_words(words)


# ---- hashed n-grams ---------------------------------------------------------

def _buckets(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint64(29))) * _M) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def hashed_grams(texts: list[str]):
    """For each n-gram family: (bucket of each n-gram, first and end n-gram
    of each text).  Texts are joined by line feeds, as many as the longest n-gram
    has bytes, so that no n-gram sees the next text."""
    gap = b"\n" * max(CHAR_GRAMS)
    blobs = [t.encode() + gap for t in texts]
    data = np.frombuffer(b"".join(blobs) + gap, np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(b) for b in blobs])))
    size = int(starts[-1])
    wide = data.astype(np.uint64)
    out = []
    for n in CHAR_GRAMS:
        h = np.zeros(size, np.uint64)
        for i in range(n):
            h = (h << np.uint64(8)) | wide[i:i + size]
        out.append((_buckets(h * _M), starts[:-1], starts[1:] - len(gap)))
    # Words: polynomial hash of each run of non-space bytes, by prefix sums.
    space = (data[:size] == 32) | ((data[:size] >= 9) & (data[:size] <= 13))
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    last = np.flatnonzero(~space & np.concatenate((space[1:], [True])))
    mixed = np.where(space, np.uint64(0), (wide[:size] + np.uint64(1)) * _M)
    begins = np.zeros(size, np.int64)
    begins[first] = first
    place = (np.arange(size) - np.maximum.accumulate(begins)).astype(np.uint64)
    mixed *= (place * np.uint64(0xD1342543DE82EF95) + np.uint64(1)) | np.uint64(1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    word = sums[last + 1] - sums[first]
    word ^= word >> np.uint64(31)
    at = np.searchsorted(first, starts)
    begin, end = at[:-1], at[1:]
    out.append((_buckets(word * _M), begin, end))
    following = np.concatenate((word[1:], word[:1]))
    following[end[end > begin] - 1] = 0      # a text's last word has none
    pair = word * np.uint64(3) + (following ^ (following << np.uint64(7))) * np.uint64(5)
    out.append((_buckets(pair * _M), begin, end))
    return out


def _means(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mean of each text's slice (0 where it is empty)."""
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return (sums[end] - sums[begin]) / np.maximum(end - begin, 1)


class _Rows:
    """Sparse training rows in blocks of about ``BLOCK_ENTRIES`` entries."""

    def __init__(self):
        self.blocks, self.y, self.entries, self._open = [], [], 0, ([], [], [])

    def add(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        for part, value in zip(self._open, (at, x, len(at))):
            part.append(value)
        self.y.append(y)
        self.entries += len(at)
        if sum(self._open[2]) > BLOCK_ENTRIES:
            self.close()

    def close(self) -> None:
        if self._open[2]:
            at, x, many = self._open
            self.blocks.append((np.concatenate(at), np.concatenate(x), np.array(many)))
            self._open = [], [], []

    def margins(self, w: np.ndarray) -> np.ndarray:
        out = []
        for at, x, many in self.blocks:
            sums = np.concatenate(([0.0], np.cumsum(w[at] * x, dtype=np.float64)))
            ends = np.cumsum(many)
            out.append(sums[ends] - sums[ends - many])
        return np.concatenate(out)

    def weighted_sums(self, r: np.ndarray, size: int) -> np.ndarray:
        """Sum of the rows, each times its ``r``."""
        out, row = np.zeros(size), 0
        for at, x, many in self.blocks:
            out += np.bincount(at, np.repeat(r[row:row + len(many)], many) * x, size)
            row += len(many)
        return out


def _features(texts: list[str]):
    """Per text: bucket numbers and scaled relative frequencies."""
    for _, run in text_runs(texts, SAMPLE_CHARS):
        fams = hashed_grams(run)
        for i in range(len(run)):
            at, x = [], []
            for f, (buckets, begin, end) in enumerate(fams):
                own, count = np.unique(buckets[begin[i]:end[i]], return_counts=True)
                at.append((own + f * BUCKETS).astype(np.int32))
                x.append((count / max(1, end[i] - begin[i]) * SCALE).astype(np.float32))
            yield np.concatenate(at), np.concatenate(x)


def _lbfgs(value_and_slope, w: np.ndarray, steps: int = 40, memory: int = 8, tol: float = 1e-5) -> np.ndarray:
    """Minimise a convex function with limited-memory BFGS steps."""
    f, g = value_and_slope(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ d))
            d -= alphas[-1] * y
        if past:
            d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y, rho), alpha in zip(past, reversed(alphas)):
            d += (alpha - rho * (y @ d)) * s
        length, down = 1.0 if past else 1 / max(1.0, np.abs(d).sum()), g @ d
        while True:
            moved = w + length * d
            f_new, g_new = value_and_slope(moved)
            if f_new <= f + 1e-4 * length * down or length < 1e-10:
                break
            length /= 2
        s, y = moved - w, g_new - g
        if s @ y > 1e-12:
            past = [*past[1 - memory:], (s, y, 1 / (s @ y))]
        gain, w, f, g = f - f_new, moved, f_new, g_new
        if gain <= tol * max(abs(f), 1e-12):
            break
    return w


def _fit(rows: _Rows, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression, mean loss plus ``penalty``
    halves of the squared weights."""
    y, size = np.array(rows.y), _FAMILIES * BUCKETS

    def value_and_slope(w):
        m = rows.margins(w[:-1]) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(m, -50, 50)))
        loss = np.mean(np.logaddexp(0, m) - y * m) + penalty / 2 * (w[:-1] @ w[:-1])
        r = (p - y) / len(y)
        return loss, np.concatenate((rows.weighted_sums(r, size) + penalty * w[:-1], [r.sum()]))

    start = np.zeros(size + 1)
    start[-1] = np.log(max(y.mean(), 1e-9) / max(1 - y.mean(), 1e-9))
    w = _lbfgs(value_and_slope, start)
    return w[:-1], float(w[-1])


def _platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted one-variable logistic fit (Newton steps)."""
    z, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (w * (y - p)) - np.array([1e-4 * beta[0], 0])
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag([1e-4, 1e-9]), slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


SCALE = 30.0    # n-gram shares are small; a common scale for the penalty


@dataclass
class QualityModel:
    weights: np.ndarray     # per family and bucket, already scaled
    bias: float
    slope: float            # calibration: sigmoid(slope * margin + shift)
    shift: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        margin = np.full(len(texts), self.bias)
        for f, (buckets, begin, end) in enumerate(hashed_grams(texts)):
            margin += _means(self.weights[f][buckets], begin, end)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def _fitted(fit: _Rows, held: _Rows, total: dict[int, int]) -> dict | None:
    """Columns of the model; None if either part lacks a class."""
    fit.close()
    held.close()
    if len(set(fit.y)) < 2 or len(set(held.y)) < 2:
        return None
    w, bias = _fit(fit, PENALTY)
    y = np.array(held.y)
    part = np.where(y > 0, total[1] / (y > 0).sum(), total[0] / (y == 0).sum())
    slope, shift = _platt(held.margins(w) + bias, y, part * len(y) / part.sum())
    return {"weights": (w * SCALE).astype("<f4").tobytes(), "bias": bias, "slope": slope, "shift": shift}


def _train_rows(total: dict[int, int], max_entries: int):
    """One task: the sample's rows in hash order -> the model, as one row."""
    def run(batches):
        fit, held = _Rows(), _Rows()
        for batch in batches:
            label, fold = batch.column("label").to_pylist(), batch.column("fold").to_pylist()
            for (at, x), y, k in zip(_features(batch.column("text").to_pylist()), label, fold):
                if fit.entries + held.entries + len(at) <= max_entries:
                    (fit if k else held).add(at, x, float(y))
        model = _fitted(fit, held, total)
        del fit, held
        give_back()
        if model is not None:
            yield emit(_MODEL, {k: [v] for k, v in model.items()})
    return run


_MODEL = pa.schema([("weights", pa.binary()), ("bias", pa.float64()), ("slope", pa.float64()), ("shift", pa.float64())])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", rows_per_class: int = SAMPLE_PER_CLASS,
          max_entries: int = SAMPLE_ENTRIES) -> QualityModel | None:
    """Fit on four fifths of the sample and calibrate on the rest; None if
    either part lacks a class.  The sample is bounded, so one task holds it as
    sparse rows and the driver gets the weights alone."""
    sample = with_text(labelled_sample(labels, label_col, rows_per_class, id_col), docs, id_col, text_col)
    rows = (sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)).cast("long"))
            .repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "label", "fold"))
    model = rows.mapInArrow(_train_rows(class_totals(labels, label_col, id_col), max_entries),
                            "weights binary, bias double, slope double, shift double").collect()
    if not model:
        return None
    weights = np.frombuffer(model[0]["weights"], "<f4").reshape(_FAMILIES, BUCKETS)
    return QualityModel(weights, model[0]["bias"], model[0]["slope"], model[0]["shift"])


# ---- scoring ----------------------------------------------------------------

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(model):
    fields = [(c, pa.int64()) for c in COLUMNS] + [("quality_prob", pa.float64())]

    def run(batches):
        for batch in batches:
            rest = [i for i, name in enumerate(batch.schema.names) if name != "_text"]
            schema = pa.schema([batch.schema.field(i) for i in rest] + [pa.field(*f) for f in fields])
            texts = batch.column("_text").to_pylist()
            counts = [base_counts(t or "") for t in texts]
            cols = [pa.array(c, pa.int64()) for c in zip(*counts)] or [pa.array([], pa.int64())] * 5
            prob = np.empty(len(texts))
            if model is not None:
                for off, some in text_runs(texts):
                    prob[off:off + len(some)] = model.value.probabilities(some)
            probs = pa.array(prob) if model is not None else pa.nulls(len(texts), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + cols + [probs], schema=schema)
        give_back()
    return run


def judge(docs: DataFrame, model: QualityModel | None, carry: list[str], text_col: str = "text",
          min_quality: float = MIN_QUALITY) -> DataFrame:
    """``carry`` columns plus the base counts, quality_prob, base_failed and
    kept.  ``carry`` may name the text column too."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model) if model is not None else None
    src = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("_text"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name != "_text")
    out = src.mapInArrow(_judge(shared), ddl + "".join(f", {c} long" for c in COLUMNS) + ", quality_prob double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good = F.coalesce(F.col("quality_prob") >= min_quality, F.lit(True))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], *COLUMNS,
                      failed.alias("base_failed"), (~failed & good).alias("kept"), "quality_prob")


def keep_documents(docs: DataFrame, model: QualityModel | None, text_col: str = "text", **rules) -> DataFrame:
    """The kept documents, with the columns of ``docs``."""
    names = docs.columns
    judged = judge(docs.toDF(*[f"in{i}" for i in range(len(names))]), model, [f"in{i}" for i in range(len(names))],
                   f"in{names.index(text_col)}", **rules)
    return judged.where("kept").select(*[F.col(f"in{i}").alias(c) for i, c in enumerate(names)])
