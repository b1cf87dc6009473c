"""Quality score by compression with two dictionaries.

One zstandard dictionary is built from good and one from bad labelled
text.  A text is compressed with each of them, in blocks of
``BLOCK_BYTES``; the normalised difference of the two compressed sizes,
``(bad - good) / (bad + good)``, becomes a probability by a logistic
calibration on labelled rows that the dictionaries were not built from.

The dictionaries come from a bounded sample of labelled rows, of which
whole texts of at most ``TEXT_BYTES`` count up to ``SAMPLE_BYTES`` a class.  Only the text enters
a score.  Null and empty texts have difference 0 and get the score of that
difference.  Without labelled rows of both classes every score is 0.5.
Equal rows get equal scores; a null id is never held out; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskwave.llm.labelled import class_totals, held_out, labelled_sample, with_text

ROWS_PER_CLASS = 1500        # labelled rows of each class that are looked at
SAMPLE_BYTES = 16 << 20      # most bytes of sampled text a class
TEXT_BYTES = 1 << 20         # longer texts are not sampled (they are scored like all others)
DICTIONARY_BYTES = 112 << 10
BLOCK_BYTES = 4096
LEVEL = 3
CUT = 0.3                    # score from which a document is predicted good


@dataclass
class Dictionaries:
    good: bytes
    bad: bytes
    slope: float
    shift: float

    def coders(self):
        import zstandard
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=self._data(d), write_checksum=False,
                                         write_content_size=False, write_dict_id=False)
                for d in (self.good, self.bad)]

    @staticmethod
    def _data(raw: bytes):
        import zstandard
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        return d


def difference(data: bytes, coders) -> float:
    """Normalised difference of the compressed sizes; positive: good."""
    good = bad = 0
    for at in range(0, len(data), BLOCK_BYTES):
        block = data[at:at + BLOCK_BYTES]
        good += len(coders[0].compress(block))
        bad += len(coders[1].compress(block))
    return (bad - good) / (bad + good) if good else 0.0


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard
    blocks = [t[i:i + BLOCK_BYTES] for t in texts for i in range(0, len(t), BLOCK_BYTES)]
    size = min(DICTIONARY_BYTES, max(1 << 10, sum(map(len, blocks)) // 8))
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:      # too few samples to train on: use their text itself
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def _platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-variable logistic fit, by Newton steps with
    a small penalty on the slope; ``w`` weights the rows."""
    scale = x.std() or 1.0
    z, beta = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (y - p)) - np.array([1e-2 * beta[0], 0])
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-9])
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", rows_per_class: int = ROWS_PER_CLASS) -> Dictionaries | None:
    """Dictionaries from half of the sample, calibration on the other half."""
    sample = with_text(labelled_sample(labels, label_col, rows_per_class, id_col), docs, id_col, text_col)
    size = F.sum(F.octet_length("text")).over(_by_hash())
    rows = (sample.where(F.octet_length("text") <= TEXT_BYTES).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)).cast("int"))
            .withColumn("upto", size).where(F.col("upto") <= SAMPLE_BYTES)
            .select("doc_id", "label", "half", "text").collect())       # bounded by rows and bytes
    rows.sort(key=lambda r: r.doc_id)
    part = {(h, k): [r.text.encode() for r in rows if (r.half, r.label) == (h, k)] for h in (0, 1) for k in (0, 1)}
    if not all(part.values()):
        return None
    out = Dictionaries(_dictionary(part[0, 1]), _dictionary(part[0, 0]), 1.0, 0.0)
    coders = out.coders()
    x = np.array([difference(t, coders) for k in (0, 1) for t in part[1, k]])
    y = np.repeat([0.0, 1.0], [len(part[1, 0]), len(part[1, 1])])
    total = class_totals(labels, label_col, id_col)
    w = np.where(y > 0, total[1] / len(part[1, 1]), total[0] / len(part[1, 0]))
    out.slope, out.shift = _platt(x, y, w * len(w) / w.sum())
    return out


def _by_hash():
    from pyspark.sql import Window
    return Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))


def _score(model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("difference", pa.float64()),
                        ("score", pa.float64())])

    def run(batches):
        coders = model.value.coders() if model else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            diff = np.array([difference(t.encode(), coders) if t and coders else 0.0 for t in texts], float)
            score = 1 / (1 + np.exp(-np.clip(model.value.slope * diff + model.value.shift, -40, 40))) \
                if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"),
                                              pa.array(diff), pa.array(score)], schema=schema)
    return run


def score(docs: DataFrame, model: Dictionaries | None, id_col: str = "doc_id", text_col: str = "text",
          cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, difference of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model) if model is not None else None
    out = (docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).alias("text"))
           .mapInArrow(_score(shared), "doc_id long, held_out boolean, difference double, score double"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"), "difference")
