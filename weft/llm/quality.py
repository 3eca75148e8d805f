"""Quality classifier: zstandard dictionaries of good and bad text; which one packs a text smaller is its score."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, training_sample
from .hashing import batches_of

#: At most so many labelled rows of each class are learned from (for the dictionaries, and for the curve by halves).
SAMPLE = 1500
DICT_BYTES = 65_536
#: Texts are compressed in pieces of so many bytes, all of them, so that a dictionary counts along the whole text.
PIECE = 256
LEVEL = 3
#: A document is kept where its score reaches this.
KEEP = 0.3


def pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False, write_dict_id=False)


def dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary; of too little text to train one, the text itself."""
    samples = [p for t in texts for p in pieces(t) if p]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" "


def difference(data: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """The normalised difference of the compressed sizes, summed over the pieces: (bad - good) / length, higher for text like the good one.

    Only the dictionaries differ, so what any compressor would save, like plain repetition, cancels out. Taken as a
    share of the text and not of its compressed size, it stays small for text that packs to nothing either way.
    """
    gap = sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces(data))
    return gap / (len(data) + 16)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Slopes and, last, the intercept of a logistic curve by Newton's method with a small ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-12
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    beta = np.zeros(a.shape[1])
    ridge = 1e-2 * np.diag(np.r_[np.ones(x.shape[1]), 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    slopes = beta[:-1] / scale
    return [*slopes.tolist(), float(beta[-1] - slopes @ mean)]


def fit(good: list[str], bad: list[str], share_good: float) -> dict | float:
    """The model, or where a class has too few rows for one, the share of good rows as the score of all."""
    if len(good) < 4 or len(bad) < 4:
        return float(share_good)
    enc = lambda texts: [t.encode("utf-8", "surrogatepass") for t in texts]
    good, bad = enc(good), enc(bad)
    pairs = [(dictionary(good[k::2]), dictionary(bad[k::2])) for k in (0, 1)]
    x, y = [], []
    for k, pair in enumerate(pairs):  # a text is scored by the dictionaries of the half that it isn't in
        g, b = map(_compressor, pair)
        for label, texts in ((1.0, good[1 - k :: 2]), (0.0, bad[1 - k :: 2])):
            x += [[difference(t, g, b)] for t in texts]
            y += [label] * len(texts)
    x, y = np.array(x), np.array(y)
    weight = np.where(y == 1, share_good / y.sum(), (1 - share_good) / (len(y) - y.sum())) * len(y)
    return {"pairs": pairs, "curve": calibrate(x, y, weight)}


def scorer(model: dict | float) -> Callable[[list[str | None]], list[float]]:
    """Texts to scores: the mean difference by the dictionaries of both halves, alone, through the calibrated curve. Compressors are built once."""
    if not isinstance(model, dict):
        return lambda texts: [model] * len(texts)
    pairs = [tuple(map(_compressor, pair)) for pair in model["pairs"]]
    slope, base = model["curve"]

    def run(texts: list[str | None]) -> list[float]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        z = [slope * sum(difference(t, g, b) for g, b in pairs) / len(pairs) + base for t in raw]
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z]

    return run


def scores(texts: list[str | None], model: dict | float) -> list[float]:
    return scorer(model)(texts)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Learns from at most ``sample`` labelled rows of each class, of ids whose crc32 mod 5 is not 0;
    nothing but the text is scored. The curve is weighted to the classes' shares among all labelled
    rows. A null text counts as empty; rows labelled both ways teach nothing; without labels of both
    classes every score is the share of label 1, or 0.5. Other columns are not looked at.
    """
    good, bad, share = training_sample(docs, labels, id_col, text_col, label_col, sample)
    model = fit(good, bad, share)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = scorer(model)
        for b in batches_of(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(told(b.column(2).to_pylist()), pa.float64())], ["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(score, f"id {dict(docs.dtypes)[id_col]}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= keep).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """The input rows whose quality score reaches ``keep``, with all their columns, judged as by quality_scores().

    A null text is scored as an empty one; repeated rows stay or go together; an empty table stays empty, and
    without labels of both classes all rows stay or go by the share of label 1, or stay if there is none.
    """
    good, bad, share = training_sample(docs, labels, id_col, text_col, label_col, sample)
    model, at = fit(good, bad, share), docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = scorer(model)
        for b in batches_of(batches, at):
            yield b.filter(pa.array([s >= keep for s in told(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
