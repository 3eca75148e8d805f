"""Toxicity: bags of character n-gram embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, training_sample
from .hashing import batches_of, words
from .quality import calibrate

#: At most so many labelled rows of each class are learned from (four fifths for the model, a fifth for the calibration).
SAMPLE = 1500
NGRAMS = (3, 4, 5)
BUCKET_BITS, DIM = 16, 8
#: Words in a segment: a bag is averaged over so many, so a few words are not lost in a long text.
SEGMENT = 12
EPOCHS, RATE, BATCH = 3, 0.15, 512
#: Bytes of text turned into n-grams at a time; longer texts go in several pieces, all of them.
PIECE = 1 << 19

_FOLD = np.full(256, 32, np.uint8)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256), *b"!@$*"]:
    _FOLD[_c] = _c
for _c in range(65, 91):
    _FOLD[_c] = _c + 32
_GAP = np.arange(256) == 32


def _pieces(data: bytes) -> list[bytes]:
    """Pieces of at most PIECE bytes, cut where no n-gram lies; only one word of more bytes is cut within."""
    out = []
    while len(data) > PIECE:
        gap = np.flatnonzero(_FOLD[np.frombuffer(data, np.uint8, PIECE)] == 32)
        cut = int(gap[-1]) + 1 if len(gap) else PIECE
        out.append(data[:cut])
        data = data[cut:]
    return [*out, data]


class Bags:
    """The n-grams of some texts: ``grams`` is a list of (bucket, valid) by byte, and ``starts`` where segments begin."""

    def __init__(self, texts: list[bytes]):
        joined = _FOLD[np.frombuffer(b" " + b"  ".join(texts) + b"      ", np.uint8)]
        ends = np.cumsum([len(t) + 2 for t in texts]) if texts else np.zeros(0, np.int64)
        letter = joined != 32
        first, end, word = words(joined, _GAP)
        text = np.searchsorted(ends, first, side="right")
        again = np.concatenate([[False], (word[1:] == word[:-1]) & (text[1:] == text[:-1])])[: len(word)]
        once = np.zeros(len(joined) + 1, np.int8)  # a word said over and over counts once
        once[first[again]] += 1
        once[end[again]] -= 1
        once = np.cumsum(once[:-1], dtype=np.int8) == 0
        first, text = first[~again], text[~again]
        count = np.bincount(text, minlength=len(texts)) if len(first) else np.zeros(len(texts), np.int64)
        begin = np.cumsum(count) - count
        nth = np.arange(len(first)) - begin[text] if len(first) else first
        head = nth % SEGMENT == 0
        self.starts, self.text = first[head], text[head]
        self.grams = []
        h = joined.astype(np.uint32)
        wide, inner = h, None
        for n in range(2, max(NGRAMS) + 1):
            h = h[:-1] * np.uint32(16777619) + wide[n - 1 :]
            if n >= 3:
                # valid: no space between the first and the last character
                inner = letter[1:-1] if inner is None else inner[:-1] & letter[n - 2 : -1]
            if n in NGRAMS:
                bucket = ((h ^ np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
                self.grams.append((bucket, inner & once[1 : len(inner) + 1]))
        self.size = len(joined)

    def means(self, value: np.ndarray) -> np.ndarray:
        """The mean of value[bucket] over each segment's n-grams."""
        if not len(self.starts):
            return np.zeros(0)
        total, count = np.zeros(self.size, np.float32), np.zeros(self.size, np.float32)
        for bucket, ok in self.grams:  # an n-gram lies at its second character, which is never a space
            total[1 : len(bucket) + 1] += np.where(ok, value[bucket], np.float32(0))
            count[1 : len(bucket) + 1] += ok
        return np.add.reduceat(total, self.starts) / np.maximum(np.add.reduceat(count, self.starts), 1)

    def listed(self) -> tuple[np.ndarray, np.ndarray]:
        """All buckets by segment, and where each segment's begin."""
        at, what = [], []
        for bucket, ok in self.grams:
            where = np.flatnonzero(ok)
            at.append(where + 1)
            what.append(bucket[where])
        at, what = np.concatenate(at), np.concatenate(what)
        seg = np.searchsorted(self.starts, at, side="right") - 1
        order = np.argsort(seg, kind="stable")
        return what[order].astype(np.int32), np.searchsorted(seg[order], np.arange(len(self.starts) + 1))


def _train(ids: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray, use: np.ndarray, model: dict, epochs: int, seed: int) -> None:
    """Adagrad on the embeddings and the softmax together over the segments ``use``; a bag is the mean of its n-grams."""
    rng = np.random.default_rng(seed)
    emb, out, bias = model["emb"], model["out"], model["bias"]
    g_emb, g_out, g_bias = model["g_emb"], model["g_out"], model["g_bias"]
    for epoch in range(epochs):
        order = use[rng.permutation(len(use))]
        rate = RATE * (1 - epoch / (epochs + 1))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            size = bounds[rows + 1] - bounds[rows]
            rows, size = rows[size > 0], size[size > 0]
            if not len(rows):
                continue
            heads = np.cumsum(size) - size
            take = ids[np.repeat(bounds[rows] - heads, size) + np.arange(size.sum())]
            bag = np.add.reduceat(emb[take], heads, axis=0) / size[:, None]
            z = bag @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[rows][:, None] / len(rows)
            d_bag = p @ out.T / size[:, None]
            d_out, d_bias = bag.T @ p, p.sum(0)
            which, inverse = np.unique(take, return_inverse=True)
            seg = np.repeat(np.arange(len(rows)), size)
            d_emb = np.stack([np.bincount(inverse, d_bag[seg, k], len(which)) for k in range(DIM)], 1)
            d_emb *= 64  # a bag's mean spreads its gradient thin
            g_emb[which] += d_emb**2
            emb[which] -= rate * d_emb / np.sqrt(g_emb[which] + 1e-8)
            g_out += d_out**2
            out -= rate * d_out / np.sqrt(g_out + 1e-8)
            g_bias += d_bias**2
            bias -= rate * d_bias / np.sqrt(g_bias + 1e-8)


def _features(parts: list[tuple[int, bytes]], n: int, value: np.ndarray, bias: float) -> np.ndarray:
    """By text: the largest segment logit and the log of the number of segments; a text without words has (bias, 0)."""
    top, count = np.full(n, -np.inf), np.zeros(n)
    for some in _batches(parts):
        bags = Bags([d for _, d in some])
        owner = np.array([i for i, _ in some])[bags.text]
        np.maximum.at(top, owner, bags.means(value) + bias)
        np.add.at(count, owner, 1)
    return np.stack([np.where(np.isfinite(top), top, bias), np.log1p(count)], 1)


def _batches(parts: list[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    """Runs of parts of about PIECE bytes together."""
    at = 0
    while at < len(parts):
        end, held = at, 0
        while end < len(parts) and (end == at or held + len(parts[end][1]) <= PIECE):
            held += len(parts[end][1])
            end += 1
        yield parts[at:end]
        at = end


def _listed(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All segments of the parts: their buckets, where each one's begin, and the text each is of."""
    ids, sizes, text = [], [], []
    for some in _batches(parts):
        bags = Bags([d for _, d in some])
        what, bounds = bags.listed()
        ids.append(what)
        sizes.append(np.diff(bounds))
        text.append(np.array([i for i, _ in some])[bags.text])
    return np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(sizes))], np.concatenate(text)


def _parts(texts: list[bytes]) -> list[tuple[int, bytes]]:
    return [(i, p) for i, t in enumerate(texts) for p in _pieces(t)]


def fit(toxic: list[str], clean: list[str], share: float, seed: int = 7) -> dict | float:
    """The model, or where a class has too few rows for one, the share of label 1 as the score of all.

    First every segment takes its text's label; then, twice, a toxic text is stood for by its two most
    toxic segments and a clean one by all of its own. The largest segment logit is calibrated on texts kept apart.
    """
    if len(toxic) < 5 or len(clean) < 5:
        return float(share)
    enc = lambda texts: [t.encode("utf-8", "surrogatepass") for t in texts]
    toxic, clean = enc(toxic), enc(clean)
    apart = lambda xs: ([x for i, x in enumerate(xs) if i % 5], xs[::5])
    (t_fit, t_cal), (c_fit, c_cal) = apart(toxic), apart(clean)
    label = np.r_[np.ones(len(t_fit), np.int64), np.zeros(len(c_fit), np.int64)]
    ids, bounds, text = _listed(_parts([*t_fit, *c_fit]))
    y = label[text]
    rng = np.random.default_rng(seed)
    n = 1 << BUCKET_BITS
    model = {"emb": rng.uniform(-1 / DIM, 1 / DIM, (n, DIM)), "out": rng.uniform(-1, 1, (DIM, 2)), "bias": np.zeros(2)}
    model |= {"g_emb": np.full((n, DIM), 1e-6), "g_out": np.full((DIM, 2), 1e-6), "g_bias": np.full(2, 1e-6)}
    value = lambda: (model["emb"] @ (model["out"][:, 1] - model["out"][:, 0])).astype(np.float32)
    even = lambda y: np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    _train(ids, bounds, y, even(y), np.arange(len(y)), model, EPOCHS, seed)
    for again in (1, 2):
        size = np.maximum(np.diff(bounds), 1)
        logit = np.add.reduceat(value()[ids], bounds[:-1]) / size if len(ids) else np.zeros(len(y))
        order = np.lexsort((-logit, text))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        use = np.flatnonzero((y == 0) | (rank < 2))
        weight = np.zeros(len(y))
        weight[use] = even(y[use])
        _train(ids, bounds, y, weight, use, model, EPOCHS, seed + again)
    out = {"value": value(), "bias": float(model["bias"][1] - model["bias"][0])}
    rest = [*t_cal, *c_cal]
    target = np.r_[np.ones(len(t_cal)), np.zeros(len(c_cal))]
    x = _features(_parts(rest), len(rest), out["value"], out["bias"])
    weight = np.where(target == 1, share / target.sum(), (1 - share) / (len(target) - target.sum())) * len(target)
    out["curve"] = calibrate(x, target, weight)
    return out


def scores(texts: pa.Array, model: dict | float) -> np.ndarray:
    if not isinstance(model, dict):
        return np.full(len(texts), model)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    z = np.c_[_features(_parts(raw), len(raw), model["value"], model["bias"]), np.ones(len(raw))] @ np.array(model["curve"])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.5).

    Learns from at most ``sample`` labelled rows of each class, of ids whose crc32 mod 5 is not 0;
    nothing but the text is scored, all of it. A null text counts as empty; rows labelled both ways
    teach nothing; without labels of both classes every score is the share of label 1, or 0.5.
    Other columns are not looked at, so their names may clash.
    """
    toxic, clean, share = training_sample(docs, labels, id_col, text_col, label_col, sample)
    model = fit(toxic, clean, share)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores(b.column(2), model), pa.float64())], ["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(score, f"id {dict(docs.dtypes)[id_col]}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
