"""Benchmark decontamination: a BM25 index of test items searched by every passage with block-max WAND, then verified."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .exchange import covered
from .hashing import batches_of, rolling, row_words, texts_of

K1, B = 1.2, 0.75
#: A passage is looked at for an item where its BM25 score reaches this share of the item's own score.
THRESHOLD = 0.6
#: Word n-grams that question and answer are compared by, and the share of each one's words that common n-grams must cover.
NGRAM, HALF = 5, 0.5
#: Items in a block, and at most so many bytes of items in one index; more items make more passes, each with its own index.
BLOCK, INDEX_BYTES = 16, 4 << 20
#: Terms of more items than this, or this share of all, are common: what they can give a block is added unseen.
COMMON_ITEMS, COMMON = 32, 0.1

#: Characters of words: letters and digits in lower case, and all that isn't ASCII.
_SEP = np.ones(256, bool)
_SEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last line or else the last sentence is the answer; a single sentence is both."""
    body = text.strip()
    cut = body.rfind("\n")
    if cut < 0:
        cut = max(body[:-1].rfind(x) + 1 for x in (". ", "? ", "! "))
    return (body[:cut], body[cut:]) if cut > 0 and body[:cut].strip() and body[cut:].strip() else (body, body)


def _hashes(texts: list[str]) -> list[np.ndarray]:
    data, at = texts_of(pa.array([t.lower() for t in texts], pa.string()))
    _, _, h, first = row_words(data, at, _SEP)
    return [h[first[i] : first[i + 1]] for i in range(len(texts))]


def overlap(want: np.ndarray, n: int, size: int, grams: np.ndarray) -> float:
    """The share of ``size`` words that those of their n-grams ``want`` cover that occur; of no words all do."""
    return float(covered(np.flatnonzero(np.isin(want, grams)), n, size).mean()) if size else 1.0


class Totals(NamedTuple):
    """What BM25 and the passages need to know of all items, whichever index they are in."""

    terms: np.ndarray
    df: np.ndarray
    n: int
    mean: float
    longest: int


def totals(shards: Iterable[list[tuple[object, str]]]) -> Totals:
    """Of all items of some shards, one shard at a time: 16 bytes for each distinct term are held."""
    terms, df, lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    for items in shards:
        whole = [h for h in _hashes([t for _, t in items if t and t.strip()]) if len(h)]
        lengths += map(len, whole)
        own, count = np.unique(np.concatenate([np.unique(h) for h in whole]) if whole else terms[:0], return_counts=True)
        terms, at = np.unique(np.concatenate([terms, own]), return_inverse=True)
        df = np.bincount(at, np.concatenate([df, count]), len(terms)).astype(np.int64)
    return Totals(terms, df, len(lengths), sum(lengths) / len(lengths) if lengths else 1.0, max([32, *lengths]))


class Index:
    """The items' postings: impacts as shares of each item's own BM25 score, with maxima by term and by block of items.

    ``known``: the totals of all items, if these are but a shard of them.
    """

    def __init__(self, items: list[tuple[object, str]], threshold: float = THRESHOLD, known: Totals | None = None):
        known = known or totals([items])
        items = sorted(((k, t) for k, t in items if t and t.strip()), key=lambda x: len(x[1]))
        whole = _hashes([t for _, t in items])
        some = [i for i, h in enumerate(whole) if len(h)]
        self.ids = [items[i][0] for i in some]
        whole = [whole[i] for i in some]
        halves = [split_item(items[i][1]) for i in some]
        question, answer = _hashes([q for q, _ in halves]), _hashes([a for _, a in halves])
        self.parts = [[(n := max(1, min(NGRAM, len(h))), rolling(h, n), len(h)) for h in x] for x in zip(question, answer, whole, strict=True)]
        self.hop = known.longest
        self.threshold = threshold
        n = len(whole)
        owner = np.repeat(np.arange(n), [len(h) for h in whole])
        every = np.concatenate(whole) if whole else np.zeros(0, np.uint64)
        self.terms, term = np.unique(every, return_inverse=True)
        key, tf = np.unique(term.astype(np.int64) * max(n, 1) + owner, return_counts=True)
        term, item = key // max(n, 1), key % max(n, 1)
        df = np.bincount(term, minlength=len(self.terms))
        length = np.array([len(h) for h in whole], float)
        df_all = known.df[np.searchsorted(known.terms, self.terms)]
        idf = np.log(1 + (known.n - df_all + 0.5) / (df_all + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / known.mean))
        impact /= np.bincount(item, impact, n)[item] if n else 1
        self.item, self.impact = item, impact
        self.blocks = -(-n // BLOCK)
        cell = term * max(self.blocks, 1) + item // BLOCK
        self.cell, first = np.unique(cell, return_index=True)  # (term, block), as postings are sorted by term and item
        self.cell_at = np.append(first, len(cell))
        self.cell_top = np.maximum.reduceat(impact, first) if len(first) else impact
        self.cell_of = np.searchsorted(self.cell, np.arange(len(self.terms) + 1) * max(self.blocks, 1))
        rare = df <= max(1, min(COMMON * n, COMMON_ITEMS))
        given = np.bincount(item, np.where(rare[term], 0.0, impact), n) if n else np.zeros(0)
        self.given = np.maximum.reduceat(given, np.arange(0, n, BLOCK)) if n else given  # by common terms, to any item of the block
        self.rare_end = np.where(rare, self.cell_of[1:], self.cell_of[:-1])

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The term of each word, or -1."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def search(self, term: np.ndarray, chunk: np.ndarray, begin: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all at or above the threshold.

        A passage is the words begin to end of ``term``, which are those of its chunks left and right
        (the same, if it has only one). Block-max WAND, for all passages at once:
        1. the block maxima of the rare terms, added up by chunk, and what common terms can give at most,
           have to reach the threshold, or the block is passed over unread;
        2. the block maxima of the passage's distinct terms have to, else there is no pivot;
        3. only then the block's postings are read and the items scored.
        """
        known = np.flatnonzero(term >= 0)
        cells, of = self._expand(self.cell_of[term[known]], self.rare_end[term[known]])
        where = chunk[known[of]] * self.blocks + self.cell[cells] % self.blocks
        n_chunks = int(right.max()) + 1
        total = np.bincount(where, self.cell_top[cells], n_chunks * self.blocks).reshape(n_chunks, self.blocks)
        bound = total[left] + np.where((left != right)[:, None], total[right], 0) + self.given
        passage, block = np.nonzero(bound >= self.threshold - 1e-9)
        found = [self._scored(term, begin, end, passage[i : i + 4096], block[i : i + 4096]) for i in range(0, len(passage), 4096)]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind) for k, kind in enumerate((np.int64, np.int64, float)))

    def _scored(self, term: np.ndarray, begin: np.ndarray, end: np.ndarray, passage: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, pair = self._expand(begin[passage], end[passage])
        t = term[word]
        key = np.sort((pair * len(self.terms) + t)[t >= 0])
        key = key[np.diff(key, prepend=-1) > 0]  # distinct terms by (passage, block)
        pair, t = key // len(self.terms), key % len(self.terms)
        want = t * self.blocks + block[pair]
        at = np.minimum(np.searchsorted(self.cell, want), len(self.cell) - 1)
        hit = self.cell[at] == want
        pair, at = pair[hit], at[hit]
        pivot = np.bincount(pair, self.cell_top[at], len(passage)) >= self.threshold - 1e-9
        pair, at = pair[pivot[pair]], at[pivot[pair]]
        posting, of = self._expand(self.cell_at[at], self.cell_at[at + 1])
        n = max(1, len(self.ids))
        key, inverse = np.unique(passage[pair[of]] * n + self.item[posting], return_inverse=True)
        score = np.bincount(inverse, self.impact[posting], len(key))
        keep = score >= self.threshold - 1e-9
        return key[keep] // n, key[keep] % n, score[keep]

    @staticmethod
    def _expand(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of the ranges a to b, and the range each is of."""
        size = b - a
        heads = np.cumsum(size) - size
        return np.repeat(a - heads, size) + np.arange(size.sum()), np.repeat(np.arange(len(a)), size)


def leaks(texts: pa.Array, index: Index) -> list[tuple[int, int, float, float, float, float, int]]:
    """(row, item, score, question, answer and whole overlap, first word) of each row and item that verify, best passage first."""
    if not len(index.terms):
        return []
    lower = pa.array([t.lower() if t else t for t in texts.to_pylist()], pa.string())
    data, at = texts_of(lower)
    _, _, h, first = row_words(data, at, _SEP)
    if not len(h):
        return []
    count = np.diff(first)
    chunks = -(-count // index.hop)
    chunk_of = np.cumsum(chunks) - chunks
    n = np.where(count > 0, np.maximum(1, chunks - 1), 0)  # passages of two chunks, one chunk apart
    row = np.repeat(np.arange(len(count)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = first[row] + nth * index.hop
    end = np.minimum(begin + 2 * index.hop, first[row + 1])
    left = chunk_of[row] + nth
    word_row = np.repeat(np.arange(len(count)), count)
    chunk = chunk_of[word_row] + (np.arange(len(h)) - first[word_row]) // index.hop
    p, item, score = index.search(index.lookup(h), chunk, begin, end, left, np.where(chunks[row] > 1, left + 1, left))
    best: dict[tuple[int, int], tuple] = {}
    for i, k, s in zip(p.tolist(), item.tolist(), score.tolist(), strict=True):
        words = h[begin[i] : end[i]]
        rolled = {n: rolling(words, n) for n in {n for n, _, _ in index.parts[k]}}
        q, a, w = (overlap(want, n, size, rolled[n]) for n, want, size in index.parts[k])
        if q >= HALF and a >= HALF:
            key = (int(row[i]), k)
            if key not in best or (w, s) > (best[key][3], best[key][0]):
                best[key] = (s, q, a, w, int(begin[i] - first[row[i]]))
    return [(r, index.ids[k], *v) for (r, k), v in sorted(best.items())]


def benchmark_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per input row and test item found in it: id, item_id, score, question, answer, whole (overlaps), first_word.

    Every text is cut into passages of twice the longest item, one item's length apart, so that each
    copy lies in one. Each passage is a BM25 query to an index of the items; all that reach the threshold
    are verified: common word 5-grams have to cover half the words of the question and half those of the
    answer, each by itself. A question or answer of fewer than five words has to occur as a whole; one
    without a word is no condition, and an item of one sentence is question and answer alike. Rows
    without a leak give no row; a null or empty text or item matches nothing, and an empty table gives no
    rows. Items may have ids of any type, null ones too. Repeated rows give repeated results; other
    columns are not looked at.

    An index holds at most index_bytes of items; larger sets are dealt over several, each of which all
    documents pass by in turn. Document frequencies, the number of items, their mean length and the
    passages' length are those of all items, so what is found doesn't depend on the number of indexes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type, out = dict(docs.dtypes)[id_col], None
    for index in _indexes(items, item_col, item_text, threshold, index_bytes):
        found = _pass(rows, index, id_type, items.schema[item_col].dataType)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def _indexes(items: DataFrame, item_col: str, item_text: str, threshold: float, index_bytes: int) -> Iterator[Index]:
    """Indexes of at most about index_bytes of items each, at least one; several share the totals of all items, which are read twice then."""
    items = items.select(F.col(item_col).alias("k"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    held = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    shards = max(1, -(-held // index_bytes))

    def shard(i: int) -> list[tuple[object, str]]:
        return [(r["k"], r["t"]) for r in items.where(F.pmod(F.xxhash64("k"), F.lit(shards)) == i).collect()]

    known = totals(map(shard, range(shards))) if shards > 1 else None
    for i in range(shards):
        yield Index(shard(i), threshold, known)


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The input rows in which no test item is found, with all their columns, judged as by benchmark_leaks().

    Rows with a null or empty text stay; repeated rows stay or go together. Without items all rows stay, and an
    empty table stays empty.
    """
    at = docs.columns.index(text_col)
    for index in _indexes(items, item_col, item_text, threshold, index_bytes):

        def clean(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches_of(batches, at):
                keep = np.ones(b.num_rows, bool)
                keep[[g[0] for g in leaks(b.column(at), index)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def _pass(rows: DataFrame, index: Index, id_type: str, item_type: DataType) -> DataFrame:
    names = ["item_id", "score", "question", "answer", "whole", "first_word"]
    kinds = [to_arrow_type(item_type), *[pa.float64()] * 4, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 1):
            got = leaks(b.column(1), index)
            if got:
                cols = [b.column(0).take(pa.array([g[0] for g in got], pa.int64())), *[pa.array([g[i + 1] for g in got], kind) for i, kind in enumerate(kinds)]]
                yield pa.RecordBatch.from_arrays(cols, ["id", *names])

    return rows.mapInArrow(run, f"id {id_type}, item_id {item_type.simpleString()}, score double, question double, answer double, whole double, first_word long")
