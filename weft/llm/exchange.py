"""Questions that chunks of documents put to parts of a hash space, as compact blobs.

Documents are dealt into chunks of a few MB of text. A chunk puts all hashes that it has of one part of
the hash space, sorted and distinct, into one blob; the part's task sees the blobs of all chunks and
answers each with a bitmap in the order asked. So a billion hashes cross as few rows of a few bytes a
hash, and a hash that a third of all documents have crosses once for each chunk.

A chunk asks at most 2 ** FAN parts, so that its blobs don't shrink to single hashes as the corpus
grows. Where that many parts would be too large, they are asked in two steps: the blobs of a batch of
chunks for one part are merged by a task, which asks the part's own parts with what is left, and hands
their answers down to its chunks. Rows grow with the corpus then, not with its square.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text in a chunk, about; more where that would make more than 2 ** MOST_BITS chunks (at 5 MB from 22 TB on).
CHUNK_BYTES, MOST_BITS = 5 << 20, 22
#: Bits of the hash space's parts that a chunk asks, and chunks whose blobs are merged where these aren't enough.
FAN, BATCH = 12, 4096


class Deal(NamedTuple):
    """How the hash space is cut: ``bits`` for all parts, of which chunks see the first ``fan``; ``batch`` chunks are merged between."""

    bits: int
    fan: int = FAN
    batch: int = BATCH

    @property
    def first(self) -> int:
        return min(self.bits, self.fan)


def dumps(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob, byte planes apart, so that what is alike packs well."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(a.dtype.str.ljust(4).encode() + len(a).to_bytes(8, "little") + a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def loads(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        kind, n = np.dtype(data[at : at + 4].decode().strip()), int.from_bytes(data[at + 4 : at + 12], "little")
        size = n * kind.itemsize
        planes = np.frombuffer(data, np.uint8, size, at + 12).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 12 + size
    return out


def deltas(values: np.ndarray) -> np.ndarray:
    """Sorted values as differences."""
    return np.diff(values, prepend=values.dtype.type(0))


def sums(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values, dtype=values.dtype)


def dealt(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN, batch: int = BATCH) -> tuple[DataFrame, Deal]:
    """(chunk, id, text) rows and how the hash space is cut.

    The number of chunks follows the text's bytes. Rows are dealt by id and text, so rows of one id, or
    without one, are spread too; only rows that repeat each other whole share a chunk.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    chunks = max(1, -(-total // max(chunk_bytes, total >> MOST_BITS)))
    return rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).alias("chunk"), "id", "text"), Deal(max(0, int(chunks - 1).bit_length()), fan, batch)


ASKS = "part long, chunk long, kind int, blob binary"


def asks(chunk: int, kind: int, parts: dict[int, bytes]) -> pa.Table:
    n = len(parts)
    return pa.table({"part": pa.array(list(parts), pa.int64()), "chunk": pa.array([chunk] * n, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "blob": pa.array(list(parts.values()), pa.binary())})


def by_part(hashes: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """The runs of sorted 64-bit hashes that share their first bits."""
    if not len(hashes):
        return []
    part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    edge = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    return [(int(part[a]), slice(int(a), int(b))) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def asked(table: pa.Table, kind: int) -> dict[int, bytes]:
    """part -> blob of an answers table's rows of a kind."""
    return {p: b for p, k, b in zip(table["part"].to_pylist(), table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True) if k == kind}


def bits_of(answers: dict[int, bytes], keys: np.ndarray, bits: int, flags: int = 1) -> list[np.ndarray]:
    """The bits that sorted keys got, by flag; without an answer they are unset."""
    out = [np.zeros(len(keys), bool) for _ in range(flags)]
    for p, s in by_part(keys, bits):
        if p in answers:
            for o, packed in zip(out, loads(answers[p]), strict=True):
                o[s] = np.unpackbits(packed, count=s.stop - s.start)
    return out


class Round:
    """A kind of question: columns by key, how those of several askers are merged, and what is answered.

    Columns are lists of arrays, the first one sorted 64-bit keys whose first bits are the part.
    """

    kind: int
    #: Bits that each key gets.
    flags = 1

    def dump(self, cols: list[np.ndarray], used: int) -> bytes:
        """A part's columns as a blob; ``used``: the leading bits of the keys that are the part's number."""
        return dumps(deltas(cols[0]), *cols[1:])

    def load(self, blob: bytes, part: int, used: int) -> list[np.ndarray]:
        first, *rest = loads(blob)
        return [sums(first), *rest]

    def merge(self, cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """One entry for each question, the entry that each of cols became, and whether it is the first of those."""
        raise NotImplementedError

    def top(self, merged: list[np.ndarray]) -> list[np.ndarray]:
        """What is answered when all askers' entries are merged."""
        raise NotImplementedError

    def spread(self, up: list[np.ndarray], inverse: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """The answers to the entries that were merged, by the answers to the merged ones."""
        raise NotImplementedError

    def ask(self, chunk: int, cols: list[np.ndarray], deal: Deal) -> pa.Table:
        return asks(chunk, self.kind, {p: self.dump([c[s] for c in cols], deal.first) for p, s in by_part(cols[0], deal.first)})

    # -- the tasks of the parts -------------------------------------------------------------------
    def _gathered(self, table: pa.Table, used: int) -> tuple[pa.Table, list[np.ndarray], list[int]]:
        """The blobs in the order of their askers, all their columns, and how many entries each has."""
        table = table.take(pa.array(np.argsort(table["chunk"].to_numpy(), kind="stable")))
        blobs = [self.load(b, p, used) for p, b in zip(table["part"].to_pylist(), table["blob"].to_pylist(), strict=True)]
        return table, [np.concatenate(c) for c in zip(*blobs, strict=True)], [len(b[0]) for b in blobs]

    def _told(self, table: pa.Table, flags: list[np.ndarray], size: list[int]) -> pa.Table:
        """A row for each asker that got a set bit."""
        bound = np.cumsum([0, *size]).tolist()
        any_set = np.logical_or.reduce(flags)
        some = [i for i, (p, q) in enumerate(zip(bound[:-1], bound[1:], strict=True)) if any_set[p:q].any()]
        pick, n = table.take(pa.array(some, pa.int64())), len(some)
        blobs = [dumps(*[np.packbits(f[bound[i] : bound[i + 1]]) for f in flags]) for i in some]
        return pa.table({"part": pick["part"], "chunk": pick["chunk"], "kind": pa.array([self.kind] * n, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def answered(self, asking: DataFrame, deal: Deal) -> DataFrame:
        """The answers to the rows of ask(), of the same shape."""
        if deal.bits <= deal.first:
            return asking.groupBy("part").applyInArrow(self._answer(deal.bits), ASKS)
        by_batch = asking.withColumn("batch", F.expr(f"chunk div {deal.batch}")).groupBy("part", "batch")
        above = by_batch.applyInArrow(self._ask_up(deal), ASKS).groupBy("part").applyInArrow(self._answer(deal.bits), ASKS)
        above = above.withColumn("one", F.shiftright("part", deal.bits - deal.first)).groupBy("one", "chunk")
        return by_batch.cogroup(above).applyInArrow(self._hand_down(deal), ASKS)

    def _answer(self, used: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            table, cols, size = self._gathered(table, used)
            merged, inverse, first = self.merge(cols)
            return self._told(table, self.spread(self.top(merged), inverse, first), size)

        return run

    def _ask_up(self, deal: Deal) -> Callable[[tuple, pa.Table], pa.Table]:
        def run(key: tuple, table: pa.Table) -> pa.Table:
            merged, _, _ = self.merge(self._gathered(table, deal.first)[1])
            return asks(key[1].as_py(), self.kind, {p: self.dump([c[s] for c in merged], deal.bits) for p, s in by_part(merged[0], deal.bits)})

        return run

    def _hand_down(self, deal: Deal) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(table: pa.Table, above: pa.Table) -> pa.Table:
            if not table.num_rows:
                return asks(0, self.kind, {})
            table, cols, size = self._gathered(table, deal.first)
            merged, inverse, first = self.merge(cols)
            up = bits_of(asked(above, self.kind) if above.num_rows else {}, merged[0], deal.bits, self.flags)
            return self._told(table, self.spread(up, inverse, first), size)

        return run


def heads(*cols: np.ndarray) -> np.ndarray:
    """Whether each place of some sorted columns differs from the one before."""
    out = np.ones(len(cols[0]), bool)
    if len(out):
        out[1:] = False
        for c in cols:
            out[1:] |= c[1:] != c[:-1]
    return out


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a window of ``width`` at one of the starts."""
    edge = np.bincount(starts, minlength=size + 1) - np.bincount(np.minimum(starts + width, size), minlength=size + 1)
    return np.cumsum(edge[:size]) > 0
