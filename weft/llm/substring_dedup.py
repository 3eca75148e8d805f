"""Substring dedup of word windows by fixed-block anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import ASKS, BATCH, CHUNK_BYTES, FAN, Deal, Round, asked, asks, bits_of, covered, dealt, deltas, dumps, heads, loads, sums
from .hashing import digests, release, rolling, row_words, texts_of

#: Words in a window that counts as a repeat. Anchors are half as long, so each window holds a whole reference block.
WINDOW = 20
#: Bits of an anchor's hash beyond the parts' that are told; false hits only cost a look at their windows.
ANCHOR_BITS = 32


class Anchors(Round):
    """Rolling anchors: hash, whether it is a reference block of the asker, whether it starts at several places."""

    kind = 1

    def __init__(self, bits: int):
        self.drop = 64 - bits - ANCHOR_BITS

    def dump(self, cols: list[np.ndarray], used: int) -> bytes:
        low = (cols[0] << np.uint64(used)) >> np.uint64(used + self.drop) if used + self.drop < 64 else cols[0] * np.uint64(0)
        return dumps(deltas(low.astype(np.uint32) if 64 - used - self.drop <= 32 else low), np.packbits(cols[1]), np.packbits(cols[2]))

    def load(self, blob: bytes, part: int, used: int) -> list[np.ndarray]:
        low, *flags = loads(blob)
        low = sums(low).astype(np.uint64) << np.uint64(self.drop)
        return [low | np.uint64(part << (64 - used) if used else 0), *[np.unpackbits(f, count=len(low)).astype(bool) for f in flags]]

    def merge(self, cols):
        order = np.argsort(cols[0], kind="stable")
        head = np.flatnonzero(heads(cols[0][order]))
        count = np.diff(np.append(head, len(order)))
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.repeat(np.arange(len(head)), count)
        block, more = (np.logical_or.reduceat(c[order], head) for c in cols[1:])
        return [cols[0][order[head]], block, more | (count > 1)], inverse, np.zeros(0, bool)

    def top(self, merged):
        """An anchor matters where it is a reference block of one document and starts at two places or more."""
        return [merged[1] & merged[2]]

    def spread(self, up, inverse, first):
        return [up[0][inverse]]


class Windows(Round):
    """Candidate windows: 128-bit digest of the words, and the smallest id that the asker has."""

    kind = 2

    def merge(self, cols):
        order = np.lexsort((cols[2], cols[1], cols[0]))
        new = heads(cols[0][order], cols[1][order])
        inverse, first = np.empty(len(order), np.int64), np.empty(len(order), bool)
        inverse[order], first[order] = np.cumsum(new) - 1, new
        return [c[order][new] for c in cols], inverse, first

    def top(self, merged):
        return [np.zeros(len(merged[0]), bool)]

    def spread(self, up, inverse, first):
        """A window goes where the same words start in another asker with a smaller id."""
        return [~first | up[0][inverse]]


class Chunk:
    """A chunk's words and what it asks of the hash space: rolling anchors, then the windows around those that were found elsewhere."""

    def __init__(self, table: pa.Table, window: int, bits: int):
        order = table["id"].combine_chunks()
        ids = order.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows = table.take(pa.array(np.lexsort((order.is_null().to_numpy(zero_copy_only=False), ids))))
        self.ids = np.sort(ids)
        self.data, self.at = texts_of(self.rows["text"])
        self.start, self.end, self.h, self.first = row_words(self.data, self.at)
        self.window, self.anchor, self.cut = window, max(1, window // 2), np.uint64(64 - bits - ANCHOR_BITS)
        n = len(self.h)
        self.row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        left = self.first[self.row + 1] - np.arange(n) if n else np.zeros(0, np.int64)  # words from here to the row's end
        self.long = (self.first[self.row + 1] - self.first[self.row] >= window) if n else np.zeros(0, bool)
        self.whole = left >= window
        self.probe = np.flatnonzero(self.long & (left >= self.anchor))
        self.block = (self.probe - self.first[self.row[self.probe]]) % self.anchor == 0

    def anchors(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The columns of Anchors, with as many bits as are told, and each probe's place in them."""
        hashes = rolling(self.h, self.anchor)[self.probe] if len(self.probe) else np.zeros(0, np.uint64)
        cut = hashes >> self.cut << self.cut
        order = np.argsort(cut, kind="stable")
        head = np.flatnonzero(heads(cut[order]))
        count = np.diff(np.append(head, len(order)))
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(head)), count)
        block = np.zeros(len(head), bool)
        block[place[self.block]] = True
        return [cut[order[head]], block, count > 1], place

    def candidates(self, deal: Deal, answers: dict[int, bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The distinct windows around hits as the columns of Windows, where each of them is first, and all later places.

        A hit is extended to the windows that hold it; of those, every one that occurs elsewhere is part of
        a maximal repeat around the hit, and all of a maximal repeat's windows hold a hit.
        """
        (cut, _, _), place = self.anchors()
        (hit,) = bits_of(answers, cut, deal.first)
        near = np.zeros(len(self.h) + 1, np.int64)
        near[1:][self.probe[hit[place]]] = 1
        near = np.cumsum(near)
        end = np.minimum(np.arange(len(self.h)) + self.window - self.anchor + 1, len(self.h))
        at = np.flatnonzero(self.whole & (near[end] > near[np.arange(len(self.h))]))
        if not len(at):
            none = np.zeros(0, np.uint64)
            return [none, none, at], at, at
        text, begin = self.joined(covered(at, self.window, len(self.h)))
        last = at + self.window - 1
        same = digests(text, begin[at], begin[last] + self.end[last] - self.start[last])
        order = np.lexsort((at, same[:, 1], same[:, 0]))  # words are in the order of (id, start)
        same, at = same[order], at[order]
        new = heads(same[:, 0], same[:, 1])
        return [same[new, 0], same[new, 1], self.ids[self.row[at[new]]]], at[new], at[~new]

    def joined(self, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The words to keep, each with a space after it, and where each begins (one more at the end)."""
        begin = np.concatenate([[0], np.cumsum(np.where(keep, self.end - self.start + 1, 0))])
        flat = np.full(int(begin[-1]), 32, np.uint8)
        of = np.flatnonzero(keep)
        body = (self.end - self.start)[of]
        inner = np.arange(body.sum()) - np.repeat(np.cumsum(body) - body, body)
        flat[np.repeat(begin[of], body) + inner] = self.data[np.repeat(self.start[of], body) + inner]
        return flat.tobytes(), begin

    def kept(self, keep: np.ndarray) -> pa.Array:
        """Each row's kept words, joined by one space."""
        text, begin = self.joined(keep)
        edge = begin[self.first].tolist()
        return pa.array([text[a : max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN, batch: int = BATCH) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (UTF-8 bytes: the kept words joined by one space).

    A word goes if a window of ``window`` consecutive words covers it whose words also start earlier: in a
    row of smaller id or earlier in the same row. Windows are judged on the input. Words are runs without
    U+0020 and U+0009 to U+000D; a null text has none. Ids are integers; a null id comes last, and of
    repeated rows, or rows of one id, exactly one keeps a window that they share. An empty table gives no
    rows; other columns are not looked at.

    1. Every chunk asks with all its rolling anchors, half a window long, marking those that are aligned
       reference blocks; an anchor is a hit where it matches a block elsewhere. A repeated window holds one.
    2. Hits are extended to the windows that hold them, which are asked for by the 128-bit BLAKE2b digest
       of their words, each with the smallest id that the chunk has of it; all but the earliest go. Those
       that go in a row make up a maximal repeat. The 64-bit hashes of step 1 only choose what is looked at.
    The text is shuffled once; all three uses of it share that exchange.
    """
    if dict(docs.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("ids have to be integers")
    rows, deal = dealt(docs, id_col, text_col, chunk_bytes, fan, batch)
    id_type, chunks = dict(docs.dtypes)[id_col], rows.groupBy("chunk")
    anchors, windows = Anchors(deal.bits), Windows()

    def first_asks(key: tuple, table: pa.Table) -> pa.Table:
        return anchors.ask(key[0].as_py(), Chunk(table, window, deal.bits).anchors()[0], deal)

    def second_asks(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return asks(0, 2, {})
        return windows.ask(key[0].as_py(), Chunk(table, window, deal.bits).candidates(deal, asked(answers, 1))[0], deal)

    def result(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.binary())})
        chunk = Chunk(table, window, deal.bits)
        cols, at, later = chunk.candidates(deal, asked(answers, 1))
        (gone,) = bits_of(asked(answers, 2), cols[0], deal.first)
        out = covered(np.concatenate([at[gone], later]), window, len(chunk.h))
        n_removed = np.diff(np.concatenate([[0], np.cumsum(out)])[chunk.first])
        found = pa.table({"id": chunk.rows["id"], "n_words": pa.array(np.diff(chunk.first), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": chunk.kept(~out)})
        del chunk
        release()
        return found

    one = anchors.answered(chunks.applyInArrow(first_asks, ASKS), deal)
    two = windows.answered(chunks.cogroup(one.groupBy("chunk")).applyInArrow(second_asks, ASKS), deal)
    out = chunks.cogroup(one.unionByName(two).groupBy("chunk")).applyInArrow(result, f"id {id_type}, n_words long, n_removed long, kept binary")
    return out.withColumnRenamed("id", id_col)
