"""Byte-level dedup: suffix order and longest previous factors of the texts' candidate stretches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import ASKS, BATCH, CHUNK_BYTES, FAN, Deal, Round, asked, asks, bits_of, by_part, covered, dealt, deltas, dumps, heads, loads, sums
from .hashing import _BYTE, SLICE, U64, digests, mix, powers, release, slices, texts_of

#: Bytes of a string that counts as a repeat, and of the anchor that each such string holds.
LENGTH, ANCHOR = 200, 64
#: Bytes whose suffixes are sorted at a time, unless one anchor alone has more.
SORTED = 1 << 19
#: The strings of an anchor with more kinds of surroundings than this are told one by one, each dealt by its own digest.
HOT = 1000


def suffix_order(data: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes with ``length`` bytes left, in the order of those bytes, and where runs of equal ones start.

    Prefix doubling: ranks by 8 bytes, then by twice as many, until the last step overlaps.
    """
    m = len(data)
    h = min(8, length)
    eight = np.ndarray((m,), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    at = np.flatnonzero(left >= h).astype(np.int32)
    key = eight[at].astype(U64) >> U64(64 - 8 * h)
    rank = np.zeros(m, np.uint32)
    while True:
        order = np.argsort(key)
        a, key = at[order], key[order]
        new = heads(key)
        rank[a] = np.cumsum(new, dtype=np.uint32)  # ranks of shorter rests are not looked at again
        if h == length:
            return a, new
        step = min(h, length - h)
        at = np.flatnonzero(left >= h + step).astype(np.int32)
        key = rank[at].astype(U64) << U64(32) | rank[at + step]
        h += step


def _nearest_smaller(place: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """The common prefix that each suffix has with the last one before it, in suffix order, of a smaller place; 0 if under ``least``.

    common[i] is that of the suffixes i - 1 and i. All between a suffix and where it looks have places no
    smaller than its own, so it can go on from there to where that one looks; the common prefix only falls
    on the way, and a suffix stops once it is under ``least``.
    """
    at, shared = np.arange(-1, len(place) - 1), np.minimum(common, np.iinfo(np.int32).max)
    todo = np.flatnonzero(shared >= least)
    out = np.zeros(len(place), common.dtype)
    while len(todo):
        todo = todo[at[todo] >= 0]
        smaller = place[at[todo]] < place[todo]
        out[todo[smaller]] = shared[todo[smaller]]
        todo = todo[~smaller]
        via = at[todo]
        shared[todo], at[todo] = np.minimum(shared[todo], shared[via]), at[via]
        todo = todo[shared[todo] >= least]
    return out


def previous_factors(place: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """The longest-previous-factor array of suffixes in suffix order: how long a prefix also starts at a smaller place; 0 if under ``least``.

    It is the longer of the prefixes shared with the previous and with the next smaller place in that order.
    """
    back = np.append(common[1:], 0)[::-1]
    return np.maximum(_nearest_smaller(place, common, least), _nearest_smaller(place[::-1], back, least)[::-1])


def other_matches(order: np.ndarray, new: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes of the order share ``length`` bytes with one at another place.

    Those whose longest previous factor is that long, and those that are one for a later suffix: whose
    longest next factor is. The sort tells common prefixes up to ``length``, so factors end there.
    """
    out = np.zeros(len(order), bool)
    some = np.flatnonzero(~(new & np.append(new[1:], True)[: len(new)]))  # a run of one has no match
    common, p = np.where(new[some], 0, length), place[order[some]]
    out[some] = (previous_factors(p, common, length) > 0) | (previous_factors(-p, common, length) > 0)
    return out


class Surroundings(Round):
    """Anchors with their surroundings: the anchor's hash, the surroundings' 128-bit digest, whether the asker has them several times.

    Answered by three bits: whether they occur again; whether their bytes are wanted, as the anchor has
    others too and this is the first asker with them; whether the anchor has very many others.
    """

    kind, flags = 1, 3

    def __init__(self, hot: int):
        self.hot = hot

    def dump(self, cols: list[np.ndarray], used: int) -> bytes:
        return dumps(deltas(cols[0]), cols[1], cols[2], np.packbits(cols[3]))

    def load(self, blob: bytes, part: int, used: int) -> list[np.ndarray]:
        a, x, y, more = loads(blob)
        return [sums(a), x, y, np.unpackbits(more, count=len(a)).astype(bool)]

    def merge(self, cols):
        order = np.lexsort((cols[2], cols[1], cols[0]))
        new = heads(*[c[order] for c in cols[:3]])
        head = np.flatnonzero(new)
        inverse, first = np.empty(len(order), np.int64), np.empty(len(order), bool)
        inverse[order], first[order] = np.cumsum(new) - 1, new
        more = np.logical_or.reduceat(cols[3][order], head) | (np.diff(np.append(head, len(order))) > 1)
        return [*[c[order][new] for c in cols[:3]], more], inverse, first

    def top(self, merged):
        head = np.flatnonzero(heads(merged[0]))
        size = np.diff(np.append(head, len(merged[0])))
        kinds = np.repeat(size, size)
        return [merged[3], kinds > 1, kinds > self.hot]

    def spread(self, up, inverse, first):
        return [up[0][inverse], up[1][inverse] & first, up[2][inverse] & first]


class Strings(Round):
    """Strings by their 128-bit digests, and whether the asker has them at several places; answered by whether they occur again."""

    kind = 3

    def dump(self, cols: list[np.ndarray], used: int) -> bytes:
        return dumps(deltas(cols[0]), cols[1], np.packbits(cols[2]))

    def load(self, blob: bytes, part: int, used: int) -> list[np.ndarray]:
        x, y, more = loads(blob)
        return [sums(x), y, np.unpackbits(more, count=len(x)).astype(bool)]

    def merge(self, cols):
        order = np.lexsort((cols[1], cols[0]))
        new = heads(cols[0][order], cols[1][order])
        head = np.flatnonzero(new)
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        more = np.logical_or.reduceat(cols[2][order], head) | (np.diff(np.append(head, len(order))) > 1)
        return [cols[0][order][new], cols[1][order][new], more], inverse, np.zeros(0, bool)

    def top(self, merged):
        return [merged[2]]

    def spread(self, up, inverse, first):
        return [up[0][inverse]]


class Chunk:
    """A chunk's texts and their anchors: of each string of ``length`` bytes, the 64-byte gram with the least hash.

    An anchor's surroundings, lo to hi, are the strings that have it.
    """

    def __init__(self, table: pa.Table, length: int, anchor: int):
        self.ids, self.length, self.anchor = table["id"], length, anchor
        self.data, self.at = texts_of(table["text"])
        self.reach = length - anchor  # an anchor starts at most so far into a string
        found = [self._slice(i, j) for i, j in slices(self.at, SLICE)]
        self.pos, self.a, self.lo, self.hi = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
        same = digests(self.data.tobytes(), self.lo, self.hi)
        shape = (self.pos - self.lo).astype(U64) << U64(32) | (self.hi - self.pos).astype(U64)
        self.x, self.y = same[:, 0] ^ mix(shape), same[:, 1].copy()
        order = np.lexsort((self.pos, self.y, self.x, self.a))
        self.pos, self.a, self.x, self.y, self.lo, self.hi = (v[order] for v in (self.pos, self.a, self.x, self.y, self.lo, self.hi))
        new = heads(self.a, self.x, self.y)
        self.head = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        self.more = np.diff(np.append(self.head, len(order))) > 1

    def _slice(self, i: int, j: int) -> tuple[np.ndarray, ...]:
        base, part, bound = self.at[i], self.data[self.at[i] : self.at[j]], self.at[i : j + 1] - self.at[i]
        n, w = len(part), self.reach + 1
        none = np.zeros(0, np.int64)
        if n < self.length:
            return none, none.astype(U64), none, none
        up, down = powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[part] * up[:n], out=total[1:])
        gram = mix((total[self.anchor :] - total[: -self.anchor]) * down[: n - self.anchor + 1])
        key = gram >> U64(32) << U64(32) | np.arange(len(gram), dtype=U64)
        size = -(-len(key) // w) * w
        key = np.concatenate([key, np.full(size - len(key), np.iinfo(U64).max)]).reshape(-1, w)
        front = np.minimum.accumulate(key, axis=1).ravel()
        back = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[: n - self.length + 1], front[self.reach : self.reach + n - self.length + 1])
        row = np.repeat(np.arange(j - i), np.diff(bound))[: len(least)]
        start = np.flatnonzero(np.arange(len(least)) + self.length <= bound[row + 1])
        pos = (least[start] & U64(0xFFFFFFFF)).astype(np.int64)
        head = np.flatnonzero(heads(pos))  # the strings of an anchor start in a row
        end = np.append(head[1:], len(pos))[: len(head)] - 1
        pos = pos[head]
        # the least of many hashes is small, so it is scrambled again or the first parts would get all anchors
        return pos + base, mix(gram[pos]), start[head] + base, start[end] + self.length + base

    def first(self) -> list[np.ndarray]:
        """The columns of Surroundings."""
        return [self.a[self.head], self.x[self.head], self.y[self.head], self.more]

    def wanted(self, deal: Deal, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By distinct (anchor, surroundings) whether they occur again; of which the bytes are wanted, and of which each string by itself."""
        again, send, hot = bits_of(answers, self.a[self.head], deal.first, 3)
        return again, self.head[send & ~hot], self.head[hot]

    def strings(self, of: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The columns of Strings for the strings of some surroundings, where all of these start, and which column entry each is."""
        n = self.hi[of] - self.lo[of] - self.length + 1
        start = np.unique(np.repeat(self.lo[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        if not len(start):
            return [np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool)], start, start
        same = digests(self.data.tobytes(), start, start + self.length)
        order = np.lexsort((same[:, 1], same[:, 0]))
        new = heads(same[order, 0], same[order, 1])
        entry = np.empty(len(start), np.int64)
        entry[order] = np.cumsum(new) - 1
        return [same[order, 0][new], same[order, 1][new], np.bincount(entry) > 1], start, entry

    def second(self, chunk: int, deal: Deal, answers: dict[int, bytes]) -> pa.Table:
        _, sent, hot = self.wanted(deal, answers)
        parts = {}
        for p, s in by_part(self.a[sent], deal.bits):
            lo, size = self.lo[sent[s]], (self.hi - self.lo)[sent[s]]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            parts[p] = dumps(self.a[sent[s]], lo, size, self.data[np.repeat(lo, size) + inner])
        return pa.concat_tables([asks(chunk, 2, parts), Strings().ask(chunk, self.strings(hot)[0], deal)])

    def removed(self, deal: Deal, answers: pa.Table) -> np.ndarray:
        """Which bytes go."""
        again, sent, hot = self.wanted(deal, asked(answers, 1))
        got, starts = asked(answers, 2), []
        for p, s in by_part(self.a[sent], deal.bits):
            if p in got:
                n = s.stop - s.start
                mask = np.unpackbits(loads(got[p])[0], count=n * (self.reach + 1)).reshape(n, -1)
                which, offset = np.nonzero(mask)
                starts.append(self.lo[sent[s]][which] + offset)
        cols, start, entry = self.strings(hot)
        starts.append(start[bits_of(asked(answers, 3), cols[0], deal.first)[0][entry]])
        out = covered(np.concatenate(starts), self.length, len(self.data))
        full, n = again[self.of], len(self.data) + 1
        return out | (np.cumsum((np.bincount(self.lo[full], minlength=n) - np.bincount(self.hi[full], minlength=n))[:-1]) > 0)


def _told(part: int, kind: int, found: list[tuple[int, bytes]]) -> pa.Table:
    n = len(found)
    return pa.table({"part": pa.array([part] * n, pa.int64()), "chunk": pa.array([f[0] for f in found], pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "blob": pa.array([f[1] for f in found], pa.binary())})


def _candidates(data: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """By entry, the first start and the end of its strings whose hash occurs again in its group; both 0 for none.

    Equal strings have equal hashes, so no suffix outside these stretches has a common prefix of ``length``.
    """
    first, last = np.full(len(begin), np.iinfo(np.int64).max), np.full(len(begin), -1)
    room = size - length + 1
    total = np.cumsum(np.maximum(room, 0))
    edge = np.append(np.flatnonzero(heads(group)), len(group))  # entries are in the order of their groups
    i = 0
    while i < len(edge) - 1:  # whole groups, about SORTED / 2 strings at a time
        before = total[edge[i] - 1] if edge[i] else 0
        j = max(i + 1, int(np.searchsorted(total[edge[1:] - 1], before + SORTED // 2, side="right")))
        some = np.arange(edge[i], edge[j])
        some = some[room[some] > 0]
        n = size[some]
        row = np.repeat(np.arange(len(some)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        up, down = powers(len(inner) + 1)
        sums_ = np.zeros(len(inner) + 1, U64)
        np.cumsum(_BYTE[data[begin[some][row] + inner]] * up[:-1], out=sums_[1:])
        at = np.flatnonzero(inner < room[some][row])
        key = (mix((sums_[at + length] - sums_[at]) * down[at]) & ~U64(0xFFFFF)) ^ mix(group[some][row[at]].astype(U64))
        order = np.argsort(key)
        new = heads(key[order])
        again = np.empty(len(order), bool)
        again[order] = ~(new & np.append(new[1:], True))
        at = at[again]
        np.minimum.at(first, some[row[at]], inner[at])
        np.maximum.at(last, some[row[at]], inner[at])
        i = j
    none = last < 0
    return np.where(none, 0, first), np.where(none, 0, last + length)


def _matched(part: int, table: pa.Table, length: int, anchor: int) -> pa.Table:
    """The strings of surroundings that occur again, by their suffixes' longest previous and next factors."""
    blobs = [loads(b) for b in table["blob"].to_pylist()]
    src = np.repeat(table["chunk"].to_numpy(), [len(b[0]) for b in blobs])
    bound = np.cumsum([0, *[len(b[0]) for b in blobs]]).tolist()
    home, lo, size = (np.concatenate([b[k] for b in blobs]) for k in range(3))
    data = np.concatenate([b[3] for b in blobs])
    del blobs
    begin = np.cumsum(size) - size
    mask = np.zeros((len(home), length - anchor + 1), np.uint8)
    by_home = np.argsort(home, kind="stable")
    group = np.cumsum(heads(home[by_home])) - 1
    some, own = by_home, group
    alone = heads(own) & np.append(heads(own)[1:], True)  # what has a home of its own has no match
    some, own = some[~alone], own[~alone]
    start, end = _candidates(data, begin[some], size[some], own, length)
    has = end > 0
    some, own, start, end = some[has], own[has], start[has], end[has]
    edges = np.append(np.flatnonzero(heads(own)), len(own))
    total = np.concatenate([[0], np.cumsum(end - start)])[edges]
    i = 0
    while i < len(edges) - 1:  # whole homes, about SORTED bytes at a time
        j = max(i + 1, int(np.searchsorted(total, total[i] + SORTED, side="right")) - 1)
        s = slice(edges[i], edges[j])
        n = (end - start)[s]
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        left, inner = (n[row] - inner).astype(np.int32), (inner + start[s][row]).astype(np.int32)
        order, new = suffix_order(data[begin[some[s]][row] + inner], left, length)
        hit = order[other_matches(order, new, (src[some[s]][row] << 40) + lo[some[s]][row] + inner, length)]
        mask[some[s][row[hit]], inner[hit]] = 1
        i = j
    chunks, found = table["chunk"].to_pylist(), []
    for c, p, q in zip(chunks, bound[:-1], bound[1:], strict=True):
        if mask[p:q].any():
            found.append((c, dumps(np.packbits(mask[p:q].ravel()))))
    return _told(part, 2, found)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN, batch: int = BATCH, hot: int = HOT) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that stay).

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere else, in the same row
    too and overlapping or not; strings lie in one row and are judged on the input, as UTF-8 bytes. A null
    text is empty. Repeated rows are repeats of each other. An empty table gives no rows; other columns
    are not looked at.

    Suffixes are only sorted where they can match. Of each string the 64-byte gram with the least hash is
    its anchor, which equal strings share. Chunks of texts tell each anchor's hash and the 128-bit BLAKE2b
    digest of all bytes a string around it can have. Where both occur again, all those strings do. Where
    only the anchor does, one copy of each kind of surroundings is sent, and the part that gathers them
    sorts their suffixes and computes longest previous factors, from previous and next smaller places in
    suffix order, and longest next factors: where either is ``length``, the string occurs elsewhere. The
    strings of an anchor with more than ``hot`` surroundings, that is of a passage in very many texts, are
    told one by one by their digests, each dealt by its own, so that they are no one task's. The text is
    shuffled once; its three uses share that.
    """
    rows, deal = dealt(docs, id_col, text_col, chunk_bytes, fan, batch)
    chunks = rows.groupBy("chunk")
    id_type = dict(docs.dtypes)[id_col]
    around = Surroundings(hot)

    def first_asks(key: tuple, table: pa.Table) -> pa.Table:
        return around.ask(key[0].as_py(), Chunk(table, length, anchor).first(), deal)

    def second_asks(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return asks(0, 2, {})
        return Chunk(table, length, anchor).second(key[0].as_py(), deal, asked(answers, 1))

    def result(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), **{c: pa.array([], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}, "kept": pa.array([], pa.binary())})
        chunk = Chunk(table, length, anchor)
        gone = chunk.removed(deal, answers)
        at = chunk.at
        total = np.concatenate([[0], np.cumsum(gone)])
        head = gone & ~np.concatenate([[False], gone[:-1]])
        head[at[:-1][at[:-1] < len(gone)]] |= gone[at[:-1][at[:-1] < len(gone)]]
        spans = np.concatenate([[0], np.cumsum(head)])
        kept = [chunk.data[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        found = pa.table({"id": chunk.ids, "n_bytes": np.diff(at), "n_removed": np.diff(total[at]), "n_spans": np.diff(spans[at]), "kept": pa.array(kept, pa.binary())})
        del chunk
        release()
        return found

    def second_answers(key: tuple, table: pa.Table) -> pa.Table:
        """Both kinds of a part: homes of surroundings and, if they are asked in one step, strings."""
        kind = table["kind"].to_numpy()
        some, told = [table.filter(pa.array(kind == k)) for k in (2, 3)], []
        if some[0].num_rows:
            told.append(_matched(key[0].as_py(), some[0], length, anchor))
        if some[1].num_rows:
            told.append(strings._answer(deal.bits)(some[1]))
        release()
        return pa.concat_tables(told)

    strings = Strings()
    one = around.answered(chunks.applyInArrow(first_asks, ASKS), deal)
    asking = chunks.cogroup(one.groupBy("chunk")).applyInArrow(second_asks, ASKS)
    if deal.bits <= deal.first:
        two = asking.groupBy("part").applyInArrow(second_answers, ASKS)
    else:
        two = asking.where("kind = 2").groupBy("part").applyInArrow(second_answers, ASKS).unionByName(strings.answered(asking.where("kind = 3"), deal))
    out = chunks.cogroup(one.unionByName(two).groupBy("chunk")).applyInArrow(result, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)
