"""Tiles of matrices of whole numbers: packed into blobs, summed and multiplied within tasks."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]

TILES = "ti long, tj long, n long, tile binary"
ENTRIES = "row long, col long, val long"
#: So many pairs of entries are formed, and so many entries read, at once.
PAIRS, CHUNK = 1 << 22, 1 << 18


def pack(at: np.ndarray, val: np.ndarray) -> bytes:
    """Rising places within a tile and their values: steps and values in as few bytes as they need, compressed."""
    step = np.diff(at, prepend=0)
    step = step.astype(np.min_scalar_type(int(step.max(initial=0))))
    kind = np.promote_types(np.min_scalar_type(int(val.min(initial=0))), np.min_scalar_type(int(val.max(initial=0))))
    val = val.astype(kind if kind.kind in "iu" and kind.itemsize < 8 else np.int64)
    head = np.array([len(at), step.itemsize, val.itemsize * (1 if val.dtype.kind == "i" else -1)], "<i8").tobytes()
    return head + pa.compress(step.tobytes() + val.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, step, kind = np.frombuffer(blob, "<i8", 3).tolist()
    raw = pa.decompress(memoryview(blob)[24:], n * (step + abs(kind)), codec="zstd", asbytes=True)
    at = np.cumsum(np.frombuffer(raw, f"u{step}", n), dtype=np.int64)
    return at, np.frombuffer(raw, f"{'i' if kind > 0 else 'u'}{abs(kind)}", n, n * step).astype(np.int64)


def _most(*vals: np.ndarray) -> int:
    """A bound of the absolute product of one value of each."""
    out = 1
    for v in vals:
        out *= max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0))))
    return out


def _long(val: np.ndarray) -> np.ndarray:
    """As longs; a value beyond them is an error."""
    return np.array(val.tolist(), np.int64) if val.dtype == object else val.astype(np.int64)


def summed(at: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in order, and the sum of each."""
    if not len(at):
        return at, val
    order = np.argsort(at, kind="stable")
    at, val = at[order], val[order]
    first = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
    return at[first], _long(np.add.reduceat(val if val.dtype == object or _most(val) * len(val) < 2**63 else val.astype(object), first))


def packed_tiles(df: DataFrame, tile: int) -> DataFrame:
    """(ti, tj, n, tile): each tile's entries, counted and as one blob."""

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        row, col, val = (table[c].to_numpy() for c in ("row", "col", "val"))
        at = row % tile * tile + col % tile
        order = np.argsort(at)
        return pa.Table.from_batches(_tile_rows(iter([(key[0].as_py(), key[1].as_py(), at[order], val[order])])))

    at = lambda c: F.floor(F.col(c) / tile).cast("long")
    return df.groupBy(at("row").alias("ti"), at("col").alias("tj")).applyInArrow(packed, TILES)


def _tile_rows(tiles: Iterator[tuple[int, int, np.ndarray, np.ndarray]], at_once: int = 64) -> Batches:
    while some := list(itertools.islice(tiles, at_once)):
        columns = [[t[0] for t in some], [t[1] for t in some], [len(t[2]) for t in some]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([pack(*t[2:]) for t in some], pa.binary())], ["ti", "tj", "n", "tile"])


def entries(tiles: DataFrame, tile: int) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for b in batches:
            for ti, tj, blob in zip(b["ti"].to_pylist(), b["tj"].to_pylist(), b["tile"], strict=True):
                at, val = unpack(blob.as_py())
                yield _entries(ti * tile + at // tile, tj * tile + at % tile, val)

    return tiles.mapInArrow(run, ENTRIES)


def _entries(row: np.ndarray, col: np.ndarray, val: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(col, pa.int64()), pa.array(val, pa.int64())], ["row", "col", "val"])


def counts(tiles: DataFrame, tile: int, dim: str) -> DataFrame:
    """(k, n): the entries of each row or column that has any."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            for ti, tj, blob in zip(b["ti"].to_pylist(), b["tj"].to_pylist(), b["tile"], strict=True):
                at, _ = unpack(blob.as_py())
                n = np.bincount(at // tile if dim == "row" else at % tile, minlength=tile)
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(k + (ti if dim == "row" else tj) * tile), pa.array(n[k])], ["k", "n"])

    return tiles.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def _runs(batches: Batches, keys: list[str], blobs: list[str]) -> Iterator[tuple[tuple, Iterator]]:
    """Rows that are sorted by keys, as one iterator of blobs for each key; only a batch is held."""
    rows = (((*(b[c][i].as_py() for c in keys),), [b[c][i].as_py() for c in blobs]) for b in batches for i in range(b.num_rows))
    for key, run in itertools.groupby(rows, lambda r: r[0]):
        yield key, (r[1] for r in run)


# -- self-products --------------------------------------------------------------------------------------
def gram_tiles(df: DataFrame, tile: int) -> DataFrame:
    """The tiles of the transpose times the matrix itself.

    Rows are met where they lie: a task forms the pairs of each row's entries, of which the upper triangle is
    enough, adds up what falls on the same place and sends packed tiles, so that no pair is a row of its own.
    """
    rows = df.where("row IS NOT NULL").select("row", "col", F.col("val").cast("long").alias("val")).repartition("row").sortWithinPartitions("row", "col")
    parts = rows.mapInArrow(_paired(tile), TILES)
    return parts.repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(_merged(tile), TILES)


def _paired(tile: int) -> Callable[[Batches], Batches]:
    def pairs(col: np.ndarray, val: np.ndarray, begin: np.ndarray, many: np.ndarray) -> Iterator[tuple]:
        """Entry i meets the ``many[i]`` entries from i on."""
        left = np.repeat(begin, many)
        right = left + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
        a, b = val[left], val[right]
        product = a * b if _most(a, b) < 2**63 else a.astype(object) * b
        # whole tiles follow each other in the order of their places
        ti, tj = col[left] // tile, col[right] // tile
        wide = int(col.max()) // tile + 1
        at, total = summed((ti * wide + tj) * tile**2 + col[left] % tile * tile + col[right] % tile, product)
        edge = [0, *(np.flatnonzero(np.diff(at // tile**2)) + 1).tolist(), len(at)]
        for x, y in itertools.pairwise(edge):
            which = int(at[x]) // tile**2
            yield which // wide, which % wide, at[x:y] % tile**2, total[x:y]

    def chunk(row: np.ndarray, col: np.ndarray, val: np.ndarray) -> Iterator[tuple]:
        last = np.flatnonzero(np.diff(row, append=row[-1] + 1))
        many = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(row)) + 1
        upto, x = np.cumsum(many), 0
        while x < len(row):
            y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + PAIRS, "right")))
            yield from pairs(col, val, np.arange(x, y), many[x:y])
            x = y

    def chunks(batches: Batches) -> Iterator[tuple]:
        """Whole rows at a time, about CHUNK entries of them."""
        held: list[Entries] = []
        for b in batches:
            held.append(tuple(b[c].to_numpy() for c in ("row", "col", "val")))
            if sum(len(h[0]) for h in held) >= CHUNK:
                row, col, val = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(row, row[-1]))
                if cut:
                    yield from chunk(row[:cut], col[:cut], val[:cut])
                held = [(row[cut:], col[cut:], val[cut:])]
        if held and sum(len(h[0]) for h in held):
            yield from chunk(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return lambda batches: _tile_rows(chunks(batches))


def _merged(tile: int) -> Callable[[Batches], Batches]:
    """Upper tiles, in parts, to whole ones and their mirror images."""

    def added(blobs: Iterator) -> tuple[np.ndarray, np.ndarray]:
        total, there, most = np.zeros(tile**2, np.int64), np.zeros(tile**2, bool), 0
        for (blob,) in blobs:
            at, val = unpack(blob)
            most += _most(val)
            if most >= 2**63 and total.dtype != object:
                total = total.astype(object)
            total[at] += val
            there[at] = True
        at = np.flatnonzero(there)
        return at, _long(total[at])

    def whole(batches: Batches) -> Iterator[tuple]:
        for (ti, tj), blobs in _runs(batches, ["ti", "tj"], ["tile"]):
            at, val = added(blobs)
            mirror = at % tile * tile + at // tile
            if ti == tj:
                low = mirror != at
                at, val = np.concatenate([at, mirror[low]]), np.concatenate([val, val[low]])
                order = np.argsort(at)
                yield ti, tj, at[order], val[order]
            else:
                yield ti, tj, at, val
                order = np.argsort(mirror)
                yield tj, ti, mirror[order], val[order]

    return lambda batches: _tile_rows(whole(batches), 4)


# -- products -------------------------------------------------------------------------------------------
def product(left: DataFrame, right: DataFrame, tile: int, inner: int, emit: Callable[[int, int, Entries], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``emit`` makes of each tile of the product, or of each sum over ``inner`` inner tiles.

    Tiles meet by their inner index and the pairs go to the task of their place, which multiplies them one after
    the other and adds up, so that what leaves a task has one row for each place.
    """
    a = left.select("ti", F.col("tj").alias("tk"), F.col("tile").alias("a"))
    b = right.select(F.col("ti").alias("tk"), "tj", F.col("tile").alias("b"))
    met = a.join(b, "tk").select("ti", "tj", F.floor(F.col("tk") / inner).alias("g"), "a", "b")

    def run(batches: Batches) -> Batches:
        for (ti, tj, _), pairs in _runs(batches, ["ti", "tj", "g"], ["a", "b"]):
            row, col, val = _multiplied(pairs, tile)
            if len(val):
                yield emit(ti, tj, (row, col, val))

    return met.repartition("ti", "tj", "g").sortWithinPartitions("ti", "tj", "g").mapInArrow(run, schema)


def _multiplied(pairs: Iterator, tile: int) -> Entries:
    """The sum of the products of pairs of tiles; sums that may not fit in 53 bits are taken in integers."""
    total, there, most = np.zeros((tile, tile)), np.zeros((tile, tile), bool), 0
    for one, two in pairs:
        (at, x), (to, y) = unpack(one), unpack(two)
        has = lambda k: np.bincount(k, minlength=tile) > 0
        ks = has(at % tile) & has(to // tile)
        if not ks.any():
            continue
        # only the rows and columns that meet become a dense product
        p, q = ks[at % tile], ks[to // tile]
        at, x, to, y = at[p], x[p], to[q], y[q]
        rows, cols = has(at // tile), has(to % tile)
        place = np.ix_(rows, cols)
        k, r, c = (np.cumsum(m) - 1 for m in (ks, rows, cols))

        def dense(v1, v2, kind, at=at, to=to, k=k, r=r, c=c):
            m1, m2 = np.zeros((r[-1] + 1, k[-1] + 1), kind), np.zeros((k[-1] + 1, c[-1] + 1), kind)
            m1[r[at // tile], k[at % tile]], m2[k[to // tile], c[to % tile]] = v1, v2
            return m1 @ m2

        one_sum = _most(x, y) * (int(k[-1]) + 1)
        most += one_sum
        got = dense(x, y, float if one_sum < 2**53 else np.int64 if one_sum < 2**63 else object)
        there[place] |= got > 0 if x.min() > 0 and y.min() > 0 else dense(1, 1, np.float32) > 0
        if most >= 2**53:  # beyond a long an error is raised at the end, as by the join
            total = total.astype(np.int64) if total.dtype == float else total
            total = total.astype(object) if most >= 2**63 else total
            got = got.astype(np.int64) if got.dtype == float else got
        total[place] += got
    row, col = np.nonzero(there)
    return row, col, _long(total[row, col])


def all_entries(tile: int) -> Callable[[int, int, Entries], pa.RecordBatch]:
    return lambda ti, tj, e: _entries(e[0] + ti * tile, e[1] + tj * tile, e[2])


#: Entries, and rows without a place in a column that say how many of a tile's entries there are above a bar and their sum.
CANDIDATES = f"{ENTRIES}, n long, s long"


def column_candidates(tile: int, hard: float, select: int, recover: int) -> Callable[[int, int, Entries], pa.RecordBatch]:
    """Of a tile's entries, those that can be among what is kept of their column, whatever the other tiles have.

    A column's k-th largest entry isn't under the k-th largest of a part; the bar ``hard`` can only decide if no part has more than ``select`` above it.
    """

    def emit(ti: int, tj: int, e: Entries) -> pa.RecordBatch:
        row, col, val = (x[np.lexsort((e[2], e[1]))] for x in e)
        last = np.flatnonzero(np.diff(col, append=tile))
        count = np.diff(last, prepend=-1)
        above = val > hard
        n = np.add.reduceat(above.astype(np.int64), last - count + 1)
        of, sums = summed(col[above], val[above])
        s = np.zeros(tile, np.int64)
        s[of] = sums
        keep = np.repeat(n <= select, count) & (val >= hard)
        for k in (select, recover):
            if k > 0:
                bar = np.where(count >= k, val[np.maximum(last - k + 1, 0)], -(2**63))
                keep |= val >= np.repeat(bar, count)
        columns = col[last]
        more = lambda x, y: pa.concat_arrays([pa.nulls(int(keep.sum()), pa.int64()) if x is None else pa.array(x[keep], pa.int64()), pa.nulls(len(columns), pa.int64()) if y is None else pa.array(y, pa.int64())])
        return pa.RecordBatch.from_arrays([more(row + ti * tile, None), more(col + tj * tile, columns + tj * tile), more(val, None), more(None, n), more(None, s[columns])], ["row", "col", "val", "n", "s"])

    return emit
