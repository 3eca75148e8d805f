import os

import numpy as np
import pyarrow as pa
import pytest

from weft.operators import tiles
from weft.operators.matrix import SparseMatrix
from weft.operators.ranking import shared_dir
from weft.plans import catalog
from weft.sources import tables

LARGER = "/root/testdata/sf0.01"


def matrix(spark, z):
    return SparseMatrix(spark.createDataFrame([(int(i), int(j), int(z[i, j])) for i, j in zip(*np.nonzero(z), strict=True)], "row long, col long, val long"), *z.shape)


def random(shape, top, share, seed=5):
    rnd = np.random.default_rng(seed)
    return rnd.integers(-top, top, shape) * (rnd.random(shape) < share)


def dense(m):
    z = np.zeros((m.nrow, m.ncol), object)
    for r in m.df.collect():
        z[r.row, r.col] = r.val
    return z


def on_disk(spark):
    top = shared_dir(spark).removeprefix("file://")
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)


@pytest.mark.parametrize("val", [[], [0], [3, 0, 255], [-1, 200], [2**40, -(2**40)], [2**63 - 1, -(2**63)]])
def test_packed_tiles_come_back(val):
    at, val = np.arange(len(val)) ** 2 * 1000, np.array(val, np.int64)
    for got, want in zip(tiles.unpack(tiles.pack(at, val)), (at, val), strict=True):
        assert got.tolist() == want.tolist()


def test_self_products_by_tiles(spark):
    z = random((60, 23), 9, 0.3)
    z[7] = 4  # one row meets all columns
    a = matrix(spark, z)
    assert a.gram(4).equals(a.transpose().mxm(a)) and a.gram().equals(a.transpose().mxm(a))
    assert a.gram(4).product(a.gram(4), dense_from=10**9).equals(a.gram(512).product(a.gram(512), dense_from=0))  # by the join and by tiles
    big = matrix(spark, np.array([[2**31, 2**30], [0, 2**31]]))
    assert (dense(big.gram(1)) == np.array([[2**62, 2**61], [2**61, 2**62 + 2**60]], object)).all()
    with pytest.raises(Exception, match=r"(?i)overflow|too (big|large)"):
        matrix(spark, np.array([[2**31], [2**31]])).gram(1).df.collect()


def test_self_products_in_small_steps(monkeypatch):
    monkeypatch.setattr(tiles, "PAIRS", 7)
    monkeypatch.setattr(tiles, "CHUNK", 10)
    z = random((40, 12), 5, 0.5)
    z[3] = 2
    row, col = np.nonzero(z)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 9]) for x in (row, col, z[row, col])], ["row", "col", "val"]) for i in range(0, len(row), 9)]
    parts = pa.Table.from_batches(tiles._paired(5)(iter(batches))).sort_by([("ti", "ascending"), ("tj", "ascending")])
    got = np.zeros((12, 12), np.int64)
    for b in tiles._merged(5)(iter(parts.to_batches(max_chunksize=3))):
        for ti, tj, blob in zip(b["ti"].to_pylist(), b["tj"].to_pylist(), b["tile"].to_pylist(), strict=True):
            at, val = tiles.unpack(blob)
            got[ti * 5 + at // 5, tj * 5 + at % 5] = val
    assert (got == z.T @ z).all()


def test_products_leave_a_task_added_up(spark):
    x, y = random((9, 30), 4, 0.4), random((30, 11), 4, 0.4, 6)
    a, b = matrix(spark, x), matrix(spark, y)
    one = a.mxm_tiled(b, 4)
    assert "Aggregate" not in one.df._jdf.queryExecution().toString()
    assert one.equals(a.mxm(b)) and a.mxm_tiled(b, 4, inner=3).equals(a.mxm(b))


def test_cancelled_places_stay_in_tiles(spark):
    a, b = matrix(spark, np.array([[1, -1]])), matrix(spark, np.array([[5], [5]]))
    for tile in (1, 2):
        assert [tuple(r) for r in a.mxm_tiled(b, tile).df.collect()] == [(0, 0, 0)]


def test_square_keeps_packed_tiles_only(spark):
    ss = tables.shared_orders(spark, LARGER)
    before = on_disk(spark)
    got = tables.shared_orders_tiled(spark, LARGER).square()
    assert on_disk(spark) - before < 4 * ss.nnz()  # bytes
    assert got.equals(ss.mxm(ss))


def test_clustering_steps_by_tiles_equal_the_whole_product_cut(spark):
    a = matrix(spark, random((70, 17), 5, 0.3)).gram(4)
    whole = a.product(a)
    for cut in ((50, 5, 0, 0.0), (2, 4, 6, 40.0), (0, 1, 3, 1e9), (-20, 0, 2, 1e9), (900, 3, 4, 5000.0)):
        want = whole.prune_recover_select(*cut)
        assert a.mcl_step(a, *cut, dense_from=0).equals(want) and sorted(map(tuple, want.df.collect())), cut


def test_clustering_step_keeps_no_whole_product(spark):
    ss = tables.shared_orders(spark, LARGER)
    before = on_disk(spark)
    query = catalog.queries()["mcl_step"](spark, LARGER)
    assert on_disk(spark) - before < 12 * ss.nnz()  # bytes
    assert query.count() == 500


def test_self_products_without_entries_and_without_rows(spark):
    for rows in ([], [(None, 1, 3), (None, 2, 4), (0, 1, 2)]):
        a = SparseMatrix(spark.createDataFrame(rows, "row long, col long, val long"), 3, 3)
        g = a.gram(2)
        assert g.equals(a.transpose().mxm(a)) and g.square().equals(g.mxm(g)) and g.mcl_step(g, 1, 2, 0, 0.0).nnz() == len(rows) // 3
