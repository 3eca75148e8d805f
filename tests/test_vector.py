import pytest

from weft.operators.vector import DenseVector, SparseVector


def sparse(spark, rows, n=10):
    return SparseVector(spark.createDataFrame(rows, "idx long, val long"), n)


def got(x):
    return sorted(map(tuple, x.df.collect()))


def test_positions_are_dense_and_stable(spark):
    v = DenseVector.iota(spark, 1000).apply(lambda x: (x * 7919) % 1000)
    assert [(r.pos, r.val) for r in v.sort().orderBy("pos").collect()] == [(i, i) for i in range(1000)]


def test_find_repacks(spark):
    v = sparse(spark, [(2, 5), (4, 1), (9, 7)])
    assert got(v.find_indices(lambda x: x > 2)) == [(0, 2), (1, 9)]
    assert got(v.find_values(lambda x: x > 2)) == [(0, 5), (1, 7)]


def test_union_keeps_cancellations(spark):
    a, b = sparse(spark, [(1, 5), (2, 2)]), sparse(spark, [(1, 5), (3, 1)])
    assert got(a - b) == [(1, 0), (2, 2), (3, -1)]
    assert got(a.setminus(b)) == [(2, 2)]


def test_range_is_checked(spark):
    rows = spark.createDataFrame([(1, 2), (11, 3)], "idx long, val long")
    with pytest.raises(Exception, match="out of range"):
        SparseVector.build(rows, 10).df.collect()
    with pytest.raises(Exception, match="beyond"):
        sparse(spark, [(0, 50)]).invert(10).df.collect()
    with pytest.raises(IndexError):
        DenseVector.iota(spark, 5).set(5, 0)


def test_scatter_gather(spark):
    v = DenseVector.full(spark, 4, 0)
    moved = v.scatter(sparse(spark, [(0, 2), (1, 2), (2, 99)], 4), lambda x, i: x, lambda x, i: i + 10)
    assert got(moved) == [(0, 0), (1, 0), (2, 11), (3, 0)]
    assert got(moved.gather(sparse(spark, [(5, 2), (6, 8)]), lambda x, i: x, -1)) == [(5, 11), (6, -1)]


def test_reduce_and_equality(spark):
    v = sparse(spark, [(1, 5), (2, 2)])
    assert v.reduce("sum").first()[0] == 7 and v.reset().reduce("max", default=-9).first()[0] == -9
    assert v.equals(v) and not v.equals(v.set(2, 3)) and not v.equals(v.delete(2))
    assert v.nnz_until(2) == 1 and v.min_element().first() == (2, 2)
    assert got(v.to_dense(-1))[:3] == [(0, -1), (1, 5), (2, 2)]


def test_random_permutation_is_a_permutation_and_repeats(spark):
    v = DenseVector.iota(spark, 50)
    a, b = v.random_permutation(3), v.random_permutation(3)
    assert got(a) == got(b) and sorted(x for _, x in got(a)) == list(range(50)) and got(a) != got(v)
