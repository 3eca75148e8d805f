import struct

import numpy as np
import pytest

from weft.operators.bfs import bfs, validate
from weft.operators.matrix import SparseMatrix
from weft.operators.ranking import checkpointed
from weft.operators.vector import SparseVector
from weft.sources import binary, generate, text


def got(m):
    return sorted(map(tuple, m.df.collect()))


def test_symmetric_matrix_market(spark, tmp_path):
    p = tmp_path / "a.mtx"
    p.write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n2 1 1.5\n3 1 2\n2 2 4\n")
    m = text.read_mtx(spark, str(p))
    assert (m.nrow, m.ncol) == (3, 3)
    assert got(m) == [(0, 1, 1.5), (0, 2, 2.0), (1, 0, 1.5), (1, 1, 4.0), (2, 0, 2.0)]


def test_header_line_that_looks_like_an_entry(spark, tmp_path):
    p = tmp_path / "a.mtx"
    p.write_text("%%MatrixMarket matrix coordinate integer general\n3 3 2\n3 3 2\n1 1 7\n")
    assert got(text.read_mtx(spark, str(p))) == [(0, 0, 7), (2, 2, 2)]


def test_pattern_and_refused_kinds(spark, tmp_path):
    p = tmp_path / "a.mtx"
    p.write_text("%%MatrixMarket matrix coordinate pattern general\n2 2 2\n1 2\n2 1\n")
    assert got(text.read_mtx(spark, str(p))) == [(0, 1, 1), (1, 0, 1)]
    p.write_text("%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 1 1\n")
    with pytest.raises(ValueError):
        text.read_mtx(spark, str(p))


def test_matrix_market_round_trip_with_repeats_and_empty(spark, tmp_path):
    m = SparseMatrix(spark.createDataFrame([(0, 1, 5), (2, 0, -3)], "row long, col long, val long"), 3, 2)
    text.write_mtx(m, str(tmp_path / "m"))
    assert text.read_mtx(spark, str(tmp_path / "m")).equals(m)
    text.write_mtx(m._new(m.df.where("false")), str(tmp_path / "e"))
    assert text.read_mtx(spark, str(tmp_path / "e")).nnz() == 0


def test_labelled_tuples(spark, tmp_path):
    (tmp_path / "t").write_text("a b 2\nb c 3\na b 9\n")
    m, known = text.read_labelled(spark, str(tmp_path / "t"))
    name = {r.idx: r.label for r in known.collect()}
    assert sorted((name[r], name[c], v) for r, c, v in got(m)) == [("a", "b", 9.0), ("b", "c", 3.0)]
    assert sorted(name) == [0, 1, 2]


def test_encoded_triples(spark, tmp_path):
    (tmp_path / "t").write_text("3\n4\n<0> <2> <1> .\n<0> <3> <1> .\n<3> <1> <0> .\n")
    assert got(text.read_encoded_triples(spark, str(tmp_path / "t"))) == [(0, 1, 3), (3, 0, 1)]
    assert got(text.read_encoded_triples(spark, str(tmp_path / "t"), keep_all=True)) == [(0, 1, 2), (0, 1, 3), (3, 0, 1)]


def test_vector_text(spark, tmp_path):
    v = SparseVector(spark.createDataFrame([(7, 1.5), (2, 4.0)], "idx long, val double"), 9)
    text.write_vector(v, str(tmp_path / "v"))
    assert text.read_sparse_vector(spark, str(tmp_path / "v")).equals(v)


def test_legacy_triples(spark, tmp_path):
    (tmp_path / "l").write_text("2 2 2\n1 1\n2 1 4\n")
    assert got(text.read_triples_text(spark, str(tmp_path / "l"))) == [(0, 0, 1.0), (1, 0, 4.0)]


def test_hkdt_and_edge_list(spark, tmp_path):
    rec = np.array([(0, 1, 2.5), (2, 2, 1.0)], [("r", "<i8"), ("c", "<i8"), ("v", "<f8")])
    (tmp_path / "b").write_bytes(binary.header_bytes(3, 3, 2) + rec.tobytes())
    assert got(binary.read_hkdt(spark, str(tmp_path / "b"))) == [(0, 1, 2.5), (2, 2, 1.0)]
    assert got(binary.read_hkdt(spark, str(tmp_path / "b"), transpose=True)) == [(1, 0, 2.5), (2, 2, 1.0)]
    with pytest.raises(ValueError):
        binary.parse_header(b"nope")
    (tmp_path / "e").write_bytes(struct.pack("<6I", 1, 2, 1, 2, 4294967295, 0))
    assert sorted(map(tuple, binary.read_edge_list(spark, str(tmp_path / "e")).collect())) == [(1, 2), (1, 2), (4294967295, 0)]


def test_kronecker_and_search(spark):
    edges = generate.kronecker(spark, 7, 4)
    assert edges.count() == 512 and edges.agg({"src": "max"}).first()[0] < 128
    both = edges.unionByName(edges.selectExpr("dst AS src", "src AS dst"))
    a = SparseMatrix(checkpointed(SparseMatrix.from_edges(both, 128, remove_loops=True, count=False).df), 128, 128)
    source = a.df.first()["row"]
    tree = bfs(a, source)
    assert set(validate(a, tree, source).values()) == {0}
    assert sorted(map(tuple, tree.collect())) == sorted(map(tuple, bfs(a, source, bottom_up=True).collect()))
    wrong = tree.withColumn("level", tree.level + (tree.level > 1).cast("long"))
    assert sum(validate(a, wrong, source).values()) > 0


def test_kronecker_quadrants(spark):
    """The first bit of unscrambled edges falls in each quadrant as often as it should."""
    n = 16 << 11
    got = {(r[0], r[1]): r[2] / n for r in generate.kronecker(spark, 11, scramble=False).selectExpr("src >= 1024 AS s", "dst >= 1024 AS d").groupBy("s", "d").count().collect()}
    for place, share in (((False, False), generate.A), ((False, True), generate.B), ((True, False), generate.C), ((True, True), 1 - generate.A - generate.B - generate.C)):
        assert abs(got[place] - share) < 0.015


def test_matrix_market_arrays(spark, tmp_path):
    p = tmp_path / "a.mtx"
    p.write_text("%%MatrixMarket matrix array real general\n% note\n2 3\n1\n2\n3\n4\n5\n0\n")
    assert got(text.read_mtx(spark, str(p))) == [(0, 0, 1.0), (0, 1, 3.0), (0, 2, 5.0), (1, 0, 2.0), (1, 1, 4.0), (1, 2, 0.0)]
    n = 9
    for symmetry, first in (("symmetric", 0), ("skew-symmetric", 1)):
        places = [(i, j) for j in range(n) for i in range(j + first, n)]
        p.write_text("\n".join([f"%%MatrixMarket matrix array integer {symmetry}", f"{n} {n}", *[str(100 * i + j + 1) for i, j in places]]) + "\n")
        sign = 1 if symmetry == "symmetric" else -1
        want = sorted({*((i, j, 100 * i + j + 1) for i, j in places), *((j, i, sign * (100 * i + j + 1)) for i, j in places if i != j)})
        assert got(text.read_mtx(spark, str(p))) == want
    p.write_text("%%MatrixMarket matrix array pattern general\n1 1\n1\n")
    with pytest.raises(ValueError):
        text.read_mtx(spark, str(p))


def test_parts_follow_each_other(spark, tmp_path):
    m = SparseMatrix(spark.range(500).selectExpr("id AS row", "id * 7 % 500 AS col", "id AS val").repartition(6), 500, 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few lines are one part
    try:
        text.write_mtx(m, str(tmp_path / "parts"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text.write_mtx(m, str(tmp_path / "one"), single=True)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1 < len(list((tmp_path / "parts").glob("part-*")))
    for name in ("parts", "one"):
        assert text.read_mtx(spark, str(tmp_path / name)).equals(m)
        lines = "".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*"))).split("\n")
        assert lines[0].startswith("%%MatrixMarket") and lines[1] == "500 500 500" and lines[2] == "1 1 0"


def test_relabelled_and_binary_writers(spark, tmp_path):
    m = SparseMatrix(spark.createDataFrame([(0, 1, 5), (2, 0, -3), (1, 1, 7)], "row long, col long, val long").repartition(2), 4, 4)
    new, names = generate.relabelled(m, 9)
    name = {r.id: r.new for r in names.collect()}
    assert sorted(name.values()) == [0, 1, 2, 3] and got(new) == sorted((name[r], name[c], v) for r, c, v in got(m))
    assert binary.write_hkdt(m, str(tmp_path / "h"), "<i8") == 3 and binary.read_hkdt(spark, str(tmp_path / "h"), "<i8").equals(m)
    edges = spark.createDataFrame([(1, 2), (4294967295, 0), (1, 2)], "src long, dst long")
    assert binary.write_edge_list(edges, f"file://{tmp_path}/e") == 3
    assert sorted(map(tuple, binary.read_edge_list(spark, str(tmp_path / "e")).collect())) == [(1, 2), (1, 2), (4294967295, 0)]
    with pytest.raises(Exception, match="unsigned"):
        binary.write_edge_list(spark.createDataFrame([(-1, 2)], "src long, dst long"), str(tmp_path / "bad"))


def test_a_hot_predicate_is_many_files(spark, tmp_path):
    m = SparseMatrix(spark.range(2000).selectExpr("id AS row", "id % 7 AS col", "CASE WHEN id % 10 = 0 THEN 3 ELSE 17 END AS val"), 2000, 7)
    binary.write_edges(m, str(tmp_path / "t"), file_rows=100)
    assert len(list((tmp_path / "t" / "val=17").glob("*.parquet"))) > 10
    back = binary.read_edges(spark, str(tmp_path / "t"), 2000, 7)
    assert back.equals(m)


def test_scramble_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for scale in (1, 5, 10):
        df = spark.range(1 << scale).select(generate._scrambled("id", scale, 3).alias("x"))
        assert df.agg(F.count_distinct("x")).first()[0] == 1 << scale


def test_edge_stream(spark, tmp_path):
    from weft.streaming.edges import current_edges, edge_sink

    source = tmp_path / "in"
    spark.createDataFrame([(1, 2, 3), (1, 2, 3), (4, 5, 6)], "row long, col long, val int").write.parquet(str(source))
    run = lambda: edge_sink(spark.readStream.schema("row long, col long, val int").parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    spark.createDataFrame([(1, 2, 3), (7, 7, 7)], "row long, col long, val int").write.mode("append").parquet(str(source))
    run()
    assert sorted(map(tuple, current_edges(spark, str(tmp_path / "out")).collect())) == [(1, 2, 3), (4, 5, 6), (7, 7, 7)]
