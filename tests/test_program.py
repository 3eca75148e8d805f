import pytest

from weft.plans.compile import can_join, compile_program
from weft.plans.patterns import PATTERNS, Edge, parse_pattern, pattern_program, program_of
from weft.plans.program import ProgramError, parse

POSTER = [(0, 0, 1), (0, 1, 2), (0, 4, 1), (1, 3, 2), (1, 4, 2), (2, 3, 3), (4, 2, 5), (4, 3, 5)]
HEAD, MID = "t\nquery_execution\n", "\nresult_generation\n"


def edges(spark, rows):
    return spark.createDataFrame(rows, "row long, col long, val int")


def test_two_hop_over_hand_graph(spark):
    text = program_of("two hops", [Edge(1, 2, "1"), Edge("2", 3, "1")])
    plan = compile_program(text, edges(spark, POSTER))
    assert [tuple(r) for r in plan.bindings.collect()] == [(1, 3, 2)]
    literal = compile_program(text, edges(spark, POSTER), count_steps=True)
    assert literal.nnz == [2, 1, 1]
    assert [tuple(r) for r in literal.bindings.collect()] == [(1, 3, 2)]
    literal.free()


@pytest.mark.parametrize(("name", "rows"), [("l1_triangle", 9), ("l2_one_hop", 23), ("l3_empty", 0), ("l4_star", 112), ("l5_two_constants", 0), ("l6_path", 0), ("l7_triangle", 5)])
def test_patterns_give_known_counts(spark, sf, name, rows):
    from weft.sources.tables import graph

    program = parse(pattern_program(name))
    assert can_join(program)
    assert compile_program(program, graph(spark, sf)).count() == rows


def test_literal_equals_joined(spark, sf):
    from weft.sources.tables import graph

    g = graph(spark, sf).cache()
    a, b = (sorted(map(tuple, compile_program(pattern_program("l7_triangle"), g, reduce=r).bindings.collect())) for r in (True, False))
    assert a == b and len(a) == 5
    g.unpersist()


def test_bag_joins_and_two_key_filter(spark):
    rows = [(1, 0, 7), (2, 0, 7), *[(i, j, 8) for i in (10, 11, 12) for j in (1, 2)], (10, 0, 9)]
    text = HEAD + "m_1_0 = G ⊗ I^0*7\nm_2_1 = G ⊗ m_1_0.D*8\nm_6_0 = G ⊗ I^0*9" + MID + "join%m_1_0\njoin%m_2_1\nfilter%6=2%m_6_0"
    assert compile_program(text, edges(spark, rows)).count() == 2
    assert compile_program(text.replace("\nfilter%6=2%m_6_0", ""), edges(spark, rows)).count() == 6


def test_long_variable_names_and_comments(spark):
    text = HEAD + "\n# a comment\nm_x12_0 = G ⊗ I^3*2\n" + MID + "join%m_x12_0"
    assert compile_program(text, edges(spark, POSTER)).bindings.columns == ["v0", "vx12"]


def test_times_keeps_values_that_a_match_then_drops(spark):
    text = HEAD + "m_1_0 = G ⊗ I^3*2\nm_1_0 = I^1*5 × m_1_0\nm_1_0 = m_1_0.D ⊗ m_1_0" + MID + "join%m_1_0"
    plan = compile_program(text, edges(spark, POSTER), count_steps=True)
    assert plan.nnz == [1, 1, 0]
    plan.free()


@pytest.mark.parametrize(
    "text",
    [
        "no sections", HEAD + "m_1_0 G" + MID, HEAD + "m_1_0 = G + I^1" + MID, HEAD + "m_1_0 = G ⊗ m_9_9.D*1" + MID, HEAD + "m_1_0 = I^1 × m_2_0" + MID, HEAD + "x = G ⊗ I^1*1" + MID,
        HEAD + "m_1_0 = G ⊗ I^1*1\nm_2_0 = G ⊗ I^1*1\nm_1_0 = m_2_0.D*3 × m_1_0" + MID, HEAD + "m_1_0 = G ⊗ I^1*1" + MID + "foo%m_1_0", HEAD + "m_1_0 = G ⊗ I^1*1" + MID + "join%m_2_0",
        HEAD + "m_1_0 = G ⊗ I^1*1\nm_3_2 = G ⊗ I^1*1" + MID + "join%m_1_0\njoin%m_3_2", HEAD + "m_1_0 = G ⊗ I^1*1" + MID + "join%m_1_0\nfilter%6=1%m_1_0", HEAD + "m_1_0 = G ⊗ I^1*1" + MID + "filter%1=5%m_1_0",
    ],
)
def test_errors_are_told(text):
    with pytest.raises(ProgramError):
        parse(text)


def test_patterns_have_to_connect():
    with pytest.raises(ValueError):
        program_of("x", parse_pattern("?1 3 5 . ?2 3 ?4"))
    assert len(PATTERNS) == 7


def test_steps_are_reported_and_stop_where_nothing_is_left(spark, sf):
    from weft.sources.tables import graph

    edges_ = graph(spark, sf).cache()
    plan = compile_program(pattern_program("l3_empty"), edges_, count_steps=True)
    program = parse(pattern_program("l3_empty"))
    assert plan.stopped and plan.nnz[-1] == 0 and len(plan.steps) < len(program.steps)
    assert [s[0] for s in plan.steps] == [s.line for s in program.steps[: len(plan.steps)]] and all(s[2] >= 0 for s in plan.steps)
    assert plan.bindings.columns == compile_program(program, edges_).bindings.columns and plan.count() == 0
    plan.free()
    full = compile_program(pattern_program("l1_triangle"), edges_, count_steps=True)
    assert not full.stopped and full.count() == 9 and len(full.steps) == len(parse(pattern_program("l1_triangle")).steps)
    full.free()
    # a matrix that is made anew later, or that the result doesn't use, stops nothing
    text = HEAD + "m_1_0 = G ⊗ I^99*1\nm_1_0 = G ⊗ I^1*2" + MID + "join%m_1_0"
    again = compile_program(text, edges(spark, POSTER), count_steps=True)
    assert again.nnz == [0, 1] and not again.stopped and again.count() == 1
    edges_.unpersist()


def test_runner(spark, sf, tmp_path):
    from weft import run
    from weft.operators.matrix import SparseMatrix
    from weft.sources.binary import write_edges
    from weft.sources.tables import graph
    from weft.sources.text import write_mtx

    g = graph(spark, sf)
    write_edges(SparseMatrix(g, 1 << 26, 1 << 26), str(tmp_path / "g"))
    (tmp_path / "q").write_text(pattern_program("l1_triangle"))
    said = []
    for more in ([], ["--repeat", "2"], ["--steps"]):
        out = run.main([str(tmp_path / "g"), str(tmp_path / "q"), *more], spark, said.append)
        assert [r.rows for r in out] == [9] * (2 if "--repeat" in more else 1)
    assert any("imbalance" in x for x in said) and any("entries, " in x and x.startswith("  m_") for x in said)
    small = SparseMatrix(edges(spark, POSTER), 5, 5)
    write_mtx(small, str(tmp_path / "p.mtx"))
    (tmp_path / "h").write_text(program_of("two hops", [Edge(1, 2, "1"), Edge("2", 3, "1")]))
    for more in ([], ["--relabel", "5"]):
        assert [r.rows for r in run.main([str(tmp_path / "p.mtx"), str(tmp_path / "h"), *more], spark, said.append)] == [1]
