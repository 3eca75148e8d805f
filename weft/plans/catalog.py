"""Named queries over the test tables and the SQL they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import functors as f
from weft.functions.semirings import LONG_MAX
from weft.operators import bfs as search
from weft.operators.matrix import SparseMatrix, dense_reduce, merge_all
from weft.operators.ranking import shared_dir
from weft.operators.vector import DenseVector, SparseVector
from weft.sources import tables as t
from weft.sources.generate import EDGE_FACTOR, LINES, PRIME, A, B, C, drop_deleted, kronecker, permute_edges, rename_vertices

from .compile import compile_program, literal_step, result
from .patterns import PATTERNS, parse_pattern, pattern_program, pattern_sql, program_of
from .program import Diag, Result, Step

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The matrices and vectors of the SQL side, by name, in the order they need.
_WITH = {
    "g": t.GRAPH_SQL,
    "os": 'SELECT l_orderkey AS "row", l_suppkey AS "col", CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS val FROM lineitem GROUP BY ALL',
    "op": 'SELECT l_orderkey AS "row", l_partkey AS "col", count(*) AS val FROM lineitem GROUP BY ALL',
    "sp": 'SELECT l_suppkey AS "row", l_partkey AS "col", CAST(max(l_linenumber) AS BIGINT) AS val FROM lineitem GROUP BY ALL',
    "ss": 'SELECT a."col" AS "row", b."col" AS "col", count(*) AS val FROM os a JOIN os b ON a."row" = b."row" GROUP BY ALL',
    "sn": "SELECT s_suppkey AS idx, CAST(s_nationkey AS BIGINT) AS val FROM supplier",
    "sf": "SELECT * FROM sn WHERE val < 5",
    "sh": "SELECT idx, val + 1 AS val FROM sn WHERE val % 2 = 0",
    "n_s": "SELECT max(s_suppkey) + 1 AS n FROM supplier",
}
_NEEDS = {"ss": ["os"], "sf": ["sn"], "sh": ["sn"]}


def _with(names: list[str]) -> str:
    return ", ".join(f"{n} AS MATERIALIZED ({_WITH[n]})" for n in dict.fromkeys(names))


def _query(name: str, sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Register a query; ``uses`` names the matrices that its SQL speaks of."""

    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            wanted = [n for u in uses.split() for n in [*_NEEDS.get(u, []), u]]
            _SQL[name] = f"WITH {_with(wanted)} {sql}" if wanted else sql
        return fn

    return add


def _mat(name: str, make: Callable[[SparkSession, str], SparseMatrix | SparseVector | DenseVector], sql: str, uses: str) -> None:
    _query(name, sql, uses)(lambda spark, d: make(spark, d).df)


def _even(spark: SparkSession, d: str) -> SparseVector:
    return SparseVector(t.supplier_nations(spark, d).df.where("val % 2 = 0").withColumn("val", F.col("val") + 1), t.supplier_nations(spark, d).length)


# -- patterns ---------------------------------------------------------------------------------------
for _name, _text in PATTERNS.items():
    _query(f"bgp_{_name}", pattern_sql(_text, "g"), "g")(lambda spark, d, n=_name: compile_program(pattern_program(n), t.graph_table(spark, d)).bindings)


@_query("bgp_l4_star_literal", pattern_sql(PATTERNS["l4_star"], "g"), "g")
def _literal(spark, d):
    return compile_program(pattern_program("l4_star"), t.graph_table(spark, d), reduce=True).bindings


@_query("bgp_l1_count", f"SELECT count(*) AS n FROM ({pattern_sql(PATTERNS['l1_triangle'], 'g')}) x", "g")
def _counted(spark, d):
    n = compile_program(pattern_program("l1_triangle"), t.graph_table(spark, d)).count()
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


#: Two hops over a graph of nine edges, in full.
_HOPS, _HAND = "?2 3 ?1 . 1 2 ?1", [(0, 0, 1), (0, 1, 2), (0, 4, 1), (1, 3, 2), (1, 4, 2), (2, 3, 3), (4, 2, 5), (4, 3, 5), (2, 1, 2)]


@_query("bgp_hand_graph", f"WITH h(\"row\", \"col\", val) AS (VALUES {', '.join(map(str, _HAND))}) " + pattern_sql(" . ".join(reversed(_HOPS.split(" . "))), "h"))
def _hand(spark, d):
    edges = spark.createDataFrame(_HAND, "row long, col long, val int")
    return compile_program(program_of("two hops", parse_pattern(" . ".join(reversed(_HOPS.split(" . "))))), edges).bindings


@_query("bgp_l3_steps", """SELECT 4 AS steps, n = 0 AS stopped, n AS entries, 0 AS n_rows FROM (SELECT CAST(count(*) AS INTEGER) AS n FROM g WHERE val = 17 AND "col" = 60000009
  AND "row" IN (SELECT "row" FROM g WHERE val = 12 AND "col" IN (SELECT "row" FROM g WHERE val = 17 AND "col" = 2))) x""", "g")
def _steps_taken(spark, d):
    """The empty pattern, step by step: it stops where a step leaves nothing."""
    plan = compile_program(pattern_program("l3_empty"), t.graph_table(spark, d), count_steps=True)
    out = spark.range(1).select(F.lit(len(plan.steps)).alias("steps"), F.lit(plan.stopped).alias("stopped"), F.lit(plan.nnz[-1]).alias("entries"), F.lit(plan.count()).alias("n_rows"))
    plan.free()
    return out


_TYPE, _NATION = 'g.val = 17 AND g."col" = 60000002', 'g.val = 3 AND g."col" = 10000007'
_STEPS = {
    "dsl_g1_const_object": ("m_1_0 = G ⊗ I^60000002*17", f'SELECT g."row", g."col", 1 AS val FROM g WHERE {_TYPE}'),
    "dsl_g2_const_subject": ("m_1_0 = G.T ⊗ I^30000003*14\nm_2_0 = G.T ⊗ I^30000003*3", 'SELECT g."col" AS "row", g."row" AS "col", 1 AS val FROM g WHERE g.val = 3 AND g."row" = 30000003'),
    "dsl_g3_rows_set": ("m_1_0 = G ⊗ I^2*17\nm_2_1 = G ⊗ m_1_0.D*3", 'SELECT g."row", g."col", 1 AS val FROM g WHERE g.val = 3 AND g."col" IN (SELECT "row" FROM g WHERE val = 17 AND "col" = 2)'),
    "dsl_g4_cols_set": ("m_1_0 = G ⊗ I^10000007*3\nm_2_1 = G.T ⊗ m_1_0.D*17", 'SELECT g."col" AS "row", g."row" AS "col", 1 AS val FROM g WHERE g.val = 17 AND g."row" IN (SELECT "row" FROM g WHERE val = 3 AND "col" = 10000007)'),
    "dsl_g5_times": ("m_1_0 = G × I^10000007*2", 'SELECT g."row", g."col", g.val * 2 AS val FROM g WHERE g."col" = 10000007'),
    "dsl_g6_keep_row": ("m_1_0 = G ⊗ I^60000001*17\nm_1_0 = I^30000004*5 × m_1_0", 'SELECT g."row", g."col", 5 AS val FROM g WHERE g.val = 17 AND g."col" = 60000001 AND g."row" = 30000004'),
    "dsl_g7_reduce_rows": ("m_1_0 = G ⊗ I^60000001*17\nm_1_2 = G ⊗ I^10000007*3\nm_1_0 = m_1_2.D ⊗ m_1_0", f'SELECT g."row", g."col", 1 AS val FROM g WHERE g.val = 17 AND g."col" = 60000001 AND g."row" IN (SELECT "row" FROM g WHERE {_NATION})'),
    "dsl_g8_reduce_cols": ("m_2_1 = G × I^10000007*1\nm_0_2 = G.T ⊗ m_2_1.D*17\nm_0_2 = m_0_2 × m_2_1.D", 'SELECT g."col" AS "row", g."row" AS "col", 1 AS val FROM g WHERE g.val = 17 AND g."row" IN (SELECT "row" FROM g WHERE "col" = 10000007)'),
}
for _name, (_steps, _sql) in _STEPS.items():

    @_query(_name, _sql, "g")
    def _dsl(spark, d, steps=_steps):
        lines = steps.split("\n")
        m = lines[-1].split(" = ")[0]
        edges = t.graph(spark, d)
        return compile_program("\n".join(["one step", "query_execution", *lines, "result_generation", f"join%{m}"]), edges, reduce=True).matrices[m]


@_query("dsl_g9_diagonal", 'SELECT DISTINCT "row" AS id FROM g WHERE val = 14', "g")
def _diagonal(spark, d):
    return t.graph(spark, d).where("val = 14").select(F.col("row").alias("id")).distinct()


def _scaled(spark, d, factor: int) -> DataFrame:
    edges = t.graph(spark, d)
    made = {"m_1_0": literal_step(edges, {}, Step("S", "m_1_0", "⊗", constant=60000001, factor=17))}
    made["m_1_0"] = literal_step(edges, made, Step("C", "m_1_0", "×", constant=30000004, factor=factor))
    return literal_step(edges, made, Step("L", "m_1_0", "⊗", diag=Diag("m_1_0", False, None)))


# a later ⊗ matches the ones that a step has left: none if it scaled them
for _factor, _name in ((5, "dsl_times_then_match"), (1, "dsl_match_ones")):
    _query(_name, f'SELECT * FROM (SELECT "row", "col", {_factor} AS val FROM g WHERE val = 17 AND "col" = 60000001 AND "row" = 30000004) x WHERE val = 1', "g")(lambda spark, d, f=_factor: _scaled(spark, d, f))


@_query("join_inner_2col", 'SELECT a."col" AS v0, a."row" AS v1, b."row" AS v2 FROM g a JOIN g b ON a."row" = b."col" WHERE a.val = 3 AND b.val = 9', "g")
def _join2(spark, d):
    g = t.graph(spark, d)
    made = {"m_1_0": g.where("val = 3"), "m_2_1": g.where("val = 9")}
    return result(made, [Result("join", "m_1_0"), Result("join", "m_2_1")])


@_query("filter_cycle", 'SELECT a."col" AS v0, a."row" AS v1, b."row" AS v2 FROM g a JOIN g b ON a."row" = b."col" WHERE a.val = 3 AND b.val = 9 AND EXISTS (SELECT 1 FROM g c WHERE c.val = 12 AND c."row" = b."row" AND c."col" = a."col")', "g")
def _cycle(spark, d):
    g = t.graph(spark, d)
    made = {"m_1_0": g.where("val = 3"), "m_2_1": g.where("val = 9"), "m_6_0": g.where("val = 12")}
    return result(made, [Result("join", "m_1_0"), Result("join", "m_2_1"), Result("filter", "m_6_0", "6", "2")])


@_query("graph_edges_by_predicate", "SELECT val, count(*) AS n FROM g GROUP BY val", "g")
def _edges(spark, d):
    return t.graph(spark, d).groupBy("val").agg(F.count("*").alias("n"))


# -- entries and filters ----------------------------------------------------------------------------
_R = 'SELECT "row", "col", {} FROM os {}'
_mat("mat_apply", lambda s, d: t.orders_suppliers(s, d).apply(lambda v: v * v + 1), _R.format("val * val + 1 AS val", ""), "os")
_mat("mat_cast", lambda s, d: t.orders_suppliers(s, d).cast("double"), _R.format("CAST(val AS DOUBLE) AS val", ""), "os")
_mat("mat_prune", lambda s, d: t.orders_suppliers(s, d).prune(lambda v: v > 20), _R.format("val", "WHERE NOT val > 20"), "os")
_mat("mat_prune_indexed", lambda s, d: t.orders_suppliers(s, d).prune_indexed(lambda r, c, v: (r + c) % 3 == v % 3), _R.format("val", 'WHERE NOT ("row" + "col") % 3 = val % 3'), "os")
_mat("mat_prune_column_dense", lambda s, d: t.orders_suppliers(s, d).prune_column(t.supplier_nations(s, d), lambda a, b: a < b), 'SELECT "row", "col", os.val FROM os JOIN sn ON "col" = idx WHERE NOT os.val < sn.val', "os sn")
_mat("mat_prune_column_sparse", lambda s, d: t.orders_suppliers(s, d).prune_column(t.first_nations(s, d), lambda a, b: a > b), 'SELECT "row", "col", os.val FROM os LEFT JOIN sf ON "col" = idx WHERE idx IS NULL OR NOT os.val > sf.val', "os sf")
_mat("mat_prune_submatrix", lambda s, d: t.shared_orders(s, d).prune_submatrix(DenseVector.iota(s, 20), DenseVector.iota(s, 30, 10)), 'SELECT * FROM ss WHERE NOT ("row" < 20 AND "col" >= 10 AND "col" < 40)', "ss")
_mat("mat_dimapply_col", lambda s, d: t.orders_suppliers(s, d).dim_apply("col", t.supplier_nations(s, d), f.times), 'SELECT "row", "col", os.val * sn.val AS val FROM os JOIN sn ON "col" = idx', "os sn")
_mat("mat_dimapply_row", lambda s, d: t.suppliers_parts(s, d).dim_apply("row", t.first_nations(s, d), f.plus), 'SELECT "row", "col", sp.val + coalesce(sf.val, 0) AS val FROM sp LEFT JOIN sf ON "row" = idx', "sp sf")
_mat("mat_transpose", lambda s, d: t.orders_suppliers(s, d).transpose(), 'SELECT "col" AS "row", "row" AS "col", val FROM os', "os")
_mat("mat_remove_loops", lambda s, d: t.shared_orders(s, d).remove_loops(), 'SELECT * FROM ss WHERE "row" <> "col"', "ss")
_mat("mat_add_loops_scalar", lambda s, d: t.shared_orders(s, d).add_loops(7, replace=True), 'SELECT * FROM ss WHERE "row" <> "col" UNION ALL SELECT i, i, 7 FROM n_s, range(n) x(i)', "ss n_s")
_mat("mat_add_loops_vector", lambda s, d: t.shared_orders(s, d).remove_loops().prune(lambda v: v > 3).add_loops(t.supplier_nations(s, d)), 'SELECT * FROM ss WHERE "row" <> "col" AND NOT val > 3 UNION ALL SELECT idx, idx, val FROM sn', "ss sn")
_mat("mat_find", lambda s, d: t.orders_parts(s, d), 'SELECT * FROM op', "op")
_mat("mat_element", lambda s, d: t.shared_orders(s, d)._new(t.shared_orders(s, d).element(3, 5)), 'SELECT * FROM ss WHERE "row" = 3 AND "col" = 5', "ss")
_mat("mat_scale_dense", lambda s, d: t.shared_orders(s, d).prune(lambda v: v < 3).ewise_scale(t.shared_orders(s, d).df), 'SELECT "row", "col", val * val AS val FROM ss WHERE NOT val < 3', "ss")


@_query("mat_update_dense", 'SELECT "row", "col", CASE WHEN "row" = "col" THEN val ELSE val + 100 END AS val FROM ss', "ss")
def _update(spark, d):
    ss = t.shared_orders(spark, d)
    return ss.remove_loops().apply(lambda v: F.lit(100).cast("long")).update_dense(ss.df, f.plus)


@_query("mat_dense_reduce", 'SELECT "row" AS idx, max(val) AS val FROM ss GROUP BY "row"', "ss")
def _dense_reduce(spark, d):
    return dense_reduce(t.shared_orders(spark, d).df, "row", "max")


#: Vertices of graphs whose numbers are keys of the tables.
_N = 1 << 26


def _part_edges(spark: SparkSession, d: str) -> DataFrame:
    """An edge for each line item, from its part to its supplier."""
    return t.table(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("src"), F.col("l_suppkey").cast("long").alias("dst"))


_mat("mat_from_vectors_max", lambda s, d: SparseMatrix.from_vectors(t.supplier_nations(s, d), t.supplier_nations(s, d).apply(lambda v: v % 3), DenseVector.iota(s, t.supplier_nations(s, d).length), 25, 3, "max"), 'SELECT val AS "row", val % 3 AS "col", max(idx) AS val FROM sn GROUP BY 1, 2', "sn")
_mat("mat_from_vectors_scalar", lambda s, d: SparseMatrix.from_vectors(t.supplier_nations(s, d), t.supplier_nations(s, d).apply(lambda v: v % 3), 1, 25, 3, "sum"), 'SELECT val AS "row", val % 3 AS "col", CAST(count(*) AS BIGINT) AS val FROM sn GROUP BY 1, 2', "sn")
_mat("mat_from_edges", lambda s, d: SparseMatrix.from_edges(_part_edges(s, d), _N, remove_loops=True), 'SELECT l_partkey AS "row", l_suppkey AS "col", count(*) AS val FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2', "")
_mat("mat_from_edges_bool", lambda s, d: SparseMatrix.from_edges(_part_edges(s, d), _N, count=False), 'SELECT DISTINCT l_partkey AS "row", l_suppkey AS "col", true AS val FROM lineitem', "")
_query("drop_deleted", "SELECT l_partkey - 100 AS src, l_suppkey - 3 AS dst, count(*) AS n FROM lineitem WHERE l_partkey >= 100 AND l_suppkey >= 3 GROUP BY 1, 2")(lambda s, d: drop_deleted(_part_edges(s, d).select((F.col("src") - 100).alias("src"), (F.col("dst") - 3).alias("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n")))

# -- reductions -------------------------------------------------------------------------------------
for _op, _agg in {"sum": "CAST(sum(val) AS BIGINT)", "min": "min(val)", "max": "max(val)"}.items():
    _mat(f"mat_reduce_row_{_op}", lambda s, d, op=_op: t.orders_suppliers(s, d).reduce("row", op, identity=-1), f'SELECT o_orderkey AS idx, coalesce(v, -1) AS val FROM orders LEFT JOIN (SELECT "row", {_agg} AS v FROM os GROUP BY 1) ON "row" = o_orderkey', "os")
    _mat(f"mat_reduce_col_{_op}", lambda s, d, op=_op: t.orders_suppliers(s, d).reduce("col", op, identity=-1), f'SELECT s_suppkey AS idx, coalesce(v, -1) AS val FROM supplier LEFT JOIN (SELECT "col", {_agg} AS v FROM os GROUP BY 1) ON "col" = s_suppkey', "os")
_mat("mat_reduce_row_or", lambda s, d: t.orders_suppliers(s, d).reduce("row", "or", lambda v: v > 40), 'SELECT o_orderkey AS idx, coalesce(v, false) AS val FROM orders LEFT JOIN (SELECT "row", bool_or(val > 40) AS v FROM os GROUP BY 1) ON "row" = o_orderkey', "os")
for _op, _agg in {"and": "bool_and(val > 5)", "xor": "count(*) FILTER (val > 5) % 2 = 1", "band": "bit_and(val)", "bor": "bit_or(val)", "bxor": "bit_xor(val)"}.items():
    _fill = {"and": "true", "xor": "false", "band": "-1", "bor": "0", "bxor": "0"}[_op]
    _mat(f"mat_reduce_col_{_op}", lambda s, d, op=_op: t.orders_suppliers(s, d).reduce("col", op, (lambda v: v > 5) if op in ("and", "xor") else f.identity), f'SELECT s_suppkey AS idx, coalesce(v, {_fill}) AS val FROM supplier LEFT JOIN (SELECT "col", {_agg} AS v FROM os GROUP BY 1) ON "col" = s_suppkey', "os")
_mat("mat_masked_reduce_in", lambda s, d: t.suppliers_parts(s, d).masked_reduce(t.first_nations(s, d), "sum"), 'SELECT p_partkey AS idx, coalesce(v, 0) AS val FROM part LEFT JOIN (SELECT "col", CAST(sum(sp.val) AS BIGINT) AS v FROM sp WHERE "row" IN (SELECT idx FROM sf) GROUP BY 1) ON "col" = p_partkey', "sp sf")
_mat("mat_masked_reduce_out", lambda s, d: t.suppliers_parts(s, d).masked_reduce(t.first_nations(s, d), "sum", exclude=True), 'SELECT p_partkey AS idx, coalesce(v, 0) AS val FROM part LEFT JOIN (SELECT "col", CAST(sum(sp.val) AS BIGINT) AS v FROM sp WHERE "row" NOT IN (SELECT idx FROM sf) GROUP BY 1) ON "col" = p_partkey', "sp sf")
_mat("mat_nnz_by_col", lambda s, d: t.orders_suppliers(s, d).nnz_by("col"), 'SELECT s_suppkey AS idx, coalesce(v, 0) AS val FROM supplier LEFT JOIN (SELECT "col", count(*) AS v FROM os GROUP BY 1) ON "col" = s_suppkey', "os")
_query("mat_nnz", "SELECT (SELECT max(o_orderkey) + 1 FROM orders) AS nrow, n AS ncol, (SELECT count(*) FROM os) AS nnz FROM n_s", "os n_s")(lambda s, d: t.orders_suppliers(s, d).shape_info())
_query("mat_bandwidth", 'SELECT coalesce(max("col" - "row"), -1) AS bandwidth FROM ss WHERE "row" <= "col"', "ss")(lambda s, d: t.shared_orders(s, d).bandwidth())
_query("mat_profile", 'SELECT CAST(sum(coalesce(i - m, 1)) AS BIGINT) AS profile FROM (SELECT i FROM n_s, range(n) x(i)) LEFT JOIN (SELECT "col", min("row") AS m FROM ss WHERE "row" <= "col" GROUP BY 1) ON "col" = i', "ss n_s")(lambda s, d: t.shared_orders(s, d).profile())
_query("mat_limits", 'SELECT min("row") AS min_row, max("row") AS max_row, min("col") AS min_col, max("col") AS max_col FROM os', "os")(lambda s, d: t.orders_suppliers(s, d).limits())
_query("mat_load_imbalance")(lambda s, d: t.orders_suppliers(s, d).load_imbalance())
_SAME = 'SELECT count(*) = 0 AS same FROM (SELECT * FROM ss) a FULL JOIN (SELECT "col" AS "row", "row" AS "col", {} AS val FROM ss) b ON a."row" = b."row" AND a."col" = b."col" WHERE a.val IS DISTINCT FROM b.val'
for _name, _change in (("mat_equals", lambda v: v), ("mat_equals_not", lambda v: F.when(v == 1, 2).otherwise(v))):
    _query(_name, _SAME.format("val" if _name == "mat_equals" else "CASE WHEN val = 1 THEN 2 ELSE val END"), "ss")(lambda s, d, f=_change: s.range(1).select(F.lit(t.shared_orders(s, d).equals(t.shared_orders(s, d).transpose().apply(f))).alias("same")))
for _name, _change, _other in (("vec_equals", lambda v: v, "val"), ("vec_equals_not", lambda v: F.when(v == 3, 4).otherwise(v), "CASE WHEN val = 3 THEN 4 ELSE val END")):
    _query(_name, f"SELECT count(*) = 0 AS same FROM sn WHERE val <> {_other}", "sn")(lambda s, d, f=_change: s.range(1).select(F.lit(t.supplier_nations(s, d).equals(t.supplier_nations(s, d).apply(f))).alias("same")))
_mat("mat_reduce_col_prod", lambda s, d: t.suppliers_parts(s, d).reduce("col", "prod", lambda v: v % 2 + 1), 'SELECT p_partkey AS idx, coalesce(v, 1.0) AS val FROM part LEFT JOIN (SELECT "col", product(val % 2 + 1) AS v FROM sp GROUP BY 1) ON "col" = p_partkey', "sp")
_mat("mat_reduce_sparse", lambda s, d: t.suppliers_parts(s, d).prune(lambda v: v < 7).reduce_sparse("col", "sum"), 'SELECT "col" AS idx, CAST(sum(val) AS BIGINT) AS val FROM sp WHERE NOT val < 7 GROUP BY 1', "sp")
_query("mat_product_nnz_by_part", 'SELECT CAST(floor("col" * 4 / n) AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS nnz FROM ss, n_s GROUP BY 1', "ss n_s")(lambda s, d: t.orders_suppliers(s, d).transpose().product_nnz_by_part(t.orders_suppliers(s, d), 4, approximate=False))
_mat("mat_product_nnz", lambda s, d: t.orders_suppliers(s, d).transpose().product_nnz(t.orders_suppliers(s, d)), 'SELECT i AS idx, coalesce(v, 0) AS val FROM (SELECT i FROM n_s, range(n) x(i)) LEFT JOIN (SELECT "col", count(*) AS v FROM ss GROUP BY 1) ON "col" = i', "ss n_s")

# -- elementwise ------------------------------------------------------------------------------------
_pair = lambda s, d: (t.shared_orders(s, d).prune(lambda v: v % 2 == 0), t.shared_orders(s, d).prune(lambda v: v % 3 == 0))
_E = '(SELECT * FROM ss WHERE NOT val % 2 = 0) a {} JOIN (SELECT * FROM ss WHERE NOT val % 3 = 0) b ON a."row" = b."row" AND a."col" = b."col"'
_K = 'coalesce(a."row", b."row") AS "row", coalesce(a."col", b."col") AS "col"'


def _ewise(name: str, make, value: str, how: str, where: str = "") -> None:
    _mat(name, lambda s, d: make(*_pair(s, d)), f"SELECT {_K}, {value} AS val FROM {_E.format(how)} {where}", "ss")


_ewise("ewise_add", lambda a, b: a + b, "coalesce(a.val, 0) + coalesce(b.val, 0)", "FULL")
_ewise("ewise_mult", lambda a, b: a.ewise_mult(b), "a.val * b.val", "INNER")
_ewise("ewise_mult_exclude", lambda a, b: a.ewise_mult(b, exclude=True), "a.val", "LEFT", "WHERE b.val IS NULL")
_ewise("ewise_not", lambda a, b: a.ewise_not(b, f.minus, 9), "a.val - 9", "LEFT", "WHERE b.val IS NULL")
_ewise("ewise_apply_inner", lambda a, b: a.ewise_apply(b, f.plus, lambda x, y: x > 5), "a.val + b.val", "INNER", "WHERE a.val > 5")
_ewise("ewise_apply_left", lambda a, b: a.ewise_apply(b, f.plus, other_nulls=True, other_null=100), "a.val + coalesce(b.val, 100)", "LEFT")
_ewise("ewise_apply_right", lambda a, b: a.ewise_apply(b, f.maximum, nulls=True, null=7), "greatest(coalesce(a.val, 7), b.val)", "RIGHT")
_ewise("ewise_apply_full", lambda a, b: a.ewise_apply(b, f.abs_diff, nulls=True, other_nulls=True), "abs(coalesce(a.val, 0) - coalesce(b.val, 0))", "FULL")
_ewise("ewise_apply_nointersect", lambda a, b: a.ewise_apply(b, f.plus, nulls=True, other_nulls=True, intersect=False), "coalesce(a.val, b.val)", "FULL", "WHERE a.val IS NULL OR b.val IS NULL")
_mat("merge_all_max", lambda s, d: merge_all([*_pair(s, d), t.shared_orders(s, d).apply(lambda v: v - 1)], "select_max"), 'SELECT "row", "col", max(val) AS val FROM (SELECT * FROM ss WHERE NOT val % 2 = 0 UNION ALL SELECT * FROM ss WHERE NOT val % 3 = 0 UNION ALL SELECT "row", "col", val - 1 FROM ss) GROUP BY 1, 2', "ss")

# -- products ---------------------------------------------------------------------------------------
_M = 'SELECT a."col" AS "row", b."col" AS "col", {} AS val FROM os a JOIN os b ON a."row" = b."row" GROUP BY 1, 2'
for _ring, _v in {
    "plus_times": "CAST(sum(a.val * b.val) AS BIGINT)", "min_plus": "min(a.val + b.val)", "select_max": "max(a.val * b.val)", "select_2nd": "max(b.val)", "bool_max": "max(b.val)",
    "rdf": "max(CASE WHEN a.val <> 0 AND a.val = b.val THEN 1 ELSE 0 END)", "or_and": "bool_or(a.val <> 0 AND b.val <> 0)",
}.items():
    _mat(f"mxm_{_ring}", lambda s, d, ring=_ring: t.orders_suppliers(s, d).transpose().mxm(t.orders_suppliers(s, d), ring), _M.format(_v), "os")
_mat("mxm_copy_2nd", lambda s, d: t.orders_suppliers(s, d).mxm(SparseMatrix(t.supplier_nations(s, d).df.select(F.col("idx").alias("row"), F.col("idx").alias("col"), "val"), t.supplier_nations(s, d).length, t.supplier_nations(s, d).length), "copy_2nd"), 'SELECT "row", "col", sn.val FROM os JOIN sn ON "col" = idx', "os sn")
_mat("mxm_copy_1st", lambda s, d: t.orders_suppliers(s, d).mxm(SparseMatrix(t.supplier_nations(s, d).df.select(F.col("idx").alias("row"), F.col("idx").alias("col"), "val"), t.supplier_nations(s, d).length, t.supplier_nations(s, d).length), "copy_1st"), 'SELECT * FROM os', "os")
_mat("mxm_square", lambda s, d: t.shared_orders_tiled(s, d).square(), 'SELECT a."row", b."col", CAST(sum(a.val * b.val) AS BIGINT) AS val FROM ss a JOIN ss b ON a."col" = b."row" GROUP BY 1, 2', "ss")
_mat("mxm_tiled", lambda s, d: t.orders_suppliers(s, d).transpose().mxm_tiled(t.orders_suppliers(s, d), 64), _M.format("CAST(sum(a.val * b.val) AS BIGINT)"), "os")
_mat("mxm_abt", lambda s, d: t.suppliers_parts(s, d).mxm(t.suppliers_parts(s, d).transpose()), 'SELECT a."row", b."row" AS "col", CAST(sum(a.val * b.val) AS BIGINT) AS val FROM sp a JOIN sp b ON a."col" = b."col" GROUP BY 1, 2', "sp")
_mat("mxm_accumulate", lambda s, d: t.shared_orders(s, d).mxm_add(t.orders_suppliers(s, d).transpose(), t.orders_suppliers(s, d)), 'SELECT "row", "col", CAST(sum(val) AS BIGINT) AS val FROM (SELECT * FROM ss UNION ALL SELECT a."col", b."col", a.val * b.val FROM os a JOIN os b ON a."row" = b."row") GROUP BY 1, 2', "ss")
_mat("mxv_dense_plus_times", lambda s, d: t.orders_suppliers(s, d).mxv(t.supplier_nations(s, d)), 'SELECT o_orderkey AS idx, coalesce(v, 0) AS val FROM orders LEFT JOIN (SELECT "row", CAST(sum(os.val * sn.val) AS BIGINT) AS v FROM os JOIN sn ON "col" = idx GROUP BY 1) ON "row" = o_orderkey', "os sn")
_mat("mxv_dense_min_plus", lambda s, d: t.orders_suppliers(s, d).mxv(t.supplier_nations(s, d), "min_plus"), f'SELECT o_orderkey AS idx, coalesce(v, {LONG_MAX}) AS val FROM orders LEFT JOIN (SELECT "row", min(os.val + sn.val) AS v FROM os JOIN sn ON "col" = idx GROUP BY 1) ON "row" = o_orderkey', "os sn")
_mat("mxv_sparse_plus_times", lambda s, d: t.orders_suppliers(s, d).mxv(t.first_nations(s, d)), 'SELECT "row" AS idx, CAST(sum(os.val * sf.val) AS BIGINT) AS val FROM os JOIN sf ON "col" = idx GROUP BY 1', "os sf")
_mat("mxv_sparse_select_max", lambda s, d: t.orders_suppliers(s, d).mxv(t.first_nations(s, d), "select_max"), 'SELECT "row" AS idx, max(os.val * sf.val) AS val FROM os JOIN sf ON "col" = idx GROUP BY 1', "os sf")
_mat("mxv_sparse_index_is_value", lambda s, d: t.orders_suppliers(s, d).mxv(t.first_nations(s, d), "bool_max", index_is_value=True), 'SELECT "row" AS idx, max(idx) AS val FROM os JOIN sf ON "col" = idx GROUP BY 1', "os sf")

# -- top k, indexing --------------------------------------------------------------------------------
_RANK = 'SELECT *, row_number() OVER (PARTITION BY "col" ORDER BY val DESC, "row") AS r FROM os'
_mat("kselect", lambda s, d: t.orders_suppliers(s, d).kselect(5), f'SELECT "col" AS idx, min(val) AS val FROM ({_RANK}) WHERE r <= 5 GROUP BY 1', "os")
_mat("kselect_short", lambda s, d: t.orders_parts(s, d).kselect(1000), 'SELECT "col" AS idx, min(val) AS val FROM op GROUP BY 1', "op")
_mat("kselect_sparse", lambda s, d: t.orders_suppliers(s, d).kselect(5, t.first_nations(s, d)), f'SELECT "col" AS idx, min(val) AS val FROM ({_RANK}) WHERE r <= 5 AND "col" IN (SELECT idx FROM sf) GROUP BY 1', "os sf")
_mat("mcl_prune_select_recover", lambda s, d: t.shared_orders(s, d).prune_recover_select(2, 4, 6, 40.0), """
SELECT "row", "col", val FROM (
  SELECT *, CASE WHEN n < 6 AND s < 40 THEN rth WHEN n > 4 THEN CASE WHEN n2 < 6 AND s2 < 40 THEN rth ELSE sth END ELSE 2 END AS cut FROM (
    SELECT *, count(*) FILTER (val > 2 AND val >= sth) OVER (PARTITION BY "col") AS n2, coalesce(sum(val) FILTER (val > 2 AND val >= sth) OVER (PARTITION BY "col"), 0) AS s2 FROM (
      SELECT *, count(*) FILTER (val > 2) OVER (PARTITION BY "col") AS n, coalesce(sum(val) FILTER (val > 2) OVER (PARTITION BY "col"), 0) AS s,
        min(val) FILTER (r <= 6) OVER (PARTITION BY "col") AS rth, min(val) FILTER (r <= 4) OVER (PARTITION BY "col") AS sth
      FROM (SELECT *, row_number() OVER (PARTITION BY "col" ORDER BY val DESC, "row") AS r FROM ss))))
WHERE val >= cut""", "ss")  # fmt: skip
_mat("mcl_step", lambda s, d: (ss := t.shared_orders_tiled(s, d)).mcl_step(ss, 50, 5, 0, 0.0), """
SELECT "row", "col", val FROM (SELECT *, CASE WHEN n > 5 THEN sth ELSE 50 END AS cut FROM (
  SELECT *, count(*) FILTER (val > 50) OVER (PARTITION BY "col") AS n, min(val) FILTER (r <= 5) OVER (PARTITION BY "col") AS sth FROM (
    SELECT *, row_number() OVER (PARTITION BY "col" ORDER BY val DESC, "row") AS r FROM (
      SELECT a."row", b."col", CAST(sum(a.val * b.val) AS BIGINT) AS val FROM ss a JOIN ss b ON a."col" = b."row" GROUP BY 1, 2))))
WHERE val >= cut""", "ss")  # fmt: skip
_mat("subsref", lambda s, d: t.shared_orders(s, d)[DenseVector.iota(s, 20, 5), DenseVector.iota(s, 10)], 'SELECT "row" - 5 AS "row", "col", val FROM ss WHERE "row" BETWEEN 5 AND 24 AND "col" < 10', "ss")
_mat("subsref_permute", lambda s, d: t.shared_orders(s, d)[t.supplier_nations(s, d), t.supplier_nations(s, d)], 'SELECT r.idx AS "row", c.idx AS "col", ss.val FROM ss JOIN sn r ON "row" = r.val JOIN sn c ON "col" = c.val', "ss sn")
_mat("subsref_columns", lambda s, d: t.orders_suppliers(s, d).columns(t.supplier_nations(s, d)), 'SELECT "row", idx AS "col", os.val FROM os JOIN sn ON "col" = sn.val', "os sn")
_mat("spasgn", lambda s, d: t.shared_orders(s, d).assign(DenseVector.iota(s, 4, 2), DenseVector.iota(s, 4, 5), SparseMatrix(s.range(4).select(F.col("id").alias("row"), F.col("id").alias("col"), (F.col("id") - 50).alias("val")), 4, 4)), 'SELECT * FROM ss WHERE NOT ("row" BETWEEN 2 AND 5 AND "col" BETWEEN 5 AND 8) UNION ALL SELECT i + 2, i + 5, i - 50 FROM range(4) x(i)', "ss")
_mat("split_concat_columns", lambda s, d: SparseMatrix.concat_columns(t.orders_suppliers(s, d).split_columns(3)), "SELECT * FROM os", "os")

# -- vectors ----------------------------------------------------------------------------------------
_mat("vec_apply", lambda s, d: t.supplier_nations(s, d).apply(lambda v: v * 3), "SELECT idx, val * 3 AS val FROM sn", "sn")
_mat("vec_apply_indexed", lambda s, d: t.supplier_nations(s, d).apply_indexed(f.plus), "SELECT idx, val + idx AS val FROM sn", "sn")
_mat("vec_apply_masked", lambda s, d: t.supplier_nations(s, d).apply(lambda v: v - 100, t.first_nations(s, d)), "SELECT idx, CASE WHEN val < 5 THEN val - 100 ELSE val END AS val FROM sn", "sn")
_mat("vec_set_to_index", lambda s, d: t.first_nations(s, d).set_to_index(), "SELECT idx, idx AS val FROM sf", "sf")
_mat("vec_find", lambda s, d: t.supplier_nations(s, d).find(lambda v: v > 20), "SELECT * FROM sn WHERE val > 20", "sn")
_mat("vec_find_value", lambda s, d: t.supplier_nations(s, d).find(7), "SELECT * FROM sn WHERE val = 7", "sn")
_mat("vec_find_indices", lambda s, d: t.supplier_nations(s, d).find_indices(lambda v: v > 20), "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, idx AS val FROM sn WHERE val > 20", "sn")
_mat("vec_find_values", lambda s, d: t.supplier_nations(s, d).find_values(lambda v: v > 20), "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, val FROM sn WHERE val > 20", "sn")
_mat("vec_to_dense", lambda s, d: t.first_nations(s, d).to_dense(-3), "SELECT idx, CASE WHEN val < 5 THEN val ELSE -3 END AS val FROM sn", "sn")
_mat("vec_select", lambda s, d: _even(s, d).select(t.supplier_nations(s, d), lambda v: v < 9), "SELECT sh.idx, sh.val FROM sh JOIN sn USING (idx) WHERE sn.val < 9", "sn sh")
_mat("vec_select_apply", lambda s, d: _even(s, d).select_apply(t.supplier_nations(s, d), lambda v: v < 9, f.times), "SELECT idx, sh.val * sn.val AS val FROM sh JOIN sn USING (idx) WHERE sn.val < 9", "sn sh")
_mat("vec_drop_listed", lambda s, d: _even(s, d).drop_listed(t.first_nations(s, d), lambda v: v - 1, False), "SELECT * FROM sh WHERE val - 1 NOT IN (SELECT val FROM sf)", "sh sf")
_mat("vec_drop_listed_index", lambda s, d: _even(s, d).drop_listed(t.first_nations(s, d), lambda v: v, True), "SELECT * FROM sh WHERE val NOT IN (SELECT idx FROM sf)", "sh sf")
_mat("vec_add_dense", lambda s, d: t.supplier_nations(s, d) + t.supplier_nations(s, d), "SELECT idx, val + val AS val FROM sn", "sn")
_mat("vec_sub_dense_sparse", lambda s, d: t.supplier_nations(s, d) - t.first_nations(s, d), "SELECT idx, CASE WHEN val < 5 THEN 0 ELSE val END AS val FROM sn", "sn")
_U = "FROM sf a FULL JOIN sh b USING (idx)"
_mat("vec_add_sparse", lambda s, d: t.first_nations(s, d) + _even(s, d), f"SELECT idx, coalesce(a.val, 0) + coalesce(b.val, 0) AS val {_U}", "sf sh")
_mat("vec_sub_sparse", lambda s, d: t.first_nations(s, d) - _even(s, d), f"SELECT idx, coalesce(a.val, 0) - coalesce(b.val, 0) AS val {_U}", "sf sh")
_mat("vec_combine", lambda s, d: t.supplier_nations(s, d).combine(_even(s, d), f.times, lambda a, b: b > 5), "SELECT idx, CASE WHEN sh.val > 5 THEN sn.val * sh.val ELSE sn.val END AS val FROM sn LEFT JOIN sh USING (idx)", "sn sh")
_mat("vec_combine_nulls", lambda s, d: t.supplier_nations(s, d).combine(_even(s, d), f.plus, apply_nulls=True, null=1000), "SELECT idx, sn.val + coalesce(sh.val, 1000) AS val FROM sn LEFT JOIN sh USING (idx)", "sn sh")
_mat("vec_ewise_apply_inner", lambda s, d: t.first_nations(s, d).ewise_apply(_even(s, d), f.plus), "SELECT idx, a.val + b.val AS val FROM sf a JOIN sh b USING (idx)", "sf sh")
_mat("vec_ewise_apply_left", lambda s, d: t.first_nations(s, d).ewise_apply(_even(s, d), f.plus, other_nulls=True, other_null=50), "SELECT idx, a.val + coalesce(b.val, 50) AS val FROM sf a LEFT JOIN sh b USING (idx)", "sf sh")
_mat("vec_ewise_apply_full", lambda s, d: t.first_nations(s, d).ewise_apply(_even(s, d), f.plus, nulls=True, other_nulls=True, null=7, other_null=50), f"SELECT idx, coalesce(a.val, 7) + coalesce(b.val, 50) AS val {_U}", "sf sh")
_mat("vec_ewise_apply_nointersect", lambda s, d: t.first_nations(s, d).ewise_apply(_even(s, d), f.plus, nulls=True, other_nulls=True, intersect=False), f"SELECT idx, coalesce(a.val, 0) + coalesce(b.val, 0) AS val {_U} WHERE a.val IS NULL OR b.val IS NULL", "sf sh")
_mat("vec_ewise_mult", lambda s, d: _even(s, d).ewise_mult(t.supplier_nations(s, d)), "SELECT idx, sh.val * sn.val AS val FROM sh JOIN sn USING (idx) WHERE sn.val <> 0", "sh sn")
_mat("vec_ewise_mult_exclude", lambda s, d: _even(s, d).ewise_mult(t.supplier_nations(s, d), exclude=True), "SELECT idx, sh.val FROM sh JOIN sn USING (idx) WHERE sn.val = 0", "sh sn")
_mat("vec_setminus", lambda s, d: t.first_nations(s, d).setminus(_even(s, d)), "SELECT * FROM sf WHERE idx NOT IN (SELECT idx FROM sh)", "sf sh")
_mat("vec_put", lambda s, d: t.supplier_nations(s, d).put(_even(s, d)), "SELECT idx, coalesce(sh.val, sn.val) AS val FROM sn LEFT JOIN sh USING (idx)", "sn sh")
_mat("vec_scatter", lambda s, d: t.supplier_nations(s, d).scatter(_even(s, d), lambda v, i: v, lambda v, i: i), "SELECT idx, coalesce(x.v, sn.val) AS val FROM sn LEFT JOIN (SELECT val AS k, max(idx) AS v FROM sh GROUP BY 1) x ON idx = k", "sn sh")
_mat("vec_gather", lambda s, d: t.supplier_nations(s, d).gather(_even(s, d), lambda v, i: v * 6, -1), "SELECT a.idx, coalesce(b.val, -1) AS val FROM sh a LEFT JOIN sn b ON b.idx = a.val * 6", "sn sh")
_mat("vec_invert", lambda s, d: t.supplier_nations(s, d).to_sparse().invert(25), "SELECT val AS idx, min(idx) AS val FROM sn GROUP BY 1", "sn")
_mat("vec_unique", lambda s, d: t.supplier_nations(s, d).unique(), "SELECT min(idx) AS idx, val FROM sn GROUP BY val", "sn")
_mat("vec_subsref_sparse", lambda s, d: t.first_nations(s, d)[t.supplier_nations(s, d)], "SELECT a.idx, coalesce(b.val, 0) AS val FROM sn a LEFT JOIN sf b ON b.idx = a.val", "sn sf")
_mat("vec_subsref_dense", lambda s, d: t.supplier_nations(s, d)[t.supplier_nations(s, d)], "SELECT a.idx, b.val FROM sn a JOIN sn b ON b.idx = a.val", "sn")
_mat("vec_nziota", lambda s, d: t.first_nations(s, d).nziota(3), "SELECT idx, row_number() OVER (ORDER BY idx) + 2 AS val FROM sf", "sf")
_mat("vec_iota", lambda s, d: DenseVector.iota(s, 50, 7), "SELECT i AS idx, i + 7 AS val FROM range(50) x(i)", "")
_mat("vec_concatenate", lambda s, d: DenseVector.concatenate([t.supplier_nations(s, d), DenseVector.iota(s, 9)]), "SELECT * FROM sn UNION ALL SELECT n + i, i FROM n_s, range(9) x(i)", "sn n_s")
_mat("vec_build_sum", lambda s, d: SparseVector.build(t.supplier_nations(s, d).df.select(F.col("val").alias("idx"), F.col("idx").alias("val")), 25), "SELECT val AS idx, CAST(sum(idx) AS BIGINT) AS val FROM sn GROUP BY 1", "sn")
_mat("vec_build_first", lambda s, d: SparseVector.build(t.supplier_nations(s, d).df.select(F.col("val").alias("idx"), F.col("idx").alias("val")), 25, "first"), "SELECT val AS idx, min(idx) AS val FROM sn GROUP BY 1", "sn")
_mat("vec_set_element", lambda s, d: t.first_nations(s, d).delete(3).set(4, 99), "SELECT * FROM sf WHERE idx NOT IN (3, 4) UNION ALL SELECT 4, 99", "sf")
_query("vec_sort", "SELECT row_number() OVER (ORDER BY val, idx) - 1 AS pos, val, idx FROM sn", "sn")(lambda s, d: t.supplier_nations(s, d).sort())
_query("vec_reduce", "SELECT CAST(sum(val * val) AS BIGINT) AS val FROM sn", "sn")(lambda s, d: t.supplier_nations(s, d).reduce("sum", lambda v: v * v))
_query("vec_reduce_empty", "SELECT CAST(0 AS BIGINT) AS val")(lambda s, d: t.first_nations(s, d).reset().reduce("sum"))
_query("vec_count", "SELECT count(*) FILTER (val > 10) AS n FROM sn", "sn")(lambda s, d: t.supplier_nations(s, d).count(lambda v: v > 10))
_query("vec_min_element", "SELECT idx, val FROM sn ORDER BY val, idx LIMIT 1", "sn")(lambda s, d: t.supplier_nations(s, d).min_element())
_query("vec_random_permutation")(lambda s, d: t.supplier_nations(s, d).random_permutation(5).df)
_query("vec_sample_candidates")(lambda s, d: t.supplier_nations(s, d).sample_candidates(64, 5).df)
_query("vec_permutation_is_one", "SELECT val, count(*) AS n FROM sn GROUP BY 1", "sn")(lambda s, d: t.supplier_nations(s, d).random_permutation(5).df.groupBy("val").agg(F.count("*").alias("n")))


_mat("vec_dense_set", lambda s, d: t.supplier_nations(s, d).set(4, 99), "SELECT idx, CASE WHEN idx = 4 THEN 99 ELSE val END AS val FROM sn", "sn")
_query("vec_dense_get", "SELECT * FROM sn WHERE idx = 6", "sn")(lambda s, d: t.supplier_nations(s, d).get(6))
_query("vec_candidates_in_range", "SELECT CAST(64 AS BIGINT) AS n, CAST(0 AS BIGINT) AS outside FROM n_s", "n_s")(lambda s, d: t.supplier_nations(s, d).sample_candidates(64, 5).df.agg(F.count("*").alias("n"), F.count_if((F.col("val") < 0) | (F.col("val") >= t.supplier_nations(s, d).length)).alias("outside")))


# -- functions --------------------------------------------------------------------------------------
@_query("functors", """SELECT "row", "col", 5 AS f_constant, val AS f_identity, 1.0 / val AS f_inverse, CAST(pow(val, 2) AS DOUBLE) AS f_power, greatest(val, 9) AS f_max, least(val, 9) AS f_min,
  CASE WHEN val <> 9 THEN 77 ELSE val END AS f_differ, val & 6 AS f_and, val | 6 AS f_or, xor(val, 6) AS f_bxor, (val > 5) <> ("row" > "col") AS f_xor, abs(val - 9) AS f_absdiff, val = 9 AS f_equal,
  CASE WHEN val <> 0 AND val = 9 THEN 1 ELSE 0 END AS f_match, CAST((val * 300) & 255 AS INTEGER) AS f_wrap FROM ss""", "ss")
def _functors(spark, d):
    v, n = F.col("val"), F.lit(9)
    return t.shared_orders(spark, d).df.select(
        "row", "col", f.constant(5)(v).alias("f_constant"), f.identity(v).alias("f_identity"), f.safe_inverse(v).alias("f_inverse"), f.exponentiate(v, F.lit(2)).alias("f_power"), f.maximum(v, n).alias("f_max"),
        f.minimum(v, n).alias("f_min"), f.set_if_not_equal(77)(v, n).alias("f_differ"), f.bitwise_and(v, F.lit(6)).alias("f_and"), f.bitwise_or(v, F.lit(6)).alias("f_or"), f.bitwise_xor(v, F.lit(6)).alias("f_bxor"),
        f.logical_xor(v > 5, F.col("row") > F.col("col")).alias("f_xor"), f.abs_diff(v, n).alias("f_absdiff"), f.equal(v, n).alias("f_equal"), f.match_predicate(v, n).alias("f_match"), f.wrap8(v * 300).alias("f_wrap"),
    )


@_query("functor_random_choice", 'SELECT "row", "col", true AS one_of_both FROM ss', "ss")
def _choice(spark, d):
    """Either operand, whichever: the value or its negative."""
    df = t.shared_orders(spark, d).df.withColumn("picked", f.random_choice(3)(F.col("val"), -F.col("val")))
    return df.select("row", "col", (F.abs("picked") == F.col("val")).alias("one_of_both"))


# -- search -----------------------------------------------------------------------------------------
def _both_ways(spark: SparkSession, d: str) -> SparseMatrix:
    """All edges of the graph, each in both directions."""
    g = t.graph(spark, d).select("row", "col")
    both = g.unionByName(g.select(F.col("col").alias("row"), F.col("row").alias("col"))).distinct()
    return SparseMatrix(both.withColumn("val", F.lit(1).cast("long")), _N, _N)


#: Breadth-first from region 0: what is reached stays in the recursion's table under its key, so the search ends by itself.
_BFS = f"""
WITH RECURSIVE g AS MATERIALIZED ({t.GRAPH_SQL}),
e AS MATERIALIZED (SELECT CAST("row" AS BIGINT) AS "row", CAST("col" AS BIGINT) AS "col" FROM g UNION SELECT "col", "row" FROM g),
b(idx, level, parent) USING KEY (idx) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION SELECT e."row", min(b.level) + 1, min(e."col") FROM b JOIN e ON e."col" = b.idx WHERE NOT EXISTS (SELECT 1 FROM recurring.b AS r WHERE r.idx = e."row") GROUP BY e."row")
"""
_query("bfs_levels", _BFS + "SELECT idx, level FROM b")(lambda s, d: search.bfs(_both_ways(s, d), 0).select("idx", "level"))
_query("bfs_parents", _BFS + "SELECT idx, parent FROM b")(lambda s, d: search.bfs(_both_ways(s, d), 0).select("idx", "parent"))
_query("bfs_bottom_up", _BFS + "SELECT idx, level FROM b")(lambda s, d: search.bfs(_both_ways(s, d), 0, bottom_up=True).select("idx", "level"))


@_query("bfs_validate", _BFS + """SELECT count(*) FILTER (idx <> 0 AND level <> 1) AS parent, count(*) FILTER (idx <> 0 AND NOT EXISTS (SELECT 1 FROM e WHERE e."row" = idx AND e."col" = 0)) AS edge,
  0 AS level, 0 AS missed, 0 AS root FROM b""")
def _validated(spark, d):
    """A tree whose parents are all the source breaks two of the rules."""
    a = _both_ways(spark, d)
    tree = search.bfs(a, 0).withColumn("parent", F.lit(0).cast("long"))
    return spark.createDataFrame([search.validate(a, tree, 0)], "parent long, edge long, level long, missed long, root long")


# -- sources ----------------------------------------------------------------------------------------
def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weft-io/{name}-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, name: str, head: list[str], body: DataFrame, order: list[str]) -> str:
    """A text file's folder: some first lines, then those of a frame (value) in an order."""
    from weft.sources.text import _write

    kinds = dict(body.dtypes)
    top = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "o long, value string")
    top = top.select("o", *[F.lit(None).cast(kinds[c]).alias(c) for c in order], "value")
    _write(top.unionByName(body.select(F.lit(0).cast("long").alias("o"), *order, "value")), ["o", *order], path := _scratch(spark, name), False)
    return path


@_query("mtx_roundtrip", "SELECT * FROM os", "os")
def _mtx(spark, d):
    from weft.sources.text import read_mtx, write_mtx

    write_mtx(t.orders_suppliers(spark, d), path := _scratch(spark, "mtx"))
    return read_mtx(spark, path).df


@_query("tuples_roundtrip", "SELECT 'o' || \"row\" AS s, 's' || \"col\" AS o, CAST(val AS DOUBLE) AS val FROM os", "os")
def _tuples(spark, d):
    from weft.sources.text import read_labelled

    t.orders_suppliers(spark, d).df.select(F.concat(F.lit("o"), "row", F.lit(" s"), "col", F.lit(" "), "val")).write.text(path := _scratch(spark, "tuples"))
    m, known = read_labelled(spark, path)
    name = lambda c, to: known.select(F.col("idx").alias(c), F.col("label").alias(to))
    return m.df.join(name("row", "s"), "row").join(name("col", "o"), "col").select("s", "o", "val")


@_query("encoded_triples", 'SELECT "row", "col", CAST(max(val) AS BIGINT) AS val FROM g GROUP BY 1, 2', "g")
def _triples(spark, d):
    from weft.sources.text import read_encoded_triples

    g = t.graph(spark, d)
    g.select(F.concat(F.lit("<"), "row", F.lit("> <"), "val", F.lit("> <"), "col", F.lit("> ."))).write.text(path := _scratch(spark, "triples"))
    return read_encoded_triples(spark, path).df


@_query("vector_roundtrip", "SELECT idx, CAST(val AS DOUBLE) AS val FROM sf", "sf")
def _vector(spark, d):
    from weft.sources.text import read_sparse_vector, write_vector

    write_vector(t.first_nations(spark, d), path := _scratch(spark, "vector"))
    return read_sparse_vector(spark, path).df


@_query("edge_table_roundtrip", 'SELECT "row", "col", val FROM g WHERE val = 12', "g")
def _edge_table(spark, d):
    from weft.sources.binary import read_edges, write_edges

    write_edges(SparseMatrix(t.graph(spark, d), 1 << 26, 1 << 26), path := _scratch(spark, "edges"))
    return read_edges(spark, path, 1 << 26, 1 << 26).df.where("val = 12")


@_query("mtx_symmetric", "SELECT * FROM ss", "ss")
def _symmetric(spark, d):
    from weft.sources.text import read_mtx

    ss = t.shared_orders(spark, d)
    low = ss.df.where("row >= col").withColumn("value", F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, "val"))
    head = ["%%MatrixMarket matrix coordinate integer symmetric", "% the lower triangle", f"{ss.nrow} {ss.ncol} {low.count()}"]
    return read_mtx(spark, _lines(spark, "symmetric", head, low, ["row", "col"])).df


@_query("mtx_pattern", 'SELECT "row", "col", CAST(1 AS BIGINT) AS val FROM os', "os")
def _pattern(spark, d):
    from weft.sources.text import read_mtx, write_mtx

    write_mtx(t.orders_suppliers(spark, d).apply(lambda v: v > 0), path := _scratch(spark, "pattern"))
    return read_mtx(spark, path).df


@_query("mtx_real", 'SELECT "row", "col", val / 4.0 AS val FROM os', "os")
def _real(spark, d):
    from weft.sources.text import read_mtx, write_mtx

    write_mtx(t.orders_suppliers(spark, d).apply(lambda v: v / F.lit(4.0)), path := _scratch(spark, "real"), single=True)
    return read_mtx(spark, path).df


@_query("mtx_array", 'SELECT idx AS "row", CAST(0 AS BIGINT) AS "col", val FROM sn UNION ALL SELECT idx, 1, idx * 3 FROM sn', "sn")
def _dense(spark, d):
    from weft.sources.text import read_mtx

    sn = t.supplier_nations(spark, d)
    body = sn.df.select(F.lit(0).alias("col"), "idx", F.col("val").cast("string").alias("value")).unionByName(sn.df.select(F.lit(1).alias("col"), "idx", (F.col("idx") * 3).cast("string").alias("value")))
    return read_mtx(spark, _lines(spark, "array", ["%%MatrixMarket matrix array integer general", f"{sn.length} 2"], body, ["col", "idx"])).df


@_query("mtx_relabelled", "SELECT * FROM ss", "ss")
def _relabelled(spark, d):
    """Under random numbers, and back by the names."""
    from weft.sources.generate import relabelled

    m, names = relabelled(t.shared_orders(spark, d), 3)
    old = lambda c: names.select(F.col("new").alias(c), F.col("id").alias(f"old_{c}"))
    return m.df.join(old("row"), "row").join(old("col"), "col").select(F.col("old_row").alias("row"), F.col("old_col").alias("col"), "val")


@_query("legacy_triples", 'SELECT "row", "col", CAST(val AS DOUBLE) AS val FROM os', "os")
def _legacy(spark, d):
    from weft.sources.text import read_triples_text

    m = t.orders_suppliers(spark, d)
    body = m.df.withColumn("value", F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, "val"))
    return read_triples_text(spark, _lines(spark, "legacy", [f"{m.nrow} {m.ncol} 0"], body, ["row", "col"])).df


@_query("csv_roundtrip", "SELECT * FROM os", "os")
def _csv(spark, d):
    from weft.sources.text import write_csv

    write_csv(t.orders_suppliers(spark, d), path := _scratch(spark, "csv"))
    return spark.read.schema("row long, col long, val long").csv(path)


@_query("dense_vector_roundtrip", "SELECT i AS idx, CASE WHEN val < 5 THEN CAST(val AS DOUBLE) ELSE -1.0 END AS val FROM n_s, range(n) x(i) LEFT JOIN sn ON idx = i", "n_s sn")
def _dense_vector(spark, d):
    from weft.sources.text import read_dense_vector, write_vector

    write_vector(t.first_nations(spark, d), path := _scratch(spark, "dense"))
    return read_dense_vector(spark, path, default=-1.0).df


@_query("hkdt_roundtrip", "SELECT * FROM os", "os")
def _hkdt(spark, d):
    from weft.sources.binary import read_hkdt, write_hkdt

    write_hkdt(t.orders_suppliers(spark, d), path := _scratch(spark, "hkdt"), "<i8")
    return read_hkdt(spark, path, "<i8").df


@_query("edge_list_roundtrip", "SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _edge_list(spark, d):
    from weft.sources.binary import read_edge_list, write_edge_list

    write_edge_list(_part_edges(spark, d), path := _scratch(spark, "pairs"))
    return read_edge_list(spark, path).groupBy("src", "dst").agg(F.count("*").alias("n"))


def _kronecker_sql(scale: int, seed: int = 1) -> str:
    """The generator's arithmetic, by edge and bit."""
    edge = [int(x * PRIME) for x in (A, A + B, A + B + C)]
    one, two, three = (f"((id % {PRIME} * {a} + (k * {b} + {seed * c + d}) % {PRIME}) % {PRIME})" for a, b, c, d in LINES)
    rows = f"SELECT CAST(i AS BIGINT) AS id, CAST(j AS BIGINT) AS k FROM range({EDGE_FACTOR << scale}) a(i), range({scale}) b(j)"
    rows = f"SELECT id, k, {one} * {two} % {PRIME} * {three} % {PRIME} AS x FROM ({rows})"
    bit = f"CAST(pow(2, {scale - 1} - k) AS BIGINT)"
    down, right = f"x >= {edge[1]}", f"(x >= {edge[0]} AND x < {edge[1]}) OR x >= {edge[2]}"
    rows = f"SELECT CAST(sum(CASE WHEN {down} THEN {bit} ELSE 0 END) AS BIGINT) AS src, CAST(sum(CASE WHEN {right} THEN {bit} ELSE 0 END) AS BIGINT) AS dst FROM ({rows}) GROUP BY id"
    mask, shift = (1 << scale) - 1, max(1, scale // 2)
    for k in (0x9E3779B1 + 2 * seed, 0x85EBCA6B):
        rows = f"SELECT {', '.join(f'({c} * {(k | 1) & mask}) & {mask} AS {c}' for c in ('src', 'dst'))} FROM ({rows})"
        rows = f"SELECT {', '.join(f'xor({c}, {c} >> {shift}) AS {c}' for c in ('src', 'dst'))} FROM ({rows})"
    return rows


_query("kronecker", _kronecker_sql(10))(lambda spark, d: kronecker(spark, 10))


@_query("rename_vertices", """SELECT side, degree, count(*) AS n FROM (SELECT 'src' AS side, count(*) AS degree FROM lineitem GROUP BY l_partkey UNION ALL SELECT 'dst', count(*) FROM lineitem GROUP BY l_suppkey) GROUP BY 1, 2""")
def _rename(spark, d):
    """Under random names every vertex keeps its degree; the table of degrees says how many have each."""
    edges = _part_edges(spark, d)
    n = edges.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1
    new = rename_vertices(permute_edges(edges), n)
    each = [new.groupBy(c).agg(F.count("*").alias("degree")).select(F.lit(c).alias("side"), "degree") for c in ("src", "dst")]
    return each[0].unionByName(each[1]).groupBy("side", "degree").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

