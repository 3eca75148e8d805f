"""The test tables as a labelled graph and as matrices."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.matrix import SparseMatrix
from weft.operators.ranking import shared_dir
from weft.operators.vector import DenseVector, SparseVector

#: Vertex numbers are base + key.
BASE = {"region": 0, "nation": 10_000_000, "customer": 20_000_000, "supplier": 30_000_000, "part": 40_000_000, "order": 50_000_000, "class": 60_000_000}

#: The graph's edges, in SQL that Spark and DuckDB both read.
GRAPH_SQL = """
SELECT 20000000 + c_custkey AS "row", 10000000 + c_nationkey AS "col", 3 AS val FROM customer
UNION ALL SELECT 30000000 + s_suppkey, 10000000 + s_nationkey, 3 FROM supplier
UNION ALL SELECT DISTINCT 50000000 + l_orderkey, 40000000 + l_partkey, 8 FROM lineitem
UNION ALL SELECT 50000000 + o_orderkey, 20000000 + o_custkey, 9 FROM orders
UNION ALL SELECT 50000000 + o_orderkey, 10000000 + c_nationkey, 12 FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT DISTINCT 50000000 + l_orderkey, 30000000 + l_suppkey, 14 FROM lineitem
UNION ALL SELECT 10000000 + n_nationkey, n_regionkey, 17 FROM nation
UNION ALL SELECT 30000000 + s_suppkey, 60000001, 17 FROM supplier
UNION ALL SELECT 50000000 + o_orderkey, CASE o_orderstatus WHEN 'F' THEN 60000002 WHEN 'O' THEN 60000003 ELSE 60000004 END, 17 FROM orders
UNION ALL SELECT 20000000 + c_custkey, 60000009 + r, 17 FROM customer JOIN (SELECT s, row_number() OVER (ORDER BY s) AS r FROM (SELECT DISTINCT c_mktsegment AS s FROM customer) AS x) AS y ON s = c_mktsegment
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge table: row (subject), col (object), val (predicate)."""
    t = lambda name: table(spark, sf_dir, name)
    b = BASE
    edge = lambda df, s, o, p: df.select(s.cast("long").alias("row"), o.cast("long").alias("col"), F.lit(p).alias("val"))
    c, o, li, s, n = t("customer"), t("orders"), t("lineitem"), t("supplier"), t("nation")
    order = F.lit(b["order"])
    segments = c.select("c_mktsegment").distinct()  # a handful
    rank = segments.select("c_mktsegment", F.dense_rank().over(Window.orderBy("c_mktsegment")).alias("r"))
    status = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 3).otherwise(4)
    parts = [
        edge(c, F.col("c_custkey") + b["customer"], F.col("c_nationkey") + b["nation"], 3),
        edge(s, F.col("s_suppkey") + b["supplier"], F.col("s_nationkey") + b["nation"], 3),
        edge(li.select("l_orderkey", "l_partkey").distinct(), F.col("l_orderkey") + order, F.col("l_partkey") + b["part"], 8),
        edge(o, F.col("o_orderkey") + order, F.col("o_custkey") + b["customer"], 9),
        edge(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("o_orderkey") + order, F.col("c_nationkey") + b["nation"], 12),
        edge(li.select("l_orderkey", "l_suppkey").distinct(), F.col("l_orderkey") + order, F.col("l_suppkey") + b["supplier"], 14),
        edge(n, F.col("n_nationkey") + b["nation"], F.col("n_regionkey"), 17),
        edge(s, F.col("s_suppkey") + b["supplier"], F.lit(b["class"] + 1), 17),
        edge(o, F.col("o_orderkey") + order, status + b["class"], 17),
        edge(c.join(rank, "c_mktsegment"), F.col("c_custkey") + b["customer"], F.col("r") + b["class"] + 9, 17),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_tables: dict[tuple[str, str], str] = {}


def graph_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge table on disk, partitioned by predicate, so that a pattern reads its predicates only.

    It is loaded once for each application and folder, as a graph is that many patterns are asked of; tables that
    change under an application need another folder.
    """
    from .binary import read_edges, write_edges

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        path = f"{shared_dir(spark)}/weft-io/graph-{uuid.uuid4().hex}"
        write_edges(SparseMatrix(graph(spark, sf_dir), 1 << 26, 1 << 26), path)
        _tables[key] = path
    return read_edges(spark, _tables[key], 1 << 26, 1 << 26).df


def _n(spark: SparkSession, sf_dir: str, name: str, key: str) -> int:
    return (table(spark, sf_dir, name).agg(F.max(key)).first()[0] or -1) + 1


def orders_suppliers(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum(F.col("l_quantity").cast("long")).alias("val"))
    return SparseMatrix(df, _n(spark, sf_dir, "orders", "o_orderkey"), _n(spark, sf_dir, "supplier", "s_suppkey"))


def orders_parts(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.count("*").alias("val"))
    return SparseMatrix(df, _n(spark, sf_dir, "orders", "o_orderkey"), _n(spark, sf_dir, "part", "p_partkey"))


def suppliers_parts(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.max("l_linenumber").cast("long").alias("val"))
    return SparseMatrix(df, _n(spark, sf_dir, "supplier", "s_suppkey"), _n(spark, sf_dir, "part", "p_partkey"))


def shared_orders(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Supplier by supplier, the number of orders that both deliver to: symmetric."""
    os = orders_suppliers(spark, sf_dir).apply(lambda v: F.lit(1).cast("long"))
    return os.transpose().mxm(os)


def shared_orders_tiled(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """The same matrix, made and kept by tiles for products that read it again."""
    # each order's lines lie together from the first exchange on
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey")
    ones = lines.distinct().select(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("col"), F.lit(1).cast("long").alias("val"))
    return SparseMatrix(ones, _n(spark, sf_dir, "orders", "o_orderkey"), _n(spark, sf_dir, "supplier", "s_suppkey")).gram()


def supplier_nations(spark: SparkSession, sf_dir: str) -> DenseVector:
    df = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_nationkey").cast("long").alias("val"))
    return DenseVector(df, _n(spark, sf_dir, "supplier", "s_suppkey"))


def first_nations(spark: SparkSession, sf_dir: str) -> SparseVector:
    return supplier_nations(spark, sf_dir).to_sparse(lambda v: v < 5)
