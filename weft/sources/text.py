"""Text formats: Matrix Market (coordinate and array), labelled tuples, dictionary-encoded triples and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.matrix import DUPLICATES, SparseMatrix
from weft.operators.ranking import positions
from weft.operators.vector import DenseVector, SparseVector

#: Matrix Market's banner words.
FORMATS, KINDS, SYMMETRIES = ("coordinate", "array"), ("real", "integer", "pattern"), ("general", "symmetric", "skew-symmetric")


def _body(spark: SparkSession, path: str, comment: str = "%") -> tuple[str, DataFrame]:
    """The first line that isn't a comment, and all lines after it (f, and where they are: file, block, id).

    Lines of one split keep their order; the first split of the first file holds the header.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = lines.where((F.col("value") != "") & ~F.col("value").startswith(comment))
    head = lines.where("block = 0").agg(F.min(F.struct("file", "id", "value")).alias("m")).first()["m"]
    if head is None:
        raise ValueError(f"{path} has no header")
    return head["value"], lines.where(F.col("id") != head["id"]).select(F.split("value", r"\s+").alias("f"), "file", "block", "id")


def banner(spark: SparkSession, path: str) -> tuple[str, str, str]:
    """(format, kind, symmetry) of a Matrix Market file."""
    first = spark.read.text(path).where("value LIKE '%MatrixMarket%'").first()
    words = first["value"].lower().split() if first else []
    if words[:2] != ["%%matrixmarket", "matrix"] or len(words) != 5 or words[2] not in FORMATS:
        raise ValueError(f"{path} has no Matrix Market banner")
    if words[3] not in KINDS or words[4] not in SYMMETRIES or words[2:4] == ["array", "pattern"]:
        raise ValueError(f"{' '.join(words[2:])} matrices aren't read")
    return words[2], words[3], words[4]


def _array(lines: DataFrame, kind: str, symmetry: str, nrow: int) -> DataFrame:
    """The entries of a dense file, one value a line, column by column; of symmetric ones the lower triangle is there.

    Lines are numbered across the file's splits by range, so a large file needs no task of its own.
    """
    values = positions(lines.select("file", "block", "id", F.col("f")[0].cast("double" if kind == "real" else "long").alias("val")), ["file", "block", "id"])
    pos, n = F.col("pos"), F.lit(nrow)
    if symmetry == "general":
        return values.select((pos % n).alias("row"), F.floor(pos / n).cast("long").alias("col"), "val")
    # a column holds one value less than the one before: m, m - 1, ..., so column j starts at j * m - j * (j - 1) / 2
    m = nrow if symmetry == "symmetric" else nrow - 1
    start = lambda j: j * m - F.floor(j * (j - 1) / 2).cast("long")
    guess = F.greatest(F.floor((2 * m + 1 - F.sqrt(F.greatest(F.lit(float((2 * m + 1) ** 2)) - 8 * pos, F.lit(0.0)))) / 2).cast("long"), F.lit(0).cast("long"))
    values = values.withColumn("j", guess)  # the square root may be off by one
    values = values.withColumn("j", F.when(start(F.col("j")) > pos, F.col("j") - 1).when(start(F.col("j") + 1) <= pos, F.col("j") + 1).otherwise(F.col("j")))
    row = pos - start(F.col("j")) + F.col("j") + (0 if symmetry == "symmetric" else 1)
    return values.select(row.alias("row"), F.col("j").alias("col"), "val")


def _entries(lines: DataFrame, kind: str, one_based: bool, value: Column | None) -> DataFrame:
    base = 1 if one_based else 0
    # a missing value counts as 1
    val = value if value is not None else F.lit(1).cast("long") if kind == "pattern" else F.coalesce(F.try_element_at("f", F.lit(3)), F.lit("1")).cast("double" if kind == "real" else "long")
    return lines.select((F.col("f")[0].cast("long") - base).alias("row"), (F.col("f")[1].cast("long") - base).alias("col"), val.alias("val"))


def read_mtx(spark: SparkSession, path: str, one_based: bool = True, duplicates: str = "max", value: Column | None = None) -> SparseMatrix:
    """A Matrix Market file, coordinate or array (of which zeros are entries too).

    ``value``: an expression over the split line ``f`` in place of a coordinate line's third field.
    """
    form, kind, symmetry = banner(spark, path)
    head, lines = _body(spark, path)
    nrow, ncol = (int(x) for x in head.split()[:2])
    df = _array(lines, kind, symmetry, nrow) if form == "array" else _entries(lines, kind, one_based, value)
    if symmetry != "general":
        sign = -1 if symmetry == "skew-symmetric" else 1
        mirrored = F.when(F.col("row") == F.col("col"), F.array(F.struct("row", "col", "val"))).otherwise(
            F.array(F.struct("row", "col", "val"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("val") * sign).alias("val")))
        )
        df = df.select(F.inline(mirrored))
    return SparseMatrix.build(df, nrow, ncol, duplicates)


def _write(lines: DataFrame, order: list[str], path: str, single: bool) -> None:
    """Lines (value) in order: part files that follow each other, or one file, which a single task writes of what others have sorted."""
    out = lines.orderBy(*order).select("value")
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def write_mtx(matrix: SparseMatrix, path: str, one_based: bool = True, transpose: bool = False, value: Column | None = None, single: bool = False) -> None:
    """A Matrix Market file in parts that follow each other, entries in the order of (row, col); ``single``: one file. ``value``: how ``val`` is written."""
    m = matrix.transpose() if transpose else matrix
    kind = "integer" if dict(m.df.dtypes)["val"] in ("tinyint", "smallint", "int", "bigint") else "pattern" if dict(m.df.dtypes)["val"] == "boolean" else "real"
    base = 1 if one_based else 0
    fields = [(F.col("row") + base).cast("string"), (F.col("col") + base).cast("string")] + ([] if kind == "pattern" else [(value if value is not None else F.col("val")).cast("string")])
    body = m.df.select(F.lit(1).alias("o"), "row", "col", F.concat_ws(" ", *fields).alias("value"))
    size = m.df.agg(F.concat_ws(" ", F.lit(str(m.nrow)), F.lit(str(m.ncol)), F.count("*").cast("string")).alias("s"))
    zero = F.lit(0).cast("long")
    head = size.select(F.lit(0).alias("o"), zero.alias("row"), zero.alias("col"), F.concat(F.lit(f"%%MatrixMarket matrix coordinate {kind} general\n"), F.col("s")).alias("value"))
    _write(head.unionByName(body), ["o", "row", "col"], path, single)


def write_csv(matrix: SparseMatrix, path: str) -> None:
    """One file of each partition, without a header."""
    matrix.df.write.mode("overwrite").csv(path)


def read_triples_text(spark: SparkSession, path: str, duplicates: str = "max") -> SparseMatrix:
    """``nrow ncol nnz``, then ``row col [val]`` from 1; no banner, a missing value is 1."""
    head, lines = _body(spark, path)
    nrow, ncol, _ = (int(x) for x in head.split())
    return SparseMatrix.build(_entries(lines, "real", True, None), nrow, ncol, duplicates)


def read_labelled(spark: SparkSession, path: str, duplicates: str = "max") -> tuple[SparseMatrix, DataFrame]:
    """``from to value`` with any labels, no header: the matrix and the dictionary (label, idx).

    Labels are numbered by hash and label, so the numbers depend on nothing but the labels.
    """
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 2)
    rows = rows.select(F.col("f")[0].alias("s"), F.col("f")[1].alias("t"), F.coalesce(F.try_element_at("f", F.lit(3)), F.lit("1")).cast("double").alias("val"))
    labels = rows.select(F.explode(F.array("s", "t")).alias("label")).distinct()
    known = positions(labels.withColumn("h", F.xxhash64("label")), ["h", "label"], "idx").select("label", "idx")
    n = known.count()
    df = rows.join(known.select(F.col("label").alias("s"), F.col("idx").alias("row")), "s").join(known.select(F.col("label").alias("t"), F.col("idx").alias("col")), "t")
    return SparseMatrix.build(df.select("row", "col", "val"), n, n, duplicates), known


def read_encoded_triples(spark: SparkSession, path: str, duplicates: str = "max", keep_all: bool = False) -> SparseMatrix:
    """Dictionary-encoded ``<s> <p> <o> .`` lines, numbers from 0: row s, col o, value p.

    Two lines of sizes at the start (entries, nodes) are passed over, as all that isn't a triple is.
    ``keep_all``: every predicate of a pair stays, as a row of its own.
    """
    pattern = r"^\s*<(\d+)>\s+<(\d+)>\s+<(\d+)>\s*\.\s*$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    df = lines.select(*[F.regexp_extract("value", pattern, i).cast("long").alias(c) for i, c in ((1, "row"), (3, "col"), (2, "val"))])
    top = df.agg(F.max(F.greatest("row", "col"))).first()[0]
    n = -1 if top is None else top
    if keep_all:
        return SparseMatrix(df.distinct(), n + 1, n + 1)
    return SparseMatrix.build(df, n + 1, n + 1, duplicates)


def read_sparse_vector(spark: SparkSession, path: str, one_based: bool = True, duplicates: str = "max") -> SparseVector:
    """``length nnz``, then ``idx val``."""
    head, lines = _body(spark, path)
    base = 1 if one_based else 0
    df = lines.select((F.col("f")[0].cast("long") - base).alias("idx"), F.col("f")[1].cast("double").alias("val"))
    return SparseVector(df.groupBy("idx").agg(DUPLICATES[duplicates]("val").alias("val")), int(head.split()[0]))


def read_dense_vector(spark: SparkSession, path: str, one_based: bool = True, default=0.0) -> DenseVector:
    return read_sparse_vector(spark, path, one_based).to_dense(default)


def write_vector(vector: SparseVector | DenseVector, path: str, one_based: bool = True, indices: bool = True, header: bool = True, single: bool = False) -> None:
    """Parts that follow each other in the order of the indices, which are the vector's own; ``single``: one file."""
    base = 1 if one_based else 0
    fields = ([(F.col("idx") + base).cast("string")] if indices else []) + [F.col("val").cast("string")]
    out = vector.df.select(F.lit(1).alias("o"), "idx", F.concat_ws(" ", *fields).alias("value"))
    if header:
        size = vector.df.agg(F.concat(F.lit(f"{vector.length} "), F.count("*").cast("string")).alias("value"))
        out = size.select(F.lit(0).alias("o"), F.lit(0).cast("long").alias("idx"), "value").unionByName(out)
    _write(out, ["o", "idx"], path, single)
