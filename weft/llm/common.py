"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.ranking import shared_dir

#: The white space of all contracts here: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and survives lost executors.

    What is written is deleted when the driver's program ends, or before by forget().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.unregister(_at_exit)
        atexit.register(_at_exit)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many folders stored() has written that aren't deleted yet."""
    return len(_written)


def forget(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Delete what stored() has written, once no result that reads it is needed any more; how many folders.

    Those before ``since``, a number that written() gave, stay, and so do the last ``but``.
    """
    gone = _written[since : len(_written) - but]
    for name in gone:
        _written.remove(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        with contextlib.suppress(Exception):  # Spark may have been stopped or lost before
            forget(spark)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, share: int = 1000) -> DataFrame:
    """Left join to a side that is unique by keys, safe when one key holds a third of the rows.

    right[weight] counts the rows of left that a key has, and total is their sum, so fewer than
    ``share`` + 1 keys weigh total / share or more. Those are broadcast, a side whose size that
    bounds; the rest shuffle, and no key of theirs holds more than 1 / share of the rows.
    left and right should be tables that are cheap to read twice.
    """
    bar = max(1, total // share)
    hot = right.where(F.col(weight) >= bar).drop(weight)
    cold = right.where(F.col(weight) < bar).drop(weight)
    gains = [c for c in cold.columns if c not in keys]
    flagged = left.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    met = flagged.where(F.col("__hot")).drop("__hot")
    rest = flagged.where(F.col("__hot").isNull()).drop("__hot", *gains).join(cold, keys, "left")
    return met.unionByName(rest)


def held_out(id_col):
    """True where crc32 of the id as text is divisible by 5: rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


#: Bytes of text that a class's sample may hold; rows beyond that are left out of it.
SAMPLE_BYTES = 48 << 20


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int, limit_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[str], float]:
    """Texts of at most ``limit`` rows and ``limit_bytes`` of label 1 and of label 0, in a fixed order, and the share of label 1.

    Only ids that are not held out; ids labelled both ways are left out. The ids are drawn from the
    labels by hash, so at most 2 * limit ids are broadcast and as many texts reach the driver, those
    before the first one in their order that would exceed the bytes.
    """
    seen = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    agreed = seen.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z").select("__id", "y")
    by = {r["y"]: r["n"] for r in agreed.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = [agreed.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").select("__id", "y").limit(limit) for y in (1, 0)]
    few = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids[0].unionByName(ids[1])), "__id")
    few = stored(few.select("y", F.xxhash64("__id").alias("h"), "text"), "sample")
    texts: list[list[str]] = []
    for y in (1, 0):
        own = few.where(F.col("y") == y)
        sizes = [r["n"] for r in own.select("h", "text", F.octet_length("text").alias("n")).orderBy("h", "text").limit(limit).select("n").collect()]
        fits = next((i for i in range(len(sizes)) if sum(sizes[: i + 1]) > limit_bytes), len(sizes))
        texts.append([r["text"] for r in own.orderBy("h", "text").limit(fits).collect()])
    total = sum(by.values())
    return texts[0], texts[1], by.get(1, 0) / total if total else 0.5


def matching(docs: DataFrame, id_col: str, side: DataFrame, by: list[str], broadcast_rows: int, how: str) -> DataFrame:
    """The rows of docs whose id and columns ``by`` are (left_semi) or aren't (left_anti) among the distinct rows (id, *by) of side; null ids match.

    Up to broadcast_rows of those are broadcast, so that no text moves; more meet the rows in a shuffle.
    """
    few = side.select(F.col("id").alias("__gone"), *[F.col(c).alias(f"__other{c}") for c in by])
    few = F.broadcast(few) if few.count() <= broadcast_rows else few
    same = docs[id_col].eqNullSafe(few["__gone"])
    for c in by:
        same = same & (docs[c] == few[f"__other{c}"])
    return docs.join(few, same, how)
