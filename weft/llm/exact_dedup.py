"""Exact dedup with an extendible-hash index kept on shared files. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, matching, skew_join, stored

#: A bucket with more keys than this is split in two.
CAPACITY = 1024
#: The directory has at most 2 ** MAX_DEPTH slots, which bounds what the driver holds.
MAX_DEPTH = 14
#: Up to so many repeated keys are broadcast to find the texts to compare; beyond, they shuffle.
BROADCAST_KEYS = 200_000


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for x in SPACES:  # a plain search for each is several times as fast as one pattern or translate()
        out = F.replace(out, F.lit(x), F.lit(""))
    return out


def directory(counts: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[int, list[tuple[int, int]]]:
    """Extendible hashing over key counts by max_depth-bit prefix: (global depth, [(local depth, bucket prefix)] by slot).

    Starts from one bucket. A bucket over capacity splits by its next bit; when it is as deep as the
    directory, the directory doubles first. At max_depth a bucket stays overfull and chains its keys.
    """
    sums = [counts.get(i, 0) for i in range(1 << max_depth)]
    levels = [sums]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([below[2 * i] + below[2 * i + 1] for i in range(len(below) // 2)])
    levels.reverse()  # levels[d][p]: keys under the d-bit prefix p
    depth, slots, todo = 0, [(0, 0)], [(0, 0)]
    while todo:
        local, prefix = todo.pop()
        if levels[local][prefix] <= capacity or local == max_depth:
            continue
        if local == depth:
            slots, depth = [x for x in slots for _ in range(2)], depth + 1
        width = 1 << (depth - local - 1)
        for bit in (0, 1):
            child = (local + 1, 2 * prefix + bit)
            at = child[1] * width
            slots[at : at + width] = [child] * width
            todo.append(child)
    return depth, slots


def _bucketed(df: DataFrame, depth: int, slots: list[tuple[int, int]]) -> DataFrame:
    """Add each key's bucket by its directory slot; the directory has at most 2 ** MAX_DEPTH rows."""
    if depth == 0:
        return df.withColumn("bucket", F.lit(0))
    ids = {b: i for i, b in enumerate(dict.fromkeys(slots))}
    values = ", ".join(f"({i}L, {ids[b]})" for i, b in enumerate(slots))
    known = df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS d(slot, bucket)")
    return df.withColumn("slot", F.shiftrightunsigned("key", 64 - depth)).join(F.broadcast(known), "slot", "left").drop("slot")


def _resolved(docs: DataFrame, id_col: str, text_col: str, capacity: int, max_depth: int, broadcast_keys: int, key_bits: int) -> DataFrame:
    """One row per input row: id, n, sha, keep_id, keep_n, group_size, kept."""
    spark = docs.sparkSession
    norm = normalised(F.col(text_col))
    key = F.xxhash64("norm")
    if key_bits < 64:
        key = F.call_function("shiftleft", F.shiftrightunsigned(key, 64 - key_bits), F.lit(64 - key_bits))
    seen = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), norm.alias("norm"),
    ).withColumn("key", key)
    order = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), "id", "rid")
    best = [F.count("*").alias("group_size"), F.min(order).alias("best")]
    kept = ["group_size", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), (-F.col("best.n")).alias("keep_n")]

    entries = stored(seen.select("rid", "id", "n", "key", F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-entries")
    repeated = stored(entries.groupBy("key").agg(*best).where("group_size > 1").select("key", *kept), "exact-keys")
    histogram = repeated.groupBy(F.shiftrightunsigned("key", 64 - max_depth).alias("prefix")).count()
    counts = {r["prefix"]: r["count"] for r in histogram.collect()}  # at most 2 ** max_depth rows
    depth, slots = directory(counts, capacity, max_depth)
    owners = max(1, min(len(set(slots)), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    asked = repeated.select("key")
    texts = docs.select(norm.alias("norm")).withColumn("key", key).join(F.broadcast(asked) if sum(counts.values()) <= broadcast_keys else asked, "key", "left_semi")
    records = _bucketed(texts.groupBy("key", "norm").agg(F.count("*").alias("n_rows")), depth, slots)  # copies fold map-side, byte by byte
    chain = Window.partitionBy("bucket", "key").orderBy("norm")
    owned = records.repartition(owners, "bucket").sortWithinPartitions("bucket", "key", "norm")
    owned = owned.withColumn("link", F.row_number().over(chain)).withColumn("differs", ~F.col("norm").eqNullSafe(F.lag("norm").over(chain)))
    index = stored(owned.select("bucket", "key", "link", "differs", "n_rows"), "exact-index")

    # a key with one record in its chain stands for one text; the rows of longer chains are told apart by their bytes
    chains = index.where("differs").groupBy("key").agg(F.count("*").alias("links"), F.sum("n_rows").alias("n_rows"))
    single = chains.where("links = 1").join(repeated, "key").where("n_rows = group_size").select("key", *repeated.columns[1:])
    long = stored(chains.where("links > 1").select("key"), "exact-chains")
    found = skew_join(entries, single.withColumn("weight", F.col("group_size")), ["key"], "weight", max(1, entries.count()))
    n_long = long.count()
    if n_long:
        side = F.broadcast(long) if n_long <= broadcast_keys else long
        rows = stored(seen.join(side, "key", "left_semi"), "exact-collisions")
        apart = rows.groupBy("key", "norm").agg(*best).select("key", "norm", *kept)
        told = rows.withColumn("sha", F.unhex(F.sha2("norm", 256))).join(apart, ["key", "norm"]).select(found.columns)
        found = found.join(side, "key", "left_anti").unionByName(told)
    alone = F.col("keep_rid").isNull()
    return found.select(
        "id", "n", F.lower(F.hex("sha")).alias("sha"), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("keep_n", "n").alias("keep_n"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("keep_rid") == F.col("rid"))).alias("kept"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, broadcast_keys: int = BROADCAST_KEYS, key_bits: int = 64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after white space (U+0020, U+0009 to U+000D) is deleted; null counts
    as empty. Of equal texts the row with the most code points, then the smallest id stays; a null id
    comes last, and of repeated rows exactly one stays. An empty table gives no rows; other columns
    are not looked at, so their names may clash.

    1. Every row becomes a small entry (64-bit key, length, digest for the output) on shared files.
    2. Keys that occur once are settled. The others, folded map-side to one record each so that a hot
       text is one, are what the index holds; counts by key prefix (at most 2 ** max_depth numbers) build
       its directory, which doubles where a bucket is overfull.
    3. Owner tasks take the buckets, each a range of keys, with the texts of their keys. They sort a key's
       texts into a chain and compare the bytes of neighbours; the index says how many a chain has.
    4. Entries probe the index by key, which stands for one text where its chain has one. The rows of a
       longer chain, whose keys collide, are matched by their bytes. No digest decides what is equal.
    A hot record is broadcast, the others meet in a shuffle. ``key_bits`` shortens keys, to make them collide.
    """
    found = _resolved(docs, id_col, text_col, capacity, max_depth, broadcast_keys, key_bits)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def exact_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, broadcast_keys: int = BROADCAST_KEYS, key_bits: int = 64) -> DataFrame:
    """The input rows that exact_dedup() keeps, with all their columns.

    A null text counts as empty, so of all rows with no text or an empty one a single one stays. Rows that
    share the id, the normalised text and the length of the kept one are the same to exact_dedup(); of
    those one stays, whichever. An empty table stays empty; columns may have any names but __sha and __n.
    """
    found = _resolved(docs, id_col, text_col, capacity, max_depth, broadcast_keys, key_bits).where("NOT kept")
    judged = stored(found.select("id", F.col("sha").alias("__sha"), F.col("n").alias("__n"), (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))).alias("same")), "exact-dropped")
    by = ["__sha", "__n"]
    gone, again = (judged.where(is_same).select("id", *by).distinct() for is_same in (~F.col("same"), F.col("same")))
    rows = docs.withColumns({"__sha": F.sha2(normalised(F.col(text_col)), 256), "__n": F.length(F.coalesce(F.col(text_col), F.lit("")))})
    out = matching(rows, id_col, gone, by, broadcast_keys, "left_anti")
    if again.limit(1).count():  # a row that goes repeats the one that stays
        out = matching(out, id_col, again, by, broadcast_keys, "left_anti").unionByName(matching(out, id_col, again, by, broadcast_keys, "left_semi").dropDuplicates([id_col, *by]))
    return out.drop(*by)
