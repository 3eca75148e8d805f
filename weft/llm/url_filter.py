"""URL filter: rules by host and path, then a blocked Bloom filter before an exact hash join. Built-in functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skew_join, stored

#: A block is 8 words of 64 bits; a key sets one bit in each word.
WORDS, BLOCK_BITS = 8, 512
#: About one in a hundred URLs that aren't listed passes; the exact join removes it.
BITS_PER_KEY = 10
#: The filter (72 bytes a block) and the list are broadcast up to so many rows; beyond, distinct URLs shuffle to them.
BROADCAST_BLOCKS, BROADCAST_URLS = 65_536, 100_000

HOST = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, HOST, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """host/path?query without scheme, www., fragment, trailing /, index page and utm_, ref and session parameters."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|sid|sessionid|fbclid|gclid)="))), "&")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits a host or its subdomains and the start of a path."""
    name = verdict = F.lit(None).cast("string")
    for say, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(say)).otherwise(verdict)
    return name, verdict


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit(7))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_filter(listed: DataFrame, key: str, n: int, bits_per_key: int = BITS_PER_KEY) -> tuple[DataFrame, int]:
    """Rows (block, w0..w7) of a blocked Bloom filter over n keys, and the number of blocks."""
    blocks = max(1, -(-n * bits_per_key // BLOCK_BITS))
    rows = listed.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def maybe_listed(key: Column) -> Column:
    """Whether the block joined to this row has the key's bit in every word."""
    out = F.col("w0").isNotNull()
    for i, m in enumerate(_masks(key)):
        out = out & (F.col(f"w{i}").bitwiseAND(m) != 0)
    return F.coalesce(out, F.lit(False))


def url_filter(
    pages: DataFrame, listed: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", default: str = "allow", broadcast_blocks: int = BROADCAST_BLOCKS, broadcast_urls: int = BROADCAST_URLS
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, canonical, maybe (the Bloom filter's answer), listed.

    The verdict is the longest fitting rule's, else block for a listed canonical URL, else ``default``.
    A null URL or one without :// has empty host and path and is never listed. An empty list or table
    works; repeated rows are each judged; URLs may be of any length; other columns are not looked at, so
    their names may clash.

    The filter and the list are broadcast while they are small, and no row moves. Beyond that, pages are
    folded map-side to distinct canonical URLs, which meet the filter's blocks in a shuffle that has no hot
    key; only possible hits go on to the list, and what passed either comes back to the pages by counted
    weight. Rows that the filter rejects take no part in a join by key.
    """
    known = stored(listed.select(canonical(F.col(listed_col)).alias("canonical")).where("canonical <> ''").distinct(), "url-list")
    n = known.count()
    bloom, blocks = bloom_filter(known, "canonical", n)
    bits, known = [f"w{i}" for i in range(WORDS)], known.withColumn("__in", F.lit(True))
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"), canonical(F.col(url_col)).alias("canonical"))
    probe, passed = _block(F.col("canonical"), blocks), (F.col("canonical") != "") & maybe_listed(F.col("canonical"))
    if blocks <= broadcast_blocks and n <= broadcast_urls:
        probed = rows.withColumn("block", probe).join(F.broadcast(bloom), "block", "left").withColumn("maybe", passed).drop("block", *bits)
        # only possible hits carry their key into the exact join
        probed = probed.withColumn("probe", F.when(F.col("maybe"), F.col("canonical")))
        found = probed.join(F.broadcast(known.withColumnRenamed("canonical", "probe")), "probe", "left")
    else:
        distinct = rows.where("canonical <> ''").groupBy("canonical").agg(F.count("*").alias("weight"))
        hits = distinct.withColumn("block", probe).join(bloom, "block").where(passed).select("canonical", "weight", F.lit(True).alias("maybe"))
        hits = stored(hits.join(known, "canonical", "left"), "url-hits")
        found = skew_join(rows, hits, ["canonical"], "weight", hits.agg(F.sum("weight")).first()[0] or 1)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    is_listed = F.coalesce(F.col("__in"), F.lit(False))
    return found.select(
        F.col("__id").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(is_listed, F.lit("block")).otherwise(F.lit(default))).alias("verdict"),
        "canonical", F.coalesce("maybe", F.lit(False)).alias("maybe"), is_listed.alias("listed"),
    )
