"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import benchmark_leaks
from .exact_dedup import exact_dedup
from .ngram_join import near_duplicates
from .packing import pack
from .quality import quality_scores
from .secrets import secret_spans
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity_scores
from .url_filter import url_filter

#: The contract's rules: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Loss-bearing tokens of a sequence of up to 2048.
MAX_LOSS = 2000
#: The tables hold no list of URLs. op4 takes for one the URLs of pages whose title is junk, words with signs run on to
#: them: what the pages hold decides what is listed, not their URLs. Where no title is so, the list is empty.
JUNK_TITLE = r"(!!|\$\$\$|\*\*\*|%%%|;&amp;)"


def tokenizer_path() -> str:
    """The packing query's vocabulary file, as installed on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def packed(docs: DataFrame) -> DataFrame:
    """The packing contract's rows: the first line of a text of several lines is its prompt, which bears no loss.

    The tokenizer drops white space and joins nothing across it, so the ids of both parts are those of the whole text.
    """
    cut = F.instr("text", "\n")
    parts = docs.select("doc_id", F.when(cut > 0, F.substring("text", F.lit(1), cut)).alias("prompt"), F.when(cut > 0, F.substr("text", cut + 1)).otherwise(F.col("text")).alias("text"))
    return digests(pack(parts, tokenizer_path(), prompt_col="prompt", max_loss=MAX_LOSS))


def digests(pieces: DataFrame) -> DataFrame:
    """The packing contract's columns of packed pieces."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_spans(docs, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    junk = pages.where(F.regexp_extract("html", "<title>([^<]*)", 1).rlike(JUNK_TITLE))
    return url_filter(pages, junk, RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .pipeline import run

    found = {f.__name__: f for f in (op1_exact_dedup, op2_secrets, op3_decontaminate, op4_url_filter, op5_toxicity, op6_substring_dedup, op7_quality, op8_packing, op9_suffix_dedup, op10_ngram_join)}
    return found | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.SQL
