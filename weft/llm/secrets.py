"""Secret scan with corpus-wide ownership frequency. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skew_join, stored

#: Fixed patterns of the base kinds, in their order: kind -> (pattern, group, least length of that group).
#: Letters of the assignment's name are spelled out in both cases, so that no engine folds others into them.
BASE = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),  # the runs of [0-9a-f]+ that have 24 or more characters
}
#: The method's own candidates: long opaque runs; those with both letters and digits that few owners have are reported.
OPAQUE = (r"([A-Za-z0-9+/_-]{24,})", 1, 24)
#: A candidate that more owners or repositories than this have is a copied example.
MAX_OWNERS, MAX_REPOS = 1, 2
KINDS = [*BASE, "opaque"]
#: Matches of a text that are walked together.
RUN = 256


def _any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for x in parts:
        out = out | text.contains(x)
    return out


_LONG = ("__long", lambda t: t.rlike("[A-Za-z0-9+/_-]{24}"))
#: Cheap tests that every text with a match passes; the patterns run only on the texts that pass.
GUARDS = {
    "assign": ("__assign", lambda t: _any(F.lower(t), ["passw", "secret", "token", "apikey", "api_key"])),
    "access": ("__access", lambda t: t.contains("AKIA")),
    "hex": _LONG,
    "opaque": _LONG,
}


def spans(text: Column, kind: str) -> Column:
    """array<struct<start, kind, end, hash>> of the leftmost non-overlapping matches that pass, in code points.

    The pieces between matches and the matches alternate, so their lengths add up to the positions. Of m
    matches the work grows with m * RUN and (m / RUN) squared.
    """
    pattern, group, least = BASE.get(kind, OPAQUE)
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    ends = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.transform(F.slice(ends, 1, F.size(whole)), F.length).alias("gap"), F.transform(whole, F.length).alias("len"), part.alias("part"))
    item = "struct<start:int,kind:int,end:int,hash:bigint>"
    none = F.array().cast(f"array<{item}>")
    ok = lambda x: (F.length(x["part"]) >= least) & (F.lit(kind != "opaque") | (x["part"].rlike("[0-9]") & x["part"].rlike("[A-Za-z]")))
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (at + x["gap"] + x["len"]).alias("end"), F.xxhash64(x["part"]).alias("hash"))
    walk = lambda runs, start: F.aggregate(
        runs,
        F.struct(start.cast("int").alias("at"), none.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["len"]).alias("at"), F.when(ok(x), F.concat(acc["out"], F.array(span(acc["at"], x)))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"],
    )
    # an array that grows by one is copied each time, so matches are walked in runs: their starts first, then each run by itself
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(pairs) - 1) / RUN), F.lit(0)).cast("int")), lambda i: F.slice(pairs, i * RUN + 1, RUN))
    starts = F.aggregate(
        F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda at, x: at + x["gap"] + x["len"])),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    walked = F.flatten(F.transform(F.arrays_zip(runs.alias("run"), starts.alias("start")), lambda z: walk(z["run"], z["start"])))
    return F.when(F.col(GUARDS[kind][0]), walked).otherwise(F.array().cast(f"array<{item}>"))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text_col: str = "text", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared.

    Base spans are always reported. Each candidate's value is hashed and its distinct owners and
    repositories counted over the whole corpus: one that at most max_owners owners and max_repos
    repositories have looks live, one that more have is a copied example. Opaque runs outside base
    spans are added when they look live. A null text is empty; a null owner or repository counts as
    one of its own; repeated rows are scanned each; other columns are not looked at. An empty table gives
    no rows. ``owner`` and ``repo`` are expressions over the input: the query takes a document's source as
    the owner and source and language together as the repository, as the tables name no others.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(F.concat(*[spans(F.col("text"), k) for k in BASE]))
    scanned = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.coalesce(owner.cast("string"), F.lit("\0")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("\0")).alias("repo"), text.alias("text"))
    scanned = scanned.withColumns({name: test(F.col("text")) for name, test in GUARDS.values()})
    scanned = scanned.select("rid", "id", "owner", "repo", base.alias("base"), spans(F.col("text"), "opaque").alias("opaque"))
    apart = F.filter("opaque", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    rows = stored(scanned.select("rid", "id", "owner", "repo", "base", F.concat("base", apart).alias("all")), "secret-spans")

    each = rows.where(F.size("all") > 0).select("rid", "owner", "repo", F.explode("all").alias("span")).withColumn("hash", F.col("span.hash"))
    pairs = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("weight"))  # folds a copied example map-side
    freq = pairs.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"), F.sum("weight").alias("weight"))
    freq = stored(freq, "secret-frequency")
    total = freq.agg(F.sum("weight")).first()[0] or 1
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    judged = skew_join(each, freq, ["hash"], "weight", total).withColumn("live", live).where(F.col("live") | (F.col("span.kind") < len(BASE)))
    by_doc = judged.groupBy("rid").agg(F.array_sort(F.collect_list("span")).alias("spans"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_shared"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long")
    return rows.join(by_doc, "rid", "left").select(
        F.col("id").alias(id_col), *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), F.coalesce(joined(F.col("spans")), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"),
    )
