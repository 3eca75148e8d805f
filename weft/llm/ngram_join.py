"""Near duplicates: an n-gram Jaccard join with Bayesian pruning of MinHash candidates and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import matching, skew_join, stored
from .components import components
from .exchange import dumps, heads, loads
from .hashing import U64, batches_of, mix, rolling, row_words, texts_of

NGRAM, THRESHOLD = 5, (4, 5)  # words of a shingle; the least Jaccard similarity as a fraction
#: Bands of MinHash values, and values of a band: two texts at the threshold share none of 36 bands of 5 with probability 6.2e-7.
BANDS, ROWS = 36, 5
#: Values compared before each look at the posterior, and the probability with which a link may be lost.
STEP, TOLERANCE = 10, 1e-6
#: Texts of a candidate group that one task compares with as many others.
BLOCK = 512
#: Texts, about, whose small candidate groups one call takes.
LOT = 250
#: Up to so many ids of texts in candidate groups are broadcast to find their texts again; beyond, they shuffle.
BROADCAST_IDS = 200_000

HASHES = BANDS * ROWS
_seeds = np.random.default_rng(77)
_MULT = _seeds.integers(1, 2**63, HASHES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_PLUS = _seeds.integers(1, 2**63, HASHES, dtype=np.int64).astype(U64)


def shingles(texts: pa.Array, n: int = NGRAM) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; a text of fewer words has one of all its words, an empty one none."""
    data, at = texts_of(texts)
    _, _, h, first = row_words(data, at)
    rolled = rolling(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        some = rolled[a : b - n + 1] if b - a >= n else rolling(h[a:b], b - a) if b > a else h[:0]
        some = np.sort(some)
        out.append(some[np.concatenate([[True], some[1:] != some[:-1]])] if len(some) > 1 else some)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of some non-empty sets, 32 bits each."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (end == at or held + len(sets[end]) <= 1 << 15):  # small enough to stay in cache
            held += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        heads = np.cumsum([0, *[len(s) for s in sets[at : end - 1]]])
        for k in range(HASHES):
            out[at:end, k] = np.minimum.reduceat(((x * _MULT[k] + _PLUS[k]) >> U64(32)).astype(np.uint32), heads)
        at = end
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sig), BANDS), U64)
    for r in range(ROWS):
        out = mix(out * U64(31) + sig[:, r::ROWS].astype(U64) + np.arange(1, BANDS + 1, dtype=U64) * U64(r == 0))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart: sums of two scrambles of their members."""
    return int(mix(s).sum(dtype=U64).astype(np.int64)), int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).astype(np.int64))


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By values compared: the least matches with which a link is as likely as the tolerance.

    With an even prior the similarity's posterior after m matches of n is Beta(m + 1, n - m + 1), and the
    probability of reaching t is that of at most m successes in n + 1 trials with probability t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


#: A look drops a pair below a fiftieth of the tolerance: all looks together then lose a pair at the threshold with probability 2.8e-7.
_LEAST = least_matches(THRESHOLD[0] / THRESHOLD[1], TOLERANCE / 50)


def links(left: list[np.ndarray], right: list[np.ndarray], sig_l: np.ndarray, sig_r: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets with Jaccard similarity of the threshold or more; ``same``: of one list, i < j.

    Every pair whose sizes allow it is looked at, whether or not it shares a band.
    """
    top, low = THRESHOLD
    size_l, size_r = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    near = np.minimum(size_l[:, None], size_r) * low >= np.maximum(size_l[:, None], size_r) * top
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    match = np.zeros(len(i), np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        match += (sig_l[i, n - STEP : n] == sig_r[j, n - STEP : n]).sum(1)
        keep = match >= _LEAST[n]
        i, j, match = i[keep], j[keep], match[keep]
    if len(i) > 1000:  # many: all at once, over the shingles of the blocks, some columns at a time
        inter = np.zeros((len(left), len(right)), np.float32)
        vocab, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
        owner = np.repeat(np.arange(len(left) + len(right)), np.r_[size_l, size_r])
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        for a in range(0, len(vocab), 4096):
            s = slice(*np.searchsorted(code, [a, a + 4096]))
            x = np.zeros((len(left) + len(right), 4096), np.float32)
            x[owner[s], code[s] - a] = 1
            inter += x[: len(left)] @ x[len(left) :].T
        common = inter[i, j].astype(np.int64)
    else:
        common = np.array([np.count_nonzero(left[a][np.minimum(np.searchsorted(left[a], right[b]), len(left[a]) - 1)] == right[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    ok = common * low >= (size_l[i] + size_r[j] - common) * top
    return i[ok], j[ok]


def _owned(i: np.ndarray, j: np.ndarray, sig_l: np.ndarray, sig_r: np.ndarray, nth: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are this group's to count: of a bucket of band ``nth``, those that share no band before it; -1 is a group of all bands."""
    if nth > 0 and len(i):
        left, right = band_keys(sig_l)[:, :nth], band_keys(sig_r)[:, :nth]
        mine = ~(left[i] == right[j]).any(1)
        i, j = i[mine], j[mine]
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n is linked to, directly or not."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches_of(batches, 1):
        sets = shingles(b.column(1))
        full = [k for k, s in enumerate(sets) if len(s)]
        bands: list = [None] * len(sets)
        if full:
            keys = band_keys(signatures([sets[k] for k in full])).view(np.int64)
            for k, row in zip(full, keys, strict=True):
                bands[k] = row
        keys = [set_key(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            ["id", "text_key", "n", "c1", "c2", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches_of(batches, 1):
        sets = shingles(b.column(1))
        keys = [set_key(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["n", "c1", "c2", "members"],
        )


_OUT = "node long, degree long, root long"


def _linked(nodes: np.ndarray, degree: np.ndarray, root: np.ndarray) -> pa.Table:
    return pa.table({"node": pa.array(nodes, pa.int64()), "degree": pa.array(degree, pa.int64()), "root": pa.array(nodes[root] if len(nodes) else nodes, pa.int64())})


def _distinct(table: pa.Table) -> pa.Table:
    """One row of each node of a group."""
    node, comp = table["node"].to_numpy(), table["comp"].to_numpy()
    order = np.lexsort((node, comp))
    return table.take(pa.array(order[heads(comp[order], node[order])]))


def _whole_groups(table: pa.Table) -> pa.Table:
    """Small candidate groups, each compared whole."""
    table = _distinct(table)
    comp, node, size, nth = (table[c].to_numpy() for c in ("comp", "node", "size", "nth"))
    sets = [np.frombuffer(m, U64) for m in table["members"].to_pylist()]
    out = []
    for own in np.split(np.arange(len(comp)), np.flatnonzero(np.diff(comp)) + 1):
        some = [sets[k] for k in own]
        sig = signatures(some)
        i, j = _owned(*links(some, some, sig, sig, True), sig, sig, int(nth[own[0]]))
        weight = size[own]
        degree = np.bincount(i, weight[j], len(own)) + np.bincount(j, weight[i], len(own))
        out.append(_linked(node[own], degree, _roots(len(own), i, j)))
    return pa.concat_tables(out)


def _as_block(key: tuple, table: pa.Table) -> pa.Table:
    """A block of a large candidate group as one blob; near copies pack well together."""
    table = _distinct(table)
    sets = [np.frombuffer(m, U64) for m in table["members"].to_pylist()]
    blob = dumps(table["node"].to_numpy(), table["size"].to_numpy(), np.array([len(s) for s in sets]), signatures(sets).ravel(), np.concatenate(sets).view(np.uint8))
    return pa.table({"comp": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int32()), "blocks": pa.array([table["blocks"][0].as_py()], pa.int32()), "nth": pa.array([table["nth"][0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    node, size, n, sig, members = loads(blob)
    return node, size, sig.reshape(len(node), HASHES), np.split(members.view(U64), np.cumsum(n)[:-1])


def _block_pair(key: tuple, table: pa.Table) -> pa.Table:
    """Two blocks of a group (or one, with itself) against each other."""
    rows = sorted(zip(table["block"].to_pylist(), table["blob"].to_pylist(), strict=True))
    node, size, sig, sets = _opened(rows[0][1])
    nth = table["nth"][0].as_py()
    if len(rows) == 1:
        if key[1].as_py() != key[2].as_py():  # the other block has no texts
            return _linked(node[:0], size[:0], size[:0])
        i, j = _owned(*links(sets, sets, sig, sig, True), sig, sig, nth)
    else:
        node2, size2, sig2, sets2 = _opened(rows[1][1])
        i, j = _owned(*links(sets, sets2, sig, sig2, False), sig, sig2, nth)
        j = j + len(node)
        node, size = np.concatenate([node, node2]), np.concatenate([size, size2])
    degree = np.bincount(i, size[j], len(node)) + np.bincount(j, size[i], len(node))
    return _linked(node, degree, _roots(len(node), i, j))


def _placed(nodes: DataFrame, members: DataFrame, buckets: DataFrame, groups: DataFrame, n_nodes: int, block: int) -> DataFrame:
    """(node, comp, blocks, nth): the groups that nodes are compared in.

    A candidate group is compared whole, which hands each node to as many tasks as the group has blocks.
    One that chance links have chained together costs less by its buckets, where a node meets only those
    that share a band with it, and a pair belongs to its first common band; the cheaper way is counted
    out for each group. The whole group loses no pair, buckets lose one with probability 6.2e-7.
    """
    n_blocks = lambda c: F.ceil(F.col(c) / block)
    sized = groups.groupBy("label").agg(F.count("*").alias("m"))
    by_bands = buckets.join(groups.withColumnRenamed("node", "leader"), "leader").groupBy("label").agg(F.sum(F.col("weight") * n_blocks("weight")).alias("by_bands"))
    sized = sized.join(by_bands, "label").select("label", F.col("m").alias("weight"), n_blocks("m").cast("int").alias("blocks"), (F.col("by_bands") < F.col("m") * n_blocks("m")).alias("banded"))
    sized = stored(sized, "near-sizes")
    placed = stored(skew_join(groups, sized, ["label"], "weight", max(1, n_nodes)), "near-groups")
    whole = placed.where("NOT banded").select("node", F.col("label").alias("comp"), "blocks", F.lit(-1).alias("nth"))
    if not sized.where("banded").limit(1).count():
        return whole
    own = members.join(placed.where("banded").select("node"), "node")
    own = skew_join(stored(own, "near-banded"), buckets.drop("leader").withColumn("blocks", n_blocks("weight").cast("int")), ["band"], "weight", max(1, n_nodes * BANDS), share=10_000)
    return whole.unionByName(own.where("blocks IS NOT NULL").select("node", F.col("band").alias("comp"), "blocks", "nth"))


def _judged(docs: DataFrame, id_col: str, text_col: str, block: int, broadcast_ids: int) -> DataFrame:
    """One row per input row: id, text_key, class_id, class_key (both of the class's first row), copies (rows with its shingles), n_links, n."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(docs.dtypes)[id_col]
    told = stored(rows.withColumn("text_key", text_key("text")).mapInArrow(_described, f"id {id_type}, text_key binary, n long, c1 long, c2 long, bands array<long>"), "near-rows")
    full = told.where("n > 0")
    key = ["n", "c1", "c2"]
    first = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    nodes = full.groupBy(*key).agg(F.count("*").alias("size"), F.min(first).alias("best"), F.first("bands").alias("bands"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), *key, "size", F.col("best.id").alias("first_id"), F.col("best.text_key").alias("first_key"), "bands"), "near-nodes")

    members = nodes.select("node", F.posexplode("bands").alias("nth", "band"))
    buckets = members.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("weight")).where("weight > 1")
    n_nodes = nodes.count()
    buckets = stored(buckets, "near-buckets")
    joined = skew_join(members.drop("nth"), buckets, ["band"], "weight", max(1, n_nodes * BANDS), share=10_000)
    # a node and its buckets' first nodes, at most one for each band, are all tied to the least of them: the same
    # groups as by an edge for each bucket, but texts that share most buckets repeat each other's edges
    star = joined.where("leader IS NOT NULL").groupBy("node").agg(F.collect_set("leader").alias("leaders"))
    edges = star.select(F.explode(F.array_union("leaders", F.array("node"))).alias("a"), F.array_min("leaders").alias("b"))
    groups = components(edges.where("a <> b").distinct())
    placed = _placed(nodes, members, buckets, groups, n_nodes, block)
    placed = stored(placed.join(nodes.drop("bands", "first_key"), "node"), "near-placed")

    ids = placed.select(F.col("first_id").alias("id")).distinct()
    n_ids = ids.count()
    side = F.broadcast(ids) if n_ids <= broadcast_ids else ids
    again = rows.join(side.withColumnRenamed("id", "want"), F.col("id").eqNullSafe(F.col("want")), "left_semi")
    sets = again.mapInArrow(_sets, "n long, c1 long, c2 long, members binary").join(placed.drop("first_id"), key)
    lots = max(1, -(-placed.count() // LOT))
    small = sets.where("blocks = 1").withColumn("lot", F.pmod(F.xxhash64("comp"), F.lit(lots))).groupBy("lot").applyInArrow(_whole_groups, _OUT)
    large = sets.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blobs = large.groupBy("comp", "block").applyInArrow(_as_block, "comp long, block int, blocks int, nth int, blob binary")
    paired = blobs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("comp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "nth", "blob")
    found = small.unionByName(paired.groupBy("comp", "low", "high").applyInArrow(_block_pair, _OUT))
    found = stored(found, "near-links")

    degree = found.groupBy("node").agg(F.sum("degree").alias("degree"))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())
    named = nodes.drop("bands").join(classes, "node", "left").join(degree, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stored(named, "near-named")
    first = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "first_key")
    least = named.groupBy("label").agg(F.min(first).alias("least"), F.count("*").alias("weight"))
    named = skew_join(named, least.select("label", F.col("least.first_id").alias("class_id"), F.col("least.first_key").alias("class_key"), "weight"), ["label"], "weight", max(1, n_nodes))
    named = stored(named.select(*key, "class_id", "class_key", (F.coalesce("degree", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"), F.col("size").alias("copies"), F.col("size").alias("weight")), "near-classes")
    columns = ["id", "text_key", "class_id", "class_key", "copies", "n_links", "n"]
    out = skew_join(full.drop("bands"), named, key, "weight", max(1, full.count())).select(columns)
    alone = told.where("n = 0").select("id", "text_key", F.col("id").alias("class_id"), F.col("text_key").alias("class_key"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"), "n")
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row per input row: id, class_id (least id of its class), n_links (other rows with similarity 0.8 or more), n_shingles.

    Similarity is Jaccard over the sets of word 5-grams, words being runs without U+0020 and U+0009 to
    U+000D; a class is what links connect. A text of one to four words has one shingle; an empty or null
    text has none and links to nothing. A null id comes last in its class. Repeated rows are copies. An
    empty table gives no rows; other columns are not looked at.

    1. Rows with the same set are one node from here on, so copies are never paired.
    2. Nodes that share a band of MinHash values are joined to the bucket's first node; what that
       connects is a candidate group. No pairs are listed.
    3. A group's texts are read again and compared in one task, or if they are many in blocks, each with
       each, or by their buckets where that is cheaper (see _placed): all pairs of sizes that allow a link have their MinHash values compared step by step, and are dropped once
       the posterior probability of a link is below a share of TOLERANCE; the others' shingles are counted exactly.
       A task gives each node's links and a forest, never the pairs.
    4. The forests' components are the classes.
    """
    found = _judged(docs, id_col, text_col, block, broadcast_ids)
    return found.select(F.col("id").alias(id_col), "class_id", "n_links", F.col("n").alias("n_shingles"))


def near_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The input rows that are their class's first by near_duplicates(), one of each class, with all their columns.

    The first is the row of the least id (a null one comes last), of several rows of that id the one of the
    least digest of its text, and of rows that repeat it whole one, whichever. Rows without a word are in
    classes of their own and all stay. An empty table stays empty; columns may have any names but __text.
    """
    judged = _judged(docs, id_col, text_col, block, broadcast_ids).where("n > 0")
    judged = judged.select("id", F.col("text_key").alias("__text"), "copies", (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))).alias("same"))
    judged = stored(judged.where("NOT same OR copies > 1"), "near-dropped")
    gone = judged.where("NOT same").select("id", "__text").distinct()
    again = judged.where("same").groupBy("id", "__text").agg(F.count("*").alias("n")).where("n > 1").select("id", "__text")
    out = matching(docs.withColumn("__text", text_key(text_col)), id_col, gone, ["__text"], broadcast_ids, "left_anti")
    if again.limit(1).count():  # a row that goes repeats the one that stays
        out = matching(out, id_col, again, ["__text"], broadcast_ids, "left_anti").unionByName(matching(out, id_col, again, ["__text"], broadcast_ids, "left_semi").dropDuplicates([id_col, "__text"]))
    return out.drop("__text")


def text_key(text: str) -> Column:
    """128 bits that tell texts apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
