"""Exact and near duplicates."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

from weft.llm import ngram_join as near
from weft.llm.components import components
from weft.llm.exact_dedup import directory, exact_dedup, exact_filter
from weft.llm.ngram_join import least_matches, near_duplicates, near_filter

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def test_directory_doubles_and_splits_only_what_is_overfull():
    counts = {0b0000: 5, 0b0001: 5, 0b1000: 1}
    depth, slots = directory(counts, capacity=5, max_depth=4)
    assert depth == 4 and len(slots) == 16
    assert slots[8:] == [(1, 1)] * 8  # the upper half never split
    assert slots[0] == (4, 0) and slots[1] == (4, 1)
    assert directory({}, 5, 4) == (0, [(0, 0)])
    assert directory({3: 100}, 5, 2)[1][3] == (2, 3)  # at full depth it chains


def _exact(rows):
    groups = defaultdict(list)
    for i, x in rows:
        groups[SPACE.sub("", x or "")].append((-len(x or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


def test_exact_dedup_on_messy_rows(messy):
    rows = [tuple(r) for r in messy.select("doc_id", "text").collect()]
    want = _exact(rows)
    # short keys collide, so that chains are long
    for options in ({}, {"capacity": 1, "max_depth": 3, "broadcast_keys": 0}, {"key_bits": 1}, {"key_bits": 2, "broadcast_keys": 0, "capacity": 1}):
        got = exact_dedup(messy, **options).collect()
        assert len(got) == len(rows)
        by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
        assert all((r.keep_id, r.group_size) == by_sha[r.text_sha256] for r in got)
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(by_sha))
        kept = exact_filter(messy, **options)
        assert kept.columns == messy.columns
        assert Counter((SPACE.sub("", r.text or ""), r.doc_id) for r in kept.collect()) == Counter((k, v[0]) for k, v in want.items())


def test_exact_filter_keeps_the_row_that_exact_dedup_keeps(spark):
    for rows, want in (([(1, "ab"), (1, "a  b")], [(1, "a  b")]), ([(1, "a  b"), (1, "ab")], [(1, "a  b")]), ([(1, "a b"), (1, "a b"), (2, "ab"), (1, "ab")], [(1, "a b")]), ([(None, "x"), (None, "x "), (7, "x")], [(None, "x ")]), ([(3, None), (2, ""), (2, "")], [(2, "")])):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        options = {"broadcast_keys": 0} if len(rows) == 2 else {}
        assert [tuple(r) for r in exact_filter(df, **options).collect()] == want


def test_exact_dedup_ties_and_empty(spark, messy):
    df = spark.createDataFrame([(5, "ab"), (3, "ab"), (4, "a b")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in exact_dedup(df).collect()} == {5: False, 3: False, 4: True}
    assert exact_dedup(messy.limit(0)).count() == 0 and exact_filter(messy.limit(0)).count() == 0


def _brute(rows):
    sets = {}
    for i, x in rows:
        w = [y for y in SPACE.split(x or "") if y]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def _family(n):
    base = [f"t{k}" for k in range(120)]
    rows = [(i, " ".join([*base[:k], f"edit{i}", *base[k + 1 :]])) for i, k in enumerate(range(5, 5 + n))]
    rows += [(1000 + i, " ".join(f"u{i}_{k}" for k in range(40))) for i in range(20)]
    return [*rows, (2000, rows[0][1]), (2001, "one two"), (2002, "one  two"), (2003, ""), (2004, None)]


def test_near_duplicates_against_brute_force(spark):
    rows = _family(30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _brute(rows)
    for options in ({}, {"block": 4, "broadcast_ids": 0}):
        got = near_duplicates(df, **options).collect()
        assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    assert {r.doc_id for r in near_filter(df).select("doc_id").collect()} == {i for i, (c, _) in want.items() if c == i}


def test_near_filter_keeps_one_row_of_a_class(spark):
    t = " ".join(f"w{i}" for i in range(40))
    for rows, n in (([(1, t), (1, t), (1, t + " x"), (2, t)], 1), ([(None, t), (None, t)], 1), ([(5, t), (4, t + " y"), (4, t + " y"), (4, "other")], 2), ([(1, ""), (1, ""), (2, None)], 3)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = near_filter(df, **({"broadcast_ids": 0} if len(rows) == 4 else {})).collect()
        least = min((r[0] is None, r[0]) for r in rows)
        assert len(got) == n and least in {(r.doc_id is None, r.doc_id) for r in got}


def _brute_links(texts):
    """(links, classes) by exact Jaccard similarity of all pairs, by an inverted index of shingles."""
    sets = {}
    for i, x in texts:
        w = [y for y in SPACE.split(x or "") if y]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    common = Counter()
    for ids in holders.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    links = {(a, b): c / (len(sets[a]) + len(sets[b]) - c) for (a, b), c in common.items() if 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return links, {i: find(i) for i in sets}


def test_recall_by_true_similarity_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    links, classes = _brute_links([(r.doc_id, r.text) for r in docs.collect()])
    degree = Counter(x for pair in links for x in pair)
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert sum(0.8 <= s < 1 for s in links.values()) > 3  # different texts, so recall is of more than copies
    assert {i: r.class_id for i, r in got.items()} == classes and {i: r.n_links for i, r in got.items()} == {i: degree[i] for i in classes}


def test_a_group_of_thousands(spark):
    rnd = np.random.default_rng(6)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(1500):  # one or two words of a hundred changed, so that many pairs lie near the threshold
        w = list(base)
        for k in rnd.integers(0, 100, 1 + i % 2):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    sets = [{hash(tuple(t.split()[k : k + 5])) for k in range(96)} for _, t in rows]
    code = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    x = np.zeros((len(rows), len(code)), np.float32)
    for i, s in enumerate(sets):
        x[i, [code[g] for g in s]] = 1
    common = x @ x.T
    size = x.sum(1)
    want = (5 * common >= 4 * (size[:, None] + size - common)).sum(1) - 1
    assert 0 < want.min() < want.max() < 1499
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.n_links for r in got.orderBy("doc_id").collect()] == want.astype(int).tolist()


def test_groups_that_are_chained_are_compared_by_buckets(spark):
    """Texts of a ring, each near its neighbours: one candidate group, and much cheaper by buckets."""
    n, step = 260, 4
    words = [f"r{k}" for k in range(n * step)]
    rows = [(i, " ".join((words * 2)[i * step : i * step + 60])) for i in range(n)]
    want = _brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = []
    real = near.stored
    near.stored = lambda d, name: told.append((name, real(d, name))) or told[-1][1]
    try:
        got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(df, block=6).collect()}
    finally:
        near.stored = real
    assert dict(told)["near-sizes"].where("banded").count() == 1
    assert got == want and 0 < max(k for _, k in want.values()) < 20


def test_near_duplicates_on_messy_rows(messy):
    got = near_duplicates(messy)
    assert got.count() == messy.count()
    same = {r.doc_id: (r.class_id, r.n_links) for r in got.collect() if r.doc_id in (0, 1, 8)}
    assert set(same.values()) == {(0, 4)}
    assert near_filter(messy).columns == messy.columns
    assert near_duplicates(messy.limit(0)).count() == 0


def test_links_need_no_common_band():
    sets = [np.sort(np.random.default_rng(k).integers(0, 2**63, 60).astype(np.uint64)) for k in range(2)]
    sig = near.signatures(sets)
    other = sig.copy()
    other[:, :: near.ROWS] ^= 1  # four of five values agree in every band
    assert not (near.band_keys(sig) == near.band_keys(other)).any()
    i, j = near.links(sets, sets, sig, other, False)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (1, 1)]


def test_pairs_at_the_threshold_share_a_band():
    words = np.random.default_rng(5).integers(0, 2**63, (20_000, 10)).astype(np.uint64)
    a, b = (near.band_keys(near.signatures(list(np.sort(words[:, k : k + 9], 1)))) for k in range(2))  # 8 of 10 in common
    assert (a == b).any(1).all()


def test_posterior_bound():
    least = least_matches(0.8, 1e-6)
    assert sorted(least) == list(range(near.STEP, near.HASHES + 1, near.STEP))
    assert all(0 <= m <= 0.8 * n for n, m in least.items()) and least[100] > 55


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
