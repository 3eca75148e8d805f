"""Catalog queries over whole tables, against brute force."""

import os
from collections import defaultdict

import duckdb
import pytest

from weft.plans import catalog
from weft.sources.tables import GRAPH_SQL


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return c


def test_bfs_over_the_whole_graph(spark, duck, sf):
    near = defaultdict(set)
    for row, col, _ in duck.sql(GRAPH_SQL).fetchall():
        near[row].add(col)
        near[col].add(row)
    level, parent, frontier = {0: 0}, {0: 0}, [0]
    while frontier:
        found = defaultdict(list)
        for v in frontier:
            for w in near[v] - level.keys():
                found[w].append(v)
        parent |= {w: min(vs) for w, vs in found.items()}
        level |= {w: level[frontier[0]] + 1 for w in found}
        frontier = list(found)
    got = lambda name: {r[0]: r[1] for r in catalog.queries()[name](spark, sf).collect()}
    assert len(level) > 1000 and max(level.values()) > 2
    assert got("bfs_levels") == got("bfs_bottom_up") == level
    assert got("bfs_parents") == parent
