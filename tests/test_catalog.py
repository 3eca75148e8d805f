import functools
import os

import duckdb
import pytest

from weft.plans import catalog

NAMES = sorted(catalog.oracle_sql())
LARGER = "/root/testdata/sf0.01"


@functools.cache
def duck(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return c


@pytest.mark.parametrize(("name", "folder"), [*((n, None) for n in NAMES), *((n, LARGER) for n in NAMES if n.startswith(("bgp_", "mat_reduce", "mcl")))])
def test_query_equals_its_sql(spark, sf, name, folder):
    sf = folder or sf
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    pick = ", ".join(f'"{c}"' for c in columns)
    want = duck(sf).sql(f"SELECT {pick} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*[f"`{c}`" for c in columns]).collect()))) == sorted(map(repr, want))


def test_every_query_without_sql_gives_rows(spark, sf):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, sf).count() > 0
