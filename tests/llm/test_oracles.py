"""Queries that SQL can express, against their SQL on whole tables."""

import os

import duckdb
import pytest

from weft.llm import registry


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name, sf):
    duck = duckdb.connect()
    for t in os.listdir(sf):
        duck.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    pick = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {pick} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, want))


def test_the_url_list_decides_something(spark):
    """Pages are blocked by the list and by no rule, others on the same hosts aren't, and the filter passes some that the join removes."""
    from weft.llm.url_filter import url_filter

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = registry.op4_url_filter(spark, "/root/testdata/sf0.1").collect()
    listed = {r.host for r in rows if r.listed and r.rule is None}
    assert listed and any(r.host in listed and not r.listed for r in rows) and all(r.verdict == "block" for r in rows if r.listed and r.rule is None)
    assert 0 < sum(r.listed for r in rows) < len(rows) / 2
    junk = pages.where("html RLIKE '!!'")
    assert url_filter(pages, junk, []).where("maybe AND NOT listed").count() > 0
