"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from devquarry.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "sale_lines"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.sql(registry.oracle_sql()[name])
    found = registry.queries()[name](spark, SF).select(*wanted.columns)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted.fetchall()))
