"""Every query of the engine against its SQL on an independent engine."""

import os
from decimal import Decimal

import duckdb
import pytest

from weirmesh.plans.catalogue import all_queries
from weirmesh.plans.oracles import all_oracles


def plain(rows):
    return sorted(tuple(str(float(v)) if isinstance(v, float | Decimal) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_same_rows(spark, sf, duck, name):
    df = all_queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    found = duck.execute(all_oracles()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == plain([r[names.index(c)] for c in columns] for r in found.fetchall())


def test_every_query_but_kernels_has_sql():
    assert set(all_queries()) - set(all_oracles()) == {"terrain_steps"}
