"""Queries on events whose keys are far beyond those of the test data.

Coordinates repeat after SPARSE[0] * SPARSE[1] keys, so keys moved by a multiple of it give the rows
that the SQL finds for the keys as they are, with ids moved as far. A multiple of 12 retains id % 3 and id % 4.
"""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_parity import plain

from weirmesh.plans.catalogue import all_queries
from weirmesh.plans.oracles import all_oracles
from weirmesh.plans.tables import SPARSE

FAR = 12 * SPARSE[0] * SPARSE[1]


@pytest.fixture(scope="session")
def far(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("far")
    for f in os.listdir(sf):
        os.symlink(f"{sf}/{f}", folder / f)
    os.remove(folder / "events.parquet")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.withColumn("event_id", F.col("event_id") + FAR).write.parquet(str(folder / "events.parquet"))
    return str(folder)


NAMES = [
    "precision_recall",
    "resume_limit",
    "resume_anti_join",
    "resume_terminal",
    "removed_barriers",
    "snap_to_river",
    "river_touch_semi",
    "water_signature_points",
]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_far_out(spark, sf, far, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    found = con.execute(all_oracles()[name])
    names = [c[0] for c in found.description]
    rows = [tuple(v + FAR if c == "id" else v for c, v in zip(names, r, strict=True)) for r in found.fetchall()]
    df = all_queries()[name](spark, far)
    assert set(df.columns) == set(names)
    got = plain(df.select(*names).collect())
    assert got == plain(rows) and got
