"""Every registered query against its SQL, at the smallest scale."""

import duckdb
import pytest
from helpers import plan

import __spark_entry__ as entry_points
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def ordered(rows):
    plain = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    columns = sorted(df.columns)
    for node in ("CartesianProduct", "NestedLoopJoin", "SinglePartition"):
        assert node not in plan(df)
    actual = ordered(tuple(r[c] for c in columns) for r in df.collect())
    result = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = ordered(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert len(actual) > 0
    assert actual == expected


def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
