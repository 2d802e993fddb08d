"""Every registered query with SQL gives the rows of that SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lotgrid.plans import detection, discovery, places, summaries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = detection.QUERIES | places.QUERIES | summaries.QUERIES | discovery.QUERIES
ORACLE = detection.ORACLE | places.ORACLE | summaries.ORACLE | discovery.ORACLE

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v + 0.0:.6g}"
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(norm(r[k]) for k in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cursor = duck.execute(ORACLE[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).limit(5).count() > 0


def test_every_sql_has_a_query():
    assert not ORACLE.keys() - QUERIES.keys()
