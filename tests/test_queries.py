"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest
from conftest import SF

from veilcount.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: At this size noise hides all bins, in SQL as well.
EMPTY = {"r2_r6_reliability"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def shown(v):
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    assert rows or name in EMPTY
    if name in ORACLE_SQL:
        found = duck.sql(ORACLE_SQL[name])
        at = [found.columns.index(c) for c in names]
        assert rows == sorted(tuple(shown(r[i]) for i in at) for r in found.fetchall())
