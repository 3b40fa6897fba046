"""Every registered relational query against its SQL in DuckDB."""

import duckdb
import pytest

from tessera.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def other(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def text(rows):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, other, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    if name in SQL:
        found = other.sql(SQL[name])
        assert sorted(found.columns) == names
        assert text(got) == text(other.sql(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall())
    else:
        assert got


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
