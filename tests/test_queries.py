"""Every registered relational query against its SQL twin in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tandem import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(row):
    return tuple(0.0 if isinstance(v, float) and v == 0 else v for v in row)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    told = duck.sql(queries.ORACLE[name])
    names = sorted(frame.columns)
    assert names == sorted(told.columns)
    ours = sorted((plain(r[c] for c in names) for r in frame.collect()), key=repr)
    place = [list(told.columns).index(c) for c in names]
    theirs = sorted((plain(r[i] for i in place) for r in told.fetchall()), key=repr)
    assert ours == theirs
    assert ours, "a query without rows proves nothing"
    for c, i in zip(names, place):
        assert KINDS[frame.schema[c].dataType.simpleString()] == str(told.types[i]), c
