"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from tidemark import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in ("events", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def rounded(rows):
    return sorted((tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, duck, name):
    frame = plans.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    found = duck.execute(plans.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    wanted = [tuple(row[names.index(c)] for c in columns) for row in found.fetchall()]
    assert rounded(map(tuple, frame.select(*columns).collect())) == rounded(wanted)
