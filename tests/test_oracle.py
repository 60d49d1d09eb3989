"""Every graph query against the same question in SQL, on the smallest tables."""

import duckdb
import pytest

from tierwalk.plans.catalogue import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(frame, columns):
    def value(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(value, row)) for row in frame[columns].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    rows = QUERIES[name](spark, DIR).toPandas()
    if name not in ORACLE_SQL:
        assert len(rows)
        return
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(rows.columns) == sorted(want.columns)
    columns = sorted(rows.columns)
    assert plain(rows, columns) == plain(want, columns)
