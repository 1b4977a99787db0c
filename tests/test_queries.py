"""Every query of the library against its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from quire.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = normal(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    result = duck.execute(sql)
    assert got == normal([c[0] for c in result.description], result.fetchall())
