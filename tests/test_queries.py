"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from corpuscle.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def tidy(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([tidy(r[c]) for c in cols]) for r in df.collect())
    assert got
    if name in catalogue.ORACLE_SQL:
        cur = duck.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert got == sorted(repr([tidy(r[names.index(c)]) for c in cols]) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
