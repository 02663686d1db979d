"""Every query that has SQL, against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from folioworks import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or not isinstance(x, (list, str, bytes)) and pd.isna(x):
        return "null"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else str(round(x, 6))
    return str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(cell, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows(got) == rows(duck.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.entry(spark).columns) == {"lang", "originals", "duplicates", "first_batch"}
    assert set(e.oracle_sql()) <= set(e.queries())
