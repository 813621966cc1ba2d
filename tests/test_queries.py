"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from pagewarden.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(names).collect())
    cols = ", ".join(f'"{c}"' for c in names)
    want = sorted(tuple(plain(v) for v in r) for r in db.sql(f"SELECT {cols} FROM ({catalog.ORACLES[name]})").fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["category", "hits", "pages", "words"]
