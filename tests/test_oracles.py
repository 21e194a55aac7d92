"""Every query that has SQL returns the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
HERE = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in os.listdir(DATA):
        name = t.removesuffix(".parquet")
        path = f"{DATA}/{t}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{t}") else "")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def canonical(rows):
    out = []
    for row in rows:
        out.append(tuple("nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else v if isinstance(v, (bool, int, type(None))) else str(v) for v in row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", HERE)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = canonical(tuple(r[c] for c in columns) for r in df.collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == canonical(duck.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
