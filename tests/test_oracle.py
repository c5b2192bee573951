"""Each query against its SQL on DuckDB, rows as multisets; queries that must not be empty."""

from collections import Counter
from datetime import date, datetime

import duckdb
import pytest

from tidemark.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.01"


def shown(v):
    return str(v)[:19] if isinstance(v, (date, datetime)) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name not in ORACLE:
        return
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{DATA}/events.parquet')")
    got = con.execute(ORACLE[name])
    columns = [c[0] for c in got.description]
    want = Counter(tuple(shown(r[columns.index(c)]) for c in sorted(columns)) for r in got.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(shown(r[c]) for c in sorted(columns)) for r in rows) == want
