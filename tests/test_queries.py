"""Every registered query with SQL against that SQL, at the smallest size."""

import datetime
import os

import duckdb
import numpy as np
import pytest

from siltbed.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (np.ndarray, list, tuple)):
        return [plain(x) for x in v]
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == sorted(df.columns)
    order = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in order]) for r in rows)
    theirs = sorted(repr([plain(dict(zip(found.columns, r, strict=True))[c]) for c in order]) for r in found.fetchall())
    assert ours == theirs
