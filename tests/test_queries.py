"""Every library query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from citeloom.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(cols, data):
    at = [cols.index(c) for c in sorted(cols)]
    return sorted([tuple(round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in at) for r in data], key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    ran = con.execute(ORACLE[name])
    want = rows([d[0] for d in ran.description], ran.fetchall())
    assert got == want
