"""Every query that has an oracle gives the oracle's rows on the smallest scale."""

import math
import os

import duckdb
import pytest

from tracelake.plans import catalog

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.12g}"
        return str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name in catalog.oracle_sql():
        found = duck.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
        assert plain(got) == plain(want)
    else:
        assert len(set(got)) == len(got)
