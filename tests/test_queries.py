"""Every registered query against its SQL twin."""

import math

import duckdb
import pytest

from trialloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)

    def plain(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        x = float(x)
        return None if math.isnan(x) else x

    return sorted(([plain(r[i]) for i in order] for r in values), key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sql, name):
    df = registry.queries()[name](spark, SF)
    cur = sql.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.FLAGSHIP
