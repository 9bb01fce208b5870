"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == names
    order = [want.columns.index(n) for n in names]
    rows = sorted(tuple(plain(r[k]) for k in order) for r in want.fetchall())
    assert sorted(tuple(map(plain, r)) for r in got.select(*[f"`{n}`" for n in names]).collect()) == rows
