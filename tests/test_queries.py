"""Every registered query of the basin against its SQL in another engine."""

import duckdb
import pytest

from rainfold.plans import files  # noqa: F401
from rainfold.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    clean = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = plain(df.select(*[f"`{c}`" for c in columns]).collect())
    assert got
    if name in ORACLE:
        cursor = duck.execute(ORACLE[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == plain([tuple(r[k] for k in at) for r in cursor.fetchall()])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 12
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
