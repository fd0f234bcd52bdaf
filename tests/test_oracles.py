"""Each registered query of the article operators against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from newslake.plans.catalog import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "events", "documents", "pages", "conversations", "labels", "benchmark")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    found, want = QUERIES[name](spark, DIR), con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    tidy = lambda x: round(x, 7) if isinstance(x, float) else x
    assert sorted(repr([tidy(r[c]) for c in names]) for r in found.collect()) == sorted(repr([tidy(x) for x in r]) for r in want.fetchall())


def test_every_query_but_the_page_text_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"page_texts"}
