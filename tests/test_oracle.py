"""Every query of the library against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from strataweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def value(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(name, spark, con, sf_dir):
    df = catalog.queries()[name](spark, sf_dir)
    rows = [tuple(value(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name in SQL:
        cur = con.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in sorted(names)]
        assert sorted(rows, key=repr) == sorted((tuple(value(r[i]) for i in order) for r in cur.fetchall()), key=repr)
