"""Every registered query of the engine against its SQL, over the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from veilframe.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sql, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in catalogue.oracle_sql():
        r = sql.execute(catalogue.oracle_sql()[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(str(tuple(plain(row[k]) for k in at)) for row in r.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) > 200
    assert e.entry(spark).count() == 5
