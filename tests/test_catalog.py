"""Every query against its SQL on the smallest tables, as the driver does it."""

import math

import pytest

from quern.plans import catalog


def cells(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(float(v))
        return str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf)
    columns = sorted(got.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    assert sorted(d[0] for d in found.description) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert cells(got.select(*columns).collect()) == cells(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]
