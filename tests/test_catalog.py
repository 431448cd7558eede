"""Every query of the catalog: against its SQL where there is one, and that it has rows."""

from pathlib import Path

import duckdb
import pytest

from tierwalk.plans import catalog

SF = "/root/testdata/sf0.001"
#: Filters that no row of the smallest tables passes.
EMPTY = {"sub_by_sic_prefix"}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_like_sql(spark, name):
    got = catalog.queries()[name](spark, SF)
    rows = got.collect()
    assert rows or name in EMPTY
    if name not in catalog.oracle_sql():
        return
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: repr(r)
    assert sorted((tuple(r[n] for n in names) for r in rows), key=key) == sorted(want.fetchall(), key=key)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["source", "score", "rating", "reasons"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
