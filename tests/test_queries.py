"""Registered queries against their SQL at the smallest scale."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from biolab.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    """Columns and rows of every query with SQL, run side by side: most of their time is planning."""

    def run(name):
        df = registry.QUERIES[name](spark, SF)
        return df.columns, df.collect()

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in registry.ORACLES}


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(results, name):
    columns, rows = results[name].result()
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "documents", "conversations", "pages"):
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    shown = lambda rows: sorted(repr(tuple(round(float(x), 6) + 0.0 if isinstance(x, float) else list(x) if isinstance(x, (list, tuple)) else x for x in r)) for r in rows)
    assert shown(rows) == shown(con.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({registry.ORACLES[name]})").fetchall())


def test_entry_has_every_query(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
