"""Every query of the subpackage that SQL can express, against DuckDB on the whole tables of a scale."""

import duckdb
import pytest

from eventloom.llm import catalog

SF = "/root/testdata/sf0.01"


def plain(v):
    return None if v != v else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    want = sorted(str([plain(v) for v in r]) for r in cur.fetchall())
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str([plain(v) for v in r]) for r in got.select(columns).collect()) == want
