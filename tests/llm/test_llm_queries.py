"""The registered queries run over the smallest test data; those with SQL give its rows."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from framewright.llm import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = entry.queries()[name](spark, str(DATA)).toArrow()
    if name in registry.SQL:
        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = con.sql(registry.SQL[name]).to_arrow_table()
        rows = lambda t: sorted(zip(*[t.column(c).to_pylist() for c in sorted(t.column_names)], strict=True))
        assert rows(got) == rows(want)
    else:
        assert got.num_rows > 0 or name.startswith("p6")
