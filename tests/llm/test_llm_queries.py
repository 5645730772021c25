"""Every query that has SQL against it, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from siftwork.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_like_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got, want = registry.QUERIES[name](spark, SF), con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(repr([plain(v) for v in r]) for r in got.select(*columns).collect())
    assert rows == sorted(repr([plain(v) for v in r]) for r in want.fetchall())
