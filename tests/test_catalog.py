"""Every registered query against its SQL at the smallest scale."""

import math

import duckdb
import pytest

from spotfield.catalog.oracles import ORACLES
from spotfield.catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set memory_limit='4GB'")
    c.execute("set temp_directory=''")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(dict(zip(names, r))[c]) for c in sorted(names)]) for r in cursor.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    assert got == want


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["specimen", "complex_id", "obs_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["flow_association", "flow_range"])
def test_flows(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == 3
    if name == "flow_association":
        assert all(0 < r.p <= 1 and r.q >= r.p - 1e-12 for r in rows)
