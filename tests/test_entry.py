"""Driver contract: entry, query registry and a DuckDB comparison at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from ticketlake.sources.fixtures import TABLES

from .conftest import SF001


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "sla_breach_rate_pct" in df.columns


def test_oracles_have_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 80


@pytest.mark.parametrize("name", ["a1", "a3", "a11_k6", "t2_u1", "q5", "x_suite", "v3_k8_j3_j4", "r2", "g4"])
def test_matches_duckdb(spark, name):
    import sys
    from pathlib import Path
    sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
    from oracle_check import rows_key
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = E.queries()[name](spark, SF001)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_key(df.columns, [tuple(r) for r in df.collect()]) == rows_key(dcols, res.fetchall())
