"""Every registered accounting query equals its SQL on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from usagemill.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "lineitem part orders events conversations"
#: Whole syncs of all logs, which take long here; tests/test_sync.py has small ones.
SYNCS = {"a13_ledger_reports", "i5_stream_sync", "d23_lasting_merges", "d24_issue_validity", "d26_claude_rebuild", "d26_pi_rebuild", "d26_opencode_rebuild", "d26_codex_rebuild", "i2_retained_history"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(frame: pd.DataFrame) -> list[str]:
    def value(v):
        if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
            return None
        if hasattr(v, "item"):
            v = v.item()
        if hasattr(v, "isoformat"):
            return str(v)[:10]
        return int(v) if isinstance(v, float) and v == int(v) else v

    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(value, r))) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES.keys() - SYNCS))
def test_equals_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
