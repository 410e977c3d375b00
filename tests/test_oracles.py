"""Every query of the stock-out analytics against its SQL in DuckDB; values are equal to the sixth digit."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from shelfsight.plans import planning, planning_sql, retail, retail_sql, states, states_sql

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {**retail.QUERIES, **states.QUERIES, **planning.QUERIES}
ORACLES = {**retail_sql.ORACLES, **states_sql.ORACLES, **planning_sql.ORACLES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return "nan" if isinstance(v, float) and math.isnan(v) else float(v) + 0.0


def alike(x, y):
    return x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-9 * max(1, abs(x)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    order = lambda rows: sorted(rows, key=lambda r: tuple(repr(round(x, 3) + 0.0 if isinstance(x, float) else x) for x in r))
    got = order(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = order(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert len(got) == len(want)
    assert all(alike(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


#: Resampling, fitted trees and a search: tested against plain versions instead.
PLAIN = {
    "bootstrap_wmape", "tree_scores", "qr_scores", "qr_eval", "qr_frozen", "qr_locked_metrics", "qr_criteria", "qr_audit", "qr_models",
    "replenishment_scores", "replenishment_segments", "replenishment_acceptance", "replenishment_comparison", "tweedie_forecast", "tweedie_eval",
}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(ORACLES) == PLAIN
