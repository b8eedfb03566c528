"""Every registered query with SQL against DuckDB on the smallest tables, and every one without for rows."""

import math

import duckdb
import pytest

from trailmark.plans import aggregate_plans, contract_plans, decision_plans, join_plans, mask_plans, ordered_plans, rule_plans, source_plans  # noqa: F401
from trailmark.plans.registry import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in ORACLES:
        assert got
        return
    r = duck.execute(ORACLES[name])
    at = [d[0] for d in r.description]
    want = sorted((tuple(plain(x[at.index(c)]) for c in cols) for x in r.fetchall()), key=str)
    assert sorted(at) == cols and got == want
