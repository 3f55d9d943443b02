"""Registered queries against their DuckDB oracle on the sf0.001 tables
(the driver repeats this at sf0.01)."""
import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from ledgerlark.sources.tables import TABLES

from .conftest import SF_SMALL

FAST = ["kpi_summary", "daily_sales_filled", "top_revenue_products", "anomaly_summary", "pareto_abc",
        "abc_class_counts", "what_if_scenarios", "clean_sales", "date_order", "cleaning_report",
        "column_profile", "best_mapping", "weekly_history_features", "forecast_summary", "extra_column_roles"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return str(v)[:10]
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_registry_shape():
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = queries()[name](spark, SF_SMALL)
    cur = con.execute(oracle_sql()[name])
    dcols = [c[0] for c in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, cur.fetchall())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["product_name", "revenue", "revenue_share", "cumulative_share", "abc_class"]
    assert df.count() > 0
