"""Analysis, anomaly, Pareto and what-if on literal tables."""
import datetime as dt

from ledgerlark.operators import analysis as A
from ledgerlark.operators import anomaly as B
from ledgerlark.operators import pareto as P

from .conftest import sales_frame

D = dt.date


def test_daily_gap_and_kpis(spark):
    rows = [(D(2024, 1, 1), "a", 1.0, 10.0, 10.0), (D(2024, 1, 1), "b", 2.0, 5.0, 10.0),
            (D(2024, 1, 5), "a", 1.0, 10.0, None), (D(2024, 1, 10), None, 3.0, 1.0, 3.0),
            (None, "z", 1.0, 1.0, 100.0)]
    df = sales_frame(spark, rows)
    filled = A.daily_filled(df).orderBy("date").collect()
    assert len(filled) == 10
    assert [r["has_sales"] for r in filled].count(True) == 3
    assert filled[4]["revenue"] == 0.0 and filled[4]["has_sales"]  # all-null revenue day sums to 0
    k = A.kpi_summary(df).first()
    assert k["row_count"] == 4 and k["total_revenue"] == 23.0 and k["product_variety"] == 2
    assert k["avg_daily_revenue_all_days"] == 2.3 and k["avg_daily_revenue_sales_days"] == round(23 / 3, 2)
    top = A.top_selling_products(df).collect()
    assert [(r["product_name"], r["count"]) for r in top] == [("a", 2), ("b", 1)]


def test_range_filter_rejects_reversed(spark):
    df = sales_frame(spark, [(D(2024, 1, 1), "a", 1.0, 1.0, 1.0)])
    try:
        A.filter_range(df, "2024-02-01", "2024-01-01")
    except ValueError:
        return
    raise AssertionError("expected ValueError")


def test_iqr_spike_and_dip(spark):
    rows = [(D(2024, 1, i), "a", 1.0, 10.0, 10.0) for i in range(1, 21)]
    rows[5] = (D(2024, 1, 6), "a", 1.0, 1000.0, 1000.0)
    rows[9] = (D(2024, 1, 10), "a", 1.0, 0.01, -500.0)
    df = sales_frame(spark, rows)
    high = B.anomaly_days(df).collect()
    assert [r["date"] for r in high] == [D(2024, 1, 6)]
    both = B.anomaly_days(df, include_low=True).collect()
    assert {r["reason"] for r in both} == {B.HIGH_REASON, B.LOW_REASON}
    s = B.anomaly_summary(df).first()
    assert s["anomaly_days"] == 1 and s["total_days"] == 20 and s["highest_anomaly_date"] == D(2024, 1, 6)


def test_iqr_all_equal(spark):
    df = sales_frame(spark, [(D(2024, 1, i), "a", 1.0, 5.0, 5.0) for i in range(1, 8)])
    b = B.iqr_bounds(A.daily_filled(df)).first()
    assert b["iqr"] == 0.0 and B.anomaly_days(df).count() == 0


def test_abc_boundaries(spark):
    rows = [(D(2024, 1, 1), p, 1.0, r, r) for p, r in [("a", 80.0), ("b", 15.0), ("c", 4.0), ("d", 1.0)]]
    df = sales_frame(spark, rows)
    got = {r["product_name"]: r for r in P.pareto_abc(df).collect()}
    assert got["a"]["abc_class"] == "A"            # before = 0
    assert got["b"]["abc_class"] == "B"            # before = .80 exactly
    assert got["c"]["abc_class"] == "C"            # before = .95 exactly
    assert abs(got["d"]["cumulative_share"] - 1.0) < 1e-12
    counts = {r["abc_class"]: r["product_count"] for r in P.abc_class_counts(df).collect()}
    assert counts == {"A": 1, "B": 1, "C": 2}


def test_abc_nonpositive_total_is_empty(spark):
    rows = [(D(2024, 1, 1), "a", 1.0, 5.0, 5.0), (D(2024, 1, 1), "b", 1.0, -5.0, -5.0)]
    assert P.pareto_abc(sales_frame(spark, rows)).count() == 0


def test_pareto_distributed_equals_single_window(spark):
    rows = [(D(2024, 1, 1), f"p{i:03d}", 1.0, float(i % 37 + 1), float(i % 37 + 1)) for i in range(300)]
    df = sales_frame(spark, rows)
    a = sorted(tuple(r) for r in P.pareto_abc(df, slices=7).collect())
    b = sorted(tuple(r) for r in P.pareto_abc(df, slices=1).collect())
    assert a == b


def test_what_if(spark):
    df = sales_frame(spark, [(D(2024, 1, 1), "a", 1.0, 100.0, 100.0)])
    rows = P.what_if_scenarios(df, price_pcts=[10], qty_pcts=[-10, 0]).orderBy("scenario_id").collect()
    assert [r["simulated_revenue"] for r in rows] == [99.0, 110.0]
    assert rows[1]["change_ratio"] == 0.1
