"""Plan shapes: passes over the raw rows, no row copies per column, no caches left behind."""
import itertools

from ledgerlark.plans import REGISTRY
from ledgerlark.sources.tables import sales

from .conftest import SF_SMALL


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_report_reads_the_rows_once(spark):
    plan = _final_plan(REGISTRY["sales_report"].fn(spark, SF_SMALL))
    assert "lineitem" not in plan  # every section reads the written base


def test_weekly_features_read_the_rows_twice_at_most(spark):
    plan = _final_plan(REGISTRY["weekly_feature_join"].fn(spark, SF_SMALL))
    assert plan.count("FileScan parquet") <= 4


def test_extra_profile_does_not_expand(spark):
    assert "Expand" not in _final_plan(REGISTRY["extra_column_profile"].fn(spark, SF_SMALL))


def test_date_issues_are_counted_without_a_limit(spark):
    plan = _final_plan(REGISTRY["date_issues"].fn(spark, SF_SMALL))
    assert "Limit" not in plan and "TakeOrdered" not in plan


def test_forecast_leaves_no_cache(spark):
    REGISTRY["future_forecast"].fn(spark, SF_SMALL)
    assert "InMemoryTableScan" not in _final_plan(REGISTRY["weekly_sales"].fn(spark, SF_SMALL))


def test_fingerprint_ignores_partitioning(spark):
    from ledgerlark.operators.summary import table_fingerprint
    from ledgerlark.sources.tables import sales
    df = sales(spark, SF_SMALL)
    assert table_fingerprint(df).first() == table_fingerprint(df.repartition(7)).first()
    assert table_fingerprint(df).first() != table_fingerprint(df.where("quantity > 1")).first()


def test_untyped_table_analyses_like_a_typed_one(spark):
    from ledgerlark.operators import analysis
    from ledgerlark.sources.tables import sales
    df = sales(spark, SF_SMALL)
    text = df.select(*[df[c].cast("string").alias(c) for c in ("date", "product_name", "quantity", "unit_price", "revenue")])
    assert analysis.kpi_summary(text).first() == analysis.kpi_summary(df).first()
    assert analysis.top_revenue_products(text, "1994-01-01", "1995-01-01").collect() == \
        analysis.top_revenue_products(df, "1994-01-01", "1995-01-01").collect()


def test_part_joins_after_orders(spark):
    """The texts of ``part`` are shuffled with ``part`` alone, not once more with every line; dates travel as days."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = sales(spark, SF_SMALL, with_orders=True, with_customer=True)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "p_partkey" in joins[0] and "o_orderkey" in joins[-1] and len(joins) == 4
    below = plan[plan.index(joins[0]):].splitlines()[1:]
    assert any("as date" in line for line in below) and not any("p_name" in line for line in below if "Join" in line)


def test_rows_are_numbered_before_the_texts_are_made(spark):
    plan = REGISTRY["cleaning_report_examples"].fn(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Window [rank(" in line)
    depth = plan[at].index("Window")
    below = list(itertools.takewhile(lambda line: not line[:depth].strip(" :"), plan[at + 1:]))
    assert any("Join Inner" in line for line in below) and not any(" adet" in line for line in below)


def test_h_is_made_before_the_join(spark):
    """One number of a line is shuffled for ``h``, not the keys it is made of."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = sales(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    above = plan[:plan.index("Join Inner")]
    assert "l_suppkey" not in above and "l_suppkey" in plan
