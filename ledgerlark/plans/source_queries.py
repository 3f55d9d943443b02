"""Registered extra-column (F1-F3) and summary (D1, D3) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import round6
from ..operators import features as W
from ..operators import forecast as L
from ..operators import summary as D
from ..sources.tables import DIRTY_MAPPING, dirty_sales, sales
from . import sql as Q
from .catalog import register

EXTRAS = ["discount", "l_returnflag", "p_brand", "p_type", "order_date"]


def sales_extras(spark, d):
    return sales(spark, d, with_orders=True)


_PROFILE_COLS = ["position", "column", "missing_ratio", "numeric_ratio", "date_parse_ratio",
                 "date_like_value_ratio", "unique_count", "unique_ratio", "is_constant"]

_XP = """xp as (
  select 1 as position, 'discount' as "column", count(case when discount is null then 1 end) as m,
         count(discount) as u, 0 as dd, count(*) as l, count(distinct discount) as q, count(*) as n from sales
  union all
  select 2, 'l_returnflag', count(case when l_returnflag is null then 1 end),
         count(try_cast(l_returnflag as double)), count(try_cast(l_returnflag as timestamp)),
         count(case when regexp_matches(l_returnflag, '[/.\\-]') or regexp_matches(lower(l_returnflag), 'jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec') then 1 end),
         count(distinct l_returnflag), count(*) from sales
  union all
  select 3, 'p_brand', count(case when p_brand is null then 1 end),
         count(try_cast(p_brand as double)), count(try_cast(p_brand as timestamp)),
         count(case when regexp_matches(p_brand, '[/.\\-]') or regexp_matches(lower(p_brand), 'jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec') then 1 end),
         count(distinct p_brand), count(*) from sales
  union all
  select 4, 'p_type', count(case when p_type is null then 1 end),
         count(try_cast(p_type as double)), count(try_cast(p_type as timestamp)),
         count(case when regexp_matches(p_type, '[/.\\-]') or regexp_matches(lower(p_type), 'jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec') then 1 end),
         count(distinct p_type), count(*) from sales
  union all
  select 5, 'order_date', count(case when order_date is null then 1 end), 0, count(order_date), count(order_date),
         count(distinct order_date), count(*) from sales),
xprof as (
  select cast(position as integer) as position, "column", round_even(m / n, 6) as missing_ratio,
         round_even(u / n, 6) as numeric_ratio, round_even(dd / n, 6) as date_parse_ratio,
         round_even(l / n, 6) as date_like_value_ratio, q as unique_count,
         round_even(q / greatest(n - m, 1), 6) as unique_ratio, q <= 1 as is_constant
  from xp)"""


@register("extra_column_profile", Q.with_(Q.SALES_WITH_ORDERS, _XP) + "select * from xprof")
def q_extra_profile(spark, d):
    return W.extra_column_profile(sales_extras(spark, d), EXTRAS).select(*_PROFILE_COLS)


@register("extra_column_roles", Q.with_(Q.SALES_WITH_ORDERS, _XP) + """
select cast(position as integer) as position, "column",
       case when is_constant then 'excluded'
            when 1 - missing_ratio < 0.2 then 'excluded'
            when "column" = 'discount' then 'numeric_measurement'
            when "column" = 'order_date' and date_parse_ratio >= 0.8 and numeric_ratio < 0.5 then 'secondary_date'
            when numeric_ratio >= 0.8 and unique_ratio <= 0.5 then 'numeric_measurement'
            when (unique_count > 100 or unique_ratio > 0.5) then 'excluded'
            else 'categorical_summary' end as role
from xprof""")
def q_extra_roles(spark, d):
    prof = W.extra_column_profile(sales_extras(spark, d), EXTRAS)
    return W.extra_column_roles(prof, "discount").select("position", "column", "role")


@register("date_delta_feature", Q.with_(Q.SALES_WITH_ORDERS) + """
select h, cast(order_date - date as double) as order_date_delay_days from sales""")
def q_delta(spark, d):
    return _delta_with_h(spark, d)


def _delta_with_h(spark, d):
    src = sales_extras(spark, d)
    fs = W.build_feature_source(src, EXTRAS, "discount",
                                core=("date", "product_name", "quantity", "unit_price", "revenue", "h"))
    return fs.frame.select("h", "order_date_delay_days")


@register("feature_source")
def q_feature_source(spark, d):
    return W.build_feature_source(sales_extras(spark, d), EXTRAS, "discount").frame


@register("business_summary")
def q_business_summary(spark, d):
    s = sales(spark, d)
    wk = W.weekly_features(s, ["discount"], numeric_extras=["discount"])
    m = L.forecast_metrics(L.moving_average_predictions(wk, L.train_test_split(wk)))
    fs = L.forecast_summary(L.future_forecast_baseline(wk), wk, m)
    return D.business_summary(s, forecast_summary=fs.withColumns(
        {c: round6(F.col(c)) for c in ("total", "mean", "conservative", "optimistic")}))


@register("table_fingerprint")
def q_fingerprint(spark, d):
    return D.table_fingerprint(sales(spark, d))


@register("text_extra_features", Q.with_(Q.SALES).rstrip() + """
select cast(date_trunc('week', date) as date) as week_start,
       coalesce(cast(sum(cast(case when h % 3 = 2 then unit_price end as decimal(38,10))) as double), 0.0) as price_text_sum,
       max(case when h % 3 = 2 then unit_price end) as price_text_max,
       cast(coalesce(sum(case when h % 10 <> 0 then 3 end), 0) as double) as ship_delay_days_sum
from sales group by 1""")
def q_text_extras(spark, d):
    """F3, W3 on text extras with cells that are no numbers (``12,5 TL``) or no dates (``n.a.``)."""
    raw = dirty_sales(spark, d).select(
        F.col("true_date").alias("date"), F.col("true_product").alias("product_name"),
        F.col("true_quantity").alias("quantity"), F.col("true_price").alias("unit_price"),
        F.col("true_revenue").alias("revenue"), F.col(DIRTY_MAPPING["unit_price"]).alias("price_text"),
        F.when(F.col("h") % 10 == 0, "n.a.").otherwise(F.date_add("true_date", 3).cast("string")).alias("Ship Date"))
    source = W.build_feature_source(raw, ["Ship Date"],
                                    core=("date", "product_name", "quantity", "unit_price", "revenue", "price_text"))
    extras = ["price_text", *source.extra_columns]
    return W.weekly_features(source.frame, extras, numeric_extras=extras).select(
        "week_start", "price_text_sum", "price_text_max", "ship_delay_days_sum")
