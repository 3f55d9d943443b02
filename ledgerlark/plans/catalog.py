"""Registered queries: one Spark plan per operator of the inventory, each with
its DuckDB oracle SQL where SQL can express it.

Every query reads the whole test tables (``sales`` = lineitem x part, and
``dirty`` derived from it); nothing is subset, capped or sampled except the
top-k reports whose limit is the feature.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import round6
from ..operators import analysis as A
from ..operators import anomaly as B
from ..operators import pareto as P
from ..sources.tables import sales
from . import sql as Q


@dataclass(frozen=True)
class Spec:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Spec] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Spec(name, fn, sql)
        return fn
    return deco


# Fixed range for the range-filter operator (the filter is the feature).
RANGE_START, RANGE_END = "1996-01-01", "1997-12-31"

# ---------------------------------------------------------------------------
# Analysis (A2-A12)
# ---------------------------------------------------------------------------


@register("date_range", Q.with_(Q.SALES) + "select min(date) as start_date, max(date) as end_date from sales")
def q_date_range(spark, d):
    return A.date_range(sales(spark, d))


@register("range_filter", Q.with_(Q.SALES) + f"""
select date, product_name, quantity, unit_price, revenue from sales
where date between date '{RANGE_START}' and date '{RANGE_END}'""")
def q_range_filter(spark, d):
    return A.filter_range(sales(spark, d), RANGE_START, RANGE_END).select(
        "date", "product_name", "quantity", "unit_price", "revenue")


_KPI_BODY = """
select k.row_count, round_even(k.total_revenue, 2) as total_revenue,
       round_even(k.total_quantity, 2) as total_quantity, k.product_variety,
       round_even(k.avg_price, 2) as average_unit_price,
       round_even(cast(d.rev_all as double) / nullif(d.days, 0), 2) as avg_daily_revenue_all_days,
       round_even(cast(d.rev_sales as double) / nullif(d.sales_days, 0), 2) as avg_daily_revenue_sales_days
from (select count(*) as row_count,
             coalesce(cast(sum(cast(revenue as decimal(38,2))) as double), 0.0) as total_revenue,
             coalesce(sum(quantity), 0.0) as total_quantity,
             count(distinct product_name) as product_variety,
             cast(sum(cast(unit_price as decimal(38,2))) as double) / nullif(count(unit_price), 0) as avg_price
      from sales where date is not null) k,
     (select sum(cast(revenue as decimal(38,2))) as rev_all, count(*) as days,
             sum(case when has_sales then cast(revenue as decimal(38,2)) end) as rev_sales,
             count(case when has_sales then 1 end) as sales_days
      from filled) d"""
_KPI_SQL = Q.with_(Q.SALES, Q.DAILY) + _KPI_BODY


@register("kpi_summary", _KPI_SQL)
def q_kpi(spark, d):
    return A.kpi_summary(sales(spark, d))


@register("avg_daily_revenue", Q.with_(Q.SALES, Q.DAILY) + """
select round_even(cast(sum(cast(revenue as decimal(38,2))) as double) / count(*), 2) as avg_daily_revenue_all_days,
       round_even(cast(sum(case when has_sales then cast(revenue as decimal(38,2)) end) as double)
                  / nullif(count(case when has_sales then 1 end), 0), 2) as avg_daily_revenue_sales_days
from filled""")
def q_avg_daily(spark, d):
    return A.avg_daily_revenue(sales(spark, d))


@register("daily_sales", Q.with_(Q.SALES) + """
select date, cast(sum(cast(revenue as decimal(38,2))) as double) as revenue, sum(quantity) as quantity,
       count(*) as row_count
from sales where date is not null group by date""")
def q_daily_sales(spark, d):
    return A.daily_sales(sales(spark, d)).withColumn("revenue", F.col("revenue").cast("double"))


@register("daily_sales_filled", Q.with_(Q.SALES, Q.DAILY) + """
select date, revenue, quantity, row_count, has_sales from filled""")
def q_daily_filled(spark, d):
    return A.daily_filled(sales(spark, d))


@register("daily_series", Q.with_(Q.SALES, Q.DAILY) + """
select date, round_even(revenue, 2) as revenue, round_even(quantity, 2) as quantity from filled""")
def q_daily_series(spark, d):
    return A.daily_series(sales(spark, d))


@register("top_revenue_products", Q.with_(Q.SALES) + """
select cast(row_number() over (order by revenue desc, product_name) as integer) as rank, product_name, revenue
from (select product_name, coalesce(cast(sum(cast(revenue as decimal(38,2))) as double), 0.0) as revenue
      from sales where date is not null and product_name is not null group by product_name
      order by revenue desc, product_name limit 10) t""")
def q_top_revenue(spark, d):
    return A.top_revenue_products(sales(spark, d))


@register("top_selling_products", Q.with_(Q.SALES) + """
select cast(row_number() over (order by count desc, product_name) as integer) as rank, product_name, count
from (select product_name, count(*) as count from sales
      where date is not null and product_name is not null group by product_name
      order by count desc, product_name limit 10) t""")
def q_top_selling(spark, d):
    return A.top_selling_products(sales(spark, d))


@register("least_selling_products", Q.with_(Q.SALES) + """
select cast(row_number() over (order by count asc, product_name) as integer) as rank, product_name, count
from (select product_name, count(*) as count from sales
      where date is not null and product_name is not null group by product_name
      order by count asc, product_name limit 10) t""")
def q_least_selling(spark, d):
    return A.least_selling_products(sales(spark, d))


@register("brand_top_revenue_products", Q.with_(Q.SALES) + """
select p_brand, rank, product_name, revenue from (
  select p_brand, cast(row_number() over (partition by p_brand order by revenue desc, product_name) as integer) as rank,
         product_name, revenue
  from (select p_brand, product_name, coalesce(cast(sum(cast(revenue as decimal(38,2))) as double), 0.0) as revenue
        from sales where date is not null and product_name is not null group by p_brand, product_name) t) r
where rank <= 3""")
def q_brand_top(spark, d):
    return A.top_revenue_products(sales(spark, d), limit=3, series_cols=["p_brand"])


_REPORT_SQL = Q.with_(Q.SALES, Q.DAILY) + """,
kpi as (""" + _KPI_BODY + """),
top_rev as (select product_name, coalesce(cast(sum(cast(revenue as decimal(38,2))) as double), 0.0) as revenue
            from sales where date is not null and product_name is not null group by product_name
            order by revenue desc, product_name limit 10),
cnt as (select product_name, count(*) as count from sales where date is not null and product_name is not null
        group by product_name),
top_cnt as (select * from cnt order by count desc, product_name limit 10),
low_cnt as (select * from cnt order by count asc, product_name limit 10)
select 'kpi' as section, cast(r as integer) as rank, k as key, v as value from (
  select 1 as r, 'row_count' as k, cast(row_count as double) as v from kpi union all
  select 2, 'total_revenue', total_revenue from kpi union all
  select 3, 'total_quantity', total_quantity from kpi union all
  select 4, 'product_variety', cast(product_variety as double) from kpi union all
  select 5, 'average_unit_price', average_unit_price from kpi union all
  select 6, 'avg_daily_revenue_all_days', avg_daily_revenue_all_days from kpi union all
  select 7, 'avg_daily_revenue_sales_days', avg_daily_revenue_sales_days from kpi) x
union all
select 'top_revenue_products', cast(row_number() over (order by revenue desc, product_name) as integer),
       product_name, revenue from top_rev
union all
select 'top_selling_products', cast(row_number() over (order by count desc, product_name) as integer),
       product_name, cast(count as double) from top_cnt
union all
select 'least_selling_products', cast(row_number() over (order by count asc, product_name) as integer),
       product_name, cast(count as double) from low_cnt
union all
select 'daily_revenue', cast(date - date '1970-01-01' as integer), strftime(date, '%Y-%m-%d'),
       round_even(revenue, 2) from filled
union all
select 'daily_quantity', cast(date - date '1970-01-01' as integer), strftime(date, '%Y-%m-%d'),
       round_even(quantity, 2) from filled"""


@register("sales_report", _REPORT_SQL)
def q_report(spark, d):
    return A.sales_report(sales(spark, d))


# ---------------------------------------------------------------------------
# Anomaly (B1-B4)
# ---------------------------------------------------------------------------

_IQR = """iqr as (select quantile_cont(revenue, 0.25) as q1, quantile_cont(revenue, 0.75) as q3,
                  count(*) as total_days from filled),
flags as (select f.*, q3 + 2.5 * (q3 - q1) as ub, q1 - 2.5 * (q3 - q1) as lb, total_days
          from filled f, iqr)"""


@register("iqr_bounds", Q.with_(Q.SALES, Q.DAILY, _IQR) + """
select round_even(q1, 6) as q1, round_even(q3, 6) as q3, round_even(q3 - q1, 6) as iqr,
       round_even(q1 - 2.5 * (q3 - q1), 6) as lower_bound, round_even(q3 + 2.5 * (q3 - q1), 6) as upper_bound,
       2.5 as multiplier, total_days from iqr""")
def q_iqr(spark, d):
    b = B.iqr_bounds(A.daily_filled(sales(spark, d)))
    return b.select(*[round6(F.col(c)).alias(c) for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound")],
                    "multiplier", "total_days")


@register("daily_anomaly_flags", Q.with_(Q.SALES, Q.DAILY, _IQR) + """
select date, revenue, quantity, revenue > ub as is_anomaly,
       case when revenue > ub then revenue end as anomaly_revenue,
       round_even(ub, 6) as normal_upper_bound, round_even(lb, 6) as normal_lower_bound,
       case when revenue > ub then 'Above normal upper bound' end as reason
from flags""")
def q_flags(spark, d):
    f = B.anomaly_flags(sales(spark, d))
    return f.withColumns({"normal_upper_bound": round6(F.col("normal_upper_bound")),
                          "normal_lower_bound": round6(F.col("normal_lower_bound"))})


@register("anomaly_days", Q.with_(Q.SALES, Q.DAILY, _IQR) + """
select date, round_even(revenue, 2) as revenue, round_even(quantity, 2) as quantity,
       'Above normal upper bound' as reason
from flags where revenue > ub""")
def q_anomaly_days(spark, d):
    return B.anomaly_days(sales(spark, d))


@register("anomaly_days_with_low", Q.with_(Q.SALES, Q.DAILY, _IQR) + """
select date, round_even(revenue, 2) as revenue, round_even(quantity, 2) as quantity,
       case when revenue > ub then 'Above normal upper bound' else 'Below normal lower bound' end as reason
from flags where revenue > ub or revenue < lb""")
def q_anomaly_days_low(spark, d):
    return B.anomaly_days(sales(spark, d), include_low=True)


@register("anomaly_summary", Q.with_(Q.SALES, Q.DAILY, _IQR) + """
select count(case when revenue > ub then 1 end) as anomaly_days, count(*) as total_days,
       round_even(cast(count(case when revenue > ub then 1 end) as double) / count(*), 6) as anomaly_ratio,
       (select date from flags where revenue > ub order by revenue desc, date asc limit 1) as highest_anomaly_date,
       max(case when revenue > ub then revenue end) as highest_anomaly_revenue,
       round_even(max(ub), 6) as normal_upper_bound, round_even(max(lb), 6) as normal_lower_bound
from flags""")
def q_anomaly_summary(spark, d):
    return B.anomaly_summary(sales(spark, d))


# ---------------------------------------------------------------------------
# Pareto / ABC, what-if
# ---------------------------------------------------------------------------

_PARETO = """pr as (select product_name, sum(cast(revenue as decimal(38,2))) as rev from sales
       where date is not null and product_name is not null and revenue is not null group by product_name),
pc as (select product_name, rev,
              sum(rev) over (order by rev desc, product_name rows between unbounded preceding and current row) as cum,
              sum(rev) over () as tot from pr),
abc as (select product_name, cast(rev as double) as revenue,
               cast(rev as double) / cast(tot as double) as revenue_share,
               cast(cum as double) / cast(tot as double) as cumulative_share,
               case when cast(cum - rev as double) / cast(tot as double) < 0.8 then 'A'
                    when cast(cum - rev as double) / cast(tot as double) < 0.95 then 'B' else 'C' end as abc_class
        from pc where tot > 0)"""


@register("pareto_abc", Q.with_(Q.SALES, _PARETO) + "select * from abc")
def q_pareto(spark, d):
    return P.pareto_abc(sales(spark, d))


@register("abc_class_counts", Q.with_(Q.SALES, _PARETO) + """
select c.abc_class, coalesce(n, 0) as product_count
from (values ('A'), ('B'), ('C')) c(abc_class)
left join (select abc_class, count(*) as n from abc group by abc_class) x on c.abc_class = x.abc_class""")
def q_abc_counts(spark, d):
    return P.abc_class_counts(sales(spark, d))


@register("brand_pareto_abc", Q.with_(Q.SALES) + """,
pr as (select p_brand, product_name, sum(cast(revenue as decimal(38,2))) as rev from sales
       where date is not null and product_name is not null and revenue is not null group by p_brand, product_name),
pc as (select p_brand, product_name, rev,
              sum(rev) over (partition by p_brand order by rev desc, product_name
                             rows between unbounded preceding and current row) as cum,
              sum(rev) over (partition by p_brand) as tot from pr)
select p_brand, product_name, cast(rev as double) as revenue,
       cast(rev as double) / cast(tot as double) as revenue_share,
       cast(cum as double) / cast(tot as double) as cumulative_share,
       case when cast(cum - rev as double) / cast(tot as double) < 0.8 then 'A'
            when cast(cum - rev as double) / cast(tot as double) < 0.95 then 'B' else 'C' end as abc_class
from pc where tot > 0""")
def q_brand_pareto(spark, d):
    return P.pareto_abc(sales(spark, d), series_cols=["p_brand"])


_PCTS = P.DEFAULT_PCTS
_GRID = ", ".join(f"({i + 1}, {float(p)}, {float(q)})" for i, (p, q) in
                  enumerate((p, q) for p in _PCTS for q in _PCTS))


@register("what_if_scenarios", Q.with_(Q.SALES) + f""",
base as (select coalesce(cast(sum(cast(revenue as decimal(38,2))) as double), 0.0) as cur
         from sales where date is not null),
grid as (select * from (values {_GRID}) g(scenario_id, price_pct, qty_pct)),
sim as (select scenario_id, cast(price_pct as double) as price_pct, cast(qty_pct as double) as qty_pct, cur,
               cur * (1 + cast(price_pct as double) / 100) * (1 + cast(qty_pct as double) / 100) as s
        from base, grid)
select cast(scenario_id as integer) as scenario_id, price_pct, qty_pct, round_even(cur, 2) as current_revenue,
       round_even(s, 2) as simulated_revenue, round_even(s - cur, 2) as difference,
       round_even(case when cur <> 0 then (s - cur) / cur else 0.0 end, 6) as change_ratio
from sim""")
def q_what_if(spark, d):
    return P.what_if_scenarios(sales(spark, d))


@register("brand_anomaly_days", Q.with_(Q.SALES) + """,
bd as (select p_brand, date, sum(cast(revenue as decimal(38,2))) as rev, sum(quantity) as qty
       from sales where date is not null group by p_brand, date),
bb as (select p_brand, min(date) as s, max(date) as e from bd group by p_brand),
bs as (select p_brand, cast(unnest(generate_series(cast(s as timestamp), cast(e as timestamp), interval 1 day)) as date) as date
       from bb),
bf as (select bs.p_brand, bs.date, coalesce(cast(bd.rev as double), 0.0) as revenue, coalesce(bd.qty, 0.0) as quantity
       from bs left join bd on bs.p_brand = bd.p_brand and bs.date = bd.date),
bq as (select p_brand, quantile_cont(revenue, 0.25) as q1, quantile_cont(revenue, 0.75) as q3 from bf group by p_brand)
select bf.p_brand, bf.date, round_even(revenue, 2) as revenue, round_even(quantity, 2) as quantity,
       case when revenue > q3 + 1.5 * (q3 - q1) then 'Above normal upper bound' else 'Below normal lower bound' end as reason
from bf join bq on bf.p_brand = bq.p_brand
where revenue > q3 + 1.5 * (q3 - q1) or revenue < q1 - 1.5 * (q3 - q1)""")
def q_brand_anomalies(spark, d):
    """B1-B3 per brand: each brand's own calendar span, IQR and flags."""
    return B.anomaly_days(sales(spark, d), multiplier=1.5, include_low=True, series_cols=["p_brand"])


@register("brand_kpi_summary", Q.with_(Q.SALES) + """,
bd as (select p_brand, date, sum(cast(revenue as decimal(38,2))) as rev, count(*) as n
       from sales where date is not null group by p_brand, date),
bb as (select p_brand, min(date) as s, max(date) as e from bd group by p_brand),
bs as (select p_brand, cast(unnest(generate_series(cast(s as timestamp), cast(e as timestamp), interval 1 day)) as date) as date
       from bb),
bf as (select bs.p_brand, bs.date, coalesce(cast(bd.rev as double), 0.0) as revenue, coalesce(bd.n > 0, false) as has_sales
       from bs left join bd on bs.p_brand = bd.p_brand and bs.date = bd.date),
k as (select p_brand, count(*) as row_count,
             coalesce(cast(sum(cast(revenue as decimal(38,2))) as double), 0.0) as total_revenue,
             coalesce(sum(quantity), 0.0) as total_quantity, count(distinct product_name) as product_variety,
             cast(sum(cast(unit_price as decimal(38,2))) as double) / nullif(count(unit_price), 0) as avg_price
      from sales where date is not null group by p_brand),
dd as (select p_brand, sum(cast(revenue as decimal(38,2))) as rev_all, count(*) as days,
              sum(case when has_sales then cast(revenue as decimal(38,2)) end) as rev_sales,
              count(case when has_sales then 1 end) as sales_days
       from bf group by p_brand)
select k.p_brand, k.row_count, round_even(k.total_revenue, 2) as total_revenue,
       round_even(k.total_quantity, 2) as total_quantity, k.product_variety,
       round_even(k.avg_price, 2) as average_unit_price,
       round_even(cast(dd.rev_all as double) / nullif(dd.days, 0), 2) as avg_daily_revenue_all_days,
       round_even(cast(dd.rev_sales as double) / nullif(dd.sales_days, 0), 2) as avg_daily_revenue_sales_days
from k left join dd on k.p_brand = dd.p_brand""")
def q_brand_kpi(spark, d):
    """A4 + A7 per brand in one plan (calendar per brand)."""
    return A.kpi_summary(sales(spark, d), series_cols=["p_brand"])
