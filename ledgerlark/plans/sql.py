"""Shared SQL fragments for the DuckDB oracle queries.

They restate, in plain ANSI SQL, what the Spark operators compute, over the
same parquet tables (``lineitem``, ``part``, ``orders`` ... as views).
"""

SALES_SELECT = """select cast(l_shipdate as date) as date, lower(p_name) as product_name,
       l_quantity as quantity,
       floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 as unit_price,
       l_extendedprice as revenue, l_discount as discount,
       l_returnflag, p_brand, p_type{extra},
       (l_orderkey * 31 + l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 1000 as h
from lineitem join part on l_partkey = p_partkey{join}"""

SALES = "sales as (" + SALES_SELECT.format(extra="", join="") + ")"
SALES_WITH_ORDERS = "sales as (" + SALES_SELECT.format(
    extra=", cast(o_orderdate as date) as order_date",
    join=" join orders on l_orderkey = o_orderkey") + ")"

M = "cast({} as decimal(38,2))"

DAILY = """daily as (
  select date, sum(cast(revenue as decimal(38,2))) as rev, sum(quantity) as qty, count(*) as n
  from sales where date is not null group by date),
bounds as (select min(date) as s, max(date) as e from sales),
spine as (
  select cast(unnest(generate_series(cast(s as timestamp), cast(e as timestamp), interval 1 day)) as date) as date
  from bounds),
filled as (
  select spine.date, coalesce(cast(rev as double), 0.0) as revenue, coalesce(qty, 0.0) as quantity,
         coalesce(n, 0) as row_count, coalesce(n > 0, false) as has_sales
  from spine left join daily on spine.date = daily.date)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"

# The messy text table (FIXTURES.md §3); equal rows in Spark and DuckDB.
DIRTY = """dirty as (
select h, date as true_date, product_name as true_product, quantity as true_quantity,
       unit_price as true_price, revenue as true_revenue, discount as true_discount,
       case when h % 4 = 0 then concat(lpad(cast(day(date) as varchar(10)), 2, '0'), '.', lpad(cast(month(date) as varchar(10)), 2, '0'), '.', cast(year(date) as varchar(10)))
            when h % 4 = 1 then concat(cast(day(date) as varchar(10)), '/', cast(month(date) as varchar(10)), '/', cast(year(date) as varchar(10)))
            when h % 4 = 2 and year(date) >= 2000 then concat(lpad(cast(day(date) as varchar(10)), 2, '0'), '-', lpad(cast(month(date) as varchar(10)), 2, '0'), '-', substring(cast(year(date) as varchar(10)), 3, 2))
            else concat(' ', lpad(cast(day(date) as varchar(10)), 2, '0'), ' / ', lpad(cast(month(date) as varchar(10)), 2, '0'), ' / ', cast(year(date) as varchar(10)), ' ') end as "Satış Tarihi",
       case h % 3 when 0 then upper(product_name) when 1 then concat('  ', replace(product_name, ' ', '   '), ' ') else product_name end as "Ürün Adı",
       case when h % 50 = 7 then 'yok' when h % 50 = 8 then '-3'
            when h % 2 = 0 then concat(cast(cast(quantity as bigint) as varchar(20)), ' adet')
            else replace(cast(quantity as varchar(20)), '.', ',') end as "Miktar",
       case h % 3 when 0 then concat('₺', cast(unit_price as varchar(20))) when 1 then concat(replace(cast(unit_price as varchar(20)), '.', ','), ' TL') else cast(unit_price as varchar(20)) end as "Birim Fiyat",
       case when h % 20 = 5 then 'n/a' else concat(replace(cast(revenue as varchar(20)), '.', ','), ' TL') end as "Toplam Tutar",
       concat('%', cast(cast(round(discount * 100) as int) as varchar(5))) as "İndirim"
from sales)"""

# Truth of the cleaned dirty table, with the planted defects applied.
CLEAN_TRUTH = """truth as (
select h, date, product_name,
       case when h % 50 in (7, 8) then null else quantity end as quantity,
       round_even(unit_price, 2) as unit_price,
       case when cast(round(discount * 100) as int) > 1 then cast(cast(round(discount * 100) as int) as double) / 100
            else cast(cast(round(discount * 100) as int) as double) end as discount,
       revenue as src_revenue
from sales),
truth2 as (
select *, round_even(coalesce(case when h % 20 = 5 then null else src_revenue end,
                              round_even(quantity * unit_price, 2)), 2) as revenue
from truth)"""
