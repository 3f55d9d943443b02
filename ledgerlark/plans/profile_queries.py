"""Registered profiling and matching queries over the messy ``dirty`` table.

The oracle knows, by construction of the dirty table, which class every
generated value has (e.g. ``5/1/1996`` profiles as numeric once ``/`` is
dropped, Q4), so it restates the counts from ``h`` and the truth columns and
re-derives the scores with the same formulas in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match as K
from ..operators import profile as P
from ..sources.tables import DIRTY_MAPPING, dirty_sales
from . import sql as Q
from .catalog import register
from .cleaning_queries import cleaned_dirty

SRC_COLS = [DIRTY_MAPPING[k] for k in ("date", "product_name", "quantity", "unit_price", "revenue", "discount")]


def dirty_src(spark, d):
    return dirty_sales(spark, d).select(*SRC_COLS)


_NORM = "trim(regexp_replace(regexp_replace(strip_accents(replace(lower(c), 'ı', 'i')), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g'))"

_CURRENCY_VALUE = """(contains(lower(v), '₺') or contains(lower(v), 'tl') or contains(lower(v), 'try')
   or contains(lower(v), '$') or contains(lower(v), 'usd') or contains(lower(v), '€') or contains(lower(v), 'eur')
   or contains(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g'), 'tl')
   or contains(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g'), 'try')
   or contains(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g'), 'usd')
   or contains(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g'), 'eur'))"""

# (position, column, class, value) for every cell of the six source columns.
_CELLS = """cells as (
  select 1 as position, 'Satış Tarihi' as c,
         case when h % 4 = 0 or (h % 4 = 2 and year(true_date) >= 2000) then 'date' else 'numeric' end as cls,
         "Satış Tarihi" as v from dirty
  union all select 2, 'Ürün Adı', 'string', "Ürün Adı" from dirty
  union all select 3, 'Miktar', case when h % 50 = 7 then 'string' when h % 50 = 8 then 'numeric'
                                     when h % 2 = 0 then 'string' else 'numeric' end, "Miktar" from dirty
  union all select 4, 'Birim Fiyat', 'numeric', "Birim Fiyat" from dirty
  union all select 5, 'Toplam Tutar', case when h % 20 = 5 then 'string' else 'numeric' end, "Toplam Tutar" from dirty
  union all select 6, 'İndirim', 'numeric', "İndirim" from dirty),
counts as (
  select position, c, count(case when cls = 'date' then 1 end) as d, count(case when cls = 'numeric' then 1 end) as n,
         count(case when cls = 'string' then 1 end) as s,
         sum(case when cls = 'string' then length(v) end) as l,
         bool_or(""" + _CURRENCY_VALUE + """) as cur
  from cells group by position, c),
prof as (
  select position, c as "column", """ + _NORM + """ as normalized_name,
         case when greatest(d, n, s) = 0 then 'short_string' when d = greatest(d, n, s) then 'date'
              when n = greatest(d, n, s) then 'numeric'
              when coalesce(cast(l as double) / nullif(s, 0), 0.0) > 10 then 'long_string' else 'short_string' end
           as dominant_type,
         cast(0 as bigint) as n_empty, d as n_date, n as n_numeric, s as n_string,
         round_even(cast(l as double) / nullif(s, 0), 6) as avg_string_length,
         coalesce(cur, false) as has_currency
  from counts)"""


@register("column_profile", Q.with_(Q.SALES, Q.DIRTY, _CELLS) + "select * from prof")
def q_column_profile(spark, d):
    return P.column_profile(dirty_src(spark, d), with_samples=False)


@register("value_class_counts", Q.with_(Q.SALES, Q.DIRTY, _CELLS) + """
select "column", value_class, n from (
  select "column", 'empty' as value_class, n_empty as n from prof union all
  select "column", 'date', n_date from prof union all
  select "column", 'numeric', n_numeric from prof union all
  select "column", 'string', n_string from prof) x""")
def q_value_classes(spark, d):
    return P.value_class_counts(dirty_src(spark, d))


@register("column_dominant_type", Q.with_(Q.SALES, Q.DIRTY, _CELLS) + 'select "column", dominant_type from prof')
def q_dominant(spark, d):
    return P.column_profile(dirty_src(spark, d), with_samples=False).select("column", "dominant_type")


@register("column_currency_flag", Q.with_(Q.SALES, Q.DIRTY, _CELLS) + 'select "column", has_currency from prof')
def q_currency(spark, d):
    return P.column_profile(dirty_src(spark, d), with_samples=False).select("column", "has_currency")


@register("normalize_names", Q.with_(Q.SALES, Q.DIRTY, _CELLS) + """
select cast(position as integer) as position, "column", normalized_name from prof""")
def q_normalize(spark, d):
    return P.normalize_names(dirty_src(spark, d))


@register("table_snapshot", _q := Q.with_(Q.SALES, Q.CLEAN_TRUTH) + """
select count(*) as row_count, 6 as column_count,
       count(case when quantity is null then 1 end) + count(case when revenue is null then 1 end) as missing_cells
from truth2""")
def q_snapshot(spark, d):
    return P.table_snapshot(cleaned_dirty(spark, d).cleaned.select(
        "date", "product_name", "quantity", "unit_price", "revenue", "discount"))


@register("column_summary", Q.with_(Q.SALES, Q.CLEAN_TRUTH) + """,
m as (select count(*) as n, count(case when quantity is null then 1 end) as mq,
             count(case when revenue is null then 1 end) as mr from truth2)
select cast(position as integer) as position, "column", dtype, missing_count,
       round_even(cast(missing_count as double) / n, 4) as missing_ratio
from (select 1 as position, 'date' as "column", 'date' as dtype, cast(0 as bigint) as missing_count, n from m
      union all select 2, 'product_name', 'string', 0, n from m
      union all select 3, 'quantity', 'double', mq, n from m
      union all select 4, 'unit_price', 'double', 0, n from m
      union all select 5, 'revenue', 'double', mr, n from m
      union all select 6, 'discount', 'double', 0, n from m) x""")
def q_column_summary(spark, d):
    return P.column_summary(cleaned_dirty(spark, d).cleaned.select(
        "date", "product_name", "quantity", "unit_price", "revenue", "discount"))


# Strict-parse values of the candidate revenue columns, by construction.
_FORMULA = """fx as (
  select case when h % 50 = 7 then null when h % 50 = 8 then -3.0 when h % 2 = 0 then null else true_quantity end as q,
         true_price as p,
         case when cast(round(true_discount * 100) as int) > 1 and cast(round(true_discount * 100) as int) <= 100
              then cast(round(true_discount * 100) as int) / 100.0 else cast(round(true_discount * 100) as double) end as dd,
         case when h % 4 = 1 then cast(concat(cast(day(true_date) as varchar), cast(month(true_date) as varchar),
                                              cast(year(true_date) as varchar)) as double)
              when h % 4 = 3 or (h % 4 = 2 and year(true_date) < 2000)
                then cast(concat(lpad(cast(day(true_date) as varchar), 2, '0'), lpad(cast(month(true_date) as varchar), 2, '0'),
                                 cast(year(true_date) as varchar)) as double)
              end as r1,
         cast(null as double) as r2,
         case when h % 20 = 5 then null else true_revenue end as r3
  from dirty),
fl as (
  select 1 as ci, 'Satış Tarihi' as "column", r1 as r, q, p, cast(dd as double) as dd from fx union all
  select 2, 'Ürün Adı', r2, q, p, cast(dd as double) from fx union all
  select 3, 'Toplam Tutar', r3, q, p, cast(dd as double) from fx),
fc as (
  select ci, "column", 0 as fi, 'quantity * unit_price' as formula,
         count(case when q is not null and p is not null and r is not null and r <> 0 then 1 end) as checked_rows,
         count(case when q is not null and p is not null and r is not null and r <> 0
                     and abs(q * p - r) / abs(r) <= 0.05 then 1 end) as matched_rows
  from fl group by ci, "column"
  union all
  select ci, "column", 1, 'quantity * unit_price * (1 - discount)',
         count(case when q is not null and p is not null and r is not null and r <> 0 and dd is not null then 1 end),
         count(case when q is not null and p is not null and r is not null and r <> 0 and dd is not null
                     and abs(q * p * (1 - dd) - r) / abs(r) <= 0.05 then 1 end)
  from fl group by ci, "column"),
fr as (select *, case when checked_rows > 0 then matched_rows / checked_rows else 0.0 end as ratio,
              row_number() over (partition by ci order by case when checked_rows > 0 then matched_rows / checked_rows else 0.0 end desc,
                                 matched_rows desc, checked_rows desc, fi) as rk
       from fc)"""


@register("revenue_formula_check", Q.with_(Q.SALES, Q.DIRTY, _FORMULA) + """
select "column", formula, checked_rows, matched_rows, round_even(ratio, 6) as match_ratio,
       ratio > 0.5 as is_valid, rk = 1 as is_best from fr""")
def q_formula(spark, d):
    return K.revenue_formula_checks(dirty_src(spark, d), DIRTY_MAPPING["quantity"],
                                    DIRTY_MAPPING["unit_price"], DIRTY_MAPPING["discount"])


def _has(keys):
    return "(" + " or ".join(f"contains(normalized_name, '{k}')" for k in keys) + ")"


def _i(expr):
    return f"cast({expr} as integer)"


from ..schema import (DATE_NAME_KEYS, DISCOUNT_BLOCK_KEYS, DISCOUNT_KEYS, PRICE_BLOCK_KEYS,  # noqa: E402
                      PRICE_KEYS, PRICE_UNIT_KEYS, PRODUCT_NAME_KEYS, PRODUCT_NAME_SECONDARY_KEYS,
                      QUANTITY_AMOUNT_KEYS, QUANTITY_BLOCK_KEYS, QUANTITY_KEYS, REVENUE_AMOUNT_KEYS,
                      REVENUE_BLOCK_KEYS, REVENUE_KEYS, REVENUE_TOTAL_KEYS)

_SCORES = f"""sc as (
  select 'date' as target, position, "column",
         round_even({_i(_has(DATE_NAME_KEYS))} * 0.5 + {_i("dominant_type = 'date'")} * 0.5, 4) as score, 0.5 as th from prof
  union all
  select 'product_name', position, "column",
         round_even((1 - {_i("dominant_type in ('date', 'numeric')")})
                    * ({_i(_has(PRODUCT_NAME_KEYS))} * 0.7 + {_i(_has(PRODUCT_NAME_SECONDARY_KEYS))} * 0.3), 4), 0.3 from prof
  union all
  select 'quantity', position, "column",
         round_even((1 - {_i(_has(QUANTITY_BLOCK_KEYS))}) * (1 - {_i("dominant_type in ('date', 'long_string')")})
                    * (least(1.0, {_i(_has(QUANTITY_KEYS))} + {_i(_has(QUANTITY_AMOUNT_KEYS))} * 0.5) * 0.6
                       + case when dominant_type = 'numeric' then 1.0 when dominant_type = 'short_string' then 0.5 else 0.0 end * 0.4), 4),
         0.5 from prof
  union all
  select 'unit_price', position, "column",
         round_even((1 - {_i(_has(PRICE_BLOCK_KEYS))}) * {_i("dominant_type = 'numeric'")}
                    * least(1.0, {_i(_has(PRICE_KEYS))} * 0.6 + {_i(_has(PRICE_UNIT_KEYS))} * 0.4
                                 + {_i("has_currency")} * 0.2), 4), 0.6 from prof
  union all
  select 'revenue', position, prof."column",
         round_even((1 - {_i(_has(REVENUE_BLOCK_KEYS))}) * {_i("dominant_type = 'numeric'")}
                    * least(1.0, greatest(cast({_i(_has(REVENUE_KEYS))} as double), cast(coalesce(z, 0) as double),
                                          {_i(_has(REVENUE_TOTAL_KEYS))} * 0.8 + {_i(_has(REVENUE_AMOUNT_KEYS))} * 0.2
                                          + {_i("has_currency")} * 0.2)), 4), 0.8
  from prof left join (select "column", {_i("ratio > 0.5")} as z from fr where rk = 1) zz on prof."column" = zz."column"
  union all
  select 'discount', position, "column",
         round_even({_i(_has(DISCOUNT_KEYS))} * {_i("dominant_type in ('numeric', 'short_string')")}
                    * (1 - {_i(_has(DISCOUNT_BLOCK_KEYS))}), 4), 0.5 from prof),
cand as (select target, "column", score,
                cast(row_number() over (partition by target order by score desc, position) as integer) as rank
         from sc where score >= th)"""


def _scored(spark, d):
    raw = dirty_src(spark, d)
    prof = P.column_profile(raw, with_samples=False)
    formula = K.revenue_formula_checks(raw, DIRTY_MAPPING["quantity"], DIRTY_MAPPING["unit_price"],
                                       DIRTY_MAPPING["discount"])
    return K.candidate_scores(prof, formula)


@register("candidate_scores", Q.with_(Q.SALES, Q.DIRTY, _CELLS, _FORMULA, _SCORES) + "select * from cand")
def q_candidates(spark, d):
    return _scored(spark, d)


for _t in ("date", "product", "quantity", "unit_price", "revenue", "discount"):
    _target = "product_name" if _t == "product" else _t

    def _mk(target):
        def fn(spark, d):
            return _scored(spark, d).where(F.col("target") == target)
        return fn
    register(f"match_{_t}", Q.with_(Q.SALES, Q.DIRTY, _CELLS, _FORMULA, _SCORES)
             + f"select * from cand where target = '{_target}'")(_mk(_target))


@register("best_mapping", Q.with_(Q.SALES, Q.DIRTY, _CELLS, _FORMULA, _SCORES) + """
select t.target, c."column", c.score
from (values ('date'), ('product_name'), ('quantity'), ('unit_price'), ('revenue'), ('discount')) t(target)
left join (select * from cand where rank = 1) c on t.target = c.target""")
def q_best(spark, d):
    return K.best_mapping(_scored(spark, d))
