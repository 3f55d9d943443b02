"""Registered cleaning queries: round trip over the ``dirty`` table.

Spark cleans the messy text; the oracle returns the truth columns with the
planted defects applied (placeholders, non-positive quantities, missing
revenue filled from quantity x price, ``%1`` staying 1.0).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import with_date_tokens
from ..functions.numbers import parse_number_fallback, parse_number_lenient, with_strict_number
from ..functions.text import CP1252, LATIN1, SHOWN, clean_product_name, clean_text, fix_mojibake, null_placeholders
from ..operators.clean import clean_sales, standardize
from ..sources.tables import DIRTY_MAPPING, dirtied, dirty_sales, sales
from . import sql as Q
from .catalog import register

DATE_SRC, PRODUCT_SRC = DIRTY_MAPPING["date"], DIRTY_MAPPING["product_name"]
QTY_SRC, PRICE_SRC, REV_SRC = DIRTY_MAPPING["quantity"], DIRTY_MAPPING["unit_price"], DIRTY_MAPPING["revenue"]
TRUTH = ["h", "true_date", "true_product", "true_quantity", "true_price", "true_revenue", "true_discount"]


def cleaned_dirty(spark, d):
    raw = dirty_sales(spark, d)
    std = standardize(raw, DIRTY_MAPPING, keep=TRUTH)
    return clean_sales(std, extras=TRUTH)


def _truth(select: str) -> str:
    return Q.with_(Q.SALES, Q.CLEAN_TRUTH) + select


@register("clean_sales", _truth(
    "select date, product_name, quantity, unit_price, revenue, discount from truth2"))
def q_clean_sales(spark, d):
    return cleaned_dirty(spark, d).cleaned.drop(*TRUTH)


@register("clean_date", _truth("select date as true_date, date from truth2"))
def q_clean_date(spark, d):
    return cleaned_dirty(spark, d).wide.select("true_date", "date")


@register("clean_product_name", _truth("select product_name as true_product, product_name from truth2"))
def q_clean_product(spark, d):
    return cleaned_dirty(spark, d).wide.select("true_product", "product_name")


@register("clean_quantity", _truth("select h, quantity from truth2"))
def q_clean_quantity(spark, d):
    return cleaned_dirty(spark, d).wide.select("h", "quantity")


@register("clean_unit_price", _truth("select unit_price as true_price, unit_price from truth2"))
def q_clean_price(spark, d):
    return cleaned_dirty(spark, d).wide.select(F.col("true_price"), "unit_price")


@register("clean_revenue", _truth("select h, revenue from truth2"))
def q_clean_revenue(spark, d):
    return cleaned_dirty(spark, d).wide.select("h", "revenue")


@register("clean_discount", _truth("select discount from truth2"))
def q_clean_discount(spark, d):
    return cleaned_dirty(spark, d).cleaned.select("discount")


@register("clean_text", Q.with_(Q.SALES, Q.DIRTY) + """
select "Ürün Adı" as raw, regexp_replace(trim("Ürün Adı"), '\\s+', ' ', 'g') as cleaned from dirty""")
def q_clean_text(spark, d):
    raw = dirty_sales(spark, d)
    return raw.select(F.col(PRODUCT_SRC).alias("raw"), clean_text(F.col(PRODUCT_SRC)).alias("cleaned"))


@register("repair_text", """
select doc_id, md5(coalesce(text, '')) as latin1, md5(coalesce(text, '')) as windows, md5(coalesce(text, '')) as twice
from documents""")
def q_repair_text(spark, d):
    """C1 round trip: whole texts read as Latin-1, as windows-1252, and twice as windows-1252, repaired."""
    def latin1(x):
        return F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")

    def windows(x):
        return F.translate(latin1(x), LATIN1[:CP1252], SHOWN[:CP1252])

    text = F.coalesce("text", F.lit(""))
    damaged = {"latin1": latin1(text), "windows": windows(text), "twice": windows(windows(text))}
    docs = spark.read.parquet(f"{d.rstrip('/')}/documents.parquet").select("doc_id", "text").withColumns(damaged)
    return docs.select("doc_id", *[F.md5(fix_mojibake(F.col(c))).alias(c) for c in damaged])


@register("null_placeholders", Q.with_(Q.SALES, Q.DIRTY) + """
select "Miktar" as raw, case when h % 50 = 7 then null else "Miktar" end as cleaned from dirty""")
def q_null_placeholders(spark, d):
    raw = dirty_sales(spark, d)
    return raw.select(F.col(QTY_SRC).alias("raw"), null_placeholders(F.col(QTY_SRC)).alias("cleaned"))


@register("parse_number_strict", Q.with_(Q.SALES) + """
select h,
       case when h % 50 = 7 then null when h % 50 = 8 then -3.0 when h % 2 = 0 then null
            else quantity end as quantity,
       unit_price,
       case when h % 20 = 5 then null else revenue end as revenue
from sales""")
def q_strict(spark, d):
    raw = dirty_sales(spark, d)
    for source, name in ((QTY_SRC, "quantity"), (PRICE_SRC, "unit_price"), (REV_SRC, "revenue")):
        raw = with_strict_number(raw, source, name)
    return raw.select("h", "quantity", "unit_price", "revenue")


@register("parse_number_lenient", Q.with_(Q.SALES) + """
select h,
       case when h % 50 = 7 then null when h % 50 = 8 then -3.0 else quantity end as quantity,
       unit_price,
       case when h % 20 = 5 then null else revenue end as revenue
from sales""")
def q_lenient(spark, d):
    raw = dirty_sales(spark, d)
    return raw.select("h", parse_number_lenient(F.col(QTY_SRC)).alias("quantity"),
                      parse_number_lenient(F.col(PRICE_SRC)).alias("unit_price"),
                      parse_number_lenient(F.col(REV_SRC)).alias("revenue"))


@register("derive_revenue", Q.with_(Q.SALES) + """
select h, (case when h % 50 = 7 then null when h % 50 = 8 then -3.0 when h % 2 = 0 then null
                else quantity end) * unit_price as revenue
from sales""")
def q_derive(spark, d):
    raw = dirty_sales(spark, d)
    mapping = {k: v for k, v in DIRTY_MAPPING.items() if k not in ("revenue", "discount")}
    return standardize(raw, mapping, keep=["h"]).select("h", "revenue")


@register("standardize", Q.with_(Q.SALES, Q.DIRTY) + """
select "Satış Tarihi" as date, "Ürün Adı" as product_name, "Miktar" as quantity,
       "Birim Fiyat" as unit_price, "Toplam Tutar" as revenue, "İndirim" as discount from dirty""")
def q_standardize(spark, d):
    return standardize(dirty_sales(spark, d), DIRTY_MAPPING)


@register("date_tokens", Q.with_(Q.SALES, Q.DIRTY) + """
, t as (select regexp_extract(trim("Satış Tarihi"), '^\\D*(\\d+)\\D+(\\d+)(?:\\D+(\\d+))?', 1) as a,
               regexp_extract(trim("Satış Tarihi"), '^\\D*(\\d+)\\D+(\\d+)(?:\\D+(\\d+))?', 2) as b,
               regexp_extract(trim("Satış Tarihi"), '^\\D*(\\d+)\\D+(\\d+)(?:\\D+(\\d+))?', 3) as c from dirty)
select nullif(a, '') as first_text, nullif(b, '') as second_text, nullif(c, '') as third_text,
       case when c <> '' and (length(a) = 4 or cast(a as double) > 31) then cast(b as double) else cast(a as double) end as "left",
       case when c <> '' and (length(a) = 4 or cast(a as double) > 31) then cast(c as double) else cast(b as double) end as "right"
from t""")
def q_date_tokens(spark, d):
    raw = dirty_sales(spark, d)
    tk = with_date_tokens(raw.select(clean_text(F.col(DATE_SRC)).alias("t")), "t")
    names = {"t1": "first_text", "t2": "second_text", "t3": "third_text", "left": "left", "right": "right"}
    return tk.select(*[F.col(f"_dt_{k}").alias(name) for k, name in names.items()])


_TOKENS = """tk as (
  select h, regexp_extract(trim("Satış Tarihi"), '^\\D*(\\d+)\\D+(\\d+)(?:\\D+(\\d+))?', 1) as a,
         regexp_extract(trim("Satış Tarihi"), '^\\D*(\\d+)\\D+(\\d+)(?:\\D+(\\d+))?', 2) as b,
         regexp_extract(trim("Satış Tarihi"), '^\\D*(\\d+)\\D+(\\d+)(?:\\D+(\\d+))?', 3) as c from dirty),
lr as (select a <> '' and b <> '' as has,
              case when c <> '' and (length(a) = 4 or cast(a as double) > 31) then cast(b as double) else cast(a as double) end as l,
              case when c <> '' and (length(a) = 4 or cast(a as double) > 31) then cast(c as double) else cast(b as double) end as r
       from tk),
st as (select count(case when has then 1 end) as scanned,
              count(case when has and l > 12 and not r > 12 then 1 end) as left_over_12,
              count(case when has and r > 12 and not l > 12 then 1 end) as right_over_12,
              count(case when has and l > 12 and r > 12 then 1 end) as both_over_12,
              count(case when has and not l > 12 and not r > 12 then 1 end) as ambiguous
       from lr)"""


@register("date_order", Q.with_(Q.SALES, Q.DIRTY, _TOKENS) + """
select case when left_over_12 + right_over_12 = 0 then 'undecidable_no_evidence'
            when greatest(left_over_12, right_over_12) / (left_over_12 + right_over_12) >= 0.99 then 'inferred'
            else 'undecidable_mixed_evidence' end as status,
       case when left_over_12 + right_over_12 > 0
             and greatest(left_over_12, right_over_12) / (left_over_12 + right_over_12) >= 0.99
            then case when left_over_12 >= right_over_12 then 'day_month' else 'month_day' end end as date_order,
       round_even(case when left_over_12 + right_over_12 > 0
                       then greatest(left_over_12, right_over_12) / (left_over_12 + right_over_12) else 0.0 end, 6)
         as confidence,
       scanned, left_over_12 + right_over_12 as evidence, left_over_12, right_over_12, ambiguous, both_over_12,
       both_over_12 + case when left_over_12 + right_over_12 > 0
                            and greatest(left_over_12, right_over_12) / (left_over_12 + right_over_12) >= 0.99
                           then least(left_over_12, right_over_12) else 0 end as invalid
from st""")
def q_date_order(spark, d):
    return cleaned_dirty(spark, d).date_order


@register("cleaning_report", _truth(""",
agg as (select count(*) as n,
               count(case when quantity is null then 1 end) as q_missing,
               count(case when revenue is null then 1 end) as r_missing,
               count(case when h % 50 = 8 then 1 end) as q_nonpos,
               count(case when h % 20 = 5 and revenue is not null then 1 end) as r_filled
        from truth2)
select cast(position as integer) as position, column_name, n as total_rows, cast(0 as bigint) as source_missing,
       cleaned_missing, n - cleaned_missing as converted, cleaned_missing as failed,
       business_errors, filled, cast(0 as bigint) as placeholders
from (select 1 as position, 'date' as column_name, 0 as cleaned_missing, 0 as business_errors, 0 as filled, * from agg
      union all select 2, 'product_name', 0, 0, 0, * from agg
      union all select 3, 'quantity', q_missing, q_nonpos, 0, * from agg
      union all select 4, 'unit_price', 0, 0, 0, * from agg
      union all select 5, 'revenue', r_missing, 0, r_filled, * from agg) x"""))
def q_cleaning_report(spark, d):
    return cleaned_dirty(spark, d).column_report()


@register("revenue_mismatch", _truth(""",
dsc as (select *, case when cast(round(discount * 100) as int) > 1 then discount else discount end as dd from truth2),
f as (select count(case when quantity is not null and unit_price is not null and revenue is not null then 1 end) as c0,
             count(case when quantity is not null and unit_price is not null and revenue is not null
                         and abs(round_even(quantity * unit_price, 2) - revenue) > 0.05 then 1 end) as m0,
             count(case when quantity is not null and unit_price is not null and revenue is not null
                         and discount is not null then 1 end) as c1,
             count(case when quantity is not null and unit_price is not null and revenue is not null
                         and discount is not null
                         and abs(round_even(quantity * unit_price * (1 - discount), 2) - revenue) > 0.05 then 1 end) as m1
      from truth2),
l as (select 1 as id, 'quantity * unit_price' as formula, c0 as checked_rows, c0 - m0 as match_count, m0 as mismatch_count from f
      union all select 2, 'quantity * unit_price * (1 - discount)', c1, c1 - m1, m1 from f),
r as (select *, case when checked_rows > 0 then match_count / checked_rows else 0.0 end as ratio from l)
select formula, checked_rows, match_count, mismatch_count, round_even(ratio, 6) as match_ratio,
       id = (select id from r order by ratio desc, match_count desc, checked_rows desc, id asc limit 1) as is_best
from r"""))
def q_revenue_mismatch(spark, d):
    return cleaned_dirty(spark, d).revenue_mismatch()


def _grouped(value, mark):
    """A whole number with thousands marks: only the fallback parser reads two or more marks."""
    return F.regexp_replace(F.format_number(value, 0), ",", mark)


@register("parse_number_fallback", Q.with_(Q.SALES) + """
select h, cast(case h % 3 when 0 then 1 else -1 end * (1000000 + cast(floor(revenue) as bigint)) as double) as value
from sales""")
def q_fallback(spark, d):
    """``1.234.567``, ``-1.234.567`` and ``-1,234,567`` keep their value and sign."""
    from ..sources.tables import sales
    whole = F.col("h") * 0 + 1_000_000 + F.floor("revenue")
    text = (F.when(F.col("h") % 3 == 0, _grouped(whole, "."))
            .when(F.col("h") % 3 == 1, F.concat(F.lit("-"), _grouped(whole, ".")))
            .otherwise(F.concat(F.lit("-"), _grouped(whole, ","), F.lit(" TL"))))
    return sales(spark, d).select("h", parse_number_fallback(text).alias("value"))


def _with_bad_dates(spark, d):
    """``dirty`` with one date in 400 against the order and one in 500 with both sides over 12, by row number."""
    raw = dirty_sales(spark, d)
    bad = F.when(F.col("h") % 500 == 3, F.lit("25.25.2001")).when(F.col("h") % 400 == 6, F.lit("02.28.1997"))
    return raw.withColumn(DATE_SRC, F.coalesce(bad, F.col(DATE_SRC)))


_BAD = """, bad as (
  select case when h % 500 = 3 then '25.25.2001' when h % 400 = 6 then '02.28.1997' end as value,
         case when h % 500 = 3 then 'both_sides_over_12' when h % 400 = 6 then 'conflicts_with_inferred_date_order' end as reason
  from sales)
"""


@register("date_issues", Q.with_(Q.SALES).rstrip() + _BAD + """
select reason, value, count(*) as n from bad where reason is not null group by all""")
def q_date_issues(spark, d):
    """C16 on dates with planted defects; all issues, counted by reason and value."""
    std = standardize(_with_bad_dates(spark, d), DIRTY_MAPPING, keep=TRUTH)
    found = clean_sales(std, extras=TRUTH).flagged_dates()
    return found.groupBy("reason", "value").agg(F.count("*").alias("n"))


def _numbered(spark, d):
    """``dirty`` in the order of its truth, numbered by distinct rank per (h, date, product, quantity, revenue).

    Numbered before the texts are made, so that they are neither shuffled nor sorted.
    """
    from pyspark.sql import Window
    order = Window.partitionBy("h").orderBy("date", "product_name", "quantity", "revenue")
    s = sales(spark, d).withColumn("n", F.rank().over(order))
    return dirtied(s, "n").withColumn("at", F.col("h") * 1_000_000 + F.col("n")).drop("n")


_NUMBERED = """, numbered as (
  select s.*, h * 1000000 + rank() over (partition by h order by date, product_name, quantity, src_revenue) as row_id
  from truth2 s)
"""


@register("cleaning_report_examples", Q.with_(Q.SALES, Q.CLEAN_TRUTH).rstrip() + _NUMBERED + """
, found as (
  select 'failed' as kind, 'quantity' as column_name, row_id, 10 as lim from numbered where quantity is null union all
  select 'failed', 'revenue', row_id, 10 from numbered where revenue is null union all
  select 'business_error', 'quantity', row_id, 10 from numbered where h % 50 = 8 union all
  select 'filled', 'revenue', row_id, 10 from numbered where h % 20 = 5 and revenue is not null)
select kind, column_name, r as rank, row_id from (
  select *, row_number() over (partition by kind, column_name order by row_id) as r from found) x where r <= lim""")
def q_examples(spark, d):
    """First failed, refused and filled rows of each column."""
    std = standardize(_numbered(spark, d), DIRTY_MAPPING, keep=["at"])
    found = clean_sales(std.withColumnRenamed("at", "row_id"), row_id="row_id").examples()
    return found.where("kind <> 'mismatch'").select("kind", "column_name", "rank", "row_id")


@register("revenue_mismatch_examples", Q.with_(Q.SALES, Q.CLEAN_TRUTH).rstrip() + _NUMBERED + """
select r as rank, row_id from (
  select row_number() over (order by row_id) as r, row_id from numbered
  where abs(round_even(quantity * unit_price, 2) - revenue * case when h % 90 = 11 then 2 else 1 end) > 0.05) x where r <= 20""")
def q_mismatch_examples(spark, d):
    """First rows whose revenue (doubled on some rows) is not quantity x price."""
    raw = _numbered(spark, d)
    doubled = F.concat(F.replace((F.col("true_revenue") * 2).cast("string"), F.lit("."), F.lit(",")), F.lit(" TL"))
    raw = raw.withColumn(REV_SRC, F.when((F.col("h") % 90 == 11) & (F.col("h") % 20 != 5), doubled).otherwise(F.col(REV_SRC)))
    std = standardize(raw, DIRTY_MAPPING, keep=["at"]).drop("discount")
    found = clean_sales(std.withColumnRenamed("at", "row_id"), row_id="row_id").examples()
    return found.where("kind = 'mismatch'").select("rank", "row_id")


# Month names used to spell dates in words for the text-date round trip
# (fixed values; the first name of each month in the parser's table).
_TR_MONTHS = ["Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül",
              "Ekim", "Kasım", "Aralık"]
_EN_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
              "October", "November", "December"]


@register("clean_text_date", Q.with_(Q.SALES) + """
select h, cast(date_trunc('month', date) as date) as date from sales""")
def q_text_date(spark, d):
    """Month-name dates (``Ocak 1996`` / ``1996 January``) -> first of month."""
    from ..functions.dates import parse_text_date
    from ..sources.tables import sales
    s = sales(spark, d)
    tr = F.element_at(F.array(*[F.lit(m) for m in _TR_MONTHS]), F.month("date"))
    en = F.element_at(F.array(*[F.lit(m) for m in _EN_MONTHS]), F.month("date"))
    text = F.when(F.col("h") % 2 == 0, F.concat(tr, F.lit(" "), F.year("date").cast("string"))) \
            .otherwise(F.concat(F.year("date").cast("string"), F.lit(" "), en))
    return s.select("h", parse_text_date(text, F.lit("day_month")).alias("date"))
