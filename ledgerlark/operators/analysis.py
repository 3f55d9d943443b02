"""Sales analysis (A2-A12): date range, KPIs, gap-filled daily series,
top / least products, report table.

Every function is ``DataFrame -> DataFrame`` over the cleaned sales schema
and stays lazy.  Money is summed as DECIMAL(38,2) so results do not depend on
partitioning.  ``series_cols`` (optional) computes the same thing for many
series at once (e.g. per brand), partitioned by those keys.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import money_sum, round2
from ..session import keep_table


def _as_date(value) -> _dt.date:
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    try:
        return _dt.date.fromisoformat(str(value).strip()[:10])
    except ValueError as exc:
        raise ValueError(f"Date could not be parsed: {value}") from exc


def prepare(df: DataFrame) -> DataFrame:
    """A1: date and numbers of a re-read table, coerced; unparsable -> NULL.  Typed columns cost nothing.

    Every analysis starts with it; columns that an analysis does not need may be absent."""
    out = df
    types = dict(df.dtypes)
    if types.get("date", "date") != "date":
        out = out.withColumn("date", F.to_date(F.col("date").try_cast("timestamp")))
    for c in ("quantity", "unit_price", "revenue"):
        if types.get(c, "double") not in ("double", "decimal(38,2)"):
            out = out.withColumn(c, F.col(c).try_cast("double"))
    return out


def sales_base(df: DataFrame, start=None, end=None, series_cols: Sequence[str] = ()) -> DataFrame:
    """Sums per (series, date, product): one pass over the rows that every analysis here can read instead of them."""
    return (filter_range(df, start, end).groupBy(*series_cols, "date", "product_name")
            .agg(money_sum(F.col("revenue")).alias("revenue"), F.sum("quantity").alias("quantity"),
                 money_sum(F.col("unit_price")).alias("_price"), F.count("unit_price").alias("_prices"),
                 F.count(F.lit(1)).alias("_rows")))


def is_base(df: DataFrame) -> bool:
    """Whether ``df`` comes from :func:`sales_base`."""
    return "_rows" in df.columns


def date_range(df: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """A2: min/max non-null date (one row, NULLs when there is no date)."""
    df = prepare(df)
    agg = [F.min("date").alias("start_date"), F.max("date").alias("end_date")]
    return df.groupBy(*series_cols).agg(*agg) if series_cols else df.agg(*agg)


def filter_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """A3: inclusive date filter on the prepared table (A1); pushes into the Parquet scan."""
    df = prepare(df)
    if start is None and end is None:
        return df.where(F.col("date").isNotNull())
    s, e = _as_date(start), _as_date(end)
    if s > e:
        raise ValueError("Start date cannot be later than end date.")
    return df.where(F.col("date").between(F.lit(s), F.lit(e)))


def _bounds(df: DataFrame, start, end, series_cols: Sequence[str]) -> DataFrame:
    """1 row (or 1 per series) with start/end of the calendar to fill."""
    if start is not None and end is not None:
        if series_cols:
            return (df.select(*series_cols).distinct()
                      .withColumns({"start_date": F.lit(_as_date(start)),
                                    "end_date": F.lit(_as_date(end))}))
        return df.sparkSession.range(1).select(F.lit(_as_date(start)).alias("start_date"),
                                               F.lit(_as_date(end)).alias("end_date"))
    return date_range(df, series_cols)


def daily_sales(df: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """A5: per-day sums (partial aggregation before the shuffle)."""
    rows = F.sum("_rows") if is_base(df) else F.count(F.lit(1))
    return (df.where(F.col("date").isNotNull())
              .groupBy(*series_cols, "date")
              .agg(money_sum(F.col("revenue")).alias("revenue"),
                   F.sum("quantity").alias("quantity"),
                   rows.alias("row_count")))


def daily_filled(df: DataFrame, start=None, end=None,
                 series_cols: Sequence[str] = ()) -> DataFrame:
    """Every calendar day in range, zero filled, ``has_sales`` flag.

    The spine is ``explode(sequence(start, end))`` of a one-row (or one row
    per series) bounds table: its size is the number of days, not rows.
    """
    ranged = filter_range(df, start, end)
    daily = daily_sales(ranged, series_cols)
    # bounds from the (small) daily aggregate: its exchange is reused, no
    # second scan of the raw rows
    bounds = _bounds(daily, start, end, series_cols)
    spine = bounds.select(*series_cols, F.explode(
        F.sequence("start_date", "end_date", F.expr("INTERVAL 1 DAY"))).alias("date"))
    keys = [*series_cols, "date"]
    return (spine.join(daily, keys, "left")
                 .select(*keys,
                         F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)).alias("revenue"),
                         F.coalesce(F.col("quantity"), F.lit(0.0)).alias("quantity"),
                         F.coalesce(F.col("row_count"), F.lit(0)).alias("row_count"),
                         F.coalesce(F.col("row_count") > 0, F.lit(False)).alias("has_sales")))


def kpi_summary(df: DataFrame, start=None, end=None, series_cols: Sequence[str] = ()) -> DataFrame:
    """A4 + A7: one row of KPIs (per series when given)."""
    ranged = filter_range(df, start, end)
    if is_base(df):
        rows, price, prices = F.coalesce(F.sum("_rows"), F.lit(0)), F.sum("_price"), F.sum("_prices")
    else:
        rows, price, prices = F.count(F.lit(1)), money_sum(F.col("unit_price")), F.count("unit_price")
    kpi_aggs = [rows.alias("row_count"),
                F.coalesce(money_sum(F.col("revenue")).cast("double"), F.lit(0.0)).alias("total_revenue"),
                F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("total_quantity"),
                F.count_distinct("product_name").alias("product_variety"),
                (price.cast("double") / F.nullif(prices, F.lit(0))).alias("_avg_price")]
    kpis = ranged.groupBy(*series_cols).agg(*kpi_aggs) if series_cols else ranged.agg(*kpi_aggs)
    daily = daily_filled(df, start, end, series_cols)
    day_aggs = [money_sum(F.col("revenue")).alias("_rev_all"),
                F.count(F.lit(1)).alias("_days"),
                money_sum(F.when(F.col("has_sales"), F.col("revenue"))).alias("_rev_sales"),
                F.count_if(F.col("has_sales")).alias("_sales_days")]
    days = daily.groupBy(*series_cols).agg(*day_aggs) if series_cols else daily.agg(*day_aggs)
    joined = kpis.join(days, list(series_cols), "left") if series_cols else kpis.crossJoin(F.broadcast(days))
    return joined.select(
        *series_cols, "row_count",
        round2(F.col("total_revenue")).alias("total_revenue"),
        round2(F.col("total_quantity")).alias("total_quantity"),
        "product_variety",
        round2(F.col("_avg_price")).alias("average_unit_price"),
        round2(F.col("_rev_all").cast("double") / F.nullif(F.col("_days"), F.lit(0)))
        .alias("avg_daily_revenue_all_days"),
        round2(F.col("_rev_sales").cast("double") / F.nullif(F.col("_sales_days"), F.lit(0)))
        .alias("avg_daily_revenue_sales_days"),
    )


def avg_daily_revenue(df: DataFrame, start=None, end=None) -> DataFrame:
    """A7 alone: mean daily revenue over all days / over sales days."""
    return kpi_summary(df, start, end).select("avg_daily_revenue_all_days",
                                              "avg_daily_revenue_sales_days")


def top_revenue_products(df: DataFrame, start=None, end=None, limit: int = 10,
                         series_cols: Sequence[str] = ()) -> DataFrame:
    """Revenue per product, top ``limit`` (ties by name)."""
    ranged = filter_range(df, start, end).where(F.col("product_name").isNotNull())
    per = (ranged.groupBy(*series_cols, "product_name")
                 .agg(F.coalesce(money_sum(F.col("revenue")), F.lit(0)).cast("double").alias("revenue")))
    return _top(per, [F.desc("revenue"), F.asc("product_name")], limit, series_cols,
                ["product_name", "revenue"])


def _product_counts(df: DataFrame, start, end, limit: int, ascending: bool,
                    series_cols: Sequence[str]) -> DataFrame:
    ranged = filter_range(df, start, end).where(F.col("product_name").isNotNull())
    rows = F.sum("_rows") if is_base(df) else F.count(F.lit(1))
    per = ranged.groupBy(*series_cols, "product_name").agg(rows.alias("count"))
    order = [F.asc("count") if ascending else F.desc("count"), F.asc("product_name")]
    return _top(per, order, limit, series_cols, ["product_name", "count"])


def top_selling_products(df: DataFrame, start=None, end=None, limit: int = 10,
                         series_cols: Sequence[str] = ()) -> DataFrame:
    """Most rows per product (Q8: rows, not quantity)."""
    return _product_counts(df, start, end, limit, False, series_cols)


def least_selling_products(df: DataFrame, start=None, end=None, limit: int = 10,
                           series_cols: Sequence[str] = ()) -> DataFrame:
    """A10: fewest rows per product."""
    return _product_counts(df, start, end, limit, True, series_cols)


def _top(per: DataFrame, order: list[Column], limit: int, series_cols: Sequence[str],
         cols: list[str]) -> DataFrame:
    """Top-k: a global ``orderBy().limit()`` plans as TakeOrderedAndProject
    (per-partition top-k, no full sort); per series a ranked window."""
    w = Window.partitionBy(*series_cols).orderBy(*order) if series_cols else Window.orderBy(*order)
    if not series_cols:
        top = per.orderBy(*order).limit(limit)
        return top.select(F.row_number().over(w).alias("rank"), *cols)
    ranked = per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return ranked.select(*series_cols, "rank", *cols)


def daily_series(df: DataFrame, start=None, end=None, series_cols: Sequence[str] = ()) -> DataFrame:
    """(date, revenue, quantity) over the filled calendar, rounded 2."""
    return daily_filled(df, start, end, series_cols).select(
        *series_cols, "date", round2(F.col("revenue")).alias("revenue"),
        round2(F.col("quantity")).alias("quantity"))


def sales_report(df: DataFrame, start=None, end=None, limit: int = 10) -> DataFrame:
    """Every section of the text report as a long table
    ``(section, rank, key, value)``; rendering is left to the caller.

    The rows are read once, into a written (date, product) aggregate that all sections read."""
    df = keep_table(sales_base(df, start, end), "base")
    k = kpi_summary(df, start, end)
    kpi_cols = ["row_count", "total_revenue", "total_quantity", "product_variety",
                "average_unit_price", "avg_daily_revenue_all_days", "avg_daily_revenue_sales_days"]
    kpi_long = k.select(F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("rank"), F.lit(c).alias("key"),
                 F.col(c).cast("double").alias("value")) for i, c in enumerate(kpi_cols)])).alias("r")
    ).select(F.lit("kpi").alias("section"), "r.rank", "r.key", "r.value")
    parts = [kpi_long]
    for name, frame, val in [
        ("top_revenue_products", top_revenue_products(df, start, end, limit), "revenue"),
        ("top_selling_products", top_selling_products(df, start, end, limit), "count"),
        ("least_selling_products", least_selling_products(df, start, end, limit), "count"),
    ]:
        parts.append(frame.select(F.lit(name).alias("section"), "rank",
                                  F.col("product_name").alias("key"),
                                  F.col(val).cast("double").alias("value")))
    daily = daily_series(df, start, end)
    for name in ("revenue", "quantity"):
        parts.append(daily.select(
            F.lit(f"daily_{name}").alias("section"),
            F.datediff("date", F.lit(_dt.date(1970, 1, 1))).alias("rank"),
            F.date_format("date", "yyyy-MM-dd").alias("key"),
            F.col(name).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("section", F.col("rank").cast("int").alias("rank"), "key", "value")
