"""Business summary document (D1, D2) and table fingerprint (D3).

The summary is one row built from one-row aggregates and bounded top-k
arrays (``limit`` before ``collect_list``), cross-joined and serialized
with ``to_json``; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep_table
from . import analysis as A
from . import anomaly as B
from . import pareto as P


def _top_array(df: DataFrame, n: int, order, name: str) -> DataFrame:
    top = df.orderBy(*order).limit(n)
    return top.agg(F.collect_list(F.struct(*df.columns)).alias(name))


def business_summary(sales: DataFrame, start=None, end=None, forecast_summary: DataFrame | None = None,
                     top: int = 5) -> DataFrame:
    """Date range, KPIs, top products, ABC counts + top A products,
    anomaly summary + top anomaly days, forecast per horizon; one row with a
    ``summary`` JSON column (timestamps ISO, NaN already NULL: D2).

    One document describes one sales series; ``forecast_summary`` is that
    series' per-horizon table (five rows), so every array is bounded.
    """
    # one pass over the rows; every part below reads the (date, product) sums
    sales = keep_table(A.sales_base(sales, start, end), "base")
    rng = A.date_range(A.filter_range(sales, start, end)).select(
        F.struct(F.date_format("start_date", "yyyy-MM-dd").alias("start"),
                 F.date_format("end_date", "yyyy-MM-dd").alias("end")).alias("date_range"))
    kpi = A.kpi_summary(sales, start, end).select(F.struct("*").alias("kpi_summary"))
    tr = _top_array(A.top_revenue_products(sales, start, end, top), top, ["rank"], "top_by_revenue")
    ts = _top_array(A.top_selling_products(sales, start, end, top), top, ["rank"], "top_by_quantity_count")
    ls = _top_array(A.least_selling_products(sales, start, end, top), top, ["rank"], "least_selling")
    abc = P.pareto_abc(sales, start, end)
    counts = P.abc_class_counts(sales, start, end, abc=abc).agg(
        F.map_from_entries(F.collect_list(F.struct("abc_class", "product_count"))).alias("class_counts"))
    top_a = _top_array(abc.where("abc_class = 'A'"), top, [F.desc("revenue"), "product_name"], "top_a_products")
    an = B.anomaly_summary(sales, start, end).select(F.struct("*").alias("anomaly_summary"))
    top_an = _top_array(B.anomaly_days(sales, start, end), top, [F.desc("revenue"), "date"], "top_anomaly_days")
    out = (rng.crossJoin(kpi).crossJoin(tr).crossJoin(ts).crossJoin(ls).crossJoin(counts)
              .crossJoin(top_a).crossJoin(an).crossJoin(top_an))
    if forecast_summary is not None:
        out = out.crossJoin(forecast_summary.agg(
            F.sort_array(F.collect_list(F.struct("*"))).alias("ml_forecast_summary")))
    else:
        out = out.withColumn("ml_forecast_summary", F.struct(F.lit("not_run").alias("status")))
    doc = F.struct(
        "date_range", "kpi_summary",
        F.struct("top_by_revenue", "top_by_quantity_count", "least_selling").alias("top_products_summary"),
        F.struct("class_counts", "top_a_products").alias("pareto_abc_summary"),
        F.struct("anomaly_summary", "top_anomaly_days").alias("anomaly"),
        "ml_forecast_summary")
    return out.select(F.to_json(doc, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("summary"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """D3: order-free content fingerprint (row count + sum of row hashes,
    accumulated as a wide decimal so it cannot overflow)."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(h).cast("string").alias("hash_sum"))
