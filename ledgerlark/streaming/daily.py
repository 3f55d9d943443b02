"""Streaming daily sales (optional path of the build plan).

With an explicit ``date_order`` the row-wise cleaners are stateless, so the
same cleaning expressions run on a streaming DataFrame; daily sums then use
an event-time watermark and a one-day tumbling window (late rows within the
watermark update their day; older ones are dropped by the engine).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import money_sum
from ..operators.clean import clean_sales


def clean_stream(std_stream: DataFrame, date_order: str) -> DataFrame:
    """Cleaned rows of a standardized stream (no detection aggregate)."""
    return clean_sales(std_stream, date_order=date_order, row_id="row_id"
                       if "row_id" in std_stream.columns else None).cleaned


def daily_sales_stream(cleaned: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Daily revenue / quantity / rows over event time with a watermark."""
    ts = F.col("date").cast("timestamp")
    return (cleaned.where(F.col("date").isNotNull())
                   .withColumn("event_time", ts)
                   .withWatermark("event_time", watermark)
                   .groupBy(F.window("event_time", "1 day").alias("day"))
                   .agg(money_sum(F.col("revenue")).cast("double").alias("revenue"),
                        F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("row_count"))
                   .select(F.to_date(F.col("day.start")).alias("date"), "revenue", "quantity", "row_count"))
