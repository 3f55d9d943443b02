"""Sinks (S5-S7): cleaned / standardized / anomaly tables, reports, preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by_month: bool = False) -> None:
    """Parquet by default (CSV with header on request).  Partitioning
    the cleaned table by month lets later date-range filters prune files."""
    out = df
    writer = None
    if partition_by_month and "date" in df.columns:
        out = df.withColumn("month", F.date_format("date", "yyyy-MM"))
        writer = out.write.partitionBy("month")
    writer = writer or out.write
    writer = writer.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_report(report_json: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row JSON document written as text."""
    report_json.select(F.col(report_json.columns[0]).alias("value")).coalesce(1).write.mode(mode).text(path)


def preview(df: DataFrame, n: int = 50, order_by: str | None = None) -> DataFrame:
    """The first ``n`` rows (by ``order_by`` when order matters)."""
    return (df.orderBy(order_by) if order_by else df).limit(n)
