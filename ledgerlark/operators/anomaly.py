"""IQR revenue anomalies on the gap-filled daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round2, round6
from ..schema import IQR_DEFAULT_MULTIPLIER
from .analysis import daily_filled

HIGH_REASON = "Above normal upper bound"
LOW_REASON = "Below normal lower bound"


def iqr_bounds(daily: DataFrame, multiplier: float = IQR_DEFAULT_MULTIPLIER,
               series_cols: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """B1: q1/q3 with linear interpolation (exact ``percentile``), bounds.

    Runs after the daily aggregation, so each group holds one value per
    calendar day.  ``approximate=True`` switches to ``percentile_approx`` for
    very long grouped series.
    """
    if approximate:
        q = F.percentile_approx("revenue", [0.25, 0.75], 10000)
    else:
        q = F.percentile(F.col("revenue"), F.array(F.lit(0.25), F.lit(0.75)))
    aggs = [q.alias("_q"), F.count(F.lit(1)).alias("total_days")]
    b = daily.groupBy(*series_cols).agg(*aggs) if series_cols else daily.agg(*aggs)
    q1, q3 = F.col("_q")[0].cast("double"), F.col("_q")[1].cast("double")
    iqr = q3 - q1
    return b.select(*series_cols, q1.alias("q1"), q3.alias("q3"), iqr.alias("iqr"),
                    (q1 - F.lit(multiplier) * iqr).alias("lower_bound"),
                    (q3 + F.lit(multiplier) * iqr).alias("upper_bound"),
                    F.lit(float(multiplier)).alias("multiplier"), "total_days")


def anomaly_flags(df: DataFrame, start=None, end=None, multiplier: float = IQR_DEFAULT_MULTIPLIER,
                  include_low: bool = False, series_cols: Sequence[str] = ()) -> DataFrame:
    """B2: daily rows with ``is_anomaly``, ``anomaly_revenue``, both bounds.

    The bounds are one row (broadcast) or one row per series (joined on the
    series keys); never collected to the driver.
    """
    daily = daily_filled(df, start, end, series_cols)
    bounds = iqr_bounds(daily, multiplier, series_cols)
    # one bounds row in total -> broadcast; one per series grows with the
    # series count -> plain equi-join (AQE broadcasts it when it is small)
    joined = (daily.join(bounds, list(series_cols), "inner") if series_cols
              else daily.crossJoin(F.broadcast(bounds)))
    high = F.col("revenue") > F.col("upper_bound")
    low = (F.col("revenue") < F.col("lower_bound")) if include_low else F.lit(False)
    return joined.select(
        *series_cols, "date", "revenue", "quantity",
        (high | low).alias("is_anomaly"),
        F.when(high | low, F.col("revenue")).alias("anomaly_revenue"),
        F.col("upper_bound").alias("normal_upper_bound"),
        F.col("lower_bound").alias("normal_lower_bound"),
        F.when(high, F.lit(HIGH_REASON)).when(low, F.lit(LOW_REASON)).alias("reason"),
    )


def anomaly_days(df: DataFrame, start=None, end=None, multiplier: float = IQR_DEFAULT_MULTIPLIER,
                 include_low: bool = False, series_cols: Sequence[str] = ()) -> DataFrame:
    """Flagged days with reason, revenue desc then date asc."""
    flags = anomaly_flags(df, start, end, multiplier, include_low, series_cols)
    return (flags.where("is_anomaly")
                 .select(*series_cols, "date", round2(F.col("revenue")).alias("revenue"),
                         round2(F.col("quantity")).alias("quantity"), "reason")
                 .orderBy(*series_cols, F.desc("revenue"), F.asc("date")))


def anomaly_summary(df: DataFrame, start=None, end=None, multiplier: float = IQR_DEFAULT_MULTIPLIER,
                    include_low: bool = False, series_cols: Sequence[str] = ()) -> DataFrame:
    """Days flagged, total days, ratio, highest high day, bounds."""
    flags = anomaly_flags(df, start, end, multiplier, include_low, series_cols)
    is_high = F.col("reason") == HIGH_REASON
    aggs = [
        F.count_if("is_anomaly").alias("anomaly_days"),
        F.count(F.lit(1)).alias("total_days"),
        F.max_by(F.when(is_high, F.col("date")),
                 F.when(is_high, F.struct(F.col("revenue"), -F.datediff("date", F.lit("1970-01-01")))))
         .alias("highest_anomaly_date"),
        F.max(F.when(is_high, F.col("revenue"))).alias("highest_anomaly_revenue"),
        F.first("normal_upper_bound").alias("normal_upper_bound"),
        F.first("normal_lower_bound").alias("normal_lower_bound"),
    ]
    s = flags.groupBy(*series_cols).agg(*aggs) if series_cols else flags.agg(*aggs)
    return s.select(*series_cols, "anomaly_days", "total_days",
                    round6(F.col("anomaly_days") / F.nullif(F.col("total_days"), F.lit(0)))
                    .alias("anomaly_ratio"),
                    "highest_anomaly_date", "highest_anomaly_revenue",
                    round6(F.col("normal_upper_bound")).alias("normal_upper_bound"),
                    round6(F.col("normal_lower_bound")).alias("normal_lower_bound"))


def top_anomaly_days(df: DataFrame, limit: int = 10, **kw) -> DataFrame:
    """B3 display view: the first ``limit`` anomaly days."""
    w = Window.orderBy(F.desc("revenue"), F.asc("date"))
    return anomaly_days(df, **kw).limit(limit).withColumn("rank", F.row_number().over(w))
