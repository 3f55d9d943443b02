"""Pareto / ABC classes (B5, B6) and the what-if scenario table.

The running share needs a total order over all products.  A global window
would pull every product into one task, and the product count grows with the
data, so the running sum is distributed (H5):

1. revenue per product (partial aggregation, shuffle on product);
2. ``repartitionByRange`` on (revenue desc, product) -> partitions are
   contiguous slices of the order; ``spark_partition_id`` numbers them;
3. one total per slice (as many rows as partitions) -> exclusive prefix
   offsets, broadcast (its size is bounded by the partition count);
4. a window *per slice* adds the local running sum to the slice offset.

Sums are DECIMAL(38,2), so shares are exact and independent of the plan.
The slice table is checkpointed so the range partition ids survive task
re-execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import money_sum, round2, round6
from ..schema import ABC_A_LIMIT, ABC_B_LIMIT
from ..session import cut_lineage
from .analysis import filter_range


def product_revenue(df: DataFrame, start=None, end=None,
                    series_cols: Sequence[str] = ()) -> DataFrame:
    ranged = filter_range(df, start, end)
    return (ranged.where(F.col("product_name").isNotNull() & F.col("revenue").isNotNull())
                  .groupBy(*series_cols, "product_name")
                  .agg(money_sum(F.col("revenue")).alias("revenue")))


def _classify(before, total):
    share_before = before / total
    return (F.when(share_before < ABC_A_LIMIT, F.lit("A"))
             .when(share_before < ABC_B_LIMIT, F.lit("B"))
             .otherwise(F.lit("C")))


def pareto_abc(df: DataFrame, start=None, end=None, series_cols: Sequence[str] = (),
               slices: int | None = None) -> DataFrame:
    """``product_name, revenue, revenue_share, cumulative_share, abc_class``.

    Class is decided by the cumulative share *before* the row (Q13): < .80 A,
    < .95 B, else C.  Empty when the total revenue is <= 0.

    The running sum is distributed, with series or without: products are cut into ranges of (series,
    revenue descending, product); a range adds the sums of its series' earlier ranges to a window of its own, so
    that a series with very many products is many tasks.  The ranges are written once (checkpoint).
    """
    s = list(series_cols)
    per = product_revenue(df, start, end, s)
    order = [F.desc("revenue"), F.asc("product_name")]
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut_lineage(per.repartitionByRange(n, *s, *order).withColumn("_slice", F.spark_partition_id()))
    # one row per range and series in it
    sums = sliced.groupBy(*s, "_slice").agg(F.sum("revenue").alias("_sum"))
    earlier = Window.partitionBy(*s).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*s, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0).cast("decimal(38,2)")).alias("_offset"),
                          F.sum("_sum").over(Window.partitionBy(*s)).alias("_total"))
    own = Window.partitionBy(*s, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = (sliced.join(offsets if s else F.broadcast(offsets), [*s, "_slice"])
           .withColumn("_cum", F.col("_offset") + F.sum("revenue").over(own)))
    total = F.col("_total").cast("double")
    cum = F.col("_cum").cast("double")
    rev = F.col("revenue").cast("double")
    before = (F.col("_cum") - F.col("revenue")).cast("double")
    return (out.where(F.col("_total") > 0)
               .select(*series_cols, "product_name", rev.alias("revenue"),
                       (rev / total).alias("revenue_share"),
                       (cum / total).alias("cumulative_share"),
                       _classify(before, total).alias("abc_class")))


def abc_class_counts(df: DataFrame, start=None, end=None, series_cols: Sequence[str] = (),
                     abc: DataFrame | None = None) -> DataFrame:
    """Products per class, zero rows kept (literal class table LEFT JOIN)."""
    abc = abc if abc is not None else pareto_abc(df, start, end, series_cols)
    spark = df.sparkSession
    classes = spark.createDataFrame([("A",), ("B",), ("C",)], "abc_class string")
    counts = abc.groupBy(*series_cols, "abc_class").agg(F.count(F.lit(1)).alias("product_count"))
    if series_cols:
        keys = abc.select(*series_cols).distinct().crossJoin(F.broadcast(classes))
    else:
        keys = classes
    return (keys.join(counts, [*series_cols, "abc_class"], "left")
                .select(*series_cols, "abc_class",
                        F.coalesce("product_count", F.lit(0)).alias("product_count")))


DEFAULT_PCTS = [-20, -10, 0, 10, 20]


def what_if_scenarios(df: DataFrame, start=None, end=None, price_pcts=None, qty_pcts=None,
                      by_product: bool = False) -> DataFrame:
    """Revenue * (1 + price%) * (1 + qty%) for a grid of scenarios.

    The scenario grid is a literal table (tens of rows) broadcast against the
    current total (or per-product totals with ``by_product``).
    """
    price_pcts = DEFAULT_PCTS if price_pcts is None else list(price_pcts)
    qty_pcts = DEFAULT_PCTS if qty_pcts is None else list(qty_pcts)
    for v in [*price_pcts, *qty_pcts]:
        if not -100 <= v <= 100:
            raise ValueError("scenario percentages must be within -100..100")
    rows = [(i + 1, float(p), float(q)) for i, (p, q) in
            enumerate((p, q) for p in price_pcts for q in qty_pcts)]
    spark = df.sparkSession
    grid = spark.createDataFrame(rows, "scenario_id int, price_pct double, qty_pct double")
    ranged = filter_range(df, start, end)
    keys = ["product_name"] if by_product else []
    agg = [F.coalesce(money_sum(F.col("revenue")), F.lit(0)).cast("double").alias("current_revenue")]
    base = ranged.groupBy(*keys).agg(*agg) if keys else ranged.agg(*agg)
    cur = F.col("current_revenue")
    sim = cur * (1 + F.col("price_pct") / 100) * (1 + F.col("qty_pct") / 100)
    out = base.crossJoin(F.broadcast(grid)).withColumn("simulated_revenue", sim)
    diff = F.col("simulated_revenue") - cur
    return out.select(*keys, "scenario_id", "price_pct", "qty_pct",
                      round2(cur).alias("current_revenue"),
                      round2(F.col("simulated_revenue")).alias("simulated_revenue"),
                      round2(diff).alias("difference"),
                      round6(F.when(cur != 0, diff / cur).otherwise(F.lit(0.0))).alias("change_ratio"))
