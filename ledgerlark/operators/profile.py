"""Table and column profiling.

All column statistics come from **one** aggregation pass over the table
(conditional counts per column), then an unpivot to one row per column.
The classification per value is a Catalyst expression (strict number parse,
day-first date patterns); no Python runs per row.  The whole table is profiled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import is_date_like
from ..functions.numbers import round_even, with_strict_number
from ..functions.text import normalize_name, strip_ws
from ..schema import CURRENCY_MARKERS

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
# Fixed tie order for the dominant class (first wins on equal counts).
CLASS_ORDER = ["date", "numeric", "string"]
NORMALIZED_CURRENCY = ["tl", "try", "usd", "eur"]


def table_snapshot(df: DataFrame) -> DataFrame:
    """Rows, columns, total missing cells (one pass)."""
    missing = [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]
    total = missing[0] if len(missing) == 1 else F.aggregate(
        F.array(*missing), F.lit(0).cast("bigint"), lambda a, x: a + x) if missing else F.lit(0)
    return df.agg(F.count(F.lit(1)).alias("row_count"),
                  F.lit(len(df.columns)).alias("column_count"),
                  total.cast("bigint").alias("missing_cells"))


def column_summary(df: DataFrame) -> DataFrame:
    """Per column dtype, missing count and ratio (round 4)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_m{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column"),
                     F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                     F.col(f"_m{i}").alias("missing_count"),
                     round_even(F.col(f"_m{i}") / F.nullif(F.col("_n"), F.lit(0)), 4).alias("missing_ratio"))
            for i, c in enumerate(df.columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_CURRENCY_RE = "(?i)(" + "|".join(re.escape(m) for m in CURRENCY_MARKERS) + ")"
_FOLDED_CURRENCY_RE = "(" + "|".join(NORMALIZED_CURRENCY) + ")"


def _currency_hit(s: Column) -> Column:
    """Currency marker in the value, or in its normalized form.  Folding
    accents can only create a marker in non-ASCII text (for ASCII the
    normalized form never joins letters), so only those are normalized."""
    return s.rlike(_CURRENCY_RE) | (s.rlike("[^\\x00-\\x7F]")
                                    & normalize_name(s).rlike(_FOLDED_CURRENCY_RE))


def _name_currency(name: str) -> bool:
    from ..functions.text import ACCENT_FROM, ACCENT_TO  # plain-Python twin for a literal
    low = name.lower()
    if any(m in low for m in CURRENCY_MARKERS):
        return True
    import re
    t = low.replace("i̇", "i").translate(str.maketrans("çğıöşü" + ACCENT_FROM, "cgiosu" + ACCENT_TO))
    t = re.sub(r"[^a-z0-9]+", " ", t)
    return any(m in t for m in NORMALIZED_CURRENCY)


def column_profile(df: DataFrame, with_samples: bool = True, sample_size: int = 10) -> DataFrame:
    """One row per column: normalized name, class counts, dominant type,
    mean string length, currency flag, sample values.

    ``dominant_type``: most frequent non-empty class (ties in the fixed
    order date, numeric, string); ``string`` becomes ``long_string`` when the
    string values average more than 10 characters; all empty ->
    ``short_string``.
    """
    cols = df.columns
    # Unpivot to one row per cell: the classification expression exists once
    # whatever the column count (small generated code), and the per-column
    # counts are a grouped aggregate with map-side partial aggregation.
    kind = {i: ("date" if isinstance(df.schema[c].dataType, _DATES)
                else "num" if isinstance(df.schema[c].dataType, _NUMERIC) else "text")
            for i, c in enumerate(cols)}
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(kind[i]).alias("kind"),
                 (F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("string"))
                  if kind[i] == "num" else F.col(f"`{c}`").cast("string")).alias("x"))
        for i, c in enumerate(cols)])).alias("cell")).select("cell.*")
    cells = cells.withColumn("t", strip_ws(F.col("x")))
    cells = with_strict_number(cells, "t", "_num_any")
    cells = cells.withColumn("num", F.when(F.col("kind") == "text", F.col("_num_any"))).drop("_num_any")
    k = (F.when(F.col("x").isNull(), F.lit("empty"))
          .when(F.col("kind") == "date", F.lit("date"))
          .when(F.col("kind") == "num", F.lit("numeric"))
          .when(is_date_like(F.col("t"), F.col("num")), F.lit("date"))
          .when(F.col("num").isNotNull(), F.lit("numeric"))
          .otherwise(F.lit("string")))
    cells = cells.withColumns({"k": k, "cur": F.when(F.col("x").isNotNull(), _currency_hit(F.col("x")))})
    per = cells.groupBy("i").agg(
        F.count_if(F.col("k") == "empty").alias("e"), F.count_if(F.col("k") == "date").alias("d"),
        F.count_if(F.col("k") == "numeric").alias("n"), F.count_if(F.col("k") == "string").alias("s"),
        F.sum(F.when(F.col("k") == "string", F.length("x"))).alias("l"),
        F.max("cur").alias("c"))
    spark = df.sparkSession
    names = spark.createDataFrame([(i, i + 1, c, _name_currency(c)) for i, c in enumerate(cols)],
                                  "i int, position int, column string, name_currency boolean")
    d, n, s_ = F.col("d"), F.col("n"), F.col("s")
    avg_len = F.col("l") / F.nullif(s_, F.lit(0))
    top = F.greatest(d, n, s_)
    dominant = (F.when(top == 0, F.lit("short_string"))
                 .when(d == top, F.lit("date"))
                 .when(n == top, F.lit("numeric"))
                 .when(F.coalesce(avg_len, F.lit(0.0)) > 10, F.lit("long_string"))
                 .otherwise(F.lit("short_string")))
    # ``per`` has one row per column (bounded by the schema): broadcast it
    prof = names.join(F.broadcast(per), "i", "left").select(
        "position", "column", normalize_name(F.col("column")).alias("normalized_name"),
        dominant.alias("dominant_type"),
        F.col("e").alias("n_empty"), d.alias("n_date"), n.alias("n_numeric"), s_.alias("n_string"),
        round_even(avg_len, 6).alias("avg_string_length"),
        (F.col("name_currency") | F.coalesce(F.col("c"), F.lit(False))).alias("has_currency"))
    if not with_samples:
        return prof
    samples = _sample_values(df, sample_size)
    return prof.join(F.broadcast(samples), "column", "left")


def _sample_values(df: DataFrame, k: int) -> DataFrame:
    """The first ``k`` non-null values of every column in table order, wherever they stand.

    The rank filter cuts each task to ``k`` rows per column before the shuffle."""
    cells = df.withColumn("_at", F.monotonically_increasing_id()).select("_at", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns])).alias("x"))
    order = Window.partitionBy("column").orderBy("_at")
    first = (cells.select("_at", "x.column", "x.v").where("v is not null")
             .withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k))
    return (first.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("_r", "v"))).alias("_s"))
            .select("column", F.col("_s.v").alias("sample_values")))


def normalize_names(df: DataFrame) -> DataFrame:
    """P8 as a table: ``(position, column, normalized_name)``."""
    return column_profile(df, with_samples=False).select("position", "column", "normalized_name")


def value_class_counts(df: DataFrame) -> DataFrame:
    """P3 counts per column and class (long form)."""
    prof = column_profile(df, with_samples=False)
    return prof.select("column", F.explode(F.array(*[
        F.struct(F.lit(k).alias("value_class"), F.col(f"n_{k}").alias("n")) for k in
        ("empty", "date", "numeric", "string")])).alias("r")).select("column", "r.value_class", "r.n")
