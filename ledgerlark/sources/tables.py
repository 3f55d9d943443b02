"""Table bindings over the parquet test tables.

``sales`` maps the TPC-H-like star schema onto the standard sales schema;
``dirty_sales`` derives a messy all-text table (Turkish headers, mixed
decimal marks, currency signs, placeholders) with its truth alongside, so
cleaning can be checked as a round trip.  Both are lazy plans over the
whole tables; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Source column names of the dirty table and the mapping onto the standard schema.
DIRTY_MAPPING = {
    "date": "Satış Tarihi",
    "product_name": "Ürün Adı",
    "quantity": "Miktar",
    "unit_price": "Birim Fiyat",
    "revenue": "Toplam Tutar",
    "discount": "İndirim",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str, with_orders: bool = False,
          with_customer: bool = False) -> DataFrame:
    """lineitem x part (x orders) as the standard sales schema plus extras.

    Join strategy is left to Catalyst/AQE: ``part`` and ``orders`` grow with
    the data, so no broadcast hint is given; AQE broadcasts them only when
    the measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
    ``orders`` is joined only when its columns are asked for.  ``part`` comes
    last, so that its texts are not shuffled once more with every line; dates
    are cut to days, and ``h`` is made of its keys, before the joins for the same reason.
    """
    df = table(spark, sf_dir, "lineitem").withColumns({
        "date": F.to_date("l_shipdate"),
        "h": (F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_suppkey") * 3
              + F.col("l_linenumber")) % 1000})
    part = table(spark, sf_dir, "part")
    extras = []
    if with_orders or with_customer:
        orders = table(spark, sf_dir, "orders").withColumn("order_date", F.to_date("o_orderdate"))
        df = df.join(orders, df["l_orderkey"] == orders["o_orderkey"])
        extras.append(F.col("order_date"))
        if with_customer:
            cust = table(spark, sf_dir, "customer")
            nation = table(spark, sf_dir, "nation")
            df = (df.join(cust, df["o_custkey"] == cust["c_custkey"])
                    .join(nation, F.col("c_nationkey") == nation["n_nationkey"]))
            extras += [F.col("c_mktsegment"), F.col("n_name")]
    df = df.join(part, df["l_partkey"] == part["p_partkey"])
    return df.select(
        "date",
        F.lower("p_name").alias("product_name"),
        F.col("l_quantity").alias("quantity"),
        (F.floor(F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
                 * 100 + 0.5) / 100).alias("unit_price"),
        F.col("l_extendedprice").alias("revenue"),
        F.col("l_discount").alias("discount"),
        "l_returnflag", "p_brand", "p_type",
        *extras,
        "h",
    )


def _s(c: Column) -> Column:
    return c.cast("string")


def _pad2(c: Column) -> Column:
    return F.lpad(_s(c), 2, "0")


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy text version of ``sales`` with truth columns (FIXTURES.md §3)."""
    return dirtied(sales(spark, sf_dir))


def dirtied(s: DataFrame, *keep: str) -> DataFrame:
    """``dirty_sales`` of rows of ``sales``; columns named by ``keep`` stay."""
    h, d = F.col("h"), F.col("date")
    date_txt = (
        F.when(h % 4 == 0, F.concat(_pad2(F.day(d)), F.lit("."), _pad2(F.month(d)), F.lit("."), _s(F.year(d))))
         .when(h % 4 == 1, F.concat(_s(F.day(d)), F.lit("/"), _s(F.month(d)), F.lit("/"), _s(F.year(d))))
         .when((h % 4 == 2) & (F.year(d) >= 2000),
               F.concat(_pad2(F.day(d)), F.lit("-"), _pad2(F.month(d)), F.lit("-"),
                        F.substring(_s(F.year(d)), 3, 2)))
         .otherwise(F.concat(F.lit(" "), _pad2(F.day(d)), F.lit(" / "), _pad2(F.month(d)),
                             F.lit(" / "), _s(F.year(d)), F.lit(" "))))
    p = F.col("product_name")
    product_txt = (F.when(h % 3 == 0, F.upper(p))
                    .when(h % 3 == 1, F.concat(F.lit("  "), F.replace(p, F.lit(" "), F.lit("   ")), F.lit(" ")))
                    .otherwise(p))
    q = F.col("quantity")
    qty_txt = (F.when(h % 50 == 7, F.lit("yok"))
                .when(h % 50 == 8, F.lit("-3"))
                .when(h % 2 == 0, F.concat(_s(q.cast("bigint")), F.lit(" adet")))
                .otherwise(F.replace(_s(q), F.lit("."), F.lit(","))))
    up = F.col("unit_price")
    price_txt = (F.when(h % 3 == 0, F.concat(F.lit("₺"), _s(up)))
                  .when(h % 3 == 1, F.concat(F.replace(_s(up), F.lit("."), F.lit(",")), F.lit(" TL")))
                  .otherwise(_s(up)))
    rev_txt = (F.when(h % 20 == 5, F.lit("n/a"))
                .otherwise(F.concat(F.replace(_s(F.col("revenue")), F.lit("."), F.lit(",")), F.lit(" TL"))))
    disc_txt = F.concat(F.lit("%"), _s(F.round(F.col("discount") * 100).cast("int")))
    return s.select(
        "h",
        d.alias("true_date"), p.alias("true_product"), q.alias("true_quantity"),
        up.alias("true_price"), F.col("revenue").alias("true_revenue"),
        F.col("discount").alias("true_discount"),
        date_txt.alias(DIRTY_MAPPING["date"]),
        product_txt.alias(DIRTY_MAPPING["product_name"]),
        qty_txt.alias(DIRTY_MAPPING["quantity"]),
        price_txt.alias(DIRTY_MAPPING["unit_price"]),
        rev_txt.alias(DIRTY_MAPPING["revenue"]),
        disc_txt.alias(DIRTY_MAPPING["discount"]),
        *keep,
    )
