"""Schema matching: score which source column is date / product / quantity /
unit price / revenue / discount (K1-K10).

Scores are Column expressions over the profile table (one row per column),
so the same plan scores the columns of many tables at once.  The revenue
formula check (K7) is one aggregation pass over the raw table that tests
every candidate column at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import normalize_discount, round_even, with_strict_number
from ..functions.text import contains_any
from ..schema import (DATE_NAME_KEYS, DISCOUNT_BLOCK_KEYS, DISCOUNT_KEYS, PRICE_BLOCK_KEYS,
                      PRICE_KEYS, PRICE_UNIT_KEYS, PRODUCT_NAME_KEYS, PRODUCT_NAME_SECONDARY_KEYS,
                      QUANTITY_AMOUNT_KEYS, QUANTITY_BLOCK_KEYS, QUANTITY_KEYS,
                      REVENUE_AMOUNT_KEYS, REVENUE_BLOCK_KEYS, REVENUE_FORMULA_VALID_RATIO,
                      REVENUE_KEYS, REVENUE_RELATIVE_TOLERANCE, REVENUE_TOTAL_KEYS)

BASE_FORMULA = "quantity * unit_price"
DISCOUNT_FORMULA = "quantity * unit_price * (1 - discount)"


def _has(keys) -> Column:
    return contains_any(F.col("normalized_name"), keys)


def _type_is(*types) -> Column:
    return F.col("dominant_type").isin(*types).cast("int")


def revenue_formula_checks(raw: DataFrame, quantity: str | None, unit_price: str | None,
                           discount: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """K7 for every candidate revenue column in one aggregation pass.

    Per column and formula: rows with parsed q, p, revenue (and discount),
    revenue != 0 are checked; a row matches when
    ``|pred - rev| / |rev| <= .05``; valid when matched/checked > .5.
    ``is_best`` marks the formula chosen by (ratio, matched, checked), the
    base formula winning ties.  Whole table by default.
    """
    spark = raw.sparkSession
    schema = "column string, formula string, checked_rows bigint, matched_rows bigint, " \
             "match_ratio double, is_valid boolean, is_best boolean"
    if not quantity or not unit_price:
        return spark.createDataFrame([], schema)
    cols = [c for c in (columns if columns is not None else raw.columns)
            if c not in {quantity, unit_price, discount}]
    if not cols:
        return spark.createDataFrame([], schema)
    if discount in {quantity, unit_price}:
        discount = None
    # staged strict parses: each column's parse steps run once per row
    staged = raw.select(F.col(f"`{quantity}`").alias("_sq"), F.col(f"`{unit_price}`").alias("_sp"),
                        *([F.col(f"`{discount}`").alias("_sd")] if discount else []),
                        *[F.col(f"`{c}`").alias(f"_sr{i}") for i, c in enumerate(cols)])
    staged = with_strict_number(staged, "_sq", "_q")
    staged = with_strict_number(staged, "_sp", "_p")
    if discount:
        staged = with_strict_number(staged, "_sd", "_d0").withColumn("_d", normalize_discount(F.col("_d0")))
    for i, _ in enumerate(cols):
        staged = with_strict_number(staged, f"_sr{i}", f"_r{i}")
    forms = [(BASE_FORMULA, F.col("_q") * F.col("_p"), F.lit(True))]
    if discount:
        forms.append((DISCOUNT_FORMULA, F.col("_q") * F.col("_p") * (1 - F.col("_d")), F.col("_d").isNotNull()))
    aggs = []
    for i, _ in enumerate(cols):
        r = F.col(f"_r{i}")
        base_ok = F.col("_q").isNotNull() & F.col("_p").isNotNull() & r.isNotNull() & (r != 0)
        for j, (_, pred, extra) in enumerate(forms):
            ok = base_ok & extra
            aggs += [F.count_if(ok).alias(f"c{i}_{j}"),
                     F.count_if(ok & (F.abs(pred - r) / F.abs(r) <= REVENUE_RELATIVE_TOLERANCE)).alias(f"m{i}_{j}")]
    one = staged.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("ci"), F.lit(c).alias("column"), F.lit(j).alias("fi"),
                     F.lit(name).alias("formula"),
                     F.col(f"c{i}_{j}").alias("checked_rows"), F.col(f"m{i}_{j}").alias("matched_rows"))
            for i, c in enumerate(cols) for j, (name, _, _) in enumerate(forms)]
    long = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    ratio = F.when(F.col("checked_rows") > 0, F.col("matched_rows") / F.col("checked_rows")).otherwise(F.lit(0.0))
    long = long.withColumn("_ratio", ratio)
    w = Window.partitionBy("ci").orderBy(F.desc("_ratio"), F.desc("matched_rows"), F.desc("checked_rows"), "fi")
    return (long.withColumn("_rk", F.row_number().over(w))
                .select("column", "formula", "checked_rows", "matched_rows",
                        round_even(F.col("_ratio"), 6).alias("match_ratio"),
                        (F.col("_ratio") > REVENUE_FORMULA_VALID_RATIO).alias("is_valid"),
                        (F.col("_rk") == 1).alias("is_best")))


def _score_table(prof: DataFrame, formula: DataFrame | None) -> tuple[DataFrame, list]:
    """Profile rows (+ formula validity) and the (target, score, threshold)
    expressions of K1-K6."""
    if formula is not None:
        z = formula.where("is_best").select("column", F.col("is_valid").cast("int").alias("_z"))
        p = prof.join(F.broadcast(z), "column", "left")
    else:
        p = prof.withColumn("_z", F.lit(0))
    zc = F.coalesce(F.col("_z"), F.lit(0))
    revenue = ((1 - _has(REVENUE_BLOCK_KEYS)) * _type_is("numeric") * F.least(F.lit(1.0), F.greatest(
        _has(REVENUE_KEYS).cast("double"), zc.cast("double"),
        _has(REVENUE_TOTAL_KEYS) * 0.8 + _has(REVENUE_AMOUNT_KEYS) * 0.2 + F.col("has_currency").cast("int") * 0.2)))
    qe = (F.when(F.col("dominant_type") == "numeric", F.lit(1.0))
           .when(F.col("dominant_type") == "short_string", F.lit(0.5)).otherwise(F.lit(0.0)))
    exprs = [
        ("date", _has(DATE_NAME_KEYS) * 0.5 + _type_is("date") * 0.5, 0.5),
        ("product_name", (1 - _type_is("date", "numeric"))
         * (_has(PRODUCT_NAME_KEYS) * 0.7 + _has(PRODUCT_NAME_SECONDARY_KEYS) * 0.3), 0.3),
        ("quantity", (1 - _has(QUANTITY_BLOCK_KEYS)) * (1 - _type_is("date", "long_string"))
         * (F.least(F.lit(1.0), _has(QUANTITY_KEYS) + _has(QUANTITY_AMOUNT_KEYS) * 0.5) * 0.6 + qe * 0.4), 0.5),
        ("unit_price", (1 - _has(PRICE_BLOCK_KEYS)) * _type_is("numeric") * F.least(
            F.lit(1.0), _has(PRICE_KEYS) * 0.6 + _has(PRICE_UNIT_KEYS) * 0.4
            + F.col("has_currency").cast("int") * 0.2), 0.6),
        ("revenue", revenue, 0.8),
        ("discount", _has(DISCOUNT_KEYS) * _type_is("numeric", "short_string") * (1 - _has(DISCOUNT_BLOCK_KEYS)), 0.5),
    ]
    return p, exprs


def candidate_scores(prof: DataFrame, formula: DataFrame | None = None) -> DataFrame:
    """K9: all candidates ``(target, column, score, rank)``; rank by score
    desc, column position asc (stable like the reference's sort).

    All six targets are scored in one projection over the profile table
    (exploded to one row per column and target), so the profile is computed
    once, not once per target.
    """
    p, exprs = _score_table(prof, formula)
    scored = p.select("position", "column", F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), round_even(e.cast("double"), 4).alias("score"),
                 F.lit(th).alias("th")) for t, e, th in exprs])).alias("s")).select(
        "position", "column", "s.*").where(F.col("score") >= F.col("th"))
    w = Window.partitionBy("target").orderBy(F.desc("score"), F.asc("position"))
    return scored.withColumn("rank", F.row_number().over(w)).select("target", "column", "score", "rank")


def best_mapping(candidates: DataFrame) -> DataFrame:
    """K8: first candidate per target; targets without one get NULL (Q1)."""
    spark = candidates.sparkSession
    targets = spark.createDataFrame([(t,) for t in ("date", "product_name", "quantity", "unit_price",
                                                    "revenue", "discount")], "target string")
    best = candidates.where(F.col("rank") == 1).select("target", "column", "score")
    return targets.join(best, "target", "left")


def suggest_mapping(raw: DataFrame, prof: DataFrame) -> dict[str, str | None]:
    """Driver-side convenience: the best mapping as a dict (reads only the
    small candidate table; the K7 check is one aggregate over ``raw``)."""
    first = {r["target"]: r["column"] for r in
             candidate_scores(prof).where("rank = 1").collect()}
    formula = revenue_formula_checks(raw, first.get("quantity"), first.get("unit_price"),
                                     first.get("discount"))
    rows = best_mapping(candidate_scores(prof, formula)).collect()
    return {r["target"]: r["column"] for r in rows}
