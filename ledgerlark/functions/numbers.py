"""Number parsing column expressions (strict P5, lenient C4, fallback C5).

All of them are plain Catalyst expressions (regexp / replace / try_cast),
so they stay inside whole-stage codegen; no Python runs per row.
``try_cast`` alone is too lenient (``'12d'`` -> 12.0), so every cast is
guarded by a shape regex first (ANSI mode is on in Spark 4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CURRENCY_MARKERS
from .text import bind, clean_text, null_placeholders, strip_ws

# Shape accepted by Python's float() once only [0-9.-] are left.
_FLOAT_SHAPE = "^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$"


def round_even(c: Column, digits: int) -> Column:
    """``rint(x * 10^d) / 10^d``: numpy-style rounding, equal to DuckDB's
    ``round_even(x, d)`` (Spark's ``round`` is HALF_UP on the exact decimal
    expansion and differs on some values, H4)."""
    scale = float(10 ** digits)
    return F.rint(c * scale) / scale


def round2(c: Column) -> Column:
    """Round half to even at 2 decimals, like numpy ``round`` (H4)."""
    return round_even(c, 2)


def round6(c: Column) -> Column:
    return round_even(c, 6)


def _without(t: Column, mark: str) -> Column:
    return F.replace(t, F.lit(mark), F.lit(""))


def _shaped_double(t: Column) -> Column:
    """Cast text made of ``[0-9.-]`` only when it has float shape (one dot at
    most, a minus only in front, a digit): a failed cast costs an exception
    per value inside the JVM.  Byte-level checks, no regex."""
    dots = F.length(t) - F.length(_without(t, "."))
    minus_inside = F.instr(F.substring(t, 2, 1 << 30), "-") > 0
    has_digit = F.length(_without(_without(t, "."), "-")) > 0
    return F.when((dots <= 1) & ~minus_inside & has_digit, t.try_cast("double"))


def _decimal_mark(t: Column) -> Column:
    """Rightmost of ``,``/``.`` is the decimal mark; a lone comma is decimal.

    A comma with no dot after it is the decimal mark: drop dots, comma ->
    dot.  Otherwise commas are grouping marks and are dropped.
    """
    comma_last = (F.instr(t, ",") > 0) & (F.instr(F.substring_index(t, ",", -1), ".") == 0)
    return F.when(comma_last, F.replace(_without(t, "."), F.lit(","), F.lit("."))).otherwise(_without(t, ","))


def parse_number_strict(c: Column) -> Column:
    """P5: NULL if any letter remains after removing currency markers."""
    t = F.lower(strip_ws(c.cast("string")))
    for marker in CURRENCY_MARKERS:
        t = F.replace(t, F.lit(marker), F.lit(""))
    kept = F.regexp_replace(t, "[^0-9,.\\-]", "")
    return F.when(~t.rlike("[a-zA-Z]"), _shaped_double(_decimal_mark(kept)))


def with_strict_number(df: DataFrame, src: str, out: str) -> DataFrame:
    """P5 as staged projections (same result as :func:`parse_number_strict`).

    Each step is its own projection, so the text produced by one step is
    computed once even though the next step reads it several times
    (Catalyst does not share subexpressions across CASE branches).
    """
    p = f"_{out}"
    t = F.lower(strip_ws(F.col(src).cast("string")))
    for marker in CURRENCY_MARKERS:
        t = F.replace(t, F.lit(marker), F.lit(""))
    df = df.withColumn(f"{p}_t", t)
    df = df.withColumns({f"{p}_letters": F.col(f"{p}_t").rlike("[a-zA-Z]"),
                         f"{p}_kept": F.regexp_replace(F.col(f"{p}_t"), "[^0-9,.\\-]", "")})
    df = df.withColumn(f"{p}_dm", _decimal_mark(F.col(f"{p}_kept")))
    df = df.withColumn(out, F.when(~F.col(f"{p}_letters"), _shaped_double(F.col(f"{p}_dm"))))
    return df.drop(f"{p}_t", f"{p}_letters", f"{p}_kept", f"{p}_dm")


def normalize_numeric_text(c: Column) -> Column:
    """C4 text step: placeholders NULL, drop currency words and every other
    non ``[0-9,.-]`` character (letters are dropped, not rejected)."""
    kept = numeric_kept_text(null_placeholders(c))
    return F.when(F.length(F.translate(kept, ",.-", "")) > 0, _decimal_mark(kept))


def numeric_kept_text(cleaned: Column) -> Column:
    """C4 text step on already cleaned, placeholder-free text: keep only
    ``[0-9,.-]``.  (Removing the currency words first changes nothing: every
    letter is dropped here anyway.)  The digits are spelled out: a range in a
    regex class costs one more test per letter."""
    return F.regexp_replace(cleaned, "[^0123456789,.\\-]+", "")


def lenient_from_kept(kept: Column) -> Column:
    """C4 cast step on the output of :func:`numeric_kept_text`.

    The text holds only ``[0-9,.-]`` here, so ``try_cast`` accepts exactly
    what Python's float() accepts (no suffix letters, no blanks are left).
    """
    return _shaped_double(_decimal_mark(kept))


def parse_number_lenient(c: Column) -> Column:
    """C4: lenient parse; NULL when the normalized text is not a number."""
    return lenient_from_kept(numeric_kept_text(null_placeholders(c)))


def parse_number_fallback(c: Column) -> Column:
    """Price-text fallback for values C4 could not parse.

    First number token with the minus directly before it; thousands separators
    removed when the token has the grouping shape (``1.234.567``,
    ``-1,234,567``), else the decimal-mark rule, else comma -> dot.  A minus that
    follows a digit is a separator, and parentheses are no sign.
    """
    return fallback_from_clean(null_placeholders(c))


def fallback_from_clean(cleaned: Column) -> Column:
    """C5 on already cleaned, placeholder-free text; token and candidate are bound, not repeated (few rows come here)."""
    def candidate(token: Column) -> Column:
        grouped = token.rlike("^-?[0-9]{1,3}([.][0-9]{3})+$|^-?[0-9]{1,3}([,][0-9]{3})+$")
        return F.when(grouped, _without(_without(token, "."), ",")).otherwise(_decimal_mark(token))

    token = F.regexp_extract(cleaned, "((?<![0-9])-)?([0-9][0-9.,]*[0-9]|[0-9])", 0)
    return F.when(cleaned.isNotNull(), bind(bind(token, candidate), _shaped_double))


def clean_number(c: Column) -> Column:
    """C4 then C5 on the rows C4 failed on (``coalesce`` is lazy per row)."""
    cleaned = null_placeholders(c)
    return F.coalesce(lenient_from_kept(numeric_kept_text(cleaned)), fallback_from_clean(cleaned))


def normalize_discount(d: Column) -> Column:
    """Values in (1, 100] are percentages."""
    return F.when((d > 1) & (d <= 100), d / 100).otherwise(d)


def money_sum(c: Column) -> Column:
    """Exact sum of cent values: DECIMAL(38,2) accumulation, DOUBLE out.

    Double sums depend on the order rows arrive in; cents summed as decimals
    give the same answer on every partitioning (and in the SQL oracle).
    """
    return F.sum(c.cast("decimal(38,2)"))
