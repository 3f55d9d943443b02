"""Date column expressions: numeric tokens (C10), ordered parse (C12),
text-month dates (C13) and the date-like test used in profiling (P4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PLACEHOLDER_VALUES
from .text import bind

# Month names (Turkish and English, full and short) -> month number.
# Fixed values.
MONTH_NAMES = {
    1: ["ocak", "oca", "january", "jan"],
    2: ["şubat", "subat", "şub", "sub", "february", "feb"],
    3: ["mart", "mar", "march"],
    4: ["nisan", "nis", "april", "apr"],
    5: ["mayıs", "mayis", "may"],
    6: ["haziran", "haz", "june", "jun"],
    7: ["temmuz", "tem", "july", "jul"],
    8: ["ağustos", "agustos", "ağu", "agu", "august", "aug"],
    9: ["eylül", "eylul", "eyl", "september", "sept", "sep"],
    10: ["ekim", "eki", "october", "oct"],
    11: ["kasım", "kasim", "kas", "november", "nov"],
    12: ["aralık", "aralik", "ara", "december", "dec"],
}

# Shapes accepted by the lenient date-like test (P4): day-first numeric dates,
# year-first ISO-like dates (optionally with a time), and English month-name
# dates with a 4-digit year.
_DAY_FIRST = "^(\\d{1,2})[./-](\\d{1,2})[./-](\\d{4}|\\d{2})([ T]\\d{1,2}:\\d{2}(:\\d{2})?)?$"
_YEAR_FIRST = "^(\\d{4})[./-](\\d{1,2})[./-](\\d{1,2})([ T]\\d{1,2}:\\d{2}(:\\d{2}(\\.\\d+)?)?)?$"
_MONTH_WORDS = ("jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec")
_MONTH_NAME_DATE = ("(?i)^(\\d{1,2}\\s+(" + _MONTH_WORDS + ")[a-z]*\\.?,?\\s+\\d{4}"
                    "|(" + _MONTH_WORDS + ")[a-z]*\\.?\\s+\\d{1,2},?\\s+\\d{4})$")


def with_date_tokens(df: DataFrame, text_col: str, prefix: str = "_dt") -> DataFrame:
    """C10 as staged columns (``{prefix}_t1.._t3, _n1.._n3, _has, _yl,
    _left, _right``): later steps reference columns instead of repeating
    the regex tree, which keeps generated code small."""
    t = F.col(text_col)
    p = prefix
    # the first three digit runs by one regex pass; the text is already
    # cleaned, so the placeholder test is a set lookup
    df = df.withColumns({f"{p}_runs": F.regexp_extract_all(t, F.lit("(\\d+)"), 1),
                         f"{p}_ph": t.isNull() | F.lower(t).isin(*PLACEHOLDER_VALUES)})
    df = df.withColumns({f"{p}_t1": F.try_element_at(F.col(f"{p}_runs"), F.lit(1)),
                         f"{p}_t2": F.try_element_at(F.col(f"{p}_runs"), F.lit(2)),
                         f"{p}_t3": F.try_element_at(F.col(f"{p}_runs"), F.lit(3))})
    df = df.withColumns({f"{p}_n1": F.col(f"{p}_t1").try_cast("double"),
                         f"{p}_n2": F.col(f"{p}_t2").try_cast("double"),
                         f"{p}_n3": F.col(f"{p}_t3").try_cast("double")})
    has = ~F.col(f"{p}_ph") & F.col(f"{p}_t1").isNotNull() & F.col(f"{p}_t2").isNotNull()
    yl = F.col(f"{p}_t3").isNotNull() & ((F.length(f"{p}_t1") == 4) | (F.col(f"{p}_n1") > 31))
    df = df.withColumns({f"{p}_has": has, f"{p}_yl": yl})
    return df.withColumns({
        f"{p}_left": F.when(F.col(f"{p}_yl"), F.col(f"{p}_n2")).otherwise(F.col(f"{p}_n1")),
        f"{p}_right": F.when(F.col(f"{p}_yl"), F.col(f"{p}_n3")).otherwise(F.col(f"{p}_n2"))})


def staged_parse_date(text_col: str, order: Column, prefix: str = "_dt") -> Column:
    """C12 + C13 over the staged token columns of :func:`with_date_tokens`."""
    p = prefix
    t3, year_first = F.col(f"{p}_t3"), F.col(f"{p}_yl")  # without a third token nothing is read
    n1, n3 = F.col(f"{p}_n1"), F.col(f"{p}_n3")
    left, right, has = F.col(f"{p}_left"), F.col(f"{p}_right"), F.col(f"{p}_has")
    year = _normalize_year(F.when(year_first, n1).otherwise(n3))
    day = F.when(order == "day_month", left).otherwise(right)
    month = F.when(order == "day_month", right).otherwise(left)
    conflict = F.when(order == "day_month", right > 12).otherwise(left > 12)
    year_shape = (F.length(t3) <= 2) | (F.length(t3) == 4) | (n3 > 31) | year_first
    ok = order.isNotNull() & t3.isNotNull() & ~conflict & year_shape
    numeric = F.when(ok, _safe_date(year, month, day))
    text_date = F.when(~F.col(f"{p}_ph"), parse_text_date(F.col(text_col), order))
    return F.when(has, numeric).otherwise(text_date)


def _normalize_year(y: Column) -> Column:
    return F.when(y < 100, y + 2000).otherwise(y)


def _safe_date(year: Column, month: Column, day: Column) -> Column:
    """Calendar-checked date; NULL for Feb 30 etc. and outside 1678..2261.

    Counted from the first of the month (no text is formatted and parsed): a day the month lacks falls into the next.
    """
    ok = (year.between(1678, 2261) & month.between(1, 12) & day.between(1, 31))
    date = F.date_add(F.make_date(year.cast("int"), month.cast("int"), F.lit(1)), day.cast("int") - 1)
    return F.when(ok, F.when(F.month(date) == month.cast("int"), date))


def _month_map() -> Column:
    pairs = []
    for num, names in MONTH_NAMES.items():
        for name in names:
            pairs += [F.lit(name), F.lit(num)]
    return F.create_map(*pairs)


def _month_number(word: Column) -> Column:
    """Month number of a TR/EN month name (one map lookup, NULL if unknown)."""
    return F.try_element_at(_month_map(), word)


def parse_text_date(text: Column, order: Column) -> Column:
    """Month-name dates without two number groups (``Ocak 2024``,
    ``January-2024``, ``2024/Mart``) -> first of that month.

    Only used when a date order was detected (Q2) and the value does not
    have two numeric tokens (Q3).  A month without a year is not read: it would
    depend on the day of the run.
    """
    # "<yyyy> <month>" -> "<month> <yyyy>"; blanks, -, /, . and , part the two
    gap = "[\\s\\-/.,]+"
    norm = F.regexp_replace(F.lower(text), "^\\s*(\\d{4})" + gap + "(\\p{L}+)\\.?\\s*$", "$2 $1")
    shape = "^\\s*(\\p{L}+)" + gap + "(\\d{4})\\s*$"

    def first_of_month(norm: Column) -> Column:
        month = _month_number(F.regexp_extract(norm, shape, 1))
        year = F.nullif(F.regexp_extract(norm, shape, 2), F.lit("")).try_cast("int")
        return bind(year, lambda y: bind(month, lambda m: _safe_date(y, m, F.lit(1))))

    return F.when(order.isNotNull(), bind(norm, first_of_month))


def is_date_like(text: Column, numeric_value: Column) -> Column:
    """Not a number, has a digit, and reads as a date (day first).

    A regex picks the shape and rewrites it to ``y-M-d``; one calendar check
    (``try_to_date``) decides.  Day and month are swapped when only the swap
    is a valid date, as a lenient day-first parser does.  Parsing is only
    attempted on shape matches, so failures (exceptions) stay rare.
    """
    t = text
    day_first = F.coalesce(F.try_to_date(F.regexp_replace(t, _DAY_FIRST, "$3-$2-$1"), "y-M-d"),
                           F.try_to_date(F.regexp_replace(t, _DAY_FIRST, "$3-$1-$2"), "y-M-d"))
    year_first = F.try_to_date(F.regexp_replace(t, _YEAR_FIRST, "$1-$2-$3"), "y-M-d")
    shaped = (F.when(t.rlike(_DAY_FIRST), day_first.isNotNull())
               .when(t.rlike(_YEAR_FIRST), year_first.isNotNull())
               .otherwise(t.rlike(_MONTH_NAME_DATE)))
    return numeric_value.isNull() & t.rlike("\\d") & shaped
