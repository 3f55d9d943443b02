"""Standard sales schema and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

TARGET_FIELDS = ["date", "product_name", "quantity", "unit_price", "revenue"]

SALES_SCHEMA = T.StructType([
    T.StructField("date", T.DateType(), True),
    T.StructField("product_name", T.StringType(), True),
    T.StructField("quantity", T.DoubleType(), True),
    T.StructField("unit_price", T.DoubleType(), True),
    T.StructField("revenue", T.DoubleType(), True),
])

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results).
# ---------------------------------------------------------------------------

# Currency markers, in the order they are stripped by the strict number parser.
CURRENCY_MARKERS = ["₺", "tl", "try", "$", "usd", "€", "eur"]
# Markers removed by the lenient cleaner (one regex alternation).
LENIENT_CURRENCY_PATTERN = "(try|tl|usd|eur)"

# Text that means "missing" after trim / lower / whitespace collapse.
PLACEHOLDER_VALUES = [
    "", "-", "--", "---", "?", "??", "unknown", "null", "none", "nan", "na",
    "n/a", "not available", "not applicable", "missing", "undefined", "empty",
    "blank", "yok", "bilinmiyor", "bilinmeyen", "bos", "boş",
]

DATE_ORDER_CONFIDENCE_THRESHOLD = 0.99
REVENUE_ABSOLUTE_TOLERANCE = 0.05      # cleaning-time mismatch check
REVENUE_RELATIVE_TOLERANCE = 0.05      # mapping-time formula check
REVENUE_FORMULA_VALID_RATIO = 0.5

# Column-name keywords used by the field scorers.
DATE_NAME_KEYS = ["date", "tarih"]
PRODUCT_NAME_KEYS = ["product", "item", "urun", "description"]
PRODUCT_NAME_SECONDARY_KEYS = ["name", "isim", "ismi", "detail"]
QUANTITY_KEYS = ["quantity", "qty", "adet", "miktar", "units"]
QUANTITY_AMOUNT_KEYS = ["amount"]
QUANTITY_BLOCK_KEYS = ["price", "fiyat", "spent", "cost", "revenue", "total", "toplam"]
PRICE_KEYS = ["price", "fiyat"]
PRICE_UNIT_KEYS = ["unit", "birim"]
PRICE_BLOCK_KEYS = ["total", "toplam", "quantity", "qty", "adet", "miktar"]
REVENUE_KEYS = ["revenue"]
REVENUE_TOTAL_KEYS = ["total", "toplam"]
REVENUE_AMOUNT_KEYS = ["amount"]
REVENUE_BLOCK_KEYS = ["unit", "birim", "quantity", "qty", "adet", "miktar"]
DISCOUNT_KEYS = ["discount", "disc", "indirim"]
DISCOUNT_BLOCK_KEYS = ["price", "fiyat", "revenue", "total", "toplam", "quantity", "qty", "adet"]

# Column-name letter folding (Turkish letters first, then accents).
NAME_FOLD_FROM = "çğıöşü"
NAME_FOLD_TO = "cgiosu"

# Extra-column role inference.
IDENTIFIER_KEYWORDS = ["id", "row", "no", "number", "code", "postal", "zip",
                       "address", "phone", "email"]
NUMERIC_MEASUREMENT_KEYWORDS = ["profit", "cost", "price", "amount", "shipping",
                                "ship", "sales", "tax", "margin", "discount",
                                "disc", "indirim", "fee", "total", "weight",
                                "quantity", "qty"]
IDENTIFIER_ENDINGS = ["id", "no", "code"]
IDENTIFIER_PHRASES = ["e mail", "phone number"]
STRONG_DATE_WORDS = ["date", "time", "delivery", "delivered"]
MONTH_ABBREVIATIONS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug",
                       "sep", "oct", "nov", "dec"]
HIGH_CARDINALITY_UNIQUE_LIMIT = 100
HIGH_CARDINALITY_RATIO_LIMIT = 0.5
PROFILE_MIN_NON_MISSING_RATIO = 0.2
# Rules for the role of an extra column, in order: rule, role, reason (fixed values).
EXTRA_COLUMN_RULES = [
    ("constant", "excluded", "constant column"),
    ("sparse", "excluded", "too many missing values"),
    ("discount", "numeric_measurement", "selected discount column"),
    ("identifier_high", "identifier", "identifier keyword with high cardinality"),
    ("identifier_numeric", "identifier", "numeric identifier-like column"),
    ("date", "secondary_date", "parseable secondary date"),
    ("measurement", "numeric_measurement", "numeric measurement profile"),
    ("moderate", "numeric_measurement", "numeric profile with moderate cardinality"),
    ("other_numeric", "excluded", "numeric column does not look like a measurement"),
    ("name", "identifier", "name-like high-cardinality column"),
    ("high", "excluded", "high-cardinality categorical column"),
    ("category", "categorical_summary", "categorical summary profile"),
]

# Forecast.
PRIORITY_FEATURES = ["year", "month", "quarter", "week_of_year",
                     "revenue_lag_1", "revenue_lag_2", "revenue_lag_4",
                     "rolling_revenue_4", "rolling_revenue_8",
                     "quantity_lag_1", "rolling_quantity_4"]
FORECAST_MAX_HORIZON = 12
FORECAST_DISPLAY_HORIZONS = [1, 2, 4, 8, 12]
FORECAST_SCENARIO_ADJUSTMENT_CAP = 0.30
FORECAST_TREND_THRESHOLD = 0.05
MIN_USABLE_WEEKS = 10
TRAIN_FRACTION = 0.80

# Pareto classes by cumulative share before the row.
ABC_A_LIMIT = 0.80
ABC_B_LIMIT = 0.95

IQR_DEFAULT_MULTIPLIER = 2.5
IQR_MULTIPLIER_CHOICES = [1.5, 2.0, 2.5, 3.0]
