"""Number, text and date column expressions (unit rows from FIXTURES §4)."""
import datetime as dt

from pyspark.sql import functions as F

from ledgerlark.functions.numbers import clean_number, parse_number_lenient, parse_number_strict, round2
from ledgerlark.functions import text
from ledgerlark.functions.text import clean_product_name, clean_text, normalize_name, null_placeholders
from ledgerlark.operators.clean import clean_sales
from ledgerlark.schema import PLACEHOLDER_VALUES

NUMBERS = [  # value, strict, lenient-with-fallback
    ("1.234,56", 1234.56, 1234.56), ("1,234.56", 1234.56, 1234.56), ("1,234", 1.234, 1.234),
    ("12 pcs", None, 12.0), ("1e5", None, 15.0), ("₺ 12,5 TL", 12.5, 12.5),
    ("1.234.567", None, 1234567.0), ("-5", -5.0, -5.0), ("12d", None, 12.0), ("abc", None, None),
    ("", None, None), ("n/a", None, None), (None, None, None),
]


def test_numbers(spark):
    df = spark.createDataFrame([(v,) for v, _, _ in NUMBERS], "v string")
    got = df.select(parse_number_strict(F.col("v")).alias("s"), clean_number(F.col("v")).alias("l")).collect()
    for (v, strict, lenient), row in zip(NUMBERS, got):
        assert row["s"] == strict, v
        assert row["l"] == lenient, v


def test_lenient_without_fallback(spark):
    df = spark.createDataFrame([("1.234.567",), ("1,234,567",)], "v string")
    assert [r[0] for r in df.select(parse_number_lenient(F.col("v"))).collect()] == [None, None]


def test_round2_half_even(spark):
    df = spark.createDataFrame([(0.125,), (1.015,), (2.675,)], "x double")
    assert [r[0] for r in df.select(round2(F.col("x"))).collect()] == [0.12, 1.01, 2.68]


def test_text(spark):
    rows = [("  a  \t b ", "a b"), ("Ã§ay", "çay"), ("日本Ã", "日本Ã"), ("Ãx", "Ãx")]
    df = spark.createDataFrame(rows, "v string, e string")
    for r in df.select(clean_text(F.col("v")).alias("c"), "e").collect():
        assert r["c"] == r["e"]
    ph = spark.createDataFrame([(v,) for v in ["-", "??", "N/A", "boş", "bilinmiyor", " Unknown ", "x"]], "v string")
    assert [r[0] for r in ph.select(null_placeholders(F.col("v"))).collect()] == [None] * 6 + ["x"]
    pn = spark.createDataFrame([("  ÇAY   Bardağı ",)], "v string")
    assert pn.select(clean_product_name(F.col("v"))).first()[0] == "çay bardağı"


def test_normalize_name(spark):
    names = {"Satış Tarihi": "satis tarihi", "Ürün Adı": "urun adi", "İndirim": "indirim",
             "Unit-Price ($)": "unit price", "Order_ID": "order id"}
    df = spark.createDataFrame([(k,) for k in names], "v string")
    got = [r[0] for r in df.select(normalize_name(F.col("v"))).collect()]
    assert got == list(names.values())


def _clean_dates(spark, values, order=None):
    df = spark.createDataFrame([(v, "p", "1", "1", "1") for v in values],
                               "date string, product_name string, quantity string, unit_price string, revenue string")
    res = clean_sales(df, date_order=order)
    return res.date_order.first(), [r["date"] for r in res.wide.orderBy("row_id").select("row_id", "date").collect()]


def test_dates_day_month(spark):
    info, got = _clean_dates(spark, ["13.01.2024", "05.02.2024", "30.02.2024", "05.01.24", "14.14.2024"])
    assert info["status"] == "inferred" and info["date_order"] == "day_month"
    assert got == [dt.date(2024, 1, 13), dt.date(2024, 2, 5), None, dt.date(2024, 1, 5), None]
    assert info["both_over_12"] == 1


def test_dates_month_day_and_iso(spark):
    info, got = _clean_dates(spark, ["01/13/2024", "02/05/2024", "2024-02-15"])
    assert info["date_order"] == "month_day"
    assert got == [dt.date(2024, 1, 13), dt.date(2024, 2, 5), dt.date(2024, 2, 15)]


def test_dates_ambiguous_all_null(spark):
    info, got = _clean_dates(spark, ["01.02.2024", "03.04.2024"])
    assert info["status"] == "undecidable_no_evidence" and got == [None, None]


def test_dates_mixed_evidence(spark):
    values = ["13.01.2024"] * 98 + ["01.13.2024"] * 2
    info, got = _clean_dates(spark, values)
    assert info["status"] == "undecidable_mixed_evidence" and all(g is None for g in got)
    values = ["13.01.2024"] * 99 + ["01.13.2024"]
    info, got = _clean_dates(spark, values)
    assert info["status"] == "inferred" and info["invalid"] == 1
    assert got.count(None) == 1


def test_text_dates(spark):
    info, got = _clean_dates(spark, ["13.01.2024", "Ocak 2024", "January 2024", "15 Mayıs 2024"],
                             order="day_month")
    assert got == [dt.date(2024, 1, 13), dt.date(2024, 1, 1), dt.date(2024, 1, 1), None]


def test_fallback_keeps_the_sign(spark):
    cases = {"-1.234.567": -1234567.0, "-1,234,567 TL": -1234567.0, "1.234.567": 1234567.0, "(1.234,50)": 1234.5,
             "5-1.234.567": 5.0}
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    assert [r[0] for r in df.select(clean_number(F.col("v"))).collect()] == list(cases.values())


def test_month_name_dates(spark):
    from ledgerlark.functions.dates import parse_text_date
    cases = {"Ocak 2024": dt.date(2024, 1, 1), "Mart-2024": dt.date(2024, 3, 1), "Ocak/2024": dt.date(2024, 1, 1),
             "2024.Mart": dt.date(2024, 3, 1), "Sept. 2021": dt.date(2021, 9, 1), "15 Mart": None, "Foo 2024": None}
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    assert [r[0] for r in df.select(parse_text_date(F.col("v"), F.lit("day_month"))).collect()] == list(cases.values())


def test_repair_of_text_read_as_windows(spark):
    def shown(text, codec):
        return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in text.encode())

    whole = ["çay", "şeker", "ağaç", "Şişe İğne ÖÜ", "it’s “quoted” – €5", "日本 é", "plain", "ÀÁÂÃÄÅ"]
    bad = [shown(t, codec) for t in whole for codec in ("latin-1", "cp1252", "cp1254")]
    bad += [shown(shown(t, codec), codec) for t in whole[:6] for codec in ("cp1252", "cp1254")]
    want = [t for t in whole for _ in range(3)] + [t for t in whole[:6] for _ in range(2)]
    kept = ["Ãx", "çay Ã§ay", "日本Ã", "Ä", "â€", "naïve Â", None, ""]  # no valid bytes: left alone
    rows = [(i, t) for i, t in enumerate(bad + kept)]
    got = [r["x"] for r in spark.createDataFrame(rows, "i int, t string").orderBy("i")
           .select(text.fix_mojibake(F.col("t")).alias("x")).collect()]
    assert got == want + kept


def test_every_whitespace_and_short_months(spark):
    rows = [(f"{ws}ürün{ws} {ws}a{ws}b ",) for ws in text.WHITESPACE] + [("plain",), ("ş" + "　" * 3 + "x",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(clean_text(F.col("v"))).collect()]
    assert got == [None if v is None else " ".join(v.split()) for (v,) in rows]
    days = [f"{day}.{month}.{year}" for year in (2023, 2024, 1900, 2000, 1677, 2262) for month in (0, 1, 2, 4, 12, 13) for day in (0, 1, 28, 29, 30, 31, 32)]

    def read(value):
        day, month, year = map(int, value.split("."))
        try:
            return dt.date(year, month, day) if 1678 <= year <= 2261 else None
        except ValueError:
            return None

    std = spark.createDataFrame([(v, "a", "1", "1", "1") for v in days],
                                "date string, product_name string, quantity string, unit_price string, revenue string")
    found = clean_sales(std, date_order="day_month").wide.select("raw_date", "date").collect()
    assert {r["raw_date"]: r["date"] for r in found} == {v: read(v) for v in days}


def test_numbers_of_damaged_and_placeholder_texts(spark):
    """Columns are cleaned as the one-value parser cleans: C4 on the source text changes nothing."""
    assert not any(ch.isdigit() for value in PLACEHOLDER_VALUES for ch in value)
    values = [*PLACEHOLDER_VALUES, *[v for v, _, _ in NUMBERS], "â‚º1.250,5", "Ã§ 12", "1 250,5", " 7\t", "1.234.567 â€“", "-1,234,567", "5-3", "--4",
              "1.2.3", "٣", "12\u3000000", "(5)", "\u00a0", "%10", "1e5", "-"]
    std = spark.createDataFrame([("01.01.2024", "a", v, v, v, v) for v in values],
                                "date string, product_name string, quantity string, unit_price string, revenue string, discount string")
    parsed = std.select("quantity", clean_number(F.col("quantity")).alias("x")).collect()
    wide = clean_sales(std).wide.select("raw_quantity", *[f"_{t}_num" for t in ("quantity", "unit_price", "revenue", "discount")]).collect()
    assert [(r[0], *r[1:]) for r in wide] == [(r["quantity"], *[r["x"]] * 4) for r in parsed]
