"""E1 + E2 end to end: messy CSV -> profile -> mapping -> clean -> KPIs."""
import json
import os
import re
import tempfile

from pyspark.sql import functions as F

from ledgerlark.operators import analysis, clean, match, profile
from ledgerlark.sources.csv import read_csv
from ledgerlark.sources.tables import DIRTY_MAPPING, dirty_sales

from .conftest import SF_SMALL


def test_csv_to_kpis(spark):
    d = tempfile.mkdtemp(prefix="ll-e2e-", dir="/tmp")
    src = dirty_sales(spark, SF_SMALL)
    cols = [DIRTY_MAPPING[k] for k in ("date", "product_name", "quantity", "unit_price", "revenue", "discount")]
    src.select(*cols, "h").write.option("header", True).option("encoding", "UTF-8").csv(d + "/in")
    raw = read_csv(spark, d + "/in")
    assert raw.count() == src.count()
    prof = profile.column_profile(raw.drop("h"))
    mapping = match.suggest_mapping(raw.drop("h"), prof)
    assert mapping == DIRTY_MAPPING
    clean.check_mapping(mapping, raw.columns)
    res = clean.clean_sales(clean.standardize(raw, mapping))
    assert res.schema_check() == []
    assert res.date_order.first()["date_order"] == "day_month"
    report = {r["column_name"]: r for r in res.column_report().collect()}
    n = report["date"]["total_rows"]
    for r in report.values():
        assert r["converted"] + r["cleaned_missing"] == n
    assert report["date"]["cleaned_missing"] == 0
    k = analysis.kpi_summary(res.cleaned).first()
    truth = src.agg(F.count(F.lit(1)).alias("n")).first()
    assert k["row_count"] == truth["n"]
    out = os.path.join(d, "report")
    from ledgerlark.sources.sinks import write_report
    write_report(res.report_json(), out)
    assert any(f.startswith("part-") for f in os.listdir(out))


def _scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation ")


def test_report_in_two_passes(spark):
    d = tempfile.mkdtemp(prefix="ll-report-", dir="/tmp")
    rows = []
    for i in range(4000):
        day = ["%02d.%02d.2024" % (i % 28 + 1, i % 12 + 1), "13.14.2024", "03.25.2024", None, "n/a", "Ocak 2024"][
            0 if i % 7 else min(i // 7 % 40, 5)]
        rows.append((day, f"Item {i % 50}" if i % 11 else "-", str(i % 9 - 2) if i % 13 else "x", "2,50",
                     str((i % 9 - 2) * 2.5) if i % 5 else ("n/a" if i % 3 else "99"), "0.1" if i % 4 else None))
    src = spark.createDataFrame(rows, "date string, product_name string, quantity string, unit_price string, "
                                      "revenue string, discount string").repartition(6)
    src.write.parquet(d + "/raw")
    raw = spark.read.parquet(d + "/raw")
    for given, columns in ((None, raw.columns), ("month_day", raw.columns[:-1])):
        res = clean.clean_sales(raw.select(*columns), date_order=given)
        frame = res.report_json()
        assert _scans(frame) == 1  # and one for the sums
        got = json.loads(frame.first()["report"])
        plain = lambda df: [{k: v for k, v in r.asDict(True).items() if v is not None} for r in df.collect()]
        assert got["columns"] == sorted(plain(res.column_report()), key=lambda r: r["position"])
        assert got["revenue_mismatch"] == plain(res.revenue_mismatch())
        assert got["date_format_detection"] == plain(res.date_order)[0]
        key = lambda r: (r["kind"], r["column_name"], r["rank"])
        assert sorted(got["examples"], key=key) == sorted(plain(res.examples()), key=key)
        assert got["date_issues"] == plain(res.date_issues())
        types = {r["column_name"]: r for r in plain(res.column_types())}
        assert {r["column_name"]: r for r in got["types"]} == types
    empty = json.loads(clean.clean_sales(raw.limit(0)).report_json().first()["report"])
    assert empty["examples"] == [] and empty["date_issues"] == [] and empty["columns"][0]["total_rows"] == 0


def _largest_method(spark, df):
    """Bytes of the largest generated method; the JVM never compiles one of more than 8,000."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its stages are generated only as they run
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        code = debug.codegenString(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code))


def test_examples_in_two_passes_of_compiled_code(spark):
    d = tempfile.mkdtemp(prefix="ll-examples-", dir="/tmp")
    day = ["%02d.02.2024", "%02d/2/24", "2024-%02d-02", " %02d - 02 - 2024 "]
    rows = [(i, day[i % 4] % (i % 31 + 1), f"Item  {i % 7}" if i % 9 else "yok", f"{i % 13 - 1} adet" if i % 5 else "n/a",
             ["₺2,50", "1.234.567", "-", "x 3"][i % 4], "n/a" if i % 3 == 0 else "5", "%10") for i in range(900)]
    spark.createDataFrame(rows + rows[:300], "at long, date string, product_name string, quantity string, unit_price string, "
                          "revenue string, discount string").repartition(5).write.parquet(d + "/raw")
    res = clean.clean_sales(spark.read.parquet(d + "/raw"), row_id="at")
    frame = res.examples()
    assert _scans(frame) == 2
    assert _largest_method(spark, frame) < 8000
    assert _largest_method(spark, res.cleaned) < 8000
    got = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        got.setdefault((r["kind"], r["column_name"]), []).append((r["row_id"], r["value"]))
    twice = sorted(rows + rows[:300])
    prices = {"₺2,50": 2.5, "1.234.567": 1234567.0, "x 3": 3.0}

    def first(n, column, when):
        return [(r[0], r[column]) for r in twice if when(r)][:n]

    assert got[("failed", "date")] == first(10, 1, lambda r: r[0] % 31 + 1 > 29)  # no such day in this February
    assert got[("failed", "product_name")] == first(10, 2, lambda r: r[2] == "yok")
    assert got[("failed", "quantity")] == first(10, 3, lambda r: r[3] == "n/a" or r[0] % 13 - 1 <= 0)
    assert got[("failed", "unit_price")] == first(10, 4, lambda r: r[4] not in prices)
    assert got[("business_error", "quantity")] == first(10, 3, lambda r: r[3] != "n/a" and r[0] % 13 - 1 <= 0)
    filled = first(10, 5, lambda r: r[5] == "n/a" and r[3] != "n/a" and r[0] % 13 > 1 and r[4] in prices)
    assert got[("filled", "revenue")] == filled
