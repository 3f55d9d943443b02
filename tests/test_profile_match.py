"""Profiling and column matching on literal header tables."""
from ledgerlark.operators import match as K
from ledgerlark.operators import profile as P

EN = ["Order Date", "Product Name", "Quantity", "Unit Price", "Total Amount", "Discount", "Order ID"]
TR = ["Satış Tarihi", "Ürün Adı", "Miktar", "Birim Fiyat", "Toplam Tutar", "İndirim", "Fatura No"]


def _table(spark, names):
    rows = []
    for i in range(12):
        q, p, d = i % 5 + 1, 10.0 + i, 0.1 if i % 2 else 0.0
        rows.append((f"{i % 28 + 1:02d}.0{i % 9 + 1}.2024", f"product {i}", str(q), f"{p:.2f}",
                     f"{q * p * (1 - d):.2f}", f"{d}", f"INV-{1000 + i}"))
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def _mapping(spark, names):
    raw = _table(spark, names)
    return K.suggest_mapping(raw, P.column_profile(raw, with_samples=False))


def test_mapping_english(spark):
    m = _mapping(spark, EN)
    assert m == {"date": "Order Date", "product_name": "Product Name", "quantity": "Quantity",
                 "unit_price": "Unit Price", "revenue": "Total Amount", "discount": "Discount"}


def test_mapping_turkish(spark):
    m = _mapping(spark, TR)
    assert m["date"] == "Satış Tarihi" and m["product_name"] == "Ürün Adı"
    assert m["quantity"] == "Miktar" and m["unit_price"] == "Birim Fiyat"
    assert m["revenue"] == "Toplam Tutar" and m["discount"] == "İndirim"


def test_profile_types(spark):
    prof = {r["column"]: r for r in P.column_profile(_table(spark, EN)).collect()}
    assert prof["Order Date"]["dominant_type"] == "date"
    assert prof["Quantity"]["dominant_type"] == "numeric"
    assert prof["Order ID"]["dominant_type"] == "short_string"
    assert len(prof["Product Name"]["sample_values"]) == 10
    assert prof["Unit Price"]["has_currency"] is False


def test_formula_check(spark):
    raw = spark.createDataFrame([(str(q), "10", str(q * 10 * 0.9), "10", "x") for q in range(1, 11)],
                                "q string, p string, rev string, d string, junk string")
    res = {(r["column"], r["formula"]): r for r in K.revenue_formula_checks(raw, "q", "p", "d").collect()}
    base = res[("rev", K.BASE_FORMULA)]
    disc = res[("rev", K.DISCOUNT_FORMULA)]
    assert not base["is_valid"] and disc["is_valid"] and disc["is_best"]
    assert res[("junk", K.BASE_FORMULA)]["checked_rows"] == 0


def test_single_pass_profile_plan(spark):
    plan = P.column_profile(_table(spark, EN), with_samples=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "PythonUDF" not in plan and "ArrowEval" not in plan


def test_samples_come_from_the_whole_table(spark):
    df = spark.createDataFrame([(None if i < 150 else f"v{i}", i) for i in range(300)], "late string, n int").coalesce(1)
    got = {r["column"]: r["sample_values"] for r in P.column_profile(df, sample_size=3).collect()}
    assert got == {"late": ["v150", "v151", "v152"], "n": ["0", "1", "2"]}


def test_mapping_problems(spark):
    from ledgerlark.operators import clean, match
    good = {"date": "d", "product_name": "p", "quantity": "q", "unit_price": "u", "revenue": "r"}
    assert clean.mapping_problems(good, list("dpqur")) == []
    assert clean.mapping_problems({**good, "revenue": "u"}, list("dpqur")) == []
    assert len(clean.mapping_problems({**good, "date": None, "unit_price": "q", "revenue": "zz"}, list("dpqur"))) == 3
    raw = spark.createDataFrame([("2", "3", str(7 * i)) for i in range(1, 9)], "q string, u string, r string")
    checks = match.revenue_formula_checks(raw, "q", "u")
    assert any("does not follow" in p for p in clean.mapping_problems(good, list("dpqur"), checks))
