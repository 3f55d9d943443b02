"""CSV encodings, sinks, streaming daily sums."""
import datetime as dt
import gzip
import os
import random
import tempfile

from pyspark.sql import functions as F

from ledgerlark.sources.csv import detect_encodings, ends_open, file_layouts, read_csv
from ledgerlark.sources.sinks import write_table
from ledgerlark.streaming.daily import daily_sales_stream

TEXT = "Ürün Adı,Miktar\nçay,3\nşeker,bilinmiyor\nkahve,NA\n"


def test_encodings(spark):
    d = tempfile.mkdtemp(prefix="ll-enc-", dir="/tmp")
    files = {"utf8.csv": TEXT.encode("utf-8"), "bom.csv": TEXT.encode("utf-8-sig"),
             "tr.csv": TEXT.encode("cp1254"), "latin.csv": TEXT.replace("ş", "s").encode("cp1254") + b"x,\x81\n"}
    for name, data in files.items():
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(data)
    enc = {os.path.basename(r["file_path"]): r["encoding"] for r in detect_encodings(spark, d).collect()}
    assert enc == {"utf8.csv": "UTF-8", "bom.csv": "UTF-8", "tr.csv": "windows-1254", "latin.csv": "ISO-8859-1"}
    df = read_csv(spark, [os.path.join(d, f) for f in ("utf8.csv", "bom.csv", "tr.csv")])
    assert df.columns == ["Ürün Adı", "Miktar"]
    rows = df.collect()
    assert sorted({r["Ürün Adı"] for r in rows}) == ["kahve", "çay", "şeker"]
    assert sum(r["Miktar"] is None for r in rows) == 3  # NA token -> NULL


def test_parquet_sink_partitioned(spark):
    d = tempfile.mkdtemp(prefix="ll-sink-", dir="/tmp")
    df = spark.createDataFrame([(dt.date(2024, 1, 5), 1.0), (dt.date(2024, 2, 5), 2.0)], "date date, revenue double")
    write_table(df, d + "/t", partition_by_month=True)
    back = spark.read.parquet(d + "/t").where(F.col("month") == "2024-02")
    assert back.count() == 1


def test_streaming_daily(spark):
    d = tempfile.mkdtemp(prefix="ll-stream-", dir="/tmp")
    src = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 1.0, 2.0, 2.0), (dt.date(2024, 1, 1), "b", 1.0, 3.0, 3.0),
                                 (dt.date(2024, 1, 2), "a", 2.0, 2.0, 4.0)],
                                "date date, product_name string, quantity double, unit_price double, revenue double")
    src.write.parquet(d + "/in")
    stream = spark.readStream.schema(src.schema).parquet(d + "/in")
    q = (daily_sales_stream(stream).writeStream.outputMode("complete").format("memory")
         .queryName("ll_daily").start())
    q.processAllAvailable()
    q.stop()
    got = {r["date"]: r["revenue"] for r in spark.sql("select * from ll_daily").collect()}
    assert got == {dt.date(2024, 1, 1): 5.0, dt.date(2024, 1, 2): 4.0}


def _write(folder, **files):
    for name, data in files.items():
        with open(os.path.join(folder, name + ".csv"), "wb") as fh:
            fh.write(data)


def test_csv_quotes_and_line_ends(spark):
    d = tempfile.mkdtemp(prefix="ll-quote-", dir="/tmp")
    _write(d, a=b'product,note\n"tea, black","say ""hi"", ok"\n"line1\nline2",x\n,"NA"\n')
    rows = {tuple(r) for r in read_csv(spark, d).collect()}
    assert rows == {("tea, black", 'say "hi", ok'), ("line1\nline2", "x"), (None, None)}


def test_csv_columns_by_name_over_encodings(spark):
    d = tempfile.mkdtemp(prefix="ll-order-", dir="/tmp")
    _write(d, a="date,ürün,qty\n2024-01-01,çay,1\n".encode(), b="ürün,qty,date\nşeker,2,2024-01-02\n".encode("cp1254"),
           c="﻿date,ürün\r\n2024-01-03,kahve\r\n".encode(), d=b"date,qty\n")
    df = read_csv(spark, d)
    assert sorted(df.columns) == ["date", "qty", "ürün"]
    assert {(r["date"], r["ürün"], r["qty"]) for r in df.collect()} == {
        ("2024-01-01", "çay", "1"), ("2024-01-02", "şeker", "2"), ("2024-01-03", "kahve", None)}
    single = read_csv(spark, os.path.join(d, "a.csv"), multiline=False)
    assert single.count() == 1 and single.first()["ürün"] == "çay"


def _messy_csv(seed, n):
    """Records with quoted line ends, doubled, misplaced and trailing quotes, blank lines and short rows."""
    rng = random.Random(seed)
    cells = ["", "x", "7,5", "çay", "a\nb", "\n\n", 'say ""hi""', "c,d\n,e", "\r\nf"]
    out = ["id,note,more\n"]
    for i in range(n):
        row = [str(i)]
        for _ in range(2):
            cell = rng.choice(cells)
            row.append('"' + cell + '"' if set(cell) & set(',\n"') or rng.random() < 0.3 else cell)
        if rng.random() < 0.1:
            row[1] = '5" pipe'
        if rng.random() < 0.1:
            row[2] = '"shut" tail "'
        if rng.random() < 0.05:
            row.pop()
        out.append(",".join(row) + rng.choice(["\n", "\n", "\r\n", "\n\n"]))
    return "".join(out)


def test_csv_ranges_equal_one_task(spark):
    d = tempfile.mkdtemp(prefix="ll-range-", dir="/tmp")
    text = _messy_csv(5, 120)
    _write(d, a=text.encode())
    one = [tuple(r) for r in read_csv(spark, d, with_nulls=False).collect()]
    assert [r[0] for r in one] == [str(i) for i in range(120)]
    plain = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
             .option("lineSep", "\n").csv(d).collect())
    assert [tuple(None if v in (None, "\r") else v.removesuffix("\r") for v in r) for r in plain] == one
    for size in (130, 701):
        cut = read_csv(spark, d, with_nulls=False, range_bytes=size)
        assert cut.rdd.getNumPartitions() >= -(-os.path.getsize(d + "/a.csv") // size)
        assert sorted(map(repr, map(tuple, cut.collect()))) == sorted(map(repr, one))
    starts = file_layouts(spark, d, range_bytes=130).where("inside").count()
    assert starts > 3  # ranges that start inside a quoted field were met


def test_csv_field_over_many_ranges_and_unclosed(spark):
    d = tempfile.mkdtemp(prefix="ll-long-", dir="/tmp")
    long = "\n".join(f"l{i}" for i in range(200))
    _write(d, a=f'k,v\n1,"{long}"\n2,z\n3,"open\n4,w\n'.encode())
    for size in (90, 1 << 20):
        got = {r["k"]: r["v"] for r in read_csv(spark, d, range_bytes=size).collect()}
        assert got["1"] == long and got["2"] == "z" and set(got) == {"1", "2", "3"}
    lines = {r["k"]: r["v"] for r in read_csv(spark, d, multiline=False).collect()}
    assert lines["2"] == "z" and lines["4"] == "w"


def test_ends_open():
    for line, inside, want in [(b"a,b", False, False), (b"a,b", True, True), (b'"a', False, True), (b'5" x,"b', False, True),
                               (b'"a""', False, True), (b'"a"",b",c', False, False), (b'x"', True, False),
                               (b'x",y,"z', True, True), (b'"a"x"', False, False), (b"", True, True), (b'"","', False, True)]:
        assert ends_open(line, b",", inside) == want, line


def test_csv_compressed_empty_and_headers(spark):
    d = tempfile.mkdtemp(prefix="ll-gz-", dir="/tmp")
    with gzip.open(d + "/a.csv.gz", "wb") as fh:
        fh.write(b'k,,k\n1,2,"3\n4"\n')
    _write(d, b=b"", c=b"\n\nK9,Other\n\n", e=b"OTHER,k0\n5,6\n")
    df = read_csv(spark, d, range_bytes=20)
    assert df.columns == ["k0", "_c1", "k2", "K9", "Other"]
    assert {tuple(r) for r in df.collect()} == {("1", "2", "3\n4", None, None), ("6", None, None, None, "5")}


def test_many_files_share_tasks(spark):
    d = tempfile.mkdtemp(prefix="ll-many-", dir="/tmp")
    _write(d, **{f"f{i}": f"a,h{i % 7}\n{i},{i}\n".encode() for i in range(60)})
    df = read_csv(spark, d)
    assert df.count() == 60 and sorted(df.columns) == ["a"] + [f"h{i}" for i in range(7)]
    assert df.rdd.getNumPartitions() <= 4
