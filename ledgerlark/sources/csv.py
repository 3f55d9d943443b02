"""Raw CSV sources (S1-S4): header CSV read all-text, per-file encoding
choice, pandas-style null tokens.

A file is read by byte ranges, also where quoted fields hold line ends.  A line
either starts a record or lies inside a quoted field, so every range maps these two
states to the state behind its last line.  One pass gives that map, whether
the bytes are UTF-8, and the header; a prefix over the maps of a file's ranges (a
window over one row per range) tells each range how it starts.  The second pass
cuts records: a range owns those that start in it and reads on to the end of the last.

Files, ranges, encodings and headers are rows of a table, never a list on the
driver; only the column names and the number of tasks are read there.
"""

from __future__ import annotations

import csv
import io
import urllib.parse
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import keep_table

# pandas' default missing-value strings (fixed values).
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

ENCODING_ORDER = ["UTF-8", "windows-1254", "ISO-8859-1"]
_UNDEFINED_1254 = "^(..)*(81|8D|8E|8F|90|9D|9E)"
_UNDEFINED_BYTES = bytes.fromhex("818D8E8F909D9E")
_BOM, _QUOTE = b"\xef\xbb\xbf", b'"'

#: Bytes of a range, bytes that opening a file counts as, and bytes of a batch of records.
RANGE_BYTES, OPEN_BYTES, BATCH_BYTES = 64 << 20, 4 << 20, 8 << 20
_COMPRESSED = r"\.(gz|bz2|zst|lz4)$"


def detect_encodings(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Per file: ``(file_path, encoding)`` from one pass over the raw bytes."""
    lines = spark.read.format("text").option("wholetext", "false").load(paths) \
        .select(F.col("_metadata.file_path").alias("file_path"), F.col("value").cast("binary").alias("b"))
    per_file = lines.groupBy("file_path").agg(
        F.bool_and(F.is_valid_utf8(F.col("b"))).alias("utf8"),
        F.bool_or(F.hex("b").rlike(_UNDEFINED_1254)).alias("undefined_1254"))
    return per_file.select("file_path", _encoding().alias("encoding"))


def _encoding() -> Column:
    return (F.when(F.col("utf8"), F.lit("UTF-8"))
             .when(F.col("undefined_1254"), F.lit("ISO-8859-1"))
             .otherwise(F.lit("windows-1254")))


def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """S3: cells equal to a null token become NULL (one projection)."""
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) for c in df.columns])


def ends_open(line: bytes, sep: bytes, inside: bool) -> bool:
    """Whether a quoted field is open behind ``line``, which starts inside one or starts a record.

    A quote opens a field only as its first character; a doubled one is part of the field, and
    behind the closing one anything up to the separator is.
    """
    at = 0
    while True:
        if not inside and line[at:at + 1] != _QUOTE:
            at = line.find(sep, at)
        else:
            at = line.find(_QUOTE, at if inside else at + 1)
            while at >= 0 and line[at + 1:at + 2] == _QUOTE:
                at = line.find(_QUOTE, at + 2)
            if at < 0:
                return True
            inside = False
            at = line.find(sep, at + 1)
        if at < 0:
            return False
        at += len(sep)


def _open(path: str):
    if path.startswith("file:"):
        system, name = fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    else:
        system, name = fs.FileSystem.from_uri(urllib.parse.quote(path, safe=":/@?=&%~+"))
    if path.endswith((".gz", ".bz2", ".zst", ".lz4")):
        return system.open_input_stream(name, compression="detect")
    return system.open_input_file(name)


def _lines(path: str, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its ``\\n``) from the first line that starts at ``start`` or later."""
    with _open(path) as raw, io.BufferedReader(raw, 1 << 20) as stream:
        at = start
        if start:
            raw.seek(start - 1)
            at += len(stream.readline()) - 1
        for line in stream:
            body = line[:-1] if line.endswith(b"\n") else line
            yield at, (body[len(_BOM):] if at == 0 and body.startswith(_BOM) else body)
            at += len(line)


def _records(path: str, start: int, end: int, inside: bool, sep: bytes, multiline: bool) -> Iterator[bytes]:
    """The records that start in the range; blank lines between records are none."""
    held: list[bytes] = []
    for at, line in _lines(path, start):
        if at >= end and not held:
            return
        skipping = inside and not held
        if not skipping and not held and line in (b"", b"\r"):
            continue
        inside = multiline and (ends_open(line, sep, inside) if _QUOTE in line else inside)
        if skipping:
            continue
        held.append(line)
        if not inside:
            yield b"\n".join(held).removesuffix(b"\r")
            held = []
    if held:
        yield b"\n".join(held).removesuffix(b"\r")


def _names(record: str, sep: str) -> list[str]:
    """Header names as Spark gives them: ``_c<i>`` for an empty one, its position behind a repeated one."""
    cells = next(csv.reader(io.StringIO(record, newline=""), delimiter=sep))
    lower = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


_STATES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("from_start", pa.bool_()),
                     ("from_inside", pa.bool_()), ("utf8", pa.bool_()), ("undefined_1254", pa.bool_()), ("header", pa.binary())])


def _range_states(sep: bytes, multiline: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b, utf8, undefined = False, True, True, False
                for at, line in _lines(row["path"], row["start"]):
                    if at >= row["end"]:
                        break
                    if _QUOTE in line:
                        same = a == b
                        a = ends_open(line, sep, a)
                        b = a if same else ends_open(line, sep, b)
                    if not line.isascii():
                        undefined = undefined or len(line.translate(None, _UNDEFINED_BYTES)) < len(line)
                        try:
                            line.decode("utf-8")
                        except UnicodeDecodeError:
                            utf8 = False
                header = None if row["start"] else next(
                    _records(row["path"], 0, row["end"], False, sep, multiline), None)
                yield pa.RecordBatch.from_pylist([dict(
                    row, from_start=a and multiline, from_inside=b and multiline, utf8=utf8, undefined_1254=undefined,
                    header=header)], schema=_STATES)
    return run


_CUT = pa.schema([("slots", pa.list_(pa.int32())), ("record", pa.string())])


def _range_records(sep: bytes, multiline: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                records = _records(row["path"], row["start"], row["end"], row["inside"], sep, multiline)
                if row["start"] == 0:
                    next(records, None)
                texts: list[str] = []
                size = 0
                for record in records:
                    texts.append(record.decode(row["encoding"], "replace"))
                    size += len(record)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([row["slots"]] * len(texts), _CUT.field(0).type),
                                                          pa.array(texts)], schema=_CUT)
                        texts, size = [], 0
                if texts:
                    yield pa.RecordBatch.from_arrays([pa.array([row["slots"]] * len(texts), _CUT.field(0).type),
                                                      pa.array(texts)], schema=_CUT)
    return run


def file_ranges(spark: SparkSession, paths: Sequence[str] | str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, end) of all byte ranges of the files; a compressed file is one range.  Only listed, not read."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length").where("length > 0")
    whole = F.col("path").rlike(_COMPRESSED)
    starts = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    return (files.select("path", "length", whole.alias("whole"), F.explode(starts).alias("start"))
            .select("path", "start", F.when(F.col("whole"), F.lit((1 << 63) - 1))
                    .otherwise(F.least(F.col("length"), F.col("start") + F.lit(range_bytes))).alias("end")))


def file_layouts(spark: SparkSession, paths: Sequence[str] | str, encoding: str | None = None, sep: str = ",",
                 multiline: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per range: ``(path, start, end, inside, encoding, header)``; header is the array of the file's column names.

    ``inside`` says that the range starts inside a quoted field.  A range that maps both states to one
    sets the state anew; behind it only the ranges that turn the state count.
    """
    ranges = keep_table(file_ranges(spark, paths, range_bytes), "csv_ranges")
    states = keep_table(ranges.repartition(_tasks(ranges, range_bytes)).mapInArrow(
        _range_states(sep.encode(), multiline),
        "path string, start long, end long, from_start boolean, from_inside boolean, utf8 boolean, "
        "undefined_1254 boolean, header binary"), "csv_states")
    before = Window.partitionBy("path").orderBy("start")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    sets, turns = F.expr("from_start = from_inside"), F.expr("cast(from_start and not from_inside as int)")
    names = F.udf(lambda b, e: _names(b.decode(e, "replace"), sep) if b is not None else None, "array<string>")
    files = states.groupBy("path").agg(F.bool_and("utf8").alias("utf8"), F.bool_or("undefined_1254").alias("undefined_1254"),
                                       F.max("header").alias("header"))
    files = files.withColumn("encoding", F.lit(encoding) if encoding else _encoding()).select(
        F.col("path").alias("__path"), "encoding", names("header", "encoding").alias("header"))
    placed = (states.withColumn("turned", F.sum(turns).over(before))
              .withColumn("set_to", F.last(F.when(sets, F.col("from_start").cast("int")), ignorenulls=True).over(earlier))
              .withColumn("set_at", F.last(F.when(sets, F.col("turned")), ignorenulls=True).over(earlier))
              .withColumn("turned", F.coalesce(F.sum(turns).over(earlier), F.lit(0)))
              .withColumn("inside", (F.coalesce("set_to", F.lit(0)) + F.col("turned") - F.coalesce("set_at", F.lit(0))) % 2 == 1))
    return (placed.drop("header").join(files, placed["path"] == files["__path"])
            .where("header is not null").select("path", "start", "end", "inside", "encoding", "header"))


def _tasks(ranges: DataFrame, range_bytes: int) -> int:
    """As many tasks as ranges of full size; small files share them."""
    size = F.least(F.col("end") - F.col("start"), F.lit(range_bytes))
    opened = F.lit(min(OPEN_BYTES, range_bytes))
    per_range = F.when(F.col("end") - F.col("start") < range_bytes, size + opened).otherwise(size)
    return max(1, int(ranges.agg(F.ceil(F.sum(per_range) / range_bytes)).first()[0] or 0))


def read_csv(spark: SparkSession, paths: Sequence[str] | str, encoding: str | None = None,
             sep: str = ",", with_nulls: bool = True, multiline: bool = True,
             range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Header CSV, every column STRING (no inference: one bad cell
    cannot change a column's type); encoding per file unless given.

    Quotes are doubled inside quoted fields, which may hold line ends (``multiline=False``: none
    do, so an unclosed quote ends with its line).  Columns are matched by name whatever its case, in the
    order of the first files that have them; a column that a file lacks is null.  Lines end
    at ``\\n`` or ``\\r\\n``; an encoding must keep ASCII bytes (UTF-16 does not).  Files are listed by Spark and read by
    pyarrow's file systems (local, HDFS, S3, GCS), a task per ``range_bytes``; compressed ones are one task each.
    """
    layouts = keep_table(file_layouts(spark, paths, encoding, sep, multiline, range_bytes), "csv_layouts")
    columns = (layouts.where("start = 0").select("path", F.posexplode("header").alias("pos", "name"))
               .groupBy(F.lower("name").alias("key"), F.lit(0).alias("all"))
               .agg(F.min(F.struct("path", "pos", "name")).alias("at"), F.max("pos").alias("pos"))
               .orderBy("at").collect())
    if not columns:
        raise FileNotFoundError(f"No input files: {paths}")
    width = 1 + max(c["pos"] for c in columns)
    known = F.transform("header", F.lower)
    slots = F.array(*[(F.array_position(known, c["key"]) - 1).cast("int") for c in columns])
    ranges = layouts.select("path", "start", "end", "inside", "encoding", slots.alias("slots"))
    records = ranges.repartition(_tasks(ranges, range_bytes)).mapInArrow(
        _range_records(sep.encode(), multiline), "slots array<int>, record string")
    parsed = records.select("slots", F.from_csv("record", ", ".join(f"c{i} string" for i in range(width)), {
        "sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}).alias("r"))
    cells = parsed.select("slots", F.array(*[F.col(f"r.c{i}") for i in range(width)]).alias("cells"))
    df = cells.select(*[F.get("cells", F.expr(f"if(slots[{i}] < 0, null, slots[{i}])")).alias(c["at"]["name"])
                        for i, c in enumerate(columns)])
    return null_tokens(df) if with_nulls else df
