"""Document fingerprints by winnowing.

Every run of ``GRAM`` code points has a rolling hash; of each ``WINDOW`` consecutive hashes the least is kept,
the rightmost on ties, with its position.  Two texts that share ``GRAM + WINDOW - 1`` code points in a row
share a kept hash (the match guarantee), and neighbouring windows mostly keep the same one.

A text shorter than ``GRAM`` keeps one hash of the whole text, an empty text none.  Very long texts are
hashed in overlapping blocks, which keeps the same hashes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .substring_dedup import _sliding
from .words import mix, whole_hash, window_hashes

GRAM, WINDOW = 12, 32
_BLOCK = 1 << 17
_PLACE = np.uint64((1 << 20) - 1)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept of a text, by position."""
    codes = _code_points(text)
    if len(codes) < gram:
        kept = np.array([whole_hash(mix(codes))] if len(codes) else [], np.uint64)
        return kept, np.zeros(len(kept), np.int64)
    hashes, places = [], []
    n = len(codes) - gram + 1
    for lo in range(0, max(1, n - window + 1), _BLOCK):
        h = window_hashes(codes[lo:lo + _BLOCK + window + gram - 2], gram)
        # the low bits hold the place from the right, so that of equal hashes the rightmost is the least
        marked = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
        least = _sliding(marked, min(window, len(h)), np.minimum)
        at = (_PLACE - (least & _PLACE)).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        hashes.append(h[at])
        places.append(at + lo)
    where = np.concatenate(places)
    new = np.concatenate([[True], where[1:] != where[:-1]])
    return np.concatenate(hashes)[new], where[new]


def digest(kept: tuple[np.ndarray, np.ndarray]) -> str:
    """A short name of a fingerprint: SHA-256 of its hashes and positions."""
    return hashlib.sha256(kept[0].tobytes() + kept[1].tobytes()).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of sorted distinct hashes; two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _text(value: pa.Scalar) -> str:
    return value.as_buffer().to_pybytes().decode("utf-8", "surrogateescape") if value.is_valid else ""


def fingerprint_documents(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: (doc_id, hashes, positions) of the whole text; null or empty text: no hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [winnow(_text(t), gram, window) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([k[0].view(np.int64) for k in kept], pa.list_(pa.int64())),
                 pa.array([k[1] for k in kept], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>"))


class _Document:
    """A text and its fingerprint, made once."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.kept = winnow(text)
        self.hashes = np.unique(self.kept[0])

    def row(self, after: "_Document") -> tuple:
        n = len(self.text)
        edited = self.text[:n - n // 3] + after.text[:n // 3]
        kept = winnow(edited)
        return (self.doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogateescape")).hexdigest(),
                digest(self.kept), digest(kept), len(self.hashes),
                likeness(self.hashes, np.unique(kept[0])), likeness(self.hashes, after.hashes))


_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                  ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("n_hashes", pa.int64()),
                  ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, guest, document order): each with the row that follows in its bucket.

    Guests are the first documents of the next bucket; they end a bucket and give no row of their own."""
    last: tuple[int, _Document] | None = None
    rows: list[tuple] = []
    for batch in batches:
        for bucket, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            if guest and (last is None or last[0] != bucket):
                continue
            own = _Document(doc_id, _text(text))
            if last is not None and last[0] == bucket:
                rows.append(last[1].row(own))
            last = None if guest else (bucket, own)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)
            rows = []


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how alike they are to it.

    The edited text has the last third (n_chars // 3 code points) replaced by as many first code points of the
    next document (or all it has), in descending order of doc_id, null ids last; after the last comes the
    first.  Rows of one doc_id stand in order of a hash of their text; equal rows are neighbours.  One row per
    row: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, n_hashes, near_edited, near_next),
    likeness being the Jaccard similarity of the kept hashes.  Null texts are empty.  An only document is its
    own successor; an empty table gives an empty result.  Other columns are not read.

    The order is cut into ranges of documents, whose first keys are the only thing the driver sees (a few per
    partition); texts are shuffled once, each range to one task, with the first document of the next range.
    """
    spark = docs.sparkSession
    order = ["o1", "o2", "o3"]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", "text", F.col("doc_id").isNull().cast("int").alias("o1"),
        F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("o2"), F.xxhash64("text").alias("o3"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = sorted(tuple(r.first) for r in keyed.select(*order).repartitionByRange(ranges, *order)
                    .groupBy(F.spark_partition_id()).agg(F.min(F.struct(*order)).alias("first")).collect())
    number = {key: i for i, key in enumerate(firsts)}

    @F.pandas_udf(ArrayType(IntegerType()))
    def buckets(o1, o2, o3):
        import pandas as pd

        out = []
        for key in zip(o1.tolist(), o2.tolist(), o3.tolist()):
            own = bisect_right(firsts, key) - 1
            out.append([own, (own - 1) % len(firsts)] if key in number else [own])
        return pd.Series(out)

    placed = (keyed.withColumn("b", buckets(*order))
              .select("*", F.posexplode("b").alias("guest", "bucket")))
    return (placed.select("bucket", "guest", "doc_id", "text", *order)
            .repartition("bucket").sortWithinPartitions("bucket", "guest", *order)
            .select("bucket", "guest", "doc_id", "text")
            .mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                  "edited_fingerprint string, n_hashes long, near_edited double, near_next double"))
