"""Stupid-backoff scores of documents, computed relationally.

    S(w | h) = c(hw) / c(h) if c(hw) > 0, else FACTOR * S(w | shorter h);  S(w) = c(w) / N

Counts are over all documents; a document's own n-grams are taken off its counts, so that it is scored by
the rest of the corpus.  An unseen word counts as 1 / (N + 1).

There is one count table per order, partitioned by n-gram hash.  Documents are dealt to chunks; a chunk
pre-aggregates its n-grams and sends each hash range ("bucket") its sorted distinct hashes with their counts
as one packed row.  A bucket sums its rows, which is the count table's part, and answers each chunk with the
corpus counts of just the n-grams it asked about (the join).  The chunk's documents then sum their
scores.  Texts are shuffled once (both uses read one exchange), n-grams once a chunk.  A hot n-gram is one
entry per chunk, so no task holds more than its range's share.

A bucket keeps ``BITS`` bits of the hash below its own; at ``CHUNK_BYTES`` text a bucket two of its n-grams agree
in them with a probability of about one in a million.  Packed rows are chunks x buckets: for very large
corpora raise ``chunk_bytes`` (both grow with the input, so their product should stay far below the n-grams).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import window_hashes, word_slices

ORDER, FACTOR = 3, 0.4
CHUNK_BYTES, LEAST_CHUNKS, BITS = 8 << 20, 32, 40


class _Grams:
    """The n-grams of a chunk's texts: for each order the distinct keys and where they stand."""

    def __init__(self, texts: pa.ChunkedArray, order: int, bucket_bits: int):
        parts, sizes = [], []
        for column in texts.chunks:
            for _, _, words, at in word_slices(column):
                parts.append(words)
                sizes.append(np.diff(at))
        words = np.concatenate([np.zeros(0, np.uint64), *parts])
        self.sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        place = np.arange(len(words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        shift = np.uint64(64 - bucket_bits - BITS)
        self.ends, self.keys, self.of, self.counts = [], [], [], []
        for n in range(1, order + 1):
            end = np.flatnonzero(place >= n - 1)  # last words of the n-grams within one text
            keys = window_hashes(words, n, salt=n)[end - (n - 1)] >> shift
            keys, of, counts = np.unique(keys, return_inverse=True, return_counts=True)
            self.ends.append(end)
            self.keys.append(keys)
            self.of.append(of)
            self.counts.append(counts)


def _pack(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, of 4 bytes each if all fit."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return (steps.astype(np.uint32) if not len(steps) or steps.max() < 1 << 32 else steps).tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint32 if len(raw) == 4 * n else np.uint64).astype(np.uint64), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts as one byte each; 255 stands for a larger one, which follows in 8 bytes at the end."""
    counts = counts.astype(np.uint64)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].tobytes()


def _unpack_counts(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, np.int64, offset=n)
    return counts


def _ask(order: int, bucket_bits: int):
    """Rows (n, bucket, chunk, keys, counts, size) of one chunk."""
    def run(table: pa.Table) -> pa.Table:
        grams = _Grams(table.column("text"), order, bucket_bits)
        chunk = table.column("chunk")[0].as_py()
        rows = []
        for n, (keys, counts) in enumerate(zip(grams.keys, grams.counts), 1):
            bucket = (keys >> np.uint64(BITS)).astype(np.int64)
            low = keys & np.uint64((1 << BITS) - 1)
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi > lo:
                    rows.append((n, int(bucket[lo]), chunk, _pack(low[lo:hi]), _pack_counts(counts[lo:hi]), hi - lo))
        return _table(rows, [("n", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()),
                             ("counts", pa.binary()), ("size", pa.int64())])
    return run


def _table(rows: list[tuple], fields: list) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[name for name, _ in fields])


def _answer(table: pa.Table) -> pa.Table:
    """Rows (n, bucket, chunk, totals): corpus counts of the n-grams that each chunk sent to this bucket."""
    sizes = table.column("size").to_pylist()
    counts = [_unpack_counts(c.as_buffer().to_pybytes(), n) for c, n in zip(table.column("counts"), sizes)]
    keys = [_unpack(k.as_buffer().to_pybytes(), n) for k, n in zip(table.column("keys"), sizes)]
    _, of = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(int(of.max()) + 1, np.int64)
    np.add.at(totals, of, np.concatenate(counts))
    packed = [_pack_counts(t) for t in np.split(totals[of], np.cumsum(sizes)[:-1])]
    return pa.table([table.column("n"), table.column("bucket"), table.column("chunk"), pa.array(packed, pa.binary()),
                     table.column("size")], names=["n", "bucket", "chunk", "totals", "size"])


def _score(order: int, bucket_bits: int, n_words: int, factor: float):
    """Rows (doc_id, n_words, log_score) of one chunk."""
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        grams = _Grams(docs.column("text"), order, bucket_bits)
        rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("n", "bucket", "totals", "size"))))
        rest = n_words - grams.sizes[grams.doc]  # words of the other documents
        score = np.log(1.0 / (rest + 1.0))
        shorter = rest
        for n in range(1, order + 1):
            totals = np.concatenate([np.zeros(0, np.int64)] + [
                _unpack_counts(raw, size) for m, _, raw, size in rows if m == n])
            end, of = grams.ends[n - 1], grams.of[n - 1]
            code = grams.doc[end] * max(1, len(totals)) + of
            _, pair, own = np.unique(code, return_inverse=True, return_counts=True)
            count = np.zeros(len(grams.doc), np.int64)
            count[end] = totals[of] - own[pair]
            # the history of the n-gram that ends at a word is the shorter one that ends before it
            history = rest if n == 1 else np.concatenate([[0], shorter[:-1]]) if len(shorter) else shorter
            seen = count[end] > 0
            with np.errstate(divide="ignore"):
                found = np.log(count[end][seen] / history[end][seen])
            if n == 1:
                score[end[seen]] = found
            else:
                score[end] += math.log(factor)
                score[end[seen]] = found
            shorter = count
        total = np.bincount(grams.doc, score, len(grams.sizes)) if len(score) else np.zeros(len(grams.sizes))
        return pa.table([docs.column("doc_id"), pa.array(grams.sizes.astype(np.int64)), pa.array(total)],
                        names=["doc_id", "n_words", "log_score"])
    return run


def backoff_scores(docs: DataFrame, order: int = ORDER, factor: float = FACTOR,
                   chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, log_score, mean_log_score).

    ``log_score`` sums ln S over the words (``[^\\x20\\x09-\\x0D]+``) of the whole text, each after up to
    ``order - 1`` words of the same text; a null or empty text has no words, score 0 and a null mean.  A
    repeated row is another document and lends its counts.  Only ``doc_id`` and ``text`` are read; an empty
    table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_bytes, n_words = texts.agg(F.sum(F.octet_length("text")),
                                 F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()
    chunks = max(LEAST_CHUNKS, -(-(n_bytes or 0) // chunk_bytes))
    bucket_bits = (chunks - 1).bit_length()
    dealt = texts.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long").alias("chunk"))
    asked = dealt.groupBy("chunk").applyInArrow(
        _ask(order, bucket_bits), "n int, bucket long, chunk long, keys binary, counts binary, size long")
    answers = (asked.groupBy("n", "bucket").applyInArrow(
        _answer, "n int, bucket long, chunk long, totals binary, size long")
        .withColumnRenamed("chunk", "to_chunk"))
    return (dealt.groupBy("chunk").cogroup(answers.groupBy("to_chunk"))
            .applyInArrow(_score(order, bucket_bits, n_words or 0, factor), "doc_id long, n_words long, log_score double")
            .withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))))
