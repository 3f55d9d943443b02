"""Substring dedup: repeated fixed-length token windows merge into maximal removal intervals.

Every window of ``width`` consecutive words has a Rabin-Karp hash, and Spark counts the hashes.  Most
windows can be counted without moving them: a window's *anchor* is the least hash of the ``GRAM``-word
runs inside it, so two equal windows hold the same anchor at two places.  First the anchors (about
one word in ten) are counted; a window whose anchor stands at one place of the corpus has count one.
Only the other windows' hashes are shuffled and counted, which loses none that repeats.

Stages: anchors -> counts -> repeated anchors of each text; window hashes there -> counts -> repeated
windows of each text; overlapping windows merge into intervals, and the words inside go.  Counts are
pre-aggregated before each shuffle and joined back by an exchange that adaptive execution can split,
so that a passage shared by a third of all documents is no single task.  Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep_table
from .words import text_buffers, window_hashes, word_slices

WIDTH, GRAM = 35, 16


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every run of ``width`` consecutive items, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = op(x[:-step], x[step:])
        have += step
    return x


def _window_anchors(words: np.ndarray, at: np.ndarray, width: int, gram: int):
    """(anchor of the window at each word, whether a window of one row starts there)."""
    n = len(words)
    starts = np.zeros(n, bool)
    anchors = np.zeros(n, np.uint64)
    if n >= width:
        ends = np.repeat(at[1:], np.diff(at))
        starts[:n - width + 1] = np.arange(width, n + 1) <= ends[:n - width + 1]
        anchors[:n - width + 1] = _sliding(window_hashes(words, gram), width - gram + 1, np.minimum)
    return anchors, starts


def _anchor_rows(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, stop, words, at in word_slices(batch.column(1)):
                anchors, starts = _window_anchors(words, at, width, gram)
                if not starts.any():
                    continue
                # a run of words is an anchor if it is the least of any window that holds it
                reach = width - gram + 1
                floor = np.concatenate([np.zeros(reach - 1, np.uint64), np.where(starts, anchors, np.uint64(0))])
                grams = window_hashes(words, gram)
                chosen = np.flatnonzero(_sliding(floor, reach, np.maximum)[:len(grams)] == grams)
                row = np.searchsorted(at, chosen, "right") - 1 + first
                order = np.lexsort((grams[chosen], row))
                row, hashes = row[order], grams[chosen][order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
                place = np.flatnonzero(new)
                counts = np.diff(np.append(place, len(row))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[place].view(np.int64)), pa.array(keys[row[place]]), pa.array(counts)],
                    ["anchor", "key", "n"])
    return run


def _window_rows(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            wanted = batch.column(2)
            values, ends = wanted.values.to_numpy().view(np.uint64), wanted.offsets.to_numpy()
            for first, stop, words, at in word_slices(batch.column(1)):
                anchors, starts = _window_anchors(words, at, width, gram)
                hashes = window_hashes(words, width)
                for i in range(first, stop):
                    lo, hi = int(at[i - first]), int(at[i - first + 1]) - width + 1
                    if hi <= lo:
                        continue
                    pos = np.flatnonzero(np.isin(anchors[lo:hi], values[ends[i]:ends[i + 1]]))
                    if len(pos):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(hashes[lo + pos].view(np.int64)), pa.array(np.full(len(pos), keys[i])),
                             pa.array(pos.astype(np.int32))], ["hash", "key", "pos"])
    return run


def _gather(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Join small batches into larger ones."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _removal(batches: Iterator[pa.RecordBatch], width: int, want_text: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, word counts, kept text or its digest, and the removed intervals of every row."""
    for batch in batches:
        data, at = text_buffers(batch.column(1))
        raw = data.tobytes() if len(data) < 1 << 26 else memoryview(data)
        n_words, n_removed, kept, spans = [], [], [], []
        for i, starts in enumerate(batch.column(2)):
            words = bytes(raw[at[i]:at[i + 1]]).split()
            found = np.sort(np.array(starts.as_py(), np.int64)) if starts.is_valid else np.zeros(0, np.int64)
            breaks = np.flatnonzero(np.diff(found) > width) + 1
            begin = found[np.concatenate([[0], breaks])] if len(found) else found
            end = found[np.concatenate([breaks - 1, [-1]]).astype(int)] + width if len(found) else found
            left = np.ones(len(words), bool)
            for lo, hi in zip(begin, end):
                left[lo:hi] = False
            text = b" ".join(compress(words, left) if len(found) else words)
            n_words.append(len(words))
            n_removed.append(len(words) - int(left.sum()))
            kept.append(text if want_text else hashlib.sha256(text).hexdigest())
            spans.append([{"begin": int(b), "end": int(e)} for b, e in zip(begin, end)])
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        out = pa.array(kept, pa.binary()).cast(pa.string()) if want_text else pa.array(kept, pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), out,
             pa.array(spans, span)],
            ["doc_id", "n_words", "n_removed", "kept", "removed"])


def _repeated(rows: DataFrame, key: str, n, name: str) -> DataFrame:
    """Values of ``key`` whose counts sum to two or more."""
    return keep_table(rows.groupBy(key).agg(F.sum(n).alias("__n")).where("__n > 1").select(key), name)


def remove_repeats(docs: DataFrame, width: int = WIDTH, want_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_removed, kept, removed).

    A word goes when a window of ``width`` words that covers it starts at two or more places of the whole
    table (same row included); windows are those of the input.  ``kept`` is the kept words joined by
    one space, or its SHA-256 if not ``want_text``; ``removed`` lists the maximal intervals of word
    numbers.  Null, empty and short texts have no window (null: no words, kept is empty).  Equal rows are
    separate places, so both lose the repeated words.  Only ``doc_id`` and ``text`` are read; an empty
    table gives an empty result.
    """
    gram = min(GRAM, width)
    texts = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
             .withColumn("key", F.xxhash64("doc_id", "text")))
    # read twice and made twice: hashing the texts again costs less than writing their anchors
    anchors = texts.select("key", "text").mapInArrow(
        lambda b: _gather(_anchor_rows(width, gram)(b)), "anchor long, key long, n int")
    wanted = (anchors.join(_repeated(anchors, "anchor", "n", "repeated"), "anchor")
              .groupBy("key").agg(F.collect_set("anchor").alias("anchors")))
    windows = keep_table(texts.join(wanted, "key").select("key", "text", "anchors").mapInArrow(
        lambda b: _gather(_window_rows(width, gram)(b)), "hash long, key long, pos int"), "windows")
    places = (windows.join(_repeated(windows, "hash", F.lit(1), "repeated"), "hash")
              .groupBy("key").agg(F.collect_set("pos").alias("places")))
    return (texts.join(places, "key", "left").select("doc_id", "text", "places")
            .mapInArrow(lambda b: _removal(b, width, want_text),
                        "doc_id long, n_words long, n_removed long, kept string, "
                        "removed array<struct<begin: long, end: long>>"))
