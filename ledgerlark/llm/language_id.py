"""Language ID by rank-order profiles of character n-grams.

A profile lists the ``PROFILE`` most frequent n-grams (1 to 3 letters, words padded by one blank) of a
language.  A document's own most frequent n-grams, over its whole text, are ranked likewise, and the
language with the least out-of-place distance wins: the sum over the document's n-grams of how far their
rank lies from the profile's, ``PROFILE`` if the profile lacks them.

Profiles are fitted on labelled documents: about ``fit_docs`` per language, drawn by a hash of doc_id, whole
texts.  Their size is languages x ``PROFILE``, and languages are limited to ``MAX_LANGUAGES`` (more is an
error), so the driver may hold and broadcast them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

PROFILE, FIT_DOCS, MAX_LANGUAGES = 300, 4000, 1000
UNKNOWN = "und"
_BLOCK = 1 << 20
_BITS = np.int64(21)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _spaced(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, each run of other characters as one 0, 0 at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([[0], np.where(letter, codes, 0)[keep], [0]])


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, as packed code points in ascending order, and their counts; empty without letters."""
    codes = _spaced(text)
    found = []
    for lo in range(0, len(codes), _BLOCK):
        c = codes[lo:lo + _BLOCK + 2]
        own = min(len(c), _BLOCK)  # n-grams that start in this block
        one = c[:own]
        two, three = (c[:-1] << _BITS | c[1:])[:own], (c[:-2] << _BITS | c[1:-1])[:own]
        three = (three << _BITS | c[2:][:own])[c[1:-1][:own] > 0]
        # a pair of blanks cannot occur beyond the ends of a text without letters
        grams = np.sort(np.concatenate([one[one > 0], two[two > 0], three]))
        start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, int)
        found.append((grams[start], np.diff(np.append(start, len(grams)))))
    if len(found) == 1:
        return found[0]
    grams, back = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return grams, np.bincount(back, np.concatenate([n for _, n in found])).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams; equal counts in n-gram order."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Ranks of the languages' most frequent n-grams."""

    def __init__(self, top: dict[str, np.ndarray], size: int):
        self.languages = sorted(top)
        self.size = size
        self.grams = np.unique(np.concatenate([*top.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.grams) + 1, len(top)), -1, np.int64)
        for k, lang in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, top[lang]), k] = np.arange(len(top[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is 1 minus the distance over its maximum; ties go to the first name."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(*gram_counts(text), self.size)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[at < len(self.grams)] = np.where(self.grams[at[at < len(self.grams)]] == own[at < len(self.grams)],
                                            at[at < len(self.grams)], len(self.grams))
        rank = self.ranks[at]
        out = np.where(rank >= 0, np.abs(rank - np.arange(len(own))[:, None]), self.size).sum(0)
        best = int(out.argmin())
        return self.languages[best], 1.0 - float(out[best]) / (self.size * len(own))


def _text(value: pa.Scalar) -> str | None:
    return value.as_buffer().to_pybytes().decode("utf-8", "replace") if value.is_valid else None


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            by_lang.setdefault(lang, []).append(gram_counts(_text(text) or ""))
        for lang, parts in by_lang.items():
            grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])


def fit_profiles(docs: DataFrame, fit_docs: int = FIT_DOCS, size: int = PROFILE) -> Profiles:
    """Profiles of the languages in ``docs(doc_id, text, lang)``; rows with a null lang are left out.

    ``fit_docs`` bounds the expected number of documents per language; a language with fewer is fitted on all.
    """
    labelled = docs.where("lang is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    if not sizes:
        return Profiles({}, size)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_docs / n))])
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    counts = (drawn.select("lang", F.col("text").cast("string").alias("text"))
              .mapInArrow(_count_rows, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # the driver gets at most languages x 16 x size rows
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(16))).orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("r", F.row_number().over(part)).where(F.col("r") <= size).select("lang", "gram", "n")
    top: dict[str, list] = {}
    for lang, gram, n in rows.collect():
        top.setdefault(lang, []).append((-n, gram))
    return Profiles({lang: np.array([g for _, g in sorted(found)[:size]], np.int64) for lang, found in top.items()}, size)


def predict_languages(docs: DataFrame, profiles: Profiles, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1) as columns ``pred`` and ``score``.

    Only ``text`` is read, whole; all columns pass through (one named like a new column is replaced).  A null
    text, an empty one or one without letters gets ``und`` and 0.0, as does every text if no profile was
    learned.  Repeated rows get equal results; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    rest = [f for f in docs.schema.fields if f.name not in (pred, score)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.predict(_text(t)) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] for m in made], pa.float64())], [*batch.schema.names[:-1], pred, score])

    schema = StructType([*rest, StructField(pred, StringType()), StructField(score, DoubleType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in rest], F.col("text").cast("string").alias("__text")).mapInArrow(
        run, schema)


def held_out(doc_id="doc_id"):
    """Whether a document is held out of the fit: crc32 of its id as text, modulo 4, is 2 (null id: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, fit_docs: int = FIT_DOCS, pred: str = "lang_pred",
                       score: str = "score") -> DataFrame:
    """Fit on the documents that are not held out and predict all: ``docs`` with columns ``pred`` and ``score``."""
    return predict_languages(docs, fit_profiles(docs.where(~held_out()), fit_docs), pred, score)
