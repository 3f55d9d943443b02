"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

Signature: ``SYMBOLS`` minima of a document's shingle hashes, of which ``BITS`` low bits stay.  A pair
with Jaccard similarity s differs in about ``SYMBOLS * (1 - s)`` symbols.  The signature is split into
``CHUNKS`` chunks; by pigeonhole two signatures that differ in fewer than ``CHUNKS * (ERRORS + 1)``
symbols have a chunk with at most ``ERRORS`` differing symbols.  Enumerating the allowed errors (every
choice of ``ERRORS`` positions left out of a chunk) turns that into equality of keys, so every pair with
a distance up to ``MAX_DISTANCE`` shares a key.  At s = 0.8 the distance is Binomial(64, 0.2): 27 or less
with probability over 0.9999.

Candidates are settled without enumerating a key's pairs: first every document against the smallest
of its key (a star); after these links are verified and joined into components, only pairs of
*different* components that share a key remain.  They are compared block by block: a pair is passed on if
its signatures lie within the distance and its sets can be similar at all.  Two upper bounds of the
intersection tell that, and no pair that is similar enough fails them.  Each document that shares a key knows
how many of its shingles another such document has; two documents share no more than the lesser of these
numbers.  And each has a histogram of its shingles over hash bins; two documents share in a bin no more than
the lesser of its counts.  With about a bin a shingle the second bound is sharp, so copies that were each
edited by themselves, a family whose members stay below the threshold, are compared inside the cells and not
handed on pair by pair.  Verification is exact: intersection and union of the full shingle sets.  Documents
whose whole sorted shingle sets have the same SHA-256 are one class with one representative.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep_table
from .components import connected_components
from .words import mix, whole_hash, window_hashes, word_slices

SYMBOLS, BITS = 64, 16
CHUNKS, ERRORS = 14, 1
MAX_DISTANCE = CHUNKS * (ERRORS + 1) - 1
LEAST_BINS, MOST_BINS = 64, 4096  # fewer bins make the bound weaker, never wrong
BLOCK = 512

_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(0, 1 << 63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, SYMBOLS, np.uint64)
_EDGES = [SYMBOLS * c // CHUNKS for c in range(CHUNKS + 1)]
# (chunk, symbols that must agree) for every chunk and every choice of one position left out
_KEYS = [(c, [p for p in range(_EDGES[c], _EDGES[c + 1]) if p != out])
         for c in range(CHUNKS) for out in range(_EDGES[c], _EDGES[c + 1])]
_CHOICE = np.uint64((1 << (len(_KEYS) - 1).bit_length()) - 1)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text (A-Z folded); empty without words."""
    for first, stop, words, at in word_slices(column, lower=True):
        grams = window_hashes(words, width, salt=width)
        for i in range(stop - first):
            lo, hi = int(at[i]), int(at[i + 1])
            if hi - lo >= width:
                yield np.unique(grams[lo:hi - width + 1])
            elif hi > lo:
                yield np.array([whole_hash(words[lo:hi])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """b-bit minhash symbols of a non-empty shingle set."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[lo:lo + 1024, None] * _MUL + _ADD).min(0), out=least)
    return mix(least).astype(np.uint16)


def histogram(shingles: np.ndarray) -> np.ndarray:
    """Shingles per hash bin; the number of bins is the power of two at or below the set's size, within limits.

    A count fits 16 bits unless a text has over 2**28 distinct shingles.
    """
    bins = min(max(1 << (len(shingles).bit_length() - 1), LEAST_BINS), MOST_BINS)
    return np.bincount((mix(shingles) & np.uint64(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint16)


def most_shared(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Upper bound of the intersection of one histogram's set with each of ``others``' (rows of one width).

    Bins are the low bits of a hash, so the halves of the wider histogram add up to the narrower one's bins."""
    bins = min(len(one), others.shape[1])
    one = one.reshape(-1, bins).sum(0, dtype=np.uint32) if len(one) > bins else one
    others = others.reshape(len(others), -1, bins).sum(1, dtype=np.uint32) if others.shape[1] > bins else others
    return np.minimum(others, one).sum(1, dtype=np.int64)


def signature_keys(symbols: np.ndarray) -> np.ndarray:
    """One 64-bit key per row for each chunk and each allowed choice of errors; its low bits number the choice."""
    wide = symbols.astype(np.uint64) + np.uint64(1)
    keys = np.empty((len(symbols), len(_KEYS)), np.uint64)
    for k, (_, agree) in enumerate(_KEYS):
        code = np.full(len(symbols), k, np.uint64)
        for p in agree:
            code = mix(code * _MUL[0] + wide[:, p])
        keys[:, k] = (code & ~_CHOICE) | np.uint64(k)
    return keys


def _first_shared(differs: np.ndarray, choice: int) -> np.ndarray:
    """Of pairs that share the key of a choice, which share none of an earlier choice (``differs``: symbols)."""
    chunk, agree = _KEYS[choice]
    errors = np.add.reduceat(differs, _EDGES[:-1], axis=1, dtype=np.int64)
    return ((errors[:, :chunk] > ERRORS).all(1)
            & ((errors[:, chunk] == ERRORS) | (choice == min(k for k, (c, _) in enumerate(_KEYS) if c == chunk))))


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, signs = [], [], []
            for shingles in shingle_sets(batch.column(1), width):
                sizes.append(len(shingles))
                sets.append(hashlib.sha256(shingles.tobytes()).digest() if len(shingles) else None)
                signs.append(signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()),
                 pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])
    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
            symbols = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            keys = signature_keys(symbols).view(np.int64)
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [s.tobytes() for s in shingle_sets(part.column(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])
    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            ids = batch.column(0).slice(lo, 256).to_numpy(zero_copy_only=False)
            sets = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column(1).slice(lo, 256)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sets)), pa.array(np.repeat(ids, [len(s) for s in sets]))], ["shingle", "id"])


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bins = [histogram(np.frombuffer(s.as_buffer(), np.uint64)).tobytes() for s in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins, pa.binary())], ["id", "bins"])


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(small) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])
    return run


def _segments(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Split a sorted stream into runs of rows that agree in the first ``by`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:by]]
        cut = np.flatnonzero(np.any([n[1:] != n[:-1] for n in names], axis=0)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        if held and last != tuple(n[0] for n in names):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(edges[:-2], edges[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(lo, hi - lo)])
            held = []
        held.append(batch.slice(edges[-2]))
        last = tuple(n[-1] for n in names)
    if held:
        yield pa.Table.from_batches(held)


def _near_in_cells(percent: int):
    """Pairs of different components in each cell of a key's block grid, within the signature distance.

    ``side`` tells the rows of the cell (0) from its columns (1); a cell of the diagonal has side 2 only.
    A pair that shares several keys is passed on by the first of them alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for cell in _segments(batches, 3):
            side, ids, comp, size, common = (cell.column(i).to_numpy() for i in range(3, 8))
            symbols = np.frombuffer(b"".join(cell.column(8).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            choice = int(np.uint64(cell.column(0)[0].as_py() % (1 << 64)) & _CHOICE)
            counts = [np.frombuffer(b, np.uint16) for b in cell.column(9).to_pylist()]
            width = np.array([len(c) for c in counts])
            own = np.zeros(len(width), np.int64)  # row within the histograms of its width
            wide = {}
            for w in np.unique(width).tolist():
                rows = np.flatnonzero(width == w)
                own[rows] = np.arange(len(rows))
                wide[w] = np.stack([counts[k] for k in rows])
            for i in np.flatnonzero(side != 1).tolist():
                lo = i + 1 if side[i] == 2 else int(np.searchsorted(side, 1))
                most = np.minimum(common[lo:], common[i])  # of the intersection
                at = lo + np.flatnonzero((comp[lo:] != comp[i]) & (ids[lo:] != ids[i])
                                         & (100 * most >= percent * (size[lo:] + size[i] - most)))
                if len(at):
                    differs = symbols[at] != symbols[i]
                    at = at[(differs.sum(1) <= MAX_DISTANCE) & _first_shared(differs, choice)]
                if len(at):
                    most = np.empty(len(at), np.int64)
                    for w, rows in wide.items():
                        of = np.flatnonzero(width[at] == w)
                        if len(of):
                            most[of] = most_shared(counts[i], rows[own[at[of]]])
                    at = at[100 * most >= percent * (size[at] + size[i] - most)]
                if len(at):
                    found.append((np.minimum(ids[at], ids[i]), np.maximum(ids[at], ids[i])))
                    n += len(at)
            if n > 50_000:
                yield _pairs(found)
                found, n = [], 0
        if found:
            yield _pairs(found)
    return run


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])


def _sets(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles): the full shingle sets of the documents ``ids``."""
    return keep_table(texts.join(ids, texts["doc_id"] == ids["id"]).select("id", "text")
                      .mapInArrow(_set_rows(width), "id long, shingles binary").where("length(shingles) > 0"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    joined = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
              .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"))
    return joined.select("a", "b", "x", "y").mapInArrow(_linked(percent), "a long, b long")


def _within(percent: int):
    """Pairs whose sizes and signatures allow the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for i in (4, 5))
            keep = pa.array((100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((x != y).sum(1) <= MAX_DISTANCE))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
    return run


def _near_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    sizes = reps.select("id", "n_shingles", "signature")
    return (pairs.join(sizes.toDF("a", "n", "x"), "a").join(sizes.toDF("b", "m", "y"), "b")
            .select("a", "b", "n", "m", "x", "y").mapInArrow(_within(percent), "a long, b long"))


def _shared_keys(keys: DataFrame) -> DataFrame:
    """(key, id, a) of the keys that several documents have; a is the smallest of them."""
    least = keep_table(keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n"))
                       .where("n > 1").select("key", "a"), "least")
    return keep_table(keys.join(least, "key"), "shared")


def _cross_links(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components that share a key.

    A key with n members is a grid of ceil(n / BLOCK) squared cells; a member joins the cells of its
    row and column, so that no task holds a whole key."""
    mixed = keep_table(members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                                  F.count("*").alias("n"))
                       .where("lo <> hi").select("key", "n"), "mixed")
    members = keep_table(members.join(mixed, "key"), "mixed")
    private = (sets.mapInArrow(_shingle_rows, "shingle long, id long").groupBy("shingle")
               .agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other")
               .groupBy("id").agg(F.count("*").alias("private")))
    known = sets.mapInArrow(_histograms, "id long, bins binary")
    reps = keep_table(reps.join(known, "id").join(private, "id", "left").select(
        "id", "n_shingles", (F.col("n_shingles") - F.coalesce("private", F.lit(0))).alias("common"), "signature", "bins"),
        "reps")
    cells = (members.join(reps, "id")
             .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
             .withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumns({"r": F.least("own", "other"), "c": F.greatest("own", "other"),
                           "side": F.when(F.col("own") == F.col("other"), 2)
                           .otherwise((F.col("own") > F.col("other")).cast("int"))}))
    pairs = (cells.select("key", "r", "c", "side", "id", "component", "n_shingles", "common", "signature",
                          "bins")
             .repartition("key", "r", "c").sortWithinPartitions("key", "r", "c", "side")
             .mapInArrow(_near_in_cells(percent), "a long, b long"))
    return _verified(keep_table(pairs, "pairs"), sets, percent)


def minhash_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept).

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read.  Shingles are ``width``
    consecutive words (A-Z folded); a shorter text is one shingle; a null text or one without words has an
    empty set and links with nothing.  Links: ``100 * intersection >= percent * union``, confirmed on full
    sets.  Rows that repeat a doc_id are one document, linked if any of its rows is.  A row without
    doc_id links with nothing: component_id null, kept true.  An empty table gives an empty result.
    ``percent`` is 80 or more.
    """
    if percent < 80:
        raise ValueError("the signature distance is set for a similarity of 0.8 or more")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = keep_table(texts.mapInArrow(
        _sketch(width), "doc_id long, n_shingles long, set_key binary, signature binary"), "sketch")
    usable = sketch.where("doc_id is not null and set_key is not null")
    classes = keep_table(usable.groupBy("set_key").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature")), "classes")
    same = (usable.join(classes.select("set_key", "id"), "set_key")
            .where("id <> doc_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct())
    keys = keep_table(classes.select("id", "signature").repartition(F.col("id"))
                      .mapInArrow(_keys, "key long, id long"), "keys")
    shared = _shared_keys(keys)
    sets = _sets(texts, keep_table(shared.select("id").distinct(), "ids"), width)
    pairs = shared.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    star = keep_table(_verified(keep_table(_near_pairs(pairs, classes, percent), "pairs"), sets, percent), "links")
    near = keep_table(connected_components(star), "near")
    members = (shared.join(near, "id", "left")
               .select("key", "id", F.coalesce("component", "id").alias("component")))
    rest = _cross_links(members, classes, sets, percent)
    component = keep_table(connected_components(keep_table(
        star.unionByName(rest).unionByName(same), "links")), "component")
    return (sketch.join(component, sketch["doc_id"] == component["id"], "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates (smallest doc_id), all columns kept."""
    gone = (minhash_components(docs, width, percent).where("not kept")
            .select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
