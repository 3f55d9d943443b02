"""Phrase collocations by SETM: occurrence relations that grow by merge-joining adjacent positions.

The occurrence relation R(k) holds, for every position of the corpus, the frequent phrase of k words that starts there.
It is kept sorted by piece and position, in blocks of about ``BLOCK_BYTES`` of text: a block row packs its positions and
the block's own phrases, pieces never cross blocks, so the merge-join of a position with its neighbour stays
inside a row.  Each length is made by the same three steps:

1. merge-join: phrases at adjacent positions of a piece give the phrases of k + 1 words, counted within the block;
2. group-count: the blocks' counts are summed by (phrase id, phrase id) over all blocks in one shuffle.  Phrases are
   dealt to buckets by a hash of their key; a block sends a bucket one row with all its counts, packed;
3. semi-join: the buckets tell each block, again in one packed row, which phrases have enough occurrences, and only
   their occurrences are kept as R(k + 1), a table under ``spark.checkpoint.dir``, before the next length is begun.

A phrase's id is its rank in its bucket, so keys are two small numbers whatever the length; the hash only deals, phrases
are told apart by their keys.  The counts of a phrase's heads and tails travel with it, so scoring needs no join.  All
counts are exact; the score is worked out in unbounded integers.

Scale: a word or phrase that is everywhere is one entry per block before any shuffle.  A task holds a block or a bucket
at a time; the buckets grow in number with the blocks, so a bucket holds the counts of a few blocks' text.
The best phrases of a language are cut per task before they meet.

Defined results: a null text is empty, a null language ``und``; empty texts and pieces have no words; texts of any length
are whole (a block ends between two pieces); equal rows count each; ties are ranked by phrase in UTF-8 byte order; an
empty table gives no rows; columns beside ``lang`` and ``text`` are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_table, keep_table, released_shuffles

BLOCK_BYTES = 12 << 20
SLICE_BYTES = 1 << 20
BLOCKS_A_TASK = 1 << 10
BLOCKS_A_BUCKET = 2
UNKNOWN = "und"

_END = b"."  # stands for every end of a piece
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
_RELATION = "block long, relation binary"
_COUNTED = "bucket long, block long, counts binary"
_FREQUENT = "block long, bucket long, groups binary"
_ROWS = 1 << 16
#: A block row is compressed already and some MB long: no second compression, no dictionary, a page for each row.
_LARGE_VALUES = {"compression": "uncompressed", "parquet.enable.dictionary": "false",
                 "parquet.page.size.row.check.min": "1"}


# ---- a block's relation --------------------------------------------------------------------------


def _narrow(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """Longs that fit are kept as ints."""
    if column.type != pa.int64() or not len(column):
        return column
    ends = pc.min_max(column).as_py()
    return column.cast(pa.int32()) if -1 << 31 <= ends["min"] and ends["max"] < 1 << 31 else column


def _ipc(table: pa.Table) -> bytes:
    table = pa.table([_narrow(c) for c in table.columns], table.column_names, metadata=table.schema.metadata)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _squeeze(*columns: np.ndarray) -> bytes:
    """Longs of one length as one value, lowest bytes first: high bytes that are zero take no room."""
    longs = np.stack(columns).astype("<i8")
    planes = np.ascontiguousarray(longs.view(np.uint8).reshape(-1, 8).T)
    return longs.shape[1].to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unsqueeze(value: bytes, columns: int) -> np.ndarray:
    n = int.from_bytes(value[:8], "little")
    if not n:
        return np.zeros((columns, 0), np.int64)
    planes = np.frombuffer(pa.decompress(value[8:], 8 * columns * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").reshape(columns, n)


def _pack(codes: np.ndarray, groups: pa.Table) -> bytes:
    """One value for a block: the phrase number at every position (-1: none), and the numbered phrases."""
    longs = [c for c in groups.column_names if groups.schema.field(c).type == pa.int64()]
    rest = groups.drop_columns(longs).replace_schema_metadata({"longs": " ".join(longs)})
    parts = [_squeeze(codes.astype(np.int64) + 1), _squeeze(*(_numbers(groups, c) for c in longs)), _ipc(rest)]
    return b"".join(len(p).to_bytes(8, "little") for p in parts[:2]) + b"".join(parts)


def _unpack(value: pa.Scalar) -> tuple[np.ndarray, pa.Table]:
    data = value.as_buffer()
    a, b = (int.from_bytes(data.slice(at, 8).to_pybytes(), "little") for at in (0, 8))
    codes = _unsqueeze(data.slice(16, a).to_pybytes(), 1)[0] - 1
    rest = pa.ipc.open_stream(data.slice(16 + a + b)).read_all().combine_chunks()
    longs = rest.schema.metadata[b"longs"].decode().split()
    numbers = _unsqueeze(data.slice(16 + a, b).to_pybytes(), len(longs))
    return codes.astype(np.int32), pa.table({c: rest[c] for c in rest.column_names} | dict(zip(longs, map(pa.array, numbers))))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


class _Words:
    """Gathers texts into the words relation of one block."""

    def __init__(self):
        self.vocabulary: dict[str, dict[bytes, int]] = {}
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.codes: list[np.ndarray] = []
        self.waiting: dict[str, list[bytes]] = {}
        self.size = self.held = 0

    def add(self, lang: str, pieces: bytes) -> None:
        """``pieces`` is folded text that starts and ends at ends of pieces."""
        self.waiting.setdefault(lang, []).append(pieces)
        self.size += len(pieces)
        self.held += len(pieces)
        if self.held >= SLICE_BYTES:
            self._number()

    def _number(self) -> None:
        for lang, texts in self.waiting.items():
            tokens = _END.join(texts).replace(_END, b" . ").split()  # bytes.split() knows ASCII blanks only
            coded = pa.array([*tokens, _END], pa.binary()).dictionary_encode()
            known = self.vocabulary.setdefault(lang, {_END: -1})
            numbers = np.empty(len(coded.dictionary), np.int32)
            for i, word in enumerate(coded.dictionary.to_pylist()):
                number = known.get(word)
                if number is None:
                    number = known[word] = len(self.words)
                    self.words.append(word)
                    self.langs.append(lang)
                numbers[i] = number
            self.codes.append(numbers[coded.indices.to_numpy()])
        self.waiting, self.held = {}, 0

    def relation(self) -> bytes:
        self._number()
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.int32)
        counts = np.bincount(codes[codes >= 0], minlength=len(self.words)) if len(self.words) else np.zeros(0, np.int64)
        return _pack(codes, pa.table({"phrase": pa.array(self.words, pa.binary()).cast(pa.string()),
                                      "lang": pa.array(self.langs, pa.string()), "n": pa.array(counts, pa.int64())}))


def _cut(folded: bytes) -> Iterator[bytes]:
    """The text in parts of about SLICE_BYTES that end where a piece ends."""
    at = 0
    while len(folded) - at > SLICE_BYTES:
        end = folded.find(_END, at + SLICE_BYTES)
        if end < 0:
            break
        yield folded[at:end]
        at = end
    yield folded[at:]


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() * BLOCKS_A_TASK
    block, words = first, _Words()

    def row():
        if block >= min(first + BLOCKS_A_TASK, 1 << 31):
            raise ValueError("too many blocks: raise BLOCK_BYTES")
        return pa.record_batch({"block": pa.array([block], pa.int64()), "relation": pa.array([words.relation()], pa.binary())})

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        for lang, text in zip(langs, texts):
            for part in _cut(text.as_buffer().to_pybytes().translate(_FOLD)):
                words.add(lang, part)
                if words.size >= BLOCK_BYTES:
                    yield row()
                    block, words = block + 1, _Words()
    if words.size:
        yield row()


def _adjacent(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge-join of each position with the next of its piece: (positions, keys left * width + right)."""
    at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    return at, codes[at].astype(np.int64) * width + codes[at + 1]


def _word_keys(codes: np.ndarray, groups: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the block's words, hashes that deal them to buckets)."""
    hashes = np.fromiter(map(zlib.crc32, groups["phrase"].cast(pa.binary()).to_pylist()), np.int64, len(groups))
    return np.arange(len(groups)), hashes


def _pair_keys(codes: np.ndarray, groups: pa.Table, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the block's distinct pairs, hashes that deal them to buckets)."""
    width = max(len(groups), 1)
    pairs = np.unique(_adjacent(codes, width)[1]) if keys is None else keys
    left, right = (_numbers(groups, "id")[part].astype(np.uint64) for part in (pairs // width, pairs % width))
    mixed = (left * np.uint64(0x9E3779B97F4A7C15) + right) * np.uint64(0xC2B2AE3D27D4EB4F)
    return pairs, (mixed >> np.uint64(33)).astype(np.int64)


def _members(hashes: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Per bucket the places of its keys, in their order."""
    bucket = hashes % buckets
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, buckets)))


def _sent(block: int, members: list[np.ndarray], packed) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that has keys of the block."""
    own = [b for b, places in enumerate(members) if len(places)]
    yield pa.record_batch({"bucket": pa.array(own, pa.int64()), "block": pa.array([block] * len(own), pa.int64()),
                           "counts": pa.array([packed(members[b]) for b in own], pa.binary())})


def _word_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (codes, groups) in _relations(batches):
            words = groups.select(["lang", "phrase", "n"])
            yield from _sent(block, _members(_word_keys(codes, groups)[1], buckets), lambda at: _ipc(words.take(pa.array(at))))

    return run


def _pair_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (codes, groups) in _relations(batches):
            ids, width = _numbers(groups, "id"), max(len(groups), 1)
            pairs, counts = np.unique(_adjacent(codes, width)[1], return_counts=True)
            left, right = ids[pairs // width], ids[pairs % width]
            yield from _sent(block, _members(_pair_keys(codes, groups, pairs)[1], buckets),
                             lambda at: _squeeze(left[at], right[at], counts[at]))

    return run


def _read_words(values: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    tables = [pa.ipc.open_stream(v).read_all() for v in values]
    both = pa.concat_tables([t.set_column(2, "n", t["n"].cast(pa.int64())) for t in tables]).combine_chunks()
    lang, phrase = (both[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "phrase"))
    return [len(t) for t in tables], lang, phrase, _numbers(both, "n")


def _read_pairs(values: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    parts = [_unsqueeze(v, 3) for v in values]
    return [p.shape[1] for p in parts], *np.concatenate(parts, axis=1)


def _group_count(read, min_count: int, buckets: int, owners_only: bool):
    """A bucket's counts -> for each block its frequent phrases: steps between their places, ids, totals, ownership."""

    def run(counted: pa.Table) -> pa.Table:
        counted = counted.sort_by("block")
        bucket, blocks = counted["bucket"][0].as_py(), counted["block"].to_pylist()
        sizes, left, right, n = read(counted["counts"].to_pylist())
        order = np.lexsort((right, left))  # equal keys stay in the order of their blocks
        left, right = left[order], right[order]
        first = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
        totals = np.add.reduceat(n[order], np.flatnonzero(first))
        frequent = totals >= min_count
        ids = (np.cumsum(frequent) - 1) * buckets + bucket
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(first) - 1
        owner = np.empty(len(order), bool)
        owner[order] = first
        out = {"block": [], "bucket": [], "groups": []}
        for block, lo, size in zip(blocks, np.cumsum([0, *sizes[:-1]]), sizes):
            mine, owned = group[lo:lo + size], owner[lo:lo + size]
            at = np.flatnonzero(frequent[mine] & owned if owners_only else frequent[mine])
            if len(at):
                out["block"].append(block)
                out["bucket"].append(bucket)
                out["groups"].append(_squeeze(np.diff(at, prepend=0), ids[mine[at]], totals[mine[at]], owned[at]))
        return pa.table({"block": pa.array(out["block"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int64()),
                         "groups": pa.array(out["groups"], pa.binary())})

    return run


def _relations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, pa.Table]]]:
    for batch in batches:
        for block, relation in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield block, _unpack(relation)
            pa.default_memory_pool().release_unused()


def _words_by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, (_, groups) in _relations(batches):
        summed = groups.group_by("lang").aggregate([("n", "sum")])
        yield from _sliced(pa.table({"lang": summed["lang"], "n": summed["n_sum"].cast(pa.int64())}))


def _sliced(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.combine_chunks().to_batches(max_chunksize=_ROWS)


def _frequent_words(codes: np.ndarray, groups: pa.Table, gid: np.ndarray) -> tuple[np.ndarray, pa.Table]:
    kept = groups.take(pa.array(gid))
    number = np.full(len(groups) + 1, -1, np.int32)  # the code -1 picks the last entry
    number[gid] = np.arange(len(gid), dtype=np.int32)
    return number[codes], pa.table({"phrase": kept["phrase"], "lang": kept["lang"]})


def _frequent_pairs(codes: np.ndarray, groups: pa.Table, pairs: np.ndarray) -> tuple[np.ndarray, pa.Table]:
    """Occurrences of the ``pairs`` (ascending), with the parts' ids and the counts of all heads and tails."""
    width = max(len(groups), 1)
    at, keys = _adjacent(codes, width)
    left, right = pa.array(pairs // width), pa.array(pairs % width)
    a, b = groups.take(left), groups.take(right)
    size = 1 + sum(c.startswith("head") for c in groups.column_names)  # words of the joined phrases
    end = pc.replace_substring_regex(b["phrase"], r"(?s)^.* ", "")  # the last word
    columns = {"phrase": pc.binary_join_element_wise(a["phrase"], end, " "), "lang": a["lang"], "left": a["id"],
               "right": b["id"]}
    for k in range(1, size):
        columns |= {f"head{k}": a[f"head{k}"], f"tail{k}": b[f"tail{k}"]}
    out = np.full(len(codes), -1, np.int32)
    for lo in range(0, len(at), _ROWS) if len(pairs) else ():
        key = keys[lo:lo + _ROWS]
        number = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        out[at[lo:lo + _ROWS]] = np.where(pairs[number] == key, number, -1)
    return out, pa.table(columns | {f"head{size}": a["total"], f"tail{size}": b["total"]})


def _semi_join(keys_of, step, buckets: int, last: bool):
    """Stream of (block row, then the buckets' rows for it) -> block rows of the next relation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = None, []

        def row():
            block, codes, groups = held
            keys, hashes = keys_of(codes, groups)
            members = _members(hashes, buckets)
            told = [(members[bucket], _unsqueeze(value, 4)) for bucket, value in found]
            places = np.concatenate([np.zeros(0, np.int64), *(own[np.cumsum(t[0])] for own, t in told)])
            ids, totals, owner = np.concatenate([np.zeros((3, 0), np.int64), *(t[1:] for _, t in told)], axis=1)
            order = np.argsort(places)
            codes, kept = step(codes, groups, keys[places[order]])
            for name, values in (("id", ids), ("total", totals), ("owner", owner.astype(bool))):
                kept = kept.append_column(name, pa.array(values[order]))
            for name in {"left", "right"} & {*kept.column_names}:  # read in the owning block only
                at = kept.column_names.index(name)
                kept = kept.set_column(at, name, pc.if_else(kept["owner"], kept[name], pa.scalar(0, kept[name].type)))
            packed = _pack(codes[:0] if last else codes, kept)
            pa.default_memory_pool().release_unused()
            return pa.record_batch({"block": pa.array([block], pa.int64()), "relation": pa.array([packed], pa.binary())})

        for batch in batches:
            for block, relation, bucket, groups in zip(*batch.columns):
                if relation.is_valid:
                    if held is not None:
                        yield row()
                    held, found = (block.as_py(), *_unpack(relation)), []
                else:
                    found.append((bucket.as_py(), groups.as_py()))
        if held is not None:
            yield row()

    return run


# ---- Spark ---------------------------------------------------------------------------------------


def word_relation(docs: DataFrame) -> DataFrame:
    """R(0): all words of all texts in blocks of sorted positions."""
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return keep_table(texts.mapInArrow(_word_blocks, _RELATION), "setm-words", **_LARGE_VALUES)


def _frequent(counted: DataFrame, read, min_count: int, buckets: int, owners_only: bool) -> DataFrame:
    """For every block and bucket, the block's phrases that are frequent in all blocks together."""
    return counted.groupBy("bucket").applyInArrow(_group_count(read, min_count, buckets, owners_only), _FREQUENT)


def _kept_occurrences(relation: DataFrame, frequent: DataFrame, join, name: str) -> DataFrame:
    frequent = keep_table(frequent, f"{name}-frequent", **_LARGE_VALUES)  # the counts' shuffle goes before the next begins
    rows = relation.select("block", "relation", F.lit(None).cast("long").alias("bucket"),
                           F.lit(None).cast("binary").alias("groups")).unionByName(
        frequent.select("block", F.lit(None).cast("binary").alias("relation"), "bucket", "groups"))
    stream = rows.repartition("block").sortWithinPartitions("block", F.col("bucket").asc_nulls_first())
    kept = keep_table(stream.mapInArrow(join, _RELATION), name, **_LARGE_VALUES)
    drop_table(frequent)
    return kept


_CANDIDATE = ("id long, left long, right long, lang string, phrase string, words int, a long, l long, r long, score long")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of the blocks that own them, each with its lowest-scoring cut."""
    names = [c.split()[0] for c in _CANDIDATE.split(", ")]
    for _, (_, groups) in _relations(batches):
        own = groups.filter(groups["owner"])
        if not len(own):
            continue
        size = 1 + sum(c.startswith("head") for c in own.column_names)
        heads = [own[f"head{k}"].to_pylist() for k in range(1, size)]
        tails = [own[f"tail{k}"].to_pylist() for k in range(size - 1, 0, -1)]
        cuts = []
        for i, a in enumerate(own["total"].to_pylist()):
            parts = [(h[i], t[i]) for h, t in zip(heads, tails)]
            score, at = min((1_000_000 * a * a // (x * y), k) for k, (x, y) in enumerate(parts))
            cuts.append((*parts[at], score))
        l, r, score = (pa.array(c, pa.int64()) for c in zip(*cuts))
        ids, left, right, total = (own[c].cast(pa.int64()) for c in ("id", "left", "right", "total"))
        yield from _sliced(pa.table([ids, left, right, own["lang"], own["phrase"], pa.array([size] * len(own), pa.int32()),
                                     total, l, r, score], names))


def phrase_candidates(docs: DataFrame, max_words: int = 3, min_count: int = 10) -> tuple[DataFrame, DataFrame]:
    """(candidates of 2 to ``max_words`` words with their counts and score, word occurrences ``n`` by lang)."""
    with released_shuffles(docs.sparkSession):  # only tables go from step to step
        before = word_relation(docs)
        totals = keep_table(before.mapInArrow(_words_by_lang, "lang string, n long").groupBy("lang").agg(
            F.sum("n").alias("n")), "setm-totals")
        buckets = max(before.count() // BLOCKS_A_BUCKET, 1)
        words = before.mapInArrow(_word_counts(buckets), _COUNTED)
        relation = _kept_occurrences(before, _frequent(words, _read_words, min_count, buckets, False),
                                     _semi_join(_word_keys, _frequent_words, buckets, False), "setm-1")
        found = None
        for size in range(2, max_words + 1):
            drop_table(before)
            before, last = relation, size == max_words
            pairs = before.mapInArrow(_pair_counts(buckets), _COUNTED)
            # the last ones are not extended: the blocks that own the phrases are enough
            relation = _kept_occurrences(before, _frequent(pairs, _read_pairs, min_count, buckets, last),
                                         _semi_join(_pair_keys, _frequent_pairs, buckets, last), f"setm-{size}")
            scored = keep_table(relation.mapInArrow(_scored, _CANDIDATE), f"setm-candidates-{size}")
            found = scored if found is None else found.unionByName(scored)
        drop_table(before)
        drop_table(relation)
    return found, totals


def mine_phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10, inside_percent: int = 50,
                 top: int = 2000) -> DataFrame:
    """The best ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    A candidate goes when a longer candidate that holds it occurs at least ``inside_percent`` % as often.  The longer
    candidate of one word more that occurs most decides this: whatever is longer still occurs no more often.
    """
    found, totals = phrase_candidates(docs, max_words, min_count)
    longer = (found.where("words > 2")  # ids are numbered for each length
              .select((F.col("words") - 1).alias("words"), F.explode(F.array("left", "right")).alias("id"), "a")
              .groupBy("words", "id").agg(F.max("a").alias("longer")))
    free = (found.join(longer, ["words", "id"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free.select("lang", F.row_number().over(best).alias("rank"), "phrase", "a", "l", "r", "score").where(
        F.col("rank") <= top)
    return (ranked.join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
